"""All registered queries of this folder: name -> (query, SQL or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "bpe", "chat", "decontaminate", "language", "middle", "mixing", "near_dup", "packed", "personal", "repeats",
    "resample", "token_counts", "vectors",
)


def all_queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(import_module(f"accordance.llm.{m}").QUERIES)
    return out
