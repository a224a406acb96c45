"""All registered queries: name -> (query, SQL or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "label_queries", "join_queries", "agreement_queries", "telemetry_queries",
    "extract_queries", "ledger_queries",
)


def all_queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(import_module(f"accordance.plans.{m}").QUERIES)
    return out
