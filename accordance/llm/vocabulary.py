"""Vocabularies of public tokenizers, loaded once per worker. Paths are parameters."""

from __future__ import annotations

import base64
from functools import lru_cache


@lru_cache(4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


@lru_cache(4)
def ranked(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id."""
    ranks = _ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, k in ranks.items():
        out[k] = piece
    return out


@lru_cache(4)
def library(path: str):
    """A tokenizer of the tokenizers library that does not start threads of its own."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
