"""Text size metrics, size tiers and templated request texts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from accordance.functions.common import col

# Fixed values: (upper bound of token estimate, context size); None = no bound.
CONTEXT_DEFAULT = ((3000, 4096), (6000, 6144), (None, 8192))
CONTEXT_CAUTIOUS = ((2000, 3072), (None, 4096))
CONTEXT_SIMPLE = ((3000, 2048), (6000, 4096), (None, 6144))

# Characters above which the longer timeout / the file route applies.
TIMEOUT_LIMIT, TIMEOUT_SHORT, TIMEOUT_LONG = 50_000, 200, 300
DIRECT_LIMIT = 100_000

# Line ends as a text splitter sees them: every Unicode line break.
LINE_BREAK = r"\R|[\x1c-\x1e]"


def char_count(text: Column | str) -> Column:
    return F.coalesce(F.length(col(text)), F.lit(0)).cast("bigint")


def line_count(text: Column | str) -> Column:
    """Lines of a text; a trailing line break opens no further line."""
    t = col(text)
    open_line = F.when(t.rlike(r"(?:\R|[\x1c-\x1e])\z") | (t == ""), 0).otherwise(1)
    return F.coalesce(F.regexp_count(t, F.lit(LINE_BREAK)) + open_line, F.lit(0)).cast(
        "bigint"
    )


def token_estimate(text: Column | str) -> Column:
    n = char_count(text)
    return F.when(n == 0, F.lit(0)).otherwise(
        F.greatest(F.lit(1), F.floor(n / 4))
    ).cast("bigint")


def tier(value: Column, tiers: Sequence[tuple[int | None, int]]) -> Column:
    out: Column | None = None
    for bound, result in tiers:
        if bound is None:
            return F.lit(result).cast("bigint") if out is None else out.otherwise(
                F.lit(result).cast("bigint")
            )
        step = F.lit(result).cast("bigint")
        out = F.when(value < bound, step) if out is None else out.when(value < bound, step)
    return out


def timeout_tier(chars: Column) -> Column:
    return F.when(chars > TIMEOUT_LIMIT, TIMEOUT_LONG).otherwise(TIMEOUT_SHORT).cast("bigint")


def route(chars: Column, limit: int = DIRECT_LIMIT) -> Column:
    return F.when(chars > limit, "file").otherwise("direct")


def render(template: str, values: Mapping[str, Column]) -> Column:
    """A text column from a template with `{name}` places; a missing value is empty."""
    parts = []
    for piece in re.split(r"(\{[a-z_0-9]+\})", template):
        name = piece[1:-1]
        if piece.startswith("{") and name in values:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)
