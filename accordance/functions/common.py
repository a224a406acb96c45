"""Small column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a text counts as white space, beyond ASCII too.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside ``body``; without it a nested lambda
    re-evaluates the whole expression for each of its elements."""
    return F.transform(F.array(value), body).getItem(0)


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def non_empty(c: Column | str) -> Column:
    """NULL for an empty text."""
    return F.nullif(col(c), F.lit(""))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a pattern's group, NULL where there is none."""
    return non_empty(F.regexp_extract(text, pattern, group))


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """part / whole * scale as double, 0 where the whole is missing or zero."""
    p, w = part.cast("double"), whole.cast("double")
    return F.coalesce(F.try_divide(p, w) * F.lit(scale), F.lit(0.0))


def total(c: Column) -> Column:
    """Sum of counts as bigint, 0 over no rows."""
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def count_where(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")


def equal(a: Column, b: Column) -> Column:
    """Equality that is false, not NULL, when a side is missing."""
    return F.coalesce(a == b, F.lit(False))
