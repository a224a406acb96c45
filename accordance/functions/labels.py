"""Label and key expressions (plain columns in, plain columns out)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordance import schemas as S
from accordance.functions.common import col, equal, found, non_empty, strip


def canonical(c: Column | str) -> Column:
    """Missing-value texts of a CSV ledger become NULL."""
    c = strip(c)
    return F.when(~c.isin(*S.CSV_MISSING), c)


def canonical_label(c: Column | str) -> Column:
    return F.upper(canonical(c))


def normalize_label(c: Column | str) -> Column:
    """Any spelling to TRUE / FALSE / NULL; other texts pass through upper-cased."""
    s = F.upper(strip(c))
    return (
        F.when(s.isNull() | s.isin(*S.MISSING_SPELLINGS), F.lit(None).cast("string"))
        .when(s.isin(*S.TRUE_SPELLINGS), "TRUE")
        .when(s.isin(*S.FALSE_SPELLINGS), "FALSE")
        .when(s.contains("PURE"), "TRUE")
        .when(s.contains("FLOSS") | s.contains("FALSE"), "FALSE")
        .otherwise(s)
    )


def map_label(
    c: Column | str,
    mapping: Mapping[str, str] = S.REFERENCE_TO_CANDIDATE,
    keep_unmapped: bool = False,
) -> Column:
    """Translate labels; an unmapped label becomes NULL or is kept."""
    c = col(c)
    out = F.lit(None).cast("string") if not keep_unmapped else c
    for source, target in reversed(list(mapping.items())):
        out = F.when(c == source, target).otherwise(out)
    return out


def upper_or(c: Column | str, default: str = "UNKNOWN") -> Column:
    return F.upper(F.coalesce(col(c), F.lit(default)))


def lower_or(c: Column | str, default: str = S.NOT_FOUND) -> Column:
    return F.lower(F.coalesce(non_empty(c), F.lit(default)))


def repo_from_url(c: Column | str) -> Column:
    """Last path segment without its `.git`."""
    return F.replace(F.element_at(F.split(col(c), "/"), -1), F.lit(".git"), F.lit(""))


def repo_after_slash(c: Column | str) -> Column:
    """Text after the final slash; `unknown` without one."""
    return F.coalesce(found(col(c), r"/([^/]+)$"), F.lit("unknown"))


def repo_or_whole(c: Column | str) -> Column:
    """Last segment, or the whole text when it has no slash; missing -> `unknown`."""
    c = col(c)
    return F.when(c.isNull() | (c == ""), "unknown").otherwise(
        F.element_at(F.split(c, "/"), -1)
    )


def valid_key(c: Column | str, min_length: int = 7) -> Column:
    return F.coalesce(F.length(col(c)) >= min_length, F.lit(False))


def is_pending(c: Column | str) -> Column:
    c = col(c)
    return c.isNull() | c.isin("", "None")


def is_completed(
    c: Column | str, failures: Iterable[str] = S.FAILURE_STATUSES
) -> Column:
    c = col(c)
    return c.isNotNull() & (c != "") & ~c.isin(*failures)


def both_classified(
    reference: Column | str,
    candidate: Column | str,
    failures: Iterable[str] = S.FAILURE_STATUSES,
) -> Column:
    r = col(reference)
    return r.isNotNull() & (r != "") & is_completed(candidate, failures)


def agrees(a: Column | str, b: Column | str) -> Column:
    return equal(col(a), col(b))


def short_key(c: Column | str, width: int = 8) -> Column:
    return F.substring(col(c), 1, width)


def first_of(df: DataFrame, *names: str) -> Column:
    """Value from the first of several column names that exists and is not empty."""
    present = [non_empty(F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def kind_of_flag(c: Column | str) -> Column:
    """Boolean label to its work-list name."""
    c = col(c)
    return F.when(c, "pure").when(~c, "floss")
