"""Row filters and their reports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordance import schemas as S
from accordance.functions import labels as L
from accordance.functions.common import count_where, ratio


def valid_keys(df: DataFrame, key: str = "item_key", min_length: int = 7) -> DataFrame:
    return df.where(L.valid_key(key, min_length))


def valid_keys_report(df: DataFrame, key: str = "item_key", min_length: int = 7) -> DataFrame:
    ok = L.valid_key(key, min_length)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        count_where(ok).alias("valid_rows"),
        count_where(~ok).alias("removed_rows"),
    )


def split_labelled(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(label).isNotNull()), df.where(F.col(label).isNull())


def pending(df: DataFrame, label: str = "candidate_label") -> DataFrame:
    return df.where(L.is_pending(label))


def completed(
    df: DataFrame,
    label: str = "candidate_label",
    failures: Iterable[str] = S.FAILURE_STATUSES,
) -> DataFrame:
    return df.where(L.is_completed(label, failures))


def both_classified(
    df: DataFrame,
    reference: str = "reference_label",
    candidate: str = "candidate_label",
    failures: Iterable[str] = S.FAILURE_STATUSES,
) -> DataFrame:
    return df.where(L.both_classified(reference, candidate, failures))


def by_reference(df: DataFrame, label: str, reference: str = "reference_label") -> DataFrame:
    return df.where(F.col(reference) == label)


def _holds_token(df: DataFrame, tokens: Sequence[str], columns: Sequence[str] | None) -> Column:
    hit = F.lit(False)
    for c in columns or df.columns:
        cell = F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
        for t in tokens:
            hit = hit | cell.contains(t.lower())
    return hit


def drop_rows_with_token(
    df: DataFrame,
    tokens: Sequence[str] = ("none", "failed"),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Rows in which no cell holds one of the tokens, whatever the case."""
    return df.where(~_holds_token(df, tokens, columns))


def token_report(
    df: DataFrame,
    tokens: Sequence[str] = ("none", "failed"),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    hit = _holds_token(df, tokens, columns)
    n, out = F.count(F.lit(1)), count_where(hit)
    return df.agg(
        n.alias("total_rows"),
        (n - out).alias("kept_rows"),
        out.alias("excluded_rows"),
        ratio(out, n, 100.0).alias("excluded_pct"),
    )


STANDARD_NAMES = {
    "item_key": "commit_hash",
    "reference_label": "purity_classification",
    "candidate_label": "llm_classification",
}


def to_standard(df: DataFrame, names: Mapping[str, str] = STANDARD_NAMES) -> DataFrame:
    """Rename to the column names of the comparison files."""
    return df.withColumnsRenamed(dict(names))


def with_agreement(
    df: DataFrame, reference: str = "reference_label", candidate: str = "candidate_label"
) -> DataFrame:
    """Reference label in candidate words plus the agreement flag."""
    return df.withColumn("reference_normalized", L.map_label(reference)).withColumn(
        "agreement", L.agrees("reference_normalized", candidate)
    )


def with_membership(
    df: DataFrame,
    reference: str = "reference_label",
    candidate: str = "candidate_label",
    no_reference: str = S.NOT_IN_REFERENCE,
    no_candidate: str = S.NOT_ANALYSED,
) -> DataFrame:
    """`in_reference`, `analysed` and `agreement` over sentinel-filled labels."""
    in_ref = F.col(reference) != no_reference
    in_cand = F.col(candidate) != no_candidate
    return df.withColumns(
        {
            "in_reference": in_ref,
            "analysed": in_cand,
            "agreement": in_ref & in_cand & L.agrees(reference, candidate),
        }
    )


def facet(
    df: DataFrame,
    agreement: bool | None = None,
    reference: str | None = None,
    candidate: str | None = None,
    reference_col: str = "reference_label",
    candidate_col: str = "candidate_label",
) -> DataFrame:
    """Rows that pass every facet given; None leaves a facet open."""
    for name, value in (
        ("agreement", agreement), (reference_col, reference), (candidate_col, candidate),
    ):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def facet_stats(df: DataFrame, **facets) -> DataFrame:
    n = F.count(F.lit(1))
    good = count_where(F.col("agreement"))
    return facet(df, **facets).agg(
        n.alias("total"),
        good.alias("agreements"),
        F.round(ratio(good, n, 100.0), 1).alias("agreement_pct"),
    )


def worklist(df: DataFrame, limit: int | None = None, label: str = "label") -> DataFrame:
    """Labelled records projected to the work-list columns, optionally the first few."""
    out = df.where(F.col(label).isNotNull()).select(
        "item_key",
        L.kind_of_flag(label).alias("kind_of_change"),
        F.col(label).alias("label"),
        *[c for c in ("description", "kind", "detail", "had_conflict") if c in df.columns],
    )
    return out if limit is None else out.orderBy("item_key").limit(limit)
