"""Many tri-state records per key to one label (A2-A4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordance.functions import labels as L
from accordance.functions.common import count_where


def _state_tests(df: DataFrame, state: str) -> tuple[Column, Column, Column]:
    """(is false, is true, is none) of a boolean or text state column."""
    c = F.col(state)
    if dict(df.dtypes)[state] == "boolean":
        return ~c, c, c.isNull()
    text = F.lower(c)
    return text == "false", text == "true", text == "none"


def resolve_labels(df: DataFrame, key: str = "item_key", state: str = "label") -> DataFrame:
    """FALSE if any record says false, else TRUE if any says true, else NONE if any
    record says none, else UNKNOWN. One partial and one final aggregation."""
    is_false, is_true, is_none = _state_tests(df, state)
    n_false, n_true, n_none = (count_where(t) for t in (is_false, is_true, is_none))
    return (
        df.groupBy(key)
        .agg(n_false.alias("n_false"), n_true.alias("n_true"), n_none.alias("n_none"))
        .select(
            key,
            F.when(F.col("n_false") > 0, "FALSE")
            .when(F.col("n_true") > 0, "TRUE")
            .when(F.col("n_none") > 0, "NONE")
            .otherwise("UNKNOWN")
            .alias("resolved_label"),
            "n_false",
            "n_true",
            "n_none",
        )
    )


def resolve_ledger(
    keys: DataFrame, records: DataFrame, key: str = "item_key", state: str = "label"
) -> DataFrame:
    """Every key of the list gets its resolved label, NOT_FOUND where it has no record."""
    resolved = resolve_labels(records, key, state).select(key, "resolved_label")
    return keys.join(resolved, key, "left").withColumn(
        "reference_label", F.coalesce("resolved_label", F.lit("NOT_FOUND"))
    ).drop("resolved_label")


def match_report(ledger: DataFrame, reference: str = "reference_label") -> DataFrame:
    return ledger.agg(
        F.count(F.lit(1)).alias("keys"),
        count_where(F.col(reference) != "NOT_FOUND").alias("matches"),
    )


def consolidate(
    df: DataFrame,
    order: Sequence[str],
    key: str = "item_key",
    label: str = "label",
    kind: str = "kind",
    detail: str = "detail",
    min_key_length: int = 7,
) -> DataFrame:
    """One record per key out of many, with conflicts kept visible.

    The base is the first record (the first false one under conflict). Details (and
    kinds, without conflict) are joined distinct in order; under conflict each
    detail carries its label. Unlabelled records add their own first row per key.

    Copies are folded per (key, label, kind, detail) before a key's rows meet, so a
    hot key brings only its distinct texts to the final step.
    """
    df = df.where(L.valid_key(key, min_key_length))
    others = [c for c in df.columns if c not in (key, label, kind, detail)]
    # Ordering columns first: the smallest struct is the first row, ties included.
    row = F.struct(*[F.col(c) for c in [*order, *[c for c in others if c not in order]]])

    folded = df.groupBy(key, label, kind, detail).agg(F.min(row).alias("_row"))
    entry = F.struct(
        "_row", F.col(label).alias("l"), F.col(kind).alias("k"), F.col(detail).alias("d")
    )
    at = F.struct(*[F.col("_row")[c].alias(c) for c in order])
    text = F.struct(
        at.alias("at"), F.col(label).alias("l"), F.col(kind).alias("k"), F.col(detail).alias("d")
    )
    has_label = F.col(label).isNotNull()
    grouped = folded.groupBy(key).agg(
        F.bool_or(label).alias("_any_true"),
        F.bool_or(~F.col(label)).alias("_any_false"),
        F.min(F.when(has_label, entry)).alias("_first"),
        F.min(F.when(~F.col(label), entry)).alias("_first_false"),
        F.min(F.when(~has_label, entry)).alias("_unlabelled"),
        F.array_sort(F.collect_list(F.when(has_label, text))).alias("_all"),
    )

    def joined(piece) -> Column:
        texts = F.array_distinct(F.array_compact(F.transform("_all", piece)))
        return F.when(F.size(texts) > 0, F.array_join(texts, " | "))

    tagged = joined(
        lambda e: F.when(
            e["d"].isNotNull(),
            F.concat(F.when(e["l"], "[True] ").otherwise("[False] "), e["d"]),
        )
    )
    clash = F.coalesce(F.col("_any_true") & F.col("_any_false"), F.lit(False))
    resolved = (
        grouped.withColumn("_clash", clash)
        .withColumn("_base", F.when(clash, F.col("_first_false")).otherwise(F.col("_first")))
        .withColumn("_details", F.when(clash, tagged).otherwise(joined(lambda e: e["d"])))
        .withColumn("_kinds", F.when(~clash, joined(lambda e: e["k"])))
    )

    def record(base: str, kinds: Column, details: Column, conflict: Column) -> Column:
        return F.when(
            F.col(base).isNotNull(),
            F.struct(
                F.col(f"{base}.l").alias(label),
                kinds.alias(kind),
                details.alias(detail),
                *[F.col(f"{base}._row")[c].alias(c) for c in others],
                conflict.alias("had_conflict"),
            ),
        )

    # A key yields its labelled record, its unlabelled one, or both.
    records = F.array_compact(
        F.array(
            record(
                "_base",
                F.coalesce("_kinds", F.col("_base.k")),
                F.coalesce("_details", F.col("_base.d")),
                F.col("_clash"),
            ),
            record(
                "_unlabelled", F.col("_unlabelled.k"), F.col("_unlabelled.d"), F.lit(False)
            ),
        )
    )
    return resolved.select(key, F.inline(records))
