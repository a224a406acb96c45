"""Ledger maintenance: increments, batches, recovery, change logs (M1-M9, L1-L3)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordance.functions import answers as A
from accordance.functions import labels as L
from accordance.functions.common import count_where
from accordance.operators.compare import patch_fill
from accordance.operators.ordered import first_per_key, number_rows

C = "candidate_label"


# ---------------------------------------------------------------------------
# Choosing work


def first_pending(
    ledger: DataFrame, n: int, key: str = "item_key", label: str = C
) -> DataFrame:
    return ledger.where(L.is_pending(label)).orderBy(key).limit(n)


def shortfall(ledger: DataFrame, n: int, label: str = C) -> DataFrame:
    """How many rows of a ledger are pending, and how many fewer than ``n`` these are."""
    have = count_where(L.is_pending(label))
    return ledger.agg(
        have.alias("pending"), F.greatest(F.lit(n) - have, F.lit(0)).alias("shortfall")
    )


def first_distinct(df: DataFrame, n: int, key: str = "item_key") -> DataFrame:
    return df.select(key).distinct().orderBy(key).limit(n)


def random_pending(ledger: DataFrame, seed: int, key: str = "item_key", label: str = C) -> DataFrame:
    """One pending row by seeded hash order, the same for the same seed."""
    mixed = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    return ledger.where(L.is_pending(label)).orderBy(mixed, key).limit(1)


def with_batches(
    pending: DataFrame, size: int, order: Sequence[str] = ("item_key",)
) -> DataFrame:
    """Batch number of each pending row, in order."""
    return number_rows(pending, order).withColumn(
        "batch_no", F.floor((F.col("row_no") - 1) / size).cast("bigint") + 1
    )


# ---------------------------------------------------------------------------
# The increment


Scorer = Callable[[DataFrame], DataFrame]


def native_scorer(responses: DataFrame) -> DataFrame:
    """(item_key, response) to (item_key, label, status) by indicator scoring."""
    empty = F.coalesce(F.trim("response") == "", F.lit(True))
    return responses.select(
        "item_key",
        F.when(~empty, F.upper(A.indicator_label("response"))).alias("label"),
        F.when(empty, "FAILED").otherwise("OK").alias("status"),
    )


def label_increment(
    ledger: DataFrame,
    responses: DataFrame,
    scorer: Scorer = native_scorer,
    reference: str | None = None,
    limit: int | None = None,
    skip_labelled: bool = True,
    order: Sequence[str] = ("response",),
) -> DataFrame:
    """Label the pending part of a ledger and return the whole ledger.

    ``outcome`` tells per row whether it was labelled, failed or left as it was.
    Of several responses to a key the last one by ``order`` counts, and a key that the ledger
    holds twice is asked once. Only responses to keys in question are scored.
    """
    work = ledger
    if reference is not None:
        work = work.where(F.col("reference_label") == reference)
    if skip_labelled:
        work = work.where(L.is_pending(C))
    work = work.select("item_key").distinct()
    if limit is not None:
        work = work.orderBy("item_key").limit(limit)
    answers = responses.select("item_key", *dict.fromkeys(["response", *order]))
    asked = first_per_key(answers.join(work, "item_key", "left_semi"), "item_key", order, last=True)
    scored = scorer(work.join(asked.select("item_key", "response"), "item_key", "left"))
    scored = scored.select(
        "item_key",
        F.when(F.col("status") == "OK", F.col("label"))
        .otherwise(F.coalesce("status", F.lit("FAILED")))
        .alias("_new"),
    )
    return ledger.join(scored, "item_key", "left").select(
        *[c for c in ledger.columns if c != C],
        F.coalesce("_new", C).alias(C),
        F.when(F.col("_new").isNull(), "kept")
        .when(F.col("_new").isin("FAILED", "ERROR"), "failed")
        .otherwise("labelled")
        .alias("outcome"),
    )


def increment_stats(result: DataFrame) -> DataFrame:
    out = F.col("outcome")
    return result.agg(
        count_where(out != "kept").alias("processed"),
        count_where(out == "labelled").alias("successful"),
        count_where(out == "failed").alias("failed"),
        count_where(out == "kept").alias("skipped"),
    )


def bootstrap(master: DataFrame, existing: DataFrame, annotator: str) -> DataFrame:
    """Rows a new annotator's ledger lacks, taken from the master list unlabelled."""
    mine = existing.where(F.col("annotator") == annotator).select("item_key")
    return master.join(mine, "item_key", "left_anti").select(
        "item_key",
        "reference_label",
        F.lit(None).cast("string").alias(C),
        F.lit(annotator).alias("annotator"),
    )


def reset_labels(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn(C, F.lit(None).cast("string"))


def analysed_keys(log: DataFrame) -> DataFrame:
    """Distinct keys of the analysed log, whichever column holds the key."""
    return (
        log.select(L.first_of(log, "commit2", "commit_hash_current", "item_key").alias("item_key"))
        .where(F.col("item_key").isNotNull())
        .distinct()
    )


# ---------------------------------------------------------------------------
# Recovery


def recover(
    ledger: DataFrame,
    snapshots: DataFrame,
    last: bool = False,
    taken: str = "taken_at",
    source: str = "source",
) -> DataFrame:
    """Labels for keys of the ledger that have none: first or last snapshot wins.

    Output: item_key, candidate_label, source. One partial aggregation picks the
    winner, so a key found in very many snapshots stays cheap.
    """
    open_keys = ledger.where(L.is_pending(C)).select("item_key").distinct()
    have = snapshots.where(~L.is_pending(C)).join(open_keys, "item_key", "left_semi")
    at = F.struct(F.col(taken), F.col(source), F.col(C))
    pick = F.max_by if last else F.min_by
    row = pick(F.struct(F.col(C).alias("label"), F.col(source).alias("source")), at)
    return have.groupBy("item_key").agg(row.alias("_r")).select(
        "item_key", F.col("_r.label").alias(C), F.col("_r.source").alias("source")
    )


def apply_recovery(ledger: DataFrame, recovered: DataFrame) -> DataFrame:
    return patch_fill(ledger, recovered)


def session_labels(analyses: DataFrame) -> DataFrame:
    """Flattened session analyses in snapshot form (the file name is the order)."""
    return analyses.where(
        L.canonical("item_key").isNotNull() & L.canonical(C).isNotNull()
    ).select("item_key", C, F.col("file_name").alias("source"), F.col("file_name").alias("taken_at"))


def change_log(old: DataFrame, new: DataFrame, source: str | None = None) -> DataFrame:
    """Keys whose label differs between two states of a ledger."""
    before = old.select("item_key", F.when(~L.is_pending(C), F.col(C)).alias("old_label"))
    after = new.select(
        "item_key",
        F.when(~L.is_pending(C), F.col(C)).alias("new_label"),
        *([F.col(source).alias("source")] if source else []),
    )
    both = before.join(after, "item_key", "full_outer")
    o, n = F.col("old_label"), F.col("new_label")
    kind = (
        F.when(o.isNull() & n.isNotNull(), "new")
        .when(o.isNotNull() & n.isNull(), "removed")
        .when(o != n, "changed")
    )
    return both.withColumn("change", kind).where(F.col("change").isNotNull())
