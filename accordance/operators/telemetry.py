"""Windows over items, batches, sessions and durations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordance.functions.common import col, count_where, ratio
from accordance.operators.ordered import (
    first_per_key, first_rows, number_rows, running_sum, within_groups,
)


def last_per_group(items: DataFrame, group: str, order: Sequence[str], n: int = 12) -> DataFrame:
    return first_rows(items, group, [F.desc(c) for c in order], n)


def dedupe_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return first_per_key(df, key, order)


def dedupe_report(df: DataFrame, key: str) -> DataFrame:
    """Rows kept and removed by a keep-first dedupe; two-level, so no hot key task."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.sum("n").alias("rows_before"),
            F.count(F.lit(1)).alias("rows_after"),
            (F.sum("n") - F.count(F.lit(1))).alias("rows_removed"),
        )
    )


def batch_timeline(
    df: DataFrame, order: Sequence[str], label: str, labels: Sequence[str], size: int = 10
) -> DataFrame:
    """Label counts per run of ``size`` rows in order."""
    numbered = number_rows(df.select(*dict.fromkeys([*order, label])), order)
    batch = F.floor((F.col("row_no") - 1) / size).cast("bigint") + 1
    return numbered.groupBy(batch.alias("batch_no")).agg(
        *[count_where(F.col(label) == v).alias(v) for v in labels]
    ).withColumn("batch", F.concat(F.lit("Batch "), F.col("batch_no").cast("string")))


def time_timeline(
    df: DataFrame, ts: str, label: str, labels: Sequence[str], unit: str | None = None
) -> DataFrame:
    """Label counts per timestamp, or per truncated timestamp."""
    at = F.col(ts) if unit is None else F.date_trunc(unit, ts)
    return df.groupBy(at.alias("bucket")).agg(
        *[count_where(F.col(label) == v).alias(v) for v in labels]
    )


def cumulative(
    sessions: DataFrame,
    order: Sequence[str] = ("start_time", "session_id"),
    value: str = "total_processed",
) -> DataFrame:
    return running_sum(sessions, order, value, "cumulative")


def _micros(start: str, end: str):
    """Exact difference, so that rates need a single division."""
    return F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(
        F.col(start).cast("timestamp")
    )


def session_rates(sessions: DataFrame) -> DataFrame:
    """Duration, success share and items per minute; 0 where undefined."""
    minutes = _micros("start_time", "end_time") / 60_000_000
    return sessions.select(
        "*",
        minutes.alias("duration_minutes"),
        ratio(F.col("ok"), F.col("total_processed"), 100.0).alias("success_pct"),
        F.coalesce(
            F.try_divide(F.col("total_processed").cast("double"), minutes), F.lit(0.0)
        ).alias("items_per_minute"),
    )


def last_sessions(sessions: DataFrame, n: int = 5) -> DataFrame:
    return sessions.orderBy(F.desc("start_time"), F.desc("session_id")).limit(n)


def progress(sessions: DataFrame, total_items: int | DataFrame) -> DataFrame:
    """Done, remaining, rate per hour and hours left. The total is a number or a
    one-row frame."""
    whole = F.lit(total_items) if isinstance(total_items, int) else total_items.scalar()
    timed = F.col("start_time").isNotNull() & F.col("end_time").isNotNull()
    span = F.when(timed, _micros("start_time", "end_time"))
    sums = sessions.agg(
        F.coalesce(F.sum("ok"), F.lit(0)).alias("done"),
        F.coalesce(F.sum(F.when(timed, F.col("ok"))), F.lit(0)).alias("timed_done"),
        F.coalesce(F.sum(span), F.lit(0)).alias("micros"),
    ).withColumn("total", whole.cast("bigint"))
    left = F.col("total") - F.col("done")
    rate = ratio(F.col("timed_done"), F.col("micros") / 3_600_000_000)
    return sums.select(
        "total",
        "done",
        left.alias("remaining"),
        ratio(F.col("done"), F.col("total"), 100.0).alias("progress_pct"),
        rate.alias("items_per_hour"),
        F.when(rate > 0, left / rate).otherwise(0.0).alias("hours_left"),
    )


def item_eta(
    done: DataFrame, total: int, start: str = "start_time", now: str = "now", n: str = "done"
) -> DataFrame:
    """Elapsed, mean per item and estimated seconds left per progress record."""
    elapsed = _micros(start, now) / 1_000_000
    mean = ratio(elapsed, col(n))
    return done.select(
        "*",
        elapsed.alias("elapsed_seconds"),
        ratio(col(n), F.lit(total), 100.0).alias("progress_pct"),
        (mean * (F.lit(total) - col(n))).alias("eta_seconds"),
    )


def event_durations(events: DataFrame, group: str, order: Sequence[str], at: str, size: bool = False) -> DataFrame:
    """Time since the group's previous event, for each event that has one.

    ``item_no`` counts them, ``previous`` is the duration before, and ``n_items`` (with ``size``) is how many the
    group has: one pass gives what `degradation` and `half_drift` would work out again.
    """
    out = within_groups(events, group, order, at, seq="_seq", prev=["_one", "_two"], size="_size" if size else None)
    return out.where("_seq > 1").select(
        *events.columns,
        (F.col(at) - F.col("_one")).alias("duration"),
        (F.col("_seq") - 1).alias("item_no"),
        (F.col("_one") - F.col("_two")).alias("previous"),
        *([(F.col("_size") - 1).alias("n_items")] if size else []),
    )


def degradation(
    durations: DataFrame,
    group: str,
    order: Sequence[str],
    duration: str = "duration",
    factor: float = 3.0,
    marker_every: int = 8,
    numbered: bool = False,
) -> DataFrame:
    """Items slower than ``factor`` times the one before, and every n-th item.

    ``numbered`` durations bring ``item_no`` and ``previous`` along, as those of `event_durations` do.
    """
    out = durations if numbered else within_groups(durations, group, order, duration, seq="item_no", prev="previous")
    return out.select(
        "*",
        F.coalesce(F.col(duration) > F.col("previous") * factor, F.lit(False)).alias("degraded"),
        (F.col("item_no") % marker_every == 0).alias("marker"),
    )


def half_drift(
    durations: DataFrame,
    group: str,
    order: Sequence[str],
    duration: str = "duration",
    factor: float = 1.5,
    numbered: bool = False,
) -> DataFrame:
    """Mean of the second half of each group against the first.

    ``numbered`` durations bring ``item_no`` and ``n_items`` along.
    """
    if not numbered:
        needed = durations.select(*dict.fromkeys([group, *order, duration]))
        durations = within_groups(needed, group, order, seq="item_no", size="n_items")
    first = F.col("item_no") <= F.floor(F.col("n_items") / 2)
    halves = durations.groupBy(group).agg(
        F.count_if(first).alias("first_n"),
        F.count_if(~first).alias("second_n"),
        F.sum(F.when(first, F.col(duration))).alias("_a"),
        F.sum(F.when(~first, F.col(duration))).alias("_b"),
    )
    return halves.select(
        group,
        "first_n",
        "second_n",
        ratio(F.col("_a"), F.col("first_n")).alias("first_mean"),
        ratio(F.col("_b"), F.col("second_n")).alias("second_mean"),
    ).withColumn("drifted", (F.col("first_n") > 0) & (F.col("second_mean") > F.col("first_mean") * factor))


def grade_rows(
    durations: DataFrame, drift: DataFrame, group: str, duration: str = "duration"
) -> DataFrame:
    """Grade of each item against its group's first half: ok, slow (1.5x), bad (2x)."""
    d, base = F.col(duration), F.col("first_mean")
    grade = F.when(d > base * 2, "bad").when(d > base * 1.5, "slow").otherwise("ok")
    return durations.join(drift.select(group, "first_mean"), group, "left").select(
        *durations.columns, grade.alias("grade")
    )
