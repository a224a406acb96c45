"""Numbering, running sums and neighbours over a total order, without one-task windows.

A window without a partition moves all rows to one task, and a window by group
moves a hot group to one task. Here the rows are cut into slices of the full order
instead, so even one group's rows (or one timestamp's) spread over slices. The cuts
come from a bounded sample, a subquery of the same plan: the rows with the
smallest hashes of their order, so the same table is always cut the same way, and nothing
runs before the result is asked for. A row finds its slice by binary search. Rows are shuffled
once, by slice; what a slice needs from other slices is one row per slice, the only thing ever broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordance.functions.common import col
from accordance.session import shuffle_width

#: Rows of the sample per slice.
_SAMPLE = 16


def _key(order: Sequence) -> Column:
    return F.struct(*[col(c).alias(f"_{i}") for i, c in enumerate(order)])


def sliced(df: DataFrame, order: Sequence) -> DataFrame:
    """``df`` with ``_slice``: slices ascend in the (ascending) order."""
    slices = shuffle_width(df.sparkSession)
    key = _key(order)
    sample = df.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(_SAMPLE * slices)
    # every _SAMPLE-th of at most _SAMPLE * slices sorted rows
    cuts = sample.agg(F.array_sort(F.collect_list("k")).alias("k")).select(
        F.transform(
            F.filter(F.sequence(F.lit(1), F.lit(slices - 1)), lambda i: i * _SAMPLE < F.size("k")),
            lambda i: F.get("k", i * _SAMPLE),
        )
        if slices > 1
        else F.slice("k", 1, 0)
    )
    with_cuts = df.withColumns({"_cuts": cuts.scalar(), "_key": key})
    steps = [1 << k for k in reversed(range((slices - 1).bit_length()))]
    # how many cuts are not above the key
    place = F.aggregate(
        F.array(*map(F.lit, steps or [0])),
        F.lit(0),
        lambda at, step: F.when(F.get("_cuts", at + step - 1) <= F.col("_key"), at + step).otherwise(at),
    )
    return with_cuts.withColumn("_slice", place).drop("_cuts", "_key")


def _before(per_slice: DataFrame, *names: str) -> DataFrame:
    """Totals of all earlier slices; the input has one row per slice."""
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(
        F.col("_slice").alias("_at"),
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in names],
    )


def number_rows(df: DataFrame, order: Sequence, name: str = "row_no") -> DataFrame:
    """1-based row number over the whole frame."""
    rows = sliced(df, order)
    offsets = _before(rows.groupBy("_slice").agg(F.count(F.lit(1)).alias("n")), "n")
    inside = Window.partitionBy("_slice").orderBy(*[col(c) for c in order])
    return (
        rows.withColumn("_n", F.row_number().over(inside))
        .join(F.broadcast(offsets), F.col("_slice") == F.col("_at"))  # one row per slice
        .withColumn(name, F.col("_before_n") + F.col("_n"))
        .select(*df.columns, name)
    )


def running_sum(df: DataFrame, order: Sequence, value: str, name: str) -> DataFrame:
    """Sum of ``value`` up to and including each row, over the whole frame."""
    rows = sliced(df, order)
    offsets = _before(rows.groupBy("_slice").agg(F.sum(value).alias("n")), "n")
    inside = Window.partitionBy("_slice").orderBy(*[col(c) for c in order]).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), F.col("_slice") == F.col("_at"))  # one row per slice
        .withColumn(name, F.col("_before_n") + F.col("_inside"))
        .select(*df.columns, name)
    )


def within_groups(
    df: DataFrame,
    group: str,
    order: Sequence,
    value: str | None = None,
    seq: str = "seq",
    prev: str | Sequence[str] = "prev_value",
    size: str | None = None,
    cut: Sequence | None = None,
) -> DataFrame:
    """Row number inside each group and the values of earlier rows, hot groups included.

    ``prev`` names the value of the row before, or those of several rows before, nearest first. ``size`` names
    the number of rows of the group. All come from one pass over one shuffle: a group that lies in one slice is settled
    there, and of one that crosses borders each slice gets what the others hold. ``cut`` is a coarser form of ``order``
    for the slices alone, for instance the beginnings of long texts: it must never descend where ``order`` ascends.
    """
    names = [] if value is None else [prev] if isinstance(prev, str) else list(prev)
    reach = max(1, len(names))
    held = df.withColumn("_value", F.lit(None).cast("int") if value is None else F.col(value))
    rows = sliced(held, [group, *(order if cut is None else cut)]).repartition(shuffle_width(df.sparkSession), "_slice")
    inside = Window.partitionBy("_slice").orderBy(col(group), *[col(c) for c in order])
    rows = rows.withColumns({
        "_place": F.row_number().over(inside),
        "_same": F.col(group).eqNullSafe(F.lag(group).over(inside)),
        **{f"_lag{j}": F.lag("_value", j).over(inside) for j in range(1, reach + 1)},
    })
    # the place where a row's group starts in its slice
    start = F.max(F.when((F.col("_place") > 1) & F.col("_same"), None).otherwise(F.col("_place"))).over(
        inside.rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = rows.withColumn("_n", F.col("_place") - start + 1)
    leading = F.col("_n") == F.col("_place")  # rows of the slice's first group
    out = rows.join(F.broadcast(_carried(rows, group, reach)), "_slice")  # one row per slice
    kept = {seq: (F.col("_n") + F.when(leading, F.col("_before")).otherwise(0)).cast("bigint")}
    for j, name in enumerate(names, 1):
        earlier = F.when(leading, F.get("_earlier", (F.lit(j) - F.col("_n")).cast("int"))["v"])
        kept[name] = F.when(F.col("_n") > j, F.col(f"_lag{j}")).otherwise(earlier)
    if size is not None:
        here = F.count(F.lit(1)).over(Window.partitionBy("_slice", group))
        last = F.col(group).eqNullSafe(F.col("_last_group"))
        kept[size] = (here + F.when(leading, F.col("_before")).otherwise(0) + F.when(last, F.col("_after")).otherwise(0)).cast("bigint")
    return out.select(*df.columns, *[c.alias(n) for n, c in kept.items()])


def _carried(rows: DataFrame, group: str, reach: int) -> DataFrame:
    """For each slice: how many rows of its first group come before it, the last of their values (nearest
    first), and how many rows of its last group come after it."""
    newest = F.slice(
        F.array(*[F.struct(F.col(c).alias("v")) for c in ["_value", *[f"_lag{j}" for j in range(1, reach)]]]),
        1, F.least(F.col("_n"), F.lit(reach)),
    )
    of = F.col(group).alias("g")
    ends = rows.groupBy("_slice").agg(
        F.min_by(F.struct(of), "_place").alias("_first"),
        F.max_by(F.struct(of, F.col("_n").alias("n"), newest.alias("values")), "_place").alias("_last"),
        F.max(F.when(F.col("_n") == F.col("_place"), F.col("_n"))).alias("_leading"),
    )
    # Two rows per slice. That of its first group asks what earlier slices hold of the group, and holds rows for
    # earlier ones; that of its last group asks and holds the other way round.
    first, last = F.col("_first.g").alias("g"), F.col("_last.g").alias("g")
    none = F.lit(None).cast(ends.schema["_last"].dataType["values"].dataType)
    two = ends.select("_slice", F.inline(F.array(
        F.struct(first, F.lit(0).alias("n"), none.alias("values"), F.col("_leading").alias("back"), F.lit(0).alias("end")),
        F.struct(last, F.col("_last.n").alias("n"), F.col("_last.values").alias("values"), F.lit(0).alias("back"), F.lit(1).alias("end")),
    )))
    line = Window.partitionBy("g").orderBy("_slice", "end")
    told = two.select(
        "_slice", "end", "g",
        F.coalesce(F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        # of the last slices that hold rows of the group, each with one row that has a list
        F.collect_list("values").over(line.rowsBetween(-2 * reach, -1)).alias("_lists"),
        F.coalesce(F.sum("back").over(line.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("_after"),
    )
    asked = F.struct("_before", F.flatten(F.reverse("_lists")).alias("_earlier"))
    return told.groupBy("_slice").agg(
        F.min_by(asked, "end").alias("_f"), F.max_by(F.struct("_after", F.col("g").alias("_last_group")), "end").alias("_l")
    ).select("_slice", "_f.*", "_l.*")


def first_rows(
    df: DataFrame, group: str | Sequence[str], order: Sequence, n: int = 1, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows of each group.

    Spark itself limits a group below the shuffle only up to a threshold of ``n``. Beyond it
    a group is dealt over salts first, each of which keeps its own first ``n`` rows, so no task
    meets a whole hot group.
    """
    keys = [group] if isinstance(group, str) else list(group)
    by = [col(c) for c in order]
    name = rank or "_rank"

    def limited(rows: DataFrame, *parts: str) -> DataFrame:
        w = Window.partitionBy(*parts).orderBy(*by)
        return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)

    spark = df.sparkSession
    if n >= int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        salt = F.pmod(F.xxhash64(*by), F.lit(shuffle_width(spark)))
        df = limited(df.withColumn("_salt", salt), *keys, "_salt").drop(name, "_salt")
    out = limited(df, *keys)
    return out if rank else out.drop(name)


def first_per_key(df: DataFrame, key: str, order: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order``, ties broken by the other
    columns, so the result never depends on row order. Partial aggregation applies."""
    rest = [c for c in df.columns if c != key and c not in order]
    row = F.struct(*[F.col(c) for c in [*order, *rest]])
    pick = F.max if last else F.min
    return df.groupBy(key).agg(pick(row).alias("_row")).select(
        *[F.col(c) if c == key else F.col("_row")[c].alias(c) for c in df.columns]
    )
