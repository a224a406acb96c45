"""Comparing label sources: joins (J1-J13) and key set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordance import schemas as S
from accordance.functions import labels as L
from accordance.functions.common import col, count_where, ratio
from accordance.operators.filters import with_membership
from accordance.operators.ordered import first_per_key, first_rows


# ---------------------------------------------------------------------------
# Annotators side by side


def spread_annotators(
    votes: DataFrame,
    annotators: Sequence[str],
    key: str = "item_key",
    annotator: str = "annotator",
    label: str = "candidate_label",
    order: Sequence[str] = (),
    absent: str = S.NOT_FOUND,
    empty: str = S.UNLABELLED,
) -> DataFrame:
    """Long votes to one row per key and one lower-case column per annotator.

    An absent key reads ``absent``; a key present without a label reads ``empty``.
    Of several rows of one annotator the last by ``order`` counts.
    """
    at = F.struct(*[F.col(c) for c in order]) if order else F.struct(F.col(label))
    vote = F.struct(F.coalesce(F.lower(label), F.lit(empty)).alias("v"))
    return votes.groupBy(key).agg(
        *[
            F.coalesce(
                F.max_by(vote, F.when(F.col(annotator) == a, at))["v"], F.lit(absent)
            ).alias(a)
            for a in annotators
        ]
    )


def lookup_annotators(
    keys: DataFrame,
    votes: DataFrame,
    annotators: Sequence[str],
    key: str = "item_key",
    reference: str = "reference_label",
    **how,
) -> DataFrame:
    """Left lookup of each annotator's label for a key list."""
    wide = spread_annotators(votes, annotators, key, **how)
    absent = how.get("absent", S.NOT_FOUND)
    return keys.join(wide, key, "left").select(
        key,
        L.lower_or(reference, "unknown").alias("reference"),
        *[F.coalesce(F.col(a), F.lit(absent)).alias(a) for a in annotators],
    )


def unite_annotators(
    ledgers: DataFrame,
    annotators: Sequence[str],
    order: Sequence[str],
    key: str = "item_key",
    annotator: str = "annotator",
    reference: str = "reference_label",
    candidate: str = "candidate_label",
) -> DataFrame:
    """Full outer union of several annotators' ledgers, one row per key.

    Later rows by ``order`` (the second ledger of an annotator) override earlier
    ones; the reference label is the first one present in annotator order. Grouping
    by key does in one shuffle what a chain of outer joins would do in several.
    """
    at = F.struct(*[F.col(c) for c in order])
    aggs: list[Column] = []
    for a in annotators:
        mine = F.when(F.col(annotator) == a, at)
        row = F.struct(F.col(reference).alias("r"), F.col(candidate).alias("c"))
        aggs.append(F.max_by(row, mine).alias(f"_{a}"))
    wide = ledgers.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)
    refs = [F.col(f"_{a}")["r"] for a in annotators]
    return wide.select(
        key,
        F.lower(F.coalesce(*refs, F.lit("unknown"))).alias("reference"),
        *[
            F.when(F.col(f"_{a}").isNull(), S.NOT_FOUND)
            .otherwise(F.coalesce(F.lower(F.col(f"_{a}")["c"]), F.lit(S.UNLABELLED)))
            .alias(a)
            for a in annotators
        ],
    )


# ---------------------------------------------------------------------------
# Two sources


def outer_compare(
    reference: DataFrame,
    candidate: DataFrame,
    key: str = "item_key",
    reference_col: str = "reference_label",
    candidate_col: str = "candidate_label",
    order: Sequence[str] = (),
) -> DataFrame:
    """Full outer comparison with sentinels and flags, one row per key.

    NULL keys are dropped first: they match nothing and would all meet in one task.
    """

    def one_each(df: DataFrame, label: str) -> DataFrame:
        df = df.where(F.col(key).isNotNull())
        if order:
            return first_per_key(df.select(key, label, *order), key, order, last=True).select(
                key, label
            )
        return df.groupBy(key).agg(F.max(label).alias(label))

    ref = one_each(reference, reference_col).withColumn("_r", F.lit(True))
    cand = one_each(candidate, candidate_col).withColumn("_c", F.lit(True))
    both = ref.join(cand, key, "full_outer").select(
        key,
        F.when(F.col("_r"), F.coalesce(reference_col, F.lit("unknown")))
        .otherwise(S.NOT_IN_REFERENCE)
        .alias(reference_col),
        F.when(F.col("_c"), F.coalesce(candidate_col, F.lit("unknown")))
        .otherwise(S.NOT_ANALYSED)
        .alias(candidate_col),
    )
    return with_membership(both, reference_col, candidate_col)


def fixed_compare(
    keys: DataFrame,
    results: DataFrame,
    expected: str = "floss",
    key: str = "item_key",
    label: str = "label",
    order: Sequence[str] = (),
    texts: Sequence[str] = ("justification", "repository", "message"),
) -> DataFrame:
    """A fixed key list against results; agreement means the expected label."""
    results = results.where(F.col(key).isNotNull())
    results = first_per_key(results, key, order or [label], last=True)
    present = [t for t in texts if t in results.columns]
    fill = {"justification": "Commit not analyzed by LLM"}
    return keys.join(
        results.select(key, label, *present, F.lit(True).alias("_hit")), key, "left"
    ).select(
        key,
        F.lit(expected).alias("reference_label"),
        F.coalesce(label, F.lit(S.NOT_ANALYSED)).alias("candidate_label"),
        *[
            F.when(F.col("_hit"), F.col(t)).otherwise(F.lit(fill.get(t, ""))).alias(t)
            for t in present
        ],
        F.coalesce(F.col(label) == expected, F.lit(False)).alias("agreement"),
    )


def keep_keys(df: DataFrame, keys: DataFrame, on: str, key: str = "item_key") -> DataFrame:
    return df.join(keys.select(F.col(key).alias(on)), on, "left_semi").select(df.columns)


def skip_keys(df: DataFrame, done: DataFrame, on: str, key: str = "item_key") -> DataFrame:
    """Rows whose key is not done. NULL keys of the done list are dropped first."""
    keys = done.select(F.col(key).alias(on)).where(F.col(on).isNotNull())
    return df.join(keys, on, "left_anti").select(df.columns)


# ---------------------------------------------------------------------------
# Item lookups


def keys_of_items(
    items: DataFrame, before: str = "before_key", after: str = "after_key"
) -> DataFrame:
    """One row per (item, side): an item is reachable by either of its keys."""
    sides = F.explode(
        F.array(
            F.struct(F.col(before).alias("item_key"), F.lit(1).alias("side")),
            F.struct(F.col(after).alias("item_key"), F.lit(2).alias("side")),
        )
    )
    return (
        items.withColumn("_s", sides)
        .select("*", F.col("_s.item_key").alias("item_key"), F.col("_s.side").alias("side"))
        .drop("_s")
        .where(F.col("item_key").isNotNull())
    )


def enrich(
    df: DataFrame,
    items: DataFrame,
    order: Sequence[str],
    columns: Sequence[str] = ("project", "project_name"),
    per_row: bool = True,
) -> DataFrame:
    """Add item columns by the before key, else by the after key; missing -> `unknown`.

    ``per_row=False`` uses the after key only if no row at all matched a before key.
    """
    values = F.struct(*[F.col(c) for c in columns])
    at = F.struct(*[F.col(c) for c in order])
    need = list(dict.fromkeys([*columns, *order, "before_key", "after_key"]))
    keys = df.select("item_key").distinct()
    wanted = keys_of_items(items.select(need)).join(keys, "item_key", "left_semi")
    sides = wanted.groupBy("item_key").agg(
        F.min_by(values, F.when(F.col("side") == 1, at)).alias("_before"),
        F.min_by(values, F.when(F.col("side") == 2, at)).alias("_after"),
    )
    joined = df.join(sides, "item_key", "left")
    pick = F.coalesce("_before", "_after")
    if not per_row:
        any_before = (
            df.join(items.select(F.col("before_key").alias("item_key")), "item_key", "left_semi")
            .agg(F.count(F.lit(1)) > 0)
            .scalar()
        )
        pick = F.when(any_before, F.col("_before")).otherwise(F.col("_after"))
    return joined.withColumn("_pick", pick).select(
        *df.columns,
        *[F.coalesce(F.col("_pick")[c], F.lit("unknown")).alias(c) for c in columns],
    )


def either_key(
    keys: DataFrame,
    items: DataFrame,
    order: Sequence[str],
    columns: Sequence[str] = ("project", "before_key", "after_key"),
) -> DataFrame:
    """First item that carries the key on either side.

    Unpivoting both key columns turns the OR condition into an equi-join.
    """
    sides = keys_of_items(items.select(*dict.fromkeys([*columns, *order, "before_key", "after_key"])))
    wanted = sides.join(keys.select("item_key"), "item_key", "left_semi")
    first = wanted.groupBy("item_key").agg(
        F.min_by(
            F.struct(*[F.col(c) for c in columns]), F.struct(*[F.col(c) for c in order])
        ).alias("_row")
    )
    return keys.join(first, "item_key", "left").select(
        *keys.columns, *[F.col("_row")[c].alias(c) for c in columns]
    )


def first_lookup(
    keys: DataFrame,
    items: DataFrame,
    on: str,
    order: Sequence[str],
    columns: Sequence[str],
) -> DataFrame:
    """Left lookup of the first item row per key."""
    need = list(dict.fromkeys([on, *columns, *order]))
    first = first_per_key(items.where(F.col(on).isNotNull()).select(need), on, order)
    first = first.select(F.col(on).alias("item_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    return keys.join(first, "item_key", "left").select(
        *keys.columns, *[F.col(f"_{c}").alias(c) for c in columns]
    )


def top_evidence(
    records: DataFrame,
    order: Sequence[str],
    key: str = "item_key",
    text: str = "description",
    n: int = 3,
    separator: str = "; ",
) -> DataFrame:
    """The first ``n`` texts of each key, joined in order."""
    have = records.where(F.col(text).isNotNull() & F.col(key).isNotNull())
    top = first_rows(have.select(key, text, *order), key, order, n, rank="_n")
    texts = F.array_sort(F.collect_list(F.struct("_n", F.col(text).alias("t"))))
    return top.groupBy(key).agg(
        F.array_join(F.transform(texts, lambda e: e["t"]), separator).alias("evidence")
    )


# ---------------------------------------------------------------------------
# Filling and overwriting


def patch_fill(
    ledger: DataFrame,
    recovered: DataFrame,
    key: str = "item_key",
    label: str = "candidate_label",
    order: Sequence[str] = (),
) -> DataFrame:
    """Only rows without a label take the recovered one, the last by ``order`` of a key."""
    fix = first_per_key(
        recovered.where(~L.is_pending(label)).select(key, *order, F.col(label).alias("_fix")), key, order, last=True
    ).select(key, "_fix")
    current = F.when(~L.is_pending(label), F.col(label))
    return ledger.join(fix, key, "left").withColumn(
        label, F.coalesce(current, "_fix")
    ).select(ledger.columns)


def diff_overwrite(
    ledger: DataFrame,
    complete: DataFrame,
    key: str = "item_key",
    label: str = "candidate_label",
    order: Sequence[str] = (),
) -> DataFrame:
    """Overwrite with the labels of a complete file; ``change`` tells what happened. The
    last row by ``order`` of a key counts."""
    new = first_per_key(
        complete.where(~L.is_pending(label)).select(key, *order, F.col(label).alias("_new")), key, order, last=True
    ).select(key, "_new")
    old = F.when(~L.is_pending(label), F.col(label))
    change = (
        F.when(F.col("_new").isNull(), "absent")
        .when(old.isNull(), "new")
        .when(old != F.col("_new"), "changed")
        .otherwise("same")
    )
    return ledger.join(new, key, "left").select(
        *[c for c in ledger.columns if c != label],
        F.col(label).alias("old_label"),
        F.coalesce("_new", old).alias(label),
        change.alias("change"),
    )


#: Length of the pieces of names by which texts that contain them are found.
_GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """The distinct pieces of ``size`` characters of a text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def contained_names(names: DataFrame, texts: DataFrame, name: str, text: str) -> DataFrame:
    """Each distinct name with each distinct text that contains it (two columns).

    An inverted index of short pieces: every text is listed under its pieces of 1 to 3 characters, and a name
    asks under one piece only, of its three-character pieces that which the fewest texts have; a shorter name
    asks for itself. What meets is then compared. The empty name is in all texts; nulls meet nothing.
    """
    have = texts.select(F.col(text).alias("_text")).where("_text IS NOT NULL").distinct()
    pieces = F.flatten(F.array(*[_grams(F.col("_text"), k) for k in range(1, _GRAM + 1)], F.array(F.lit(""))))
    index = have.select("_text", F.explode(F.array_distinct(pieces)).alias("_piece"))
    counts = index.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    asked = names.select(F.col(name).alias("_name")).where("_name IS NOT NULL").distinct()
    own = F.when(F.length("_name") > _GRAM, _grams(F.col("_name"), _GRAM)).otherwise(F.array("_name"))
    # a piece that no text has drops out here, and with it the name: an inner join would let another piece stand in
    tried = asked.select("_name", F.explode(own).alias("_piece")).join(counts, "_piece", "left")
    rarest = tried.groupBy("_name").agg(F.min_by("_piece", F.struct(F.coalesce("_n", F.lit(0)), "_piece")).alias("_piece"))
    met = rarest.join(index, "_piece").where(F.contains("_text", F.col("_name")))
    return met.select(F.col("_name").alias(name), F.col("_text").alias(text))


def contains_lookup(
    names: DataFrame | Sequence[str], summary: DataFrame, order: Sequence[str], model: str = "annotator"
) -> DataFrame:
    """First summary row whose annotator id contains a short name, per short name.

    ``names`` is a list or a table with the column ``short_name``; it may be long, see `contained_names`.
    """
    spark = summary.sparkSession
    if not isinstance(names, DataFrame):
        names = spark.createDataFrame([(n,) for n in names], "short_name string")
    asked = names.select("short_name").distinct()
    hits = contained_names(asked, summary, "short_name", model).join(summary, model)
    first = first_per_key(hits.select("short_name", *summary.columns), "short_name", order)
    return asked.join(first, "short_name", "left")


# ---------------------------------------------------------------------------
# Key sets


def distinct_keys(*columns: DataFrame) -> DataFrame:
    """Union of single-column frames as one key set."""
    out = columns[0].toDF("item_key")
    for c in columns[1:]:
        out = out.union(c.toDF("item_key"))
    return out.where(F.col("item_key").isNotNull()).distinct()


def _flagged(**sides: DataFrame) -> DataFrame:
    """Every key once, with one flag per side it occurs in: a union and one
    aggregation instead of one join per pair of sides."""
    names = list(sides)
    out = None
    for name, df in sides.items():
        part = df.toDF("item_key").where(F.col("item_key").isNotNull()).select(
            "item_key", *[F.lit(n == name).alias(n) for n in names]
        )
        out = part if out is None else out.union(part)
    return out.groupBy("item_key").agg(*[F.bool_or(n).alias(n) for n in names])


def key_intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.toDF("item_key").intersect(right.toDF("item_key"))


def key_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.toDF("item_key").subtract(right.toDF("item_key"))


def intersection_report(left: DataFrame, right: DataFrame) -> DataFrame:
    n_left, n_right = count_where(F.col("a")), count_where(F.col("b"))
    common = count_where(F.col("a") & F.col("b"))
    return _flagged(a=left, b=right).agg(
        n_left.alias("left_keys"),
        n_right.alias("right_keys"),
        common.alias("common_keys"),
        ratio(common, n_left, 100.0).alias("left_pct"),
        ratio(common, n_right, 100.0).alias("right_pct"),
    )


def overlap_report(keys: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """How many of the keys occur in either, each and both of two other columns."""
    k, a, b = F.col("k"), F.col("a"), F.col("b")
    return _flagged(k=keys, a=first, b=second).agg(
        count_where(k).alias("keys"),
        count_where(a | b).alias("other_keys"),
        count_where(k & (a | b)).alias("common"),
        count_where(k & a).alias("in_first"),
        count_where(k & b).alias("in_second"),
        count_where(k & a & b).alias("in_both"),
    )


def concat_rows(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def expansion_report(planned: DataFrame, found: DataFrame, on: str) -> DataFrame:
    """Planned keys against rows found for them (a key may expand to several rows)."""
    per_key = (
        planned.select(F.col("item_key"), F.lit(1).alias("p"), F.lit(0).alias("f"))
        .union(found.select(col(on).alias("item_key"), F.lit(0), F.lit(1)))
        .groupBy("item_key")
        .agg(F.max("p").alias("p"), F.sum("f").alias("f"))
        .where("p = 1")
    )
    planned_n, rows = F.count(F.lit(1)), F.coalesce(F.sum("f"), F.lit(0))
    return per_key.agg(
        planned_n.alias("planned_keys"),
        count_where(F.col("f") > 0).alias("found_keys"),
        rows.alias("found_rows"),
        (rows - planned_n).alias("difference"),
        count_where(F.col("f") > 1).alias("expanded_keys"),
    )
