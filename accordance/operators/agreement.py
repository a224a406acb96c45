"""Agreement analytics.

Almost everything derives from one small cube: counts per (annotator, reference,
candidate). It is built by one partial and one final aggregation; what follows
works on at most |labels|^2 rows per annotator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordance import schemas as S
from accordance.functions import labels as L
from accordance.functions.common import count_where, equal, ratio, total
from accordance.operators.compare import keys_of_items
from accordance.operators.ordered import first_rows

R, C = "reference_label", "candidate_label"


def _n() -> Column:
    return F.count(F.lit(1))


# ---------------------------------------------------------------------------
# Counts and matrices


def value_counts(df: DataFrame, label: str, keep_null: bool = False) -> DataFrame:
    """Count and share of each label; the total is a subquery, so values need not be few."""
    if not keep_null:
        df = df.where(F.col(label).isNotNull())
    counts = df.groupBy(label).agg(_n().alias("n"))
    return counts.withColumn("pct", ratio(F.col("n"), df.agg(_n()).scalar(), 100.0))


def label_cube(
    df: DataFrame,
    by: Sequence[str] = (),
    reference: str = R,
    candidate: str = C,
    keep_null: bool = False,
) -> DataFrame:
    """Counts per (by.., reference, candidate)."""
    if not keep_null:
        df = df.where(F.col(reference).isNotNull() & F.col(candidate).isNotNull())
    return df.groupBy(*by, reference, candidate).agg(_n().alias("n"))


def confusion(
    df: DataFrame, labels: Sequence[str], reference: str = R, candidate: str = C
) -> DataFrame:
    """Dense matrix: one row per reference label, one column per candidate label."""
    df = df.where(F.col(reference).isNotNull() & F.col(candidate).isNotNull())
    return df.groupBy(reference).agg(
        *[count_where(F.col(candidate) == c).alias(c) for c in labels]
    )


def confusion_margins(
    df: DataFrame, reference: str = R, candidate: str = C, all_name: str = "All"
) -> DataFrame:
    """Long matrix with margins; the cube runs on the counted pairs only."""
    pairs = label_cube(df, (), reference, candidate)
    return pairs.cube(reference, candidate).agg(
        F.sum("n").alias("n"),
        F.grouping(reference).alias("_gr"),
        F.grouping(candidate).alias("_gc"),
    ).select(
        F.when(F.col("_gr") == 1, all_name).otherwise(F.col(reference)).alias(reference),
        F.when(F.col("_gc") == 1, all_name).otherwise(F.col(candidate)).alias(candidate),
        "n",
    )


def confusion_pct(df: DataFrame, reference: str = R, candidate: str = C) -> DataFrame:
    """Pair counts as percent of their reference row."""
    row = Window.partitionBy(reference)
    return label_cube(df, (), reference, candidate).withColumn(
        "row_pct", ratio(F.col("n"), F.sum("n").over(row), 100.0)
    )


def confusion_sparse(df: DataFrame, by: str = "annotator") -> DataFrame:
    """Normalised pair counts that keep missing labels as their own group."""
    norm = df.select(
        by, L.normalize_label(R).alias(R), L.normalize_label(C).alias(C)
    )
    return label_cube(norm, (by,), keep_null=True)


def confusion_2x2(
    sparse: DataFrame, by: str = "annotator", labels: Sequence[str] = ("TRUE", "FALSE")
) -> DataFrame:
    """Fixed-label matrix per annotator from sparse counts, zeros included."""
    cells = [
        F.struct(
            F.lit(r).alias(R),
            F.lit(c).alias(C),
            total(F.when((F.col(R) == r) & (F.col(C) == c), F.col("n"))).alias("n"),
        )
        for r in labels
        for c in labels
    ]
    return sparse.groupBy(by).agg(F.array(*cells).alias("_cells")).select(
        by, F.inline("_cells")
    )


# ---------------------------------------------------------------------------
# Agreement rates


def agreement_total(df: DataFrame, agreement: str = "agreement") -> DataFrame:
    n, good = _n(), count_where(F.col(agreement))
    return df.agg(
        n.alias("total"),
        good.alias("agreements"),
        (n - good).alias("disagreements"),
        ratio(good, n, 100.0).alias("agreement_pct"),
    )


def comparison_summary(
    compared: DataFrame, candidate: str = C, not_analysed: str = S.NOT_ANALYSED
) -> DataFrame:
    """Totals of a fixed comparison; rates are over the analysed rows."""
    n = _n()
    done = count_where(F.col(candidate) != not_analysed)
    good = count_where(F.col("agreement"))
    return compared.agg(
        n.alias("total"),
        done.alias("analysed"),
        (n - done).alias("not_analysed"),
        good.alias("agreements"),
        (done - good).alias("disagreements"),
        count_where(F.col(candidate) == "pure").alias("pure"),
        count_where(F.col(candidate) == "floss").alias("floss"),
        ratio(good, done, 100.0).alias("agreement_pct"),
    )


def agreement_by_class(
    df: DataFrame, reference: str = R, candidate: str = C, agreement: str = "agreement"
) -> DataFrame:
    """Agreement per reference class and per candidate class in one pass."""
    pairs = df.groupBy(reference, candidate).agg(
        _n().alias("n"), count_where(F.col(agreement)).alias("good")
    )
    return (
        pairs.groupingSets(
            [[F.col(reference)], [F.col(candidate)]], F.col(reference), F.col(candidate)
        )
        .agg(
            F.sum("n").alias("total"),
            F.sum("good").alias("agreements"),
            F.grouping(reference).alias("_g"),
        )
        .select(
            F.when(F.col("_g") == 0, "reference").otherwise("candidate").alias("axis"),
            F.when(F.col("_g") == 0, F.col(reference)).otherwise(F.col(candidate)).alias("label"),
            "total",
            "agreements",
            ratio(F.col("agreements"), F.col("total"), 100.0).alias("agreement_pct"),
        )
        .where(F.col("label").isNotNull())
    )


def agreement_truth(sparse: DataFrame, by: str = "annotator") -> DataFrame:
    """Per truth value: total, agree, disagree (a missing answer disagrees)."""
    rows = []
    for truth in ("TRUE", "FALSE"):
        n = total(F.when(F.col(R) == truth, F.col("n")))
        good = total(F.when((F.col(R) == truth) & (F.col(C) == truth), F.col("n")))
        rows.append(
            F.struct(
                F.lit(truth).alias("truth"), n.alias("total"), good.alias("agree"),
                (n - good).alias("disagree"),
            )
        )
    return sparse.groupBy(by).agg(F.array(*rows).alias("_rows")).select(by, F.inline("_rows"))


def model_summary(sparse: DataFrame, by: str = "annotator") -> DataFrame:
    """One wide row per annotator out of the sparse cube."""

    def n(cond: Column) -> Column:
        return total(F.when(cond, F.col("n")))

    r, c = F.col(R), F.col(C)
    everything, analysed = total(F.col("n")), n(c.isNotNull())
    cols = {
        "total_items": everything,
        "analysed": analysed,
        "missing": everything - analysed,
        "reference_true": n(r == "TRUE"),
        "reference_false": n(r == "FALSE"),
        "candidate_true": n(c == "TRUE"),
        "candidate_false": n(c == "FALSE"),
    }
    for truth in ("TRUE", "FALSE"):
        whole, good = n(r == truth), n((r == truth) & (c == truth))
        low = truth.lower()
        cols[f"agreement_{low}_total"] = whole
        cols[f"agreement_{low}_agree"] = good
        cols[f"agreement_{low}_disagree"] = whole - good
    return sparse.groupBy(by).agg(*[v.alias(k) for k, v in cols.items()])


# The column names of the summary file, in file order.
SUMMARY_FILE_NAMES = {
    "annotator": "model",
    "file": "file",
    "total_items": "total_commits_in_file",
    "analysed": "analyzed_by_model",
    "reference_true": "purity_true",
    "reference_false": "purity_false",
    "candidate_true": "llm_true",
    "candidate_false": "llm_false",
    "agreement_true_total": "agreement_true_total",
    "agreement_true_agree": "agreement_true_agree",
    "agreement_true_disagree": "agreement_true_disagree",
    "agreement_false_total": "agreement_false_total",
    "agreement_false_agree": "agreement_false_agree",
    "agreement_false_disagree": "agreement_false_disagree",
}


def summary_file(ledgers: DataFrame) -> DataFrame:
    """The summary of a folder of ledgers, a row per annotator and file, as its file has it: names, order of
    columns, order of rows."""
    named = ledgers.withColumn("_of", F.struct("annotator", "file"))
    out = model_summary(confusion_sparse(named, "_of"), "_of").select("_of.*", "*")
    return out.select(*[F.col(c).alias(n) for c, n in SUMMARY_FILE_NAMES.items()]).orderBy("model", "file")


def membership(compared: DataFrame, reference: str = R, candidate: str = C) -> DataFrame:
    """Where keys occur, and both label distributions in the intersection."""
    pairs = compared.groupBy("in_reference", "analysed", reference, candidate).agg(
        _n().alias("n"), count_where(F.col("agreement")).alias("good")
    )
    where = (
        F.when(F.col("in_reference") & F.col("analysed"), "both")
        .when(F.col("in_reference"), "only_reference")
        .otherwise("only_candidate")
    )
    rows = F.array(
        F.struct(F.lit("membership").alias("section"), where.alias("label")),
        F.when(where == "both", F.struct(F.lit("reference").alias("section"), F.col(reference).alias("label"))),
        F.when(where == "both", F.struct(F.lit("candidate").alias("section"), F.col(candidate).alias("label"))),
    )
    return (
        pairs.withColumn("_r", F.explode(F.array_compact(rows)))
        .groupBy(F.col("_r.section").alias("section"), F.col("_r.label").alias("label"))
        .agg(F.sum("n").alias("n"), F.sum("good").alias("agreements"))
    )


# ---------------------------------------------------------------------------
# Repositories, projects, keys


def repo_stats(
    df: DataFrame,
    repo: str = "repo_name",
    reference: str = "reference_normalized",
    candidate: str = C,
) -> DataFrame:
    n, good = _n(), count_where(F.col("agreement"))
    return df.groupBy(repo).agg(
        n.alias("total"),
        good.alias("agreements"),
        F.round(ratio(good, n), 3).alias("agreement_rate"),
        count_where(F.col(reference) == "PURE").alias("reference_pure"),
        count_where(F.col(candidate) == "PURE").alias("candidate_pure"),
    )


def repo_matrix(
    df: DataFrame, labels: Sequence[str], repo: str = "repo_name", label: str = C
) -> DataFrame:
    return df.where(F.col(repo).isNotNull() & F.col(label).isNotNull()).groupBy(repo).agg(
        *[count_where(F.col(label) == v).alias(v) for v in labels]
    )


def project_matches(items: DataFrame, keys: DataFrame, project: str = "project_name") -> DataFrame:
    """Matched keys per project, in all and per key column."""
    sides = keys_of_items(items.select(project, "before_key", "after_key"))
    return (
        sides.join(keys.select("item_key"), "item_key", "left_semi")
        .groupBy(project)
        .agg(
            _n().alias("total_matches"),
            count_where(F.col("side") == 1).alias("before_matches"),
            count_where(F.col("side") == 2).alias("after_matches"),
        )
    )


def top_project(matches: DataFrame, project: str = "project_name") -> DataFrame:
    """The project with most matches."""
    return matches.orderBy(F.desc("total_matches"), project).limit(1)


def key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(_n().alias("n"))


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    n = F.col("n")
    return key_counts(df, key).agg(
        total(n).alias("total_rows"),
        _n().alias("distinct_keys"),
        count_where(n > 1).alias("duplicated_keys"),
        F.coalesce(F.max(F.when(n > 1, n)), F.lit(0)).alias("max_multiplicity"),
        total(F.when(n > 1, n)).alias("rows_in_duplicates"),
    )


def top_duplicates(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    return key_counts(df, key).where("n > 1").orderBy(F.desc("n"), key).limit(k)


# ---------------------------------------------------------------------------
# Disagreement patterns and dataset statistics


def patterns(
    df: DataFrame, reference: str = R, candidate: str = C, agreement: str = "agreement"
) -> DataFrame:
    """Label pairs of the disagreements with their share."""
    pairs = label_cube(df.where(~F.col(agreement)), (), reference, candidate)
    return pairs.withColumn("share_pct", ratio(F.col("n"), pairs.agg(F.sum("n")).scalar(), 100.0))


def dataset_stats(
    df: DataFrame,
    repo: str = "repo_name",
    label: str = "label",
    size: str = "n_chars",
    confidence: str = "confidence",
) -> DataFrame:
    """Overall figures of a labelled set; one shuffle on the repository."""
    levels = ("high", "low", "medium")
    per_repo = df.groupBy(repo).agg(
        _n().alias("n"),
        count_where(F.col(label) == "pure").alias("pure"),
        count_where(F.col(label) == "floss").alias("floss"),
        F.sum(size).alias("size_sum"),
        F.count(size).alias("size_n"),
        *[count_where(F.col(confidence) == v).alias(v) for v in levels],
    )
    n = F.sum("n")
    commonest = F.array_max(
        F.array(
            *[
                F.struct(F.sum(v).alias("n"), F.lit(-i).alias("rank"), F.lit(v).alias("v"))
                for i, v in enumerate(levels)
            ]
        )
    )["v"]
    return per_repo.agg(
        total(F.col("n")).alias("total"),
        F.count(repo).alias("repositories"),
        total(F.col("pure")).alias("pure"),
        total(F.col("floss")).alias("floss"),
        ratio(F.sum("pure"), n, 100.0).alias("pure_pct"),
        ratio(F.sum("floss"), n, 100.0).alias("floss_pct"),
        F.min_by(
            repo, F.when(F.col(repo).isNotNull(), F.struct(-F.col("n"), F.col(repo)))
        ).alias("top_repository"),
        ratio(F.sum("size_sum"), F.sum("size_n")).alias("mean_size"),
        F.when(n > 0, commonest).alias("common_confidence"),
    )


def combos(wide: DataFrame, annotators: Sequence[str], k: int | None = 10) -> DataFrame:
    """Most frequent label combinations of the annotators."""
    out = wide.groupBy(*annotators).agg(_n().alias("n"))
    return out if k is None else out.orderBy(F.desc("n"), *annotators).limit(k)


def model_coverage(
    wide: DataFrame, annotators: Sequence[str], absent: str = S.NOT_FOUND
) -> DataFrame:
    n = _n()
    rows = [
        F.struct(
            F.lit(a).alias("annotator"),
            count_where(F.col(a) != absent).alias("found"),
            n.alias("total"),
            ratio(count_where(F.col(a) != absent), n, 100.0).alias("found_pct"),
        )
        for a in annotators
    ]
    return wide.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def ledger_coverage(ledger: DataFrame, label: str = C) -> DataFrame:
    n = _n()
    have = count_where(~L.is_pending(label))
    done = count_where(L.is_completed(label) & ~L.is_pending(label))
    return ledger.agg(
        n.alias("total"),
        have.alias("with_label"),
        (n - have).alias("without_label"),
        done.alias("completed"),
        ratio(have, n, 100.0).alias("with_label_pct"),
        ratio(n - have, n, 100.0).alias("without_label_pct"),
    )


def status_breakdown(df: DataFrame, by: str = "annotator") -> DataFrame:
    """Counts per status and reference label; missing statuses read NONE."""
    return (
        df.select(
            by,
            F.coalesce(C, F.lit("NONE")).alias("status"),
            F.coalesce(R, F.lit("UNKNOWN")).alias("reference_label"),
        )
        .groupBy(by, "status", "reference_label")
        .agg(_n().alias("n"))
    )


def status_by_reference(breakdown: DataFrame, status: str) -> DataFrame:
    return breakdown.where(F.col("status") == status)


# ---------------------------------------------------------------------------
# N-way consensus


def vote_combos(
    votes: DataFrame,
    annotators: Sequence[str],
    key: str = "item_key",
    annotator: str = "annotator",
    label: str = "label",
    vocabulary: Sequence[str] = S.CANDIDATE_LABELS,
) -> DataFrame:
    """Counts of label combinations over the keys every annotator has labelled.

    At most |vocabulary|^|annotators| rows, whatever the number of keys.
    """
    votes = votes.where(
        F.col(label).isin(*vocabulary) & F.col(annotator).isin(*annotators)
    )
    per_key = votes.groupBy(key).agg(
        *[F.max(F.when(F.col(annotator) == a, F.col(label))).alias(a) for a in annotators]
    )
    return per_key.dropna(subset=list(annotators)).groupBy(*annotators).agg(_n().alias("n"))


#: Annotators whose subsets are summed in one pass.
_BITS_PER_PASS = 4


def superset_sums(masks: DataFrame, bits: int, least: int = 1) -> DataFrame:
    """``mask``, ``n``: for each bit mask the sum of ``n`` over all given masks that contain it.

    Some bits at a time: a mask counts for all masks that lack any of these bits, and equal masks are added up
    before the next bits, so no row ever stands for more than 2^`_BITS_PER_PASS`. Masks with fewer
    than ``least`` bits, and those that nothing contains, are left out.
    """
    out = masks.select(F.col("mask").cast("bigint").alias("mask"), "n")
    for low in range(0, bits, _BITS_PER_PASS):
        width = min(_BITS_PER_PASS, bits - low)
        parts = F.array(*[F.lit(k << low).cast("bigint") for k in range(1 << width)])
        rest = F.col("mask").bitwiseAND(F.lit(~(((1 << width) - 1) << low)).cast("bigint"))
        below = F.transform(F.filter(parts, lambda p: p.bitwiseAND(F.col("mask")) == p), lambda p: p.bitwiseOR(rest))
        out = out.select(F.explode(F.filter(below, lambda m: F.bit_count(m) >= least)).alias("mask"), "n")
        out = out.groupBy("mask").agg(F.sum("n").alias("n"))
    return out


def consensus(
    combos: DataFrame, annotators: Sequence[str], labels: Sequence[str] = S.CANDIDATE_LABELS, sizes: Sequence[int] | None = None
) -> DataFrame:
    """Agreement of subsets of annotators, and the full set split by label.

    A label of a combination is the bit mask of those who gave it; a subset agrees where such a mask contains it, so
    all subsets come from superset sums. ``sizes`` are the subset sizes wanted; by default all are. The plan grows with
    the number of annotators, not with that of their subsets.
    """
    k = len(annotators)
    wanted = sorted(set(range(1, k + 1) if sizes is None else sizes) & set(range(1, k + 1)))
    given = combos.withColumn("_l", F.explode(F.array_distinct(F.array(*annotators))))
    mask = F.lit(0).cast("bigint")
    for i, a in enumerate(annotators):
        mask = mask + F.when(F.col(a) == F.col("_l"), F.lit(1 << i)).otherwise(0)
    masks = given.groupBy(mask.alias("mask"), "_l").agg(F.sum("n").alias("n"))
    whole = combos.agg(total(F.col("n")).alias("total"))
    every = (1 << k) - 1
    unanimous = F.col("mask") == every
    splits = masks.agg(
        total(F.when(unanimous, F.col("n"))).alias("all"),
        *[total(F.when(unanimous & (F.col("_l") == v), F.col("n"))).alias(f"l{i}") for i, v in enumerate(labels)],
    ).withColumn("total", whole.scalar())
    named = [("total_agreement", F.col("all")), ("total_disagreement", F.col("total") - F.col("all"))]
    named += [(f"agreement_{v}", F.col(f"l{i}")) for i, v in enumerate(labels)]
    out = splits.select("total", F.inline(F.array(*[
        F.struct(F.lit("breakdown").alias("kind"), F.lit(m).alias("members"), n.alias("agreements")) for m, n in named
    ])))
    names = F.array(*[F.struct(F.lit(1 << i).cast("bigint").alias("bit"), F.lit(a).alias("name")) for i, a in enumerate(annotators)])
    if wanted:
        sums = superset_sums(masks.select("mask", "n"), k, wanted[0])
        subsets = combos.sparkSession.range(1, 1 << k).where(F.bit_count("id").isin(wanted))
        members = F.transform(F.filter(names, lambda x: x["bit"].bitwiseAND(F.col("id")) != 0), lambda x: x["name"])
        rows = subsets.join(sums, F.col("id") == F.col("mask"), "left").select(
            whole.scalar().alias("total"), F.concat(F.lit("subset_"), F.bit_count("id")).alias("kind"),
            F.array_join(members, " + ").alias("members"), F.coalesce("n", F.lit(0)).cast("bigint").alias("agreements"),
        )
        out = out.select(*rows.columns).union(rows)
    return out.select("kind", "members", "agreements", "total").withColumn(
        "agreement_pct", F.round(ratio(F.col("agreements"), F.col("total"), 100.0), 2)
    )


def majority_table(combos: DataFrame, annotators: Sequence[str]) -> DataFrame:
    """Label proportions per annotator plus a row for the strict majority."""

    def votes_for(label: str) -> Column:
        n = F.lit(0)
        for a in annotators:
            n = n + (F.col(a) == label).cast("int")
        return n * 2 > len(annotators)

    majority = F.when(votes_for("PURE"), "PURE").when(votes_for("FLOSS"), "FLOSS")
    voters = F.array(
        *[F.struct(F.lit(a).alias("voter"), F.col(a).alias("label")) for a in annotators],
        F.struct(F.lit("consensus").alias("voter"), majority.alias("label")),
    )
    n = total(F.col("n"))
    pure = total(F.when(F.col("_v.label") == "PURE", F.col("n")))
    floss = total(F.when(F.col("_v.label") == "FLOSS", F.col("n")))
    return (
        combos.withColumn("_v", F.explode(voters))
        .groupBy(F.col("_v.voter").alias("annotator"))
        .agg(
            n.alias("total"),
            pure.alias("pure"),
            floss.alias("floss"),
            (n - pure - floss).alias("undecided"),
            F.round(ratio(pure, n), 3).alias("pure_share"),
            F.round(ratio(floss, n), 3).alias("floss_share"),
            F.round(ratio(pure, n, 100.0), 2).alias("pure_pct"),
            F.round(ratio(floss, n, 100.0), 2).alias("floss_pct"),
        )
    )


# ---------------------------------------------------------------------------
# Sizes, runs, work, sessions, exports


def size_histogram(df: DataFrame, size: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between the smallest and the largest size."""
    ends = df.agg(F.min(size).alias("lo"), F.max(size).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    place = F.floor(F.try_divide((F.col(size) - lo) * F.lit(bins), hi - lo))
    bin_no = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("bigint")
    return (
        df.where(F.col(size).isNotNull())
        .groupBy(bin_no.alias("bin"))
        .agg(_n().alias("n"), F.min(size).alias("smallest"), F.max(size).alias("largest"))
    )


def run_summary(
    df: DataFrame, label: str = "label", route: str = "route", size: str = "n_chars"
) -> DataFrame:
    return df.agg(
        count_where(F.col(label) == "pure").alias("pure"),
        count_where(F.col(label) == "floss").alias("floss"),
        _n().alias("total"),
        count_where(F.col(route) == "file").alias("by_file"),
        count_where(F.col(route) == "direct").alias("direct"),
        F.floor(ratio(total(F.col(size)), _n())).cast("bigint").alias("mean_size"),
    )


def work_stats(work: DataFrame, done: DataFrame, key: str = "item_key") -> DataFrame:
    """Total, done and open work of a labelled list (one row per key)."""
    marks = done.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_done", F.lit(True))
    open_ = F.col("_done").isNull()
    n, todo = _n(), count_where(open_)
    return work.join(marks, key, "left").agg(
        n.alias("total"),
        (n - todo).alias("already_done"),
        todo.alias("to_do"),
        count_where(open_ & (F.col("kind_of_change") == "floss")).alias("floss_to_do"),
        count_where(open_ & (F.col("kind_of_change") == "pure")).alias("pure_to_do"),
        count_where(F.col("had_conflict")).alias("conflicts"),
    )


def session_summary(analyses: DataFrame, session: str = "session_id") -> DataFrame:
    """Candidate counts and convergence per session, on normalised labels."""
    r, c = L.normalize_label(R), L.normalize_label(C)
    n, good = _n(), count_where(equal(r, c))
    return analyses.groupBy(session).agg(
        n.alias("total"),
        count_where(F.col(C) == "PURE").alias("pure"),
        count_where(F.col(C) == "FLOSS").alias("floss"),
        count_where(F.col(C).isin(*S.FAILURE_STATUSES)).alias("failed"),
        good.alias("agree"),
        (n - good).alias("disagree"),
    )


def export_stats(
    df: DataFrame,
    repo: str = "repository",
    reference: str = "reference_normalized",
    candidate: str = C,
) -> DataFrame:
    per_repo = df.groupBy(repo).agg(
        _n().alias("n"),
        count_where(F.col("agreement")).alias("good"),
        count_where(F.col(reference) == "PURE").alias("rp"),
        count_where(F.col(candidate) == "PURE").alias("cp"),
    )
    return per_repo.agg(
        total(F.col("n")).alias("total_comparisons"),
        ratio(F.sum("good"), F.sum("n")).alias("agreement_rate"),
        total(F.col("rp")).alias("reference_pure_count"),
        total(F.col("cp")).alias("candidate_pure_count"),
        F.count(repo).alias("repositories"),
    )


def repository_list(df: DataFrame, repo: str = "repository") -> DataFrame:
    return df.select(repo).where(F.col(repo).isNotNull()).distinct()


# ---------------------------------------------------------------------------
# Examples and top-k


def pattern_examples(
    df: DataFrame,
    by: Sequence[str] = (R, C),
    k: int = 2,
    key: str = "item_key",
) -> DataFrame:
    """Up to k keys of each pattern."""
    return first_rows(df, by, [key], k, rank="example_no")


def top_k(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(_n().alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(k)
