from __future__ import annotations

from collections import Counter
from itertools import combinations
import random
import time

import pytest

from accordance.operators import agreement as G
from accordance.operators import filters as P

V = "item_key string, annotator string, label string"


def _votes(spark, table, voters):
    data = [(f"k{i}", v, lab) for i, row in enumerate(table) for v, lab in zip(voters, row) if lab != "-"]
    return spark.createDataFrame(data, V)


@pytest.mark.parametrize(
    "row, majority", [("PPPP", "pure"), ("PPPF", "pure"), ("FFFP", "floss"), ("PPFF", None)]
)
def test_majority_of_four(spark, row, majority):
    voters = ("a", "b", "c", "d")
    table = [[{"P": "PURE", "F": "FLOSS"}[x] for x in row]]
    m = G.majority_table(G.vote_combos(_votes(spark, table, voters), voters), voters)
    r = m.where("annotator = 'consensus'").first()
    assert (r["pure"], r["floss"], r["undecided"]) == (
        int(majority == "pure"), int(majority == "floss"), int(majority is None))


def test_consensus_against_brute_force_and_trio_identity(spark):
    voters = ("a", "b", "c", "d")
    rng = random.Random(1)
    table = [[rng.choice(["PURE", "FLOSS", "FLOSS", "FAILED", None, "-"] if rng.random() < 0.2
                         else ["PURE", "FLOSS"]) for _ in voters] for _ in range(400)]
    full = [r for r in table if all(x in ("PURE", "FLOSS") for x in r)]
    combos = G.vote_combos(_votes(spark, table, voters), voters)
    got = {r["members"]: r["agreements"] for r in G.consensus(combos, voters).collect()}
    for k in range(1, 5):
        for m in combinations(range(4), k):
            want = sum(len({r[i] for i in m}) == 1 for r in full)
            assert got[" + ".join(voters[i] for i in m)] == want
    everyone = got["a + b + c + d"]
    assert got["total_agreement"] == everyone == got["agreement_PURE"] + got["agreement_FLOSS"]
    assert got["total_agreement"] + got["total_disagreement"] == len(full)
    trios = sum(v for k, v in got.items() if k.count("+") == 2)
    table_m = {r["annotator"]: r for r in G.majority_table(combos, voters).collect()}
    decided = table_m["consensus"]["pure"] + table_m["consensus"]["floss"]
    # three of four agree once per decided key, and all four trios do under full agreement
    assert trios == 4 * everyone + (decided - everyone)


def test_published_proportions(spark):
    """Label counts of the published table give its rounded shares."""
    df = spark.createDataFrame(
        [("PURE", 978), ("FLOSS", 1750)], "x string, n long"
    )
    r = {t["annotator"]: t for t in G.majority_table(df, ("x",)).collect()}["x"]
    assert (r["pure_share"], r["floss_share"], r["pure_pct"], r["floss_pct"]) == (0.359, 0.641, 35.85, 64.15)


LED = "annotator string, reference_label string, candidate_label string"


def test_summary_row_from_published_counts(spark):
    """A ledger with the counts of a published row yields that row."""
    data = (
        [("m", "FALSE", "FLOSS")] * 187 + [("m", "FALSE", "FAILED")] * 53 + [("m", "FALSE", "PURE")] * 2
        + [("m", "NONE", "FAILED")] * 61 + [("m", "NONE", "FLOSS")] * 262 + [("m", "NONE", None)] * 18
    )
    sparse = G.confusion_sparse(spark.createDataFrame(data, LED))
    r = G.model_summary(sparse).first().asDict()
    assert r == {
        "annotator": "m", "total_items": 583, "analysed": 565, "missing": 18, "reference_true": 0,
        "reference_false": 242, "candidate_true": 2, "candidate_false": 449,
        "agreement_true_total": 0, "agreement_true_agree": 0, "agreement_true_disagree": 0,
        "agreement_false_total": 242, "agreement_false_agree": 187, "agreement_false_disagree": 55,
    }
    cells = {(x["reference_label"], x["candidate_label"]): x["n"] for x in sparse.collect()}
    assert cells[("FALSE", "FAILED")] == 53 and cells[(None, None)] == 18
    two = {(x["reference_label"], x["candidate_label"]): x["n"] for x in G.confusion_2x2(sparse).collect()}
    assert two == {("TRUE", "TRUE"): 0, ("TRUE", "FALSE"): 0, ("FALSE", "TRUE"): 2, ("FALSE", "FALSE"): 187}
    truth = {x["truth"]: (x["total"], x["agree"], x["disagree"]) for x in G.agreement_truth(sparse).collect()}
    assert truth == {"TRUE": (0, 0, 0), "FALSE": (242, 187, 55)}


PAIRS = [("TRUE", "PURE"), ("TRUE", "FLOSS"), ("FALSE", "FLOSS"), ("FALSE", None), (None, "PURE"),
         ("NONE", "PURE"), ("NOT_FOUND", "PURE"), ("FALSE", "FAILED")]


def _compared(spark):
    df = spark.createDataFrame(PAIRS, "reference_label string, candidate_label string")
    return P.with_agreement(P.both_classified(df))


def test_margins_add_up(spark):
    df = _compared(spark)
    m = {(r[0], r[1]): r[2] for r in G.confusion_margins(df).collect()}
    assert m[("All", "All")] == df.count() == 5
    inner = Counter()
    for (r, c), n in m.items():
        if "All" not in (r, c):
            inner["All", c] += n
            inner[r, "All"] += n
    assert {k: v for k, v in m.items() if "All" in k and k != ("All", "All")} == dict(inner)


def test_rates(spark, rows):
    df = _compared(spark)
    assert tuple(G.agreement_total(df).first()) == (5, 2, 3, 40.0)
    by = {(r["axis"], r["label"]): (r["total"], r["agreements"]) for r in G.agreement_by_class(df).collect()}
    assert by[("reference", "TRUE")] == (2, 1) and by[("candidate", "PURE")] == (3, 1)
    assert sum(n for (a, _), (n, _g) in by.items() if a == "reference") == 5
    pats = {(r[0], r[1]): (r[2], r[3]) for r in G.patterns(df).collect()}
    assert sum(n for n, _ in pats.values()) == 3
    assert abs(sum(s for _, s in pats.values()) - 100) < 1e-9


def test_empty_input_gives_zero_rates(spark):
    df = _compared(spark).limit(0)
    assert tuple(G.agreement_total(df).first()) == (0, 0, 0, 0.0)
    assert G.confusion_margins(df).where("reference_label <> 'All'").count() == 0


def test_value_counts_null_rule(spark, rows):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "v string")
    assert rows(G.value_counts(df, "v")) == [("a", 2, 2 / 3 * 100.0), ("b", 1, 1 / 3 * 100.0)]
    assert (None, 1, 25.0) in rows(G.value_counts(df, "v", keep_null=True))


def test_histogram_of_equal_sizes(spark, rows):
    df = spark.createDataFrame([(7,), (7,)], "n int")
    assert rows(G.size_histogram(df, "n")) == [(0, 2, 7, 7)]
    df = spark.createDataFrame([(i,) for i in range(101)], "n int")
    got = G.size_histogram(df, "n", 10).orderBy("bin").collect()
    assert [r["n"] for r in got] == [10] * 9 + [11]


def test_dataset_stats_ties(spark):
    df = spark.createDataFrame(
        [("r2", "pure", 10, "low"), ("r1", "floss", 20, "high"), (None, "pure", None, "low"), (None, "pure", 0, "high")],
        "repo_name string, label string, n_chars long, confidence string",
    )
    r = G.dataset_stats(df).first()
    assert (r["total"], r["repositories"], r["pure"], r["floss"]) == (4, 2, 3, 1)
    assert (r["top_repository"], r["mean_size"], r["common_confidence"]) == ("r1", 10.0, "high")


def test_session_convergence_uses_normalised_labels(spark):
    df = spark.createDataFrame(
        [("s", "true", "PURE"), ("s", "FALSE", "FLOSS"), ("s", "TRUE", "FLOSS"), ("s", None, None)],
        "session_id string, reference_label string, candidate_label string",
    )
    r = G.session_summary(df).first()
    assert (r["total"], r["agree"], r["disagree"]) == (4, 2, 2)


def _brute_consensus(combos, names, sizes):
    out = {}
    whole = sum(n for *_, n in combos)
    for size in sizes:
        for members in combinations(range(len(names)), size):
            hit = sum(c[-1] for c in combos if len({c[m] for m in members}) == 1)
            out[f"subset_{size}", " + ".join(names[m] for m in members)] = (hit, whole)
    return out


@pytest.mark.parametrize("k, sizes", [(1, None), (3, None), (5, None), (6, [2, 5]), (4, [9])])
def test_consensus_of_subsets_equals_counting(spark, k, sizes):
    rng = random.Random(k)
    names = [f"a{i}" for i in range(k)]
    combos = [(*[rng.choice(["PURE", "FLOSS", "OTHER"]) for _ in names], rng.randrange(1, 9)) for _ in range(25)]
    frame = spark.createDataFrame(combos, ", ".join(f"{n} string" for n in names) + ", n long")
    out = G.consensus(frame, names, sizes=sizes).collect()
    got = {(r["kind"], r["members"]): (r["agreements"], r["total"]) for r in out if r["kind"] != "breakdown"}
    assert got == _brute_consensus(combos, names, [s for s in sizes or range(1, k + 1) if s <= k])
    splits = {r["members"]: r["agreements"] for r in out if r["kind"] == "breakdown"}
    same = [c for c in combos if len(set(c[:k])) == 1]
    assert splits == {"total_agreement": sum(c[-1] for c in same), "total_disagreement": sum(c[-1] for c in combos) - sum(c[-1] for c in same),
                      **{f"agreement_{v}": sum(c[-1] for c in same if c[0] == v) for v in ("PURE", "FLOSS")}}


def test_sixteen_annotators(spark):
    rng = random.Random(1)
    names = [f"m{i:02d}" for i in range(16)]
    rows = [(f"k{i}", n, rng.choice(["PURE", "FLOSS"])) for i in range(60) for n in names]
    votes = spark.createDataFrame(rows, "item_key string, annotator string, label string")
    start = time.time()
    combos = G.vote_combos(votes, names)
    out = G.consensus(combos, names, sizes=[2, 16])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert time.time() - start < 20 and len(plan) < 200_000
    by_key = {}
    for k, n, v in rows:
        by_key.setdefault(k, {})[n] = v
    got = {r["members"]: r["agreements"] for r in out.collect() if r["kind"] == "subset_2"}
    assert got == {f"{a} + {b}": sum(v[a] == v[b] for v in by_key.values()) for a, b in combinations(names, 2)}
    full = [r for r in G.consensus(combos, names).collect() if r["kind"].startswith("subset_")]
    assert len(full) == 2**16 - 1


def test_consensus_of_nothing(spark):
    empty = spark.createDataFrame([], "a string, b string, n long")
    assert {(r["members"], r["agreements"], r["total"], r["agreement_pct"]) for r in G.consensus(empty, ["a", "b"]).collect()} >= {
        ("a + b", 0, 0, 0.0), ("total_agreement", 0, 0, 0.0)}


def test_summary_file(spark):
    rows = [("m", "m.csv", "a", "TRUE", "PURE"), ("m", "m.csv", "b", "FALSE", None), ("b", "b.csv", "a", "TRUE", "FLOSS")]
    df = spark.createDataFrame(rows, "annotator string, file string, item_key string, reference_label string, candidate_label string")
    out = G.summary_file(df)
    assert out.columns == list(G.SUMMARY_FILE_NAMES.values()) and len(out.columns) == 14
    assert [tuple(r) for r in out.collect()] == [
        ("b", "b.csv", 1, 1, 1, 0, 0, 1, 1, 0, 1, 0, 0, 0), ("m", "m.csv", 2, 1, 1, 1, 1, 0, 1, 1, 0, 1, 0, 1)]
