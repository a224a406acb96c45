from __future__ import annotations

import random

from pyspark.sql import functions as F

from accordance.operators import compare as J

L = "item_key string, reference_label string"
C = "item_key string, candidate_label string, o int"


def test_outer_compare(spark, rows):
    ref = spark.createDataFrame([("a", "pure"), ("b", "floss"), (None, "pure"), ("d", "pure")], L)
    cand = spark.createDataFrame(
        [("a", "floss", 1), ("a", "pure", 2), ("c", "pure", 1), (None, "x", 1), ("d", None, 1)], C
    )
    got = rows(J.outer_compare(ref.withColumn("o", F.lit(0)), cand, order=["o"]))
    assert got == [
        ("a", "pure", "pure", True, True, True),
        ("b", "floss", "not_analyzed", True, False, False),
        ("c", "not_in_purity", "pure", False, True, False),
        ("d", "pure", "unknown", True, True, False),
    ]


def test_spread_and_unite(spark, rows):
    votes = spark.createDataFrame(
        [("k1", "m", "TRUE", None, 1), ("k1", "m", "TRUE", "PURE", 2), ("k1", "g", "TRUE", "FLOSS", 1),
         ("k2", "g", None, None, 1), ("k2", "d", "FALSE", "FAILED", 1)],
        "item_key string, annotator string, reference_label string, candidate_label string, part int",
    )
    want = [("k1", "true", "pure", "floss", "not_found"), ("k2", "false", "not_found", "unlabelled", "failed")]
    assert rows(J.unite_annotators(votes, ("m", "g", "d"), ["part"])) == want
    keys = spark.createDataFrame([("k1", "TRUE"), ("k9", None)], L)
    got = rows(J.lookup_annotators(keys, votes, ("m", "d"), order=["part"]))
    assert got == [("k1", "true", "pure", "not_found"), ("k9", "unknown", "not_found", "not_found")]


def test_override_by_missing_label(spark, rows):
    """A later row without a label still overrides: it is the row that counts."""
    votes = spark.createDataFrame(
        [("k", "m", "TRUE", "PURE", 1), ("k", "m", "TRUE", None, 2)],
        "item_key string, annotator string, reference_label string, candidate_label string, part int",
    )
    assert rows(J.unite_annotators(votes, ("m",), ["part"])) == [("k", "true", "unlabelled")]


ITEMS = "project string, project_name string, before_key string, after_key string, o int"
DATA = [("P1", "p1", "b1", "a1", 2), ("P0", "p0", "b1", "a9", 1), ("P2", "p2", "b2", "b1", 0), ("P3", "p3", None, "a3", 5)]


def test_enrich_falls_back_per_row_or_as_a_whole(spark, rows):
    items = spark.createDataFrame(DATA, ITEMS)
    keys = spark.createDataFrame([("b1",), ("a3",), ("zz",)], "item_key string")
    assert rows(J.enrich(keys, items, ["o"]), "item_key", "project") == [
        ("a3", "P3"), ("b1", "P0"), ("zz", "unknown")]
    assert rows(J.enrich(keys, items, ["o"], per_row=False), "item_key", "project") == [
        ("a3", "unknown"), ("b1", "P0"), ("zz", "unknown")]
    only_after = keys.where("item_key = 'a3'")
    assert rows(J.enrich(only_after, items, ["o"], per_row=False), "item_key", "project") == [("a3", "P3")]


def test_either_key_takes_the_first_item(spark, rows):
    items = spark.createDataFrame(DATA, ITEMS)
    keys = spark.createDataFrame([("b1",), ("a3",), ("zz",)], "item_key string")
    assert rows(J.either_key(keys, items, ["o"])) == [
        ("a3", "P3", None, "a3"), ("b1", "P2", "b2", "b1"), ("zz", None, None, None)]
    assert rows(J.first_lookup(keys, items, "before_key", ["o"], ["project"])) == [
        ("a3", None), ("b1", "P0"), ("zz", None)]


def test_top_evidence(spark, rows):
    df = spark.createDataFrame(
        [("k", i, t) for i, t in enumerate([None, "a", "b", None, "c", "d"])] + [("n", 1, None)],
        "item_key string, o int, description string",
    )
    assert rows(J.top_evidence(df, ["o"])) == [("k", "a; b; c")]


def test_patch_and_overwrite(spark, rows):
    led = spark.createDataFrame([("a", None), ("b", "PURE"), ("c", ""), ("d", "FLOSS"), ("e", "PURE")],
                                "item_key string, candidate_label string")
    new = spark.createDataFrame([("a", "PURE"), ("b", "FLOSS"), ("d", "FLOSS"), ("e", None), ("x", "PURE")],
                                "item_key string, candidate_label string")
    assert rows(J.patch_fill(led, new)) == [
        ("a", "PURE"), ("b", "PURE"), ("c", None), ("d", "FLOSS"), ("e", "PURE")]
    got = {r["item_key"]: (r["candidate_label"], r["change"]) for r in J.diff_overwrite(led, new).collect()}
    assert got == {"a": ("PURE", "new"), "b": ("FLOSS", "changed"), "c": (None, "absent"),
                   "d": ("FLOSS", "same"), "e": ("PURE", "absent")}


def test_fixed_compare_and_keys(spark, rows):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "item_key string")
    res = spark.createDataFrame([("a", "floss", "why", "r"), ("b", "pure", None, "s")],
                                "item_key string, label string, justification string, repository string")
    assert rows(J.fixed_compare(keys, res)) == [
        ("a", "floss", "floss", "why", "r", True), ("b", "floss", "pure", None, "s", False),
        ("c", "floss", "not_analyzed", "Commit not analyzed by LLM", "", False)]
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("z", 4)], "k string, n int")
    assert rows(J.keep_keys(df, keys, "k"), "n") == [(1,), (2,)]
    assert rows(J.skip_keys(df, keys, "k"), "n") == [(3,), (4,)]


def test_contains_lookup(spark, rows):
    s = spark.createDataFrame([("mid_x", 1), ("mid", 2), ("other", 3)], "annotator string, n int")
    assert rows(J.contains_lookup(["mid", "zzz", "oth"], s, ["n"]), "short_name", "n") == [
        ("mid", 1), ("oth", 3), ("zzz", None)]


def test_key_sets(spark, rows):
    a = spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "k string")
    b = spark.createDataFrame([("2",), ("3",)], "k string")
    c = spark.createDataFrame([("2",), ("1",), ("9",)], "k string")
    assert tuple(J.intersection_report(a, b).first()) == (2, 2, 1, 50.0, 50.0)
    assert tuple(J.overlap_report(a, b, c).first()) == (2, 4, 2, 1, 2, 1)
    assert rows(J.distinct_keys(a, b)) == [("1",), ("2",), ("3",)]
    assert rows(J.key_intersection(a, b)) == [("2",)]
    assert rows(J.key_difference(b, a)) == [("3",)]
    assert rows(J.concat_rows(a, b.withColumn("x", F.lit(1))).where("k = '3'")) == [("3", 1)]


def test_expansion(spark):
    planned = spark.createDataFrame([("a",), ("b",), ("c",)], "item_key string")
    found = spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "k string")
    assert tuple(J.expansion_report(planned, found, "k").first()) == (3, 2, 3, 0, 1)


def test_no_cross_join_and_no_hinted_broadcast(spark):
    """Plans stay equi-joins; nothing is broadcast on a hint."""
    items = spark.createDataFrame(DATA, ITEMS)
    keys = spark.createDataFrame([("b1",)], "item_key string")
    for df in (J.enrich(keys, items, ["o"]), J.either_key(keys, items, ["o"])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        physical = df._jdf.queryExecution().executedPlan().toString()
        assert "strategy=broadcast" not in plan
        assert "NestedLoop" not in physical and "Cartesian" not in physical


def test_contained_names_equal_comparing_all(spark, rows):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcé中") for _ in range(n))
    texts = [word(rng.randrange(0, 15)) for _ in range(120)] + ["mistral:7b", "gemma2_2b", None]
    names = [word(rng.randrange(0, 6)) for _ in range(200)] + ["", "mistral", "gemma", "2b", ":", "none here", None]
    got = rows(J.contained_names(
        spark.createDataFrame([(n,) for n in names], "n string"), spark.createDataFrame([(t,) for t in texts], "t string"), "n", "t"))
    assert got == sorted({(n, t) for n in names for t in texts if n is not None and t is not None and n in t}, key=repr)


def test_many_names(spark):
    names = spark.range(100_000).selectExpr("concat('n', id, 'x') AS short_name")
    summary = spark.range(3000).selectExpr("concat('model_n', id * 37, 'x', id % 7) AS annotator", "id AS n")
    out = J.contains_lookup(names, summary, ["annotator"])
    found = {r["short_name"]: r["n"] for r in out.where("annotator IS NOT NULL").collect()}
    assert found == {f"n{k * 37}x": k for k in range(3000) if k * 37 < 100_000}
    assert out.count() == 100_000
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()
