from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from accordance.functions import labels as L
from accordance.functions import sizes as Z
from accordance.operators import filters as P


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column).first()[0]


@pytest.mark.parametrize(
    "raw, label",
    [
        ("true", "TRUE"), (" T ", "TRUE"), ("1", "TRUE"), ("Pure", "TRUE"), ("impure", "TRUE"),
        ("FLOSS", "FALSE"), ("0", "FALSE"), ("na", None), ("NaN", None), ("", None), (None, None),
        ("FAILED", "FAILED"), ("xyz", "XYZ"), ("xfalsey", "FALSE"), ("\tnone\n", None),
    ],
)
def test_normalize(spark, raw, label):
    assert one(spark, L.normalize_label("v"), raw) == label


def test_map_and_replace_differ_on_unmapped(spark):
    assert one(spark, L.map_label("v"), "NOT_FOUND") is None
    assert one(spark, L.map_label("v", keep_unmapped=True), "NOT_FOUND") == "NOT_FOUND"
    assert one(spark, L.map_label("v"), "NONE") == "UNKNOWN"
    assert one(spark, L.map_label("v", keep_unmapped=True), None) is None


@pytest.mark.parametrize(
    "url, a, b, c",
    [
        ("https://h/org/tool.git", "tool", "tool.git", "tool.git"),
        ("https://h/org/tool/", "", "unknown", ""),
        ("tool", "tool", "unknown", "tool"),
        ("", "", "unknown", "unknown"),
        (None, None, "unknown", "unknown"),
    ],
)
def test_repository_names(spark, url, a, b, c):
    assert one(spark, L.repo_from_url("v"), url) == a
    assert one(spark, L.repo_after_slash("v"), url) == b
    assert one(spark, L.repo_or_whole("v"), url) == c


def test_agreement_never_null(spark):
    df = spark.createDataFrame(
        [("A", "A"), ("A", "B"), (None, "A"), (None, None)], "a string, b string"
    ).select(L.agrees("a", "b"))
    assert [r[0] for r in df.collect()] == [True, False, False, False]


def test_pending_and_completed(spark, rows):
    df = spark.createDataFrame(
        [("a", None), ("b", ""), ("c", "None"), ("d", "PURE"), ("e", "FAILED"), ("f", "ERROR")],
        "item_key string, candidate_label string",
    )
    assert [r[0] for r in rows(P.pending(df), "item_key")] == ["a", "b", "c"]
    assert [r[0] for r in rows(P.completed(df.where("candidate_label <> 'None'")), "item_key")] == ["d"]
    only_failed = P.completed(df, failures=("FAILED",)).where("candidate_label = 'ERROR'")
    assert only_failed.count() == 1


def test_first_of_uses_columns_there_are(spark):
    df = spark.createDataFrame([("", "x", "y")], "a string, b string, c string")
    assert df.select(L.first_of(df, "nope", "a", "c")).first()[0] == "y"
    assert df.select(L.first_of(df, "nope")).first()[0] is None


@pytest.mark.parametrize(
    "text, lines, tokens",
    [("", 0, 0), ("a", 1, 1), ("a\n", 1, 1), ("a\nb", 2, 1), ("a\r\nb\r\n", 2, 1), ("\n", 1, 1),
     ("x" * 40, 1, 10), ("a b", 2, 1)],
)
def test_text_sizes(spark, text, lines, tokens):
    assert one(spark, Z.line_count("v"), text) == lines == len(text.splitlines())
    assert one(spark, Z.token_estimate("v"), text) == tokens


@pytest.mark.parametrize(
    "n, default, cautious, simple",
    [(0, 4096, 3072, 2048), (2999, 4096, 4096, 2048), (3000, 6144, 4096, 4096),
     (5999, 6144, 4096, 4096), (6000, 8192, 4096, 6144), (99999, 8192, 4096, 6144)],
)
def test_tiers(spark, n, default, cautious, simple):
    got = [one(spark, Z.tier(F.col("v"), t), n, "long")
           for t in (Z.CONTEXT_DEFAULT, Z.CONTEXT_CAUTIOUS, Z.CONTEXT_SIMPLE)]
    assert got == [default, cautious, simple]


def test_routes(spark):
    assert one(spark, Z.route(F.col("v")), 100_000, "long") == "direct"
    assert one(spark, Z.route(F.col("v")), 100_001, "long") == "file"
    assert one(spark, Z.timeout_tier(F.col("v")), 50_000, "long") == 200
    assert one(spark, Z.timeout_tier(F.col("v")), 50_001, "long") == 300


def test_render_keeps_unknown_braces(spark):
    out = one(spark, Z.render("a {v} {other} {{v}}", {"v": F.col("v")}), "X")
    assert out == "a X {other} {X}"
    assert one(spark, Z.render("<{v}>", {"v": F.col("v")}), None) == "<>"


def test_rows_with_token(spark, rows):
    df = spark.createDataFrame(
        [("a", "pure"), ("b", "xNONEx"), ("failed", None), ("d", None)], "k string, v string"
    )
    assert rows(P.drop_rows_with_token(df), "k") == [("a",), ("d",)]
    assert tuple(P.token_report(df).first()) == (4, 2, 2, 50.0)


def test_facets(spark):
    df = spark.createDataFrame(
        [("TRUE", "PURE", True), ("TRUE", "FLOSS", False), ("FALSE", "FLOSS", True)],
        "reference_label string, candidate_label string, agreement boolean",
    )
    assert tuple(P.facet_stats(df).first()) == (3, 2, 66.7)
    assert tuple(P.facet_stats(df, reference="TRUE").first()) == (2, 1, 50.0)
    assert tuple(P.facet_stats(df, candidate="NOPE").first()) == (0, 0, 0.0)
