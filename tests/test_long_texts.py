"""Texts that would take a pattern back to every opening stay linear."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from accordance.functions import answers as A
from accordance.operators import extract as E

N = 40_000


@pytest.mark.parametrize(
    "text",
    [
        "</think>" + "<think> a " * N,
        "<<think>> " * N,
        "critical: " + "CRITICAL: You must respond " * N,
        "```json {" * N + "}",
        "``` {" * N + "}",
        "}" + "{ " * N,
        "{\"a\": " * N,
        "word " * N + ": x",
        "pure " * N + ".",
        "key: value\n" * N,
        "<think a " * N,
        "<think a " * N + ">",
        "\n" * N + "think" + "\n" * N,
        "changes " * N,
        '{"a":[' * N + "]}" * N,
        '{"a":[' * N + "x" + "]}" * N,
    ],
    ids=range(16),
)
def test_open_ends(spark, text):
    df = spark.createDataFrame([("k", text)], "item_key string, response string")
    start = time.time()
    r = E.cascade(df).first()
    assert r["status"] == "ok"
    assert time.time() - start < 30


def test_unclosed_block_is_kept(spark):
    df = spark.createDataFrame([("a<think>x</think>b<think>c <think> d",)], "t string")
    assert df.select(A.remove_blocks("t")).first()[0] == "ab<think>c <think> d"


def test_money_signs_survive(spark):
    df = spark.createDataFrame([("<think>x</think>cost $1 \\ <think> $2",)], "t string")
    assert df.select(A.remove_blocks(F.col("t"))).first()[0] == "cost $1 \\ <think> $2"


@pytest.mark.parametrize(
    "piece", ["<think a ", "<think a />x", "\n", "changes ", "this is ", '{"a":[', '{"a": "x "y" ', '"'], ids=range(8)
)
def test_time_grows_with_the_text(spark, piece):
    def seconds(n):
        df = spark.createDataFrame([("k", "think " + piece * n)], "item_key string, response string")
        best = 1e9
        for _ in range(2):
            start = time.perf_counter()
            df = E.cascade(df.select("item_key", "response"), E.STRUCTURE_FIRST)
            df.collect()
            best = min(best, time.perf_counter() - start)
        return best

    short = seconds(20_000)
    assert seconds(40_000) < 3 * max(short, 1.0)


def test_inner_quotes_before_long_blanks():
    from accordance.functions.brackets import find_value

    for n in (10, 63, 64, 80, 5000):
        blanks = " " * n
        assert json.loads(find_value('{"a": "x "inner"%sy", "b": 1}' % blanks)) == {"a": f'x "inner"{blanks}y', "b": 1}
        assert json.loads(find_value('{"a": "x "%sy" }' % blanks)) == {"a": f'x "{blanks}y'}


def test_open_tags_and_blank_lines_are_kept(spark):
    texts = ["<think a <think b", "a <think/> b", "a <think x/> <think y> z", "\n\n x\n think: no\ny", "this pure. this is so. done"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(A.remove_blocks("t")).collect()]
    assert got[:4] == ["<think a <think b", "a  b", "a  <think y> z", "\n\n x\n\ny"]
    assert df.select(A.bare_justification("t", 0)).collect()[4][0] == ". done"
