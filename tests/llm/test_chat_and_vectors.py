"""Operators 1 and 3, and the pipeline."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from accordance.llm import chat, common, vectors
from accordance.llm.registry import all_queries
from accordance.operators.ordered import sliced
from tests.llm import brute
from tests.oracle import compare, connect

TURNS = "conv_id long, turn long, role string, text string, system string, before int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS)


def test_sql(spark):
    query, sql = all_queries()["op1_chat_windows"]
    sf = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf), query, sql, sf) == []


def odd_turns() -> list[tuple]:
    rows = [(1, 0, "system", "be ### brief"), *((1, k, "user" if k % 2 else "assistant", f"turn {k} \\b </turn> " * (k % 9)) for k in range(1, 700))]
    rows += [(2, None, None, None), (2, 1, "assistant", "same"), (2, 1, "assistant", "same"), (2, 1, "to:ol\\=", "x: y")]
    rows += [(3, 0, "assistant", "word " * 9000), (4, 0, "assistant", ""), (None, 0, "user", "no id"), (5, 0, "system", "s " * 9000), (5, 1, "user", "hi"), (5, 2, "assistant", "ho")]
    return rows


def test_conversations_read_back(spark):
    rows = odd_turns()
    expected = {}
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c))
        loss = "".join(x for *_, r, x in own if r == "assistant")
        expected[c] = (len(own), brute.sha("".join(f"{r}\n{x}\n" for *_, r, x in own)), len(loss), brute.sha(loss))
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(turns(spark, rows)).collect()}
    assert got == expected


def test_windows_keep_to_the_budget(spark):
    rows = [r for r in odd_turns() if r[0] == 1]
    windows = chat.format_windows(turns(spark, rows)).orderBy("block", "window").collect()
    assert len(windows) > 3 and sum(w["n_turns"] for w in windows) == len(rows)
    for k, w in enumerate(windows):
        assert w["n_tokens"] <= chat.BUDGET + w["n_turns"] and not (w["over_budget"] and w["n_turns"] > 1)
        assert w["text"].startswith("### System: be \\h brief</turn>\n")
        if k:  # the repeated turns are the last ones before, and none of them is a target
            repeated = w["text"].split("</turn>\n")[1 : w["n_repeated"]]
            before = windows[k - 1]["text"].split("</turn>\n")[:-1]
            assert repeated == before[len(before) - len(repeated) :]
            first = len("".join(x + "</turn>\n" for x in w["text"].split("</turn>\n")[: w["n_repeated"]]))
            assert all(s["start"] >= first for s in w["loss_spans"])
    assert chat.digests(turns(spark, [])).count() == 0


@pytest.mark.parametrize("step", [0, 1, 1000])
def test_windows_do_not_depend_on_the_numbers_of_turns(spark, step):
    """Turns numbered alike, in steps of one and in steps of a thousand; a conversation of three blocks beside short ones."""
    rows = [(None if c == 2 else c, step * k, "user", f"{k:04d} some words") for c, n in ((1, 20), (2, 600), (3, 1)) for k in range(n)]
    windows = chat.format_windows(turns(spark, rows)).orderBy("conv_id", "block", "window").collect()
    shape = {c: [(w["block"], w["n_turns"]) for w in windows if w["conv_id"] == c] for c in (1, None, 3)}
    assert shape[1] == [(0, 20)] and shape[3] == [(0, 1)]
    assert sum(n for _, n in shape[None]) == 600 and {b for b, _ in shape[None]} == {0, 1, 2}
    # a turn has 33 bytes, so 9 tokens: 199 fit 2048 - 256 and 28 the history; a window ends with its block
    assert shape[None] == [(0, 199), (0, 57), (1, 199), (1, 57), (2, 88)]
    long = [w for w in windows if w["conv_id"] is None]
    assert [w["n_repeated"] for w in long] == [0, 28, 28, 28, 28]
    own = "".join("".join(x + "</turn>\n" for x in w["text"].split("</turn>\n")[w["n_repeated"] : -1]) for w in long)
    assert own == "".join(f"### User: {k:04d} some words</turn>\n" for k in range(600))


def test_a_hot_conversation_spreads(spark):
    """One conversation, one turn number: its turns are numbered in many tasks."""
    rows = [(1, 7, "user", f"text {k}") for k in range(4000)]
    by = ["conv_id", *chat.slice_order()]
    sizes = [r["count"] for r in sliced(turns(spark, rows), by).groupBy("_slice").count().collect()]
    assert len(sizes) > 2 and max(sizes) < len(rows) / 2
    windows = chat.format_windows(turns(spark, rows)).collect()
    assert sum(w["n_turns"] for w in windows) == 4000 and max(w["block"] for w in windows) == 15


def links(x, labels, least):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= least) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    return near


def test_vectors_equal_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(6, 32))
    x = np.concatenate([centre[k % 6] + 0.22 * rng.normal(size=32) for k in range(150)] + [rng.normal(size=(50 * 32))]).reshape(-1, 32)
    x = x.astype(np.float32).astype(np.float64)
    labels = np.arange(len(x)) % 2
    x[10], x[12] = x[8], x[8]
    near = links(x, labels, 0.93)
    comp = brute.components(range(len(x)), [(int(a), int(b)) for a, b in np.argwhere(near)])
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [None] * 32, [float("inf")] * 32]
    data = [(k, [float(f) for f in v], int(labels[k]), 1) for k, v in enumerate(x)]
    data += [(1000 + k, v, 0, 1) for k, v in enumerate(odd)] + [(2000, data[8][1], None, 1)]
    got = rows(vectors.find_near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, class int")))
    expected = [(k, int(near[k].sum()), comp[k], comp[k] == k) for k in range(len(x))]
    expected += [(i, 0, i, True) for i, *_ in data[len(x) :]]
    assert got == sorted(expected, key=repr)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.find_near_vectors(empty).count() == 0


@pytest.mark.parametrize("size", [16, 64, 100])
def test_recall_at_the_limit(size):
    rng = np.random.default_rng(size)
    a, b = rng.normal(size=(2, 1500, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    one, two = vectors.codes(a), vectors.codes(b)
    met = (one[:, :, :, None] == two[:, :, None, :]).any(axis=(1, 2, 3))
    assert met.mean() > 0.99


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    columns, before = docs.columns, docs.count()
    items = [tuple(r) for r in common.table(spark, sf, "benchmark").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        docs = common.written(stage(spark, docs, sf))
        assert docs.columns == columns
        ids = sorted(r[0] for r in docs.select("doc_id").collect())
        if name == "near_duplicates":
            assert ids == sorted(i for i, _, c in brute.near_duplicates(given, 5, 80) if i == c)
        if name == "decontamination":
            assert ids == sorted(r[0] for r in brute.contamination(given, items) if not r[-1])
        if name == "personal_data":
            assert not docs.where(F.regexp_like("text", F.lit(brute.BASE["email"]))).count()
    assert 0 < docs.count() < before
    texts = {r[0]: brute.sha(r[1]) for r in docs.select("doc_id", "text").collect()}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in out} == texts
