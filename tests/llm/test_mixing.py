"""Operator 11 against plain targets, and its balance."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from accordance.llm import common, mixing
from tests.llm import brute


def size_of(text) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes: dict, percent=150, most=2) -> dict:
    """Shares by weight, what is above shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    target, left = dict.fromkeys(order, 0.0), sum(sizes.values()) * percent / 100
    free = [s for s in order if sizes[s]]
    while free and left > 1e-6:
        whole = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / whole
        left = sum(max(0.0, target[s] - most * sizes[s]) for s in free)
        for s in free:
            target[s] = min(target[s], float(most * sizes[s]))
        free = [s for s in free if target[s] < most * sizes[s]]
    return target


def check(data, out, slack):
    """``data``: (doc_id, text, source); ``out``: rows of `planned`."""
    assert Counter((i, s, size_of(t)) for i, t, s in data) == Counter((r["doc_id"], r["source"], r["size"]) for r in out)
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += size_of(t)
    target = plain_targets(dict(sizes))
    taken, docs, wanted = defaultdict(int), defaultdict(int), defaultdict(float)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]], rel=1e-9)
        times = r["target"] / r["source_size"] if r["source_size"] else 0.0
        assert r["copies"] in (int(times), -int(-times // 1)) and r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        docs[r["source"]] += r["copies"]
        wanted[r["source"]] += times
    for s in sizes:
        assert abs(taken[s] - target[s]) <= slack(s, sizes[s]), (s, taken[s], target[s])
        assert abs(docs[s] - wanted[s]) <= 11


def corpus(n=3000):
    rng = random.Random(9)
    data = []
    for k in range(n):
        source = "hot" if rng.random() < 0.5 else rng.choice(["a", "B", "é", "中", "tiny", None])
        words = int(rng.paretovariate(0.9)) % 5000
        data.append((k, "wort " * words, source))
    return data + [(None, "one two", "a")] * 30 + [(7, "same text", "hot")] * 30 + [(-1, None, "a"), (-2, "", None), (-3, None, "void")]


def test_totals_are_kept(spark):
    data = corpus()
    frame = spark.createDataFrame(data, "doc_id long, text string, source string")
    # what is left to the landing is among the smallest documents
    check(data, mixing.planned(frame).collect(), lambda s, n: 40)


def test_blocks_and_rounds_change_nothing_in_the_totals(spark, monkeypatch):
    monkeypatch.setattr(mixing, "UNITS", 40)
    monkeypatch.setattr(mixing, "FAN", 3)
    monkeypatch.setattr(mixing, "LEFT", 16)
    data = corpus()
    frame = spark.createDataFrame(data, "doc_id long, text string, source string")
    # blocks of 40 hold too few words to make up for one document of thousands before their last round
    check(data, mixing.planned(frame).collect(), lambda s, n: max(40, 0.03 * n))


def test_reruns_agree_whatever_the_partitions(spark, rows):
    data = corpus(500)
    frame = spark.createDataFrame(data, "doc_id long, text string, source string")
    first = rows(mixing.planned(frame))
    assert rows(mixing.planned(frame.repartition(7))) == first
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows(mixing.planned(frame.coalesce(1))) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("n", [1, 2, 8, 30])
def test_probabilities_are_kept_on_average(n):
    rng = random.Random(n)
    sizes = [int(rng.paretovariate(0.7)) % 900 for _ in range(n)]
    wanted = [rng.choice([0.3, 0.62]) for _ in range(n)]
    times = Counter()
    for seed in range(1500):
        phi = list(wanted)
        draw = random.Random(seed).random
        mixing.fly(sizes, phi, draw, 20)
        mixing.settle_largest(sizes, phi, draw, mixing.LANDING)
        mixing.fly(sizes, phi, draw, mixing.LANDING)
        mixing.land(sizes, phi, draw)
        assert set(phi) <= {0.0, 1.0}
        times.update(k for k, p in enumerate(phi) if p)
    for k in range(n):
        assert abs(times[k] / 1500 - wanted[k]) < 0.06


def test_flight_keeps_both_totals():
    rng = random.Random(1)
    sizes = [int(rng.paretovariate(0.8)) % 9000 for _ in range(400)]
    phi = [rng.random() for _ in sizes]
    before = sum(phi), sum(p * s for p, s in zip(phi, sizes))
    mixing.settle_largest(sizes, phi, rng.random, 300)
    mixing.fly(sizes, phi, rng.random, 2)
    assert sum(0 < p < 1 for p in phi) <= 2
    assert sum(phi) == pytest.approx(before[0], abs=1e-4)
    assert sum(p * s for p, s in zip(phi, sizes)) == pytest.approx(before[1], abs=1.0)


def test_the_mix_itself(spark):
    data = corpus(300)
    frame = spark.createDataFrame([(*r, "x", 1) for r in data], "doc_id long, text string, source string, row string, copies int")
    out = mixing.mixed(frame)
    assert out.columns == [*frame.columns, "copy"]
    found = Counter((r["doc_id"], r["source"], r["text"] or "") for r in out.collect())
    expected = Counter()
    for r in mixing.planned(frame).collect():
        expected[r["doc_id"], r["source"], "wort " * r["size"] if r["doc_id"] not in (None, 7) else None] += r["copies"]
    for key, n in found.items():
        if key[0] not in (None, 7):
            assert expected[key] == n
    assert sum(found.values()) == sum(expected.values())
    with pytest.raises(ValueError):
        mixing.mixed(frame, copy="row")


def test_small_tables(spark, rows):
    schema = "doc_id long, text string, source string"
    assert mixing.planned(spark.createDataFrame([], schema)).count() == 0
    assert mixing.mixed(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(1, "a b c d", "s")], schema)
    assert rows(mixing.planned(one), "target", "size") == [(6.0, 4)]
    blank = spark.createDataFrame([(1, None, None), (2, " ", "s")], schema)
    assert rows(mixing.planned(blank), "doc_id", "source_size", "target", "copies") == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_given_table(spark):
    sf = "/root/testdata/sf0.001"
    data = [tuple(r) for r in common.table(spark, sf, "documents").select("doc_id", "text", "source").collect()]
    out = mixing.op11_source_mix(spark, sf).collect()
    check(data, out, lambda s, n: max(r["size"] for r in out if r["source"] == s))
    assert all(r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in out)
