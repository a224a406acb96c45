"""Operator 13 against a plain version."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordance.llm import common, resample
from tests.llm import brute

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text) -> list[str]:
    return WORD.findall((text or "").translate(brute.LOW))


def buckets(text, n=10_000) -> list[int]:
    w = words(text)
    return [zlib.crc32(f.encode()) % n for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def plain(docs, target, percent=25, least=20) -> list[tuple]:
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(buckets(x))
    for x in target:
        t.update(buckets(x))
    whole_s, whole_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * whole_s / ((s[b] + 1) * whole_t))) for b in range(10_000)]
    rows = []
    for i, x in docs:
        found = buckets(x)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    k = percent * len(able) // 100
    out = [(*r[:4], n + 1) for n, r in enumerate(able[:k])]
    return out + [(*r[:4], None) for r in able[k:] + [r for r in rows if r[4] < least]]


def corpus() -> tuple[list, list]:
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma", "été", "中文", "x1", "word" * 30, "delta", "ONE", "two"]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 80)))) for k in range(300)]
    docs += [(i, t) for i, t, *_ in brute.odd_texts()]
    docs += [(None, "alpha beta " * 15)] * 40 + [(7, "alpha beta " * 15)] * 40  # many rows that tie in all
    return docs, [" ".join(rng.choices(vocabulary[:4], k=50)) for _ in range(20)] + [None, ""]


def frames(spark, docs, target):
    return (
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
        spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string"),
    )


def test_equals_the_plain_version(spark, rows):
    docs, target = corpus()
    assert rows(resample.resample(*frames(spark, docs, target))) == sorted(plain(docs, target), key=repr)


@pytest.mark.parametrize("percent", [0, 1, 50, 100])
def test_other_shares(spark, rows, percent):
    docs, target = corpus()
    got = rows(resample.resample(*frames(spark, docs, target), percent=percent))
    assert got == sorted(plain(docs, target, percent), key=repr)


def test_long_texts_come_in_pieces(monkeypatch):
    rng = random.Random(2)
    text = " ".join(rng.choices(["a", "Bc", "x" * 90, "é", "...", "w" * 300], k=400)) + " end."
    whole = Counter(buckets(text))
    for size in (1, 7, 64, 1000, 10**6):
        parts = list(resample.pieces(text.encode(), size))
        found, _, n = resample.features(parts, [k > 0 for k in range(len(parts))], 10_000)
        assert Counter(found.tolist()) == whole and int(n.sum()) == len(words(text))


def test_checksums():
    texts = [b"", b"a", "é".encode() * 70, b"abc " * 3, b"-"]
    for t in texts:
        found, _, n = resample.features([t], [False], 1 << 31)
        assert sorted(found.tolist()) == sorted(buckets(t.decode(), 1 << 31)) and n[0] == len(words(t.decode()))


def test_kth_smallest(spark):
    rng = np.random.default_rng(4)
    for spread in (1, 10, 10**12):
        values = sorted(rng.integers(-spread, spread, 200).tolist())
        frame = spark.createDataFrame([(v,) for v in values], "v long")
        for k in (1, 2, 100, 200):
            below, upto = (sum(f(v, values[k - 1]) for v in values) for f in (int.__lt__, int.__le__))
            assert resample.kth_smallest(frame, F.col("v"), k) == (values[k - 1], below, upto)


def test_columns_do_not_clash_and_empty_tables(spark, rows):
    docs, target = corpus()
    docs = docs[:50]
    frame, goal = frames(spark, docs, target)
    clash = frame.withColumns({n: F.lit("x") for n in ("score", "row", "rank", "_part", "n_words", "bucket")})
    assert rows(resample.resample(clash, goal)) == sorted(plain(docs, target), key=repr)
    empty = frame.where("false")
    assert resample.resample(empty, goal).count() == 0
    assert rows(resample.resample(frame, goal.where("false"))) == sorted(plain(docs, []), key=repr)


def test_given_table(spark, rows):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()]
    target = [r[0] for r in common.table(spark, sf, "benchmark").select("text").collect()]
    assert rows(resample.op13_resample(spark, sf)) == sorted(plain(docs, target), key=repr)
