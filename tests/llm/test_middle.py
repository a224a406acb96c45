"""Operator 12 against a plain version, and exact round trips."""

from __future__ import annotations

import random
import re
from hashlib import sha256

import numpy as np
import pytest

from accordance.llm import middle
from tests.llm import brute

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text) -> tuple:
    text = text or ""
    units = UNIT.findall(text)
    d = sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in middle.MARKS) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts() -> list[tuple]:
    rng = random.Random(3)
    signs = "ab é中😀 \n\t  \x0b\x1c\x00<P"
    rows = [(k, "".join(rng.choice(signs) for _ in range(rng.randrange(1, 900)))) for k in range(200)]
    rows += [(500 + k, t) for k, t in enumerate(["a <P> b", "<S>", "x<M", "<" * 40 + "P" * 40, " \n ", "z" * 70_000, "wort " * 60_000])]
    return rows


def test_equals_the_plain_version_and_is_rebuilt(spark, rows):
    data = texts() + [(i, t) for i, t, *_ in brute.odd_texts()]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    out = middle.fill_in_middle(frame)
    assert rows(out) == sorted((plain(i, t) for i, t in data), key=repr)
    back = out.select("doc_id", middle.restored().alias("text"))
    assert rows(back) == sorted(((i, t or "") for i, t in data), key=repr)
    assert {r[2] for r in rows(out)} == {"plain", "spm", "psm"}


def test_columns_of_the_input_do_not_clash(spark, rows):
    frame = spark.createDataFrame(
        [(1, "one two three", "x", 3, "y")], "doc_id long, text string, form string, n long, output string"
    )
    assert rows(middle.fill_in_middle(frame)) == [plain(1, "one two three")]
    assert rows(middle.digests(frame))[0][6] == brute.sha("one two three")


def test_every_boundary_of_the_tree():
    rng = np.random.default_rng(1)
    for size in (0, 1, 255, 256, 257, 5000):
        data = rng.choice(np.frombuffer("ab  \n".encode(), np.uint8), size)
        ends, begins = middle._masks(data)
        tree, at = middle.BlockTree(ends, begins), np.flatnonzero(ends) + 1
        assert tree.find(0) == (0, 0)
        assert [tree.find(k + 1) for k in range(len(at))] == [(int(x), int(x)) for x in at]


def test_marks_that_overlap_are_refused(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for marks in (("", "b", "c"), ("aba", "x", "y"), ("ab", "bc", "x"), ("a", "xay", "z")):
        with pytest.raises(ValueError):
            middle.fill_in_middle(frame, marks=marks)


def test_other_parameters_and_empty_table(spark, rows):
    frame = spark.createDataFrame([(k, f"text {k} with words") for k in range(50)], "doc_id long, text string")
    out = rows(middle.fill_in_middle(frame, seed=1, rate=100, spm_rate=0, marks=("[p]", "[s]", "[m]")))
    assert {r[2] for r in out} == {"psm"} and all(r[5].startswith("[p]") for r in out)
    assert middle.digests(spark.createDataFrame([], brute.COLUMNS)).count() == 0
