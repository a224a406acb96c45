"""Components of links: rounds, and results with one task and with several."""

from __future__ import annotations

import pytest

from accordance.llm import common, components
from tests.llm import brute


def _links():
    chain = [(i, i + 1) for i in range(1, 400)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    return chain[::2] + star + [(b, a) for a, b in chain[1::2]] + [(5000, 5000), (7000, 7001), (7001, 7000)]


@pytest.mark.parametrize("at_once", [1 << 18, 64])
def test_components_are_right_whatever_a_task_takes(spark, monkeypatch, at_once):
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    pairs = _links()
    found = components.components(spark.createDataFrame(pairs, "a long, b long").repartition(7))
    linked = {n for p in pairs if p[0] != p[1] for n in p}
    wanted = brute.components(linked, [p for p in pairs if p[0] != p[1]])
    rows = found.collect()
    assert len(rows) == len(linked)
    assert {r["node"]: r["component"] for r in rows} == wanted


def test_few_links_need_one_round(spark, monkeypatch):
    tables = []
    written = common.written
    monkeypatch.setattr(components.common, "written", lambda df: tables.append(df) or written(df))
    found = components.components(spark.createDataFrame(_links(), "a long, b long").repartition(7))
    assert found.select("component").distinct().count() == 3
    assert len(tables) == 1


def test_no_links(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
