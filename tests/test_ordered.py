from __future__ import annotations

import random
from itertools import accumulate

import pytest

from accordance.operators import ordered as O
from accordance.operators import telemetry as W


@pytest.fixture(scope="module")
def hot(spark):
    """One group holds a third of the rows and many rows share one time."""
    rng = random.Random(7)
    data = []
    for i in range(900):
        group = "hot" if i % 3 == 0 else f"g{rng.randrange(40)}"
        data.append((group, rng.choice([1, 1, 1, rng.randrange(100)]), i, rng.randrange(50)))
    return data, spark.createDataFrame(data, "g string, t int, id int, v int").repartition(5)


def test_row_numbers(hot):
    data, df = hot
    want = {r[2]: n for n, r in enumerate(sorted(data, key=lambda r: (r[1], r[2])), 1)}
    got = {r["id"]: r["row_no"] for r in O.number_rows(df, ["t", "id"]).collect()}
    assert got == want


def test_running_sum(hot):
    data, df = hot
    line = sorted(data, key=lambda r: (r[1], r[2]))
    want = dict(zip((r[2] for r in line), accumulate(r[3] for r in line)))
    got = {r["id"]: r["s"] for r in O.running_sum(df, ["t", "id"], "v", "s").collect()}
    assert got == want


def test_within_groups_over_slice_borders(hot):
    data, df = hot
    want = {}
    for g in {r[0] for r in data}:
        line = sorted((r for r in data if r[0] == g), key=lambda r: (r[1], r[2]))
        for n, r in enumerate(line):
            want[r[2]] = (n + 1, line[n - 1][3] if n else None)
    out = O.within_groups(df, "g", ["t", "id"], "v")
    assert {r["id"]: (r["seq"], r["prev_value"]) for r in out.collect()} == want


def test_a_group_over_many_slices(spark):
    df = spark.createDataFrame([("only", i, i * i) for i in range(200)], "g string, t int, v int")
    assert O.sliced(df, ["g", "t"]).select("_slice").distinct().count() > 2
    out = O.within_groups(df, "g", ["t"], "v").orderBy("t").collect()
    assert [r["seq"] for r in out] == list(range(1, 201))
    assert [r["prev_value"] for r in out] == [None, *(i * i for i in range(199))]


def test_the_missing_group_is_a_group(spark):
    df = spark.createDataFrame([(None, i) for i in range(100)] + [("b", 1)], "g string, t int")
    out = O.within_groups(df, "g", ["t"], "t").where("g IS NULL").orderBy("t").collect()
    assert [r["seq"] for r in out] == list(range(1, 101))
    assert [r["prev_value"] for r in out] == [None, *range(99)]


def test_null_values_and_groups(spark):
    df = spark.createDataFrame(
        [("a", 1, None), ("a", 2, 5), ("a", 3, None), ("b", 1, 7)], "g string, t int, v int"
    )
    got = [tuple(r) for r in O.within_groups(df, "g", ["t"], "v").orderBy("g", "t").collect()]
    assert got == [("a", 1, None, 1, None), ("a", 2, 5, 2, None), ("a", 3, None, 3, 5), ("b", 1, 7, 1, None)]


def test_first_per_key_ignores_row_order(spark, rows):
    data = [("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", 1, None)]
    want = [("a", 1, "y"), ("b", 1, None)]
    for seed in range(3):
        random.Random(seed).shuffle(data)
        df = spark.createDataFrame(data, "k string, o int, v string").repartition(3)
        assert rows(O.first_per_key(df, "k", ["o"])) == want


def test_rank_limit_goes_below_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS g", "id AS o")
    plan = O.first_rows(df, "g", ["o"], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_batches_and_dedupe(spark, rows):
    df = spark.createDataFrame(
        [(f"k{i:03d}", "PURE" if i % 2 else "FLOSS") for i in range(25)], "item_key string, c string"
    )
    got = rows(W.batch_timeline(df, ["item_key"], "c", ("PURE", "FLOSS")))
    assert got == [(1, 5, 5, "Batch 1"), (2, 5, 5, "Batch 2"), (3, 2, 3, "Batch 3")]
    items = spark.createDataFrame([("p", f"c{i % 4}", i) for i in range(20)], "p string, c string, o int")
    last = W.last_per_group(items, "p", ["o"])
    assert sorted(r["o"] for r in last.collect()) == list(range(8, 20))
    assert sorted(r["o"] for r in W.dedupe_first(last, "c", ["o"]).collect()) == [8, 9, 10, 11]
    assert tuple(W.dedupe_report(last, "c").first()) == (12, 4, 8)


SESSIONS = "session_id string, start_time timestamp, end_time timestamp, total_processed long, ok long, failed long"


def test_session_rates_edges(spark):
    df = spark.sql(
        "SELECT * FROM VALUES "
        "('a', timestamp '2024-01-01 10:00:00', timestamp '2024-01-01 10:10:00', 5L, 4L, 1L),"
        "('b', timestamp '2024-01-01 11:00:00', timestamp '2024-01-01 11:00:00', 1L, 1L, 0L),"
        "('c', timestamp '2024-01-01 12:00:00', CAST(NULL AS timestamp), 0L, 0L, 0L)"
        " AS t(session_id, start_time, end_time, total_processed, ok, failed)"
    )
    got = {r["session_id"]: (r["duration_minutes"], r["success_pct"], r["items_per_minute"])
           for r in W.session_rates(df).collect()}
    assert got == {"a": (10.0, 80.0, 0.5), "b": (0.0, 100.0, 0.0), "c": (None, 0.0, 0.0)}
    cum = {r["session_id"]: r["cumulative"] for r in W.cumulative(df).collect()}
    assert cum == {"a": 5, "b": 6, "c": 6}
    assert [r["session_id"] for r in W.last_sessions(df, 2).collect()] == ["c", "b"]
    p = W.progress(df, 10).first()
    assert (p["done"], p["remaining"], p["progress_pct"]) == (5, 5, 50.0)
    assert (p["items_per_hour"], p["hours_left"]) == (30.0, 5 / 30.0)


def test_degradation_and_drift(spark):
    times = [10, 10, 31, 30, 30, 30, 30, 30, 91, 10]
    df = spark.createDataFrame([("m", i, d) for i, d in enumerate(times)], "m string, i int, duration int")
    out = W.degradation(df, "m", ["i"]).orderBy("i").collect()
    assert [r["i"] for r in out if r["degraded"]] == [2, 8]
    assert [r["i"] for r in out if r["marker"]] == [7]
    drift = W.half_drift(df, "m", ["i"])
    r = drift.first()
    assert (r["first_n"], r["second_n"], r["first_mean"], r["second_mean"], r["drifted"]) == (
        5, 5, 22.2, 38.2, True)
    grades = {r["i"]: r["grade"] for r in W.grade_rows(df, drift, "m").collect()}
    assert (grades[0], grades[3], grades[8]) == ("ok", "ok", "bad")


def test_item_eta(spark):
    df = spark.sql("SELECT timestamp '2024-01-01 10:00:00' AS start_time, timestamp '2024-01-01 10:01:00' AS now, 4L AS done")
    r = W.item_eta(df, 10).first()
    assert (r["elapsed_seconds"], r["progress_pct"], r["eta_seconds"]) == (60.0, 40.0, 90.0)


@pytest.mark.parametrize("width", [1, 4, 150])
def test_several_lags_and_sizes(spark, hot, width):
    data, df = hot
    data = data[:400] + [(None, r[1], r[2], r[3]) for r in data[400:450]]
    frame = spark.createDataFrame(data, "g string, t int, id int, v int").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    try:
        out = O.within_groups(frame, "g", ["t", "id"], "v", prev=["p1", "p2", "p3"], size="size").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(out) == len(data)
    for g in {r[0] for r in data}:
        line = sorted((r for r in data if r[0] == g), key=lambda r: (r[1], r[2]))
        got = {r["id"]: tuple(r[c] for c in ("seq", "p1", "p2", "p3", "size")) for r in out if r["g"] == g}
        for n, r in enumerate(line):
            assert got[r[2]] == (n + 1, *(line[n - j][3] if n >= j else None for j in (1, 2, 3)), len(line))


def test_slices_are_found_by_search(spark):
    df = spark.range(500).selectExpr("id % 97 AS a", "id AS b")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rows = sorted((r["a"], r["b"], r["_slice"]) for r in O.sliced(df, ["a", "b"]).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r[2] for r in rows] == sorted(r[2] for r in rows)
    assert {r[2] for r in rows} == set(range(13))


def test_durations_and_degradation_read_events_once_per_use(spark, rows):
    data = [("u", i, (i * i * 7) % 50 + 100 * i) for i in range(60)] + [("w", 100, 5)]
    events = spark.createDataFrame(data, "u string, id int, at long")
    out = W.event_durations(events, "u", ["at", "id"], "at", size=True)
    both = W.degradation(out, "u", ["at", "id"], numbered=True)
    anew = W.degradation(out.select("u", "id", "at", "duration"), "u", ["at", "id"])
    names = ("id", "item_no", "previous", "degraded", "marker")
    assert rows(both, *names) == rows(anew, *names)
    drift = W.half_drift(out, "u", ["at", "id"], numbered=True)
    assert rows(drift) == rows(W.half_drift(out.drop("n_items", "item_no"), "u", ["at", "id"]))
    assert both._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 5  # rows and slice ends, their samples of the order
