from __future__ import annotations

import os
import random

import pytest

from accordance.operators import ledger as M
from accordance.sources import changelog as C
from accordance.sources import writers as W
from accordance.streaming import arrivals as S

KIND = "item_key string, reference_label string, candidate_label string, n long"


def history(steps=6):
    """Versions of a ledger in which labels come, change and go, and keys repeat."""
    rng = random.Random(3)
    state = [(f"k{i}", rng.choice(["TRUE", None]), None, None) for i in range(40)] + [("k1", "TRUE", None, None)] * 2 + [(None, None, "PURE", 1)]
    out = [list(state)]
    for _ in range(steps):
        for _ in range(12):
            i = rng.randrange(len(state))
            state[i] = (state[i][0], state[i][1], rng.choice([None, "PURE", "FLOSS"]), rng.choice([None, 1]))
        if rng.random() < 0.5:
            state.pop(rng.randrange(len(state)))
        state.append((f"x{rng.randrange(5)}", "FALSE", "FLOSS", 2))
        out.append(list(state))
    return out


@pytest.fixture(scope="module")
def logged(spark, tmp_path_factory):
    """The same versions as a log with a full copy every third time, and as full copies."""
    root = tmp_path_factory.mktemp("log")
    log, full, stamps = f"{root}/log", f"{root}/full", []
    for state in history():
        df = spark.createDataFrame(state, KIND)
        stamps.append((C.write_version(df, log, full_every=3), W.write_version(df, full)))
    return log, full, stamps


def test_any_version_equals_the_full_copy(spark, rows, logged):
    log, full, stamps = logged
    for a, b in stamps:
        assert rows(C.read_version(spark, log, a)) == rows(W.read_version(spark, full, b))
    assert C.versions(spark, log) == [a for a, _ in stamps]
    assert C.full_copies(spark, log) == [stamps[3][0], stamps[6][0]]


def test_versions_hold_only_what_changed(spark, logged):
    log, _, stamps = logged
    for state, before, (stamp, _) in zip(history()[1:], history(), stamps[1:]):
        held = spark.read.parquet(f"{log}/changes/v={stamp}")
        assert 0 < held.count() <= 2 * 14 < len(state)
    sizes = {r["version"]: r["n_rows"] for r in C.sizes(spark, log).collect()}
    assert [sizes[a] for a, _ in stamps] == [len(s) for s in history()]


def test_recovery_from_the_log_alone(spark, rows, logged):
    log, full, _ = logged
    now = W.read_version(spark, full)
    for last in (False, True):
        snaps = C.read_version_snapshots(spark, log, last)
        assert all("/changes/" in f for f in snaps.inputFiles())
        ours, theirs = M.recover(now, snaps, last), M.recover(now, W.read_version_snapshots(spark, full), last)
        once = {r[0] for r in rows(now.groupBy("item_key").count().where("count = 1"), "item_key")}
        pick = lambda df: [r for r in rows(df, "item_key", "candidate_label") if r[0] in once]
        assert pick(ours) == pick(theirs) and pick(ours)


def test_label_changes_equal_the_comparison_of_states(spark, rows, logged):
    log, full, stamps = logged
    found = rows(C.label_changes(spark, log), "version", "item_key", "old_label", "new_label", "change")
    once = {k for k in {r[0] for s in history() for r in s} if k and all(sum(r[0] == k for r in s) <= 1 for s in history())}
    expected = []
    for (_, b), (a2, b2) in zip(stamps, stamps[1:]):
        log_ = M.change_log(W.read_version(spark, full, b), W.read_version(spark, full, b2))
        expected += [(a2, *r) for r in rows(log_, "item_key", "old_label", "new_label", "change") if r[0] in once]
    assert [r for r in found if r[1] in once] == sorted(expected, key=repr)
    assert {r[4] for r in found} == {"new", "changed", "removed"}


def test_compaction(spark, rows, logged, tmp_path):
    path = f"{tmp_path}/c"
    for state in history(3):
        C.write_version(spark.createDataFrame(state, KIND), path)
    before = [rows(C.read_version(spark, path, v)) for v in C.versions(spark, path)]
    assert C.full_copies(spark, path) == []
    newest = C.compact(spark, path)
    assert C.compact(spark, path) == newest == C.full_copies(spark, path)[-1]
    assert [rows(C.read_version(spark, path, v)) for v in C.versions(spark, path)] == before
    assert all("/full/" in f for f in C.read_version(spark, path).inputFiles())
    C.write_version(spark.createDataFrame(history(3)[0], KIND), path)
    assert rows(C.read_version(spark, path)) == before[0]
    os.makedirs(f"{path}/changes/v=99999999T000000000000")  # jobs that died half way
    os.makedirs(f"{path}/full/v=99999999T000000000000")
    assert rows(C.read_version(spark, path)) == before[0]


def test_new_columns_and_no_changes(spark, rows, tmp_path):
    path = f"{tmp_path}/n"
    first = spark.createDataFrame([("a", "PURE")], "item_key string, candidate_label string")
    v1 = C.write_version(first, path)
    v2 = C.write_version(C.read_version(spark, path), path)
    assert v2 > v1 and rows(C.read_version(spark, path, v2)) == [("a", "PURE")]
    C.write_version(spark.createDataFrame([("a", "PURE", 1), ("b", None, None)], "item_key string, candidate_label string, x int"), path)
    assert rows(C.read_version(spark, path), "item_key", "candidate_label", "x") == [("a", "PURE", 1), ("b", None, None)]
    C.compact(spark, path)
    C.write_version(first, path)
    assert rows(C.read_version(spark, path), "item_key", "candidate_label", "x") == [("a", "PURE", None)]
    assert rows(C.read_version(spark, path, v1), "item_key", "candidate_label") == [("a", "PURE")]
    with pytest.raises(FileNotFoundError):
        C.read_version(spark, path, "nothing")
    with pytest.raises(FileNotFoundError):
        C.read_version(spark, f"{tmp_path}/none")
    empty = f"{tmp_path}/e"
    C.write_version(first.where("false"), empty)
    assert C.read_version(spark, empty).count() == 0


def test_arrivals_into_a_log(spark, tmp_path):
    path, work = f"{tmp_path}/led", f"{tmp_path}/work"
    C.write_version(spark.createDataFrame([("a", "TRUE", None), ("b", "FALSE", "PURE")], "item_key string, reference_label string, candidate_label string"), path)
    os.makedirs(f"{tmp_path}/in")
    with open(f"{tmp_path}/in/1.json", "w") as f:
        f.write('{"item_key": "a", "response": "FINAL: floss"}\n')
    S.label_arrivals(S.read_arrivals(spark, f"{tmp_path}/in"), work, f"{tmp_path}/cp").awaitTermination()
    S.merge_arrivals(spark, path, work, storage=C)
    got = {r["item_key"]: r["candidate_label"] for r in C.read_version(spark, path).collect()}
    assert got == {"a": "FLOSS", "b": "PURE"}
    change = C.label_changes(spark, path).collect()
    assert [(r["item_key"], r["new_label"], r["change"]) for r in change] == [("a", "FLOSS", "new")]
