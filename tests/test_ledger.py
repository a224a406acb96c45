from __future__ import annotations

from accordance.operators import ledger as M
from accordance.operators import scorer as K

LED = "item_key string, reference_label string, candidate_label string"
ROWS = [("a", "TRUE", None), ("b", "FALSE", "PURE"), ("c", "FALSE", ""), ("d", "FALSE", "FAILED"), ("e", "FALSE", None)]


def test_choosing_work(spark, rows):
    led = spark.createDataFrame(ROWS, LED)
    assert rows(M.first_pending(led, 2), "item_key") == [("a",), ("c",)]
    assert tuple(M.shortfall(led, 5).first()) == (3, 2)
    one = {tuple(M.random_pending(led, s).first()) for s in range(20)}
    assert M.random_pending(led, 3).first() == M.random_pending(led.repartition(3), 3).first()
    assert len(one) > 1 and {r[0] for r in one} <= {"a", "c", "e"}
    got = rows(M.with_batches(led, 2), "item_key", "batch_no")
    assert got == [("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 3)]


def test_increment(spark):
    led = spark.createDataFrame(ROWS, LED)
    resp = spark.createDataFrame([("a", "floss"), ("c", "Only structural"), ("b", "floss")], "item_key string, response string")
    out = M.label_increment(led, resp, reference="FALSE")
    got = {r["item_key"]: (r["candidate_label"], r["outcome"]) for r in out.collect()}
    assert got == {"a": (None, "kept"), "b": ("PURE", "kept"), "c": ("PURE", "labelled"),
                   "d": ("FAILED", "kept"), "e": ("FAILED", "failed")}
    assert tuple(M.increment_stats(out).first()) == (2, 1, 1, 3)
    again = M.label_increment(out.drop("outcome"), resp, reference="FALSE")
    assert again.where("outcome <> 'kept'").count() == 0
    forced = M.label_increment(led, resp, skip_labelled=False, limit=2)
    got = {r["item_key"]: r["candidate_label"] for r in forced.collect()}
    assert (got["a"], got["b"]) == ("FLOSS", "FLOSS") and got["d"] == "FAILED"


SNAP = "item_key string, candidate_label string, source string, taken_at int"


def test_recovery(spark, rows):
    led = spark.createDataFrame(ROWS, LED)
    snaps = spark.createDataFrame(
        [("a", "FLOSS", "s2", 2), ("a", "PURE", "s1", 1), ("a", None, "s0", 0), ("b", "FLOSS", "s1", 1),
         ("c", "FLOSS", "s3", 3), ("zz", "PURE", "s1", 1)], SNAP)
    first, last = M.recover(led, snaps), M.recover(led, snaps, last=True)
    assert rows(first) == [("a", "PURE", "s1"), ("c", "FLOSS", "s3")]
    assert rows(last) == [("a", "FLOSS", "s2"), ("c", "FLOSS", "s3")]
    new = M.apply_recovery(led, first)
    assert M.recover(new, snaps).count() == 0  # recovered and done keys are disjoint
    log = rows(M.change_log(led, new))
    assert log == [("a", None, "PURE", "new"), ("c", None, "FLOSS", "new")]
    assert rows(M.apply_recovery(new, first)) == rows(new)
    assert rows(M.change_log(new, M.reset_labels(new)), "change") == [("removed",)] * 4


def test_bootstrap_and_log(spark, rows):
    master = spark.createDataFrame([("a", "TRUE"), ("b", "FALSE")], "item_key string, reference_label string")
    have = spark.createDataFrame([("a", "m"), ("b", "other")], "item_key string, annotator string")
    assert rows(M.bootstrap(master, have, "m")) == [("b", "FALSE", None, "m")]
    log = spark.createDataFrame([("x", None), (None, "y"), ("x", "z"), (None, None)], "commit2 string, commit_hash_current string")
    assert rows(M.analysed_keys(log)) == [("x",), ("y",)]


def test_user_scorer(spark):
    calls = spark.createDataFrame(
        [("a", "ok"), ("b", "boom"), ("c", "none"), ("d", "ok")], "item_key string, request string").repartition(2)

    def complete(text):
        if text == "boom":
            raise RuntimeError("down")
        return "FINAL: pure" if text == "ok" else None

    out = {r["item_key"]: r for r in K.ask_all(calls, complete).collect()}
    assert {k: (r["status"], r["attempts"]) for k, r in out.items()} == {
        "a": ("OK", 1), "b": ("ERROR", 3), "c": ("FAILED", 3), "d": ("OK", 1)}
    assert out["b"]["error"] == "RuntimeError: down"
