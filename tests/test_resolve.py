from __future__ import annotations

import random

import pytest

from accordance.operators import resolve as R

T, F_, N = True, False, None


@pytest.mark.parametrize(
    "labels, out",
    [([F_], "FALSE"), ([T], "TRUE"), ([N], "NONE"), ([T, N], "TRUE"), ([T, F_], "FALSE"),
     ([F_, N], "FALSE"), ([T, F_, N], "FALSE")],
)
def test_tri_state(spark, labels, out):
    df = spark.createDataFrame([("k", v) for v in labels], "item_key string, label boolean")
    assert R.resolve_labels(df).first()["resolved_label"] == out


def test_unusable_state_is_unknown(spark):
    df = spark.createDataFrame(
        [("a", "maybe"), ("b", "True"), ("b", "maybe"), ("c", "None"), ("c", "maybe")],
        "item_key string, state string",
    )
    got = dict(R.resolve_labels(df, state="state").select("item_key", "resolved_label").collect())
    assert got == {"a": "UNKNOWN", "b": "TRUE", "c": "NONE"}


def test_every_key_of_the_list_is_kept(spark):
    keys = spark.createDataFrame([("a",), ("z",)], "item_key string")
    df = spark.createDataFrame([("a", True)], "item_key string, label boolean")
    led = R.resolve_ledger(keys, df)
    assert dict(led.collect()) == {"a": "TRUE", "z": "NOT_FOUND"}
    assert tuple(R.match_report(led).first()) == (2, 1)


ROWS = "item_key string, label boolean, kind string, detail string, note string, ord long"


def _consolidated(spark, data):
    df = spark.createDataFrame(data, ROWS)
    out = R.consolidate(df, ["ord"]).orderBy("item_key", "label")
    return [r.asDict() for r in out.collect()]


def test_same_label_joins_distinct_texts_in_order(spark):
    (r,) = _consolidated(spark, [
        ("keykey1", True, "k2", "b", "n2", 2), ("keykey1", True, "k1", "a", "n1", 1),
        ("keykey1", True, "k1", "b", "n3", 3), ("keykey1", True, None, None, "n4", 4),
    ])
    assert (r["label"], r["kind"], r["detail"], r["note"], r["had_conflict"]) == (
        True, "k1 | k2", "a | b", "n1", False)


def test_conflict_uses_first_false_row_and_tags(spark):
    (r,) = _consolidated(spark, [
        ("keykey1", True, "k1", "a", "n1", 1), ("keykey1", False, "k2", "a", "n2", 2),
        ("keykey1", False, "k3", None, "n3", 3), ("keykey1", True, "k1", "a", "n4", 4),
    ])
    assert (r["label"], r["kind"], r["detail"], r["note"], r["had_conflict"]) == (
        False, "k2", "[True] a | [False] a", "n2", True)


def test_unlabelled_rows_are_added_and_short_keys_dropped(spark):
    out = _consolidated(spark, [
        ("keykey1", None, "k", "x", "n9", 9), ("keykey1", None, "k", "y", "n8", 8),
        ("keykey1", True, "k", "z", "n1", 1), ("short", True, "k", "z", "n1", 1),
    ])
    assert [(r["item_key"], r["label"], r["detail"]) for r in out] == [
        ("keykey1", None, "y"), ("keykey1", True, "z")]


def _by_hand(rows):
    out = {}
    for key in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == key and r[1] is not None), key=lambda r: r[5])
        if mine:
            clash = len({r[1] for r in mine}) > 1
            base = next(r for r in mine if not clash or r[1] is False)
            texts = [f"[{r[1]}] {r[3]}" if clash else r[3] for r in mine if r[3] is not None]
            out[key] = (base[1], " | ".join(dict.fromkeys(texts)) or base[3], base[4], clash)
    return out


def test_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    data = []
    for i in range(600):
        key = "hothot1" if rng.random() < 0.4 else f"keykey{rng.randrange(60):02d}"
        data.append((key, rng.choice([True, False, None]), rng.choice("xy"),
                     rng.choice([None, "a", "b", "c"]), f"n{i}", i))
    got = {
        r["item_key"]: (r["label"], r["detail"], r["note"], r["had_conflict"])
        for r in _consolidated(spark, data) if r["label"] is not None
    }
    assert got == _by_hand(data)
