"""Large JSON arrays in pieces, against a whole parse of each file."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from accordance.sources.json_pieces import json_elements


def value(rng: random.Random, depth: int = 0):
    kind = rng.randrange(9 if depth < 3 else 5)
    if kind < 3:
        return "".join(rng.choices(['"', "\\", "{", "}", "[", "]", ",", "\n", "é", "中", "word ", "\\\\"], k=rng.randrange(12)))
    if kind < 5:
        return rng.choice([None, True, 17, -2.5])
    if kind < 7:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{k}{rng.choice(['', '}', '{', chr(34)])}": value(rng, depth + 1) for k in range(rng.randrange(4))}


@pytest.fixture(scope="module")
def small_blocks(spark):
    side = spark.newSession()
    side.conf.set("spark.sql.files.maxPartitionBytes", "700")
    side.conf.set("spark.sql.files.openCostInBytes", "100")
    return side


def read(session, folder):
    rows = json_elements(session, str(folder)).select("file_name", F.to_json("record").alias("r")).collect()
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["file_name"], []).append(json.dumps(json.loads(r["r"]), sort_keys=True))
    return {k: sorted(v) for k, v in out.items()}


def expected(folder):
    out = {}
    for path in folder.iterdir():
        try:
            whole = json.loads(path.read_text(encoding="utf-8-sig"))
        except ValueError:
            continue
        found = [x for x in (whole if isinstance(whole, list) else [whole]) if isinstance(x, dict)]
        if found:
            out[path.name] = sorted(json.dumps(x, sort_keys=True) for x in found)
    return out


def test_pieces_equal_a_whole_parse(small_blocks, tmp_path):
    rng = random.Random(3)
    for k in range(12):
        many = [{"id": j, "v": value(rng)} if rng.random() < 0.8 else value(rng) for j in range(rng.randrange(1, 60))]
        text = json.dumps(many, ensure_ascii=k % 2 == 0, indent=[None, 2, None][k % 3])
        (tmp_path / f"a{k}.json").write_text(text + "\n" * (k % 4), encoding="utf-8-sig" if k == 5 else "utf-8")
    (tmp_path / "copies.json").write_text(json.dumps([{"same": "}"}] * 200))
    (tmp_path / "one.json").write_text(json.dumps({"a": {"b": ["}", "]"]}, "t": "x{" * 900}))
    (tmp_path / "line.json").write_text('{"a": 1}\n')
    (tmp_path / "nested.json").write_text('[[{"in": 1}], {"out": [{"x": 2}]}, 3, [{"in": 4}]]')
    want = expected(tmp_path)
    assert len(want) >= 14 and sum(map(len, want.values())) > 400
    assert read(small_blocks, tmp_path) == want


@pytest.mark.parametrize("text", [
    "", "[]", "  [ ] ", "17", '"{}"', '{"a": 1', '[{"a": 1}', '[{"a": 1}, {"b": ]', '[{"a": 1}, oops]', '[{"a": 1},]', '{"a": 1}{"b": 2}',
    '[{"a": 1}] {"b": 2}', '[{"a": "x}]', '[{"a": 1}}', '[{"a": 1} {"b": 2}]', "[1, [2]]",
])
def test_files_that_give_nothing(small_blocks, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    (tmp_path / "good.json").write_text('[{"a": 1}]')
    assert read(small_blocks, tmp_path) == {"good.json": ['{"a": 1}']}
