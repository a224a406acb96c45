"""What tasks hold at once, and what they leave behind in a worker."""

from __future__ import annotations

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from accordance.llm import common, decontaminate, language, pretokens

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def peak_of(run):
    tracemalloc.start()
    out = run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def texts_of(n, words):
    rng = random.Random(5)
    out = [" ".join(rng.choices("alpha beta gamma delta epsilon zeta".split(), k=words)) for _ in range(n)]
    out[3] = f"{out[3]} {ITEM}"
    out[5], out[6] = None, ""
    return out


def test_contamination_takes_a_batch_in_pieces():
    """A batch of 10 MB; before, 2 MB of its text were looked at together beside all texts as strings."""
    texts = texts_of(400, 5000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    shared = SimpleNamespace(value=decontaminate.Items(["x"], [ITEM]))
    task = decontaminate._pass(shared, 1, 2, ["doc_id"], True)

    def run():
        return [r for b in task(iter([batch])) for r in b.select(["doc_id", "n_words", "n_hit", "items"]).to_pylist()]

    run()
    found, peak = peak_of(run)
    assert [r["doc_id"] for r in found] == list(range(len(texts)))
    assert [r["n_words"] for r in found] == [len((t or "").split()) for t in texts]
    assert {r["doc_id"]: (r["n_hit"], r["items"]) for r in found if r["n_hit"]} == {3: (14, ["x"])}
    assert peak < 24 << 20


def test_pieces_hold_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(decontaminate, "CHARS", 10)
    texts = ["a" * 25, None, "", "bb", "cccc", "dddddd", "e" * 11, "f", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = [p.column(0).to_pylist() for p in decontaminate.pieces(iter([batch, batch.slice(0, 0), batch.slice(3, 2)]), 0)]
    assert parts == [[texts[0]], [None, "", "bb", "cccc"], ["dddddd"], [texts[6]], ["f", None], ["bb", "cccc"]]


@pytest.mark.parametrize("part_bytes", [1 << 24, 40])
def test_a_kept_text_is_sent_once(spark, rows, monkeypatch, part_bytes):
    monkeypatch.setattr(decontaminate, "PART_BYTES", part_bytes)
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts_of(12, 30))], "doc_id long, text string, source string")
    bench = spark.createDataFrame([("x", ITEM), ("y", "twelve thirteen"), ("z", "beta")], "item_id string, text string")
    with_text = decontaminate.find_contamination(docs, bench, ("source", "text", "doc_id"))
    assert "_read" not in with_text._jdf.queryExecution().analyzed().toString()
    without = decontaminate.find_contamination(docs, bench)
    assert "_read" not in without.columns and with_text.columns[:3] == ["source", "text", "doc_id"]
    found = rows(without)
    assert rows(with_text.drop("source", "text")) == found
    assert {r[0] for r in found if "x" in r[3]} == {3} and {r[0] for r in found if "y" in r[3]} == {3}
    left = {r[0] for r in found if not r[-1]}
    assert {5, 6} <= left < set(range(12))
    assert {tuple(r) for r in decontaminate.keep_clean(docs, bench).collect()} == {tuple(r) for r in docs.collect() if r[0] in left}


def test_powers_take_little_memory():
    """Before, each worker kept 32 MB of powers, and made several arrays of the size of the sums at once."""
    values = np.random.default_rng(3).integers(0, 256, 1 << 20).astype(np.uint8)
    sums, peak = peak_of(lambda: pretokens.prefix_sums(values))
    assert peak < 12 << 20
    base, key, modulus = int(pretokens._BASE), int(pretokens._KEY), 1 << 64
    for k in (0, 1, 4095, 4096, 4097, 8191, 8192, 999_999, (1 << 20) - 1):
        assert (int(sums[k + 1]) - int(sums[k])) % modulus == (int(values[k]) + 1) * key * pow(base, k, modulus) % modulus
    starts = np.asarray([0, 4090, 4096, 1 << 19])
    again = np.concatenate([values[s : s + 50] for s in starts])
    hashes = pretokens.span_hashes(sums, starts, starts + 50)
    assert (pretokens.span_hashes(pretokens.prefix_sums(again), np.arange(4) * 50, np.arange(1, 5) * 50) == hashes).all()
    assert len(set(hashes.tolist())) == 4


def test_training_texts_never_stand_beside_their_batch():
    texts = [t or "x" for t in texts_of(400, 5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])

    sizes = [sum(len(t) for _, t in chunk) for chunk in language._chunks(iter([batch]), 2)]
    assert sum(sizes) == sum(map(len, texts)) and max(sizes) < 2 * language._AT_ONCE
    _, peak = peak_of(lambda: [len(chunk) for chunk in language._chunks(iter([batch]), 2)])
    assert peak < 8 << 20


def test_tasks_give_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    assert list(common.thrifty(lambda batches: (2 * b for b in batches))(iter([1, 2]))) == [2, 4] and len(given) == 1
    assert common.thrifty_groups(lambda key, a, b: (key, a + b))((1,), 2, 3) == ((1,), 5) and len(given) == 2


def test_freed_memory_leaves_the_process():
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    common.give_back()
    before = held()
    blocks = [bytes(100_000) for _ in range(2000)]  # too small for mappings of their own once the limit has grown
    last = bytes(100_000)
    del blocks
    common.give_back()
    assert held() - before < 60 << 20 and len(last) == 100_000
