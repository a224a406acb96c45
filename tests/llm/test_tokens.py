"""Operators 5, 9 and 10 against the libraries."""

from __future__ import annotations

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from accordance.llm import bpe, common, packed, token_counts
from accordance.llm.pretokens import Block
from tests.llm import brute


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def ranked():
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_split_equals_the_pattern():
    rng = random.Random(1)
    signs = " \n\t'''sstrevmld  aébcÜ12²٣!?-_ 　 Ⅷ中😀"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)]
    block, at = Block(texts), 0
    pattern = regex.compile(public_tokenizers.PATTERN)
    for text, n in zip(texts, block.counts):
        assert [block.words[c] for c in block.codes[at : at + n]] == pattern.findall(text)
        at += n


def test_counts_equal_the_library(spark, rows, library):
    data = brute.odd_texts()
    got = rows(token_counts.budgeted(spark.createDataFrame(data, brute.COLUMNS)))
    expected = []
    for i, t, *_ in data:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        expected.append((i, len((t or "").encode()), n, n > 1024))
    assert got == sorted(expected, key=repr)


def test_counts_of_a_table(spark, rows, library):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents").select("doc_id", "text").collect()
    expected = {r[0]: len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in docs}
    assert {r[0]: r[2] for r in rows(token_counts.op5_token_counts(spark, sf))} == expected


@pytest.mark.parametrize("bits", [1, 3, 16, 17, 32])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = packed.pack(ids, bits)
        assert len(data) == 8 * -(-n * bits // 64)
        assert (packed.unpack(data, bits, 0, n) == ids).all()
        assert (packed.unpack(data, bits, n // 2, n - n // 2) == ids[n // 2 :]).all()


def test_packed_files_equal_the_library(spark, library):
    data = brute.odd_texts()
    frame = spark.createDataFrame(data, brute.COLUMNS)
    got = [tuple(r) for r in packed.written_and_read(frame).orderBy(*"start doc_id".split()).collect()]
    encoded = sorted(
        ((i is not None, i or 0, brute.little_endian(library.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, *_ in data)
    )
    start, expected = 0, []
    for known, i, ids in encoded:
        expected.append((i if known else None, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert got == expected


def test_packed_files_are_read_by_range(spark, rows):
    path = common.shared_folder(spark)
    data = [(k, f"text {k} " * 5) for k in range(300)]
    packed.write_tokens(
        spark.createDataFrame(data, "doc_id long, text string"), path, public_tokenizers.path("byte_bpe_50k.json"), 50_257
    )
    whole = rows(packed.read_documents(spark, path))
    assert rows(packed.read_documents(spark, path, first=40, last=59)) == [r for r in whole if 40 <= r[0] <= 59]


def test_encoding_equals_the_library_and_decodes(spark, rows, ranked):
    data = brute.odd_texts()
    frame = spark.createDataFrame(data, brute.COLUMNS)
    expected = []
    for i, t, *_ in data:
        ids = ranked.encode_ordinary(t or "")
        expected.append((i, len(ids), brute.sha(brute.little_endian(ids)), brute.sha(t or "")))
    assert rows(bpe.digests(frame)) == sorted(expected, key=repr)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.decode(bpe.encode(frame, ranks, public_tokenizers.PATTERN), ranks)
    assert sorted((r[1].decode() for r in decoded.collect())) == sorted(t or "" for _, t, *_ in data)


def test_equal_blocks_of_several_tasks(spark, rows):
    data = [(1, "same text here"), (2, "other"), (None, None)]
    one = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    blank = spark.createDataFrame([(None, None)] * 8 + [(5, "")] * 4 + [(6, "twice")] * 6, "doc_id long, text string")
    frame = one.union(one).union(blank.repartition(6))
    expected = sorted((r[0] for r in frame.collect()), key=repr)
    assert len(expected) == 24
    for found in (rows(bpe.digests(frame)), rows(token_counts.budgeted(frame))):
        assert [r[0] for r in found] == expected
        assert len(set(found)) == 5  # ids 1, 2, 5, 6 and null: equal rows give equal results


def test_empty_tables(spark):
    empty = spark.createDataFrame([], brute.COLUMNS)
    assert bpe.digests(empty).count() == 0
    assert token_counts.budgeted(empty).count() == 0
    assert packed.written_and_read(empty).count() == 0


def test_classes_of_characters_take_little_memory():
    """Every worker makes this table, so making it must not hold all characters as objects."""
    import tracemalloc
    import unicodedata

    import regex

    from accordance.llm import pretokens

    pretokens._classes.cache_clear()
    tracemalloc.start()
    table = pretokens._classes()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    for c in (*range(0x20, 0x3000), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0x1D7CE, 0x20000, 0x10FFFF):
        known = not 0xD800 <= c < 0xE000
        assert (table[c] == pretokens.LETTER) == (known and bool(regex.match(r"\p{L}", chr(c)))), unicodedata.name(chr(c), c)
        assert (table[c] == pretokens.DIGIT) == (known and bool(regex.match(r"\p{N}", chr(c))))
