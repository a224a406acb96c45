"""Operators 2, 4, 6, 7 and 8 against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from accordance.llm import common, decontaminate, language, near_dup, personal, repeats
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "clash", 2.0) for i, t in rows], brute.COLUMNS)


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in common.table(spark, SMALL, "documents").select("doc_id", "text").collect()]


# -- language ------------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    found = language.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, total, rejected = found.agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.count_if("rejected")
    ).first()
    assert total > 200 and right > 0.98 and rejected == 0


def test_language_of_odd_texts(spark):
    train = [("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de")] * 4
    model = language.fit(spark.createDataFrame(train, "text string, lang string"))
    rows = [(1, None), (2, ""), (3, "123 ..."), (4, "und der hund"), (5, "the dog"), (6, "x" * 70_000), (6, "the dog"), (None, "die katze"), (7, "中文字符測試" * 20)]
    got = {(r["doc_id"], r["lang_pred"]): r for r in language.predict(frame(spark, rows), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "de"), (5, "en"), (6, "en"), (None, "de")} <= got.keys()
    assert got[1, "und"]["score"] == 0 and got[1, "und"]["rejected"] and got[1, "und"]["cross_entropy"] is None
    assert not got[5, "en"]["rejected"] and 0 < got[5, "en"]["score"] <= 1
    assert any(r["rejected"] for (i, _), r in got.items() if i == 7)


def test_no_training_rows(spark):
    model = language.fit(spark.createDataFrame([(None, "en"), ("text", None)], "text string, lang string"))
    assert model is None
    assert [r["lang_pred"] for r in language.predict(frame(spark, [(1, "text")]), model).collect()] == ["und"]
    assert language.predict(frame(spark, []), model).count() == 0


def test_probabilities_sum_to_one(spark):
    import numpy as np

    model = language.fit(spark.createDataFrame([("abracadabra", "x"), ("abc", "x")], "text string, lang string"))
    signs = [ord(c) for c in "abrcd"]
    for context in ("abr", "bra", "xyz"):
        head = sum(ord(c) << (16 * (3 - k)) for k, c in enumerate(context))
        grams = np.asarray([head + s for s in signs], np.uint64)
        # one share of the uniform ground stays for signs that were never seen
        assert 0.8 < np.exp(model.score(grams)).sum() < 1.0


def test_rare_grams_of_many_languages_stay(spark):
    rng = random.Random(8)
    own = {f"l{k:03}": "".join(chr(0x4E00 + rng.randrange(400)) for _ in range(60)) for k in range(600)}
    train = spark.createDataFrame([(t + "the same words " * 2, x) for x, t in own.items()], "text string, lang string")
    docs = frame(spark, [(k, t) for k, t in enumerate(own.values()) if k % 40 == 7])
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, language.fit(train)).collect()}
    assert got == {k: x for k, x in enumerate(own) if k % 40 == 7}


def test_stage_learns_from_all_labelled_documents(spark):
    ids = spark.range(200).where(language.held_out(F.col("id")))
    held = [r[0] for r in ids.limit(4).collect()]
    rest = [k for k in range(1000, 1030)]
    data = [(k, "the cat and the dog " * 5, "en") for k in rest] + [(k, "кошка и собака " * 8, "ru") for k in held]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in language.keep_known(docs).collect()} == {*held, *rest}


# -- near duplicates -----------------------------------------------------------


def test_near_duplicates_equal_brute_force(spark, rows, documents):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(4)]
    data = list(documents)
    for k in range(160):  # a crowded group of copies with one to five changed words
        w = base[k % 4].split()
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        data.append((10_000 + k, " ".join(w)))
    data += [(20_000, None), (20_001, ""), (20_002, "one two"), (20_003, "ONE  two"), (20_004, "one two three"), (20_005, "a " * 20_000)]
    got = rows(near_dup.find_near_duplicates(frame(spark, data)))
    expected = [(i, n, c, i == c) for i, n, c in brute.near_duplicates(data, 4, 80)]
    assert got == sorted(expected, key=repr)


def test_rest_of_crowded_regions(spark, rows, monkeypatch):
    """With hardly any neighbours compared, the last step still finds every link."""
    monkeypatch.setattr(near_dup, "SMALL", 2)
    monkeypatch.setattr(near_dup, "NEAR", 1)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(50)]
    base = [rng.choice(words) for _ in range(60)]
    data = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randrange(2, 5)):
            w[rng.randrange(60)] = rng.choice(words)
        data.append((k, " ".join(w)))
    got = rows(near_dup.find_near_duplicates(frame(spark, data)).select("doc_id", "n_shingles", "component_id"))
    assert got == sorted(brute.near_duplicates(data, 4, 80), key=repr)


def test_one_of_each_class_stays(spark):
    text = "a b c d e f g h i j"
    data = [(3, text), (1, text), (1, text), (2, "other words stand here now"), (None, None), (5, None)]
    kept = near_dup.keep_one(frame(spark, data))
    assert kept.columns == frame(spark, data).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [1, 2, 5, None]
    assert near_dup.keep_one(frame(spark, [])).count() == 0


def test_one_stays_with_null_or_repeated_ids(spark):
    w = " ".join(f"w{k}" for k in range(200))
    x = " ".join(f"x{k}" for k in range(200))
    y = " ".join(f"y{k}" for k in range(200))
    data = [(None, w), (None, w + " end"), (7, x), (7, x + " end"), (3, y), (9, y + " end"), (9, "another text of some words here")]
    got = sorted((tuple(r)[:2] for r in near_dup.keep_one(frame(spark, data)).collect()), key=repr)
    assert len(got) == 4
    assert (3, y) in got and (9, "another text of some words here") in got
    assert sum(t.startswith("w0") for _, t in got) == 1 and sum(t.startswith("x0") for _, t in got) == 1


# -- decontamination -----------------------------------------------------------


def test_contamination_equals_brute_force(spark, rows, documents, monkeypatch):
    items = [tuple(r) for r in common.table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    items += [(9001, "and the"), (9002, ""), (9003, None), (9004, "a b " * 10), (None, "null id " * 8), (9004, "b a")]
    rng = random.Random(5)
    docs = list(documents) + [(-1, None), (-2, ""), (-3, items[0][1]), (-4, "x " + items[1][1].upper()), (-5, "a b " * 30), (-5, "q " * 13)]
    for k in range(100):
        w = (rng.choice(items)[1] or "").split()
        at = rng.randrange(max(1, len(w) - 5))
        docs.append((-100 - k, " ".join(["zz", *w[at : at + rng.randrange(8, 20)], "yy"])))
    expected = sorted(brute.contamination(docs, items), key=repr)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    assert rows(decontaminate.digests(frame(spark, docs), bench)) == expected
    monkeypatch.setattr(decontaminate, "PART_BYTES", 4000)  # several parts
    assert rows(decontaminate.digests(frame(spark, docs), bench)) == expected


def test_contamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in decontaminate.digests(frame(spark, [(1, "a b")]), bench).collect()] == [(2, 0, 0)]
    assert decontaminate.digests(frame(spark, []), bench).count() == 0


# -- personal data -------------------------------------------------------------


def odd_personal() -> list[tuple]:
    rng = random.Random(6)
    out = []
    for signs in ("aB0_.%+-@ 19.-()\né中", "0123456789 -+().", "a.@b-1"):
        out += ["".join(rng.choice(signs) for _ in range(rng.randrange(50))) for _ in range(250)]
    out += ["a@b.c_d@e.f", "4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "0255.1.1.1 256.1.1.1", None, "", "a@b.c " * 1500, "1 " * 1200]
    return [(-1 - k, t) for k, t in enumerate(out)]


def test_base_spans_equal_brute_force(spark, documents):
    data = documents + odd_personal() + [(7, "mail x@y.org"), (7, "mail x@y.org"), (None, "call +1 (212) 555-0100 now")]
    docs = frame(spark, data)
    expected = {}
    for i, t in data:
        expected.setdefault(i, []).append(brute.base_spans(t))
    for r in personal.digests(docs).collect():
        own = [e for e in expected[r["doc_id"]] if e[:4] == tuple(r)[1:5] and brute.sha(e[4]) == r["base_sha256"]]
        assert own, r
        assert set(own[0][4].split(",")) <= set(r["spans"].split(","))


def test_more_spans_and_masking(spark):
    data = [(k, f"call tel {200 + k % 700}-555-{1000 + k} or +1 212 555 {1000 + k}, card 4111 1111 1111 1111") for k in range(60)]
    data += [(900, None), (901, ""), (902, "nothing here")]
    docs = frame(spark, data)
    classifier = personal.fit(docs)
    for r in personal.digests(docs, classifier).where("doc_id < 60").collect():
        assert r["n_phone"] == 1 and r["spans"].count("phone:") == 2
    out = {r["doc_id"]: r["text"] for r in personal.mask_documents(docs).collect()}
    assert out[0] == "call tel <PHONE> or <PHONE>, card <CARD>"
    assert out[900] is None and out[901] == "" and out[902] == "nothing here"
    assert personal.digests(frame(spark, [])).count() == 0


def test_long_texts_take_linear_time(spark):
    import time

    def seconds(n: int) -> float:
        data = [(1, "a" * n), (2, "1" * n), (3, "a.b" * (n // 3) + "@x.y"), (4, "1 " * (n // 2)), (5, "+1" + " " * n)]
        docs = spark.createDataFrame(data, "doc_id long, text string")
        start = time.perf_counter()
        personal.digests(docs, classifier).collect()
        return time.perf_counter() - start

    classifier = personal.Classifier([])
    seconds(1000)
    assert seconds(200_000) < 4 * max(1.5, seconds(100_000))


# -- repeated strings ----------------------------------------------------------


@pytest.mark.parametrize("crowded", [1 << 14, 2])
def test_repeats_equal_brute_force(spark, rows, documents, monkeypatch, crowded):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    rng = random.Random(8)
    z = "".join(rng.choice("abc def") for _ in range(3000))
    data = documents[:120] + [(-1, None), (-2, ""), (-3, "a" * 199), (-4, "b" * 200), (-5, "c" * 201), (-6, "xy" * 300)]
    data += [(-7, z[:500] + "Q" + z[500:700] + "é" + z[300:600]), (-8, z[100:299] + "--" + z[1000:1200]), (-9, z[999:1400])]
    data += [(None, z[2000:2300]), (None, z[1900:2250]), (-10, z[:250]), (-10, z[:250])]
    for k in range(80):
        at = rng.randrange(2700)
        data.append((-100 - k, "p" * rng.randrange(90) + z[at : at + rng.randrange(100, 320)] + "q" * rng.randrange(90)))
    assert rows(repeats.digests(frame(spark, data))) == sorted(brute.repeats(data), key=repr)


def test_repeats_of_rows_whose_checksums_clash(spark, rows):
    """Texts without an id, or with one id, that a 32-bit checksum takes for one."""
    import random
    import zlib

    pick, seen, pairs = random.Random(5), {}, []
    while len(pairs) < 2:
        text = "".join(pick.choices("abcdefgh ", k=12))
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        if other != text:
            pairs.append((other, text))
    shared = "".join(pick.choices("klmnop ", k=260))
    # equal checksums stay equal in front of one text; only the first of a pair begins with what another row repeats
    data = []
    for i, (one, two) in zip((None, 4), pairs):
        assert zlib.crc32((one + shared).encode()) == zlib.crc32((two + shared).encode())
        data += [(i, one + shared), (i, two + shared), (9, one + shared[:190])]
    expected = brute.repeats(data)
    assert expected[0][2] == 272 > expected[1][2]
    assert rows(repeats.digests(frame(spark, data))) == sorted(expected, key=repr)


def test_text_keys_tell_ids_and_texts_apart():
    given = [(None, b"1"), (1, b""), (1, b"1"), (11, b""), (None, b""), (None, b"-"), (-1, b""), (0, b""), (1, b"1")]
    keys = list(zip(*(x.tolist() for x in repeats.text_keys([i for i, _ in given], [r for _, r in given]))))
    assert len(set(keys)) == len(given) - 1 and keys[2] == keys[-1]


def test_repeats_of_an_empty_table(spark):
    assert repeats.digests(frame(spark, [])).count() == 0
