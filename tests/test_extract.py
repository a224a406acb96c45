from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from accordance.functions import answers as A
from accordance.functions import brackets as B
from accordance.operators import extract as E

LONG = "the method was moved and every caller kept its result"


def label(spark, texts, order=E.VERDICT_FIRST, **cols):
    df = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "item_key string, response string")
    for n, v in cols.items():
        df = df.withColumn(n, F.lit(v))
    return {int(r["item_key"][1:]): r for r in E.cascade(df, order).collect()}


@pytest.mark.parametrize(
    "text, out",
    [
        ("final: pure", "PURE"), ("x FINAL:\n  Floss y", "FLOSS"), ("conclusão: pure", "PURE"),
        ("Resultado: floss\nFINAL: pure", "PURE"), ("the FINAL pure answer", "PURE"),
        ("it is\nfloss  \nmore", "FLOSS"), ("so it is pure", "PURE"), ("impure", None), ("épure", None),
        ("pure or not pure?", None), ("", None), (None, None),
        ("CLASSIFICATION: PURE\nbut CONCLUSÃO: FLOSS", "FLOSS"),
    ],
)
def test_verdict(spark, text, out):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(A.verdict("t")).first()[0] == out


@pytest.mark.parametrize(
    "text, out",
    [
        ("a<think>x\ny</think>b", "ab"), ("a<THINK id='1'/>b", "ab"), ("[think] so\nkeep", "\nkeep"),
        ("You are an expert in x\nkeep", "\nkeep"),
        ("CRITICAL: You must respond now, no text before or after. rest", "rest"),
        ("  trim me \n next", "trim me\nnext"),
        ("a a a a a a a\nkeep", "keep"), ("one two one two one two one\nkeep", "keep"),
        ("one two three four five six", "one two three four five six"),
    ],
)
def test_clean(spark, text, out):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(A.clean_answer("t")).first()[0] == out


OBJ = '{"refactoring_type": "pure", "justification": "' + LONG + '"}'


@pytest.mark.parametrize(
    "text, tier",
    [
        (OBJ, "whole"),
        ("Here:\n```json\n" + OBJ + "\n```", "candidate"),
        ("<think>hm {</think>```\n" + OBJ + "\n```", "candidate"),
        ("so " + OBJ + " done", "candidate"),
        (OBJ + OBJ, "candidate"),
        (OBJ[:-1] + ",}", "repaired"),
        ("{\n// note\n" + OBJ[1:], "repaired"),
        ('x {"refactoring_type": "pure", "justification": "has } and { inside ' + LONG + '"} y', "scanned"),
        ('pre {"a": {"b": 1}, "refactoring_type": "pure", "justification": "' + LONG + '"} post', "scanned"),
        ("text " + OBJ[:-1], "scanned"),
        ('say "hi {"refactoring_type": "pure", "justification": "a } b ' + LONG + '"}', "scanned"),
        ("[1, 2] nothing", None), ("nothing", None), ("{ not json }", None), ("", None),
    ],
)
def test_structured_tiers(spark, text, tier):
    df = spark.createDataFrame([("k", text)], "item_key string, response string")
    r = E.structured_answer(df).first()
    assert r["answer_tier"] == tier
    if tier and not text.startswith("pre"):
        doc = json.loads(r["answer_json"]) if tier != "repaired" else None
        assert doc is None or doc["refactoring_type"] == "pure"


def test_inner_object_wins_when_it_reads_first(spark):
    """The shortest piece that reads is taken, as with any lazy pattern."""
    df = spark.createDataFrame([("k", 'pre {"b": 1} {"refactoring_type": "pure"}')], "item_key string, response string")
    assert E.structured_answer(df).first()["answer_json"] == '{"b": 1}'


def test_bracket_scan():
    assert json.loads(B.find_value('x {"a": "}"} y')) == {"a": "}"}
    assert B.find_value('x [1, {"a": 2}] y', objects_only=False) == '[1, {"a": 2}]'
    assert json.loads(B.find_value('{"a": [1,2,],}')) == {"a": [1, 2]}
    assert json.loads(B.find_value('{"a": "say "hi" now"}')) == {"a": 'say "hi" now'}
    assert json.loads(B.find_value(r'{"a": "q\" }", "b": 2}')) == {"a": 'q" }', "b": 2}
    assert B.find_value("no brace") is None and B.find_value("{{{{") is None
    deep = "{" * 200_000
    assert B.find_value(deep) is None  # linear, no recursion


def test_key_lines(spark):
    df = spark.createDataFrame(
        [('"refactoring_type": "pure"\nnote = x\nnote = y\nab: no',), ("nothing here",), ("a: b",)], "t string"
    )
    got = [r[0] for r in df.select(A.key_line_map(F.col("t"))).collect()]
    assert got == [{"refactoring_type": "pure", "note": "y"}, None, None]


def test_scores(spark):
    df = spark.createDataFrame(
        [("No functional impact",), ("only structural, identical behavior",), ("logic change",),
         ("it maintains all",), ("nothing",)], "t string")
    got = [tuple(r) for r in df.select(A.pure_score("t"), A.floss_score("t"), A.indicator_label("t")).collect()]
    # "no functional impact" also counts as "functional impact"
    assert got == [(1, 1, "floss"), (2, 0, "pure"), (0, 1, "floss"), (0, 0, "pure"), (0, 0, "floss")]
    conf = spark.createDataFrame([("Highly certain",), ("moderate",), ("x",)], "t string")
    assert [r[0] for r in conf.select(A.confidence("t")).collect()] == ["high", "medium", "low"]


def test_fallback(spark):
    df = spark.createDataFrame(
        [("Purely structural. More",), ("pure but a bug fix",), ("A sentence that is long enough. x",)], "t string")
    got = [tuple(r) for r in df.select(A.fallback_label("t"), A.fallback_justification("t")).collect()]
    assert got == [
        ("pure", "Contains structural changes"),
        ("floss", "Contains bug fixes"),
        ("floss", "Unable to extract detailed analysis from LLM response. LLM output: A sentence that is long enough"),
    ]


def test_verdict_first_cascade(spark):
    out = label(spark, [
        "reason\nFINAL: PURE\n" + OBJ.replace("pure", "floss"), OBJ, "```json\n" + OBJ[:-1] + ",}\n```",
        "Only structural, identical behavior", "status: unclear", "  \n ", None,
        '{"refactoring_type": "PURE", "justification": "abc"}',
    ])
    got = {k: (r["label"], r["status"], r["extraction_method"]) for k, r in out.items()}
    assert got == {
        0: ("pure", "ok", "verdict"), 1: ("pure", "ok", "structured"), 2: ("pure", "ok", "structured"),
        3: ("pure", "ok", "scoring"), 4: ("floss", "ok", "key_lines"), 5: (None, "failed", None),
        6: (None, "failed", None), 7: ("floss", "ok", "structured"),
    }
    assert out[0]["justification"].startswith("reason\nFINAL")
    assert out[1]["justification"] == LONG
    assert out[7]["justification"] == E.NO_JUSTIFICATION
    assert "refactoring_type" in out[7]["fields_filled"].split(",")


def test_structure_first_cascade(spark):
    out = label(spark, [
        OBJ, 'refactoring_type: pure, justification: moved only\nFINAL: floss', "it was pure work, clearly",
        "FINAL: pure or FINAL: floss", "unclear text", "",
    ], E.STRUCTURE_FIRST)
    got = {k: (r["label"], r["extraction_method"]) for k, r in out.items()}
    assert got[0] == ("pure", "structured")
    assert got[2] == ("pure", "bare_label")
    assert got[3] == ("pure", "bare_label")
    assert got[4] == ("floss", "fallback")
    assert got[5] == (None, None)
    assert out[4]["justification"].startswith("Unable to extract")


def test_at_least_four_of_five_awkward_answers(spark):
    texts = [
        "```json\n" + OBJ + "\n```", "It only changes structure.\n\n" + OBJ,
        "This represents pure refactoring with no behavioral changes.", OBJ[:60], "Some modifications...",
    ]
    for order in (E.VERDICT_FIRST, E.STRUCTURE_FIRST):
        out = label(spark, texts, order)
        assert sum(r["label"] is not None for r in out.values()) == 5
        assert [out[i]["label"] for i in (0, 1)] == ["pure", "pure"]


def test_completion_sources_in_order(spark):
    df = spark.createDataFrame(
        [("k1", '{"refactoring_type": "pure", "justification": "' + LONG + '", "project": "P"}', "arg", None, "item", None),
         ("k2", '{"justification": "abc"}', "arg", None, "item", "e1; e2"),
         ("k3", '{"commit1": "c1", "confidence_level": "high"}', None, "b0", None, None)],
        "item_key string, response string, repository string, before_key string, item_repository string, evidence string",
    )
    out = {r["item_key"]: r for r in E.complete_fields(E.answer_fields(E.structured_answer(df))).collect()}
    assert (out["k1"]["repository"], out["k2"]["repository"], out["k3"]["repository"]) == ("P", "item", "unknown")
    assert (out["k3"]["commit_hash_before"], out["k1"]["commit_hash_before"]) == ("c1", "unknown")
    assert out["k2"]["technical_evidence"] == "e1; e2" and out["k1"]["technical_evidence"] == "Not provided"
    assert (out["k2"]["label"], out["k2"]["justification"]) == ("floss", E.NO_JUSTIFICATION)
    assert out["k2"]["fields_filled"] == (
        "repository,commit_hash_current,technical_evidence,refactoring_type,justification,confidence_level,diff_source")
    assert out["k3"]["confidence"] == "high"


def test_method_shares_and_quarantine(spark):
    df = spark.createDataFrame([("a", "FINAL: pure"), ("b", ""), ("c", "x"), ("d", "FINAL: floss")],
                               "item_key string, response string")
    out = E.cascade(df)
    got = {r["extraction_method"]: (r["n"], r["pct"]) for r in E.success_by_method(out).collect()}
    assert got == {"verdict": (2, 50.0), "none": (1, 25.0), "scoring": (1, 25.0)}
    ok, bad = E.split_by_status(out)
    assert (ok.count(), bad.count()) == (3, 1)
    f = E.failures(out).first()
    assert (f["item_key"], f["repository"], f["error"]) == ("b", "unknown", "empty response")


def test_object_inside_a_think_block(spark):
    text = '<think>{"refactoring_type": "pure", "justification": "only names", "confidence_level": "high"}</think> project: x\nrepository: y'
    df = spark.createDataFrame([("a", text), ("b", text + "\nFINAL: FLOSS")], "item_key string, response string")
    got = {r["item_key"]: r for r in E.cascade(df, E.STRUCTURE_FIRST).collect()}
    assert [got["a"][c] for c in ("label", "justification", "confidence", "extraction_method")] == ["pure", "only names", "high", "structured"]
    assert got["b"]["label"] == "floss"


def test_a_text_is_scanned_once_for_each_reading(monkeypatch):
    """Pieces of a text without commas and comments to drop are found once, and used by every attempt."""
    seen = []
    spans = B._spans
    monkeypatch.setattr(B, "_spans", lambda text, opener, quoted: seen.append(text) or spans(text, opener, quoted))
    text = 'so {"a": "the "x" of "y", seen", "b": "low"} then'
    assert json.loads(B.find_value(text)) == {"a": 'the "x" of "y", seen', "b": "low"}
    assert seen.count(text) == 2


def test_quotes_and_backslashes_of_spans():
    assert B.spans(r'{"a": "q\" }", "b": 2} \"{', "{") == [(0, 22)]
    assert B.spans('\\{"}" \\', "{") == [] and B.spans('\\{"}"}', "{") == [(1, 6)]
    assert B.escape_inner_quotes('{"a": "x "y" z"}') == r'{"a": "x \"y\" z"}'
