from __future__ import annotations

import random

import pytest

from accordance.operators import sections as N

HEAD = "diff --git"


def by_hand(text, max_chars, limit):
    """Line by line, as the rule reads."""
    if len(text) <= max_chars:
        return text, 0
    kept, cut, count, noted, total = [], 0, 0, False, -1
    for line in text.split("\n"):
        if line.startswith(HEAD):
            count, noted = 0, False
        if count < limit:
            count += 1
            new = line
        elif line.startswith("@@"):
            new = line
        elif not noted:
            noted, cut, new = True, cut + 1, N.LINES_OMITTED
        else:
            new = None
        if new is not None:
            kept.append(new)
            total += len(new) + 1
        if total > max_chars:
            kept.append(N.GLOBALLY_CUT)
            break
    return "\n".join(kept), cut


@pytest.mark.parametrize("seed", range(4))
def test_reduction_against_the_rule(spark, seed):
    rng = random.Random(seed)
    texts = ["", "short", HEAD + " a\n@@ x"]
    for _ in range(40):
        n = rng.randrange(1, 120)
        texts.append("\n".join(
            rng.choice([HEAD + " f", "@@ -1 +1 @@", "+ added line é", "", "- x" * rng.randrange(9)])
            for _ in range(n)))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    out = N.reduce_sections(df, max_chars=200, lines_per_section=5).collect()
    for r in out:
        body, cut = by_hand(texts[r["i"]], 200, 5)
        assert r["reduced_text"] == body
        assert r["truncated_sections"] == cut
        assert r["original_chars"] == len(texts[r["i"]]) and r["new_chars"] == len(body)
        assert r["reduced"] == (len(texts[r["i"]]) > 200)


def test_defaults_only_touch_long_texts(spark):
    text = HEAD + " a\n" + "\n".join(f"line {i} with some more words" for i in range(3000))
    df = spark.createDataFrame([(text,), (text[:60_000],), (None,)], "text string")
    a, b, c = N.reduce_sections(df).collect()
    assert a["reduced"] and a["truncated_sections"] == 1 and a["reduced_text"].count("\n") == 400
    assert not b["reduced"] and b["reduced_text"] == text[:60_000]
    assert c["reduced_text"] is None and not c["reduced"]


def test_numbered_lines(spark):
    df = spark.createDataFrame([(1, "pre\nA1\nx\nB1"), (2, "A\n\nb"), (3, "")], "id int, text string")
    got = [tuple(r) for r in N.numbered_lines(df, header="[A-E]").orderBy("id", "section_no", "line_no").collect()]
    assert got == [(1, 0, 1, "pre"), (1, 1, 1, "A1"), (1, 1, 2, "x"), (1, 2, 1, "B1"),
                   (2, 1, 1, "A"), (2, 1, 2, ""), (2, 1, 3, "b"), (3, 0, 1, "")]


def test_no_shuffle(spark):
    df = spark.range(3).selectExpr("id", "repeat('x\n', 100) AS text")
    for out in (N.numbered_lines(df), N.reduce_sections(df), N.truncate_text(df)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_truncate(spark):
    df = spark.createDataFrame([("abcdef",), ("abc",), (None,)], "text string")
    got = [tuple(r)[1:] for r in N.truncate_text(df, limit=4, note="~").collect()]
    assert got == [("abcd~", True, 6, 4), ("abc", False, 3, 3), (None, False, 0, 0)]


def test_a_note_of_the_text_itself_is_not_counted(spark):
    text = "A one\nnote\nplain\nplain\nB two\nnote\nmore, kept\nrest\n" + "x" * 40
    df = spark.createDataFrame([(1, text)], "id int, text string")
    out = N.reduce_sections(df, max_chars=30, lines_per_section=2, header="[A-E]", kept=",", note="note", cut_note="cut").first()
    assert out["reduced_text"].startswith("A one\nnote\nnote\nB two\nnote\n")
    assert out["truncated_sections"] == 1  # the second section's note lies behind the cut
