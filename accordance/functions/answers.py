"""Expressions that read a label out of a free-text answer.

Everything here is a column expression, so a table of responses is scored in one
JVM-side projection. Patterns use ``(?d)`` so that only a line feed ends a line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from accordance.functions.common import WHITESPACE_RUN, col, found, let, strip

# ---------------------------------------------------------------------------
# Parts of an answer that carry reasoning or echo the request, as
# (opening, closing) pairs or as whole patterns. What a group holds is put back: text that
# a pattern has searched in vain, so that it is not searched again from the next opening.
THINK_BLOCKS = (
    (r"<think\b[^>]*>", r"</think>"),
    r"(?is)<think\b[^>]*+(?<=/)>|(<think\b[^>]*+>?)",
    (r"<<think>>", r"<</think>>"),
    r"(?imd)^\s*+\[?\(?think\)?\]?[:\-\s].*$|(^\s++)",
)
ECHOED_TEXT = (
    (r"CRITICAL:\s*You\s+must\s+respond", r"before\s+or\s+after\."),
    (r"Analyze\s+this\s+Git\s+diff\s+and\s+classify", r"refactoring\."),
    r"(?imd)^You\s+are\s+an?\s+expert.*$",
    r"(?imd)^Based\s+on\s+the\s+provided.*$",
)
ECHO_WORDS = ("critical:", "analyze", "expert", "based")

# Verdict patterns, highest priority first.
VERDICT_PATTERNS = (
    r"(?iu)FINAL:\s*(PURE|FLOSS)",
    r"(?iu)CONCLUSÃO:\s*(PURE|FLOSS)",
    r"(?iu)CLASSIFICATION:\s*(PURE|FLOSS)",
    r"(?iu)RESULTADO:\s*(PURE|FLOSS)",
    r"(?iU)\bFINAL[:\s]+(PURE|FLOSS)\b",
    r"(?imdU)\b(PURE|FLOSS)\s*$",
)
VERDICT_PATTERNS_SHORT = VERDICT_PATTERNS[:2]

# Phrases counted for and against a purely structural change.
PURE_PHRASES = (
    "pure refactoring", "puro", "estrutural apenas",
    "sem mudanças funcionais", "without functional changes",
    "only structural", "apenas estrutural", "structure only",
    "no functional impact", "sem impacto funcional",
    "identical behavior", "comportamento idêntico",
)
FLOSS_PHRASES = (
    "floss", "functional changes", "mudanças funcionais",
    "behavioral change", "mudança comportamental",
    "logic change", "mudança de lógica",
    "algorithm change", "mudança de algoritmo",
    "new functionality", "nova funcionalidade",
    "functional impact", "impacto funcional",
)
NEGATION_PHRASES = (
    "não altera", "not change", "no change", "without changing",
    "sem alterar", "maintains", "preserva", "mantém",
)
HIGH_WORDS = ("high", "alta", "certain", "confident")
MEDIUM_WORDS = ("medium", "média", "moderate")

# Words of the keyword fallback and its themes.
FALLBACK_PURE = ("pure", "purely", "only structural", "no functional", "no behavior")
FALLBACK_CHANGE = ("bug", "fix", "feature", "new", "behavior", "functional")
FALLBACK_THEMES = (
    (("behavioral", "behavior"), "Contains behavioral changes"),
    (("structural",), "Contains structural changes"),
    (("bug", "fix"), "Contains bug fixes"),
    (("feature", "new"), "Contains new features"),
)
FALLBACK_NO_THEME = "Unable to extract detailed analysis from LLM response"

# Per field, the quoted pattern and then the loose ones.
FIELD_PATTERNS = {
    name: (rf'(?i)"{name}":\s*"([^"]*)"', rf"(?i){name}[:\s]*([^\n,}}]+)")
    for name in (
        "project", "repository", "commit_hash_before", "commit_hash_current",
        "refactoring_type", "justification",
    )
}
FIELD_PATTERNS["refactoring_type"] += (r"(?i)(pure|floss)",)
NO_VALUE = ("", "Unknown", "None")

# Free-text justification of a bare label.
JUSTIFICATION_PATTERNS = (
    r"(?isu)(?:justification|reasoning|explanation)[\s:]*(.+?)(?=\n\n|\n[A-Z]|\.|\z)",
    r"(?isuU)(?:this|the commit|changes)[\s\w]*(?:are|is|represents?)[\s\w]*(.+?)(?=\.|\z)",
)
# Words that a justification opens with, and all that the second pattern could look through.
JUSTIFICATION_RUN = r"(?:this|the commit|changes)[\s\w]*+"

JUSTIFICATION_WORDS = (
    ("justification", "reasoning", "explanation"),
    ("this", "the commit", "changes"),
)

# Where an object may stand in an answer, in the order tried.
OBJECT_PATTERNS = (
    r"```json\s*(\{[\s\S]*?\})\s*```",
    r"```\s*(\{[\s\S]*?\})\s*```",
    r"(\{[\s\S]*?\})",
)
OBJECT_OPENINGS = (r"```json\s*\{", r"```\s*\{", r"\{")
KEY_LINE = (
    r"([\"']?)([a-zA-Z0-9_\- ]{3,40}+)\1\s*[:=]\s*([\"']?)([^\n\r]+?)\3(?:\n|\z)"
)


def _any(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def _replaced(text: Column, patterns: Sequence[str | tuple[str, str]]) -> Column:
    """Text without the parts that match.

    An opening that is never closed is matched together with all that follows and
    put back, so a text full of open ends is not searched again from each of them.
    """
    for p in patterns:
        if isinstance(p, tuple):
            opening, closing = p
            open_end = opening.removesuffix(">") if opening.endswith("*>") else opening
            whole = rf"(?is){opening}.*?{closing}|({opening}.*)\z|({open_end})\z"
            text = F.regexp_replace(text, whole, "$1$2")
        else:
            text = F.regexp_replace(text, p, "$1" if "|(" in p else "")
    return text


def _count(text: Column, phrases: Sequence[str]) -> Column:
    n = F.lit(0)
    for p in phrases:
        n = n + text.contains(p).cast("int")
    return n


# ---------------------------------------------------------------------------
# Cleaning


def remove_blocks(text: Column | str) -> Column:
    """Answer text without reasoning blocks and echoed instructions.

    The patterns only run on a text that holds one of the words they need.
    """
    t = col(text)
    t = F.when(F.lower(t).contains("think"), _replaced(t, THINK_BLOCKS)).otherwise(t)
    return let(
        t, lambda x: F.when(_any(F.lower(x), ECHO_WORDS), _replaced(x, ECHOED_TEXT)).otherwise(x)
    )


def _worth_keeping(line: Column) -> Column:
    def judge(words: Column) -> Column:
        n = F.size(words)

        def repeats(distinct: Column) -> Column:
            return (distinct * 3 < n) | ((F.length(line) > 20) & (distinct * 2 < n))

        return ~((n > 5) & let(F.size(F.array_distinct(words)), repeats))

    # A one-character separator needs no pattern to be compiled per line.
    return let(F.split(F.regexp_replace(line, WHITESPACE_RUN, " "), " "), judge)


def drop_repetitive_lines(text: Column | str) -> Column:
    """Trim every line and drop the ones that mostly repeat a few words."""
    lines = F.transform(F.split(col(text), "\n"), strip)
    return F.array_join(F.filter(lines, _worth_keeping), "\n")


def clean_answer(text: Column | str) -> Column:
    return drop_repetitive_lines(remove_blocks(text))


# ---------------------------------------------------------------------------
# Verdict, fields, bare label


def verdict(text: Column | str, patterns: Sequence[str] = VERDICT_PATTERNS) -> Column:
    """PURE / FLOSS from the first pattern that hits, else NULL.

    Like the other searches below, the patterns only run on a text that holds one of
    the words they need.
    """
    t = col(text)
    return F.when(
        _any(F.lower(t), ("pure", "floss")), F.upper(F.coalesce(*[found(t, p) for p in patterns]))
    )


def field_value(text: Column | str, name: str) -> Column:
    t = col(text)
    low = F.lower(t)
    tries = []
    for pattern in FIELD_PATTERNS[name]:
        words = (name,) if name in pattern else ("pure", "floss")
        v = F.btrim(F.btrim(strip(F.regexp_extract(t, pattern, 1)), F.lit('"')), F.lit("'"))
        tries.append(F.when(_any(low, words), F.when(~v.isin(*NO_VALUE), v)))
    return F.coalesce(*tries)


def bare_label(text: Column | str) -> Column:
    low = F.lower(col(text))
    return F.when(_any(low, ("pure", "floss")), found(low, r"(?U)\b(pure|floss)\b"))


def bare_justification(text: Column | str, longer_than: int = 10) -> Column:
    t = col(text)
    tries = []
    labelled, plain = JUSTIFICATION_PATTERNS
    # Where the second pattern fails from one opening it fails from all others in the same
    # run of words, so that run is taken in one empty match.
    runs = F.regexp_extract_all(t, F.lit(f"{plain}|{JUSTIFICATION_RUN}"), F.lit(1))
    firsts = (F.regexp_extract(t, labelled, 1), F.get(F.filter(runs, lambda x: x != ""), F.lit(0)))
    for first, words in zip(firsts, JUSTIFICATION_WORDS):
        v = strip(first)
        tries.append(F.when(_any(F.lower(t), words) & (F.length(v) > longer_than), v))
    return F.coalesce(*tries)


# ---------------------------------------------------------------------------
# Scoring


# The functions below search a text dozens of times. ``lowered`` says that the column
# is lower-case already, so that a caller can compute that once per row.


def _low(text: Column | str, lowered: bool) -> Column:
    return col(text) if lowered else F.lower(col(text))


def pure_score(text: Column | str, lowered: bool = False) -> Column:
    return _count(_low(text, lowered), PURE_PHRASES)


def floss_score(text: Column | str, lowered: bool = False) -> Column:
    return _count(_low(text, lowered), FLOSS_PHRASES)


def label_from_scores(
    pure: Column, floss: Column, text: Column | str, lowered: bool = False
) -> Column:
    """The larger count wins; on a tie a negation phrase means pure, else floss."""
    return (
        F.when(pure > floss, "pure")
        .when(floss > pure, "floss")
        .when(_any(_low(text, lowered), NEGATION_PHRASES), "pure")
        .otherwise("floss")
    )


def indicator_label(text: Column | str) -> Column:
    return label_from_scores(pure_score(text), floss_score(text), text)


def confidence(text: Column | str, lowered: bool = False) -> Column:
    t = _low(text, lowered)
    return F.when(_any(t, HIGH_WORDS), "high").when(_any(t, MEDIUM_WORDS), "medium").otherwise("low")


def fallback_label(text: Column | str, lowered: bool = False) -> Column:
    t = _low(text, lowered)
    return F.when(_any(t, FALLBACK_PURE) & ~_any(t, FALLBACK_CHANGE), "pure").otherwise("floss")


def fallback_justification(text: Column | str, low: Column | None = None) -> Column:
    t = col(text)
    low = F.lower(t) if low is None else low
    themes = F.array_compact(
        F.array(*[F.when(_any(low, words), F.lit(said)) for words, said in FALLBACK_THEMES])
    )
    first = F.substring_index(t, ".", 1)
    quoted = F.when(
        (F.length(first) > 20) & (F.length(first) < 200),
        F.array(F.concat(F.lit("LLM output: "), first)),
    ).otherwise(F.array().cast("array<string>"))
    parts = let(
        themes,
        lambda found: F.when(F.size(found) > 0, found).otherwise(
            F.array(F.lit(FALLBACK_NO_THEME))
        ),
    )
    return F.array_join(F.concat(parts, quoted), ". ")


# ---------------------------------------------------------------------------
# Structured answers


def is_object_text(text: Column) -> Column:
    """Does the text hold exactly one JSON object?

    The parser itself stops after the first value, so the text is wrapped in an
    array: anything behind the object makes that array malformed or longer.
    """
    t = strip(text)
    alone = let(
        F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))),
        lambda v: v.isNotNull() & F.try_variant_get(v, "$[1]", "variant").isNull(),
    )
    return F.coalesce(
        F.when(t.startswith("{") & t.endswith("}"), alone), F.lit(False)
    )


def _pieces(text: Column, pattern: str, opening: str) -> Column:
    """Matches of a pattern. Where it fails from one opening it fails from all later
    ones, so the rest of the text is taken in one empty match."""
    return F.regexp_extract_all(text, F.lit(rf"{pattern}|{opening}[\s\S]*\z"), F.lit(1))


def object_candidates(text: Column) -> Column:
    """Object-like pieces of a text, in the order they are tried."""
    return F.concat(*[_pieces(text, p, o) for p, o in zip(OBJECT_PATTERNS, OBJECT_OPENINGS)])


def brace_pieces(text: Column) -> Column:
    """The last kind of candidates only: from a brace to the next closing one."""
    return _pieces(text, OBJECT_PATTERNS[-1], OBJECT_OPENINGS[-1])


def repair_object(text: Column) -> Column:
    """Drop trailing commas and line comments of an object-like text."""
    t = F.regexp_replace(text, r",\s*\}", "}")
    t = F.regexp_replace(t, r",\s*\]", "]")
    return F.regexp_replace(t, r"(?d)//.*?\n", "\n")


def key_line_entries(text: Column) -> Column:
    """`key: value` lines of a text as an array of (key, value, pos).

    The long text is scanned once; the parts are then read out of each short match.
    """
    hit = (text.contains(":") | text.contains("=")) & text.rlike(
        r"[a-zA-Z0-9_\- ]{3}[\"']?\s*[:=]"
    )
    matches = F.when(hit, F.regexp_extract_all(text, F.lit(KEY_LINE), F.lit(0)))
    entries = F.transform(
        matches,
        lambda m, i: F.struct(
            strip(F.regexp_extract(m, KEY_LINE, 2)).alias("key"),
            i.alias("pos"),
            F.btrim(strip(F.regexp_extract(m, KEY_LINE, 4)), F.lit("\"'")).alias("value"),
        ),
    )
    return F.filter(entries, lambda e: (F.length(e["key"]) > 1) & (F.length(e["value"]) > 0))


def key_line_map(text: Column) -> Column:
    """Map of the `key: value` lines, the last line of a key wins; NULL if none."""

    def last_per_key(entries: Column) -> Column:
        kept = F.filter(
            entries,
            lambda e, i: F.coalesce(
                F.get(entries, i + 1)["key"] != e["key"], F.lit(True)
            ),
        )
        pairs = F.transform(kept, lambda e: F.struct(e["key"], e["value"]))
        return F.when(F.size(entries) > 0, F.map_from_entries(pairs))

    return let(F.array_sort(key_line_entries(text)), last_per_key)


def has_minimum(label: Column, justification: Column) -> Column:
    return label.isNotNull() | justification.isNotNull()
