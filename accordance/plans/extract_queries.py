"""Queries that read labels out of answers and cut long texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordance.functions import answers as X
from accordance.operators import compare as J
from accordance.operators import extract as E
from accordance.operators import sections as N
from accordance.plans import adapters as V
from accordance.plans.adapters import sql
from accordance.plans.agreement_queries import sql_confidence, sql_score


def strip_blocks(spark, d):
    return V.responses(spark, d).select("item_key", X.remove_blocks("response").alias("text"))


def drop_repetitive(spark, d):
    docs = V.texts(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", X.drop_repetitive_lines("text").alias("text"))


def verdict(spark, d):
    return V.responses(spark, d).select(
        "item_key",
        X.verdict("response").alias("verdict"),
        X.verdict("response", X.VERDICT_PATTERNS_SHORT).alias("short_verdict"),
    )


def structured_answer(spark, d):
    out = E.structured_answer(V.responses(spark, d))
    return out.withColumn("_doc", F.try_parse_json("answer_json")).select(
        "item_key",
        "answer_tier",
        F.try_variant_get("_doc", "$.refactoring_type", "string").alias("label"),
        F.try_variant_get("_doc", "$.justification", "string").alias("justification"),
    )


def repair_retry(spark, d):
    """Every object-like piece of every answer, before and after repairs."""
    pieces = F.filter(X.object_candidates(X.remove_blocks("response")), lambda p: p != "")
    rows = V.responses(spark, d).select("item_key", F.posexplode(pieces).alias("piece_no", "piece"))
    return rows.select(
        "item_key",
        (F.col("piece_no") + 1).cast("bigint").alias("piece_no"),
        X.is_object_text(F.col("piece")).alias("readable"),
        X.repair_object(F.col("piece")).alias("repaired"),
        X.is_object_text(X.repair_object(F.col("piece"))).alias("readable_after"),
    )


def quote_repair(spark, d):
    """Objects whose texts hold quotes that were never escaped."""
    said = V.table(spark, d, "events").select(
        "event_id",
        F.concat(
            F.lit('so {"refactoring_type": "pure", "justification": "the "'), "event_type", F.lit('" of user "'),
            F.col("user_id").cast("string"), F.lit('", seen", "confidence_level": "low"} then'),
        ).alias("response"),
    )
    out = E.answer_fields(E.structured_answer(said))
    return out.select(
        "event_id", "answer_tier", F.col("a_refactoring_type").alias("label"), F.col("a_justification").alias("justification"),
        F.col("a_confidence_level").alias("confidence"),
    )


def field_patterns(spark, d):
    out = E.line_fields(V.responses(spark, d).drop("repository"))
    return out.select(
        "item_key", "f_repository", "f_refactoring_type", "f_justification", "f_count",
        (F.col("f_count") >= 2).alias("usable"),
    )


def bare_label(spark, d):
    return V.responses(spark, d).select(
        "item_key",
        X.bare_label("response").alias("label"),
        X.bare_justification("response").alias("justification"),
    )


def indicator_score(spark, d):
    return V.responses(spark, d).select(
        "item_key",
        X.pure_score("response").cast("bigint").alias("pure_score"),
        X.floss_score("response").cast("bigint").alias("floss_score"),
        X.indicator_label("response").alias("label"),
    )


def confidence(spark, d):
    return V.responses(spark, d).select("item_key", X.confidence("response").alias("confidence"))


def keyword_fallback(spark, d):
    return V.responses(spark, d).select(
        "item_key",
        X.fallback_label("response").alias("label"),
        X.fallback_justification("response").alias("justification"),
    )


def key_lines(spark, d):
    """Whether a text has `key: value` lines at all (the map itself is Spark's)."""
    return V.texts(spark, d, "documents", "doc_id", "text").select(
        "doc_id", X.key_line_map(F.col("text")).isNotNull().alias("has_key_lines")
    )


def min_structure(spark, d):
    out = E.answer_fields(E.structured_answer(V.responses(spark, d)))
    return out.select(
        "item_key", X.has_minimum(F.col("a_refactoring_type"), F.col("a_justification")).alias("usable")
    )


def complete_fields(spark, d):
    """All answers completed from the item list, the evidence and the request."""
    out = E.answer_fields(E.structured_answer(V.responses(spark, d))).drop("response", "cleaned", "answer_json")
    listed = J.first_lookup(out.select("item_key"), V.items(spark, d), "after_key", V.ITEM_ORDER, ["project_name", "before_key", "after_key"])
    listed = listed.select(
        "item_key", F.col("project_name").alias("item_repository"), F.col("before_key").alias("item_before"),
        F.col("after_key").alias("item_after"),
    )
    evidence = J.top_evidence(V.details(spark, d), V.DETAIL_ORDER, text="detail")
    done = E.complete_fields(out.join(listed, "item_key", "left").join(evidence, "item_key", "left"))
    return done.select(
        "item_key", "repository", "commit_hash_before", "commit_hash_current", "label",
        "justification", "technical_evidence", "confidence", "diff_source", "fields_filled",
    )


def cascade(spark, d):
    return E.cascade(V.responses(spark, d)).select(
        "item_key", "label", "status", "extraction_method", "justification", "confidence"
    )


def cascade_structure_first(spark, d):
    return E.cascade(V.responses(spark, d), E.STRUCTURE_FIRST).select(
        "item_key", "label", "status", "extraction_method"
    )


def success_by_method(spark, d):
    return E.success_by_method(E.cascade(V.responses(spark, d)))


def quarantine(spark, d):
    return E.failures(E.cascade(V.responses(spark, d))).select("item_key", "repository", "error", "attempt")


def bracket_scan(spark, d):
    """The JSON value inside a sentence, found by the Python bracket scan."""
    said = V.table(spark, d, "events").select(
        "event_id",
        F.concat(F.lit("the "), "event_type", F.lit(' event "said '), "props", F.lit(" } and went")).alias("response"),
    )
    return E.any_json_value(said).select("event_id", "json_value")


CUT = {"max_chars": 500, "lines_per_section": 2, "header": "[A-E]", "kept": ",",
       "note": "... (lines omitted)", "cut_note": "... (text cut)"}


def reduce_sections(spark, d):
    docs = V.texts(spark, d, "documents", "doc_id", "text")
    return N.reduce_sections(docs, **CUT).drop("text")


def truncate_text(spark, d):
    docs = V.texts(spark, d, "documents", "doc_id", "text")
    return N.truncate_text(docs, limit=1000).drop("text")


# ---------------------------------------------------------------------------
# SQL

_WS = r"[\s\x{85}\p{Z}\x1c-\x1f\x0b]"


def _blocks(t: str) -> str:
    for p, f in (
        (r"<think\b[^>]*>.*?</think>", "gis"), (r"<think\b[^>]*/>", "gis"),
        (r"<<think>>.*?<</think>>", "gis"), (r"^\s*\[?\(?think\)?\]?[:\-\s].*$", "gim"),
        (r"CRITICAL:\s*You\s+must\s+respond.*?before\s+or\s+after\.", "gis"),
        (r"Analyze\s+this\s+Git\s+diff\s+and\s+classify.*?refactoring\.", "gis"),
        (r"^You\s+are\s+an?\s+expert.*$", "gim"), (r"^Based\s+on\s+the\s+provided.*$", "gim"),
    ):
        if f == "gim":
            p, f = "(?m)" + p, "gi"
        t = f"regexp_replace({t}, '{p}', '', '{f}')"
    return t


def _lines(t: str) -> str:
    trimmed = f"regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')"
    words = f"regexp_split_to_array(x, '{_WS}+')"
    n, u = f"len({words})", f"list_unique({words})"
    return (
        f"array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda x: {trimmed}), "
        f"lambda x: NOT (({n} > 5 AND {u} * 3 < {n}) OR ({n} > 5 AND length(x) > 20 AND {u} * 2 < {n}))), chr(10))"
    )


def _first(t: str, *patterns: tuple[str, str]) -> str:
    return "coalesce(" + ", ".join(
        f"nullif(regexp_extract({t}, '{p}', 1, '{f}'), '')" for p, f in patterns) + ")"


_W = r"[\p{L}\p{M}\p{N}_]"
_EDGE = r"(?:^|[^\p{L}\p{M}\p{N}_])"
_VERDICTS = (
    (r"FINAL:\s*(PURE|FLOSS)", "i"), (r"CONCLUSÃO:\s*(PURE|FLOSS)", "i"),
    (r"CLASSIFICATION:\s*(PURE|FLOSS)", "i"), (r"RESULTADO:\s*(PURE|FLOSS)", "i"),
    (_EDGE + r"FINAL[:\s]+(PURE|FLOSS)(?:[^\p{L}\p{M}\p{N}_]|$)", "i"),
    (r"(?m)" + _EDGE + r"(PURE|FLOSS)\s*$", "i"),
)
_VERDICT = f"upper({_first('response', *_VERDICTS)})"
_SHORT = f"upper({_first('response', *_VERDICTS[:2])})"

_MEND = "regexp_replace(regexp_replace({0}, ',\\s*\\}}', '}}', 'g'), ',\\s*\\]', ']', 'g')"
_VALID = "(json_valid({0}) AND json_type(CASE WHEN json_valid({0}) THEN {0} END) = 'OBJECT' AND NOT regexp_matches({0}, ',\\s*[}}\\]]'))"
_OBJECT = r"regexp_extract(cleaned, '(\{[\s\S]*?\})', 1)"
_PIECES = "list_concat(" + ", ".join(
    f"regexp_extract_all({_blocks('response')}, '{p}', 1)"
    for p in (r"```json\s*(\{[\s\S]*?\})\s*```", r"```\s*(\{[\s\S]*?\})\s*```", r"(\{[\s\S]*?\})")
) + ")"

_KV_BODY = r"([a-zA-Z0-9_\- ]{3,40})"


def _key_lines(t: str) -> str:
    """Any `key: value` line whose trimmed key has two characters and value one."""
    hits = []
    for q in ("", '"', "''"):
        for v in ("", '"', "''"):
            hits.append(
                f"""len(list_filter(regexp_extract_all({t}, '{q}{_KV_BODY}{q}\\s*[:=]\\s*{v}[^\\n\\r]+?{v}(?:\\n|$)', 1),
                    lambda k: length(trim(k)) > 1)) > 0"""
            )
    return "(" + " OR ".join(hits) + ")"


def _loose(name: str, *more: str) -> str:
    pats = [f'"{name}":\\s*"([^"]*)"', f"{name}[:\\s]*([^\\n,}}]+)", *more]
    vals = [
        f"CASE WHEN v{i} NOT IN ('', 'Unknown', 'None') THEN v{i} END" for i in range(len(pats))
    ]
    inner = ", ".join(
        f"trim(trim(regexp_replace(regexp_extract(response, '{p}', 1, 'i'), '^[ \\t\\n\\r\\x0b\\f]+|[ \\t\\n\\r\\x0b\\f]+$', '', 'g'), '\"'), '''') AS v{i}"
        for i, p in enumerate(pats)
    )
    return f"(SELECT coalesce({', '.join(vals)}) FROM (SELECT {inner}))"


_FIELDS = f"""fields AS (SELECT item_key, response, {_loose('project')} AS project, {_loose('repository')} AS repo,
  {_loose('commit_hash_before')} AS b, {_loose('commit_hash_current')} AS c,
  {_loose('refactoring_type', '(pure|floss)')} AS t, {_loose('justification')} AS j FROM responses),
 counted AS (SELECT *, (project IS NOT NULL)::INT + (repo IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT
  + (t IS NOT NULL)::INT + (j IS NOT NULL)::INT AS n FROM fields)"""

_BARE = r"nullif(regexp_extract(lower(response), '" + _EDGE + r"(pure|floss)(?:[^\p{L}\p{M}\p{N}_]|$)', 1), '')"
_S = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_SW = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}\p{L}\p{M}\p{N}_]"
_JUST = "coalesce(" + ", ".join(
    f"""(SELECT CASE WHEN length(v) > 10 THEN v END FROM (SELECT regexp_replace(regexp_extract(response, '{p}', 1, 'is'),
        '^[ \\t\\n\\r\\x0b\\f]+|[ \\t\\n\\r\\x0b\\f]+$', '', 'g') AS v))"""
    for p in (
        r"(?:justification|reasoning|explanation)[\s:]*(.+?)(?:\n\n|\n[A-Z]|\.|$)",
        rf"(?:this|the commit|changes){_SW}*(?:are|is|represents?){_SW}*(.+?)(?:\.|$)",
    )) + ")"


def _contains(t: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({t}), '{w}')" for w in words) + ")"


_FALLBACK = (
    f"CASE WHEN {_contains('response', X.FALLBACK_PURE)} AND NOT {_contains('response', X.FALLBACK_CHANGE)} THEN 'pure' ELSE 'floss' END"
)
_THEMES = "list_filter([" + ", ".join(
    f"CASE WHEN {_contains('response', w)} THEN '{s}' END" for w, s in X.FALLBACK_THEMES) + "], lambda x: x IS NOT NULL)"
_SENTENCE = "string_split(response, '.')[1]"
_FALLBACK_TEXT = f"""array_to_string(list_concat(
   CASE WHEN len({_THEMES}) > 0 THEN {_THEMES} ELSE ['{X.FALLBACK_NO_THEME}'] END,
   CASE WHEN length({_SENTENCE}) > 20 AND length({_SENTENCE}) < 200 THEN ['LLM output: ' || {_SENTENCE}] ELSE [] END), '. ')"""

_RAW = f"regexp_replace(response, '^{_WS}+|{_WS}+$', '', 'g')"
_CLEAN = _lines(_blocks("response"))
# The object of an answer as it stands in the text: the whole text, the first readable piece, or the first
# piece mended.
_PARSED = f"""cleaned AS (SELECT *, {_CLEAN} AS cleaned FROM responses),
 tried AS (SELECT *, regexp_replace(cleaned, '^{_WS}+|{_WS}+$', '', 'g') AS whole,
   list_filter(regexp_extract_all(cleaned, '(\\{{[\\s\\S]*?\\}})', 1), lambda p: {_VALID.format('p')})[1] AS good,
   {_MEND.format(_OBJECT)} AS mended FROM cleaned),
 tiers AS (SELECT *, CASE WHEN {_VALID.format('whole')} THEN 'whole' WHEN good IS NOT NULL THEN 'candidate'
   WHEN {_VALID.format('mended')} THEN 'repaired' END AS tier FROM tried),
 objects AS (SELECT *, CASE tier WHEN 'whole' THEN whole WHEN 'candidate' THEN good WHEN 'repaired' THEN mended END AS doc FROM tiers),
 parsed AS (SELECT *, """ + ", ".join(
    f"coalesce({', '.join(f'nullif(json_extract_string(doc, {chr(39)}$.{n}{chr(39)}), {chr(39)*2})' for n in names)}) AS a_{k}"
    for k, names in E.ANSWER_FIELDS.items()) + """ FROM objects)"""

_LABEL = "CASE WHEN a_refactoring_type IN ('pure', 'floss') THEN a_refactoring_type ELSE 'floss' END"
_CASCADE = f"""{_PARSED}, casc AS (SELECT item_key, CASE WHEN response = '' THEN NULL ELSE lab END AS label,
    CASE WHEN response = '' THEN 'failed' ELSE 'ok' END AS status,
    CASE WHEN response = '' THEN NULL ELSE m END AS extraction_method,
    CASE WHEN response = '' THEN NULL WHEN m IN ('verdict', 'scoring') THEN {_RAW} WHEN m = 'structured' THEN a_justification
         ELSE 'Analysis failed - insufficient data' END AS justification,
    CASE WHEN response = '' OR m = 'verdict' THEN NULL WHEN m = 'structured' THEN coalesce(a_confidence_level, 'low')
         WHEN m = 'key_lines' THEN 'low' ELSE {sql_confidence('response')} END AS confidence
  FROM (SELECT *, CASE m WHEN 'verdict' THEN lower(v) WHEN 'structured' THEN {_LABEL}
                    WHEN 'key_lines' THEN 'floss' ELSE {sql_score('response')} END AS lab
    FROM (SELECT *, CASE WHEN v IS NOT NULL THEN 'verdict' WHEN doc IS NOT NULL THEN 'structured'
                         WHEN {_key_lines('cleaned')} THEN 'key_lines' ELSE 'scoring' END AS m
      FROM (SELECT *, {_VERDICT} AS v FROM parsed))))"""

_SOURCES = """listed AS (SELECT after_key AS k, project_name, before_key FROM (SELECT *, row_number() OVER (PARTITION BY after_key
     ORDER BY ord0, ord1, ord2, ord3) AS rn FROM items) WHERE rn = 1),
   proof AS (SELECT item_key AS k, string_agg(detail, '; ' ORDER BY rn) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY item_key
     ORDER BY ord1, ord2, ord3) AS rn FROM details WHERE detail IS NOT NULL) WHERE rn <= 3 GROUP BY item_key),
   given AS (SELECT p.*, coalesce(l.project_name, p.repository) AS repo, l.before_key AS before, coalesce(l.k, p.item_key) AS after, f.evidence
     FROM parsed p LEFT JOIN listed l ON l.k = p.item_key LEFT JOIN proof f ON f.k = p.item_key)"""
_COMPLETE = f"""SELECT item_key, coalesce(a_repository, repo, 'unknown') AS repository, coalesce(a_commit_hash_before, before, 'unknown') AS commit_hash_before,
   coalesce(a_commit_hash_current, after, 'unknown') AS commit_hash_current, {_LABEL} AS label,
   CASE WHEN length(a_justification) >= 5 THEN a_justification ELSE '{E.NO_JUSTIFICATION}' END AS justification,
   coalesce(a_technical_evidence, evidence, '{E.NO_EVIDENCE}') AS technical_evidence, coalesce(a_confidence_level, 'low') AS confidence,
   coalesce(a_diff_source, 'direct') AS diff_source, array_to_string(list_filter([
     CASE WHEN a_repository IS NULL AND repo IS NOT NULL THEN 'repository' END,
     CASE WHEN a_commit_hash_before IS NULL AND before IS NOT NULL THEN 'commit_hash_before' END,
     CASE WHEN a_commit_hash_current IS NULL THEN 'commit_hash_current' END,
     CASE WHEN a_technical_evidence IS NULL AND evidence IS NOT NULL THEN 'technical_evidence' END,
     CASE WHEN coalesce(a_refactoring_type, '') NOT IN ('pure', 'floss') THEN 'refactoring_type' END,
     CASE WHEN coalesce(length(a_justification), 0) < 5 THEN 'justification' END,
     CASE WHEN a_technical_evidence IS NULL AND evidence IS NULL THEN 'technical_evidence' END,
     CASE WHEN a_confidence_level IS NULL THEN 'confidence_level' END,
     CASE WHEN a_diff_source IS NULL THEN 'diff_source' END], lambda x: x IS NOT NULL), ',') AS fields_filled FROM given"""

_STRUCTURE_FIRST = f"""SELECT item_key, CASE WHEN response = '' THEN NULL
    WHEN m = 'structured' THEN {_LABEL}
    WHEN m = 'lines' THEN CASE WHEN t IS NOT NULL AND coalesce(v, t) IN ('pure', 'floss') THEN coalesce(v, t) ELSE 'floss' END
    WHEN m = 'bare_label' THEN coalesce(v, bl) WHEN m = 'verdict' THEN v ELSE {_FALLBACK} END AS label,
    CASE WHEN response = '' THEN 'failed' ELSE 'ok' END AS status,
    CASE WHEN response = '' THEN NULL ELSE m END AS extraction_method
  FROM (SELECT *, CASE WHEN doc IS NOT NULL THEN 'structured' WHEN n >= 2 AND (t IS NOT NULL OR j IS NOT NULL) THEN 'lines'
          WHEN bl IS NOT NULL THEN 'bare_label' WHEN v IS NOT NULL THEN 'verdict' ELSE 'fallback' END AS m
    FROM (SELECT c.*, r.doc, r.a_refactoring_type, lower({_SHORT.replace('response', 'c.response')}) AS v, {_BARE.replace('response', 'c.response')} AS bl
          FROM counted c JOIN parsed r ON c.item_key = r.item_key))"""

_REDUCE = """WITH lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
 heads AS (SELECT *, sum(regexp_matches(line, '^[A-E]')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM lines),
 nums AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec ORDER BY pos) AS no FROM heads),
 outs AS (SELECT *, no > 2 AND NOT contains(line, ',') AS off FROM nums),
 firsts AS (SELECT *, off AND row_number() OVER (PARTITION BY doc_id, sec, off ORDER BY pos) = 1 AS mark FROM outs),
 kept AS (SELECT doc_id, text, pos, CASE WHEN mark THEN '... (lines omitted)' ELSE line END AS line, mark
          FROM firsts WHERE NOT off OR mark),
 lens AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS upto FROM kept),
 capped AS (SELECT *, upto - length(line) - 1 AS before FROM lens),
 joined AS (SELECT doc_id, any_value(text) AS text, string_agg(line, chr(10) ORDER BY pos)
              || CASE WHEN max(upto) > 500 THEN chr(10) || '... (text cut)' ELSE '' END AS body,
              count(*) FILTER (WHERE mark) AS marks
            FROM capped WHERE before <= 500 GROUP BY doc_id)
 SELECT doc_id, CASE WHEN length(text) > 500 THEN body ELSE text END AS reduced_text, length(text) > 500 AS reduced,
        length(text) AS original_chars, length(CASE WHEN length(text) > 500 THEN body ELSE text END) AS new_chars,
        CASE WHEN length(text) > 500 THEN marks ELSE 0 END AS truncated_sections FROM joined"""

QUERIES = {
    "strip_blocks": (strip_blocks, sql(f"SELECT item_key, {_blocks('response')} AS text FROM responses", "responses")),
    "drop_repetitive": (drop_repetitive, f"SELECT doc_id, {_lines('text')} AS text FROM documents"),
    "verdict": (
        verdict, sql(f"SELECT item_key, {_VERDICT} AS verdict, {_SHORT} AS short_verdict FROM responses", "responses"),
    ),
    "structured_answer": (
        structured_answer,
        sql("""SELECT item_key, tier AS answer_tier, json_extract_string(doc, '$.refactoring_type') AS label,
               json_extract_string(doc, '$.justification') AS justification FROM parsed""", "responses", extra=_PARSED),
    ),
    "repair_retry": (
        repair_retry,
        sql(f"""SELECT item_key, piece_no, {_VALID.format('piece')} AS readable, {_MEND.format('piece')} AS repaired,
                {_VALID.format('(' + _MEND.format('piece') + ')')} AS readable_after
                FROM (SELECT item_key, unnest(ps) AS piece, generate_subscripts(ps, 1) AS piece_no
                      FROM (SELECT item_key, {_PIECES} AS ps FROM responses))""", "responses"),
    ),
    "quote_repair": (
        quote_repair,
        """SELECT event_id, 'scanned' AS answer_tier, 'pure' AS label, 'low' AS confidence,
           'the "' || event_type || '" of user "' || user_id::VARCHAR || '", seen' AS justification FROM events""",
    ),
    "field_patterns": (
        field_patterns,
        sql("""SELECT item_key, coalesce(repo, project) AS f_repository, t AS f_refactoring_type, j AS f_justification,
               n AS f_count, n >= 2 AS usable FROM counted""", "responses", extra=_FIELDS),
    ),
    "bare_label": (
        bare_label, sql(f"SELECT item_key, {_BARE} AS label, {_JUST} AS justification FROM responses", "responses"),
    ),
    "indicator_score": (
        indicator_score,
        sql("SELECT item_key, " + " + ".join(f"contains(lower(response), '{p}')::BIGINT" for p in X.PURE_PHRASES)
            + " AS pure_score, " + " + ".join(f"contains(lower(response), '{p}')::BIGINT" for p in X.FLOSS_PHRASES)
            + f" AS floss_score, {sql_score('response')} AS label FROM responses", "responses"),
    ),
    "confidence": (
        confidence, sql(f"SELECT item_key, {sql_confidence('response')} AS confidence FROM responses", "responses"),
    ),
    "keyword_fallback": (
        keyword_fallback,
        sql(f"SELECT item_key, {_FALLBACK} AS label, {_FALLBACK_TEXT} AS justification FROM responses", "responses"),
    ),
    "key_lines": (key_lines, f"SELECT doc_id, {_key_lines('text')} AS has_key_lines FROM documents"),
    "bracket_scan": (bracket_scan, "SELECT event_id, props AS json_value FROM events"),
    "min_structure": (
        min_structure,
        sql("SELECT item_key, a_refactoring_type IS NOT NULL OR a_justification IS NOT NULL AS usable FROM parsed",
            "responses", extra=_PARSED),
    ),
    "complete_fields": (
        complete_fields,
        sql(_COMPLETE, "responses", "items", "details", extra=f"{_PARSED}, {_SOURCES}"),
    ),
    "cascade": (cascade, sql("SELECT * FROM casc", "responses", extra=_CASCADE)),
    "cascade_structure_first": (
        cascade_structure_first, sql(_STRUCTURE_FIRST, "responses", extra=f"{_PARSED}, {_FIELDS}"),
    ),
    "success_by_method": (
        success_by_method,
        sql("""SELECT coalesce(extraction_method, 'none') AS extraction_method, status, count(*) AS n,
               count(*) / (sum(count(*)) OVER ())::DOUBLE * 100 AS pct FROM casc GROUP BY 1, 2""", "responses", extra=_CASCADE),
    ),
    "quarantine": (
        quarantine,
        sql("""SELECT item_key, repository, 'empty response' AS error, 'JSON parsing failed' AS attempt
               FROM responses WHERE response = ''""", "responses"),
    ),
    "reduce_sections": (reduce_sections, _REDUCE),
    "truncate_text": (
        truncate_text,
        """SELECT doc_id, CASE WHEN length(text) > 1000 THEN substring(text, 1, 1000) || chr(10) || '... (truncado)' ELSE text END AS short_text,
           length(text) > 1000 AS truncated, length(text) AS original_chars, least(length(text), 1000) AS kept_chars FROM documents""",
    ),
}
