"""Queries over labels, predicates and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordance.functions import labels as L
from accordance.functions import sizes as Z
from accordance.operators import compare as J
from accordance.operators import filters as P
from accordance.operators import resolve as R
from accordance.plans import adapters as V
from accordance.plans.adapters import sql

SPELLINGS = ("true", " T ", "1", "Pure", "impure", "FLOSS", "0", "na", "NaN", "", None, "FAILED", "xyz")


def _spelled(spark, d):
    words = F.array(*[F.lit(s).cast("string") for s in SPELLINGS])
    return V.table(spark, d, "documents").select(
        V.key_text("doc_id").alias("item_key"),
        F.get(words, (F.col("doc_id") % len(SPELLINGS)).cast("int")).alias("raw"),
    )


_SPELLED = "spelled AS (SELECT printf('k%07d', doc_id) AS item_key, CASE doc_id % 13 " + " ".join(
    f"WHEN {i} THEN {'NULL' if s is None else repr(s)}" for i, s in enumerate(SPELLINGS)
) + " END AS raw FROM documents)"

_NORM = """CASE WHEN {0} IS NULL OR upper(trim({0})) IN ('NONE','','NA','NAN') THEN NULL
 WHEN upper(trim({0})) IN ('TRUE','T','1','PURE') THEN 'TRUE'
 WHEN upper(trim({0})) IN ('FALSE','F','0','FLOSS') THEN 'FALSE'
 WHEN contains(upper({0}), 'PURE') THEN 'TRUE'
 WHEN contains(upper({0}), 'FLOSS') OR contains(upper({0}), 'FALSE') THEN 'FALSE'
 ELSE upper(trim({0})) END"""


def label_normalize(spark, d):
    return _spelled(spark, d).select("item_key", L.normalize_label("raw").alias("label"))


def label_map(spark, d):
    return V.ledgers(spark, d).select(
        "item_key", "annotator", L.map_label("reference_label").alias("reference_normalized")
    )


def label_replace(spark, d):
    return V.ledgers(spark, d).select(
        "item_key", "annotator",
        L.map_label("candidate_label", {"PURE": "TRUE", "FLOSS": "FALSE"}, keep_unmapped=True).alias("label"),
    )


def case_default(spark, d):
    return V.ledgers(spark, d).select(
        "item_key", "annotator",
        L.upper_or("candidate_label").alias("upper_label"),
        L.lower_or("candidate_label").alias("lower_label"),
    )


def repo_name_a(spark, d):
    return V.table(spark, d, "pages").select("page_id", L.repo_from_url("url").alias("repo_name"))


def repo_name_b(spark, d):
    return V.table(spark, d, "pages").select(
        "page_id",
        L.repo_after_slash("url").alias("repo_b"),
        L.repo_or_whole("url").alias("repo_c"),
    )


def valid_keys(spark, d):
    return P.valid_keys(V.flawed_details(spark, d))


def valid_keys_report(spark, d):
    return P.valid_keys_report(V.flawed_details(spark, d))


def split_labelled(spark, d):
    have, lack = P.split_labelled(V.details(spark, d))
    cols = ["item_key", *V.DETAIL_ORDER]
    return J.concat_rows(
        have.select(*cols, F.lit("labelled").alias("part")),
        lack.select(*cols, F.lit("unlabelled").alias("part")),
    )


def _keys(df):
    return df.select("item_key", "reference_label", "candidate_label")


def pending(spark, d):
    return _keys(P.pending(V.ledger(spark, d)))


def completed(spark, d):
    return _keys(P.completed(V.ledger(spark, d)))


def both_classified(spark, d):
    return P.both_classified(V.ledgers(spark, d)).select(
        "item_key", "annotator", "reference_label", "candidate_label"
    )


def by_reference(spark, d):
    return _keys(P.by_reference(V.ledger(spark, d), "NONE"))


_ANY = ["item_key", "reference_label", "candidate_label", "project_name"]


def any_token_exclusion(spark, d):
    return P.drop_rows_with_token(V.ledger(spark, d).select(_ANY))


def exclusion_report(spark, d):
    return P.token_report(V.ledger(spark, d).select(_ANY))


_HIT = " OR ".join(
    f"contains(lower(coalesce({c}, '')), '{t}')" for c in _ANY for t in ("none", "failed")
)


def std_schema(spark, d):
    return P.to_standard(_keys(V.ledger(spark, d)))


def alias_coalesce(spark, d):
    src = V.table(spark, d, "documents").select(
        V.key_text("doc_id").alias("item_key"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("llm_analysis"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("llm"),
    )
    return src.select("item_key", L.first_of(src, "llm_analysis", "model_label", "llm").alias("label"))


def flags(spark, d):
    compared = P.with_agreement(V.ledgers(spark, d))
    return compared.select("item_key", "annotator", "reference_normalized", "agreement")


def compared(spark, d):
    """Rows both sides have labelled, with repository columns and the agreement flag."""
    both = P.both_classified(V.ledgers(spark, d))
    return P.with_agreement(both)


def facet_stats(spark, d):
    c = compared(spark, d)
    parts = {
        "all": {},
        "agreeing": {"agreement": True},
        "reference_true": {"reference": "TRUE"},
        "candidate_pure": {"candidate": "PURE"},
        "true_and_pure": {"reference": "TRUE", "candidate": "PURE"},
    }
    return J.concat_rows(
        *[P.facet_stats(c, **f).withColumn("facet", F.lit(n)) for n, f in parts.items()]
    )


_FACETS = {
    "all": "true",
    "agreeing": "agreement",
    "reference_true": "reference_label = 'TRUE'",
    "candidate_pure": "candidate_label = 'PURE'",
    "true_and_pure": "reference_label = 'TRUE' AND candidate_label = 'PURE'",
}


def short_key(spark, d):
    return V.items(spark, d).select(*V.ITEM_ORDER, L.short_key("after_key", 4).alias("short"))


def text_metrics(spark, d):
    return V.table(spark, d, "documents").select(
        "doc_id",
        Z.char_count("text").alias("chars"),
        Z.line_count("text").alias("lines"),
        Z.token_estimate("text").alias("tokens"),
    )


def size_tiers(spark, d):
    docs = V.table(spark, d, "documents")
    chars, tokens = Z.char_count("text"), Z.token_estimate("text")
    return docs.select(
        "doc_id",
        Z.tier(tokens, Z.CONTEXT_DEFAULT).alias("context_default"),
        Z.tier(tokens, Z.CONTEXT_CAUTIOUS).alias("context_cautious"),
        Z.tier(tokens, Z.CONTEXT_SIMPLE).alias("context_simple"),
        Z.timeout_tier(chars).alias("timeout"),
        Z.route(chars).alias("route"),
    )


TEMPLATE = "Repository: {repo}\nKey: {key}\nSize: {chars} characters ({lines} lines)\n\n{text}\n"


def request_text(spark, d):
    docs = V.table(spark, d, "documents")
    return docs.select(
        "doc_id",
        Z.render(
            TEMPLATE,
            {
                "repo": F.col("source"),
                "key": V.key_text("doc_id"),
                "chars": Z.char_count("text"),
                "lines": Z.line_count("text"),
                "text": F.col("text"),
            },
        ).alias("request"),
    )


def boolean_worklist(spark, d):
    records = R.consolidate(V.details(spark, d), V.DETAIL_ORDER)
    return P.worklist(records).select("item_key", "kind_of_change", "had_conflict")


_LINES = (
    "len(regexp_extract_all(text, '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'))"
    " + CASE WHEN text = '' OR regexp_matches(text, '[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]\\z')"
    " THEN 0 ELSE 1 END"
)
_TOKENS = "CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END"
_KEYS = "SELECT item_key, reference_label, candidate_label FROM alpha"

QUERIES = {
    "label_normalize": (
        label_normalize,
        sql(f"SELECT item_key, {_NORM.format('raw')} AS label FROM spelled", extra=_SPELLED),
    ),
    "label_map": (label_map, sql("SELECT item_key, annotator, reference_normalized FROM normal", "normal")),
    "label_replace": (
        label_replace,
        sql("""SELECT item_key, annotator, CASE candidate_label WHEN 'PURE' THEN 'TRUE' WHEN 'FLOSS' THEN 'FALSE'
               ELSE candidate_label END AS label FROM ledgers""", "ledgers"),
    ),
    "case_default": (
        case_default,
        sql("""SELECT item_key, annotator, upper(coalesce(candidate_label, 'UNKNOWN')) AS upper_label,
               lower(coalesce(candidate_label, 'not_found')) AS lower_label FROM ledgers""", "ledgers"),
    ),
    "repo_name_a": (
        repo_name_a,
        "SELECT page_id, replace(string_split(url, '/')[-1], '.git', '') AS repo_name FROM pages",
    ),
    "repo_name_b": (
        repo_name_b,
        """SELECT page_id, coalesce(nullif(regexp_extract(url, '/([^/]+)$', 1), ''), 'unknown') AS repo_b,
           CASE WHEN url IS NULL OR url = '' THEN 'unknown' ELSE string_split(url, '/')[-1] END AS repo_c
           FROM pages""",
    ),
    "valid_keys": (
        valid_keys,
        sql("SELECT * FROM flawed_details WHERE item_key IS NOT NULL AND length(item_key) >= 7", "flawed_details"),
    ),
    "valid_keys_report": (
        valid_keys_report,
        sql("""SELECT count(*) AS total_rows, count(*) FILTER (WHERE length(item_key) >= 7) AS valid_rows,
               count(*) - count(*) FILTER (WHERE length(item_key) >= 7) AS removed_rows FROM flawed_details""",
            "flawed_details"),
    ),
    "split_labelled": (
        split_labelled,
        sql("""SELECT item_key, ord1, ord2, ord3,
               CASE WHEN label IS NULL THEN 'unlabelled' ELSE 'labelled' END AS part FROM details""", "details"),
    ),
    "pending": (pending, sql(_KEYS + " WHERE candidate_label IS NULL", "alpha")),
    "completed": (completed, sql(_KEYS + " WHERE candidate_label NOT IN ('FAILED', 'ERROR')", "alpha")),
    "both_classified": (
        both_classified,
        sql("""SELECT item_key, annotator, reference_label, candidate_label FROM ledgers
               WHERE reference_label IS NOT NULL AND candidate_label NOT IN ('FAILED', 'ERROR')""", "ledgers"),
    ),
    "by_reference": (by_reference, sql(_KEYS + " WHERE reference_label = 'NONE'", "alpha")),
    "any_token_exclusion": (
        any_token_exclusion, sql(f"SELECT {', '.join(_ANY)} FROM alpha WHERE NOT ({_HIT})", "alpha"),
    ),
    "exclusion_report": (
        exclusion_report,
        sql(f"""SELECT count(*) AS total_rows, count(*) FILTER (WHERE NOT ({_HIT})) AS kept_rows,
                count(*) FILTER (WHERE {_HIT}) AS excluded_rows,
                count(*) FILTER (WHERE {_HIT}) / count(*)::DOUBLE * 100 AS excluded_pct FROM alpha""", "alpha"),
    ),
    "std_schema": (
        std_schema,
        sql("""SELECT item_key AS commit_hash, reference_label AS purity_classification,
               candidate_label AS llm_classification FROM alpha""", "alpha"),
    ),
    "alias_coalesce": (
        alias_coalesce,
        """SELECT printf('k%07d', doc_id) AS item_key,
           coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''),
                    CASE WHEN doc_id % 2 = 0 THEN source END) AS label FROM documents""",
    ),
    "flags": (
        flags,
        sql("""SELECT item_key, annotator, reference_normalized,
               coalesce(reference_normalized = candidate_label, false) AS agreement FROM normal""", "normal"),
    ),
    "facet_stats": (
        facet_stats,
        sql(" UNION ALL ".join(
            f"""SELECT '{n}' AS facet, count(*) AS total, count(*) FILTER (WHERE agreement) AS agreements,
                round(coalesce(count(*) FILTER (WHERE agreement) / nullif(count(*), 0)::DOUBLE * 100, 0), 1) AS agreement_pct
                FROM compared WHERE {w}""" for n, w in _FACETS.items()), "compared"),
    ),
    "short_key": (
        short_key, sql("SELECT ord0, ord1, ord2, ord3, substring(after_key, 1, 4) AS short FROM items", "items"),
    ),
    "text_metrics": (
        text_metrics,
        f"SELECT doc_id, length(text) AS chars, {_LINES} AS lines, {_TOKENS} AS tokens FROM documents",
    ),
    "size_tiers": (
        size_tiers,
        f"""SELECT doc_id, CASE WHEN t < 3000 THEN 4096 WHEN t < 6000 THEN 6144 ELSE 8192 END AS context_default,
            CASE WHEN t < 2000 THEN 3072 ELSE 4096 END AS context_cautious,
            CASE WHEN t < 3000 THEN 2048 WHEN t < 6000 THEN 4096 ELSE 6144 END AS context_simple,
            CASE WHEN c > 50000 THEN 300 ELSE 200 END AS timeout,
            CASE WHEN c > 100000 THEN 'file' ELSE 'direct' END AS route
            FROM (SELECT doc_id, {_TOKENS} AS t, length(text) AS c FROM documents)""",
    ),
    "request_text": (
        request_text,
        f"""SELECT doc_id, 'Repository: ' || source || chr(10) || 'Key: ' || printf('k%07d', doc_id) || chr(10)
            || 'Size: ' || length(text)::VARCHAR || ' characters (' || ({_LINES})::VARCHAR || ' lines)'
            || chr(10) || chr(10) || text || chr(10) AS request FROM documents""",
    ),
    "boolean_worklist": (
        boolean_worklist,
        sql("""SELECT item_key, CASE WHEN bool_and(label) THEN 'pure' ELSE 'floss' END AS kind_of_change,
               bool_or(label) AND bool_or(NOT label) AS had_conflict
               FROM details WHERE label IS NOT NULL GROUP BY item_key""", "details"),
    ),
}
