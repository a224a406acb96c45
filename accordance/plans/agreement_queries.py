"""Queries over counts, matrices, agreement and consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordance.functions import answers as X
from accordance.functions import labels as L
from accordance.functions import sizes as Z
from accordance.operators import agreement as G
from accordance.operators import compare as J
from accordance.operators import filters as P
from accordance.operators import resolve as R
from accordance.plans import adapters as V
from accordance.plans.adapters import sql
from accordance.plans.join_queries import _OUTER, _UNITED, outer_compare, unite_models
from accordance.plans.label_queries import _NORM, compared

A = V.ANNOTATORS
STATUSES = ("PURE", "FLOSS", "FAILED", "ERROR")


def value_counts(spark, d):
    return G.value_counts(V.ledgers(spark, d), "candidate_label")


def value_counts_with_null(spark, d):
    return G.value_counts(V.ledgers(spark, d), "candidate_label", keep_null=True)


def tri_state(spark, d):
    return R.resolve_labels(V.details(spark, d))


def resolve_ledger(spark, d):
    keys = V.graded(spark, d).select("item_key")
    return R.resolve_ledger(keys, V.details(spark, d))


def match_report(spark, d):
    return R.match_report(resolve_ledger(spark, d))


def consolidate(spark, d):
    return R.consolidate(V.details(spark, d), V.DETAIL_ORDER)


_CONSOLIDATE = """
, lab AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY ord1, ord2, ord3, label, kind NULLS FIRST, detail NULLS FIRST) AS pos FROM details WHERE label IS NOT NULL),
 clash AS (SELECT item_key, bool_or(label) AND bool_or(NOT label) AS c, min(pos) AS p,
                  min(CASE WHEN NOT label THEN pos END) AS pf FROM lab GROUP BY item_key),
 texts AS (SELECT l.item_key, CASE WHEN k.c THEN CASE WHEN l.label THEN '[True] ' ELSE '[False] ' END || l.detail ELSE l.detail END AS t,
                  min(l.pos) AS pos FROM lab l JOIN clash k ON l.item_key = k.item_key WHERE l.detail IS NOT NULL GROUP BY 1, 2),
 kinds AS (SELECT item_key, kind, min(pos) AS pos FROM lab GROUP BY 1, 2),
 joined AS (SELECT item_key, string_agg(t, ' | ' ORDER BY pos) AS detail FROM texts GROUP BY 1),
 kjoin AS (SELECT item_key, string_agg(kind, ' | ' ORDER BY pos) AS kind FROM kinds GROUP BY 1),
 cons AS (
  SELECT b.item_key, b.label, CASE WHEN k.c THEN b.kind ELSE kj.kind END AS kind,
         coalesce(j.detail, b.detail) AS detail, b.ord1, b.ord2, b.ord3, k.c AS had_conflict
  FROM clash k JOIN lab b ON b.item_key = k.item_key AND b.pos = CASE WHEN k.c THEN k.pf ELSE k.p END
  LEFT JOIN joined j ON j.item_key = k.item_key LEFT JOIN kjoin kj ON kj.item_key = k.item_key
  UNION ALL
  SELECT item_key, NULL, kind, detail, ord1, ord2, ord3, false FROM (
    SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY ord1, ord2, ord3, kind NULLS FIRST, detail NULLS FIRST) AS rn
    FROM details WHERE label IS NULL) WHERE rn = 1)"""


def confusion(spark, d):
    c = compared(spark, d)
    return G.confusion(c, ("PURE", "FLOSS"), "reference_normalized")


def confusion_margins(spark, d):
    return G.confusion_margins(compared(spark, d), "reference_normalized")


def confusion_pct(spark, d):
    return G.confusion_pct(compared(spark, d), "reference_normalized")


def confusion_sparse(spark, d):
    return G.confusion_sparse(V.ledgers(spark, d))


def confusion_2x2(spark, d):
    return G.confusion_2x2(confusion_sparse(spark, d))


_SPARSE = f"""sparse AS (SELECT annotator, {_NORM.format('reference_label')} AS reference_label,
  {_NORM.format('candidate_label')} AS candidate_label, count(*) AS n FROM ledgers GROUP BY 1, 2, 3)"""


def agreement_total(spark, d):
    return G.agreement_total(compared(spark, d))


def comparison_summary(spark, d):
    from accordance.plans.join_queries import fixed_compare

    return G.comparison_summary(fixed_compare(spark, d))


def agreement_by_class(spark, d):
    return G.agreement_by_class(compared(spark, d))


def agreement_truth(spark, d):
    return G.agreement_truth(confusion_sparse(spark, d))


def model_summary(spark, d):
    return G.model_summary(confusion_sparse(spark, d))


def summary_file(spark, d):
    """The summary in the columns and order of its file."""
    files = V.ledgers(spark, d).withColumn("file", F.concat("annotator", F.lit(".csv")))
    return G.summary_file(files)


def membership(spark, d):
    return G.membership(outer_compare(spark, d))


def _with_repo(spark, d):
    return compared(spark, d).withColumn("repo_name", L.repo_after_slash("project")).withColumnRenamed(
        "project", "repository")


def repo_stats(spark, d):
    return G.repo_stats(_with_repo(spark, d))


def repo_matrix(spark, d):
    df = V.ledgers(spark, d).withColumn("repo_name", L.repo_from_url("project"))
    return G.repo_matrix(df, STATUSES)


def project_matches(spark, d):
    return G.project_matches(V.items(spark, d), V.graded(spark, d).select("item_key"))


def project_top(spark, d):
    return G.top_project(project_matches(spark, d))


def duplicate_report(spark, d):
    return G.duplicate_report(V.items(spark, d), "after_key")


def duplicate_top(spark, d):
    return G.top_duplicates(V.items(spark, d), "after_key")


def patterns(spark, d):
    return G.patterns(compared(spark, d))


def _labelled_responses(spark, d):
    t = V.texts(spark, d, "documents", "source", "text", "n_chars")
    return t.select(
        F.col("source").alias("repo_name"),
        X.indicator_label("text").alias("label"),
        X.confidence("text").alias("confidence"),
        F.col("n_chars").cast("bigint").alias("n_chars"),
        Z.route(Z.char_count("text"), 2000).alias("route"),
    )


def dataset_stats(spark, d):
    return G.dataset_stats(_labelled_responses(spark, d))


def sql_score(t: str) -> str:
    def n(phrases):
        return " + ".join(f"contains(lower({t}), '{p}')::INT" for p in phrases)

    negated = " OR ".join(f"contains(lower({t}), '{p}')" for p in X.NEGATION_PHRASES)
    p, f = f"({n(X.PURE_PHRASES)})", f"({n(X.FLOSS_PHRASES)})"
    return f"CASE WHEN {p} > {f} THEN 'pure' WHEN {f} > {p} THEN 'floss' WHEN {negated} THEN 'pure' ELSE 'floss' END"


def sql_confidence(t: str) -> str:
    def hit(words):
        return " OR ".join(f"contains(lower({t}), '{w}')" for w in words)

    return f"CASE WHEN {hit(X.HIGH_WORDS)} THEN 'high' WHEN {hit(X.MEDIUM_WORDS)} THEN 'medium' ELSE 'low' END"


_SCORED = f"""scored AS (SELECT source AS repo_name, {sql_score('text')} AS label, {sql_confidence('text')} AS confidence,
  n_chars, CASE WHEN length(text) > 2000 THEN 'file' ELSE 'direct' END AS route FROM documents)"""


def combos(spark, d):
    return G.combos(unite_models(spark, d), A)


def model_coverage(spark, d):
    return G.model_coverage(unite_models(spark, d), A)


def ledger_coverage(spark, d):
    return G.ledger_coverage(V.ledger(spark, d))


def status_breakdown(spark, d):
    return G.status_breakdown(V.ledgers(spark, d))


def status_failed(spark, d):
    return G.status_by_reference(status_breakdown(spark, d), "FAILED")


def _votes(spark, d):
    """Reference and three annotators as four voters over the same keys."""
    tool = V.graded(spark, d).select(
        "item_key", F.lit("tool").alias("annotator"), L.map_label("reference_label").alias("label")
    )
    return tool.unionByName(
        V.ledgers(spark, d).select("item_key", "annotator", F.col("candidate_label").alias("label"))
    )


VOTERS = ("tool", *A)


def consensus_nway(spark, d):
    return G.consensus(G.vote_combos(_votes(spark, d), VOTERS), VOTERS)


def majority_table(spark, d):
    return G.majority_table(G.vote_combos(_votes(spark, d), VOTERS), VOTERS)


_VOTED = """votes AS (SELECT item_key, 'tool' AS annotator, CASE reference_label WHEN 'TRUE' THEN 'PURE'
    WHEN 'FALSE' THEN 'FLOSS' END AS label FROM graded UNION ALL SELECT item_key, annotator, candidate_label FROM ledgers),
 voted AS (SELECT * FROM (SELECT item_key, """ + ", ".join(
    f"max(CASE WHEN annotator = '{v}' AND label IN ('PURE', 'FLOSS') THEN label END) AS {v}" for v in VOTERS
) + " FROM votes GROUP BY item_key) WHERE " + " AND ".join(f"{v} IS NOT NULL" for v in VOTERS) + ")"


def _consensus_sql() -> str:
    from itertools import combinations

    def same(m):
        return " AND ".join(f"{m[0]} = {x}" for x in m)

    rows = [("breakdown", "total_agreement", same(VOTERS)),
            ("breakdown", "total_disagreement", f"NOT ({same(VOTERS)})")]
    rows += [("breakdown", f"agreement_{v}", f"{same(VOTERS)} AND tool = '{v}'") for v in ("PURE", "FLOSS")]
    for k in range(1, 5):
        rows += [(f"subset_{k}", " + ".join(m), same(m)) for m in combinations(VOTERS, k)]
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS kind, '{b}' AS members, count(*) FILTER (WHERE {w}) AS agreements, count(*) AS total,
            round(count(*) FILTER (WHERE {w}) / count(*)::DOUBLE * 100, 2) AS agreement_pct FROM voted"""
        for a, b, w in rows)


_FLOSS_VOTES = " + ".join(f"({v} = 'FLOSS')::INT" for v in VOTERS)
_MAJORITY = "SELECT annotator, n AS total, p AS pure, f AS floss, n - p - f AS undecided, " \
    "round(p / n::DOUBLE, 3) AS pure_share, round(f / n::DOUBLE, 3) AS floss_share, " \
    "round(p / n::DOUBLE * 100, 2) AS pure_pct, round(f / n::DOUBLE * 100, 2) AS floss_pct FROM (" + " UNION ALL ".join(
        [f"SELECT '{v}' AS annotator, count(*) AS n, count(*) FILTER (WHERE {v} = 'PURE') AS p, "
         f"count(*) FILTER (WHERE {v} = 'FLOSS') AS f FROM voted" for v in VOTERS]
        + [f"SELECT 'consensus', count(*), count(*) FILTER (WHERE 4 - ({_FLOSS_VOTES}) > 2), "
           f"count(*) FILTER (WHERE ({_FLOSS_VOTES}) > 2) FROM voted"]) + ")"


def size_histogram(spark, d):
    return G.size_histogram(V.table(spark, d, "documents").select("n_chars"), "n_chars")


def run_summary(spark, d):
    return G.run_summary(_labelled_responses(spark, d))


def work_stats(spark, d):
    from accordance.plans.label_queries import boolean_worklist

    done = P.completed(V.ledger(spark, d)).select("item_key")
    return G.work_stats(boolean_worklist(spark, d), done)


def session_summary(spark, d):
    analyses = V.ledger(spark, d).withColumnRenamed("project_name", "session_id").where("candidate_label IS NOT NULL")
    return G.session_summary(analyses)


def export_stats(spark, d):
    return G.export_stats(_with_repo(spark, d))


def export_repositories(spark, d):
    return G.repository_list(_with_repo(spark, d))


def expansion_check(spark, d):
    planned = P.completed(V.ledger(spark, d)).select("item_key")
    found = J.keep_keys(V.items(spark, d), planned, "after_key").select("after_key")
    return J.expansion_report(planned, found, "after_key")


def pattern_examples(spark, d):
    """Examples of each disagreement of each annotator."""
    wrong = compared(spark, d).where(~F.col("agreement"))
    return G.pattern_examples(wrong, ("annotator", "reference_label", "candidate_label")).select(
        "annotator", "item_key", "reference_label", "candidate_label", F.col("example_no").cast("bigint").alias("example_no")
    )


def top_k(spark, d):
    return G.top_k(V.items(spark, d), "project_name")


def _agg(n: str) -> str:
    return (f"SELECT {n}, count(*) AS total, count(*) FILTER (WHERE agreement) AS agreements, "
            "count(*) FILTER (WHERE agreement) / count(*)::DOUBLE * 100 AS agreement_pct FROM compared")


_MATCHES = """SELECT project_name, count(*) AS total_matches, count(*) FILTER (WHERE side = 1) AS before_matches,
   count(*) FILTER (WHERE side = 2) AS after_matches FROM (
     SELECT project_name, before_key AS k, 1 AS side FROM items UNION ALL SELECT project_name, after_key, 2 FROM items)
   WHERE k IN (SELECT item_key FROM graded) GROUP BY project_name"""

QUERIES = {
    "value_counts": (
        value_counts,
        sql("""SELECT candidate_label, count(*) AS n, count(*) / (sum(count(*)) OVER ())::DOUBLE * 100 AS pct FROM ledgers
               WHERE candidate_label IS NOT NULL GROUP BY 1""", "ledgers"),
    ),
    "value_counts_with_null": (
        value_counts_with_null,
        sql("""SELECT candidate_label, count(*) AS n, count(*) / (sum(count(*)) OVER ())::DOUBLE * 100 AS pct
               FROM ledgers GROUP BY 1""", "ledgers"),
    ),
    "tri_state": (
        tri_state,
        sql("""SELECT item_key, CASE WHEN bool_or(NOT label) THEN 'FALSE' WHEN bool_or(label) THEN 'TRUE' ELSE 'NONE' END
               AS resolved_label, count(*) FILTER (WHERE NOT label) AS n_false, count(*) FILTER (WHERE label) AS n_true,
               count(*) FILTER (WHERE label IS NULL) AS n_none FROM details GROUP BY item_key""", "details"),
    ),
    "resolve_ledger": (
        resolve_ledger,
        sql("""SELECT g.item_key, CASE WHEN r.item_key IS NULL THEN 'NOT_FOUND' WHEN r.reference_label = 'floss' THEN 'FALSE'
               WHEN r.reference_label = 'pure' THEN 'TRUE' ELSE 'NONE' END AS reference_label
               FROM graded g LEFT JOIN resolved r ON g.item_key = r.item_key""", "details", "alpha", extra=_OUTER),
    ),
    "match_report": (
        match_report,
        sql("""SELECT count(*) AS keys, count(r.item_key) AS matches FROM graded g
               LEFT JOIN resolved r ON g.item_key = r.item_key""", "details", "alpha", extra=_OUTER),
    ),
    "consolidate": (consolidate, sql("SELECT * FROM cons", "details", extra=_CONSOLIDATE.strip().lstrip(","))),
    "confusion": (
        confusion,
        sql("""SELECT reference_normalized, count(*) FILTER (WHERE candidate_label = 'PURE') AS "PURE",
               count(*) FILTER (WHERE candidate_label = 'FLOSS') AS "FLOSS" FROM compared GROUP BY 1""", "compared"),
    ),
    "confusion_margins": (
        confusion_margins,
        sql("""SELECT coalesce(reference_normalized, 'All') AS reference_normalized,
               coalesce(candidate_label, 'All') AS candidate_label, count(*) AS n FROM compared
               GROUP BY CUBE (reference_normalized, candidate_label)""", "compared"),
    ),
    "confusion_pct": (
        confusion_pct,
        sql("""SELECT reference_normalized, candidate_label, count(*) AS n,
               count(*) / (sum(count(*)) OVER (PARTITION BY reference_normalized))::DOUBLE * 100 AS row_pct
               FROM compared GROUP BY 1, 2""", "compared"),
    ),
    "confusion_sparse": (confusion_sparse, sql("SELECT * FROM sparse", "ledgers", extra=_SPARSE)),
    "confusion_2x2": (
        confusion_2x2,
        sql("""SELECT a.annotator, r.l AS reference_label, c.l AS candidate_label, coalesce(s.n, 0) AS n
               FROM (SELECT DISTINCT annotator FROM ledgers) a, (VALUES ('TRUE'), ('FALSE')) r(l), (VALUES ('TRUE'), ('FALSE')) c(l)
               LEFT JOIN sparse s ON s.annotator = a.annotator AND s.reference_label = r.l AND s.candidate_label = c.l""",
            "ledgers", extra=_SPARSE),
    ),
    "agreement_total": (
        agreement_total,
        sql("""SELECT count(*) AS total, count(*) FILTER (WHERE agreement) AS agreements,
               count(*) FILTER (WHERE NOT agreement) AS disagreements,
               count(*) FILTER (WHERE agreement) / count(*)::DOUBLE * 100 AS agreement_pct FROM compared""", "compared"),
    ),
    "comparison_summary": (
        comparison_summary,
        sql("""SELECT count(*) AS total, count(a.item_key) AS analysed, count(*) - count(a.item_key) AS not_analysed,
               count(*) FILTER (WHERE candidate_label = 'FLOSS') AS agreements,
               count(*) FILTER (WHERE candidate_label = 'PURE') AS disagreements,
               count(*) FILTER (WHERE candidate_label = 'PURE') AS pure, count(*) FILTER (WHERE candidate_label = 'FLOSS') AS floss,
               coalesce(count(*) FILTER (WHERE candidate_label = 'FLOSS') / nullif(count(a.item_key), 0)::DOUBLE * 100, 0) AS agreement_pct
               FROM resolved r LEFT JOIN (SELECT * FROM alpha WHERE candidate_label NOT IN ('FAILED', 'ERROR')) a
               ON r.item_key = a.item_key WHERE r.reference_label = 'floss'""", "details", "alpha", extra=_OUTER),
    ),
    "agreement_by_class": (
        agreement_by_class,
        sql(_agg("'reference' AS axis, reference_label AS label") + " GROUP BY reference_label UNION ALL "
            + _agg("'candidate', candidate_label") + " GROUP BY candidate_label", "compared"),
    ),
    "agreement_truth": (
        agreement_truth,
        sql("""SELECT annotator, t.l AS truth, coalesce(sum(n) FILTER (WHERE reference_label = t.l), 0)::BIGINT AS total,
               coalesce(sum(n) FILTER (WHERE reference_label = t.l AND candidate_label = t.l), 0)::BIGINT AS agree,
               coalesce(sum(n) FILTER (WHERE reference_label = t.l AND coalesce(candidate_label, '') <> t.l), 0)::BIGINT AS disagree
               FROM sparse, (VALUES ('TRUE'), ('FALSE')) t(l) GROUP BY annotator, t.l""", "ledgers", extra=_SPARSE),
    ),
    "model_summary": (
        model_summary,
        sql("SELECT annotator, " + ", ".join(
            f"coalesce(sum(n) FILTER (WHERE {w}), 0)::BIGINT AS {n}" for n, w in {
                "total_items": "true", "analysed": "candidate_label IS NOT NULL", "missing": "candidate_label IS NULL",
                "reference_true": "reference_label = 'TRUE'", "reference_false": "reference_label = 'FALSE'",
                "candidate_true": "candidate_label = 'TRUE'", "candidate_false": "candidate_label = 'FALSE'",
                "agreement_true_total": "reference_label = 'TRUE'",
                "agreement_true_agree": "reference_label = 'TRUE' AND candidate_label = 'TRUE'",
                "agreement_true_disagree": "reference_label = 'TRUE' AND coalesce(candidate_label, '') <> 'TRUE'",
                "agreement_false_total": "reference_label = 'FALSE'",
                "agreement_false_agree": "reference_label = 'FALSE' AND candidate_label = 'FALSE'",
                "agreement_false_disagree": "reference_label = 'FALSE' AND coalesce(candidate_label, '') <> 'FALSE'",
            }.items()) + " FROM sparse GROUP BY annotator", "ledgers", extra=_SPARSE),
    ),
    "summary_file": (
        summary_file,
        sql("""SELECT annotator AS model, annotator || '.csv' AS file, sum(n)::BIGINT AS total_commits_in_file,
               coalesce(sum(n) FILTER (WHERE candidate_label IS NOT NULL), 0)::BIGINT AS analyzed_by_model, """ + ", ".join(
            f"coalesce(sum(n) FILTER (WHERE {w}), 0)::BIGINT AS {n}" for n, w in {
                "purity_true": "reference_label = 'TRUE'", "purity_false": "reference_label = 'FALSE'",
                "llm_true": "candidate_label = 'TRUE'", "llm_false": "candidate_label = 'FALSE'",
                "agreement_true_total": "reference_label = 'TRUE'",
                "agreement_true_agree": "reference_label = 'TRUE' AND candidate_label = 'TRUE'",
                "agreement_true_disagree": "reference_label = 'TRUE' AND coalesce(candidate_label, '') <> 'TRUE'",
                "agreement_false_total": "reference_label = 'FALSE'",
                "agreement_false_agree": "reference_label = 'FALSE' AND candidate_label = 'FALSE'",
                "agreement_false_disagree": "reference_label = 'FALSE' AND coalesce(candidate_label, '') <> 'FALSE'",
            }.items()) + " FROM sparse GROUP BY annotator ORDER BY annotator", "ledgers", extra=_SPARSE),
    ),
    "membership": (
        membership,
        sql("""SELECT 'membership' AS section, CASE WHEN in_reference AND analysed THEN 'both' WHEN in_reference
               THEN 'only_reference' ELSE 'only_candidate' END AS label, count(*) AS n,
               count(*) FILTER (WHERE agreement) AS agreements FROM outer_flags GROUP BY 2
               UNION ALL SELECT 'reference', reference_label, count(*), count(*) FILTER (WHERE agreement)
               FROM outer_flags WHERE in_reference AND analysed GROUP BY 2
               UNION ALL SELECT 'candidate', candidate_label, count(*), count(*) FILTER (WHERE agreement)
               FROM outer_flags WHERE in_reference AND analysed GROUP BY 2""", "details", "alpha", extra=_OUTER),
    ),
    "repo_stats": (
        repo_stats,
        sql("""SELECT coalesce(nullif(regexp_extract(project, '/([^/]+)$', 1), ''), 'unknown') AS repo_name, count(*) AS total,
               count(*) FILTER (WHERE agreement) AS agreements,
               round(count(*) FILTER (WHERE agreement) / count(*)::DOUBLE, 3) AS agreement_rate,
               count(*) FILTER (WHERE reference_normalized = 'PURE') AS reference_pure,
               count(*) FILTER (WHERE candidate_label = 'PURE') AS candidate_pure FROM compared GROUP BY 1""", "compared"),
    ),
    "repo_matrix": (
        repo_matrix,
        sql("SELECT project_name AS repo_name, " + ", ".join(
            f"count(*) FILTER (WHERE candidate_label = '{s}') AS \"{s}\"" for s in STATUSES)
            + " FROM ledgers WHERE candidate_label IS NOT NULL GROUP BY 1", "ledgers"),
    ),
    "project_matches": (
        project_matches,
        sql(_MATCHES, "graded", "items"),
    ),
    "project_top": (
        project_top,
        sql(_MATCHES + " ORDER BY total_matches DESC, project_name LIMIT 1", "graded", "items"),
    ),
    "duplicate_report": (
        duplicate_report,
        sql("""SELECT sum(n)::BIGINT AS total_rows, count(*) AS distinct_keys, count(*) FILTER (WHERE n > 1) AS duplicated_keys,
               coalesce(max(n) FILTER (WHERE n > 1), 0) AS max_multiplicity,
               coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS rows_in_duplicates
               FROM (SELECT after_key, count(*) AS n FROM items GROUP BY 1)""", "items"),
    ),
    "duplicate_top": (
        duplicate_top,
        sql("SELECT after_key, count(*) AS n FROM items GROUP BY 1 HAVING n > 1 ORDER BY n DESC, after_key LIMIT 5", "items"),
    ),
    "patterns": (
        patterns,
        sql("""SELECT reference_label, candidate_label, count(*) AS n,
               count(*) / (sum(count(*)) OVER ())::DOUBLE * 100 AS share_pct
               FROM compared WHERE NOT agreement GROUP BY 1, 2""", "compared"),
    ),
    "dataset_stats": (
        dataset_stats,
        sql("""SELECT count(*) AS total, count(DISTINCT repo_name) AS repositories,
               count(*) FILTER (WHERE label = 'pure') AS pure, count(*) FILTER (WHERE label = 'floss') AS floss,
               count(*) FILTER (WHERE label = 'pure') / count(*)::DOUBLE * 100 AS pure_pct,
               count(*) FILTER (WHERE label = 'floss') / count(*)::DOUBLE * 100 AS floss_pct,
               (SELECT repo_name FROM scored GROUP BY 1 ORDER BY count(*) DESC, repo_name LIMIT 1) AS top_repository,
               sum(n_chars) / count(*)::DOUBLE AS mean_size,
               (SELECT confidence FROM scored GROUP BY 1 ORDER BY count(*) DESC, confidence LIMIT 1) AS common_confidence
               FROM scored""", extra=_SCORED),
    ),
    "combos": (
        combos,
        sql(f"SELECT {', '.join(A)}, count(*) AS n FROM united GROUP BY ALL ORDER BY n DESC, {', '.join(A)} LIMIT 10",
            "ledgers", extra=_UNITED),
    ),
    "model_coverage": (
        model_coverage,
        sql(" UNION ALL ".join(
            f"""SELECT '{a}' AS annotator, count(*) FILTER (WHERE {a} <> 'not_found') AS found, count(*) AS total,
                count(*) FILTER (WHERE {a} <> 'not_found') / count(*)::DOUBLE * 100 AS found_pct FROM united""" for a in A),
            "ledgers", extra=_UNITED),
    ),
    "ledger_coverage": (
        ledger_coverage,
        sql("""SELECT count(*) AS total, count(candidate_label) AS with_label, count(*) - count(candidate_label) AS without_label,
               count(*) FILTER (WHERE candidate_label NOT IN ('FAILED', 'ERROR')) AS completed,
               count(candidate_label) / count(*)::DOUBLE * 100 AS with_label_pct,
               (count(*) - count(candidate_label)) / count(*)::DOUBLE * 100 AS without_label_pct FROM alpha""", "alpha"),
    ),
    "status_breakdown": (
        status_breakdown,
        sql("""SELECT annotator, coalesce(candidate_label, 'NONE') AS status, reference_label, count(*) AS n
               FROM ledgers GROUP BY 1, 2, 3""", "ledgers"),
    ),
    "status_failed": (
        status_failed,
        sql("""SELECT annotator, candidate_label AS status, reference_label, count(*) AS n FROM ledgers
               WHERE candidate_label = 'FAILED' GROUP BY 1, 2, 3""", "ledgers"),
    ),
    "consensus_nway": (consensus_nway, sql(_consensus_sql(), "ledgers", extra=_VOTED)),
    "majority_table": (majority_table, sql(_MAJORITY, "ledgers", extra=_VOTED)),
    "size_histogram": (
        size_histogram,
        """SELECT CASE WHEN hi = lo THEN 0 ELSE least(floor((n_chars - lo) * 20 / (hi - lo)::DOUBLE), 19)::BIGINT END AS bin,
           count(*) AS n, min(n_chars) AS smallest, max(n_chars) AS largest
           FROM documents, (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents) GROUP BY 1""",
    ),
    "run_summary": (
        run_summary,
        sql("""SELECT count(*) FILTER (WHERE label = 'pure') AS pure, count(*) FILTER (WHERE label = 'floss') AS floss,
               count(*) AS total, count(*) FILTER (WHERE route = 'file') AS by_file,
               count(*) FILTER (WHERE route = 'direct') AS direct,
               floor(sum(n_chars) / count(*)::DOUBLE)::BIGINT AS mean_size FROM scored""", extra=_SCORED),
    ),
    "work_stats": (
        work_stats,
        sql("""SELECT count(*) AS total, count(a.item_key) AS already_done, count(*) - count(a.item_key) AS to_do,
               count(*) FILTER (WHERE a.item_key IS NULL AND NOT pure) AS floss_to_do,
               count(*) FILTER (WHERE a.item_key IS NULL AND pure) AS pure_to_do, count(*) FILTER (WHERE clash) AS conflicts
               FROM (SELECT item_key, bool_and(label) AS pure, bool_or(label) AND bool_or(NOT label) AS clash FROM details
                     WHERE label IS NOT NULL GROUP BY item_key) w
               LEFT JOIN (SELECT * FROM alpha WHERE candidate_label NOT IN ('FAILED', 'ERROR')) a ON w.item_key = a.item_key""",
            "details", "alpha"),
    ),
    "session_summary": (
        session_summary,
        sql("""SELECT project_name AS session_id, count(*) AS total, count(*) FILTER (WHERE candidate_label = 'PURE') AS pure,
               count(*) FILTER (WHERE candidate_label = 'FLOSS') AS floss,
               count(*) FILTER (WHERE candidate_label IN ('FAILED', 'ERROR')) AS failed,
               count(*) FILTER (WHERE (reference_label = 'TRUE' AND candidate_label = 'PURE')
                 OR (reference_label = 'FALSE' AND candidate_label = 'FLOSS')) AS agree,
               count(*) - count(*) FILTER (WHERE (reference_label = 'TRUE' AND candidate_label = 'PURE')
                 OR (reference_label = 'FALSE' AND candidate_label = 'FLOSS')) AS disagree
               FROM alpha WHERE candidate_label IS NOT NULL GROUP BY 1""", "alpha"),
    ),
    "export_stats": (
        export_stats,
        sql("""SELECT count(*) AS total_comparisons, count(*) FILTER (WHERE agreement) / count(*)::DOUBLE AS agreement_rate,
               count(*) FILTER (WHERE reference_normalized = 'PURE') AS reference_pure_count,
               count(*) FILTER (WHERE candidate_label = 'PURE') AS candidate_pure_count,
               count(DISTINCT project) AS repositories FROM compared""", "compared"),
    ),
    "export_repositories": (export_repositories, sql("SELECT DISTINCT project AS repository FROM compared", "compared")),
    "expansion_check": (
        expansion_check,
        sql("""SELECT count(*) AS planned_keys, count(f.after_key) AS found_keys, coalesce(sum(n), 0)::BIGINT AS found_rows,
               (coalesce(sum(n), 0) - count(*))::BIGINT AS difference, count(*) FILTER (WHERE n > 1) AS expanded_keys
               FROM (SELECT * FROM alpha WHERE candidate_label NOT IN ('FAILED', 'ERROR')) a
               LEFT JOIN (SELECT after_key, count(*) AS n FROM items GROUP BY 1) f ON a.item_key = f.after_key""",
            "alpha", "items"),
    ),
    "pattern_examples": (
        pattern_examples,
        sql("""SELECT annotator, item_key, reference_label, candidate_label, example_no FROM (
               SELECT *, row_number() OVER (PARTITION BY annotator, reference_label, candidate_label ORDER BY item_key) AS example_no
               FROM compared WHERE NOT agreement) WHERE example_no <= 2""", "compared"),
    ),
    "top_k": (
        top_k,
        sql("SELECT project_name, count(*) AS n FROM items GROUP BY 1 ORDER BY n DESC, project_name LIMIT 10", "items"),
    ),
}
