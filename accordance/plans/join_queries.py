"""Queries over joins and key sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordance.functions import labels as L
from accordance.operators import agreement as G
from accordance.operators import compare as J
from accordance.operators import filters as P
from accordance.operators import resolve as R
from accordance.plans import adapters as V
from accordance.plans.adapters import sql

A = V.ANNOTATORS


def lookup_models(spark, d):
    keys = P.by_reference(V.graded(spark, d), "NONE").select("item_key", "reference_label")
    return J.lookup_annotators(keys, V.ledgers(spark, d), A)


def _resolved_kinds(spark, d):
    """Resolved reference label per order key, in candidate words."""
    return R.resolve_labels(V.details(spark, d)).select(
        "item_key",
        F.lower(L.map_label("resolved_label")).alias("reference_label"),
    )


def outer_compare(spark, d):
    cand = V.ledger(spark, d).select("item_key", F.lower("candidate_label").alias("candidate_label"))
    return J.outer_compare(_resolved_kinds(spark, d), cand)


_OUTER = """resolved AS (
  SELECT item_key, CASE WHEN bool_or(NOT label) THEN 'floss' WHEN bool_or(label) THEN 'pure'
         ELSE 'unknown' END AS reference_label FROM details GROUP BY item_key),
 outer_rows AS (
  SELECT coalesce(r.item_key, c.item_key) AS item_key,
         CASE WHEN r.item_key IS NULL THEN 'not_in_purity' ELSE r.reference_label END AS reference_label,
         CASE WHEN c.item_key IS NULL THEN 'not_analyzed'
              ELSE coalesce(lower(c.candidate_label), 'unknown') END AS candidate_label
  FROM resolved r FULL OUTER JOIN alpha c ON r.item_key = c.item_key),
 outer_flags AS (
  SELECT *, reference_label <> 'not_in_purity' AS in_reference, candidate_label <> 'not_analyzed' AS analysed,
         reference_label <> 'not_in_purity' AND candidate_label <> 'not_analyzed'
           AND reference_label = candidate_label AS agreement FROM outer_rows)"""


def resolved_matrix(spark, d):
    """Resolved reference label against candidate label, with margins."""
    done = P.completed(V.ledger(spark, d)).select("item_key", "candidate_label")
    details = V.details(spark, d).join(done.select("item_key"), "item_key", "left_semi")
    reference = R.resolve_labels(details).select(
        "item_key", L.map_label("resolved_label").alias("reference_label")
    )
    both = done.join(reference, "item_key")
    return G.confusion_margins(both)


def fixed_compare(spark, d):
    keys = R.resolve_labels(V.details(spark, d)).where("resolved_label = 'FALSE'").select("item_key")
    results = P.completed(V.ledger(spark, d)).select(
        "item_key", F.lower("candidate_label").alias("label"), F.col("project").alias("repository")
    )
    return J.fixed_compare(keys, results, texts=("repository",))


def semi_keys(spark, d):
    keys = P.completed(V.ledger(spark, d)).select("item_key")
    return J.keep_keys(V.items(spark, d), keys, "after_key").select(*V.ITEM_ORDER, "after_key", "project_name")


def anti_pending(spark, d):
    done = P.completed(V.ledger(spark, d)).select("item_key")
    return J.skip_keys(V.items(spark, d), done, "after_key").select(*V.ITEM_ORDER, "after_key")


def enrich_fallback(spark, d):
    keys = V.ledger(spark, d).select("item_key", "candidate_label")
    return J.enrich(keys, V.items(spark, d), V.ITEM_ORDER)


def enrich_whole(spark, d):
    """The all-or-nothing form of the fallback."""
    keys = V.ledger(spark, d).select("item_key", "candidate_label")
    return J.enrich(keys, V.items(spark, d), V.ITEM_ORDER, per_row=False)


def _first_item(side: str) -> str:
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {side}
        ORDER BY ord0, ord1, ord2, ord3) AS rn FROM items) WHERE rn = 1)"""


_ENRICH = """SELECT a.item_key, a.candidate_label,
  coalesce(b.project, f.project, 'unknown') AS project,
  coalesce(b.project_name, f.project_name, 'unknown') AS project_name
FROM alpha a LEFT JOIN """ + _first_item("before_key") + """ b ON a.item_key = b.before_key
LEFT JOIN """ + _first_item("after_key") + """ f ON a.item_key = f.after_key"""

_ENRICH_WHOLE = """SELECT a.item_key, a.candidate_label,
  coalesce(CASE WHEN h.hit THEN b.project ELSE f.project END, 'unknown') AS project,
  coalesce(CASE WHEN h.hit THEN b.project_name ELSE f.project_name END, 'unknown') AS project_name
FROM alpha a LEFT JOIN """ + _first_item("before_key") + """ b ON a.item_key = b.before_key
LEFT JOIN """ + _first_item("after_key") + """ f ON a.item_key = f.after_key
CROSS JOIN (SELECT count(*) > 0 AS hit FROM alpha WHERE item_key IN (SELECT before_key FROM items)) h"""


def either_key(spark, d):
    return J.either_key(V.graded(spark, d).select("item_key"), V.items(spark, d), V.ITEM_ORDER)


def first_lookup(spark, d):
    keys = V.graded(spark, d).select("item_key")
    return J.first_lookup(keys, V.items(spark, d), "after_key", V.ITEM_ORDER, ["before_key", "project_name"])


def _two_part_ledgers(spark, d):
    """Each annotator's ledger in two files: all keys, then a second one that
    overrides keys of graded documents with their reference label only."""
    first = V.ledgers(spark, d).select(
        "item_key", "annotator", "reference_label", "candidate_label", F.lit(1).alias("part")
    )
    second = (
        V.ledgers(spark, d)
        .where("reference_label = 'TRUE'")
        .select(
            "item_key", "annotator", "reference_label",
            F.when(F.col("candidate_label").isNull(), "PURE").otherwise(F.col("candidate_label")).alias("candidate_label"),
            F.lit(2).alias("part"),
        )
    )
    return first.unionByName(second)


def unite_models(spark, d):
    return J.unite_annotators(_two_part_ledgers(spark, d), A, ["part"])


_UNITED = """united AS (SELECT item_key, coalesce(lower(max(reference_label)), 'unknown') AS reference, """ + ", ".join(
    f"""CASE WHEN count(*) FILTER (WHERE annotator = '{a}') = 0 THEN 'not_found'
        ELSE coalesce(lower(max(CASE WHEN annotator = '{a}' THEN
             coalesce(candidate_label, CASE WHEN reference_label = 'TRUE' THEN 'PURE' END) END)), 'unlabelled')
        END AS {a}""" for a in A) + " FROM ledgers GROUP BY item_key)"


def top3_evidence(spark, d):
    return J.top_evidence(V.details(spark, d), V.DETAIL_ORDER, text="detail")


def patch_fill(spark, d):
    """Open rows take the label of the newest snapshot that has one."""
    led = V.ledger(spark, d).select("item_key", "reference_label", "candidate_label")
    return J.patch_fill(led, V.snapshots(spark, d), order=["taken_at"])


def _complete(spark, d):
    return V.ledger(spark, d, "beta").select("item_key", "candidate_label")


def diff_overwrite(spark, d):
    led = V.ledger(spark, d).select("item_key", "candidate_label")
    return J.diff_overwrite(led, _complete(spark, d))


SHORT_NAMES = ("alph", "bet", "delta", "a")


def contains_lookup(spark, d):
    summary = G.model_summary(G.confusion_sparse(V.ledgers(spark, d))).select("annotator", "total_items", "analysed")
    return J.contains_lookup(SHORT_NAMES, summary, ["annotator"])


def project_lookup(spark, d):
    """The first project address that contains a repository name, per name of the item and the graded lists."""
    items = V.items(spark, d).select(F.col("project_name").alias("short_name"))
    names = V.graded(spark, d).select(F.col("project_name").alias("short_name")).union(items)
    places = V.graded(spark, d).select("project", "lang").distinct()
    return J.contains_lookup(names, places, ["project", "lang"], "project")


# ---------------------------------------------------------------------------
# Key sets


def _after(spark, d):
    return V.items(spark, d).select("after_key")


def _before(spark, d):
    return V.items(spark, d).select("before_key")


def key_intersection(spark, d):
    return J.key_intersection(V.graded(spark, d).select("item_key"), _after(spark, d))


def intersection_report(spark, d):
    return J.intersection_report(V.graded(spark, d).select("item_key"), _after(spark, d))


def key_union(spark, d):
    return J.distinct_keys(_before(spark, d), _after(spark, d))


def overlap_report(spark, d):
    return J.overlap_report(V.graded(spark, d).select("item_key"), _before(spark, d), _after(spark, d))


def key_difference(spark, d):
    return J.key_difference(_before(spark, d), V.graded(spark, d).select("item_key"))


def concat_rows(spark, d):
    a = V.ledger(spark, d).select("item_key", "candidate_label")
    b = V.ledger(spark, d, "beta").select("item_key", "reference_label", "candidate_label")
    return J.concat_rows(a, b)


QUERIES = {
    "resolved_matrix": (
        resolved_matrix,
        sql("""SELECT coalesce(reference_label, 'All') AS reference_label,
               coalesce(candidate_label, 'All') AS candidate_label, count(*) AS n
               FROM (SELECT upper(r.reference_label) AS reference_label, a.candidate_label
                     FROM alpha a JOIN resolved r ON a.item_key = r.item_key
                     WHERE a.candidate_label NOT IN ('FAILED', 'ERROR'))
               GROUP BY CUBE (reference_label, candidate_label)""", "details", "alpha", extra=_OUTER),
    ),
    "lookup_models": (
        lookup_models,
        sql("""SELECT k.item_key, 'none' AS reference, """ + ", ".join(
            f"""CASE WHEN {a}.item_key IS NULL THEN 'not_found'
                ELSE coalesce(lower({a}.candidate_label), 'unlabelled') END AS {a}""" for a in A)
            + " FROM graded k " + " ".join(
            f"LEFT JOIN (SELECT * FROM ledgers WHERE annotator = '{a}') {a} ON k.item_key = {a}.item_key" for a in A)
            + " WHERE k.reference_label = 'NONE'", "ledgers"),
    ),
    "outer_compare": (outer_compare, sql("SELECT * FROM outer_flags", "details", "alpha", extra=_OUTER)),
    "fixed_compare": (
        fixed_compare,
        sql("""SELECT r.item_key, 'floss' AS reference_label,
               coalesce(lower(a.candidate_label), 'not_analyzed') AS candidate_label,
               coalesce(a.project, '') AS repository, coalesce(a.candidate_label = 'FLOSS', false) AS agreement
               FROM resolved r LEFT JOIN (SELECT * FROM alpha WHERE candidate_label NOT IN ('FAILED', 'ERROR')) a
               ON r.item_key = a.item_key WHERE r.reference_label = 'floss'""", "details", "alpha", extra=_OUTER),
    ),
    "semi_keys": (
        semi_keys,
        sql("""SELECT ord0, ord1, ord2, ord3, after_key, project_name FROM items WHERE after_key IN
               (SELECT item_key FROM alpha WHERE candidate_label NOT IN ('FAILED', 'ERROR'))""", "items", "alpha"),
    ),
    "anti_pending": (
        anti_pending,
        sql("""SELECT ord0, ord1, ord2, ord3, after_key FROM items WHERE after_key NOT IN
               (SELECT item_key FROM alpha WHERE candidate_label NOT IN ('FAILED', 'ERROR'))""", "items", "alpha"),
    ),
    "enrich_fallback": (enrich_fallback, sql(_ENRICH, "items", "alpha")),
    "enrich_whole": (enrich_whole, sql(_ENRICH_WHOLE, "items", "alpha")),
    "either_key": (
        either_key,
        sql("""SELECT k.item_key, e.project, e.before_key, e.after_key FROM graded k LEFT JOIN (
                 SELECT *, row_number() OVER (PARTITION BY side_key ORDER BY ord0, ord1, ord2, ord3) AS rn
                 FROM (SELECT before_key AS side_key, * FROM items UNION ALL SELECT after_key, * FROM items)) e
               ON k.item_key = e.side_key AND e.rn = 1""", "graded", "items"),
    ),
    "first_lookup": (
        first_lookup,
        sql("SELECT k.item_key, f.before_key, f.project_name FROM graded k LEFT JOIN "
            + _first_item("after_key") + " f ON k.item_key = f.after_key", "graded", "items"),
    ),
    "unite_models": (unite_models, sql("SELECT * FROM united", "ledgers", extra=_UNITED)),
    "top3_evidence": (
        top3_evidence,
        sql("""SELECT item_key, string_agg(detail, '; ' ORDER BY rn) AS evidence FROM (
                 SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY ord1, ord2, ord3) AS rn
                 FROM details WHERE detail IS NOT NULL) WHERE rn <= 3 GROUP BY item_key""", "details"),
    ),
    "patch_fill": (
        patch_fill,
        sql("""SELECT a.item_key, a.reference_label, coalesce(a.candidate_label, s.candidate_label) AS candidate_label
               FROM alpha a LEFT JOIN (SELECT item_key, arg_max(candidate_label, taken_at) AS candidate_label FROM snapshots
                 WHERE candidate_label IS NOT NULL GROUP BY item_key) s ON a.item_key = s.item_key""",
            "alpha", "snapshots"),
    ),
    "diff_overwrite": (
        diff_overwrite,
        sql("""SELECT a.item_key, a.candidate_label AS old_label,
               coalesce(b.candidate_label, a.candidate_label) AS candidate_label,
               CASE WHEN b.candidate_label IS NULL THEN 'absent' WHEN a.candidate_label IS NULL THEN 'new'
                    WHEN a.candidate_label <> b.candidate_label THEN 'changed' ELSE 'same' END AS change
               FROM alpha a LEFT JOIN (SELECT * FROM ledgers WHERE annotator = 'beta') b
               ON a.item_key = b.item_key""", "alpha"),
    ),
    "contains_lookup": (
        contains_lookup,
        sql("""SELECT n.short_name, s.annotator, s.total_items, s.analysed FROM (VALUES ('alph'), ('bet'), ('delta'), ('a'))
               n(short_name) LEFT JOIN (SELECT short_name, min(annotator) AS annotator FROM
                 (VALUES ('alph'), ('bet'), ('delta'), ('a')) m(short_name), (SELECT DISTINCT annotator FROM ledgers)
                 WHERE contains(annotator, short_name) GROUP BY short_name) p ON n.short_name = p.short_name
               LEFT JOIN (SELECT annotator, count(*) AS total_items, count(candidate_label) AS analysed
                 FROM ledgers GROUP BY annotator) s ON p.annotator = s.annotator""", "ledgers"),
    ),
    "project_lookup": (
        project_lookup,
        sql("""SELECT short_name, project, lang FROM (SELECT DISTINCT project_name AS short_name FROM graded UNION SELECT project_name FROM items) n
               LEFT JOIN (SELECT name, arg_min(lang, (project, lang)) AS lang, min(project) AS project FROM
                 (SELECT DISTINCT project_name AS name FROM graded UNION SELECT project_name FROM items) m,
                 (SELECT DISTINCT project, lang FROM graded) p WHERE contains(project, name) GROUP BY name) h ON n.short_name = h.name""",
            "graded", "items"),
    ),
    "key_intersection": (
        key_intersection,
        sql("SELECT item_key FROM graded INTERSECT SELECT after_key FROM items", "graded", "items"),
    ),
    "intersection_report": (
        intersection_report,
        sql("""SELECT l AS left_keys, r AS right_keys, c AS common_keys, c / l::DOUBLE * 100 AS left_pct,
               c / r::DOUBLE * 100 AS right_pct FROM (SELECT
                 (SELECT count(DISTINCT item_key) FROM graded) AS l,
                 (SELECT count(DISTINCT after_key) FROM items) AS r,
                 (SELECT count(*) FROM (SELECT item_key FROM graded INTERSECT SELECT after_key FROM items)) AS c)""",
            "graded", "items"),
    ),
    "key_union": (
        key_union,
        sql("SELECT before_key AS item_key FROM items UNION SELECT after_key FROM items", "items"),
    ),
    "overlap_report": (
        overlap_report,
        sql("""SELECT count(*) FILTER (WHERE k) AS keys, count(*) FILTER (WHERE a OR b) AS other_keys,
               count(*) FILTER (WHERE k AND (a OR b)) AS common, count(*) FILTER (WHERE k AND a) AS in_first,
               count(*) FILTER (WHERE k AND b) AS in_second, count(*) FILTER (WHERE k AND a AND b) AS in_both
               FROM (SELECT key, bool_or(side = 0) AS k, bool_or(side = 1) AS a, bool_or(side = 2) AS b FROM (
                 SELECT item_key AS key, 0 AS side FROM graded UNION ALL SELECT before_key, 1 FROM items
                 UNION ALL SELECT after_key, 2 FROM items) GROUP BY key)""", "graded", "items"),
    ),
    "key_difference": (
        key_difference,
        sql("SELECT before_key AS item_key FROM items EXCEPT SELECT item_key FROM graded", "graded", "items"),
    ),
    "concat_rows": (
        concat_rows,
        sql("""SELECT item_key, candidate_label, NULL::VARCHAR AS reference_label FROM alpha
               UNION ALL SELECT item_key, candidate_label, reference_label FROM ledgers WHERE annotator = 'beta'""",
            "alpha"),
    ),
}
