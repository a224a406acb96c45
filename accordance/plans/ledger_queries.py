"""Queries over ledger maintenance and choosing work (M1-M9, L1-L4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordance.operators import ledger as M
from accordance.operators import scorer as K
from accordance.plans import adapters as V
from accordance.plans.adapters import sql
from accordance.plans.agreement_queries import sql_score


def _alpha(spark, d):
    return V.ledger(spark, d).select("item_key", "reference_label", "candidate_label")


def first_n_pending(spark, d):
    return M.first_pending(_alpha(spark, d), 20)


def shortfall(spark, d):
    return M.shortfall(_alpha(spark, d), 1_000_000)


def first_n_distinct(spark, d):
    none = V.ledgers(spark, d).where("reference_label = 'NONE'")
    return M.first_distinct(none, 500)


def sorted_keys(spark, d):
    return V.ledgers(spark, d).select("item_key").distinct().orderBy("item_key")


def label_increment(spark, d):
    return M.label_increment(
        _alpha(spark, d), V.responses(spark, d).select("item_key", "response"), reference="NONE"
    )


def increment_stats(spark, d):
    return M.increment_stats(label_increment(spark, d))


def batch_ids(spark, d):
    pending = _alpha(spark, d).where("candidate_label IS NULL")
    return M.with_batches(pending, 25).select("item_key", "row_no", "batch_no")


def bootstrap_ledger(spark, d):
    return M.bootstrap(
        V.graded(spark, d).select("item_key", "reference_label"), V.ledgers(spark, d), "gamma"
    )


def recover_first(spark, d):
    return M.recover(_alpha(spark, d), V.snapshots(spark, d))


def recover_last(spark, d):
    return M.recover(_alpha(spark, d), V.snapshots(spark, d), last=True)


def apply_recovery(spark, d):
    return M.apply_recovery(_alpha(spark, d), recover_first(spark, d))


def reset_labels(spark, d):
    return M.reset_labels(_alpha(spark, d))


def change_log(spark, d):
    """What differs between one annotator's ledger, recovered, and another's."""
    old = M.apply_recovery(_alpha(spark, d), recover_first(spark, d))
    return M.change_log(old, V.ledger(spark, d, "beta").select("item_key", "candidate_label"))


def random_pending(spark, d):
    return M.random_pending(_alpha(spark, d), 7)


def analysed_keys(spark, d):
    log = V.table(spark, d, "documents").select(
        F.when(F.col("doc_id") % 2 == 0, V.key_text("doc_id")).alias("commit2"),
        F.when(F.col("doc_id") % 3 == 0, V.key_text("doc_id")).alias("commit_hash_current"),
    )
    return M.analysed_keys(log)


def _answer(text: str) -> str | None:
    """A stand-in for a user's scorer that answers, stays silent or breaks."""
    n = len(text)
    if n % 11 == 0:
        raise ValueError("unreadable")
    return None if n % 7 == 0 else f"FINAL: {'PURE' if n % 2 == 0 else 'FLOSS'}"


def user_scorer(spark, d):
    asked = V.texts(spark, d, "documents", "doc_id", "text").select(
        V.key_text("doc_id").alias("item_key"), F.col("text").alias("request")
    )
    return K.ask_all(asked, _answer).select(
        "item_key", "response", "status", F.col("attempts").cast("bigint").alias("attempts"), "error"
    )


_INCREMENT = f"""incr AS (SELECT a.item_key, a.reference_label,
   CASE WHEN w THEN CASE WHEN r.response = '' THEN 'FAILED' ELSE upper({sql_score('r.response')}) END ELSE a.candidate_label END AS candidate_label,
   CASE WHEN w THEN CASE WHEN r.response = '' THEN 'failed' ELSE 'labelled' END ELSE 'kept' END AS outcome
   FROM (SELECT *, candidate_label IS NULL AND reference_label = 'NONE' AS w FROM alpha) a
   LEFT JOIN responses r ON a.item_key = r.item_key)"""
_FOUND = """found AS (SELECT item_key, {0}(candidate_label, taken_at) AS candidate_label, {0}(source, taken_at) AS source
   FROM snapshots WHERE candidate_label IS NOT NULL
   AND item_key IN (SELECT item_key FROM alpha WHERE candidate_label IS NULL) GROUP BY item_key)"""
_FIRST, _LAST = _FOUND.format("arg_min"), _FOUND.format("arg_max")

QUERIES = {
    "first_n_pending": (
        first_n_pending,
        sql("""SELECT item_key, reference_label, candidate_label FROM alpha WHERE candidate_label IS NULL
               ORDER BY item_key LIMIT 20""", "alpha"),
    ),
    "shortfall": (
        shortfall,
        sql("""SELECT count(*) AS pending, greatest(1000000 - count(*), 0) AS shortfall FROM alpha
               WHERE candidate_label IS NULL""", "alpha"),
    ),
    "first_n_distinct": (
        first_n_distinct,
        sql("SELECT DISTINCT item_key FROM ledgers WHERE reference_label = 'NONE' ORDER BY item_key LIMIT 500", "ledgers"),
    ),
    "sorted_keys": (sorted_keys, sql("SELECT DISTINCT item_key FROM ledgers ORDER BY item_key", "ledgers")),
    "label_increment": (label_increment, sql("SELECT * FROM incr", "alpha", "responses", extra=_INCREMENT)),
    "increment_stats": (
        increment_stats,
        sql("""SELECT count(*) FILTER (WHERE outcome <> 'kept') AS processed, count(*) FILTER (WHERE outcome = 'labelled') AS successful,
               count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'kept') AS skipped FROM incr""",
            "alpha", "responses", extra=_INCREMENT),
    ),
    "batch_ids": (
        batch_ids,
        sql("""SELECT item_key, row_no, (row_no - 1) // 25 + 1 AS batch_no FROM (SELECT item_key,
               row_number() OVER (ORDER BY item_key) AS row_no FROM alpha WHERE candidate_label IS NULL)""", "alpha"),
    ),
    "bootstrap_ledger": (
        bootstrap_ledger,
        sql("""SELECT item_key, reference_label, NULL::VARCHAR AS candidate_label, 'gamma' AS annotator FROM graded
               WHERE item_key NOT IN (SELECT item_key FROM ledgers WHERE annotator = 'gamma')""", "ledgers"),
    ),
    "recover_first": (recover_first, sql("SELECT * FROM found", "alpha", "snapshots", extra=_FIRST)),
    "recover_last": (recover_last, sql("SELECT * FROM found", "alpha", "snapshots", extra=_LAST)),
    "apply_recovery": (
        apply_recovery,
        sql("""SELECT a.item_key, a.reference_label, coalesce(a.candidate_label, f.candidate_label) AS candidate_label
               FROM alpha a LEFT JOIN found f ON a.item_key = f.item_key""", "alpha", "snapshots", extra=_FIRST),
    ),
    "reset_labels": (
        reset_labels, sql("SELECT item_key, reference_label, NULL::VARCHAR AS candidate_label FROM alpha", "alpha"),
    ),
    "change_log": (
        change_log,
        sql("""SELECT * FROM (SELECT coalesce(o.item_key, b.item_key) AS item_key, old_label, b.candidate_label AS new_label,
                 CASE WHEN old_label IS NULL AND b.candidate_label IS NOT NULL THEN 'new'
                      WHEN old_label IS NOT NULL AND b.candidate_label IS NULL THEN 'removed'
                      WHEN old_label <> b.candidate_label THEN 'changed' END AS change
               FROM (SELECT a.item_key, coalesce(a.candidate_label, f.candidate_label) AS old_label
                     FROM alpha a LEFT JOIN found f ON a.item_key = f.item_key) o
               FULL JOIN (SELECT * FROM ledgers WHERE annotator = 'beta') b ON o.item_key = b.item_key) WHERE change IS NOT NULL""",
            "alpha", "snapshots", extra=_FIRST),
    ),
    "random_pending": (
        random_pending,
        sql("""SELECT item_key, reference_label, candidate_label FROM alpha WHERE candidate_label IS NULL
               ORDER BY md5(item_key || ':7'), item_key LIMIT 1""", "alpha"),
    ),
    "analysed_keys": (
        analysed_keys,
        "SELECT printf('k%07d', doc_id) AS item_key FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0",
    ),
    "user_scorer": (
        user_scorer,
        """SELECT printf('k%07d', doc_id) AS item_key,
           CASE WHEN length(text) % 11 = 0 OR length(text) % 7 = 0 THEN NULL
                WHEN length(text) % 2 = 0 THEN 'FINAL: PURE' ELSE 'FINAL: FLOSS' END AS response,
           CASE WHEN length(text) % 11 = 0 THEN 'ERROR' WHEN length(text) % 7 = 0 THEN 'FAILED' ELSE 'OK' END AS status,
           CASE WHEN length(text) % 11 = 0 OR length(text) % 7 = 0 THEN 3 ELSE 1 END AS attempts,
           CASE WHEN length(text) % 11 = 0 THEN 'ValueError: unreadable' END AS error FROM documents""",
    ),
}
