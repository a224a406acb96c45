"""Queries over batches, sessions, durations and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordance.operators import sections as N
from accordance.operators import telemetry as W
from accordance.plans import adapters as V
from accordance.plans.adapters import sql


def last_n_per_group(spark, d):
    return W.last_per_group(V.items(spark, d), "project_name", V.ITEM_ORDER).select(
        "project_name", "after_key", *V.ITEM_ORDER
    )


def dedupe_first(spark, d):
    """The filtered item list: last rows per project, then one row per after key."""
    last = W.last_per_group(V.items(spark, d), "project_name", V.ITEM_ORDER)
    return W.dedupe_first(last, "after_key", V.ITEM_ORDER)


def dedupe_report(spark, d):
    return W.dedupe_report(V.items(spark, d), "after_key")


def batch_timeline(spark, d):
    return W.batch_timeline(
        V.ledger(spark, d), ["item_key"], "candidate_label", ("PURE", "FLOSS")
    )


def ts_timeline(spark, d):
    ev = V.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = W.time_timeline(ev, "ts", "event_type", ("click", "view", "error"), "hour")
    return out.select(F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "click", "view", "error")


def cumulative(spark, d):
    return W.cumulative(V.sessions(spark, d)).select("session_id", "total_processed", "cumulative")


def session_rates(spark, d):
    return W.session_rates(V.sessions(spark, d)).select(
        "session_id", "duration_minutes", "success_pct", "items_per_minute"
    )


def last_sessions(spark, d):
    return W.last_sessions(V.sessions(spark, d)).select("session_id", "total_processed", "ok", "failed")


def progress_eta(spark, d):
    n = V.table(spark, d, "lineitem").agg(F.count(F.lit(1)))
    return W.progress(V.sessions(spark, d), n)


def degradation(spark, d):
    return W.degradation(V.durations(spark, d), "user_id", ["at_us", "event_id"], numbered=True).select(
        "user_id", "event_id", "duration", "item_no", "degraded", "marker"
    )


def half_drift(spark, d):
    return W.half_drift(V.durations(spark, d, size=True), "user_id", ["at_us", "event_id"], numbered=True)


def grade_rows(spark, d):
    durations = V.durations(spark, d, size=True)
    drift = W.half_drift(durations, "user_id", ["at_us", "event_id"], numbered=True)
    return W.grade_rows(durations, drift, "user_id").select("user_id", "event_id", "duration", "grade")


def sections(spark, d):
    docs = V.texts(spark, d, "documents", "doc_id", "text")
    return N.numbered_lines(docs, header="[A-E]")


_HALVES = """halves AS (SELECT user_id, count(*) FILTER (WHERE item_no <= n // 2) AS first_n,
   count(*) FILTER (WHERE item_no > n // 2) AS second_n,
   coalesce(sum(duration) FILTER (WHERE item_no <= n // 2) / nullif(count(*) FILTER (WHERE item_no <= n // 2), 0)::DOUBLE, 0) AS first_mean,
   coalesce(sum(duration) FILTER (WHERE item_no > n // 2) / nullif(count(*) FILTER (WHERE item_no > n // 2), 0)::DOUBLE, 0) AS second_mean
   FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS item_no,
         count(*) OVER (PARTITION BY user_id) AS n FROM durations) GROUP BY user_id)"""
_MIN = "((epoch_us(end_time) - epoch_us(start_time)) / 60000000::DOUBLE)"

QUERIES = {
    "last_n_per_group": (
        last_n_per_group,
        sql("""SELECT project_name, after_key, ord0, ord1, ord2, ord3 FROM (SELECT *, row_number() OVER (PARTITION BY project_name
               ORDER BY ord0 DESC, ord1 DESC, ord2 DESC, ord3 DESC) AS rn FROM items) WHERE rn <= 12""", "items"),
    ),
    "dedupe_first": (
        dedupe_first,
        sql("""SELECT * EXCLUDE (rn, rn2) FROM (SELECT *, row_number() OVER (PARTITION BY after_key ORDER BY ord0, ord1, ord2, ord3) AS rn2
               FROM (SELECT *, row_number() OVER (PARTITION BY project_name ORDER BY ord0 DESC, ord1 DESC, ord2 DESC, ord3 DESC) AS rn
               FROM items) WHERE rn <= 12) WHERE rn2 = 1""", "items"),
    ),
    "dedupe_report": (
        dedupe_report,
        sql("""SELECT count(*) AS rows_before, count(DISTINCT after_key) AS rows_after,
               count(*) - count(DISTINCT after_key) AS rows_removed FROM items""", "items"),
    ),
    "batch_timeline": (
        batch_timeline,
        sql("""SELECT batch_no, 'Batch ' || batch_no::VARCHAR AS batch, count(*) FILTER (WHERE candidate_label = 'PURE') AS "PURE",
               count(*) FILTER (WHERE candidate_label = 'FLOSS') AS "FLOSS" FROM (
               SELECT candidate_label, (row_number() OVER (ORDER BY item_key) - 1) // 10 + 1 AS batch_no FROM alpha) GROUP BY 1""",
            "alpha"),
    ),
    "ts_timeline": (
        ts_timeline,
        """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) FILTER (WHERE event_type = 'click') AS click,
           count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'error') AS error
           FROM events GROUP BY 1""",
    ),
    "cumulative": (
        cumulative,
        sql("""SELECT session_id, total_processed, sum(total_processed) OVER (ORDER BY start_time, session_id
               ROWS UNBOUNDED PRECEDING)::BIGINT AS cumulative FROM sessions""", "sessions"),
    ),
    "session_rates": (
        session_rates,
        sql(f"""SELECT session_id, {_MIN} AS duration_minutes, ok / total_processed::DOUBLE * 100 AS success_pct,
                coalesce(total_processed / nullif({_MIN}, 0), 0) AS items_per_minute FROM sessions""", "sessions"),
    ),
    "last_sessions": (
        last_sessions,
        sql("""SELECT session_id, total_processed, ok, failed FROM sessions
               ORDER BY start_time DESC, session_id DESC LIMIT 5""", "sessions"),
    ),
    "progress_eta": (
        progress_eta,
        sql("""SELECT total, done, total - done AS remaining, done / total::DOUBLE * 100 AS progress_pct,
               rate AS items_per_hour, (total - done) / rate AS hours_left FROM (
               SELECT (SELECT count(*) FROM lineitem) AS total, sum(ok)::BIGINT AS done,
               sum(ok)::DOUBLE / (sum(epoch_us(end_time) - epoch_us(start_time))::DOUBLE / 3600000000::DOUBLE) AS rate FROM sessions)""", "sessions"),
    ),
    "degradation": (
        degradation,
        sql("""SELECT user_id, event_id, duration, item_no, coalesce(duration > previous * 3, false) AS degraded, item_no % 8 = 0 AS marker
               FROM (SELECT *, row_number() OVER w AS item_no, lag(duration) OVER w AS previous FROM durations
               WINDOW w AS (PARTITION BY user_id ORDER BY at_us, event_id))""", "durations"),
    ),
    "half_drift": (
        half_drift,
        sql("""SELECT *, first_n > 0 AND second_mean > first_mean * 1.5::DOUBLE AS drifted FROM halves""", "durations", extra=_HALVES),
    ),
    "grade_rows": (
        grade_rows,
        sql("""SELECT d.user_id, event_id, duration, CASE WHEN duration > first_mean * 2::DOUBLE THEN 'bad'
               WHEN duration > first_mean * 1.5::DOUBLE THEN 'slow' ELSE 'ok' END AS grade
               FROM durations d JOIN halves h ON d.user_id = h.user_id""", "durations", extra=_HALVES),
    ),
    "sections": (
        sections,
        """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                          generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
           heads AS (SELECT *, (sum(regexp_matches(line, '^[A-E]')::INT) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS section_no FROM lines)
           SELECT doc_id, section_no, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY pos) AS line_no, line FROM heads""",
    ),
}
