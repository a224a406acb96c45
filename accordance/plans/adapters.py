"""Shapes of the engine derived from the given tables, as frames and as SQL.

Every shape covers its whole table and its whole texts; only the columns a query
uses are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordance.operators.telemetry import event_durations

ANNOTATORS = ("alpha", "beta", "gamma")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; how a scan is split is up to the session."""
    return table(spark, sf_dir, name).select(*columns)


def key_text(c: str | Column) -> Column:
    """`k` + id, padded with zeros to seven digits and never cut."""
    s = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.concat(F.lit("k"), F.when(F.length(s) < 7, F.lpad(s, 7, "0")).otherwise(s))


# ---------------------------------------------------------------------------
# Detail records: many tri-state records per order


_DETAIL_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus",
)
_ITEM_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    return texts(spark, sf_dir, "lineitem", *_DETAIL_COLUMNS).select(
        key_text("l_orderkey").alias("item_key"),
        F.when(F.col("l_returnflag") == "R", False)
        .when(F.col("l_returnflag") == "A", True)
        .alias("label"),
        F.when(part % 10 != 0, F.concat(F.lit("part "), (part % 25).cast("string"))).alias("detail"),
        F.col("l_linestatus").alias("kind"),
        F.col("l_linenumber").alias("ord1"),
        part.alias("ord2"),
        F.col("l_suppkey").alias("ord3"),
    )


DETAIL_ORDER = ("ord1", "ord2", "ord3")


def flawed_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail records some of whose keys are missing, empty or short."""
    n = F.col("l_orderkey") % 50
    return table(spark, sf_dir, "lineitem").select(
        F.when(n == 0, F.lit(None).cast("string"))
        .when(n == 1, "")
        .when(n == 2, "abc")
        .otherwise(key_text("l_orderkey"))
        .alias("item_key"),
        F.col("l_linenumber").alias("ord1"),
        F.col("l_partkey").alias("ord2"),
        F.col("l_suppkey").alias("ord3"),
    )


# ---------------------------------------------------------------------------
# Item list: before/after keys of a project


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    supp = F.col("l_suppkey")
    return texts(spark, sf_dir, "lineitem", *_ITEM_COLUMNS).select(
        F.concat(
            F.lit("https://example.org/org"), (supp % 7).cast("string"),
            F.lit("/repo"), supp.cast("string"),
        ).alias("project"),
        F.concat(F.lit("repo"), supp.cast("string")).alias("project_name"),
        key_text("l_partkey").alias("before_key"),
        key_text("l_orderkey").alias("after_key"),
        F.col("l_orderkey").alias("ord0"),
        F.col("l_linenumber").alias("ord1"),
        F.col("l_partkey").alias("ord2"),
        supp.alias("ord3"),
    )


ITEM_ORDER = ("ord0", "ord1", "ord2", "ord3")


# ---------------------------------------------------------------------------
# Ledgers: several annotators over the documents


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(marks, "doc_id", "left").select(
        "doc_id",
        "lang",
        key_text("doc_id").alias("item_key"),
        F.when(F.col("quality") == 1, "TRUE")
        .when(F.col("quality") == 0, "FALSE")
        .otherwise("NONE")
        .alias("reference_label"),
        F.concat(F.lit("https://example.org/"), F.col("lang"), F.lit("/"), F.col("source")).alias("project"),
        F.col("source").alias("project_name"),
        F.col("n_chars").cast("bigint").alias("n_chars"),
        "quality",
        "toxic",
    )


def _votes() -> dict[str, Column]:
    i, n = F.col("doc_id"), F.col("n_chars")
    null = F.lit(None).cast("string")
    return {
        "alpha": F.when(i % 13 == 0, null)
        .when(i % 17 == 0, "FAILED")
        .when(i % 101 == 0, "ERROR")
        .when(n % 3 == 0, "PURE")
        .otherwise("FLOSS"),
        "beta": F.when(i % 7 == 0, null)
        .when((F.col("quality") == 1) & (i % 5 != 0), "PURE")
        .otherwise("FLOSS"),
        "gamma": F.when(F.col("toxic") == 1, "FLOSS").when(n > 2000, "PURE").otherwise("FLOSS"),
    }


_LEDGER_COLUMNS = ("item_key", "reference_label", "project", "project_name", "n_chars")


# The third annotator does not know every language, so it lacks those keys.
_READS_GAMMA = "lang <> 'de'"


def ledger(spark: SparkSession, sf_dir: str, annotator: str = "alpha") -> DataFrame:
    base = graded(spark, sf_dir)
    if annotator == "gamma":
        base = base.where(_READS_GAMMA)
    return base.select(*_LEDGER_COLUMNS, _votes()[annotator].alias("candidate_label"))


def ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All annotators in long form, from one scan."""
    votes = _votes()
    rows = F.array_compact(
        F.array(
            *[
                F.when(
                    F.lit(True) if a != "gamma" else F.expr(_READS_GAMMA),
                    F.struct(F.lit(a).alias("annotator"), votes[a].alias("candidate_label")),
                )
                for a in ANNOTATORS
            ]
        )
    )
    return graded(spark, sf_dir).select(
        *_LEDGER_COLUMNS, F.inline(rows)
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two earlier copies of the whole alpha ledger; they hold labels it has lost."""
    i = F.col("doc_id")
    alpha = _votes()["alpha"]
    rows = F.array(
        *[
            F.struct(
                F.when(i % lost == 0, label).otherwise(alpha).alias("candidate_label"),
                F.lit(f"snapshot_{n}").alias("source"),
                F.lit(n).alias("taken_at"),
            )
            for n, lost, label in ((1, 26, "PURE"), (2, 13, "FLOSS"))
        ]
    )
    return table(spark, sf_dir, "documents").select(key_text("doc_id").alias("item_key"), F.inline(rows))


# ---------------------------------------------------------------------------
# Sessions and durations


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    bad = F.col("event_type") == "error"
    day = F.date_format("ts", "yyyy-MM-dd")
    return (
        ev.groupBy("user_id", day.alias("day"))
        .agg(
            F.min("ts").alias("start_time"),
            F.max("ts").alias("end_time"),
            F.count(F.lit(1)).alias("total_processed"),
            F.count_if(~bad).alias("ok"),
            F.count_if(bad).alias("failed"),
        )
        .select(
            F.concat_ws("_", F.lit("s"), F.col("user_id").cast("string"), "day").alias("session_id"),
            "start_time", "end_time", "total_processed", "ok", "failed",
        )
    )


def durations(spark: SparkSession, sf_dir: str, size: bool = False) -> DataFrame:
    """Microseconds since the user's previous event."""
    ev = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us")
    )
    return event_durations(ev, "user_id", ["at_us", "event_id"], "at_us", size)


# ---------------------------------------------------------------------------
# Responses: whole texts in the forms that annotators answer in


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, text, n = F.col("doc_id"), F.col("text"), F.col("n_chars")
    even = n % 2 == 0
    label = F.when(even, "pure").otherwise("floss")
    note = F.concat(F.lit("document "), i.cast("string"), F.lit(" has "), n.cast("string"), F.lit(" characters"))
    form = i % 7
    answer = (
        F.when(form == 0, F.concat(text, F.lit("\nFINAL: "), F.when(even, "PURE").otherwise("floss")))
        .when(
            form == 1,
            F.concat(
                F.lit("<think>"), text, F.lit('</think>{"refactoring_type": "'), label,
                F.lit('", "justification": "'), note, F.lit('", "confidence_level": "high"}'),
            ),
        )
        .when(
            form == 2,
            F.concat(
                F.lit("<think>"), text, F.lit('</think>\n```json\n{"refactoring_type": "floss", "justification": "'),
                note, F.lit('",}\n```'),
            ),
        )
        .when(form == 3, F.concat(F.lit("These are functional changes with new functionality.\n"), text))
        .when(form == 4, F.concat(F.lit("Only structural, no functional impact.\n"), text))
        .when(form == 5, "")
        .otherwise(text)
    )
    return texts(spark, sf_dir, "documents", "doc_id", "text", "source", "n_chars").select(
        key_text("doc_id").alias("item_key"),
        F.col("source").alias("repository"),
        n.cast("bigint").alias("n_chars"),
        answer.alias("response"),
    )


# ---------------------------------------------------------------------------
# The same shapes in SQL

_KEY = "printf('k%07d', {})"

VIEWS = {
    "details": f"""
      SELECT {_KEY.format('l_orderkey')} AS item_key,
             CASE l_returnflag WHEN 'R' THEN false WHEN 'A' THEN true END AS label,
             CASE WHEN l_partkey % 10 <> 0 THEN 'part ' || (l_partkey % 25)::VARCHAR END AS detail,
             l_linestatus AS kind, l_linenumber AS ord1, l_partkey AS ord2, l_suppkey AS ord3
      FROM lineitem""",
    "flawed_details": f"""
      SELECT CASE WHEN l_orderkey % 50 = 0 THEN NULL WHEN l_orderkey % 50 = 1 THEN ''
                  WHEN l_orderkey % 50 = 2 THEN 'abc' ELSE {_KEY.format('l_orderkey')} END AS item_key,
             l_linenumber AS ord1, l_partkey AS ord2, l_suppkey AS ord3
      FROM lineitem""",
    "items": f"""
      SELECT 'https://example.org/org' || (l_suppkey % 7)::VARCHAR || '/repo' || l_suppkey::VARCHAR AS project,
             'repo' || l_suppkey::VARCHAR AS project_name,
             {_KEY.format('l_partkey')} AS before_key, {_KEY.format('l_orderkey')} AS after_key,
             l_orderkey AS ord0, l_linenumber AS ord1, l_partkey AS ord2, l_suppkey AS ord3
      FROM lineitem""",
    "graded": f"""
      SELECT d.doc_id, d.lang, {_KEY.format('d.doc_id')} AS item_key,
             CASE l.quality WHEN 1 THEN 'TRUE' WHEN 0 THEN 'FALSE' ELSE 'NONE' END AS reference_label,
             'https://example.org/' || d.lang || '/' || d.source AS project,
             d.source AS project_name, d.n_chars, l.quality, l.toxic
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "ledgers": """
      SELECT doc_id, item_key, reference_label, project, project_name, n_chars, 'alpha' AS annotator,
             CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN 'FAILED'
                  WHEN doc_id % 101 = 0 THEN 'ERROR' WHEN n_chars % 3 = 0 THEN 'PURE'
                  ELSE 'FLOSS' END AS candidate_label
      FROM graded
      UNION ALL
      SELECT doc_id, item_key, reference_label, project, project_name, n_chars, 'beta',
             CASE WHEN doc_id % 7 = 0 THEN NULL
                  WHEN quality = 1 AND doc_id % 5 <> 0 THEN 'PURE' ELSE 'FLOSS' END
      FROM graded
      UNION ALL
      SELECT doc_id, item_key, reference_label, project, project_name, n_chars, 'gamma',
             CASE WHEN toxic = 1 THEN 'FLOSS' WHEN n_chars > 2000 THEN 'PURE' ELSE 'FLOSS' END
      FROM graded WHERE lang <> 'de'""",
    "alpha": "SELECT * FROM ledgers WHERE annotator = 'alpha'",
    "normal": """
      SELECT *, CASE reference_label WHEN 'TRUE' THEN 'PURE' WHEN 'FALSE' THEN 'FLOSS'
                     WHEN 'NONE' THEN 'UNKNOWN' END AS reference_normalized
      FROM ledgers""",
    # rows both sides have labelled, with the agreement flag
    "compared": """
      SELECT *, coalesce(reference_normalized = candidate_label, false) AS agreement
      FROM normal
      WHERE candidate_label IS NOT NULL AND candidate_label NOT IN ('FAILED', 'ERROR')""",
    "snapshots": """
      SELECT item_key, CASE WHEN doc_id % 26 = 0 THEN 'PURE' ELSE candidate_label END AS candidate_label,
             'snapshot_1' AS source, 1 AS taken_at FROM alpha
      UNION ALL
      SELECT item_key, CASE WHEN doc_id % 13 = 0 THEN 'FLOSS' ELSE candidate_label END,
             'snapshot_2', 2 FROM alpha""",
    "sessions": """
      SELECT 's_' || user_id::VARCHAR || '_' || strftime(ts, '%Y-%m-%d') AS session_id,
             min(ts) AS start_time, max(ts) AS end_time, count(*) AS total_processed,
             count(*) FILTER (WHERE event_type <> 'error') AS ok,
             count(*) FILTER (WHERE event_type = 'error') AS failed
      FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d')""",
    "durations": """
      SELECT user_id, event_id, at_us, at_us - prev_us AS duration FROM (
        SELECT user_id, event_id, epoch_us(ts) AS at_us,
               lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_us
        FROM events) WHERE prev_us IS NOT NULL""",
    "responses": f"""
      SELECT {_KEY.format('doc_id')} AS item_key, source AS repository, n_chars, doc_id % 7 AS form,
             doc_id, text,
             CASE doc_id % 7
               WHEN 0 THEN text || chr(10) || 'FINAL: ' || CASE WHEN n_chars % 2 = 0 THEN 'PURE' ELSE 'floss' END
               WHEN 1 THEN '<think>' || text || '</think>{{"refactoring_type": "'
                    || CASE WHEN n_chars % 2 = 0 THEN 'pure' ELSE 'floss' END
                    || '", "justification": "document ' || doc_id::VARCHAR || ' has ' || n_chars::VARCHAR
                    || ' characters", "confidence_level": "high"}}'
               WHEN 2 THEN '<think>' || text || '</think>' || chr(10) || '```json' || chr(10)
                    || '{{"refactoring_type": "floss", "justification": "document ' || doc_id::VARCHAR
                    || ' has ' || n_chars::VARCHAR || ' characters",}}' || chr(10) || '```'
               WHEN 3 THEN 'These are functional changes with new functionality.' || chr(10) || text
               WHEN 4 THEN 'Only structural, no functional impact.' || chr(10) || text
               WHEN 5 THEN '' ELSE text END AS response
      FROM documents""",
}

NEEDS = {
    "ledgers": ("graded",),
    "alpha": ("ledgers",),
    "normal": ("ledgers",),
    "compared": ("normal",),
    "snapshots": ("alpha",),
}


def sql(body: str, *views: str, extra: str = "") -> str:
    """A query over the shapes it names, each as a WITH clause."""
    order: list[str] = []

    def need(v: str) -> None:
        for d in NEEDS.get(v, ()):
            need(d)
        if v not in order:
            order.append(v)

    for v in views:
        need(v)
    parts = [f"{v} AS ({VIEWS[v]})" for v in order]
    if extra:
        parts.append(extra)
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
