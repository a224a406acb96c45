"""Reading ledgers, detail records, answers, sessions and snapshots.

CSV files are read by the names in their own headers, all text as strings first; a value that
cannot be read is NULL and never stops the job.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordance import schemas as S
from accordance.functions import labels as L
from accordance.functions.common import non_empty

SNAPSHOT_TIME = "yyyy-MM-dd_HH-mm-ss"


def _file_name() -> Column:
    return F.col("_metadata.file_name")


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))


# ---------------------------------------------------------------------------
# CSV by the names in each file's own header

#: Files up to this size share tasks when first lines are looked for; longer ones get a task each,
#: which stops at the first line.
_SHORT_FILE = 1 << 20
#: Files whose positions are broadcast: some hundred bytes each.
_FEW_FILES = 50_000


def first_lines(spark: SparkSession, path: str | Sequence[str]) -> dict[str, str]:
    """The first line that is not blank of each file, by the path that Spark gives it.

    The tasks open the files. What comes to the driver is a line per file, as is the listing that Spark keeps there.
    """
    def one(batches: Iterator) -> Iterator:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    side = spark.newSession()  # how files are cut differs here, and only here
    lines = side.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    lines = lines.where(F.trim("value") != "")
    # ids ascend inside a file: a short one is never cut
    numbered = lines.where(F.col("size") <= _SHORT_FILE).withColumn("id", F.monotonically_increasing_id())
    short = numbered.groupBy("file").agg(F.min_by("value", "id").alias("value"))
    out = {r["file"]: r["value"] for r in short.collect()}
    # a file is a task of its own, never cut, and hands over one line at a time
    side.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 62))
    side.conf.set("spark.sql.files.openCostInBytes", str(1 << 61))
    side.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    long = lines.where(F.col("size") > _SHORT_FILE).select("file", "value").mapInArrow(one, "file string, value string")
    out.update((r["file"], r["value"]) for r in long.collect())
    return out


def _names(header: str, sep: str) -> list[str]:
    return next(csv.reader([header.lstrip("\ufeff")], delimiter=sep), [])


def _csv(
    spark: SparkSession, path: str | Sequence[str], fields: dict[str, Sequence[str]], sep: str = ",", **options
) -> DataFrame:
    """One scan of CSV files whose columns may differ in order, number and spelling.

    ``fields`` gives for each output column (a string) the header names it may have; the first of them that a
    file has and that is not empty counts, and a file with none of them reads NULL. ``_file``
    is the name of the file. Spark reads the files by position; a file's positions are joined to
    its rows by path, or written into the plan if all headers are alike.
    """
    try:
        found = first_lines(spark, path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no file under {path}") from e
        raise
    places: dict[str, list[list[int]]] = {}
    for header in set(found.values()):
        names = _names(header, sep)
        places[header] = [[names.index(n) for n in wanted if n in names] for wanted in fields.values()]
    width = max((len(_names(h, sep)) for h in places), default=0) or 1
    cells = [f"_c{k}" for k in range(width)]
    reader = spark.read.schema(", ".join(f"{c} string" for c in cells)).option("header", True).option("sep", sep)
    rows = reader.option("escape", '"').options(**options).csv(path)
    file_path, file_name = F.col("_metadata.file_path"), _file_name().alias("_file")

    def first(values: list[Column]) -> Column:
        return F.coalesce(*map(non_empty, values)) if values else F.lit(None).cast("string")

    if len({str(x) for x in places.values()}) <= 1:
        at = next(iter(places.values()), [[]] * len(fields))
        return rows.select(*[first([F.col(cells[k]) for k in own]).alias(n) for n, own in zip(fields, at)], file_name)
    kind = "_path string, " + ", ".join(f"_p{k} array<int>" for k in range(len(fields)))
    table = spark.createDataFrame([(f, *places[h]) for f, h in found.items()], kind)
    if len(found) <= _FEW_FILES:
        table = F.broadcast(table)  # beyond that many files Spark joins by a shuffle
    one = [
        F.get(F.filter(F.transform(f"_p{k}", lambda i: non_empty(F.get("_row", i))), lambda x: x.isNotNull()), F.lit(0)).alias(n)
        for k, n in enumerate(fields)
    ]
    joined = rows.select(F.array(*cells).alias("_row"), file_path.alias("_path"), file_name).join(table, "_path")
    return joined.select(*one, "_file")


def _csv_text(spark: SparkSession, path, names: Sequence[str], **options) -> DataFrame:
    """CSV files by column name, all strings; a column that a file lacks reads NULL."""
    return _csv(spark, path, {n: [n] for n in names}, **options).withColumnRenamed("_file", "file_name")


def read_ledger(spark: SparkSession, path) -> DataFrame:
    """Label ledger, labels canonical; a missing label column reads as NULL."""
    raw = _csv_text(spark, path, ["hash", "purity_analysis", "llm_analysis"])
    return raw.select(
        L.canonical("hash").alias("item_key"),
        L.canonical_label("purity_analysis").alias("reference_label"),
        L.canonical_label("llm_analysis").alias("candidate_label"),
    )


def read_items(spark: SparkSession, path) -> DataFrame:
    raw = _csv_text(spark, path, S.ITEM_FILE.fieldNames())
    return raw.select(
        F.col("ind").try_cast("bigint").alias("ind"),
        L.canonical("commit1").alias("before_key"),
        L.canonical("commit2").alias("after_key"),
        L.canonical("project").alias("project"),
        L.canonical("project_name").alias("project_name"),
    )


def read_details(spark: SparkSession, path) -> DataFrame:
    """`;` detail records from text lines: a line needs three fields and a key.

    ``state`` keeps the tri-state text, ``label`` is its boolean. Rows are split by
    hand because ragged rows must not lose their readable fields.
    """
    lines = spark.read.text(path).select("value", _file_name().alias("file_name"))
    parts = F.split(F.btrim("value", F.lit(" \t\r\n")), ";")
    cut = lines.select(parts.alias("p")).where(F.size("p") >= 3)
    names = S.DETAIL_FIELDS
    # The last field keeps whatever separators are left in the line.
    last = F.array_join(F.slice("p", len(names), F.greatest(F.size("p") - len(names) + 1, F.lit(0))), ";")
    fields = [F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names[:-1])]
    named = cut.select(
        *fields, F.when(F.size("p") >= len(names), last).alias(names[-1])
    )
    key = F.col("item_key")
    header = (key == "commit") & (F.col("state") == "purity")
    state = F.lower("state")
    return named.where((key != "") & (key != "None") & ~header).select(
        "item_key",
        F.when(state.isin("true", "false", "none"), state).otherwise("unusable").alias("state"),
        F.when(state == "true", True).when(state == "false", False).alias("label"),
        *[L.canonical(n).alias(n) for n in ("description", "kind", "detail")],
    )


def read_ledger_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All ledgers of a folder; the annotator is the file name without `.csv`."""
    raw = _csv(spark, f"{folder}/*.csv", {
        "item_key": ["hash"],
        "reference_label": ["purity_analysis", "purity", "purity_tool"],
        "candidate_label": ["llm_analysis", "model_label", "llm"],
    })
    return raw.select(
        F.regexp_extract("_file", r"^(.*)\.csv$", 1).alias("annotator"), F.col("_file").alias("file"),
        L.canonical("item_key").alias("item_key"), "reference_label", "candidate_label",
    )


def read_snapshots(spark: SparkSession, pattern: str) -> DataFrame:
    """Timestamped ledger copies with their source and the time in the name."""
    raw = _csv_text(spark, pattern, ["hash", "purity_analysis", "llm_analysis"])
    stamp = F.regexp_extract("file_name", r"backup_(?:[a-z_]*_)?([0-9_-]{19})$", 1)
    return raw.select(
        L.canonical("hash").alias("item_key"),
        L.canonical_label("llm_analysis").alias("candidate_label"),
        F.col("file_name").alias("source"),
        F.try_to_timestamp(stamp, F.lit(SNAPSHOT_TIME)).alias("taken_at"),
    )


def newest_path(
    spark: SparkSession, families: Sequence[str], by_name: bool = False
) -> str | None:
    """Newest file of the first family (a path pattern) that has any file.

    Only the listing is read: the content column is not selected.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    for family in families:
        pattern = fs_path(family)
        if not pattern.getFileSystem(conf).globStatus(pattern):
            continue
        files = spark.read.format("binaryFile").load(family).select("path", "modificationTime")
        order = [F.desc("path")] if by_name else [F.desc("modificationTime"), F.desc("path")]
        row = files.orderBy(*order).limit(1).first()
        if row is not None:
            return row["path"]
    return None


#: Comparison tables, in the order in which they are looked for (fixed values).
LEDGER_TABLE = "hashes_no_rpt_purity_with_analysis.csv"
DUAL_TABLES = "dual_classification_comparison_*.csv"
COMPARISON_TABLES = "purity_llm_comparison_*.csv"


def read_comparison(spark: SparkSession, folder: str, prefer_dual: bool = False) -> DataFrame:
    """The comparison of a folder: its ledger, else the newest comparison file.

    Columns: item_key, repository, project_name, reference_normalized, candidate_label,
    agreement. A ledger gives the rows that both sides have labelled. In a comparison
    file a missing label reads UNKNOWN, and texts may hold line breaks.
    """
    if _exists(spark, f"{folder}/{LEDGER_TABLE}"):
        rows = read_ledger(spark, f"{folder}/{LEDGER_TABLE}")
        both = rows.where(F.col("reference_label").isNotNull() & ~L.is_pending("candidate_label"))
        ref = F.col("reference_label")
        for old, new in S.REFERENCE_TO_CANDIDATE.items():
            ref = F.when(F.col("reference_label") == old, new).otherwise(ref)
        shaped = both.where("candidate_label <> 'FAILED'").select(
            "item_key", F.lit("multiple_repositories").alias("repository"), F.lit("mixed").alias("project_name"),
            ref.alias("reference_normalized"), F.upper("candidate_label").alias("candidate_label"),
        )
        agreement = F.coalesce(F.col("reference_normalized") == F.col("candidate_label"), F.lit(False))
        return shaped.withColumn("agreement", agreement)
    families = [f"{folder}/{DUAL_TABLES}"] * prefer_dual + [f"{folder}/{COMPARISON_TABLES}"]
    newest = newest_path(spark, families)
    if newest is None:
        raise FileNotFoundError(f"no comparison under {folder}")
    names = ["commit_hash", "hash", "repository", "project_name", "purity_classification", "llm_classification", "agreement"]
    raw = _csv_text(spark, newest, names, multiLine=True)
    ref, cand = (F.upper(F.coalesce(L.canonical(c), F.lit("UNKNOWN"))) for c in ("purity_classification", "llm_classification"))
    given = F.lower("agreement").try_cast("boolean") if prefer_dual else F.lit(None).cast("boolean")
    return raw.select(
        F.coalesce(L.canonical("commit_hash"), L.canonical("hash")).alias("item_key"), "repository", "project_name",
        ref.alias("reference_normalized"), cand.alias("candidate_label"), F.coalesce(given, ref == cand).alias("agreement"),
    )


def read_answers(spark: SparkSession, path) -> DataFrame:
    """Answer records from JSON files that hold one object or an array of them.

    Bad files are skipped; the whole record, unknown keys included, stays in the
    variant column ``record``.
    """
    docs = (
        spark.read.option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("singleVariantColumn", "doc")
        .json(path)
        .select("doc", _file_name().alias("file_name"))
    )
    many = F.try_variant_get("doc", "$", "array<variant>")
    rows = docs.where(F.col("doc").isNotNull()).select(
        "file_name", F.explode(F.coalesce(many, F.array("doc"))).alias("record")
    )
    fields = [
        F.try_variant_get("record", f"$.{f.name}", f.dataType.simpleString()).alias(f.name)
        for f in S.RESPONSE_RECORD.fields
    ]
    shape = F.schema_of_variant("record")
    return rows.where(shape.startswith("OBJECT")).select("file_name", *fields, "record")


def read_sessions(spark: SparkSession, path) -> DataFrame:
    """Session documents, one row per file, both array names accepted."""
    docs = (
        spark.read.option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .schema(S.SESSION_FILE)
        .json(path)
    )
    info = F.col("session_info")
    return docs.where(info.isNotNull()).select(
        _file_name().alias("session_id"),
        info["model_used"].alias("annotator"),
        F.try_to_timestamp(info["start_time"]).alias("start_time"),
        F.try_to_timestamp(info["end_time"]).alias("end_time"),
        *[
            F.coalesce(info[n], F.lit(0)).alias(a)
            for n, a in (
                ("total_processed", "total_processed"),
                ("successful_analyses", "ok"),
                ("failed_analyses", "failed"),
            )
        ],
        F.coalesce("analyses", "detailed_analyses").alias("items"),
    )


def session_analyses(sessions: DataFrame) -> DataFrame:
    """One row per analysed item of the sessions."""
    return sessions.select("session_id", "annotator", F.explode("items").alias("a")).select(
        "session_id",
        F.col("session_id").alias("file_name"),
        F.coalesce(F.col("annotator"), F.lit("unknown")).alias("annotator"),
        F.col("a.hash").alias("item_key"),
        F.upper("a.purity_classification").alias("reference_label"),
        F.col("a.llm_classification").alias("candidate_label"),
        F.col("a.llm_justification").alias("justification"),
        F.col("a.llm_raw_response").alias("response"),
        F.col("a.project_name").alias("project_name"),
        F.col("a.diff_size").alias("n_chars"),
    )


def decode_bytes(content: Column | str) -> Column:
    """UTF-8 text where the bytes are valid UTF-8, else Latin-1."""
    b = F.col(content) if isinstance(content, str) else content
    return F.when(F.is_valid_utf8(b.cast("string")), F.decode(b, "UTF-8")).otherwise(
        F.decode(b, "ISO-8859-1")
    )


def read_bytes(spark: SparkSession, path) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(
        "path", decode_bytes("content").alias("text")
    )
