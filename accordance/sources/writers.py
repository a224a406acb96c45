"""Writing results: plain sinks, versioned ledgers, quarantine, export bundle."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordance.operators import agreement as G


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def safe_name(annotator):
    """Annotator id as a folder name."""
    return F.translate(annotator, ":", "_")


def write_by_annotator(df: DataFrame, path: str, mode: str = "append") -> None:
    """One folder per annotator, so that a reader prunes to the ones it wants."""
    df.withColumn("annotator", safe_name(F.col("annotator"))).write.mode(mode).partitionBy(
        "annotator"
    ).parquet(path)


def append_failures(failures: DataFrame, path: str) -> None:
    failures.write.mode("append").parquet(path)


def append_analysed(results: DataFrame, path: str) -> None:
    """Analysed log: results are only ever appended."""
    results.write.mode("append").parquet(path)


# ---------------------------------------------------------------------------
# Versioned tables


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[str]:
    """Finished versions of a table, oldest first. A version counts once its job has
    left the success mark, so a lost driver leaves no half version behind."""
    root, fs = _folder(spark, path)
    if not fs.exists(root):
        return []
    marks = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")) or []
    return sorted(m.getPath().getParent().getName()[2:] for m in marks)


def write_version(df: DataFrame, path: str, at: datetime | None = None) -> str:
    """Write the next version beside the earlier ones, which stay as snapshots.

    The input may well be read from the current version: no file is overwritten.
    """
    stamp = (at or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%S%f")
    known = versions(df.sparkSession, path)
    if known and stamp <= known[-1]:
        raise ValueError(f"version {stamp} is not newer than {known[-1]}")
    df.write.mode("errorifexists").parquet(f"{path}/v={stamp}")
    return stamp


def read_version(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no version under {path}")
    return spark.read.parquet(f"{path}/v={version or known[-1]}")


def read_version_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All earlier versions in snapshot form, for recovery."""
    known = versions(spark, path)[:-1]
    if not known:
        raise FileNotFoundError(f"no earlier version under {path}")
    read = spark.read.option("basePath", path).option("mergeSchema", True)
    rows = read.parquet(*[f"{path}/v={v}" for v in known])
    stamp = F.regexp_extract("_metadata.file_path", r"/v=([^/]+)/", 1)
    return rows.select(*[c for c in rows.columns if c != "v"], stamp.alias("source"), stamp.alias("taken_at"))


# ---------------------------------------------------------------------------
# Reports


def report_frame(compared: DataFrame, source: str, output: str) -> DataFrame:
    """The agreement report as one nested row."""
    totals = G.agreement_total(compared)
    # At most |labels|^2 cells, all counted before they meet here.
    cells = G.confusion_margins(compared, "reference_normalized", "candidate_label").agg(
        F.array_sort(
            F.collect_list(F.struct("reference_normalized", "candidate_label", "n"))
        ).alias("confusion_matrix")
    )
    return totals.withColumn("confusion_matrix", cells.scalar()).select(
        F.current_timestamp().alias("generated_at"),
        F.lit(source).alias("source"),
        F.lit(output).alias("output"),
        F.struct("*").alias("statistics"),
    )


def export_bundle(compared: DataFrame, sessions: DataFrame, path: str) -> dict[str, str]:
    """The comparison as CSV and JSON, its statistics, repositories and sessions.

    ``compared`` carries repository, repo_name, reference_normalized,
    candidate_label and agreement. It is kept in memory and on disk for the writers.
    """
    compared = compared.persist()
    try:
        parts = {
            "comparison_csv": (write_csv, compared),
            "comparison_json": (write_json, compared),
            "statistics": (write_json, G.export_stats(compared)),
            "repositories": (write_csv, G.repository_list(compared)),
            "repository_stats": (write_csv, G.repo_stats(compared)),
            "sessions": (write_json, sessions),
        }
        out = {}
        for name, (write, df) in parts.items():
            write(df, f"{path}/{name}")
            out[name] = f"{path}/{name}"
        return out
    finally:
        compared.unpersist()
