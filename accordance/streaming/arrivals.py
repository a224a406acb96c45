"""Arriving response files are labelled as they land and upserted into a ledger.

A batch only writes its own labels and failures, each into a folder of its run and number,
so a batch that is run again replaces itself and the ledger is not rewritten per batch. A run
lives as long as its stream checkpoint. ``merge_arrivals`` brings all batches that were not
merged before into one new ledger version and notes them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordance import schemas as S
from accordance.schemas import FAILURE_STATUSES
from accordance.functions import labels as L
from accordance.operators import extract as E
from accordance.operators.ordered import first_per_key
from accordance.sources import writers as W

ARRIVAL = T.StructType(S.RESPONSE.fields + [T.StructField("arrived_at", T.TimestampType())])


def read_arrivals(
    spark: SparkSession, folder: str, max_files: int | None = None, schema: T.StructType = ARRIVAL
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(folder)


def _run_id(spark: SparkSession, checkpoint: str) -> str:
    """The name of a stream checkpoint's run, kept inside it."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/run_id")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        stream = fs.open(path)
        try:
            return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream)).readLine()
        finally:
            stream.close()
    name = uuid.uuid4().hex
    out = fs.create(path, False)
    try:
        out.write(bytearray(name.encode()))
    finally:
        out.close()
    return name


def label_arrivals(
    arrivals: DataFrame,
    work_path: str,
    checkpoint: str,
    label: Callable[[DataFrame], DataFrame] = E.cascade,
):
    """Start the job: all files there are, then stop. Progress is in ``checkpoint``."""

    run = _run_id(arrivals.sparkSession, checkpoint)

    def each(batch: DataFrame, batch_id: int) -> None:
        # One answer per key and batch: the latest to arrive.
        one = first_per_key(
            batch.where(F.col("item_key").isNotNull()),
            "item_key", ["arrived_at", "response"], last=True,
        )
        labelled = label(one).persist()
        try:
            labels = labelled.select(
                "item_key", "label", "status", "extraction_method", F.current_timestamp().alias("labelled_at")
            )
            part = f"run={run}/batch_id={batch_id}"
            labels.write.mode("overwrite").parquet(f"{work_path}/labels/{part}")
            E.failures(labelled).write.mode("overwrite").parquet(f"{work_path}/failures/{part}")
        finally:
            labelled.unpersist()

    return (
        arrivals.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def upsert(ledger: DataFrame, labelled: DataFrame, skip_labelled: bool = True) -> DataFrame:
    """Ledger with new labels (one row per key, with the ``batch_id`` that wrote it).

    A row that has a label keeps it, unless ``skip_labelled`` is off; a failed answer never
    replaces a label. All columns of the ledger stay; new keys have NULL in those not known.
    Merging a batch again changes nothing.
    """
    ok = F.col("status") == "ok"
    new = labelled.select(
        "item_key",
        F.when(ok, F.upper("label")).otherwise("FAILED").alias("_label"),
        F.coalesce(ok, F.lit(False)).alias("_ok"),
        F.col("batch_id").cast("bigint").alias("_batch"),
        F.lit(True).alias("_new"),
    )
    old = ledger if "batch_id" in ledger.columns else ledger.withColumn("batch_id", F.lit(None).cast("bigint"))
    old = old.withColumn("_known", F.lit(True))
    missing = L.is_pending("candidate_label")
    wanting = missing | F.col("candidate_label").isin(*FAILURE_STATUSES)
    takes = F.when(F.col("_ok"), wanting if skip_labelled else F.lit(True)).otherwise(missing)
    takes = F.coalesce(F.col("_new") & F.coalesce(takes, F.lit(True)), F.lit(False))
    given = {
        "candidate_label": F.when(takes, F.col("_label")).otherwise(F.col("candidate_label")),
        "batch_id": F.when(takes, F.col("_batch")).otherwise(F.col("batch_id")),
    }
    if "reference_label" in ledger.columns:
        given["reference_label"] = F.when(F.col("_known").isNull(), F.lit("NOT_FOUND")).otherwise(F.col("reference_label"))
    return old.join(new, "item_key", "full_outer").select(
        *[given.get(c, F.col(c)).alias(c) for c in old.columns if c != "_known"]
    )


def merge_arrivals(
    spark: SparkSession, ledger_path: str, work_path: str, skip_labelled: bool = True, storage: ModuleType = W
) -> str | None:
    """Write one ledger version with all batches not merged before; None if there is none.

    Of several batches with a key the last good answer counts, else the last one. ``storage`` keeps the
    ledger: `writers` as full copies, `changelog` as changes.
    """
    ledger = storage.read_version(spark, ledger_path)
    labels = spark.read.option("basePath", f"{work_path}/labels").parquet(f"{work_path}/labels")
    labels = labels.withColumn("run", F.col("run").cast("string"))
    merged = f"{work_path}/merged"
    path, fs = W._folder(spark, merged)
    if fs.exists(path):
        done = spark.read.schema("run string, batch_id long, version string").parquet(merged)
        labels = labels.join(done.select("run", "batch_id").distinct(), ["run", "batch_id"], "left_anti")
    batches = labels.select("run", F.col("batch_id").cast("bigint").alias("batch_id")).distinct().persist()
    try:
        if batches.isEmpty():
            return None
        ranked = labels.withColumn("_ok", F.coalesce((F.col("status") == "ok").cast("int"), F.lit(0)))
        latest = first_per_key(ranked, "item_key", ["_ok", "labelled_at", "run", "batch_id"], last=True)
        version = storage.write_version(upsert(ledger, latest, skip_labelled), ledger_path)
        batches.withColumn("version", F.lit(version)).write.mode("append").parquet(merged)
        return version
    finally:
        batches.unpersist()
