"""What the operators of this folder share: tables, code on executors, written tables."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application.

    The functions given to Spark import their helpers inside the task, so that what a
    worker has prepared (character classes, vocabularies) is kept from task to task.
    """
    sc = spark.sparkContext
    if getattr(sc, "_accordance_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="accordance-"), "accordance_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("accordance", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._accordance_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none, as in tests, gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/accordance-{uuid.uuid4().hex}"


def carried(*needed: str) -> Callable:
    """For a function from documents to some of them: it sees the ``needed`` columns only.

    All others travel with their row in one struct of numbered fields, whatever their names are, and
    come back as they were. Columns that are needed but not there are left out.
    """

    def wrap(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(run)
        def of(docs: DataFrame, *args, **options) -> DataFrame:
            names = docs.columns
            rest = [c for c in names if c not in needed]
            packed = F.struct(*[docs[c].alias(f"f{i}") for i, c in enumerate(rest)]).alias("_carried")
            out = run(docs.select(*[c for c in names if c in needed], *([packed] if rest else [])), *args, **options)
            return out.select(*[F.col(c) if c in needed else F.col("_carried")[f"f{rest.index(c)}"].alias(c) for c in names])

        return of

    return wrap


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """What this process has freed goes back to the system.

    Spark keeps idle workers for later tasks; without this each keeps the most that any task took.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library only
    if trim:
        trim(0)


def thrifty(run: Callable) -> Callable:
    """A task over batches that keeps no memory for the next one."""

    def task(batches: Iterator) -> Iterator:
        from accordance.llm.common import give_back

        yield from run(batches)
        give_back()

    return task


def thrifty_groups(run: Callable) -> Callable:
    """The same for a function of a key and two tables."""

    def task(key, left, right):
        from accordance.llm.common import give_back

        out = run(key, left, right)
        give_back()
        return out

    return task


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str | Column) -> Column:
    """A text, null read as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))
