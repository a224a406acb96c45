"""Versions of a table as a log of changes, with a full copy now and then.

A version is a multiset of rows. What it changes against the one before is a signed count per
distinct row: rows that came have positive counts, rows that went negative ones. A
version is read from the newest full copy up to it and the changes since; the past (labels that
were lost, keys whose label changed) is read from the changes alone.

    path/changes/v=STAMP   the changed rows with their count in `_n`; counts as written once its
                           success mark is there
    path/full/v=STAMP      a full copy of that version; may be missing, and may be deleted

The functions have the names and arguments of those in `writers` that keep a full copy of
each version, so either module can store a ledger.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accordance.sources.writers import _folder

#: Versions between two full copies.
FULL_EVERY = 16
_N = "_n"


def _marked(spark: SparkSession, path: str) -> list[str]:
    root, fs = _folder(spark, path)
    if not fs.exists(root):
        return []
    marks = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")) or []
    return sorted(m.getPath().getParent().getName()[2:] for m in marks)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Finished versions, oldest first."""
    return _marked(spark, f"{path}/changes")


def full_copies(spark: SparkSession, path: str) -> list[str]:
    """Versions that have a full copy, oldest first."""
    known = set(versions(spark, path))
    return [v for v in _marked(spark, f"{path}/full") if v in known]


def _logs(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """The changes of some versions, with ``_v``; a column that a version did not know is NULL."""
    read = spark.read.option("basePath", f"{path}/changes").option("mergeSchema", True)
    rows = read.parquet(*[f"{path}/changes/v={v}" for v in wanted])
    return rows.select(*[c for c in rows.columns if c != "v"], F.regexp_extract("_metadata.file_path", r"/v=([^/]+)/", 1).alias("_v"))


def _aligned(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` with the columns of both, NULL where it has none."""
    missing = [f for f in like.schema if f.name not in df.columns and f.name not in (_N, "_v")]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})


def _counted(df: DataFrame, sign: int = 1) -> DataFrame:
    return df.groupBy(*df.columns).agg((F.count(F.lit(1)) * sign).alias(_N))


def _repeated(counted: DataFrame) -> DataFrame:
    """Each row as often as its count says."""
    whole = counted.where(F.col(_N) > 0)
    return whole.withColumn(_N, F.explode(F.sequence(F.lit(1), F.col(_N).cast("int")))).drop(_N)


def read_version(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """A version, the newest if none is named.

    Rows of the full copy that no later change touches pass a join with the changes, which Spark broadcasts
    while their files are small; only touched rows are counted.
    """
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no version {version or ''} under {path}")
    upto = version or known[-1]
    base = max((v for v in full_copies(spark, path) if v <= upto), default=None)
    since = [v for v in known if v <= upto and (base is None or v > base)]
    if base is not None and not since:
        return spark.read.parquet(f"{path}/full/v={base}")
    changes = _logs(spark, path, since).drop("_v")
    columns = [c for c in changes.columns if c != _N]
    net = changes.groupBy(*columns).agg(F.sum(_N).alias(_N))
    if base is None:
        return _repeated(net).select(*columns)
    full = _aligned(spark.read.parquet(f"{path}/full/v={base}"), changes)
    net = _aligned(net, full)
    columns = full.columns
    # the changes themselves, not their sums: files of a known size
    touched = _aligned(changes, full).select(*[F.col(c).alias(f"_t_{c}") for c in columns])
    same = [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in columns]
    kept = full.join(touched, same, "left_anti")
    again = _counted(full.join(touched, same, "left_semi")).unionByName(net.select(*columns, _N))
    return kept.unionByName(_repeated(again.groupBy(*columns).agg(F.sum(_N).alias(_N))))


def write_version(df: DataFrame, path: str, at: datetime | None = None, full_every: int = FULL_EVERY) -> str:
    """Write what ``df`` changes against the newest version; the first version is all additions.

    The input may be read from the newest version: no file is overwritten. Columns must not be maps or
    variants, which have no equality, nor begin with ``_t_`` or be named ``_n``. A column that ``df`` no longer has is kept, as NULL.
    """
    spark = df.sparkSession
    stamp = (at or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%S%f")
    known = versions(spark, path)
    if known and stamp <= known[-1]:
        raise ValueError(f"version {stamp} is not newer than {known[-1]}")
    if known:
        old = read_version(spark, path)
        new, old = _aligned(df, old), _aligned(old, df)
        signed = _counted(new).unionByName(_counted(old, -1))
        changes = signed.groupBy(*new.columns).agg(F.sum(_N).alias(_N)).where(F.col(_N) != 0)
    else:
        changes = _counted(df)
    changes.write.mode("errorifexists").parquet(f"{path}/changes/v={stamp}")
    full = full_copies(spark, path)
    if sum(v > full[-1] for v in [*known, stamp]) >= full_every if full else len(known) >= full_every:
        compact(spark, path)
    return stamp


def compact(spark: SparkSession, path: str) -> str:
    """Add a full copy of the newest version, from which later ones are read."""
    newest = versions(spark, path)[-1]
    if newest not in full_copies(spark, path):
        # what a job left half written is replaced
        read_version(spark, path, newest).write.mode("overwrite").parquet(f"{path}/full/v={newest}")
    return newest


def read_version_snapshots(spark: SparkSession, path: str, last: bool = False) -> DataFrame:
    """The past of the table in snapshot form, for recovery, from the changes alone.

    A row stands with the version that brought it (``source``, ``taken_at``); with ``last``, rows that went
    stand with the last version that still had them. For keys that have lost their label, the first of the
    former and the last of the latter are those that full copies of all earlier versions would give.
    """
    known = versions(spark, path)
    if not known[:-1]:
        raise FileNotFoundError(f"no earlier version under {path}")
    rows = _logs(spark, path, known if last else known[:-1])
    rows = rows.where(F.col(_N) < 0 if last else F.col(_N) > 0)
    before = F.create_map(*[F.lit(x) for pair in zip(known[1:], known) for x in pair])
    stamp = F.get(F.map_values(F.map_filter(before, lambda k, _: k == F.col("_v"))), F.lit(0)) if last else F.col("_v")
    return rows.select(*[c for c in rows.columns if c not in (_N, "_v")], stamp.alias("source"), stamp.alias("taken_at"))


def label_changes(spark: SparkSession, path: str, key: str = "item_key", label: str = "candidate_label") -> DataFrame:
    """``version``, key, ``old_label``, ``new_label`` and ``change`` (new, changed, removed) of each version
    after the first: the keys whose label the version changed. Only changes are read."""
    known = versions(spark, path)
    if len(known) < 2:
        raise FileNotFoundError(f"no second version under {path}")
    given = F.when(~F.col(label).isin("", "None"), F.col(label))
    sides = _logs(spark, path, known[1:]).groupBy(F.col("_v").alias("version"), F.col(key)).agg(
        F.max(F.when(F.col(_N) < 0, given)).alias("old_label"), F.max(F.when(F.col(_N) > 0, given)).alias("new_label")
    )
    old, new = F.col("old_label"), F.col("new_label")
    change = F.when(old.isNull() & new.isNotNull(), "new").when(new.isNull() & old.isNotNull(), "removed").when(old != new, "changed")
    return sides.withColumn("change", change).where(F.col("change").isNotNull())


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """``version``, rows that came and went, and rows of the version, from the changes alone."""
    known = versions(spark, path)
    rows = _logs(spark, path, known) if known else spark.createDataFrame([], f"{_N} long, _v string")
    per = rows.groupBy(F.col("_v").alias("version")).agg(
        F.coalesce(F.sum(F.when(F.col(_N) > 0, F.col(_N))), F.lit(0)).alias("came"),
        F.coalesce(-F.sum(F.when(F.col(_N) < 0, F.col(_N))), F.lit(0)).alias("went"),
    )
    every = spark.createDataFrame([(v,) for v in known], "version string").join(per, "version", "left")
    every = every.select("version", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("came", "went")])
    line = Window.orderBy("version").rowsBetween(Window.unboundedPreceding, 0)  # a row per version
    return every.withColumn("n_rows", F.sum(F.col("came") - F.col("went")).over(line))
