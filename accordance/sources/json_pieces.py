"""Elements of JSON files that are one large array, read in pieces by many tasks.

A file that is one JSON value is one row to Spark's JSON source. Here it is read as text that
ends at closing braces, so Spark cuts a file into blocks as it does with lines. Whether a
block starts inside a string, and how deep, follows from sums over the blocks before it; then
every piece knows its depth, and the pieces between two ends of top-level objects are one element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _outside(bare: Column, inside: bool) -> Column:
    """What stands outside strings, of a text without escapes that starts inside one or not."""
    return F.regexp_replace(F.concat(F.lit('"'), bare) if inside else bare, '"[^"]*("|$)', "")


def _pieces(spark: SparkSession, path) -> DataFrame:
    """The pieces in front of closing braces, with the depth they change by in both cases of their start."""
    meta = F.col("_metadata")
    rows = spark.read.option("lineSep", "}").text(path).select(
        meta["file_path"].alias("file"), meta["file_name"].alias("file_name"), meta["file_size"].alias("size"),
        meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"), "value",
    )
    # an escape never holds a brace, so no piece ends inside one
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    counted = rows.withColumn("_bare", bare).withColumn("quotes", _count(F.col("_bare"), '"'))
    for state in (0, 1):
        text = _outside(F.col("_bare"), bool(state))
        # the brace at the end counts where it stands outside strings
        closed = ((F.col("quotes") + state) % 2 == 0).cast("int")
        counted = counted.withColumn(f"delta{state}", _count(text, "{[") - _count(text, "]") - closed)
    return counted.drop("_bare")


def _sum_before(column: str | Column, window) -> Column:
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def json_elements(spark: SparkSession, path, larger_than: int = -1) -> DataFrame:
    """``file_name`` and ``record`` (variant) of every object in files of one object or one array.

    Of an array the objects count, nested ones not; order and repeats are kept as rows. A file that is
    not one valid value gives nothing. Only files of more than ``larger_than`` bytes are
    read. Neither a file nor a block is ever one value: what a task holds at once is an element.
    """
    pieces = _pieces(spark, path).where(F.col("size") > larger_than)
    here = Window.partitionBy("file", "block").orderBy("id")
    # the state at a piece's start, if the block starts outside strings
    placed = pieces.withColumn("_odd", _sum_before("quotes", here) % 2)
    opens = F.ltrim(F.regexp_replace("value", r"^[\ufeff\s]+", "")).startswith("[")
    deltas = [F.sum(F.when(F.col("_odd") == s, F.col("delta0")).otherwise(F.col("delta1"))).alias(f"d{s}") for s in (0, 1)]
    blocks = placed.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"), *deltas, F.min_by(opens.cast("int"), "id").alias("opens"),
        F.sum(F.octet_length("value") + 1).alias("bytes"), F.first("size").alias("size"),
    )
    line = Window.partitionBy("file").orderBy("block")  # a row per block
    blocks = blocks.withColumn("_state", _sum_before("quotes", line) % 2)
    blocks = blocks.withColumn("_delta", F.when(F.col("_state") == 0, F.col("d0")).otherwise(F.col("d1")))
    every = Window.partitionBy("file")
    starts = blocks.select(
        "file", "block", "_state", _sum_before("_delta", line).alias("_depth"),
        F.first("opens").over(line).alias("base"),
        # the last piece has no brace, unless the file ends with one
        F.when(F.sum("bytes").over(every) == F.col("size"), 0).otherwise(-1).alias("_wanted"),
        F.sum("_delta").over(every).alias("_reached"), (F.sum("quotes").over(every) % 2).alias("_open_string"),
    )
    right = starts.where("_wanted = _reached and _open_string = 0").drop("_wanted", "_reached", "_open_string")
    known = placed.join(right, ["file", "block"])
    delta = F.when((F.col("_odd") + F.col("_state")) % 2 == 0, F.col("delta0")).otherwise(F.col("delta1"))
    known = known.withColumn("_delta", delta)
    depth = F.col("_depth") + F.sum("_delta").over(here.rowsBetween(Window.unboundedPreceding, 0))
    outside = (F.col("_odd") + F.col("_state") + F.col("quotes")) % 2 == 0
    known = known.withColumn("_end", (outside & (depth == F.col("base"))).cast("int"))
    ends = known.groupBy("file", "block").agg(F.sum("_end").alias("n"))
    ends = ends.select("file", "block", _sum_before("n", line).alias("_ends"))
    numbered = known.join(ends, ["file", "block"]).withColumn("element", F.col("_ends") + _sum_before("_end", here))
    own = F.array_sort(F.collect_list(F.struct("block", "id", "value")))
    whole = numbered.groupBy("file", "file_name", "base", "element").agg(
        F.array_join(F.transform(own, lambda x: x["value"]), "}").alias("text"), (F.max("_end") == 1).alias("ended")
    )
    parsed = whole.select("file", "file_name", "ended", _parsed().alias("values"))
    bad = parsed.where("values is null").select("file").distinct()
    good = parsed.where("ended").join(bad, "file", "left_anti")
    rows = good.select("file_name", F.explode("values").alias("record"))
    return rows.where(F.schema_of_variant("record").startswith("OBJECT"))


def _parsed() -> Column:
    """The values of an element's text as an array, NULL if they are not valid.

    Scalars and nested arrays stand in front of the object they precede; what follows the last object has no end.
    """
    array, first = F.col("base") == 1, F.col("element") == 0
    text = F.regexp_replace("text", r"^\ufeff", "")
    closed = F.concat(text, F.lit("}"))

    def values(inner: Column) -> Column:
        return F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), inner, F.lit("]"))), "$", "array<variant>")

    def after(sign: str, of: Column) -> Column:
        return F.when(F.ltrim(F.regexp_replace(of, r"^\s+", "")).startswith(sign), F.regexp_replace(of, rf"^\s*\{sign}", ""))

    ended = F.when(array, values(F.when(first, after("[", closed)).otherwise(after(",", closed)))).when(first, values(closed))
    nothing = F.array().cast("array<variant>")
    # after the last object: the end of the array, perhaps behind other values; or nothing but white space
    blank = F.trim(F.regexp_replace(text, r"\s+", "")) == ""
    rest = F.regexp_extract(text, r"(?s)^\s*,(.*)\]\s*$", 1)
    tail = F.when(first, F.when(F.try_parse_json(text).isNotNull(), nothing))
    tail = tail.when(array & F.regexp_like(text, F.lit(r"^\s*\]\s*$")), nothing)
    tail = tail.when(array & (F.regexp_replace(rest, r"\s+", "") != ""), F.when(values(rest).isNotNull(), nothing))
    tail = tail.when(~array & blank, nothing)
    return F.when(F.col("ended"), ended).otherwise(tail)
