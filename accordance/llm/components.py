"""Connected components of a graph of links, by alternating stars.

A task takes in about `AT_ONCE` links and reduces them to stars, so few links need one round in
few tasks, whatever the number of shuffle partitions; more links need more tasks and further rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordance.llm import common

#: Links of a task; their nodes fit the memory of `_forest` together.
AT_ONCE = 1 << 18


def _forest(batches: Iterator) -> Iterator:
    """Links of one task reduced to stars; a link that adds nothing is left out."""
    import pyarrow as pa

    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1 << 20:  # bounded memory: what is known goes out, and is joined later
            yield _stars(parent, root, schema)
            parent.clear()
    if parent:
        yield _stars(parent, root, schema)


def _stars(parent, root, schema):
    import pyarrow as pa

    pairs = [(x, root(x)) for x in list(parent)]
    pairs = [(x, r) for x, r in pairs if x != r]
    return pa.RecordBatch.from_arrays(
        [pa.array([p[k] for p in pairs], schema.field(k).type) for k in (0, 1)], schema=schema
    )


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node that has a link.

    ``links`` has two columns of one orderable type; direction and repeats do not matter.
    A node joined to a third of all nodes is only ever aggregated by minimum or joined to
    one row, so it is no hot group. Each round is a written table.
    """
    common.ship(links.sparkSession)
    a, b = links.columns
    pairs = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges, tasks = _reduced(pairs)
    # the links of one task are stars
    while tasks > 1 and not _are_stars(edges):
        edges, tasks = _reduced(common.written(_small(_large(edges))))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _reduced(pairs: DataFrame) -> tuple[DataFrame, int]:
    """Stars of the links of each task, written, and how many tasks that were; ``pairs`` is read twice."""
    kind = pairs.schema["u"].dataType.simpleString()
    tasks = max(1, -(-pairs.count() // AT_ONCE))
    stars = pairs.coalesce(tasks).mapInArrow(_forest, f"u {kind}, v {kind}")
    return common.written(stars.distinct() if tasks > 1 else stars), tasks


def _are_stars(edges: DataFrame) -> bool:
    """Does every node stand on one side only, and on the left of one link only?"""
    left, right = F.lit(1).alias("left"), F.lit(0).alias("right")
    ends = edges.select(F.col("u").alias("n"), left, right).union(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("n").agg(F.sum("left").alias("left"), F.max("right").alias("right"))
    return seen.where("left > 1 or left > 0 and right > 0").isEmpty()


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest neighbour of that node."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v")))
