"""Near-duplicate documents with an LSH forest over MinHash signatures.

1. *Sets.* Each document becomes the set of its distinct word shingles, an id of that set
   and a MinHash signature. Documents with equal sets are one class from here on, so a
   group of copies is never compared with itself.
2. *Forest.* Every class appears once in each of `TREES` sorted orders; order t reads the
   signature from another place on. The orders are laid out by range, so a crowded region
   is spread over tasks like any other. Classes that share a longest common prefix of at
   least `DEPTH` values are neighbours. In a small region all of them are candidates. In a
   crowded one the depth adapts: a class meets its nearest neighbours in the order
   and the first class of the deepest prefix it shares with the one before.
   The nearest neighbours of the first `FIRST` orders are linked before, and what is one
   component by then is not compared again.
3. *Links.* Candidates whose signatures agree enough (four standard errors below the
   limit) are confirmed on the full sets, recomputed from the texts of only the classes
   that have candidates.
4. *Rest.* Regions in which not all pairs were compared, because they were crowded
   or cut by the border of a task, and which still hold several components, are finished
   exactly. Each of their classes is entered under its rarest shingles, so many that two
   sets similar enough share one of them. Under a shingle that joins several
   components, classes of different components meet in blocks and are confirmed or refused
   on their sets; a class that differs too much from its crowd has only rare shingles
   of its own and meets nobody. Pairs never leave their task; only links that join two
   components do. How rare a shingle is comes from a count table of fixed size: any order
   gives the same links, a coarse one only costs time.
5. *Components* of the links; the smallest doc_id of a component stands for it.

A pair at the limit shares no region in any order with probability
(1 - 0.8 ** 3) ** 16 = 1e-5, and outside the rest its signatures agree too little with
probability 1.2e-4; more similar pairs are lost far more rarely.

Classes carry a long number from the written class table on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordance.llm import common
from accordance.llm.components import components

HASHES, TREES, STEP, DEPTH, LONGEST = 64, 16, 4, 3, 12
#: Orders whose nearest neighbours are linked first.
FIRST = 4
#: Rows of a region that are compared with all others; neighbours beyond it.
SMALL, NEAR = 64, 2
#: Share of equal signature values from which a pair is confirmed on its sets.
AGREE = 0.6
BLOCK = 256
#: Slots of the table that counts shingles, and set values compared at once.
SLOTS, AT_ONCE = 1 << 21, 1 << 19
#: Characters of text a task holds as words at once.
CHARS = 1 << 19
_SETS = "doc_id long, n_shingles long, set_id binary, signature binary"


@lru_cache(2)
def _functions():
    import numpy as np

    rng = np.random.default_rng(20)
    a = rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(texts: list, k: int):
    """The sorted distinct shingle hashes of each text; an empty array without words."""
    import numpy as np

    from accordance.llm.words import BLANKS, grams, words_of

    hashes, counts = words_of(texts, BLANKS)
    ends = np.cumsum(counts)
    every = grams(hashes, k)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist()):
        if n >= k:
            out.append(np.unique(every[end - n : end - k + 1]))
        else:
            out.append(grams(hashes[end - n : end], n) if n else np.zeros(0, np.uint64))
    return out


def set_id(values) -> bytes:
    from hashlib import blake2b

    return blake2b(values.tobytes(), digest_size=16).digest()


def signature(values):
    """`HASHES` 16-bit values, two sets agree in each with the probability of their similarity."""
    import numpy as np

    a, b = _functions()
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 2048):
        best = np.minimum(best, (values[i : i + 2048, None] * a + b).min(axis=0))
    return ((best >> np.uint64(40)) & np.uint64(0xFFFF)).astype(">u2")


def few(batches: Iterator) -> Iterator[list[tuple]]:
    """(id, text) of Arrow batches, about `CHARS` characters at a time; a batch is never a list as a whole."""
    from accordance.llm.near_dup import CHARS

    for batch in batches:
        rows, held = [], 0
        for i, t in zip(batch.column(0), batch.column(1)):
            rows.append((i.as_py(), t.as_py()))
            held += len(rows[-1][1] or "")
            if held >= CHARS:
                yield rows
                rows, held = [], 0
        if rows:
            yield rows


def _set_rows(k: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from accordance.llm.near_dup import few, set_id, shingle_sets, signature

        for rows in few(batches):
            sets = shingle_sets([r[1] for r in rows], k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_id(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_id", "signature"],
            )

    return run


_TREES = "key binary, cid long, low binary, component long"
_PAIRS = "a long, b long"


def _tree_rows(trees: int):
    """Each class once per order: the order's key, the class, 8 bits of each signature value."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from accordance.llm.near_dup import HASHES, LONGEST, STEP

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, HASHES, 2)
            low = np.ascontiguousarray(sig[:, :, 1]).reshape(n, HASHES)
            short = [x.tobytes() for x in low]
            for t in range(trees):
                at = (t * STEP + np.arange(LONGEST)) % HASHES
                key = np.concatenate([np.full((n, 1), t, np.uint8), sig[:, at].reshape(n, 2 * LONGEST)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x.tobytes() for x in key], pa.binary()), batch.column(0),
                        pa.array(short, pa.binary()), batch.column(2),
                    ],
                    names=["key", "cid", "low", "component"],
                )

    return run


def _nearest(batches: Iterator) -> Iterator:
    """Of an ordered task, each class with the one right before it in its region."""
    import numpy as np
    import pyarrow as pa

    from accordance.llm import near_dup as nd

    base = 1 + 2 * nd.DEPTH
    last = None
    for batch in batches:
        a_out, b_out = [], []
        for key, sid, low in zip(*(batch.column(k).to_pylist() for k in ("key", "cid", "low"))):
            mine = np.frombuffer(low, np.uint8)
            if last and last[0][:base] == key[:base] and (last[2] == mine).sum() >= nd.AGREE * nd.HASHES:
                a_out.append(min(last[1], sid))
                b_out.append(max(last[1], sid))
            last = (key, sid, mine)
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


def _region(key: bytes, depth: int) -> bytes:
    return key[: 1 + 2 * depth]


def _neighbours(batches: Iterator) -> Iterator:
    """Candidate pairs (a, b) of an ordered task that are not of one component yet, and
    unfinished regions."""
    import numpy as np
    import pyarrow as pa

    from accordance.llm import near_dup as nd

    base = 1 + 2 * nd.DEPTH
    region, keys, ids, lows, comps = None, [], [], [], []
    leaders: dict[int, tuple] = {}
    a_out, b_out, regions = [], [], []
    first_region, crowded = None, False

    def flush():
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array(a_out + [None] * len(regions), pa.int64()), pa.array(b_out + [None] * len(regions), pa.int64()),
                pa.array([None] * len(a_out) + regions, pa.binary()),
            ],
            names=["a", "b", "region"],
        )
        a_out.clear(), b_out.clear(), regions.clear()
        return batch

    def unfinished(r):
        if r is not None:
            regions.append(r)

    for batch in batches:
        for key, sid, low, comp in zip(*(c.to_pylist() for c in batch.columns)):
            r = key[:base]
            if r != region:
                if crowded or region is not None and region == first_region:
                    unfinished(region)  # crowded, or perhaps begun in the task before
                first_region = r if region is None else first_region
                region, keys, ids, lows, comps, crowded = r, [key], [sid], [np.frombuffer(low, np.uint8)], [comp], False
                leaders = {d: (key, sid, lows[0], comp) for d in range(nd.DEPTH, nd.LONGEST + 1)}
                continue
            mine = np.frombuffer(low, np.uint8)
            if len(ids) < nd.SMALL and not crowded:
                others, table, of = ids, np.stack(lows), comps
            else:
                crowded = True
                keys, ids, lows, comps = keys[-nd.NEAR :], ids[-nd.NEAR :], lows[-nd.NEAR :], comps[-nd.NEAR :]
                last = keys[-1]
                depth = nd.DEPTH
                while depth < nd.LONGEST and last[: 3 + 2 * depth] == key[: 3 + 2 * depth]:
                    depth += 1
                heads = [leaders[depth]]
                others = ids + [h[1] for h in heads]
                table = np.stack(lows + [h[2] for h in heads])
                of = comps + [h[3] for h in heads]
                for d in range(depth + 1, nd.LONGEST + 1):
                    leaders[d] = (key, sid, mine, comp)
            if not crowded:
                last = keys[-1]
                for d in range(nd.DEPTH + 1, nd.LONGEST + 1):
                    if last[: 1 + 2 * d] != key[: 1 + 2 * d]:
                        leaders[d] = (key, sid, mine, comp)
            agree = (table == mine).sum(axis=1) >= nd.AGREE * nd.HASHES
            for k in np.flatnonzero(agree):
                o = others[k]
                if o != sid and of[k] != comp:
                    a_out.append(min(o, sid))
                    b_out.append(max(o, sid))
            keys.append(key), ids.append(sid), lows.append(mine), comps.append(comp)
        if len(a_out) > 1 << 14:
            yield flush()
    unfinished(region)  # may go on in the next task
    yield flush()


def _bitmap(ids: DataFrame, column: str, bits: int = 26) -> bytes:
    """Which hashes of a column occur, as a map of fixed size (2**bits bits)."""
    import numpy as np

    slot = F.pmod(F.xxhash64(column), F.lit(1 << bits))
    words = (
        ids.select(slot.alias("s"))
        .groupBy(F.shiftright("s", 6).cast("int").alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("v"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return out.tobytes()


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``cid`` and ``shingles`` of the wanted classes (``set_id``, ``doc_id``, ``cid``), from one document of each.

    A map of fixed size keeps most other texts from being read in Python; the join is exact.
    """
    import numpy as np

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_bitmap(wanted, "doc_id"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from accordance.llm.near_dup import few, set_id, shingle_sets

        known = np.frombuffer(shared.value, np.uint64)

        def chosen():
            for batch in batches:
                slot = batch.column(0).to_numpy().astype(np.int64)
                bit = (known[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)
                yield batch.filter(pa.array(bit == 1)).select([1, 2])

        for rows in few(chosen()):
            sets = shingle_sets([r[1] for r in rows], k)
            some = [(r[0], s) for r, s in zip(rows, sets) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in some], pa.int64()), pa.array([set_id(s) for _, s in some], pa.binary()),
                    pa.array([s.tobytes() for _, s in some], pa.binary()),
                ],
                names=["doc_id", "set_id", "shingles"],
            )

    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 26))
    sets = docs.select(slot.alias("slot"), "doc_id", "text").mapInArrow(common.thrifty(run), "doc_id long, set_id binary, shingles binary")
    # by set alone: a class may have no doc_id but null
    return sets.join(wanted.select("set_id", "cid"), "set_id").dropDuplicates(["set_id"]).select("cid", "shingles")


def _confirm(percent: int):
    def run(_key, left, right):
        import numpy as np
        import pyarrow as pa

        pairs = []
        if left.num_rows and right.num_rows:
            a = left.column("of")[0].as_py()
            one = np.frombuffer(left.column("one")[0].as_py(), np.uint64)
            for b, data in zip(right.column("b").to_pylist(), right.column("two").to_pylist()):
                two = np.frombuffer(data, np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * both >= percent * (len(one) + len(two) - both):
                    pairs.append((a, b))
        return pa.table(
            {"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())}
        )

    return run


def _sets_of(nodes: DataFrame, docs: DataFrame, carriers: DataFrame, k: int) -> DataFrame:
    wanted = common.written(carriers.join(nodes, "cid", "left_semi").select("set_id", "doc_id", "cid"))
    return common.written(_full_sets(docs, wanted, k))


def _links(candidates: DataFrame, docs: DataFrame, carriers: DataFrame, k: int, percent: int) -> DataFrame:
    """The candidate pairs that are similar enough on their full sets.

    A class with many candidates is dealt over groups of 256 partners, each with its set.
    """
    nodes = candidates.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    sets = _sets_of(nodes, docs, carriers, k)
    shares = candidates.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("shares"))
    salt = F.pmod(F.xxhash64("b"), F.col("shares")).cast("int")
    right = (
        candidates.join(shares, "a").select("a", "b", salt.alias("salt"))
        .join(sets.withColumnRenamed("cid", "b"), "b").select("a", "salt", "b", "shingles")
    )
    left = shares.join(sets.withColumnRenamed("cid", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), "shingles"
    )
    left, right = left.toDF("of", "share", "one"), right.toDF("a", "salt", "b", "two")
    both = left.groupBy("of", "share").cogroup(right.groupBy("a", "salt"))
    return both.applyInArrow(_confirm(percent), _PAIRS)


def _weights(sets: DataFrame) -> bytes:
    """How often shingles occur in the sets, by the last bits of their hash: `SLOTS` 32-bit counts."""
    import numpy as np

    slots = SLOTS

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(slots, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(0).slice(at, 256)]
                slot, n = np.unique(np.concatenate(sets).astype(np.int64) & (slots - 1), return_counts=True)
                total[slot] += n
        some = np.flatnonzero(total)
        for at in range(0, len(some), 1 << 16):
            part = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["slot", "n"])

    counts = sets.select("shingles").mapInArrow(common.thrifty(run), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32).tobytes()


def rarest(values, weights, percent: int):
    """The rarest shingles of a set, so many that every set similar enough shares one of them.

    Sets that are similar enough share at least ``percent`` of the larger one, so of n shingles in any
    order all sets agree on, one of the first n - needed + 1 is shared.
    """
    import numpy as np

    n = len(values)
    order = np.lexsort((values, weights[values.astype(np.int64) & (len(weights) - 1)]))
    return values[order[: n - -(-percent * n // 100) + 1]]


def _entries(percent: int, shared):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from accordance.llm.near_dup import rarest

        weights = np.frombuffer(shared.value, np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                found = [rarest(np.frombuffer(x.as_buffer(), np.uint64), weights, percent) for x in some.column(2)]
                sizes = [len(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(some.column(0).to_numpy(), sizes)),
                        pa.array(np.repeat(some.column(1).to_numpy(), sizes)),
                        pa.array(np.concatenate([np.arange(n, dtype=np.int64) for n in sizes])),
                    ],
                    names=["shingle", "cid", "component", "place"],
                )

    return run


def _block_links(percent: int):
    """Links between two blocks of a shingle (or within one) that join two components.

    A pair is counted exactly unless it is joined by then or too little of its sets is left from
    this shingle on (then it is no link, or shares a rarer shingle and is counted there).
    Pairs never leave the task.
    """

    def run(_key, rows):
        import numpy as np
        import pyarrow as pa

        from accordance.llm import near_dup as nd

        side, ids, group, place = (rows.column(c).to_numpy().astype(np.int64) for c in ("side", "cid", "component", "place"))
        data = rows.column("shingles").combine_chunks()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in data]
        size = np.asarray([len(x) for x in sets], np.int64)
        left = size - place
        one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        a_out, b_out = [], []
        for i in one:
            open_ = two[
                (group[two] != group[i])
                & ((100 + percent) * np.minimum(left[two], left[i]) >= percent * (size[two] + size[i]))
                & ((side[i] != 2) | (two > i))
            ]
            step = max(1, nd.AT_ONCE // max(1, int(size[open_].max()))) if len(open_) else 1
            for at in range(0, len(open_), step):
                part = open_[at : at + step]
                flat = np.concatenate([sets[j] for j in part])
                where = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
                both = np.add.reduceat((sets[i][where] == flat).astype(np.int64), np.cumsum(size[part]) - size[part])
                for j in part[100 * both >= percent * (size[part] + size[i] - both)]:
                    if group[i] != group[j]:
                        a_out.append(min(ids[i], ids[j]))
                        b_out.append(max(ids[i], ids[j]))
                        group[group == group[j]] = group[i]
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return run


def _labelled(carriers: DataFrame, labels: DataFrame) -> DataFrame:
    named = labels.withColumnRenamed("node", "cid")
    return carriers.join(named, "cid", "left").withColumn("component", F.coalesce("component", "cid"))


def _rest(trees: DataFrame, regions: DataFrame, docs: DataFrame, carriers: DataFrame, k: int, percent: int) -> DataFrame:
    """Links in the unfinished regions that hold more than one component."""
    spark = docs.sparkSession
    rows = trees.select(F.substring("key", 1, 1 + 2 * DEPTH).alias("region"), "cid", "component")
    rows = common.written(rows.join(regions, "region", "left_semi"))
    mixed = rows.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    nodes = common.written(rows.join(mixed, "region", "left_semi").select("cid", "component").distinct())
    sets = _sets_of(nodes.select("cid"), docs, carriers, k)
    shared = spark.sparkContext.broadcast(_weights(sets))
    named = sets.join(nodes, "cid").select("cid", "component", "shingles")
    entries = common.written(named.mapInArrow(common.thrifty(_entries(percent, shared)), "shingle long, cid long, component long, place long"))
    # a large component of a shingle has blocks of its own, small ones share theirs; nothing is
    # compared where all are of one component
    per = entries.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n"))
    small = F.sum(F.when(F.col("n") < BLOCK, F.col("n")).otherwise(0))
    several = per.groupBy("shingle").agg(F.count(F.lit(1)).alias("components"), small.alias("small")).where("components > 1")
    large = F.col("n") >= BLOCK
    lanes = per.join(several, "shingle").select(
        "shingle", "component", F.when(large, F.col("component")).otherwise(-1).alias("lane"),
        F.ceil(F.when(large, F.col("n")).otherwise(F.col("small")) / BLOCK).alias("shares"),
    )
    block = F.pmod(F.xxhash64(F.when(F.col("lane") < 0, F.col("component")).otherwise(F.col("cid"))), F.col("shares"))
    dealt = common.written(
        entries.join(lanes, ["shingle", "component"]).select("shingle", "cid", "component", "place", F.struct("lane", block.alias("share")).alias("at"))
    )
    blocks = dealt.select("shingle", "at").distinct()
    pairs = blocks.withColumnRenamed("at", "i").join(blocks.withColumnRenamed("at", "j"), "shingle")
    pairs = pairs.where("i <= j and not (i.lane = j.lane and i.lane >= 0)")
    # side 2: a block with itself; 0 and 1: the two sides of a pair of blocks
    ends = pairs.select("shingle", "i", "j", F.explode(F.when(
        F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("at"), F.lit(2).alias("side")))
    ).otherwise(F.array(
        F.struct(F.col("i").alias("at"), F.lit(0).alias("side")), F.struct(F.col("j").alias("at"), F.lit(1).alias("side"))
    ))).alias("e")).select("shingle", "i", "j", F.col("e.at").alias("at"), F.col("e.side").alias("side"))
    met = ends.join(dealt, ["shingle", "at"]).join(sets, "cid")
    return met.groupBy("shingle", "i", "j").applyInArrow(_block_links(percent), _PAIRS).distinct()


COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def _classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Each row's ``doc_id``, ``n_shingles`` and ``set_id``; each class with its smallest
    ``doc_id`` and its component."""
    spark = docs.sparkSession
    common.ship(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = common.written(source.mapInArrow(common.thrifty(_set_rows(k)), _SETS))
    carriers = (
        sets.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"))
    )
    carriers = common.written(carriers.withColumn("cid", F.monotonically_increasing_id()))

    def forest(classes: DataFrame, trees: int) -> DataFrame:
        return classes.select("cid", "signature", "component").mapInArrow(common.thrifty(_tree_rows(trees)), _TREES)

    def ordered(rows: DataFrame) -> DataFrame:
        return rows.repartitionByRange(common.width(spark), "key").sortWithinPartitions("key")

    # the nearest neighbours of a few orders join most of a crowd before anything else is compared
    alone = carriers.withColumn("component", F.col("cid"))
    near = common.written(ordered(forest(alone, FIRST)).mapInArrow(common.thrifty(_nearest), _PAIRS).distinct())
    # written first: a task never holds two Python workers, one for the links and one for their components
    labels = components(common.written(_links(near, source, carriers, k, percent)))
    trees = forest(_labelled(carriers, labels), TREES)
    found = common.written(ordered(trees).mapInArrow(common.thrifty(_neighbours), f"{_PAIRS}, region binary"))
    candidates = common.written(found.where("a is not null").select("a", "b").distinct().join(near, ["a", "b"], "left_anti"))
    if not candidates.isEmpty():
        labels = components(labels.toDF("a", "b").union(common.written(_links(candidates, source, carriers, k, percent))))
    regions = found.where("region is not null").select("region").distinct()
    joined = forest(_labelled(carriers, labels), TREES)
    more = common.written(_rest(joined, regions, source, carriers, k, percent))
    if not more.isEmpty():
        labels = components(labels.toDF("a", "b").union(more))
    # the class of each component, then its smallest document
    return sets, _labelled(carriers, labels).select("set_id", "doc_id", "component")


def find_near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of each row of ``docs``.

    Words stand between white space, A-Z lowered; a text of fewer than ``k`` words is one
    shingle. A null text, or one without words, has an empty set, no links and itself as
    component. Rows with the same doc_id are separate rows; a component is named by
    its smallest doc_id, and rows with that doc_id are kept. A null doc_id gives null only where no
    other row of the component has one. Other columns are not read. Empty tables give no rows.
    """
    sets, named = _classes(docs, k, percent)
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = named.join(least, "component").select("set_id", "component_id")
    out = sets.select("doc_id", "n_shingles", "set_id").join(ids, "set_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return find_near_duplicates(common.table(spark, sf_dir, "documents"))


@common.carried("doc_id", "text")
def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class of near duplicates, with its own columns.

    Of a component the row with the smallest doc_id and set stays, a null doc_id only where there
    is no other. Of texts without words, rows that share doc_id and text are one document.
    """
    sets, named = _classes(docs, k, percent)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set_id")
    best = named.groupBy("component").agg(F.min(first).alias("best")).select("best.doc_id", "best.set_id")
    blank = sets.where("set_id is null").select("doc_id", "set_id").distinct()
    kept = common.written(best.union(blank).select(F.col("doc_id").alias("_kept"), F.col("set_id").alias("_of")))
    several = sets.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    several = common.written(several.select(F.col("doc_id").alias("_several")))
    own = docs["doc_id"].cast("long")
    if several.isEmpty():
        return docs.join(kept, own.eqNullSafe(kept["_kept"]), "left_semi")
    again = own.eqNullSafe(several["_several"])
    alone = docs.join(several, again, "left_anti").join(kept, own.eqNullSafe(kept["_kept"]), "left_semi")

    @F.pandas_udf("binary")
    def set_of(texts: pd.Series) -> pd.Series:
        from accordance.llm.near_dup import set_id, shingle_sets

        found = (shingle_sets([t or ""], k)[0] for t in texts)
        return pd.Series([set_id(x) if len(x) else None for x in found], dtype=object)

    rows = docs.join(several, again, "left_semi").withColumn("_set", set_of(F.col("text").cast("string")))
    rows = rows.join(kept, rows["doc_id"].cast("long").eqNullSafe(kept["_kept"]) & rows["_set"].eqNullSafe(kept["_of"]), "left_semi")
    rows = rows.withColumn("_blank", F.when(F.col("_set").isNull(), F.col("text")))
    return alone.union(rows.dropDuplicates(["doc_id", "_set", "_blank"]).select(*docs.columns))


_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS n, doc_id AS r FROM documents
  UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.n WHERE reach.r < l.b),
least AS (SELECT n, min(r) AS component_id FROM reach GROUP BY n)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d JOIN least l ON l.n = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id"""

QUERIES = {"op4_near_duplicates": (op4_near_duplicates, _SQL)}
