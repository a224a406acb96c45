"""Mixing sources to target weights by balanced sampling (the cube method).

1. Each source gets a share of the mix by weight, at most ``most`` times its size; what is above
   is shared again. A document is then wanted target / size of its source times: a whole number of
   times for sure, and the fraction is an inclusion probability.
2. Flight: the probabilities of a source's documents move together along directions that
   change neither the number of words nor the number of documents (the null space of these two
   constraints), until one of them is 0 or 1, and so on. Directions are followed to either side with odds that
   leave every probability what it was on average. The largest documents are settled first, each against all
   others of its portion; the rest go three at a time.
3. The flight runs in blocks of documents. A block leaves ``LEFT`` documents open; those of
   ``FAN`` blocks meet in the next round, and so on until a source is one block. A hot source is only more blocks.
4. There documents are settled until a landing problem of ``LANDING`` documents is left, of which
   the outcome with the nearest number of words is preferred, the odds still kept.

Only numbers travel: texts are read once, for their sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordance.llm import common
from accordance.operators.ordered import number_rows

WEIGHTS = (3, 1, 2)
#: Documents of a source per block of the first round, blocks per block of the next, documents left open by a block.
UNITS, FAN, LEFT = 4_096, 16, 256
#: Documents that are left to the landing, which looks at all their outcomes.
LANDING = 10
_EPS = 1e-9


# ---------------------------------------------------------------------------
# Targets


def shares(sources: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """``source``, ``source_size``, ``target`` from ``source`` and ``source_size`` (a row per source).

    Sources take the weights in turn, by code point, a null source last. The mix is ``percent`` of all sizes;
    targets stop at ``most`` times their source's size, and what is above is shared again by weight among the
    others until none is above (or all are full).
    """
    ordered = number_rows(sources, [F.col("source").isNull(), "source"], "_no")
    turn = F.array(*map(F.lit, weights))
    table = common.written(ordered.withColumn("_weight", F.get(turn, ((F.col("_no") - 1) % len(weights)).cast("int"))))
    full = F.col("source_size") * most
    level = 0.0
    while True:  # a round ends with at least one more full source, or is the last
        over = F.col("_weight") * F.lit(level) >= full
        row = table.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(over, full)).alias("full"), F.sum(F.when(~over, F.col("_weight"))).alias("weight")
        ).first()
        if not row["weight"]:
            break  # no source at all, or all are full
        now = (row["all"] * percent / 100 - (row["full"] or 0)) / row["weight"]
        if now <= level:
            break
        level = now
    target = F.least(full.cast("double"), F.col("_weight") * F.lit(float(level)))
    return table.select("source", "source_size", target.alias("target"))


# ---------------------------------------------------------------------------
# Flight and landing of one block


def _step(phi, u, draw: float):
    """Move along ``u`` to the border on one side or the other; the mean stays."""
    import numpy as np

    moving = u != 0
    p, d = phi[moving], u[moving]
    ahead = np.where(d > 0, (1 - p) / np.abs(d), p / np.abs(d)).min()
    back = np.where(d > 0, p / np.abs(d), (1 - p) / np.abs(d)).min()
    phi[moving] = p + d * (ahead if draw * (ahead + back) < back else -back)
    phi[phi < _EPS] = 0.0
    phi[phi > 1 - _EPS] = 1.0
    return phi


def fly(sizes: list[int], phi: list[float], draw: Callable[[], float], left: int) -> None:
    """Settle documents three at a time, in order, until ``left`` are open; changes ``phi``."""
    todo = iter(k for k, p in enumerate(phi) if 0 < p < 1)
    n_open = sum(0 < p < 1 for p in phi)
    active: list[int] = []
    while n_open > max(left, 2):
        while len(active) < 3:
            active.append(next(todo))
        a, b, c = active
        # orthogonal to (1, 1, 1) and to the sizes
        u = [sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b]]
        if not any(u):
            u = [1, -1, 0]
        ahead = min((1 - phi[k]) / d if d > 0 else -phi[k] / d for k, d in zip(active, u) if d)
        back = min(phi[k] / d if d > 0 else (phi[k] - 1) / d for k, d in zip(active, u) if d)
        move = ahead if draw() * (ahead + back) < back else -back
        for k, d in zip(active, u):
            p = phi[k] + d * move
            phi[k] = 0.0 if p < _EPS else 1.0 if p > 1 - _EPS else p
        active = [k for k in active if 0 < phi[k] < 1]
        n_open -= 3 - len(active)


def settle_largest(sizes: list[int], phi: list[float], draw: Callable[[], float], until: int) -> None:
    """Settle open documents, largest first and each against all others together, as long as both totals
    can be kept and more than ``until`` are open; changes ``phi``."""
    import numpy as np

    at = np.asarray([k for k, p in enumerate(phi) if 0 < p < 1], np.int64)
    at = at[np.argsort([-sizes[k] for k in at], kind="stable")] if len(at) else at
    s, p = np.asarray([sizes[k] for k in at], float), np.asarray([phi[k] for k in at])
    while len(s) > until:
        u = _direction(s, p)
        if u is None:
            break
        p = _step(p, u, draw())
        closed = (p == 0) | (p == 1)
        for k, x in zip(at[closed].tolist(), p[closed].tolist()):
            phi[k] = x
        at, s, p = at[~closed], s[~closed], p[~closed]
    for k, x in zip(at.tolist(), p.tolist()):
        phi[k] = x


def _direction(s, p):
    """A move of one of the first documents that can move, and of the others by their room, that keeps both
    totals; None if there is none."""
    import numpy as np

    rows = np.stack([np.ones(len(s)), s / max(1.0, s.max())])
    room = p * (1 - p)
    for k in range(min(len(s), 3)):
        w = room.copy()
        w[k] = 0.0
        x = np.linalg.lstsq((rows * w) @ rows.T, rows[:, k], rcond=1e-12)[0]
        u = -w * (x @ rows)
        u[k] = 1.0
        if np.abs(rows @ u).max() < 1e-7:
            return u
    return None


def land(sizes: list[int], phi: list[float], draw: Callable[[], float]) -> None:
    """Settle the last open documents, few enough to look at all outcomes; changes ``phi``.

    The probabilities are a mean of the outcome whose words come nearest to what is wanted and of a point
    on a border of the cube, where one more document is settled. Either is taken with its odds, so no probability
    changes on average.
    """
    import numpy as np

    at = [k for k, p in enumerate(phi) if 0 < p < 1]
    s, p = np.asarray([sizes[k] for k in at], float), np.asarray([phi[k] for k in at])
    words, documents = float(s @ p), float(p.sum())
    done = np.zeros(len(at), bool)
    while not done.all():
        n = int((~done).sum())
        some = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
        every = np.repeat(p[None, :], 1 << n, 0)
        every[:, ~done] = some
        # a document more or less counts as a word
        best = every[np.argmin(np.abs(every @ s - words) + np.abs(every.sum(1) - documents))]
        odds = float(np.where(best == 1, p, 1 - p)[~done].min())
        if draw() < odds or odds > 1 - _EPS:
            p = best
            break
        p = np.where(done, p, (p - odds * best) / (1 - odds))
        p[p < _EPS], p[p > 1 - _EPS] = 0.0, 1.0
        done = (p == 0) | (p == 1)
    for k, x in zip(at, p.tolist()):
        phi[k] = x


def _flights(seed: int, last: bool, of: int, left: int) -> Callable:
    """A task that runs the flight (and, in the last round, the landing) of its blocks, which come sorted."""

    def run(batches: Iterator) -> Iterator:
        import random

        import pyarrow as pa

        from accordance.llm.mixing import LANDING, fly, land, settle_largest

        key, rng = None, None
        held: list[pa.Table] = []

        def settled(final: bool):
            nonlocal held
            table = pa.concat_tables(held)
            phi, sizes = table["phi"].to_pylist(), table["size"].to_pylist()
            n_open = sum(0 < p < 1 for p in phi)
            if final and last:
                settle_largest(sizes, phi, rng.random, LANDING)
                fly(sizes, phi, rng.random, LANDING)
                land(sizes, phi, rng.random)
            elif n_open > left:
                # an eighth of what is to be settled, while the others can still make up for it
                settle_largest(sizes, phi, rng.random, n_open - (n_open - left) // 8)
                fly(sizes, phi, rng.random, left)
            table = table.set_column(table.schema.get_field_index("phi"), "phi", pa.array(phi, pa.float64()))
            opened = [0 < p < 1 for p in phi]
            held = [] if final else [table.filter(pa.array(opened))]
            return table if final else table.filter(pa.array([not o for o in opened]))

        def cut(batch):
            """Runs of rows of one block."""
            sources, blocks = batch["source"].to_pylist(), batch["block"].to_pylist()
            start = 0
            for k in range(1, batch.num_rows + 1):
                if k == batch.num_rows or (sources[k], blocks[k]) != (sources[start], blocks[start]):
                    yield (sources[start], blocks[start]), batch.slice(start, k - start)
                    start = k

        for batch in batches:
            for name, rows in cut(batch):
                if name != key:
                    if held:
                        yield from settled(True).to_batches()
                    held = []
                    key, rng = name, random.Random(f"{seed}:{of}:{name[0]!r}:{name[1]}")
                while rows.num_rows:  # the same portions of a block, wherever a batch ends
                    room = 16 * left - sum(t.num_rows for t in held)
                    held.append(pa.Table.from_batches([rows.slice(0, room)]))
                    if rows.num_rows >= room:
                        yield from settled(False).to_batches()
                    rows = rows.slice(room)
        if held:
            yield from settled(True).to_batches()

    return run


# ---------------------------------------------------------------------------
# The mix


def units(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None
) -> DataFrame:
    """``row`` (a number that tells rows apart, made here if no column has it), ``doc_id``, ``source``
    and ``size`` in words."""
    return docs.select(
        (F.monotonically_increasing_id() if row is None else F.col(row)).alias("row"),
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.regexp_count(common.text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
    )


def decide(
    table: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = 150, most: int = 2, seed: int = 11
) -> DataFrame:
    """The `units` of a written table with ``source_size``, ``target`` and ``copies``.

    Blocks are by hashes of the documents and their number is by the number of documents, and each block has
    its own random numbers, so reruns agree on any cluster.
    """
    spark = table.sparkSession
    common.ship(spark)
    sums = table.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    sources = common.written(sums)
    found = shares(sources.select("source", "source_size"), weights, percent, most)
    # a row per source: broadcast by Spark if it is small, else a join that may split a hot source
    targets = found.withColumnRenamed("source", "_s").join(sources.select(F.col("source").alias("_t"), "_n"), F.col("_s").eqNullSafe(F.col("_t")))
    wanted = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    mark = F.xxhash64(F.lit(seed), "doc_id", "size")
    blocks = F.ceil(F.col("_n") / UNITS)
    rows = table.join(targets, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        *table.columns, "source_size", "target", F.floor(wanted).alias("base"), (wanted - F.floor(wanted)).alias("phi"),
        F.pmod(F.xxhash64(mark), blocks).alias("block"), mark.alias("mark"),
    )
    n_blocks = sources.agg(F.max(F.ceil(F.col("_n") / UNITS))).first()[0] or 1
    done, opened = [], rows
    of = 0
    while True:
        last = n_blocks == 1
        dealt = opened.repartition(common.width(spark), "source", "block")
        sorted_ = dealt.sortWithinPartitions("source", "block", "mark", "doc_id", "size", "row")
        flown = common.written(sorted_.mapInArrow(_flights(seed, last, of, LEFT), rows.schema))
        is_open = (F.col("phi") > 0) & (F.col("phi") < 1)
        done.append(flown.where(~is_open))
        if last:
            break
        n_blocks, of = -(-n_blocks // FAN), of + 1
        opened = flown.where(is_open).withColumn("block", F.floor(F.col("block") / FAN))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select(*table.columns, "source_size", "target", (F.col("base") + F.col("phi").cast("long")).alias("copies"))


def planned(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``copies`` of every row of ``docs``.

    A null or empty text has size 0, and a source without words target 0. A null source is a source of its
    own, the last. Rows with one id, or none, are decided each for itself; rows equal in id, size and source
    are alike, so it does not show which of them are taken. Other columns are not read. An empty table
    gives no rows.
    """
    return decide(common.written(units(docs)), **options).drop("row")


def mixed(docs: DataFrame, copy: str = "copy", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns.

    ``copy`` counts the repeats of a row from 1; its name must not be among the columns of ``docs``. Odd
    rows as in `planned`. The documents are written once, with a number per row to join the decisions to.
    """
    if copy in docs.columns:
        raise ValueError(f"{copy} is a column of the documents")
    held = common.written(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")))
    numbers = units(held, "doc.doc_id", "doc.text", "doc.source", "row")
    decided = decide(common.written(numbers), **options).where("copies > 0").select(F.col("row").alias("_row"), "copies")
    joined = held.join(decided, F.col("row") == F.col("_row"))
    return joined.select("doc.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(copy))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    out = planned(common.table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


QUERIES = {"op11_source_mix": (op11_source_mix, None)}
