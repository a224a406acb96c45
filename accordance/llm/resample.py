"""Resampling of documents towards a target corpus by importance weights of hashed word runs.

1. Features are runs of one and two words, hashed into buckets. Both corpora are counted by
   bucket; a bucket's gain compares its share in the target with its share in the documents.
2. The gains are an array with one place per bucket; a document's weight is the mean of its
   features' gains, read from the array.
3. A document's score is its weight plus noise that its id alone decides, so that the highest
   scores are a weighted draw without replacement. Scores are written once.
4. The lowest drawn place is found by bisection on numbers: jobs count exactly how many written
   rows stand above a threshold, on the score first and then, among rows of the cutoff score, on
   the id and what else orders them. Each job counts for all thresholds that the next
   ``LEVELS`` halvings can come to.
5. Drawn rows are dealt by range and ranked by their place and the rows of earlier ranges.

Only the bucket table (``buckets`` rows, a parameter) and single counts come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accordance.llm import common

#: Halvings whose thresholds are counted by one job.
LEVELS = 4
#: Bytes of one text that are looked at together; longer texts come in pieces, cut between words.
PIECE = 1 << 21
#: Longer words are hashed one by one.
_LONG = 64


# ---------------------------------------------------------------------------
# Hashed features of one task


def _table():
    """The remainders of all bytes for the polynomial of crc32."""
    import numpy as np

    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


def _extended(state, data, starts, ends):
    """The running checksums after the bytes of each span, all spans at once."""
    import zlib

    import numpy as np

    table = _table()
    size = ends - starts
    out = state.copy()
    for k in np.flatnonzero(size > _LONG).tolist():
        before = int(state[k]) ^ 0xFFFFFFFF
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), before) ^ 0xFFFFFFFF
    order = np.argsort(-size, kind="stable")
    order = order[int((size > _LONG).sum()) :]
    at, now, left = starts[order], out[order], -size[order]
    for j in range(-int(left[0]) if len(left) else 0):
        m = int(np.searchsorted(left, -j, "left"))  # spans with more than j bytes
        now[:m] = table[(now[:m] ^ data[at[:m] + j]) & 0xFF] ^ (now[:m] >> np.uint32(8))
    out[order] = now
    return out


def pieces(text: bytes, size: int) -> Iterator[bytes]:
    """A text cut before words, each piece but the first beginning with the last word of the one before."""
    import numpy as np

    from accordance.llm.words import _LOWER, LETTERS

    if len(text) <= size:
        yield text
        return
    inside = LETTERS[_LOWER[np.frombuffer(text, np.uint8)]]
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    start = 0
    while start < len(text):
        # the next piece begins with the last word that begins below start + size, if that is a later one
        last = int(np.searchsorted(begins, start + size, "left")) - 1
        first = int(np.searchsorted(begins, start, "left"))
        if last <= first:
            last = first + 1
        stop = int(begins[last + 1]) if last + 1 < len(begins) else len(text)
        yield text[start:stop]
        if stop == len(text):
            return
        start = int(begins[last])


def features(texts: Sequence[bytes], again: Sequence[bool], buckets: int):
    """The bucket of every feature, the text it belongs to, and the number of words of each text.

    ``again`` marks a text whose first word was counted before.
    """
    import numpy as np

    from accordance.llm.words import _LOWER, LETTERS

    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.cumsum(lengths) - lengths
    inside = np.concatenate([[False], LETTERS[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    owner = np.searchsorted(first, starts, "right") - 1
    words = np.bincount(owner, minlength=len(texts))
    seed = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    one = _extended(seed, data, starts, ends)
    pair = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
    table = _table()
    spaced = table[(one[pair] ^ np.uint32(0x20)) & 0xFF] ^ (one[pair] >> np.uint32(8))
    two = _extended(spaced, data, starts[pair + 1], ends[pair + 1])
    single = np.ones(len(starts), bool)
    repeated = np.asarray(again, bool) & (words > 0)
    single[(np.cumsum(words) - words)[repeated]] = False
    hashes = np.concatenate([one[single], two]) ^ np.uint32(0xFFFFFFFF)
    return (hashes % np.uint32(buckets)).astype(np.int64), np.concatenate([owner[single], owner[pair]]), words - repeated


def _pieced(batches: Iterator, columns: int) -> Iterator[tuple[list, list[bytes], list[bool], list[int]]]:
    """Rows of a task with their pieces of text, and the row of each piece."""
    from accordance.llm.words import chunks

    for rows in chunks(batches, columns):
        texts, again, row = [], [], []
        for k, r in enumerate(rows):
            for j, p in enumerate(pieces(r[-1] or b"", PIECE)):
                texts.append(p)
                again.append(j > 0)
                row.append(k)
        yield rows, texts, again, row


def _count(buckets: int) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from accordance.llm.resample import _grouped, _pieced, features

        held = np.zeros(buckets, np.int64)
        for _, texts, again, row in _pieced(batches, 1):
            for some in _grouped(texts, again, row):
                held += np.bincount(features(some[0], some[1], buckets)[0], minlength=buckets)
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(held[found], pa.int64())], names=["bucket", "n"])

    return run


def _grouped(texts: list, again: list, row: list) -> Iterator[tuple[list, list, list]]:
    """Pieces in runs of about `PIECE` bytes."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > PIECE:
            yield texts[start:k], again[start:k], row[start:k]
            start, size = k, 0
        size += len(t)
    if texts:
        yield texts[start:], again[start:], row[start:]


def _weigh(gains: list[int]) -> Callable:
    buckets = len(gains)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from accordance.llm.resample import _grouped, _pieced, features

        gain = np.asarray(gains, np.int64)
        for rows, texts, again, row in _pieced(batches, 2):
            words, count, total = (np.zeros(len(rows), np.int64) for _ in range(3))
            for some, seen, own in _grouped(texts, again, row):
                found, owner, n = features(some, seen, buckets)
                np.add.at(words, own, n)
                np.add.at(count, own, np.bincount(owner, minlength=len(some)))
                # sums of whole numbers below 2^53, exact in doubles
                sums = np.bincount(owner, weights=gain[found].astype(float), minlength=len(some))
                np.add.at(total, own, sums.astype(np.int64))
            weight = np.floor_divide(total, np.maximum(count, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), *(pa.array(x, pa.int64()) for x in (words, count, weight))],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    return run


# ---------------------------------------------------------------------------
# Gains, scores


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """How many features of the one column ``texts`` has fall into each bucket that has any."""
    parts = texts.mapInArrow(_count(buckets), "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of each bucket; a corpus without features has equal shares everywhere."""
    spark = docs.sparkSession
    s, t = bucket_counts(docs, buckets), bucket_counts(target, buckets)
    both = s.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).union(t.select("bucket", F.lit(0), "n"))
    every = both.union(spark.range(buckets).select("id", F.lit(0), F.lit(0))).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    found = sorted(every.collect())  # as many rows as buckets, a parameter
    whole_s, whole_t = sum(r["s"] for r in found), sum(r["t"] for r in found)
    sides = spark.createDataFrame([(r["bucket"], r["s"], r["t"]) for r in found], "bucket long, s long, t long")
    share = (F.col("t") + 1.0) * F.lit(float(whole_s + buckets)) / ((F.col("s") + 1.0) * F.lit(float(whole_t + buckets)))
    out = sides.select("bucket", F.floor(F.log(share) * 1000.0).alias("gain")).collect()
    return [r["gain"] for r in sorted(out)]


def noise(seed: int, doc_id: str = "doc_id") -> Column:
    """Gumbel noise in thousandths that the id alone decides; a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0)


def scored(
    docs: DataFrame, target: DataFrame, buckets: int = 10_000, seed: int = 7, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` and ``score`` of every document."""
    common.ship(docs.sparkSession)
    raw = common.text_of(text).cast("binary").alias("text")
    found = gains(docs.select(raw), target.select(raw), buckets)
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), raw).mapInArrow(
        _weigh(found), "doc_id long, n_words long, n_features long, weight long"
    )
    return out.withColumn("score", F.col("weight") + noise(seed))


# ---------------------------------------------------------------------------
# The draw


def kth_smallest(rows: DataFrame, value: Column, k: int) -> tuple[int, int, int]:
    """The k-th smallest value (k from 1) of a written table, and how many rows are below and up to it.

    Bisection between the least and the largest value. A job counts the rows up to each of the
    thresholds that the next `LEVELS` halvings can meet, so it stands for that many halvings.
    """
    numbers = rows.select(value.cast("long").alias("v"))
    least, most, upto = numbers.agg(F.min("v"), F.max("v"), F.count("v")).first()
    below = 0
    while least < most:
        cuts = sorted(_thresholds(least, most, LEVELS))
        counts = numbers.agg(*[F.count_if(F.col("v") <= c) for c in cuts]).first()
        for c, n in zip(cuts, counts):
            if n >= k:
                most, upto = c, n
                break
            least, below = c + 1, n
    return least, below, upto


def _thresholds(least: int, most: int, levels: int) -> set[int]:
    if least >= most or not levels:
        return set()
    half = (least + most) // 2
    return {half} | _thresholds(least, half, levels - 1) | _thresholds(half + 1, most, levels - 1)


def cutoff(rows: DataFrame, orders: Sequence[Column], k: int) -> Column:
    """Which rows of a written table are the first ``k`` in the order of several numbers.

    Numbers are tried one after another, each among the rows that tie in those before.
    """
    taken, tied = F.lit(False), F.lit(True)
    for order in orders:
        if k <= 0:
            return taken
        value, below, upto = kth_smallest(rows.where(tied), order, k)
        if upto == k:
            return taken | (tied & (order <= value))
        taken = taken | (tied & (order < value))
        tied, k = tied & (order == value), k - below
    raise ValueError("the numbers do not tell all rows apart")


def ranked(rows: DataFrame, orders: Sequence[Column]) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, 3...), dealt by range instead of sorted in one task."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(common.width(spark), *orders).sortWithinPartitions(*orders)
    place = F.monotonically_increasing_id()
    # a written table, so that counts and places come from one dealing
    table = common.written(dealt.select("*", F.spark_partition_id().alias("_part"), (place.bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("_place")))
    sizes = table.groupBy(F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = sizes.select("_of", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    out = table.join(F.broadcast(before), F.col("_part") == F.col("_of"))
    return out.select(*rows.columns, (F.col("_before") + F.col("_place")).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, buckets: int = 10_000, seed: int = 7,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row of ``docs``.

    ``percent`` of the documents with ``min_words`` words, rounded down, are drawn by the highest scores, ties by
    the smaller id, a null id last, then by fewer features; rows that are equal in all this are taken
    in any order, which does not show in the result. A null or empty text has no features, weight 0
    and is never drawn (unless ``min_words`` is 0). Repeated rows are drawn each for itself. Other
    columns are not read. An empty table gives no rows; an empty target only pulls to rare buckets.
    """
    rows = common.written(scored(docs, target, buckets, seed, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
    able = rows.where(F.col("n_words") >= min_words)
    k = able.count() * percent // 100
    shown = ["doc_id", "n_features", "weight", "score"]
    no_id = F.col("doc_id").isNull().cast("long")  # these come last
    orders = [-F.col("score"), no_id, F.coalesce("doc_id", F.lit(0)), F.col("n_features"), F.col("row")]
    chosen = (F.col("n_words") >= min_words) & cutoff(able, orders, k)
    drawn = ranked(rows.where(chosen), orders)
    return drawn.select(*shown, "rank").union(rows.where(~chosen).select(*shown, F.lit(None).cast("long")))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark texts."""
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


# crc32 in SQL: a table of remainders by its rule, folded over the bytes of each distinct feature.
_SQL = r"""
WITH remainders AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
    ORDER BY i) AS t FROM range(256) r(i)),
words AS (SELECT 0 AS side, row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    UNION ALL SELECT 1, row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
feats AS (SELECT side, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1]))) AS f FROM words),
counts AS (SELECT side, row, f, count(*) AS n FROM feats GROUP BY ALL),
hashed AS (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(0, length(hex(encode(f))) // 2),
      lambda j: ('0x' || substr(hex(encode(f)), 2 * j + 1, 2))::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT f FROM counts), remainders),
placed AS (SELECT side, row, bucket, n FROM counts JOIN hashed USING (f)),
sides AS (SELECT b AS bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0)::BIGINT AS t
    FROM range(10000) r(b) LEFT JOIN placed ON bucket = b GROUP BY b),
gains AS (SELECT bucket, floor(1000::DOUBLE * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sides) + 10000)::DOUBLE
      / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sides) + 10000)::DOUBLE)))::BIGINT AS gain FROM sides),
weights AS (SELECT row, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
    FROM placed JOIN gains USING (bucket) WHERE side = 0 GROUP BY row),
scores AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + floor(-1000::DOUBLE * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
        / 4294967296::DOUBLE)))::BIGINT AS score FROM words LEFT JOIN weights USING (row) WHERE side = 0),
places AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
      count(*) OVER (PARTITION BY n_words >= 20) * 25 // 100 AS k FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= k THEN place END AS rank FROM places
"""

QUERIES = {"op13_resample": (op13_resample, _SQL)}
