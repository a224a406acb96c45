"""Benchmark decontamination by winnowing.

A fingerprint is the smallest hash of `K` words in each run of `WINDOW - K + 1` successive
ones. Whatever 13 words a document shares with an item, both sides keep the same
fingerprint inside them, because the choice depends on these words alone. Document and
item fingerprints are joined by hash, and each hit is extended word by word as far as a
window that holds it can reach; spans of at least `WINDOW` words are contaminated.
Items of fewer words are one window and are joined at every position.

The benchmark side is the small one: its size is read first, it is split into parts of at
most `PART_BYTES` of text, and the documents pass the parts one after another in the
same scan, so no part outgrows a task. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordance.llm import common

WINDOW, K = 13, 5
PART_BYTES = 1 << 24
#: Bytes of text that are looked at together.
CHARS = 1 << 18
_FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def winnowed(hashes, counts):
    """Positions of the fingerprints of texts whose word hashes stand one after another.

    Equal smallest hashes of a run are all kept; a run that crosses two texts only adds some.
    """
    import numpy as np

    from accordance.llm.words import grams

    g = grams(hashes, K)
    w = WINDOW - K + 1
    n = len(g)
    if not n:
        return np.zeros(0, np.int64), g
    ends = np.cumsum(counts)
    high = np.iinfo(np.uint64).max
    for j in range(1, K):  # grams that cross the end of a text
        at = ends - j
        g[at[(at >= 0) & (at < n)]] = high
    padded = np.concatenate([np.full(w - 1, high), g, np.full(w - 1, high)])
    low = _sliding(padded, w, np.minimum)  # one per run, those over the edges included
    best = _sliding(low, w, np.maximum)
    return np.flatnonzero((g == best) & (g != high)), g


def _sliding(a, w: int, f):
    """``f`` over every ``w`` successive values."""
    width, out = 1, a
    while 2 * width <= w:
        out = f(out[:-width], out[width:])
        width *= 2
    return f(out[: len(a) - w + 1], out[w - width : w - width + len(a) - w + 1])


class Items:
    """The fingerprints of one part of the benchmark, sorted for the join."""

    def __init__(self, ids: list[str], texts: list):
        import numpy as np

        from accordance.llm.words import LETTERS, grams, words_of

        self.words, counts = words_of(texts, LETTERS)
        self.ids = ids
        ends = np.cumsum(counts)
        self.begin, self.end = ends - counts, ends
        self.item = np.repeat(np.arange(len(ids)), counts)
        at, g = winnowed(self.words, counts)
        at = at[counts[self.item[at]] >= WINDOW] if len(at) else at
        order = np.argsort(g[at], kind="stable")
        self.long = (g[at][order], at[order])
        self.short = {}
        for m in sorted({int(c) for c in counts if 0 < c < WINDOW}):
            first = self.begin[counts == m]
            h = grams(self.words, m)[first]
            order = np.argsort(h, kind="stable")
            self.short[m] = (h[order], first[order])

    def hits(self, words, counts):
        """(start, end, item) of every extended hit, in positions of ``words``."""
        import numpy as np

        from accordance.llm.words import grams

        ends = np.cumsum(counts)
        doc = np.repeat(np.arange(len(counts)), counts)
        begin = ends - counts
        found = []
        at, g = winnowed(words, counts)
        p, q = _joined(g[at], at, *self.long)
        if len(p):
            lo, hi = begin[doc[p]], ends[doc[p]]
            left = self._extend(words, p, q, -1, lo, hi)
            right = self._extend(words, p + K - 1, q + K - 1, 1, lo, hi)
            same = np.ones(len(p), bool)
            for j in range(K):
                same &= words[p + j] == self.words[q + j]
            ok = same & (left + K + right >= WINDOW)
            found.append(((p - left)[ok], (p + K + right)[ok], self.item[q[ok]]))
        for m, (h, first) in self.short.items():
            g = grams(words, m)
            p, q = _joined(g, np.arange(len(g)), h, first)
            ok = p + m <= ends[doc[p]] if len(p) else np.zeros(0, bool)
            for j in range(m):
                ok &= words[p + j] == self.words[q + j]
            found.append((p[ok], p[ok] + m, self.item[q[ok]]))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *(f[k] for f in found)]) for k in range(3))

    def _extend(self, words, p, q, step: int, lo, hi):
        """Equal words beyond p and q, as far as a window around the fingerprint reaches."""
        import numpy as np

        n = np.zeros(len(p), np.int64)
        active = np.ones(len(p), bool)
        begin, end = self.begin[self.item[q]], self.end[self.item[q]]
        for j in range(1, WINDOW - K + 1):
            a, b = p + step * j, q + step * j
            active &= (a >= lo) & (a < hi) & (b >= begin) & (b < end)
            active[active] = words[a[active]] == self.words[b[active]]
            n += active
        return n


def pieces(batches: Iterator, at: int) -> Iterator:
    """The batches in slices of about `CHARS` bytes of text (column ``at``); a longer text is a slice of its own."""
    import numpy as np
    import pyarrow.compute as pc

    from accordance.llm.decontaminate import CHARS

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        i = 0
        while i < batch.num_rows:
            before = int(ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(ends, before + CHARS, "right")))
            yield batch.slice(i, j - i)
            i = j


def _joined(hashes, places, keys, targets):
    """All (place, target) whose hashes are equal; ``keys`` is sorted."""
    import numpy as np

    from accordance.llm.pretokens import ragged

    if not len(keys) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    some = np.flatnonzero(keys[at] == hashes)
    first = at[some]
    n = np.searchsorted(keys, hashes[some], "right") - first
    return np.repeat(places[some], n), ragged(targets, first, n)


def _pass(shared, at: int, width: int, names: list[str], fresh: bool):
    """One part of the benchmark; ``at`` is the place of the text among the first ``width`` columns.

    The results of the passes before follow these; columns that are not among ``names`` are not given back.
    A batch is taken in pieces of about `CHARS` characters, so its texts never stand beside it as a whole.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from accordance.llm.decontaminate import pieces
        from accordance.llm.words import LETTERS, words_of

        items = shared.value
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in pieces(batches, at):
            texts = batch.column(at).to_pylist()
            words, n_words = words_of(texts, LETTERS)
            named, spans = [[]] * len(texts), [[]] * len(texts)
            n_hit = np.zeros(len(texts), np.int64)
            if not fresh:
                n_hit = batch.column(width + 1).to_numpy().copy()
                named, spans = batch.column(width + 2).to_pylist(), batch.column(width + 3).to_pylist()
            start, end, item = items.hits(words, n_words)
            ends = np.cumsum(n_words)
            doc = np.searchsorted(ends, start, "right")
            by = np.argsort(doc, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(doc[by])) + 1):
                if not len(part):
                    continue
                d = int(doc[part[0]])
                base = int(ends[d] - n_words[d])
                own = [(int(start[x]) - base, int(end[x]) - base) for x in part]
                merged = _merged(own + [(s["start"], s["end"]) for s in spans[d]])
                spans[d] = [{"start": a, "end": b} for a, b in merged]
                named[d] = sorted({*named[d], *(items.ids[int(k)] for k in np.unique(item[part]))})
                n_hit[d] = sum(b - a for a, b in merged)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(names)], pa.array(n_words), pa.array(n_hit),
                    pa.array(named, pa.list_(pa.string())), pa.array(spans, pa.list_(span)),
                ],
                names=[*names, "n_words", "n_hit", "items", "spans"],
            )

    def _merged(spans: list) -> list:
        out: list = []
        for a, b in sorted(spans):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with ``n_words``, ``n_hit``, ``items``, ``spans``, ``contaminated``.

    ``items`` are the ids (as strings, sorted) of the items with a window in the text, ``spans``
    the hit words as (start, end), end exclusive. A document is contaminated if at least
    a twentieth of its words are hit. A null or empty text has no words and no hits; an
    item without words has no window; an item id that repeats counts once, a null id reads ``""``.
    Rows stay as they come. With an empty benchmark nothing is hit.
    """
    spark = docs.sparkSession
    common.ship(spark)
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), common.text_of("text").alias("text")
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    # a text that is kept is not sent a second time, and one that is not stays behind in the last pass
    out = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias("_read"))
    at = keep.index("text") if "text" in keep else len(keep)
    names = out.columns
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields]
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).toArrow()
        own = Items(part.column("item_id").to_pylist(), part.column("text").to_pylist())
        shared = spark.sparkContext.broadcast(own)
        n = len(keep) if k == parts - 1 else len(names)
        task = common.thrifty(_pass(shared, at, len(names), names[:n], k == 0))
        out = out.mapInArrow(task, ", ".join([*kept[:n], _FOUND]))
    rule = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.withColumn("contaminated", rule)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    return digests(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


@common.carried("doc_id", "text")
def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns only.

    A null or empty text has no words and stays. Repeated rows fare alike. Without documents nothing is
    returned, without a benchmark all stay.
    """
    names = docs.columns
    return find_contamination(docs, benchmark, tuple(names)).where(~F.col("contaminated")).select(*names)


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least({WINDOW}, len(w)) AS m FROM b WHERE len(w) > 0),
places AS (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized),
windows AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM places),
spots AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m),
grams AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM spots),
hits AS (SELECT doc_id, i, m, item_id FROM grams JOIN windows USING (m, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id"""

QUERIES = {"op6_decontamination": (op6_decontamination, _SQL)}
