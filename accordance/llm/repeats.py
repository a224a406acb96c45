"""Removal of long byte strings that stand more than once, by refinement of q-gram buckets.

A byte goes if a string of `LENGTH` bytes that covers it also starts anywhere else. Not every
suffix is sorted: of each such string only the leftmost smallest q-gram is looked at,
its *anchor*. Equal strings have equal anchors at equal places, so comparing what stands
around equal anchors finds every repeat.

1. *Initial buckets*: anchors with the same q-gram. An anchor alone in its bucket settles all
   strings it stands for at once; most of a corpus ends here.
2. *Refinement*: a bucket is split by the identifier of everything an anchor's strings reach at the later
   (and earlier) offsets. Where two anchors agree in all of it, all their strings repeat.
3. *Last refinement*, only of buckets that fell apart: the strings themselves: the hash of
   every 200-byte string, from prefix sums; no bucket pointers of later offsets. A crowded bucket does this by string over
   all tasks, so it never meets in one.
4. The spans of each document are merged and cut out.

The bytes of a document are read again where they are needed, which costs less than to shuffle
or store them. Maps of fixed size say which parts can be needed; the joins behind them are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordance.llm import common

LENGTH, Q = 200, 40
#: Distinct surroundings from which a bucket is dealt over tasks.
CROWDED = 1 << 14
MAP_BITS = 26
#: Surroundings whose strings are hashed at once.
_AT_ONCE = 2048
_POSITION = 31


def text_keys(ids: list, raw: list[bytes]):
    """128 bits of each row's id and text, as two columns: what tells rows apart, with an id or without.

    Rows equal in both share their key, and their spans."""
    import hashlib

    import numpy as np

    digest = hashlib.blake2b
    # the id in front of the text, with a mark that no number has where there is none
    keys = [digest(b"-" + r if i is None else b"%d:" % i + r, digest_size=16).digest() for i, r in zip(ids, raw)]
    both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


class Anchors:
    """The anchors of some texts: per anchor its text, first and last string, place and hashes."""

    def __init__(self, raw: list[bytes]):
        import numpy as np

        from accordance.llm.pretokens import mix, prefix_sums, span_hashes

        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        self.first = np.cumsum(lengths) - lengths
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        n = len(self.data)
        none = np.zeros(0, np.int64)
        self.text = self.s = self.e = self.at = none
        self.gram = self.reach = np.zeros(0, np.uint64)
        if n < LENGTH:
            return
        self.sums = prefix_sums(self.data)
        where = np.arange(n - Q + 1)
        grams = span_hashes(self.sums, where, where + Q)
        low = (grams >> np.uint64(_POSITION) << np.uint64(_POSITION)) | where.astype(np.uint64)
        w, width = LENGTH - Q + 1, 1
        while 2 * width <= w:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        m = n - LENGTH + 1
        low = np.minimum(low[:m], low[w - width : w - width + m])
        anchor = (low & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
        ok = np.zeros(m, bool)
        room = np.flatnonzero(lengths >= LENGTH)
        edge = np.zeros(m + 1, np.int64)
        np.add.at(edge, self.first[room], 1)
        np.add.at(edge, self.first[room] + lengths[room] - LENGTH + 1, -1)
        ok = np.cumsum(edge[:-1]) > 0
        p = np.flatnonzero(ok)
        if not len(p):
            return
        a = anchor[p]
        # an anchor's strings follow one another inside one text
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)])
        begin = np.flatnonzero(new)
        self.s, self.e, self.at = p[begin], p[np.append(begin[1:], len(p)) - 1], a[begin]
        self.text = np.searchsorted(self.first[room], self.s, "right") - 1
        self.text = room[self.text]
        self.gram = grams[self.at]
        self.reach = mix(span_hashes(self.sums, self.s, self.e + LENGTH) + (self.at - self.s).astype(np.uint64))


def _raw_chunks(batches, chunk: int = 1 << 19):
    ids, raw, held = [], [], 0
    for batch in batches:
        for row in range(0, batch.num_rows, 256):
            part = batch.slice(row, 256)
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids.append(i)
                raw.append((t or "").encode())
                held += len(raw[-1])
                if held >= chunk:
                    yield ids, raw
                    ids, raw, held = [], [], 0
    if ids:
        yield ids, raw


_ANCHORS = "doc long, variant long, s int, e int, gram long, reach long"


def _anchor_rows(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    from accordance.llm.repeats import Anchors, _raw_chunks, text_keys

    for ids, raw in _raw_chunks(batches):
        x = Anchors(raw)
        doc, variant = text_keys(ids, raw)
        base = x.first[x.text]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(doc[x.text]), pa.array(variant[x.text]), pa.array((x.s - base).astype(np.int32)),
                pa.array((x.e - base + LENGTH).astype(np.int32)), pa.array(x.gram.view(np.int64)), pa.array(x.reach.view(np.int64)),
            ],
            names=["doc", "variant", "s", "e", "gram", "reach"],
        )


def fixed_map(df: DataFrame, column: str, bits: int = MAP_BITS) -> bytes:
    """Which low bits of a 64-bit column occur, as 2**bits bits."""
    import numpy as np

    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = (
        df.select(slot.alias("s")).groupBy(F.shiftright("s", 6).cast("int").alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("v")).toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return out.tobytes()


def in_map(data: bytes, values):
    import numpy as np

    table = np.frombuffer(data, np.uint64)
    slot = values.view(np.uint64) & np.uint64(64 * len(table) - 1)
    return ((table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


_REACH = "gram long, crowded boolean, doc long, variant long, s int, bytes binary"


def _reach_rows(shared):
    """What the anchors of mixed buckets reach; surroundings seen before in the task only once."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from accordance.llm.repeats import Anchors, _raw_chunks, in_map, text_keys

        mixed, full, crowd = shared.value
        for ids, raw in _raw_chunks(batches):
            x = Anchors(raw)
            k = np.flatnonzero(in_map(mixed, x.gram))
            # of surroundings that may repeat as a whole, one copy of a chunk is enough
            again = in_map(full, x.reach[k])
            _, one = np.unique(x.reach[k], return_index=True)
            keep = ~again
            keep[one] = True
            k = k[keep]
            base = x.first[x.text[k]]
            data = x.data.tobytes()
            doc, variant = text_keys(ids, raw)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(x.gram[k].view(np.int64)), pa.array(in_map(crowd, x.gram[k])),
                    pa.array(doc[x.text[k]]), pa.array(variant[x.text[k]]),
                    pa.array((x.s[k] - base).astype(np.int32)),
                    pa.array([data[i : j + LENGTH] for i, j in zip(x.s[k].tolist(), x.e[k].tolist())], pa.binary()),
                ],
                names=["gram", "crowded", "doc", "variant", "s", "bytes"],
            )

    return run


def _strings(blobs: list[bytes]):
    """The hash of every string of `LENGTH` bytes in each blob, its blob and its offset."""
    import numpy as np

    from accordance.llm.pretokens import prefix_sums, span_hashes, ragged

    lengths = np.fromiter(map(len, blobs), np.int64, len(blobs))
    first = np.cumsum(lengths) - lengths
    sums = prefix_sums(np.frombuffer(b"".join(blobs), np.uint8))
    n = lengths - LENGTH + 1
    start = ragged(np.arange(int(lengths.sum())), first, n)
    blob = np.repeat(np.arange(len(blobs)), n)
    return span_hashes(sums, start, start + LENGTH), blob, start - first[blob]


_SPANS = "doc long, variant long, s int, e int"


def _spans(doc, variant, s, blob, offset):
    """Runs of repeated strings of one blob as byte spans."""
    import numpy as np
    import pyarrow as pa

    new = np.ones(len(blob), bool)
    new[1:] = (blob[1:] != blob[:-1]) | (offset[1:] != offset[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(blob)) - 1 if len(blob) else begin
    b = blob[begin]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc[b]), pa.array(variant[b]), pa.array((s[b] + offset[begin]).astype(np.int32)),
            pa.array((s[b] + offset[last] + LENGTH).astype(np.int32)),
        ],
        names=["doc", "variant", "s", "e"],
    )


def _refine(batches: Iterator) -> Iterator:
    """Repeated strings of whole buckets; the rows come ordered by bucket."""
    import numpy as np
    import pandas as pd

    from accordance.llm.repeats import _AT_ONCE, _spans, _strings

    held: list[tuple] = []

    def part(rows, h, blob, offset, repeated):
        doc, variant, s = (np.asarray([r[k] for r in rows], t) for k, t in ((1, np.int64), (2, np.int64), (3, np.int64)))
        return _spans(doc, variant, s, blob[repeated], offset[repeated])

    def settle(rows):
        if len(rows) <= 2 * _AT_ONCE:
            h, blob, offset = _strings([r[4] for r in rows])
            codes, _ = pd.factorize(h)
            yield part(rows, h, blob, offset, np.bincount(codes)[codes] > 1)
            return
        # a large bucket: first which hashes come twice, then the spans, a part of its rows at a time
        parts = [rows[k : k + _AT_ONCE] for k in range(0, len(rows), _AT_ONCE)]
        every = np.sort(np.concatenate([_strings([r[4] for r in p])[0] for p in parts]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        del every
        for p in parts:
            h, blob, offset = _strings([r[4] for r in p])
            at = np.minimum(np.searchsorted(twice, h), max(0, len(twice) - 1))
            yield part(p, h, blob, offset, twice[at] == h if len(twice) else np.zeros(len(h), bool))

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("gram", "doc", "variant", "s", "bytes"))):
            if len(held) >= _AT_ONCE and row[0] != held[-1][0]:
                yield from settle(held)
                held = []
            held.append(row)
    if held:
        yield from settle(held)


def _string_rows(batches: Iterator) -> Iterator:
    """Every string of crowded buckets by its bucket and hash."""
    import numpy as np
    import pyarrow as pa

    from accordance.llm.repeats import _strings

    for batch in batches:
        for row in range(0, batch.num_rows, 2048):
            part = batch.slice(row, 2048)
            h, blob, offset = _strings(part.column("bytes").to_pylist())
            gram, doc, variant, s = (part.column(k).to_numpy() for k in ("gram", "doc", "variant", "s"))
            at = (s[blob] + offset).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(gram[blob]), pa.array(h.view(np.int64)), pa.array(doc[blob]), pa.array(variant[blob]), pa.array(at),
                    pa.array(at + np.int32(LENGTH)),
                ],
                names=["gram", "h", "doc", "variant", "s", "e"],
            )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc``, ``variant`` (see `text_keys`), ``s``, ``e``: byte spans, not merged, that consist of repeated strings.

    ``docs`` has doc_id and text.
    """
    spark = docs.sparkSession
    anchors = common.written(docs.mapInArrow(_anchor_rows, _ANCHORS))
    kinds = anchors.groupBy("gram", "reach").agg(F.count(F.lit(1)).alias("n"))
    buckets = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")).where("n > 1")
    buckets = common.written(buckets)
    full = common.written(kinds.where("n > 1").select("gram", "reach"))
    whole = anchors.join(full, ["gram", "reach"], "left_semi").select("doc", "variant", "s", "e")
    mixed = buckets.where("kinds > 1")
    maps = (fixed_map(mixed, "gram"), fixed_map(full, "reach"), fixed_map(mixed.where(F.col("kinds") > CROWDED), "gram", 20))
    shared = spark.sparkContext.broadcast(maps)
    reach = common.written(docs.mapInArrow(_reach_rows(shared), _REACH))
    calm = reach.where("not crowded").drop("crowded")
    calm = calm.repartition(common.width(spark), "gram").sortWithinPartitions("gram").mapInArrow(_refine, _SPANS)
    strings = reach.where("crowded").mapInArrow(_string_rows, f"gram long, h long, {_SPANS}")
    twice = strings.groupBy("gram", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", "h")
    crowded = strings.join(twice, ["gram", "h"], "left_semi").select("doc", "variant", "s", "e")
    return whole.union(calm).union(crowded)


_CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the bytes that stay) of each row.

    Matches never cross rows; strings are judged on the texts as given, so overlaps count, and
    every copy of a repeated string goes. A null or empty text, or one shorter than `LENGTH`
    bytes, keeps all its bytes. Repeated rows repeat each other's strings. Other columns are not
    read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    common.ship(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of("text").alias("text"))
    spans = common.written(repeated_spans(source))
    some = spark.sparkContext.broadcast(fixed_map(spans, "doc"))

    def keyed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from accordance.llm.repeats import in_map, text_keys

        for batch in batches:
            for row in range(0, batch.num_rows, 512):
                part = batch.slice(row, 512)
                texts = [t.encode() for t in part.column(1).to_pylist()]
                doc, variant = text_keys(part.column(0).to_pylist(), texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(doc), pa.array(variant), pa.array(in_map(some.value, doc)), pa.array(texts, pa.binary())],
                    names=["doc_id", "doc", "variant", "may", "raw"],
                )

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for i, raw, found in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not found:
                    out.append((i, len(raw), 0, 0, raw))
                    continue
                edge = np.zeros(len(raw) + 1, np.int64)
                at = np.asarray([(x["s"], x["e"]) for x in found], np.int64)
                np.add.at(edge, at[:, 0], 1)
                np.add.at(edge, at[:, 1], -1)
                gone = np.cumsum(edge[:-1]) > 0
                starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((i, len(raw), int(gone.sum()), starts, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[k] for r in out], pa.int64()) for k in range(4)), pa.array([r[4] for r in out], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    keyed_rows = source.mapInArrow(keyed, "doc_id long, doc long, variant long, may boolean, raw binary")
    by_doc = spans.groupBy("doc", "variant").agg(F.collect_set(F.struct("s", "e")).alias("found"))
    # no second worker for rows that stay whole
    none = F.lit(0).cast("long")
    untouched = keyed_rows.where("not may").select(
        "doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("raw").alias("kept")
    )
    touched = keyed_rows.where("may").join(by_doc, ["doc", "variant"], "left").select("doc_id", "raw", "found")
    return untouched.union(touched.mapInArrow(cut, _CUT))


def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the byte strings that the corpus repeats, as digests."""
    return digests(common.table(spark, sf_dir, "documents"))


def digests(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op8_repeated_strings": (op8_repeated_strings, None)}
