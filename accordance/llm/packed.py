"""Token ids in fixed-width bit-packed blocks.

Format: a Parquet folder whose rows are blocks of whole documents in ascending doc_id
order (null first; equal ids in the order of their tokens).

| column | meaning |
| --- | --- |
| slice, block | place of the block: slices ascend by doc_id, blocks ascend in a slice |
| first_doc, last_doc | smallest and largest doc_id of the block, for pruning by range |
| before | ids of this slice before the block |
| n_ids, bits | ids in the block and bits per id: the fewest that hold the vocabulary |
| doc_ids, ends | the documents and, for each, the end of its ids in the block |
| payload | ids in little-endian 64-bit words; id i fills bits i * bits to (i + 1) * bits |

Any id is found from its number alone, so a document is read without its neighbours, and
whole blocks unpack with array operations. Blocks close at ``BLOCK_IDS``, at the end
of a document. Parquet is the container, so any store that Spark reaches will do.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accordance.llm import common

BLOCK_IDS = 1 << 18
#: Pre-tokens that a worker remembers from block to block; others are encoded again.
REMEMBERED = 400_000
FILE = (
    "slice int, block int, first_doc long, last_doc long, before long, n_ids long, bits int, "
    "doc_ids array<bigint>, ends array<bigint>, payload binary"
)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids, bits: int) -> bytes:
    """Ids (each below 2**bits) as 64-bit words; 64 ids fill ``bits`` words."""
    import numpy as np

    n = len(ids)
    lanes = np.zeros((-(-n // 64), 64), np.uint64)
    lanes.reshape(-1)[:n] = ids
    out = np.zeros((len(lanes), bits + 1), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= lanes[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    words = -(-n * bits // 64)
    return np.ascontiguousarray(out[:, :bits]).astype("<u8", copy=False).tobytes()[: 8 * words]


def unpack(payload: bytes, bits: int, start: int, n: int):
    """``n`` ids from number ``start`` on, as unsigned 32-bit integers."""
    import numpy as np

    words = np.frombuffer(payload, "<u8")
    if not n:
        return np.zeros(0, np.uint32)
    at = (np.arange(start, start + n, dtype=np.uint64)) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    low = words[word] >> shift
    over = np.minimum(word + 1, len(words) - 1)
    high = (words[over] << np.uint64(1)) << (np.uint64(63) - shift)
    return ((low | high) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def _width(bits: int) -> str:
    """How ids travel before they are packed."""
    return "<u2" if bits <= 16 else "<u4"


def _encode(tokenizer: str, special: str | None, end_id: int | None, splits: list[int], bits: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from accordance.llm import packed
        from accordance.llm.pretokens import Block, in_blocks, ragged
        from accordance.llm.vocabulary import library

        encode = library(tokenizer).encode
        known = packed.__dict__.setdefault("_known", {}).setdefault(tokenizer, {})
        bounds = np.asarray(splits, np.int64)
        for ids, texts in in_blocks(batches):
            block = Block(texts, special)
            found = [known.get(w) for w in block.words]
            missing = [k for k, x in enumerate(found) if x is None]
            if missing:
                e = encode([block.words[k] for k in missing], is_pretokenized=True, add_special_tokens=False)
                n = np.bincount(np.asarray(e.word_ids, np.int64), minlength=len(missing))
                new = np.asarray(e.ids, np.uint32).tobytes()
                ends = (4 * np.cumsum(n)).tolist()
                for k, i, j in zip(missing, [0, *ends], ends):
                    found[k] = new[i:j]
                    if len(known) < packed.REMEMBERED:
                        known[block.words[k]] = found[k]
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            whole = ragged(np.frombuffer(b"".join(found), np.uint32), (np.cumsum(size) - size)[block.codes], size[block.codes])
            after = np.concatenate([[0], np.cumsum(size[block.codes])])
            edge = after[np.concatenate([[0], np.cumsum(block.counts)])].tolist()
            kind = packed._width(bits)
            size = np.dtype(kind).itemsize
            tail = b"" if end_id is None else np.asarray([end_id], kind).tobytes()
            data = whole.astype(kind).tobytes()
            where = [0 if i is None else int(np.searchsorted(bounds, i, "right")) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(where, pa.int32()), pa.array(ids, pa.int64()),
                    pa.array([data[size * i : size * j] + tail for i, j in zip(edge[:-1], edge[1:])], pa.binary()),
                ],
                names=["slice", "doc_id", "ids"],
            )

    return run


def _pack_rows(bits: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from accordance.llm.packed import BLOCK_IDS, _width, pack

        kind = _width(bits)
        width = np.dtype(kind).itemsize
        at: dict[int, list[int]] = {}  # slice -> [blocks, ids] so far
        held: list = []
        size = 0

        def close():
            nonlocal held, size
            where = held[0][0]
            state = at.setdefault(where, [0, 0])
            docs = [x[1] for x in held]
            ends = np.cumsum([len(x[2]) // width for x in held])
            ids = np.frombuffer(b"".join(x[2] for x in held), kind)
            known = [d for d in docs if d is not None]
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([where], pa.int32()), pa.array([state[0]], pa.int32()),
                    pa.array([min(known, default=None)], pa.int64()), pa.array([max(known, default=None)], pa.int64()),
                    pa.array([state[1]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([bits], pa.int32()),
                    pa.array([docs], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())),
                    pa.array([pack(ids, bits)], pa.binary()),
                ],
                names=["slice", "block", "first_doc", "last_doc", "before", "n_ids", "bits", "doc_ids", "ends", "payload"],
            )
            state[0] += 1
            state[1] += len(ids)
            held, size = [], 0
            return row

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (row[0] != held[0][0] or size >= BLOCK_IDS):
                    yield close()
                held.append(row)
                size += len(row[2]) // width
        if held:
            yield close()

    return run


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, vocabulary: int, special: str | None = None,
    end_id: int | None = None, doc_id: str = "doc_id", text: str | Column = "text",
) -> None:
    """Encode every whole text with the library and write the ids to ``path``.

    A null or empty text has only the end id, if one is given. Repeated rows are
    written as often as they come. Other columns are not read. An empty table writes a folder without rows.
    """
    spark = docs.sparkSession
    common.ship(spark)
    n = common.width(spark)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_of(text).alias("text"))
    shares = [k / n for k in range(1, n)]
    found = source.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), F.lit(100 * n)).alias("s")).first() if shares else None
    splits = sorted(set(found["s"] or [])) if found else []
    bits = bits_for(vocabulary)
    sliced = source.mapInArrow(_encode(tokenizer, special, end_id, splits, bits), "slice int, doc_id long, ids binary")
    ordered = sliced.repartitionById(n, "slice").sortWithinPartitions("slice", "doc_id", "ids")
    blocks = ordered.mapInArrow(_pack_rows(bits), FILE)
    # packed bits do not shrink any further
    blocks.write.option("compression", "lz4").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``: the ids of all blocks before each."""
    blocks = spark.read.schema(FILE).parquet(path)
    # a row per slice; their number is set by the writer, not by the data
    totals = blocks.groupBy("slice").agg(F.sum("n_ids").alias("total"))
    order = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("slice", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(bases), "slice").withColumn("start", F.col("base") + F.col("before"))


def read_documents(
    spark: SparkSession, path: str, first: int | None = None, last: int | None = None, digest: bool = False
) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids``.

    ``first`` and ``last`` read only the blocks that can hold such documents. With
    ``digest``, ``ids_crc32`` stands for ``ids``.
    """

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        from accordance.llm.packed import unpack

        for batch in batches:
            for bits, docs, ends, payload, base in zip(*(c.to_pylist() for c in batch.columns)):
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                data = unpack(payload, bits, 0, ends[-1]).astype("<u4", copy=False).tobytes()
                parts = [data[4 * i : 4 * j] for i, j in zip(begins.tolist(), ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64()), pa.array(begins + base, pa.int64()),
                        pa.array(np.asarray(ends) - begins, pa.int64()),
                        pa.array([zlib.crc32(p) for p in parts], pa.int64()) if digest else pa.array(parts, pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    blocks = read_blocks(spark, path)
    if first is not None:
        blocks = blocks.where(F.col("last_doc") >= first)
    if last is not None:
        blocks = blocks.where(F.col("first_doc") <= last)
    common.ship(spark)
    kind = "ids_crc32 long" if digest else "ids binary"
    out = blocks.select("bits", "doc_ids", "ends", "payload", "start").mapInArrow(
        run, f"doc_id long, start long, n_tokens long, {kind}"
    )
    if first is not None:
        out = out.where(F.col("doc_id") >= first)
    return out.where(F.col("doc_id") <= last) if last is not None else out


def op9_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as packed ids, and read back."""
    return written_and_read(common.table(spark, sf_dir, "documents"))


def written_and_read(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    spark = docs.sparkSession
    path = common.shared_folder(spark)
    write_tokens(
        docs, path, public_tokenizers.path("byte_bpe_50k.json"), 50_257, special="<|endoftext|>", end_id=2
    )
    return read_documents(spark, path, digest=True)


QUERIES = {"op9_packed_ids": (op9_packed_ids, None)}
