"""Byte-level BPE encoding and decoding over distinct words.

1. *Split.* Blocks of documents are split into pre-tokens; a block keeps its distinct
   words once and, as positions, one word number per occurrence.
2. *Shuffle of distinct words.* Each block sends its words by hash bucket; a bucket meets
   in one task, which encodes each distinct word of the whole corpus once.
3. *Join back.* The ids of a block's words return to the block and are put at the
   positions of the words.

A frequent word travels once per block, not once per occurrence, so no word is a hot
key. The split is done twice, once for the words and once for the positions, because
splitting costs less than shuffling or storing the texts; a block is named by its content,
and a block whose ids are missing stops the job instead of giving wrong rows. Blocks of
equal content share a name and one answer, and each of them gives its own rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordance.llm import common

IDS = "doc_id long, n_tokens long, ids binary"
_WORDS = "bucket int, block string, words binary, sizes binary"
_REPLY = "block string, bucket int, ids binary, sizes binary"


def _name(ids, block) -> str:
    """A block's name: which texts it holds, in which order."""
    from hashlib import blake2b

    h = blake2b(digest_size=16)
    h.update(repr(ids).encode())
    h.update(block.counts.tobytes())
    h.update(block.codes.tobytes())
    h.update(block.hashes.tobytes())
    return h.hexdigest()


def blocks_of(batches, special: str | None = None):
    """(doc ids, split block, its name) of Arrow batches of (doc_id, text)."""
    from accordance.llm.pretokens import Block, in_blocks

    for ids, texts in in_blocks(batches):
        block = Block(texts, special)
        yield ids, block, _name(ids, block)


def spread(name: str, block) -> str:
    """The name under which a block waits for its answers: a block without words gets none,
    so that equal ones (runs of null ids and null texts) need not meet in one task."""
    from pyspark import TaskContext

    return name if len(block.words) else f"{name}/{TaskContext.get().partitionId()}"


def word_rows(n_buckets: int, special: str | None = None) -> Callable:
    """A task that sends the distinct words of each block, one row per bucket."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from accordance.llm.bpe import blocks_of
        from accordance.llm.pretokens import squeeze

        for _, block, name in blocks_of(batches, special):
            bucket = (block.hashes % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            words = [block.words[k].encode() for k in order.tolist()]
            sizes = np.fromiter(map(len, words), np.uint32, len(words))
            used, first = np.unique(bucket[order], return_index=True)
            last = np.append(first[1:], len(words))
            rows = [
                (int(b), name, squeeze(b"".join(words[i:j])), squeeze(sizes[i:j]))
                for b, i, j in zip(used.tolist(), first.tolist(), last.tolist())
            ]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int32()),
                        pa.array([r[1] for r in rows], pa.string()),
                        pa.array([r[2] for r in rows], pa.binary()),
                        pa.array([r[3] for r in rows], pa.binary()),
                    ],
                    names=["bucket", "block", "words", "sizes"],
                )

    return run


def once(batch, answered: set) -> list[list]:
    """The columns of a batch of `_WORDS` without what was sent before under the same name.

    All rows of a bucket are in one task, so each block and bucket is answered once.
    """
    import pyarrow as pa

    new = []
    for key in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
        new.append(key not in answered)
        answered.add(key)
    return [c.to_pylist() for c in batch.filter(pa.array(new, pa.bool_())).columns]


def encode_words(encoder: Callable) -> Callable:
    """A task that encodes each distinct word of its buckets once.

    ``encoder()`` gives a function from a list of words (bytes) to a list of lists of ids.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from accordance.llm.bpe import once
        from accordance.llm.pretokens import squeeze, unsqueeze, unsqueeze_values

        encode = encoder()
        known: dict[bytes, bytes] = {}
        answered: set = set()
        for batch in batches:
            bucket, block, words, sizes = once(batch, answered)
            ids_out, sizes_out = [], []
            for blob, size in zip(words, sizes):
                ends = np.cumsum(unsqueeze_values(size), dtype=np.int64).tolist()
                blob = unsqueeze(blob)
                own = [blob[i:j] for i, j in zip([0, *ends], ends)]
                new = [w for w in own if w not in known]
                for w, ids in zip(new, encode(new)):
                    known[w] = np.asarray(ids, np.uint32).tobytes()
                found = [known[w] for w in own]
                ids_out.append(squeeze(np.frombuffer(b"".join(found), np.uint32)))
                sizes_out.append(squeeze(np.fromiter(map(len, found), np.uint32, len(found)) // 4))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block, pa.string()), pa.array(bucket, pa.int32()),
                    pa.array(ids_out, pa.binary()), pa.array(sizes_out, pa.binary()),
                ],
                names=["block", "bucket", "ids", "sizes"],
            )

    return run


def rank_encoder(path: str, pattern: str) -> Callable:
    """Words to ids by the ranks of a file: base64 bytes and rank on each line."""

    def make() -> Callable:
        from accordance.llm.vocabulary import ranked

        piece = ranked(path, pattern)._encode_single_piece
        return lambda words: [piece(w) for w in words]

    return make


def replies(docs: DataFrame, encoder: Callable, special: str | None = None) -> DataFrame:
    """Ids of the distinct words of each block, one row per block and bucket."""
    n = common.width(docs.sparkSession)
    words = docs.mapInArrow(common.thrifty(word_rows(n, special)), _WORDS).repartitionById(n, "bucket")
    return words.mapInArrow(common.thrifty(encode_words(encoder)), _REPLY)


_POSITIONS = "block string, docs array<bigint>, counts binary, codes binary, buckets binary"


def position_rows(n_buckets: int, special: str | None = None) -> Callable:
    """A task that keeps, per block, the word number of each occurrence, in order."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from accordance.llm.bpe import blocks_of, spread
        from accordance.llm.pretokens import squeeze

        for ids, block, name in blocks_of(batches, special):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([spread(name, block)], pa.string()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([block.counts.tobytes()], pa.binary()),
                    pa.array([squeeze(block.codes)], pa.binary()),
                    pa.array([squeeze(block.hashes % np.uint64(n_buckets))], pa.binary()),
                ],
                names=["block", "docs", "counts", "codes", "buckets"],
            )

    return run


def place(emit: Callable) -> Callable:
    """A task that puts the ids of a block's words at their positions.

    Positions of equal blocks are equal, so the rows are made once and given once per block.
    """

    def run(_key, positions, answers):
        import numpy as np
        import pyarrow as pa

        from accordance.llm.pretokens import unsqueeze_values

        if not positions.num_rows:
            raise RuntimeError("word ids came back for a block that was not split again: the input is not stable")
        docs, counts = (positions.column(k)[0].as_py() for k in ("docs", "counts"))
        codes, buckets = (unsqueeze_values(positions.column(k)[0].as_py()) for k in ("codes", "buckets"))
        counts = np.frombuffer(counts, np.int64)
        order = np.argsort(buckets, kind="stable")
        rows = sorted(zip(*(answers.column(k).to_pylist() for k in ("bucket", "ids", "sizes"))))
        none = np.zeros(0, np.uint32)
        ids = np.concatenate([none, *(unsqueeze_values(r[1]) for r in rows)])
        sent = np.concatenate([none, *(unsqueeze_values(r[2]) for r in rows)]).astype(np.int64)
        if len(sent) != len(buckets):
            raise RuntimeError("a block has another number of words than were encoded: the input is not stable")
        size = np.zeros(len(buckets), np.int64)
        start = np.zeros(len(buckets), np.int64)
        size[order] = sent
        start[order] = np.cumsum(sent) - sent
        out = emit(docs, counts, codes, ids, start, size)
        return pa.concat_tables([out] * positions.num_rows)

    return run


def _ids_of_documents(docs, counts, codes, ids, start, size):
    import numpy as np
    import pyarrow as pa

    from accordance.llm.pretokens import ragged

    length = size[codes]
    whole = ragged(ids, start[codes], length)
    after = np.concatenate([[0], np.cumsum(length)])
    edge = after[np.concatenate([[0], np.cumsum(counts)])]
    data = whole.astype("<u4", copy=False).tobytes()
    return pa.table(
        {
            "doc_id": pa.array(docs, pa.int64()),
            "n_tokens": pa.array(np.diff(edge), pa.int64()),
            "ids": pa.array([data[4 * i : 4 * j] for i, j in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.binary()),
        }
    )


def encode(
    docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str | Column = "text"
) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) of each row.

    A null or empty text has no ids. Repeated rows give repeated results, a null
    ``doc_id`` stays null, other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    common.ship(spark)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_of(text).alias("text"))
    return _encoded(source, rank_encoder(ranks, pattern), None, _ids_of_documents, IDS)


def _encoded(source: DataFrame, encoder: Callable, special: str | None, emit: Callable, schema: str) -> DataFrame:
    n = common.width(source.sparkSession)
    positions = source.mapInArrow(common.thrifty(position_rows(n, special)), _POSITIONS)
    answers = replies(source, encoder, special)
    both = positions.groupBy("block").cogroup(answers.groupBy("block"))
    return both.applyInArrow(common.thrifty_groups(place(emit)), schema)


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """``doc_id`` and ``bytes``: the ids joined to the table of token bytes.

    The table is the vocabulary file, so its size is fixed by the vocabulary. Null ids
    give null bytes.
    """
    common.ship(encoded.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from accordance.llm.vocabulary import token_bytes

        find = token_bytes(ranks).__getitem__
        for batch in batches:
            out = [
                None if b is None else b"".join(map(find, np.frombuffer(b, "<u4").tolist()))
                for b in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    return digests(common.table(spark, sf_dir, "documents"))


def round_trip(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """`encode`, with ``bytes``: the ids joined to the token bytes while they are at hand."""

    def emit(*block):
        import numpy as np
        import pyarrow as pa

        from accordance.llm.vocabulary import token_bytes

        find = token_bytes(ranks).__getitem__
        out = _ids_of_documents(*block)
        data = [b"".join(map(find, np.frombuffer(b, "<u4").tolist())) for b in out.column("ids").to_pylist()]
        return out.append_column("bytes", pa.array(data, pa.binary()))

    common.ship(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_of(text).alias("text"))
    return _encoded(source, rank_encoder(ranks, pattern), None, emit, f"{IDS}, bytes binary")


def digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    whole = round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return whole.select(
        "doc_id", "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


QUERIES = {"op10_byte_bpe": (op10_byte_bpe, None)}
