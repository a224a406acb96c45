"""Token counts from the frequencies of pre-tokens; no id of a document is ever made.

1. Blocks of documents are split into pre-tokens; a block keeps its distinct pre-tokens
   once, and per document the frequency of each.
2. The distinct pre-tokens meet by hash bucket, where the library counts the pieces of
   each distinct pre-token of the whole corpus once.
3. The counts return to their block and are joined to the frequencies, and each document
   sums frequency times pieces.

A frequent pre-token travels once per block, so no pre-token is a hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordance.llm import common
from accordance.llm.bpe import word_rows

COUNTS = "doc_id long, n_bytes long, n_tokens long"
_PIECES = "block string, bucket int, pieces binary"
_FREQUENCIES = (
    "block string, docs array<bigint>, n_bytes binary, pairs binary, codes binary, times binary, buckets binary"
)


def frequency_rows(n_buckets: int, special: str | None) -> Callable:
    """A task that keeps, per block, how often each document holds each pre-token."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from accordance.llm.bpe import blocks_of, spread
        from accordance.llm.pretokens import squeeze

        for ids, block, name in blocks_of(batches, special):
            n = max(1, len(block.words))
            doc = np.repeat(np.arange(len(ids)), block.counts)
            key, times = np.unique(doc * n + block.codes, return_counts=True)
            word_bytes = np.fromiter((len(w.encode()) for w in block.words), np.int64, len(block.words))
            n_bytes = np.zeros(len(ids), np.int64)
            np.add.at(n_bytes, key // n, word_bytes[key % n] * times)
            pairs = np.bincount(key // n, minlength=len(ids)).astype(np.int64)
            bucket = (block.hashes % np.uint64(n_buckets)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([spread(name, block)], pa.string()), pa.array([ids], pa.list_(pa.int64())),
                    *(
                        pa.array([x], pa.binary())
                        for x in (n_bytes.tobytes(), pairs.tobytes(), squeeze(key % n), squeeze(times), squeeze(bucket))
                    ),
                ],
                names=["block", "docs", "n_bytes", "pairs", "codes", "times", "buckets"],
            )

    return run


def count_words(path: str) -> Callable:
    """A task that counts the pieces of each distinct pre-token of its buckets once."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from accordance.llm.bpe import once
        from accordance.llm.pretokens import squeeze, unsqueeze, unsqueeze_values
        from accordance.llm.vocabulary import library

        encode = library(path).encode
        known: dict[bytes, int] = {}
        answered: set = set()
        for batch in batches:
            bucket, block, words, sizes = once(batch, answered)
            out = []
            for blob, size in zip(words, sizes):
                ends = np.cumsum(unsqueeze_values(size), dtype=np.int64).tolist()
                blob = unsqueeze(blob)
                own = [blob[i:j] for i, j in zip([0, *ends], ends)]
                new = [w for w in own if w not in known]
                if new:
                    found = encode([w.decode() for w in new], is_pretokenized=True, add_special_tokens=False)
                    n = np.bincount(np.asarray(found.word_ids, np.int64), minlength=len(new))
                    known.update(zip(new, n.tolist()))
                out.append(squeeze(np.fromiter((known[w] for w in own), np.uint32, len(own))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(block, pa.string()), pa.array(bucket, pa.int32()), pa.array(out, pa.binary())],
                names=["block", "bucket", "pieces"],
            )

    return run


def _sum(_key, frequencies, answers):
    import numpy as np
    import pyarrow as pa

    from accordance.llm.pretokens import unsqueeze_values

    if not frequencies.num_rows:
        raise RuntimeError("piece counts came back for a block that was not split again: the input is not stable")
    docs = frequencies.column("docs")[0].as_py()
    n_bytes, pairs = (np.frombuffer(frequencies.column(k)[0].as_py(), np.int64) for k in ("n_bytes", "pairs"))
    codes, times, buckets = (unsqueeze_values(frequencies.column(k)[0].as_py()) for k in ("codes", "times", "buckets"))
    rows = sorted(zip(answers.column("bucket").to_pylist(), answers.column("pieces").to_pylist()))
    sent = np.concatenate([np.zeros(0, np.uint32), *(unsqueeze_values(r[1]) for r in rows)])
    if len(sent) != len(buckets):
        raise RuntimeError("a block has another number of pre-tokens than were counted: the input is not stable")
    pieces = np.zeros(len(buckets), np.int64)
    pieces[np.argsort(buckets, kind="stable")] = sent
    running = np.concatenate([[0], np.cumsum(pieces[codes] * times)])
    edge = np.concatenate([[0], np.cumsum(pairs)])
    out = pa.table(
        {
            "doc_id": pa.array(docs, pa.int64()),
            "n_bytes": pa.array(n_bytes, pa.int64()),
            "n_tokens": pa.array(np.diff(running[edge]), pa.int64()),
        }
    )
    return pa.concat_tables([out] * frequencies.num_rows)  # equal blocks: once for each


def count_tokens(
    docs: DataFrame, tokenizer: str, special: str | None, doc_id: str = "doc_id", text: str | Column = "text"
) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of each row's whole text.

    ``special`` is the string that the library takes as one token wherever it stands.
    A null or empty text counts 0. Repeated rows give repeated results, a null ``doc_id``
    stays null, other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    common.ship(spark)
    n = common.width(spark)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_of(text).alias("text"))
    frequencies = source.mapInArrow(frequency_rows(n, special), _FREQUENCIES)
    words = source.mapInArrow(word_rows(n, special), "bucket int, block string, words binary, sizes binary")
    answers = words.repartitionById(n, "bucket").mapInArrow(count_words(tokenizer), _PIECES)
    return frequencies.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_sum, COUNTS)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they pass a context of 1024."""
    return budgeted(common.table(spark, sf_dir, "documents"))


def budgeted(docs: DataFrame, limit: int = 1024) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), "<|endoftext|>")
    return counted.select("*", (F.col("n_tokens") > limit).alias("over_limit"))


QUERIES = {"op5_token_counts": (op5_token_counts, None)}
