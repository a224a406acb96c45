"""Language identification with interpolated Kneser-Ney character models.

Every character 4-gram of all labelled training texts is counted per language (counts are
added up inside the tasks first, so a language that holds most rows is no hot key).
Lower orders use continuation counts, as Kneser-Ney asks. The model is a table of one
log-probability per gram and language and one back-off per context and language; no gram
is left out, whatever its count, and the driver holds a few numbers per language only.

A text belongs to the language with the lowest cross-entropy per character. Blocks of
documents send their distinct grams by hash bucket; a bucket of the model is one sorted array in
one task, whose answers return to the block.

Rejection is calibrated on the counts: each language's model knows the mean and the
variance of its own surprisal, with 4-grams seen once scored as if they had not been
seen. A text whose best cross-entropy lies further above the mean than `MARGIN` and
`Z` standard errors of a text of its length is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordance.llm import common

ORDER = 4
#: Nats per character, and standard errors, above a language's own entropy.
MARGIN, Z = 1.0, 4.0
#: Characters whose evidence the score trusts at most.
EVIDENCE = 40
UNKNOWN = "und"
#: Characters whose grams are made or scored at once.
_AT_ONCE = 1 << 18
#: Characters of a block, which asks for each distinct gram once.
BLOCK_CHARS = 1 << 22
_PAD = 1


@lru_cache(1)
def _fold():
    """Characters as 16-bit codes: lower case, digits alike, the upper planes on 2048 codes."""
    import numpy as np

    low = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000:
            one = chr(c).lower()
            low[c] = ord(one) if len(one) == 1 else c
    low[0x30:0x3A] = 0x30
    high = low >= 0x10000
    low[high] = 0xD800 + low[high] % 2048
    return low.astype(np.uint16)


def keys_of(texts: list[str]):
    """The packed 4-gram ending at each character, and each text's first position."""
    import numpy as np

    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    first = np.cumsum(lengths) - lengths
    codes = np.full(len(points) + (ORDER - 1) * len(texts), _PAD, np.uint16)
    shift = np.repeat((ORDER - 1) * np.arange(1, len(texts) + 1), lengths)
    at = np.arange(len(points)) + shift
    codes[at] = _fold()[points]
    wide = codes.astype(np.uint64)
    key = wide[at]
    for k in range(1, ORDER):
        key |= wide[at - k] << np.uint64(16 * k)
    return key, first, lengths, points


def _chunks(batches, n_columns: int):
    """Lists of rows with text in the last column, about `_AT_ONCE` characters each."""
    rows, held = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):  # few strings beside the batch at a time
            part = batch.slice(at, 64)
            for row in zip(*(part.column(k).to_pylist() for k in range(n_columns))):
                rows.append(row)
                held += len(row[-1])
                if held >= _AT_ONCE:
                    yield rows
                    rows, held = [], 0
    if rows:
        yield rows


def _count(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    from accordance.llm.language import _chunks, keys_of

    held: dict[str, list] = {}

    def merged(parts):
        keys = np.concatenate([p[0] for p in parts])
        keys, at = np.unique(keys, return_inverse=True)
        return keys, np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

    for rows in _chunks(batches, 2):
        by: dict[str, list[str]] = {}
        for lang, text in rows:
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            key, *_ = keys_of(texts)
            parts = held.setdefault(lang, [])
            parts.append(np.unique(key, return_counts=True))
            if sum(len(p[0]) for p in parts[1:]) > 1 << 20:
                held[lang] = [merged(parts)]
    for lang, parts in held.items():
        keys, n = merged(parts)
        for i in range(0, len(keys), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys[part])), pa.array(keys[part].view(np.int64)), pa.array(n[part])],
                names=["lang", "key", "n"],
            )


#: Kinds of entries besides whole 4-grams, in the upper 16 bits of an id: shorter grams by
#: their order, and the contexts of grams of an order.
_GRAM = {o: o for o in range(1, ORDER)}
_CONTEXT = {o: ORDER - 1 + o for o in range(1, ORDER + 1)}
_MIX = (31_337, 40_503, 60_493, 15_731)


def _mask(order: int) -> int:
    return (1 << (16 * order)) - 1


def bucket_of(ids, n_buckets: int):
    """The bucket of each id; `_bucket` is the same as a column."""
    import numpy as np

    parts = sum((ids >> np.uint64(16 * k) & np.uint64(0xFFFF)) * np.uint64(m) for k, m in enumerate(_MIX))
    return (parts % np.uint64(n_buckets)).astype(np.int32)


def _bucket(i: Column, n_buckets: int) -> Column:
    parts = [F.shiftrightunsigned(i, 16 * k).bitwiseAND(F.lit(0xFFFF)) * F.lit(m).cast("long") for k, m in enumerate(_MIX)]
    return F.pmod(sum(parts[1:], parts[0]), F.lit(n_buckets)).cast("int")


def needed(grams):
    """All ids whose entries the score of 4-grams can need: whole 4-grams, and the others."""
    import numpy as np

    parts = []
    for order in range(1, ORDER + 1):
        own = np.unique(grams & np.uint64(_mask(order)))
        if order < ORDER:
            parts.append(own | np.uint64(_GRAM[order] << 48))
        parts.append(np.unique(own >> np.uint64(16)) | np.uint64(_CONTEXT[order] << 48))
    return np.unique(grams), np.unique(np.concatenate(parts))


class Entries:
    """Some entries of a model as sorted arrays: per id the languages that know it, and their values."""

    def __init__(self, four, ids, langs, values):
        """Parallel arrays of single entries; the same entry may come repeatedly."""
        self.tables = [self._table(ids[own], langs[own], values[own]) for own in (~four, four)]

    @classmethod
    def of_sides(cls, sides: Iterator) -> Entries:
        """From (ids, langs, values) of the other entries and then of the 4-grams; one side is held at a time."""
        out = cls.__new__(cls)
        out.tables = [cls._table(*side) for side in sides]
        return out

    @staticmethod
    def _table(i, k, v):
        import numpy as np

        by = np.lexsort((k, i))
        i, k, v = i[by], k[by], v[by]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (k[1:] != k[:-1])
        if not new.all():
            i, k, v = i[new], k[new], v[new]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1])[: len(i)])
        return i[first], np.append(first, len(i)), k, v

    def find(self, four: bool, ids):
        """Of the entries of ``ids``: at which of ``ids`` each stands, its language, its value."""
        import numpy as np

        from accordance.llm.pretokens import ragged

        keys, edge, langs, values = self.tables[four]
        if not len(keys):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.float32)
        at = np.minimum(np.searchsorted(keys, ids), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == ids)
        at = at[hit]
        length = edge[at + 1] - edge[at]
        return np.repeat(hit, length), ragged(langs, edge[at], length), ragged(values, edge[at], length)

    def score(self, grams, n_langs: int, floor: float, order: int = ORDER):
        """Log-probability of the last character of each gram, per language."""
        import numpy as np

        if order == 0:
            return np.full((len(grams), n_langs), floor, np.float32)
        short, at = np.unique(grams & np.uint64(_mask(order - 1)), return_inverse=True)
        out = self.score(short, n_langs, floor, order - 1)[at]
        i, k, v = self.find(False, grams >> np.uint64(16) | np.uint64(_CONTEXT[order] << 48))
        out[i, k] += v
        i, k, v = self.find(order == ORDER, grams if order == ORDER else grams | np.uint64(_GRAM[order] << 48))
        out[i, k] = v
        return out


class Model:
    """A table of log-probabilities and back-offs, with the few numbers of each language.

    ``table`` has a row (four, id, lang, value) for every gram and context of every language.
    """

    def __init__(self, table: DataFrame, langs: list[str], floor: float, mean: list[float], variance: list[float]):
        self.table, self.langs, self.floor, self.mean, self.variance = table, langs, floor, mean, variance

    def score(self, grams):
        """Log-probability of the last character of each of a few grams, per language."""
        import numpy as np

        whole, other = needed(grams)
        parts = [
            self.table.where(F.col("four") == four).where(F.col("id").isin(ids.view(np.int64).tolist()))
            for four, ids in ((True, whole), (False, other))
        ]
        return Entries(*_entry_arrays(parts[0].union(parts[1]).toArrow())).score(grams, len(self.langs), self.floor)


def _entry_arrays(rows):
    import numpy as np

    four = np.asarray(rows.column("four").to_pylist(), bool)
    ids = rows.column("id").to_numpy().view(np.uint64)
    return four, ids, rows.column("lang").to_numpy().astype(np.int64), rows.column("value").to_numpy()


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """The model of all rows whose text and language are not null; None without such rows."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")
    )
    counts = common.written(
        rows.mapInArrow(common.thrifty(_count), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    )
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    numbers = spark.createDataFrame(list(enumerate(langs)), "k int, lang string")
    key = F.col("key")
    levels = {ORDER: counts.join(F.broadcast(numbers), "lang").select("k", "key", F.col("n").cast("double").alias("n"))}
    for order in range(ORDER - 1, 0, -1):
        # continuation counts: in how many different left contexts a shorter gram stands
        short = key.bitwiseAND(F.lit(_mask(order))).alias("key")
        levels[order] = common.written(levels[order + 1].groupBy("k", short).agg(F.count(F.lit(1)).cast("double").alias("n")))
    floor = -math.log(levels[1].select("key").distinct().count() + 1.0)
    below, entries = None, None
    for order in range(1, ORDER + 1):
        own = levels[order].withColumn("context", F.shiftrightunsigned(key, 16))
        few = own.groupBy("k").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
        d = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
        few = F.broadcast(few.select("k", d.alias("d")))
        contexts = own.groupBy("k", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).join(few, "k")
        contexts = common.written(contexts.withColumn("share", F.col("d") * F.col("kinds") / F.col("total")))
        found = own.join(contexts.select("k", "context", "d", "total", "share"), ["k", "context"])
        if below is None:
            found = found.withColumn("low", F.lit(math.exp(floor)))
        else:
            found = found.withColumn("short", key.bitwiseAND(F.lit(_mask(order - 1))))
            found = found.join(below.select("k", F.col("key").alias("short"), F.col("p").alias("low")), ["k", "short"])
        unseen = F.col("share") * F.col("low")
        p = unseen + F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")
        below = common.written(found.select("k", "key", "n", unseen.alias("unseen"), p.alias("p")))
        kind = 0 if order == ORDER else _GRAM[order] << 48
        both = below.select(
            F.lit(order == ORDER).alias("four"), key.bitwiseOR(F.lit(kind).cast("long")).alias("id"),
            F.col("k").alias("lang"), F.ln("p").cast("float").alias("value"),
        ).union(
            contexts.select(
                F.lit(False), F.col("context").bitwiseOR(F.lit(_CONTEXT[order] << 48)), "k", F.ln("share").cast("float")
            )
        )
        entries = both if entries is None else entries.union(both)
    # the surprisal of each language's own texts, grams seen once as if not seen
    surprise = -F.ln(F.when(F.col("n") == 1, F.col("unseen")).otherwise(F.col("p")))
    weighed = below.select("k", "n", surprise.alias("s")).groupBy("k")
    mean = F.sum(F.col("n") * F.col("s")) / F.sum("n")
    stats = weighed.agg(mean.alias("mean"), (F.sum(F.col("n") * F.col("s") * F.col("s")) / F.sum("n")).alias("square"))
    stats = sorted(tuple(r) for r in stats.collect())
    return Model(entries, langs, floor, [m for _, m, _ in stats], [max(0.0, q - m * m) for _, m, q in stats])


SCORES = "lang_pred string, score double, cross_entropy double, rejected boolean"


def _blocks(batches: Iterator, at: int):
    """(name, rows) of blocks of about `BLOCK_CHARS` characters; equal texts give equal names.

    A block without characters asks nothing and is named by its task, so that such blocks
    need not meet.
    """
    from hashlib import blake2b

    import pyarrow as pa
    from pyspark import TaskContext

    def block(parts):
        rows = pa.Table.from_batches(parts).combine_chunks()
        texts = rows.column(at).to_pylist()
        if not any(texts):
            return f"/{TaskContext.get().partitionId()}", rows, texts
        h = blake2b(repr([t and len(t) for t in texts]).encode(), digest_size=16)
        for t in texts:
            h.update((t or "").encode())
        return h.hexdigest(), rows, texts

    parts, held = [], 0
    for batch in batches:
        for row in range(0, batch.num_rows, 64):
            part = batch.slice(row, 64)
            parts.append(part)
            held += sum(len(t) for t in part.column(at).to_pylist() if t)
            if held >= BLOCK_CHARS:
                yield block(parts)
                parts, held = [], 0
    if parts:
        yield block(parts)


def _packed_rows(at: int):
    """A task that packs each block into one row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from accordance.llm.language import _blocks

        for name, rows, _ in _blocks(batches, at):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "packed"]
            )

    return run


def pack_ids(ids) -> bytes:
    """Ascending ids as compressed differences, bytes of equal weight side by side."""
    import numpy as np

    from accordance.llm.pretokens import squeeze

    steps = np.diff(ids, prepend=np.uint64(0))
    return squeeze(np.ascontiguousarray(steps, np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_ids(data: bytes):
    import numpy as np

    from accordance.llm.pretokens import unsqueeze

    planes = np.frombuffer(unsqueeze(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


_ASKS = "bucket int, four boolean, id long, lang int, value float, block string, whole binary, other binary"


def _ask_rows(at: int, n_buckets: int):
    """A task that sends the distinct ids each block needs, one row per bucket."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from accordance.llm import language as lm

        for name, _, texts in lm._blocks(batches, at):
            parts, texts = [], [t for t in texts if t]
            for one in lm._text_chunks(texts):
                parts.append(np.unique(lm.keys_of(one)[0]))
            if not parts:
                continue
            asked = lm.needed(np.unique(np.concatenate(parts)))
            buckets = [lm.bucket_of(x, n_buckets) for x in asked]
            order = [np.argsort(b, kind="stable") for b in buckets]
            cuts = [np.searchsorted(b[o], np.arange(n_buckets + 1)) for b, o in zip(buckets, order)]
            sorted_ids = [x[o] for x, o in zip(asked, order)]
            rows = [
                (b, *(lm.pack_ids(x[c[b] : c[b + 1]]) for x, c in zip(sorted_ids, cuts)))
                for b in range(n_buckets) if any(c[b] < c[b + 1] for c in cuts)
            ]
            none = [None] * len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int32()), pa.array(none, pa.bool_()), pa.array(none, pa.int64()),
                    pa.array(none, pa.int32()), pa.array(none, pa.float32()), pa.array([name] * len(rows), pa.string()),
                    pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()),
                ],
                names=["bucket", "four", "id", "lang", "value", "block", "whole", "other"],
            )

    return run


_ANSWERS = "block string, four boolean, at binary, lang binary, value binary"


def _answer(batches: Iterator) -> Iterator:
    """Of a bucket: first its entries of the model, then the questions of all blocks."""
    import numpy as np
    import pyarrow as pa

    from accordance.llm import language as lm
    from accordance.llm.pretokens import squeeze

    held, known = [], None
    for batch in batches:
        asks = np.asarray(batch.column("block").is_valid())
        model = batch.filter(pa.array(~asks))
        if model.num_rows:
            held.append(lm._entry_arrays(model))
        questions = batch.filter(pa.array(asks))
        if not questions.num_rows:
            continue
        if known is None:
            none = (np.zeros(0, bool), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.float32))
            known = lm.Entries(*(np.concatenate(x) for x in zip(none, *held)))
            held = []
        for block, whole, other in zip(*(questions.column(c).to_pylist() for c in ("block", "whole", "other"))):
            out = []
            for four, data in ((True, whole), (False, other)):
                ids = lm.unpack_ids(data)
                at, lang, value = known.find(four, ids)
                bits = np.ascontiguousarray(value, np.float32).view(np.uint32)
                out.append((block, four, lm.pack_ids(ids[at]), squeeze(np.asarray(lang, np.uint32)), squeeze(bits)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.bool_()),
                    *(pa.array([r[c] for r in out], pa.binary()) for c in (2, 3, 4)),
                ],
                names=["block", "four", "at", "lang", "value"],
            )


def _text_chunks(texts: list[str]):
    """Lists of texts of about `_AT_ONCE` characters."""
    start = 0
    while start < len(texts):
        stop, held = start, 0
        while stop < len(texts) and held < _AT_ONCE:
            held += len(texts[stop])
            stop += 1
        yield texts[start:stop]
        start = stop


def _scored(rows, at: int, known: Entries | None, langs, floor, mean, variance):
    """The rows of a block with the columns of `SCORES`."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    from accordance.llm.pretokens import LETTER, _classes

    texts = [t or "" for t in rows.column(at).to_pylist()]
    pred = [UNKNOWN] * len(texts)
    score = np.zeros(len(texts))
    entropy = np.full(len(texts), np.nan)
    reject = np.ones(len(texts), bool)
    todo = [k for k, t in enumerate(texts) if t] if known else []
    start = 0
    for chunk in _text_chunks([texts[k] for k in todo]):
        part = todo[start : start + len(chunk)]
        start += len(chunk)
        key, first, lengths, points = keys_of(chunk)
        codes, grams = pd.factorize(key)
        table = known.score(grams, len(langs), floor)
        sums = np.stack(
            [np.add.reduceat(table[:, j][codes].astype(np.float64), first) for j in range(len(langs))], axis=1
        )
        letters = np.add.reduceat((_classes()[points] == LETTER).astype(np.int64), first)
        ce = -sums / lengths[:, None]
        best = ce.argmin(axis=1)
        low = ce[np.arange(len(part)), best]
        trust = np.minimum(lengths, EVIDENCE)[:, None]
        share = 1 / np.exp(-(ce - low[:, None]) * trust).sum(axis=1)
        bound = np.asarray(mean)[best] + MARGIN + Z * np.sqrt(np.asarray(variance)[best] / lengths)
        for i, k in enumerate(part):
            if letters[i]:
                pred[k] = langs[best[i]]
                score[k] = share[i]
                entropy[k] = low[i]
                reject[k] = low[i] > bound[i]
    new = (pa.array(pred, pa.string()), pa.array(score), pa.array(entropy, mask=np.isnan(entropy)), pa.array(reject))
    for name, column in zip(("lang_pred", "score", "cross_entropy", "rejected"), new):
        rows = rows.append_column(name, column)
    return rows


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected``.

    A null text, or one without a letter, is ``und``, scores 0, is rejected and has no
    cross-entropy. Ties go to the language that sorts first. Repeated rows give repeated results.
    """
    spark = docs.sparkSession
    common.ship(spark)
    read = (*keep, *(() if text in keep else (text,)))
    source = docs.select(*read)
    at = read.index(text)
    n = common.width(spark)
    has_model = model is not None
    langs, floor, mean, variance = (model.langs, model.floor, model.mean, model.variance) if model else ([], 0.0, [], [])
    packed = source.mapInArrow(common.thrifty(_packed_rows(at)), "block string, packed binary")
    if has_model:
        entries = model.table.select(
            _bucket(F.col("id"), n).alias("bucket"), "four", "id", "lang", "value",
            F.lit(None).cast("string").alias("block"), F.lit(None).cast("binary").alias("whole"), F.lit(None).cast("binary").alias("other"),
        )
        both = entries.union(source.select(*read).mapInArrow(common.thrifty(_ask_rows(at, n)), _ASKS))
        # an id's bucket is one task: the entries of the model come before the questions
        dealt = both.repartitionById(n, "bucket").sortWithinPartitions(F.col("block").asc_nulls_first())
        answers = dealt.mapInArrow(common.thrifty(_answer), _ANSWERS)
    else:
        answers = spark.createDataFrame([], _ANSWERS)

    def run(_key, blocks, answers):
        import numpy as np
        import pyarrow as pa

        from accordance.llm import language as lm
        from accordance.llm.pretokens import unsqueeze_values

        if not blocks.num_rows:
            raise RuntimeError("answers came back for a block that was not made again: the input is not stable")
        known = None
        if has_model:
            reads = (("at", lm.unpack_ids, np.uint64), ("lang", unsqueeze_values, np.uint32), ("value", unsqueeze_values, np.uint32))
            side = answers.column("four").to_pylist()

            def entries(four):
                ids, lang, value = (
                    np.concatenate([np.zeros(0, kind), *(read(x) for x, own in zip(answers.column(c).to_pylist(), side) if own == four)])
                    for c, read, kind in reads
                )
                return ids, lang, value.view(np.float32)

            known = lm.Entries.of_sides(entries(four) for four in (False, True))
        out = []
        for blob in blocks.column("packed").to_pylist():
            rows = pa.ipc.open_stream(blob).read_all()
            named = any(rows.column(at).to_pylist())
            if has_model and named and not answers.num_rows:
                raise RuntimeError("a block has no answers: the input is not stable")
            done = lm._scored(rows, at, known, langs, floor, mean, variance)
            out.append(done.select([*keep, "lang_pred", "score", "cross_entropy", "rejected"]))
        return pa.concat_tables(out)

    kept = T.StructType([source.schema[c] for c in keep] + T.StructType.fromDDL(SCORES).fields)
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(common.thrifty_groups(run), kept)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """A fixed quarter of the documents, by a checksum of the id; a null id is not in it."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out."""
    return predictions(common.table(spark, sf_dir, "documents"))


def predictions(docs: DataFrame) -> DataFrame:
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


@common.carried("doc_id", "text", "lang")
def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised, with their own columns only.

    Learned from all labelled documents; only `op2_language_id` holds some out. A null or empty text, or one without
    a letter, goes; without any labelled document all go. Repeated rows fare alike. An empty table gives no rows.
    """
    model = fit(docs)
    names = docs.columns
    return predict(docs, model, keep=tuple(names)).where(~F.col("rejected")).select(*names)


QUERIES = {"op2_language_id": (op2_language_id, None)}
