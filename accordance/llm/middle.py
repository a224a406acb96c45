"""Fill-in-middle examples: each text is cut at two places that its id alone decides.

Units are words with the white space before them; white space at the end of a text is a unit too.
A text is held in blocks of ``BLOCK`` bytes. A Fenwick tree over the blocks stores how
many units end, and how many code points begin, in each; descending it by binary lifting
finds the block of the k-th unit's end together with the code points before that block, and the
boundary itself is looked for in that one block.

Each text is cut by itself in the task that reads it: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordance.llm import common

BLOCK = 256
#: What opens the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


class BlockTree:
    """Cumulated counts over blocks of one text, with the descent to the k-th unit."""

    def __init__(self, ends, begins):
        """``ends`` and ``begins`` tell for each byte whether a unit ends, a code point begins there."""
        import numpy as np

        self.ends, self.begins = ends, begins
        firsts = np.arange(0, len(ends), BLOCK)
        counts = np.stack([np.add.reduceat(x, firsts, dtype=np.int64) for x in (ends, begins)]) if len(ends) else np.zeros((2, 0), np.int64)
        sums = np.zeros((2, counts.shape[1] + 1), np.int64)
        np.cumsum(counts, axis=1, out=sums[:, 1:])
        at = np.arange(1, sums.shape[1])
        # node i holds the blocks from i - (its lowest set bit) up to i
        self.units, self.points = (np.concatenate([[0], s[at] - s[at - (at & -at)]]).tolist() for s in sums)
        self.size = len(at)

    def find(self, k: int) -> tuple[int, int]:
        """The byte and the code point behind the ``k``-th unit; (0, 0) for k = 0."""
        import numpy as np

        if k <= 0:
            return 0, 0
        at, points, left, step = 0, 0, k, 1 << (self.size.bit_length() - 1)
        while step:
            to = at + step
            if to <= self.size and self.units[to] < left:
                at, points, left = to, points + self.points[to], left - self.units[to]
            step >>= 1
        here = slice(at * BLOCK, (at + 1) * BLOCK)
        inside = int(np.flatnonzero(self.ends[here])[left - 1]) + 1
        return at * BLOCK + inside, points + int(self.begins[here][:inside].sum())


def _masks(data):
    """For every byte of a text: does a unit end there, does a code point begin there."""
    import numpy as np

    from accordance.llm.words import BLANKS

    word = BLANKS[data]
    ends = np.ones(len(data), bool)
    ends[:-1] = word[:-1] & ~word[1:]
    return ends, (data & 0xC0) != 0x80


def cut_points(doc_id: int | None, n: int, seed: int) -> tuple[int, int, int, int]:
    """Units before the middle, units before the suffix, and two numbers that decide the form."""
    from hashlib import sha256

    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    return min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1)), h[2] % 100, h[3] % 100


def _transform(seed: int, rate: int, spm_rate: int, marks: tuple[str, str, str]) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from accordance.llm.middle import BlockTree, _masks, cut_points
        from accordance.llm.words import chunks

        p, s, m = (x.encode() for x in marks)
        for rows in chunks(batches, 2):
            out = []
            for doc_id, text in rows:
                ends, begins = _masks(np.frombuffer(text, np.uint8))
                n = int(ends.sum())
                first, second, by_form, by_order = cut_points(doc_id, n, seed)
                if not text or by_form >= rate or p in text or s in text or m in text:
                    out.append((doc_id, n, "plain", None, None, text))
                    continue
                tree = BlockTree(ends, begins)
                (i, before), (j, until) = tree.find(first), tree.find(second)
                spm = by_order < spm_rate
                parts = (s, text[j:], p, text[:i], m, text[i:j]) if spm else (p, text[:i], s, text[j:], m, text[i:j])
                out.append((doc_id, n, "spm" if spm else "psm", before, until - before, b"".join(parts)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def _distinct(marks: tuple[str, str, str]) -> None:
    """Marks must be found again without doubt, whatever stands before and behind them."""
    for x in marks:
        for y in marks:
            if not x or x in y and x is not y or any(x[k:] == y[: len(x) - k] for k in range(1, len(x))):
                raise ValueError(f"marks {x!r} and {y!r} can be taken for each other")


def fill_in_middle(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, marks: tuple[str, str, str] = MARKS,
    doc_id: str = "doc_id", text: str | Column = "text",
) -> DataFrame:
    """``doc_id``, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` and the ``output`` text.

    Of 100 texts about ``rate`` are cut, of these ``spm_rate`` in the order suffix, prefix,
    middle and the others in the order prefix, suffix, middle. A null or empty text, and one that
    holds a mark, stays plain, with null lengths. Rows with one id are cut by the same
    numbers, rows without an id by those of an empty id; repeated rows give repeated results. Other
    columns are not read, so their names cannot clash. An empty table gives no rows.
    """
    _distinct(marks)
    common.ship(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_of(text).cast("binary").alias("text"))
    out = source.mapInArrow(_transform(seed, rate, spm_rate, tuple(marks)), _OUT)
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: str | Column = "output", form: str | Column = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text an output was made from.

    A cut text holds no mark of its own, and no mark can begin in a part and end in the mark behind
    it, so the three marks of an output are the only ones.
    """
    o, f = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    pattern = "|".join("\\Q" + x + "\\E" for x in marks)
    part = F.split(o, pattern, -1)
    whole = F.when(f == "spm", F.concat(part[2], part[3], part[1])).when(f == "psm", F.concat(part[1], part[3], part[2]))
    return F.coalesce(whole, o)


def digests(docs: DataFrame) -> DataFrame:
    """The examples with digests in place of texts; odd rows as in `fill_in_middle`."""
    out = fill_in_middle(docs)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored().cast("binary"), 256).alias("restored_sha256"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as fill-in-middle examples, and rebuilt from them."""
    return digests(common.table(spark, sf_dir, "documents"))


_SQL = r"""
WITH units AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
numbers AS (SELECT *, len(u)::BIGINT AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
    ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM units),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
    coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
           ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts
"""

QUERIES = {"op12_fill_in_middle": (op12_fill_in_middle, _SQL)}
