"""Words of many texts at once, as 64-bit hashes in numpy arrays, over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from accordance.llm.pretokens import mix, prefix_sums, span_hashes

CHUNK = 1 << 21
_STEP = np.uint64(0x9FB21C651E98DF25)


def byte_table(separators: bytes) -> np.ndarray:
    """Which bytes belong to words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Words are what stands between white space.
BLANKS = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of letters, digits and all characters beyond ASCII (upper case is lowered first).
LETTERS = byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def chunks(batches: Iterator, columns: int) -> Iterator[list[tuple]]:
    """Rows of Arrow batches with text in the last column, about `CHUNK` characters at a time."""
    rows, held = [], 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(columns))):
            rows.append(row)
            held += len(row[-1] or "")
            if held >= CHUNK:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def words_of(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word in order, and how many words each text has."""
    raw = [(t or "").encode() for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    data = _LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    n = len(data)
    counts = np.zeros(len(raw), np.int64)
    if not n:
        return np.zeros(0, np.uint64), counts
    first = np.cumsum(lengths) - lengths
    inside = np.zeros(n + 1, bool)
    inside[:n] = table[data]
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    start = inside[:n].copy()
    start[1:] &= ~inside[: n - 1] | opens[1:n]
    end = inside[:n] & (~inside[1:] | opens[1:])
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    hashes = span_hashes(prefix_sums(data), starts, ends)
    for k in np.flatnonzero(ends - starts > 256):  # long ones by a hash without structure
        from hashlib import blake2b

        hashes[k] = int.from_bytes(blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    some = np.flatnonzero(lengths)
    counts[some] = np.bincount(np.searchsorted(first[some], starts, "right") - 1, minlength=len(some))
    return hashes, counts


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the ``k`` words from each position on (``len - k + 1`` of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _STEP + hashes[j : j + n]
    return mix(out + np.uint64(k))
