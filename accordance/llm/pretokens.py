"""Byte-level BPE pre-tokens of many texts at once, as numpy arrays.

The pattern splits a text into contractions, runs of letters, of digits and of other
signs, each with one blank before it, and white space. Every border follows from the
classes of neighbouring characters, so whole blocks of texts are split with array
operations instead of a match per pre-token.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
#: The property White_Space of Unicode (fixed values).
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
#: Characters of a block; a longer text is a block of its own.
BLOCK_CHARS = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_KEY = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(1)
def _classes() -> np.ndarray:
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    # in pieces, one of which is all surrogates: a worker never holds all characters as objects
    for first in (*range(0, 0xD800, 0x800), *range(0xE000, 0x110000, 0x800)):
        piece = "".join(map(chr, range(first, first + 0x800)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
            for m in regex.finditer(pattern, piece):
                table[first + m.start() : first + m.end()] = kind
    table[list(WHITE_SPACE)] = SPACE
    return table


class _Powers:
    """Powers of the base and of its inverse modulo 2**64: of 0 to `STEP` - 1, and of multiples of `STEP`, more when needed."""

    STEP = 1 << 12
    inverse = pow(int(_BASE), -1, 1 << 64)
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(STEP - 1, _BASE)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(STEP - 1, np.uint64(inverse))]), dtype=np.uint64)
    far_up = far_down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        """Makes the powers of 0 to ``n``."""
        rows = n // cls.STEP + 1
        if len(cls.far_up) < rows:
            for name, b in (("far_up", int(_BASE)), ("far_down", cls.inverse)):
                step = np.uint64(pow(b, cls.STEP, 1 << 64))
                setattr(cls, name, np.cumprod(np.concatenate([[np.uint64(1)], np.full(rows - 1, step)]), dtype=np.uint64))

    @classmethod
    def raise_all(cls, values: np.ndarray) -> None:
        """Each value times the power of its position, in place."""
        n = len(values)
        cls.reach(n)
        whole = n // cls.STEP
        rows = values[: whole * cls.STEP].reshape(whole, cls.STEP)
        rows *= cls.up
        rows *= cls.far_up[:whole, None]
        rest = values[whole * cls.STEP :]
        rest *= cls.up[: len(rest)]
        rest *= cls.far_up[whole]

    @classmethod
    def lowered(cls, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Each value times the inverse of the power of its position ``at``."""
        if len(at):
            cls.reach(int(at.max()))
        return values * cls.down[at % cls.STEP] * cls.far_down[at // cls.STEP]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """``n + 1`` running sums of values times powers, modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    own = out[1:]
    np.add(values, np.uint64(1), out=own)
    own *= _KEY
    _Powers.raise_all(own)
    np.cumsum(own, out=own)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads differences over all 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever the span stands."""
    return mix(_Powers.lowered(sums[ends] - sums[starts], starts) + (ends - starts).astype(np.uint64) * _BASE)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def token_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in joined texts.

    ``first`` holds the ascending positions at which texts begin; no pre-token
    crosses one of them. Empty texts are left out by the caller.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    border = np.empty(n, bool)
    border[0] = True
    np.not_equal(kind[1:], kind[:-1], out=border[1:])
    border[first] = True
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    opens[n] = True
    start = np.flatnonzero(border)
    end = np.append(start[1:], n)
    runs = kind[start]
    blank = runs == SPACE
    followed = ~opens[end]
    last_is_blank = points[end - 1] == 32
    # a blank right before another run belongs to that run
    lent = blank & followed & last_is_blank
    mark = np.zeros(n + 1, bool)
    own = start - np.concatenate([[False], lent[:-1]]).astype(np.int64)
    mark[own[~blank]] = True
    mark[start[blank & (~followed | (end - start > 1))]] = True
    mark[end[blank & followed & ~last_is_blank] - 1] = True
    # contractions: a lone apostrophe that took no blank, and letters after it
    lone = np.flatnonzero((runs == OTHER) & (end - start == 1) & (own == start) & followed)
    lone = lone[points[start[lone]] == 39]
    if len(lone):
        lone = lone[runs[lone + 1] == LETTER]
        a, letters_end = start[lone] + 1, end[lone + 1]
        c1 = points[a]
        c2 = points[np.minimum(a + 1, n - 1)]
        two = a + 1 < letters_end
        one = np.isin(c1, [ord(c) for c in "stmd"])
        pair = two & (((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l"))))
        taken = np.where(one, 1, np.where(pair, 2, 0))
        hit = taken > 0
        mark[a[hit]] = False
        more = a + taken < letters_end
        mark[(a + taken)[hit & more]] = True
    return np.flatnonzero(mark[:n])


class Block:
    """Texts of one block, split: distinct pre-tokens and the index of each occurrence."""

    def __init__(self, texts: list[str], special: str | None = None):
        parts, own, is_special = [], [], []
        for i, text in enumerate(texts):
            if special and special in text:
                for k, piece in enumerate(text.split(special)):
                    if k:
                        parts.append(special), own.append(i), is_special.append(True)
                    if piece:
                        parts.append(piece), own.append(i), is_special.append(False)
            elif text:
                parts.append(text), own.append(i), is_special.append(False)
        whole = "".join(parts)
        points = code_points(whole)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.cumsum(lengths) - lengths
        starts = token_starts(points, first)
        if any(is_special):
            keep = np.ones(len(points) + 1, bool)
            for at in np.flatnonzero(is_special):
                keep[first[at] + 1 : first[at] + lengths[at]] = False
            starts = starts[keep[starts]]
        ends = np.append(starts[1:], len(points)).astype(np.int64)
        hashes = span_hashes(prefix_sums(points), starts, ends)
        for k in np.flatnonzero(ends - starts > 64):  # long ones by a hash without structure
            hashes[k] = strong(whole[starts[k] : ends[k]])
        codes, self.hashes = pd.factorize(hashes)
        self.codes = codes.astype(np.uint32)
        seen = np.full(len(self.hashes), -1, np.int64)
        seen[codes[::-1]] = np.arange(len(codes))[::-1]
        self.words = [whole[a:b] for a, b in zip(starts[seen].tolist(), ends[seen].tolist())]
        # occurrences of each text
        text_of = np.asarray(own, np.int64)
        counts = np.zeros(len(texts), np.int64)
        if len(starts):
            np.add.at(counts, text_of[np.searchsorted(first, starts, "right") - 1], 1)
        self.counts = counts


def strong(word: str) -> np.uint64:
    from hashlib import blake2b

    return np.uint64(int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little"))


def in_blocks(batches: Iterator, chars: int = BLOCK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(doc ids, texts) of Arrow batches of (doc_id, text), regrouped into blocks."""
    ids: list = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        for row in range(0, batch.num_rows, 256):  # few strings beside the batch at a time
            part = batch.slice(row, 256)
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                t = t or ""
                if held and held + len(t) > chars:
                    yield ids, texts
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(t)
                held += len(t)
    if ids:
        yield ids, texts


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``values[s : s + n]`` for all pairs."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    at = np.arange(total) - np.repeat(before - starts, lengths)
    return values[at]


def squeeze(data: bytes | np.ndarray) -> bytes:
    """Bytes, or unsigned 32-bit values with bytes of equal weight side by side, compressed."""
    import pyarrow as pa

    if isinstance(data, np.ndarray):
        data = np.ascontiguousarray(data, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    import pyarrow as pa

    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def unsqueeze_values(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()
