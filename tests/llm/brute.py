"""Plain Python versions of the operators, and small tables with every odd case."""

from __future__ import annotations

import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def odd_texts() -> list[tuple]:
    """(doc_id, text, id, label, n): nulls, empty and long texts, ties, repeats, clashing columns."""
    rng = random.Random(7)
    words = ["alpha", "beta", "Gamma", "delta's", "don't", "12", "x9", "été", "中文", "-", "...", "\n", "  ", "😀"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "..."), (104, "word " * 4000), (105, "z" * 9000)]
    rows += [(106, texts[0]), (106, texts[0]), (107, texts[1] + " end"), (None, texts[2]), (None, None)]
    rows += [(108, "say <|endoftext|> and <|endoftext|><|endoftext|>  end"), (109, "ab cd ef"), (110, "I'LL we'll 'sam")]
    return [(i, t, 1, "clash", 2.0) for i, t in rows]


COLUMNS = "doc_id long, text string, set_id long, class string, n double"


def components(nodes, pairs) -> dict:
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def shingles(text: str | None, k: int) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if len(w) >= k:
        return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    return frozenset([tuple(w)] if w else [])


def near_duplicates(rows, k: int, percent: int) -> list[tuple]:
    """(doc_id, set size, component) of each row; ids are distinct here."""
    sets = {i: shingles(t, k) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    both = Counter()
    for own in holders.values():
        for x in range(len(own)):
            for y in range(x):
                both[own[y], own[x]] += 1
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    comp = components(sets, links)
    return [(i, len(sets[i]), comp[i]) for i in sets]


def contamination(docs, items) -> list[tuple]:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(LOW))
        for j in range(max(1, len(w) - 12)) if w else []:
            windows[tuple(w[j : j + 13])].add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w = word.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for m in {len(x) for x in windows}:
            for j in range(len(w) - m + 1):
                if tuple(w[j : j + m]) in windows:
                    found |= windows[tuple(w[j : j + m])]
                    hit.update(range(j, j + m))
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def repeats(rows, length: int = 200) -> list[tuple]:
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in raw for p in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def little_endian(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> tuple:
    """The numbers of spans of each base kind, and all spans as listed."""
    counts, spans = [], []
    for kind, pattern in BASE.items():
        found = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and _luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                found.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(len(found))
        spans += found
    return (*counts, ",".join(spans))
