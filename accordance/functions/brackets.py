"""Per-text bracket matching for the few answers the native tiers leave over.

Used from one vectorised UDF; each text is handled on its own.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right

_TOKEN = re.compile(r'["{}\[\]]')
#: The rest of a quoted text, to the quote that closes it.
_QUOTED = re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
_CLOSER = {"{": "}", "[": "]"}
#: What stands behind a quote that closes a value; each run of blanks is read once.
_CLOSES = re.compile(r"\s*+(?:[:}\]]|,\s*+[\"{\[\-0-9tfn]|,?\s*+\Z)")


def _spans(text: str, opener: str, quoted: bool) -> list[tuple[int, int, int]]:
    """(start, end, levels of brackets of either kind) of the pairs outside quotes."""
    closer = _CLOSER[opener]
    stack: list[list[int]] = []  # place, depth there, greatest depth since
    out: list[tuple[int, int, int]] = []
    at = depth = 0
    while True:
        if quoted:
            if (hit := _QUOTED.match(text, at)) is None:
                break
            at, quoted = hit.end(), False
        if (hit := _TOKEN.search(text, at)) is None:
            break
        token, at = hit.group(), hit.end()
        if token == '"':
            quoted = True
        elif token in _CLOSER:
            depth += 1
            if token == opener:
                stack.append([hit.start(), depth, depth])
            elif stack:
                stack[-1][2] = max(stack[-1][2], depth)
        else:
            depth -= 1
            if token == closer and stack:
                start, low, high = stack.pop()
                out.append((start, at, high - low + 1))
                if stack:
                    stack[-1][2] = max(stack[-1][2], high)
    return out


def spans(text: str, opener: str) -> list[tuple[int, int]]:
    """(start, end) of every balanced bracket pair outside quotes, by start.

    A stack gives all pairs in one pass, so the work stays linear in the text. A
    pair counts as unquoted at its own opener, whatever stray quote stands before
    it, hence one pass for either reading of the text in front.
    """
    return sorted({p[:2] for quoted in (False, True) for p in _spans(text, opener, quoted)})


_COMMA = re.compile(r",\s*+[}\]]")
#: A comment, or an unended one, which stays.
_COMMENT = re.compile(r"//[^\n]*+(?:\n|\Z)")


def _without(text: str, pattern: re.Pattern) -> tuple[str, list[tuple[int, int]]]:
    """Text where each match is cut down to its last character, and the cuts made:
    (place in the new text, characters gone up to there)."""
    parts: list[str] = []
    cuts: list[tuple[int, int]] = []
    at = size = gone = 0
    for hit in pattern.finditer(text):
        if hit.group()[-1] not in "}]\n":
            continue
        parts.append(text[at : hit.start()])
        size += hit.start() - at
        at = hit.end() - 1
        gone += at - hit.start()
        cuts.append((size, gone))
    parts.append(text[at:])
    return "".join(parts), cuts


def _repaired(text: str) -> tuple[str, list[list[tuple[int, int]]]]:
    text, commas = _without(text, _COMMA)
    text, comments = _without(text, _COMMENT)
    return text, [comments, commas]


def _place(i: int, repairs: list[list[tuple[int, int]]]) -> int:
    """Where a place of the repaired text was in the text before."""
    for cuts in repairs:
        k = bisect_right(cuts, (i, 1 << 62))
        i += cuts[k - 1][1] if k else 0
    return i


def _deepest() -> int:
    """How deeply nested a value the parser of this Python reads."""
    low, high = 1, 1 << 17
    while low < high:
        mid = (low + high + 1) // 2
        try:
            json.loads("[" * mid + "]" * mid)
            low = mid
        except RecursionError:
            high = mid - 1
    return low


def _readings(text: str, opener: str) -> list[tuple[int, int, int, bool]]:
    """The pairs of both readings, by start, each with its levels and its reading."""
    return sorted((*p, quoted) for quoted in (False, True) for p in _spans(text, opener, quoted))


def _first(text: str, opener: str, kind: type, pieces: list | None = None) -> tuple[int, object] | None:
    """(start, value) of the first balanced piece (of `_readings`) that parses as it stands.

    A piece that fails at some place makes every later piece of the same reading fail that
    holds this place, so nested pieces are not parsed one by one.
    """
    pieces = _readings(text, opener) if pieces is None else pieces
    bad = {False: -1, True: -1}
    decode = json.JSONDecoder().raw_decode
    deepest = _deepest() if any(p[2] > 500 for p in pieces) else 500
    for start, end, levels, quoted in pieces:
        if start < bad[quoted] < end or levels > deepest:
            continue
        try:
            value, stop = decode(text, start)
        except json.JSONDecodeError as e:
            bad[quoted] = e.pos
        except (ValueError, RecursionError):
            pass
        else:
            if stop == end and isinstance(value, kind):
                return start, value
    return None


def escape_inner_quotes(text: str) -> str:
    """Escape a quote that neither opens nor closes a value."""
    out: list[str] = []
    quoted = False
    at = 0
    i = text.find('"')
    while i >= 0:
        if i == 0 or text[i - 1] != "\\":
            if not quoted:
                quoted = True
            elif _CLOSES.match(text, i + 1):
                quoted = False
            else:
                out += (text[at:i], "\\")
                at = i
        i = text.find('"', i + 1)
    out.append(text[at:])
    return "".join(out)


def _outermost(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs, by start, that stand in no other."""
    out: list[tuple[int, int]] = []
    for start, end in pairs:
        if not out or end > out[-1][1]:
            out.append((start, end))
    return out


def _loose(text: str, pairs: list[tuple[int, int]]) -> list[str]:
    """Pieces for openings without a partner: up to the next closing brace."""
    paired = {s for s, _ in pairs}
    by_end: dict[int, list[int]] = {}
    end = -1
    for hit in re.finditer(r"\{", text):
        start = hit.start()
        if start in paired:
            continue
        if end < start and (end := text.find("}", start)) < 0:
            break
        by_end.setdefault(end, []).append(start)
    return [text[s : e + 1] for e, own in by_end.items() for s in dict.fromkeys((own[0], own[-1]))]


def find_value(text: str, objects_only: bool = True) -> str | None:
    """JSON text of the first readable value, repaired if need be; None if none.

    Tried in turn: balanced pieces, as they stand or without trailing commas and comments,
    the earlier piece first; an object that is not closed; objects up to the next closing brace; and
    all of these with stray quotes escaped.
    """
    if not objects_only:
        found = _first(text, "[", list)
        if found:
            return text[found[0] : json.JSONDecoder().raw_decode(text, found[0])[1]]
    first = text.find("{")
    if first < 0:
        return None
    fixed, repairs = _repaired(text)
    readings = _readings(fixed, "{")
    mended = _first(fixed, "{", dict, readings)
    plain = mended if fixed == text else _first(text, "{", dict)
    if mended and (not plain or _place(mended[0], repairs) < plain[0]):
        plain = mended
    if plain:
        return json.dumps(plain[1], ensure_ascii=False)
    more: list[str] = []
    tail = fixed[fixed.find("{") :] if "{" in fixed else ""
    if tail.count("{") > tail.count("}"):
        more.append(tail.rstrip("`\n ") + "}")
    pairs = sorted({p[:2] for p in readings})
    more += _loose(fixed, pairs)
    for piece in more:
        found = _first(piece, "{", dict)
        if found and not found[0] and found[1]:
            return json.dumps(found[1], ensure_ascii=False)
    for piece in [*(fixed[s:e] for s, e in _outermost(pairs)), *more]:
        found = _first(escape_inner_quotes(piece), "{", dict)
        if found and (found[1] or piece not in more):
            return json.dumps(found[1], ensure_ascii=False)
    return None
