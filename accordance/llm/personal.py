"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans in every whole text. The base spans of four kinds are fixed by
their patterns and checks. Looser patterns propose more: numbers of card length without
the check digit, phone numbers without a plus, written-out addresses, numbers of social
security shape, names after a title. Four labelers vote on every proposed span - its shape, the
check of its kind, gazetteers, and the words before it - or abstain. The votes of all
documents are counted by pattern; expectation-maximisation on these counts estimates how reliable each
labeler is, and its posteriors train a span classifier over votes and features of the
span. Base spans always stay; a proposed one is added if the classifier is sure enough and the
check of its kind has not failed.

The counts are the only thing that leaves the executors. Their number is bounded by the
possible votes and features, not by the data. All patterns start only where a run of
their characters starts and never give back what they took, so a text of any length is
searched in linear time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordance.llm import common

KINDS = ("email", "ip", "card", "phone")
#: Base patterns, as the contract fixes them, made linear: \G lets a match start where the
#: one before it ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser patterns: name -> (kind of the span, pattern).
LOOSE = {
    "spelled": ("email", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+ ?[\[(]dot[\])] ?[A-Za-z]{2,24}+"),
    "local": ("phone", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])"),
    "social": ("social", r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "titled": ("name", r"\b(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]{1,30}+(?: [A-Z][a-z]{1,30}+)?+"),
}
#: Gazetteers (fixed values): endings of mail hosts, starts of card numbers, country codes, given names.
HOST_ENDINGS = "com|org|net|edu|gov|io|de|fr|es|uk|it|nl|eu|info|biz|co"
CARD_STARTS = "3[47]|4|5[1-5]|2[2-7]|6"
COUNTRY_CODES = "1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|81|82|84|86|9[0-58]"
GIVEN_NAMES = "Anna|Ben|Carlos|Claire|David|Emma|Hans|James|Jean|John|Jose|Julia|Karl|Laura|Maria|Marie|Mary|Michael|Paul|Peter|Pierre|Sarah|Sofia|Thomas"
#: Words before a span that speak for or against it.
CUES = {
    "email": ("mail|contact|write|reach", "example"),
    "ip": ("ip|host|server|address|from", "version|release|v"),
    "card": ("card|visa|mastercard|credit|payment", "order|invoice|isbn|serial|id|ref|no"),
    "phone": ("call|tel|phone|fax|mobile|contact", "order|invoice|id|ref"),
    "social": ("ssn|social|security", "order|part|id|ref"),
    "name": ("dear|contact|by|from|signed", "street|avenue"),
}
#: Code points before a span that a cue may stand in.
CONTEXT = 32
LABELERS = ("shape", "check", "gazetteer", "context")
ROUNDS = 50
#: Probability from which a span that is not a base span is added.
SURE = 0.9
_CHUNK = 512


_NONE = "array<int>"
_SPANS = "array<struct<start:int,end:int,m:string>>"
_CANDIDATE = (
    "array<struct<kind:string,start:int,end:int,base:boolean,shape:int,check:int,gazetteer:int,context:int,"
    "size:int,digits:int,mixed:int>>"
)


def _sums(xs: Column) -> Column:
    state = F.struct(F.lit(0).alias("at"), F.array().cast(_NONE).alias("out"))

    def step(acc, x):
        return F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"] + x).alias("out"))

    return F.aggregate(xs, state, step)["out"]


def _with_spans(docs: DataFrame, patterns: dict[str, tuple[str, Column]], text: str) -> DataFrame:
    """A column ``_s_<name>`` for each pattern: (start, end, match) of all leftmost matches.

    Positions are code points. What is used more than once is a column of its own, so it is worked
    out once; sums run in chunks, so that many matches in a text stay cheap.
    """
    names = docs.columns

    def step(columns: dict[str, Column], *gone: str) -> None:
        nonlocal docs
        docs = docs.withColumns(columns).drop(*gone)

    def some(name: str, c: Column, kind: str) -> Column:
        return F.when(F.size(f"_m_{name}") > 0, c).otherwise(F.array().cast(kind))

    step({f"_m_{k}": F.when(may, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")) for k, (p, may) in patterns.items()})
    step({
        f"_g_{k}": some(k, F.zip_with(F.slice(F.split(text, p, -1), 1, F.size(f"_m_{k}")), f"_m_{k}", lambda g, m: F.length(g) + F.length(m)), _NONE)
        for k, (p, _) in patterns.items()
    })

    def chunked(k: str) -> Column:
        count = F.floor((F.size(f"_g_{k}") - 1) / _CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), count), lambda c: _sums(F.slice(f"_g_{k}", c * _CHUNK + 1, F.lit(_CHUNK))))

    step({f"_r_{k}": some(k, chunked(k), "array<array<int>>") for k in patterns}, *(f"_g_{k}" for k in patterns))
    step({f"_b_{k}": _sums(F.transform(f"_r_{k}", lambda x: F.element_at(x, -1))) for k in patterns})

    def placed(k: str) -> Column:
        ends = F.flatten(F.zip_with(f"_r_{k}", f"_b_{k}", lambda x, b: F.transform(x, lambda y: y + b - F.element_at(x, -1))))
        return F.zip_with(ends, f"_m_{k}", lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("m")))

    step({f"_s_{k}": some(k, placed(k), _SPANS) for k in patterns})
    return docs.select(*names, *(f"_s_{k}" for k in patterns))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def one(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), one), F.lit(0), lambda a, x: a + x)
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(False)


_PART = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


def valid(kind: str, m: Column) -> Column:
    """The check of a base kind."""
    if kind == "ip":
        return F.regexp_like(m, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _patterns(text: Column) -> dict[str, tuple[str, Column]]:
    """name -> (pattern, where it may match at all)."""
    digit = F.regexp_like(text, F.lit("[0-9]"))
    may = {
        "email": F.contains(text, F.lit("@")), "ip": digit & F.contains(text, F.lit(".")), "card": digit,
        "phone": F.contains(text, F.lit("+")), "spelled": F.regexp_like(text, F.lit(r"[\[(]at[\])]")), "local": digit,
        "social": digit & F.contains(text, F.lit("-")), "titled": F.contains(text, F.lit(". ")),
    }
    return {k: (p, may[k]) for k, p in (BASE | {k: p for k, (_, p) in LOOSE.items()}).items()}


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 for, 0 against, -1 abstains."""
    out = F.lit(-1)
    if no is not None:
        out = F.when(no, 0).otherwise(out)
    return F.when(yes, 1).otherwise(out)


def _votes(name: str, kind: str, text: Column, s: Column) -> list[Column]:
    m, d = s["m"], _digits(s["m"])
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    shape = {
        "email": like(m, r"@.*\.[A-Za-z]{2,24}$"), "ip": ~like(m, r"(?:^|\.)0[0-9]"),
        "card": like(m, r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"),
        "phone": like(m, r"^\+"), "spelled": F.lit(True), "local": like(m, r"^\("), "social": ~like(m, "^(?:000|666|9)"), "titled": F.lit(True),
    }[name]
    check = _vote(valid(kind, m), ~valid(kind, m)) if name in BASE and name != "email" else F.lit(-1)
    if name == "local":
        check = _vote(F.length(d) == 10)
    known = {
        "email": _vote(like(m, rf"\.(?:{HOST_ENDINGS})$")), "ip": _vote(F.lit(False), like(m, r"^(?:0|127|255)\.")),
        "card": _vote(like(d, f"^(?:{CARD_STARTS})"), ~like(d, f"^(?:{CARD_STARTS})")),
        "phone": _vote(like(d, f"^(?:{COUNTRY_CODES})")), "spelled": _vote(like(m, rf"(?:{HOST_ENDINGS})$")),
        "local": F.lit(-1), "social": F.lit(-1), "titled": _vote(like(m, rf"\. (?:{GIVEN_NAMES})\b")),
    }[name]
    before = F.lower(F.substr(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT))))
    yes, no = CUES[kind]
    context = _vote(like(before, rf"\b(?:{yes})\b"), like(before, rf"\b(?:{no})\b"))
    return [_vote(shape, ~shape), check, known, context]


FEATURES = ("kind", *LABELERS, "size", "digits", "mixed")
def with_candidates(docs: DataFrame, text: str | Column = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and ``_candidates``: all proposed spans, base spans first."""
    rows = docs.select(*(F.col(c).alias(f"_k_{i}") for i, c in enumerate(keep)), common.text_of(text).alias("_t"))
    t = F.col("_t")
    rows = _with_spans(rows, _patterns(t), "_t")

    def described(name: str, kind: str):
        def one(s: Column) -> Column:
            votes = _votes(name, kind, t, s)
            n = F.length(_digits(s["m"]))
            return F.struct(
                F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                (valid(kind, s["m"]) if name in BASE else F.lit(False)).alias("base"),
                *(v.cast("int").alias(k) for k, v in zip(LABELERS, votes)),
                F.least(F.floor(F.log2(F.length(s["m"]))).cast("int"), F.lit(7)).alias("size"),
                F.floor(4 * n / F.length(s["m"])).cast("int").alias("digits"),
                F.regexp_like(s["m"], F.lit("[ ().-]")).cast("int").alias("mixed"),
            )

        return one

    kinds = {k: k for k in BASE} | {k: kind for k, (kind, _) in LOOSE.items()}
    spans = {k: F.col(f"_s_{k}") for k in kinds}
    # a number of another length is no card, whatever its digits
    spans["card"] = F.filter("_s_card", lambda x: F.length(_digits(x["m"])).between(13, 19))
    every = F.concat(*(F.transform(spans[k], described(k, kind)).cast(_CANDIDATE) for k, kind in kinds.items()))
    rows = rows.withColumn("_every", every).withColumn("_base", F.filter("_every", lambda x: x["base"]))
    free = F.filter("_every", lambda x: ~x["base"] & ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return rows.select(*(F.col(f"_k_{i}").alias(c) for i, c in enumerate(keep)), F.concat("_base", free).alias("_candidates"))


class Classifier:
    """Log-odds per feature value, learned from posteriors of the labelers' votes."""

    def __init__(self, counts: list):
        """``counts``: (features..., base, number) of every combination that occurs."""
        votes: dict[tuple, float] = {}
        for r in counts:
            key = (r["kind"], *(r[k] for k in LABELERS))
            votes[key] = votes.get(key, 0) + r["n"]
        self.reliability = {k: (0.8, 0.8) for k in LABELERS}
        prior = {k: 0.5 for k, *_ in votes}
        post: dict[tuple, float] = {}
        for _ in range(ROUNDS):
            for key in votes:
                odds = math.log(prior[key[0]] / (1 - prior[key[0]]))
                for k, v in zip(LABELERS, key[1:]):
                    a, b = self.reliability[k]
                    odds += math.log(a / (1 - b)) if v == 1 else math.log((1 - a) / b) if v == 0 else 0
                post[key] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            for kind in prior:
                own = [(n, post[key]) for key, n in votes.items() if key[0] == kind]
                prior[kind] = (sum(n * p for n, p in own) + 1) / (sum(n for n, _ in own) + 2)
            for i, k in enumerate(LABELERS):
                said = [(key[i + 1], n, post[key]) for key, n in votes.items() if key[i + 1] >= 0]
                # a labeler is better than chance; with few votes it stays near its first value
                a = (sum(n * p for v, n, p in said if v == 1) + 8) / (sum(n * p for _, n, p in said) + 10)
                b = (sum(n * (1 - p) for v, n, p in said if v == 0) + 8) / (sum(n * (1 - p) for _, n, p in said) + 10)
                self.reliability[k] = tuple(min(0.99, max(0.51, x)) for x in (a, b))
        self.posterior = post
        yes: dict = {}
        no: dict = {}
        for r in counts:
            p = post[(r["kind"], *(r[k] for k in LABELERS))]
            for f in FEATURES:
                yes[f, r[f]] = yes.get((f, r[f]), 1.0) + r["n"] * p
                no[f, r[f]] = no.get((f, r[f]), 1.0) + r["n"] * (1 - p)
        total_yes = sum(v for (f, _), v in yes.items() if f == "kind") or 1.0
        total_no = sum(v for (f, _), v in no.items() if f == "kind") or 1.0
        self.bias = math.log(total_yes / total_no)
        self.weights = {f: {} for f in FEATURES}
        for f, v in yes:
            self.weights[f][v] = math.log(yes[f, v] / total_yes) - math.log(no[f, v] / total_no)

    def probability(self, x: Column) -> Column:
        odds = F.lit(self.bias)
        for f, weights in self.weights.items():
            if weights:
                table = F.create_map(*(F.lit(y) for pair in weights.items() for y in pair))
                odds = odds + F.coalesce(F.element_at(table, x[f]), F.lit(0.0))
        return 1 / (1 + F.exp(-odds))


def fit(docs: DataFrame, text: str = "text") -> Classifier:
    """The classifier learned from the spans of all texts."""
    # the outer form: a filter on the array would work out all spans a second time
    rows = with_candidates(docs, text, ()).select(F.inline_outer("_candidates")).where("kind is not null")
    return Classifier(rows.groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n")).collect())


def find_personal_data(docs: DataFrame, classifier: Classifier | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with ``found``: (kind, start, end, base) of every span.

    Spans are in code points, end exclusive, ordered by kind (the base kinds first, in their
    order), start and end. A null or empty text has none. Rows stay as they come.
    """
    classifier = classifier or fit(docs)
    some = F.filter("_candidates", lambda x: x["base"] | ((x["check"] != 0) & (classifier.probability(x) >= SURE)))
    kinds = F.array(*(F.lit(k) for k in (*KINDS, "name", "social")))
    ordered = F.array_sort(F.transform(some, lambda x: F.struct(
        F.array_position(kinds, x["kind"]).alias("place"), x["start"].alias("start"), x["end"].alias("end"),
        x["kind"].alias("kind"), x["base"].alias("base"),
    )))
    found = F.transform(ordered, lambda x: F.struct(x["kind"], x["start"], x["end"], x["base"]))
    return with_candidates(docs, "text", keep).select(*keep, found.alias("found"))


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def digests(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    base = F.filter("found", lambda x: x["base"])
    counts = [F.size(F.array_remove(F.transform(base, lambda x: x["kind"] == F.lit(k)), False)).cast("long").alias(f"n_{k}") for k in KINDS]
    return find_personal_data(docs, classifier).select(
        "doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans")
    )


def masked(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlaps become one."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        gap = F.substr(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        sign = F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, sign))).otherwise(acc["out"]).alias("out"),
        )

    by_start = F.array_sort(F.transform(found, lambda x: F.struct(x["start"], x["end"], x["kind"])))
    done = F.aggregate(by_start, state, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1)))
    return F.when(F.size(found) == 0, text).otherwise(done)


@common.carried("doc_id", "text", "n_chars")
def mask_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked; ``n_chars``, where there is one, follows the text.

    A null text comes back empty. Repeated rows give repeated results. An empty table gives no rows.
    """
    names = docs.columns
    found = find_personal_data(docs, keep=tuple(names))
    out = found.withColumn("text", masked(F.col("text"), F.col("found")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return digests(common.table(spark, sf_dir, "documents"))


QUERIES = {"op7_personal_data": (op7_personal_data, None)}
