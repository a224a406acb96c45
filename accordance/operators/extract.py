"""A table of responses to a table of labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordance.functions import answers as A
from accordance.functions.brackets import find_value
from accordance.functions.common import non_empty, ratio, strip

# Texts that the field completion puts in.
NO_JUSTIFICATION = "Analysis failed - insufficient data"
NO_JUSTIFICATION_SIMPLE = "Analysis completed but detailed justification not available"
NO_EVIDENCE = "Not provided"
RAW_JUSTIFICATION = "Resposta LLM (JSON parsing falhou): "
VERDICT_JUSTIFICATION = "Classification extracted from FINAL: pattern. Full response: "

ANSWER_FIELDS = {
    "refactoring_type": ("refactoring_type",),
    "justification": ("justification",),
    "repository": ("repository", "project"),
    "commit_hash_before": ("commit_hash_before", "commit1"),
    "commit_hash_current": ("commit_hash_current", "commit2"),
    "technical_evidence": ("technical_evidence",),
    "confidence_level": ("confidence_level",),
    "diff_source": ("diff_source",),
    "llm_raw_response": ("llm_raw_response",),
}


def _scan_objects(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else find_value(t))


def _scan_any(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else find_value(t, objects_only=False))


# Marked non-deterministic so that no filter above is pushed through the scan, which
# would clean and parse every text a second time.
_bracket_scan = F.pandas_udf(_scan_objects, T.StringType()).asNondeterministic()
_bracket_scan_any = F.pandas_udf(_scan_any, T.StringType()).asNondeterministic()


def clean_responses(df: DataFrame, response: str = "response") -> DataFrame:
    return df.withColumn("cleaned", A.clean_answer(response))


def structured_answer(
    df: DataFrame, response: str = "response", residual: bool = True
) -> DataFrame:
    """The JSON object of each answer: ``answer_json`` and the tier that found it.

    Tiers: the whole text, the first readable candidate, the first candidate after
    repairs. Only a text that all of these leave over, and that has a brace at all,
    is handed to the Python bracket scan; all others enter it as NULL.
    """
    out = df.withColumn("_clean", A.clean_answer(response))
    out = out.withColumn("_whole", strip("_clean"))
    out = out.withColumn(
        "_pieces",
        F.when(F.col("_clean").contains("{") & F.col("_clean").contains("}"), A.object_candidates(F.col("_clean"))),
    )
    out = out.withColumn(
        "_good", F.get(F.filter("_pieces", A.is_object_text), F.lit(0))
    )
    # Repairs apply to the object that opens first in the text.
    first = F.get(
        F.col("_pieces"), F.size("_pieces") - F.size(A.brace_pieces(F.col("_clean")))
    )
    out = out.withColumn("_mended", A.repair_object(first))
    native = (
        F.when(A.is_object_text(F.col("_whole")), F.col("_whole"))
        .when(F.col("_good").isNotNull(), F.col("_good"))
        .when(A.is_object_text(F.col("_mended")), F.col("_mended"))
    )
    tier = (
        F.when(F.col("_native") == F.col("_whole"), "whole")
        .when(F.col("_native") == F.col("_good"), "candidate")
        .when(F.col("_native").isNotNull(), "repaired")
    )
    out = out.withColumn("_native", native).withColumn("answer_tier", tier)
    if residual:
        left_over = F.when(
            F.col("_native").isNull() & F.col("_clean").contains("{"), F.col("_clean")
        )
        out = out.withColumn("_scanned", _bracket_scan(left_over))
        out = out.withColumn(
            "answer_tier",
            F.when(F.col("_scanned").isNotNull(), "scanned").otherwise(F.col("answer_tier")),
        )
        out = out.withColumn("answer_json", F.coalesce("_native", "_scanned"))
    else:
        out = out.withColumn("answer_json", F.col("_native"))
    return out.select(*df.columns, F.col("_clean").alias("cleaned"), "answer_json", "answer_tier")


def any_json_value(df: DataFrame, response: str = "response") -> DataFrame:
    """First balanced JSON array or object of each text (arrays are tried first)."""
    t = F.col(response)
    held = t.contains("{") | t.contains("[")
    # a text without a bracket holds no value and enters the Python scan as NULL
    return df.withColumn("json_value", _bracket_scan_any(F.when(held, t)))


def _doc_field(names: tuple[str, ...]) -> Column:
    """A field of the parsed answer or of its key lines; empty counts as missing."""
    tries = []
    for n in names:
        tries.append(non_empty(F.try_variant_get("_doc", f"$.{n}", "string")))
        tries.append(non_empty(F.element_at("_kv", n)))
    return F.coalesce(*tries)


def answer_fields(df: DataFrame) -> DataFrame:
    """Named fields (`a_*`) of `answer_json`, or of the key lines without one."""
    out = df.withColumn("_doc", F.try_parse_json("answer_json")).withColumn(
        "_kv",
        A.key_line_map(F.when(F.col("answer_json").isNull(), F.col("cleaned"))),
    )
    out = out.withColumns({f"a_{k}": _doc_field(v) for k, v in ANSWER_FIELDS.items()})
    return out.withColumn("has_key_lines", F.col("_kv").isNotNull()).drop("_doc", "_kv")


def complete_fields(df: DataFrame) -> DataFrame:
    """Fill the fields of a parsed answer and list what was filled.

    Sources in order: the answer (`a_*`), the item list and evidence
    (`item_repository`, `item_before`, `item_after`, `evidence`), the request's own
    arguments (`repository`, `before_key`, `item_key`), then fixed defaults.
    """

    def have(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    filled: list[Column] = []
    out: dict[str, Column] = {}

    def fill(target: str, answer: str, item: str, argument: str) -> None:
        known = F.coalesce(non_empty(have(item)), non_empty(have(argument)))
        out[target] = F.coalesce(F.col(answer), known, F.lit("unknown"))
        filled.append(F.when(F.col(answer).isNull() & known.isNotNull(), target))

    fill("repository", "a_repository", "item_repository", "repository")
    fill("commit_hash_before", "a_commit_hash_before", "item_before", "before_key")
    fill("commit_hash_current", "a_commit_hash_current", "item_after", "item_key")

    evidence = non_empty(have("evidence"))
    out["technical_evidence"] = F.coalesce("a_technical_evidence", evidence, F.lit(NO_EVIDENCE))
    filled.append(
        F.when(F.col("a_technical_evidence").isNull() & evidence.isNotNull(), "technical_evidence")
    )

    valid = F.coalesce(F.col("a_refactoring_type").isin("pure", "floss"), F.lit(False))
    out["label"] = F.when(valid, F.col("a_refactoring_type")).otherwise("floss")
    filled.append(F.when(~valid, "refactoring_type"))

    short = F.coalesce(F.length("a_justification") < 5, F.lit(True))
    raw = strip(F.coalesce("a_llm_raw_response", F.lit("")))
    out["justification"] = (
        F.when(~short, F.col("a_justification"))
        .when(F.length(raw) > 10, F.concat(F.lit(RAW_JUSTIFICATION), raw))
        .otherwise(NO_JUSTIFICATION)
    )
    filled.append(F.when(short, "justification"))
    filled.append(
        F.when(F.col("a_technical_evidence").isNull() & evidence.isNull(), "technical_evidence")
    )
    for target, answer, default in (
        ("confidence", "a_confidence_level", "low"),
        ("diff_source", "a_diff_source", "direct"),
    ):
        out[target] = F.coalesce(F.col(answer), F.lit(default))
        filled.append(F.when(F.col(answer).isNull(), answer[2:]))

    out["fields_filled"] = F.array_join(F.array_compact(F.array(*filled)), ",")
    return df.withColumns(out)


def required_fields(df: DataFrame) -> DataFrame:
    """The plain completion: request arguments, then fixed defaults."""

    def have(name: str, default: str) -> Column:
        c = F.col(name) if name in df.columns else F.lit(None).cast("string")
        return F.coalesce(non_empty(c), F.lit(default))

    def blank_to_null(c: str) -> Column:
        return F.when(strip(c) != "", F.col(c))

    valid = F.coalesce(F.col("a_refactoring_type").isin("pure", "floss"), F.lit(False))
    return df.withColumns(
        {
            "repository": F.coalesce(blank_to_null("a_repository"), have("repository", "Unknown")),
            "commit_hash_before": F.coalesce(
                blank_to_null("a_commit_hash_before"), have("before_key", "Unknown")),
            "commit_hash_current": F.coalesce(
                blank_to_null("a_commit_hash_current"), have("item_key", "Unknown")),
            "label": F.when(valid, F.col("a_refactoring_type")).otherwise("floss"),
            "justification": F.coalesce(
                blank_to_null("a_justification"), F.lit(NO_JUSTIFICATION_SIMPLE)),
        }
    )


def line_fields(df: DataFrame, response: str = "response") -> DataFrame:
    """Field-by-field patterns (`f_*`); usable with at least two fields."""
    names = list(A.FIELD_PATTERNS)
    out = df.withColumns({f"_{n}": A.field_value(response, n) for n in names})
    filled = out.withColumn("f_repository", F.coalesce("_repository", "_project")).withColumns(
        {f"f_{n}": F.col(f"_{n}") for n in names if n not in ("project", "repository")}
    )
    n = F.lit(0)
    for name in names:
        n = n + F.col(f"_{name}").isNotNull().cast("int")
    return filled.withColumn("f_count", n.cast("bigint")).drop(*[f"_{n}" for n in names])


VERDICT_FIRST, STRUCTURE_FIRST = "verdict_first", "structure_first"


def cascade(
    df: DataFrame,
    order: str = VERDICT_FIRST,
    response: str = "response",
    residual: bool = True,
) -> DataFrame:
    """Label every response, with the method that gave the label and the raw text.

    ``verdict_first``: verdict line, structured answer (object, else key lines),
    indicator scoring. ``structure_first``: structured answer, field lines, bare
    label (a short verdict overrides these two), short verdict alone, keyword
    fallback. An object that only the uncleaned text holds counts as structured, and a
    short verdict overrides its label. Only an empty answer fails.
    """
    if order == VERDICT_FIRST:
        return _verdict_first(df, response, residual)
    if order == STRUCTURE_FIRST:
        return _structure_first(df, response, residual)
    raise ValueError(f"unknown order: {order}")


def _prepared(df: DataFrame, response: str, residual: bool) -> DataFrame:
    out = df.withColumn("raw_response", strip(response))
    out = out.withColumn("_empty", F.coalesce(F.col("raw_response") == "", F.lit(True)))
    return structured_answer(out, response, residual)


_OUTPUT = (
    "label", "status", "extraction_method", "justification", "confidence",
    "raw_response", "fields_filled",
)


def _result(df: DataFrame, source: DataFrame) -> DataFrame:
    keep = [c for c in source.columns if c not in _OUTPUT]
    return df.select(*keep, *[c for c in _OUTPUT])


def _verdict_first(df: DataFrame, response: str, residual: bool) -> DataFrame:
    out = df.withColumn("raw_response", strip(response))
    out = out.withColumn("_empty", F.coalesce(F.col("raw_response") == "", F.lit(True)))
    out = out.withColumn("_verdict", F.lower(A.verdict(response)))
    # Only answers without a verdict go on to parsing and scoring.
    out = out.withColumn("_open", F.when(F.col("_verdict").isNull() & ~F.col("_empty"), F.col(response)))
    out = answer_fields(structured_answer(out, "_open", residual))
    parsed = F.col("answer_json").isNotNull() | F.col("has_key_lines")
    out = out.withColumn("_parsed", parsed)
    out = out.withColumn("_low", F.lower(F.when(~F.col("_parsed"), F.col("_open"))))
    scored = F.col("_low")
    out = out.withColumns(
        {"_pure": A.pure_score(scored, True), "_floss": A.floss_score(scored, True)}
    )
    out = out.withColumns(
        {
            "a_refactoring_type": F.when(F.col("_parsed"), F.col("a_refactoring_type")).otherwise(
                A.label_from_scores(F.col("_pure"), F.col("_floss"), scored, True)
            ),
            "a_justification": F.when(F.col("_parsed"), F.col("a_justification")).otherwise(
                F.col("raw_response")
            ),
            "a_confidence_level": F.when(
                F.col("_parsed"), F.col("a_confidence_level")
            ).otherwise(A.confidence(scored, True)),
        }
    )
    done = complete_fields(out)
    by_verdict = F.col("_verdict").isNotNull()
    empty = F.col("_empty")
    null = F.lit(None).cast("string")
    done = done.withColumns(
        {
            "label": F.when(empty, null).when(by_verdict, F.col("_verdict")).otherwise(F.col("label")),
            "justification": F.when(empty, null)
            .when(by_verdict, F.col("raw_response"))
            .otherwise(F.col("justification")),
            "confidence": F.when(~empty & ~by_verdict, F.col("confidence")),
            "fields_filled": F.when(~empty & ~by_verdict, F.col("fields_filled")),
            "status": F.when(empty, "failed").otherwise("ok"),
            "extraction_method": F.when(empty, null)
            .when(by_verdict, "verdict")
            .when(F.col("answer_json").isNotNull(), "structured")
            .when(F.col("_parsed"), "key_lines")
            .otherwise("scoring"),
        }
    )
    return _result(done, df)


def _structure_first(df: DataFrame, response: str, residual: bool) -> DataFrame:
    out = line_fields(answer_fields(_prepared(df, response, residual)), response)
    out = out.withColumns(
        {
            "_verdict": F.lower(A.verdict(response, A.VERDICT_PATTERNS_SHORT)),
            "_bare": A.bare_label(response),
        }
    )
    parsed = A.has_minimum(F.col("a_refactoring_type"), F.col("a_justification"))
    # an object that cleaning has taken away with the reasoning around it
    t = F.col(response)
    raw = F.when(~parsed & t.contains("{") & t.contains("}"), A.object_candidates(t))
    out = out.withColumn("_raw", F.get(F.filter(raw, A.is_object_text), F.lit(0)))
    out = out.withColumn("_raw_doc", F.try_parse_json("_raw"))
    for k, names in ANSWER_FIELDS.items():
        tries = [non_empty(F.try_variant_get("_raw_doc", f"$.{n}", "string")) for n in names]
        out = out.withColumn(f"r_{k}", F.coalesce(*tries))
    uncleaned = A.has_minimum(F.col("r_refactoring_type"), F.col("r_justification"))
    out = out.withColumn("_uncleaned", F.coalesce(~parsed & uncleaned, F.lit(False)))
    lines = (F.col("f_count") >= 2) & A.has_minimum(
        F.col("f_refactoring_type"), F.col("f_justification")
    )
    method = (
        F.when(F.col("_empty"), F.lit(None).cast("string"))
        .when(parsed | F.col("_uncleaned"), "structured")
        .when(lines, "lines")
        .when(F.col("_bare").isNotNull(), "bare_label")
        .when(F.col("_verdict").isNotNull(), "verdict")
        .otherwise("fallback")
    )
    out = out.withColumn("extraction_method", method)
    m = F.col("extraction_method")
    out = out.withColumn("_low", F.lower(F.when(m == "fallback", F.col(response))))
    fallback = F.when(m == "fallback", F.col(response))
    label = (
        F.when(F.col("_uncleaned"), F.coalesce("_verdict", "r_refactoring_type"))
        .when(m == "structured", F.col("a_refactoring_type"))
        .when(
            m == "lines",
            F.when(F.col("f_refactoring_type").isNotNull(), F.coalesce("_verdict", "f_refactoring_type")),
        )
        .when(m == "bare_label", F.coalesce("_verdict", "_bare"))
        .when(m == "verdict", F.col("_verdict"))
        .when(m == "fallback", A.fallback_label("_low", True))
    )
    justification = (
        F.when(F.col("_uncleaned"), F.col("r_justification"))
        .when(m == "structured", F.col("a_justification"))
        .when(m == "lines", F.col("f_justification"))
        .when(m == "bare_label", A.bare_justification(F.when(m == "bare_label", F.col(response))))
        .when(m == "verdict", F.concat(F.lit(VERDICT_JUSTIFICATION), F.col(response)))
        .when(m == "fallback", A.fallback_justification(fallback, F.col("_low")))
    )
    out = out.withColumns({"_label": label, "_just": justification}).withColumns(
        {"a_refactoring_type": F.col("_label"), "a_justification": F.col("_just")}
    )
    done = required_fields(out)
    empty = F.col("_empty")
    done = done.withColumns(
        {
            "label": F.when(~empty, F.col("label")),
            "justification": F.when(~empty, F.col("justification")),
            "confidence": F.when(F.col("_uncleaned"), F.col("r_confidence_level")).when(
                m == "structured", F.col("a_confidence_level")
            ),
            "fields_filled": F.lit(None).cast("string"),
            "status": F.when(empty, "failed").otherwise("ok"),
        }
    )
    return _result(done, df)


def split_by_status(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    return labelled.where("status = 'ok'"), labelled.where("status <> 'ok'")


def failures(labelled: DataFrame, error: str = "empty response") -> DataFrame:
    """Quarantine records of what could not be labelled, with full context."""

    def have(name: str) -> Column:
        return F.col(name) if name in labelled.columns else F.lit(None).cast("string")

    return labelled.where("status <> 'ok'").select(
        F.current_timestamp().alias("failed_at"),
        "item_key",
        F.coalesce(non_empty(have("repository")), F.lit("unknown")).alias("repository"),
        have("message").alias("message"),
        F.lit(error).alias("error"),
        F.col("raw_response").alias("response"),
        F.col("raw_response").alias("response_excerpt"),
        F.lit("JSON parsing failed").alias("attempt"),
        have("prompt").alias("prompt"),
        F.substring(have("prompt"), 1, 2000).alias("prompt_excerpt"),
    )


def success_by_method(labelled: DataFrame) -> DataFrame:
    """Rows per extraction method and their share of all rows."""
    counts = labelled.groupBy(
        F.coalesce("extraction_method", F.lit("none")).alias("extraction_method"), "status"
    ).agg(F.count(F.lit(1)).alias("n"))
    # A handful of methods, so the whole-frame window stays tiny.
    return counts.withColumn(
        "pct", ratio(F.col("n"), F.sum("n").over(Window.partitionBy()), 100.0)
    )
