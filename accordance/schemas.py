"""Explicit schemas and the closed vocabularies used everywhere."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Label vocabularies.
REFERENCE_LABELS = ("TRUE", "FALSE", "NONE", "NOT_FOUND", "UNKNOWN")
CANDIDATE_LABELS = ("PURE", "FLOSS")
FAILURE_STATUSES = ("FAILED", "ERROR")
CANDIDATE_STATUSES = ("PURE", "FLOSS", "FAILED", "ERROR", "DRY_RUN")
REFERENCE_TO_CANDIDATE = {"TRUE": "PURE", "FALSE": "FLOSS", "NONE": "UNKNOWN"}

# Spellings of one truth value.
TRUE_SPELLINGS = ("TRUE", "T", "1", "PURE")
FALSE_SPELLINGS = ("FALSE", "F", "0", "FLOSS")
MISSING_SPELLINGS = ("NONE", "", "NA", "NAN")

# Cell texts that a CSV ledger uses for "no value".
CSV_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Sentinels of the comparison frames.
NOT_IN_REFERENCE = "not_in_purity"
NOT_ANALYSED = "not_analyzed"
NOT_FOUND = "not_found"
UNLABELLED = "unlabelled"


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


# ---------------------------------------------------------------------------
# File shapes (column names as they stand in the files).
LEDGER_FILE = T.StructType(_strings("hash", "purity_analysis", "llm_analysis"))

ITEM_FILE = T.StructType(
    _longs("ind") + _strings("commit1", "commit2", "project", "project_name")
)

DETAIL_FIELDS = (
    "lead", "item_key", "state", "description", "kind", "detail",
)

RESPONSE_RECORD = T.StructType(
    _strings(
        "repository", "commit_hash_before", "commit_hash_current", "commit_message",
        "refactoring_type", "justification", "technical_evidence",
        "confidence_level", "diff_source",
    )
    + _longs("diff_size_chars", "diff_lines")
    + _strings("processing_method")
    + [T.StructField("success", T.BooleanType())]
)

SESSION_INFO = T.StructType(
    _strings(
        "model_used", "analysis_type", "description", "csv_file_analyzed",
        "start_time", "end_time",
    )
    + _longs(
        "total_processed", "successful_analyses", "failed_analyses",
        "skipped_already_analyzed", "processing_errors",
    )
)

SESSION_ANALYSIS = T.StructType(
    _strings(
        "hash", "purity_classification", "llm_classification", "llm_justification",
        "llm_confidence", "project_name", "analysis_timestamp", "llm_raw_response",
        "repository", "commit_hash_before", "commit_hash_current",
        "technical_evidence", "diff_source",
    )
    + _longs("diff_size", "diff_lines")
)

SESSION_FILE = T.StructType(
    [
        T.StructField("session_info", SESSION_INFO),
        T.StructField("analyses", T.ArrayType(SESSION_ANALYSIS)),
        T.StructField("detailed_analyses", T.ArrayType(SESSION_ANALYSIS)),
    ]
)

# ---------------------------------------------------------------------------
# Engine shapes.
LEDGER = T.StructType(_strings("item_key", "reference_label", "candidate_label"))

RESPONSE = T.StructType(_strings("item_key", "response"))

FAILURE = T.StructType(
    [T.StructField("failed_at", T.TimestampType())]
    + _strings(
        "item_key", "repository", "message", "error", "response",
        "response_excerpt", "attempt", "prompt_excerpt",
    )
)
