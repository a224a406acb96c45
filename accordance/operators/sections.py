"""Sectioned texts: numbering and reduction.

A text arrives in one row, and the row is split, cut and joined again in place with
array functions. No line ever goes through a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordance.functions.common import col, let

# Limits, section marks and the two notes of a cut.
MAX_CHARS, LINES_PER_SECTION, SIMPLE_LIMIT = 60_000, 400, 50_000
SECTION_HEADER, KEPT_LINE = r"diff --git", r"^@@"
LINES_OMITTED = "... (linhas adicionais omitidas)"
GLOBALLY_CUT = "\n... (diff truncado por limite global)"
SIMPLY_CUT = "\n... (truncado)"


def _sections(text: Column, header: str) -> Column:
    """Pieces that each begin at a header line (a first piece may lack one)."""
    return F.split(text, rf"\n(?={header})")


def numbered_lines(
    df: DataFrame, text: str = "text", header: str = SECTION_HEADER
) -> DataFrame:
    """One row per line with its section number and its line number in the section.

    Section 0 holds lines before the first header; sections count from 1.
    """
    starts = F.col(text).rlike(rf"\A(?:{header})")
    return (
        df.select(
            "*",
            F.posexplode(_sections(F.col(text), header)).alias("_at", "_section"),
        )
        .select(
            *df.columns,
            (F.col("_at") + starts.cast("int")).cast("bigint").alias("section_no"),
            F.posexplode(F.split("_section", "\n")).alias("_line_at", "line"),
        )
        .select(
            *[c for c in df.columns if c != text],
            "section_no",
            (F.col("_line_at") + 1).cast("bigint").alias("line_no"),
            "line",
        )
    )


def _cut_section(section: Column, limit: int, kept: str, note: str) -> Column:
    """(lines, cut?) of one section."""

    def cut(lines: Column) -> Column:
        head = F.slice(lines, 1, limit)
        rest = F.slice(lines, limit + 1, F.greatest(F.size(lines) - limit, F.lit(0)))

        def with_rest(rest: Column) -> Column:
            marks = F.transform(rest, lambda x: x.rlike(kept))
            first_out = F.array_position(marks, False) - 1

            def tail(first: Column) -> Column:
                lines_left = F.transform(
                    rest,
                    lambda x, i: F.when(x.rlike(kept), x).when(i == first, F.lit(note)),
                )
                notes = F.transform(marks, lambda m, i: F.when(m, False).when(i == first, True))
                return F.struct(
                    F.concat(head, F.array_compact(lines_left)).alias("lines"),
                    # which of the lines is the note
                    F.concat(F.transform(head, lambda x: F.lit(False)), F.array_compact(notes)).alias("notes"),
                )

            return let(first_out, tail)

        return let(rest, with_rest)

    return let(F.split(section, "\n"), cut)


def reduce_sections(
    df: DataFrame,
    text: str = "text",
    max_chars: int = MAX_CHARS,
    lines_per_section: int = LINES_PER_SECTION,
    header: str = SECTION_HEADER,
    kept: str = KEPT_LINE,
    note: str = LINES_OMITTED,
    cut_note: str = GLOBALLY_CUT,
) -> DataFrame:
    """Cut long texts per section and then as a whole; adds the reduced text and a report.

    The whole-text limit cuts after the first line that passes it, which is the
    first line break beyond that many characters of the joined text.
    """
    t = F.col(text)
    long = F.coalesce(F.length(t) > max_chars, F.lit(False))
    out = df.withColumn("_long", long).withColumn(
        "_parts",
        F.when(
            F.col("_long"),
            F.transform(
                _sections(t, header),
                lambda s: _cut_section(s, lines_per_section, kept, note),
            ),
        ),
    )
    out = out.withColumn(
        "_joined",
        F.array_join(F.flatten(F.transform("_parts", lambda p: p["lines"])), "\n"),
    )
    out = out.withColumn(
        "_end",
        F.when(
            F.length("_joined") > max_chars,
            F.locate("\n", F.col("_joined"), max_chars + 2),
        ),
    )
    # Sections behind the cut do not count as truncated: only notes that were kept.
    body = F.when(F.col("_end") > 0, F.col("_joined").substr(F.lit(1), F.col("_end") - 1)).otherwise(
        F.col("_joined")
    )
    out = out.withColumn("_body", body)
    reduced = F.when(
        F.col("_long"),
        F.when(F.col("_end").isNotNull(), F.concat("_body", F.lit("\n" + cut_note))).otherwise(
            F.col("_body")
        ),
    ).otherwise(t)
    # A text may hold such a line of its own. The body is the first lines as they were joined.
    lines = F.size(F.split("_body", "\n"))
    notes = F.size(F.filter(F.slice(F.flatten(F.transform("_parts", lambda p: p["notes"])), F.lit(1), lines), lambda x: x))
    return out.withColumn("reduced_text", reduced).select(
        *df.columns,
        "reduced_text",
        F.col("_long").alias("reduced"),
        F.coalesce(F.length(t), F.lit(0)).cast("bigint").alias("original_chars"),
        F.coalesce(F.length("reduced_text"), F.lit(0)).cast("bigint").alias("new_chars"),
        F.when(F.col("_long"), notes).otherwise(0).cast("bigint").alias("truncated_sections"),
    )


def truncate_text(
    df: DataFrame, text: str = "text", limit: int = SIMPLE_LIMIT, note: str = SIMPLY_CUT
) -> DataFrame:
    t = col(text)
    long = F.coalesce(F.length(t) > limit, F.lit(False))
    return df.select(
        "*",
        F.when(long, F.concat(F.substring(t, 1, limit), F.lit(note))).otherwise(t).alias("short_text"),
        long.alias("truncated"),
        F.coalesce(F.length(t), F.lit(0)).cast("bigint").alias("original_chars"),
        F.when(long, limit).otherwise(F.coalesce(F.length(t), F.lit(0))).cast("bigint").alias("kept_chars"),
    )
