"""Data-quality findings: threshold rules over the profile tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablereview.functions.expressions import fixed_text

# Thresholds and report texts.
MISSING_LOW, MISSING_MEDIUM = 5.0, 20.0
DUPLICATE_LOW, DUPLICATE_MEDIUM = 2.0, 10.0
CARDINALITY_FLAG, CARDINALITY_HIGH = 0.95, 99.0
ADVICE = {
    "missing_values": (
        "Investigate an appropriate missing-value handling strategy "
        "(e.g. imputation, row removal, or model-based approaches) "
        "before proceeding with modeling."
    ),
    "duplicate_rows": (
        "Investigate whether these duplicates represent legitimate "
        "repeated observations or should be removed before modeling."
    ),
    "high_cardinality": (
        "This column may be an identifier or too high-cardinality "
        "for direct modeling. Review its role before feature "
        "engineering (e.g. consider grouping rare values, target "
        "encoding, or dropping it)."
    ),
    "constant_column": (
        "This column provides little or no predictive information "
        "and should be reviewed for removal before modeling "
        "(unless it is a deliberately constant flag or control column)."
    ),
}
NOUN = "data-quality issue(s)"
NONE_FOUND = "No data-quality issues detected."
FINDING_COLUMNS = ("issue_type", "severity", "column", "evidence", "recommendation")


def _percent(part: Column, rows: Column) -> Column:
    return (part / F.when(rows == 0, 1).otherwise(rows)) * F.lit(100.0)


def _graded(share: Column, low: float, medium: float) -> Column:
    return F.when(share <= low, "low").when(share <= medium, "medium").otherwise("high")


def _finding(table, kind, severity, column, evidence, percent, position, keep=()) -> DataFrame:
    return table.select(
        *keep,
        F.lit(kind).alias("issue_type"),
        severity.alias("severity"),
        column.cast("string").alias("column"),
        evidence.alias("evidence"),
        F.lit(ADVICE[kind]).alias("recommendation"),
        percent.cast("double").alias("percent"),
        position.cast("int").alias("position"),
    )


def missing_values(columns: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``columns`` holds column_name, position, row_count, missing_count.

    ``keep`` names further columns to carry along, such as the key of a review
    when profiles of many tables are judged at once.
    """
    share = _percent(F.col("missing_count"), F.col("row_count"))
    rows = F.when(F.col("row_count") == 0, 1).otherwise(F.col("row_count"))
    evidence = F.concat(
        F.lit("Column '"), F.col("column_name"), F.lit("' has "),
        F.col("missing_count").cast("string"), F.lit(" missing value(s), which is "),
        fixed_text(share, 2), F.lit("% of the "), rows.cast("string"),
        F.lit(" rows in the dataset."),
    )
    return _finding(
        columns.where(F.col("missing_count") > 0), "missing_values",
        _graded(share, MISSING_LOW, MISSING_MEDIUM), F.col("column_name"), evidence, share,
        F.col("position"), keep,
    )


def duplicate_rows(table: DataFrame) -> DataFrame:
    """``table`` is the one-row table profile."""
    share = _percent(F.col("duplicate_row_count"), F.col("row_count"))
    rows = F.when(F.col("row_count") == 0, 1).otherwise(F.col("row_count"))
    evidence = F.concat(
        F.lit("The dataset contains "), F.col("duplicate_row_count").cast("string"),
        F.lit(" duplicate row(s), which is "), fixed_text(share, 2), F.lit("% of the "),
        rows.cast("string"), F.lit(" rows."),
    )
    return _finding(
        table.where(F.col("duplicate_row_count") > 0), "duplicate_rows",
        _graded(share, DUPLICATE_LOW, DUPLICATE_MEDIUM), F.lit(None), evidence, share, F.lit(0),
    )


def high_cardinality(columns: DataFrame) -> DataFrame:
    """``columns`` holds column_name, position, row_count, unique_count."""
    ratio = F.col("unique_count") / F.col("row_count")
    share = ratio * F.lit(100.0)
    evidence = F.concat(
        F.lit("Column '"), F.col("column_name"), F.lit("' has "),
        F.col("unique_count").cast("string"), F.lit(" unique value(s) out of "),
        F.col("row_count").cast("string"), F.lit(" rows, which is "), fixed_text(share, 2),
        F.lit("% of the dataset."),
    )
    flagged = columns.where((F.col("row_count") > 0) & (F.col("unique_count") >= 1)).where(
        F.try_divide("unique_count", "row_count") >= CARDINALITY_FLAG
    )
    severity = F.when(share >= CARDINALITY_HIGH, "high").otherwise("medium")
    return _finding(
        flagged, "high_cardinality", severity, F.col("column_name"), evidence, share, F.col("position")
    )


def constant_column(columns: DataFrame) -> DataFrame:
    evidence = F.concat(
        F.lit("Column '"), F.col("column_name"),
        F.lit("' contains only 1 unique non-null value across the "),
        F.col("row_count").cast("string"), F.lit(" rows in the dataset."),
    )
    return _finding(
        columns.where(F.col("unique_count") == 1), "constant_column", F.lit("medium"),
        F.col("column_name"), evidence, F.lit(None), F.col("position"),
    )


def quality_findings(table: DataFrame, columns: DataFrame) -> DataFrame:
    """All findings with their place in the report (``ordinal``, from 1)."""
    stages = [
        missing_values(columns),
        duplicate_rows(table),
        high_cardinality(columns),
        constant_column(columns),
    ]
    return number_findings(stages, FINDING_COLUMNS)


def number_findings(stages: list[DataFrame], columns: tuple[str, ...]) -> DataFrame:
    """Union of findings in stage order; there are a few rows per profiled column."""
    tagged = [s.withColumn("stage", F.lit(i)) for i, s in enumerate(stages)]
    union = reduce(DataFrame.unionByName, tagged)
    place = F.row_number().over(Window.orderBy("stage", "position"))
    return union.select(place.alias("ordinal"), *columns, "percent")


def report_summary(
    findings: DataFrame, noun: str = NOUN, none_found: str = NONE_FOUND, note: str | None = None
) -> DataFrame:
    """One row: finding_count, summary."""
    counted = findings.agg(F.count(F.lit(1)).alias("finding_count"))
    some = F.concat(F.col("finding_count").cast("string"), F.lit(f" {noun} detected."))
    if note is None:
        text = F.when(F.col("finding_count") > 0, some).otherwise(none_found)
    else:
        text = F.when(F.col("finding_count") > 0, F.concat(some, F.lit(f" {note}"))).otherwise(note)
    return counted.select("finding_count", text.alias("summary"))
