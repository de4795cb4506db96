"""Exploratory findings: target imbalance and dominant categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablereview.functions.expressions import fixed_text
from tablereview.operators.quality import number_findings

# Thresholds and report texts.
IMBALANCE_FLAG, IMBALANCE_MEDIUM, IMBALANCE_HIGH = 0.60, 0.75, 0.90
DOMINANT_FLAG, DOMINANT_MEDIUM, DOMINANT_HIGH = 0.80, 0.90, 0.95
IMBALANCE_MEANING = (
    "One target class represents a disproportionate share of the "
    "observations, which may indicate class imbalance."
)
IMBALANCE_IMPLICATION = (
    "Accuracy alone may be misleading for this target. Consider "
    "class-sensitive evaluation metrics and imbalance handling "
    "strategies (e.g. class weighting, resampling, or threshold "
    "tuning) during modeling."
)
DOMINANT_MEANING = (
    "' is heavily concentrated in a single "
    "category, which may indicate limited variation or a nearly "
    "constant column."
)
DOMINANT_IMPLICATION = (
    "' may contain limited variation. Evaluate "
    "its predictive usefulness before including it in models "
    "(e.g. consider grouping rare categories or dropping it if it "
    "does not provide meaningful signal)."
)
NOUN = "EDA finding(s)"
NONE_FOUND = "No EDA findings detected."
FINDING_COLUMNS = (
    "finding_type",
    "importance",
    "columns",
    "evidence",
    "interpretation",
    "modeling_implication",
)


def _graded(ratio: Column, medium: float, high: float) -> Column:
    return F.when(ratio < medium, "low").when(ratio < high, "medium").otherwise("high")


def _finding(table, kind, importance, column, evidence, meaning, implication, ratio, position):
    return table.select(
        F.lit(kind).alias("finding_type"),
        importance.alias("importance"),
        F.array(column).alias("columns"),
        evidence.alias("evidence"),
        meaning.alias("interpretation"),
        implication.alias("modeling_implication"),
        (ratio * 100).alias("percent"),
        position.cast("int").alias("position"),
    )


def target_imbalance(distribution: DataFrame, target: str) -> DataFrame:
    """``distribution`` holds target_value, n."""
    top = distribution.agg(
        F.count(F.lit(1)).alias("classes"),
        F.sum("n").alias("total"),
        F.min(F.struct(-F.col("n"), F.col("target_value"))).alias("best"),
    ).select(
        "classes", "total", F.col("best.target_value").alias("name"), (-F.col("best.col1")).alias("n")
    )
    ratio = F.try_divide("n", "total")
    evidence = F.concat(
        F.lit("The target class '"), F.col("name"), F.lit("' represents "),
        F.col("n").cast("string"), F.lit(" out of "), F.col("total").cast("string"),
        F.lit(" target observations, which is "), fixed_text(ratio * 100, 2),
        F.lit("% of the dataset."),
    )
    return _finding(
        top.where((F.col("classes") >= 2) & (ratio >= IMBALANCE_FLAG)), "target_imbalance",
        _graded(ratio, IMBALANCE_MEDIUM, IMBALANCE_HIGH), F.lit(target), evidence,
        F.lit(IMBALANCE_MEANING), F.lit(IMBALANCE_IMPLICATION), ratio, F.lit(0),
    )


def dominant_category(columns: DataFrame) -> DataFrame:
    """``columns`` holds column_name, position, row_count, mode_value, mode_count."""
    rows = F.when(F.col("row_count") == 0, 1).otherwise(F.col("row_count"))
    ratio = F.col("mode_count") / rows
    evidence = F.concat(
        F.lit("The categorical column '"), F.col("column_name"),
        F.lit("' is dominated by the value '"), F.col("mode_value"), F.lit("', which appears in "),
        F.col("mode_count").cast("string"), F.lit(" out of "), rows.cast("string"),
        F.lit(" rows ("), fixed_text(ratio * 100, 2), F.lit("% of the dataset)."),
    )
    name = F.concat(F.lit("The feature '"), F.col("column_name"))
    return _finding(
        columns.where((F.col("mode_count") > 0) & (ratio >= DOMINANT_FLAG)), "dominant_category",
        _graded(ratio, DOMINANT_MEDIUM, DOMINANT_HIGH), F.col("column_name"), evidence,
        F.concat(name, F.lit(DOMINANT_MEANING)), F.concat(name, F.lit(DOMINANT_IMPLICATION)), ratio,
        F.col("position"),
    )


def explore_findings(
    columns: DataFrame, distribution: DataFrame | None = None, target: str | None = None
) -> DataFrame:
    stages = [dominant_category(columns)]
    if distribution is not None:
        stages.insert(0, target_imbalance(distribution, target))
    return number_findings(stages, FINDING_COLUMNS)
