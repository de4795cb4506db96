"""A whole review: profile, findings, proposals, comparison, decision."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablereview.functions.expressions import fixed_text
from tablereview.functions.scratch import materialize, spread
from tablereview.operators import explore, planner, quality, suggest
from tablereview.operators.compare import Comparison, compare_models, decide
from tablereview.operators.profile import (
    column_profile,
    require_column,
    table_facts,
    table_profile,
    target_distribution,
)
from tablereview.operators.transforms import feature_report
from tablereview.sources.csv import read_csv
from tablereview.sources.sinks import profile_document, write_profile

Planner = Callable[[DataFrame, str], DataFrame]  # (column facts, target) -> specs


@dataclass(frozen=True)
class Responses:
    """Outside suggestions: one-row tables with a ``response`` column, or None."""

    quality: DataFrame | None = None
    explore: DataFrame | None = None
    features: DataFrame | None = None


@dataclass(frozen=True)
class Review:
    target: str
    table: DataFrame
    columns: DataFrame
    distribution: DataFrame
    quality_findings: DataFrame
    quality_summary: DataFrame
    explore_findings: DataFrame
    explore_summary: DataFrame
    specs: DataFrame | None
    comparison: Comparison
    feature_report: DataFrame
    decision: DataFrame

    def profile_json(self) -> DataFrame:
        return profile_document(self.table, self.columns, self.target, self.distribution)

    def write_profile(self, path: str) -> str:
        """The profile document, and beside it the target distribution as rows."""
        return write_profile(profile_document(self.table, self.columns, self.target), self.distribution, path)

    def result(self) -> DataFrame:
        """One row: the sizes, the findings, both models, the decision and a summary line."""
        issues = self.quality_summary.select("finding_count").scalar()
        found = self.explore_summary.select("finding_count").scalar()
        rows = self.table.select("row_count").scalar()
        width = self.table.select("column_count").scalar()
        line = F.concat(
            F.lit("Pipeline completed. Data quality: "), F.col("quality_issues").cast("string"),
            F.lit(" issue(s). EDA: "), F.col("eda_findings").cast("string"),
            F.lit(" finding(s). Features: "), F.size("features_created").cast("string"),
            F.lit(" created, "), F.size("features_skipped").cast("string"),
            F.lit(" skipped. Modeling: baseline accuracy "), fixed_text(F.col("baseline_accuracy"), 4),
            F.lit(" → engineered "), fixed_text(F.col("engineered_accuracy"), 4),
            F.lit(". Critic decision: "), F.col("decision"), F.lit("."),
        )
        return self.decision.select(
            F.lit(self.target).alias("target_column"),
            rows.alias("row_count"),
            width.alias("column_count"),
            issues.alias("quality_issues"),
            found.alias("eda_findings"),
            *[c for c in self.decision.columns if c != "experiment"],
        ).withColumn("review_summary", line)

    def summary(self) -> str:
        """The run report as text."""
        r = self.result().first()

        def side(name: str) -> str:
            area = r[f"{name}_roc_auc"]
            shown = "n/a" if area is None else f"{area:.4f}"
            return (
                f"{name.capitalize()}: accuracy={r[f'{name}_accuracy']:.4f}, "
                f"f1={r[f'{name}_f1_score']:.4f}, roc_auc={shown}"
            )

        return "\n".join(
            [
                f"Dataset: {r.row_count} rows × {r.column_count} columns",
                f"Data quality: {r.quality_issues} finding(s)",
                f"EDA: {r.eda_findings} finding(s)",
                f"Features: {len(r.features_created)} created, {len(r.features_skipped)} skipped",
                "",
                side("baseline"),
                side("engineered"),
                "",
                f"Critic decision: {r.decision.upper()}",
                *[f"  • {reason}" for reason in r.reasons],
                "",
                r.review_summary,
            ]
        )


def run_review(
    spark: SparkSession,
    source: str | DataFrame,
    target: str,
    plan_with: Planner | None = None,
    loader: Callable[[SparkSession, str], DataFrame] = read_csv,
    responses: Responses | None = None,
    **model_options,
) -> Review:
    """Review a CSV path (through ``loader``) or any DataFrame.

    ``plan_with`` is ``planner.plan_features``, ``planner.plan_simple`` or any
    function of the column facts and the target; without it no features are
    proposed, and both models are the same. ``model_options`` go to
    ``compare_models``.
    """
    df = loader(spark, source) if isinstance(source, str) else source
    require_column(df, target)
    responses = responses or Responses()
    df = spread(df)
    # profile tables are tiny but take scans to make; each is read several times
    table = materialize(table_profile(df))
    facts = table_facts(df)
    columns = column_profile(df, facts=facts)
    distribution = materialize(target_distribution(df, target))

    found = quality.quality_findings(table, columns)
    q_findings, q_summary = _merged(found, responses.quality, "quality")
    seen = explore.explore_findings(columns, distribution, target)
    e_findings, e_summary = _merged(seen, responses.explore, "explore")

    specs = None if plan_with is None else plan_with(facts, target)
    if responses.features is not None:
        supplied = suggest.parse_specs(responses.features, df.columns)
        specs = supplied if specs is None else planner.append_specs(specs, supplied)
    comparison = compare_models(df, target, [] if specs is None else specs, facts=facts, **model_options)
    decision = materialize(decide(comparison.result))
    report = feature_report(comparison.log, table, comparison.plan)
    return Review(
        target, table, columns, distribution, q_findings, q_summary, e_findings, e_summary,
        specs, comparison, report, decision,
    )


def _merged(findings: DataFrame, response: DataFrame | None, kind: str):
    if response is not None:
        return suggest.merge_findings(findings, response, kind)
    rules = quality if kind == "quality" else explore
    return findings, quality.report_summary(findings, rules.NOUN, rules.NONE_FOUND)
