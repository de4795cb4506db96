"""Baseline against engineered features, and the decision on each experiment."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablereview.functions.expressions import fixed_text
from tablereview.functions.scratch import spread
from tablereview.operators.model import evaluate, feature_columns, fit_predict
from tablereview.operators.prep import fit_prep
from tablereview.operators.split import Split, stratified_split
from tablereview.operators.transforms import FeaturePlan, feature_lists, feature_log, plan_transforms

METRICS = ("accuracy", "f1_score", "roc_auc")


@dataclass(frozen=True)
class Comparison:
    split: Split
    plan: FeaturePlan
    log: DataFrame
    metrics: DataFrame  # one row per variant
    result: DataFrame  # one row: both sides, changes, lists, summary


def compare_models(
    df: DataFrame,
    target: str,
    specs,
    transforms: str = "core",
    test_size: float = 0.2,
    seed: int = 42,
    max_iter: int = 1000,
    key: str | None = None,
    exclude: tuple[str, ...] = (),
    facts: DataFrame | None = None,
) -> Comparison:
    """Train without and with the new features on the same split.

    ``facts`` are the column facts of ``df`` where they are known already.

    Features are row-local, so the rows are split once, before they are made.
    Preparation is fitted once for all columns, and the baseline uses its own
    columns of it - unless a feature replaced one of them.
    """
    used = spread(df.drop(*exclude) if exclude else df)
    split = stratified_split(used, target, test_size, seed, key)
    plan = plan_transforms(used, specs, transforms, target, facts)
    old = feature_columns(used.columns, target)
    new = feature_columns(plan.result_columns, target)
    plain = split.stored()
    if plan.lookups:
        engineered = split.stored(plan.apply(plain.rows))
    else:  # expressions cost less than writing and reading their values
        engineered = replace(plain, rows=plan.apply(plain.rows))
    after = fit_prep(engineered.train, new)
    if set(plan.created) & set(old):
        before = fit_prep(plain.train, old)
    else:
        before = after.only(old)
    sides = {"baseline": (plain, before)}
    if plan.created:
        sides["engineered"] = (engineered, after)
    fit = inheritable_thread_target(df.sparkSession)(fit_predict)
    with ThreadPoolExecutor(len(sides)) as pool:  # the fits do not depend on each other
        started = {n: pool.submit(fit, rows, target, known, max_iter) for n, (rows, known) in sides.items()}
        runs = {n: future.result() for n, future in started.items()}
    predictions = None
    for name, run in runs.items():
        part = run.predictions.withColumn("variant", F.lit(name))
        predictions = part if predictions is None else predictions.unionByName(part)
    metrics = evaluate(predictions, split.class_count, ("variant",))
    if not plan.created:  # the same columns give the same model
        both = F.explode(F.array(F.lit("baseline"), F.lit("engineered")))
        metrics = metrics.drop("variant").select(both.alias("variant"), "*")
    metrics = metrics.withColumn("train_rows", F.lit(split.train_rows).cast("bigint"))
    log = feature_log(df, plan)
    lists = feature_lists(log).select(F.lit(target).alias("experiment"), "features_created", "features_skipped")
    wide = pair_variants(metrics.withColumn("experiment", F.lit(target)))
    return Comparison(
        split,
        plan,
        log,
        metrics,
        deltas(wide.join(F.broadcast(lists), "experiment")),
    )


def pair_variants(metrics: DataFrame) -> DataFrame:
    """One row per experiment out of a baseline and an engineered metrics row."""

    def pick(name: str, variant: str) -> Column:
        return F.max(F.when(F.col("variant") == variant, F.col(name))).alias(f"{variant}_{name}")

    return metrics.groupBy("experiment").agg(
        *[pick(m, v) for v in ("baseline", "engineered") for m in METRICS]
    )


def deltas(pairs: DataFrame) -> DataFrame:
    """Changes, the improved flag and the summary of each experiment."""
    changes = pairs.select(
        "*",
        (F.col("engineered_accuracy") - F.col("baseline_accuracy")).alias("accuracy_change"),
        (F.col("engineered_f1_score") - F.col("baseline_f1_score")).alias("f1_change"),
        (F.col("engineered_roc_auc") - F.col("baseline_roc_auc")).alias("roc_auc_change"),
        (F.col("engineered_f1_score") > F.col("baseline_f1_score")).alias("improved"),
    )
    return changes.withColumn("summary", _summary())


# The wording of summaries here, and of reasons in ``decide``.
def _summary() -> Column:
    def four(name: str, plus: bool = False) -> Column:
        return fixed_text(F.col(name), 4, plus)

    def side(word: str) -> Column:
        return F.concat(
            F.lit(f"{word} model achieved accuracy "), four(f"{word.lower()}_accuracy"),
            F.lit(" and F1 "), four(f"{word.lower()}_f1_score"), F.lit("."),
        )

    area = F.concat(
        F.lit("ROC-AUC changed from "), four("baseline_roc_auc"), F.lit(" to "),
        four("engineered_roc_auc"), F.lit(" (Δ "), four("roc_auc_change", True), F.lit(")."),
    )
    verdict = (
        F.when(F.col("improved"), "The engineered features improved model performance.")
        .when(
            F.col("accuracy_change") > 0,
            "Accuracy improved but F1 did not; some metrics improved while others declined.",
        )
        .otherwise("The engineered features did not improve model performance.")
    )
    # concat_ws leaves out the part that is NULL without an area
    return F.concat_ws(" ", side("Baseline"), side("Engineered"), area, verdict)


def decide(comparisons: DataFrame) -> DataFrame:
    """Accept, reject or review each experiment (one row per comparison).

    Input: accuracy_change, f1_change, roc_auc_change, improved,
    features_created, features_skipped. All other columns are kept.
    """
    accuracy, f1, area = (F.col(c) for c in ("accuracy_change", "f1_change", "roc_auc_change"))
    created, skipped = F.col("features_created"), F.col("features_skipped")
    accuracy_up, f1_up = accuracy > 0, f1 > 0
    area_up, area_down = F.coalesce(area > 0, F.lit(False)), F.coalesce(area < 0, F.lit(False))
    empty = F.size(created) == 0
    accept = accuracy_up & f1_up & ~area_down
    worse = ~(accuracy_up | f1_up | area_up)

    def text(value: Column) -> Column:
        return fixed_text(value, 4, plus=True)

    def reasons(*parts: Column) -> Column:
        return F.filter(F.array(*parts), lambda r: r.isNotNull())

    both = F.concat(F.lit("accuracy Δ"), text(accuracy), F.lit(", F1 Δ"), text(f1), F.lit("."))
    lead = F.when(
        accuracy_up & ~f1_up,
        F.concat(
            F.lit("accuracy improved by "), text(accuracy), F.lit(" but F1 declined by "), text(f1)
        ),
    ).when(
        f1_up & ~accuracy_up,
        F.concat(
            F.lit("F1 improved by "), text(f1), F.lit(" but accuracy declined by "), text(accuracy)
        ),
    )
    tail = F.when(area_down, F.concat(F.lit("ROC-AUC declined by "), text(area)))
    mixed = F.concat_ws("; ", lead, tail)
    none = F.lit(None).cast("string")
    why = (
        F.when(empty, reasons(F.lit("No engineered features were successfully created."), none))
        .when(
            accept,
            reasons(
                F.concat(F.lit("Model performance improved: "), both),
                F.when(area_up, F.concat(F.lit("ROC-AUC Δ"), text(area), F.lit("."))),
            ),
        )
        .when(worse, reasons(F.concat(F.lit("No performance improvement: "), both), none))
        .otherwise(
            reasons(
                F.when(mixed != "", F.concat(F.lit("Mixed results: "), mixed, F.lit("."))),
                F.lit("Engineered features show some benefit but not uniformly positive."),
            )
        )
    )
    decision = (
        F.when(empty, "reject").when(accept, "accept").when(worse, "reject").otherwise("review")
    )
    nothing = F.array().cast("array<string>")
    decided = comparisons.select(
        "*",
        decision.alias("decision"),
        F.when(decision == "reject", nothing).otherwise(created).alias("accepted_features"),
        F.when(decision == "reject", F.concat(created, skipped)).otherwise(skipped).alias("rejected_features"),
        why.alias("reasons"),
        F.col("improved").alias("performance_improved"),
        F.lit(False).alias("leakage_warning"),
    )
    summary = F.concat(
        F.lit("Critic reviewed "), F.size("features_created").cast("string"),
        F.lit(" engineered feature(s). Decision: "), F.upper("decision"), F.lit(". Key reasons: "),
        F.array_join(F.slice("reasons", 1, 3), "; "),
    )
    return decided.withColumn("decision_summary", summary)
