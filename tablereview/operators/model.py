"""Logistic regression on prepared features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablereview.functions import types as ty
from tablereview.functions.expressions import col, rows_as_table
from tablereview.functions.scratch import spread, store
from tablereview.operators.levels import LevelModel, fit_levels, widest
from tablereview.operators.metrics import binary_metrics, class_metrics
from tablereview.operators.passes import PassModel, fit_in_passes, in_passes
from tablereview.operators.prep import Prep, fit_prep
from tablereview.operators.split import MARK, Split, stratified_split

MODEL_NAME = "LogisticRegression"


@dataclass(frozen=True)
class Fitted:
    prep: Prep
    model: LogisticRegressionModel | LevelModel | PassModel
    predictions: DataFrame  # test rows: label, prediction, score

    @property
    def intercept(self) -> float:
        return float(self.model.intercept)

    @property
    def coefficients(self) -> DataFrame:
        """(place, weight) for each feature of a model of two classes."""
        if isinstance(self.model, LevelModel):
            return self.model.coefficients
        if isinstance(self.model, PassModel):
            return self.model.coefficients(self.predictions)
        rows = [(i, float(w)) for i, w in enumerate(self.model.coefficients.toArray())]
        return rows_as_table(self.predictions.sparkSession, "place int, weight double", rows)

    def scored(self, df: DataFrame, keep: list[Column], entries: bool = False) -> DataFrame:
        """``keep`` (and ``entries`` as ``Prep.features`` gives them) plus prediction and score of each row."""
        return _scored(self.model, self.prep, df, keep, entries)


def _scored(
    model: LogisticRegressionModel | LevelModel | PassModel,
    prep: Prep,
    df: DataFrame,
    keep: list[Column],
    entries: bool = False,
) -> DataFrame:
    if isinstance(model, LevelModel | PassModel):
        return model.scored(df, keep, entries)
    scored = model.transform(prep.features(df, keep, entries))
    kept = scored.columns[: len(keep) + entries]
    return scored.select(*kept, "prediction", vector_to_array("probability")[1].alias("score"))


def class_label(target: str, classes: DataFrame, df: DataFrame) -> DataFrame:
    """Add ``_label``: index of the class in sorted order."""
    lookup = classes.select(F.col("t").alias("_t"), F.col("label").alias("_label"))
    return df.join(lookup, col(target) == F.col("_t")).drop("_t")


def fit_predict(
    split: Split, target: str, prep: Prep, max_iter: int = 1000, keep: tuple[Column, ...] = ()
) -> Fitted:
    """Fit on the train rows, predict the test rows.

    The penalty equals an L2 term of one half per squared coefficient against
    the summed loss; features are scaled already. A model of two classes with
    too many coefficients for the driver keeps those of its widest text column
    in a table (``levels``), one of few coefficients and many rows is fitted
    without writing the features (``passes``).
    """
    rows = class_label(target, split.classes, split.rows)
    train, test = rows.where(~F.col(MARK)), rows.where(F.col(MARK))
    test_columns = [*keep, F.col("_label").alias("label")]
    wide = widest(prep) if split.class_count == 2 else None
    passes = split.class_count == 2 and in_passes(prep, split.train_rows)
    if (wide or passes) and train.agg(F.count_distinct("_label")).first()[0] == 2:
        if passes:
            model = fit_in_passes(train, "_label", prep, max_iter)
            return Fitted(prep, model, _scored(model, prep, test, test_columns))
        model = fit_levels(train, "_label", split.train_rows, prep, wide, max_iter)
        scored = store(_scored(model, prep, test, test_columns), "scores")
        return Fitted(prep, model, scored)
    estimator = LogisticRegression(
        maxIter=max_iter,
        regParam=1.0 / split.train_rows,
        elasticNetParam=0.0,
        standardization=False,
        tol=1e-6,
        family="binomial" if split.class_count == 2 else "multinomial",
    )
    model = estimator.fit(prep.features(train, [F.col("_label").alias("label")]))
    return Fitted(prep, model, _scored(model, prep, test, test_columns))


def feature_columns(columns: list[str], target: str) -> list[str]:
    return [c for c in columns if c not in (target, MARK)]


def evaluate(predictions: DataFrame, classes: int, by: tuple[str, ...] = ()) -> DataFrame:
    """accuracy, f1_score, roc_auc (two classes only) and test_rows per group."""
    if classes == 2:
        return binary_metrics(predictions, by).withColumnRenamed("rows", "test_rows")
    base = class_metrics(predictions, by).withColumnRenamed("rows", "test_rows")
    return base.withColumn("roc_auc", F.lit(None).cast("double"))


def model_report(
    df: DataFrame,
    target: str,
    test_size: float = 0.2,
    seed: int = 42,
    max_iter: int = 1000,
    key: str | None = None,
    exclude: tuple[str, ...] = (),
) -> DataFrame:
    """One row: model, task, target, metrics, sizes and notes."""
    used = spread(df.drop(*exclude) if exclude else df)
    split = stratified_split(used, target, test_size, seed, key).stored()
    columns = feature_columns(used.columns, target)
    prep = fit_prep(split.train, columns)
    fitted = fit_predict(split, target, prep, max_iter)
    return report_row(evaluate(fitted.predictions, split.class_count), split, target, used, columns)


def report_row(
    metrics: DataFrame, split: Split, target: str, df: DataFrame, columns: list[str]
) -> DataFrame:
    binary = split.class_count == 2
    kinds = [df.schema[c].dataType for c in columns]
    notes = (
        f"Baseline {MODEL_NAME} model trained on {split.train_rows} training rows and evaluated "
        f"on {split.test_rows} test rows. Numeric features: {sum(map(ty.is_number, kinds))}, "
        f"Categorical features: {sum(map(ty.is_text, kinds))}."
    )
    return metrics.select(
        F.lit(MODEL_NAME).alias("model_name"),
        F.lit("binary_classification" if binary else "multiclass_classification").alias("task_type"),
        F.lit(target).alias("target_column"),
        "accuracy",
        "f1_score",
        "roc_auc",
        F.lit(split.train_rows).cast("bigint").alias("train_rows"),
        "test_rows",
        F.lit(notes).alias("notes"),
    )
