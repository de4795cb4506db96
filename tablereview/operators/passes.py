"""Two-class logistic regression in passes over the rows, for tables of many rows.

A pass makes the features of a row where the row is read, and tasks add up the loss with its first and second
derivatives. So feature vectors are neither written nor kept between passes, and what a fit takes on disk does
not grow with the table. Spark adds up the tasks' sums, and the driver takes Newton's steps, as few as the
number of coefficients allows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablereview.functions.expressions import col, rows_as_table
from tablereview.operators.levels import HEAD, SLICE, Sums, _collected, _logistic, newton, sums_of
from tablereview.operators.prep import Prep

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Train rows up to which Spark ML fits, which writes the vectors of all rows and keeps a copy of them. By rows
#: alone, so that both fits of a comparison stop at the same optimum.
MANY_ROWS = 1_000_000


def in_passes(prep: Prep, rows: int) -> bool:
    """Whether a fit of two classes is made in passes: many rows, few coefficients."""
    return rows > MANY_ROWS and 0 < prep.width <= HEAD


@dataclass(frozen=True)
class PassModel:
    """A fit: a coefficient for each place in the features, the intercept last."""

    prep: Prep
    weights: np.ndarray

    @property
    def intercept(self) -> float:
        return float(self.weights[-1])

    def coefficients(self, df: DataFrame) -> DataFrame:
        """(place, weight) for each feature, by place in the vector of ``Prep.features``."""
        rows = [(i, float(w)) for i, w in enumerate(self.weights[:-1])]
        return rows_as_table(df.sparkSession, "place int, weight double", rows)

    def scored(self, df: DataFrame, keep: list[Column], entries: bool = False) -> DataFrame:
        """``keep`` (and ``entries`` as ``Prep.features`` gives them) plus prediction and score of each row."""
        flat, numbers = self.prep.flat(df, keep)
        kept = [col(c) for c in flat.columns[: len(keep)]]
        if entries:
            kept.append(self.prep.entries(numbers).alias("entries"))
        parts = [n * F.lit(float(w)) for n, w in zip(numbers, self.weights)]
        for i, (start, text) in enumerate(zip(self.prep.starts, self.prep.texts)):
            of_slot = F.lit([float(w) for w in self.weights[start : start + text.size]])
            parts.append(F.coalesce(F.get(of_slot, F.col(f"s{i}").cast("int")), F.lit(0.0)))
        margins = flat.select(*kept, sum(parts, F.lit(self.intercept)).alias("_margin"))
        return margins.select(
            *[col(c) for c in margins.columns[:-1]],
            F.when(F.col("_margin") > 0, 1.0).otherwise(0.0).alias("prediction"),
            (1 / (1 + F.exp(-F.col("_margin")))).alias("score"),
        )


def fit_in_passes(train: DataFrame, label: str, prep: Prep, max_iter: int) -> PassModel:
    """Fit on train rows of both classes."""
    numbers = F.array(*[col(n.name).cast("double") for n in prep.numbers]).cast("array<double>").alias("numbers")
    flat = prep.slots(train, [F.col(label).cast("double").alias("label"), numbers])
    scaling = np.array([(n.median, n.mean, n.scale) for n in prep.numbers]).reshape(-1, 3)
    size = prep.width + 1

    def at(weights: np.ndarray) -> Sums:
        parts = flat.mapInArrow(_summed(weights, scaling, prep.starts), "i int, j int, value double")
        return _collected(parts.groupBy("i", "j").agg(F.sum("value").alias("value")), size)

    return PassModel(prep, newton(at, size, max_iter))


def _summed(weights: np.ndarray, scaling: np.ndarray, starts: list[int]) -> Callable:
    """A task's loss at (-1, -1), slope at (-1, place), curvature at (place, place); rows are a label, the
    numbers as they are, and the slot of each text. ``scaling`` has the median, mean and scale of each number."""
    size = len(weights)
    most = max(1, SLICE // size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, slope, curvature = 0.0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            for first in range(0, batch.num_rows, most):
                label, x = _features(batch.slice(first, most), scaling, starts, size)
                margin = weights @ x
                if not np.isfinite(margin).all():
                    raise ValueError("Features must not be NaN or infinite.")
                p = _logistic(margin)
                loss += float((np.logaddexp(0, margin) - label * margin).sum())
                slope += x @ (p - label)
                curvature += (x * (p * (1 - p))) @ x.T
        yield sums_of(loss, slope, curvature)

    return run


def _features(
    rows: pa.RecordBatch, scaling: np.ndarray, starts: list[int], size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Labels, and the features of a row in each column. Numbers are filled and scaled here, as ``Scaled``
    does it: in SQL, so many expressions make a method that Java does not compile."""
    label, numbers, *slots = rows.columns
    x = np.zeros((size, rows.num_rows))
    x[-1] = 1.0
    median, mean, scale = scaling.T[:, :, None]
    values = numbers.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(scaling)).T if len(scaling) else x[:0]
    x[: len(scaling)] = (np.where(np.isnan(values), median, values) - mean) / scale
    for start, column in zip(starts, slots):
        slot = column.fill_null(-1).to_numpy(zero_copy_only=False)
        held = np.flatnonzero(slot >= 0)
        x[start + slot[held], held] = 1.0
    return label.to_numpy(zero_copy_only=False), x
