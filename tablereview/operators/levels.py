"""Two-class logistic regression with a text column of so many levels that their coefficients are a table.

At given coefficients of the other features (the head), the best coefficient of a level only depends on the
rows of that level. So the rows of a level are kept together, tasks find its coefficient, and what goes to the
driver is the loss with its first and second derivatives in the head, added up by Spark. The driver takes
Newton's steps in the head, whose size does not depend on the table. Levels that many rows hold belong to
the head. The optimum is that of all coefficients at once: the loss is convex.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablereview.functions.expressions import col, rows_as_table
from tablereview.functions.scratch import store
from tablereview.operators.prep import Encoded, Prep

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Up to so many coefficients Spark ML fits, which sends a number for each of them per evaluation.
DRIVER_COEFFICIENTS = 4096
#: Coefficients of the head before frequent levels.
HEAD = 256
#: A level is frequent, and part of the head, with more rows than this and more than 1 / FREQUENT of all.
LEVEL_ROWS = 4096
FREQUENT = 256
BLOCK_ROWS = 1024
SPREAD = 10_000
#: Numbers of a dense slice of features in a task.
SLICE = 1 << 20
#: The next step would gain less than this share of the loss.
TOLERANCE = 1e-12

Sums = tuple[float, np.ndarray, np.ndarray]  # loss, slope and curvature in the head


def widest(prep: Prep) -> Encoded | None:
    """The text column whose levels stay a table; None if all coefficients are for Spark ML."""
    if prep.width <= DRIVER_COEFFICIENTS:
        return None
    text = max(prep.texts, key=lambda t: t.size)
    return text if prep.width - text.size <= HEAD else None


@dataclass(frozen=True)
class Layout:
    """Places in the head: numbers, levels of the other texts, frequent levels of the wide one, intercept."""

    prep: Prep
    wide: Encoded
    frequent: list[int]  # slots of the wide column

    @staticmethod
    def of(prep: Prep, wide: Encoded, rows: int) -> Layout:
        often = F.col("n") > max(LEVEL_ROWS, rows // FREQUENT)
        # the level that fills gaps holds more rows than were counted
        found = prep.levels.where((F.col("c") == wide.id) & (often | (F.col("slot") == wide.mode_slot)))
        return Layout(prep, wide, sorted(r.slot for r in found.select("slot").collect()))

    @property
    def others(self) -> list[tuple[int, int, Encoded]]:
        """Number of each other text column among all, its start in the head, the column."""
        out, start = [], len(self.prep.numbers)
        for i, text in enumerate(self.prep.texts):
            if text is not self.wide:
                out.append((i, start, text))
                start += text.size
        return out

    @property
    def first_frequent(self) -> int:
        return self.prep.width - self.wide.size

    @property
    def size(self) -> int:
        return self.first_frequent + len(self.frequent) + 1

    def place_of_frequent(self, slot: Column) -> Column:
        """Place of a frequent level of the wide column from 0; NULL for other levels."""
        return F.nullif(F.array_position(F.lit(self.frequent).cast("array<bigint>"), slot), F.lit(0)) - 1

    def flat(self, df: DataFrame, keep: list[Column], entries: bool = False) -> DataFrame:
        """``keep`` (and ``entries`` as ``Prep.features`` gives them) plus numbers, places in the head (-1:
        none) and the slot of the wide column, NULL for a level in the head or an unseen one."""
        numbers = F.array(*[n.expression() for n in self.prep.numbers]).cast("array<double>").alias("numbers")
        rows = self.prep.slots(df, [*keep, numbers])
        slot = F.col(f"s{self.prep.texts.index(self.wide)}")
        frequent = self.place_of_frequent(slot)
        places = [F.lit(start) + F.col(f"s{i}") for i, start, _ in self.others]
        places.append(F.lit(self.first_frequent) + frequent)
        values = [F.get("numbers", F.lit(i)) for i in range(len(self.prep.numbers))]
        return rows.select(
            *map(col, rows.columns[: len(keep)]),
            *([self.prep.entries(values).alias("entries")] if entries else []),
            "numbers",
            F.array(*[F.coalesce(p, F.lit(-1)).cast("int") for p in places]).alias("places"),
            F.when(frequent.isNull(), slot).alias("level"),
        )


@dataclass(frozen=True)
class LevelModel:
    """A fit: the coefficients of the head, and a table (level, weight) of the others."""

    layout: Layout
    head: np.ndarray
    weights: DataFrame

    @property
    def intercept(self) -> float:
        return float(self.head[-1])

    @property
    def coefficients(self) -> DataFrame:
        """(place, weight) for each feature, by place in the vector of ``Prep.features``."""
        prep, layout, head = self.layout.prep, self.layout, self.head
        starts = prep.starts
        rows = [(i, float(head[i])) for i in range(len(prep.numbers))]
        for i, start, text in layout.others:
            rows += [(starts[i] + k, float(head[start + k])) for k in range(text.size)]
        first = starts[prep.texts.index(layout.wide)]
        rows += [(first + s, float(head[layout.first_frequent + k])) for k, s in enumerate(layout.frequent)]
        rest = self.weights.select((F.lit(first) + F.col("level")).cast("int").alias("place"), "weight")
        return rows_as_table(self.weights.sparkSession, "place int, weight double", rows).unionAll(rest)

    def scored(self, df: DataFrame, keep: list[Column], entries: bool = False) -> DataFrame:
        """``keep`` (and ``entries``) plus prediction and score of each row."""
        rows = self.layout.flat(df, keep, entries)
        kept = rows.columns[: len(keep) + entries]
        head = F.lit([float(w) for w in self.head])
        parts = [F.get("numbers", F.lit(i)) * F.lit(float(self.head[i])) for i in range(len(self.layout.prep.numbers))]
        parts += [
            F.coalesce(F.get(head, F.nullif(F.get("places", F.lit(j)), F.lit(-1))), F.lit(0.0))
            for j in range(len(self.layout.others) + 1)
        ]
        known = sum(parts, F.lit(self.intercept))
        # rows without a level of the table get a spread number, so that they do not meet in a task
        away = -1 - F.pmod(F.xxhash64(*map(col, kept), "numbers"), F.lit(SPREAD))
        rows = rows.select(*map(col, kept), known.alias("_known"), F.coalesce("level", away).alias("_level"))
        joined = rows.join(self.weights, F.col("_level") == F.col("level"), "left")
        margin = F.col("_known") + F.coalesce("weight", F.lit(0.0))
        margins = joined.select(*map(col, kept), margin.alias("_margin"))
        return margins.select(
            *map(col, kept),
            F.when(F.col("_margin") > 0, 1.0).otherwise(0.0).alias("prediction"),
            (1 / (1 + F.exp(-F.col("_margin")))).alias("score"),
        )


def fit_levels(train: DataFrame, label: str, rows: int, prep: Prep, wide: Encoded, max_iter: int) -> LevelModel:
    """Fit on train rows of both classes."""
    layout = Layout.of(prep, wide, rows)
    blocks = _blocks(layout.flat(train, [F.col(label).cast("double").alias("label")]), rows)
    shape = (len(prep.numbers), len(layout.others) + 1, layout.size)

    def at(head: np.ndarray) -> Sums:
        parts = blocks.mapInArrow(_summed(head, shape), "i int, j int, value double")
        return _collected(parts.groupBy("i", "j").agg(F.sum("value").alias("value")), layout.size)

    head = newton(at, layout.size, max_iter)
    weights = blocks.mapInArrow(_level_weights(head, shape), "level bigint, weight double")
    return LevelModel(layout, head, store(weights, "weights"))


def _blocks(flat: DataFrame, rows: int) -> DataFrame:
    """Rows (equal ones counted) in blocks, a row of a table each; a level is in one block."""
    equal = flat.groupBy("label", "numbers", "places", "level").agg(F.count(F.lit(1)).alias("n"))
    spread = F.when(F.col("level").isNull(), F.xxhash64("label", "numbers", "places")).otherwise(F.xxhash64("level"))
    block = F.pmod(spread, F.lit(math.ceil(rows / BLOCK_ROWS)))
    row = F.struct(
        "label", "numbers", "places", F.coalesce("level", F.lit(-1)).alias("level"), F.col("n").cast("double").alias("n")
    )
    return store(equal.groupBy(block.alias("block")).agg(F.collect_list(row).alias("rows")).select("rows"), "blocks")


def _collected(sums: DataFrame, size: int) -> Sums:
    loss, slope, curvature = 0.0, np.zeros(size), np.zeros((size, size))
    for i, j, value in sums.collect():
        if j < 0:
            loss = value
        elif i < 0:
            slope[j] = value
        else:
            curvature[i, j] = curvature[j, i] = value
    return loss, slope, curvature


def sums_of(loss: float, slope: np.ndarray, curvature: np.ndarray) -> pa.RecordBatch:
    """The loss at (-1, -1), the slope at (-1, place) and the curvature at (place, place), as rows."""
    i, j = np.nonzero(np.triu(curvature))
    at = np.arange(len(slope))
    return pa.RecordBatch.from_pydict({
        "i": pa.array(np.r_[-1, np.full(len(slope), -1), i], pa.int32()),
        "j": pa.array(np.r_[-1, at, j], pa.int32()),
        "value": pa.array(np.r_[loss, slope, curvature[i, j]], pa.float64()),
    })


def newton(at: Callable[[np.ndarray], Sums], size: int, max_iter: int) -> np.ndarray:
    """Newton's method, steps halved until the loss falls; all but the last coefficient are
    penalised by half their square."""
    penalised = np.r_[np.ones(size - 1), 0.0]

    def whole(x: np.ndarray) -> Sums:
        loss, slope, curvature = at(x)
        return loss + 0.5 * float(penalised @ x**2), slope + penalised * x, curvature + np.diag(penalised)

    x = np.zeros(size)
    loss, slope, curvature = whole(x)
    for _ in range(max_iter):
        step = -np.linalg.solve(curvature, slope)
        gain = -float(slope @ step) / 2
        if not gain > TOLERANCE * max(1.0, abs(loss)):
            break
        share = 1.0
        while True:
            found = whole(x + share * step)
            if found[0] <= loss - 1e-4 * share * gain:
                break
            share /= 2
            if share < 1e-6:  # no more to gain than rounding takes
                return x
        x = x + share * step
        loss, slope, curvature = found
    return x


@dataclass(frozen=True)
class _Rows:
    """Rows of whole levels, by level; level -1 is that of the rows without one."""

    label: np.ndarray
    numbers: np.ndarray
    places: np.ndarray
    n: np.ndarray
    levels: np.ndarray
    starts: np.ndarray
    group: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, numbers: int, ones: int) -> _Rows:
        rows = batch.column(0).flatten()
        field = {f.name: rows.field(i) for i, f in enumerate(rows.type)}
        level = field["level"].to_numpy(zero_copy_only=False)
        order = np.argsort(level, kind="stable")
        levels, starts, counts = np.unique(level[order], return_index=True, return_counts=True)

        def of(name: str) -> np.ndarray:
            return field[name].to_numpy(zero_copy_only=False)[order]

        def wide(name: str, width: int) -> np.ndarray:
            return field[name].flatten().to_numpy(zero_copy_only=False).reshape(len(level), width)[order]

        return _Rows(
            of("label"), wide("numbers", numbers), wide("places", ones), of("n"),
            levels, starts, np.repeat(np.arange(len(levels)), counts),
        )

    def features(self, a: int, b: int, size: int) -> np.ndarray:
        x = np.zeros((b - a, size))
        x[:, : self.numbers.shape[1]] = self.numbers[a:b]
        x[:, -1] = 1.0
        for at in self.places[a:b].T:
            held = np.flatnonzero(at >= 0)
            x[held, at[held]] = 1.0
        return x

    def known(self, head: np.ndarray) -> np.ndarray:
        """The margin of each row without its level."""
        of_place = np.r_[head, 0.0]  # place -1 is the last
        return self.numbers @ head[: self.numbers.shape[1]] + of_place[self.places].sum(axis=1) + head[-1]

    def solved(self, known: np.ndarray) -> np.ndarray:
        """The best coefficient of each level: Newton's steps within bounds, halving where they leave them."""
        free = self.levels >= 0
        most = np.where(free, np.add.reduceat(self.n, self.starts), 0.0)
        u, low, high = np.zeros(len(most)), -most, most
        for _ in range(200):
            p = _logistic(known + u[self.group])
            slope = np.add.reduceat(self.n * (p - self.label), self.starts) + u
            curvature = np.add.reduceat(self.n * p * (1 - p), self.starts) + 1
            low, high = np.where(slope < 0, u, low), np.where(slope > 0, u, high)
            new = u - slope / curvature
            new = np.where((new >= low) & (new <= high), new, (low + high) / 2)
            new = np.where(free, new, 0.0)
            change, u = np.abs(new - u), new
            if not np.any(change > 1e-13 * (1 + np.abs(u))):
                break
        return u


def _logistic(margin: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * margin))


def _summed(head: np.ndarray, shape: tuple[int, int, int]) -> Callable:
    """A task's loss at (-1, -1), slope at (-1, place), curvature at (place, place)."""
    numbers, ones, size = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, slope, curvature = 0.0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Rows.of(batch, numbers, ones)
            known = rows.known(head)
            u = rows.solved(known)
            margin = known + u[rows.group]
            p = _logistic(margin)
            bend = rows.n * p * (1 - p)
            loss += float(rows.n @ (np.logaddexp(0, margin) - rows.label * margin)) + 0.5 * float(u @ u)
            share = np.where(rows.levels >= 0, 1 / (1 + np.add.reduceat(bend, rows.starts)), 0.0)
            last, held = -1, np.zeros(size)  # sums of the level that the next slice may go on with
            most = max(1, SLICE // size)
            for a in range(0, len(p), most):
                b = min(a + most, len(p))
                x = rows.features(a, b, size)
                slope += x.T @ (rows.n * (p - rows.label))[a:b]
                bent = x * bend[a:b, None]
                curvature += x.T @ bent
                group, starts = np.unique(rows.group[a:b], return_index=True)
                sums = np.add.reduceat(bent, starts)
                if group[0] == last:
                    sums[0] += held
                elif last >= 0:
                    curvature -= share[last] * np.outer(held, held)
                last, held = group[-1], sums[-1].copy()
                curvature -= (sums[:-1] * share[group[:-1], None]).T @ sums[:-1]
            curvature -= share[last] * np.outer(held, held)
        yield sums_of(loss, slope, curvature)

    return run


def _level_weights(head: np.ndarray, shape: tuple[int, int, int]) -> Callable:
    numbers, ones, _ = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _Rows.of(batch, numbers, ones)
                u, free = rows.solved(rows.known(head)), rows.levels >= 0
                yield pa.RecordBatch.from_pydict({
                    "level": pa.array(rows.levels[free], pa.int64()), "weight": pa.array(u[free], pa.float64()),
                })

    return run
