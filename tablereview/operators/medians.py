"""Exact medians of many columns without sorting or holding a column.

A quantile sketch gives, per column, a narrow bracket of values that should hold
the middle ranks. One more pass counts the rows below the bracket and groups
the few distinct values inside it; the middle values are then read off exactly.
Brackets that would still hold too many values are narrowed first, so the sort
at the end is over a bounded number of rows at any table size. A bracket that
misses the middle is noticed and starts again from all values.

Sketches are merged in two levels: those of the tasks by group of partitions,
then one sketch for each (column, group). So however many tasks there are, no
task has to hold the sketches of all of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablereview.functions.expressions import col

FIRST_ACCURACY = 2_000
ACCURACY = 10_000
MAX_VALUES = 4_000_000
GRID = 1_000
BATCH = 64  # columns per pass
GROUPS = 256  # sketches of a column that meet in one task


@dataclass(frozen=True)
class Bracket:
    rows: int  # non-null rows of the column
    low: float
    high: float
    inside: float  # upper bound of the distinct values strictly inside


@dataclass(frozen=True)
class Summary:
    """Moments and extremes of a column with at least one value."""

    rows: int
    mean: float
    deviation: float | None  # sample standard deviation
    variance: float  # population variance
    low: float
    high: float
    bracket: Bracket | None


def as_number(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return col(name).cast("int").cast("double")
    return col(name).cast("double")


def summaries(
    df: DataFrame, columns: list[str], medians: bool = True, accuracy: int = FIRST_ACCURACY
) -> dict[str, Summary | None]:
    """Summary of each number column; None without a value.

    Columns are turned into (column, value) rows, so that there is one small
    aggregate whatever the number of columns, and partial results of different
    columns are merged by different tasks.
    """
    out: dict[str, Summary | None] = dict.fromkeys(columns)
    margin = 2.0 / accuracy
    ends = [max(0.0, 0.5 - margin), min(1.0, 0.5 + margin)]
    for start in range(0, len(columns), BATCH):
        batch = columns[start : start + BATCH]
        long = _long(df, batch)
        for r in _merged(long, "v", accuracy if medians else None, ends).collect():
            s = _moments(r.parts)
            bracket = Bracket(s.rows, *r.q, 6.0 * s.rows / accuracy) if medians else None
            out[batch[int(r.c)]] = replace(s, low=r.lo, high=r.hi, bracket=bracket)
    return out


def _merged(
    long: DataFrame, value: str, accuracy: int | None, points: list[float], *more: Column
) -> DataFrame:
    """A row for each ``c``: extremes, moments of each group of partitions (``parts``), quantiles of
    ``value`` at ``points`` (``q``, unless ``accuracy`` is None), and sums of ``more``."""
    grouped = long.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    names = [f"m{i}" for i in range(len(more))]
    first = [
        F.struct(F.count("v").alias("n"), F.sum("v").alias("sum"), F.var_pop("v").alias("var")).alias("part"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
        *[m.alias(n) for m, n in zip(more, names)],
    ]
    second = [
        F.collect_list("part").alias("parts"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        *[F.sum(n).alias(n) for n in names],
    ]
    if accuracy is not None:
        # rank error of about 2.3 / k^0.9, below one part in ``accuracy``
        size = min(65_535, max(8, 4 * accuracy))
        first.append(F.kll_sketch_agg_double(value, F.lit(size)).alias("sketch"))
        merged = F.kll_merge_agg_double("sketch", F.lit(size))
        at = F.array(*[F.lit(float(p)) for p in points])
        second.append(F.kll_sketch_get_quantile_double(merged, at).alias("q"))
    return grouped.groupBy("c", "g").agg(*first).groupBy("c").agg(*second)


def _moments(parts: list) -> Summary:
    """Moments of all rows from those of groups of them."""
    rows = sum(p.n for p in parts)
    mean = sum(p["sum"] for p in parts) / rows
    squares = sum(p.n * (p["var"] + (p["sum"] / p.n - mean) ** 2) for p in parts)
    deviation = math.sqrt(squares / (rows - 1)) if rows > 1 else None
    return Summary(rows, mean, deviation, squares / rows, mean, mean, None)


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(c, v) rows of the values; c is the index in ``columns``. NaN is missing."""
    ids = [str(i) for i in range(len(columns))]
    wide = df.select(*[as_number(df, c).alias(i) for i, c in zip(ids, columns)])
    return wide.unpivot([], ids, "c", "v").where(F.col("v").isNotNull() & ~F.isnan("v"))


def exact_medians(
    df: DataFrame,
    columns: list[str],
    accuracy: int = FIRST_ACCURACY,
    max_values: int = MAX_VALUES,
) -> dict[str, float | None]:
    return medians_of(df, summaries(df, columns, accuracy=accuracy), accuracy, max_values)


def medians_of(
    df: DataFrame,
    found: dict[str, Summary | None],
    accuracy: int = ACCURACY,
    max_values: int = MAX_VALUES,
) -> dict[str, float | None]:
    """Exact medians, given the summaries of the same rows."""
    known = {c: s.bracket for c, s in found.items() if s is not None}
    out: dict[str, float | None] = dict.fromkeys(found)
    for limit in (max_values, max_values, math.inf):
        while True:
            wide = {c: b for c, b in known.items() if b.inside > limit and b.low < b.high}
            if not wide:
                break
            known.update(_narrow(df, wide, accuracy))
        names = list(known)
        for start in range(0, len(names), BATCH):
            out.update(_read_off(df, {c: known[c] for c in names[start : start + BATCH]}))
        # a bracket that missed the middle starts again from all values, at last without narrowing
        known = {c: Bracket(b.rows, -math.inf, math.inf, b.rows) for c, b in known.items() if out[c] is None}
        if not known:
            break
    return out


def _of_column(values: list, kind: str) -> Column:
    """The value that belongs to the column index ``c`` of a long row."""
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")[F.col("c").cast("int")]


def _narrow(df: DataFrame, wide: dict[str, Bracket], accuracy: int) -> dict[str, Bracket]:
    """Smaller brackets from one pass: the rows below and inside each bracket, and
    quantiles of the values inside; the two quantiles around the middle remain."""
    grid = [i / GRID for i in range(GRID + 1)]
    margin = 2.0 / accuracy
    names, out = list(wide), {}
    for start in range(0, len(names), BATCH):
        batch = names[start : start + BATCH]
        low = _of_column([wide[c].low for c in batch], "double")
        high = _of_column([wide[c].high for c in batch], "double")
        within = F.when(F.col("v") >= low, F.col("v"))
        rows = _long(df, batch).where(F.col("v") <= high)
        counted = F.count_if(F.col("v") < low), F.count(F.col("w"))
        for r in _merged(rows.withColumn("w", within), "w", accuracy, grid, *counted).collect():
            old, below, inside = wide[batch[int(r.c)]], r.m0, r.m1
            first = ((old.rows - 1) // 2 - below) / inside - margin
            last = (old.rows // 2 + 1 - below) / inside + margin
            i, j = math.floor(first * GRID), math.ceil(last * GRID)
            low_end = r.q[i] if i > 0 else old.low
            high_end = r.q[j] if j < GRID else old.high
            # an unchanged bracket means that few distinct values fill it: read it off
            same = (low_end, high_end) == (old.low, old.high)
            share = (j - i) / GRID + 2.0 / accuracy
            out[batch[int(r.c)]] = Bracket(
                old.rows, low_end, high_end, 0.0 if same else share * inside
            )
    return out


def _read_off(df: DataFrame, brackets: dict[str, Bracket]) -> dict[str, float]:
    """Medians of the columns whose bracket holds the middle."""
    if not brackets:
        return {}
    names = list(brackets)
    # NaN marks "below the bracket": the values themselves hold no NaN
    low = _of_column([b.low for b in brackets.values()], "double")
    high = _of_column([b.high for b in brackets.values()], "double")
    clipped = F.when(F.col("v") < low, F.lit(float("nan"))).otherwise(F.col("v"))
    counts = (
        _long(df, names)
        .where(F.col("v") <= high)
        .groupBy("c", clipped.alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    first = _of_column([(b.rows - 1) // 2 for b in brackets.values()], "bigint")
    last = _of_column([b.rows // 2 for b in brackets.values()], "bigint")
    order = Window.partitionBy("c").orderBy(F.isnan("v").desc(), "v")
    placed = counts.select(
        "c", "v", "n", F.sum("n").over(order).alias("upto"), F.array(first, last).alias("r")
    )

    def holds(i: int) -> Column:
        return (F.col("upto") > F.col("r")[i]) & (F.col("upto") - F.col("n") <= F.col("r")[i])

    middle = (
        placed.groupBy("c")
        .agg(
            F.max(F.when(holds(0), F.col("v"))).alias("a"),
            F.max(F.when(holds(1), F.col("v"))).alias("b"),
        )
        .collect()
    )
    out = {}
    for m in middle:
        if not (m.a is None or m.b is None or m.a != m.a):
            out[names[int(m.c)]] = (m.a + m.b) / 2.0
    return out
