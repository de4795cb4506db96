"""All figures of all columns from one read of a table, exact medians from a second one.

Every value becomes a row (column, value). Counting equal values gives missing and distinct values
and modes; the counted values of a number column are summed up by cell, and the cells give moments,
extremes and the cell that holds the median. A cell is a range of numbers: 256 for each power of two
and sign. So a column has at most about a million cells, and in practice some thousands, whatever the
number of rows; cells are sums, so they merge in any order and to the same figures. Only the values
of the cell in the middle are read again for the exact median, and not even those if it holds one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablereview.functions import types as ty
from tablereview.functions.expressions import col, group_key
from tablereview.functions.scratch import store
from tablereview.operators.medians import BATCH, Bracket, Summary, medians_of

CELLS = 256  # for each power of two
_ABOVE = 1 << 23  # puts the cells of all positive numbers above the cell of zero
_INFINITE = 1 << 24


@dataclass(frozen=True)
class Figures:
    """What one read tells of a column; ``summary`` is None without a number in it."""

    rows: int
    missing: int
    distinct: int
    mode_key: str | None
    mode_count: int
    summary: Summary | None


def _typed(name: str, dtype: T.DataType) -> tuple[Column, Column, Column]:
    """A value as one of whole number, fraction and text; all three are NULL for a missing one."""
    value = col(name)
    whole, fraction, text = F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(dtype, ty.INTEGRAL):
        whole = value.cast("bigint")
    elif isinstance(dtype, ty.FLOATING):
        # one zero; NaN is missing. A float counts by its own value, which a double holds exactly
        fraction = F.when(~F.isnan(value), value.cast("double") + F.lit(0.0))
    elif isinstance(dtype, T.DecimalType):
        text = value.cast("string")
    elif ty.is_nested(dtype):
        text = F.when(value.isNotNull(), "")
    else:
        text = group_key(value, dtype)
    return whole, fraction, text


def _counted(df: DataFrame, columns: list[str]) -> DataFrame:
    """(c, whole, fraction, text, n): rows of each value of each column, missing ones too.

    Equal values of a task are combined before the shuffle, so a hot value costs one row per task.
    """
    cells = []
    for i, name in enumerate(columns):
        cells += [F.lit(i), *_typed(name, df.schema[name].dataType)]
    long = df.select(F.stack(F.lit(len(columns)), *cells).alias("c", "whole", "fraction", "text"))
    return long.groupBy("c", "whole", "fraction", "text").agg(F.count(F.lit(1)).alias("n"))


def _number(df: DataFrame, columns: list[str]) -> Column:
    """The counted value as a number, if its column is one."""

    def kinds(kind: type) -> list[int]:
        return [i for i, c in enumerate(columns) if isinstance(df.schema[c].dataType, kind)] or [-1]

    return (
        F.when(F.col("c").isin(kinds(T.DecimalType)), F.col("text").try_cast("double"))
        .when(F.col("c").isin(kinds(T.BooleanType)), (F.col("text") == "True").cast("double"))
        .otherwise(F.coalesce("fraction", F.col("whole").cast("double")))
    )


def _step(size: Column, cells: int = CELLS) -> Column:
    return F.floor(F.log2(size) * cells)


def cell_of(v: Column, cells: int = CELLS) -> Column:
    """Ascending number of the cell of a number: never falls as the number rises. ``cells`` for each
    power of two, at most 4096."""
    size = F.abs(v)
    cell = F.when(size == float("inf"), F.lit(_INFINITE)).otherwise(_step(size, cells) + _ABOVE)
    return F.when(v > 0, cell).when(v < 0, -cell).otherwise(0).cast("int")


def _origin(v: Column) -> Column:
    """A number near all numbers of a cell, the same for each of them; sums are taken from there."""
    size = F.abs(v)
    near = F.when((size > 0) & (size < float("inf")), F.pow(F.lit(2.0), _step(size) / float(CELLS)))
    return F.coalesce(F.signum(v) * near, F.lit(0.0))


def _head(v: Column) -> Column:
    """The first 24 bits of a number. Sums of these are exact up to large totals, and what is left of the
    numbers is too small for its rounding to show: means come out as from exact sums."""
    return F.when(F.abs(v) < 1e38, v.cast("float").cast("double")).otherwise(v)


def _tail(v: Column) -> Column:
    return F.when(_head(v) == v, 0.0).otherwise(v - _head(v))


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """A stored row for each (c, cell) of numbers, and one (c, NULL) of missing and other values."""
    counted = _counted(df, columns).withColumn("v", _number(df, columns))
    known = F.coalesce(F.col("whole").cast("string"), F.col("fraction").cast("string"), F.col("text")).isNotNull()
    off = F.col("v") - F.col("origin")
    rows = counted.select(
        "c",
        "text",
        "n",
        "v",
        F.when(F.col("v").isNotNull(), cell_of(F.col("v"))).alias("cell"),
        F.when(F.col("v").isNotNull(), _origin(F.col("v"))).alias("origin"),
        known.alias("known"),
    )
    return store(
        rows.groupBy("c", "cell").agg(
            F.sum("n").alias("n"),
            F.sum(F.when(~F.col("known"), F.col("n"))).alias("missing"),
            F.count_if("known").alias("values"),
            F.max(F.when(F.col("text").isNotNull(), F.col("n"))).alias("mode_count"),
            F.min(F.when(F.col("text").isNotNull(), F.struct(-F.col("n"), F.col("text")))).alias("mode"),
            F.max("origin").alias("origin"),
            F.sum(F.col("n") * _head(F.col("v"))).alias("heads"),
            F.sum(F.col("n") * _tail(F.col("v"))).alias("tails"),
            F.sum(F.col("n") * off).alias("s1"),
            F.sum(F.col("n") * off * off).alias("s2"),
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
        ),
        "cells",
    )


def _summed(cells: DataFrame) -> DataFrame:
    """One row per column, from its cells."""
    column, order = Window.partitionBy("c"), Window.partitionBy("c").orderBy("cell")
    number = F.col("cell").isNotNull()
    valid = F.when(number, F.col("n"))
    at = F.col("origin") - F.col("mean")
    placed = cells.select(
        "*",
        F.sum(valid).over(column).alias("valid"),
        ((F.sum("heads").over(column) + F.sum("tails").over(column)) / F.sum(valid).over(column)).alias("mean"),
        F.sum(valid).over(order).alias("upto"),
    )
    # the cells that hold the two ranks in the middle
    first, last = F.floor((F.col("valid") - 1) / 2), F.floor(F.col("valid") / 2)
    held = number & (F.col("upto") > first) & (F.col("upto") - F.col("n") <= last)
    return placed.groupBy("c").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"),
        F.sum("values").alias("values"),
        F.max("mode_count").alias("mode_count"),
        F.min("mode").alias("mode"),
        F.max("valid").alias("valid"),
        F.max("mean").alias("mean"),
        F.sum(F.col("n") * at * at + 2 * at * F.col("s1") + F.col("s2")).alias("squares"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.min(F.when(held, F.col("lo"))).alias("from"),
        F.max(F.when(held, F.col("hi"))).alias("to"),
        F.sum(F.when(held, F.col("values"))).alias("inside"),
    )


def column_figures(df: DataFrame, columns: list[str] | None = None) -> dict[str, Figures]:
    """Figures of each column (default: all). Each column is read once.

    NaN counts as missing. Nested values are counted only; their distinct values and modes have no meaning.
    """
    columns = df.columns if columns is None else columns
    out = dict.fromkeys(columns, Figures(0, 0, 0, None, 0, None))
    for start in range(0, len(columns), BATCH):
        batch = columns[start : start + BATCH]
        for r in _summed(_cells(df, batch)).collect():
            summary = None
            if r.valid:
                variance = max(0.0, r.squares / r.valid) if r.squares == r.squares else r.squares
                spread = variance if r.lo < r.hi else 0.0
                deviation = (spread * r.valid / (r.valid - 1)) ** 0.5 if r.valid > 1 else None
                bracket = Bracket(r.valid, r["from"], r["to"], r.inside)
                summary = Summary(r.valid, r["mean"], deviation, spread, r.lo, r.hi, bracket)
            key = r["mode"].text if r["mode"] else None
            out[batch[r.c]] = Figures(r.rows, r.missing, r["values"], key, r.mode_count or 0, summary)
    return out


def figure_medians(df: DataFrame, figures: dict[str, Figures]) -> dict[str, float | None]:
    """Exact medians; a column is read only if the cell in the middle holds more than one value."""
    found = {c: f.summary for c, f in figures.items()}
    known = {c: s.low if s.low == s.high else s.bracket.low for c, s in found.items() if s and s.bracket.low == s.bracket.high}
    rest = {c: s for c, s in found.items() if s and c not in known}
    return dict.fromkeys(found) | known | (medians_of(df, rest) if rest else {})
