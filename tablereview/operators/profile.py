"""Table and column profiles: counts, missing, distinct, statistics, modes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablereview.functions import types as ty
from tablereview.functions.expressions import (
    KEY_BYTES,
    col,
    display_text,
    group_key,
    nan_as_null,
    row_fingerprint,
    rows_as_table,
)
from tablereview.functions.scratch import spread
from tablereview.operators.figures import Figures, column_figures, figure_medians
from tablereview.operators.medians import BATCH, medians_of, summaries

COLUMN_PROFILE = (
    "position int, column_name string, data_type string, is_numeric boolean, "
    "row_count bigint, missing_count bigint, unique_count bigint, "
    "mean double, median double, std double, min double, max double, "
    "mode_value string, mode_count bigint"
)

_FACTS = (
    "position int, column_name string, data_type string, is_numeric boolean, "
    "spec_numeric boolean, row_count bigint, missing_count bigint, "
    "mean double, median double, std double, min double, max double"
)


def _batches(names: list[str]) -> list[list[str]]:
    return [names[i : i + BATCH] for i in range(0, len(names), BATCH)]


def require_column(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise ValueError(
            f"Target column '{name}' not found in DataFrame. Available columns: {df.columns}"
        )


def table_profile(df: DataFrame) -> DataFrame:
    """One row: row_count, column_count, duplicate_row_count."""
    clean = nan_as_null(df)
    groups = (
        clean.select(*row_fingerprint(clean))
        .groupBy("_fp1", "_fp2")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_row_count"),
    )


def missing_counts(df: DataFrame) -> DataFrame:
    """column_name, missing_count - all columns in one pass."""
    clean = nan_as_null(df)
    counts = clean.agg(*[F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing_count"))
                    for i, c in enumerate(df.columns)
                ]
            )
        )
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(c, key, n): rows per value of category columns; c is the index in ``columns``.

    Equal values of a partition are combined before the shuffle, so a hot value
    costs one row per task.
    """
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    out = None
    for start in range(0, len(columns), BATCH):
        batch = columns[start : start + BATCH]
        ids = [str(start + i) for i in range(len(batch))]
        keyed = df.select(
            *[group_key(col(c), dtypes[c]).alias(i) for c, i in zip(batch, ids)]
        )
        part = (
            keyed.unpivot([], ids, "c", "key")
            .where(F.col("key").isNotNull())
            .groupBy("c", "key")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        out = part if out is None else out.unionByName(part)
    return out


def _numeric_distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    """(c, unique_count) of number columns, grouped as numbers instead of text."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    kinds: dict[str, list[tuple[int, str]]] = {}
    for i, c in enumerate(columns):
        dtype = dtypes[c]
        kind = (
            "bigint"
            if isinstance(dtype, ty.INTEGRAL)
            else "double"
            if isinstance(dtype, ty.FLOATING)
            else dtype.simpleString()
        )
        kinds.setdefault(kind, []).append((i, c))
    parts = []
    for kind, members in kinds.items():
        for start in range(0, len(members), BATCH):
            batch = members[start : start + BATCH]
            plain = df.select(*[col(c).cast(kind).alias(str(i)) for i, c in batch])
            parts.append(
                plain.unpivot([], [str(i) for i, _ in batch], "c", "v")
                .where(F.col("v").isNotNull())
                .where(~F.isnan("v") if kind == "double" else F.lit(True))
                .groupBy("c", "v")
                .agg(F.lit(1).alias("one"))
                .groupBy("c")
                .agg(F.count(F.lit(1)).alias("unique_count"))
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _count_then_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """(c, unique_count, mode_key, mode_count) of category columns.

    Ties go to the smallest key; keys of long texts are their SHA-256.
    """
    return (
        value_counts(df, columns)
        # the smallest of text keys needs rows sorted by column: cheap on a number
        .groupBy(F.col("c").cast("int").alias("c"))
        .agg(
            F.count(F.lit(1)).alias("unique_count"),
            F.max("n").alias("mode_count"),
            F.min(F.struct(-F.col("n"), F.col("key"))).alias("best"),
        )
        .select(
            F.col("c").cast("string").alias("c"),
            "unique_count",
            "mode_count",
            F.col("best.key").alias("mode_key"),
        )
    )


def _mode_texts(df: DataFrame, columns: list[str], modes: DataFrame) -> DataFrame:
    """Add mode_value: the text behind mode_key.

    A key of 64 bytes stands for a long text; one more scan of just the text
    columns finds a row with that key. No text is ever shuffled.
    """
    texts = [
        (i, f.name)
        for i, f in enumerate(df.schema[c] for c in columns)
        if ty.is_text(f.dataType)
    ]
    short = F.octet_length("mode_key") < 64
    if not texts:
        return modes.withColumn("mode_value", F.col("mode_key"))
    keys = {
        r.c: r.mode_key
        for r in modes.where(~short & F.col("c").isin([str(i) for i, _ in texts])).collect()
    }
    if not keys:
        return modes.withColumn("mode_value", F.col("mode_key"))
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    found = df.agg(
        *[
            F.max(F.when(group_key(col(c), dtypes[c]) == keys[str(i)], col(c))).alias(f"t{i}")
            for i, c in texts
            if str(i) in keys
        ]
    ).first()
    lookup = rows_as_table(
        df.sparkSession,
        "c string, mode_text string",
        [(i, found[f"t{i}"]) for i in keys],
    )
    # one row per column on both sides
    return (
        modes.join(F.broadcast(lookup), "c", "left")
        .withColumn("mode_value", F.coalesce("mode_text", "mode_key"))
        .drop("mode_text")
    )


def _with_names(df: DataFrame, columns: list[str], facts: DataFrame) -> DataFrame:
    names = rows_as_table(
        df.sparkSession,
        "c string, column_name string",
        [(str(i), c) for i, c in enumerate(columns)],
    )
    # names: one row per column; facts: at most one row per column
    return names.join(F.broadcast(facts), "c", "left").drop("c")


def distinct_counts(df: DataFrame) -> DataFrame:
    """column_name, unique_count - exact, missing left out; NULL for nested columns."""
    numbers = ty.number_columns(df)
    categories = ty.category_columns(df)
    nested = [f.name for f in df.schema.fields if ty.is_nested(f.dataType)]
    parts = []
    if numbers:
        parts.append(_with_names(df, numbers, _numeric_distinct(df, numbers)))
    if categories:
        counted = (
            value_counts(df, categories).groupBy("c").agg(F.count(F.lit(1)).alias("unique_count"))
        )
        parts.append(_with_names(df, categories, counted))
    out = None
    for part in parts:
        part = part.select("column_name", F.coalesce("unique_count", F.lit(0)).alias("unique_count"))
        out = part if out is None else out.unionByName(part)
    if nested:
        empty = rows_as_table(
            df.sparkSession,
            "column_name string, unique_count bigint",
            [(c, None) for c in nested],
        )
        out = empty if out is None else out.unionByName(empty)
    return out


def modes(df: DataFrame) -> DataFrame:
    """column_name, mode_value, mode_count of every category column."""
    columns = ty.category_columns(df)
    if not columns:
        return rows_as_table(
            df.sparkSession, "column_name string, mode_value string, mode_count bigint", []
        )
    best = _count_then_mode(df, columns)
    if ty.text_columns(df):
        # one row per column: fixed here because it is read twice below
        best = rows_as_table(
            df.sparkSession,
            "c string, unique_count bigint, mode_count bigint, mode_key string",
            [tuple(r) for r in best.collect()],
        )
    return _with_names(df, columns, _mode_texts(df, columns, best)).select(
        "column_name", "mode_value", F.coalesce("mode_count", F.lit(0)).alias("mode_count")
    )


def column_facts(df: DataFrame, medians: bool = True) -> DataFrame:
    """One row per column of everything that needs no shuffle of the data.

    One aggregate counts the rows and the gaps of the other columns, one yields
    the moments, extremes and median brackets of the number columns; a last pass
    reads the exact medians off.
    """
    if medians:
        df = spread(df)
    fields = df.schema.fields
    numbers = [f.name for f in fields if ty.is_number_or_bool(f.dataType)]
    others = [f.name for f in fields if f.name not in numbers]
    rows, gaps = _count_gaps(df, others)
    found = summaries(df, numbers, medians)
    middle: dict[str, float | None] = {}
    if medians:
        wanted = {f.name for f in fields if ty.is_number(f.dataType)}
        middle = medians_of(df, {c: s for c, s in found.items() if c in wanted})
    out = []
    for i, f in enumerate(fields):
        s = found.get(f.name)
        stats = [None] * 5
        if s is not None:
            stats = [s.mean, middle.get(f.name), s.deviation, s.low, s.high]
        missing = gaps[f.name] if f.name in gaps else rows - (s.rows if s else 0)
        kinds = (ty.type_label(f.dataType), ty.is_number(f.dataType), ty.is_number_or_bool(f.dataType))
        out.append((i, f.name, *kinds, rows, missing, *stats))
    return rows_as_table(df.sparkSession, _FACTS, out)


def _count_gaps(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, int]]:
    """Rows of the table, and missing values of some of its columns."""
    rows, gaps = 0, {}
    for batch in _batches(columns) or [[]]:
        counts = [F.count_if(col(c).isNull()) for c in batch]
        row = df.agg(F.count(F.lit(1)), *counts).first()
        rows = row[0]
        gaps.update(zip(batch, row[1:]))
    return rows, gaps


_STATS = ("mean", "median", "std", "min", "max")


def numeric_stats(df: DataFrame) -> DataFrame:
    """column_name, mean, median, std, min, max of every number column."""
    facts = column_facts(df.select(*[col(c) for c in ty.number_columns(df)]))
    return facts.select("column_name", *_STATS)


_ALL_FACTS = _FACTS + ", unique_count bigint, mode_value string, mode_count bigint"


def table_facts(df: DataFrame) -> DataFrame:
    """One row per column of all there is to know of it, from two reads of the table at most: one
    table for the profile, the rules and the planner. Long texts that are modes are looked up in one
    more read of just their columns."""
    df = spread(df)
    fields = df.schema.fields
    figures = column_figures(df)
    middle = figure_medians(df, {f.name: figures[f.name] for f in fields if ty.is_number(f.dataType)})
    shown = _mode_values(df, figures)
    out = []
    for i, f in enumerate(fields):
        x = figures[f.name]
        s = x.summary
        stats = [s.mean, middle.get(f.name), s.deviation, s.low, s.high] if s else [None] * 5
        kinds = (ty.type_label(f.dataType), ty.is_number(f.dataType), ty.is_number_or_bool(f.dataType))
        mode = (None, None)
        if not (ty.is_number(f.dataType) or ty.is_nested(f.dataType)):
            mode = (shown.get(f.name), x.mode_count)
        distinct = None if ty.is_nested(f.dataType) else x.distinct
        out.append((i, f.name, *kinds, x.rows, x.missing, *stats, distinct, *mode))
    return rows_as_table(df.sparkSession, _ALL_FACTS, out)


def _mode_values(df: DataFrame, figures: dict[str, Figures]) -> dict[str, str | None]:
    """The value of each mode. A key of 64 bytes stands for a long text, which one more scan of just
    such columns finds."""
    shown = {c: x.mode_key for c, x in figures.items()}
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    long = [c for c, k in shown.items() if k is not None and ty.is_text(dtypes[c]) and len(k.encode()) >= KEY_BYTES]
    if long:
        texts = [F.max(F.when(group_key(col(c), dtypes[c]) == shown[c], col(c))) for c in long]
        shown |= dict(zip(long, df.agg(*texts).first()))
    return shown


def column_profile(
    df: DataFrame, exclude_target: str | None = None, facts: DataFrame | None = None
) -> DataFrame:
    """The whole column profile, one row per column, in schema order.

    ``exclude_target`` leaves the statistics and the mode of that column empty.
    ``facts`` is ``table_facts(df)`` where that is known already.
    """
    facts = table_facts(df) if facts is None else facts
    keep = F.lit(True) if exclude_target is None else F.col("column_name") != exclude_target
    shown = {s: F.when(F.col("is_numeric") & keep, F.col(s)) for s in _STATS}
    shown |= {m: F.when(keep, F.col(m)) for m in ("mode_value", "mode_count")}
    names = [part.split()[0] for part in COLUMN_PROFILE.split(", ")]
    return facts.select(*[shown.get(n, F.col(n)).alias(n) for n in names])


def target_distribution(df: DataFrame, target: str, missing: bool = True) -> DataFrame:
    """target_value, n per value of the target; missing counts as 'nan'."""
    require_column(df, target)
    dtype = df.schema[target].dataType
    clean = nan_as_null(df.select(col(target).alias("t")))
    if not missing:
        clean = clean.where(F.col("t").isNotNull())
    value = F.coalesce(display_text(F.col("t"), dtype), F.lit("nan"))
    return (
        clean.groupBy(value.alias("target_value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "target_value")
    )


def planner_profile(df: DataFrame, target: str) -> DataFrame:
    """Per non-target column: type, missing, distinct, rows, mean, min, max.

    Booleans count as numbers here; statistics are empty without a value.
    """
    facts = column_facts(df, medians=False)
    return (
        facts.join(F.broadcast(distinct_counts(df)), "column_name", "left")
        .where(F.col("column_name") != target)
        .select(
            "position",
            "column_name",
            "data_type",
            F.col("spec_numeric").alias("is_numeric"),
            "missing_count",
            "unique_count",
            "row_count",
            "mean",
            "min",
            "max",
        )
    )
