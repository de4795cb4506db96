"""Feature proposals: from profile rows to an ordered table of specs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names that mark identifiers, compared exactly.
ID_NAMES = ("id", "customer_id", "user_id", "account_id", "client_id", "customerid")

SPEC = (
    "ordinal int, feature_name string, transformation_type string, "
    "columns array<string>, parameters map<string,string>"
)


def _spec(name: Column, kind: str, *columns: Column) -> Column:
    return F.struct(
        name.alias("feature_name"),
        F.lit(kind).alias("transformation_type"),
        F.array(*columns).alias("columns"),
    )


def _inputs(facts: DataFrame, target: str) -> DataFrame:
    return facts.where(F.col("column_name") != target)


def _numbered(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """Specs with their ordinal; their number depends on the columns, not the rows."""
    union = reduce(DataFrame.unionByName, parts)
    return _as_specs(union.withColumn("ordinal", F.row_number().over(Window.orderBy(*order))))


def _as_specs(staged: DataFrame) -> DataFrame:
    return staged.select(
        F.col("ordinal").cast("int").alias("ordinal"),
        F.col("spec.feature_name").alias("feature_name"),
        F.col("spec.transformation_type").alias("transformation_type"),
        F.col("spec.columns").alias("columns"),
        F.create_map().cast("map<string,string>").alias("parameters"),
    )


def _staged(table: DataFrame, stage: int, first: Column, second: Column, k: Column, spec: Column):
    return table.select(
        F.lit(stage).alias("stage"),
        first.cast("int").alias("first"),
        second.cast("int").alias("second"),
        k.cast("int").alias("k"),
        spec.alias("spec"),
    )


STAGES = ("log1p", "pairs", "missing")
PAIR_KINDS = 3  # ratio, difference, product


def _indexed(facts: DataFrame, target: str) -> DataFrame:
    """The columns by what their type and range allow: for each stage whether a column takes part, how
    many columns before it do (``_at``), and how many do (``_of``). One row per column."""
    name, low = F.col("column_name"), F.col("min")
    fits = {
        "log1p": F.col("spec_numeric") & ((low > 0) | ((low >= 0) & (F.col("max") > 0))),
        "pairs": F.col("spec_numeric") & ~name.isin(*ID_NAMES) & (low.isNull() | (low >= 0)),
        "missing": F.col("missing_count") > 0,
    }
    before = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    flagged = _inputs(facts, target).select(
        "position", "column_name", *[F.coalesce(fit, F.lit(False)).cast("bigint").alias(s) for s, fit in fits.items()]
    )
    return flagged.select(
        "*",
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_at") for s in STAGES],
        *[F.sum(s).over(Window.partitionBy()).alias(f"{s}_of") for s in STAGES],
    )


def _single(index: DataFrame, stage: str, offset: Column, name: Column, kind: str) -> DataFrame:
    """One spec for each column of a stage."""
    ordinal = (offset + F.col(f"{stage}_at") + 1).alias("ordinal")
    return index.where(F.col(stage) == 1).select(ordinal, _spec(name, kind, F.col("column_name")).alias("spec"))


def _pairs(index: DataFrame, offset: Column) -> DataFrame:
    """Three specs for each pair of columns. The second column is found by its number among those that
    fit, and the ordinal follows from both numbers, so that pairs are neither searched nor sorted."""
    fit = index.where(F.col("pairs") == 1)
    at, of = F.col("pairs_at"), F.col("pairs_of")
    following = F.when(at + 1 < of, F.sequence(at + 1, of - 1))
    first = fit.select(
        F.col("column_name").alias("a"), at.alias("i"), of.alias("m"), offset.alias("offset"), F.explode(following).alias("j")
    )
    second = fit.select(F.col("column_name").alias("b"), at.alias("_j"))
    # one row for each column of the reviewed table
    paired = first.join(F.broadcast(second), F.col("j") == F.col("_j"))
    x, y = F.col("a"), F.col("b")
    specs = F.array(
        _spec(F.concat(F.lit("ratio_"), x, F.lit("_to_"), y), "ratio", x, y),
        _spec(F.concat(F.lit("diff_"), x, F.lit("_minus_"), y), "difference", x, y),
        _spec(F.concat(F.lit("product_"), x, F.lit("_times_"), y), "product", x, y),
    )
    i, j, m = F.col("i"), F.col("j"), F.col("m")
    place = F.expr("i * (2 * m - i - 1) div 2") + (j - i - 1)
    exploded = paired.select(place.alias("place"), "offset", F.posexplode(specs).alias("k", "spec"))
    return exploded.select((F.col("offset") + place_of(F.col("place"), F.col("k"))).alias("ordinal"), "spec")


def place_of(pair: Column, k: Column) -> Column:
    return pair * PAIR_KINDS + k + 1


def _planned(facts: DataFrame, target: str, stages: tuple[str, ...]) -> DataFrame:
    """Specs of the stages one after the other, numbered from 1."""
    index, offset, parts, name = _indexed(facts, target), F.lit(0).cast("bigint"), [], F.col("column_name")
    if "log1p" in stages:
        parts.append(_single(index, "log1p", offset, F.concat(F.lit("log1p_"), name), "log1p"))
        offset = offset + F.col("log1p_of")
    if "pairs" in stages:
        parts.append(_pairs(index, offset))
        offset = offset + F.expr(f"{PAIR_KINDS} * pairs_of * (pairs_of - 1) div 2")
    if "missing" in stages:
        parts.append(_single(index, "missing", offset, F.concat(name, F.lit("_is_missing")), "missing_indicator"))
    return _as_specs(reduce(DataFrame.unionByName, parts))


_ORDER = ["stage", "first", "second", "k"]


def plan_log1p(facts: DataFrame, target: str) -> DataFrame:
    return _planned(facts, target, ("log1p",))


def plan_pairs(facts: DataFrame, target: str) -> DataFrame:
    return _planned(facts, target, ("pairs",))


def plan_missing_indicator(facts: DataFrame, target: str) -> DataFrame:
    return _planned(facts, target, ("missing",))


def plan_features(facts: DataFrame, target: str) -> DataFrame:
    """Log proposals, then pair proposals, then missing indicators.

    ``facts`` is ``profile.table_facts`` or ``column_facts``. Ordinals are worked out from the numbers
    of the columns, so specs of any number are made by many tasks.
    """
    return _planned(facts, target, STAGES)


def append_specs(planned: DataFrame, supplied: DataFrame) -> DataFrame:
    """Planned specs, then supplied ones such as ``suggest.parse_specs`` returns."""
    last = planned.agg(F.coalesce(F.max("ordinal"), F.lit(0))).scalar()
    moved = supplied.withColumn("ordinal", F.col("ordinal") + last)
    return planned.unionByName(moved.select(*planned.columns))


def plan_simple(facts: DataFrame, target: str) -> DataFrame:
    """Opt-in planner: log1p and missing indicator, column by column."""
    name = F.col("column_name")
    table = _inputs(facts, target)
    logs = _staged(
        table.where(F.col("spec_numeric") & (F.col("min") >= 0) & (F.col("max") > 0)), 0,
        F.col("position"), F.lit(0), F.lit(0),
        _spec(F.concat(F.lit("log_"), name), "log1p", name),
    )
    gaps = _staged(
        table.where(F.col("missing_count") > 0), 0, F.col("position"), F.lit(0), F.lit(1),
        _spec(F.concat(name, F.lit("_is_missing")), "missing_indicator", name),
    )
    return _numbered([logs, gaps], _ORDER)
