"""Profile as a JSON document, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_NUMERIC = ("mean", "median", "std", "min", "max")


def _by_name(key: Column, value: Column, order: Column, keep: Column | None = None) -> Column:
    """Aggregate rows into a map in profile order."""
    entry = F.struct(order.alias("o"), key.alias("k"), value.alias("v"))
    entries = F.collect_list(entry if keep is None else F.when(keep, entry))
    return F.map_from_entries(
        F.transform(F.array_sort(entries), lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value")))
    )


def profile_document(
    table: DataFrame,
    columns: DataFrame,
    target: str | None = None,
    distribution: DataFrame | None = None,
) -> DataFrame:
    """One row, ``json``: the whole profile of a table.

    Gathers profile rows only: one per column, and one per value of the target if
    ``distribution`` is given. For a target with very many values leave it out and
    use ``write_profile``.
    """
    numeric = F.struct(*[F.col(s) for s in _NUMERIC])
    mode = F.struct(
        F.col("mode_value").alias("most_frequent_value"),
        F.col("mode_count").alias("most_frequent_count"),
    )
    place, name, is_number = F.col("position"), F.col("column_name"), F.col("is_numeric")
    maps = columns.agg(
        _by_name(name, F.col("missing_count"), place).alias("missing_values_by_column"),
        _by_name(name, F.col("unique_count"), place).alias("unique_values_by_column"),
        _by_name(name, F.col("data_type"), place).alias("data_types_by_column"),
        _by_name(name, numeric, place, is_number).alias("numeric_statistics"),
        _by_name(name, mode, place, ~is_number & F.col("mode_count").isNotNull()).alias(
            "categorical_statistics"
        ),
    )
    counts = ["row_count", "column_count", "duplicate_row_count"]
    whole = table.select(*counts, F.lit(1).alias("_k")).join(
        F.broadcast(maps.withColumn("_k", F.lit(1))), "_k"
    )
    spread = F.lit(None).cast("map<string,bigint>")
    if distribution is not None:
        spread = distribution.agg(
            _by_name(
                F.col("target_value"), F.col("n"), F.struct(-F.col("n"), F.col("target_value"))
            )
        ).scalar()
    document = F.struct(
        *counts,
        *maps.columns,
        F.lit(target).cast("string").alias("target_column"),
        spread.alias("target_distribution"),
        F.lit("").alias("summary"),
    )
    return whole.select(F.to_json(document, {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def write_profile_json(document: DataFrame, path: str) -> str:
    """Write the document (one row) as text into the folder ``path``; parent
    folders are created. Returns the path."""
    document.coalesce(1).write.mode("overwrite").text(path)
    return path


def write_profile(document: DataFrame, distribution: DataFrame, path: str) -> str:
    """Write the document (made without the distribution) into ``path/profile`` and the
    target distribution, at any number of values, as JSON rows into ``path/target_distribution``."""
    write_profile_json(document, f"{path}/profile")
    write_table(distribution, f"{path}/target_distribution", "json")
    return path


def write_table(df: DataFrame, path: str, form: str = "parquet") -> str:
    """Write any result table."""
    df.write.mode("overwrite").format(form).save(path)
    return path



__all__ = ["profile_document", "write_profile", "write_profile_json", "write_table"]
