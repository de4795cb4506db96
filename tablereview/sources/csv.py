"""CSV with a header and inferred column types."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablereview.functions.expressions import col

# Texts that mean "missing", and those that mean true or false.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
TRUE = ("True", "TRUE", "true")
FALSE = ("False", "FALSE", "false")
BLANK = " \t\n\r\f\v"
WHOLE = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITE = ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")


def _trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANK))


def _as_double(value: Column) -> Column:
    text = F.lower(_trimmed(value))
    infinite = F.when(text.startswith("-"), float("-inf")).otherwise(float("inf"))
    return F.when(text.isin(*INFINITE), infinite).otherwise(text.try_cast("double"))


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Read a CSV file or folder; types are taken from all values of a column.

    Whole numbers become bigint, or double when values are missing; decimals
    double; true/false boolean when none is missing; the rest text. Quoted line
    breaks need ``multi_line``, which keeps Spark from splitting files: when it
    is not given, one pass over the lines finds the files that need it, and only
    those are read so.
    """
    try:
        if multi_line is None:
            text = _read_by_file(spark, path)
        else:
            text = _read_text(spark, path, multi_line)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"CSV file not found: {path}") from None
        raise
    clean = text.select(
        *[F.when(~col(c).isin(*MISSING), col(c)).alias(c) for c in text.columns]
    )
    kinds = _infer(clean)
    return clean.select(*[_cast(col(c), kinds[c]).alias(c) for c in clean.columns])


def _read_text(
    spark: SparkSession, path: str, multi_line: bool, schema: StructType | None = None
) -> DataFrame:
    reader = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
    )
    return (reader.schema(schema) if schema else reader).csv(path)


def _read_by_file(spark: SparkSession, path: str) -> DataFrame:
    """Files with quoted line breaks whole, the others in splits.

    The names of the former are a part of Spark's own file listing; a filter on the
    file path prunes the scans to their files.
    """
    broken = _files_with_quoted_breaks(spark, path)
    if not broken:
        return _read_text(spark, path, False)
    whole = _read_text(spark, path, True)
    if len(broken) == len(whole.inputFiles()):
        return whole
    split = _read_text(spark, path, False, whole.schema)
    inside = F.col("_metadata.file_path").isin(broken)
    return split.where(~inside).unionByName(whole.where(inside))


def _files_with_quoted_breaks(spark: SparkSession, path: str) -> list[str]:
    """Files that have a line with an odd number of quotes."""
    lines = spark.read.text(path)
    quotes = F.char_length("value") - F.char_length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    odd = lines.where(quotes % 2 == 1).select(F.col("_metadata.file_path").alias("file"))
    return [r.file for r in odd.distinct().collect()]


def _infer(df: DataFrame) -> dict[str, str]:
    """Type of every column, from all its values: (column, value) rows, one
    aggregate, whose partial results are a few counts per column and task."""
    ids = [str(i) for i in range(len(df.columns))]
    named = df.select(*[col(c).alias(i) for c, i in zip(df.columns, ids)])
    value, number, digits, whole = (F.col(c) for c in ("v", "number", "digits", "whole"))
    tested = (
        named.unpivot([], ids, "c", "v")
        .select("c", "v", _trimmed(value).alias("number"))
        .select("*", number.rlike(WHOLE).alias("digits"))
        .select("*", (digits & number.try_cast("bigint").isNotNull()).alias("whole"))
    )
    decimal = number.rlike(DECIMAL) | F.lower(number).isin(*INFINITE)
    counts = tested.groupBy("c").agg(
        F.count_if(value.isNull()).alias("missing"),
        F.count(value).alias("values"),
        F.count_if(whole).alias("whole"),
        F.count_if(digits).alias("digits"),
        F.count_if(~whole & decimal).alias("decimal"),
        F.count_if(value.isin(*TRUE, *FALSE)).alias("flags"),
    )
    found = {df.columns[int(r.c)]: r for r in counts.collect()}
    return {c: _kind(found.get(c)) for c in df.columns}


def _kind(r) -> str:
    if r is None or r["values"] == 0:
        return "double"
    if r.whole == r["values"]:
        return "double" if r.missing else "bigint"
    if r.whole + r.decimal == r["values"] and r.digits < r["values"]:
        return "double"
    if r.flags == r["values"] and not r.missing:
        return "boolean"
    return "string"


def _cast(value: Column, kind: str) -> Column:
    if kind == "bigint":
        return _trimmed(value).cast("bigint")
    if kind == "double":
        return _as_double(value)
    if kind == "boolean":
        return F.when(value.isNotNull(), value.isin(*TRUE))
    return value
