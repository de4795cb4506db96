"""The three notions of "numeric" and the type labels of a profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Label of each Spark type as a profile shows it.
TYPE_LABELS = {
    "tinyint": "int64",
    "smallint": "int64",
    "int": "int64",
    "bigint": "int64",
    "float": "float32",
    "double": "float64",
    "boolean": "bool",
    "string": "str",
}

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def type_label(dtype: T.DataType) -> str:
    text = dtype.simpleString()
    return TYPE_LABELS.get(text, text)


def is_number(dtype: T.DataType) -> bool:
    """Profiler and modeller: booleans are not numbers."""
    return isinstance(dtype, T.NumericType)


def is_number_or_bool(dtype: T.DataType) -> bool:
    """Planner and feature executor: booleans count as numbers."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, NESTED)


def number_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]


def category_columns(df: DataFrame) -> list[str]:
    """Columns that get a mode: everything that is neither a number nor nested."""
    return [
        f.name
        for f in df.schema.fields
        if not is_number(f.dataType) and not is_nested(f.dataType)
    ]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]
