"""Column expressions shared by the operators. All stay in the JVM."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablereview.functions import types as ty

KEY_BYTES = 64


def col(name: str) -> Column:
    """Column by exact name, also when the name holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_as_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in float columns, so that there is one missing value."""
    if not any(isinstance(f.dataType, ty.FLOATING) for f in df.schema.fields):
        return df
    return df.select(
        *[
            F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name)
            if isinstance(f.dataType, ty.FLOATING)
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def display_text(value: Column, dtype: T.DataType) -> Column:
    """Text of a value as reports show it; booleans read True / False."""
    if isinstance(dtype, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    return value.cast("string")


def group_key(value: Column, dtype: T.DataType) -> Column:
    """Short text that identifies a value, for grouping.

    Text of 64 bytes or more is replaced by its SHA-256 (64 hex digits). Shorter
    text stays as it is, so the two can never be equal, and shuffles carry at
    most 64 bytes per value however long the texts are.
    """
    if ty.is_nested(dtype):
        text = F.to_json(value, {"ignoreNullFields": "false"})
    elif isinstance(dtype, ty.FLOATING):
        text = (value + F.lit(0.0)).cast("string")
    else:
        text = display_text(value, dtype)
    if not (ty.is_text(dtype) or ty.is_nested(dtype)):
        return text
    return F.when(F.octet_length(text) < KEY_BYTES, text).otherwise(F.sha2(text, 256))


def row_fingerprint(df: DataFrame, seed: int = 0) -> list[Column]:
    """Two independently seeded 64-bit hashes that identify a whole row.

    A NULL leaves a running hash unchanged, so each value goes in together with
    its null flag. Nested values go in as JSON text. With 128 bits, even 10^12
    different rows share a fingerprint with a chance below 10^-14.
    """
    parts: list[Column] = []
    for f in df.schema.fields:
        value = col(f.name)
        parts.append(value.isNull())
        if ty.is_nested(f.dataType):
            value = F.to_json(value, {"ignoreNullFields": "false"})
        parts.append(value)
    return [
        F.xxhash64(F.lit(start), F.lit(seed), *parts).alias(name)
        for start, name in ((17, "_fp1"), (7919, "_fp2"))
    ]


def fixed_text(value: Column, digits: int, plus: bool = False) -> Column:
    """Decimal text of a double, rounded from its exact binary value.

    ``format_string`` rounds the shortest decimal form half up (0.125 gives
    0.13); report texts round the binary value with ties to even (0.12). The
    fraction is split at 2^-26 so that both halves times 10^digits are exact
    and the comparison with one half cannot be off.
    """
    unit = 10**digits
    x = F.abs(value)
    whole = F.floor(x)
    fraction = x - whole
    high = F.floor(fraction * F.lit(67108864.0)) / F.lit(67108864.0)
    scaled = high * F.lit(float(unit))
    base = F.floor(scaled)
    over = (scaled - base - F.lit(0.5)) + (fraction - high) * F.lit(float(unit))
    up = (over > 0) | ((over == 0) & (base % 2 == 1))
    total = whole.cast("bigint") * unit + base.cast("bigint") + F.when(up, 1).otherwise(0)
    sign = F.when(value < 0, "-").otherwise("+" if plus else "")
    return F.concat(
        sign,
        F.floor(total / unit).cast("string"),
        F.lit("."),
        F.lpad((total % unit).cast("string"), digits, "0"),
    )


def strip_text(value: Column) -> Column:
    """Trim every kind of white space on both ends."""
    blank = r"[\s\x1c-\x1f]"
    return F.regexp_replace(value, rf"(?U)\A{blank}+|{blank}+\z", "")


def rows_as_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """Driver rows of a known small size as a local relation."""
    struct = T.StructType.fromDDL(schema)
    names = struct.fieldNames()
    table = pa.Table.from_pylist(
        [dict(zip(names, row)) for row in rows], schema=to_arrow_schema(struct)
    )
    return spark.createDataFrame(table, struct)
