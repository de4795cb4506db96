"""Values of a dictionary of any size for the rows of a table, whatever few keys most rows hold.

A dictionary that fits into what may be broadcast answers its column without moving a row. Of a
larger one only the frequent keys are broadcast: a key with a share of 1 / FREQUENT of the counted
rows, of which there can be FREQUENT. Rows whose keys are all missing or answered by then stay where
they are. The other rows are joined with the whole dictionary; a key that is settled already takes a
spread number into that join instead of itself. So no frequent key meets in one task, and no row
moves for one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablereview.functions import types as ty
from tablereview.functions.expressions import col
from tablereview.functions.scratch import store

#: Bytes of all dictionaries and slices of one call that may be broadcast.
BROADCAST_BYTES = 32 << 20
FREQUENT = 1024
#: Longer text keys are never in a slice.
KEY_BYTES = 64
ROW_BYTES = 64  # of a broadcast row besides its key
SPREAD = 10_000


@dataclass(frozen=True)
class Dictionary:
    """A stored table (key, n, value, pad): unique keys, the rows counted for each, a value, 0."""

    table: DataFrame
    size: int
    rows: int
    bytes: int  # as broadcast

    @staticmethod
    def measured(table: DataFrame) -> Dictionary:
        """Write (key, n, value) out and measure it."""
        held = store(table.select("key", "n", "value", F.lit(0).alias("pad")), "dictionary")
        facts = held.agg(
            F.count(F.lit(1)).alias("size"), F.sum("n").alias("rows"), F.sum(key_bytes(held)).alias("bytes")
        ).first()
        return Dictionary(held, facts.size, facts.rows or 0, (facts.bytes or 0) + ROW_BYTES * facts.size)

    def frequent(self) -> DataFrame:
        """At most FREQUENT keys of at most KEY_BYTES bytes, if they are text."""
        often = F.col("n") * FREQUENT >= self.rows
        return self.table.where(often & (key_bytes(self.table) <= KEY_BYTES))


def key_bytes(table: DataFrame) -> Column:
    if ty.is_text(table.schema["key"].dataType):
        return F.octet_length("key")
    return F.lit(16 if not isinstance(table.schema["key"].dataType, T.BinaryType) else KEY_BYTES + 1)


@dataclass(frozen=True)
class Wanted:
    """A lookup: the key of a row, the dictionary, and the name of the column that gets the value."""

    key: Column
    dictionary: Dictionary
    out: str


def broadcast_whole(wanted: list[Wanted]) -> list[bool]:
    """Which dictionaries are broadcast whole: the smallest ones that fit together, after a slice for
    each of the others."""
    slices = FREQUENT * (KEY_BYTES + ROW_BYTES)
    left = BROADCAST_BYTES - slices * len(wanted)
    whole = [False] * len(wanted)
    for i in sorted(range(len(wanted)), key=lambda i: wanted[i].dictionary.bytes):
        more = wanted[i].dictionary.bytes - slices
        if wanted[i].dictionary.bytes <= slices or more <= left:
            whole[i] = True
            left -= max(0, more)
    return whole


def answered(df: DataFrame, wanted: list[Wanted], whole: list[bool]) -> DataFrame:
    """``df`` with the key of each lookup (``_k0``...) and the values that broadcasts know (``_v0``...)."""
    out = df.select("*", *[w.key.alias(f"_k{i}") for i, w in enumerate(wanted)])
    for i, w in enumerate(wanted):
        known = w.dictionary.table if whole[i] else w.dictionary.frequent()
        known = known.select(F.col("key").alias("_key"), F.col("value").alias(f"_v{i}"))
        # its size has been measured, or is bounded by FREQUENT and KEY_BYTES
        out = out.join(F.broadcast(known), F.col(f"_k{i}") == F.col("_key"), "left").drop("_key")
    return out


def open_rows(wanted: list[Wanted], whole: list[bool]) -> tuple[Column, dict[int, Column]]:
    """Whether a row has a key that the broadcasts do not know, and which."""
    rare = {
        i: F.col(f"_k{i}").isNotNull() & F.col(f"_v{i}").isNull() for i in range(len(wanted)) if not whole[i]
    }
    return reduce(lambda a, b: a | b, rare.values(), F.lit(False)), rare


def look_up(df: DataFrame, wanted: list[Wanted]) -> DataFrame:
    """``df`` plus a column with the value of each key; NULL for a missing or unknown one."""
    if not wanted:
        return df
    whole = broadcast_whole(wanted)
    rows = answered(df, wanted, whole)
    result = [*map(col, df.columns), *[F.col(f"_v{i}").alias(w.out) for i, w in enumerate(wanted)]]
    if all(whole):
        return rows.select(*result)
    is_open, rare = open_rows(wanted, whole)
    rest = rows.where(is_open)
    for i, w in enumerate(wanted):
        if whole[i]:
            continue
        pad = F.when(rare[i], 0).otherwise(1 + F.pmod(F.xxhash64(*[f"_k{j}" for j in rare]), F.lit(SPREAD)))
        table = w.dictionary.table.select(
            F.col("key").alias("_key"), F.col("pad").alias("_zero"), F.col("value").alias("_value")
        )
        joined = rest.withColumn("_pad", pad.cast("int")).join(
            table, (F.col(f"_k{i}") == F.col("_key")) & (F.col("_pad") == F.col("_zero")), "left"
        )
        rest = joined.withColumn(f"_v{i}", F.coalesce(f"_v{i}", "_value")).drop("_key", "_zero", "_value", "_pad")
    return rows.where(~is_open).select(*result).unionAll(rest.select(*result))
