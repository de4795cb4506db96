"""Places and running totals over one global order, spread over range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablereview.functions.scratch import materialize, store

#: Up to so many rows are put in order by one task.
FEW = 10_000
_ROW_BITS = 33  # of monotonically_increasing_id: partition above, row within it below


def _starts(rows: DataFrame, amount: str | None) -> DataFrame:
    """(_start_part, _start): the total of all earlier range partitions, a row for each."""
    total = F.count(F.lit(1)) if amount is None else F.sum(amount)
    sums = rows.groupBy("_part").agg(total.alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        F.col("_part").alias("_start_part"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"),
    )


def places(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add ``out`` = number of rows strictly before in ``order``, in which rows must be unique.

    The rows are written once; a few get their places from one window over what is written. More
    of them are range-partitioned and sorted, and the number of a row within its sorted partition is
    its place but for the rows of earlier partitions: the sorted rows move once.
    """
    held = store(df, "unplaced")
    if held.count() <= FEW:
        return held.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("bigint") - 1)
    ranged = held.repartitionByRange(*order).sortWithinPartitions(*order)
    ids = F.monotonically_increasing_id()
    numbered = store(
        ranged.select(
            "*",
            F.shiftright(ids, _ROW_BITS).cast("int").alias("_part"),
            ids.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_inner"),
        ),
        "places",
    )
    # one row per range partition, so never more rows than shuffle partitions
    starts = F.broadcast(_starts(numbered, None))
    placed = numbered.join(starts, F.col("_part") == F.col("_start_part"))
    return placed.select(*df.columns, (F.col("_start") + F.col("_inner")).alias(out))


def totals_before(df: DataFrame, order: list[str], amount: str, out: str) -> DataFrame:
    """Add ``out`` = sum of ``amount`` over all rows strictly before in ``order``.

    Rows must be unique in ``order`` (group first): then no key can overfill a
    range partition. The partition of each row is fixed by writing the ranged
    rows out; one total per partition is all that is brought together. The rows are
    written before, so that what makes them is not run again for the borders; a few
    get their totals from one window.
    """
    held = store(df, "amounts")
    if held.count() <= FEW:
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return held.withColumn(out, F.coalesce(F.sum(amount).over(before), F.lit(0)))
    ranged = materialize(
        held.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    )
    starts = _starts(ranged, amount)
    within = (
        Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.withColumn("_inner", F.coalesce(F.sum(amount).over(within), F.lit(0)))
        # one row per range partition, so never more rows than shuffle partitions
        .join(F.broadcast(starts), F.col("_part") == F.col("_start_part"))
        .withColumn(out, F.col("_start") + F.col("_inner"))
        .drop("_part", "_start_part", "_start", "_inner")
    )
