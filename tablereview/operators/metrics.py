"""Classification metrics over a table of predictions, per group of rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablereview.functions.scratch import store
from tablereview.operators.figures import cell_of

WIDE = "decimal(38,0)"
CELLS = 4096  # of scores for each power of two
#: Rows that one task merges or puts in order; tasks grow in number with the rows.
TASK_ROWS = 500_000
#: Tasks that a frequent score is dealt to before it is merged.
SPREAD = 64


def class_metrics(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """accuracy and weighted f1_score from label and prediction.

    The rows shrink to one per (group, label, prediction) before the shuffle.
    """
    cells = predictions.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(
            F.col("label").alias("c"), F.col("n").alias("support"), zero.alias("guessed"), hit.alias("hits")
        ),
        F.struct(
            F.col("prediction").alias("c"), zero.alias("support"), F.col("n").alias("guessed"), zero.alias("hits")
        ),
    )
    per_class = (
        cells.select(*by, F.explode(sides).alias("s"))
        .groupBy(*by, F.col("s.c").alias("c"))
        .agg(
            F.sum("s.support").alias("support"),
            F.sum("s.guessed").alias("guessed"),
            F.sum("s.hits").alias("hits"),
        )
    )
    f1 = 2.0 * F.col("hits") / (F.col("support") + F.col("guessed"))
    return per_class.groupBy(*by).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("support") * f1) / F.sum("support")).alias("f1_score"),
        F.sum("support").alias("rows"),
    )


def _score_cell() -> Column:
    """The range of scores that a score lies in; missing ones come first, NaN last."""
    score = F.col("score").cast("double")
    return F.when(F.isnan(score), F.lit(1 << 25)).when(score.isNotNull(), cell_of(score, CELLS))


def _tasks(rows: DataFrame) -> int:
    count = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(math.ceil(count / TASK_ROWS), min(cores, math.ceil(count / 10_000)), 1)


def _merged(predictions: DataFrame, by: tuple[str, ...], **counts: Column) -> tuple[DataFrame, int]:
    """A row with the ``counts`` of its rows for each (group, cell, score), and the number of tasks.

    Most scores may occur once, so rows are dealt out before equal ones are merged: a task merges a
    bounded number of scores, however much of the table one task reads. A frequent score goes to
    SPREAD tasks, and only its sums meet. The few columns are written first, and counted there.
    """
    flags = reduce(Column.__add__, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(counts.values())])
    rows = store(predictions.select(*by, "score", flags.alias("_flags")), "scores")
    tasks = _tasks(rows)
    dealt = rows.withColumn("_deal", F.spark_partition_id() % SPREAD).repartition(tasks, *by, "score", "_deal")
    parts = dealt.groupBy(*by, "score", "_deal").agg(
        *[F.count_if(F.getbit("_flags", F.lit(i)) == 1).alias(n) for i, n in enumerate(counts)]
    )
    placed = parts.withColumn("cell", _score_cell()).repartition(tasks, *by, "cell")
    return placed.groupBy(*by, "cell", "score").agg(*[F.sum(n).alias(n) for n in counts]), tasks


def _area_sums(scored: DataFrame, by: tuple[str, ...], tasks: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Per group: pos, neg, ``more``, and ``won``, twice the pairs in which the positive row has the
    greater score, ties as one half. ``scored`` has a row for each (group, cell, score).

    Negatives below a score are those of the group's earlier cells and those before it in its own
    cell. So no more than a cell of a group is ever put in order by one task, and cells are few: no
    ranks over all scores are needed. All sums are exact integers.
    """
    within = Window.partitionBy(*by, "cell").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(within), F.lit(0))
    twice = (2 * below + F.col("neg")).cast("decimal(19,0)")
    names = ("pos", "neg", *more)
    cells = (
        scored.withColumn("twice", twice)
        .groupBy(*by, "cell")
        .agg(
            F.sum((F.col("pos").cast("decimal(19,0)") * F.col("twice")).cast(WIDE)).alias("won"),
            *[F.sum(n).alias(n) for n in names],
        )
    )
    if by:
        cells = cells.repartition(tasks, *by)
    earlier = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = (2 * F.coalesce(F.sum("neg").over(earlier), F.lit(0))).cast("decimal(19,0)")
    won = (F.col("won") + F.col("pos").cast("decimal(19,0)") * before).cast(WIDE)
    return (
        cells.withColumn("won", won)
        .groupBy(*by)
        .agg(F.sum("won").alias("won"), *[F.sum(n).alias(n) for n in names])
    )


def _area() -> Column:
    pos, neg = F.col("pos"), F.col("neg")
    return F.when((pos > 0) & (neg > 0), F.col("won").cast("double") / (2.0 * pos * neg)).alias("roc_auc")


def roc_auc(predictions: DataFrame, positive: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact, tie-aware area under the ROC curve of ``score``; NULL with one class.

    Equal scores are merged before anything is put in order.
    """
    merged, tasks = _merged(predictions, by, pos=positive, neg=~positive)
    return _area_sums(merged, by, tasks).select(*by, _area())


def binary_metrics(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """accuracy, weighted f1_score, rows and roc_auc of labels and predictions 0 and 1, per group.

    The predictions are read once: they shrink to a row for each (group, score) with its four counts,
    which yield class counts and the area together.
    """
    told, real = F.col("prediction") == 1.0, F.col("label") == 1.0
    merged, tasks = _merged(predictions, by, pos=real, neg=~real, tp=real & told, tn=~real & ~told)
    pos, neg, tp, tn = (F.col(c) for c in ("pos", "neg", "tp", "tn"))
    missed = pos - tp + neg - tn

    def f1(hits: Column) -> Column:
        return F.coalesce(F.try_divide(2.0 * hits, 2 * hits + missed), F.lit(0.0))

    rows = pos + neg
    return _area_sums(merged, by, tasks, ("tp", "tn")).select(
        *by,
        F.try_divide(tp + tn, rows).alias("accuracy"),
        F.try_divide(neg * f1(tn) + pos * f1(tp), rows).alias("f1_score"),
        rows.alias("rows"),
        _area(),
    )
