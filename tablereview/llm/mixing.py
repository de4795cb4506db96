"""Mixing sources to target weights by Poisson replication, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablereview.functions.expressions import col
from tablereview.functions.scratch import store
from tablereview.llm.native import as_row, from_row

SEED = 17
#: Sources weigh in by their size to this power unless weights are given.
FLATTEN = 0.5


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of seed and key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_steps(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... as far as a double tells it from 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(
        (-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("steps")
    )

    def step(state: Column, k: Column) -> Column:
        log = state["log"] + F.log(rate / k)
        total = state["sum"] + F.exp(log)
        return F.struct(
            log.alias("log"), total.alias("sum"), F.concat(state["steps"], F.array(total)).alias("steps")
        )

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["steps"])


def source_rates(
    docs: DataFrame,
    source_column: str = "source",
    weights: dict[str, float] | None = None,
    flatten: float = FLATTEN,
    total: float | None = None,
) -> DataFrame:
    """Stored table (source, docs, rate, steps): mean number of copies that gives each source its share.

    Shares follow ``weights`` (a source that is not named gets 0) or, without them, the number of
    documents to the power ``flatten``. Copies are ``total`` in the mean, by default one a document.
    Documents without a source make a source of their own, of weight ``weights[None]``.
    """
    counts = store(
        docs.groupBy(col(source_column).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("docs")), "sources"
    )
    if weights is None:
        weight = F.pow(F.col("docs").cast("double"), F.lit(flatten))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    sums = counts.agg(F.sum("weight").alias("weight"), F.sum("docs").alias("docs")).first()
    copies = float(total if total is not None else sums.docs or 0)
    if not sums.weight:
        return store(counts.limit(0).withColumn("rate", F.lit(0.0)).withColumn("steps", F.array(F.lit(0.0))), "rates")
    rates = counts.filter("weight > 0").withColumn(
        "rate", F.lit(copies) * (F.col("weight") / F.lit(float(sums.weight))) / F.col("docs")
    )
    return store(rates.withColumn("steps", poisson_steps(F.col("rate"))), "rates")


def mix_sources(
    docs: DataFrame,
    id_column: str = "doc_id",
    source_column: str = "source",
    weights: dict[str, float] | None = None,
    flatten: float = FLATTEN,
    total: float | None = None,
    seed: int = SEED,
    text_column: str = "text",
    copy_column: str | None = None,
) -> DataFrame:
    """Each document as often as a Poisson variable of its source's rate says, in a random order.

    The variable is inverted at a number hashed from the seed and the id, so a rerun gives the same
    rows. Rows are dealt to partitions and sorted there by a hash of id and copy, a global shuffle.
    All columns come back; ``copy_column`` adds the number of the copy, from 1.

    A null id takes the MD5 of the text for its id. Rows repeated under one id get equal counts.
    Sources of weight 0, and all rows of an empty table, give no rows. Rates are joined by source;
    a source with most of the rows is split by adaptive execution where the rates are too many
    to be broadcast.
    """
    key = F.coalesce(col(id_column).cast("string"), F.md5(F.coalesce(col(text_column).cast("string"), F.lit(""))))
    rates = source_rates(docs, source_column, weights, flatten, total)
    rates = rates.select(F.col("source").alias("of"), "steps")
    rows = docs.select(
        as_row(docs).alias("row"),
        col(source_column).cast("string").alias("source"),
        key.alias("key"),
        uniform(seed, key).alias("u"),
    )
    copies = F.size(F.filter("steps", lambda step: step <= F.col("u")))
    dealt = (
        rows.join(rates, F.col("source").eqNullSafe(F.col("of")))
        .select("row", "key", copies.alias("copies"))
        .filter("copies > 0")
        .select("row", "key", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .withColumn("place", F.xxhash64(F.lit(seed), "key", "copy"))
        .repartition("place")
        .sortWithinPartitions("place", "key", "copy")
    )
    added = [F.col("copy").cast("long").alias(copy_column)] if copy_column else []
    return dealt.select(*from_row(docs), *added)
