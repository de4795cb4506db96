"""All figures of a column from one read, against plain Python."""

import math
import random
import statistics
from collections import Counter
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablereview.operators import figures as fig
from tablereview.operators import profile as prof

SCHEMA = (
    "whole bigint, small tinyint, fraction double, single float, money decimal(12,2), flag boolean, "
    "word string, day date, list array<int>, huge bigint, none double, wide double"
)


def mixed(rng, n):
    rows = []
    for i in range(n):
        row = (
            rng.randint(-50, 50),
            rng.choice([None, -1, 0, 1]),
            rng.choice([float("nan"), -0.0, 0.0, rng.gauss(0, 1) ** 3, rng.gauss(0, 1e-9), 7.5]),
            rng.choice([0.5, 0.25, None, 3.0]),
            Decimal(rng.randint(-999, 999)) / 100,
            rng.choice([True, True, False, None]),
            rng.choice(["a", "é", "b" * 100, "b" * 99, "", None]),
            date(2020, 1, rng.randint(1, 28)),
            rng.choice([None, [1], [2, None]]),
            2**60 + rng.randint(0, 3),
            None,
            rng.lognormvariate(0, 30) * rng.choice([-1, 1]),
        )
        rows.append(row)
    return rows


def expected(values, numeric):
    held = [v for v in values if v is not None and v == v]
    counts = Counter(held)
    numbers = [float(v) for v in held] if numeric else []
    return len(values), len(values) - len(held), len(counts), numbers


@pytest.mark.parametrize("n", [1, 2, 37, 5000])
def test_figures_match_plain_python(spark, n):
    rows = mixed(random.Random(n), n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = fig.column_figures(df)
    medians = fig.figure_medians(df, got)
    for i, f in enumerate(df.schema.fields):
        values = [r[i] for r in rows]
        if f.name == "list":
            assert (got["list"].rows, got["list"].missing) == (n, values.count(None))
            continue
        if f.name == "single":
            values = [v for v in values]
        numeric = f.name not in ("word", "day")
        total, missing, distinct, numbers = expected(values, numeric)
        x = got[f.name]
        assert (x.rows, x.missing, x.distinct) == (total, missing, distinct), f.name
        if not numbers:
            assert x.summary is None and medians[f.name] is None
            continue
        s = x.summary
        assert (s.rows, s.low, s.high) == (len(numbers), min(numbers), max(numbers))
        assert math.isclose(s.mean, math.fsum(numbers) / len(numbers), rel_tol=1e-9, abs_tol=1e-9 * max(map(abs, numbers)))
        assert medians[f.name] == statistics.median(numbers), f.name
        if len(numbers) > 1:
            spread = statistics.stdev(numbers)
            assert math.isclose(s.deviation, spread, rel_tol=1e-6, abs_tol=1e-9 * max(map(abs, numbers)))
        else:
            assert s.deviation is None
    text, count = got["word"].mode_key, got["word"].mode_count
    counts = Counter(r[6] for r in rows if r[6] is not None)
    assert count == max(counts.values(), default=0) and (text is None) == (not counts)


def test_cells_rise_with_numbers(spark):
    rng = random.Random(8)
    values = [rng.lognormvariate(0, 100) * rng.choice([-1, 1]) for _ in range(3000)]
    values += [2.0**k for k in range(-1074, 1024, 3)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1024, 7)]
    values += [0.0, float("inf"), float("-inf"), 5e-324, -5e-324, 1.7976931348623157e308]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", fig.cell_of(F.col("v")).alias("cell"))
    cells = [r.cell for r in sorted(df.collect(), key=lambda r: r.v)]
    assert cells == sorted(cells) and len(set(cells)) > 1000


def counted_reads(spark, df, schema):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return df.mapInArrow(seen, schema), read


def test_a_profile_reads_the_table_twice_at_most(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("x"), F.concat(F.lit("t"), F.col("id") % 9).alias("t"))
    table, read = counted_reads(spark, df, df.schema)
    rows = prof.column_profile(table).collect()
    assert [r.unique_count for r in rows] == [3000, 7, 9] and rows[0].median == 1499.5
    assert read.value <= 6000
    table, read = counted_reads(spark, df.select("x", "t"), "x double, t string")
    prof.column_profile(table).collect()  # the middle cell of x holds one value
    assert read.value == 3000


def test_more_columns_than_a_batch(spark):
    df = spark.range(50).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(150)])
    got = prof.column_profile(df).collect()
    assert [r.unique_count for r in got] == [min(50, i + 1) for i in range(150)]


def test_infinite_and_equal_numbers(spark):
    df = spark.createDataFrame([(float("inf"), 3.0), (1.0, 3.0), (2.0, 3.0)], "a double, b double")
    got = fig.column_figures(df)
    assert fig.figure_medians(df, got) == {"a": 2.0, "b": 3.0}
    assert got["a"].summary.high == got["a"].summary.mean == float("inf") and got["b"].summary.deviation == 0.0


def test_means_come_out_as_from_exact_sums(spark):
    rng = random.Random(2)
    values = [rng.choice([0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08]) for _ in range(60_000)]
    values = [v for v in values if rng.random() < 0.9]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(7)
    assert fig.column_figures(df)["x"].summary.mean == math.fsum(values) / len(values)
