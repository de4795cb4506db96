import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tablereview.operators import transforms as tr
from tablereview.operators.planner import plan_features
from tablereview.operators.profile import column_facts, table_profile


def spec(name, kind, *columns, **parameters):
    return tr.Spec(name, kind, columns, parameters)


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (25.0, 50000, 85.0, "a"), (30.0, 60000, 90.0, "b"), (35.0, 75000, 78.0, "a"), (40.0, 80000, 92.0, "c"),
        (None, 55000, 88.0, "b"), (50.0, 90000, 95.0, "c"),
    ]
    return spark.createDataFrame(rows, "age double, income bigint, score double, category string").coalesce(1)


def run(df, *specs, **options):
    out, log = tr.apply_features(df, list(specs), **options)
    return [r.asDict() for r in out.collect()], log.orderBy("ordinal").collect()


def test_core(people):
    rows, log = run(
        people,
        spec("log1p_age", "log1p", "age"),
        spec("age_missing", "missing_indicator", "age"),
        spec("r", "ratio", "income", "score"),
        spec("s", "count_sum", "age", "score"),
    )
    assert [r.status for r in log] == ["applied"] * 4
    assert rows[0]["log1p_age"] == pytest.approx(math.log1p(25))
    assert rows[4]["log1p_age"] is None
    assert [r["age_missing"] for r in rows] == [0, 0, 0, 0, 1, 0]
    assert rows[0]["r"] == pytest.approx(50000 / 85)
    assert (rows[0]["s"], rows[4]["s"]) == (110.0, 88.0)
    assert people.columns == ["age", "income", "score", "category"]


def test_skip_reasons(spark, people):
    negative = people.withColumn("value", F.col("income") - 60000)
    _, log = run(
        negative,
        spec("a", "log1p", "value"), spec("b", "log1p", "category"), spec("c", "log1p", "nope"),
        spec("d", "log1p", "age", "score"), spec("e", "ratio", "age"), spec("f", "ratio", "age", "category"),
        spec("g", "ratio", "nope", "age"), spec("h", "count_sum", "age"), spec("i", "missing_indicator", "nope"),
        spec("j", "drop_table", "age"), spec("k", "count_sum", "age", "category"), spec("l", "difference", "age", "score"),
        spec("category", "missing_indicator", "age"),
        target="category",
    )
    assert [r.reason for r in log] == [
        "Source column 'value' contains negative values; log1p requires non-negative data.",
        "Source column 'category' is not numeric.",
        "Source column 'nope' does not exist.",
        "log1p requires exactly one source column.",
        "ratio requires exactly two source columns (numerator, denominator).",
        "denominator column 'category' is not numeric.",
        "numerator column 'nope' does not exist.",
        "count_sum requires at least two source columns.",
        "Source column 'nope' does not exist.",
        "Unsupported transformation type: drop_table",
        "Source column 'category' is not numeric.",
        "Unsupported transformation type: difference",
        "Feature name 'category' is the target column.",
    ]


def test_zero_denominator(spark):
    df = spark.createDataFrame([(10, 2), (20, 0), (30, 5)], "num bigint, den bigint").coalesce(1)
    rows, _ = run(df, spec("r", "ratio", "num", "den"))
    assert [r["r"] for r in rows] == [5.0, None, 6.0]


def test_chain_and_overwrite(spark):
    df = spark.createDataFrame([(-4.0, 2.0), (5.0, 0.0)], "a double, b double").coalesce(1)
    rows, log = run(
        df,
        spec("s", "count_sum", "a", "b"),  # -2, 5
        spec("l", "log1p", "s"),  # skipped: negative
        spec("s", "ratio", "b", "a"),  # overwrites: -0.5, 0
        spec("m", "missing_indicator", "s"),
        spec("b", "count_sum", "b", "b"),  # 4, 0
        spec("l2", "log1p", "b"),
        spec("a", "missing_indicator", "a"),  # now 0, 0
        spec("l3", "log1p", "a"),
    )
    assert [r.status for r in log] == ["applied", "skipped"] + ["applied"] * 6
    assert [r["s"] for r in rows] == [-0.5, 0.0]
    assert [r["l2"] for r in rows] == [pytest.approx(math.log(5)), 0.0]
    assert [(r["a"], r["l3"], r["m"]) for r in rows] == [(0, 0.0, 0), (0, 0.0, 0)]
    assert list(rows[0]) == ["a", "b", "s", "m", "l2", "l3"]


def test_booleans_and_empty_numbers(spark):
    df = spark.createDataFrame([(True, False, None), (False, True, None)], "p boolean, q boolean, e double").coalesce(1)
    rows, log = run(
        df, spec("l", "log1p", "p"), spec("r", "ratio", "p", "q"), spec("s", "count_sum", "p", "q"),
        spec("le", "log1p", "e"), spec("se", "count_sum", "e", "e"),
    )
    assert all(r.status == "applied" for r in log)
    assert [(r["r"], r["s"], r["le"], r["se"]) for r in rows] == [(None, 1, None, 0.0), (0.0, 1, None, 0.0)]


def test_report_adds_up(spark, people):
    specs = plan_features(column_facts(people, medians=False), "score")
    plan = tr.plan_transforms(people, specs, target="score")
    log = tr.feature_log(people, plan)
    report = tr.feature_report(log, table_profile(people), plan).first()
    assert len(report.features_created) + len(report.features_skipped) == specs.count() == log.count()
    assert report.features_created == ["log1p_age", "log1p_income", "ratio_age_to_income", "age_is_missing"]
    assert all(": Unsupported" in s for s in report.features_skipped)
    assert (report.original_column_count, report.engineered_column_count) == (4, 8)
    assert report.summary == "Applied 4 feature(s) and skipped 2 feature(s)."
    assert log.where("status = 'skipped' and reason is null").count() == 0


def test_extended(spark):
    rows = [
        (4.0, "lo", "x", dt.date(2024, 2, 29), True, None), (-1.0, "hi", "y", None, False, True),
        (None, None, "x", dt.date(2023, 12, 31), True, True), (0.0, "hi", "zz", dt.date(2024, 1, 1), None, False),
    ]
    df = spark.createDataFrame(rows, "n double, two string, many string, d date, p boolean, q boolean").coalesce(1)
    out, log = run(
        df,
        spec("log", "log", "n"), spec("sqrt", "sqrt", "n"), spec("b", "binary_to_int", "two"),
        spec("b3", "binary_to_int", "many"), spec("m", "map_values", "two", hi="H"),
        spec("t", "reduce_categories", "many", top_k=1), spec("o", "ordinal_encode", "many"),
        spec("o2", "ordinal_encode", "many", order='["zz", "x"]'), spec("len", "string_length", "many"),
        spec("wd", "datetime_extract", "d", part="isodow"), spec("bad", "datetime_extract", "d", part="eon"),
        spec("and", "bool_and", "p", "q"), spec("or", "bool_or", "p", "q"), spec("nz", "count_nonzero", "n", "p"),
        spec("sq", "sum_squares", "n", "n"), spec("df", "difference", "n", "o"), spec("pr", "product", "n", "o"),
        spec("ix", "interaction", "n", "n"), spec("lo", "log1p", "o"), spec("o", "ordinal_encode", "two"),
        transforms="extended",
    )
    assert {r.feature_name: r.reason for r in log if r.status == "skipped"} == {
        "sqrt": "Source column 'n' contains negative values; sqrt requires non-negative data.",
        "b3": "Source column 'many' does not have exactly two values.",
        "bad": "Unknown date part 'eon'.",
    }
    got = {k: [r[k] for r in sorted(out, key=lambda r: (r["many"], r["n"] is None))] for k in out[0]}
    assert got["many"] == ["x", "x", "y", "zz"]
    assert got["log"] == [pytest.approx(math.log(4)), None, None, None]
    assert got["b"] == [1, None, 0, 0]
    assert got["m"] == [None, None, "H", "H"]
    assert got["t"] == ["x", "x", "Other", "Other"]
    assert got["o2"] == [1, 1, None, 0]
    assert got["len"] == [1, 1, 1, 2]
    assert got["wd"] == [4, 7, None, 1]
    assert got["and"] == [None, True, False, False]
    assert got["or"] == [True, True, True, None]
    assert got["nz"] == [2, 1, 1, 0]
    assert got["sq"] == [32.0, 0.0, 2.0, 0.0]
    assert got["df"] == [4.0, None, -2.0, -2.0]
    assert got["pr"] == [0.0, None, -1.0, 0.0]
    assert got["lo"] == [0.0, 0.0, pytest.approx(math.log(2)), pytest.approx(math.log(3))]
    assert got["o"] == [1, None, 0, 0]  # overwritten by the last spec


def test_plan_applies_to_a_stream(spark, small, tmp_path):
    """A plan made on a batch is plain expressions, so it fits a stream as it is."""
    batch = spark.read.parquet(f"{small}/events.parquet")
    plan = tr.plan_transforms(batch, [spec("l", "log1p", "value"), spec("r", "ratio", "value", "user_id")])
    (tmp_path / "in").mkdir()
    batch.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = plan.apply(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    query = (
        stream.writeStream.format("memory").queryName("made")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    expected = plan.apply(batch)
    assert spark.table("made").exceptAll(expected).count() == 0
    assert spark.table("made").count() == expected.count()
