import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tablereview.functions.expressions import fixed_text
from tablereview.functions.scratch import PIECES, spread
from tablereview.operators import profile as prof
from tablereview.operators.medians import Bracket, exact_medians, medians_of, summaries
from tablereview.operators.ranking import totals_before
from tablereview.plans import catalog
from tablereview.sources.csv import read_csv
from tablereview.sources.sinks import profile_document, write_profile_json, write_table


def by_name(df):
    return {r.column_name: r for r in df.collect()}


def test_customers(spark, customers_csv):
    df = read_csv(spark, customers_csv)
    table = prof.table_profile(df).first()
    assert (table.row_count, table.column_count, table.duplicate_row_count) == (5, 5, 0)
    rows = by_name(prof.column_profile(df))
    assert list(rows) == ["customer_id", "age", "income", "city", "churn"]
    assert [r.data_type for r in rows.values()] == ["int64", "float64", "int64", "str", "str"]
    assert [r.missing_count for r in rows.values()] == [0, 1, 0, 0, 0]
    assert [r.unique_count for r in rows.values()] == [5, 4, 5, 3, 2]
    assert (rows["age"]["mean"], rows["age"].median) == (32.25, 30.0)
    assert rows["age"]["std"] == pytest.approx(8.99536917900909)
    assert rows["income"]["std"] == pytest.approx(15076.471735787522)
    assert (rows["city"].mode_value, rows["city"].mode_count) == ("Tampa", 3)
    assert (rows["churn"].mode_value, rows["churn"].mode_count) == ("No", 3)
    target = prof.target_distribution(df, "churn").collect()
    assert [(r.target_value, r.n) for r in target] == [("No", 3), ("Yes", 2)]


def test_duplicates_treat_missing_as_equal(spark):
    rows = [(1, "a", None), (2, "b", None), (2, "b", None), (None, "2", "b"), (2, None, "b")]
    df = spark.createDataFrame(rows, "x int, y string, z string")
    assert prof.table_profile(df).first().duplicate_row_count == 1


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    row = prof.column_profile(df).first()
    assert (row.missing_count, row.unique_count, row["mean"], row["max"]) == (2, 2, 2.0, 3.0)


def test_types_and_statistics(spark):
    rows = [(10, 1.0, "x", True, 4.0), (20, 2.0, "y", False, None), (30, 8.0, "z", True, 8.0)]
    df = spark.createDataFrame(rows, "ints bigint, floats double, text string, bools boolean, gaps double")
    got = by_name(prof.column_profile(df))
    assert [got[c].data_type for c in df.columns] == ["int64", "float64", "str", "bool", "float64"]
    assert (got["ints"]["mean"], got["ints"].median, got["ints"]["std"]) == (20.0, 20.0, 10.0)
    assert got["gaps"]["mean"] == 6.0
    assert got["gaps"]["std"] == pytest.approx(2.8284271247461903)
    assert got["bools"]["mean"] is None
    assert (got["bools"].mode_value, got["bools"].mode_count) == ("True", 2)
    assert set(by_name(prof.numeric_stats(df))) == {"ints", "floats", "gaps"}


def test_modes(spark):
    rows = [("a", "x", 1, None), ("a", None, 2, None), ("b", "x", 3, None), ("b", "y", 4, None), ("a", "x", 5, None)]
    df = spark.createDataFrame(rows, "c string, g string, n int, e string")
    got = by_name(prof.modes(df))
    assert set(got) == {"c", "g", "e"}
    assert (got["c"].mode_value, got["c"].mode_count) == ("a", 3)
    assert (got["g"].mode_value, got["g"].mode_count) == ("x", 3)
    assert (got["e"].mode_value, got["e"].mode_count) == (None, 0)
    assert by_name(prof.distinct_counts(df))["e"].unique_count == 0


def test_mode_of_long_texts_is_whole(spark):
    long = "long text " * 50
    df = spark.createDataFrame([(long,), (long,), ("short",), (long + "x",)], "t string")
    row = prof.modes(df).first()
    assert (row.mode_value, row.mode_count) == (long, 2)
    assert prof.distinct_counts(df).first().unique_count == 3


def test_tied_mode_is_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "t string")
    assert prof.modes(df).first().mode_value == "a"


def test_empty_and_one_row_tables(spark):
    empty = spark.createDataFrame([], "x double, y string")
    assert prof.table_profile(empty).first().row_count == 0
    rows = by_name(prof.column_profile(empty))
    assert (rows["x"].unique_count, rows["x"]["mean"], rows["y"].mode_count) == (0, None, 0)
    one = spark.createDataFrame([(5.0, "q")], "x double, y string")
    rows = by_name(prof.column_profile(one))
    assert (rows["x"].median, rows["x"]["std"], rows["y"].mode_value) == (5.0, None, "q")


def test_nested_columns_only_count_missing(spark):
    rows = [([1, None], 1), ([None, 1], 1), (None, 1), ([1, None], 1)]
    df = spark.createDataFrame(rows, "a array<int>, b int")
    assert prof.table_profile(df).first().duplicate_row_count == 1
    row = by_name(prof.column_profile(df))["a"]
    assert (row.missing_count, row.unique_count, row.mode_value) == (1, None, None)


def test_target(spark):
    df = spark.createDataFrame([("Yes",), ("No",), (None,), ("Yes",)], "label string")
    got = {r.target_value: r.n for r in prof.target_distribution(df, "label").collect()}
    assert got == {"Yes": 2, "No": 1, "nan": 1}
    assert prof.target_distribution(df, "label", missing=False).count() == 2
    with pytest.raises(ValueError, match="Target column 'x' not found.*label"):
        prof.target_distribution(df, "x")


def test_column_names_with_dots(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a")], ["x.y", "a`b"])
    rows = by_name(prof.column_profile(df))
    assert (rows["x.y"].median, rows["a`b"].mode_count) == (1.5, 2)


@pytest.mark.parametrize("accuracy, limit", [(2000, 10**6), (20, 30), (8, 5)])
def test_medians_are_exact(spark, accuracy, limit):
    rng = random.Random(accuracy)
    rows = [
        (
            rng.gauss(0, 1) ** 3,
            float(rng.choice([0, 0, 0, 5, 9])),
            7.0,
            rng.random() if i % 3 else None,
            rng.lognormvariate(0, 6),
            float("-inf") if i % 5 == 0 else float(i),
        )
        for i in range(4001)
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    got = exact_medians(df, df.columns, accuracy, limit)
    for i, c in enumerate(df.columns):
        assert got[c] == statistics.median([r[i] for r in rows if r[i] is not None])


def test_narrowing_starts_from_any_bracket(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("x"))
    found = summaries(df, ["x"])["x"]
    wide = type(found)(**{**found.__dict__, "bracket": Bracket(10_000, 0.0, 9_999.0, 1e9)})
    assert medians_of(df, {"x": wide}, accuracy=50, max_values=40) == {"x": 4999.5}


def test_running_totals(spark):
    rng = random.Random(3)
    rows = [(i % 3, float(i), rng.randint(0, 9)) for i in rng.sample(range(5000), 5000)]
    df = spark.createDataFrame(rows, "g int, s double, n int")
    got = {(r.g, r.s): r.b for r in totals_before(df, ["g", "s"], "n", "b").collect()}
    total = 0
    for g, s, n in sorted(rows):
        assert got[(g, s)] == total
        total += n


def test_fixed_text_rounds_the_binary_value(spark):
    rng = random.Random(5)
    values = [0.125, 2.675, 0.375, 1.005, 0.0, 99.995, 100.0, 0.005, 0.015, 1e-9, 33.335, 12345.678]
    values += [rng.random() * 10 ** rng.randint(-4, 3) for _ in range(3000)]
    values += [i / 800 for i in range(800)]
    df = spark.createDataFrame([(v,) for v in values] + [(-v,) for v in values], "x double")
    x = F.col("x")
    for r in df.select("x", fixed_text(x, 2).alias("a"), fixed_text(x, 4, True).alias("b")).collect():
        if r.x == 0:
            continue
        assert (r.a, r.b) == (f"{r.x:.2f}", f"{r.x:+.4f}")


def test_profile_json(spark, customers_csv, tmp_path):
    df = read_csv(spark, customers_csv)
    document = profile_document(
        prof.table_profile(df),
        prof.column_profile(df),
        "churn",
        prof.target_distribution(df, "churn"),
    )
    path = write_profile_json(document, str(tmp_path / "deep" / "er" / "profile"))
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    got = json.loads(text)
    assert got["missing_values_by_column"] == {"customer_id": 0, "age": 1, "income": 0, "city": 0, "churn": 0}
    assert list(got["unique_values_by_column"]) == df.columns
    assert got["numeric_statistics"]["income"]["median"] == 68000.0
    assert got["categorical_statistics"]["city"] == {"most_frequent_value": "Tampa", "most_frequent_count": 3}
    assert got["target_distribution"] == {"No": 3, "Yes": 2}
    assert got["summary"] == ""
    bare = json.loads(profile_document(prof.table_profile(df), prof.column_profile(df)).first()[0])
    assert bare["target_column"] is None and bare["target_distribution"] is None


def test_write_table(spark, tmp_path):
    df = spark.range(5)
    assert spark.read.parquet(write_table(df, str(tmp_path / "a" / "t"))).count() == 5


def test_a_bracket_that_misses_the_middle_is_widened(spark):
    df = spark.range(10_001).select(F.col("id").cast("double").alias("x"), (-F.col("id")).cast("double").alias("y"))
    found = summaries(df, ["x", "y"])
    missed = type(found["x"])(**{**found["x"].__dict__, "bracket": Bracket(10_001, 10.0, 20.0, 10.0)})
    for limit in (40, 4_000_000):
        got = medians_of(df, {"x": missed, "y": found["y"]}, accuracy=50, max_values=limit)
        assert got == {"x": 5000.0, "y": -5000.0}


def test_spread_is_asked_for(spark, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    assert spread(lines) is lines
    spark.conf.set(PIECES, "4")
    try:
        wide = spread(lines)
        assert len(wide.inputFiles()) == 4 and wide.count() == lines.count()
        assert spread(wide) is wide
    finally:
        spark.conf.unset(PIECES)


def test_only_files_with_quoted_breaks_are_read_whole(spark, tmp_path):
    folder = tmp_path / "some files"
    folder.mkdir()
    (folder / "a b.csv").write_text('i,t\n1,plain\n2,"q ""x"" y"\n')
    (folder / "b%20.csv").write_text('i,t\n3,"two\nlines"\n4,z\n')
    (folder / "c.csv").write_text("i,t\n")
    got = sorted(map(tuple, read_csv(spark, str(folder)).collect()))
    assert got == [(1, "plain"), (2, 'q "x" y'), (3, "two\nlines"), (4, "z")]
    assert got == sorted(map(tuple, read_csv(spark, str(folder), multi_line=True).collect()))


def test_csv_files_of_whole_texts_grow_in_number_with_the_documents(spark, tmp_path, monkeypatch):
    """300 texts, two in three with line breaks, one missing: no file holds more than 20 records."""
    texts = [None] + [f'text "{i}"' + "\nmore," * (i % 3) for i in range(299)]
    rows = [(i, text, "en", "web", len(text or "")) for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.repartition(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(catalog, "CSV_RECORDS", 20)
    monkeypatch.setattr(catalog, "scratch_path", lambda *_: str(tmp_path / "csv"))
    back = catalog.QUERIES["source_csv_text"](spark, str(tmp_path))
    expected = df.withColumn("text", F.md5("text"))
    assert sorted(map(str, back.collect())) == sorted(map(str, expected.collect()))
    written = read_csv(spark, str(tmp_path / "csv")).groupBy(F.input_file_name().alias("file")).count().collect()
    assert len(written) == 16 and max(r["count"] for r in written) == 20
