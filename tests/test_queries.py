"""Every registered query against its SQL on the small tables."""

import os

import pytest
from checks import both, duck

import __spark_entry__ as entry_module
from tablereview.operators import levels, model

QUERIES = entry_module.queries()
SQL = entry_module.oracle_sql()
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    columns, names, got, expected = both(spark, con, QUERIES[name], SQL[name], FOLDER)
    assert columns == names
    assert len(got) == len(expected)
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert {r.column_name for r in df.collect()} == set(
        spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").columns
    )


@pytest.mark.parametrize(
    ("name", "column", "grades"),
    [
        ("dq_high_cardinality", "severity", {"medium", "high"}),
        ("dq_duplicate_rows", "severity", {"low", "medium", "high"}),
        ("eda_target_imbalance", "importance", {"low", "medium", "high"}),
        ("eda_dominant_category", "importance", {"low", "medium", "high"}),
        ("findings_merge", "severity", {"low", "medium", "high"}),
    ],
)
def test_rule_tables_show_every_grade(spark, name, column, grades):
    assert {r[0] for r in QUERIES[name](spark, FOLDER).select(column).collect()} == grades


@pytest.mark.parametrize("name", ["compare_separable", "model_gradient", "model_report_separable", "model_test_rows"])
def test_levels_as_a_table_match_sql(spark, con, monkeypatch, name):
    monkeypatch.setattr(levels, "DRIVER_COEFFICIENTS", 10)
    fits = []
    fit = model.fit_levels
    monkeypatch.setattr(model, "fit_levels", lambda *args: fits.append(1) or fit(*args))
    test_query_matches_sql(spark, con, name)
    assert fits
