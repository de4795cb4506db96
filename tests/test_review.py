import io
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablereview.operators import planner, suggest
from tablereview.plans.review import Responses, run_review
from tablereview.sources.csv import read_csv

KINDS = {"int64": "bigint", "float64": "double", "object": "string", "bool": "boolean"}


def check_csv(spark, path, text):
    path.write_text(text)
    df = read_csv(spark, str(path))
    expected = pd.read_csv(io.StringIO(text))
    assert df.columns == list(expected.columns)
    mixed_flags = [c for c in expected if expected[c].dtype == object and expected[c].isin([True, False]).any()]
    assert [t for _, t in df.dtypes] == [
        "string" if c in mixed_flags else KINDS[str(expected[c].dtype)] for c in expected
    ]
    got = [tuple(r) for r in df.collect()]
    want = []
    for row in expected.itertuples(index=False):
        want.append(tuple(
            None if pd.isna(v) else str(v) if c in mixed_flags else v for c, v in zip(expected, row)
        ))
    assert got == want


@pytest.mark.parametrize(
    "text",
    [
        "a,b\n1,2\n3,4\n",
        "a,b\n1,x\n,y\n3,\n",
        "a,b,c\n1.5,1e3,.5\n-2,+4,5.\nNA,n/a,null\n",
        "a,b\ntrue,True\nFALSE,\nTrue,False\n",
        "a,b,c\n007,12d,t\n-1,3f,f\n",
        'a,b\n"x, y","say ""hi"""\n"NA"," "\n"","plain"\n',
        'a,b\n"line one\nline two",1\nz,2\n',
        "a,b\n#N/A,1.#IND\n<NA>,-nan\n",
        "a,b\n9223372036854775807,inf\n-9223372036854775808,-Infinity\n",
        "a,b\n2024-01-01,10:30\n2024-02-30,x\n",
        "a,b\n 1, 2.5\n2 ,x \n",
        "a,b\n1,2\n\n3,4\n",
        "a,b\n1.0,1\n2.0,2.5\n",
        "a\n99999999999999999999999\n1\n",
    ],
)
def test_csv_types_and_values(spark, tmp_path, text):
    check_csv(spark, tmp_path / "t.csv", text)


def test_csv_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="CSV file not found: .*nope.csv"):
        read_csv(spark, str(tmp_path / "nope.csv"))


def test_two_row_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("customer_id,age,income,city,churn\n1,24,52000,Tampa,No\n2,31,68000,Miami,No\n")
    df = read_csv(spark, str(tmp_path / "t.csv"))
    assert df.count() == 2
    assert df.columns == ["customer_id", "age", "income", "city", "churn"]


@pytest.fixture(scope="module")
def churn_csv(tmp_path_factory):
    rng = random.Random(4)
    lines = ["num_1,num_2,plan,target"]
    for _ in range(200):
        x, z = rng.gauss(5, 1), rng.random()
        y = "yes" if x + rng.gauss(0, 1) > 5.3 else "no"
        lines.append(f"{x:.4f},{'' if rng.random() < 0.1 else round(z, 4)},{rng.choice('abc')},{y}")
    path = tmp_path_factory.mktemp("review") / "churn.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_review_without_planner(spark, churn_csv):
    review = run_review(spark, churn_csv, "target")
    row = review.result().first()
    assert (row.row_count, row.column_count) == (200, 4)
    assert (row.features_created, row.accuracy_change, row.decision) == ([], 0.0, "reject")
    assert review.specs is None
    assert row.review_summary.startswith("Pipeline completed. Data quality: ")


def test_review_with_planner_and_responses(spark, churn_csv):
    finding = {"issue_type": "leak", "severity": "high", "evidence": "e", "recommendation": "r"}
    specs = [{"feature_name": "both", "transformation_type": "count_sum", "columns": ["num_1", "num_2"]},
             {"feature_name": "bad", "transformation_type": "log1p", "columns": ["target"]}]
    one = lambda text: spark.createDataFrame([(text,)], "response string")
    review = run_review(
        spark, churn_csv, "target", planner.plan_simple,
        responses=Responses(
            one(json.dumps({"findings": [finding], "summary": "s"})), one("not json"), one(json.dumps({"specs": specs}))
        ),
    )
    row = review.result().first()
    assert row.features_created == ["log_num_1", "log_num_2", "num_2_is_missing", "both"]
    # a supplied spec that reads the target is kept, and logged like any other
    assert row.features_skipped == ["bad: Source column 'target' is not numeric."]
    assert review.quality_findings.where(F.col("origin") == "supplied").count() == 1
    assert suggest.NOTE in review.explore_summary.first().summary
    text = review.summary()
    assert "Dataset: 200 rows × 4 columns" in text
    assert f"Critic decision: {row.decision.upper()}" in text
    assert "roc_auc=" in text
    assert json.loads(review.profile_json().first().json)["row_count"] == 200
    assert review.feature_report.first().engineered_column_count == 8


def test_review_of_a_table_with_three_classes(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet").drop("o_orderdate")
    review = run_review(spark, orders, "o_orderstatus", planner.plan_features, key="o_orderkey")
    row = review.result().first()
    assert row.roc_auc_change is None
    assert "roc_auc=n/a" in review.summary()


def test_review_of_an_unknown_target(spark, churn_csv):
    with pytest.raises(ValueError, match="Target column 'x' not found"):
        run_review(spark, churn_csv, "x")
    with pytest.raises(FileNotFoundError):
        run_review(spark, "/nowhere/x.csv", "x")


def test_custom_loader(spark, small):
    def load(session, path):
        return session.read.parquet(path).drop("text").withColumn("y", F.col("n_chars") > 500).select(
            "lang", "source", "n_chars", F.col("y").cast("int").alias("y")
        )

    review = run_review(spark, f"{small}/documents.parquet", "y", loader=load)
    assert review.table.first().column_count == 4
