import json

import pytest
from pyspark.sql import functions as F

from tablereview.functions.expressions import rows_as_table
from tablereview.operators import explore, planner, quality, suggest, transforms
from tablereview.operators.profile import column_facts

COLUMNS = (
    "position int, column_name string, row_count bigint, missing_count bigint, unique_count bigint, "
    "mode_value string, mode_count bigint"
)


def columns(spark, rows=100, **one):
    made = [
        (i, c, rows, v.get("m", 0), v.get("u", 50), v.get("v"), v.get("k"))
        for i, (c, v) in enumerate(one.items())
    ]
    return rows_as_table(spark, COLUMNS, made)


def table(spark, rows, duplicates):
    return rows_as_table(
        spark, "row_count bigint, column_count bigint, duplicate_row_count bigint", [(rows, 2, duplicates)]
    )


def severities(df):
    return {r["column"]: r.severity for r in df.collect()}


def test_missing_severity(spark):
    got = severities(
        quality.missing_values(
            columns(spark, **{n: {"m": m} for n, m in dict(z=0, a=2, b=5, c=6, d=20, e=21, f=50).items()})
        )
    )
    assert got == dict(a="low", b="low", c="medium", d="medium", e="high", f="high")


@pytest.mark.parametrize("n, severity", [(1, "low"), (2, "low"), (3, "medium"), (10, "medium"), (11, "high"), (30, "high")])
def test_duplicate_severity(spark, n, severity):
    row = quality.duplicate_rows(table(spark, 100, n)).first()
    assert (row.severity, row["column"]) == (severity, None)
    assert row.evidence == f"The dataset contains {n} duplicate row(s), which is {n}.00% of the 100 rows."


def test_cardinality(spark):
    got = severities(
        quality.high_cardinality(columns(spark, a={"u": 96}, b={"u": 100}, c={"u": 50}, d={"u": 0}, e={"u": 99}))
    )
    assert got == dict(a="medium", b="high", e="high")
    assert quality.high_cardinality(columns(spark, 0, a={"u": 0})).count() == 0


def test_constant(spark):
    got = severities(quality.constant_column(columns(spark, a={"u": 1}, b={"u": 3}, c={"u": 0})))
    assert got == dict(a="medium")


def test_report_order_and_summary(spark):
    cols = columns(spark, x={"m": 1, "u": 100}, y={"m": 30, "u": 1})
    found = quality.quality_findings(table(spark, 100, 5), cols)
    got = [(r.ordinal, r.issue_type, r["column"]) for r in found.orderBy("ordinal").collect()]
    assert got == [
        (1, "missing_values", "x"), (2, "missing_values", "y"), (3, "duplicate_rows", None),
        (4, "high_cardinality", "x"), (5, "constant_column", "y"),
    ]
    assert quality.report_summary(found).first().summary == "5 data-quality issue(s) detected."
    none = quality.quality_findings(table(spark, 100, 0), columns(spark, x={}))
    assert quality.report_summary(none).first().summary == "No data-quality issues detected."


@pytest.mark.parametrize(
    "counts, importance",
    [
        ((50, 50), None), ((59, 41), None), ((70, 30), "low"), ((75, 25), "medium"), ((85, 15), "medium"),
        ((95, 5), "high"), ((100,), None),
    ],
)
def test_imbalance(spark, counts, importance):
    spread = rows_as_table(spark, "target_value string, n bigint", [(str(i), n) for i, n in enumerate(counts)])
    rows = explore.target_imbalance(spread, "y").collect()
    assert [r.importance for r in rows] == ([importance] if importance else [])
    if rows:
        assert rows[0].columns == ["y"]
        assert f"represents {counts[0]} out of 100" in rows[0].evidence


def test_dominant(spark):
    ks = dict(a=70, b=85, c=90, d=92, e=98, f=0)
    got = explore.dominant_category(columns(spark, **{c: {"v": "q", "k": k} for c, k in ks.items()}))
    assert {r.columns[0]: r.importance for r in got.collect()} == dict(b="low", c="medium", d="medium", e="high")


def test_explore_without_target(spark):
    found = explore.explore_findings(columns(spark, a={"v": "q", "k": 10}))
    summary = quality.report_summary(found, explore.NOUN, explore.NONE_FOUND).first().summary
    assert summary == "No EDA findings detected."


def test_planner(spark):
    rows = [(1.0, -1.0, 1.0, 2.0, 0), (2.0, 2.0, None, 3.0, 1), (3.0, 3.0, 3.0, 4.0, 0), (4.0, 4.0, 4.0, 5.0, 1)]
    df = spark.createDataFrame(
        rows, "positive_col double, negative_col double, col_with_na double, col_without_na double, target bigint"
    )
    facts = column_facts(df, medians=False)
    specs = planner.plan_features(facts, "target").orderBy("ordinal").collect()
    logs = [s.feature_name for s in specs if s.transformation_type == "log1p"]
    assert logs == ["log1p_positive_col", "log1p_col_with_na", "log1p_col_without_na"]
    assert [s.feature_name for s in specs if s.transformation_type == "missing_indicator"] == ["col_with_na_is_missing"]
    pairs = [s.feature_name for s in specs if s.transformation_type == "ratio"]
    assert pairs == [
        "ratio_positive_col_to_col_with_na", "ratio_positive_col_to_col_without_na",
        "ratio_col_with_na_to_col_without_na",
    ]
    assert [s.transformation_type for s in specs[3:6]] == ["ratio", "difference", "product"]
    simple = planner.plan_simple(facts, "target").orderBy("ordinal").collect()
    assert [s.feature_name for s in simple] == [
        "log_positive_col", "log_col_with_na", "col_with_na_is_missing", "log_col_without_na",
    ]


def test_planner_leaves_out_identifiers_and_keeps_empty_numbers(spark):
    df = spark.createDataFrame(
        [(1, 1, 5.0, None, True), (2, 2, 6.0, None, False)],
        "id int, customerID int, v double, e double, b boolean",
    )
    pairs = planner.plan_pairs(column_facts(df, medians=False), "none")
    names = {tuple(r.columns) for r in pairs.collect()}
    assert names == {("customerID", "v"), ("customerID", "e"), ("customerID", "b"), ("v", "e"), ("v", "b"), ("e", "b")}


def responses(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, response string")


GOOD = {"issue_type": "skew", "severity": "low", "column": None, "evidence": "e", "recommendation": "r"}


def test_merge_findings(spark):
    found = quality.quality_findings(table(spark, 100, 0), columns(spark, x={"m": 1}))
    valid = responses(spark, json.dumps({"findings": [GOOD, {**GOOD, "extra": 1}], "summary": "s"})).drop("k")
    merged, summary = suggest.merge_findings(found, valid, "quality")
    rows = merged.orderBy("ordinal").collect()
    assert [(r.ordinal, r.origin, r.issue_type) for r in rows] == [
        (1, "deterministic", "missing_values"), (2, "supplied", "skew"), (3, "supplied", "skew"),
    ]
    assert summary.first().summary == "3 data-quality issue(s) detected."
    for bad in ("this is not json", '{"invalid": "structure"}', None):
        merged, summary = suggest.merge_findings(found, responses(spark, bad).drop("k"), "quality")
        assert merged.count() == 1
        assert summary.first().summary == f"1 data-quality issue(s) detected. {suggest.NOTE}"
    none = quality.quality_findings(table(spark, 100, 0), columns(spark, x={}))
    _, summary = suggest.merge_findings(none, responses(spark, "no").drop("k"), "quality")
    assert summary.first().summary == suggest.NOTE


def test_findings_are_judged_whole(spark):
    texts = [
        json.dumps({"findings": [GOOD], "summary": "s"}),
        json.dumps({"findings": [GOOD, {**GOOD, "severity": 5}], "summary": "s"}),
        json.dumps({"findings": [{k: v for k, v in GOOD.items() if k != "evidence"}], "summary": "s"}),
        json.dumps({"findings": [GOOD]}),
        json.dumps({"findings": [], "summary": "s"}),
        json.dumps({"findings": [None], "summary": "s"}),
        json.dumps({"findings": {"a": 1}, "summary": "s"}),
        json.dumps({"findings": [], "summary": "s"}) + " more",
        "{'findings': [], 'summary': 's'}",
        json.dumps({"findings": [{k: v for k, v in GOOD.items() if k != "column"}], "summary": "s"}),
        json.dumps({"findings": [{**GOOD, "column": 3}], "summary": "s"}),
    ]
    got = suggest.validity(responses(spark, *texts), "quality").orderBy("k").collect()
    assert [r.valid for r in got] == [True, False, False, False, True, False, False, False, False, True, False]


def test_explore_findings_from_outside(spark):
    item = {"finding_type": "t", "importance": "low", "columns": ["a", "b"], "evidence": "e", "interpretation": "i"}
    texts = [
        json.dumps({"findings": [item, {**item, "modeling_implication": "m"}], "summary": "s"}),
        json.dumps({"findings": [{**item, "columns": ["a", 1]}], "summary": "s"}),
        json.dumps({"findings": [{**item, "columns": "a"}], "summary": "s"}),
        json.dumps({"findings": [{**item, "columns": []}], "summary": "s"}),
    ]
    got = suggest.parse_findings(responses(spark, *texts), "explore", keys=("k",)).orderBy("k", "ordinal").collect()
    assert [(r.k, r.columns, r.modeling_implication) for r in got] == [
        (0, ["a", "b"], None), (0, ["a", "b"], "m"), (3, [], None),
    ]


def python_extract(text):
    """The rule in plain Python: JSON inside the outer fences, or the whole text."""
    text = text.strip()
    first, last = text.find("```"), text.rfind("```")
    if first != -1 and last > first:
        text = text[first + 3 : last].strip()
        head, newline, rest = text.partition("\n")
        if newline and head.strip().lower() in ("json", "javascript", "js"):
            text = rest.strip()
    try:
        json.loads(text)
    except json.JSONDecodeError:
        return None
    return text


def test_extract_json(spark):
    texts = [
        '{"a": 1}', ' \n\t{"a": [1, {"b": null}]}  ', '```json\n{"a": 1}\n```', 'x ```\n[1, 2]\n``` y',
        '```JSON \n{"a": 1}```', '```json {"a": 1}```', '```python\n{}\n```', "```", "``````", "````", "",
        '{"a": 1} x', "{'a': 1}", "1 2", "1],[2", "1]", "1}", '1,"w":2', '1, 2', "null", '"s"', "[", "]",
        '```js\n{"a": "```"}\n```', 'a ``` {"b": 2} ``` c ``` d', "nan", "\x1c{}\x1d", " [1] ",
        '{"a":1}\n```', "true", "tru", "-", "01", '{"a": 1,}', "[1,]",
    ]
    got = suggest.extract_json(responses(spark, *texts)).orderBy("k").collect()
    assert [r.json_text for r in got] == [python_extract(t) for t in texts]


def test_specs_from_outside(spark):
    def spec(**change):
        return {"feature_name": "f", "transformation_type": "log1p", "columns": ["a"], **change}

    texts = [
        json.dumps({"specs": [spec(), spec(transformation_type="evil"), spec(columns=[]), spec(columns=["zz"]),
                              spec(columns=["y"]), spec(feature_name="g", parameters={"top_k": 3})]}),
        json.dumps({"specs": [spec(columns=[1])]}),
        json.dumps({"specs": [spec(parameters=[1])]}),
        json.dumps({"summary": "s"}),
        "nothing",
    ]
    rows = responses(spark, *texts)
    got = suggest.parse_specs(rows, ["a", "y"], keys=("k",)).orderBy("k", "ordinal").collect()
    assert [(r.k, r.ordinal, r.feature_name, r.parameters) for r in got] == [
        (0, 1, "f", None), (0, 5, "f", None), (0, 6, "g", {"top_k": "3"}),
    ]
    assert suggest.parse_specs(rows, ["a"], keys=("k",)).count() == 2
    facts = column_facts(spark.createDataFrame([(1.0, 0)], "a double, y int"), medians=False)
    planned = planner.plan_features(facts, "y")
    both = planner.append_specs(planned, suggest.parse_specs(rows, ["a", "y"]))
    assert [r.ordinal for r in both.orderBy("ordinal").collect()] == [1, 2, 6, 7]
    assert both.where(F.col("feature_name") == "g").count() == 1


def many_facts(spark, n):
    """Facts of a table of n columns: every third is text, every fifth has a negative minimum."""
    i = F.col("id")
    number = i % 3 > 0
    return spark.range(n).select(
        i.cast("int").alias("position"),
        F.concat(F.lit("c"), i).alias("column_name"),
        number.alias("spec_numeric"),
        F.when(number, F.when(i % 5 == 0, -1.0).otherwise(F.when(i % 7 == 0, 0.0).otherwise(1.0))).alias("min"),
        F.when(number, 9.0).alias("max"),
        F.when(i % 11 == 0, 4).otherwise(0).cast("bigint").alias("missing_count"),
    )


def test_specs_of_many_columns_are_numbered_in_order(spark):
    n = 60
    got = [(r.ordinal, r.feature_name) for r in planner.plan_features(many_facts(spark, n), "c1").collect()]
    names = [i for i in range(n) if i != 1]
    fit = [i for i in names if i % 3 > 0 and i % 5 > 0]
    expected = [f"log1p_c{i}" for i in fit]
    for k, i in enumerate(fit):
        for j in fit[k + 1 :]:
            expected += [f"ratio_c{i}_to_c{j}", f"diff_c{i}_minus_c{j}", f"product_c{i}_times_c{j}"]
    expected += [f"c{i}_is_missing" for i in names if i % 11 == 0]
    assert sorted(got) == list(enumerate(expected, 1))


def test_thousands_of_columns_are_planned_without_a_nested_loop(spark):
    specs = planner.plan_features(many_facts(spark, 3000), "none")
    plan = specs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    fit = sum(i % 3 > 0 and i % 5 > 0 for i in range(3000))
    total = fit + 3 * fit * (fit - 1) // 2 + sum(i % 11 == 0 for i in range(3000))
    row = specs.agg(F.count(F.lit(1)), F.min("ordinal"), F.max("ordinal"), F.countDistinct("ordinal")).first()
    assert tuple(row) == (total, 1, total, total) and total > 3_000_000


def test_specs_ruled_out_by_their_own_row_are_never_collected(spark, monkeypatch):
    seen = []
    collect = transforms._with_ordinals
    monkeypatch.setattr(transforms, "_with_ordinals", lambda s: seen.append(s.count()) or collect(s))
    facts = many_facts(spark, 40).where("spec_numeric")
    df = spark.range(3).select(*[F.col("id").cast("double").alias(r.column_name) for r in facts.collect()])
    specs = planner.plan_pairs(facts, "none")
    plan = transforms.plan_transforms(df, specs)
    log = transforms.feature_log(df, plan).collect()
    assert seen == [specs.count() // 3] and len(log) == specs.count()
    assert {(r.transformation_type, r.status) for r in log} == {
        ("ratio", "applied"), ("difference", "skipped"), ("product", "skipped")
    }
    assert {r.ordinal for r in log} == set(range(1, len(log) + 1))
    assert {r.reason for r in log} == {
        None, "Unsupported transformation type: difference", "Unsupported transformation type: product"
    }
