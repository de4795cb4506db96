import math
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tablereview.operators import compare, levels, metrics, model, passes, prep, split
from tablereview.operators.split import MARK, class_quotas, stratified_split
from tablereview.operators.transforms import Spec


def mixed(spark, n=300, classes=2, seed=1):
    """Numbers with gaps, two text columns, a target that depends on them."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in range(3)]
        cat = rng.choice("abc")
        lean = x[0] * 1.5 - x[1] + (0.8 if cat == "a" else 0) + rng.gauss(0, 0.7)
        y = sum(lean > cut for cut in ([0.0] if classes == 2 else [-0.7, 0.7]))
        rows.append((None if rng.random() < 0.1 else x[0], x[1], x[2], cat, rng.choice("wxyz"), True, y))
    return spark.createDataFrame(
        rows, "num_0 double, num_1 double, num_2 double, cat_0 string, cat_1 string, flag boolean, target bigint"
    )


def largest_remainder(counts, n_train):
    total = sum(counts)
    shares = [divmod(c * n_train, total) for c in counts]
    quotas = [whole for whole, _ in shares]
    for i in sorted(range(len(counts)), key=lambda i: (-shares[i][1], i))[: n_train - sum(quotas)]:
        quotas[i] += 1
    return quotas


def test_quotas(spark):
    rng = random.Random(2)
    for _ in range(6):
        counts = [rng.randint(2, 50) for _ in range(rng.randint(2, 40))]
        n = sum(counts) - math.ceil(0.2 * sum(counts))
        kept = largest_remainder(counts, n)
        assert sum(kept) == n
        classes = spark.createDataFrame(
            [(f"{i:03}", c, float(i)) for i, c in enumerate(counts)], "t string, n bigint, label double"
        )
        got = {r.t: r.quota for r in class_quotas(classes, sum(counts), n).collect()}
        assert got == {f"{i:03}": c - k for i, (c, k) in enumerate(zip(counts, kept)) if c > k}


def test_split_of_many_classes(spark):
    """More classes than any list on the driver should hold; each has four rows."""
    df = spark.range(48_000).select((F.col("id") % 12_000).alias("t"), (F.col("id") % 7).alias("x"))
    split = stratified_split(df, "t", test_size=0.25)
    assert split.class_count == 12_000 and split.test_rows == 12_000
    per_class = split.rows.groupBy("t").agg(F.count_if(MARK).alias("test"), F.count(F.lit(1)).alias("n"))
    assert [(r.test, r.n) for r in per_class.select("test", "n").distinct().collect()] == [(1, 4)]


def test_keyless_split_is_over_rows(spark):
    """Copies of one row fall on both sides; the least test share of the 40 rows is far from none."""
    df = spark.range(4000).select((F.col("id") % 2).alias("t"), (F.col("id") % 40).alias("x"))
    split = stratified_split(df, "t")
    sides = split.rows.groupBy("x").agg(F.count_if(MARK).alias("test"), F.count(F.lit(1)).alias("n")).collect()
    assert all(0 < r.test < 100 and r.n == 100 for r in sides) and len(sides) == 40
    assert split.rows.drop(MARK).exceptAll(df).isEmpty() and split.test.count() == 800


def shares(split):
    rows = split.rows.groupBy("t", MARK).count().collect()
    return {(r.t, r[MARK]): r["count"] for r in rows}


def test_split_sizes_and_repeatability(spark):
    df = mixed(spark)
    split = stratified_split(df, "target")
    assert (split.train_rows, split.test_rows) == (240, 60)
    assert split.train.count() == 240 and split.test.count() == 60
    again = stratified_split(df.repartition(5), "target")
    assert split.rows.exceptAll(again.rows).count() == 0
    other = stratified_split(df, "target", seed=7)
    assert split.rows.exceptAll(other.rows).count() > 0


def test_split_of_identical_rows(spark):
    """A hot row that makes up most of a class is shared exactly."""
    df = spark.range(4000).select(
        F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("t"),
        F.when(F.col("id") < 3500, 0).otherwise(F.col("id")).alias("x"),
    )
    split = stratified_split(df, "t")
    assert split.rows.count() == 4000
    assert shares(split) == {("a", True): 600, ("a", False): 2400, ("b", True): 200, ("b", False): 800}
    assert split.rows.drop(MARK).exceptAll(df).count() == 0
    assert df.exceptAll(split.rows.drop(MARK)).count() == 0


def test_split_with_a_repeated_key(spark):
    """One key value may hold most rows: the rows behind it decide."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("t"),
        F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("k"),
        (F.col("id") % 500).alias("x"),
    )
    split = stratified_split(df, "t", key="k")
    assert shares(split) == {("a", True): 400, ("a", False): 1600, ("b", True): 200, ("b", False): 800}
    assert split.rows.drop(MARK).exceptAll(df).count() == 0


def test_split_errors(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "x int, t string")
    with pytest.raises(ValueError, match="only 1 member"):
        stratified_split(df, "t")
    with pytest.raises(ValueError, match="missing"):
        stratified_split(df.withColumn("t", F.nullif("t", F.lit("b"))), "t")
    with pytest.raises(ValueError, match="two classes"):
        stratified_split(df.where("t = 'a'"), "t")
    with pytest.raises(ValueError, match="not found"):
        stratified_split(df, "nope")
    with pytest.raises(ValueError, match="one row per class"):
        stratified_split(df.unionByName(df).where("x > 1"), "t", test_size=0.1)


def test_prep_values(spark):
    rows = [(1.0, 5.0, "a", None), (None, 5.0, "b", None), (3.0, 5.0, None, None), (8.0, 5.0, "b", None)]
    df = spark.createDataFrame(rows, "x double, c double, s string, e double").coalesce(1)
    fitted = prep.fit_prep(df, df.columns)
    assert [(n.name, n.median) for n in fitted.numbers] == [("x", 3.0), ("c", 5.0)]
    x, c = fitted.numbers
    filled = [1.0, 3.0, 3.0, 8.0]
    assert (x.mean, x.scale) == (pytest.approx(np.mean(filled)), pytest.approx(np.std(filled)))
    assert c.scale == 1.0
    assert (fitted.texts[0].mode, fitted.texts[0].size) == ("b", 2)
    assert [r.key for r in fitted.levels.orderBy("slot").collect()] == ["a", "b"]
    assert [r.s for r in fitted.impute(df).collect()] == ["a", "b", "b", "b"]
    vectors = [list(r.features.toArray()) for r in fitted.features(df, []).collect()]
    assert [v[2:] for v in vectors] == [[1, 0], [0, 1], [0, 1], [0, 1]]
    unseen = fitted.features(df.withColumn("s", F.lit("new")), []).first().features.toArray()
    assert list(unseen[2:]) == [0, 0]


def test_many_levels(spark):
    """Levels stay a table: a text column without repeats gets one slot a row."""
    df = spark.range(30_000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("s"), F.col("id").alias("x"))
    fitted = prep.fit_prep(df, ["s", "x"])
    assert fitted.width == 30_001 and fitted.texts[0].size == 30_000
    encoded = fitted.encode(df, [F.col("x")]).where("x % 5000 = 7")
    assert {r.x: list(r.h0.indices) for r in encoded.collect()} == {x: [x] for x in range(7, 30_000, 5000)}


def dense(prep_, df):
    rows = prep_.features(df, [F.col("_label").alias("label")]).collect()
    return np.array([r.features.toArray() for r in rows]), np.array([r.label for r in rows])


def minimise(x, y, classes):
    """Newton steps on the summed loss plus half the squared coefficients."""
    n, d = x.shape
    x1 = np.hstack([x, np.ones((n, 1))])
    if classes == 2:
        w = np.zeros(d + 1)
        for _ in range(100):
            p = 1 / (1 + np.exp(-x1 @ w))
            keep = np.r_[np.ones(d), 0]
            g = x1.T @ (p - y) + keep * w
            h = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(keep) + 1e-12 * np.eye(d + 1)
            w -= np.linalg.solve(h, g)
        return 1 / (1 + np.exp(-x1 @ w))
    w = np.zeros((classes, d + 1))
    onehot = np.eye(classes)[y.astype(int)]
    keep = np.r_[np.ones(d), 0]
    step = 1.0 / (0.5 * np.linalg.norm(x1, 2) ** 2 + 1)
    v, t = w.copy(), 1.0
    for _ in range(20000):
        z = x1 @ v.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = v - step * ((p - onehot).T @ x1 + keep * v)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    z = x1 @ w.T
    p = np.exp(z - z.max(1, keepdims=True))
    return (p / p.sum(1, keepdims=True))[:, 1]


@pytest.mark.parametrize("classes", [2, 3])
def test_model_equals_direct_minimisation(spark, classes):
    df = mixed(spark, 400, classes)
    split = stratified_split(df, "target")
    fitted = prep.fit_prep(split.train, model.feature_columns(df.columns, "target"))
    run = model.fit_predict(split, "target", fitted)
    x, y = dense(fitted, model.class_label("target", split.classes, split.train))
    scores = [r.score for r in run.model.transform(
        fitted.features(split.train, [])).select(model.vector_to_array("probability")[1].alias("score")).collect()]
    assert np.allclose(sorted(scores), sorted(minimise(x, y, classes)), atol=2e-3)


def brute_f1(pairs):
    labels = {a for a, _ in pairs}
    total = 0.0
    for c in labels:
        hits = sum(a == b == c for a, b in pairs)
        support, guessed = sum(a == c for a, _ in pairs), sum(b == c for _, b in pairs)
        total += support * (2 * hits / (support + guessed))
    return total / len(pairs)


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return wins / (len(pos) * len(neg))


def test_metrics_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i % 3, float(rng.random() < 0.4), rng.choice([0.1, 0.3, 0.5, rng.random()]), float(rng.randint(0, 2)))
            for i in range(600)]
    rows += [(9, 1.0, 0.5, 1.0)]  # a group with one class
    df = spark.createDataFrame(rows, "g int, label double, score double, prediction double")
    got = {r.g: r for r in metrics.class_metrics(df, ("g",)).collect()}
    area = {r.g: r.roc_auc for r in metrics.roc_auc(df, F.col("label") == 1, ("g",)).collect()}
    for g in (0, 1, 2):
        mine = [r for r in rows if r[0] == g]
        assert got[g].accuracy == pytest.approx(np.mean([r[1] == r[3] for r in mine]))
        assert got[g].f1_score == pytest.approx(brute_f1([(r[1], r[3]) for r in mine]))
        assert area[g] == pytest.approx(brute_auc([(r[1], r[2]) for r in mine]), abs=1e-12)
    assert area[9] is None
    whole = metrics.roc_auc(df, F.col("label") == 1).first().roc_auc
    assert whole == pytest.approx(brute_auc([(r[1], r[2]) for r in rows]), abs=1e-12)


@pytest.mark.parametrize("classes, task", [(2, "binary_classification"), (3, "multiclass_classification")])
def test_model_report(spark, classes, task):
    row = model.model_report(mixed(spark, 300, classes), "target").first()
    assert (row.model_name, row.task_type, row.target_column) == ("LogisticRegression", task, "target")
    assert (row.train_rows, row.test_rows) == (240, 60)
    assert row.accuracy > 0.55 and row.f1_score > 0.55
    assert (row.roc_auc is not None) == (classes == 2)
    assert row.notes.endswith("60 test rows. Numeric features: 3, Categorical features: 2.")


def test_text_target_and_all_missing_column(spark):
    df = mixed(spark).withColumn("target", F.when(F.col("target") == 1, "yes").otherwise("no"))
    row = model.model_report(df.withColumn("e", F.lit(None).cast("double")), "target").first()
    assert row.roc_auc > 0.7 and "Numeric features: 4" in row.notes


def test_comparison(spark):
    df = mixed(spark).withColumn("num_1", F.col("num_1") + 10)
    specs = [Spec("l", "log1p", ("num_1",)), Spec("bad", "log1p", ("cat_0",)), Spec("m", "missing_indicator", ("num_0",))]
    got = compare.compare_models(df, "target", specs)
    r = got.result.first()
    assert r.features_created == ["l", "m"]
    assert r.features_skipped == ["bad: Source column 'cat_0' is not numeric."]
    assert r.accuracy_change == pytest.approx(r.engineered_accuracy - r.baseline_accuracy, abs=1e-10)
    assert r.f1_change == pytest.approx(r.engineered_f1_score - r.baseline_f1_score, abs=1e-10)
    assert r.improved == (r.engineered_f1_score > r.baseline_f1_score)
    alone = model.model_report(df, "target").first()
    assert (alone.accuracy, alone.f1_score) == (r.baseline_accuracy, r.baseline_f1_score)
    again = compare.compare_models(df, "target", specs).result.first()
    assert again == r


def test_comparison_without_features(spark):
    r = compare.compare_models(mixed(spark), "target", []).result.first()
    assert (r.accuracy_change, r.f1_change, r.improved, r.features_created) == (0.0, 0.0, False, [])
    assert r.summary.endswith("The engineered features did not improve model performance.")


def test_comparison_with_an_overwritten_column(spark):
    df = mixed(spark)
    r = compare.compare_models(df, "target", [Spec("num_0", "missing_indicator", ("num_0",))]).result.first()
    assert r.baseline_accuracy == model.model_report(df, "target").first().accuracy
    assert r.engineered_accuracy < r.baseline_accuracy


DECISIONS = [
    (0.05, 0.03, 0.02, ["f"], ["g: no"], "accept"),
    (0.0, 0.0, None, ["f"], [], "reject"),
    (0.03, -0.01, None, ["f"], ["g: no"], "review"),
    (0.05, 0.03, 0.02, [], ["g: no"], "reject"),
    (0.0167, 0.0082, -0.0682, ["f"], [], "review"),
    (-0.02, -0.01, -0.03, ["f"], ["g: no"], "reject"),
    (0.01, 0.01, 0.0, ["f"], [], "accept"),
    (0.0, 0.0, 0.01, ["f"], [], "review"),
    (-0.01, 0.02, -0.03, ["f"], [], "review"),
]


def test_decisions(spark):
    rows = [(i, a, f, u, f > 0, c, s) for i, (a, f, u, c, s, _) in enumerate(DECISIONS)]
    df = spark.createDataFrame(
        rows, "i int, accuracy_change double, f1_change double, roc_auc_change double, improved boolean, "
        "features_created array<string>, features_skipped array<string>",
    )
    got = compare.decide(df).orderBy("i").collect()
    assert [r.decision for r in got] == [d[-1] for d in DECISIONS]
    assert (got[0].accepted_features, got[0].rejected_features) == (["f"], ["g: no"])
    assert got[0].reasons == ["Model performance improved: accuracy Δ+0.0500, F1 Δ+0.0300.", "ROC-AUC Δ+0.0200."]
    assert got[2].reasons[0] == "Mixed results: accuracy improved by +0.0300 but F1 declined by -0.0100."
    assert got[3].reasons == ["No engineered features were successfully created."]
    assert got[3].rejected_features == ["g: no"]
    assert got[4].reasons[0] == "Mixed results: ROC-AUC declined by -0.0682."
    assert (got[5].accepted_features, got[5].rejected_features) == ([], ["f", "g: no"])
    assert got[7].reasons == ["Engineered features show some benefit but not uniformly positive."]
    assert got[8].reasons[0] == (
        "Mixed results: F1 improved by +0.0200 but accuracy declined by -0.0100; ROC-AUC declined by -0.0300."
    )
    assert got[0].decision_summary == (
        "Critic reviewed 1 engineered feature(s). Decision: ACCEPT. Key reasons: Model performance improved: "
        "accuracy Δ+0.0500, F1 Δ+0.0300.; ROC-AUC Δ+0.0200."
    )
    assert not any(r.leakage_warning for r in got)
    assert [r.performance_improved for r in got] == [f > 0 for _, f, *_ in DECISIONS]


def test_comparison_summary_wording(spark):
    rows = [(0, 0.7963, 0.7913, 0.8403, 0.8027, 0.7948, 0.8485), (1, 0.5, 0.5, None, 0.6, 0.4, None)]
    df = spark.createDataFrame(
        rows, "i int, baseline_accuracy double, baseline_f1_score double, baseline_roc_auc double, "
        "engineered_accuracy double, engineered_f1_score double, engineered_roc_auc double",
    )
    first, second = compare.deltas(df).orderBy("i").collect()
    assert first.summary == (
        "Baseline model achieved accuracy 0.7963 and F1 0.7913. Engineered model achieved accuracy 0.8027 and F1 "
        "0.7948. ROC-AUC changed from 0.8403 to 0.8485 (Δ +0.0082). The engineered features improved model performance."
    )
    assert second.summary.endswith("Accuracy improved but F1 did not; some metrics improved while others declined.")
    assert second.roc_auc_change is None and "ROC" not in second.summary


def test_missing_group_value_is_a_group(spark):
    rows = [(None, 1.0, 1.0, 0.9), (None, 0.0, 1.0, 0.4), (1, 1.0, 1.0, 0.8), (1, 0.0, 0.0, 0.9)]
    scored = spark.createDataFrame(rows, "g int, label double, prediction double, score double")
    got = {r.g: (r.test_rows, r.accuracy, r.roc_auc) for r in model.evaluate(scored, 2, ("g",)).collect()}
    assert got == {None: (2, 0.5, 1.0), 1: (2, 1.0, 0.0)}


def test_metrics_read_the_predictions_once(spark):
    """One pass for classes and scores together, the same figures as from two."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rng = random.Random(4)
    rows = [("ab"[i % 2], float(rng.random() < 0.4), round(rng.random(), 2)) for i in range(4000)]
    df = spark.createDataFrame([(g, y, float(s > 0.6), s) for g, y, s in rows], "g string, label double, prediction double, score double")
    counted = df.mapInArrow(seen, df.schema)
    got = {r.g: r for r in metrics.binary_metrics(counted, ("g",)).collect()}
    assert read.value == 4000
    base = {r.g: r for r in metrics.class_metrics(df, ("g",)).collect()}
    area = {r.g: r.roc_auc for r in metrics.roc_auc(df, F.col("label") == 1.0, ("g",)).collect()}
    for g in "ab":
        assert math.isclose(got[g].accuracy, base[g].accuracy) and math.isclose(got[g].f1_score, base[g].f1_score)
        assert got[g].rows == base[g].rows and math.isclose(got[g].roc_auc, area[g])
    one = metrics.binary_metrics(df.where("label = 1 and prediction = 1")).first()
    assert (one.accuracy, one.f1_score, one.roc_auc) == (1.0, 1.0, None)


def test_scores_are_dealt_to_more_tasks_as_rows_grow(spark, monkeypatch):
    """Nearly unique scores, one frequent score, gaps and both zeros: same figures, tasks by number of rows."""
    rng = random.Random(6)
    rows = [(i % 2, float(rng.random() < 0.5), rng.choice([0.5, rng.random(), rng.random()])) for i in range(3000)]
    rows += [(0, 1.0, 0.0), (0, 0.0, -0.0), (None, 1.0, 0.7), (None, 0.0, 0.7)]
    data = [(g, y, float(s > 0.6), s) for g, y, s in rows]
    df = spark.createDataFrame(data, "g int, label double, prediction double, score double")
    monkeypatch.setattr(metrics, "TASK_ROWS", 100)
    merged, tasks = metrics._merged(df, ("g",), pos=F.col("label") == 1.0)
    assert tasks == 31 and merged.rdd.getNumPartitions() == 31
    assert merged.where("score = 0.5").count() == 2 and merged.where("g = 0 and score = 0").count() == 1
    got = {r.g: r for r in metrics.binary_metrics(df, ("g",)).collect()}
    for g in (0, 1, None):
        mine = [r for r in data if r[0] == g]
        assert got[g].rows == len(mine) and got[g].accuracy == pytest.approx(np.mean([r[1] == r[2] for r in mine]))
        assert got[g].roc_auc == pytest.approx(brute_auc([(r[1], r[3]) for r in mine]), abs=1e-12)
        assert got[g].f1_score == pytest.approx(brute_f1([(r[1], r[2]) for r in mine]))


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_only_rows_with_copies_move(spark):
    """Of 50,000 rows, 300 have a copy; the filter finds them all and hardly any other."""
    df = spark.range(50_000).select("id", (F.col("id") % 3).alias("t"), F.concat(F.lit("text "), "id").alias("s"))
    copied = df.unionAll(df.where("id < 300")).repartition(7)
    unique, copies = split._by_filter(copied, 50_300)
    assert exchanges(unique) == 0
    assert unique.join(df.where("id < 300"), "id", "left_semi").isEmpty()
    assert copies.where("id < 300").count() == 600 and copies.count() < 600 + 50_000 / 64
    assert unique.count() + copies.count() == 50_300
    # the same hashes as from numbering all rows
    slow = split._numbered(copied, 5).collect()
    assert sorted(slow) == sorted(split._hashed_by_content(copied, 5, 50_300).collect())


def test_a_full_filter_moves_all_rows_and_loses_none(spark, monkeypatch):
    monkeypatch.setattr(split, "FILTER_BITS", 64)
    df = spark.range(3000).select((F.col("id") % 700).alias("x"), (F.col("id") % 2).cast("string").alias("t"))
    got = split._hashed_by_content(df, 5, 3000).collect()
    assert sorted(got) == sorted(split._numbered(df, 5).collect()) and len({r["_h"] for r in got}) == 3000


def test_a_split_without_key_of_unique_and_hot_rows(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") < 6000, F.col("id")).otherwise(-1).alias("x"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("t"),
    )
    marked = stratified_split(df, "t").rows.groupBy("t", (F.col("x") == -1).alias("hot")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(MARK).alias("test")
    )
    rows = {(r.t, r.hot): (r.n, r.test) for r in marked.collect()}
    assert {k: n for k, (n, _) in rows.items()} == {("a", False): 2000, ("b", False): 4000, ("a", True): 1000, ("b", True): 2000}
    assert rows["a", False][1] + rows["a", True][1] == 600 and rows["b", False][1] + rows["b", True][1] == 1200
    assert 120 < rows["a", True][1] < 280


def test_engineered_rows_are_not_written(spark, monkeypatch):
    """Features without a lookup are made where the base rows are read; one store of the split serves both fits."""
    written, stored = [], split.Split.stored
    monkeypatch.setattr(split.Split, "stored", lambda self, rows=None: written.append(rows) or stored(self, rows))
    found = compare.compare_models(mixed(spark, 200), "target", [Spec("d", "ratio", ("num_1", "num_2"))], max_iter=5)
    assert found.plan.created == ["d"] and written == [None]
    assert {r.variant for r in found.metrics.collect()} == {"baseline", "engineered"}


def many_levels(spark, n=1200, seed=3):
    """Gaps and copies, a text column with frequent, rare, single and missing values."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, kind = rng.gauss(0, 1), rng.choice("abc")
        text = rng.choice(["hot", None, f"rare {rng.randrange(60)}", f"one {i}"])
        lean = x + (kind == "a") + 2 * (text == "hot") - (text or "").count("1") + rng.gauss(0, 1)
        rows.append((None if rng.random() < 0.1 else x, 7.0, kind, text, int(lean > 0.3)))
    rows += rows[:100]
    return spark.createDataFrame(rows, "x double, same double, kind string, text string, target bigint").repartition(5)


@pytest.mark.parametrize("per_slice", [8, 1 << 20])
def test_a_fit_with_levels_as_a_table_equals_direct_minimisation(spark, monkeypatch, per_slice):
    for name, value in {"DRIVER_COEFFICIENTS": 100, "LEVEL_ROWS": 50, "FREQUENT": 10, "BLOCK_ROWS": 64}.items():
        monkeypatch.setattr(levels, name, value)
    monkeypatch.setattr(levels, "newton", exact_sums(levels.newton))
    monkeypatch.setattr(levels, "SLICE", per_slice)
    df = many_levels(spark)
    marked = stratified_split(df, "target").stored()
    fitted = prep.fit_prep(marked.train, model.feature_columns(df.columns, "target"))
    run = model.fit_predict(marked, "target", fitted, keep=(F.col("x"), F.col("text")))
    assert isinstance(run.model, levels.LevelModel)
    assert 0 < run.model.weights.count() < fitted.width - 5
    train = model.class_label("target", marked.classes, marked.train)
    x, y = dense(fitted, train)
    expected = minimise(x, y, 2)
    scores = [r.score for r in run.scored(train, []).collect()]
    assert np.allclose(sorted(scores), sorted(expected), atol=1e-6)
    # coefficients by place give the same margins of test rows, with unseen levels among them
    found = {r.place: r.weight for r in run.coefficients.collect()}
    assert sorted(found) == list(range(fitted.width))
    weights = np.array([found[i] for i in range(fitted.width)])
    test = model.class_label("target", marked.classes, marked.test)
    xt, yt = dense(fitted, test)
    assert (xt.sum(axis=1) < xt.sum(axis=1).max() - 0.5).any()
    margins = xt @ weights + run.intercept
    rows = run.predictions.collect()
    assert run.predictions.columns == ["x", "text", "label", "prediction", "score"]
    assert np.allclose(sorted(r.score for r in rows), sorted(1 / (1 + np.exp(-margins))), atol=1e-9)
    assert sorted((r.label, r.prediction) for r in rows) == sorted(zip(yt, (margins > 0).astype(float)))
    entries = run.scored(train, [], entries=True)
    assert entries.columns == ["entries", "prediction", "score"]
    assert sorted(sorted(map(tuple, r.entries)) for r in entries.collect()) == sorted(
        sorted(map(tuple, r.entries)) for r in fitted.features(train, [], entries=True).collect()
    )


def exact_sums(newton):
    """``newton``, with the derivatives of the loss in the head compared with differences."""

    def checked(at, size, max_iter):
        rng = np.random.default_rng(1)
        x, d = rng.normal(size=size), rng.normal(size=size)
        (_, slope, curvature), (up, more, _), (down, less, _) = at(x), at(x + 1e-4 * d), at(x - 1e-4 * d)
        assert (up - down) / 2e-4 == pytest.approx(slope @ d, rel=1e-5)
        assert np.allclose((more - less) / 2e-4, curvature @ d, rtol=1e-4, atol=1e-3)
        return newton(at, size, max_iter)

    return checked


@pytest.mark.parametrize("per_slice", [64, 1 << 20])
def test_a_fit_in_passes_equals_direct_minimisation(spark, monkeypatch, per_slice):
    monkeypatch.setattr(passes, "MANY_ROWS", 100)
    monkeypatch.setattr(passes, "SLICE", per_slice)
    monkeypatch.setattr(passes, "newton", exact_sums(passes.newton))
    df = many_levels(spark, 600).withColumn("text", F.nullif(F.substring("text", 1, 6), F.lit("one 5")))
    marked = stratified_split(df, "target").stored()
    train = model.class_label("target", marked.classes, marked.train)
    test = model.class_label("target", marked.classes, marked.test)
    fitted = prep.fit_prep(train.where("kind != 'c'"), model.feature_columns(df.columns, "target"))  # 'c' is unseen
    run = model.fit_predict(marked, "target", fitted, keep=(F.col("x"), F.col("text")))
    assert isinstance(run.model, passes.PassModel)
    x, y = dense(fitted, train)
    scores = [r.score for r in run.scored(train, []).collect()]
    assert np.allclose(sorted(scores), sorted(minimise(x, y, 2)), atol=1e-6)
    found = {r.place: r.weight for r in run.coefficients.collect()}
    assert sorted(found) == list(range(fitted.width))
    xt, yt = dense(fitted, test)
    margins = xt @ np.array([found[i] for i in range(fitted.width)]) + run.intercept
    rows = run.predictions.collect()
    assert run.predictions.columns == ["x", "text", "label", "prediction", "score"]
    assert np.allclose(sorted(r.score for r in rows), sorted(1 / (1 + np.exp(-margins))), atol=1e-9)
    assert sorted((r.label, r.prediction) for r in rows) == sorted(zip(yt, (margins > 0).astype(float)))
    entries = run.scored(train, [], entries=True)
    assert entries.columns == ["entries", "prediction", "score"]
    assert sorted(sorted(map(tuple, r.entries)) for r in entries.collect()) == sorted(
        sorted(map(tuple, r.entries)) for r in fitted.features(train, [], entries=True).collect()
    )


def test_a_comparison_of_many_rows_writes_no_vectors(spark, monkeypatch):
    """Metrics as of the fits that write them, without writing a feature."""
    specs = [Spec("d", "ratio", ("num_1", "num_2"))]
    few = {r.variant: r for r in compare.compare_models(mixed(spark), "target", specs).metrics.collect()}
    monkeypatch.setattr(passes, "MANY_ROWS", 100)
    monkeypatch.setattr(prep, "_as_vectors", None)
    monkeypatch.setattr(model.LogisticRegression, "fit", None)
    many = {r.variant: r for r in compare.compare_models(mixed(spark), "target", specs).metrics.collect()}
    assert many.keys() == few.keys() == {"baseline", "engineered"}
    for name, r in many.items():
        assert (r.train_rows, r.test_rows) == (few[name].train_rows, few[name].test_rows)
        assert r.accuracy == pytest.approx(few[name].accuracy, abs=0.01)
        assert r.roc_auc == pytest.approx(few[name].roc_auc, abs=0.001)


def test_a_fit_in_passes_refuses_infinite_features(spark, monkeypatch):
    monkeypatch.setattr(passes, "MANY_ROWS", 100)
    df = mixed(spark).withColumn("num_1", F.when(F.col("num_1") > 1, float("inf")).otherwise(F.col("num_1")))
    with pytest.raises(Exception, match="NaN or infinite"):
        model.model_report(df, "target").collect()


def test_which_fits_are_made_in_passes(spark):
    def known(size):
        return prep.Prep([prep.Scaled(f"x{i}", 0.0, 0.0, 1.0) for i in range(size)], [])

    assert passes.in_passes(known(256), 1_000_001)
    assert not any([passes.in_passes(known(257), 1 << 40), passes.in_passes(known(9), 1_000_000), passes.in_passes(known(0), 1 << 40)])


def test_a_wide_fit_sends_the_driver_no_number_for_each_level(spark, monkeypatch):
    sent = []
    whole = levels._collected

    def counted(sums, size):
        sent.append(sums.count())
        return whole(sums, size)

    monkeypatch.setattr(levels, "_collected", counted)
    monkeypatch.setattr(model.LogisticRegression, "fit", None)
    for n in (6_000, 18_000):
        df = spark.range(n).select(
            F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"),
            F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("x"),
            F.pmod(F.xxhash64("id"), F.lit(2)).alias("target"),
        )
        report = model.model_report(df, "target").first()
        assert report.train_rows + report.test_rows == n
    assert max(sent) == 1 + 3 + 6  # the loss; x, the level that fills gaps and the intercept


def test_which_fits_are_for_the_driver(spark):
    few = spark.range(4_000).select(F.col("id").cast("string").alias("s"), F.lit("k").alias("t"))
    assert levels.widest(prep.fit_prep(few, ["s", "t"])) is None
    many = spark.range(5_000).select(F.col("id").cast("string").alias("s"), F.hex("id").alias("t"))
    assert levels.widest(prep.fit_prep(many, ["s"])).name == "s"
    assert levels.widest(prep.fit_prep(many, ["s", "t"])) is None  # two wide columns


def test_tasks_of_a_wide_fit_need_no_package(tmp_path):
    for made in (levels._summed(np.zeros(2), (1, 1, 2)), levels._level_weights(np.zeros(2), (1, 1, 2))):
        code = "import sys, pickle; print(list(pickle.load(sys.stdin.buffer)(iter(())))[1:])"
        ran = subprocess.run(
            [sys.executable, "-c", code], input=cloudpickle.dumps(made), cwd=tmp_path, capture_output=True, check=True,
            env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
        )
        assert ran.stdout.strip() == b"[]"


def test_tasks_of_a_fit_in_passes_need_no_package(tmp_path):
    code = "import sys, pickle; print([b.num_rows for b in pickle.load(sys.stdin.buffer)(iter(()))])"
    ran = subprocess.run(
        [sys.executable, "-c", code], input=cloudpickle.dumps(passes._summed(np.zeros(2), np.ones((1, 3)), [])), cwd=tmp_path,
        capture_output=True, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
    )
    assert ran.stdout.strip() == b"[3]"


def test_a_fit_in_passes_of_texts_alone(spark, monkeypatch):
    df = mixed(spark).select("cat_0", "cat_1", "target")
    expected = model.model_report(df, "target").first()
    monkeypatch.setattr(passes, "MANY_ROWS", 100)
    found = model.model_report(df, "target").first()
    assert found.roc_auc == pytest.approx(expected.roc_auc, abs=0.001) and found.test_rows == expected.test_rows
