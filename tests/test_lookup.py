"""Dictionaries of any size against tables in which few keys hold most rows."""

import statistics

import pytest
from pyspark.sql import functions as F

from tablereview.operators import lookup, prep, ranking
from tablereview.operators.lookup import Dictionary, Wanted, look_up
from tablereview.operators.transforms import Spec, apply_features


def dictionary(spark, counts):
    rows = [(k, n, i) for i, (k, n) in enumerate(sorted(counts.items()))]
    return Dictionary.measured(spark.createDataFrame(rows, "key string, n long, value long"))


@pytest.fixture
def nothing_whole(monkeypatch):
    """As if no dictionary fitted into a broadcast."""
    monkeypatch.setattr(lookup, "broadcast_whole", lambda wanted: [False] * len(wanted))


def skewed(spark, rows=60_000):
    """90 % missing, of the rest half one level, others rare; an unknown level too."""
    key = F.when(F.col("i") % 10 == 0, F.when(F.col("i") % 20 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("i") % 1999)))
    return spark.range(rows).withColumnRenamed("id", "i").withColumn("a.b", key).withColumn("c", F.when(F.col("i") >= 0, "one"))


def wanted_of(spark, df):
    counts = {r[0]: r[1] for r in df.where("`a.b` is not null").groupBy("`a.b`").count().collect() if r[0] != "k7"}
    return [
        Wanted(F.col("`a.b`"), dictionary(spark, counts), "v.1"),
        Wanted(F.col("c"), dictionary(spark, {"one": df.count()}), "w"),
    ], {k: i for i, k in enumerate(sorted(counts))}


def test_values_of_all_rows(spark, nothing_whole):
    df = skewed(spark)
    wanted, expected = wanted_of(spark, df)
    out = look_up(df, wanted)
    assert out.columns == ["i", "a.b", "c", "v.1", "w"]
    rows = out.collect()
    assert sorted(r.i for r in rows) == list(range(60_000))
    assert all(r["v.1"] == expected.get(r["a.b"]) and r.w == 0 for r in rows)
    assert any(r["a.b"] == "k7" for r in rows)


def test_whole_dictionaries_move_no_row(spark):
    df = skewed(spark)
    wanted, expected = wanted_of(spark, df)
    out = look_up(df, wanted)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "hashpartitioning" not in plan
    assert all(r["v.1"] == expected.get(r["a.b"]) for r in out.collect())


def test_only_rare_keys_move_and_no_task_has_many(spark, nothing_whole):
    df = skewed(spark, 200_000)
    wanted, _ = wanted_of(spark, df)
    whole = [False, False]
    rows = lookup.answered(df, wanted, whole)
    is_open, rare = lookup.open_rows(wanted, whole)
    rest = rows.where(is_open)
    assert rest.where("`a.b` is null or `a.b` = 'hot'").isEmpty() and rest.count() == 10_000
    # as the join deals them out: by key and spread number, also for the column that is settled
    for i in rare:
        pad = F.when(rare[i], 0).otherwise(1 + F.pmod(F.xxhash64("_k0", "_k1"), F.lit(lookup.SPREAD)))
        dealt = rest.withColumn("pad", pad).repartition(16, f"_k{i}", "pad")
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 16 and max(sizes) <= 3 * statistics.median(sizes)


def test_frequent_keys_are_few_and_short(spark, monkeypatch):
    monkeypatch.setattr(lookup, "FREQUENT", 10)
    counts = {f"k{i}": 1 for i in range(900)} | {"hot": 600, "x" * 65: 500, "é" * 40: 400}
    known = dictionary(spark, counts)
    assert {r.key for r in known.frequent().collect()} == {"hot"}
    assert (known.size, known.rows) == (903, 2400)
    assert known.bytes == sum(len(k.encode()) for k in counts) + lookup.ROW_BYTES * 903


def test_small_dictionaries_are_broadcast_first(spark, monkeypatch):
    def of(size):
        return Wanted(F.lit("x"), Dictionary(None, 1, 1, size), "v")

    slice_bytes = lookup.FREQUENT * (lookup.KEY_BYTES + lookup.ROW_BYTES)
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 5 * slice_bytes)
    wanted = [of(4 * slice_bytes), of(10), of(2 * slice_bytes), of(100 * slice_bytes)]
    assert lookup.broadcast_whole(wanted) == [False, True, True, False]


def test_one_hot_and_ranks_agree_without_broadcasts(spark, nothing_whole):
    df = spark.range(5000).select(
        F.col("id").alias("x"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("level "), F.col("id") % 700)).alias("s"),
        F.lit("same").alias("t"),
    )
    fitted = prep.fit_prep(df, ["s", "t"])
    levels = sorted({f"level {i % 700}" for i in range(5000) if i % 3 > 0})
    top = min(levels, key=lambda v: (-sum(f"level {i % 700}" == v for i in range(5000) if i % 3 > 0), v))
    rows = {r.x: (r.s0, r.s1) for r in fitted.slots(df, [F.col("x")]).collect()}
    assert rows == {i: (levels.index(f"level {i % 700}" if i % 3 > 0 else top), 0) for i in range(5000)}
    ranked, _ = apply_features(df, [Spec("s", "ordinal_encode", ("s",)), Spec("r.2", "ordinal_encode", ("t",))], "extended")
    assert ranked.columns == ["x", "s", "t", "r.2"]
    got = {r.x: (r.s, r["r.2"]) for r in ranked.collect()}
    assert got == {i: (levels.index(f"level {i % 700}") if i % 3 > 0 else None, 0) for i in range(5000)}


@pytest.mark.parametrize("few", [0, 10_000])
def test_places_of_few_and_many_rows(spark, monkeypatch, few):
    monkeypatch.setattr(ranking, "FEW", few)
    df = spark.range(3000).select((F.col("id") % 7).alias("a"), F.xxhash64("id").alias("b"))
    expected = {tuple(k): i for i, k in enumerate(sorted(tuple(r) for r in df.collect()))}
    assert {(r.a, r.b): r.place for r in ranking.places(df, ["a", "b"], "place").collect()} == expected
    totals = ranking.totals_before(df.withColumn("n", F.col("a") + 1), ["a", "b"], "n", "before")
    upto = 0
    for r in sorted(totals.collect(), key=lambda r: (r.a, r.b)):
        assert r.before == upto
        upto += r.n
    assert ranking.places(df.limit(0), ["a", "b"], "place").count() == 0


def test_places_move_the_rows_once(spark, monkeypatch):
    monkeypatch.setattr(ranking, "FEW", 0)
    df = spark.range(1000).select("id")
    plan = ranking.places(df, ["id"], "place")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan.split("Join")[0] and "RepartitionByExpression" not in plan
