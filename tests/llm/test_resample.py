import functools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tablereview.llm import resample
from tablereview.llm import words as W


def auc(good, bad):
    return np.mean([[g > b for b in bad] for g in good])


def test_good_documents_rank_higher(spark, documents, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    held = {r.doc_id: r.quality for r in labels.filter("doc_id % 2 = 1").collect()}
    out = {r.doc_id: r for r in resample.resample(documents, labels.filter("doc_id % 2 = 0")).collect()}
    assert len(out) == documents.count()
    good = [out[i].log_weight for i, q in held.items() if q == 1 and out[i].log_weight is not None]
    bad = [out[i].log_weight for i, q in held.items() if q == 0 and out[i].log_weight is not None]
    assert auc(good, bad) > 0.8


def test_exactly_k_are_kept(spark, documents, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = resample.resample(documents, labels, share=0.3).collect()
    keys = sorted((r.gumbel_key for r in rows if r.gumbel_key is not None), reverse=True)
    k = round(0.3 * len(rows))
    assert {r.kept for r in rows if r.gumbel_key is not None and r.gumbel_key >= keys[k - 1]} == {True}
    assert sum(r.kept for r in rows) == sum(x >= keys[k - 1] for x in keys)


def test_kth_greatest(spark):
    rng = np.random.default_rng(3)
    values = [*rng.normal(size=30_000), *[0.5] * 15_000, 1e9, -1e9]
    df = spark.createDataFrame([(float(v),) for v in values], "value double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 9_000, 20_000, len(values)):
        assert resample.kth_greatest(df, k) == ordered[k - 1]


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (99, 1), (None, 1), (6, None)], "doc_id long, quality int")
    rows = resample.resample(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(r.log_weight is None and not r.kept for r in rows if r.n_features == 0)
    assert resample.resample(none, labels).count() == 0
    assert resample.resample(odd, labels.limit(0)).count() == odd.count()


def test_counts_weights_keys_and_kept_match_brute_force(spark, documents, small):
    """Each word and pair hashed alone, counted, weighed and ranked in plain Python."""
    labels = spark.read.parquet(f"{small}/labels.parquet")
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    share = np.mean([r.quality == 1 for r in labels.filter("quality is not null and doc_id is not null").collect()])
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hashed = functools.cache(lambda w: next(W.word_hashes(pa.array([w.translate(lower)]))))
    one = functools.cache(lambda w: int(hashed(w)[0]) % resample.FEATURES)
    two = functools.cache(lambda v, w: int(W.runs(np.concatenate([hashed(v), hashed(w)]), 2)[0]) % resample.FEATURES)
    grams = {i: [one(w) for w in ws] + [two(*p) for p in zip(ws, ws[1:])] for i, t in rows for ws in [split(t)]}
    raw, target = Counter(), Counter()
    for i, found in grams.items():
        raw.update(found)
        target.update(found if i in good else ())
    smoothed = raw.total() + resample.FEATURES, target.total() + resample.FEATURES
    ratio = {b: math.log((target[b] + 1) / smoothed[1]) - math.log((raw[b] + 1) / smoothed[0]) for b in raw}
    noise = documents.select("doc_id", resample.gumbel(resample.SEED, F.col("doc_id"), F.col("text")).alias("noise"))
    key = {}
    out = {r.doc_id: r for r in resample.resample(documents, labels).collect()}
    assert len(out) == len(rows) == len(grams)
    for r in noise.collect():
        found = grams[r.doc_id]
        assert out[r.doc_id].n_features == len(found)
        if found:
            weight = sum(ratio[b] for b in found) / len(found) * resample.LENGTH
            assert abs(out[r.doc_id].log_weight - weight) < 1e-6
            key[r.doc_id] = weight + r.noise
            assert abs(out[r.doc_id].gumbel_key - key[r.doc_id]) < 1e-6
    drawn = sorted(key, key=key.get, reverse=True)[: round(share * len(rows))]
    assert {i for i, r in out.items() if r.kept} == set(drawn)
