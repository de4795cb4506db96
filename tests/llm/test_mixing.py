import hashlib
import math
from collections import Counter

import pytest
from tablereview.llm import mixing


def poisson(rate, u):
    k, p, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u:
        k += 1
        p *= rate / k
        if p == 0:
            break
        total += p
    return k


def uniform(key, seed=mixing.SEED):
    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:13], 16) / 2**52


def test_counts_invert_the_distribution(documents):
    rows = documents.collect()
    sizes = Counter(r.source for r in rows)
    total = sum(math.sqrt(n) for n in sizes.values())
    got = Counter(r.doc_id for r in mixing.mix_sources(documents).select("doc_id").collect())
    for r in rows:
        rate = len(rows) * math.sqrt(sizes[r.source]) / total / sizes[r.source]
        assert got[r.doc_id] == poisson(rate, uniform(r.doc_id))


def test_weights_are_met(spark):
    rows = [(i, f"t{i}", "a" if i % 10 else "b") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(r.source for r in mixing.mix_sources(docs, weights={"a": 1, "b": 3}, total=8000).collect())
    assert got["a"] == pytest.approx(2000, abs=200) and got["b"] == pytest.approx(6000, abs=350)
    assert mixing.mix_sources(docs, weights={"a": 1}).filter("source = 'b'").count() == 0
    assert mixing.mix_sources(docs, weights={"c": 1}).count() == 0


def test_large_rates(spark):
    docs = spark.createDataFrame([(i, "x", "s") for i in range(20)], "doc_id long, text string, source string")
    got = Counter(r.doc_id for r in mixing.mix_sources(docs, total=20 * 2000).select("doc_id").collect())
    assert all(abs(n - 2000) < 300 for n in got.values()) and len(set(got.values())) > 5


def test_order_is_shuffled(documents):
    ids = [r.doc_id for r in mixing.mix_sources(documents).select("doc_id").collect()]
    assert ids != sorted(ids)


def test_odd_rows(odd, none):
    out = mixing.mix_sources(odd, copy_column="copy", total=200)
    assert out.columns == [*odd.columns, "copy"]
    assert 120 < out.count() < 300
    assert mixing.mix_sources(none).count() == 0
