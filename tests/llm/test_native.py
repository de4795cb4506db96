"""Spans and masks against plain Python, also with very many matches in one text."""

import random
import re
import time

from pyspark.sql import functions as F
from tablereview.llm import native

PATTERNS = ("[a-z]{2}[0-9é]", "(key|zz)=?([0-9]*)", "z+", "q.{0,9}")


def texts():
    rng = random.Random(1)
    parts = ["aé1@b", "xx", "\U0001f600q", "key=12345", "\n", "zz" * 30, "z"]
    counts = [0, 1, 5, 63, 64, 65, 200, 4095, 4096, 4097]
    return [" ".join(rng.choice(parts) for _ in range(n)) for n in counts * 3]


def with_spans(df):
    found = F.concat(*(native.matches(F.col("t"), p, 2 if "(" in p else 0) for p in PATTERNS))
    return df.withColumn("spans", F.sort_array(found))


def test_spans_and_masks_match_plain_python(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "i int, t string").repartition(8)
    mask = native.masked(F.col("t"), F.col("spans"), lambda s: F.concat(F.lit("<"), s["part"], F.lit(">")))
    for r in with_spans(df).select("t", "spans", mask.alias("mask")).collect():
        spans = sorted(
            (m.start(), m.end(), m[0], m[2] if "(" in p else m[0]) for p in PATTERNS for m in re.finditer(p, r.t)
        )
        assert [tuple(s) for s in r.spans] == spans
        out, at = [], 0
        for start, stop, _, part in spans:
            if start >= at:
                out.append(f"{r.t[at:start]}<{part}>")
            at = max(at, stop)
        assert r.mask == "".join(out) + r.t[at:]


def test_combined_before(spark):
    for n in (1, 64, 65, 4096, 4097, 10_000):
        values = [(k * 7919) % 31 for k in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        sums = native.combined_before(F.col("v"), F.lit(0), lambda a, x: a + x)
        tops = native.combined_before(F.col("v"), F.lit(3), lambda a, x: F.greatest(a, x))
        row = df.select(sums.alias("sums"), tops.alias("tops")).first()
        assert row.sums == [sum(values[:k]) for k in range(n)]
        assert row.tops == [max([3, *values[:k]]) for k in range(n)]


def test_many_matches_in_one_text(spark):
    def seconds(n):
        df = spark.createDataFrame([(" ".join(f"user{k}@example.com," for k in range(n)),)], "t string")
        spans = native.matches(F.col("t"), "[a-z0-9]+@[a-z.]+")
        mask = native.masked(F.col("t"), F.col("spans"), lambda s: F.lit("*"))
        start = time.perf_counter()
        row = df.select(spans.alias("spans"), "t").select("spans", mask.alias("mask")).first()
        assert len(row.spans) == n and row.mask == " ".join(["*,"] * n)
        return time.perf_counter() - start

    seconds(1000)
    once, twice = seconds(32_000), seconds(64_000)
    assert once < 10 and twice < 3 * once + 2
