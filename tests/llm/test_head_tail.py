import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tablereview.llm import head_tail
from tablereview.llm.pieces import word_pieces

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(feature):
    return crc32(feature.encode()) % 10_000


def brute(rows, targets):
    s, t = (Counter(bucket(f) for text in texts for f in features(text)[1]) for texts in ([r[1] for r in rows], targets))
    big_s, big_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in s}
    out = []
    for doc_id, text in rows:
        n, found = features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, n, len(found), weight, score, None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    for place, row in enumerate(able[: 25 * len(able) // 100]):
        row[5] = place + 1
    return sorted(map(tuple, out), key=str)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def got(docs, targets):
    return sorted(map(tuple, head_tail.resample_towards(docs, targets).collect()), key=str)


def test_matches_brute_force(spark, documents, small):
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    assert got(documents, benchmark) == brute(rows_of(documents), [r.text for r in benchmark.collect()])


def test_any_head_gives_the_same_buckets():
    words = "the cat sat on the mat and the dog sat on the log é ü the".encode().split()
    expected = [bucket(w.decode()) for w in words], [bucket(f"{a.decode()} {b.decode()}") for a, b in zip(words, words[1:])]
    for head in ([], ["the", "sat"], ["the", "cat", "the cat", "é", "é ü", "on the"], [w.decode() for w in words]):
        single, pairs = head_tail.HeadTail(head, 10_000)(words)
        assert (single.tolist(), pairs.tolist()) == expected


def test_blocks_and_pieces_lose_nothing(monkeypatch):
    texts = [" ".join(f"w{i % 97}" for i in range(n)).encode() for n in (0, 1, 500, 3, 0, 1000)] + [b"x" * 300 + b" y"]
    whole = [list(word_pieces(t, head_tail.TABLE, 1 << 20)) for t in texts]
    assert [sum(map(len, p)) for p in whole] == [len(t.split()) for t in texts]
    assert [w for p in word_pieces(texts[5], head_tail.TABLE, 7) for w in p] == texts[5].split()

    def counted(block):
        monkeypatch.setattr(head_tail, "BLOCK", block)
        tables = head_tail.HeadTail(["w1", "w2", "w1 w2"], 10_000)
        found, words = Counter(), 0
        for text, buckets, n in head_tail.feature_blocks(iter(texts), tables):
            found.update(zip(text.tolist(), buckets.tolist()))
            words += n
        return found, words

    assert counted(1) == counted(100) == counted(1 << 18)


def test_frequent_features_are_in_the_head(spark, documents, monkeypatch):
    monkeypatch.setattr(head_tail, "HEAD", 256)
    monkeypatch.setattr(head_tail, "LEAST_SEEN", 1)
    found = head_tail.head_features(documents, "text")
    words, pairs = Counter(), Counter()
    for _, text in rows_of(documents):
        n, all_of = features(text)
        words.update(all_of[:n])
        pairs.update(all_of[n:])
    for counts in (words, pairs):
        assert {f for f, k in counts.items() if k * 256 >= counts.total()} <= set(found)
    assert len(found) <= 2 * 256 * 4 / 3


@pytest.mark.parametrize("times", [10**8, 10**11])
def test_totals_of_large_tables_are_whole_numbers(spark, documents, monkeypatch, times):
    """Counts as of a table so many times as large: three times a total is more than 32 bits hold."""
    monkeypatch.setattr(head_tail, "LEAST_SEEN", 1)
    small, counted = head_tail.head_features(documents, "text"), head_tail._counted

    def large(batches):
        for batch in counted(batches):
            yield pa.RecordBatch.from_arrays([batch.column("feature"), pc.multiply(batch.column("n"), times)], ["feature", "n"])

    few = documents.limit(1).select(F.lit("one two three one two three one two").alias("text"))
    words = head_tail.head_features(few, "text")
    monkeypatch.setattr(head_tail, "_counted", large)
    assert small and sorted(head_tail.head_features(documents, "text")) == sorted(small)
    assert words and sorted(head_tail.head_features(few, "text")) == sorted(words)


def test_ranks_with_many_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), 25 if i % 7 else 3, 0, 0, int(s)) for i, s in enumerate(rng.integers(0, 9, 3000))]
    df = spark.createDataFrame(rows, "id long, n_words long, n_features long, weight long, score long")
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    expected = {r[0]: k + 1 for k, r in enumerate(able[: len(able) * 40 // 100])}
    assert {r.id: r["rank"] for r in head_tail.draw(df, 40).collect()} == {r[0]: expected.get(r[0]) for r in rows}
    assert {r["rank"] for r in head_tail.draw(df, 0).collect()} == {None}


def test_odd_rows(spark, odd, none):
    target = spark.createDataFrame([(None,), ("",), ("one two three",)], "text string")
    rows = got(odd, target)
    expected = brute(rows_of(odd), [r.text for r in target.collect()])
    # rows that tie under one id may swap ranks
    assert sorted(r[:5] for r in rows if r[0]) == sorted(r[:5] for r in expected if r[0])
    assert sorted(r[5] for r in rows if r[5]) == sorted(r[5] for r in expected if r[5])
    assert got(odd, target.limit(0)) and got(none, target) == []
