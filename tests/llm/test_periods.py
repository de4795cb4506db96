import hashlib
import random
import re
import zlib

import numpy as np
from tablereview.llm import periods, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=6):
    """Every period, every stretch."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= 4 * q:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((b, e - b, q) for (b, e), q in found.items() if e - b >= least), key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n or doc_id is None:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def expected(doc_id, words):
    runs = brute(words)
    keep = [True] * len(words)
    for start, length, q in runs:
        keep[start + q : start + length] = [False] * (length - q)
    start, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    return (
        doc_id,
        len(runs),
        start,
        length,
        q,
        1000 * length // q if runs else None,
        sha("".join(f"{a},{n},{p}\n" for a, n, p in runs)),
        sha(" ".join(w for w, k in zip(words, keep) if k)),
    )


def random_words(rng):
    k, w = rng.choice([1, 2, 3, 5, 50]), []
    w = [rng.randrange(k) for _ in range(rng.randrange(200))]
    for _ in range(rng.randrange(4)):
        block = [rng.randrange(k) for _ in range(rng.randrange(1, max(2, len(w) // 3)))]
        if rng.random() < 0.4:  # small periods within a greater one
            block = [rng.randrange(k) for _ in range(rng.randrange(1, 4))] * rng.randrange(1, 9) + block[:3]
        at = rng.randrange(len(w) + 1)
        w[at:at] = block * rng.randrange(2, 9) + block[: rng.randrange(len(block))]
    return w[:400]


def test_all_runs_of_random_words():
    rng = random.Random(5)
    n = 0
    for _ in range(150):
        texts = [random_words(rng) for _ in range(rng.randrange(1, 20))]
        got = periods.runs_of([np.array(w, dtype=np.int64) for w in texts], 6)
        assert got == [brute(w) for w in texts]
        n += sum(map(len, got))
    assert n > 1000


def test_choice_depends_on_the_context_only():
    rng = np.random.default_rng(2)
    words = np.tile(rng.integers(0, 4, 300), 3)
    for scale in (1, 2, 4, 8):
        names = words
        for k in range(scale.bit_length() - 1):
            names = periods.numbered(names[: -(1 << k)], names[1 << k :])[0]
        chosen = periods.selected(names, scale, [])
        n = len(chosen) - 300
        assert (chosen[:n] == chosen[300 : 300 + n]).all()
        assert all(chosen[i : i + scale].any() for i in range(len(chosen) - scale))


def test_long_texts_in_one_pass(spark):
    rng = np.random.default_rng(3)
    noise = [f"w{x}" for x in rng.integers(0, 10_000, 200_000)]
    block = [f"b{x}" for x in rng.integers(0, 50, 30_000)]
    text = " ".join(noise + block * 5 + ["same"] * 100_000 + noise[:1000])
    rows = periods.find_runs(spark.createDataFrame([(1, text), (2, "a " * 10)], "doc_id long, text string")).collect()
    runs = {r.doc_id: r for r in rows}
    assert (200_000, 150_000, 30_000) in {tuple(r) for r in runs[1].runs}
    assert (350_000, 100_000, 1) in {tuple(r) for r in runs[1].runs}
    assert runs[2].collapsed == "a" and runs[1].n_words == 451_000


def test_query_matches_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = sorted(expected(r.doc_id, planted(r.doc_id, WORD.findall(r.text or ""))) for r in docs)
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, small).collect()))
    assert got == want
    assert sum(r[1] > 0 for r in got) > 5


def test_odd_rows(odd, none):
    got = sorted(map(tuple, periods.digest(periods.find_runs(odd)).collect()), key=str)
    assert got == sorted((expected(r.doc_id, WORD.findall(r.text or "")) for r in odd.collect()), key=str)
    assert periods.find_runs(none).count() == 0
    edited = {(r.doc_id, r.text) for r in queries.with_periods(odd).collect() if r.doc_id in (None, 1, 2, 3)}
    assert {(None, None), (1, None)} <= edited
