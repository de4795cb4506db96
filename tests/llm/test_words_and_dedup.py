import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tablereview.llm import dedup, words


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, width):
    w = split(text)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width):
    """Class (least position) of each row, by comparing all that share a shingle."""
    sets = [shingles(text, width) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x]).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for x in s:
            holders[x].append(i)
    return sets, [root(i) for i in range(len(rows))]


def test_word_hashes_follow_the_words():
    texts = ["The the THE", "", None, " a\tb\x0bc\n", "é É ü x", "x" * 3_000_000 + " y", "y"]
    hashes = list(words.word_hashes(pa.array(texts)))
    assert [len(h) for h in hashes] == [len(split(t)) for t in texts]
    seen = {}
    for text, found in zip(texts, hashes, strict=True):
        for word, value in zip(split(text), found.tolist(), strict=True):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("width", [4, 5])
def test_classes_match_brute_force(documents, width):
    rows = [(r.doc_id, r.text) for r in documents.orderBy("doc_id").collect()]
    sets, roots = brute(rows, width)
    got = {r.doc_id: r for r in dedup.near_duplicates(documents, width=width).collect()}
    assert len(got) == len(rows)
    for i, (doc_id, _) in enumerate(rows):
        r = got[doc_id]
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[i]), rows[roots[i]][0], roots[i] == i)


def test_large_group_of_edits(spark):
    """One origin, many edits of it that are seldom alike, some gone too far, in one bucket."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(160):
        text = list(base)
        for at in rng.choice(150, size=int(rng.integers(0, 12)), replace=False):
            text[at] = f"e{rng.integers(0, 40)}"
        rows.append((i, " ".join(text)))
    sets, roots = brute(rows, 4)
    assert len(set(roots)) > 10
    got = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(roots))


def test_odd_rows(odd, none):
    got = dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    same = [r for r in got if r.n_shingles == 10]
    assert len(same) == 4 and {r.component_id for r in same} == {5}
    assert sum(r.kept for r in same) == 1
    assert all(r.kept and r.component_id == r.doc_id for r in got if r.n_shingles == 0)
    kept = dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert kept.count() == 13 - 3
    assert dedup.near_duplicates(none).count() == 0
    assert dedup.drop_near_duplicates(none).count() == 0


def test_estimate_is_corrected(spark):
    shared, own = words.constants(50, 900), words.constants(51, 200)
    a, b = np.unique(shared[:900]), np.unique(np.concatenate([shared[:800], own]))
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    rows = [(dedup.packed(dedup.minima(a)).tolist(), dedup.packed(dedup.minima(b)).tolist())]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    got = df.select(dedup.estimate(df.a, df.b).alias("s"), dedup.estimate(df.a, df.a).alias("one")).first()
    assert got.one == 1.0
    assert abs(got.s - exact) < 0.12
