import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tablereview.llm import fingerprints as fp


@settings(max_examples=60, deadline=None)
@given(st.text("abé\U0001f600", max_size=40), st.text("abé\U0001f600", max_size=40), st.data())
def test_spans_and_extensions(a, b, data):
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    x, y = fp.PrefixHashes(a), fp.PrefixHashes(b)
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    assert x.common_extension(i, y, j) == n
    length = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    assert x.equal(i, y, j, length) == (a[i : i + length] == b[j : j + length])


def check(rows, got):
    assert len(got) == len(rows)
    prints = {}
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        m = len(text) // 4
        changed = text[: len(text) - m] + after[:m]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert prints.setdefault(changed, r.edited_fingerprint) == r.edited_fingerprint
        assert r.common_edited >= len(text) - m
        assert r.near_next == fp.likeness(fp.Fingerprint(text), fp.Fingerprint(after))
        assert 0 <= r.near_edited <= 1
    assert len(set(prints.values())) == len(prints)


def test_neighbours_match_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in fp.fingerprint_neighbours(documents).collect()}
    check(rows, got)
    alike = [r.near_edited for r in got.values() if r.n_chars > 400]
    assert sum(alike) / len(alike) > 0.7


def test_odd_rows(spark, odd, none):
    got = fp.fingerprint_neighbours(odd).collect()
    assert len(got) == odd.count()
    assert {r.n_chars for r in got if r.doc_id in (1, 2)} == {0}
    assert all(r.near_edited == 1.0 for r in got if r.n_chars == 0)
    assert fp.fingerprint_neighbours(none).count() == 0
    single = spark.createDataFrame([(5, "only one text here")], "doc_id long, text string")
    (r,) = fp.fingerprint_neighbours(single).collect()
    assert r.near_next == 1.0


def test_many_rows_under_one_id(spark):
    rows = [(7, f"text number {i} of many") for i in range(300)] + [(i, f"other {i}") for i in range(20)]
    got = fp.fingerprint_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 320
    assert len({r.fingerprint for r in got}) == 320


@settings(max_examples=60, deadline=None)
@given(st.text("abé", max_size=60), st.text("abé", max_size=40), st.data())
def test_a_changed_end_gives_the_same_fingerprint(a, b, data):
    keep = data.draw(st.integers(0, len(a)))
    changed = fp.Fingerprint(b, fp.Fingerprint(a), keep)
    assert str(changed) == str(fp.Fingerprint(a[:keep] + b))
    assert (changed.windows == fp.Fingerprint(a[:keep] + b).windows).all()


@pytest.mark.parametrize("parts", [64, 200])
def test_every_part_has_a_task_of_its_own(spark, parts):
    rows = [(i, f"text {i * i % 9973} of row {i}, " + "with some more words " * (i % 4)) for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.doc_id: r for r in fp.fingerprint_neighbours(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    check(rows, got)
