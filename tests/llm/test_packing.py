import bisect
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from tablereview.llm import packing


def one_at_a_time(lengths, capacities):
    """Best fit by falling length, one document after the other: final sizes of the bins."""
    room = []
    for length in sorted(lengths, reverse=True):
        k = bisect.bisect_left(room, (length, -1))
        if k < len(room):
            left, size = room.pop(k)
        else:
            size = min(
                (c for c in capacities if c >= length),
                key=lambda c: (packing.sequence_cost(c) / (c // length * length), -c),
            )
            left = size
        bisect.insort(room, (left - length, size))
    return Counter(packing.final_size(size - left, capacities) for left, size in room)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120), st.sampled_from([(64,), (16, 64), (10, 24, 64)]))
def test_plan_is_best_fit(lengths, capacities):
    bins = packing.plan(dict(Counter(lengths)), capacities)
    sizes = Counter()
    held = Counter()
    ranks = set()
    for b in bins:
        assert 0 < b.used <= b.capacity
        sizes[packing.final_size(b.used, capacities)] += b.n
        for length, rank, each, _ in b.visits:
            held[length] += each * b.n
            ranks |= {(length, rank + i) for i in range(each * b.n)}
    assert held == Counter(lengths)
    assert len(ranks) == len(lengths)
    assert sum(sizes.values()) == sum(one_at_a_time(lengths, capacities).values())
    assert sizes == one_at_a_time(lengths, capacities)


def check(rows, lengths):
    assert Counter(r.row for r in rows if r.piece == 0) == Counter({r.row: 1 for r in rows})
    words, bins = Counter(), {}
    for r in rows:
        words[r.doc_id, r.row] += r.n_words
        if r.n_words:
            bins.setdefault(r.bin_id, []).append(r)
        else:
            assert r.bin_id is None
    assert sorted(words.values()) == sorted(lengths)
    for held in bins.values():
        end = 0
        for r in sorted(held, key=lambda r: r.bin_offset):
            assert r.bin_offset == end
            end += r.n_words
        assert {(r.bin_used, r.bin_size) for r in held} == {(end, packing.final_size(end, packing.CAPACITIES))}
    return bins


def test_documents_are_placed(documents):
    lengths = [len(r.text.split()) for r in documents.select("text").collect()]
    bins = check(packing.pack(documents).collect(), lengths)
    pieces = []
    for n in lengths:
        pieces += [4096] * (n // 4096) + ([n % 4096] if n % 4096 else [])
    assert Counter(b[0].bin_size for b in bins.values()) == one_at_a_time(pieces, packing.CAPACITIES)


def test_odd_rows(odd, none):
    check(packing.pack(odd).collect(), [len((r.text or "").split()) for r in odd.collect()])
    assert packing.pack(none).count() == 0
    assert sum(r.n_words for r in packing.pack(odd, length_column="key").collect()) == sum(range(13))
