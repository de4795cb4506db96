import hashlib
import itertools
import random
import re
from collections import Counter

from tablereview.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return ",".join(
        f"{kind}:{m.start()}:{m.end()}"
        for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text or "")
        if passes(kind, m[0])
    )


def check(docs, at_least):
    expected = sorted(hashlib.sha256(base(r.text).encode()).hexdigest() for r in docs.collect())
    got = pii.digest(pii.scan_personal(docs)).collect()
    assert sorted(r.base_sha256 for r in got) == expected
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) >= at_least
    return got


def test_base_spans_match_brute_force(documents):
    check(documents, 3)


def test_hard_texts(spark):
    texts = [
        "a@b.c_d@e.f a@b x@y..z @q.r a.b@-c.d-.e",
        "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 1.2.3 9999.1.1.1.1",
        "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111 4111  1111 1111 1111",
        "4111 1111 1111 1111 2 and 1 4111111111111111 and 5500-0000-0000-0004x4111111111111111",
        "+1 (555) 555-1234 +12 +1-2-3-4-5-6-7-8-9-0 +1234567890123456 +4 9 ++49 30 123456",
        "é\U0001f600 x@y.org é 10.0.0.1",
        "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20",
    ]
    check(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), 10)


def test_candidates_are_judged(spark):
    rows = [(i, f"reach me by phone 415-555-{1000 + i} or e-mail jo.{i} at example") for i in range(40)]
    rows += [(100 + i, f"see table 3 version 415.555.{1000 + i}") for i in range(40)]
    rows += [(200 + i, f"her ssn 123-45-{6000 + i} is private") for i in range(20)]
    got = {r.doc_id: r.spans for r in check(spark.createDataFrame(rows, "doc_id long, text string"), 0)}
    assert all(got[i].startswith("phone:18:30") for i in range(40))
    assert not any(got[100 + i] for i in range(40))
    assert all(got[200 + i].startswith("national_id:8:19") for i in range(20))


def test_reliabilities_find_the_good_labeler():
    """Three labelers of known accuracy; votes by their exact shares."""
    right = (0.95, 0.8, 0.6)
    counts = {}
    for truth, share in ((1, 4000), (0, 6000)):
        for k in range(8):
            p, votes = share, ""
            for i, r in enumerate(right):
                said = k >> i & 1
                p *= r if said == truth else 1 - r
                votes += "2" if said else "0"
            counts[votes] = counts.get(votes, 0) + round(p)
    truth, trust = pii.reliabilities(counts, (0.8, 0.8, 0.8))
    assert sum(trust[0]) > sum(trust[1]) > sum(trust[2])
    assert truth["222"] > 0.9 > 0.1 > truth["000"]


def test_odd_rows(odd, none):
    check(odd, 4)
    assert pii.scan_personal(none).count() == 0


def test_a_wrong_labeler_is_found_out():
    """Four labelers, one taken to be right in 0.9 of its votes that is right in 0.3 of them."""
    right = (0.9, 0.85, 0.8, 0.3)
    counts = {}
    for truth, share in ((1, 4000), (0, 6000)):
        for votes in itertools.product("210", repeat=4):
            p = share
            for v, r in zip(votes, right):
                p *= 0.2 if v == "1" else 0.8 * (r if (v == "2") == bool(truth) else 1 - r)
            pattern = "".join(votes)
            counts[pattern] = counts.get(pattern, 0) + round(p)
    _, trust = pii.reliabilities(counts, (0.8, 0.8, 0.8, 0.9))
    assert max(trust[3]) < 0.4
    for r, found in zip(right, trust):
        assert abs(found[0] - r) < 0.05 and abs(found[1] - r) < 0.05
    few = {k: 1 for k in list(counts)[:3]}
    assert pii.reliabilities(few, (0.8, 0.8, 0.8, 0.9))[1][3][0] > 0.8


def brute_classifier(rows, before, rounds, belief):
    """Probability of each (votes, features) candidate, with one pass over all candidates for each sum."""
    n = len(rows)
    start = []
    for i, share in enumerate(before):
        q = sum(v[i] != "1" for v, _ in rows) / n
        start.append(({"2": q * share, "1": 1 - q, "0": q - q * share}, {"2": q - q * share, "1": 1 - q, "0": q * share}))
    table, prior = start, 0.5
    for _ in range(rounds):
        truth = []
        for votes, _ in rows:
            yes, no = prior, 1 - prior
            for v, (t, f) in zip(votes, table):
                yes, no = yes * max(t[v], 1e-9), no * max(f[v], 1e-9)
            truth.append(yes / (yes + no))
        prior = (sum(truth) + 1) / (n + 2)
        table = []
        for i, (t0, f0) in enumerate(start):
            t = {v: belief * t0[v] for v in "210"}
            f = {v: belief * f0[v] for v in "210"}
            for (votes, _), p in zip(rows, truth):
                t[votes[i]] += p
                f[votes[i]] += 1 - p
            table.append(({v: x / (sum(truth) + belief) for v, x in t.items()}, {v: x / (n - sum(truth) + belief) for v, x in f.items()}))
    good = []
    for _, features in rows:
        yes, no = 1 + sum(truth), 1 + n - sum(truth)
        for i, value in enumerate(features):
            same = [p for (_, other), p in zip(rows, truth) if other[i] == value]
            yes *= (0.5 + sum(same)) / (1.5 + sum(truth))
            no *= (0.5 + len(same) - sum(same)) / (1.5 + n - sum(truth))
        good.append(yes / (yes + no))
    return good


def test_classifier_matches_brute_force():
    """Every candidate's probability, for candidates drawn from labelers that err."""
    rng = random.Random(11)
    rows = []
    for _ in range(300):
        true = rng.random() < 0.4
        say = lambda right, voting: "1" if rng.random() > voting else "20"[(rng.random() < right) != true]
        votes = say(0.8, 1) + ("2" if rng.random() < (0.5 if true else 0.1) else "1") + say(0.9, 0.3) + say(0.9, 0.2) + "1"
        rows.append((votes, "".join(str(rng.randint(0, 1) + true * (i > 0)) for i in range(4))))
    expected = brute_classifier(rows, tuple(pii.LABELERS.values()), pii.ROUNDS, pii.BELIEF)
    got = pii.span_classifier(Counter(rows))
    assert all(abs(got[features] - p) < 1e-9 for (_, features), p in zip(rows, expected))
    assert 50 < sum(p >= pii.LEAST for p in expected) < 250


def test_names_are_proposed_by_gazetteer_and_context(spark):
    rows = [
        (1, "please contact Anna Schmidt today"),
        (2, "author: Juri Wolkow wrote"),
        (3, "Dear Mr Smith Jones, hello"),
        (4, "we met Peter Kowalski there"),
        (5, "the United States of America"),
        (6, "contact Anna Schmidt and contact Anna Schmidt"),
    ]
    text = pii.F.col("text")
    found = spark.createDataFrame(rows, "id long, text string").select(
        "id", "text", pii.candidate_spans(text, pii.base_spans(text)).alias("c")
    )
    got = {r.id: [r.text[c.start : c.stop] for c in r.c if c.kind == "person"] for r in found.collect()}
    assert got == {
        1: ["Anna Schmidt"],
        2: ["Juri Wolkow"],
        3: ["Mr Smith Jones"],
        4: ["Peter Kowalski"],
        5: [],
        6: ["Anna Schmidt"] * 2,
    }
