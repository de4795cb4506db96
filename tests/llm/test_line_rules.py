import re
from collections import Counter, defaultdict

from tablereview.llm import line_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower()


def brute(rows, most_docs, most_share):
    texts = defaultdict(set)
    for _, text, host in rows:
        texts[host].add(text or "")
    held = Counter((h, line) for h, ts in texts.items() for t in ts for line in {normal(x) for x in t.split("\n")} - {""})
    common = {k for k, n in held.items() if n > most_docs and n > most_share * len(texts[k[0]])}
    out = []
    for doc_id, text, host in rows:
        text = text or ""
        w = WORD.findall(text)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        seen, covered = Counter(windows), set()
        for k, x in enumerate(windows):
            if seen[x] > 1:
                covered |= set(range(k, k + 5))
        lines = [x for x in text.split("\n") if WORD.search(x)]
        lost = [len(WORD.findall(x)) for x in text.split("\n") if (host, normal(x)) in common]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        kept = not failed and not (sum(lost) > 0 and len(w) - sum(lost) < 10)
        symbols = sum(c in "#*$%&|<>" for c in text)
        out.append(
            (doc_id, len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed, kept, len(lost))
        )
    return sorted(out, key=str), common


def measured(docs, **limits):
    return sorted([tuple(r)[:9] for r in line_rules.line_rules(docs, **limits).collect()], key=str)


def test_measures_match_brute_force(documents):
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    for limits in ({"most_docs": 20, "most_share": 0.1}, {"most_docs": 1, "most_share": 0.05}):
        expected, common = brute(rows, *limits.values())
        assert measured(documents, **limits) == expected
    assert common


def test_boilerplate_goes(spark):
    line = "Sign up for our  newsletter and never miss another story from us again"
    rows = [(i, f"{line}\nbody words of document {i} that differ from all the others {i}", "h") for i in range(30)]
    rows += [(100 + i, f"{line.upper()}\nshort {i}", "h") for i in range(5)]
    rows += [(200, f"{line}\nelsewhere it is a line like any other", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.text for r in line_rules.drop_rejected(docs).collect()}
    assert set(kept) == {*range(30), 200}
    assert kept[3] == "body words of document 3 that differ from all the others 3"
    assert kept[200].startswith("Sign")
    # copies are one document, so their lines are not boilerplate
    copies = spark.createDataFrame([(i, rows[0][1], "h") for i in range(50)], docs.schema)
    assert line_rules.drop_rejected(copies).count() == 50


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert measured(odd) == brute(rows, 20, 0.1)[0]
    kept = line_rules.drop_rejected(odd)
    assert kept.columns == odd.columns
    assert kept.count() == sum(r[7] for r in brute(rows, 20, 0.1)[0])
    assert measured(none) == [] and line_rules.drop_rejected(none).count() == 0
