import hashlib
import re

from tablereview.llm import secret_scan as ss

# the base patterns as plain regular expressions: kind, pattern, group, least length
PLAIN = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
)


def base(text):
    spans = []
    for place, (kind, pattern, part, least) in enumerate(PLAIN):
        for m in re.finditer(pattern, text or "", re.A):
            if len(m[part]) >= least:
                spans.append((m.start(), place, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def check(docs, at_least):
    texts = [r.text for r in docs.collect()]
    got = ss.digest(ss.scan_secrets(docs)).collect()
    expected = sorted(hashlib.sha256(base(t).encode()).hexdigest() for t in texts)
    assert sorted(r.base_sha256 for r in got) == expected
    assert sum(r.n_assign + r.n_access + r.n_hex for r in got) >= at_least


def test_base_spans_match_brute_force(documents):
    check(documents, 0)


def test_hard_texts(spark):
    texts = [
        "token: secret: abcdefgh12",
        "TOKEN==abcdefgh password = 'x' apikey:\"ABCDEFGH\"",
        "éü\U0001f600 api_key=12345678 " + "0" * 31 + " " + "a" * 32 + "g",
        "AKIAAKIAAKIAAKIA AKIAABCDEFGHIJK AKIAABCDEFGHIJKL",
        "paſſword=abcdefgh ſecret=abcdefgh Secret =  abcdefgh",
        "password=abcdefgh" * 3,
    ]
    check(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), 6)


def test_added_spans_and_redaction(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----"
    text = f"é {key} x ghp_{'Zz' * 18} http://user:pass1234@host/ token=abcdefghij"
    docs = spark.createDataFrame([(1, text, 5), (2, "clean", 5)], "doc_id long, text string, n_chars int")
    spans = ss.digest(ss.scan_secrets(docs)).filter("doc_id = 1").first().spans
    assert [s.split(":")[0] for s in spans.split(",")] == ["private_key", "forge", "login", "assign"]
    start, stop = map(int, spans.split(",")[0].split(":")[1:])
    assert text[start:stop] == key
    rows = {r.doc_id: r for r in ss.redact_secrets(docs).collect()}
    assert rows[1].text == "é [private_key] x [forge] http[login]host/ [assign]"
    assert rows[1].n_chars == len(rows[1].text)
    assert (rows[2].text, rows[2].n_chars) == ("clean", 5)


def test_trigram_queries_are_necessary():
    samples = {
        "assign": ["API_KEY=12345678", "apikey:12345678", 'passwd" = x', "Secret:y", "token=z", "password=1"],
        "access": ["AKIA" + "A" * 12],
        "forge": ["ghs_" + "a" * 36],
        "login": ["://ab:cdef@"],
        "payment": ["rk_live_" + "a" * 16],
        "private_key": ["-----BEGIN PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----"],
    }
    rules = {r.kind: r for r in ss.RULES}
    for kind, texts in samples.items():
        query = ss.trigram_query(rules[kind].pattern)
        for text in texts:
            assert re.search(rules[kind].pattern, text)
            assert any(all(g in text.lower() for g in clause) for clause in query)
    assert ss.trigram_query("[0-9a-f]{32,}") is None
    assert ss.trigram_query("abc?d|xyz") == [["abc", "bcd"], ["abd"], ["xyz"]]


def test_odd_rows(odd, none):
    check(odd, 5)
    clean = ss.redact_secrets(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert sum(r.text is None for r in clean.collect()) == sum(r.text is None for r in odd.collect())
    assert ss.scan_secrets(none).count() == 0
