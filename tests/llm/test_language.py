import math
import random
import re
import time

from tablereview.llm import language


def test_pages_are_told_apart(spark, documents, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    models = language.language_models(documents)
    rows = language.identify(pages, models).collect()
    truth = {r.page_id: re.search(r'<html lang="(\w+)"', r.html)[1] for r in pages.collect()}
    assert len(rows) == len(truth)
    assert sum(r.lang == truth[r.page_id] for r in rows) >= 0.97 * len(rows)
    assert all(0.25 <= r.probability <= 1.0000001 for r in rows)
    bare = pages.selectExpr("page_id", "'x' AS url", "regexp_replace(html, '<html[^>]*>', '') AS html")
    rows = language.identify(bare, models).collect()
    assert sum(r.text_lang == truth[r.page_id] for r in rows) >= 0.9 * len(rows)


def test_evidence_decides_where_the_text_does_not(spark, documents):
    models = language.language_models(documents)
    said = {r.lang: r.text for r in documents.groupBy("lang").agg({"text": "max"}).toDF("lang", "text").collect()}
    rows = [(i, f"http://h.example.{x}/{x}/{i}", f'<html lang="{x}">{said[x]}') for i, x in enumerate(["fr", "de"] * 30)]
    rows += [(900, "http://h.example.fr/1", "<p></p>"), (901, None, None), (902, "nonsense", '<html lang="de">')]
    pages = spark.createDataFrame([(*r, 0.5) for r in rows], "page_id long, url string, html string, by_text double")
    got = {r.page_id: r for r in language.identify(pages, models).collect()}
    assert len(got) == 63
    assert got[900].lang == "fr" and got[902].lang == "de" and got[901].host == ""
    assert language.identify(pages.limit(0), models).count() == 0
    assert {r.lang for r in language.identify(pages, {}).collect()} == {None}


def test_visible_text():
    assert language.visible_text("<style>p{}</style>a<!-- b -->c<b>d</b><script>var t='</p>'") == "a c d"


def test_markup_is_stripped_in_linear_time():
    plain = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>")
    rng = random.Random(6)
    parts = ["<b>", "<", ">", "<!--", "-->", "<script>", "</script >", "<style x", "</STYLE>", "word", " ", "\n", "a<b"]
    for _ in range(5000):
        html = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert language.visible_text(html) == " ".join(plain.sub(" ", html).split())
    start = time.process_time()
    assert language.visible_text("<" * 1_000_000 + " end").endswith("< end")
    assert time.process_time() - start < 5


def test_posterior_matches_brute_force(spark, documents, small):
    """Every sum over pages taken anew in plain Python, odd, long and repeated pages among them."""
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    long = '<html lang="de">' + " ".join(r.text or "" for r in documents.filter("lang = 'de'").limit(60).collect())
    pages += [
        (None, None, None),
        (None, "https://a.b.example.de/de/x", "<p>"),
        (9001, "no address", '<meta http-equiv="content-language" content="fr">'),
        (9002, "http://user@long.example.org:80/en?x", long),
        (9003, "http://odd.example.xx/zz/", '<html lang="zz">words'),
        pages[0],
        pages[0],
    ]
    models = language.language_models(documents)
    langs = sorted(models)
    n = range(len(langs))

    def shares(logs):
        weights = [math.exp(x - max(logs)) for x in logs]
        return [w / sum(weights) for w in weights]

    def told(value):
        return "-" if not value else value if value in langs else "other"

    def first(pattern, text):
        found = re.search(pattern, text)
        return found[1] if found else ""

    rows = []
    for key, url, html in pages:
        url, html = (url or "").lower(), html or ""
        host = first(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url)
        said = first(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b", html)
        said = said or first(r"(?i)<meta\b[^>]*?content-language[^>]*?\bcontent\s*=\s*[\"']?\s*([a-z]{2,3})\b", html)
        text = language.visible_text(html)
        grams = [int(language.trigrams(text[i : i + 3])[0]) for i in range(len(text) - 2)] if key != 9002 else None
        grams = language.trigrams(text) if grams is None else grams
        logs = [sum(models[x][b] for b in grams) * language.TEXT_WEIGHT for x in langs]
        evidence = {
            "declared": told(said.lower()),
            "code": told(first(r"^[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:[/?#-]|$)", url)),
            "suffix": first(r"\.([a-z0-9-]+)$", host),
        }
        rows.append((key, host, first(r"([^.]+\.[^.]+)$", host), evidence, logs, shares(logs)))

    def summed(of):
        return [sum(r[5][i] for r in rows if of(r)) for i in n]

    known, few = language.PRIOR_PAGES, language.SMOOTHING
    of_all = summed(lambda r: True)
    overall = [(x + few) / (sum(of_all) + few * len(langs)) for x in of_all]
    expected = []
    for key, host, domain, evidence, logs, own in rows:
        logs = list(logs)
        for kind, value in evidence.items():
            if value in ("", "-"):
                continue
            sums = summed(lambda r: r[3][kind] == value)  # noqa: B023
            seen = sum(sums) / max(sum(of_all), few)
            for i in n:
                before = seen if kind == "suffix" else 0.5 * seen + 0.5 * (langs[i] == value)
                logs[i] += math.log(max((sums[i] + known * before) / (of_all[i] + known), 1e-9))
        sums = summed(lambda r: r[2] == domain)  # noqa: B023
        of_domain = [(sums[i] + known * overall[i]) / (sum(sums) + known) for i in n]
        sums = summed(lambda r: r[1] == host)  # noqa: B023
        others = [max(sums[i] - own[i], 0.0) for i in n]
        logs = [logs[i] + math.log((others[i] + known * of_domain[i]) / (sum(others) + known)) for i in n]
        posterior = shares(logs)
        expected.append((key or -1, host, evidence["declared"], langs[posterior.index(max(posterior))], max(posterior)))
    got = language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), models).collect()
    got = sorted((r.page_id or -1, r.host, r.declared, r.lang, r.probability) for r in got)
    assert len(got) == len(expected) == len(pages)
    for mine, theirs in zip(sorted(expected), got, strict=True):
        assert mine[:4] == theirs[:4] and abs(mine[4] - theirs[4]) < 1e-6, (mine, theirs)
