"""Language of web pages by Bayesian evidence fusion.

Evidence: the text under character trigram models, the language that the markup declares, the
suffix of the address, the language code in its path, and how the pages of the same host are
written. How far a declaration, a suffix or a code can be trusted is counted over all pages from
what their texts say; host priors are smoothed towards the domain and that towards all pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablereview.functions.expressions import col
from tablereview.functions.scratch import store
from tablereview.llm import words as W

BUCKETS = 1 << 14
#: Trigrams of a text are far from independent; their log likelihood counts for so much.
TEXT_WEIGHT = 0.1
#: Pages that what was known before counts for: the share of a value, half of it for a declaration or
#: code that tells the truth; a domain's shares for a host, those of all pages for a domain.
PRIOR_PAGES = 5.0
SMOOTHING = 0.5
NONE = "-"

_FACTORS = W.constants(21, 3)
_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)")
#: A tag that nothing closes runs to the end, so that the end is looked for once and not from every "<".
_MARKUP = re.compile(_HIDDEN.pattern + r"|(?P<tag><[^>]*(?:>|\Z))")


def trigrams(text: str) -> np.ndarray:
    """Buckets of a text's trigrams of lower-cased code points."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        mixed = W.mix(codes[:-2] * _FACTORS[0] + codes[1:-1] * _FACTORS[1] + codes[2:] * _FACTORS[2])
    return (mixed % np.uint64(BUCKETS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for i, text in enumerate(batch.column("text")):
            held = counts.setdefault(langs[i], np.zeros(BUCKETS, dtype=np.int64))
            held += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
    for lang, held in counts.items():
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(held[at])], names=["lang", "bucket", "n"]
        )


def language_models(texts: DataFrame, text_column: str = "text", lang_column: str = "lang") -> dict[str, np.ndarray]:
    """Log share of each trigram bucket in each language, counted over all texts.

    Rows without a text or a language have no effect. One row for each language and bucket comes
    to the driver, however many texts there are.
    """
    rows = texts.select(col(text_column).cast("string").alias("text"), col(lang_column).cast("string").alias("lang"))
    counted = rows.dropna().mapInArrow(_counted, "lang string, bucket long, n long")
    found: dict[str, np.ndarray] = {}
    for r in counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        found.setdefault(r.lang, np.zeros(BUCKETS))[r.bucket] = r.n
    return {
        lang: np.log((n + SMOOTHING) / (n.sum() + SMOOTHING * BUCKETS)) for lang, n in sorted(found.items())
    }


def _without_markup(found: re.Match[str]) -> str:
    tag = found["tag"]
    # behind a tag that is never closed no tag is, but scripts and comments may begin there
    return " " if tag is None or tag.endswith(">") else _HIDDEN.sub(" ", tag)


def visible_text(html: str) -> str:
    return " ".join(_MARKUP.sub(_without_markup, html).split())


def _scored(table: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for html in batch.column("html"):
                found = trigrams(visible_text(html.as_py() or ""))
                scores.append((table[:, found].sum(axis=1) * TEXT_WEIGHT).tolist())
            keep = [c for c in batch.schema.names if c != "html"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(scores, pa.list_(pa.float64()))], names=[*keep, "text_log"]
            )

    return work


def _shares(logs: Column, n: int) -> Column:
    """Probabilities from log weights."""
    greatest = F.array_max(logs)
    total = sum((F.exp(logs[i] - greatest) for i in range(n)), F.lit(0.0))
    return F.array(*[F.exp(logs[i] - greatest) / total for i in range(n)])


def _summed(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("by_text")[i]) for i in range(n)]).alias("sums"))


def identify(
    pages: DataFrame,
    models: dict[str, np.ndarray],
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """(id, lang, probability, text_lang, declared, suffix, host) for each page.

    lang is the language of the greatest posterior, the first in alphabetical order of equals. A page
    does not count in its own host's prior. A null address has the host "" and no suffix; null markup
    is empty, and an empty text favours no language, so that the other evidence decides. Rows repeated
    under one id count and are answered one by one. An empty table gives an empty result; without
    any model lang is null. Other columns are not read.
    """
    langs = sorted(models)
    n = len(langs)
    url = F.lower(F.coalesce(col(url_column).cast("string"), F.lit("")))
    html = F.coalesce(col(html_column).cast("string"), F.lit(""))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    code = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:[/?#-]|$)", 1)
    markup = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b", 1))
    meta = F.lower(
        F.regexp_extract(
            html, r"(?i)<meta\b[^>]*?content-language[^>]*?\bcontent\s*=\s*[\"']?\s*([a-z]{2,3})\b", 1
        )
    )
    known = F.array(*[F.lit(x) for x in langs]) if langs else F.array(F.lit(""))

    def told(value: Column) -> Column:
        return F.when(value == "", NONE).when(F.array_contains(known, value), value).otherwise("other")

    rows = pages.select(
        col(id_column).alias("id"),
        host.alias("host"),
        told(F.when(markup != "", markup).otherwise(meta)).alias("declared"),
        told(code).alias("code"),
        html.alias("html"),
    )
    rows = rows.withColumn("suffix", F.regexp_extract("host", r"\.([a-z0-9-]+)$", 1))
    rows = rows.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    if not langs:
        empty = F.lit(None).cast("string")
        return rows.select(
            F.col("id").alias(id_column),
            empty.alias("lang"),
            F.lit(None).cast("double").alias("probability"),
            empty.alias("text_lang"),
            "declared",
            "suffix",
            "host",
        )
    id_type = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(
        _scored(np.stack([models[x] for x in langs])),
        f"id {id_type}, host string, declared string, code string, suffix string, domain string, text_log array<double>",
    )
    scored = store(scored.withColumn("by_text", _shares(F.col("text_log"), n)), "page_texts")
    everything = scored.agg(*[F.sum(F.col("by_text")[i]).alias(f"s{i}") for i in range(n)]).first()
    pages_of = [max(x or 0.0, 0.0) for x in everything]
    overall = [(x + SMOOTHING) / (sum(pages_of) + SMOOTHING * n) for x in pages_of]
    out = scored
    for kind in ("declared", "code", "suffix"):
        sums = store(_summed(scored, [kind], n), f"by_{kind}")
        seen = sum((F.col("sums")[i] for i in range(n)), F.lit(0.0)) / max(sum(pages_of), SMOOTHING)
        trust = []
        for i, lang in enumerate(langs):
            told_before = seen if kind == "suffix" else 0.5 * seen + 0.5 * (F.col(kind) == lang).cast("double")
            share = (F.col("sums")[i] + PRIOR_PAGES * told_before) / (pages_of[i] + PRIOR_PAGES)
            # what is not said is no evidence
            trust.append(F.when(F.col(kind).isin("", NONE), 0.0).otherwise(F.log(F.greatest(share, F.lit(1e-9)))))
        out = out.join(sums.select(kind, F.array(*trust).alias(f"trust_{kind}")), kind)
    domains = _summed(scored, ["domain"], n)
    domains = store(domains.select("domain", F.array(*_smoothed(F.col("sums"), overall, n)).alias("of_domain")), "domains")
    hosts = _summed(scored, ["host", "domain"], n).join(domains, "domain").select("host", "sums", "of_domain")
    out = out.join(store(hosts, "hosts"), "host")
    others = [F.greatest(F.col("sums")[i] - F.col("by_text")[i], F.lit(0.0)) for i in range(n)]
    total = sum(others, F.lit(0.0)) + PRIOR_PAGES
    logs = [
        F.col("text_log")[i]
        + F.col("trust_declared")[i]
        + F.col("trust_code")[i]
        + F.col("trust_suffix")[i]
        + F.log((others[i] + PRIOR_PAGES * F.col("of_domain")[i]) / total)
        for i in range(n)
    ]
    out = out.withColumn("logs", F.array(*logs)).withColumn("posterior", _shares(F.col("logs"), n))
    names = F.array(*[F.lit(x) for x in langs])

    def best(values: str) -> Column:
        return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))

    return out.select(
        F.col("id").alias(id_column),
        best("posterior").alias("lang"),
        F.array_max("posterior").alias("probability"),
        best("by_text").alias("text_lang"),
        "declared",
        "suffix",
        "host",
    )


def _smoothed(sums: Column, towards: list[float], n: int) -> list[Column]:
    total = sum((sums[i] for i in range(n)), F.lit(0.0)) + PRIOR_PAGES
    return [(sums[i] + PRIOR_PAGES * towards[i]) / total for i in range(n)]
