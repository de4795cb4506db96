"""Secret scanning through a trigram inverted index, in DataFrame operations only.

From each rule's regular expression the trigrams are derived that every match must contain, as
alternatives of which one must hold entirely. The index lists, for each trigram of the rules, the
texts that contain it. Intersecting the lists gives each rule's candidates, and only on those is
the expression run. Rules without a mandatory trigram run on every text.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablereview.functions.expressions import col
from tablereview.functions.scratch import store
from tablereview.llm.native import SPAN, as_row, from_row, listed, masked, matches, text_key, text_of

#: Alternatives of a rule beyond this number are given up for "anything".
MOST_ALTERNATIVES = 256
_GAP = "\0"


@dataclass(frozen=True)
class Rule:
    """A match counts if the text of group ``part`` has ``least`` characters."""

    kind: str
    pattern: str
    part: int = 0
    least: int = 1
    base: bool = False


# Patterns of the base kinds. Long enough runs are asked for in the pattern where that
# finds the same spans, as for whole runs of one class.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        part=2,
        least=8,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
)
ADDED_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"://[A-Za-z0-9._%+-]{1,64}:[^\x20\x09-\x0D/:@]{4,64}@"),
)
RULES = BASE_RULES + ADDED_RULES


def _alternatives(items) -> list[str]:
    """Strings, with gaps for anything, one of which every match of the parsed items fits, in lower case."""
    out = [""]
    for op, value in items:
        if op is rc.LITERAL:
            more = [chr(value).lower()]
        elif op is rc.IN:
            more = _class(value)
        elif op is rc.BRANCH:
            more = [x for branch in value[1] for x in _alternatives(branch)]
        elif op is rc.SUBPATTERN:
            more = _alternatives(value[-1])
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
            least, most, inner = value
            once = _alternatives(inner)
            if (least, most) == (0, 1):
                more = ["", *once]
            elif least == 0 or len(once) > 8:
                more = [_GAP]
            else:
                more = [x + _GAP for x in once]
        elif op in (rc.AT, rc.ASSERT, rc.ASSERT_NOT):
            more = [""]
        else:
            more = [_GAP]
        out = list(dict.fromkeys(x + y for x in out for y in more))
        if len(out) > MOST_ALTERNATIVES:
            out = list(dict.fromkeys(x + _GAP for x in _short(out)))
    return out


def _short(alternatives: list[str]) -> list[str]:
    """A common beginning only, where there are too many ends."""
    n = min(len(x) for x in alternatives)
    while len({x[:n] for x in alternatives}) > MOST_ALTERNATIVES // 4:
        n -= 1
    return list(dict.fromkeys(x[:n] for x in alternatives))


def _class(items) -> list[str]:
    found: set[str] = set()
    for op, value in items:
        if op is rc.LITERAL:
            found.add(chr(value).lower())
        elif op is rc.RANGE and value[1] - value[0] < 8:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return [_GAP]
    return sorted(found) if len(found) <= 8 else [_GAP]


def trigram_query(pattern: str) -> list[list[str]] | None:
    """Alternatives of trigrams, one of which a lower-cased matching text has entirely; None if any text may match."""
    clauses = []
    for fits in _alternatives(rp.parse(pattern)):
        parts = fits.split(_GAP)
        clauses.append(frozenset(p[i : i + 3] for p in parts for i in range(len(p) - 2)))
    if not all(clauses):
        return None
    least = [c for c in set(clauses) if not any(other < c for other in clauses)]
    return sorted(sorted(c) for c in least)


def index_trigrams(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, key1, key2): which of the trigrams each lower-cased text contains."""
    low = texts.select("key1", "key2", F.lower("text").alias("low"))
    held = F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in trigrams])
    return low.select("key1", "key2", F.explode(F.array_compact(held)).alias("trigram"))


def candidates(spark: SparkSession, postings: DataFrame, queries: dict[str, list[list[str]]]) -> DataFrame:
    """(key1, key2, rules): for each text the rules of which it has all trigrams of an alternative."""
    wanted = [
        (kind, i, gram, 1 << place, (1 << len(clause)) - 1)
        for kind, clauses in queries.items()
        for i, clause in enumerate(clauses)
        for place, gram in enumerate(clause)
    ]
    clauses = spark.createDataFrame(wanted, "rule string, clause int, trigram string, bit bigint, full bigint")
    return (
        postings.join(F.broadcast(clauses), "trigram")
        .groupBy("key1", "key2", "rule", "clause", "full")
        .agg(F.bit_or("bit").alias("bits"))
        .filter("bits = full")
        .groupBy("key1", "key2")
        .agg(F.collect_set("rule").alias("rules"))
    )


def _kind_spans(rule: Rule, place: int, indexed: bool) -> Column:
    """Spans of one rule in the column text, with the rule's place and kind."""
    spans = F.filter(matches(F.col("text"), rule.pattern, rule.part), lambda s: F.length(s["part"]) >= rule.least)
    if indexed:
        asked = F.array_contains(F.coalesce("rules", F.array(F.lit(""))), rule.kind)
        spans = F.when(asked, spans).otherwise(F.expr(f"cast(array() AS array<{SPAN}>)"))
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(place).alias("place"),
            s["stop"].alias("stop"),
            F.lit(rule.kind).alias("kind"),
            F.lit(rule.base).alias("base"),
        ),
    )


def _with_spans(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds ``spans``, sorted by start and then in the order of the rules, to rows with text, key1, key2."""
    spark = rows.sparkSession
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    indexed = {kind: query for kind, query in queries.items() if query}
    if indexed:
        grams = sorted({g for query in indexed.values() for clause in query for g in clause})
        # written first: few texts have candidates, and Spark knows how few when it picks the join
        found = store(candidates(spark, index_trigrams(rows, grams), indexed), "secret_candidates")
        found = found.select(F.col("key1").alias("of1"), F.col("key2").alias("of2"), "rules")
        rows = rows.join(found, (F.col("key1") == F.col("of1")) & (F.col("key2") == F.col("of2")), "left")
    kinds = [_kind_spans(rule, place, rule.kind in indexed) for place, rule in enumerate(rules)]
    return rows.withColumn("spans", F.sort_array(F.concat(*kinds)))


def scan_secrets(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """(id, spans) for each document; a span is start, place of its rule, stop, kind and whether a base kind.

    Positions are code points, the stop exclusive. A null text is empty and has no spans. Equal texts
    share their postings; each row gets its spans. Other columns are not read; an empty table gives
    an empty result.
    """
    text = text_of(text_column)
    rows = docs.select(col(id_column).alias("id"), text.alias("text"), *text_key(text))
    return _with_spans(rows, rules).select(F.col("id").alias(id_column), "spans")


def redact_secrets(
    docs: DataFrame, text_column: str = "text", length_column: str = "n_chars", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """The documents with every secret replaced by its kind in brackets, with all columns.

    ``length_column``, if there is one, gets the new number of code points where a text changes.
    Texts without secrets, null ones too, stay as they are.
    """
    text = text_of(text_column)
    rows = docs.select(as_row(docs).alias("row"), text.alias("text"), *text_key(text))
    rows = _with_spans(rows, rules)
    clean = masked(F.col("text"), F.col("spans"), lambda s: F.concat(F.lit("["), s["kind"], F.lit("]")))
    hit = F.size("spans") > 0
    rows = rows.select("row", F.when(hit, clean).alias("clean"))
    changed = {text_column: F.coalesce("clean", F.col("row")[text_column])}
    if length_column in docs.columns:
        changed[length_column] = F.coalesce(F.length("clean"), F.col("row")[length_column])
    return rows.select(*from_row(docs, **changed))


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the SHA-256 of their list and the list of all spans."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        id_column,
        *[count(rule.kind) for rule in BASE_RULES],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
