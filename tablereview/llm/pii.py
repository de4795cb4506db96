"""Personal data by weak supervision, in DataFrame operations only.

Base spans (email, ip, card, phone) are fixed by their patterns. Looser patterns propose further
candidates. On each candidate regex, checksum, gazetteer and context labelers vote yes, no or
nothing. Expectation maximisation over the counts of vote patterns estimates how far each labeler
can be trusted and how likely each pattern is personal data; with these as soft labels a naive
Bayes classifier of span features is fitted, which decides on the candidates.

Votes and features take few values, so their counts are a bounded table (at most 3**5 patterns of
votes times 2 * 3**3 features for each kind); only that table comes to the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablereview.functions.expressions import col
from tablereview.functions.scratch import store
from tablereview.llm.native import listed, matches, text_of

ROUNDS = 50
#: What is assumed of a labeler counts for so many candidates; all others are learned from.
BELIEF = 20.0
LEAST_SHARE = 1e-9
#: Candidates whose probability reaches this are personal data.
LEAST = 0.5
#: Code points before a span that the context labelers read.
CONTEXT = 40

# Patterns of the base kinds. Possessive repeats and the conditions in front only
# spare the search starts that cannot succeed; the spans are those of the plain patterns.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "national_id", "iban", "person")

# Titles, common given and family names, and domains and country codes.
_TITLE = "(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)"
_GIVEN = "Anna|James|John|Maria|Mary|Michael|Peter|Robert"
_FAMILY = "Smith|Johnson|Williams|Brown|Garcia|Martin|Müller|Schmidt|Schneider|Dupont|Bernard|Fernandez|Lopez"
_ENDINGS = "com|org|net|edu|gov|de|fr|es|uk"


@dataclass(frozen=True)
class Candidates:
    kind: str
    pattern: str
    strict: str
    cues: str


# Looser patterns, the form a strict reader asks for, and words that announce a kind.
PROPOSED = (
    Candidates(
        "email",
        r"(?i)\b[a-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\])\x20?[a-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[a-z0-9-]{1,63}){1,4}",
        r"(?i)(?:\.|dot[)\]])\x20?[a-z]{2,}$",
        r"e-?mail|mail|contact|correo|courriel|write",
    ),
    Candidates(
        "phone",
        r"(?<![\w+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])",
        r"^\(?[2-9]",
        r"phone|tel|call|mobile|fax|cell|telefon|fono",
    ),
    Candidates(
        "national_id",
        r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
        r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
        r"ssn|social|security|id\b|identity|insurance",
    ),
    Candidates(
        "iban",
        r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b",
        r"^(?:DE|FR|ES|IT|NL|BE|AT|CH|GB|PT|PL|IE|LU|SE|DK|FI|NO)",
        r"iban|account|bank|konto|cuenta|compte",
    ),
    Candidates(
        "person",
        # after a title; a given name of the gazetteer; two names after a word that announces a person
        rf"\b{_TITLE}\b\.?\x20\p{{Lu}}\p{{L}}+(?:\x20\p{{Lu}}\p{{L}}+)?"
        rf"|\b(?:{_GIVEN})\x20\p{{Lu}}\p{{L}}+\b"
        r"|(?=\p{Lu})(?<=\b(?:[Cc]ontact|[Dd]ear|[Aa]uthor|[Pp]atient|[Nn]ame)(?:\x20is)?:?\x20)\p{Lu}\p{L}+\x20\p{Lu}\p{L}+",
        rf"(?:^|\x20)(?!{_TITLE}\b)\p{{Lu}}\p{{L}}+\x20\p{{Lu}}\p{{L}}+$",
        r"name|dear|by|contact|patient|author",
    ),
)
GAZETTEER = rf"(?i)\b(?:{_GIVEN}|{_FAMILY}|{_ENDINGS})\b"
REFUSED = r"(?i)(?:version|build|serial|order|isbn|issn|page|section|figure|table|no\.|#)[\x20:]*$"

#: Labelers, and in what share of their votes they are taken to be right before any data.
LABELERS = {"strict": 0.6, "gazetteer": 0.7, "announced": 0.9, "refused": 0.95, "placed": 0.9}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of card numbers."""
    places = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(
            F.filter(places, lambda c: c != ""),
            lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
                F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)
            ),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    return total % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the base kinds: struct(place, start, stop, kind), by kind as listed, then start."""
    octets = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
    digits = r"[0-9]"
    found = (
        F.when(F.contains(text, F.lit("@")), matches(text, EMAIL)),
        F.filter(matches(text, IP), lambda s: s["text"].rlike(octets)),
        F.filter(matches(text, CARD), lambda s: luhn(_digits(s["text"]))),
        F.when(
            F.contains(text, F.lit("+")),
            F.filter(
                matches(text, PHONE), lambda s: F.regexp_count(s["text"], F.lit(digits)).between(8, 15)
            ),
        ),
    )
    none = F.expr("cast(array() AS array<struct<place:int,start:int,stop:int,kind:string>>)")
    kinds = [
        F.coalesce(F.transform(spans, _placed(place, kind)), none)
        for place, (kind, spans) in enumerate(zip(BASE_KINDS, found, strict=True))
    ]
    return F.concat(*kinds)


def _placed(place: int, kind: str):
    return lambda s: F.struct(
        F.lit(place).alias("place"), s["start"].alias("start"), s["stop"].alias("stop"), F.lit(kind).alias("kind")
    )


def _vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(yes, F.lit(False)), 2).when(F.coalesce(no, F.lit(False)), 0).otherwise(1)


def _judged(text: Column, proposal: Candidates):
    """A candidate with its votes (2 yes, 1 nothing, 0 no; base-3 digits) and features."""

    def judge(s: Column) -> Column:
        before = F.substr(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT)))
        after = F.substr(text, s["stop"] + 1, F.lit(1))
        strict = s["text"].rlike(proposal.strict)
        announced = before.rlike(rf"(?i)(?:{proposal.cues})[^.\n]*$")
        refused = before.rlike(REFUSED)
        votes = (
            _vote(strict, ~strict),
            _vote(s["text"].rlike(GAZETTEER), F.lit(False)),
            _vote(announced, F.lit(False)),
            _vote(F.lit(False), refused),
            _vote(F.lit(False), after.rlike(r"[\p{L}0-9_@]") | before.rlike(r"[\p{L}0-9_@]$")),
        )
        length = F.length(s["text"])
        digits = F.regexp_count(s["text"], F.lit("[0-9]"))
        features = (
            F.when(strict, 1).otherwise(0),
            F.when(announced, 2).when(refused, 0).otherwise(1),
            F.when(length < 13, 0).when(length < 25, 1).otherwise(2),
            F.when(digits * 3 < length, 0).when(digits * 3 < length * 2, 1).otherwise(2),
        )
        return F.struct(
            F.lit(KINDS.index(proposal.kind)).alias("place"),
            s["start"].alias("start"),
            s["stop"].alias("stop"),
            F.lit(proposal.kind).alias("kind"),
            F.concat(*[v.cast("string") for v in votes]).alias("votes"),
            F.concat(*[v.cast("string") for v in features]).alias("features"),
        )

    return judge


def candidate_spans(text: Column, base: Column) -> Column:
    """Candidates of all proposals that do not touch a base span."""
    judged = [F.transform(matches(text, p.pattern), _judged(text, p)) for p in PROPOSED]
    return F.filter(
        F.concat(*judged),
        lambda c: ~F.exists(base, lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])),
    )


def _start(counts: dict[str, int], share: float, labeler: int) -> dict[bool, dict[str, float]]:
    """Shares of the votes 2, 1, 0 if a labeler that is right in ``share`` of its votes votes as often as it does."""
    total = sum(counts.values())
    voting = sum(n for pattern, n in counts.items() if pattern[labeler] != "1") / total if total else 0.5
    right, wrong = voting * share, voting * (1 - share)
    return {True: {"2": right, "1": 1 - voting, "0": wrong}, False: {"2": wrong, "1": 1 - voting, "0": right}}


def reliabilities(
    counts: dict[str, int], before: tuple[float, ...], rounds: int = ROUNDS, belief: float = BELIEF
) -> tuple[dict[str, float], list[tuple[float, float]]]:
    """Expectation maximisation for votes that are independent given the truth.

    Takes counts of vote patterns (digits 2 yes, 1 nothing, 0 no). Returns the probability of each
    pattern to be true, and for each labeler the share of yes in its votes on the true and of no in
    those on the false. What is estimated are the shares of all three answers, so that a labeler
    that only ever says yes, or only no, can be told from a useless one by whom it passes over. A
    labeler starts out as right in the share ``before`` of its votes; that counts for ``belief``
    candidates, however many there are.
    """
    start = [_start(counts, share, i) for i, share in enumerate(before)]
    prior, answers = 0.5, start
    truth: dict[str, float] = {}
    total = sum(counts.values())
    for _ in range(rounds):
        for pattern in counts:
            odds = math.log(prior / (1 - prior))
            for vote, answer in zip(pattern, answers, strict=True):
                odds += math.log(max(answer[True][vote], LEAST_SHARE) / max(answer[False][vote], LEAST_SHARE))
            truth[pattern] = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
        prior = (sum(n * truth[p] for p, n in counts.items()) + 1) / (total + 2)
        held = {True: {p: n * truth[p] for p, n in counts.items()}, False: {p: n * (1 - truth[p]) for p, n in counts.items()}}
        answers = [
            {
                side: {
                    vote: (sum(n for p, n in found.items() if p[i] == vote) + belief * start[i][side][vote])
                    / (sum(found.values()) + belief)
                    for vote in "210"
                }
                for side, found in held.items()
            }
            for i in range(len(before))
        ]

    def share(of: dict[str, float], vote: str) -> float:
        voting = of["2"] + of["0"]
        return of[vote] / voting if voting else 0.5

    return truth, [(share(a[True], "2"), share(a[False], "0")) for a in answers]


def span_classifier(counts: dict[tuple[str, str], int]) -> dict[str, float]:
    """Probability of each feature pattern, by naive Bayes fitted on the labels that votes give.

    Takes counts of (votes, features).
    """
    by_votes: dict[str, int] = defaultdict(int)
    for (votes, _), n in counts.items():
        by_votes[votes] += n
    truth, _ = reliabilities(dict(by_votes), tuple(LABELERS.values()))
    total = {True: 1.0, False: 1.0}
    held: dict[tuple[bool, int, str], float] = defaultdict(lambda: 0.5)
    for (votes, features), n in counts.items():
        for side, weight in ((True, n * truth[votes]), (False, n * (1 - truth[votes]))):
            total[side] += weight
            for i, value in enumerate(features):
                held[side, i, value] += weight
    out = {}
    for features in {f for _, f in counts}:
        score = math.log(total[True] / total[False])
        for i, value in enumerate(features):
            score += math.log(held[True, i, value] / (total[True] + 0.5))
            score -= math.log(held[False, i, value] / (total[False] + 0.5))
        out[features] = 1 / (1 + math.exp(-max(-700.0, min(700.0, score))))
    return out


def scan_personal(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = LEAST
) -> DataFrame:
    """(id, base, spans) for each document: base spans, and those with the accepted candidates.

    A span is struct(place, start, stop, kind) in code points, the stop exclusive, in order of kind
    and start. A null text is empty and has no spans. Repeated rows each get theirs and count as
    often. An empty table gives an empty result. Other columns are not read.
    """
    text = text_of(text_column)
    rows = docs.select(col(id_column).alias("id"), text.alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    found = store(rows.select("id", "base", candidate_spans(F.col("text"), F.col("base")).alias("candidates")), "spans")
    patterns = (
        found.select(F.explode("candidates").alias("c"))
        .groupBy("c.kind", "c.votes", "c.features")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    by_kind: dict[str, dict[tuple[str, str], int]] = defaultdict(dict)
    for r in patterns:
        by_kind[r.kind][r.votes, r.features] = r.n
    accepted = [
        f"{kind}:{features}"
        for kind, counts in sorted(by_kind.items())
        for features, p in sorted(span_classifier(counts).items())
        if p >= least
    ]
    good = F.filter(
        "candidates", lambda c: F.concat(c["kind"], F.lit(":"), c["features"]).isin(accepted) if accepted else F.lit(False)
    )
    added = F.transform(
        good,
        lambda c: F.struct(c["place"].alias("place"), c["start"].alias("start"), c["stop"].alias("stop"), c["kind"].alias("kind")),
    )
    return found.select(F.col("id").alias(id_column), "base", F.sort_array(F.concat("base", added)).alias("spans"))


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the SHA-256 of their list and the list of all spans."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        id_column,
        *[count(kind) for kind in BASE_KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
