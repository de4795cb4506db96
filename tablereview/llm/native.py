"""Column expressions shared by the operators that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablereview.functions.expressions import col

#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def text_of(name: str) -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK + "+", -1), lambda word: word != "")


def as_row(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that none can clash with a working column."""
    return F.struct(*[col(c) for c in docs.columns])


def from_row(docs: DataFrame, row: str = "row", **changed: Column) -> list[Column]:
    """The columns of ``docs`` again, some with new values."""
    return [
        (changed[c].cast(docs.schema[c].dataType) if c in changed else F.col(row)[c]).alias(c) for c in docs.columns
    ]


def text_key(text: Column) -> list[Column]:
    """128-bit hash of a text."""
    return [F.xxhash64(text).alias("key1"), F.xxhash64(F.lit(7), text).alias("key2")]


SPAN = "struct<start:int,stop:int,text:string,part:string>"


#: Elements that one aggregate puts together; longer arrays go in blocks of so many.
BLOCK = 64


def combined_before(values: Column, first: Column, combine: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """For each number of an array, ``first`` combined with all numbers before it.

    An aggregate that appends copies what it has at each step. So no aggregate gets more than BLOCK
    numbers, but for the one over the totals of the last level: the work is in proportion to the array.
    """

    def grown(part: Column, start: Column) -> Column:
        state = F.struct(start.cast("int").alias("at"), F.expr("cast(array() AS array<int>)").alias("out"))
        return F.aggregate(
            part,
            state,
            lambda s, x: F.struct(
                combine(s["at"], x).cast("int").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")
            ),
        )

    if not levels:
        return grown(values, first)["out"]

    def in_blocks(held: Column) -> Column:
        last = F.size(held) - 1
        blocks = F.transform(
            F.sequence(F.lit(0), last, F.lit(BLOCK)),
            lambda at: grown(
                F.transform(F.sequence(at, F.least(at + BLOCK - 1, last)), lambda i: F.get(held, i)), first
            ),
        )

        def joined(parts: Column) -> Column:
            totals = F.transform(parts, lambda p: p["at"])
            return let(
                combined_before(totals, first, combine, levels - 1),
                lambda starts: F.flatten(
                    F.transform(parts, lambda p, k: F.transform(p["out"], lambda x: combine(F.get(starts, k), x).cast("int")))
                ),
            )

        return F.when(F.size(held) <= BLOCK, grown(held, first)["out"]).otherwise(let(blocks, joined))

    return let(values, in_blocks)


def matches(text: Column, pattern: str, part: int = 0) -> Column:
    """Leftmost matches that do not overlap, as an array of spans in code points.

    ``part`` names the group whose text goes into the field of that name. The pattern must not
    match an empty string. Without a match the array is empty, and only the search is paid for.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        found.alias("text"),
        (F.regexp_extract_all(text, F.lit(pattern), F.lit(part)) if part else found).alias("part"),
    )

    def placed(held: Column) -> Column:
        lengths = F.transform(held, lambda p: F.length(p["gap"]) + F.length(p["text"]))

        def spans(starts: Column) -> Column:
            def span(p: Column, i: Column) -> Column:
                start = F.get(starts, i) + F.length(p["gap"])
                return F.struct(
                    start.alias("start"),
                    (start + F.length(p["text"])).alias("stop"),
                    p["text"].alias("text"),
                    p["part"].alias("part"),
                )

            return F.transform(held, span)

        return let(combined_before(lengths, F.lit(0), lambda a, x: a + x), spans)

    spans = let(F.filter(pieces, lambda p: p["text"].isNotNull()), placed)
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(f"cast(array() AS array<{SPAN}>)"))


def listed(spans: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))),
        ",",
    )


#: Code points of the pieces that a text is cut into before parts of it are taken out.
PIECE = 4096


def _between(pieces: Column, start: Column, stop: Column) -> Column:
    """Code points from start to before stop (from 0) of a text in pieces; no piece is passed over twice."""
    a, b = F.floor(start / PIECE).cast("int"), F.floor((stop - 1) / PIECE).cast("int")
    tail = F.substr(F.get(pieces, a), start % PIECE + 1, F.lit(PIECE))
    inner = F.array_join(F.transform(F.sequence(a + 1, b - 1), lambda i: F.get(pieces, i)), "")
    return (
        F.when(stop <= start, "")
        .when(a == b, F.substr(F.get(pieces, a), start % PIECE + 1, stop - start))
        .otherwise(
            F.concat(
                tail,
                F.when(b > a + 1, inner).otherwise(""),
                F.substr(F.get(pieces, b), F.lit(1), (stop - 1) % PIECE + 1),
            )
        )
    )


def masked(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """The text with each span (sorted by start) replaced; overlapping spans give one mark.

    The work is in proportion to the text and to PIECE for each span.
    """

    def joined(held: Column, ends: Column, pieces: Column) -> Column:
        marked = F.transform(
            held,
            lambda s, i: F.when(
                s["start"] >= F.get(ends, i), F.concat(_between(pieces, F.get(ends, i), s["start"]), mark(s))
            ),
        )
        last = F.size(held) - 1
        end = F.greatest(F.get(ends, last), F.get(held, last)["stop"])
        rest = _between(pieces, end, F.length(text))
        return F.concat(F.array_join(F.filter(marked, lambda m: m.isNotNull()), ""), rest)

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    changed = let(
        spans,
        lambda held: let(
            combined_before(F.transform(held, lambda s: s["stop"]), F.lit(0), lambda a, x: F.greatest(a, x)),
            lambda ends: let(cut, lambda pieces: joined(held, ends, pieces)),
        ),
    )
    return F.when(F.size(spans) > 0, changed).otherwise(text)
