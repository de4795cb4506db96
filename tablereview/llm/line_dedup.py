"""Line dedup across documents by sorted hashes, in DataFrame operations only.

Hashes of long lines are range-partitioned and sorted by document and position. The sorted stream
gives each hash its first document (the greatest id) and the number of its documents. Lines of hashes
that stand in enough documents go, but for those of the first one. The answer is a bitmap of kept
lines for each document that loses any; texts are not sent to the lines, nor lines to the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablereview.functions.expressions import col
from tablereview.functions.scratch import store
from tablereview.llm.native import BLANKS, as_row, from_row, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shorter lines always stay.
LEAST_CHARS = 40
#: A line in fewer documents stays everywhere.
LEAST_DOCS = 5
#: The rows of a hash are sorted in so many slices, by document, so that no task has to take all rows
#: of a line that a large part of the documents share.
SLICES = 256
#: Lines for each number of a bitmap.
BITS = 64


def text_row(id_column: str, text_column: str) -> list[Column]:
    """What tells one text from another: its id and a hash (rows under one id may differ)."""
    return [col(id_column).alias("id"), F.xxhash64(text_of(text_column)).alias("text_key")]


def line_keys(text: Column) -> Column:
    """Lines without blanks at the ends, A-Z in lower case."""
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.transform(F.split(lowered, "\n", -1), lambda line: F.trim(line, F.lit(BLANKS)))


def long_lines(docs: DataFrame, id_column: str, text_column: str, least_chars: int) -> DataFrame:
    """A stored row for each long line: 128-bit hash of its key, id, text key and position."""
    lines = F.filter(
        F.transform(
            line_keys(text_of(text_column)),
            lambda line, i: F.when(
                F.length(line) >= least_chars,
                F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"), i.alias("position")),
            ),
        ),
        lambda line: line.isNotNull(),
    )
    rows = docs.select(*text_row(id_column, text_column), F.explode(lines).alias("line"))
    return store(rows.select("line.h1", "line.h2", "id", "text_key", "line.position"), "long_lines")


def streamed(lines: DataFrame) -> DataFrame:
    """(h1, h2, id, place) where a document begins in the sorted rows of a slice of a hash.

    Rows are range-partitioned by hash and slice, and sorted by document, the greatest id first, and
    position. Slices are made from ids, so a document lies in one slice.
    """
    slice_of = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(SLICES)).cast("int").alias("slice")
    order = [F.col("id").desc_nulls_last(), F.col("position")]
    ranged = (
        lines.select("h1", "h2", slice_of, "id", "position")
        .repartitionByRange("h1", "h2", "slice")
        .sortWithinPartitions("h1", "h2", "slice", *order)
    )
    stream = Window.partitionBy("h1", "h2", "slice").orderBy(*order)
    begins = F.row_number().over(stream).alias("place"), F.lag(F.struct("id")).over(stream).alias("last")
    first = F.col("last").isNull() | ~F.col("last.id").eqNullSafe(F.col("id"))
    return ranged.select("h1", "h2", "id", *begins).filter(first).select("h1", "h2", "id", "place")


def common_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """Stored (h1, h2, docs, keeper) of the lines that ``least_docs`` documents hold: the documents that
    begin in the streams of a hash are counted, the greatest of those at place 1 keeps its lines."""
    counts = streamed(lines).groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("docs"), F.max(F.when(F.col("place") == 1, F.col("id"))).alias("keeper")
    )
    return store(counts.filter(F.col("docs") >= least_docs), "common_long_lines")


def keep_bitmaps(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
) -> DataFrame:
    """Stored (id, text_key, n_dropped, keep) of each text that loses lines.

    Bit ``i % 64`` of ``keep[i div 64]`` says whether line ``i`` stays; numbers after the last dropped
    line are left out, as all their lines stay. Rows that repeat a text under one id are one text.
    """
    lines = long_lines(docs, id_column, text_column, least_chars)
    often = common_lines(lines, least_docs)
    dropped = lines.join(often, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("keeper")))
    at = F.col("position")
    words = dropped.groupBy("id", "text_key", F.floor(at / BITS).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, position % {BITS})")).alias("lost")
    )
    maps = words.groupBy("id", "text_key").agg(
        F.sum(F.bit_count("lost")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", "lost"))).alias("words"),
    )
    whole = F.lit(-1).cast("long")
    keep = F.flatten(
        F.transform(
            "words",
            lambda w, i: F.concat(
                F.array_repeat(whole, w["word"] - F.coalesce(F.get("words", i - 1)["word"], F.lit(-1)) - 1),
                F.array(F.bitwise_not(w["lost"])),
            ),
        )
    )
    return store(maps.select("id", "text_key", "n_dropped", keep.alias("keep")), "keep_bitmaps")


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of a text whose bit is set, or that lie beyond the bitmap."""
    return F.array_join(
        F.filter(
            F.split(text, "\n", -1),
            lambda line, i: F.coalesce(
                F.getbit(F.get(keep, F.floor(i / BITS).cast("int")), F.pmod(i, F.lit(BITS))) == 1, F.lit(True)
            ),
        ),
        "\n",
    )


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(row, text, keep, n_dropped) of each row; without dropped lines the last two are null."""
    held = bitmaps.select(F.col("id").alias("of_id"), F.col("text_key").alias("of_key"), "n_dropped", "keep")
    rows = docs.select(as_row(docs).alias("row"), *text_row(id_column, text_column))
    joined = rows.join(held, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")), "left")
    return joined.select("row", "id", "keep", "n_dropped")


def drop_repeated_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length_column: str = "n_chars",
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
) -> DataFrame:
    """The documents with all columns, without the lines that ``keep_bitmaps`` drops.

    Every document stays, with an empty text if all its lines go. A null text stays null. Rows without
    an id are one document, behind all others. Rows that repeat a text under one id lose the same
    lines. ``length_column``, if there is one, gets the new number of code points of a changed text.
    An empty table gives an empty result.
    """
    maps = keep_bitmaps(docs, id_column, text_column, least_chars, least_docs)
    rows = with_bitmaps(docs, maps, id_column, text_column)
    old = F.col("row")[text_column].cast("string")
    changed = F.col("keep").isNotNull()
    rows = rows.select("row", F.when(changed, kept_text(old, F.col("keep"))).alias("shorter"))
    new = {text_column: F.coalesce("shorter", F.col("row")[text_column].cast("string"))}
    if length_column in docs.columns:
        new[length_column] = F.coalesce(F.length("shorter"), F.col("row")[length_column])
    return rows.select(*from_row(docs, **new))


def digest(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
) -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256, keep) of each document.

    A null text is one empty line. ``keep`` is the bitmap, null if no line goes.
    """
    slim = docs.select(col(id_column).alias(id_column), col(text_column).cast("string").alias(text_column))
    rows = with_bitmaps(
        slim, keep_bitmaps(slim, id_column, text_column, least_chars, least_docs), id_column, text_column
    )
    text = F.coalesce(F.col("row")[text_column], F.lit(""))
    left = F.when(F.col("keep").isNull(), text).otherwise(kept_text(text, F.col("keep")))
    n_lines = F.length(text) - F.length(F.translate(text, "\n", "")) + 1
    return rows.select(
        F.col("id").alias(id_column),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.sha2(left, 256).alias("kept_sha256"),
        "keep",
    )
