"""Quality rules with cross-document line frequency, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablereview.functions.expressions import col
from tablereview.functions.scratch import store
from tablereview.llm.native import BLANKS, as_row, from_row, let, text_key, text_of, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
#: A line is boilerplate on a host when more documents than both of these have it.
MOST_DOCS = 20
MOST_SHARE = 0.10


def repeated_words(hashes: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more; takes the hashes of the words."""
    none = F.expr("cast(array() AS array<bigint>)")
    windows = let(
        hashes,
        lambda w: F.when(
            F.size(w) >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
            ),
        ).otherwise(none),
    )

    def covered(at: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.size(at) - 1),
            F.lit(0).cast("long"),
            lambda n, k: n + F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - F.get(at, k), F.lit(WINDOW))),
        )

    def repeated(ordered: Column) -> Column:
        marked = F.transform(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda k: F.when(
                F.coalesce(F.get(ordered, k - 1)["hash"] == F.get(ordered, k)["hash"], F.lit(False))
                | F.coalesce(F.get(ordered, k + 1)["hash"] == F.get(ordered, k)["hash"], F.lit(False)),
                F.get(ordered, k)["at"],
            ),
        )
        return let(F.sort_array(F.filter(marked, lambda at: at.isNotNull())), covered)

    def counted(w: Column) -> Column:
        places = F.transform(w, lambda h, i: F.struct(h.alias("hash"), i.alias("at")))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(places), repeated)
        )

    return let(windows, counted)


def normal_lines(text: Column) -> Column:
    """Lines of a text, lower-cased, with single spaces and none at the ends; blank ones stay, empty."""
    plain = F.lower(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "))
    return F.transform(F.split(plain, "\n", -1), lambda line: F.trim(line))


def base_measures(text: Column) -> list[Column]:
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.translate(line, BLANKS, "") != "")
    return [
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(
            F.transform(words_of(text), lambda w: F.xxhash64(w)),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")),
        ).alias("counted"),
    ]


def measured(docs: DataFrame, id_column: str | None, text_column: str, host_column: str) -> DataFrame:
    """A stored row for each document: its measures, its text's key, hash and words of its lines."""
    identity = col(id_column) if id_column else F.lit(0)
    source = docs.select(
        identity.alias("id"), text_of(text_column).alias("text"), col(host_column).cast("string").alias("host")
    )
    lines = F.transform(
        F.filter(normal_lines(F.col("text")), lambda line: line != ""),
        lambda line: F.struct(
            F.xxhash64(line).alias("line"), (F.length(line) - F.length(F.translate(line, " ", "")) + 1).alias("words")
        ),
    )
    return store(
        source.select("id", "host", *text_key(F.col("text")), *base_measures(F.col("text")), lines.alias("lines")),
        "line_measures",
    )


def common_lines(measures: DataFrame, most_docs: int, most_share: float) -> tuple[DataFrame, DataFrame]:
    """Distinct documents of each host, and the (host, line) that more of them have than allowed.

    Equal texts on a host count as one document, a line repeated in a document once.
    """
    texts = store(
        measures.groupBy("host", "key1", "key2").agg(F.first("lines").alias("lines")),
        "distinct_documents",
    )
    sizes = texts.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    lines = texts.select("host", F.explode(F.array_distinct(F.col("lines.line"))).alias("line"))
    often = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_docs)
    often = often.join(sizes.withColumnRenamed("host", "of_host"), F.col("host").eqNullSafe(F.col("of_host")))
    often = store(often.filter(F.col("n") > most_share * F.col("docs")).select("host", "line"), "common_lines")
    return texts, often


def _lost(texts: DataFrame, often: DataFrame) -> DataFrame:
    """Common lines and their words in each distinct document that has any."""
    often = often.select(F.col("host").alias("of_host"), F.col("line").alias("of_line"))
    return (
        texts.select("host", "key1", "key2", F.explode("lines").alias("at"))
        .select("host", "key1", "key2", "at.line", "at.words")
        .join(often, F.col("host").eqNullSafe(F.col("of_host")) & (F.col("line") == F.col("of_line")))
        .groupBy(F.col("host").alias("of_host"), F.col("key1").alias("of_key1"), F.col("key2").alias("of_key2"))
        .agg(
            F.sum("words").alias("lost_words"),
            F.count(F.lit(1)).alias("lost_lines"),
            F.collect_set("line").alias("common"),
        )
    )


def _same_text() -> Column:
    return (
        F.col("host").eqNullSafe(F.col("of_host"))
        & (F.col("key1") == F.col("of_key1"))
        & (F.col("key2") == F.col("of_key2"))
    )


def line_rules(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
    most_docs: int = MOST_DOCS,
    most_share: float = MOST_SHARE,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """Measures and verdict of each document.

    A line (lower-cased, blanks collapsed) that stands in more than ``most_docs`` distinct documents
    of a host and in more than ``most_share`` of them is boilerplate there. A document is kept if it
    passes the base rules and has ``least_words`` words left without boilerplate lines.

    A null text is an empty text: all counts 0, base_failed true. Rows without a host make one host.
    Equal or repeated rows count once in the frequencies and get a row each. Other columns are not
    read; an empty table gives an empty result.
    """
    measures = measured(docs, id_column, text_column, host_column)
    lost = _lost(*common_lines(measures, most_docs, most_share)).drop("common")
    n_words, repeated = F.col("counted.n_words"), F.col("counted.n_repeat_words")
    failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
    left = n_words - F.coalesce("lost_words", F.lit(0))
    depleted = F.coalesce(F.col("lost_words") > 0, F.lit(False)) & (left < least_words)
    return measures.join(lost, _same_text(), "left").select(
        F.col("id").alias(id_column),
        n_words.alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeated.alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
        F.coalesce("lost_lines", F.lit(0)).cast("long").alias("n_common_lines"),
        left.cast("long").alias("n_words_left"),
    )


def drop_rejected(
    docs: DataFrame,
    text_column: str = "text",
    host_column: str = "source",
    length_column: str = "n_chars",
    most_docs: int = MOST_DOCS,
    most_share: float = MOST_SHARE,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """The documents that ``line_rules`` keeps, without their boilerplate lines, with all columns.

    Rejected documents go. In the others each boilerplate line goes with its line feed, and
    ``length_column``, if there is one, gets the new number of code points; a document without such
    lines stays as it is. Nulls, repeated rows and empty tables are treated as by ``line_rules``.
    """
    measures = measured(docs, None, text_column, host_column)
    texts, often = common_lines(measures, most_docs, most_share)
    lost = _lost(texts, often)
    n_words, repeated = F.col("counted.n_words"), F.col("counted.n_repeat_words")
    good = measures.filter((n_words >= LEAST_WORDS) & (100 * repeated <= MOST_REPEATED * n_words))
    good = good.groupBy("host", "key1", "key2").agg(F.first(n_words).alias("n_words"))
    verdict = (
        good.join(lost, _same_text(), "left")
        .filter(F.col("lost_words").isNull() | (F.col("n_words") - F.col("lost_words") >= least_words))
        .select(F.col("host").alias("of_host"), F.col("key1").alias("of_key1"), F.col("key2").alias("of_key2"), "common")
    )
    rows = docs.select(
        as_row(docs).alias("row"),
        text_of(text_column).alias("text"),
        col(host_column).cast("string").alias("host"),
        *text_key(text_of(text_column)),
    ).join(verdict, _same_text())
    pairs = F.arrays_zip(
        F.split(F.col("text"), "\n", -1).alias("line"),
        F.transform(normal_lines(F.col("text")), lambda x: F.when(x != "", F.xxhash64(x))).alias("hash"),
    )
    stays = F.filter(
        pairs, lambda p: p["hash"].isNull() | ~F.array_contains(F.col("common"), F.coalesce(p["hash"], F.lit(0)))
    )
    shorter = F.array_join(F.transform(stays, lambda p: p["line"]), "\n")
    rows = rows.select("row", "common", F.when(F.col("common").isNotNull(), shorter).alias("shorter"))
    changed = {
        text_column: F.when(F.col("common").isNotNull(), F.col("shorter")).otherwise(F.col("row")[text_column])
    }
    if length_column in docs.columns:
        changed[length_column] = F.when(F.col("common").isNotNull(), F.length("shorter")).otherwise(
            F.col("row")[length_column]
        )
    return rows.select(*from_row(docs, **changed))
