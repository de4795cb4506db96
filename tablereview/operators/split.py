"""Exact, reproducible, stratified train/test split without moving the rows.

Rows of a class are ordered by a hash of the seed and the row key, and the
first rows up to the quota of the class form the test set. A histogram of the
leading hash digits finds the digit group in which each class is cut, and only
that group is looked at closely. What comes out is one threshold per class, so
marking the rows is a comparison. Without a key the rows are numbered within
their equals, so that copies of one row fall on both sides. Rows that have equals
are found by counting short hashes and asking a filter of the repeated ones; all
other rows stay where they are.

Classes, quotas and thresholds are tables at any number of classes; they are
written out, so that Spark knows their size when it picks a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tablereview.functions.expressions import col, nan_as_null, row_fingerprint
from tablereview.functions.scratch import store
from tablereview.operators.profile import require_column
from tablereview.operators.ranking import FEW, places

MARK = "_is_test"
GROUP_ROWS = 4096
COPIES = 100_000
#: Of the filter for rows with copies: 262,144 words of 64 bits at most.
FILTER_BITS = 1 << 24


@dataclass(frozen=True)
class Split:
    rows: DataFrame  # the table plus MARK
    classes: DataFrame  # t, n, label: the place of the class in sorted order
    class_count: int
    train_rows: int
    test_rows: int

    def stored(self, rows: DataFrame | None = None) -> Split:
        """The same split with its rows (or rows derived from them) written out,
        train and test apart: fitting and scoring pass over them many times."""
        table = store(self.rows if rows is None else rows, "split", (MARK,))
        return replace(self, rows=table)

    @property
    def train(self) -> DataFrame:
        return self.rows.where(~F.col(MARK)).drop(MARK)

    @property
    def test(self) -> DataFrame:
        return self.rows.where(F.col(MARK)).drop(MARK)


def _classes(df: DataFrame, target: str) -> tuple[DataFrame, Row]:
    """(t, n, label) of each class, and what the checks need to know of them."""
    counted = df.groupBy(col(target).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    placed = places(counted, ["t"], "label")
    classes = placed.select("t", "n", F.col("label").cast("double").alias("label"))
    facts = classes.agg(
        F.count(F.lit(1)).alias("classes"),
        F.count_if(F.col("t").isNull()).alias("missing"),
        F.min("n").alias("least"),
        F.max("n").alias("largest"),
        F.sum("n").alias("total"),
    )
    return classes, facts.first()


def class_quotas(classes: DataFrame, total: int, n_train: int, few: bool = False) -> DataFrame:
    """(t, quota) of the classes with test rows. The train side gets the largest
    remainder shares of ``n_train``; ties go to the earlier class. The ranks of few classes
    come from one window, so nothing is run before the quotas are used."""
    wide = F.col("n").cast("decimal(19,0)") * F.lit(n_train).cast("decimal(19,0)")
    shares = classes.select("t", "n", "label", wide.alias("share")).selectExpr(
        "t", "n", "label", f"share div {total} as whole", f"-(share % {total}) as rest"
    )
    if few:
        all_classes = Window.partitionBy()
        placed = shares.select(
            "*",
            (F.row_number().over(Window.orderBy("rest", "label")) - 1).alias("place"),
            (F.lit(n_train) - F.sum("whole").over(all_classes)).alias("left"),
        )
    else:
        left = n_train - shares.agg(F.sum("whole").alias("s")).first().s
        placed = places(shares, ["rest", "label"], "place").withColumn("left", F.lit(left))
    kept = F.col("whole") + F.when(F.col("place") < F.col("left"), 1).otherwise(0)
    quotas = placed.select("t", (F.col("n") - kept).cast("bigint").alias("quota")).where(F.col("quota") > 0)
    return quotas if few else store(quotas, "quotas")


def _content_hash(df: DataFrame, seed: int) -> Column:
    return F.concat(*[F.lpad(F.hex(h), 16, "0") for h in row_fingerprint(df, seed)])


def _cuts(hashed: DataFrame, quotas: DataFrame, largest: int) -> DataFrame:
    """Per class: the hash at which the quota is reached, how many rows of that
    hash are still taken (``take``) and how many rows have it (``same``).

    ``hashed`` holds (t, h); ``quotas`` holds (t, quota), quota >= 1.
    """
    digits = min(5, max(1, math.ceil(math.log(max(largest / GROUP_ROWS, 1), 16))))
    group = F.substring("h", 1, digits)
    by_group = hashed.groupBy("t", group.alias("g")).agg(F.count(F.lit(1)).alias("n"))
    # at most 16^digits rows per class
    upto = F.sum("n").over(Window.partitionBy("t").orderBy("g"))
    cut_groups = (
        by_group.withColumn("upto", upto)
        .join(quotas, "t")
        .where((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
        .select("t", "g", (F.col("quota") - F.col("upto") + F.col("n")).alias("rest"))
    )
    inside = (
        hashed.withColumn("g", group)
        .join(store(cut_groups, "cut_groups"), ["t", "g"])
        .groupBy("t", "h")
        .agg(F.count(F.lit(1)).alias("n"), F.max("rest").alias("rest"))
    )
    # rows with equal hash are one row here, so this holds ~ rows / 16^digits
    upto = F.sum("n").over(Window.partitionBy("t").orderBy("h"))
    cuts = (
        inside.withColumn("upto", upto)
        .where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")))
        .select(
            "t",
            "h",
            (F.col("rest") - F.col("upto") + F.col("n")).alias("take"),
            F.col("n").alias("same"),
        )
    )
    return store(cuts, "cuts")


def _mark(df: DataFrame, target: str, columns: list[str], cuts: DataFrame) -> DataFrame:
    """``columns`` and MARK, from rows with ``_h``; rows at a cut that is only
    partly taken get NULL."""
    ends = cuts.select(
        F.col("t").alias("_t"), F.col("h").alias("_cut"), (F.col("take") == F.col("same")).alias("_whole")
    )
    joined = df.join(ends, col(target) == F.col("_t"), "left")
    mark = (
        F.when(F.col("_cut").isNull(), False)
        .when(F.col("_h") < F.col("_cut"), True)
        .when(F.col("_h") > F.col("_cut"), False)
        .when(F.col("_whole"), True)
    )
    return joined.select(*[col(c) for c in columns], mark.alias(MARK))


def _copy_filter(df: DataFrame, total: int) -> DataFrame:
    """Stored (_word, _bits): a filter that holds every row with an equal row in ``df``.

    Rows are counted by a short hash, as many bits as let one unique row in 128 share its hash; copies
    are combined before the shuffle, and no more than the hash is shuffled. Hashes found twice set a bit
    each of FILTER_BITS.
    """
    bits = min(63, max(16, total.bit_length() + 7))
    short = F.shiftrightunsigned("_fp1", 64 - bits)
    counted = df.select(row_fingerprint(df)[0]).select(short.alias("_short")).groupBy("_short").count()
    place = F.pmod("_short", F.lit(FILTER_BITS))
    found = counted.where("count > 1").select(*_word_and_bit(place))
    return store(
        found.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")),
        "copy_filter",
    )


def _word_and_bit(place: Column) -> list[Column]:
    return [F.floor(place / 64).cast("int").alias("_word"), (place % 64).cast("int").alias("_bit")]


def _by_filter(df: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(rows without an equal one, rows that may have one); the first have not moved."""
    words = _copy_filter(df, total)
    bits = min(63, max(16, total.bit_length() + 7))
    place = F.pmod(F.shiftrightunsigned("_fp1", 64 - bits), F.lit(FILTER_BITS))
    placed = df.select("*", row_fingerprint(df)[0])
    placed = placed.select(*[col(c) for c in df.columns], *_word_and_bit(place))
    # at most FILTER_BITS / 64 rows of two numbers
    held = placed.join(F.broadcast(words.withColumnRenamed("_word", "_of")), F.col("_word") == F.col("_of"), "left")
    maybe = F.coalesce(F.getbit("_bits", "_bit") == 1, F.lit(False))
    columns = [col(c) for c in df.columns]
    return held.where(~maybe).select(*columns), held.where(maybe).select(*columns)


def _copy_hash(df: DataFrame, seed: int, number: Column) -> Column:
    """A hash of the content of a row and its number among equal rows."""
    return F.md5(F.concat_ws("|", _content_hash(df, seed), number.cast("string"))).alias("_h")


def _hashed_by_content(df: DataFrame, seed: int, total: int) -> DataFrame:
    """The rows of ``df`` and ``_h``. Only rows that may have equals move, and are written out."""
    unique, copies = _by_filter(df, total)
    single = unique.select("*", _copy_hash(df, seed, F.lit(0)))
    return single.unionAll(store(_numbered(copies, seed), "numbered"))


def _numbered(df: DataFrame, seed: int) -> DataFrame:
    """The rows of ``df`` and ``_h``: a hash of content and number among equal rows.

    Equal rows are counted (combined before the shuffle) and written out again;
    a row with very many copies is dealt out in chunks first.
    """
    columns = [col(c) for c in df.columns]
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    few = groups.where(F.col("_n") <= COPIES).select(
        *columns, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("_k")
    )
    chunk = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / COPIES))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.col("_chunk") * COPIES
    many = (
        groups.where(F.col("_n") > COPIES)
        .select("*", F.explode(chunk).alias("_chunk"))
        .repartition(tasks, F.col("_chunk"), F.xxhash64(*columns))
        .select(
            *columns,
            F.explode(F.sequence(first, F.least(first + COPIES, F.col("_n")) - 1)).alias("_k"),
        )
    )
    return few.unionByName(many).select(*columns, _copy_hash(df, seed, F.col("_k")))


def _share_copies(same: DataFrame, target: str, columns: list[str], take: DataFrame) -> DataFrame:
    """Mark exactly ``take`` of the identical rows of each class.

    Identical rows are interchangeable: they are counted (combined before the
    shuffle) and written out again in two steps, so that no task emits more
    than a bounded number of copies per input row.
    """
    groups = same.groupBy(*[col(c) for c in columns]).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(col(target)).orderBy(F.xxhash64(*[col(c) for c in columns]))
    before = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    counted = (
        groups.withColumn("_before", before)
        .join(take, col(target) == F.col("_t"))
        .withColumn(
            "_test", F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_take") - F.col("_before")))
        )
    )
    halves = counted.select(
        *[col(c) for c in columns],
        F.explode(
            F.array(
                F.struct(F.lit(True).alias("m"), F.col("_test").alias("k")),
                F.struct(F.lit(False).alias("m"), (F.col("_n") - F.col("_test")).alias("k")),
            )
        ).alias("_half"),
    ).where(F.col("_half.k") > 0)
    tasks = int(same.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = halves.select(
        "*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_half.k") - 1) / COPIES))).alias("_chunk")
    ).repartition(tasks, "_chunk", "_half")
    size = F.least(F.lit(COPIES), F.col("_half.k") - F.col("_chunk") * COPIES)
    return chunks.select(
        *[col(c) for c in columns],
        F.col("_half.m").alias(MARK),
        F.explode(F.sequence(F.lit(1), size)).alias("_copy"),
    ).drop("_copy")


def stratified_split(
    df: DataFrame,
    target: str,
    test_size: float = 0.2,
    seed: int = 42,
    key: str | None = None,
) -> Split:
    """Split ``df``: ceil(test_size * n) test rows, classes in proportion.

    ``key`` names an identifier column: rows are ordered by
    md5("seed|key"), rows of one key by their content. Without it the content of
    the row and its number among equal rows are the key.
    """
    require_column(df, target)
    df = nan_as_null(df)
    classes, facts = _classes(df, target)
    if facts.missing:
        raise ValueError(f"Target column '{target}' contains missing values.")
    if facts.classes < 2:
        raise ValueError(f"Target column '{target}' needs at least two classes.")
    if facts.least < 2:
        raise ValueError(f"The least populated class in '{target}' has only 1 member.")
    n_test = math.ceil(test_size * facts.total)
    n_train = facts.total - n_test
    if min(n_train, n_test) < facts.classes:
        raise ValueError("The train and test sets must each have one row per class or more.")
    quotas = class_quotas(classes, facts.total, n_train, facts.classes <= FEW)
    if key is None:
        rows = _hashed_by_content(df, seed, facts.total)
    else:
        rows = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), col(key).cast("string"))))
    cuts = _cuts(rows.select(col(target).alias("t"), F.col("_h").alias("h")), quotas, facts.largest)
    marked = _mark(rows, target, df.columns, cuts)
    if not cuts.where("take < same").isEmpty():
        marked = _settle(rows, target, df.columns, _content_hash(df, seed), marked, cuts, facts.largest)
    return Split(marked, classes, facts.classes, n_train, n_test)


def _rows_at(rows: DataFrame, target: str, cuts: DataFrame) -> DataFrame:
    """Rows that share the hash at the cut of their class."""
    at = cuts.select(F.col("t").alias("_t"), F.col("h").alias("_cut"))
    same = (col(target) == F.col("_t")) & (F.col("_h") == F.col("_cut"))
    return rows.join(at, same, "left_semi")


def _settle(
    rows: DataFrame,
    target: str,
    columns: list[str],
    content: Column,
    marked: DataFrame,
    cuts: DataFrame,
    largest: int,
) -> DataFrame:
    """Decide the rows that share the hash at a cut of which only some are taken:
    by content, and equal ones by count."""
    cuts = cuts.where("take < same")
    tied = _rows_at(rows, target, cuts).withColumn("_h", content)
    done = marked.where(F.col(MARK).isNotNull())
    hashed = tied.select(col(target).alias("t"), F.col("_h").alias("h"))
    cuts = _cuts(hashed, cuts.select("t", F.col("take").alias("quota")), largest)
    again = _mark(tied, target, columns, cuts)
    done = done.unionByName(again.where(F.col(MARK).isNotNull()))
    cuts = cuts.where("take < same")
    if cuts.isEmpty():
        return done
    tied = _rows_at(tied, target, cuts)
    take = cuts.select(F.col("t").alias("_t"), F.col("take").alias("_take"))
    return done.unionByName(_share_copies(tied, target, columns, take))
