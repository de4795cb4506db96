"""Best-fit packing of documents into sequences of several permitted lengths.

Best fit in order of falling length only looks at lengths, and lengths are at most the largest
capacity. So the whole corpus is planned from its histogram of lengths, with equal bins held as one
group: a plan of a few entries per length however many documents there are, and exactly the bins
that best fit would fill one document at a time.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablereview.functions.expressions import col
from tablereview.functions.scratch import store
from tablereview.llm.native import text_of

CAPACITIES = (256, 512, 1024, 2048, 4096)
#: Cost of a sequence besides its length, and the length at which attention costs as much as the rest.
OVERHEAD = 16
ATTENTION = 1 << 16
_RANK_BITS = 44


def sequence_cost(capacity: int) -> float:
    return OVERHEAD + capacity + capacity * capacity / ATTENTION


@dataclass
class Bins:
    """Equal bins first, first + 1, ...; visits are (length, first rank, documents a bin, offset)."""

    first: int
    n: int
    capacity: int
    used: int = 0
    visits: list[tuple[int, int, int, int]] = field(default_factory=list)

    def split(self, n: int) -> Bins:
        """Take the first n bins out."""
        head = Bins(self.first, n, self.capacity, self.used, list(self.visits))
        self.visits = [(length, rank + n * each, each, at) for length, rank, each, at in self.visits]
        self.first, self.n = self.first + n, self.n - n
        return head


def plan(
    histogram: dict[int, int],
    capacities: tuple[int, ...] = CAPACITIES,
    cost: Callable[[int], float] = sequence_cost,
) -> list[Bins]:
    """Bins for so many documents of each length, in order of falling length.

    A document goes to the open bin with the least room that holds it. Where there is none, a bin of
    the capacity is opened that costs least for each word when filled with documents of this
    length; of equals, the largest. Ranks count the documents of a length.
    """
    room: list[int] = []
    waiting: dict[int, list[Bins]] = {}
    opened = 0

    def put(bins: Bins) -> None:
        left = bins.capacity - bins.used
        if left not in waiting:
            insort(room, left)
            waiting[left] = []
        waiting[left].append(bins)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(room, length)
            if at < len(room):
                bins = waiting[room[at]].pop()
                if not waiting[room[at]]:
                    del waiting[room.pop(at)]
            else:
                size = min(
                    (c for c in capacities if c >= length), key=lambda c: (cost(c) / (c // length * length), -c)
                )
                bins = Bins(opened, -(-left // (size // length)), size)
                opened += bins.n
            fit = (bins.capacity - bins.used) // length
            full = min(bins.n, left // fit)
            n, each = (full, fit) if full else (1, left)
            if n < bins.n:
                rest, bins = bins, bins.split(n)
                put(rest)
            bins.visits.append((length, rank, each, bins.used))
            bins.used += each * length
            rank, left = rank + n * each, left - n * each
            put(bins)
    return sorted((b for group in waiting.values() for b in group), key=lambda b: b.first)


def final_size(used: int, capacities: tuple[int, ...]) -> int:
    """The least capacity that holds what is in the bin."""
    return min(c for c in capacities if c >= used)


def _placer(bins: list[Bins], capacities: tuple[int, ...]):
    rows = sorted(
        ((length << _RANK_BITS) | rank, each, b.first, at, length, final_size(b.used, capacities), b.used)
        for b in bins
        for length, rank, each, at in b.visits
    )
    table = np.array(rows, dtype=np.int64).reshape(-1, 7)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("n_words").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            none = pa.array(length == 0)
            if len(table):
                wanted = (length << _RANK_BITS) | rank
                hit = table[np.maximum(np.searchsorted(table[:, 0], wanted, side="right") - 1, 0)]
                step = rank - (hit[:, 0] & ((1 << _RANK_BITS) - 1))
                each = np.maximum(hit[:, 1], 1)
                found = [hit[:, 2] + step // each, hit[:, 3] + step % each * hit[:, 4], hit[:, 5], hit[:, 6]]
            else:
                found = [np.zeros(len(length), dtype=np.int64)] * 4
            placed = [pa.array(x, pa.int64()) for x in found]
            placed = [pa.compute.if_else(none, pa.scalar(None, pa.int64()), x) for x in placed]
            keep = [batch.column(c) for c in ("id", "row", "piece", "start_word", "n_words")]
            yield pa.RecordBatch.from_arrays(
                [*keep, *placed],
                names=["id", "row", "piece", "start_word", "n_words", "bin_id", "bin_offset", "bin_size", "bin_used"],
            )

    return work


def pack(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacities: tuple[int, ...] = CAPACITIES,
    cost: Callable[[int], float] = sequence_cost,
    length_column: str | None = None,
) -> DataFrame:
    """Place every document in a sequence.

    Lengths are words (runs of bytes other than space and \\t..\\r), or ``length_column`` if given,
    for lengths in tokens. A document longer than the largest capacity is cut into pieces of that
    capacity and a rest. Returns for each piece the id, row (a number for each row of the input, so
    that repeated rows can be told apart), piece, start_word, n_words, bin_id, bin_offset (where it
    begins in its sequence), bin_size (the least capacity that holds the sequence) and bin_used.

    Equally long documents are ranked by their place in the stored lengths, which carries no
    meaning. A text that is null or without words gives one piece of 0 words without a bin; so does
    a null or negative length. Other columns are not read; an empty table gives an empty result.
    Only the histogram, at most one entry for each length up to the largest capacity, and the plan
    made from it reach the driver.
    """
    spark, largest = docs.sparkSession, max(capacities)
    if length_column:
        length = F.greatest(F.coalesce(col(length_column).cast("long"), F.lit(0)), F.lit(0))
    else:
        length = F.regexp_count(text_of(text_column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    source = docs.select(col(id_column).alias("id"), length.alias("words"))
    source = source.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    last = F.greatest(F.ceil(F.col("words") / largest) - 1, F.lit(0))
    pieces = source.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    start = F.col("piece") * largest
    pieces = store(
        pieces.select(
            "id",
            "row",
            "part",
            "piece",
            start.alias("start_word"),
            F.least(F.lit(largest).cast("long"), F.col("words") - start).alias("n_words"),
        ),
        "pieces",
    )
    counts = store(pieces.groupBy("part", "n_words").agg(F.count(F.lit(1)).alias("n")), "piece_counts")
    lengths = counts.filter("n_words > 0").groupBy("n_words").agg(F.sum("n").alias("n")).collect()
    bins = plan({r.n_words: r.n for r in lengths}, capacities, cost)
    before = Window.partitionBy("n_words").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "n_words", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("part", "n_words").orderBy("row", "piece")
    ranked = (
        pieces.withColumn("rank", F.row_number().over(within).cast("long") - 1)
        .join(offsets, ["part", "n_words"])
        .withColumn("rank", F.col("rank") + F.col("before"))
        .select("id", "row", "piece", "start_word", "n_words", "rank")
    )
    id_type = pieces.schema["id"].dataType.simpleString()
    placed = ranked.mapInArrow(
        _placer(bins, capacities),
        f"id {id_type}, row bigint, piece bigint, start_word bigint, n_words bigint, "
        "bin_id bigint, bin_offset bigint, bin_size bigint, bin_used bigint",
    )
    return placed.withColumnRenamed("id", id_column)
