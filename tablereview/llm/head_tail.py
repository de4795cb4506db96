"""Importance resampling towards a target, with a head-tail vocabulary.

Words and pairs of neighbouring words go to the bucket of their CRC-32. Frequent words come from a
broadcast table with their CRC states, frequent pairs from a broadcast table with their buckets;
every other feature takes its CRC directly, a pair by going on from the state of its first word. So
each feature has its exact bucket, whether it is in the tables or not, and bucket totals are exact.

A document's weight is the floored mean, over its features, of how much more frequent their buckets
are in the target; the greatest sums of weight and Gumbel noise are drawn.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablereview.functions.expressions import col
from tablereview.functions.scratch import store
from tablereview.llm.pieces import blank_table, texts_of, word_pieces
from tablereview.operators.ranking import totals_before

BUCKETS = 10_000
#: Words and pairs with at least 1 / HEAD of all words and pairs are in the tables.
HEAD = 1 << 14
#: A task lowers all its counts by one after each SLACK * HEAD words (pairs), and reports those that
#: are at least 1 / (SLACK * HEAD) of its words. What it misses of a feature is less than 2 / (SLACK *
#: HEAD) of its words, so with SLACK 8 each frequent feature is counted with 3 / 4 of the least count
#: or more, and at most 4 / 3 * HEAD words and as many pairs reach that.
SLACK = 8
#: A task never reports what it has seen less often, which matters for tasks under LEAST_SEEN * SLACK *
#: HEAD words (some 3 MB of text) alone: they may miss more, so that a frequent feature stays in the
#: tail. That costs time and changes no result.
LEAST_SEEN = 4
#: Longer words stay in the tail, so the tables hold 21,845 words and pairs of 129 bytes each at most.
LONGEST = 64
#: Words that are looked up together.
BLOCK = 1 << 18
LEAST_WORDS = 20
PERCENT = 25
SEED = 7

#: Bytes of 0-9, A-Z, a-z and of all code points from 128 on.
TABLE = blank_table([b >= 128 or chr(b).isalnum() for b in range(256)], lower=True)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's frequent words and pairs; "" and " " stand for all its words and all its pairs."""
    counts, seen, since = (Counter(), Counter()), [0, 0], [0, 0]
    for batch in batches:
        for text in texts_of(batch.column("text")):
            before: list[bytes] = []
            for piece in word_pieces(text, TABLE):
                row = before + piece
                for kind, found in enumerate((piece, zip(row, islice(row, 1, None)))):
                    n = len(piece) if kind == 0 else len(row) - 1
                    counts[kind].update(found)
                    seen[kind] += n
                    since[kind] += n
                    if since[kind] >= SLACK * HEAD:
                        lower = {key: k - 1 for key, k in counts[kind].items() if k > 1}
                        counts[kind].clear()
                        counts[kind].update(lower)
                        since[kind] = 0
                before = row[-1:]
    feature, n = ["", " "], seen.copy()
    for kind, name in enumerate((bytes.decode, lambda pair: b" ".join(pair).decode())):
        often = [(key, k) for key, k in counts[kind].items() if k >= max(LEAST_SEEN, seen[kind] / (SLACK * HEAD))]
        feature += [name(key) for key, _ in often]
        n += [k for _, k in often]
    yield pa.RecordBatch.from_arrays([pa.array(feature, pa.string()), pa.array(n, pa.int64())], ["feature", "n"])


def head_features(docs: DataFrame, text_column: str) -> list[str]:
    """Frequent words and pairs of all documents. Their number is bounded, see SLACK; which features
    are in it has no effect on any result."""
    counts = docs.select(col(text_column).cast("string").alias("text")).mapInArrow(_counted, "feature string, n long")
    counts = store(counts.groupBy("feature").agg(F.sum("n").alias("n")), "head_counts")
    totals = {r.feature: r.n for r in counts.filter(F.col("feature").isin("", " ")).collect()}
    # whole numbers of Python: no product of a total that a literal of 32 bits could not hold
    least = {kind: F.lit(-(-3 * totals.get(kind, 0) // (4 * HEAD))) for kind in ("", " ")}
    often = F.col("n") >= F.when(F.col("feature").contains(" "), least[" "]).otherwise(least[""])
    short = F.forall(F.split("feature", " "), lambda w: (F.octet_length(w) > 0) & (F.octet_length(w) <= LONGEST))
    return [r.feature for r in counts.filter(often & short).select("feature").collect()]


class HeadTail:
    """CRC states of frequent words, buckets of frequent pairs, direct CRC for the rest."""

    def __init__(self, head: list[str], buckets: int) -> None:
        words = sorted(f.encode() for f in head if " " not in f)
        self.buckets, self.place = buckets, {w: i for i, w in enumerate(words)}
        # the last entry stands for words that are not in the table
        self.state = np.array([*map(crc32, words), 0], dtype=np.int64)
        self.spaced = np.array([*(crc32(b" ", s) for s in self.state[:-1].tolist()), 0], dtype=np.int64)
        held = {}
        for feature in head:
            first, gap, second = feature.encode().partition(b" ")
            if gap and first in self.place and second in self.place:
                key = self.place[first] * len(self.state) + self.place[second]
                held[key] = crc32(feature.encode()) % buckets
        keys = sorted(held)
        self.pair_keys = np.array([*keys, np.iinfo(np.int64).max], dtype=np.int64)
        self.pair_buckets = np.array([*(held[k] for k in keys), 0], dtype=np.int64)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words, and of each word with the next one."""
        ids = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        state, spaced = self.state[ids], self.spaced[ids]
        tail = np.flatnonzero(ids < 0)
        if len(tail):
            states = [crc32(words[i]) for i in tail.tolist()]
            state[tail] = states
            spaced[tail] = [crc32(b" ", s) for s in states]
        key = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * len(self.state) + ids[1:], -1)
        at = np.searchsorted(self.pair_keys, key)
        pairs = self.pair_buckets[at]
        rest = np.flatnonzero(self.pair_keys[at] != key)
        if len(rest):
            direct = map(crc32, map(words.__getitem__, (rest + 1).tolist()), spaced[rest].tolist())
            pairs[rest] = np.fromiter(direct, np.int64, len(rest)) % self.buckets
        return state % self.buckets, pairs


def feature_blocks(texts: Iterator[bytes], head: HeadTail) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(number of the text, bucket) of all features, a block of words at a time, and the words in it.

    Words come first in a block, pairs after them. A text longer than a block goes on in the next,
    which begins with its last word again, for the pair.
    """
    words: list[bytes] = []
    of: list[tuple[int, int]] = []
    again = 0

    def found() -> tuple[np.ndarray, np.ndarray, int]:
        text = np.repeat(np.array([k for k, _ in of], np.int64), np.array([n for _, n in of], np.int64))
        single, pairs = head(words)
        inside = np.flatnonzero(text[:-1] == text[1:])
        return (
            np.concatenate([text[again:], text[inside]]),
            np.concatenate([single[again:], pairs[inside]]),
            len(words) - again,
        )

    for k, data in enumerate(texts):
        for piece in word_pieces(data, TABLE):
            words += piece
            of.append((k, len(piece)))
            if len(words) >= BLOCK:
                yield found()
                words, of, again = words[-1:], [(k, 1)], 1
    if len(words) > again:
        yield found()


def _totalled(head, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = HeadTail(head.value, buckets)
        totals = np.zeros((2, buckets), dtype=np.int64)
        for batch in batches:
            part = np.array(batch.column("part").to_pylist(), dtype=np.int64)
            for text, bucket, _ in feature_blocks(texts_of(batch.column("text")), tables):
                totals += np.bincount(part[text] * buckets + bucket, minlength=2 * buckets).reshape(2, buckets)
        part, bucket = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(totals[part, bucket])],
            ["part", "bucket", "n"],
        )

    return work


def bucket_totals(docs: DataFrame, target: DataFrame, head, buckets: int, text_column: str) -> np.ndarray:
    """Features in each bucket: row 0 of all documents, row 1 of all target texts."""
    text = col(text_column).cast("string").alias("text")
    rows = docs.select(F.lit(0).alias("part"), text).unionAll(target.select(F.lit(1).alias("part"), text))
    counts = rows.mapInArrow(_totalled(head, buckets), "part int, bucket int, n long")
    totals = np.zeros((2, buckets), dtype=np.int64)
    for r in counts.groupBy("part", "bucket").agg(F.sum("n").alias("n")).collect():
        totals[r.part, r.bucket] = r.n
    return totals


def gains(totals: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed bucket shares, target to documents, rounded down."""
    buckets = totals.shape[1]
    s_all, t_all = (float(x) + buckets for x in totals.sum(axis=1).tolist())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
            for s, t in zip(totals[0].tolist(), totals[1].tolist())
        ],
        dtype=np.int64,
    )


def noise(seed: int, key: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weighed(head, gain: np.ndarray, seed: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = HeadTail(head.value, len(gain))
        for batch in batches:
            n_rows = batch.num_rows
            n_words, n, total = (np.zeros(n_rows, dtype=np.int64) for _ in range(3))
            for text, bucket, words in feature_blocks(texts_of(batch.column("text")), tables):
                n_words += np.bincount(text[:words], minlength=n_rows)
                n += np.bincount(text, minlength=n_rows)
                # whole numbers far below 2^53, so sums in doubles are exact
                total += np.bincount(text, weights=gain[bucket], minlength=n_rows).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            drawn = [noise(seed, key or "") for key in batch.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    *(pa.array(x) for x in (n_words, n, weight, weight + np.array(drawn, dtype=np.int64))),
                ],
                ["id", "n_words", "n_features", "weight", "score"],
            )

    return work


def weigh(
    docs: DataFrame,
    target: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """A stored row (id, n_words, n_features, weight, score) for each document.

    Words are runs of 0-9, A-Z, a-z and code points from 128 on, in lower case as to A-Z. A null or
    wordless text has no features, weight 0 and its noise as score. A null id has the noise of an
    empty id. Rows under one id have one noise. An empty target has smoothed shares; empty documents
    give an empty result. Other columns are not read. Texts of any length are worked through in
    blocks of words.
    """
    session = docs.sparkSession
    head = session.sparkContext.broadcast(head_features(docs, text_column))
    gain = gains(bucket_totals(docs, target, head, buckets, text_column))
    rows = docs.select(
        col(id_column).alias("id"),
        col(id_column).cast("string").alias("key"),
        col(text_column).cast("string").alias("text"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    weighed = rows.mapInArrow(
        _weighed(head, gain, seed), f"id {kind}, n_words long, n_features long, weight long, score long"
    )
    return store(weighed, "weights")


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``weighed`` with ``rank``: 1, 2, 3... of the ``percent`` % greatest scores, else null.

    Of the documents with ``least_words`` words, ties to the smaller id, null ids last. The number of
    distinct scores is bounded by the noise and weights of doubles; a running total over them gives
    every score its first rank, so only rows of one score are sorted together. Noise spreads equal
    weights over scores: at most about 1 in 2,700 of them share one, unless rows share an id.
    """
    able = F.col("n_words") >= least_words
    n = weighed.filter(able).count()
    k = percent * n // 100
    none = F.lit(None).cast("long").alias("rank")
    if not k:
        return weighed.select("*", none)
    counts = weighed.filter(able).groupBy((-F.col("score")).alias("down")).agg(F.count(F.lit(1)).alias("n"))
    firsts = store(totals_before(counts, ["down"], "n", "before").filter(F.col("before") < k), "first_ranks")
    least = -firsts.agg(F.max("down")).first()[0]
    high = able & (F.col("score") >= least)
    within = Window.partitionBy("down").orderBy(F.col("id").asc_nulls_last())
    ranked = (
        weighed.filter(high)
        .join(firsts.select("down", "before"), -F.col("score") == F.col("down"))
        .withColumn("rank", F.col("before") + F.row_number().over(within))
        .select(*weighed.columns, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    )
    return ranked.unionAll(weighed.filter(~high).select("*", none))


def resample_towards(
    docs: DataFrame,
    target: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) for each document; see ``weigh`` and ``draw``."""
    return draw(weigh(docs, target, id_column, text_column, seed=seed), percent, least_words).withColumnRenamed(
        "id", id_column
    )
