"""Quality classification by importance resampling with hashed n-gram models.

Words and pairs of words are hashed to FEATURES buckets. One model counts the buckets over all
documents, the other over documents labelled good. A document's log weight is the mean over its
n-grams of log(target / raw), times LENGTH, so that texts of any length are weighed as if they had
LENGTH n-grams. Log weight plus Gumbel noise, the greatest k of all: a sample without replacement
in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablereview.functions.expressions import col
from tablereview.functions.scratch import store
from tablereview.llm import words as W

FEATURES = 10_000
LENGTH = 100
SMOOTHING = 1.0
SEED = 29
#: The target model is fitted on so many good documents at most, those of the least hashed ids.
TARGET_ROWS = 20_000
CELLS = 4096
FEW = 10_000


def features(words: np.ndarray) -> np.ndarray:
    """Buckets of a text's words and pairs of words."""
    grams = np.concatenate([words, W.runs(words, 2)]) if len(words) > 1 else words
    return (grams % np.uint64(FEATURES)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(FEATURES, dtype=np.int64), np.zeros(FEATURES, dtype=np.int64)
    for batch in batches:
        good = batch.column("good").to_pylist()
        for i, words in enumerate(W.word_hashes(batch.column("text"))):
            counts = np.bincount(features(words), minlength=FEATURES)
            raw += counts
            if good[i]:
                target += counts
    held = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(held), pa.array(raw[held]), pa.array(target[held])], names=["feature", "raw", "target"]
    )


def _weighed(ratio: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = [], []
            for words in W.word_hashes(batch.column("text")):
                found = features(words)
                n.append(len(found))
                weight.append(float(ratio[found].mean()) * LENGTH if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("noise"),
                    pa.array(n, pa.int64()),
                    pa.array(weight, pa.float64()),
                ],
                names=["id", "noise", "n_features", "log_weight"],
            )

    return work


def model_counts(docs: DataFrame, good: DataFrame, id_column: str, text_column: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts over all documents and over those whose ids are in ``good``."""
    rows = docs.select(col(id_column).alias("id"), col(text_column).cast("string").alias("text"))
    rows = rows.join(F.broadcast(good), "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counts = rows.mapInArrow(_counted, "feature long, raw long, target long")
    raw, target = np.zeros(FEATURES), np.zeros(FEATURES)
    for r in counts.groupBy("feature").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r.feature], target[r.feature] = r.raw, r.target
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    def shares(counts: np.ndarray) -> np.ndarray:
        return np.log((counts + SMOOTHING) / (counts.sum() + SMOOTHING * FEATURES))

    return shares(target) - shares(raw)


def gumbel(seed: int, *key: Column) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double")
    return -F.log(-F.log((bits + 0.5) / float(1 << 53)))


def kth_greatest(values: DataFrame, k: int) -> float:
    """The k-th greatest of a column ``value`` without nulls, exactly; counts of cells narrow it down."""
    low, high = values.agg(F.min("value"), F.max("value")).first()
    while True:
        here = values.filter((F.col("value") >= low) & (F.col("value") <= high))
        width = (high - low) / CELLS
        if width <= 0 or low + width <= low:
            return high
        cell = F.least(F.floor((F.col("value") - low) / width), F.lit(CELLS - 1)).cast("int").alias("cell")
        cells = here.groupBy(cell).agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        for r in sorted(cells.collect(), key=lambda r: -r.cell):
            if k <= r.n:
                low, high, n = r.low, r.high, r.n
                break
            k -= r.n
        if low == high:
            return low
        if n <= FEW:
            inside = values.filter((F.col("value") >= low) & (F.col("value") <= high)).collect()
            return sorted((r.value for r in inside), reverse=True)[k - 1]


def resample(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    share: float | None = None,
    seed: int = SEED,
) -> DataFrame:
    """(id, n_features, log_weight, gumbel_key, kept) for each document.

    Kept are the share * n documents of the greatest key; by default ``share`` is the share of label
    1 among labelled rows. The noise is hashed from seed, id and text, so rows repeated under one id
    share their key, and rows with the key of the last one kept are all kept.

    A text that is null or without words has no weight and no key and is not kept. Labels without a
    document, and null labels, have no effect; without any good label all documents weigh alike. An
    empty table gives an empty result. Other columns are not read.
    """
    held = labels.filter(col(label_column).isNotNull() & col(id_column).isNotNull())
    if share is None:
        share = held.agg(F.avg((col(label_column) == 1).cast("double"))).first()[0]
        share = 1.0 if share is None else share
    good = held.filter(col(label_column) == 1).select(col(id_column).alias("id")).distinct()
    good = good.orderBy(F.xxhash64("id"), "id").limit(TARGET_ROWS).withColumn("good", F.lit(True))
    good = store(good, "target_rows")
    ratio = log_ratio(*model_counts(docs, good, id_column, text_column))
    if good.isEmpty():
        ratio = np.zeros(FEATURES)
    text = col(text_column).cast("string")
    rows = docs.select(col(id_column).alias("id"), gumbel(seed, col(id_column), text).alias("noise"), text.alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    weighed = rows.mapInArrow(_weighed(ratio), f"id {id_type}, noise double, n_features long, log_weight double")
    weighed = store(weighed.withColumn("key", F.col("log_weight") + F.col("noise")).drop("noise"), "weights")
    n, keyed = weighed.agg(F.count(F.lit(1)), F.count("key")).first()
    k = min(round(share * n), keyed)
    least = kth_greatest(weighed.select(F.col("key").alias("value")).filter("value is not null"), k) if k else None
    kept = F.coalesce(F.col("key") >= F.lit(least), F.lit(False)) if k else F.lit(False)
    return weighed.select(
        F.col("id").alias(id_column),
        "n_features",
        "log_weight",
        F.col("key").alias("gumbel_key"),
        kept.alias("kept"),
    )
