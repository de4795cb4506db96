"""Near-duplicate documents by b-bit MinHash.

1. A document's words (A-Z lower-cased) make a set of distinct shingles. Documents with the same
   set become one node, found by a 128-bit hash of the set, so copies cost one row each.
2. Each node has MINIMA minima under as many hash functions. Bands of ROWS whole minima are
   hashed; nodes with a band in common are candidates. Of each minimum BITS low bits are kept,
   packed into longs: the share of equal entries, corrected for those that agree by chance,
   estimates the similarity of a candidate pair by bit counts.
3. Pairs whose estimate is within reach of the threshold are confirmed on their full sets.

Buckets are never expanded into all pairs, except those of up to SMALL nodes. In a larger one all
nodes are compared with one pivot, the node that lies in the most and largest buckets: the likely
origin of a group of edits. Buckets whose nodes are one component after that are done. Among the
nodes of the others, pairs of different components are found by their rarest shingles: with the
shingles of all open nodes in one order of falling rarity, two sets that share at least s of their
n and m shingles have one in common among the first n - s + 1 of the one and m - s + 1 of the
other. Here s = t / (1 + t) * (n + m), with m not below the least set in the node's buckets. An
edit that went too far has its first places full of shingles of its own and meets nobody; one that
did not is linked with the origin already. So every pair of nodes with a band in common is
compared, ruled out or connected, whatever the bucket's size.

With 32 bands of 5, a pair of similarity 0.8 shares no band with probability 3e-6, and its estimate
falls short of 0.8 by the margin of 0.2 (six standard deviations) with about 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablereview.functions.expressions import col
from tablereview.functions.scratch import materialize, store
from tablereview.llm import words as W
from tablereview.llm.native import as_row, from_row

WIDTH = 4
THRESHOLD = 80
BANDS = 32
ROWS = 5
MINIMA = BANDS * ROWS
BITS = 4
MARGIN = 0.2
SMALL = 8
#: Shingles whose hash functions are taken at once, which bounds memory for long texts.
BLOCK = 4096

_PER_LONG = 64 // BITS
_FACTORS = (W.constants(1, MINIMA) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (W.constants(2, MINIMA) >> np.uint64(32)).astype(np.uint32)
_BAND_FACTORS = W.constants(3, ROWS)
_BAND_SHIFTS = W.constants(4, BANDS)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    return np.unique(W.runs(words, width))


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128-bit hash of a set of shingles."""
    with np.errstate(over="ignore"):
        n = np.uint64(len(shingles))
        low = W.mix(np.array([shingles.sum(dtype=np.uint64) + n]))
        high = W.mix(np.array([W.mix(shingles ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) - n]))
    return int(high.view(np.int64)[0]), int(low.view(np.int64)[0])


def minima(shingles: np.ndarray) -> np.ndarray:
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(values), BLOCK):
        hashed = _FACTORS[:, None] * values[None, i : i + BLOCK]
        hashed += _SHIFTS[:, None]
        least = np.minimum(least, hashed.min(axis=1))
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS of each minimum, side by side in longs."""
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, _PER_LONG)
    places = np.arange(_PER_LONG, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low << places, axis=1).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        rows = least.astype(np.uint64).reshape(BANDS, ROWS)
        return W.mix((rows * _BAND_FACTORS).sum(axis=1, dtype=np.uint64) + _BAND_SHIFTS).view(np.int64)


def _signatures(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for words in W.word_hashes(batch.column("text")):
                shingles = shingle_set(words, width)
                if len(shingles) == 0:
                    rows.append((0, None, None, None, None))
                    continue
                least = minima(shingles)
                rows.append((len(shingles), *set_key(shingles), packed(least), band_keys(least)))
            n, high, low, signature, bands = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("row"),
                    pa.array(n, pa.int64()),
                    pa.array(high, pa.int64()),
                    pa.array(low, pa.int64()),
                    pa.array(signature, pa.list_(pa.int64())),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["id", "row", "n", "high", "low", "signature", "bands"],
            )

    return work


def _sets(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sets = [], []
            high, low = batch.column("high").to_pylist(), batch.column("low").to_pylist()
            for i, words in enumerate(W.word_hashes(batch.column("text"))):
                shingles = shingle_set(words, width)
                if set_key(shingles) == (high[i], low[i]):
                    node.append(batch.column("node")[i].as_py())
                    sets.append(shingles.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"]
            )

    return work


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: the share of equal entries, less chance agreement."""
    low_bits = F.lit(sum(1 << (BITS * i) for i in range(_PER_LONG)))
    unequal = F.lit(0)
    for i in range(MINIMA // _PER_LONG):
        x = a[i].bitwiseXOR(b[i])
        for step in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        unequal = unequal + F.bit_count(x.bitwiseAND(low_bits))
    chance = 2.0**-BITS
    return ((1 - unequal / MINIMA) - chance) / (1 - chance)


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Connected components of links (a, b): rows (node, component), the component being its least node.

    Every pass takes the least label among neighbours, then that label's own label, so chains
    shorten by half. Each pass is a checkpoint.
    """
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        links.select(F.col("b").alias("src"), F.col("a").alias("dst"))
    )
    found = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near"))
    found = found.select("node", F.least("node", "near").alias("component"))
    if labels is not None:
        found = found.join(labels.withColumnRenamed("component", "had"), "node", "left").select(
            "node", F.least("component", "had").alias("component")
        )
    found = materialize(found)
    while True:
        near = (
            both.join(found, both.src == found.node)
            .groupBy(F.col("dst").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = found.join(near, "node").select(
            "node", F.col("component").alias("had"), F.least("component", "near").alias("via")
        )
        jump = found.select(F.col("node").alias("via"), F.col("component").alias("beyond"))
        step = materialize(
            lower.join(jump, "via", "left").select(
                "node", "had", F.least("via", F.coalesce("beyond", "via")).alias("component")
            )
        )
        changed = step.filter(F.col("had") != F.col("component")).limit(1).count()
        found = step.select("node", "component")
        if not changed:
            return found


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = 5,
    threshold: int = THRESHOLD,
) -> DataFrame:
    """Class of each document under links of at least ``threshold`` percent similarity.

    Returns one row per row of ``docs``: the id, n_shingles (size of the distinct set of runs of
    ``width`` words; all words as one run if there are fewer), component_id (least id reachable)
    and kept (id equals component_id). Links hold when 100 * intersection >= threshold * union.

    Texts that are null or without words have n_shingles 0, are linked with nothing and kept.
    Equal texts are linked. A null id never is a component_id as long as its class has another id; in
    a class without any id component_id is null and all rows are kept. Rows repeated under the id
    that is kept are all marked so. An empty table gives an empty result. Other columns are not read.
    """
    found = _classified(_source(docs, id_column, text_column), width, threshold)
    return found.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id").withColumn(
        "kept", col(id_column).eqNullSafe(F.col("component_id"))
    )


def drop_near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = 5,
    threshold: int = THRESHOLD,
) -> DataFrame:
    """One row of each class that ``near_duplicates`` finds, the one with the least id, with all columns.

    Texts without words all stay, rows with null ids go after the others, and of rows repeated under
    one id a single one stays.
    """
    found = _classified(_source(docs, id_column, text_column), width, threshold)
    kept = found.filter("n = 0 or row = best_row").select(F.col("row").alias("kept_row"), "n").distinct()
    rows = docs.select(as_row(docs).alias("row"), row_key(id_column, text_column).alias("key"))
    rows = rows.join(kept, F.col("key") == F.col("kept_row"))
    # equal rows without words are counted and written out again: a task that runs twice gives the same rows
    content = F.when(F.col("n") == 0, F.xxhash64(F.to_json("row"))).alias("content")
    grouped = rows.groupBy("key", content).agg(F.first("row").alias("row"), F.count(F.lit(1)).cast("int").alias("n"))
    times = F.when(F.col("content").isNull(), F.lit(1)).otherwise(F.col("n"))
    return grouped.select(F.explode(F.array_repeat("row", times)).alias("row")).select(*from_row(docs))


def row_key(id_column: str, text_column: str) -> Column:
    return F.xxhash64(col(id_column), col(text_column).cast("string"))


def _source(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(
        col(id_column).alias("id"),
        col(text_column).cast("string").alias("text"),
        row_key(id_column, text_column).alias("row"),
    )


def _classified(source: DataFrame, width: int, threshold: int) -> DataFrame:
    """(id, n, row, component_id, best_row) for each row of the source."""
    id_type = source.schema["id"].dataType.simpleString()
    signed = store(
        source.mapInArrow(
            _signatures(width),
            f"id {id_type}, row bigint, n bigint, high bigint, low bigint, "
            "signature array<bigint>, bands array<bigint>",
        ),
        "signatures",
    )
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row"))
    nodes = store(
        signed.filter("n > 0")
        .groupBy("high", "low")
        .agg(best.alias("best"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id())
        .withColumn("row", F.col("best.row")),
        "nodes",
    )
    classes = nodes.select("node", "high", "low", "best").join(_link(source, nodes, width, threshold), "node", "left")
    classes = classes.withColumn("component", F.coalesce("component", "node"))
    classes = store(classes, "node_classes")
    least = store(classes.groupBy("component").agg(F.min("best").alias("least")), "least_ids")
    classes = classes.select("component", "high", "low").join(least, "component").select("high", "low", "least")
    has_words = F.col("n") > 0
    return (
        signed.select("id", "n", "row", "high", "low")
        .join(classes, ["high", "low"], "left")
        .select(
            "id",
            "n",
            "row",
            F.when(has_words, F.col("least.id")).otherwise(F.col("id")).alias("component_id"),
            F.when(has_words, F.col("least.row")).otherwise(F.col("row")).alias("best_row"),
        )
    )


def _link(source: DataFrame, nodes: DataFrame, width: int, threshold: int) -> DataFrame:
    """(node, component) of the nodes that have links."""
    bands = nodes.select("node", F.explode("bands").alias("key"))
    # aggregated sides of joins are written first, so that a join can split the rows of a hot key
    shared = store(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "shared")
    members = store(bands.join(shared, "key").select("key", "node", "size"), "members")
    # the node with the most company in all its buckets comes first as a pivot
    company = store(members.groupBy("node").agg(F.sum("size").alias("company")), "company")
    wanted = nodes.join(company.select("node"), "node").select("row", "node", "high", "low")
    sets = store(
        source.select("row", "text")
        .join(wanted, "row")
        .dropDuplicates(["row", "node"])
        .select("node", "high", "low", "text")
        .mapInArrow(_sets(width), "node bigint, shingles array<bigint>"),
        "sets",
    )
    bucket = store(members.join(company, "node"), "buckets")
    signatures = nodes.select("node", "signature")
    if bucket.isEmpty():
        return nodes.select("node", F.col("node").alias("component")).limit(0)
    pivots = store(_pivots(bucket), "pivots")
    pairs = bucket.select("key", "node").join(pivots, "key").filter("node != pivot")
    pairs = pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = store(_confirmed(pairs, signatures, sets, threshold), "links")
    labels = components(links)
    bucket = store(_open(bucket, labels), "open_buckets")
    if bucket.isEmpty():
        return labels
    pairs = _rare_pairs(bucket, sets, labels, threshold)
    more = store(_confirmed(pairs, signatures, sets, threshold), "links")
    return components(links.unionByName(more), labels)


def _pivots(bucket: DataFrame) -> DataFrame:
    """(key, pivot): every node of a small bucket, the one with the most company of a large one."""
    slot = F.when(F.col("size") <= SMALL, F.col("node"))
    return (
        bucket.groupBy("key", slot.alias("slot"))
        .agg(F.max(F.struct("company", "node")).alias("first"))
        .select("key", F.col("first.node").alias("pivot"))
    )


def _open(bucket: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, component) of the large buckets with nodes of two components or more."""
    rest = (
        bucket.filter(F.col("size") > SMALL)
        .select("key", "node")
        .join(labels, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    several = (
        rest.groupBy("key")
        .agg(F.min("component").alias("least"), F.max("component").alias("most"))
        .filter("least != most")
    )
    return rest.join(store(several.select("key"), "several"), "key").select("key", "node", "component")


def _rare_pairs(bucket: DataFrame, sets: DataFrame, labels: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of open nodes of different components that have one of their rarest shingles in common."""
    sizes = sets.select("node", F.size("shingles").alias("n"))
    mates = bucket.join(sizes, "node")
    least = store(mates.groupBy("key").agg(F.min("n").alias("least")), "least")
    part = F.lit(threshold / (100 + threshold))
    smallest = F.greatest(F.min("least"), F.ceil(F.first("n") * threshold / 100))
    first = (
        mates.join(least, "key")
        .groupBy("node")
        .agg(F.first("component").alias("component"), F.first("n").alias("n"), smallest.alias("least"))
        # a hair less, so that rounding never shortens a beginning
        .withColumn("places", F.col("n") - F.ceil(part * (F.col("n") + F.col("least")) - 1e-6) + 1)
    )
    first = store(first, "open_nodes")
    held = store(
        sets.join(first.select("node"), "node").select("node", F.explode("shingles").alias("shingle")), "open_shingles"
    )
    common = store(held.groupBy("shingle").agg(F.count(F.lit(1)).alias("nodes")), "common_shingles")
    rarest = Window.partitionBy("node").orderBy("nodes", "shingle")
    beginning = (
        held.join(common, "shingle")
        .withColumn("place", F.row_number().over(rarest))
        .join(first, "node")
        .filter((F.col("place") <= F.col("places")) & (F.col("nodes") > 1))
        .select("shingle", "node", "component", "n", (F.col("n") - F.col("place") + 1).alias("rest"))
    )
    beginning = store(beginning, "rare_shingles")
    other = beginning.select(
        "shingle",
        F.col("node").alias("b"),
        F.col("component").alias("of_b"),
        F.col("n").alias("n_b"),
        F.col("rest").alias("rest_b"),
    )
    # at their first common shingle, what is left of each set must hold all they need to share
    enough = F.least("rest", "rest_b") >= part * (F.col("n") + F.col("n_b")) - 1e-6
    fits = enough & (F.col("component") != F.col("of_b"))
    return (
        beginning.withColumnRenamed("node", "a")
        .join(other, "shingle")
        .filter(fits & (F.col("a") < F.col("b")))
        .select("a", "b")
        .distinct()
    )


def _confirmed(pairs: DataFrame, signatures: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    def of(table: DataFrame, value: str, side: str) -> DataFrame:
        return table.select(F.col("node").alias(side), F.col(value).alias(f"of_{side}"))

    near = (
        pairs.join(of(signatures, "signature", "a"), "a")
        .join(of(signatures, "signature", "b"), "b")
        .filter(estimate(F.col("of_a"), F.col("of_b")) >= threshold / 100 - MARGIN)
        .select("a", "b")
    )
    return (
        near.join(of(sets, "shingles", "a"), "a")
        .join(of(sets, "shingles", "b"), "b")
        .withColumn("both", F.size(F.array_intersect("of_a", "of_b")))
        .filter(100 * F.col("both") >= threshold * (F.size("of_a") + F.size("of_b") - F.col("both")))
        .select("a", "b")
    )
