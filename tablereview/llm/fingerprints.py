"""Document fingerprints from prefix polynomial hashes.

For a text of code points c, prefix array i holds the sum of (c[j] + 1) * base**j over j < i, modulo
the prime 2**31 - 1, for two bases. The hash of any span is a difference of two entries, shifted by
an inverse power, so equal spans have equal hashes wherever they stand, and the longest common
extension of two places is found by binary search on the length.

A fingerprint is the hash of the whole text and the SKETCH least scrambled hashes of its windows of
WINDOW code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablereview.functions.expressions import col
from tablereview.llm import words as W

PRIME = (1 << 31) - 1
BASES = (1_732_050_807, 1_414_213_562)
WINDOW = 16
SKETCH = 64
#: Code points a partition of neighbours holds, about, and rows looked at to place its borders.
PARTITION_CHARS = 1 << 28
BORDER_SAMPLE = 16
_NULL_ID = -(1 << 63)

_U = np.uint64
_P = _U(PRIME)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Remainders modulo PRIME of values below 2**62."""
    x = (x & _P) + (x >> _U(31))
    x = (x & _P) + (x >> _U(31))
    return np.where(x >= _P, x - _P, x)


class _Powers:
    def __init__(self, base: int) -> None:
        self.base, self.values = base, np.ones(1, dtype=_U)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            step = _U(pow(self.base, len(self.values), PRIME))
            self.values = np.concatenate([self.values, _reduced(self.values * step)])
        return self.values[:n]


_UP = [_Powers(b) for b in BASES]
_DOWN = [_Powers(pow(b, -1, PRIME)) for b in BASES]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(_U) + _U(1)


class PrefixHashes:
    """Hashes of all spans of a text, each in constant time."""

    def __init__(self, text: str, before: PrefixHashes | None = None, keep: int = 0) -> None:
        """Of ``text``, or of the first ``keep`` code points of ``before`` and then ``text``."""
        codes = _codes(text)
        self.n = keep + len(codes)
        self.prefixes = []
        for i, up in enumerate(_UP):
            terms = codes * up(self.n)[keep:]
            sums = np.empty(self.n + 1, dtype=_U)
            sums[: keep + 1] = before.prefixes[i][: keep + 1] if before else 0
            sums[keep + 1 :] = _reduced(np.cumsum((terms & _P) + (terms >> _U(31))) + sums[keep])
            self.prefixes.append(sums)

    def spans(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """62-bit hashes of many spans."""
        parts = []
        for prefix, down in zip(self.prefixes, _DOWN, strict=True):
            parts.append(_reduced((prefix[stops] + _P - prefix[starts]) * down(self.n + 1)[starts]))
        return (parts[0] << _U(31)) | parts[1]

    def span(self, start: int, stop: int) -> int:
        parts = []
        for prefix, down in zip(self.prefixes, _DOWN, strict=True):
            parts.append((int(prefix[stop]) - int(prefix[start])) * int(down(start + 1)[start]) % PRIME)
        return parts[0] << 31 | parts[1]

    def equal(self, start: int, other: PrefixHashes, other_start: int, length: int) -> bool:
        return self.span(start, start + length) == other.span(other_start, other_start + length)

    def common_extension(self, start: int, other: PrefixHashes, other_start: int) -> int:
        """Length of the longest common run from two places on."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, other_start, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def windows(self, first: int = 0) -> np.ndarray:
        """Scrambled hashes of the windows from a place on, as 32-bit numbers; a short text is one window."""
        width = min(WINDOW, self.n)
        starts = np.arange(first, self.n - width + 1)
        return W.mix(self.spans(starts, starts + width)) >> _U(32)


def _least(windows: np.ndarray) -> np.ndarray:
    """The SKETCH least distinct values, in order."""
    if len(windows) > 8 * SKETCH:
        few = np.unique(windows[windows < _U((1 << 32) * 4 * SKETCH // len(windows))])
        if len(few) >= SKETCH:
            return few[:SKETCH].astype(np.uint32)
    return np.unique(windows)[:SKETCH].astype(np.uint32)


class Fingerprint:
    def __init__(self, text: str, before: Fingerprint | None = None, keep: int = 0) -> None:
        """Of ``text``, or of the first ``keep`` code points of ``before`` and then ``text``."""
        self.hashes = PrefixHashes(text, before.hashes if before else None, keep)
        n = self.hashes.n
        self.whole = self.hashes.span(0, n)
        same = keep - WINDOW + 1 if before and min(n, before.hashes.n) >= WINDOW else 0
        if n == 0:
            self.windows = np.zeros(0, dtype=_U)
        elif same > 0:
            self.windows = np.concatenate([before.windows[:same], self.hashes.windows(same)])
        else:
            self.windows = self.hashes.windows()
        self.least = _least(self.windows)

    def __str__(self) -> str:
        return f"{self.hashes.n:x}-{self.whole:016x}-{self.least.astype('>u4').tobytes().hex()}"


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Share of common windows, estimated from the sketches as 2 J / (1 + J); 1 for equal texts."""
    if (a.hashes.n, a.whole) == (b.hashes.n, b.whole):
        return 1.0
    union = np.union1d(a.least, b.least)[:SKETCH]
    if not len(union) or not len(a.least) or not len(b.least):
        return 0.0
    both = len(np.intersect1d(np.intersect1d(union, a.least), b.least))
    j = both / len(union)
    return 2 * j / (1 + j)


_FIELDS = (
    ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()),
    ("near_next", pa.float64()),
    ("common_edited", pa.int64()),
    ("common_next", pa.int64()),
)


def _compared(text: str, own: Fingerprint, after: str, following: Fingerprint) -> tuple:
    # the last quarter gives way to as much of the beginning of the next text
    quarter = len(text) // 4
    keep = len(text) - quarter
    changed = text[:keep] + after[:quarter]
    other = Fingerprint(after[:quarter], own, keep)
    return (
        own.hashes.n,
        hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
        str(own),
        str(other),
        likeness(own, other),
        likeness(own, following),
        own.hashes.common_extension(0, other.hashes, 0),
        own.hashes.common_extension(0, following.hashes, 0),
    )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition in order; the last one only is there to follow the one before."""
    last = None
    for batch in batches:
        ids, rows = [], []
        for i, text in enumerate(batch.column("text")):
            text = text.as_py()
            own = Fingerprint(text)
            if last is not None:
                ids.append(last[0])
                rows.append(_compared(last[1], last[2], text, own))
            extra = batch.column("extra")[i].as_py()
            last = None if extra else (batch.column("id")[i].as_py(), text, own)
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _FIELDS]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, batch.schema.field("id").type)]
            + [pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS, strict=True)],
            names=["id", *[name for name, _ in _FIELDS]],
        )


def fingerprint_neighbours(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edit by the next text in order of the id.

    Returns the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next
    (likeness to the edited and to the next text), common_edited and common_next (code points in
    common from the start on). Ids are whole numbers; a null id comes first, equal ids are ordered by
    a hash of the text. The last document is followed by the first, a single one by itself. A null
    text is empty. Two empty texts are alike with 1, an empty one and another with 0. Other columns
    are not read; an empty table gives an empty result.

    Documents are dealt by borders of the order to partitions, and each partition also gets the
    first document of the next, so the texts are shuffled once. Borders come from a small sample;
    they decide on the size of partitions only.
    """
    spark = docs.sparkSession
    text = F.coalesce(col(text_column).cast("string"), F.lit(""))
    rows = docs.select(
        col(id_column).alias("id"),
        F.coalesce(col(id_column).cast("long"), F.lit(_NULL_ID)).alias("place"),
        text.alias("text"),
        F.xxhash64(text).alias("tie"),
    )
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size.chars or 0) // PARTITION_CHARS))
    every = max(1, size.n // (BORDER_SAMPLE * parts))
    sampled = rows.filter(F.pmod(F.xxhash64("place", "tie"), F.lit(every)) == 0).select("place", "tie").collect()
    sampled = sorted((r.place, r.tie) for r in sampled)
    step = max(1, len(sampled) // parts)
    borders = np.array(sorted(set(sampled[step::step])), dtype=np.int64).reshape(-1, 2)

    @F.pandas_udf("int")
    def part(place, tie):  # noqa: ANN001, ANN202
        return _part(place, tie, borders)

    keyed = rows.withColumn("part", part("place", "tie"))
    heads = keyed.groupBy("part").agg(F.min(F.struct("place", "tie")).alias("head")).collect()
    heads = sorted((r.part, r["head"].place, r["head"].tie) for r in heads)
    before = {p: heads[i - 1][0] for i, (p, _, _) in enumerate(heads)}
    table = spark.createDataFrame(
        [(p, place, tie, before[p]) for p, place, tie in heads], "part int, place long, tie long, before int"
    )
    own = keyed.withColumn("extra", F.lit(False))
    # at most a row for each partition, or as many as repeat it
    head = keyed.join(F.broadcast(table), ["part", "place", "tie"])
    head = head.dropDuplicates(["part"]).withColumn("part", F.col("before")).drop("before")
    head = head.withColumn("extra", F.lit(True)).select(*own.columns)
    id_type = rows.schema["id"].dataType.simpleString()
    schema = ", ".join(
        f"{name} {'long' if kind == pa.int64() else 'double' if kind == pa.float64() else 'string'}"
        for name, kind in _FIELDS
    )
    return (
        own.unionByName(head)
        # ids are taken modulo the number of tasks, so there is one for each part
        .repartitionById(len(borders) + 1, F.col("part"))
        .sortWithinPartitions("extra", "place", "tie")
        .select("id", "text", "extra")
        .mapInArrow(_neighbours, f"id {id_type}, {schema}")
        .withColumnRenamed("id", id_column)
    )


def _part(place, tie, borders: np.ndarray):  # noqa: ANN001, ANN202
    """Number of borders that a (place, tie) has reached."""
    import pandas as pd

    place, tie = place.to_numpy(), tie.to_numpy()
    low = np.searchsorted(borders[:, 0], place, side="left")
    high = np.searchsorted(borders[:, 0], place, side="right")
    out = low.copy()
    for value in np.unique(low[high > low]):
        at = (low == value) & (high > low)
        end = int(high[at][0])
        out[at] = value + np.searchsorted(borders[value:end, 1], tie[at], side="right")
    return pd.Series(out.astype(np.int32))
