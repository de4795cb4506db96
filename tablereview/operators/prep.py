"""Model preparation: impute, scale and one-hot encode, fitted on train rows."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablereview.functions import types as ty
from tablereview.functions.expressions import col, group_key
from tablereview.functions.scratch import store
from tablereview.operators.lookup import ROW_BYTES, Dictionary, Wanted, look_up
from tablereview.operators.medians import medians_of, summaries
from tablereview.operators.profile import value_counts
from tablereview.operators.ranking import places


@dataclass(frozen=True)
class Scaled:
    """A number column: fill value, then (x - mean) / scale."""

    name: str
    median: float
    mean: float
    scale: float

    def filled(self) -> Column:
        fill = F.lit(self.median)
        return F.coalesce(F.nanvl(col(self.name).cast("double"), fill), fill)

    def expression(self) -> Column:
        return (self.filled() - F.lit(self.mean)) / F.lit(self.scale)


@dataclass(frozen=True)
class Encoded:
    """A text column: fill level and its slot, number of train levels, their id in
    ``Prep.levels``, and the same levels as a dictionary of slots.

    Levels are group keys: the text itself, or its SHA-256 when it is long.
    """

    name: str
    mode: str
    mode_slot: int
    size: int
    id: str
    slots: Dictionary


@dataclass(frozen=True)
class Prep:
    """``levels`` (c, key, n, slot) holds the train levels of all text columns, a table at
    any number of levels; slot is the place of a level in the sorted order of its column."""

    numbers: list[Scaled]
    texts: list[Encoded]
    levels: DataFrame | None = None

    def only(self, columns: list[str]) -> Prep:
        """The same fitted preparation for fewer input columns."""
        keep = set(columns)
        return Prep(
            [n for n in self.numbers if n.name in keep],
            [t for t in self.texts if t.name in keep],
            self.levels,
        )

    @property
    def width(self) -> int:
        return len(self.numbers) + sum(t.size for t in self.texts)

    @property
    def starts(self) -> list[int]:
        """Where the block of each text column starts in the features."""
        ends = itertools.accumulate((t.size for t in self.texts), initial=len(self.numbers))
        return list(ends)[:-1]

    def impute(self, df: DataFrame) -> DataFrame:
        """Fill missing numbers and texts; other columns stay."""
        fills = {n.name: n.filled() for n in self.numbers}
        fills |= {t.name: self._filled_key(df, t) for t in self.texts}
        return df.select(*[fills.get(c, col(c)).alias(c) for c in df.columns])

    def scale(self, df: DataFrame) -> DataFrame:
        """Fill and scale the number columns; other columns stay."""
        scaled = {n.name: n.expression() for n in self.numbers}
        return df.select(*[scaled.get(c, col(c)).alias(c) for c in df.columns])

    @staticmethod
    def _filled_key(df: DataFrame, text: Encoded) -> Column:
        return F.coalesce(group_key(col(text.name), df.schema[text.name].dataType), F.lit(text.mode))

    def features(self, df: DataFrame, keep: list[Column], entries: bool = False) -> DataFrame:
        """``keep`` columns plus a sparse ``features`` vector, written out; with ``entries`` also
        the (place, value) pairs of the vector as an array."""
        if not self.width:
            raise ValueError("No usable feature columns.")
        flat, values = self.flat(df, keep)
        kept = flat.columns[: len(keep)]
        places = [F.lit(i) for i in range(len(values))]
        if entries:
            flat = flat.withColumn("entries", self.entries(values))
            kept = [*kept, "entries"]
        return _as_vectors(flat, kept, {"features": (self.width, places, values, self._slot_places())})

    def flat(self, df: DataFrame, keep: list[Column]) -> tuple[DataFrame, list[Column]]:
        """``keep`` columns, the scaled numbers ``n0, n1, ...`` and the slots ``s0, s1, ...``; and the numbers."""
        numbers = [n.expression().alias(f"n{i}") for i, n in enumerate(self.numbers)]
        return self.slots(df, [*keep, *numbers]), [F.col(f"n{i}") for i in range(len(numbers))]

    def _slot_places(self) -> list[Column]:
        return [(F.lit(start) + F.col(f"s{i}")).cast("int") for i, start in enumerate(self.starts)]

    def entries(self, values: list[Column]) -> Column:
        """The (place, value) pairs of a row with these numbers and the slots ``s0, s1, ...``."""
        pairs = [F.struct(F.lit(i).alias("place"), v.alias("value")) for i, v in enumerate(values)]
        pairs += [F.struct(s.alias("place"), F.lit(1.0).alias("value")) for s in self._slot_places()]
        return F.filter(F.array(*pairs), lambda e: e["place"].isNotNull())

    def encode(self, df: DataFrame, keep: list[Column]) -> DataFrame:
        """``keep`` columns plus one one-hot vector ``h0, h1, ...`` per text column, written out."""
        flat = self.slots(df, keep)
        kept = flat.columns[: len(keep)]
        blocks = {}
        for i, text in enumerate(self.texts):
            blocks[f"h{i}"] = (text.size, [], [], [F.col(f"s{i}").cast("int")])
        return _as_vectors(flat, kept, blocks)

    def slots(self, df: DataFrame, keep: list[Column]) -> DataFrame:
        """``keep`` columns plus the slot ``s0, s1, ...`` of each text column: NULL for an
        unseen level. A missing text has the slot of the mode and takes part in no join."""
        keys = [group_key(col(t.name), df.schema[t.name].dataType) for t in self.texts]
        flat = df.select(*keep, *[k.alias(f"t{i}") for i, k in enumerate(keys)])
        kept = flat.columns[: len(keep)]
        wanted = [Wanted(F.col(f"t{i}"), t.slots, f"s{i}") for i, t in enumerate(self.texts)]
        filled = [
            F.when(F.col(f"t{i}").isNull(), F.lit(t.mode_slot).cast("bigint")).otherwise(F.col(f"s{i}")).alias(f"s{i}")
            for i, t in enumerate(self.texts)
        ]
        return look_up(flat, wanted).select(*map(col, kept), *filled)


def _as_vectors(
    flat: DataFrame, kept: list[str], blocks: dict[str, tuple[int, list[Column], list[Column], list[Column]]]
) -> DataFrame:
    """Sparse vectors of (size, places, values, slots): values at their places, then a one at each
    slot that is not NULL.

    They are written in the storage form of a vector and read as vectors, so no row
    passes through Python. The arrays are joined of parts, since a filter would be interpreted for
    each element.
    """
    parts = []
    for name, (size, places, values, slots) in blocks.items():
        none = [F.array().cast(kind) for kind in ("array<int>", "array<double>")]
        seen = [F.when(s.isNotNull(), F.array(s)).otherwise(none[0]) for s in slots]
        ones = [F.when(s.isNotNull(), F.array(F.lit(1.0))).otherwise(none[1]) for s in slots]
        parts.append(
            F.struct(
                F.lit(0).cast("tinyint").alias("type"),
                F.lit(size).cast("int").alias("size"),
                F.concat(F.array(*places).cast("array<int>"), *seen).alias("indices"),
                F.concat(F.array(*values).cast("array<double>"), *ones).alias("values"),
            ).alias(name)
        )
    made = flat.select(*[col(c) for c in kept], *parts)
    fields = [f for f in made.schema.fields if f.name not in blocks]
    vectors = [T.StructField(name, VectorUDT()) for name in blocks]
    return store(made, "vectors", schema=T.StructType(fields + vectors))


def fit_prep(train: DataFrame, columns: list[str]) -> Prep:
    """Fit on train rows. Columns without any value, and columns that are neither
    numbers nor text, are left out."""
    fields = {f.name: f.dataType for f in train.schema.fields}
    numbers = _fit_numbers(train, [c for c in columns if ty.is_number(fields[c])])
    texts, levels = _fit_texts(train, [c for c in columns if ty.is_text(fields[c])])
    return Prep(numbers, texts, levels)


def _fit_numbers(train: DataFrame, columns: list[str]) -> list[Scaled]:
    if not columns:
        return []
    rows = train.count()
    found = {c: s for c, s in summaries(train, columns).items() if s is not None}
    medians = medians_of(train, found)
    out = []
    for c, s in found.items():
        # moments after filling: the gaps add (rows - s.rows) times the median
        gaps, median = rows - s.rows, medians[c]
        mean = s.mean + gaps * (median - s.mean) / rows
        spread = s.variance * s.rows + s.rows * (s.mean - mean) ** 2 + gaps * (median - mean) ** 2
        deviation = 0.0 if s.low == s.high else math.sqrt(spread / rows)
        out.append(Scaled(c, median, mean, deviation or 1.0))
    return out


def _fit_texts(train: DataFrame, columns: list[str]) -> tuple[list[Encoded], DataFrame | None]:
    if not columns:
        return [], None
    placed = places(value_counts(train, columns).select("c", "key", "n"), ["c", "key"], "place")
    ranked = store(placed.select("*", F.lit(0).alias("pad")), "levels")
    # one row per column
    facts = ranked.groupBy("c").agg(
        F.count(F.lit(1)).alias("size"),
        F.sum("n").alias("rows"),
        F.sum(F.octet_length("key")).alias("bytes"),
        F.min("place").alias("start"),
        F.min(F.struct(-F.col("n"), F.col("key"), F.col("place"))).alias("top"),
    )
    found = {r.c: r for r in facts.collect()}
    texts, start = [], F.lit(None).cast("bigint")
    for i, name in enumerate(columns):
        if r := found.get(str(i)):
            slot = (F.col("place") - r.start).alias("value")
            table = ranked.where(F.col("c") == r.c).select("key", "n", slot, "pad")
            known = Dictionary(table, r["size"], r["rows"], r["bytes"] + ROW_BYTES * r["size"])
            texts.append(Encoded(name, r.top.key, r.top.place - r.start, r["size"], r.c, known))
            start = F.when(F.col("c") == r.c, r.start).otherwise(start)
    return texts, ranked.select("c", "key", "n", (F.col("place") - start).alias("slot"))
