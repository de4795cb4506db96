"""Runs of repeating words, found with string synchronising sets.

A run is a longest stretch of words with a smallest period q that is repeated EXPONENT times. Runs
of a period from t to 2t - 1 are found at scale t = 1, 2, 4, 8...: a position is selected if the least
hash among the fragments of t words that begin at it or at the t positions behind it is at either
end. The choice depends on 2t words only, so equal stretches of 2t words (contexts) have equal choices.
A run of this scale has a selected position s among its first t, the next selected position with the
same context is s + q, and both contexts lie within the run. So the distances of neighbouring selected
positions with equal contexts propose all its periods, one proposal for each selected position.

Fragments of a period up to t / 4 would select position after position; they are left out of the
choice. They lie in the highly periodic regions that smaller scales have found, and those supply the
small periods which this scale omits. Such a fragment lies in a run of at least EXPONENT periods, so
the regions are complete, and no stretch of 3t words around a longer period lies in them wholly.

Fragments get exact numbers by doubling: two halves of t words make one of 2t. No result rests on a
hash. Each proposal is extended by comparing words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablereview.functions.expressions import col
from tablereview.llm.pieces import blank_table, texts_of, word_pieces
from tablereview.llm.words import mix

#: Periods in a run at least, and words in it at least.
EXPONENT = 4
LEAST_WORDS = 6
#: Words of texts that are searched together; a longer text goes alone.
TOGETHER = 1 << 17
#: Numbers of words that are turned into text at a time.
STEP = 1 << 16

TABLE = blank_table([b not in (9, 10, 11, 12, 13, 32) for b in range(256)], lower=False)
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)

Run = tuple[int, int, int]


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, in linear time: block ends meet block starts."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    padded = np.full(rows * width, _NEVER, dtype=np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def selected(names: np.ndarray, scale: int, regions: list[Run]) -> np.ndarray:
    """Which positions are synchronising at ``scale``; names are those of fragments of that length."""
    ids = mix(names.astype(np.uint64) + np.uint64(1))
    ids[ids == _NEVER] = 0
    for start, length, _ in regions:
        ids[start : start + length - scale + 1] = _NEVER
    if len(ids) <= scale:
        return np.zeros(0, dtype=bool)
    least = window_least(ids, scale + 1)
    return (least != _NEVER) & ((least == ids[: len(least)]) | (least == ids[scale:]))


def numbered(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal numbers for equal pairs; positions in order of their number, and where a number begins."""
    pairs = first * (int(second.max()) + 1) + second
    order = np.argsort(pairs, kind="stable")
    ordered = pairs[order]
    begins = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    names = np.empty(len(pairs), dtype=np.int64)
    names[order] = np.cumsum(begins) - 1
    return names, order, begins


def _same_ahead(words: np.ndarray, at: int, other: int) -> int:
    """Length of the common stretch from two positions on; the end of words is a mark that stands once."""
    n, step = 0, 16
    while True:
        a, b = words[at + n : at + n + step], words[other + n : other + n + step]
        a = a[: len(b)]
        differ = np.flatnonzero(a != b)
        if len(differ):
            return n + int(differ[0])
        n += len(a)
        if len(a) < step:
            return n
        step *= 2


def _same_behind(words: np.ndarray, at: int, other: int) -> int:
    """Length of the common stretch that ends before two positions, at < other."""
    n, step = 0, 16
    while at > n:
        width = min(step, at - n)
        differ = np.flatnonzero(words[at - n - width : at - n] != words[other - n - width : other - n])
        if len(differ):
            return n + width - 1 - int(differ[-1])
        n += width
        step *= 2
    return n


def _proposed(order: np.ndarray, begins: np.ndarray, chosen: np.ndarray, scale: int) -> list[tuple[int, int]]:
    """(position, period) of neighbouring selected positions with equal contexts; of those that
    continue each other within one run only the first."""
    group = np.cumsum(begins)
    inside = order < len(chosen)
    inside[inside] = chosen[order[inside]]
    at, group = order[inside], group[inside]
    apart = at[1:] - at[:-1]
    near = np.flatnonzero((group[1:] == group[:-1]) & (apart >= scale) & (apart < 2 * scale))
    start, period = at[near], apart[near]
    if not len(start):
        return []
    sort = np.lexsort((start, period))
    start, period = start[sort], period[sort]
    # words from start to start + period + 2 * scale have the period; the next proposal of the same period
    # that begins before start + 2 * scale shares a whole period with it
    linked = (period[1:] == period[:-1]) & (start[1:] - start[:-1] <= 2 * scale)
    first = np.concatenate([[True], ~linked])
    return list(zip(start[first].tolist(), period[first].tolist()))


def _extended(words: np.ndarray, proposals: list[tuple[int, int]]) -> set[Run]:
    """Longest stretches of the proposed periods that are repeated often enough."""
    found: set[Run] = set()
    for start, period in proposals:
        first = start - _same_behind(words, start, start + period)
        length = start + period + _same_ahead(words, start, start + period) - first
        if length >= EXPONENT * period:
            found.add((first, length, period))
    return found


def stretches(words: np.ndarray) -> list[Run]:
    """(start, length, smallest period) of every stretch of EXPONENT periods or more that no
    neighbouring word extends. Words are numbers from 0 on; a negative number, each of which stands
    once, ends every text."""
    held: dict[tuple[int, int], int] = {}
    place, scale = np.arange(len(words)), 1
    names = np.where(words < 0, int(words.max(initial=0)) - words, words)
    while len(words) > 2 * scale:
        contexts, order, begins = numbered(names[:-scale], names[scale:])
        if begins.all():  # a run of this scale or a greater one holds two equal contexts
            break
        regions = _moved([(s, n, q) for (s, n), q in held.items() if EXPONENT * q <= scale <= n], place)
        chosen = selected(names, scale, regions)
        for first, length, period in _extended(words, _proposed(order, begins, chosen, scale)):
            key = (int(place[first]), length)
            held[key] = min(held.get(key, period), period)
        scale *= 2
        words, place, names = _narrowed(words, place, contexts, begins, order, scale)
    return [(start, length, q) for (start, length), q in held.items()]


def _moved(regions: list[Run], place: np.ndarray) -> list[Run]:
    """Regions at their positions among the words that are left."""
    if not regions:
        return []
    starts = np.array([r[0] for r in regions])
    at = np.minimum(np.searchsorted(place, starts), len(place) - 1)
    there = place[at] == starts
    return [(int(k), n, q) for k, ok, (_, n, q) in zip(at, there, regions) if ok]


def _narrowed(
    words: np.ndarray, place: np.ndarray, names: np.ndarray, begins: np.ndarray, order: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Only the texts that hold a repeated fragment; a longer fragment cannot be repeated elsewhere."""
    again = ~begins
    again[:-1] |= ~begins[1:]
    text = np.cumsum(words < 0) - (words < 0)
    keep = np.zeros(int(text[-1]) + 1, dtype=bool)
    keep[text[order[again]]] = True
    if keep.all():
        return words, place, names
    stays = keep[text]
    # fragments that begin near the end have no number; each gets one of its own
    full = np.concatenate([names, int(names.max()) + 1 + np.arange(len(words) - len(names))])
    words, place, names = words[stays], place[stays], full[stays]
    return words, place, names[: len(words) - length + 1]


def _word_numbers(data: bytes) -> tuple[list[bytes], np.ndarray]:
    """Distinct words of a text, and the number of each word in order."""
    known: dict[bytes, int] = {}
    parts = [
        np.array([known.setdefault(w, len(known)) for w in piece], dtype=np.int64) for piece in word_pieces(data, TABLE)
    ]
    return list(known), np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _collapsed(known: list[bytes], numbers: np.ndarray, runs: list[Run]) -> str:
    """The words joined by a space, without those behind the first period of a run."""
    keep = np.ones(len(numbers), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    left = numbers[keep]
    steps = (b" ".join(map(known.__getitem__, left[k : k + STEP].tolist())) for k in range(0, len(left), STEP))
    return b" ".join(steps).decode()


def runs_of(texts: list[np.ndarray], least_words: int) -> list[list[Run]]:
    """Runs of each text, sorted by start and period. Words of different texts are told apart."""
    parts, offset = [], 0
    for k, numbers in enumerate(texts):
        parts += [numbers + offset, np.array([-1 - k])]
        offset += int(numbers.max(initial=0)) + 1
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    out: list[list[Run]] = [[] for _ in texts]
    for start, length, period in stretches(np.concatenate(parts)):
        if length >= least_words:
            k = int(np.searchsorted(starts, start, side="right")) - 1
            out[k].append((start - int(starts[k]), length, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def _searched(least_words: int):
    def found(ids: pa.Array, texts: list[tuple[list[bytes], np.ndarray]]) -> pa.RecordBatch:
        runs = runs_of([numbers for _, numbers in texts], least_words)
        ends = np.cumsum([0, *map(len, runs)])
        flat = np.array([r for some in runs for r in some], dtype=np.int64).reshape(-1, 3)
        fields = [pa.array(flat[:, k]) for k in range(3)]
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([len(numbers) for _, numbers in texts], pa.int64()),
                pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"])
                ),
                pa.array([_collapsed(known, numbers, r) for (known, numbers), r in zip(texts, runs)], pa.string()),
            ],
            ["id", "n_words", "runs", "collapsed"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, n = [], 0, 0
            for k, data in enumerate(texts_of(batch.column("text"))):
                texts.append(_word_numbers(data))
                n += len(texts[-1][1])
                if n >= TOGETHER:
                    yield found(batch.column("id")[first : k + 1], texts)
                    texts, first, n = [], k + 1, 0
            if texts:
                yield found(batch.column("id")[first:], texts)

    return work


def find_runs(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = LEAST_WORDS
) -> DataFrame:
    """(id, n_words, runs, collapsed) of each document.

    ``runs`` are (start, length, period) in words, sorted by start and period: all stretches of
    ``least_words`` words and EXPONENT smallest periods or more that no neighbouring word extends.
    ``collapsed`` are the words, joined by a space, that do not lie behind the first period of a run.

    Words are runs of characters other than space and \\t..\\r, compared exactly. A null, empty or blank
    text has no words, no runs and an empty ``collapsed``. Rows are searched for themselves, so repeated
    rows and ids, null ids and ties have no effect; other columns are not read. An empty table gives an
    empty result. A text is one task's work, in time n log n and memory in proportion to its words.
    """
    rows = docs.select(col(id_column).alias("id"), col(text_column).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    runs = "array<struct<start: long, length: long, period: long>>"
    found = rows.mapInArrow(_searched(least_words), f"id {kind}, n_words long, runs {runs}, collapsed string")
    return found.withColumnRenamed("id", id_column)


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Number of runs, the longest one (ties: smallest start, then period), hashes of runs and of words left."""
    longest = F.array_min(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("down"), r["start"], r["period"]))
    )
    listed = F.transform(
        "runs",
        lambda r: F.concat(
            F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")
        ),
    )
    return found.select(col(id_column), "runs", "collapsed", longest.alias("longest")).select(
        col(id_column),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        (-F.col("longest.down")).alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("1000 * -longest.down div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
