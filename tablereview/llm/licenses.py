"""License scans in DataFrame operations only: sparse TF-IDF cosine to templates, then inheritance.

Every line of a text is compared with notices of one line. Headers of several lines and whole
license texts are compared with every window of as many words, over line ends, and with the whole
text. Words are weighed by frequency and rarity; the cosine with a template
only needs the words they share. It knows no order, so a window must also have a share of word pairs
that the template has. Rarity is counted over all texts for the words of the templates;
any other word counts as one that no text holds. A text that mostly consists
of a license is a license file, and so is one named like it; files without a license of their own
take that of the nearest directory above that holds a license file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablereview.functions.expressions import col
from tablereview.functions.scratch import store
from tablereview.llm.native import let, text_of

# Notices by which licenses are named in headers and license files.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it under the GNU General Public License."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("proprietary", "All rights reserved."),
)
_GNU = (
    "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published "
    "by the Free Software Foundation; either version {3} of the License, or (at your option) any later version."
)
_GNU_REST = (
    " This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2} for more details. You should have "
    "received a copy of the GNU {2} along with this {0}. If not, see <https://www.gnu.org/licenses/>."
)
_GNU_HEADERS = (
    ("GPL-2.0", "program", ";", "General Public License", "2"),
    ("GPL-3.0", "program", ":", "General Public License", "3"),
    ("LGPL-2.1", "library", ";", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "library", ":", "Lesser General Public License", "3"),
    ("AGPL-3.0", "program", ":", "Affero General Public License", "3"),
)
#: Standard headers that run over lines.
HEADERS = (
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    *((name, _GNU.format(*fill)) for name, *fill in _GNU_HEADERS),
    *((name, (_GNU + _GNU_REST).format(*fill)) for name, *fill in _GNU_HEADERS),
)
#: Whole licenses, without lines that name an owner.
TEXTS = tuple(
    (path.stem, path.read_text(encoding="utf-8"))
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
)
BLOCKS = HEADERS + TEXTS
LICENSE_FILE = r"(?i)(^|/)(license|licence|copying|unlicense|notice)([._-][^/]*)?$"
LEAST_COSINE = 0.85
#: Share of a window's words whose next word follows them in the template, too.
LEAST_PAIRS = 0.5
#: Share of a text's words in license lines from which it is a license file.
FILE_SHARE = 0.5
_SPLIT = r"[^\p{L}\p{N}.+-]+"


def tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits and . + -, without dots and hyphens at the ends."""
    return F.filter(
        F.transform(F.split(F.lower(text), _SPLIT, -1), lambda w: F.btrim(w, F.lit(".+-"))),
        lambda w: w != "",
    )


def _template_tokens(text: str) -> list[str]:
    return [w for w in (x.strip(".+-") for x in re.split(r"[^\w.+-]+", text.lower())) if w]


def _template_words(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, Counter]]:
    return [(name, Counter(_template_tokens(text))) for name, text in templates]


def template_frequencies(texts: DataFrame, words: list[str]) -> tuple[int, dict[str, int]]:
    """Number of texts, and of those that hold each of the words."""
    wanted = F.array(*[F.lit(w) for w in words])
    held = texts.select(F.explode(F.array_intersect(tokens(F.col("text")), wanted)).alias("word"))
    rows = held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    return texts.count(), {r.word: r.n for r in rows}


def _anchors(weights: dict[str, float], holding: dict[str, int], least: float) -> set[str]:
    """The rarest words of a template without which a line cannot reach the least cosine.

    A line that only shares other words has at most the norm of their weights as its cosine.
    """
    found: set[str] = set()
    for word in sorted(weights, key=lambda w: (holding.get(w, 0), w)):
        if math.sqrt(sum(x * x for w, x in weights.items() if w not in found)) < least - 1e-9:
            break
        found.add(word)
    return found


def license_lines(
    files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST_COSINE
) -> DataFrame:
    """Lines of ``files`` (key, text) that are license notices: (key, text_hash, line, words, license, cosine)."""
    spark = files.sparkSession
    counted = _template_words(templates)
    vocabulary = sorted({w for _, words in counted for w in words})
    texts, holding = template_frequencies(files, vocabulary)
    rarity = {w: math.log((1 + texts) / (1 + holding.get(w, 0))) + 1 for w in vocabulary}
    unseen = math.log(1 + texts) + 1
    anchors: set[str] = set()
    weights = []
    for place, (name, words) in enumerate(counted):
        norm = math.sqrt(sum((n * rarity[w]) ** 2 for w, n in words.items()))
        weights += [(w, place, name, n * rarity[w] / norm) for w, n in words.items()]
        anchors |= _anchors({w: n * rarity[w] / norm for w, n in words.items()}, holding, least)
    template = spark.createDataFrame(weights, "word string, template int, license string, weight double")
    weighed = spark.createDataFrame(sorted(rarity.items()), "word string, rarity double")
    wanted = F.array(*[F.lit(w) for w in sorted(anchors)])
    at = ["key", "text_hash", "line"]
    lines = files.select(
        "key", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(F.col("text"), "\n", -1)).alias("line", "text")
    )
    lines = lines.select(*at, tokens(F.col("text")).alias("words"))
    lines = lines.filter(F.arrays_overlap("words", wanted))
    words = (
        lines.select(*at, F.size("words").alias("words"), F.explode("words").alias("word"))
        .groupBy(*at, "words", "word")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(weighed), "word", "left")
        .withColumn("value", F.col("n") * F.coalesce("rarity", F.lit(unseen)))
    )
    norms = words.groupBy(*at, "words").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    dots = (
        words.join(F.broadcast(template), "word")
        .groupBy(*at, "template", "license")
        .agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    )
    cosine = F.round(F.col("dot") / F.col("norm"), 9)
    best = F.max(F.struct(cosine.alias("cosine"), (-F.col("template")).alias("t"), "license"))
    return (
        dots.join(norms, at)
        .groupBy(*at, "words")
        .agg(best.alias("best"))
        .filter(F.col("best.cosine") >= least)
        .select(*at, "words", "best.license", "best.cosine")
    )


def _marked(text: Column) -> Column:
    """Tokens with the line feeds between them."""
    apart = F.split(F.lower(F.regexp_replace(text, "\n", " \n ")), _SPLIT.replace("^", "^\n"), -1)
    return F.filter(F.transform(apart, lambda w: F.btrim(w, F.lit(".+-"))), lambda w: w != "")


def _line_starts(marked: Column) -> Column:
    """(line, offset, stop) of each line with words; offset and stop count the words before it and up to its end."""
    feeds = F.filter(F.transform(marked, lambda w, i: F.when(w == "\n", i)), lambda i: i.isNotNull())
    first = F.array(F.struct(F.lit(0).alias("line"), F.lit(0).alias("offset")))
    rest = let(feeds, lambda at: F.transform(at, lambda i, k: F.struct((k + 1).alias("line"), (i - k).alias("offset"))))
    words = F.size(F.filter(marked, lambda w: w != "\n"))
    stops = lambda x, n: F.transform(
        x, lambda s, i: F.struct(s["line"], s["offset"], F.coalesce(F.get(x, i + 1)["offset"], n).alias("stop"))
    )
    lines = let(words, lambda n: let(F.concat(first, rest), lambda x: stops(x, n)))
    return F.filter(lines, lambda s: s["stop"] > s["offset"])


def _word_places(texts: DataFrame) -> DataFrame:
    """Words of (key, text_hash, text): (key, text_hash, total, line, pos, word, next), next null behind the last."""
    marked = F.col("marked")
    words = F.filter(marked, lambda w: w != "\n")
    pairs = lambda w: F.zip_with(
        w, F.slice(w, 2, F.size(w)), lambda a, b: F.struct(a.alias("word"), b.alias("next"))
    )
    part = lambda h, s: F.struct(
        F.size(h).alias("total"), s["line"], s["offset"], F.slice(h, s["offset"] + 1, s["stop"] - s["offset"]).alias("held")
    )
    parts = let(let(words, pairs), lambda h: F.transform(_line_starts(marked), lambda s: part(h, s)))
    return (
        texts.select("key", "text_hash", _marked(F.col("text")).alias("marked"))
        .select("key", "text_hash", F.explode(parts).alias("part"))
        .select("key", "text_hash", "part.total", "part.line", "part.offset", F.posexplode("part.held").alias("at", "held"))
        .select("key", "text_hash", "total", "line", (F.col("offset") + F.col("at")).alias("pos"), "held.word", "held.next")
    )


def _windows(words: DataFrame) -> DataFrame:
    """Every window of every text and template: (key, text_hash, template, length, offset, words, cosine, pairs).

    A word enters the windows that start up to length - 1 words before it and leaves those behind it.
    Running counts of the word give what each step adds to the square of the norm, running sums over
    the steps the cosine of each window, so the work is in proportion to the words.
    """
    text = ["key", "text_hash", "template"]
    enter = F.struct(F.greatest(F.lit(0), F.col("pos") - F.col("length") + 1).alias("at"), F.lit(1).alias("step"))
    leave = F.struct((F.col("pos") + 1).alias("at"), F.lit(-1).alias("step"))
    steps = words.select("*", F.explode(F.array(enter, leave)).alias("e")).select("*", "e.at", "e.step")
    held = F.sum("step").over(
        Window.partitionBy(*text, "word").orderBy("at", F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    )
    by_text = Window.partitionBy(*text).orderBy("at")
    sums = (
        steps.filter(F.col("at") < F.col("total"))
        .select(
            *text,
            "length",
            "total",
            "at",
            (F.col("step") * F.col("rarity") * F.col("weight")).alias("dot"),
            (F.col("rarity") * F.col("rarity") * (2 * held * F.col("step") - 1)).alias("square"),
            (F.col("step") * F.col("paired")).alias("paired"),
        )
        .select(
            *text,
            "length",
            F.col("at").alias("offset"),
            F.least("length", F.col("total") - F.col("at")).alias("words"),
            *[F.sum(c).over(by_text).alias(c) for c in ("dot", "square", "paired")],
            F.lead("at").over(by_text).alias("after"),
        )
        .filter(F.col("after").isNull() | (F.col("after") != F.col("offset")))
    )
    return sums.select(
        *text, "length", "offset", "words",
        F.round(F.col("dot") / F.sqrt("square"), 9).alias("cosine"), (F.col("paired") / F.col("words")).alias("pairs"),
    )


def _peaks(windows: DataFrame) -> DataFrame:
    """Of windows less than a template apart the best, one for each length of it; of equal ones the first."""
    text = ["key", "text_hash", "template"]
    in_order = Window.partitionBy(*text).orderBy("offset")
    apart = (F.col("offset") - F.lag("offset").over(in_order) >= F.col("length")).cast("int")
    first = F.min("offset").over(Window.partitionBy(*text, "island"))
    best = F.max(F.struct("cosine", (-F.col("offset")).alias("back"), "words")).alias("best")
    return (
        windows.withColumn("apart", F.coalesce(apart, F.lit(0)))
        .withColumn("island", F.sum("apart").over(in_order))
        .withColumn("piece", F.floor((F.col("offset") - first) / F.col("length")))
        .groupBy(*text, "island", "piece")
        .agg(best)
        .select(*text, (-F.col("best.back")).alias("offset"), "best.words", "best.cosine")
    )


def license_blocks(
    files: DataFrame, templates: tuple[tuple[str, str], ...] = BLOCKS, least: float = LEAST_COSINE,
    least_pairs: float = LEAST_PAIRS,
) -> DataFrame:
    """Windows of ``files`` (key, text) that are a header or a whole license.

    A window of as many words as the template starts at every word; behind the last full one they
    end with the text. Of matching windows at neighbouring places the best stays (``_peaks``).
    Returns (key, text_hash, line, until, offset, words, license, cosine), lines and words counted
    from 0, until being the line behind the window. A window and a template only are compared if
    the words of the whole text leave the least cosine within reach: it is at most the norm of the
    weights of the template's words that the text holds.
    """
    spark = files.sparkSession
    counted = _template_words(templates)
    vocabulary = sorted({w for _, words in counted for w in words})
    wanted = F.array(*[F.lit(w) for w in vocabulary])
    keyed = files.select("key", F.xxhash64("text").alias("text_hash"), "text")
    held = store(
        keyed.select("key", "text_hash", F.array_intersect(tokens(F.col("text")), wanted).alias("held")), "held_words"
    )
    texts = held.count()
    rows = held.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    holding = {r.word: r.n for r in rows}
    rarity = {w: math.log((1 + texts) / (1 + holding.get(w, 0))) + 1 for w in vocabulary}
    unseen = math.log(1 + texts) + 1
    weights, sizes = [], []
    for place, (name, words) in enumerate(counted):
        norm = math.sqrt(sum((n * rarity[w]) ** 2 for w, n in words.items()))
        weights += [(w, place, n * rarity[w] / norm) for w, n in words.items()]
        sizes.append((place, name, sum(words.values())))
    template = spark.createDataFrame(weights, "word string, template int, weight double")
    weighed = spark.createDataFrame(sorted(rarity.items()), "word string, rarity double")
    named = spark.createDataFrame(sizes, "template int, license string, length int")
    following = {(k, *p) for k, (_, text) in enumerate(templates) for w in [_template_tokens(text)] for p in zip(w, w[1:])}
    pairs = spark.createDataFrame([(*p, 1) for p in sorted(following)], "template int, word string, next string, paired int")
    near = (
        held.dropDuplicates(["key", "text_hash"])
        .select("key", "text_hash", F.explode("held").alias("word"))
        .join(F.broadcast(template), "word")
        .groupBy("key", "text_hash", "template")
        .agg(F.sum(F.col("weight") * F.col("weight")).alias("reach"))
        .filter(F.col("reach") >= least * least - 1e-9)
        .join(F.broadcast(named.drop("license")), "template")
        .drop("reach")
    )
    near = store(near, "license_candidates")
    of_text = ["key", "text_hash"]
    places = store(
        _word_places(keyed.join(store(near.select(*of_text).distinct(), "license_texts"), of_text).dropDuplicates(of_text)),
        "license_words",
    )
    words = (
        places.drop("line")
        .join(near, of_text)
        .join(F.broadcast(weighed), "word", "left")
        .join(F.broadcast(template), ["word", "template"], "left")
        .join(F.broadcast(pairs), ["template", "word", "next"], "left")
        .fillna({"rarity": unseen, "weight": 0.0, "paired": 0})
    )
    alike = (F.col("cosine") >= least) & (F.col("pairs") >= least_pairs)
    inner = _peaks(_windows(words).filter(alike))
    value = F.col("n") * F.col("rarity")
    whole = (
        words.filter(F.col("total") > F.col("length"))
        .groupBy(*of_text, "template", "total", "word", "rarity", "weight")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("paired").alias("paired"))
        .groupBy(*of_text, "template", "total")
        .agg(
            F.round(F.sum(value * F.col("weight")) / F.sqrt(F.sum(value * value)), 9).alias("cosine"),
            (F.sum("paired") / F.col("total")).alias("pairs"),
        )
        .filter(alike)
        .select(*of_text, "template", F.lit(0).alias("offset"), F.col("total").alias("words"), "cosine")
    )
    stop = F.col("offset") + F.col("words")
    return (
        inner.unionByName(whole)
        .withColumn("stop", stop)
        .join(places.select(*of_text, F.col("pos").alias("offset"), "line"), [*of_text, "offset"])
        .join(
            places.select(*of_text, (F.col("pos") + 1).alias("stop"), (F.col("line") + 1).alias("until")), [*of_text, "stop"]
        )
        .join(F.broadcast(named), "template")
        .select(*of_text, "line", "until", "offset", "words", "license", "cosine")
    )


def _covered(spans: Column) -> Column:
    """Places under (offset, words) spans, each counted once."""
    start = F.struct(F.lit(0).alias("stop"), F.lit(0).alias("n"))

    def add(state: Column, span: Column) -> Column:
        stop = span["offset"] + span["words"]
        more = F.greatest(F.lit(0), stop - F.greatest(state["stop"], span["offset"]))
        return F.struct(F.greatest(state["stop"], stop).alias("stop"), (state["n"] + more).alias("n"))

    return F.aggregate(F.array_sort(spans), start, add)["n"]


def _notices(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(key, license, cosine, notice_words): a block counts before single lines, and its words once."""
    best = F.max(F.struct("block", "cosine", (-F.col("line")).alias("line"), "license")).alias("best")
    text = ["key", "text_hash"]
    in_text = blocks.groupBy(*text).agg(
        F.max(F.struct(F.lit(True).alias("block"), "cosine", (-F.col("line")).alias("line"), "license")).alias("best"),
        _covered(F.collect_list(F.struct("offset", "words"))).cast("long").alias("words"),
        F.collect_set(F.struct("line", "until")).alias("ranges"),
    )
    in_text = store(in_text, "license_blocks")
    inside = F.exists("ranges", lambda r: (r["line"] <= F.col("line")) & (F.col("line") < r["until"]))
    alone = (
        lines.join(in_text.select(*text, "ranges"), text, "left")
        .filter(~F.coalesce(inside, F.lit(False)))
        .withColumn("block", F.lit(False))
        .groupBy(*text)
        .agg(best, F.sum("words").cast("long").alias("words"))
    )
    return (
        alone.unionByName(in_text.drop("ranges"))
        .groupBy("key")
        .agg(F.max("best").alias("best"), F.sum("words").alias("notice_words"))
        .select("key", "best.license", "best.cosine", "notice_words")
    )


def scan_licenses(
    files: DataFrame,
    path_column: str = "path",
    text_column: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    least: float = LEAST_COSINE,
    file_share: float = FILE_SHARE,
    blocks: tuple[tuple[str, str], ...] = BLOCKS,
) -> DataFrame:
    """License of each file: (path, license, how, cosine, from_dir).

    how is "file" for a license file, "header" for another file that holds a notice, "inherited" if
    the license is that of a license file in the directory or the nearest above it (from_dir), else
    null like the license. Headers and license texts of several lines (``blocks``) count before
    notices of one line; of several the one of the greatest cosine counts, then the first; of several license files of a directory the one of the greatest cosine, then of the least
    path. Only notices of a license file that have a license are passed on.

    A null path is a file "" in the root; a null text is empty. Rows repeated under one path each get
    the same answer, from the notices and words of all their different texts. An empty table gives an empty result. Other columns
    are not read.
    """
    path = F.coalesce(col(path_column).cast("string"), F.lit(""))
    rows = files.select(path.alias("key"), text_of(text_column).alias("text"))
    own = store(_notices(license_lines(rows, templates, least), license_blocks(rows, blocks, least)), "notices")
    directory = F.regexp_extract("key", r"^(.*)/[^/]*$", 1)
    size = F.size(F.split(F.trim(F.col("text")), r"[\x20\x09-\x0D]+", -1))
    sizes = store(
        rows.select("key", directory.alias("dir"), F.xxhash64("text").alias("text_hash"), size.alias("size")), "file_sizes"
    )
    measured = (
        sizes.join(own.select("key"), "key")
        .select("key", "text_hash", "size")
        .distinct()
        .groupBy("key")
        .agg(F.sum("size").alias("size"))
    )
    own = store(own.join(measured, "key"), "sized_notices")
    files_of = sizes.select("key", "dir").join(own, "key", "left")
    named = F.col("key").rlike(LICENSE_FILE) & F.col("license").isNotNull()
    mostly = F.coalesce(F.col("notice_words") >= file_share * F.col("size"), F.lit(False))
    files_of = store(files_of.withColumn("is_file", named | mostly), "license_files")
    # written before they are joined, so that the rows of one directory can be split
    held = store(
        files_of.filter("is_file")
        .groupBy("dir")
        .agg(F.min(F.struct((-F.col("cosine")).alias("c"), "key", "license")).alias("best"))
        .select(F.col("dir").alias("above"), F.col("best.license").alias("dir_license")),
        "directory_licenses",
    )
    parts = F.split("dir", "/", -1)
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    directories = store(files_of.select("dir").distinct(), "directories")
    nearest = store(
        directories.select("dir", F.explode(F.array_distinct(above)).alias("above"))
        .join(held, "above")
        .groupBy("dir")
        .agg(F.max(F.struct(F.length("above").alias("depth"), "above", "dir_license")).alias("up"))
        .select(F.col("dir").alias("of_dir"), "up"),
        "nearest_licenses",
    )
    out = files_of.join(nearest, F.col("dir") == F.col("of_dir"), "left")
    inherited = F.col("license").isNull() & F.col("up").isNotNull()
    return out.select(
        F.col("key").alias(path_column),
        F.coalesce("license", "up.dir_license").alias("license"),
        F.when(F.col("is_file"), "file")
        .when(F.col("license").isNotNull(), "header")
        .when(inherited, "inherited")
        .alias("how"),
        "cosine",
        F.when(inherited, F.col("up.above")).alias("from_dir"),
    )
