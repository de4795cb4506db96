import math
import random
import re
import time
from collections import Counter

from tablereview.llm import licenses


def test_inheritance(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [
        ("p/LICENSE", "MIT License text follows\nReleased under the MIT License.\nmore words " * 3),
        ("p/a/b/code.py", "nothing here"),
        ("p/a/COPYING", apache),
        ("p/a/b/own.py", f"some text\n{apache}\n" + "code " * 50),
        ("p/c.py", "plain"),
        ("q/c.py", None),
        (None, ""),
        ("p/c.py", "plain"),
    ]
    files = spark.createDataFrame([(*r, 1) for r in rows], "path string, text string, license int")
    got = {r.path: r for r in licenses.scan_licenses(files).collect()}
    assert licenses.scan_licenses(files).count() == len(rows)
    answers = {p: (r.license, r.how, r.from_dir) for p, r in got.items()}
    assert answers["p/LICENSE"] == ("MIT", "file", None)
    assert answers["p/a/COPYING"] == ("Apache-2.0", "file", None)
    assert answers["p/a/b/code.py"] == ("Apache-2.0", "inherited", "p/a")
    assert answers["p/a/b/own.py"] == ("Apache-2.0", "header", None)
    assert answers["p/c.py"] == ("MIT", "inherited", "p")
    assert answers["q/c.py"] == answers[""] == (None, None, None)
    assert licenses.scan_licenses(files.limit(0)).count() == 0


def test_cosine_matches_brute_force(spark, documents):
    """The best template of each line, with every line compared with every template."""
    rows = [(str(r.doc_id), r.text) for r in documents.collect()]
    split = lambda t: [w for w in (x.strip(".+-") for x in re.split(r"[^\w.+-]+|_", t.lower())) if w]
    held = Counter(w for _, t in rows for w in set(split(t)))
    templates = [(name, Counter(split(t))) for name, t in licenses.TEMPLATES]
    vocabulary = {w for _, c in templates for w in c}
    rarity = lambda w: math.log((1 + len(rows)) / (1 + (held[w] if w in vocabulary else 0))) + 1
    norm = lambda c: math.sqrt(sum((n * rarity(w)) ** 2 for w, n in c.items()))
    expected = {}
    for key, text in rows:
        for i, line in enumerate(text.split("\n")):
            c = Counter(split(line))
            if not c:
                continue
            best = max(
                (sum(n * c[w] * rarity(w) ** 2 for w, n in t.items()) / norm(t) / norm(c), -k, name)
                for k, (name, t) in enumerate(templates)
            )
            if best[0] >= licenses.LEAST_COSINE:
                expected[key, i] = best[2]
    files = spark.createDataFrame(rows, "key string, text string")
    got = {(r.key, r.line): r.license for r in licenses.license_lines(files).collect()}
    assert got == expected and got


MIT = """MIT License

Copyright (c) 2019-2024 Jane Example and others

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or
substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
APACHE_HEADER = """# Copyright 2021 The Example Authors
#
# Licensed under the Apache License, Version 2.0 (the "License"); you may
# not use this file except in compliance with the License. You may obtain
# a copy of the License at
#
#      http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
# WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
# License for the specific language governing permissions and limitations
# under the License.
"""
GPL_HEADER = """/*
 * frob.c - part of frobnicate
 *
 * This program is free software; you can redistribute it and/or
 * modify it under the terms of the GNU General Public License
 * as published by the Free Software Foundation; either version 2
 * of the License, or (at your option) any later version.
 */
"""


def test_license_files_and_wrapped_headers(spark):
    code = "\n".join(f"value_{i} = compute(step{i}, other{i})  # note {i} on part {i % 7}" for i in range(200))
    bsd = dict(licenses.TEXTS)["BSD-3-Clause"].replace("copyright holder", "Example Institute")
    rows = [
        ("m/LICENSE", MIT),
        ("m/sub/code.py", code),
        ("m/sub/embedded.js", "/*\n * " + MIT.replace("\n", "\n * ") + "*/\n" + code),
        ("a/code.py", APACHE_HEADER + code),
        ("g/frob.c", GPL_HEADER + code),
        ("b/terms.txt", "Copyright (c) 2020, Example Institute\nAll rights reserved.\n\n" + bsd),
        ("x/LICENSE-3rd", dict(licenses.TEXTS)["GPL-3.0"]),
        ("y/other.py", code),
    ]
    rows += [(f"z/{i}.py", f"plain words of the file {i} and no terms in it\n{code[:300]}") for i in range(30)]
    got = {r.path: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    answers = {p: (r.license, r.how) for p, r in got.items()}
    assert answers["m/LICENSE"] == ("MIT", "file")
    assert answers["m/sub/code.py"] == ("MIT", "inherited")
    assert answers["m/sub/embedded.js"] == ("MIT", "header")
    assert answers["a/code.py"] == ("Apache-2.0", "header")
    assert answers["g/frob.c"] == ("GPL-2.0", "header")
    assert answers["b/terms.txt"] == ("BSD-3-Clause", "file")
    assert answers["x/LICENSE-3rd"] == ("GPL-3.0", "file")
    assert answers["y/other.py"] == (None, None)
    assert all(answers[f"z/{i}.py"] == (None, None) for i in range(30))


def brute_blocks(rows, templates, least, least_pairs):
    """Every window of every text compared with every template, by plain counting."""
    vocabulary = {w for _, t in templates for w in licenses._template_tokens(t)}
    split = lambda t: [w for w in (x.strip(".+-") for x in re.split(r"[^\w.+-]+|_", t.lower())) if w]
    held = Counter(w for _, t in rows for w in set(split(t)) & vocabulary)
    rarity = lambda w: math.log((1 + len(rows)) / (1 + held[w])) + 1
    norm = lambda c: math.sqrt(sum((n * rarity(w)) ** 2 for w, n in c.items()))
    found = set()
    for key, text in rows:
        lines = [(line, w) for line, part in enumerate(text.split("\n")) for w in split(part)]
        words = [w for _, w in lines]
        for name, template in templates:
            t = split(template)
            follows, counts, length = set(zip(t, t[1:])), Counter(t), len(t)

            def window(at, size):
                part = Counter(words[at : at + size])
                cosine = sum(n * part[w] * rarity(w) ** 2 for w, n in counts.items()) / norm(counts) / norm(part)
                paired = sum(p in follows for p in zip(words[at : at + size], words[at + 1 : at + size + 1]))
                good = cosine >= least and paired >= least_pairs * size
                return (round(cosine, 6), -at, size) if good else None

            islands, last = [], None
            for at in range(len(words)):
                here = window(at, min(length, len(words) - at))
                if here and (last is None or at - last >= length):
                    islands.append([])
                if here:
                    islands[-1].append(here)
                    last = at
            best = []
            for island in islands:
                pieces = {}
                for w in island:
                    pieces.setdefault((island[0][1] - w[1]) // length, []).append(w)
                best += [max(p) for p in pieces.values()]
            if len(words) > length:
                best += [w for w in [window(0, len(words))] if w]
            found |= {(key, lines[-b][0], lines[-b + n - 1][0] + 1, -b, n, name, c) for c, b, n in best}
    return found


def test_blocks_match_every_window(spark):
    templates = (
        ("A", "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
        ("B", "alpha beta gamma rho sigma tau"),
        ("C", "one two one two one two three"),
        ("D", "alpha beta gamma rho sigma tau"),
    )
    a, b, c = (t for _, t in templates[:3])
    rows = [
        ("plain", "nothing of the kind in here"),
        ("whole", a),
        ("short", "alpha beta gamma delta epsilon zeta eta"),
        ("wrapped", f"x y z\n/* {a.replace(' delta', chr(10) + chr(10) + ' * delta')} */\nx y z"),
        ("minified", "x " * 300 + b + " y" * 300 + " " + a + " z"),
        ("copies", "\n".join([a] * 5 + ["x"] + [b] * 4)),
        ("edited", a.replace("zeta", "other") + " words\n" + b.replace("rho", "new rho")),
        ("order", " ".join(sorted(a.split(), reverse=True)) + " " + " ".join(sorted(b.split(), key=lambda w: w[::-1]))),
        ("cycle", "one two " * 40 + "three " + c),
        ("", ""),
        ("blank", "\n \n\t"),
        ("twice", f"v\n{b}\nw"),
    ]
    rows += [(f"r{i}", f"common words {i}\nand alpha {i % 3}") for i in range(20)]
    files = spark.createDataFrame([*rows, rows[-21]], "key string, text string")
    for least, pairs in ((0.85, 0.5), (0.7, 0.0)):
        got = {
            (r.key, r.line, r.until, r.offset, r.words, r.license, round(r.cosine, 6))
            for r in licenses.license_blocks(files, templates, least, pairs).collect()
        }
        assert got == brute_blocks([*rows, rows[-21]], templates, least, pairs)
        assert {g[0] for g in got} >= {"whole", "wrapped", "minified", "copies", "cycle", "twice"}
        assert ("order" in {g[0] for g in got}) == (pairs == 0)


def test_long_text_of_license_words(spark):
    """100,000 license words in no order are no license; one in their midst, on the same line, is found."""
    rng = random.Random(5)
    pool = [w for _, t in licenses.TEXTS for w in t.split()]
    mixed = [rng.choice(pool) for _ in range(100_000)]
    rows = [("mixed", " ".join(mixed)), ("within", " ".join([*mixed[:20_000], *MIT.split(), *mixed[20_000:40_000]]))]
    rows += [(f"{i}", f"plain words {i}") for i in range(40)]
    start = time.monotonic()
    found = licenses.license_blocks(spark.createDataFrame(rows, "key string, text string")).collect()
    assert time.monotonic() - start < 120
    assert {(r.key, r.license) for r in found} == {("within", "MIT")}
    places = [(r.offset, r.words, round(r.cosine, 3)) for r in found]
    assert all(20_000 <= at + n / 2 <= 20_000 + len(MIT.split()) for at, n, _ in places), places


def test_ties_repeated_paths_and_names(spark):
    rows = [
        ("d/LICENSE", dict(licenses.TEXTS)["MIT"]),
        ("d/LICENCE", "SPDX-License-Identifier: Apache-2.0"),
        ("d/COPYING", "SPDX-License-Identifier: MIT"),
        ("d/x.py", "plain"),
        ("e/x.py", "plain"),
        ("e/x.py", "SPDX-License-Identifier: MIT\n" + "code " * 40),
        (None, None),
    ]
    names = "path string, text string, key int, line int, license int, cosine int, template int, held int, dir int, word int"
    files = spark.createDataFrame([(*r, *[1] * 8) for r in rows], names)
    got = licenses.scan_licenses(files).collect()
    assert len(got) == len(rows)
    answers = {r.path: (r.license, r.how) for r in got}
    # equal cosines of 1: the license file of the least path is passed on
    assert answers["d/x.py"] == ("MIT", "inherited")
    assert [(r.license, r.how) for r in got if r.path == "e/x.py"] == [("MIT", "header")] * 2
    assert answers[""] == (None, None)
