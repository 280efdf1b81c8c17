"""License scans: TF-IDF cosine to templates, then inheritance along paths.

Lines of a file that speak of licences are its header. Its words, weighted by
the number in the header and by their rareness among the templates, are
compared with each template by cosine. Besides, the whole text of a licence
file (LICENSE, COPYING and the like), and of any other file the paragraphs with
such lines, are compared in the same way with whole licence texts and with the
standard notices. The best template of all at or above the threshold is the
file's own licence; an SPDX tag decides before any cosine. Licence files give
their licence to their directory, and a file without one of its own takes that
of the nearest directory above it. Built-in functions only.

Cases: null or empty text has no header; the cosine is that of the statement's
template unless a text or notice reaches the threshold and is nearer, and 1 for
an SPDX tag; a tag of one known licence gives its name without ``-only``,
``-or-later`` or ``+``, any other tag is given as written; the texts of the CC
BY licences aren't among the templates, only their notices; a file with equal cosines takes the
first template by name; several licence files of a directory: the one with the
greatest cosine, then the first by name; null paths have no directory; repeated
rows are judged alike; an empty table gives an empty table; other columns are
kept unless named like an output.
"""

from __future__ import annotations

import math
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semaspark.llm.common import carried, carry, materialise, tidy
from semaspark.llm.decontam import let

# SPDX names and the statements by which files declare them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under the Creative Commons Attribution 4.0 International License CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0 share alike.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "Copyright. All rights reserved. Proprietary and confidential.",
}

_FREE = "This program is free software{}; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, {}. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details. You should have received a copy of the GNU {} along with this program. If not, see https://www.gnu.org/licenses/."
_CC = "This work is licensed under the Creative Commons {} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."

# The notices that the licences ask for at the head of files.
NOTICES = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("CC-BY-4.0", _CC.format("Attribution", "by")),
    ("CC-BY-NC-4.0", _CC.format("Attribution-NonCommercial", "by-nc")),
    ("CC-BY-SA-4.0", _CC.format("Attribution-ShareAlike", "by-sa")),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/."),
    *[(f"GPL-{v}.0", _FREE.format("", *["General Public License", at, *["General Public License"] * 2])) for v in (2, 3) for at in (f"version {v}", f"either version {v} of the License, or (at your option) any later version")],
    *[("LGPL-3.0", _FREE.format("", *["Lesser General Public License", at, *["Lesser General Public License"] * 2])) for at in ("version 3", "either version 3 of the License, or (at your option) any later version")],
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]

# A tag and its expression.
_TAG = r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*)*)"
_EDITION = r"(-only|-or-later|\+)$"
_BREAK = r"\r?\n[^\p{L}\p{N}\n]*\n"

HEADER = r"(?i)licen[cs]e|copyright|spdx|all rights reserved|public domain|redistribution"
_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([._-][^/]*)?$"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _counts(words: Column) -> Column:
    """Each of the words with its number, by the ends of its run in order."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        ends = F.filter(at, lambda i: (i == n) | (F.get(w, i) != F.get(w, i - 1)))
        return let(ends, lambda e: F.transform(e, lambda i, k: F.struct(F.get(w, i - 1).alias("term"), (i - F.coalesce(F.get(e, k - 1), F.lit(0))).alias("tf"))))

    return let(F.array_sort(words), runs)


def header(text: Column) -> Column:
    """The lines that speak of licences."""
    return F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda line: line.rlike(HEADER)), "\n")


def paragraphs(text: Column) -> Column:
    """The paragraphs with lines that speak of licences."""
    return F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), _BREAK), lambda p: p.rlike(HEADER)), "\n")


def texts() -> list[tuple[str, str]]:
    """Names and whole texts of licences, and their notices."""
    folder = resources.files("semaspark.llm") / "license_texts"
    whole = [(f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted(folder.iterdir(), key=lambda f: f.name)]
    return whole + NOTICES


def _nearest(pieces: DataFrame) -> DataFrame:
    """``piece`` with ``near``, the ``cosine`` and ``name`` of the nearest of
    ``texts()``; pieces without words are left out."""
    spark = pieces.sparkSession
    known = texts()
    template = spark.createDataFrame([(i, body) for i, (_, body) in enumerate(known)], "i int, body string")
    # Some twenty templates of fixed text: their weights become a small table.
    rows = template.select("i", F.explode(_words(F.col("body"))).alias("term")).groupBy("i", "term").agg(F.count(F.lit(1)).alias("tf")).collect()
    df: dict[str, int] = {}
    for r in rows:
        df[r["term"]] = df.get(r["term"], 0) + 1
    idf = {t: math.log((1 + len(known)) / (1 + n)) + 1 for t, n in df.items()}
    norm = [0.0] * len(known)
    for r in rows:
        norm[r["i"]] += (r["tf"] * idf[r["term"]]) ** 2
    unit = {t: [0.0] * len(known) for t in idf}
    for r in rows:
        unit[r["term"]][r["i"]] = r["tf"] * idf[r["term"]] / math.sqrt(norm[r["i"]])
    weights = F.broadcast(spark.createDataFrame([(t, idf[t], unit[t]) for t in sorted(idf)], "term string, idf double, unit array<double>"))
    # Words are counted in their row, so only sums are exchanged; the row's number keeps equal pieces apart.
    counted = pieces.select("piece", "words", F.monotonically_increasing_id().alias("row")).select("piece", "row", F.explode(_counts(_words(F.col("words")))).alias("c")).select("piece", "row", "c.term", "c.tf")
    w = F.col("tf") * F.coalesce("idf", F.lit(math.log(1 + len(known)) + 1))
    sums = counted.join(weights, "term", "left").groupBy("piece", "row").agg(F.sqrt(F.sum(w * w)).alias("length"), *[F.coalesce(F.sum(w * F.col("unit")[i]), F.lit(0.0)).alias(f"dot{i}") for i in range(len(known))])
    best = F.array_max(F.array(*[F.struct(F.round(F.col(f"dot{i}") / F.col("length"), 10).alias("cosine"), F.lit(-i).alias("order"), F.lit(n).alias("name")) for i, (n, _) in enumerate(known)]))
    return sums.select("piece", best.alias("near")).groupBy("piece").agg(F.max("near").alias("near"))


def match(files: DataFrame, text: str = "text", threshold: float = 0.6, path: str | None = None) -> DataFrame:
    """Columns of ``files`` with ``license`` (null without one) and ``cosine``
    of the best template (0 without a header). Without ``path`` no file is a
    licence file."""
    spark = files.sparkSession
    kept = [c for c in files.columns if c not in ("license", "cosine")]
    template = spark.createDataFrame(list(TEMPLATES.items()), "name string, body string")
    terms = template.select("name", F.explode(_words(F.col("body"))).alias("term")).groupBy("name", "term").agg(F.count(F.lit(1)).alias("tf"))
    # A dozen templates of fixed text: their weights are computed here and become literals.
    rows = terms.collect()
    df: dict[str, int] = {}
    for r in rows:
        df[r["term"]] = df.get(r["term"], 0) + 1
    idf = {t: math.log((1 + len(TEMPLATES)) / (1 + n)) + 1 for t, n in df.items()}
    unseen = math.log(1 + len(TEMPLATES)) + 1
    norm: dict[str, float] = {}
    for r in rows:
        norm[r["name"]] = norm.get(r["name"], 0.0) + (r["tf"] * idf[r["term"]]) ** 2
    unit = {(r["name"], r["term"]): r["tf"] * idf[r["term"]] / math.sqrt(norm[r["name"]]) for r in rows}
    table = F.create_map(*[x for t in sorted(idf) for x in (F.lit(t), F.lit(idf[t]))])
    words = F.when(F.col("header") != "", _words(F.col("header"))).otherwise(F.array().cast("array<string>"))
    body = F.col(f"`{text}`")
    tag = F.regexp_extract(F.coalesce(body, F.lit("")), _TAG, 1)
    plain = F.regexp_replace(tag, _EDITION, "")
    piece = F.when(F.col(f"`{path}`").rlike(_FILE), body).otherwise(paragraphs(body)) if path else paragraphs(body)
    work = files.select(carry(files, kept), header(body).alias("header"), F.when(plain.isin(list(TEMPLATES)), plain).when(tag != "", tag).alias("tag"), piece.alias("words"))
    # Pieces are looked up by their digests.
    digest = F.when(F.col("words") != "", F.sha2("words", 256)).alias("piece")
    pieces = work.select(digest, "words").where("piece is not null")
    near = materialise(_nearest(pieces).where(F.col("near.cosine") >= threshold))
    work = work.select("*", digest).drop("words").join(near, "piece", "left")
    work = work.withColumn("words", words)
    distinct = F.array_distinct("words")
    weighed = F.transform(distinct, lambda t: F.struct(t.alias("t"), (F.size(F.filter("words", lambda w: w == t)) * F.coalesce(F.element_at(table, t), F.lit(unseen))).alias("w")))
    work = work.withColumn("vector", F.when(F.size("words") > 0, weighed))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"]))

    def cosine(name: str) -> Column:
        own = F.create_map(*[x for (n, t), u in sorted(unit.items()) if n == name for x in (F.lit(t), F.lit(u))])
        dot = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x["w"] * F.coalesce(F.element_at(own, x["t"]), F.lit(0.0)))
        return F.round(dot / length, 10)  # so that equal cosines are ties

    best = F.array_max(F.array(*[F.struct(cosine(n).alias("cosine"), F.lit(-i).alias("order"), F.lit(n).alias("name")) for i, n in enumerate(sorted(TEMPLATES))]))
    work = work.withColumn("best", F.when(F.col("vector").isNotNull(), best))
    found = F.coalesce(F.col("best.cosine"), F.lit(0.0))
    nearer = F.coalesce(F.col("near.cosine") > found, F.lit(False))
    license_ = F.when(F.col("tag").isNotNull(), F.col("tag")).when(nearer, F.col("near.name")).when(found >= threshold, F.col("best.name"))
    cosine_ = F.when(F.col("tag").isNotNull(), F.lit(1.0)).when(nearer, F.col("near.cosine")).otherwise(found)
    return work.select(*carried(kept), license_.alias("license"), cosine_.alias("cosine"))


@tidy
def scan(files: DataFrame, text: str = "text", path: str = "path", threshold: float = 0.6) -> DataFrame:
    """Columns of ``files`` but the text, with ``license``, ``cosine`` and
    ``origin``: ``own``, the directory that the licence is inherited from, or
    null."""
    kept = [c for c in files.columns if c not in ("license", "cosine", "origin", text)]
    own = match(files, text, threshold, path)
    folder = F.regexp_replace(F.col(f"`{path}`"), r"/?[^/]*$", "")
    own = materialise(own.select(carry(own, kept), "license", "cosine", folder.alias("_dir"), F.col(f"`{path}`").rlike(_FILE).alias("_is")))
    given = own.where("_is and license is not null and _dir is not null").groupBy(F.col("_dir").alias("above"))
    given = materialise(given.agg(F.min_by("license", F.struct(-F.col("cosine"), F.col("license"))).alias("theirs")))
    # Each directory once, with all directories above it.
    dirs = own.where("license is null and _dir is not null").select("_dir").distinct()
    parts = F.split("_dir", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("above"), i.alias("depth")))
    climbed = dirs.select("_dir", F.explode(F.concat(F.array(F.struct(F.lit("").alias("above"), F.lit(0).alias("depth"))), ups)).alias("u")).select("_dir", "u.above", "u.depth")
    nearest = materialise(climbed.join(given, "above").groupBy("_dir").agg(F.max_by(F.struct("above", "theirs"), "depth").alias("n")))
    out = own.join(nearest, "_dir", "left")
    lone = F.col("license").isNull()
    return out.select(
        *carried(kept),
        F.coalesce("license", "n.theirs").alias("license"), "cosine",
        F.when(~lone, F.lit("own")).otherwise(F.col("n.above")).alias("origin"),
    )
