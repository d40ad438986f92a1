"""License scan in DataFrame operations only.

A file's header lines (those that speak of licences, copyright or permission) are scored against licence templates
by the cosine of sparse TF-IDF vectors; the best template above THRESHOLD is the file's own licence. A directory has
the licence of its licence file; a file without one of its own inherits from the nearest ancestor directory that has
one, found by joining directory paths.

Term weights: tf * ln((1 + N) / (1 + df)), N and df counted over the header lines of all files. Only terms of the
templates, a few hundred, are kept apart; any other term counts as one that occurs once, which lowers the cosine of
lines that say other things too. Scores are rounded to SCORE_DIGITS so that ties do not hang on summation order;
ties go to the template, then the path, that sorts first.

Before lines come whole texts: the whole text of each file with a header line, and each of its header blocks (lines
without an empty one between them, two or more, one a header line), are scored as one vector against full licence
texts and against the notices that licences ask for. The best at TEXT_THRESHOLD or above decides, lines only where
there is none. The two kinds of template are weighed apart, tf * ln((1 + N) / (1 + df)) over the licences of the kind:
what all texts say counts nothing. In notices, of few words, 1 is added to the logarithm, and version numbers count. A list of wordings of one's own is for lines
only. No full text of CC BY, CC BY-NC or Unlicense is at hand; these are told by their lines.

Defined results: a null or empty text has no header; a null path is a file in no directory; rows with one path are
one file, whose best text decides for each of them; ties are as above; a very long text is scored whole; an empty table
gives an empty result, an empty template list detects nothing; extra columns are ignored, also those named as the
results are, unless keep names them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from importlib.resources import files as resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

THRESHOLD, SCORE_DIGITS = 0.55, 6
TEXT_THRESHOLD = 0.7
#: Tasks over which the rows of one line, directory or path are dealt.
SALTS = 16
HEADER = r"licen[cs]e|copyright|spdx|all rights reserved|permission is hereby"
LICENCE_FILE = r"(^|/)(licen[cs]e|copying|notice|unlicense)([-._][^/]*)?$"
TERM = "[a-z0-9]+(?:[.][0-9]+)*"

# The wordings by which public licences are named in headers.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "GNU General Public License Version 3, 29 June 2007"],
    "GPL-2.0": ["under the terms of the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["under the terms of the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["SPDX-License-Identifier: CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "All-Rights-Reserved": ["All rights reserved."],
}


_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def full_texts() -> dict[str, dict[str, list[str]]]:
    """Kind (text, notice) to licence to its wordings: the files of licence_texts, and the notices cut out of them."""
    texts = {x.name.removesuffix(".txt"): [x.read_text("utf-8")] for x in (resources(__package__) / "licence_texts").iterdir() if x.name.endswith(".txt")}
    bsd = texts["BSD-3-Clause"][0]
    texts["BSD-3-Clause"].append(bsd.replace("REGENTS", "COPYRIGHT HOLDERS").replace("the University nor the names of its", "the copyright holder nor the names of its"))
    texts["BSD-2-Clause"] = [re.sub(r"3\. Neither.*?permission\.\n", "", x, flags=re.S) for x in texts["BSD-3-Clause"]]
    texts |= {"MIT": ["MIT License Copyright (c)\n" + _GRANT], "ISC": ["ISC License Copyright (c)\n" + _ISC]}
    notices = {}
    for name, (text, *_) in texts.items():
        if m := re.search(r"(This (?:program|library) is free software.*?)\n\s*\n.*?You should have received.*?(?=\n\s*\n)", text, re.S):
            notices[name] = [m[1], m[0]]
    notices["LGPL-3.0"] = [re.sub(r"version\s+2\.1", "version 3", x) for x in notices["LGPL-2.1"]]
    apache = re.search(r"(Licensed under the Apache License.*?LICENSE-2\.0)\s.*?limitations under the License", texts["Apache-2.0"][0], re.S)
    notices["Apache-2.0"] = [apache[1].split("You may obtain")[0], apache[1], apache[0]]
    notices["MPL-2.0"] = [re.search(r"This Source Code Form is subject.*?MPL/2\.0/", texts["MPL-2.0"][0], re.S)[0]]
    return {"text": texts, "notice": notices}


def text_vectors(spark: SparkSession) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """(kind, license, wording, term, w) of unit length times idf; (term, text, notice), each term's idf in either kind;
    and the idf of a term that no template of the kind has."""
    rows, idf, rare = [], {}, {}
    for kind, listed in full_texts().items():
        counts = [(name, i, Counter(re.findall(TERM, x.lower()))) for name, xs in listed.items() for i, x in enumerate(xs)]
        df = Counter(t for name in listed for t in set().union(*(c for n, _, c in counts if n == name)))  # a licence is counted once
        least = float(kind == "notice")
        rare[kind] = math.log(1 + len(listed)) + least
        weight = {t: math.log((1 + len(listed)) / (1 + n)) + least for t, n in df.items()}
        for t, w in weight.items():
            idf.setdefault(t, {})[kind] = w
        for name, i, c in counts:
            length = math.sqrt(sum((n * weight[t]) ** 2 for t, n in c.items()))
            rows += [(kind, name, i, t, n * weight[t] ** 2 / length) for t, n in c.items() if weight[t] > 0]
    known = [(t, *(x.get(k, rare[k]) for k in ("text", "notice"))) for t, x in idf.items()]
    return spark.createDataFrame(rows, "kind string, license string, wording int, term string, w double"), spark.createDataFrame(known, "term string, text double, notice double"), rare


def templates(spark: SparkSession, listed: dict[str, list[str]] | None = None) -> DataFrame:
    """(license, wording, text)."""
    rows = [(name, i, text) for name, texts in (TEMPLATES if listed is None else listed).items() for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "license string, wording int, text string")


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def headers(files: DataFrame) -> DataFrame:
    """(path, line): each distinct header line of each file."""
    worded = files.where(F.col("text").rlike(f"(?i){HEADER}"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"(?i){HEADER}"))
    return worded.select("path", F.explode(F.array_distinct(lines)).alias("line"))


def detect_texts(files: DataFrame) -> DataFrame:
    """(path, b): of each file whose text or header block is a licence's text or notice, struct(less, license) of the best."""
    target, known, rare = text_vectors(files.sparkSession)
    blocks = F.filter(F.split("text", r"\n[ \t\r]*(?=\n)"), lambda x: x.rlike(f"(?i){HEADER}") & F.trim(x, F.lit("\n\r\t ")).contains("\n"))
    units = files.where(F.col("text").rlike(f"(?i){HEADER}")).select("path", F.explode(F.array_distinct(F.concat(F.array("text"), blocks))).alias("unit"))
    units = units.withColumn("key", F.sha2("unit", 256))  # each wording is scored once, however many hold it
    tokens = units.select("key", "unit").dropDuplicates(["key"]).select("key", F.explode(_terms(F.col("unit"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    weighed = tokens.join(F.broadcast(known), "term", "left")
    square = {k: F.sum((F.col("tf") * F.coalesce(k, F.lit(rare[k]))) ** 2) for k in rare}
    norm = weighed.groupBy("key").agg(*(F.sqrt(x).alias(k) for k, x in square.items()))
    dot = tokens.join(F.broadcast(target), "term").groupBy("key", "kind", "license", "wording").agg(F.sum(F.col("tf") * F.col("w")).alias("dot"))
    size = F.when(F.col("kind") == "text", F.col("text")).otherwise(F.col("notice"))
    scored = dot.join(norm, "key").select("key", "license", F.round(F.col("dot") / size, SCORE_DIGITS).alias("score")).where(f"score >= {TEXT_THRESHOLD}")
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("b"))
    return salted(units.select("path", "key"), best, "key", ("path",)).where("b is not null").groupBy("path").agg(F.min("b").alias("b"))


def detect(files: DataFrame, wordings: DataFrame, whole: bool = False) -> DataFrame:
    """(path, license, score) of each file (path, text) with a licence of its own; whole: by whole texts first."""
    found = headers(files)
    lines = found.groupBy("line").agg(F.count("*").alias("files"))  # each wording is scored once, however many hold it
    n = F.broadcast(lines.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("n_lines")))
    tokens = lines.select("line", "files", F.explode(_terms(F.col("line"))).alias("term")).groupBy("line", "files", "term").agg(F.count("*").alias("tf"))
    listed = wordings.select("license", "wording", F.explode(_terms(F.col("text"))).alias("term")).groupBy("license", "wording", "term").agg(F.count("*").alias("tf"))
    vocabulary = F.broadcast(listed.select("term").distinct())  # the templates' own terms, a few hundred
    df = tokens.join(vocabulary, "term", "left_semi").groupBy("term").agg(F.sum("files").alias("df"))
    idf = F.log((1 + F.col("n_lines")) / (1 + F.coalesce("df", F.lit(1)))) + 1
    weighed = vocabulary.join(df, "term", "left").crossJoin(n).select("term", idf.alias("idf"))  # one row of n
    alone = F.broadcast(n.select((F.log((1 + F.col("n_lines")) / 2) + 1).alias("rare")))
    target = listed.join(F.broadcast(weighed), "term").select("license", "wording", "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = target.groupBy("license", "wording").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    target = target.join(F.broadcast(length), ["license", "wording"])
    vector = tokens.join(F.broadcast(weighed), "term", "left").crossJoin(alone).select("line", "term", (F.col("tf") * F.coalesce("idf", "rare")).alias("v"))
    norm = vector.groupBy("line").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dot = vector.join(F.broadcast(target), "term").groupBy("line", "license", "wording", "t_norm").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    scored = dot.join(norm, "line").select("line", "license", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), SCORE_DIGITS).alias("score"))
    best = scored.groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("b")).where(f"-b.less >= {THRESHOLD}")
    own = salted(found, best, "line", ("path",)).where("b is not null").groupBy("path").agg(F.min("b").alias("b"))
    if whole:
        first = detect_texts(files).withColumnRenamed("b", "t").withColumnRenamed("path", "p")
        own = own.join(first, F.col("path").eqNullSafe(F.col("p")), "full").select(F.coalesce("p", "path").alias("path"), F.coalesce("t", "b").alias("b"))
    return own.select("path", F.col("b.license").alias("license"), (-F.col("b.less")).alias("score"))


def directory(path: Column) -> Column:
    """The path up to its last slash; '' at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def salted(many: DataFrame, few: DataFrame, key: str, by: tuple[str, ...]) -> DataFrame:
    """many left join few on the key, where one key may hold a third of many: its rows are dealt by a hash of `by` over
    SALTS tasks, and each row of few (one a key) is sent to all of them."""
    spread = many.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    copies = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(copies, [key, "__salt"], "left").drop("__salt")


def inherit(paths: DataFrame, own: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, path, license, score, origin, licensed_by) of every path.

    origin is own, inherited or none; licensed_by is the path of the file whose header decided. Directories, not files,
    are joined with their ancestors, so a directory of any number of files is one row there.
    """
    listed = paths.select("path", *keep, directory(F.col("path")).alias("dir"))
    by_file = own.where(F.lower("path").rlike(LICENCE_FILE)).select(directory(F.col("path")).alias("dir"), "path", "license", "score")
    by_dir = by_file.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("less"), F.col("path").alias("by"), "license")).alias("b"))
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    above = listed.where("path is not null").select("dir").distinct().select("dir", F.explode(F.sequence(F.lit(0), depth)).alias("depth")).select("dir", "depth", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/").alias("up"))
    nearest = above.join(by_dir.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by("b", "depth").alias("b"))
    found = salted(listed, own.select("path", F.col("license").alias("own"), F.col("score").alias("own_score")), "path", ("path", *keep))
    joined = salted(found, nearest, "dir", ("path", *keep))
    mine = F.col("own").isNotNull()
    return joined.select(
        *keep,
        "path",
        F.coalesce("own", "b.license").alias("license"),
        F.coalesce(F.col("own_score"), -F.col("b.less")).alias("score"),
        F.when(mine, "own").when(F.col("b").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(mine, F.col("path")).otherwise(F.col("b.by")).alias("licensed_by"),
    )


def scan(files: DataFrame, wordings: DataFrame | None = None, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The licence of every file; columns named in keep are passed through.

    Files are read once: the paths, and the texts of those that have a header line, are written to the shared folder.
    Wordings of one's own are joined by shuffle if they are many; the given ones are sent to all executors, 100 KB.
    """
    text = F.col(text_col).cast("string")
    rows = files.select(F.col(path_col).cast("string").alias("path"), *(c for c in keep if c != "path"), F.when(text.rlike(f"(?i){HEADER}"), text).alias("text"))
    rows = written(rows, "headers")
    listed = templates(files.sparkSession) if wordings is None else wordings
    return inherit(rows, detect(rows, listed, whole=wordings is None), tuple(c for c in keep if c != "path"))
