"""Licence scans.

Lines, sentences, headers and whole files are compared with templates by the cosine of sparse TF-IDF vectors: rows of
(piece, term, weight), with term frequencies by their logarithm and document frequencies counted over all terms of all files.
Pieces that no template can reach are left out exactly: of each template the rarest terms that hold over 1 - LEAST ** 2 of its
squared length are anchors, and a piece without an anchor of a template has a cosine below LEAST with it. A file that names no licence inherits that of the
nearest directory above it that has a licence file. Everything is Spark expressions, aggregations and joins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, remove, table

# Well-known wordings by licence, one sentence each.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "Licensed under the Simplified BSD License."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: SPDX identifiers of each licence; an identifier is one token (see TOKEN), so it matches as a whole or not at all.
SPDX = {name: [name] for name in TEMPLATES} | {
    name: [name, f"{name}-only", f"{name}-or-later", f"{name}+"] for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
} | {"BSD-2-Clause": ["BSD-2-Clause", "BSD-2-Clause-FreeBSD"]}


def _gnu(kind: str, version: str, thing: str = "program") -> list[str]:
    """The notice of a GNU licence: with "or later" in the wordings of versions 2 and 3, and of that version only."""
    free = f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}"
    later = f"as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    return [f"{free} {later}", f"{free} version {version} as published by the Free Software Foundation.", f"{free} as published by the Free Software Foundation; version {version} of the License."]


def _warranty(kind: str, thing: str = "program") -> str:
    return f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details. You should have received a copy of the GNU {kind} along with this {thing}. If not, see <https://www.gnu.org/licenses/>."


GNU = {"GPL-2.0": ("General Public License", "2"), "GPL-3.0": ("General Public License", "3"), "LGPL-2.1": ("Lesser General Public License", "2.1"), "LGPL-3.0": ("Lesser General Public License", "3"), "AGPL-3.0": ("Affero General Public License", "3")}
#: First lines of licence files.
TITLES = {
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache-2.0": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "MPL-2.0": "Mozilla Public License Version 2.0",
    "CC0-1.0": "Creative Commons CC0 1.0 Universal",
}
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Whole headers and short licence files, which are compared as one piece: they tell licences apart that share sentences.
WHOLE = {name: [f"{notice} {_warranty(kind, thing)}" for thing in ("program", "library") for notice in _gnu(kind, version, thing)[:2]] for name, (kind, version) in GNU.items()} | {
    "BSD-2-Clause": [f"{_BSD} {_BSD_END}"],
    "BSD-3-Clause": [f"{_BSD} {_BSD_NAME} {_BSD_END}"],
}
for _name, (_kind, _version) in GNU.items():
    TEMPLATES[_name] += [t for thing in ("program", "library") for t in _gnu(_kind, _version, thing)]
for _name, _title in TITLES.items():
    TEMPLATES[_name] += [_title]
TOKEN = r"spdx-license-identifier: [a-z0-9.+-]+|[a-z]+|[0-9]+(?:\.[0-9]+)?"
LICENCE_FILE = r"(?i)^(?:licen[sc]e|copying|unlicense|notice)(?:[.-].*)?$"
SPDX_LINE = r"(?i)SPDX-License-Identifier:[ \t]*([a-z0-9.+() \t-]+)"
#: What is compared as one piece besides the whole file: the comment at its start, and a BSD wording anywhere.
COMMENT = r"^[ \t]*(?:$|#|//|/\*|\*|;|--|<!--)"
BSD_FROM, BSD_TO = r"(?is)Redistribution\s+and\s+use\s.*", r"(?i)such\W+damage"
#: Least cosine.
LEAST = 0.6


def tokens(text: Column) -> Column:
    """A text's terms in order, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _vectors(templates: dict[str, list[str]]) -> list[tuple[str, dict[str, int]]]:
    """(licence, term counts) of each distinct wording."""
    import collections
    import re

    found = {(name, tuple(sorted(collections.Counter(re.findall(TOKEN, text.lower())).items()))) for name, texts in templates.items() for text in texts}
    return [(name, dict(counts)) for name, counts in sorted(found)]


def frequencies(files: DataFrame) -> DataFrame:
    """term, n: in how many files each term stands, for terms of at least two files."""
    terms = files.select(F.explode(F.array_distinct(tokens(F.coalesce(F.col("text"), F.lit(""))))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n")).filter("n > 1")


@dataclass
class Templates:
    """Weighted templates: rows of (kind, template, licence, term, weight over the template's length), and the anchors."""

    rows: list[tuple[int, int, str, str, float]]
    anchors: list[str]


def weigh(counts: dict[str, int], n_files: int) -> Templates:
    """``counts``: in how many files each template term stands (absent: one at most)."""
    idf = lambda t: math.log((1 + n_files) / (1 + max(1, counts.get(t, 1)))) + 1
    rows, anchors, k = [], set(), 0
    for kind, templates in enumerate((TEMPLATES, WHOLE)):
        for name, tf in _vectors(templates):
            weights = {t: (1 + math.log(n)) * idf(t) for t, n in tf.items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            rows += [(kind, k, name, t, w / norm) for t, w in weights.items()]
            left = 1.0
            for t, w in sorted(weights.items(), key=lambda x: (counts.get(x[0], 1), -x[1], x[0])):  # rarest first
                if left < LEAST**2 - 1e-6:
                    break
                anchors.add(t)
                left -= (w / norm) ** 2
            k += 1
    return Templates(rows, sorted(anchors))


def stretches(text: Column, sounds) -> Column:
    """Lines, sentences and paragraphs across lines that ``sounds`` (a test of a text) picks."""
    lines = F.split(text, "\n")
    joined = F.regexp_replace(text, r"\s*\n[ \t#*/;-]*", " ")
    sentences = F.array_union(F.split(joined, r"(?<=[.;:!?])\s+"), F.split(joined, r"(?<=[.!?])\s+"))
    paragraphs = F.split(text, r"\n[ \t#*/;-]*\n")
    return F.filter(F.array_union(F.array_union(lines, sentences), paragraphs), sounds)


def pieces(text: Column, sounds) -> Column:
    """What is compared as one piece: the file, the comment it starts with, BSD wordings in it."""
    lines = F.split(text, "\n")
    code = F.array_position(F.transform(lines, lambda x: ~F.regexp(x, F.lit(COMMENT))), True)
    header = F.when(code > 0, F.array_join(F.slice(lines, 1, F.greatest(code - 1, F.lit(0)).cast("int")), "\n")).otherwise(text)
    return F.filter(F.array_union(F.array(text, header), bsd_pieces(text)), sounds)


def bsd_pieces(text: Column) -> Column:
    """From each first "Redistribution and use" to the next "such damage", however far; in time linear in the text."""
    ends = F.split(text, BSD_TO)
    begun = F.transform(F.slice(ends, 1, F.size(ends) - 1), lambda x: F.regexp_extract(x, BSD_FROM, 0))
    return F.transform(F.filter(begun, lambda x: x != ""), lambda x: F.concat(x, F.lit("such damage")))


def spdx_licence(text: Column) -> Column:
    """The licence that an SPDX line names; of several the one that comes last by name."""
    table = F.create_map(*[F.lit(v) for name, ids in SPDX.items() for i in ids for v in (i.lower(), name)])
    expressions = F.regexp_extract_all(F.lower(text), F.lit(SPDX_LINE), F.lit(1))
    ids = F.flatten(F.transform(expressions, lambda e: F.split(e, r"[\s()]+")))
    return F.array_max(F.filter(F.transform(ids, lambda i: F.try_element_at(table, i)), lambda x: x.isNotNull()))


def prepared(files: DataFrame, anchors: list[str]) -> DataFrame:
    """row (a number of its own), file_id, path, spdx, whether every line has an anchor, and pieces: (kind, terms) of those
    that have one; kind 0 is compared with TEMPLATES, 1 with WHOLE."""
    known = F.array(*map(F.lit, anchors))
    sounds = lambda x: F.arrays_overlap(tokens(x), known)
    df = files.select("file_id", "path", F.coalesce(F.col("text"), F.lit("")).alias("_t")).withColumn("_able", sounds(F.col("_t")))
    of = lambda kind, texts: F.transform(texts, lambda x: F.struct(F.lit(kind).alias("kind"), tokens(x).alias("terms")))
    empty = F.array().cast("array<struct<kind:int,terms:array<string>>>")
    found = F.when(F.col("_able"), F.concat(of(0, stretches(F.col("_t"), sounds)), of(1, pieces(F.col("_t"), sounds)))).otherwise(empty)
    filled = F.filter(F.split("_t", "\n"), lambda x: F.regexp(x, F.lit(r"\S")))
    only = F.when(F.col("_able"), F.forall(filled, sounds)).otherwise(False)
    spdx = F.when(F.contains(F.lower("_t"), F.lit("spdx-license-identifier")), spdx_licence(F.col("_t")))
    return df.select(F.monotonically_increasing_id().alias("row"), "file_id", "path", spdx.alias("spdx"), only.alias("only"), found.alias("pieces"))


def scores(found: DataFrame, counts: DataFrame, n_files: int, templates: Templates) -> DataFrame:
    """row, one, whole: the (score, licence) of the best piece and template of either kind, where it reaches LEAST. Of equal
    scores the licence that comes last by name."""
    spark = found.sparkSession
    terms = found.select("row", F.posexplode("pieces").alias("piece", "p")).select("row", "piece", "p.kind", F.explode("p.terms").alias("term"))
    tf = terms.groupBy("row", "piece", "kind", "term").agg(F.count("*").alias("tf"))
    idf = F.log(F.lit(1.0 + n_files) / (1 + F.coalesce("n", F.lit(1)))) + 1
    weighted = cut(tf.join(counts, "term", "left").select("row", "piece", "kind", "term", ((1 + F.log("tf")) * idf).alias("w")), "licences-weights")
    norms = weighted.groupBy("row", "piece").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    rows = spark.createDataFrame(templates.rows, "kind int, template int, licence string, term string, tw double")
    dots = weighted.join(F.broadcast(rows), ["kind", "term"]).groupBy("row", "piece", "kind", "template", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    near = dots.join(norms, ["row", "piece"]).select("row", "kind", F.struct(F.round(F.col("dot") / F.col("norm"), 9).alias("score"), "licence").alias("s")).filter(F.col("s.score") >= LEAST)
    best = cut(near.groupBy("row").agg(F.max(F.when(F.col("kind") == 0, F.col("s"))).alias("one"), F.max(F.when(F.col("kind") == 1, F.col("s"))).alias("whole")), "licences-scores")
    remove(weighted)
    return best


def ancestors(path: Column) -> Column:
    """Every directory above a path with its depth; the root is ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("dir")))


def scan(files: DataFrame) -> DataFrame:
    """file_id, path, licence, score, origin of every file (file_id, path, text). origin is ``own`` where a piece reaches
    LEAST, ``inherited`` (with the distance in ``levels`` and no score) where a licence file stands in a directory above,
    else null. A licence file is one by its name or by holding nothing but licence-like lines; of several in a directory
    the best-scored counts, then the licence last by name.

    Null or empty text: no own licence. Null path: nothing to inherit. Repeated rows stay; a very long text is compared like
    any other; other columns are dropped; an empty table gives an empty one.
    """
    n_files = files.count()
    counts = cut(frequencies(files), "licences-frequencies")
    known = sorted({t for texts in (TEMPLATES, WHOLE) for _, tf in _vectors(texts) for t in tf})
    templates = weigh({r.term: r.n for r in counts.filter(F.col("term").isin(known)).collect()}, n_files)
    found = cut(prepared(files, templates.anchors), "licences")
    best = scores(found, counts, n_files, templates)
    rated = found.drop("pieces").join(best, "row", "left")
    # an SPDX line or a title is exact; else a whole wording tells more than the sentences it shares with others
    one, whole = F.col("one"), F.col("whole")
    exact = F.when(F.col("spdx").isNotNull(), F.struct(F.lit(1.0).alias("score"), F.col("spdx").alias("licence")))
    text = F.when(whole.isNotNull() & (one.isNull() | (one["score"] < 1) | whole["licence"].startswith("BSD") & one["licence"].startswith("BSD")), whole).otherwise(one)
    rated = cut(rated.select("file_id", "path", "only", F.coalesce(exact, text).alias("best")), "licences-own")
    remove(counts, found, best)
    name = F.regexp_extract("path", "[^/]*$", 0)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    bearers = rated.filter(F.col("path").isNotNull() & F.col("best").isNotNull() & (F.col("only") | F.regexp(name, F.lit(LICENCE_FILE))))
    folders = bearers.groupBy(folder.alias("dir")).agg(F.max("best").alias("from"))
    open_paths = rated.filter(F.col("best").isNull() & F.col("path").isNotNull()).select("path").distinct()
    above = open_paths.select("path", F.explode(ancestors(F.col("path"))).alias("a")).select("path", "a.dir", "a.depth")
    nearest = above.join(folders, "dir").groupBy("path").agg(F.max(F.struct("depth", F.col("from.licence").alias("licence"))).alias("up"))
    full = rated.filter(F.col("best").isNull()).join(nearest, "path", "left")
    depth = F.size(F.split("path", "/")) - 1
    heirs = full.select("file_id", "path", F.col("up.licence").alias("licence"), F.lit(None).cast("double").alias("score"), F.when(F.col("up").isNotNull(), F.lit("inherited")).alias("origin"), (depth - F.col("up.depth")).cast("long").alias("levels"))
    owners = rated.filter(F.col("best").isNotNull()).select("file_id", "path", "best.licence", "best.score", F.lit("own").alias("origin"), F.lit(0).cast("long").alias("levels"))
    return owners.unionByName(heirs)


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: fifty in a directory, twenty directories in one above it, by source; the first of each fifty stands
    for the directory's licence file. A null source or doc_id leaves its part of the path out."""
    whole = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    name = F.when(F.col("doc_id") % 50 == 0, F.lit("LICENSE")).otherwise(F.col("doc_id").cast("string"))
    return docs.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", whole(1000), whole(50), name).alias("path"), "text")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """Documents as files of their source's directories."""
    return scan(document_paths(table(spark, sf_dir, "documents"))).withColumnRenamed("file_id", "doc_id")
