"""Licence scan: sparse TF-IDF cosine of licence passages to templates, then inheritance from the nearest ancestor directory.

Passages are the lines that hold a cue word, and windows of the text's words, across line ends, laid so that a cue word of the text meets one of the template; a window is
as long as its template, so words around a notice do not count against it. Terms are words and pairs of words, weighted by count times inverse frequency over the
licences of the templates; a word that no template has weighs as one that a single licence has. So a text's result depends on nothing but the text and the templates.
A template counts only where the passage holds a term that tells it from each similar template of another licence: a notice without the version that
two licences differ by is neither. A text's own licence is that of the greatest cosine over its passages, if that reaches ``least`` (ties: the smaller name).
The expression of an ``SPDX-License-Identifier`` counts as a cosine of 1; ``-only``, ``-or-later`` and ``+`` are left out as in the templates.

A file whose name begins with LICENSE, LICENCE or COPYING speaks for its directory. Every other file without an own licence takes that of the nearest
directory above it that has one (its own directory first; of several licence files in a directory the best match, then the smaller name).
Directories are joined, not files: one row for each directory and ancestor.

Null text or path: no passage, no directory. Texts without a cue and without a licensed ancestor have null results. Repeated rows each get a row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, replace_column, table, written

# Notices and titles by which files name common licences, and the short licences whole; a licence can have several.
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. """
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission. """
BSD_END = "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties are disclaimed."
GNU = [("GPL-2.0", "General", "2", "June 1991"), ("GPL-3.0", "General", "3", "29 June 2007"), ("LGPL-2.0", "Library General", "2", "June 1991"), ("LGPL-2.1", "Lesser General", "2.1", "February 1999"),
       ("LGPL-3.0", "Lesser General", "3", "29 June 2007"), ("AGPL-3.0", "Affero General", "3", "19 November 2007")]
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
      "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
TEMPLATES = [
    ("Apache-1.1", "Licensed under the Apache Software License, Version 1.1."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", MIT_TEXT),
    ("ISC", ISC_TEXT),
    ("BSD-2-Clause", BSD_HEAD + BSD_END),
    ("BSD-3-Clause", BSD_HEAD + BSD_THIRD + BSD_END),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    *((name, text.format(kind, version, dated)) for name, kind, version, dated in GNU for text in (
        "This work is licensed under the GNU {0} Public License, version {1}.",
        "You can redistribute it and/or modify it under the terms of the GNU {0} Public License as published by the Free Software Foundation, either version {1} "
        "of the License, or (at your option) any later version.",
        "GNU {0} Public License Version {1}, {2}")),
    *((f"CC-{short}-{version}", text.format(short, long, version)) for version in ("4.0", "3.0", "2.0") for short, long in CC.items() for text in (
        "Licensed under CC {0} {2}.", "This work is licensed under a Creative Commons {1} {2} International License.")),
]
CUE = re.compile(r"licen[sc]|copyright|redistribut|permission is hereby|SPDX", re.I)
LICENCE_FILE = r"(?i)^(licen[sc]e|copying)"
LEAST = 0.5
#: Templates of this cosine or more are similar: a term must tell them apart.
SIMILAR = 0.5
_word = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_version = re.compile(r"\b(gpl)?v(?:ersion|er|\.)?\s*(?=\d)")
_zero = re.compile(r"(?<=\d)\.0\b(?!\.\d)")
_cue_word = re.compile(r"licen[sc]|copyright|redistribut|permission")
_spdx = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+(?:[ \t]+(?:OR|AND|WITH)[ \t]+[A-Za-z0-9.+-]+)*)", re.I)


def words_of(text: str) -> list[str]:
    """Words (hyphenated names are one) in lower case; versions in one form: ``v3``, ``v. 3.0`` and ``version 3`` are the words version and 3."""
    return _word.findall(_zero.sub("", _version.sub(lambda m: f"{m[1] or ''} version ", text.lower())))


def counted(words: list[str]) -> Counter:
    return Counter(words) + Counter(map(" ".join, zip(words, words[1:])))


def cues(words: list[str]) -> list[tuple[int, str]]:
    """(position, kind) of each cue word."""
    return [(i, m[0]) for i, m in enumerate(map(_cue_word.search, words)) if m]


def spdx(text: str) -> list[str]:
    """Licence expressions of SPDX lines."""
    return [re.sub(r"(?:-only|-or-later|\+)(?=$| )", "", " ".join(m.rstrip(".-").split()), flags=re.I) for m in _spdx.findall(text)]


class Matcher:
    """Fixed vectors of the templates; plain data, sent to the tasks."""

    def __init__(self, templates: list[tuple[str, str]], least: float) -> None:
        self.least = least
        words = [words_of(t) for _, t in templates]
        names, known = [name for name, _ in templates], [counted(w) for w in words]
        held: dict[str, set] = {}
        for name, counts in zip(names, known):
            for t in counts:
                held.setdefault(t, set()).add(name)
        total = len(set(names))
        self.weight = {t: math.log((1 + total) / (1 + len(of))) + 1 for t, of in held.items()}
        self.other = math.log((1 + total) / 2) + 1
        vectors = [self.vector(counts) for counts in known]
        self.templates = []
        for i, (name, w, (vector, norm)) in enumerate(zip(names, words, vectors)):
            unit = {t: x / norm for t, x in vector.items()}
            tells = [frozenset(known[i].keys() - known[j].keys()) for j, (v, n) in enumerate(vectors)
                     if names[j] != name and sum(x * v.get(t, 0.0) for t, x in unit.items()) >= SIMILAR * n]
            at: dict[str, list[int]] = {}
            for p, kind in cues(w):
                at.setdefault(kind, []).append(p)
            self.templates.append((name, len(w), unit, tells, at, [(t.split(" "), x * x) for t, x in unit.items()]))
        self.reach = max((len(w) for w in words), default=0)

    def vector(self, counts: Counter) -> tuple[dict[str, float], float]:
        vector = {t: n * self.weight.get(t, self.other) for t, n in counts.items()}
        return vector, math.sqrt(sum(x * x for x in vector.values())) or 1.0

    def cosine(self, vector: dict[str, float], norm: float, unit: dict[str, float], tells: list[frozenset]) -> float:
        if any(t.isdisjoint(vector) for t in tells):
            return 0.0
        few, many = sorted((unit, vector), key=len)
        return min(1.0, sum(x * many[t] for t, x in few.items() if t in many) / norm)

    def best(self, text: str | None) -> tuple[str | None, float | None]:
        if not text or not CUE.search(text):
            return None, None
        top = min([(0.0, ""), *((-1.0, name) for name in spdx(text))])
        for line in {x for x in text.splitlines() if CUE.search(x)}:
            vector, norm = self.vector(counted(words_of(line)))
            for name, _, unit, tells, _, _ in self.templates:
                top = min(top, (-self.cosine(vector, norm, unit, tells), name))
        words = words_of(text)
        seen = set()
        for i, kind in cues(words):
            around = set(words[max(0, i - self.reach):i + self.reach])
            for k, (name, n, unit, tells, at, parts) in enumerate(self.templates):
                # No cosine is greater than the root of the squares of the template's terms at hand.
                if kind not in at or sum(x for t, x in parts if around.issuperset(t)) < self.least ** 2:
                    continue
                for start in {max(0, i - p) for p in at[kind]}:
                    if (k, start) not in seen:
                        seen.add((k, start))
                        top = min(top, (-self.cosine(*self.vector(counted(words[start:start + n])), unit, tells), name))
        return (top[1], -top[0]) if top[1] and -top[0] >= self.least else (None, None)


def own_licences(files: DataFrame, text_col: str, templates: list[tuple[str, str]], least: float) -> DataFrame:
    """``files`` without the text, plus licence and cosine by its own passages (null below ``least``)."""
    matcher = Matcher(templates, least)
    keep = [c for c in replace_column(files, "licence", "cosine") if c != text_col]
    rows = files.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "__text"):
            found = [matcher.best(text) for text in b.column("__text").to_pylist()]
            made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made], names=[*keep, "licence", "cosine"])

    fields = [*rows.drop("__text").schema.fields, T.StructField("licence", T.StringType()), T.StructField("cosine", T.DoubleType())]
    return rows.mapInArrow(scored, T.StructType(fields))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """``files`` without the text, plus licence, cosine and licence_from: ``own``, the directory it is inherited from, or null."""
    own = written(own_licences(files, text_col, templates, least), "licences")
    keep = [F.col(f"`{c}`") for c in own.columns if c not in ("licence", "cosine", "licence_from")]
    path = F.col(f"`{path_col}`")
    # The directory of a/b/c is a/b, that of a file without one the empty name.
    folder = F.when(path.isNotNull(), F.regexp_replace(F.regexp_replace(path, r"^/+", ""), r"/?[^/]*$", ""))
    placed = own.withColumn("__dir", folder)
    best = Window.partitionBy("__dir").orderBy(F.desc("cosine"), "licence")
    speaks = (placed.filter(F.regexp_extract(path, r"([^/]*)$", 1).rlike(LICENCE_FILE) & F.col("licence").isNotNull())
              .groupBy("__dir", "licence").agg(F.max("cosine").alias("cosine")).withColumn("nth", F.row_number().over(best)).filter("nth = 1")
              .select(F.col("__dir").alias("above"), F.col("licence").alias("up"), F.col("cosine").alias("up_cosine")))
    dirs = placed.filter("__dir is not null").select("__dir").distinct().withColumn("parts", F.split("__dir", "/"))
    ladder = dirs.select("__dir", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"), "parts").select(
        "__dir", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("above"))
    nearest = (ladder.join(speaks, "above").groupBy("__dir").agg(F.max(F.struct("depth", "above", "up", "up_cosine")).alias("near")))
    has = F.col("licence").isNotNull()
    return placed.join(nearest, "__dir", "left").select(
        *keep, F.coalesce("licence", "near.up").alias("licence"), F.when(has, F.col("cosine")).otherwise(F.col("near.up_cosine")).alias("cosine"),
        F.when(has, F.lit("own")).otherwise(F.col("near.above")).alias("licence_from"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents have no paths: a tree is laid over them by source and id, with the first of each sixteen ids as a directory's licence file."""
    name = F.expr("case when doc_id % 16 = 0 then 'LICENSE' else concat(doc_id, '.txt') end")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.expr("cast(doc_id div 4096 as string)"), F.expr("cast(doc_id div 256 as string)"),
                       F.expr("cast(doc_id div 16 as string)"), name)
    return scan(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))
