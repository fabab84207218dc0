"""Licence scan: sparse TF-IDF cosine against templates, and inheritance along directories.

1. Every text is compared three times: as a whole, by its leading comment block,
   and by its statements (lines, and sentences within them).  Each of these and
   each template is a sparse TF-IDF vector; the inverse document frequency of a
   template word comes from all statements of all files, and a word that no
   template has weighs as one seen once.  Wrapped lines make no difference to the
   first two, whose templates are the full licence texts (``licenses/``) and the
   headers that the licences ask for; a whole file may also be a single statement.
2. A file's own licence is that of the whole file if its cosine reaches
   ``FILE_COSINE``, else that of the comment block if it reaches ``HEADER_COSINE``,
   else the template with the largest cosine of its statements, if that reaches
   ``MIN_COSINE``.  A file that matches as a whole, or in which matched statements
   hold at least ``FILE_SHARE`` of the words, is a licence file, otherwise they are a header.
3. A licence file speaks for its directory.  A file without a licence of its own
   takes that of the nearest directory above it, by a join of directories with
   their ancestors.

The inherited licence is looked up once per directory, so a directory that holds
a third of all files is one row until files join it, which adaptive execution splits.

Defined cases: null text has no statements; a null path has no directory and
inherits nothing; a path without a slash is in the root directory ``""``.  Ties
go to the licence that sorts first.  Repeated rows are judged each.  An empty
table, or no templates, finds nothing.  Columns of the input stay unless their
name is one of the results', which are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.tables import small_table, unused_name
from wordloom.operators.ranking import materialize

MIN_COSINE = 0.6
HEADER_COSINE = 0.75    # of a leading comment block with a header or a full text
FILE_COSINE = 0.85      # of a whole file with any template
FILE_SHARE = 0.5

# Statements by which licences name themselves (licence, statement).
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU Affero General Public License"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Use of this source code is governed by the BSD 2-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("GPL-1.0-or-later", "GNU General Public License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-2.0-or-later", "GNU Lesser General Public License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

# What licences ask to be put at the start of source files.
GNU_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name}
as published by the Free Software Foundation, {version}. This program is distributed in the hope that it will be useful, but
WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
{name} for more details. You should have received a copy of the GNU {name} along with this program. {where}"""
GNU_LICENSES = [("AGPL-3.0", "Affero General Public License", "3"), ("GPL-2.0", "General Public License", "2"),
                ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"),
                ("LGPL-3.0", "Lesser General Public License", "3")]
GNU_VERSIONS = ["either version {v} of the License, or (at your option) any later version", "version {v} of the License"]
GNU_WHERE = ["If not, see <https://www.gnu.org/licenses/>.",
             "If not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."]
HEADERS = [(license_, GNU_HEADER.format(name=name, version=version.format(v=v), where=where))
           for license_, name, v in GNU_LICENSES for version in GNU_VERSIONS for where in GNU_WHERE] + [
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
     with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
     applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
     WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
     permissions and limitations under the License."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
     not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
]

# how a line of a comment begins; the second group opens a comment of several lines
COMMENT = re.compile(r"\s*(?:(#|//|--|;|%|<\?|\.\.|dnl\b|rem\b)|(/\*|<!--|\(\*|\{-|\"\"\"|'''))", re.I)
CLOSES = {"/*": "*/", "<!--": "-->", "(*": "*)", "{-": "-}", '"""': '"""', "'''": "'''"}
LINE = re.compile(r"[^\n]+")

STATEMENT = re.compile(r"\n|(?<=[.!?;])\s+")
TERM = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def terms(statement: str) -> list[str]:
    return TERM.findall(statement.lower())


def template_table(spark: SparkSession) -> DataFrame:
    return small_table(spark, TEMPLATES, "license string, statement string")


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the headers and of the full licence texts."""
    files = sorted((Path(__file__).parent / "licenses").glob("*.txt"))
    return HEADERS + [(f.name.removesuffix(".txt"), f.read_text()) for f in files]


def leading_comment(text: str) -> str:
    """The comments that a text begins with; blank lines do not end them."""
    end, closes = 0, None
    for line in LINE.finditer(text):
        s = line.group()
        if closes is None and s.strip():
            opened = COMMENT.match(s)
            if not opened:
                break
            closes, s = CLOSES.get(opened.group(2)), s[opened.end():]
        if closes and closes in s:
            closes = None
        end = line.end()
    return text[:end]


def counted(text: str) -> Counter:
    return Counter(m.group() for m in TERM.finditer(text.lower()))


class Matcher:
    """Cosine of statements with templates; built from template rows and the counts of their words."""

    def __init__(self, templates: list[tuple[str, str]], statements: int, counts: dict[str, int], least: float):
        self.least = least
        self.idf = {w: log((1 + statements) / (1 + n)) + 1 for w, n in counts.items()}
        self.other = log((1 + statements) / 2) + 1
        self.vectors, self.by_term = [], {}
        for license_, text in templates:
            vector = {w: n * self.idf[w] for w, n in Counter(terms(text)).items()}
            norm = sqrt(sum(x * x for x in vector.values()))
            if norm:
                for w, x in vector.items():
                    self.by_term.setdefault(w, []).append((len(self.vectors), x / norm))
                self.vectors.append(license_)
        # the most frequent words, as long as no template could reach the cosine by them alone:
        # a statement without any other template word needs no look
        self.telling, common = set(counts), [0.0] * len(self.vectors)
        for w in sorted(counts, key=lambda w: (-counts[w], w)):
            grown = {i: common[i] + x * x for i, x in self.by_term.get(w, ())}
            if all(sqrt(x) < least - 1e-6 for x in grown.values()):
                self.telling.discard(w)
                for i, x in grown.items():
                    common[i] = x

    def best(self, words: list[str]) -> tuple[str, float] | None:
        if self.telling.isdisjoint(words):
            return None
        dots: dict[int, float] = {}
        square = 0.0
        for w, n in Counter(words).items():
            x = n * self.idf.get(w, self.other)
            square += x * x
            for i, y in self.by_term.get(w, ()):
                dots[i] = dots.get(i, 0.0) + x * y
        found = [(-dot / sqrt(square), self.vectors[i]) for i, dot in dots.items()
                 if dot / sqrt(square) >= self.least - 1e-12]
        if not found:
            return None
        score, name = min((round(s, 9), name) for s, name in found)
        return name, -score


class TextMatcher(Matcher):
    """The same for long texts, given as the counts of their words."""

    def __init__(self, templates: list[tuple[str, str]], statements: int, counts: dict[str, int], least: float):
        super().__init__(templates, statements, counts, least)
        self.row = {w: k for k, w in enumerate(self.by_term)}
        self.matrix = np.zeros((len(self.row), len(self.vectors)))
        for w, k in self.row.items():
            for i, y in self.by_term[w]:
                self.matrix[k, i] = y

    def best(self, words: Counter) -> tuple[str, float] | None:
        if self.telling.isdisjoint(words):
            return None
        weights = {w: n * self.idf.get(w, self.other) for w, n in words.items()}
        square = sum(x * x for x in weights.values())
        known = [w for w in weights if w in self.row]
        scores = np.array([weights[w] for w in known]) @ self.matrix[[self.row[w] for w in known]] / sqrt(square)
        found = [(-round(float(scores[i]), 9), self.vectors[i]) for i in np.flatnonzero(scores >= self.least - 1e-12)]
        if not found:
            return None
        score, name = min(found)
        return name, -score


def word_counts(texts: DataFrame, vocabulary: set[str]) -> tuple[int, dict[str, int]]:
    """(number of statements, statements that have each word of the vocabulary), over all texts."""
    def run(batches):
        import pyarrow as pa
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for s in STATEMENT.split(text or ""):
                    words = terms(s)
                    if words:
                        counts[""] += 1
                        counts.update(vocabulary.intersection(words))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["w", "n"])

    found = {r["w"]: r["n"] for r in texts.mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return found.pop("", 0), {w: found.get(w, 0) for w in vocabulary}


def own_licenses(files: DataFrame, templates: DataFrame, text_col: str = "text", least: float = MIN_COSINE,
                 full: list[tuple[str, str]] = ()) -> DataFrame:
    """Add ``own_license``, ``cosine``, ``matched_share`` (of the words) to every row.

    With ``full`` (headers and full texts) files are also compared as a whole and by their leading comment block.
    """
    rows = sorted((r["license"], r["statement"]) for r in templates.select("license", "statement").collect())  # a parameter, not data
    vocabulary = {w for _, s in rows for w in terms(s)}
    statements, counts = word_counts(files.select(F.col(text_col).cast("string")), vocabulary.union(*(terms(s) for _, s in full)))
    matcher = Matcher(rows, statements, {w: counts[w] for w in vocabulary}, least)
    headers = TextMatcher(list(full), statements, {w: counts[w] for _, s in full for w in terms(s)}, HEADER_COSINE) if full else None
    wholes = TextMatcher([*rows, *full], statements, counts, FILE_COSINE) if full else None
    given = files.drop("own_license", "cosine", "matched_share")
    names = given.columns
    schema = T.StructType([*given.schema.fields, T.StructField("own_license", T.StringType()),
                           T.StructField("cosine", T.DoubleType()), T.StructField("matched_share", T.DoubleType())])

    def scan(text):
        total, matched, best, telling = 0, 0, None, False
        for s in STATEMENT.split(text or ""):
            words = terms(s)
            total += len(words)
            telling = telling or bool(full) and not (headers.telling.isdisjoint(words) and wholes.telling.isdisjoint(words))
            found = matcher.best(words)
            if found:
                matched += len(words)
                if best is None or (-found[1], found[0]) < (-best[1], best[0]):
                    best = found
        if telling:
            found = wholes.best(counted(text))
            if found:
                return *found, 1.0
            best = headers.best(counted(leading_comment(text))) or best
        return (*(best or (None, None)), matched / total if total else 0.0)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            found = [scan(t) for t in batch.column(len(names)).to_pylist()]
            cols = list(zip(*found)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64())],
                schema_names)

    schema_names = schema.names
    return given.withColumn(unused_name(given, "__text"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def directory_of(path: Column) -> Column:
    """Everything before the last slash; the root directory is empty."""
    return F.when(F.instr(path, "/") == 0, F.lit("")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def scan(files: DataFrame, templates: DataFrame, path_col: str = "path", text_col: str = "text",
         least: float = MIN_COSINE, file_share: float = FILE_SHARE,
         full: list[tuple[str, str]] | None = None) -> DataFrame:
    """All rows with own_license, cosine, is_license_file, license and inherited_from (a directory); the text is left out.

    ``full`` are headers and full texts to compare with, by default those of ``full_texts``.
    """
    names = ["own_license", "cosine", "matched_share", "is_license_file", "license", "inherited_from"]
    kept = [c for c in files.columns if c not in (*names, text_col)]
    found = own_licenses(files.select(*kept, text_col), templates, text_col, least,
                         full_texts() if full is None else full).drop(text_col)
    rows = materialize(found.withColumn("is_license_file", F.col("own_license").isNotNull() & (F.col("matched_share") >= file_share))
                       .withColumn("__dir", directory_of(F.col(path_col))), "licenses")
    speaks = (rows.filter(F.col("is_license_file") & F.col("__dir").isNotNull()).groupBy(F.col("__dir").alias("above"))
              .agg(F.min(F.struct(F.negative("cosine").alias("c"), "own_license")).getField("own_license").alias("license")))
    dirs = rows.filter(F.col("__dir").isNotNull()).select("__dir").distinct()
    parts = F.split("__dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    lines = dirs.select("__dir", F.explode(F.array_distinct(above)).alias("above"))
    nearest = (lines.join(speaks, "above").groupBy("__dir")
               .agg(F.max(F.struct(F.length("above").alias("n"), "above", "license")).alias("near"))
               .select(F.col("__dir").alias("d"), F.col("near.above").alias("from_dir"), F.col("near.license").alias("dir_license")))
    out = rows.join(nearest, F.col("__dir") == F.col("d"), "left")
    return out.select(*kept, "own_license", "cosine", "is_license_file", F.coalesce("own_license", "dir_license").alias("license"),
                      F.when(F.col("own_license").isNull(), F.col("from_dir")).alias("inherited_from"))
