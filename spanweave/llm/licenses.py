"""Licence scans: sparse TF-IDF cosine to templates, then inheritance by path.

Every line of a text, and the text as a whole, is a unit; so is, for each
template and each place of its rarest word in the text, the stretch of words
that a copy of the template around that word would take, whatever the lines, so
that wrapped headers and licences inside paragraphs count in full.  A unit's
vector has tf x idf weights, idf from the document counts of the whole corpus; words that
no template has share the idf of an unseen word.  The best cosine to a template
counts if it reaches the threshold.  Lines that hold only common words cannot
reach it (Cauchy-Schwarz on the template's light part), so a text without any
of the heavy words is passed over exactly, not approximately.

A file without a licence of its own takes that of the nearest directory upwards
that has a licence file (by name) with a recognised licence.

Templates that only differ in rare clauses are told apart by the whole bodies;
of equal cosines the longer template counts.

Defined cases: null or empty text: no own licence; a null path inherits
nothing; ties go to the longer template, then to the name and the path that
sort first; repeated
rows each get a row; an empty table gives an empty table; a long text is scanned
whole; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import byte_texts, materialise

THRESHOLD = 0.6
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice|readme)([.-].*)?$"
# The wording of public licences.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_AS_IS = "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."
_MIT_KEEP = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_END = "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."
_ISC_END = "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness."
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "BSD-2-Clause": [_BSD, f"{_BSD} {_BSD_1} {_BSD_2} {_AS_IS}"],
    "BSD-3-Clause": [f"{_BSD} {_BSD_1} {_BSD_2} {_BSD_3} {_AS_IS}", _BSD_3],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.",
    ],
    "GPL-3.0-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "ISC": [f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}"],
    "MIT": ["Released under the MIT License.", _MIT, f"{_MIT} {_MIT_KEEP} {_MIT_END}"],
    "MIT-0": [f"{_MIT} {_MIT_END}"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}

#: A-Z to lower case; what is not a letter, digit or UTF-8 byte, to a blank.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or b == 10 else 32) for b in range(256))


def tokens(line: bytes) -> list[bytes]:
    return line.translate(_FOLD).split()


def _vocabulary(templates: dict[str, list[str]]) -> list[bytes]:
    return sorted({t for texts in templates.values() for x in texts for t in tokens(x.encode())})


NONE = (0.0, 0, None)


def _better(a: tuple, b: tuple) -> tuple:
    """The better of two (cosine, words, licence)."""
    return min(a, b, key=lambda x: (-x[0], -x[1], x[2] or ""))


class Matcher:
    """Cosines to the templates, given the document counts of their words."""

    def __init__(self, templates: dict[str, list[str]], n: int, df: dict[bytes, int], threshold: float) -> None:
        self.threshold = threshold
        self.idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in _vocabulary(templates)}
        self.unseen = math.log(1 + n) + 1
        self.templates = []
        for name in sorted(templates):
            for text in templates[name]:
                w = {t: c * self.idf[t] for t, c in Counter(tokens(text.encode())).items()}
                self.templates.append((name, w, math.sqrt(sum(x * x for x in w.values())), len(tokens(text.encode()))))
        # the light words: even all of them together stay below the threshold
        light: set[bytes] = set()
        for t in sorted(self.idf, key=lambda t: (self.idf[t], t)):
            more = light | {t}
            if any(math.sqrt(sum(x * x for v, x in w.items() if v in more)) >= 0.999 * threshold * norm for _, w, norm, _ in self.templates):
                break
            light = more
        self.heavy = sorted(set(self.idf) - light, key=lambda t: (self.idf[t], t))
        # rarest word of a template: (template words, place of that word in it), once each
        self.anchors: dict[bytes, set[tuple[int, int]]] = {}
        for name in templates:
            for text in templates[name]:
                words = tokens(text.encode())
                rare = max(words, key=lambda t: (self.idf[t], t))
                self.anchors.setdefault(rare, set()).add((len(words), words.index(rare)))

    def unit(self, words: list[bytes]) -> tuple[float, int, str | None]:
        """(cosine, words of the template, licence) of the best template; ties
        go to the longer one, then to the name that sorts first."""
        count = Counter(words)
        idf, unseen = self.idf, self.unseen
        weight = {t: c * idf.get(t, unseen) for t, c in count.items()}
        norm = math.sqrt(sum(x * x for x in weight.values()))
        best = NONE
        for name, w, size, n in self.templates:
            dot = sum(x * weight[t] for t, x in w.items() if t in weight)
            best = _better(best, (round(dot / (norm * size), 9), n, name) if dot else NONE)
        return best

    def text(self, text: bytes) -> tuple[float | None, str | None]:
        """(cosine, licence) of the best unit at or above the threshold."""
        folded = text.translate(_FOLD)
        if not any(t in folded for t in self.heavy):
            return None, None
        heavy, best = set(self.heavy), NONE
        for unit in [*folded.split(b"\n"), folded]:
            words = unit.split()
            if not heavy.isdisjoint(words):
                best = _better(best, self.unit(words))
        if not self.anchors.keys().isdisjoint(words):  # those of the whole text
            seen = set()
            for p, t in enumerate(words):
                for n, at in self.anchors.get(t, ()):
                    place = (max(0, p - at), min(len(words), p - at + n))
                    if place not in seen:
                        seen.add(place)
                        best = _better(best, self.unit(words[slice(*place)]))
        return (best[0], best[2]) if best[0] >= self.threshold else (None, None)


def _document_counts(vocabulary: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, words = 0, frozenset(vocabulary)
        df: Counter = Counter()
        for batch in batches:
            for text in byte_texts(batch.column(0)):
                n += 1
                df.update(words.intersection(tokens(text)))
        yield pa.RecordBatch.from_arrays([pa.array(["", *(t.decode() for t in df)]), pa.array([n, *df.values()], pa.int64())], names=["token", "n"])

    return run


def matcher(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> Matcher:
    """Count the template words over all texts of ``files``."""
    counted = files.select("text").mapInArrow(_document_counts(_vocabulary(templates)), "token string, n long")
    df = {r["token"]: r["n"] for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}  # a row for each template word
    return Matcher(templates, df.pop("", 0), {t.encode(): n for t, n in df.items()}, threshold)


def _scan(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Matcher = sent.value
        for batch in batches:
            got = [m.text(t) for t in byte_texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[1] for x in got], pa.string()), pa.array([x[0] for x in got], pa.float64())], names=["doc_id", "path", "own", "score"]
            )

    return run


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def scan(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, own_license, own_score, license, declared_in of each row
    of ``files`` (doc_id, path, text).

    license is the own one, or that of the nearest directory upwards with a
    licence file; declared_in names that file, and is null for an own licence.
    """
    files = files.select("doc_id", "path", "text")
    sent = files.sparkSession.sparkContext.broadcast(matcher(files, templates, threshold))
    found = materialise(files.mapInArrow(_scan(sent), "doc_id long, path string, own string, score double"), "licences")
    found = found.withColumn("dir", _directory(F.col("path")))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    declared = found.where(F.col("own").isNotNull() & name.rlike(LICENCE_FILE)).groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "own")).alias("d"))
    declared = declared.select(F.col("dir").alias("up"), F.col("d.path").alias("by"), F.col("d.own").alias("lent"))
    # each directory once, with itself and those above it
    dirs = found.where("dir is not null").select("dir").distinct().withColumn("parts", F.split("dir", "/"))
    above = dirs.select("dir", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"), "parts")
    above = above.select("dir", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("up"))
    nearest = above.join(declared, "up").groupBy("dir").agg(F.max_by(F.struct("lent", "by"), "depth").alias("n"))
    # a table, not an aggregate, so that a directory with very many files can be split over tasks
    out = found.join(materialise(nearest, "nearest"), "dir", "left")
    return out.select(
        "doc_id",
        "path",
        F.col("own").alias("own_license"),
        F.col("score").alias("own_score"),
        F.coalesce("own", "n.lent").alias("license"),
        F.when(F.col("own").isNull(), F.col("n.by")).alias("declared_in"),
    )


def document_path(doc_id: Column, source: Column) -> Column:
    """The place of a document in a tree by source and id: directories of 1000
    and below them of 100 ids.  Of a hundred ids in the even directories the
    first 20 are licence files of their own directory; the next 10 ids of each
    hundred are licence files of the thousand's, and 5 more of the source's."""
    place = F.pmod(doc_id, F.lit(100))
    top = F.concat(F.lit("/"), F.coalesce(source, F.lit("_")))
    middle = F.concat(top, F.lit("/"), F.floor(doc_id / 1000))
    leaf = F.concat(middle, F.lit("/"), F.floor(doc_id / 100))
    licence = F.concat(F.lit("/LICENSE-"), doc_id)
    return (
        F.when((place < 20) & (F.pmod(F.floor(doc_id / 100), F.lit(2)) == 0), F.concat(leaf, licence))
        .when((place >= 20) & (place < 30), F.concat(middle, licence))
        .when((place >= 30) & (place < 35), F.concat(top, licence))
        .otherwise(F.concat(leaf, F.lit("/"), doc_id, F.lit(".txt")))
    )


def scan_documents(docs: DataFrame) -> DataFrame:
    """``scan`` of a documents table."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return scan(docs.select("doc_id", document_path(F.col("doc_id"), F.col("source")).alias("path"), "text"))
