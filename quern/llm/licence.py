"""The licence of each repository and source file, from statements found by TF-IDF over word n-grams.

A text is cut into sentences. Stretches of words are turned into TF-IDF vectors over word n-grams and
multiplied, sparsely, against vectors of the licences' names; a stretch is accepted as a name if its
cosine is high enough and beats every other licence by a margin. The sentence around the names, with the
names blanked, is compared in the same way with frames of statements on the work itself and on other
works (bundled copies, helpers, older versions); only the former count. Paragraphs of some length are also
compared with the licences' own wording (grants and notices), so a licence text is known without its name.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources import spread

CONFLICT, UNKNOWN = "CONFLICT", "UNKNOWN"
COSINE, MARGIN, FRAME_MARGIN, LONGEST = 0.8, 0.1, 0.05, 8
#: Paragraphs of so many words or more are compared with licence wording; cosine and margin to be accepted.
BODY_WORDS, BODY_COSINE, BODY_MARGIN = 20, 0.7, 0.02

#: Names of the licences, as words() leaves them.
NAMES = {
    "MIT": ["mit", "mit license", "the mit license", "expat license"],
    "Apache-2.0": ["apache 2", "apache license 2", "apache software license 2", "asl 2", "apache license"],
    "GPL-2.0": ["gpl 2", "gnu gpl 2", "gnu general public license 2", "general public license 2"],
    "GPL-3.0": ["gpl 3", "gnu gpl 3", "gnu general public license 3", "general public license 3"],
    "LGPL-2.1": ["lgpl 2.1", "gnu lgpl 2.1", "gnu lesser general public license 2.1", "lesser general public license 2.1"],
    "LGPL-3.0": ["lgpl 3", "gnu lgpl 3", "gnu lesser general public license 3", "lesser general public license 3"],
    "MPL-2.0": ["mpl 2", "mozilla public license 2"],
    "BSD-3-Clause": ["bsd 3 clause", "bsd 3 clause license", "new bsd 3 clause", "3 clause bsd", "3 clause bsd license", "new bsd license", "modified bsd license"],
    "Unlicense": ["unlicense", "the unlicense", "public domain unlicense"],
    "CC0-1.0": ["cc 0 1", "cc 0", "cc 0 1 universal", "creative commons zero 1", "creative commons zero"],
    "ARR": ["arr", "all rights reserved", "all rights reserved no license granted", "licenseref all rights reserved"],
}
#: Frames around a name, NAME for the name itself.
OWN = [
    "NAME", "license NAME", "licensed under NAME", "spdx license identifier NAME", "licensed under the terms of the NAME", "released under NAME", "the code is released under NAME",
    "all code in this repository NAME", "maintainer confirmed NAME for all code", "sources are under NAME", "terms checked by hand NAME", "NAME re read at the pinned commit",
    "this file is part of the project and is distributed under the NAME", "this file is part of the project under the NAME",
    "use change and sharing are allowed under the terms of the NAME the full wording is in the file that came with the sources",
    "you may pass on the project changed or not as long as you keep to the NAME and leave this notice in place", "diese datei gehört zu und steht unter der lizenz NAME",
    "copyright c the team NAME no license is granted", "copyright c the authors NAME", "this project is licensed under the NAME", "this work is under NAME",
]
FOREIGN = [
    "depends on a helper that is itself NAME", "depends on a library under NAME", "bundles a copy of under NAME which we do not index", "bundles a copy of a library under NAME",
    "the abandoned line was NAME not relevant for this pin", "older versions were under NAME", "previous versions were NAME", "the build script uses a plugin under NAME",
    "parsing loop inspired by a helper that is itself under NAME nothing was copied from it", "inspired by code under NAME", "NAME applies to the bundled copy only",
    "claims NAME could not be verified", "might be NAME to be confirmed", "third party code under NAME", "uses a library that is licensed under NAME",
    "parts of the code come from licensed under the NAME", "portions of this software are copyright of and licensed under NAME", "contains code from which is licensed under NAME", "includes files from distributed under the NAME",
    "ships with a library under NAME", "the vendored library is under NAME", "its dependencies are under NAME", "based on older code that was released under NAME", "adapted from a project licensed under the NAME",
    "formerly licensed under NAME", "was NAME until version", "the fonts and images are under NAME", "not NAME", "the original author used NAME",
]
#: Fixed wording of the licences' grants and of the notices that apply them, one paragraph each.
BODIES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC0-1.0": ["To the extent possible under law, the person who associated this work has waived all copyright and related or neighboring rights to this work and dedicated it to the public domain worldwide."],
}
#: A lower-case name that is also a common word needs one of these near it.
_CUE = re.compile(r"licen[cs]e|lizenz|\bunder\b|\bterms\b|spdx|keep to|confirmed|sources|all code|re-read|\bitself\b|\bline was\b|claims|might be", re.I)
_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:\.\d+)*|[+/]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?!\d)")
_SKIP = {"version", "v"}
_SAME = {"licence": "license", "three": "3", "clauses": "clause", "licences": "license"}


def words(text: str) -> list[tuple[str, int, int]]:
    """Normal words of a text, with where each stands: one spelling of licence, versions without v and .0."""
    out = []
    for m in _TOKEN.finditer(re.sub(r"(?<=[A-Za-z])[vV](?=\.? ?\d)", " ", text)):
        word = m[0].lower()
        if word in _SKIP:
            continue
        if word[0].isdigit():
            while word.endswith(".0"):
                word = word[:-2]
        out.append((_SAME.get(word, word), m.start(), m.end()))
    return out


def _grams(tokens: list[str]) -> Counter:
    return Counter(" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1))


class Vectors:
    """Templates as TF-IDF vectors in an inverted table; cosine of a query with each by a sparse product."""

    def __init__(self, templates: list[tuple[str, str]]):
        grams = [(label, _grams(text.split())) for label, text in templates]
        seen = Counter(g for _, c in grams for g in c)
        self.labels = [label for label, _ in grams]
        self.idf = {g: math.log((1 + len(grams)) / (1 + n)) + 1 for g, n in seen.items()}
        self.new = math.log(1 + len(grams)) + 1
        self.table: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, (_, counts) in enumerate(grams):
            weights = {g: n * self.idf[g] for g, n in counts.items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            for g, w in weights.items():
                self.table[g].append((k, w / norm))

    def best(self, tokens: list[str]) -> dict[str, float]:
        """The highest cosine by label; n-grams of no template count against the query."""
        scores: dict[int, float] = defaultdict(float)
        norm = 0.0
        for g, n in _grams(tokens).items():
            w = n * self.idf.get(g, self.new)
            norm += w * w
            for k, weight in self.table.get(g, ()):
                scores[k] += w * weight
        out: dict[str, float] = {}
        for k, s in scores.items():
            out[self.labels[k]] = max(out.get(self.labels[k], 0.0), s / math.sqrt(norm))
        return out


@functools.lru_cache(maxsize=1)
def _models() -> tuple[Vectors, set[str], Vectors]:
    names = Vectors([(key, name) for key, forms in NAMES.items() for name in forms])
    vocabulary = {w for forms in NAMES.values() for name in forms for w in name.split()}
    frames = Vectors([("own", x) for x in OWN] + [("foreign", x) for x in FOREIGN])
    return names, vocabulary, frames


@functools.lru_cache(maxsize=1)
def _bodies() -> Vectors:
    return Vectors([(key, " ".join(w for w, _, _ in words(text))) for key, texts in BODIES.items() for text in texts])


def body(paragraph: str) -> str | None:
    """The licence whose wording a paragraph is, if any."""
    if len(tokens := [w for w, _, _ in words(paragraph)]) < BODY_WORDS and "unencumbered" not in tokens:
        return None
    ranked = sorted(_bodies().best(tokens).items(), key=lambda x: -x[1])
    if ranked and ranked[0][1] >= BODY_COSINE and (len(ranked) == 1 or ranked[0][1] - ranked[1][1] >= BODY_MARGIN):
        return ranked[0][0]
    return None


@functools.lru_cache(maxsize=65536)
def _name(tokens: tuple[str, ...]) -> tuple[str, float] | None:
    ranked = sorted(_models()[0].best(list(tokens)).items(), key=lambda x: -x[1])
    if ranked and ranked[0][1] >= COSINE and (len(ranked) == 1 or ranked[0][1] - ranked[1][1] >= MARGIN):
        return ranked[0]
    return None


def sentence_names(sentence: str) -> tuple[list[str], list[tuple[str, int, int]], list[tuple[int, int, str]]]:
    """The words, their places, and the names found as (first word, end word, licence), left to right."""
    placed = words(sentence)
    tokens = [w for w, _, _ in placed]
    vocabulary = _models()[1]
    inside = [w in vocabulary for w in tokens]
    options = []
    for i, ok in enumerate(inside):
        if not ok:
            continue
        for j in range(i + 1, min(i + LONGEST, len(tokens)) + 1):
            if inside[j - 1] and (hit := _name(tuple(tokens[i:j]))):
                if j == i + 1 and tokens[i] in ("mit", "arr"):
                    written = sentence[placed[i][1] : placed[i][2]]
                    beside = {*tokens[max(i - 1, 0) : i], *tokens[j : j + 1]} & {"or", "/", "choice"}
                    if not written.isupper() and len(tokens) > 3 and not beside and not _CUE.search(sentence):
                        continue
                options.append((round(hit[1], 6), j - i, -i, j, hit[0]))
    taken: list[tuple[int, int, str]] = []
    for _, _, i, j, name in sorted(options, reverse=True):
        if all(j <= a or -i >= b for a, b, _ in taken):
            taken.append((-i, j, name))
    return tokens, placed, sorted(taken)


def _of_sentence(sentence: str) -> set[str]:
    tokens, placed, names = sentence_names(sentence)
    if not names:
        return set()
    blank: list[str] = []
    last = 0
    groups: list[list[str]] = []
    for k, (i, j, name) in enumerate(names):
        between = tokens[last:i]
        after = j
        if tokens[after : after + 2] == ["or", "later"]:
            after += 2
        elif tokens[after : after + 1] in (["only"], ["+"]):
            after += 1
        if k > 0 and between in (["or"], ["/"], ["or", "at", "your", "choice"], ["or", "at", "your", "option"]):
            groups[-1].append(name)
        else:
            if k > 0 and (m := re.compile(r"\n(?=[^\W\d_a-z])").search(sentence, placed[last - 1][2], placed[i][1])):
                return _of_sentence(sentence[: m.start()]) | _of_sentence(sentence[m.end() :])  # lines of two comments
            blank.extend(between)
            blank.append("NAME")
            groups.append([name])
        last = after
    blank.extend(tokens[last:])
    fit = _models()[2].best([w for w in blank if w not in ("either", "/", "+")])
    if fit.get("foreign", 0.0) > fit.get("own", 0.0) + FRAME_MARGIN:
        return set()
    return {" OR ".join(sorted(set(g))) for g in groups}


def statements(text: str | None) -> set[str]:
    """Licences a text states for the work itself; a free choice is its ids sorted and joined by OR."""
    out: set[str] = set()
    for paragraph in re.split(r"\n\s*\n", text or ""):
        if whole := body(paragraph):
            out.add(whole)
            continue
        for sentence in _SENTENCE.split("\n".join(line.strip() for line in paragraph.split("\n"))):
            out |= _of_sentence(sentence)
    return out


def header(source: str | None) -> str:
    """The comments before the first code line, without their marks."""
    out, at, n = [], 0, len(source or "")
    while at < n:
        if source[at].isspace() or source[at] == "﻿":
            at += 1
        elif source.startswith("/*", at):
            stop = source.find("*/", at + 2)
            stop = n if stop < 0 else stop
            body = source[at + 2 : stop].strip("*")
            out.append("\n".join(re.sub(r"^[ \t]*\*+", "", line) for line in re.split(r"\r\n|\r|\n", body)))
            at = stop + 2
            out.append("\n\n")
        elif source.startswith("//", at):
            m = re.compile(r"[^\r\n]*").match(source, at)
            out.append(m[0].lstrip("/") + "\n")
            at = m.end()
            if not re.match(r"(?:\r\n|\r|\n)[ \t]*//", source[at : at + 80]):
                out.append("\n")
        elif at == 0 and source.startswith("#!"):
            at = source.find("\n") if "\n" in source else n
        else:
            break
    return "".join(out)


def _extract(reader):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(statements(reader(t))) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names[:-1], "found"])

    return run


def repo_licences(roster: DataFrame, repo_files: DataFrame) -> DataFrame:
    """``repo, license`` of each roster entry: its one statement, CONFLICT or UNKNOWN.

    Evidence is the licence field, top-level licence files and readmes, and the notes of an approved
    review. Repeated entries count together; a null repo gives no row; null fields and texts state nothing.
    """
    top = F.lower("path").rlike(r"^[^/]*(licen[cs]e|copying|readme)[^/]*$")
    approved = F.lower(F.trim("license_review.verdict")) == "approved"
    known = roster.where("repo is not null")
    texts = (
        known.select("repo", F.col("license").alias("text"))
        .unionByName(known.where(approved).select("repo", F.col("license_review.notes").alias("text")))
        .unionByName(repo_files.where(top).select("repo", F.col("content").alias("text")))
        .where("text is not null")
    )
    stated = texts.mapInArrow(_extract(lambda t: t), "repo string, found array<string>").select("repo", F.explode("found").alias("one"))
    found = stated.groupBy("repo").agg(F.collect_set("one").alias("all"))
    one = F.when(F.size("all") == 1, F.col("all")[0]).when(F.size("all") > 1, F.lit(CONFLICT)).otherwise(F.lit(UNKNOWN))
    return known.select("repo").distinct().join(found, "repo", "left").select("repo", one.alias("license"))


def file_licences(sources: DataFrame, repos: DataFrame) -> DataFrame:
    """``file_id, repo, path, license`` of each source file, from its header and the result of its repository.

    ``repos`` is what repo_licences gives. A header with different statements is a conflict; one without
    any takes the repository's result; null contents state nothing. A file delivered several times is one
    file, and what its copies state counts together.
    """
    chosen = sources.select("file_id", "repo", "path", "content")
    rows = spread(chosen).mapInArrow(_extract(header), "file_id bigint, repo string, path string, found array<string>")
    files = rows.groupBy("file_id").agg(F.max("repo").alias("repo"), F.max("path").alias("path"), F.array_distinct(F.flatten(F.collect_set("found"))).alias("all"))
    joined = files.join(repos.withColumnRenamed("license", "of_repo"), "repo", "left")
    known = ~F.coalesce("of_repo", F.lit(UNKNOWN)).isin(CONFLICT, UNKNOWN)
    license = (
        F.when(F.size("all") == 0, F.coalesce("of_repo", F.lit(UNKNOWN)))
        .when(F.size("all") > 1, F.lit(CONFLICT))
        .when(known & (F.col("of_repo") != F.col("all")[0]), F.lit(CONFLICT))
        .otherwise(F.col("all")[0])
    )
    return joined.select("file_id", "repo", "path", license.alias("license"))


def directories(files: DataFrame) -> DataFrame:
    """``repo, directory, files, conflicts, unknowns, licenses, verdict`` of every directory, its subdirectories included.

    The verdict is the one licence of all files that have any, CONFLICT if they have several or a file has one
    of its own, UNKNOWN if none has any.
    """
    parts = F.split(F.coalesce("path", F.lit("")), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    rows = files.select("repo", "license", F.explode(above).alias("directory"))
    out = rows.groupBy("repo", "directory").agg(
        F.count("*").alias("files"), F.count_if(F.col("license") == CONFLICT).alias("conflicts"), F.count_if(F.col("license") == UNKNOWN).alias("unknowns"),
        F.array_sort(F.collect_set(F.when(~F.col("license").isin(CONFLICT, UNKNOWN), F.col("license")))).alias("licenses"),
    )
    verdict = F.when((F.col("conflicts") > 0) | (F.size("licenses") > 1), CONFLICT).when(F.size("licenses") == 1, F.col("licenses")[0]).otherwise(UNKNOWN)
    return out.withColumn("verdict", verdict)
