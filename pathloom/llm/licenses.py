"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by path.

Statements are windows of words around terms such as "licence" or "copyright", anywhere in a text, whatever stands between the
words. Each is compared with the templates: terms weigh by their inverse document frequency over all texts, a term that no
template has weighs like one that no text has. A file that is a licence by name is compared as a whole with the whole
texts of licences as well, where such are given. A file without a statement of its own inherits from the nearest
ancestor directory that has a licence file (LICENSE, LICENCE, COPYING, UNLICENSE by name): each file's
directories are exploded, root last, and joined by path.

Defined cases: a null or empty text has no statement; texts of any length are read whole; a null path has no directories and
inherits nothing; an empty path, or one of slashes, is a nameless file in the root; of equal scores the first template by name
wins, but "All rights reserved" only counts where no other licence is stated; of licence files in one directory the best
score, then the first path; rows that repeat a path are files of their own; an empty table gives no rows; columns but
the id, the path and the text are left out, so none can clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.shared import map_text, written

_DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,"
    " THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"
    " in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = _BSD_2 + (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"
    " without specific prior written permission."
)
_FSF = "Free Software Foundation, Inc."


def _gnu(what: str, name: str, version: str, mark: str) -> str:
    """The notice that a file under a GNU licence begins with."""
    return (
        f"This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation,"
        f" either version {version} of the License, or (at your option) any later version."
    )


def _gnu_only(what: str, name: str, version: str) -> str:
    return f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} version {version} as published by the Free Software Foundation."


def _cc(name: str) -> str:
    """The opening of a Creative Commons licence."""
    return (
        f"Creative Commons {name} International Public License. By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions"
        f" of this Creative Commons {name} International Public License"
    )


#: Statements of well-known licences, in common wordings: notices in a sentence, the headers of files, and of the
#: licences' own texts the whole (of short ones) or the sections that tell them from others; fixed values.
TEMPLATES = {
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0", _gnu("program", "Affero General Public License", "3", ":"),
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 " + _FSF,
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", _BSD_2 + _DISCLAIMER),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", _BSD_3 + _DISCLAIMER,
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", _cc("Attribution 4.0")),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", _cc("Attribution-NonCommercial 4.0")),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", _cc("Attribution-ShareAlike 4.0")),
    "CC0-1.0": (
        "Dedicated to the public domain under the CC0 1.0 license.", "SPDX-License-Identifier: CC0-1.0",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
        "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s)",
    ),
    "GFDL-1.2": ("Licensed under the GNU Free Documentation License, Version 1.2.", "GNU Free Documentation License Version 1.2, November 2002 Copyright (C) 2000,2001,2002 " + _FSF),
    "GFDL-1.3": (
        "Licensed under the GNU Free Documentation License, Version 1.3.",
        "GNU Free Documentation License Version 1.3, 3 November 2008 Copyright (C) 2000, 2001, 2002, 2007, 2008 " + _FSF,
    ),
    "GPL-1.0": (_gnu("program", "General Public License", "1", ";"), "GNU GENERAL PUBLIC LICENSE Version 1, February 1989 Copyright (C) 1989 " + _FSF),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0",
        _gnu("program", "General Public License", "2", ";"), _gnu_only("program", "General Public License", "2"),
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 " + _FSF,
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0",
        _gnu("program", "General Public License", "3", ":"), _gnu_only("program", "General Public License", "3"),
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 " + _FSF,
    ),
    "ISC": (
        "Licensed under the ISC License.", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL-2.0": (
        "Licensed under the GNU Library General Public License, version 2.", "SPDX-License-Identifier: LGPL-2.0", _gnu("library", "Library General Public License", "2", ";"),
        "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1991 " + _FSF,
    ),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1", _gnu("library", "Lesser General Public License", "2.1", ";"),
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 " + _FSF,
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0", _gnu("library", "Lesser General Public License", "3", ":"),
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 " + _FSF,
    ),
    "MIT": (
        "Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT",
    ),
    "MPL-1.1": (
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
        "Mozilla Public License Version 1.1 1. Definitions. 1.0.1. Commercial Use",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor",
    ),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense",
    ),
}
#: Says only that rights are kept; where a text has another statement as well, that one counts.
WEAKEST = "Proprietary"
TERM = re.compile(r"[^\W_]+")
#: A statement has one of these terms.
CUE = re.compile(r"licen[cs]|copyright|permission|public domain|rights reserved", re.I)
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([.\-_].*)?$"
THRESHOLD = 0.75
#: Words whose windows are scored at a time.
CHUNK_WORDS = 4096
#: Places that the files of one directory are dealt to.
SALTS = 32


@dataclass
class Scanner:
    """Templates as sparse unit vectors, by term: the places ``starts[c]`` to ``starts[c + 1]`` of ``which`` (template) and ``values``
    are those of term c. ``wholes`` are whole texts of licences, each as the weights of its terms."""

    names: list[str]
    lengths: list[int]
    column: dict[str, int]
    idf: np.ndarray
    unknown: float
    starts: np.ndarray
    which: np.ndarray
    values: np.ndarray
    wholes: list[tuple[str, dict[str, float]]] = field(default_factory=list)

    @classmethod
    def of(cls, templates: dict[str, tuple[str, ...]], frequencies: dict[str, int], n: int, wholes: dict[str, str] | None = None) -> Scanner:
        said = [(name, TERM.findall(text.lower())) for name, texts in sorted(templates.items()) for text in texts]
        counted = [(name, Counter(TERM.findall(text.lower()))) for name, text in sorted((wholes or {}).items())]
        terms = sorted({t for _, ts in said for t in ts} | {t for _, c in counted for t in c})
        idf = np.array([math.log((n + 1) / (frequencies.get(t, 0) + 1)) + 1 for t in terms])
        column = {t: k for k, t in enumerate(terms)}
        entries = []
        for k, (_, ts) in enumerate(said):
            weights = {column[t]: c * idf[column[t]] for t, c in Counter(ts).items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            entries += [(c, k, w / norm) for c, w in weights.items()]
        entries.sort()
        starts = np.searchsorted([c for c, _, _ in entries], np.arange(len(terms) + 1))
        out = cls([name for name, _ in said], [len(ts) for _, ts in said], column, idf, math.log(n + 1) + 1, starts, np.array([k for _, k, _ in entries]), np.array([v for _, _, v in entries]))
        out.wholes = [(name, out._unit(counts)) for name, counts in counted]
        return out

    def _unit(self, counts: Counter) -> dict[str, float]:
        weights = {t: c * (self.idf[self.column[t]] if t in self.column else self.unknown) for t, c in counts.items()}
        norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        return {t: w / norm for t, w in weights.items()}

    def best_whole(self, text: str) -> tuple[str | None, float]:
        """The whole licence nearest to a whole text, and the cosine."""
        own = self._unit(Counter(TERM.findall(text.lower())))
        scores = [(round(sum(w * own.get(t, 0.0) for t, w in weights.items()), 12), name) for name, weights in self.wholes]
        top, name = max(scores, key=lambda x: x[0], default=(0.0, None))
        return (name, float(top)) if top > 0 else (None, 0.0)

    def best(self, text: str, threshold: float = THRESHOLD, whole: bool = False) -> tuple[str | None, float]:
        """The template nearest to any statement of a text, and the cosine; with ``whole`` the whole licence that the text as a whole is
        nearest to, if that reaches the threshold. ``WEAKEST`` only counts if no other template reaches the threshold."""
        if whole and (found := self.best_whole(text))[1] >= threshold:
            return found
        tops: dict[bool, tuple[float, int]] = {True: (0.0, 0), False: (0.0, 0)}
        for words, said in self._stretches(text):
            for k, score in self._scores(words, np.array(said)):
                weak = self.names[k] == WEAKEST
                if (score, -k) > (tops[weak][0], -tops[weak][1]):
                    tops[weak] = (score, k)
        top = max(tops.values(), key=lambda x: (x[0], -x[1])) if tops[False][0] < threshold else tops[False]
        return (self.names[top[1]], float(top[0])) if top[0] > 0 else (None, 0.0)

    def _stretches(self, text: str) -> Iterator[tuple[list[str], list[int]]]:
        """The words of a text, and whether each has a cue, in parts that hold every window with a cue: those within a window's
        length of one, in parts of about CHUNK_WORDS that overlap."""
        cues = CUE.finditer(text)
        cue = next(cues, None)
        if cue is None:
            return
        reach = max(self.lengths)
        words: list[str] = []
        said: list[int] = []
        since = reach
        for found in TERM.finditer(text):
            hit = 0
            while cue is not None and cue.start() < found.end():
                hit, cue = 1, next(cues, None)
            words.append(found.group().lower())
            said.append(hit)
            since = 0 if hit else since + 1
            full = len(words) >= CHUNK_WORDS + 2 * reach
            if full or since == reach:
                if any(said):
                    yield words, said
                words, said = words[len(words) - reach + 1 :], said[len(said) - reach + 1 :]
                if since == reach and cue is None:
                    return
        if any(said):
            yield words, said

    def _scores(self, words: list[str], said: np.ndarray):
        """For each length of templates, (template, cosine) of the best window of so many words that has a cue."""
        ids = np.array([self.column.get(w, -1) for w in words])
        weights = np.where(ids >= 0, self.idf[ids], self.unknown)
        # what each word adds to the product with each template; windows are differences of running sums
        known = np.flatnonzero(ids >= 0)
        n_entries = self.starts[ids[known] + 1] - self.starts[ids[known]]
        rows, ends = np.repeat(known, n_entries), np.cumsum(n_entries)
        at = np.arange(len(rows)) + np.repeat(self.starts[ids[known]] - (ends - n_entries), n_entries)
        parts = np.zeros((len(words), len(self.names)))
        parts[rows, self.which[at]] = self.values[at] * weights[rows]
        sums, cues = np.vstack([np.zeros((1, parts.shape[1])), np.cumsum(parts, axis=0)]), np.concatenate([[0], np.cumsum(said)])
        for n in sorted(set(self.lengths)):
            if n > len(words):
                break
            kinds = [k for k, m in enumerate(self.lengths) if m == n]
            places = np.flatnonzero(cues[n:] > cues[:-n])
            if not len(places):
                continue
            products = (sums[n:] - sums[:-n])[places][:, kinds]
            scores = products / np.sqrt(self._squares(words, weights, n)[places])[:, None]
            for j, k in enumerate(kinds):
                yield k, round(float(scores[:, j].max()), 12)

    @staticmethod
    def _squares(words: list[str], weights: np.ndarray, n: int) -> np.ndarray:
        """The squared norms of all windows of n words: a word that is there c times weighs c times."""
        counts: dict[str, int] = {}
        out, total, w = [], 0.0, weights.tolist()
        for k, word in enumerate(words):
            c = counts.get(word, 0)
            total += w[k] * w[k] * (2 * c + 1)
            counts[word] = c + 1
            if k >= n:
                old = words[k - n]
                c = counts[old]
                total -= w[k - n] * w[k - n] * (2 * c - 1)
                counts[old] = c - 1
            if k >= n - 1:
                out.append(total)
        return np.array(out)


def fit(df: DataFrame, text: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, wholes: dict[str, str] | None = None) -> Scanner:
    """A scanner whose weights come from all texts: counts of the templates' terms, a bounded number. ``wholes``: whole texts of
    licences by name, for files that are licences by name."""
    terms = {t for texts in [*templates.values(), tuple((wholes or {}).values())] for x in texts for t in TERM.findall(x.lower())}

    def fn(texts: list[str]) -> list[list]:
        return [[[t for t in terms.intersection(TERM.findall(x.lower()))] for x in texts]]

    counted = map_text(df.select(text), text, {"terms": "array<string>"}, fn, drop=(text,)).select(F.explode(F.concat("terms", F.array(F.lit("")))).alias("term")).groupBy("term").count()
    found = {r["term"]: r["count"] for r in counted.collect()}
    return Scanner.of(templates, found, found.get("", 0), wholes)


def directories(path: str) -> F.Column:
    """The ancestor directories of a path, nearest first, down to the root ''."""
    parts = F.filter(F.split(F.col(path), "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.greatest(F.size(parts) - 1, F.lit(0)), F.lit(0)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(F.col(path).isNotNull(), above)


def scan(df: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", scanner: Scanner | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``key, path, license, score, origin, license_path`` for each file; origin is own, inherited or null."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(scanner or fit(df, text))  # a few hundred terms

    def read(whole: bool):
        def fn(texts: list[str]) -> list[list]:
            found = [shared.value.best(t, threshold, whole) for t in texts]
            return [[n for n, _ in found], [s for _, s in found]]

        return fn

    files = df.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(text).alias("text"))
    named = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE), F.lit(False))
    scores = lambda rows, whole: map_text(rows, "text", {"nearest": "string", "score": "double"}, read(whole), drop=("text",))
    scored = scores(files.where(~named), False).union(scores(files.where(named), True)) if shared.value.wholes else scores(files, False)
    scored = written(scored.withColumn("own", F.when(F.col("score") >= threshold, F.col("nearest"))), "license-scores")
    own = scored.where("own is not null").select("key", "path", F.col("own").alias("license"), "score", F.lit("own").alias("origin"), F.col("path").alias("license_path"))
    name = F.element_at(F.split("path", "/"), -1)
    holders = scored.where(F.col("own").isNotNull() & name.rlike(LICENSE_FILE)).withColumn("dir", F.get(directories("path"), F.lit(0)))
    holders = holders.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("rank"), "path", "own", "score")).alias("best"))
    rest = scored.where("own is null").select("key", "path")
    rest = written(rest, "license-rest")
    # distinct directories inherit once, files take what their directory has
    near = rest.where("path is not null").select(F.get(directories("path"), F.lit(0)).alias("dir")).distinct()
    above = near.select("dir", F.posexplode(F.concat(F.array("dir"), F.when(F.col("dir") != "", directories("dir")).otherwise(F.array().cast("array<string>")))).alias("far", "up"))
    given = above.join(holders.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.min(F.struct("far", "best")).alias("found")).select("dir", "found.best")
    # files of one directory meet its licence in SALTS places
    given = given.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    inherited = rest.withColumn("dir", F.get(directories("path"), F.lit(0))).withColumn("salt", F.pmod(F.xxhash64("key", "path"), F.lit(SALTS)).cast("int")).join(given, ["dir", "salt"], "left")
    inherited = inherited.select("key", "path", F.col("best.own").alias("license"), F.col("best.score").alias("score"), F.when(F.col("best").isNotNull(), "inherited").alias("origin"), F.col("best.path").alias("license_path"))
    return own.union(inherited).withColumnRenamed("key", key)
