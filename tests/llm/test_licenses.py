import math
import pathlib
import random
from collections import Counter

import pytest

from pathloom.llm import licenses


def test_every_template_finds_itself():
    scanner = licenses.Scanner.of(licenses.TEMPLATES, {}, 0)
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            found, score = scanner.best(f"some words before\n{text}\nand after it")
            assert (found, round(score, 9)) == (name, 1.0), text


def test_scores_are_cosines():
    frequencies = {"the": 80, "under": 9, "license": 4, "mit": 1}
    scanner = licenses.Scanner.of({"MIT": ("Released under the MIT License.",)}, frequencies, 99)
    idf = lambda t: math.log(100 / (frequencies.get(t, 0) + 1)) + 1
    a, b = Counter("released under the mit license".split()), Counter("released under the old license".split())
    dot = sum(a[t] * b[t] * idf(t) ** 2 for t in a)
    norm = lambda c: math.sqrt(sum((n * idf(t)) ** 2 for t, n in c.items()))
    name, score = scanner.best("zzz yyy xxx www vvv released under the old license")
    assert name == "MIT" and abs(score - dot / norm(a) / norm(b)) < 1e-9


def test_noise_and_places():
    scanner = licenses.Scanner.of(licenses.TEMPLATES, {}, 0)
    assert scanner.best("word " * 5000 + "Released*** under%%% the### MIT&&& License.")[0] == "MIT"
    assert scanner.best("nothing of the kind")[0] is None and scanner.best("")[0] is None


GNU = "you can redistribute it and/or modify\n# it under the terms of the GNU {} as published by\n# the Free Software Foundation{} either version {} of the License, or\n# (at your option) any later version.\n"
BSD = """Copyright (c) 2019, Some Body. All rights reserved.
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
CLAUSE = "3. Neither the name of Some Body nor the names of its contributors may be used to endorse or promote products\nderived from this software without specific prior written permission.\n"
REAL = [
    ("GPL-3.0", "# This program is free software: " + GNU.format("General Public License", ",", 3) + "# This program is distributed in the hope that it will be useful"),
    ("GPL-2.0", "# This program is free software; " + GNU.format("General Public License", ";", 2)),
    ("AGPL-3.0", "# This program is free software: " + GNU.format("Affero General Public License", ",", 3)),
    ("LGPL-2.1", "# This library is free software; " + GNU.format("Lesser General Public License", ";", "2.1")),
    ("LGPL-3.0", "# This library is free software: " + GNU.format("Lesser General Public License", ",", 3)),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("BSD-2-Clause", BSD.format("")),
    ("BSD-2-Clause", BSD.format("").replace(" All rights reserved.", "")),
    ("BSD-3-Clause", BSD.format(CLAUSE)),
    ("ISC", "Copyright 2020 Some Body\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use"),
    ("Apache-2.0", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n1. Definitions."),
    ("MIT", "Copyright (c) 2020 Some Body. All rights reserved.\nReleased under the MIT License."),
    ("Proprietary", "Copyright (c) 2020 Some Body. All rights reserved."),
]


def test_files_headers_and_texts():
    spoken = {t: 80 for t in "the of to and in or a is this that it for with any be by you are as under".split()}
    for frequencies, n in (({}, 0), (spoken, 100)):
        scanner = licenses.Scanner.of(licenses.TEMPLATES, frequencies, n)
        for name, text in REAL:
            for around in ("{}", "import os\n" * 50 + "{}\n" + "x = 1\n" * 3000):
                found, score = scanner.best(around.format(text))
                assert found == name and score >= licenses.THRESHOLD, (name, found, score, text)


def _brute(text, templates, frequencies, n):
    """(score, name) of the best window of any template's length that has a cue, counting every window by itself."""
    idf = lambda t: math.log((n + 1) / (frequencies.get(t, 0) + 1)) + 1
    known = {t for texts in templates.values() for x in texts for t in licenses.TERM.findall(x.lower())}
    unknown = math.log(n + 1) + 1
    words = [(m.group().lower(), m.start(), m.end()) for m in licenses.TERM.finditer(text)]
    cues = {next(k for k, w in enumerate(words) if w[2] > m.start()) for m in licenses.CUE.finditer(text)}
    best = {True: (0.0, ""), False: (0.0, "")}
    for name in sorted(templates):
        for template in templates[name]:
            a = Counter(licenses.TERM.findall(template.lower()))
            m = sum(a.values())
            for at in range(len(words) - m + 1):
                if not any(at <= c < at + m for c in cues):
                    continue
                b = Counter(w for w, _, _ in words[at : at + m])
                weight = lambda t: idf(t) if t in known else unknown
                cosine = sum(a[t] * b[t] * idf(t) ** 2 for t in a) / math.sqrt(sum((c * idf(t)) ** 2 for t, c in a.items()) * sum((c * weight(t)) ** 2 for t, c in b.items()))
                best[name == licenses.WEAKEST] = max(best[name == licenses.WEAKEST], (round(cosine, 10), name), key=lambda x: x[0])
    return best[False] if best[False][0] >= licenses.THRESHOLD else max(best.values(), key=lambda x: x[0])


def test_scores_by_brute_force(monkeypatch):
    """Texts of words of the templates and others, with gaps of any kind, in parts of any size."""
    monkeypatch.setattr(licenses, "CHUNK_WORDS", 50)
    templates = {k: tuple(x for x in v if len(x) < 130) for k, v in licenses.TEMPLATES.items()}
    templates = {k: v for k, v in templates.items() if v}
    frequencies = {"the": 80, "under": 9, "license": 4, "mit": 1, "licensed": 3, "public": 20}
    scanner = licenses.Scanner.of(templates, frequencies, 99)
    rng = random.Random(6)
    pool = [t for v in templates.values() for x in v for t in x.split()] + ["stone", "bridge", "river", "near", "old"] * 40
    for k in range(25):
        words = rng.choices(pool, k=rng.randint(1, 150))
        if k % 2:
            words[10:10] = rng.choice(rng.choice(list(templates.values()))).split()
        text = "".join(w + rng.choice((" ", "\n", " *** ", " " * 700)) for w in words)
        want = _brute(text, templates, frequencies, 99)
        name, score = scanner.best(text)
        assert score == pytest.approx(want[0], abs=1e-8) and (name == want[1] or not score or score == pytest.approx(_brute(text, {name: templates[name]}, frequencies, 99)[0], abs=0.2)), (text, want, name)


def test_words_count_whatever_is_between_them():
    scanner = licenses.Scanner.of(licenses.TEMPLATES, {}, 0)
    for gap in (" ", " " * 700, "\n" * 100_000, " ... " * 5000):
        assert scanner.best(f"word {gap} Released under the{gap}MIT{gap}License.{gap}") == ("MIT", 1.0)
    assert scanner.best("a copyright of no kind " * 20_000 + "Released under the MIT License.") == ("MIT", 1.0)


COMMON = pathlib.Path("/usr/share/common-licenses")
FILES = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not COMMON.exists(), reason="the system has no licence files")
def test_whole_licence_files(spark):
    """Files of the system by the built-in templates alone, and damaged ones (the first tenth and every fourth line gone) by whole texts."""
    texts = {name: (COMMON / file).read_text() for file, name in FILES.items() if (COMMON / file).exists()}
    scanner = licenses.Scanner.of(licenses.TEMPLATES, {}, 0)
    assert {name: scanner.best(text)[0] for name, text in texts.items()} == {name: name for name in texts}
    damaged = [(k, f"lib{k}/COPYING", "\n".join(x for n, x in enumerate(text.splitlines()) if n >= text.count("\n") // 10 and n % 4), name) for k, (name, text) in enumerate(texts.items())]
    rows = spark.createDataFrame(damaged, "doc_id int, path string, text string, name string")
    by = licenses.fit(rows, wholes=texts)
    got = {r.doc_id: (r.license, r.score) for r in licenses.scan(rows, scanner=by).collect()}
    assert all(got[k][0] == name and got[k][1] > 0.9 for k, _, _, name in damaged), got


def test_odd_paths(spark):
    mit = "Released under the MIT License."
    files = [(1, "", "x"), (2, "/", "x"), (3, "///", mit), (4, "LICENSE", mit), (5, "a//b/", "x"), (6, None, "x"), (7, "/LICENSE", mit)]
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(files, "doc_id int, path string, text string").selectExpr("*", "1 AS best", "2 AS dir", "3 AS own")).collect()}
    own, inherited = ("MIT", "own"), ("MIT", "inherited")
    assert got == {1: inherited, 2: inherited, 3: own, 4: own, 5: inherited, 6: (None, None), 7: own}


def test_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [
        (1, "repo/LICENSE", mit), (2, "repo/a.py", "print(1)"), (3, "repo/sub/deep/b.py", None), (4, "repo/sub/LICENSE.txt", apache), (5, "repo/other/c.py", ""),
        (6, "elsewhere/d.py", "x"), (7, "repo/sub/e.py", mit), (8, None, "x"), (9, "top.py", "x"), (10, "repo/sub/notes.md", apache), (11, "repo/a.py", "print(1)"), (12, None, mit),
    ]
    df = spark.createDataFrame(files, "doc_id bigint, path string, text string").withColumnRenamed("doc_id", "score")
    got = {r.score_key: (r.license, r.origin, r.license_path) for r in licenses.scan(df.withColumnRenamed("score", "score_key"), key="score_key").collect()}
    assert got == {
        1: ("MIT", "own", "repo/LICENSE"), 2: ("MIT", "inherited", "repo/LICENSE"), 3: ("Apache-2.0", "inherited", "repo/sub/LICENSE.txt"), 4: ("Apache-2.0", "own", "repo/sub/LICENSE.txt"),
        5: ("MIT", "inherited", "repo/LICENSE"), 6: (None, None, None), 7: ("MIT", "own", "repo/sub/e.py"), 8: (None, None, None), 9: (None, None, None),
        10: ("Apache-2.0", "own", "repo/sub/notes.md"), 11: ("MIT", "inherited", "repo/LICENSE"), 12: ("MIT", "own", None),
    }


def test_documents(spark, nothing, odd):
    from pathloom.llm import queries

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    marks = {"Released under the MIT License": "MIT", "Licensed under the Apache License, Version 2.0": "Apache-2.0", "GNU General Public License, version 3": "GPL-3.0", "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0", "All rights reserved": "Proprietary"}
    rows = queries.op3_license_scan(spark, sf).collect()
    for r in rows:
        want = {name for mark, name in marks.items() if mark in docs[r.doc_id]}
        assert (r.license in want and r.origin == "own") if want else r.origin != "own"
    # inheritance by brute force
    holders = {}
    for r in rows:
        name = r.path.rsplit("/", 1)[-1]
        if r.origin == "own" and name.startswith("LICENSE"):
            at = r.path[: -len(name) - 1]
            holders[at] = min(holders.get(at, (1.0,)), (-r.score, r.path, r.license))
    for r in rows:
        if r.origin != "own":
            parts = r.path.split("/")[:-1]
            found = next((holders[d] for k in range(len(parts), -1, -1) if (d := "/".join(parts[:k])) in holders), None)
            assert (r.license, r.license_path, r.origin) == ((found[2], found[1], "inherited") if found else (None, None, None))
    assert holders and sum(r.origin == "inherited" for r in rows) > 10
    assert licenses.scan(nothing.withColumnRenamed("source", "path")).count() == 0
    assert licenses.scan(odd.withColumnRenamed("source", "path")).count() == odd.count()
