"""Licence scan against a plain computation of cosines and ancestors."""

import math
import re
from collections import Counter
from pathlib import Path

from alamatika.llm import licences as L


BSD = """// Copyright 2019 The Example Authors. All rights reserved.
// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are
// met:
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
APACHE = """# Copyright 2021 Someone
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
import os
"""
GPL = """/* This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version. */
int main;
"""


def terms(text):
    return [t for t in re.split(r"[^a-z0-9.]+|\.(?![0-9])", text.lower()) if t]


def plain(files):
    def texts_of(path, content):
        content = content or ""
        lines, out = content.split("\n"), set()
        if re.search(L.HEADER_LINE, content):
            marks = [k for k, x in enumerate(lines) if re.search(L.HEADER_LINE, x)]
            out.add("\n".join(lines[k] for k in marks))
            out.add("\n".join(x for k, x in enumerate(lines) if any(abs(k - m) <= L.AROUND for m in marks)))
            plain = [k for k, x in enumerate(lines) if not re.search(L.COMMENT_LINE, x)]
            out.add("\n".join(lines[: plain[0] if plain else None]))
        if re.search(L.LICENCE_FILE, path or ""):
            out.add(content)
        return out - {""}

    def spdx_of(content):
        m = re.search(L.SPDX, content or "")
        return re.sub(L.SPDX_SUFFIX, "", m[1]) if m else None

    texts = {t for p, c in files if not spdx_of(c) for t in texts_of(p, c)}
    templates = [(name, t) for name, all_ in L.TEMPLATES.items() for t in all_]
    bags = [(None, t, Counter(terms(t))) for t in texts] + [(n, t, Counter(terms(t))) for n, t in templates]
    bags = [b for b in bags if b[2]]
    df = Counter(w for b in bags for w in b[2])

    def vector(bag):
        v = {w: n * (math.log((len(bags) + 1) / (df[w] + 1)) + 1) for w, n in bag.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    named = [(n, vector(b)) for n, _, b in bags if n]
    own = {}
    for n, t, bag in bags:
        if n is None:
            v = vector(bag)
            best = min((-round(sum(x * u.get(w, 0) for w, x in v.items()), 9), name) for name, u in named)
            if -best[0] >= L.MIN_COSINE:
                own[t] = best

    def best_of(path, content):
        if spdx_of(content):
            return -1.0, spdx_of(content)
        return min((own[t] for t in texts_of(path, content) if t in own), default=None)

    holders = {}
    for p, c in files:
        if p and re.search(L.LICENCE_FILE, p) and best_of(p, c):
            far, name = best_of(p, c)
            folder = p.rpartition("/")[0]
            holders[folder] = min(holders.get(folder, (9, "", "")), (far, p, name))
    out = []
    for p, c in files:
        if best_of(p, c):
            out.append((p, best_of(p, c)[1], None))
            continue
        folder = None if p is None else p.rpartition("/")[0]
        while folder is not None and folder not in holders and folder:
            folder = folder.rpartition("/")[0]
        found = holders.get(folder) if folder is not None else None
        out.append((p, found[2] if found else None, folder if found else None))
    return out


def test_against_plain(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [
        ("a/LICENSE", mit), ("a/COPYING", "nothing of the kind"), ("a/b/c/x.txt", "plain text"),
        ("a/b/LICENSE.md", f"Jl. Merdeka\n{gpl}"), ("a/b/c/y.txt", "first\n" + gpl.upper() + "\nlast"),
        ("a/z.txt", None), ("q/only.txt", "Licensed under CC BY-NC 4.0."), ("q/r.txt", ""), ("root.txt", "copyright me"),
        (None, "no path"), (None, mit), ("a/z.txt", None), ("a/bb/t.txt", "Licensed under the Apache License, Version 2.0."),
        ("h/bsd.c", "int x;\n" + BSD + "int y;\n" * 9), ("h/mpl.js", MPL + "let a = 1\n" * 9), ("h/apache.py", APACHE),
        ("h/gpl.c", GPL), ("h/s.c", "/* SPDX-License-Identifier: MIT */\nint z;"), ("h/LICENSE", "SPDX-License-Identifier: GPL-3.0-or-later"),
        ("h/odd.c", "SPDX-License-Identifier: (EUPL-1.2 OR MIT)"), ("p/LICENSE-1", "one prose line of no matter\n" + mit),
        ("p/prose.txt", "words of prose\n" * 30 + mit + "\n" + "more words of prose\n" * 30), ("p/free.txt", "free software is nice"),
        ("deep/" * 40 + "f", "word " * 3000), ("LICENSE", "all rights reserved by nobody at all"), ("a//w.txt", "x"),
    ]
    df = spark.createDataFrame([(p, c, "k") for p, c in files], "path string, content string, key string")
    got = [(r["path"], r["licence"], r["inherited_from"]) for r in L.scan_licences(df).collect()]
    order = lambda rows: sorted(rows, key=repr)
    assert order(got) == order(plain(files))
    assert ("a/b/c/x.txt", "GPL-3.0", "a/b") in got and ("a/z.txt", "MIT", "a") in got
    named = {p: n for p, n, inherited in got if inherited is None}
    assert named["h/bsd.c"] == "BSD-3-Clause" and named["h/mpl.js"] == "MPL-2.0" and named["h/apache.py"] == "Apache-2.0"
    assert named["h/gpl.c"] == named["h/LICENSE"] == "GPL-3.0" and named["h/s.c"] == "MIT" and named["h/odd.c"] == "EUPL-1.2"
    assert named["p/LICENSE-1"] == named["p/prose.txt"] == "MIT" and ("p/free.txt", "MIT", "p") in got
    assert L.scan_licences(df.limit(0)).count() == 0


def test_complete_licence_files(spark):
    """Complete files, with copyright lines, in other case and line breaks, name their folder."""
    names = ["Apache-2.0", "BSD-3-Clause", "GPL-3.0", "MIT", "MPL-2.0"]
    whole = {n: (Path(L.__file__).parent / f"licence_texts/{n}.txt").read_text() for n in names}
    files = []
    for n in names:
        text = "Copyright (c) 2020 Somebody Else\n" + " ".join(whole[n].split())
        files += [(f"{n}/a/LICENSE", text), (f"{n}/a/x/f.txt", "plain"), (f"{n}/b/COPYING", text.upper()), (f"{n}/b/g.txt", "")]
    files.append(("c/f.txt", "plain"))
    df = spark.createDataFrame(files, "path string, content string")
    for r in L.scan_licences(df).collect():
        assert r["licence"] == {"c": None}.get(r["path"].split("/")[0], r["path"].split("/")[0]), r
