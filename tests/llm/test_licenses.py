import math
import re

from vellum.llm import licenses as m


def brute(files):
    idf, other, units = m.vectors()
    own, notices = {}, {}
    for path, text in files:
        for k, line in enumerate((text or "").split("\n")):
            words = m.terms("".join(c.lower() if c.isascii() else c for c in line))
            weight = {t: words.count(t) * idf.get(t, other) for t in words}
            norm = math.sqrt(sum(w * w for w in weight.values())) or 1
            best = min((-round(sum(w * u.get(t, 0) for t, w in weight.items()) / norm, 9), i) for i, u in enumerate(units))
            if -best[0] >= m.THRESHOLD:
                notices.setdefault(path, set()).add(k)
                own[path] = min(own.get(path, (0, 99, 0)), (best[0], best[1], k))
    held = {}
    for path in own:
        text = dict(files)[path] or ""
        full = sum(bool(x.strip()) for x in text.split("\n"))
        if re.search(m.LICENSE_FILE, path.rpartition("/")[2]) or full <= len(notices[path]):
            d = path.rpartition("/")[0]
            held[d] = min(held.get(d, (9, "")), (own[path][0], m.TEMPLATES[own[path][1]][0]))
    out = []
    for path, _ in files:
        if path in own:
            out.append((path, m.TEMPLATES[own[path][1]][0], "own", None))
            continue
        d = path.rpartition("/")[0]
        while d not in held and d:
            d = d.rpartition("/")[0]
        out.append((path, held[d][1], "inherited", d) if d in held else (path, None, None, None))
    return sorted(out, key=str)


FILES = [
    ("a/LICENSE", "Some Project\n\nReleased under the MIT License."), ("a/x.py", "print(1)"), ("a/b/y.py", None), ("a/b/c/z.py", "// Licensed under the Apache License, Version 2.0"),
    ("a/b/c/w.py", ""), ("a/b/d/only", "All rights reserved.\n"), ("a/b/d/v", "text mit und licensed things in here"), ("b/q", "a license of sorts"), ("LICENSE-x", "x"), ("", "words"),
    ("c/COPYING.txt", "This work is licensed under the GNU General Public License, version 2.\nReleased under the MIT License."), ("c/e/f/g", "n"), ("a/b/d/u", "é" * 20000),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(p, t, 1) for p, t in FILES], "path string, text string, term int")
    got = sorted(((r.path, r.license, r.how, r.licensed_by) for r in m.scan(df).collect()), key=str)
    assert got == brute(FILES)
    assert ("a/b/d/v", "Proprietary", "inherited", "a/b/d") in got and ("c/e/f/g", "MIT", "inherited", "c") in got
    assert m.scan(df.limit(0)).count() == 0
    assert m.scan(spark.createDataFrame([(None, None), (None, "All rights reserved")], "path string, text string")).count() == 2


def test_documents(spark):
    rows = [("/".join((r.source, r.lang, str(r.doc_id))), r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = sorted(((r.path, r.license, r.how, r.licensed_by) for r in m.op5_license_scans(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == brute(rows) and sum(g[2] == "own" for g in got) > 5


def test_anchors_are_exact():
    _, _, units = m.vectors()
    chosen = set(m.anchors(units, m.THRESHOLD))
    for u in units:
        assert math.sqrt(sum(w * w for t, w in u.items() if t not in chosen)) < m.THRESHOLD
    assert "mit" not in chosen


def test_wrapped_and_embedded_notices(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute"
    files = {
        "a/x": ("Copyright 2020 Jane Doe. Released under the MIT License.", "MIT"), "b/x": ("Copyright (c) 2020 Acme Corporation and contributors. All rights reserved.", "Proprietary"),
        "c/x": (f"/* {bsd}\n */\nint main;", "BSD-3-Clause"), "d/x": (grant, "MIT"), "e/LICENSE": ("MIT License\n\nCopyright (c) 2020 Jane Doe", "MIT"), "e/y/z": ("code", "MIT"),
        "f/COPYING": ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "GPL-3.0"), "g/COPYING": ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", None),
        "h/x": ("mit\nthe license of the dog is mit and all the rights", None), "i/x": ("GNU GENERAL PUBLIC LICENSE", "GPL-3.0"),
    }
    df = spark.createDataFrame([(p, t) for p, (t, _) in files.items()], "path string, text string")
    assert {r.path: r.license for r in m.scan(df).collect()} == {p: k for p, (_, k) in files.items()}


def test_rows_with_one_path(spark):
    """Two files of one path are two files: their lines do not mix, and each keeps its own licence."""
    rows = [("a/x", "Released under the MIT License"), ("a/x", "Licensed under the Apache License, Version 2.0"), ("a/x", "code\nmore"), (None, "All rights reserved"), (None, None)]
    got = sorted(((r.path, r.license, r.how) for r in m.scan(spark.createDataFrame(rows, "path string, text string")).collect()), key=str)
    assert [g[1:] for g in got if g[0] == "a/x"] == [("Apache-2.0", "inherited"), ("Apache-2.0", "own"), ("MIT", "own")]


def test_identifiers_and_further_licences(spark):
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    files = {
        "a/x.c": ("// SPDX-License-Identifier: GPL-2.0-only\nint x;", "GPL-2.0"), "b/x.py": ("# SPDX-License-Identifier: MPL-2.0\nx = 1", "MPL-2.0"), "c/LICENSE": (isc, "ISC"),
        "d/UNLICENSE": ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy", "Unlicense"),
        "e/z.h": ("/*\n * This software is provided 'as-is', without any express or implied\n * warranty. In no event will the authors be held liable for any damages\n * arising from the use of this software.\n */", "Zlib"),
        "f/x": ("an spdx license identifier mit is a line of a header", None),
    }
    df = spark.createDataFrame([(p, t) for p, (t, _) in files.items()], "path string, text string")
    assert {r.path: r.license for r in m.scan(df).collect()} == {p: k for p, (_, k) in files.items()}
