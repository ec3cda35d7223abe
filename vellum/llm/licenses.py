"""License scans: sparse TF-IDF cosine to templates, then nearest-ancestor inheritance, in DataFrame functions.

Every line of every whole file is a candidate header or notice. Term weights (tf * idf) use the inverse
document frequencies of the templates; a term no template has gets the largest of them and so pulls the
cosine down. Only lines with an anchor term are weighed: anchors are chosen so that a line without any
cannot reach the threshold with any template (the rest of the template's vector is too short), and of these
only lines whose terms make up enough of some template's vector: both filters are exact. A file's own licence is that of its best line.

Notices that are wrapped over lines or stand inside a longer line are found in term windows: each anchor of a
notice that a file has lays windows of the notice's length over the terms of the whole file, line ends or not, so
that the anchor stands at its place in the notice or up to `SLACK` terms off. Titles of licences count where they
begin a line and end it (or end in a version). A line counts as a notice where all of its terms are in a window.

A licence file (by name, or a file all of whose lines with words are notices) licenses its directory. A file
without a licence of its own takes that of its nearest ancestor directory with one, found by joining the
ancestors of distinct directories with the licensed directories.

Null and empty texts have no licence of their own; a null path is a file at the root with an empty name. Rows
with one path but different texts are different files, told apart by a hash of the text; equal rows get equal
results. Very long texts are whole, extra columns are not read, an empty table gives an empty table. Ties go to the template listed first, then to the first line; between licence
files of one directory to the best cosine, then to the least licence name.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import ascii_lower, settle, shared_folder, table

#: (licence, notice): fixed public wordings.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("Proprietary", "All rights reserved"),
)
THRESHOLD = 0.75
#: (licence, title): the first lines of licence files, met term by term.
TITLES = (
    ("Apache-2.0", "Apache License Version 2.0"), ("Apache-2.0", "Apache License, Version 2"), ("MIT", "MIT License"), ("MIT", "The MIT License"), ("MIT", "MIT License (MIT)"), ("MIT", "The MIT License (MIT)"),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", "The 3-Clause BSD License"), ("GPL-3.0", "GNU General Public License"), ("GPL-3.0", "GNU General Public License Version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License"), ("LGPL-3.0", "GNU Lesser General Public License Version 3"), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("AGPL-3.0", "GNU Affero General Public License"), ("AGPL-3.0", "GNU Affero General Public License Version 3"), ("ISC", "ISC License"), ("Zlib", "zlib License"), ("EPL-2.0", "Eclipse Public License v 2.0"),
    ("BSL-1.0", "Boost Software License Version 1.0"), ("BSD-2-Clause", "BSD 2-Clause License"), ("Unlicense", "The Unlicense"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"), ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"), ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
)
#: Identifiers of the SPDX list that a header line may name after "SPDX-License-Identifier:".
IDENTIFIERS = ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "ISC", "Zlib", "Unlicense", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
SUFFIXES = ("", " only", " or later")
TITLES += tuple((name, f"SPDX License Identifier {name}{suffix}") for name in IDENTIFIERS for suffix in (SUFFIXES if "GPL" in name else ("",)))
SLACK = 2
#: Notices of fewer terms have to stand whole in a window.
SHORT = 5
#: Words of running text in several languages: an anchor only where no other term is left.
COMMON = set(
    "the of and to in a is for be on with this that by at from or an as it you are may not any all use will no if can was has have had which who but they their its our your we he she "
    "i do does did been were would there these those than then so such into out up only more most other some mit der die das und ein eine ist den dem des zu von auf nicht für als auch "
    "le la les de du des un une et en est que qui dans pour par sur au aux ne pas ce se el los las y que del por con para su al lo como pero sus mas o si".split()
)
TERM = r"[a-z0-9]+"
LICENSE_FILE = r"(?i)^(?:licen[cs]e|copying|copyright|notice|unlicense)(?:[.\-_][^/]*)?$"


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def vectors(templates=TEMPLATES) -> tuple[dict[str, float], float, list[dict[str, float]]]:
    """(idf of template terms, idf of all others, unit vector of each template)."""
    n = len(templates)
    df: dict[str, int] = {}
    for _, text in templates:
        for t in set(terms(text)):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    other = math.log(1 + n) + 1
    out = []
    for _, text in templates:
        own = terms(text)
        weight = {t: own.count(t) * idf[t] for t in set(own)}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        out.append({t: w / norm for t, w in weight.items()})
    return idf, other, out


def anchors(units: list[dict[str, float]], threshold: float) -> list[str]:
    """Terms of which every line at the threshold with a template has at least one."""
    chosen: set[str] = set()
    for unit in units:
        # long terms first and words of running text last: the fewer lines have an anchor, the better
        for term in sorted(unit, key=lambda t: (t not in COMMON, min(len(t), 6), unit[t], t), reverse=True):
            if math.sqrt(sum(w * w for t, w in unit.items() if t not in chosen)) < threshold - 1e-9:
                break
            chosen.add(term)
    return sorted(chosen)


def scan_lines(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """path, line_no, template, license, cosine: the best template of every line that reaches the threshold."""
    spark = files.sparkSession
    idf, other, units = vectors(templates)
    marks = "|".join(anchors(units, threshold))
    lines = files.select("path", "tie", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.where(F.col("line").rlike(rf"(?i)(?<![a-z0-9])(?:{marks})(?![a-z0-9])"))
    # a cosine is at most the length of the part of the template's vector whose terms the line has
    every = F.array(*(F.lit(t) for t in sorted(idf)))
    squares = F.array(*(F.array(*(F.struct(F.lit(t).alias("term"), F.lit(w * w).alias("square")) for t, w in sorted(u.items()))) for u in units))
    own = F.regexp_extract_all(ascii_lower(F.col("line")), F.lit(TERM), F.lit(0))
    # generators keep the optimizer from writing these expressions into the lambda below, term by term
    lines = lines.select("path", "tie", "line_no", F.explode(F.array(own)).alias("terms"))
    lines = lines.select("path", "tie", "line_no", "terms", F.explode(F.array(F.array_intersect("terms", every))).alias("shared"))
    zero = F.lit(0.0)
    reach = F.exists(squares, lambda u: F.aggregate(u, zero, lambda a, s: a + F.when(F.array_contains("shared", s["term"]), s["square"]).otherwise(zero)) >= threshold**2 - 1e-9)
    words = lines.where(reach).select("path", "tie", "line_no", F.explode("terms").alias("term"))
    counted = words.groupBy("path", "tie", "line_no", "term").agg(F.count("*").alias("tf"))
    # both tables have a row for each term of the templates at most
    weights = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    entries = spark.createDataFrame([(t, k, w) for k, u in enumerate(units) for t, w in sorted(u.items())], "term string, template int, unit double")
    weighed = counted.join(F.broadcast(weights), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    shares = entries.groupBy("term").agg(F.collect_list(F.struct("template", "unit")).alias("of"))
    per = weighed.join(F.broadcast(shares), "term", "left").groupBy("path", "tie", "line_no")
    # a line's terms are few: its sparse vector is gathered once and met with the templates' vectors
    per = per.agg(F.sum(F.col("w") * F.col("w")).alias("square"), F.flatten(F.collect_list(F.transform(F.coalesce("of", F.array().cast("array<struct<template:int,unit:double>>")), lambda s: F.struct(s["template"].alias("template"), (s["unit"] * F.col("w")).alias("part"))))).alias("parts"))
    dots = per.select("path", "tie", "line_no", F.sqrt("square").alias("norm"), F.explode("parts").alias("p")).groupBy("path", "tie", "line_no", "norm", "p.template").agg(F.sum("p.part").alias("dot"))
    scored = dots.select("path", "tie", "line_no", "template", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine")).where(F.col("cosine") >= threshold)
    best = scored.groupBy("path", "tie", "line_no").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "template")).alias("b"))
    names = F.element_at(F.array(*(F.lit(k) for k, _ in templates)), F.col("b.template") + 1)
    return best.select("path", "tie", "line_no", "b.template", names.alias("license"), (-F.col("b.less")).alias("cosine"))


def scan_windows(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, titles=TITLES) -> DataFrame:
    """path, line_no, template, license, cosine, whole: the lines of every term window that reaches the threshold with its notice, and of titles.

    Titles are numbered after the templates. whole: all terms of the line are in the window.
    """
    idf, other, units = vectors(templates)
    laid, seen = [], set()
    for k, ((_, text), unit) in enumerate(zip(templates, units, strict=True)):
        own, marks = terms(text), set(anchors([unit], threshold))
        for j, term in enumerate(own):
            for shift in range(-SLACK, SLACK + 1) if term in marks else ():
                if (term, k, j + shift) not in seen:
                    seen.add((term, k, j + shift))
                    laid.append((term, k, j + shift, len(own)))
    # a title is looked for at its most telling term
    telling = [max(terms(text), key=lambda t: (t not in COMMON and not t.isdigit(), len(t), t)) for _, text in titles]
    for k, ((_, text), term) in enumerate(zip(titles, telling, strict=True), len(templates)):
        own = terms(text)
        laid += [(term, k, j, len(own)) for j, t in enumerate(own) if t == term]
    by: dict[str, list[str]] = {}
    for term, k, back, size in laid:
        by.setdefault(term, []).append(f"struct({k} AS template, {back} AS back, {size} AS size)")
    # a file is looked at if it has an anchor of a notice or the most telling term of a title
    some = sorted(by)
    held = files.where(F.col("text").rlike(rf"(?i)(?<![a-z0-9])(?:{'|'.join(some)})(?![a-z0-9])"))
    own = F.regexp_extract_all(ascii_lower(F.col("x")), F.lit(TERM), F.lit(0))
    lines = held.select("path", "tie", F.posexplode(F.split("text", "\n")).alias("line_no", "x")).select("path", "tie", "line_no", own.alias("ts")).where(F.size("ts") > 0)
    # terms of a file in order, with their lines; rows with one path are one file
    every = lines.groupBy("path", "tie").agg(F.array_sort(F.collect_list(F.struct("line_no", "ts"))).alias("all"))
    every = every.select("path", "tie", F.expr("flatten(transform(all, l -> transform(l.ts, t -> struct(l.line_no AS l, t AS t))))").alias("terms"))
    case = " ".join(f"WHEN '{t}' THEN array({', '.join(v)})" for t, v in sorted(by.items()))
    marks = ", ".join(f"'{t}'" for t in sorted(by))
    places = every.select("path", "tie", "terms", F.expr(f"filter(transform(terms, (s, i) -> struct(s.t AS t, i AS i)), s -> s.t IN ({marks}))").alias("at")).where(F.size("at") > 0)
    windows = f"""flatten(transform(at, a -> transform(filter(CASE a.t {case} END, w -> a.i >= w.back AND a.i - w.back + w.size <= size(terms)),
        w -> struct(w.template AS template, slice(terms, a.i - w.back + 1, w.size) AS part, get(terms, a.i - w.back - 1) AS before, get(terms, a.i - w.back + w.size) AS after))))"""
    cut = places.select("path", "tie", F.explode(F.expr(windows)).alias("w")).select("path", "tie", "w.template", F.expr("w.before.l").alias("before"), F.expr("w.after").alias("after"), F.expr("w.part.t").alias("ts"), F.expr("w.part.l").alias("ls"))
    weights = F.create_map(*(F.lit(x) for t, w in sorted(idf.items()) for x in (t, w)))
    # get() is null outside of its array: filters may be taken in any order
    vector = F.get(F.array(*(F.create_map(*(F.lit(x) for t, w in sorted(u.items()) for x in (t, w))) for u in units)), "template")
    zero = F.lit(0.0)
    noted = cut.where(F.col("template") < len(templates)).withColumn("unit", vector).withColumn("own", F.array_distinct("ts"))
    noted = noted.where(F.aggregate("own", zero, lambda a, t: a + F.pow(F.coalesce(F.try_element_at("unit", t), zero), F.lit(2))) >= threshold**2 - 1e-9)
    noted = noted.withColumn("idf", weights).withColumn("own", F.transform("own", lambda t: F.struct(t.alias("t"), (F.size(F.filter("ts", lambda x: x == t)) * F.coalesce(F.try_element_at("idf", t), F.lit(other))).alias("w"))))
    dot = F.aggregate("own", zero, lambda a, s: a + s["w"] * F.coalesce(F.try_element_at("unit", s["t"]), zero))
    norm = F.sqrt(F.aggregate("own", zero, lambda a, s: a + s["w"] * s["w"]))
    noted = noted.withColumn("cosine", F.round(dot / norm, 9)).where(F.col("cosine") >= threshold)
    noted = noted.where((F.size("ts") >= SHORT) | (F.col("cosine") >= 1 - 1e-6))  # most of three words is no notice in the midst of prose
    title = F.get(F.array(*(F.array(*(F.lit(t) for t in terms(text))) for _, text in titles)), F.col("template") - len(templates))
    alone = F.col("before").isNull() | (F.col("before") < F.col("ls")[0])
    last = F.element_at("ls", -1)
    ends = F.col("after").isNull() | (last < F.col("after.l")) & ~F.col("after.t").isin("version", "v") | F.element_at("ts", -1).rlike("^[0-9]+$")
    named = cut.where(F.col("template") >= len(templates)).where((F.col("ts") == title) & alone & ends).withColumn("cosine", F.lit(1.0))
    columns = ["path", "tie", "template", "cosine", "before", "after", "ls"]
    found = noted.select(*columns).unionByName(named.select(*columns)).select("*", F.explode(F.array_distinct("ls")).alias("line_no"))
    whole = (F.col("before").isNull() | (F.col("before") < F.col("line_no"))) & (F.col("after").isNull() | (F.col("after.l") > F.col("line_no")))
    names = F.element_at(F.array(*(F.lit(k) for k, _ in (*templates, *titles))), F.col("template") + 1)
    return found.select("path", "tie", "line_no", "template", names.alias("license"), "cosine", whole.alias("whole"))


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, folder: str | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """`carried`, path, license, cosine, how (own, inherited or null) and licensed_by (a directory) of every row."""
    folder = folder or shared_folder(files.sparkSession)
    files = files.select(*carried, F.coalesce("path", F.lit("")).alias("path"), F.xxhash64("text").alias("tie"), "text")
    found = scan_lines(files, templates, threshold).withColumn("whole", F.lit(True)).unionByName(scan_windows(files, templates, threshold))
    found = settle(found, folder, "lines")
    own = found.groupBy("path", "tie").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "template", "line_no", "license")).alias("b"), F.count_distinct(F.when(F.col("whole"), F.col("line_no"))).alias("n_notices"))
    own = settle(own.select("path", "tie", F.col("b.license").alias("license"), (-F.col("b.less")).alias("cosine"), "n_notices"), folder, "own")

    directory = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    name = F.substring_index("path", "/", -1)
    # files all of whose lines with words are notices; only files with a notice are looked at
    sizes = files.select("path", "tie", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))).alias("n"))
    sizes = sizes.join(own.select("path", "tie"), ["path", "tie"], "left_semi").groupBy("path", "tie").agg(F.max("n").alias("n_lines"))
    holders = own.join(sizes, ["path", "tie"]).where(name.rlike(LICENSE_FILE) | (F.col("n_lines") <= F.col("n_notices")))
    licensed = holders.select(directory.alias("licensed_by"), "license", "cosine").groupBy("licensed_by").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("b"))
    licensed = settle(licensed.select("licensed_by", F.col("b.license").alias("dir_license")), folder, "directories")

    directories = files.select(directory.alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = F.concat(F.array(F.lit("")), F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    climbed = directories.select("dir", F.posexplode(up).alias("depth", "licensed_by")).join(licensed, "licensed_by")
    nearest = climbed.groupBy("dir").agg(F.max(F.struct("depth", "licensed_by", "dir_license")).alias("b"))
    nearest = settle(nearest.select("dir", "b.licensed_by", "b.dir_license"), folder, "nearest")

    rows = files.select(*carried, "path", "tie", directory.alias("dir")).join(own.drop("n_notices"), ["path", "tie"], "left").join(nearest, "dir", "left")
    how = F.when(F.col("license").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited")
    by = F.when(F.col("license").isNull(), F.col("licensed_by"))
    return rows.select(*carried, "path", F.coalesce("license", "dir_license").alias("license"), "cosine", how.alias("how"), by.alias("licensed_by"))


def op5_license_scans(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document as a file source/lang/doc_id."""
    documents = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    return scan(documents.select("doc_id", path.alias("path"), "text"), carried=("doc_id",))
