"""License notices in texts: MinHash bands over overlapping windows, then exact shingle containment.

Only DataFrame functions. Templates are put in classes of similar size. A window of a class is one and
a half times as long as its largest template, and windows begin half such a length apart, so that a
notice lies wholly in one of them. Where a window holds 0.8 of a template that is half as long as the
largest of its class, the two have a Jaccard similarity of 0.4 / 1.6, a quarter. As a band is one
MinHash value, such a notice is retrieved with a probability of at least 1 - (3/4) ** BANDS, 0.99994,
if none of the shingles it lacks carries a word of VARIANT: those are required.
Shingles that carry a version or variant must all be there, and where templates share their words the
one with most of them is reported. SPDX lines are read by a pattern. Only the shingle that is a template's smallest under one of the hash
functions can give an equal band, so texts without any of these shingles have no window to hash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import small_side
from sensorloom.sources.scratch import written

#: Words in a shingle, MinHash values of a window, share of a template's shingles that a notice holds.
SHINGLE, BANDS, LEAST = 3, 34, 0.8
#: Shingles of the largest template of the first class; each further class has twice as many.
FIRST_CLASS = 6

_GNU = "{thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = f"{_BSD}: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

# Public notices by SPDX name, with the form of the notice behind it where there are several.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause-or-BSD-3-Clause": _BSD,
    "BSD-2-Clause": f"{_BSD_TWO} This software is provided by the copyright holders and contributors as is",
    "BSD-3-Clause": f"{_BSD_TWO} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    **{f"CC-{k}-4.0" + ("" if k == "BY" else "-text"): f"This work is licensed under a Creative Commons {v} 4.0 International License." for k, v in _CC.items()},
    **{f"CC-{k}-3.0-text": f"This work is licensed under a Creative Commons {v} 3.0 Unported License." for k, v in (_CC | {"BY-ND": "Attribution-NoDerivs", "BY-NC-ND": "Attribution-NonCommercial-NoDerivs"}).items()},
    **{f"CC-{k}-{n}" + ("-short" if k == "BY" else ""): f"Licensed under CC {k} {n}." for k in _CC for n in ("4.0", "3.0")},
    "CC0-1.0-text": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    **{f"{k}": f"This work is licensed under the GNU {v}." for k, v in {
        "GPL-2.0": "General Public License, version 2", "GPL-3.0": "General Public License, version 3", "LGPL-2.1": "Lesser General Public License, version 2.1",
        "LGPL-3.0": "Lesser General Public License, version 3", "AGPL-3.0": "Affero General Public License, version 3",
    }.items()},
    "GPL-2.0-only-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "GPL-2.0-or-later-header": _GNU.format(thing="This program", kind="General Public License", version="2"),
    "GPL-3.0-or-later-header": _GNU.format(thing="This program", kind="General Public License", version="3"),
    "LGPL-2.0-or-later-header": _GNU.format(thing="This library", kind="Library General Public License", version="2"),
    "LGPL-2.1-or-later-header": _GNU.format(thing="This library", kind="Lesser General Public License", version="2.1"),
    "LGPL-3.0-or-later-header": _GNU.format(thing="This library", kind="Lesser General Public License", version="3"),
    "AGPL-3.0-or-later-header": _GNU.format(thing="This program", kind="Affero General Public License", version="3"),
    "ISC-text": f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.",
    "0BSD-text": f"{_ISC}. The software is provided as is and the author disclaims all warranties",
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "Unlicense-text": "This is free and unencumbered software released into the public domain",
}

#: Words of versions and variants; a shingle of a template with one of them must be in the text.
VARIANT = r"(^| )([0-9]+|noncommercial|sharealike|noderivatives|noderivs|nc|sa|nd|general|lesser|gnu library|library general|affero|later|endorse|mit|distribution this)( |$)"

_ID = r"\(*[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?\)*"
#: The expression of an SPDX line.
SPDX = rf"(?i:SPDX-License-Identifier):[ \t]*({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)"


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles_of(words: Column) -> Column:
    """The runs of SHINGLE words as texts, in order."""
    last = F.size(words) - SHINGLE + 1
    at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws(" ", *[F.element_at(words, i + j) for j in range(SHINGLE)]))


def hashed(shingles: Column) -> Column:
    return F.transform(shingles, lambda s: F.xxhash64(s))


def band(hashes: Column, i: int) -> Column:
    """Smallest value of the hashes under hash function i."""
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(i))))


def _windows(size_class: int) -> Column:
    """Class, first shingle and length of each window over the column hashes."""
    length = FIRST_CLASS * 2**size_class
    at = F.sequence(F.lit(0), F.size("hashes") - 1, F.lit(length // 2))
    kind, size = F.lit(size_class).alias("class"), F.lit(length + length // 2).alias("length")
    return F.transform(at, lambda s: F.struct(kind, s.alias("start"), size))


def _spdx_lines(docs: DataFrame) -> DataFrame:
    """doc_id, license, containment and first_word of each SPDX line."""
    marked = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").rlike(SPDX))
    between = F.transform(F.split("text", SPDX), lambda t: F.size(words_of(t)))
    lines = F.transform(F.regexp_extract_all("text", F.lit(SPDX), F.lit(0)), lambda t: F.size(words_of(t)))
    names = F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))
    parts = marked.select("doc_id", between.alias("between"), lines.alias("lines"), F.posexplode(names).alias("i", "license"))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    first = total(F.slice("between", F.lit(1), F.col("i") + 1)) + total(F.slice("lines", F.lit(1), F.col("i")))
    return parts.select("doc_id", "license", F.lit(1.0).alias("containment"), first.alias("first_word"))


def scan_licenses(docs: DataFrame, notices: Mapping[str, str] = NOTICES, least: float = LEAST) -> DataFrame:
    """(doc_id, license, containment, first_word, windows) for each doc_id and notice that its text holds.

    containment is the largest share of the notice's distinct shingles in one window, at least `least`;
    all shingles with a word of VARIANT must be in it. Where several notices share most of their words in
    the text, the one with most shingles there is given. An SPDX line gives its expression as license.
    first_word the first word of the first such window, counted from 0; windows their number. Null,
    empty and short texts hold nothing. Rows that share a doc_id (or have none) are put together. A
    notice needs SHINGLE + 2 words. An empty table gives an empty result. Columns other than
    doc_id and text are left out.
    """
    spark = docs.sparkSession
    each = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("notice")) for k, v in sorted(notices.items())])
    listed = spark.range(1).select(F.inline(each))
    shingles = F.array_distinct(shingles_of(words_of(F.col("notice"))))
    required = F.filter("template", lambda s: s.rlike(VARIANT))
    sized = listed.select("license", shingles.alias("template")).withColumns({"size": F.size("template"), "required": required})
    size_class = F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / FIRST_CLASS))).cast("int")
    templates = written(sized.withColumn("class", size_class).withColumn("hashes", hashed(F.col("template"))))
    if templates.where(F.col("size") < 3).limit(1).count():
        raise ValueError(f"a notice needs {SHINGLE + 2} words")
    # One row for each notice and band; as many as the notices given by the caller.
    bands = written(templates.select("license", "class", F.posexplode(F.array(*[band(F.col("hashes"), i) for i in range(BANDS)])).alias("band", "value")))
    classes = [r["class"] for r in templates.select("class").distinct().orderBy("class").collect()]
    smallest = templates.select(F.explode("hashes").alias("h"), "license").join(bands, "license")
    is_least = smallest.where(F.xxhash64("h", F.col("band")) == F.col("value"))
    anchors = [r["h"] for r in is_least.select("h").distinct().collect()]  # a notice has BANDS at most
    # Each array goes through a generator of one row: Spark would otherwise copy its expression into the
    # filters and lambdas below and split the text again for every shingle.
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.explode(F.array(words_of(F.col("text")))).alias("words"))
    hashes = rows.select("doc_id", "row", "words", F.explode(F.array(hashed(shingles_of(F.col("words"))))).alias("hashes"))
    texts = hashes.where(F.exists("hashes", lambda h: h.isin(anchors)))
    starts = [_windows(c) for c in classes]
    window = texts.select("doc_id", "row", "words", "hashes", F.explode(F.concat(*starts)).alias("w")).select(
        "doc_id", "row", "w.class", "w.start", F.slice("hashes", F.col("w.start") + 1, F.col("w.length")).alias("hashes"), F.slice("words", F.col("w.start") + 1, F.col("w.length") + SHINGLE - 1).alias("words")
    )
    held = window.where(F.exists("hashes", lambda h: h.isin(anchors)))
    values = held.select("doc_id", "row", "class", "start", "words", F.array(*[band(F.col("hashes"), i) for i in range(BANDS)]).alias("values"))
    keyed = values.select("doc_id", "row", "class", "start", "words", F.posexplode("values").alias("band", "value"))
    found = keyed.join(small_side(bands), ["class", "band", "value"]).select("doc_id", "row", "start", "words", "license").distinct()
    own = found.select("doc_id", "row", "start", "license", F.explode(F.array(shingles_of(F.col("words")))).alias("own"))
    checked = own.join(small_side(templates.select("license", "template", "size", "required")), "license")
    shared = F.size(F.array_intersect("own", "template"))
    whole = F.size(F.array_except("required", "own")) == 0
    kept = checked.where(whole).withColumns({"shared": shared, "containment": shared / F.col("size")}).where(F.col("containment") >= least)
    # Of the notices that hold a place of the text the one with most shingles has it, then the densest; a notice that has
    # half of its places or fewer is part of another.
    places = F.filter(F.transform("own", lambda s, i: F.when(F.array_contains("template", s), F.col("start") + i)), lambda i: i.isNotNull())
    hit = ["doc_id", "row", "start", "license", "containment"]
    placed = kept.select(*hit, "shared", F.explode(F.array(places)).alias("places"))
    span = F.array_min("places") - F.array_max("places")
    placed = placed.select(*hit, F.struct("shared", "containment", span.alias("span"), "license").alias("rank"), F.explode("places").alias("place"))
    best = F.max("rank").over(Window.partitionBy("row", "place"))
    first = placed.select(*hit, best.alias("best")).withColumn("own", (F.col("best.license") == F.col("license")).cast("double"))
    alone = first.groupBy(*hit).agg(F.avg("own").alias("own")).where(F.col("own") > 0.5)
    rows = alone.select("doc_id", "license", "containment", F.col("start").alias("first_word")).unionByName(_spdx_lines(docs))
    return rows.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("first_word").cast("long").alias("first_word"), F.count(F.lit(1)).alias("windows"))
