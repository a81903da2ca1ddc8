"""License scans: MinHash bands over overlapping windows of words retrieve templates, exact containment verifies them.

A text's words are hashed in runs of five. A template of t runs belongs to windows of w runs, w being the smallest power
of two that is at least 2t, that start at every multiple of w / 2: an occurrence of the template lies inside one of them.
A window's signature are minima of its hashed runs under fixed permutations, one for each band, so that a window that
holds 75 % of a template (at least 0.19 of the union of both) shares a band with a probability above 1 - 1e-5. Templates
are retrieved by these bands alone, and for each that shares one, the share of its runs in the window is counted exactly.

A window that qualifies holds at least 75 % of the runs of the smallest template of its size, so a window with fewer runs of
any template is left out before a signature is made; this loses nothing. Whether some template has a run is looked up
in a Bloom filter of 64 bits and four places a run, which lets one other run in some 70,000 pass. So a text costs one hash a word, one
a run and one look at each run; signatures are made for windows that most often hold a template.

All of it are DataFrame functions in one pass; texts are neither shuffled nor written. Templates are a parameter, or a table
(template, license, text), of some thousand texts at most: their runs are made on the driver into the filter, a literal of
eight bytes a run, and a window meets the templates of its own size.

Covered: the notices and headers below, and the short licenses in full (MIT, BSD, ISC, zlib, Unlicense). The long texts of
the Apache, GNU, Mozilla and Creative Commons licenses are found by their headers; give their texts as a table for more.

Defined results: a null text has no words; a text of fewer than five words is one run; letters A-Z count as a-z; a
document that repeats a license has one row for it, of its best window, the earliest on a tie; rows of equal doc_id are
scanned each for itself; an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHIFTS = (0, 15, 30, 45)  #: of the four places of a hash in the filter
WORD = r"[^\x20\x09-\x0D]+"

#: (name, license, text): fixed values, the usual notices of public licenses.
TEMPLATES = (
    ("mit-notice", "MIT", "Released under the MIT License."),
    ("mit-grant", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("apache-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-header", "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-notice", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-header", "GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-work", "CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("bsd-grant", "BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("mit-warranty", "MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd-clauses", "BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-name", "BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-warranty", "BSD-2-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"),
    ("zlib", "Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("mpl-header", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("lgpl-header", "LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl-header", "AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc-grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)


Templates = tuple[tuple[str, str, str], ...] | DataFrame


@dataclass(frozen=True)
class LicenseOptions:
    run: int = 5  #: words of a run
    share: float = 0.75  #: of a template's distinct runs, to be found in one window
    missed: float = 1e-5  #: probability that a window that qualifies shares no band


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; in a lambda, a plain expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(text: Column, size: int) -> Column:
    """Hashes of a text's runs of words, in order."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.transform(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))

    def cut(w: Column) -> Column:
        long = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))
        return F.when(F.size(w) >= size, long).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<long>"))

    return let(words, cut)


def signature(window: Column, bands: int) -> Column:
    """The minimum of each band's permutation over a window's runs."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_min(F.transform(window, lambda h: F.xxhash64(h, b))))


def templates(spark: SparkSession, texts: Templates, o: LicenseOptions) -> DataFrame:
    """(template, license, runs, window): distinct runs and the length of the windows to look in."""
    rows = texts if isinstance(texts, DataFrame) else spark.createDataFrame(list(texts), "template string, license string, text string")
    rows = rows.select("template", "license", F.array_distinct(runs(F.col("text"), o.run)).alias("runs"), F.size(runs(F.col("text"), o.run)).alias("length")).where("length > 0")
    return rows.withColumn("window", F.pow(F.lit(2), F.ceil(F.log2(F.col("length") * 2))).cast("int"))


def bloom(values: list[int]) -> Callable[[Column], Column]:
    """A test that all of some hashes pass, and about one in 70,000 of the others: four bits of 64 a value."""
    bits = max(16, math.ceil(math.log2(64 * max(1, len(values)))))
    held = [0] * (1 << (bits - 6))
    for v in values:
        for shift in SHIFTS:
            place = ((v & (1 << 64) - 1) >> shift) % (1 << bits)
            held[place >> 6] |= 1 << (place & 63)
    words = F.lit(np.array(held, np.uint64).view(np.int64))  # one literal, which all looks share

    def bit(h: Column, shift: int) -> Column:
        place = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        word = F.get(words, F.shiftright(place, 6).cast("int"))
        return F.call_function("shiftright", word, (place % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

    return lambda h: reduce(lambda a, b: a & b, (bit(h, shift) for shift in SHIFTS))


def scan(docs: DataFrame, texts: Templates = TEMPLATES, options: LicenseOptions = LicenseOptions()) -> DataFrame:
    """(row, doc_id, template, license, found, share, first_run): the templates in each document, with their best window's first run."""
    o, spark = options, docs.sparkSession
    known = templates(spark, texts, o)
    held = known.collect()  # a parameter's rows, not data
    bands = math.ceil(math.log(o.missed) / math.log(1 - o.share / (4 + 1 - o.share)))
    listed = bloom(sorted({h for r in held for h in r.runs}))
    least = {w: min(math.ceil(o.share * len(r.runs)) for r in held if r.window == w) for w in sorted({r.window for r in held})}

    def of_size(r: Column, places: Column, w: int) -> Column:
        """The windows of w runs with enough runs of templates. places: those of such runs."""
        last = lambda i: F.floor(i * 2 / w).cast("int")
        around = F.array_distinct(F.flatten(F.transform(places, lambda i: F.sequence(F.greatest(F.lit(0), last(i) - 1), last(i)))))
        found = F.transform(around, lambda j: F.struct(F.lit(w).alias("window"), (j * w / 2).cast("int").alias("first"), F.slice(r, (j * w / 2).cast("int") + 1, w).alias("part")))
        return F.filter(found, lambda x: F.size(F.filter(x["part"], listed)) >= least[w])

    def windows(r: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: listed(F.get(r, i)))
        return let(places, lambda p: F.when(F.size(p) > 0, F.flatten(F.array(*(of_size(r, p, w) for w in least)))))

    # no filter on the windows before they are exploded: it would make them twice
    held_in = let(runs(F.col("text"), o.run), lambda r: F.when(F.size(r) > 0, windows(r))) if held else F.lit(None).cast("array<struct<window:int,first:int,part:array<long>>>")
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.explode(held_in).alias("w"))
    cut = rows.select("row", "doc_id", "w.window", "w.first", F.array_distinct("w.part").alias("part"))
    signed = cut.withColumn("signature", signature(F.col("part"), bands))
    of = known.select("template", "license", "window", F.col("runs").alias("own"), signature(F.col("runs"), bands).alias("bands"))
    # a band's number is hashed into its minima, so equal values are of one band
    pairs = signed.join(F.broadcast(of), "window").where(F.arrays_overlap("signature", "bands"))
    matched = pairs.withColumn("found", F.size(F.array_intersect("part", "own"))).withColumn("share", F.col("found") / F.size("own")).where(F.col("share") >= o.share)
    best = F.max_by(F.struct("found", "share", F.col("first").alias("first_run")), F.struct("found", -F.col("first")))
    return matched.groupBy("row", "doc_id", "template", "license").agg(best.alias("b")).select("row", "doc_id", "template", "license", "b.*")


def scan_sql(texts: tuple[tuple[str, str, str], ...] = TEMPLATES) -> str:
    """DuckDB SQL for the rows of scan, over every window."""
    quoted = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in texts)
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    cut = "CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END"
    return f"""
WITH t AS (SELECT template, license, {cut} AS r FROM (SELECT template, license, {words} AS w FROM (VALUES {quoted}) v(template, license, text))),
tr AS (SELECT template, license, unnest(list_distinct(r)) AS g, len(list_distinct(r)) AS n, (2 ** ceil(log2(2 * len(r))))::BIGINT AS s FROM t),
d AS (SELECT doc_id, {cut} AS r FROM (SELECT doc_id, {words} AS w FROM documents)),
dr AS (SELECT doc_id, unnest(r) AS g, unnest(range(len(r))) AS p FROM d),
h AS (SELECT doc_id, template, license, tr.g, n, s // 2 AS half, p // (s // 2) AS j FROM dr JOIN tr ON tr.g = dr.g),
w AS (SELECT doc_id, template, license, n, g, j * half AS first_run FROM h UNION ALL SELECT doc_id, template, license, n, g, (j - 1) * half FROM h WHERE j > 0),
c AS (SELECT doc_id, template, license, first_run, count(DISTINCT g) AS found, count(DISTINCT g) / any_value(n) AS share FROM w GROUP BY 1, 2, 3, 4),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, template ORDER BY found DESC, first_run) AS k FROM c WHERE share >= 0.75)
SELECT doc_id, template, license, found::INT AS found, share, first_run::INT AS first_run FROM b WHERE k = 1
"""
