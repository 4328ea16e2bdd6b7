"""License scans: word-bigram Dice coefficients against licence templates, DataFrame functions only.

A whole text is normalised (A-Z to lower case, anything but letters, digits and non-ASCII to blanks,
so comment marks, line ends and blank lines part nothing) and its word bigrams are compared with
each template's set, window by window: a window starts and ends with a bigram of the template, as
any best one does.  With n bigrams in the template and a coefficient of t, a set needs t n / (2 - t)
of them and may have n (2 - t) / t in all; windows are at most that long.  Templates of which a
text has too few bigrams are passed over.  All happens within the row: no shuffle, no explode.

Edge cases: null, empty and one-word texts match nothing; equal best scores go to the licence
first by name; a very long text is searched whole; repeated rows give repeated results; an empty
table gives an empty result; extra columns travel along and columns named ``license_hits`` are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Notices of public licences, name and wording.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template."""
    words = re.sub(_NOT_WORD, " ", text.translate(str.maketrans(_UPPER, _LOWER))).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def least_common(n: int, threshold: float) -> int:
    """Bigrams of a template of ``n`` that a matching window has at least."""
    return ceil(threshold * n / (2 - threshold) - 1e-9)


def longest(n: int, threshold: float) -> int:
    """Bigrams, repeats counted, of the longest window compared with a template of ``n``."""
    return floor(n * (2 - threshold) / threshold + 1e-9)


def scan_licenses(docs: DataFrame, *, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``license_hits array<struct<dice, license, first, last>>``, best first.

    One hit a licence: its best window's coefficient, and first and last word from 0 (of equal ones
    the first, then the shortest).
    """
    docs = docs.drop("license_hits")
    known = sorted({(name, tuple(bigrams(text))) for name, text in templates})
    table = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(len(g)).alias("n"), F.lit(least_common(len(g), threshold)).alias("least"), F.lit(longest(len(g), threshold)).alias("most"), F.array(*map(F.lit, g)).alias("grams")) for name, g in known])
    every = sorted({g for _, grams in known for g in grams})
    fewest = min(least_common(len(g), threshold) for _, g in known)

    words = F.split(F.trim(F.regexp_replace(F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER), _NOT_WORD, " ")), " ")
    n = F.size("words")
    pairs = F.when(n > 1, F.zip_with(F.slice("words", 1, n - 1), F.slice("words", 2, n - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    # Each step is a column that the next refers to more than once, so that none is computed anew in a loop.
    rows = docs.select(F.struct(*docs.columns).alias("row"), words.alias("words")).select("row", pairs.alias("pairs"))
    found = F.filter(F.transform("pairs", lambda g, i: F.when(g.isin(every), F.struct(i.alias("i"), g.alias("g")))), lambda x: x.isNotNull())
    rows = rows.select("row", "pairs", F.when(F.size("pairs") >= fewest, found).otherwise(F.array().cast("array<struct<i:int,g:string>>")).alias("marks"))

    def distinct(x: Column) -> Column:
        return F.size(F.array_distinct(x))

    def windows(t: Column, mine: Column) -> Column:
        """Coefficients of the windows from each mark of the template to each later one near enough."""

        def to(lo: Column, at: Column) -> Column:
            ends = F.slice(mine, at + t["least"], t["most"])
            near = F.filter(ends, lambda hi: hi["i"] - lo["i"] < t["most"])
            return F.transform(near, lambda hi, k: score(lo, at, hi, k))

        def score(lo: Column, at: Column, hi: Column, k: Column) -> Column:
            common = distinct(F.transform(F.slice(mine, at + 1, t["least"] + k), lambda m: m["g"]))
            size = distinct(F.slice("pairs", lo["i"] + 1, hi["i"] - lo["i"] + 1))
            return F.struct((-F.round(2.0 * common / (size + t["n"]), 6)).alias("under"), lo["i"].alias("first"), (hi["i"] + 1).alias("last"))

        return F.flatten(F.transform(mine, to))

    def best(t: Column) -> Column:
        mine = F.filter("marks", lambda m: F.array_contains(t["grams"], m["g"]))
        enough = distinct(F.transform(mine, lambda m: m["g"])) >= t["least"]
        hit = F.when(enough, F.array_min(windows(t, mine)))
        return F.struct(hit["under"].alias("under"), t["license"].alias("license"), hit["first"].alias("first"), hit["last"].alias("last"))

    hits = F.filter(F.transform(table, best), lambda h: -h["under"] >= threshold)
    rows = rows.select("row", F.when(F.size("marks") >= fewest, F.array_sort(hits)).otherwise(F.array().cast("array<struct<under:double,license:string,first:int,last:int>>")).alias("hits"))
    # of one licence's templates the best comes first
    one_each = F.filter("hits", lambda h, k: ~F.exists(F.slice("hits", 1, k), lambda o: o["license"] == h["license"]))
    told = F.transform(one_each, lambda h: F.struct((-h["under"]).alias("dice"), h["license"].alias("license"), h["first"].alias("first"), h["last"].alias("last")))
    return rows.select("row.*", told.alias("license_hits"))


def license_digest(scanned: DataFrame) -> DataFrame:
    names = F.array_sort(F.array_distinct(F.transform("license_hits", lambda h: h["license"])))
    best = F.get("license_hits", 0)
    return scanned.select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), best["license"].alias("best_license"), best["dice"].alias("best_dice"))
