"""License texts in documents, found by MinHash bands over windows and verified by exact shingles.

Everything here is DataFrame expressions. A template is a sequence of words;
its shingles are runs of five words (of all its words if it has fewer). A
document holds a template if one of its windows has ``contained`` (0.8) of the
template's distinct shingles.

Templates fall into classes by size: class c has up to 2^c shingles. Windows
of a class have 2 * 2^c shingles and begin every 2^c, so that whatever run of
up to 2^c shingles lies whole in one window. A window and a template it holds
then have a Jaccard similarity of 0.18 at least (0.25 if it holds all of it),
and one of ``BANDS`` = 40 bands of one MinHash row each agrees with a
probability of 1 - 0.82^40 > 0.9996 (all of it: 1 - 0.75^40 > 0.99999).

Documents that hold none of the anchor words are passed over beforehand: each
template's anchors touch more than a fifth of its shingles, so a document
without any can't hold enough of it.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, BANDS, CONTAINED = 5, 40, 0.8

# fixed values: wordings of public license notices
TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0-notice": "This work has been dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "bsd-3-clause-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def anchors(templates: dict[str, str]) -> list[str]:
    """Words such that a text without any of them lacks over a fifth of each template's shingles."""
    uses: dict[str, int] = {}
    for t in templates.values():
        for w in set(_words(t)):
            uses[w] = uses.get(w, 0) + 1
    chosen: set[str] = set()
    for t in templates.values():
        words = _words(t)
        k = min(SHINGLE, len(words))
        shingles = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
        touched = {s for s in shingles if chosen & set(s)}
        # words of other templates come first, then long ones
        for w in sorted(set(words) - chosen, key=lambda w: (-min(len(w), 8), -uses[w], w)):
            if len(touched) > (1 - CONTAINED) * len(shingles) + 1e-9:
                break
            more = {s for s in shingles if w in s}
            if more - touched:
                touched |= more
                chosen.add(w)
    return sorted(chosen)


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _shingles(words: Column, k: Column | int) -> Column:
    """Hashes of runs of k words, repeats included; empty if there are fewer words."""
    k = F.lit(k) if isinstance(k, int) else k
    places = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice(words, i, k), " ")))


def _bands(hashes: Column) -> Column:
    return F.array(*[_least(hashes, b) for b in range(BANDS)])


def _least(hashes: Column, b: int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(b))))


def _template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``license, k, c, shingles, bands`` of each template."""
    rows = []
    for name, text in templates.items():
        words = _words(text)
        if words:
            rows.append((name, " ".join(words), min(SHINGLE, len(words))))
    if sum(len(r[1]) for r in rows) > 8 << 20:
        raise ValueError("templates of over 8 MB are not meant to be broadcast")
    t = spark.createDataFrame(rows, "license string, words string, k int")
    t = t.select("license", "k", F.array_distinct(_shingles(F.split("words", " "), F.col("k"))).alias("shingles"))
    # log2 in whole steps: sizes 1, 2, 3-4, 5-8, ...
    size = F.size("shingles")
    c = F.when(size <= 1, 0).otherwise(F.length(F.bin((size - 1).cast("long"))))
    return t.select("license", "k", c.cast("int").alias("c"), "shingles", _bands(F.col("shingles")).alias("bands"))


def _classes(templates: dict[str, str]) -> list[tuple[int, int]]:
    out = set()
    for text in templates.values():
        words = _words(text)
        if words:
            k = min(SHINGLE, len(words))
            size = len({tuple(words[i : i + k]) for i in range(len(words) - k + 1)})
            out.add((k, (size - 1).bit_length()))
    return sorted(out)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``licenses`` (sorted), ``n_licenses`` and ``matches`` of every row.

    A match has the license, the greatest share of its shingles that a window
    holds, and the word (from 0) at which the first window with that share begins. Rows
    without a match have empty arrays. Null and empty texts match nothing, and very
    long ones are read whole;
    rows of one id (or without id) share what is found in any of them;
    repeated rows stay. An empty table or no templates give no matches. Other
    columns are left out; names in them do not matter.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = anchors(templates)
    classes = _classes(templates)
    empty = "array<struct<license:string,contained:double,word:int>>"
    if not classes:
        none = base.select("id", F.array().cast("array<string>").alias("licenses"), F.lit(0).alias("n_licenses"), F.array().cast(empty).alias("matches"))
        return none.withColumnRenamed("id", id_col)
    some = base.where(F.col("text").rlike("(?i)" + "|".join(marked))).select("id", _tokens(F.col("text")).alias("words"))
    known = F.array(*[F.lit(w) for w in marked])

    def windows(k: int, c: int) -> Column:
        step = 1 << c
        n = F.size("words") - (k - 1)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        near = F.filter(starts, lambda s: F.arrays_overlap(F.slice("words", s + 1, 2 * step + k - 1), known))
        return F.transform(
            near,
            lambda s: F.struct(
                F.lit(k).alias("k"), F.lit(c).alias("c"), s.alias("word"), F.array_distinct(_shingles(F.slice("words", s + 1, 2 * step + k - 1), k)).alias("held")
            ),
        )

    wins = some.select("id", F.inline(reduce(lambda a, b: F.concat(a, b), [windows(k, c) for k, c in classes])))
    signed = wins.select("*", _bands(F.col("held")).alias("bands")).select("id", "k", "c", "word", "held", F.posexplode("bands").alias("band", "least"))
    table = _template_table(spark, templates)
    entries = table.select("license", "k", "c", "shingles", F.posexplode("bands").alias("band", "least"))
    found = signed.join(F.broadcast(entries), ["k", "c", "band", "least"])  # templates alone: 8 MB of words at most
    share = F.size(F.array_intersect("held", "shingles")) / F.size("shingles")
    matches = found.select("id", "license", "word", share.alias("contained")).where(F.col("contained") >= CONTAINED)
    # of windows that hold as much the first
    best = matches.groupBy("id", "license").agg(F.max(F.struct("contained", (-F.col("word")).alias("back"))).alias("best"))
    best = best.select("id", "license", F.col("best.contained").alias("contained"), (-F.col("best.back")).alias("word"))
    by_id = best.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("license", "contained", "word"))).alias("matches"))  # a row a template at most
    ids = base.select("id")
    joined = ids.join(by_id, ids["id"].eqNullSafe(by_id["id"]), "left").select(ids["id"].alias(id_col), F.coalesce("matches", F.array().cast(empty)).alias("matches"))
    licenses = F.transform("matches", lambda m: m["license"])
    return joined.select(id_col, licenses.alias("licenses"), F.size("matches").alias("n_licenses"), "matches")
