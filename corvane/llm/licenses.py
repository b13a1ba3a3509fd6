"""License scans, in DataFrame functions only: phrases, and an exact set-similarity join with templates.

A template is the token set of a license notice. A text block is a run of words, and meets the
template if it holds at least `least` of its tokens (containment). How long a block is goes by the
template: the least of 6, 12, 24, .. words that is half as long again as the notice, so a notice is
found however its lines are broken, and words scattered over a page are not one. A block starts at
every word that some template of its length has; any other qualifying run holds such a block.

Tokens are ordered by how many documents have them, rarest first. A block that meets a template
shares with it a token among the first |T| - need + 1 of the template and the first |B| - need + 1
of the block (prefix filter); blocks with fewer than `need` template tokens cannot meet it (length
filter); from the first token shared, the block must have enough left (positional filter; of the
template the prefix leaves enough). What passes all three is verified. No qualifying block is lost,
none is reported that doesn't qualify.

The texts are read once: what is kept of a document are its phrase places and, if all its tokens
together meet some template, the places of its template tokens. The templates are a fixed list, so
broadcasting them is bounded.
Null text has no words. Repeated rows are each scanned; null doc_ids are kept. A very long text is
scanned whole, within its row. Further columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import LETTERS_LOW, LETTERS_UP, keep, once

# The phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices as their licenses word them, by label.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind, either express or implied"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("proprietary", "All rights reserved"),
]

_SPLIT = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def tokens_of(notice: str) -> list[str]:
    return sorted(set(re.findall("[0-9a-z]+", notice.lower())))


def window_of(notice: str) -> int:
    """How many words a block for this notice has."""
    words, window = len(re.findall("[0-9a-z]+", notice.lower())), 6
    while 2 * window < 3 * words:
        window *= 2
    return window


Template = tuple[int, str, list[str], int, int]  # number, label, tokens, how many are needed, words of a block


def _strings(values: list[str]):
    return F.array(*map(F.lit, values))


def _by_window(sets: list[Template]) -> dict[int, list[Template]]:
    return {w: [x for x in sets if x[4] == w] for w in sorted({x[4] for x in sets})}


def _scanned(docs: DataFrame, sets: list[Template]) -> DataFrame:
    """Per document: n_words, its phrase places (start, label), _any (template tokens), _met (lengths of the blocks worth a look) and _s (place, token)."""
    low = once(F.translate(F.coalesce("text", F.lit("")), LETTERS_UP, LETTERS_LOW)).alias("_low")
    d = docs.select("doc_id", low).select("doc_id", "_low", once(F.array_remove(F.split("_low", _SPLIT), "")).alias("_w"))

    def phrase(x, i):
        out = F.lit(None)
        for words, label in ((p.split(), v) for p, v in PHRASES.items()):
            same = x == words[0]
            for n, w in enumerate(words[1:], 1):
                same = same & (F.get("_w", i + n) == w)
            out = F.when(same, F.struct(i.cast("bigint").alias("start"), F.lit(label).alias("label"))).otherwise(out)
        return out

    may = F.col("_low").contains("license") | F.col("_low").contains("cc")
    none = "array<struct<start:bigint,label:string>>"
    places = F.when(may, F.filter(F.transform("_w", phrase), lambda x: x.isNotNull())).otherwise(F.array().cast(none))
    vocabulary = sorted({w for x in sets for w in x[2]})
    d = d.select("doc_id", "_w", F.size("_w").cast("bigint").alias("n_words"), once(places).alias("_places"), once(F.array_intersect("_w", _strings(vocabulary))).alias("_any"))
    enough = lambda x: F.size(F.array_intersect("_any", _strings(x[2]))) >= x[3]
    windows = F.array(*(F.when(reduce(or_, map(enough, of)), F.lit(w)) for w, of in _by_window(sets).items()))
    d = d.select("*", once(F.when(F.size("_any") >= min(x[3] for x in sets), F.array_compact(windows)).otherwise(F.array().cast("array<int>"))).alias("_met"))
    tokens = F.filter(F.transform("_w", lambda x, i: F.struct(i.alias("p"), x.alias("w"))), lambda x: x.w.isin(vocabulary))
    return d.select("doc_id", "n_words", "_places", "_any", "_met", F.when(F.size("_met") > 0, tokens).otherwise(F.array().cast("array<struct<p:int,w:string>>")).alias("_s"))


def _blocks(seen: DataFrame, sets: list[Template], rank: dict[str, int]) -> DataFrame:
    """(_row, window, no, tokens): every block of a document that has enough tokens for some template, its tokens rarest first; no is its first word."""
    ranked = F.create_map(*(x for w, i in rank.items() for x in (F.lit(w), F.lit(i))))

    def blocks(window: int, of: list[Template]) -> DataFrame:
        vocabulary, fewest = sorted({w for x in of for w in x[2]}), min(x[3] for x in of)
        own = seen.where(F.array_contains("_met", window)).select("_row", once(F.filter("_s", lambda x: x.w.isin(vocabulary))).alias("_s"))
        near = lambda x, i: F.filter(F.slice("_s", i + 1, window), lambda y: y.p < x.p + window)
        block = F.transform("_s", lambda x, i: F.struct(x.p.alias("no"), F.array_distinct(F.transform(near(x, i), lambda y: y.w)).alias("tokens")))
        return own.select("_row", F.lit(window).alias("window"), F.explode(F.filter(block, lambda b: F.size(b.tokens) >= fewest)).alias("b"))

    parts = [blocks(window, of) for window, of in _by_window(sets).items()]
    rare_first = F.transform(F.sort_array(F.transform("b.tokens", lambda w: F.struct(ranked[w].alias("r"), w.alias("w")))), lambda x: x.w)
    return reduce(DataFrame.unionByName, parts).select("_row", "window", "b.no", rare_first.alias("tokens"))


def scan(docs: DataFrame, least: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, places, found, score): places array<(start, label)>, found array<(label, template, block, containment)>, the best block of each template met."""
    spark = docs.sparkSession
    sets: list[Template] = [(n, label, tokens_of(text), math.ceil(least * len(tokens_of(text)) - 1e-9), window_of(text)) for n, (label, text) in enumerate(templates)]
    seen = keep(_scanned(docs, sets).withColumn("_row", F.monotonically_increasing_id()), "licenses")
    counts = dict(map(tuple, seen.select(F.explode("_any").alias("w")).groupBy("w").count().collect()))  # at most the templates' tokens
    rank = {w: i for i, w in enumerate(sorted({w for x in sets for w in x[2]}, key=lambda w: (counts.get(w, 0), w)))}
    row = lambda token, x: F.struct(F.lit(token).alias("token"), F.lit(x[4]).alias("window"), F.lit(x[0]).alias("template"), F.lit(x[1]).alias("label"), F.lit(x[3]).alias("need"), _strings(x[2]).alias("whole"))
    index = [row(w, x) for x in sets for w in sorted(x[2], key=rank.get)[: len(x[2]) - x[3] + 1]]
    prefix = spark.range(1).select(F.explode(F.array(*index)).alias("t")).select("t.*")
    fewest = reduce(lambda out, x: F.when(F.col("window") == x[0], min(t[3] for t in x[1])).otherwise(out), _by_window(sets).items(), F.lit(1))
    ahead = _blocks(seen, sets, rank).select("*", F.posexplode(F.slice("tokens", F.lit(1), F.greatest(F.size("tokens") - fewest + 1, F.lit(0)))).alias("bp", "token"))
    met = ahead.join(F.broadcast(prefix), ["token", "window"]).where((F.size("tokens") >= F.col("need")) & (F.size("tokens") - F.col("bp") >= F.col("need")))
    found = met.withColumn("_s", F.size(F.array_intersect("tokens", "whole"))).where("_s >= need").select("_row", "template", "label", (F.col("_s") / F.size("whole")).alias("containment"), (-F.col("no")).alias("before"))
    one = found.groupBy("_row", "template", "label").agg(F.max(F.struct("containment", "before")).alias("b"))
    by = one.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("label", "template", (-F.col("b.before")).alias("block"), F.col("b.containment").alias("containment")))).alias("found"))
    best = F.array_max(F.transform("found", lambda f: f.containment))
    done = seen.select("_row", "doc_id", "n_words", F.col("_places").alias("places")).join(by, "_row", "left")
    return done.select("doc_id", "n_words", "places", "found", F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"))
