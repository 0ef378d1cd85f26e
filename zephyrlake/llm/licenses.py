"""Licence scans: Dice coefficient over word bigrams against licence templates, in DataFrame operations alone.

A text's lines, sentences, paragraphs, itself and runs of adjacent sentences across line and paragraph breaks are
compared. Size bounds say which templates a passage can
reach at all: with x bigrams against t, Dice is at most 2 min(x, t) / (x + t).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices and statements of common public licences.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1 header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD notice": "Released under the BSD 3-Clause License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Rights reserved": "All rights reserved.",
}
THRESHOLD = 0.8
#: Words of any text, which tell least.
COMMON = frozenset("a an and any are as at by for from in is it may must not of on or that the this to under with you".split())


def plain_words(text: str) -> list[str]:
    """The normal form of a template, as ``normal`` makes of a column."""
    return re.sub(r"[^\w]+|_+", " ", text.lower()).split()


def normal(text: Column) -> Column:
    """Lower-case words of letters and digits, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]++", " "))


def bigrams(words: list[str]) -> list[str]:
    """Distinct word bigrams."""
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def telling(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which any passage that reaches the threshold against any template holds one.

    Dice >= s against t bigrams asks for at least ceil(s * t / (2 - s)) shared ones. Words are taken from each
    template, longest first, common ones last and those taken before at no cost, until fewer bigrams than that are free of them.
    """
    chosen: set[str] = set()
    for text in templates.values():
        words = plain_words(text)
        grams = bigrams(words)
        asked = -int(-(threshold * len(grams) / (2 - threshold) - 1e-9) // 1)
        for word in sorted({w for w in words if w not in chosen}, key=lambda w: (w in COMMON, -len(w), w)):
            if sum(not chosen & set(g.split()) for g in grams) < asked:
                break
            chosen.add(word)
    return sorted(chosen)


def pairs_of(words: Column) -> Column:
    """Distinct word bigrams of an array of words."""
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))


def with_runs(rows: DataFrame, hint: str, grams: list[str], most: int) -> DataFrame:
    """Adds __runs: array<struct<i, j, passage, g>>, runs of two or more adjacent sentences (line ends end one as well) of __low.

    A run holds a telling word, and its first and last sentence take part in a template's bigram: without them
    the rest is more alike. Runs go up to 2 * most words and most distinct bigrams.
    """
    units = F.split("__low", r"\s*\R\s*|(?<=[.!?;])\s+")
    units = F.transform(units, lambda x: F.struct(x.alias("t"), F.split(normal(x), " ").alias("w"), x.rlike(hint).cast("int").alias("hint")))
    rows = rows.withColumn("__units", F.filter(units, lambda x: F.get(x["w"], F.lit(0)) != ""))
    shares = lambda w: F.exists(pairs_of(w), lambda x: x.isin(grams))
    after = lambda i: F.slice(F.get(F.col("__units"), i + 1)["w"], F.lit(1), F.lit(1))
    before = lambda i: F.slice(F.get(F.col("__units"), i - 1)["w"], F.lit(-1), F.lit(1))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("__first", F.transform("__units", lambda x, i: shares(F.concat(x["w"], F.coalesce(after(i), none)))))
    rows = rows.withColumn("__last", F.transform("__units", lambda x, i: shares(F.concat(F.coalesce(before(i), none), x["w"]))))
    upto = lambda value: F.aggregate("__units", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + value(x))))
    rows = rows.withColumn("__n", upto(lambda x: F.size(x["w"]))).withColumn("__hints", upto(lambda x: x["hint"]))
    end = lambda i: F.least(F.size("__units") - 1, i + 2 * most)
    fits = lambda i, j: (j > i) & F.get("__last", j) & (F.get("__n", j + 1) - F.get("__n", i) <= 2 * most) & (F.get("__hints", j + 1) > F.get("__hints", i))
    starts = F.filter(F.sequence(F.lit(0), F.size("__units") - 1), lambda i: F.get("__first", i))
    spans = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(F.sequence(i, end(i)), lambda j: fits(i, j)), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    rows = rows.withColumn("__spans", F.when(F.size("__units") > 1, spans))
    part = lambda x, name: F.transform(F.slice("__units", x["i"] + 1, x["j"] - x["i"] + 1), lambda u: u[name])
    runs = F.transform("__spans", lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j"), F.array_join(part(x, "t"), " ").alias("passage"), pairs_of(F.flatten(part(x, "w"))).alias("g")))
    return rows.withColumn("__runs", F.filter(runs, lambda x: F.size(x["g"]) <= most))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Adds licenses: array<struct<license, dice, passage>>, the best template of every passage that reaches ``threshold``.

    Passages are a text's distinct lines, sentences within lines, paragraphs and the whole text, and of the runs
    of adjacent sentences that reach a template those which no single passage as good and no better run over the
    same place stands for. Passages inside a better run of another template are part of that one; ties go to the template of the later name. Templates need three words. Null and empty texts have no licences; rows, also
    repeated ones, and other columns stay, but for one named licenses. Nothing is shuffled.
    """
    templates = TEMPLATES if templates is None else templates
    keep = [c for c in docs.columns if c != "licenses"]
    table = [(name, bigrams(plain_words(t))) for name, t in sorted(templates.items())]
    most = int(max(len(g) for _, g in table) * (2 - threshold) / threshold) + 1
    sets = F.array(*[F.struct(F.lit(name).alias("license"), F.array(*[F.lit(x) for x in g]).alias("grams"), F.lit(len(g)).alias("n")) for name, g in table])
    words = "|".join(map(re.escape, telling(templates, threshold)))
    hint = rf"(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])"
    empty = F.array().cast("array<string>")
    low = F.lower(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.when(low.rlike(hint), low).alias("__low"))
    lines = F.split("__low", r"\R")
    parts = F.concat(lines, F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?;])\s+"))), F.split("__low", r"\R\s*\R"), F.array("__low"))
    rows = rows.withColumn("__parts", F.when(F.col("__low").isNotNull(), F.array_distinct(F.filter(parts, lambda x: x.rlike(hint)))).otherwise(empty))
    rows = rows.withColumn("__words", F.transform("__parts", lambda x: F.struct(x.alias("passage"), F.split(normal(x), " ").alias("w"))))
    rows = rows.withColumn("__words", F.filter("__words", lambda x: F.size(x["w"]) >= 3))
    rows = rows.withColumn("__grams", F.transform("__words", lambda x: F.struct(x["passage"].alias("passage"), pairs_of(x["w"]).alias("g"))))
    able = lambda x: F.filter(sets, lambda t: 2 * F.least(t["n"], F.size(x["g"])) >= threshold * (t["n"] + F.size(x["g"])) - 1e-9)
    best = lambda x: F.array_max(F.transform(able(x), lambda t: F.struct((2 * F.size(F.array_intersect(x["g"], t["grams"])) / (t["n"] + F.size(x["g"]))).alias("dice"), t["license"].alias("license"))))
    rows = rows.withColumn("__best", F.transform("__grams", lambda x: F.struct(best(x).alias("b"), x["passage"].alias("passage"))))
    reached = F.filter("__best", lambda x: F.coalesce(x["b"]["dice"] >= threshold - 1e-9, F.lit(False)))
    found = F.transform(reached, lambda x: F.struct(x["b"]["license"].alias("license"), x["b"]["dice"].alias("dice"), x["passage"].alias("passage")))
    rows = with_runs(rows.withColumn("__found", found).drop("__parts", "__words", "__grams", "__best"), hint, sorted({x for _, g in table for x in g}), most)
    rows = rows.withColumn("__scored", F.transform("__runs", lambda x: F.struct(best(x).alias("b"), x["i"].alias("i"), x["j"].alias("j"), x["passage"].alias("passage"))))
    rows = rows.withColumn("__scored", F.filter("__scored", lambda x: F.coalesce(x["b"]["dice"] >= threshold - 1e-9, F.lit(False))))
    better = lambda x, y: F.when(y["b"]["license"] == x["b"]["license"], (y["i"] <= x["j"]) & (y["j"] >= x["i"])).otherwise((y["i"] <= x["i"]) & (y["j"] >= x["j"])) & (F.struct(y["b"]["dice"], -y["i"], -y["j"]) > F.struct(x["b"]["dice"], -x["i"], -x["j"]))
    single = lambda x: F.exists("__found", lambda y: (y["license"] == x["b"]["license"]) & (y["dice"] >= x["b"]["dice"]) & normal(x["passage"]).contains(normal(y["passage"])))
    alone = F.filter("__scored", lambda x: ~single(x) & ~F.exists("__scored", lambda y: better(x, y)))
    runs = F.transform(alone, lambda x: F.struct(x["b"]["license"].alias("license"), x["b"]["dice"].alias("dice"), x["passage"].alias("passage")))
    rows = rows.withColumn("__more", F.coalesce(runs, F.array().cast("array<struct<license:string,dice:double,passage:string>>")))
    within = lambda x: F.exists("__more", lambda y: (y["license"] != x["license"]) & (y["dice"] > x["dice"]) & normal(y["passage"]).contains(normal(x["passage"])))
    every = F.concat(F.filter("__found", lambda x: ~within(x)), "__more")
    return rows.select(*[F.col(f"`{c}`") for c in keep], every.alias("licenses"))
