"""License scans, with DataFrame functions alone.

Each line of a file, and the file as a whole, is a sparse TF-IDF vector over lower-case words (runs of a-z and 0-9, but for a few that say little); so is each template notice. Inverse document frequencies come from the templates; a word of no template weighs as one in none. A line whose cosine to a template reaches ``least`` is a license header. A file is a licence file for its directory if its name says so (LICENSE, LICENCE, COPYING, NOTICE, with any ending) and it has a header, or if the text as a whole reaches ``least``. Files without a header take the licence of the nearest directory above them that has a licence file: distinct directories are joined with their ancestors, the deepest match counts, and files join their own directory.

Lines without any of the words that carry a template's weight can't reach ``least``; the filter on them is exact: for each template, the heaviest words (numbers last) are taken until the rest weighs less than least**2.

Notices also stand in the middle of a line, or run over several. Windows of up to ``WINDOW`` lines and up to two sentences (over line breaks, and cut before the usual first words of a notice) are compared with the notices and with ``HEADERS``: standard headers, titles and first sentences of licence texts, and SPDX marks; they count in files in which no line reaches ``least``. Only files that hold enough of one template's words are cut into windows; that bound is exact.

Null texts are empty and have no header; null paths are the empty path in the root directory. Ties between licences go to the higher cosine, then to the first name. Rows with equal paths are one file (its header is the best of theirs), and each row gets the result. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# The usual notices of common licenses.
TEMPLATES = (
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Released under the ISC License"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version"
_SPDX = ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")
# Standard headers, and titles and first sentences of licence texts.
HEADERS = (
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", _GNU.format("Affero ", 3)),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", _GNU.format("", 2)),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", _GNU.format("", 3)),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", _GNU.format("Lesser ", 3)),
    ("MIT", "Licensed under the MIT License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    *((name, f"SPDX-License-Identifier: {name}") for name in _SPDX),
)
# A text that has both is the second one's: the first one's sentence stands in it as well.
PART_OF = ("BSD-2-Clause", "BSD-3-Clause")
WINDOW = 5
SENTENCE = r"(?i)(?<=[.;:!?])\s+|\n\s*\n|\s+(?=(?:licensed|released|distributed|dedicated|permission|redistribution|spdx)\b)"
# Words that say little; neither templates nor texts count them.
STOP = ("a", "an", "and", "any", "by", "in", "into", "is", "of", "the", "this", "to", "under")
LEAST = 0.75
LICENCE_NAME = r"(?i)^(license|licence|copying|notice)([.-].*)?$"
WORD = "[^a-z0-9]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(WORD, text.lower()) if w and w not in STOP]


class Weights:
    """Template vectors of length 1, word weights, and the words without which no line can reach ``least``."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST):
        counts = [Counter(words_of(t)) for _, t in templates]
        df = Counter(w for c in counts for w in c)
        n = len(templates)
        self.idf = {w: math.log((1 + n) / (1 + d)) + 1 for w, d in df.items()}
        self.other = math.log(1 + n) + 1
        self.vectors: list[tuple[int, str, str, float]] = []
        needed: set[str] = set()
        for k, ((name, _), c) in enumerate(zip(templates, counts)):
            raw = {w: tf * self.idf[w] for w, tf in c.items()}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            unit = {w: x / norm for w, x in raw.items()}
            self.vectors += [(k, name, w, x) for w, x in unit.items()]
            rest = 1.0
            for w, x in sorted(unit.items(), key=lambda p: (not p[0].isalpha(), -p[1], p[0])):
                if rest < least * least:
                    break
                needed.add(w)
                rest -= x * x
        self.needed = sorted(needed)
        #: Words stand between characters that belong to none.
        self.pattern = "(?i)(?:^|[^a-z0-9])(?:" + "|".join(self.needed) + ")(?:[^a-z0-9]|$)"


def possible(units: DataFrame, weights: Weights, least: float) -> DataFrame:
    """The units that may reach ``least``, told inside each row, before any word is sent.

    Two bounds, both exact: a cosine is at most the length of the template's part whose words are there; and at most the length of the unit's part in template words, whose frequencies are at most their number, against that part and the distinct other words together.
    """
    vocabulary = sorted(weights.idf)
    heaviest = max(weights.idf.values())
    known = F.array(*map(F.lit, vocabulary))
    by: dict[int, list] = {}
    for k, _, w, x in weights.vectors:
        by.setdefault(k, []).extend((F.lit(w), F.lit(x * x)))
    squares = [F.create_map(*v) for v in by.values()]
    slack = least * least - 1e-6  # cosines are rounded to six digits

    def part(there: F.Column, weight: F.Column) -> F.Column:
        return F.aggregate(there, F.lit(0.0), lambda a, w: a + F.coalesce(weight[w], F.lit(0.0)))

    def may(s: F.Column) -> F.Column:
        mine = F.pow(s["hits"] * heaviest, F.lit(2.0))
        rest = (s["distinct"] - F.size(s["there"])) * weights.other**2
        return (mine >= slack * (mine + rest)) & (F.greatest(*(part(s["there"], m) for m in squares), F.lit(0.0)) >= slack)

    # One expression: what is used more than once is a lambda's variable, so that it is worked out once.
    words = F.filter(F.split(F.lower("t"), WORD), lambda w: (w != "") & ~w.isin(*STOP))
    facts = F.transform(F.array(words), lambda ws: F.struct(F.array_intersect(ws, known).alias("there"), F.size(F.filter(ws, lambda w: w.isin(*vocabulary))).alias("hits"), F.size(F.array_distinct(ws)).alias("distinct")))
    return units.where(F.exists(facts, may))


def holding(files: DataFrame, weights: Weights, least: float) -> DataFrame:
    """The files (path, text) of which some part may reach ``least``: those that hold the words of that much of a template. Told inside each row."""
    vocabulary = F.array(*map(F.lit, sorted(weights.idf)))
    by: dict[int, list] = {}
    for k, _, w, x in weights.vectors:
        by.setdefault(k, []).extend((F.lit(w), F.lit(x * x)))
    squares = F.array(*(F.create_map(*v) for v in by.values()))
    slack = least * least - 1e-6
    there = F.array(F.array_intersect(F.split(F.lower("text"), WORD), vocabulary))
    enough = lambda ws: F.exists(squares, lambda m: F.aggregate(ws, F.lit(0.0), lambda a, w: a + F.coalesce(m[w], F.lit(0.0))) >= slack)
    return files.where(F.exists(there, enough))


def windows(files: DataFrame, weights: Weights, least: float) -> DataFrame:
    """(path, line, t): the windows of lines and of sentences that may reach ``least``. line: the window's hash, so that equal windows of a path are one.

    Two bounds, worked out part by part before any window becomes a text: a cosine is at most the length of the template's part whose words are there, and these squares, each word at its greatest, are added up over the parts; and it is at most the length of the window's part in template words, whose frequencies are at most their number, against that part and the distinct other words of any one part together. Both are exact: what is left out can't reach ``least``.
    """
    heaviest = max(weights.idf.values())
    greatest: dict[str, float] = {}
    for _, _, w, x in weights.vectors:
        greatest[w] = max(greatest.get(w, 0.0), x * x)
    square = F.create_map(*(F.lit(v) for pair in greatest.items() for v in pair))
    slack = least * least - 1e-6
    total = lambda numbers: F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)

    def facts(part: F.Column) -> F.Column:
        """(squares, template words, distinct other words) of a part."""
        words = F.filter(F.split(F.lower(part), WORD), lambda w: (w != "") & ~w.isin(*STOP))
        known = F.transform(F.array(words), lambda ws: F.struct(ws.alias("ws"), F.filter(ws, lambda w: w.isin(*greatest)).alias("known")))
        one = F.transform(known, lambda s: F.struct(total(F.transform(F.array_distinct(s["known"]), lambda w: square[w])).alias("squares"), F.size(s["known"]).cast("double").alias("hits"), (F.size(F.array_distinct(s["ws"])) - F.size(F.array_distinct(s["known"]))).cast("double").alias("others")))
        return F.element_at(one, 1)

    def may(f: F.Column) -> F.Column:
        """Whether a window of parts with these facts may reach ``least``."""
        mine = F.pow(total(F.transform(f, lambda x: x["hits"])) * heaviest, F.lit(2.0))
        rest = F.array_max(F.transform(f, lambda x: x["others"])) * weights.other**2
        return (total(F.transform(f, lambda x: x["squares"])) >= slack) & (mine >= slack * (mine + rest))

    def runs(parts: F.Column, length: int) -> F.Column:
        own = F.filter(parts, lambda p: p.rlike("(?i)[a-z0-9]"))
        # What is used more than once is a lambda's variable, so that it is worked out once.
        both = F.transform(F.array(own), lambda l: F.struct(l.alias("l"), F.transform(l, facts).alias("f")))

        def of(s: F.Column, n: int) -> F.Column:
            starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(s["l"]) - n + 1, F.lit(1))), lambda i: F.coalesce(may(F.slice(s["f"], i, n)), F.lit(False)))
            return F.transform(starts, lambda i: F.array_join(F.slice(s["l"], i, n), "\n"))

        return F.flatten(F.transform(both, lambda s: F.flatten(F.array(*(of(s, n) for n in range(1, length + 1))))))

    cut = files.select("path", F.explode(F.concat(runs(F.split("text", "\n"), WINDOW), runs(F.split("text", SENTENCE), 2))).alias("t"))
    return cut.select("path", F.xxhash64("t").alias("line"), "t").distinct()


def cosines(units: DataFrame, weights: Weights, least: float) -> DataFrame:
    """(path, line, name, cosine): for each unit of text (path, line, t), its best license of cosine ``least`` or more."""
    spark = units.sparkSession
    idf = spark.createDataFrame([(w, float(x)) for w, x in weights.idf.items()], "w string, idf double")
    vectors = spark.createDataFrame([(k, name, w, float(x)) for k, name, w, x in weights.vectors], "template int, name string, w string, x double")
    words = units.select("path", "line", F.explode(F.split(F.lower("t"), WORD)).alias("w")).where((F.col("w") != "") & ~F.col("w").isin(*STOP))
    counted = words.groupBy("path", "line", "w").agg(F.count(F.lit(1)).alias("tf"))
    # The templates' words: a list of fixed length.
    weighed = counted.join(F.broadcast(idf), "w", "left").select("path", "line", "w", (F.col("tf") * F.coalesce("idf", F.lit(weights.other))).alias("x"))
    norm = weighed.groupBy("path", "line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.join(F.broadcast(vectors.withColumnRenamed("x", "y")), "w").groupBy("path", "line", "template", "name").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    scored = dots.join(norm, ["path", "line"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= least)
    return scored.groupBy("path", "line").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "name")).alias("m")).select("path", "line", "m.name", (-F.col("m.c")).alias("cosine"))


def directory(path: F.Column) -> F.Column:
    """The directory of a path, without its last slash; '' is the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST, keep: tuple[str, ...] = (), headers: tuple[tuple[str, str], ...] = HEADERS) -> DataFrame:
    """(path, license, origin, cosine, licence_dir, *keep) for every row. origin: 'header', 'inherited' or null; licence_dir: the directory whose licence is inherited."""
    weights = Weights(templates, least)
    own = files.select(F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)))
    hopeful = own.where(F.col("text").rlike(weights.pattern)).select("path", "text")
    lines = hopeful.select("path", F.posexplode(F.split("text", "\n")).alias("line", "t")).where(F.col("t").rlike(weights.pattern))
    units = lines.unionByName(hopeful.select("path", F.lit(-1).alias("line"), F.col("text").alias("t")))
    best = cosines(possible(units, weights, least), weights, least)
    pick = F.min(F.struct((-F.col("cosine")).alias("c"), "name"))
    per_file = best.groupBy("path").agg(F.min(F.when(F.col("line") >= 0, F.struct((-F.col("cosine")).alias("c"), "name"))).alias("head"), F.min(F.when(F.col("line") < 0, F.struct((-F.col("cosine")).alias("c"), "name"))).alias("whole"))
    # Windows. They count where no line is a header.
    wide = Weights((*templates, *headers), least)
    # One word alone is no notice ('mit' is a German word).
    several = F.size(F.array_intersect(F.split(F.lower("t"), WORD), F.array(*map(F.lit, sorted(wide.idf))))) > 1
    held = holding(own.select("path", "text"), wide, least)
    seen = cosines(stored(possible(windows(held, wide, least), wide, least).where(several), "windows"), wide, least)
    m = F.struct((-F.col("cosine")).alias("c"), "name")
    part, whole = PART_OF
    wider = seen.groupBy("path").agg(F.min(F.when(F.col("name") != part, m)).alias("other"), F.min(F.when(F.col("name") == part, m)).alias("part"), F.max(F.col("name") == whole).alias("has")).select("path", F.array_min(F.array("other", F.when(~F.col("has"), F.col("part")))).alias("wide"))
    per_file = per_file.join(wider, "path", "full").select("path", F.coalesce("head", "wide").alias("head"), "whole")
    per_file = stored(per_file, "headers")  # read twice
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_NAME)
    governs = per_file.select(directory(F.col("path")).alias("dir"), F.coalesce("whole", F.when(named, F.col("head"))).alias("m")).where("m is not null")
    licences = governs.select("dir", F.col("m.name").alias("name"), (-F.col("m.c")).alias("cosine")).groupBy("dir").agg(pick.alias("m")).select("dir", F.col("m.name").alias("d_name"), (-F.col("m.c")).alias("d_cosine"))
    # Every distinct directory with its ancestors: prefixes of its path.
    dirs = own.select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    ancestors = dirs.select(F.col("dir").alias("below"), F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.concat_ws("/", F.slice(parts, F.lit(1), n)).alias("dir")))).alias("a")).select("below", "a.depth", "a.dir").distinct()
    # Stored, so that both sides of the last join are plain exchanges, which Spark splits where a directory is hot.
    nearest = ancestors.join(licences, "dir").groupBy("below").agg(F.max(F.struct("depth", "dir", "d_name", "d_cosine")).alias("n")).select(F.col("below").alias("dir"), F.col("n.dir").alias("licence_dir"), F.col("n.d_name").alias("d_name"), F.col("n.d_cosine").alias("d_cosine"))
    nearest = stored(nearest, "nearest")
    heads = per_file.where("head is not null").select("path", F.col("head.name").alias("h_name"), (-F.col("head.c")).alias("h_cosine"))
    out = own.drop("text").withColumn("dir", directory(F.col("path"))).join(heads, "path", "left").join(nearest, "dir", "left")
    inherits = F.col("h_name").isNull() & F.col("d_name").isNotNull()
    return out.select(
        "path",
        F.coalesce("h_name", "d_name").alias("license"),
        F.when(F.col("h_name").isNotNull(), "header").when(F.col("d_name").isNotNull(), "inherited").alias("origin"),
        F.coalesce("h_cosine", "d_cosine").alias("cosine"),
        F.when(inherits, F.col("licence_dir")).alias("licence_dir"),
        *(F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)),
    )


def document_path(source: str = "source", lang: str = "lang", doc_id: str = "doc_id") -> F.Column:
    """Where a document would lie in a tree. Every fiftieth id stands in its source's folder, every tenth of the others in the folder of its language there, both with a licence file's name; the rest lie one folder deeper, by hundred. Licence files without a notice govern nothing."""
    source, lang = F.coalesce(F.col(source), F.lit("_")), F.coalesce(F.col(lang), F.lit("_"))
    number = F.col(doc_id)
    name = F.coalesce(number.cast("string"), F.lit("_"))
    hundred = F.coalesce(F.floor(number / 100).cast("string"), F.lit("_"))
    return F.when(number % 50 == 0, F.concat(source, F.lit("/LICENSE."), name)).when(number % 10 == 0, F.concat(source, F.lit("/"), lang, F.lit("/LICENSE."), name)).otherwise(F.concat(source, F.lit("/"), lang, F.lit("/"), hundred, F.lit("/"), name, F.lit(".txt")))


def oracle(templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> str:
    """The scan over documents as SQL, without the filter on words."""
    w = Weights(templates, least)
    idf = ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in w.idf.items())
    vectors = ", ".join(f"({k}, '{name}', '{word}', {x!r}::DOUBLE)" for k, name, word, x in w.vectors)
    return f"""
WITH idf(w, idf) AS (VALUES {idf}),
vec(template, name, w, y) AS (VALUES {vectors}),
own AS (SELECT doc_id, coalesce(source, '_') || '/' || CASE WHEN doc_id % 50 = 0 THEN 'LICENSE.' || doc_id WHEN doc_id % 10 = 0 THEN coalesce(lang, '_') || '/LICENSE.' || doc_id ELSE coalesce(lang, '_') || '/' || coalesce(CAST(doc_id // 100 AS VARCHAR), '_') || '/' || coalesce(CAST(doc_id AS VARCHAR), '_') || '.txt' END AS path, coalesce(text, '') AS text FROM documents),
cut AS (SELECT path, string_split(text, chr(10)) AS l, text FROM own),
units AS (SELECT path, unnest(range(len(l))) AS line, unnest(l) AS t FROM cut UNION ALL SELECT path, -1, text FROM cut),
words AS (SELECT path, line, unnest(regexp_split_to_array(lower(t), '{WORD}')) AS w FROM units),
counted AS (SELECT path, line, w, count(*) AS tf FROM words WHERE w <> '' AND w NOT IN {STOP} GROUP BY ALL),
weighed AS (SELECT path, line, c.w, tf * coalesce(idf, {w.other!r}::DOUBLE) AS x FROM counted c LEFT JOIN idf ON c.w = idf.w),
norm AS (SELECT path, line, sqrt(sum(x * x)) AS norm FROM weighed GROUP BY ALL),
dots AS (SELECT path, line, template, name, sum(x * y) AS dot FROM weighed JOIN vec USING (w) GROUP BY ALL),
scored AS (SELECT path, line, name, round(dot / norm, 6) AS cosine FROM dots JOIN norm USING (path, line)),
best AS (SELECT path, line, name, cosine FROM scored WHERE cosine >= {least} QUALIFY row_number() OVER (PARTITION BY path, line ORDER BY cosine DESC, name) = 1),
heads AS (SELECT path, name AS h_name, cosine AS h_cosine FROM best WHERE line >= 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY cosine DESC, name) = 1),
wholes AS (SELECT path, name, cosine FROM best WHERE line < 0),
governs AS (SELECT * FROM wholes UNION ALL SELECT path, h_name, h_cosine FROM heads WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '{LICENCE_NAME}') AND path NOT IN (SELECT path FROM wholes)),
licences AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, name AS d_name, cosine AS d_cosine FROM governs QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, name) = 1),
dirs AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS below FROM own),
nearest AS (SELECT below, dir AS licence_dir, d_name, d_cosine FROM dirs JOIN licences ON dir = '' OR dir = below OR starts_with(below, dir || '/') QUALIFY row_number() OVER (PARTITION BY below ORDER BY length(dir) DESC) = 1)
SELECT doc_id, path, coalesce(h_name, d_name) AS license, CASE WHEN h_name IS NOT NULL THEN 'header' WHEN d_name IS NOT NULL THEN 'inherited' END AS origin, coalesce(h_cosine, d_cosine) AS cosine, CASE WHEN h_name IS NULL THEN licence_dir END AS licence_dir
FROM own LEFT JOIN heads USING (path) LEFT JOIN nearest ON nearest.below = regexp_replace(own.path, '/?[^/]*$', '')"""
