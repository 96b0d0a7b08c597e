"""Licence scan by sparse TF-IDF vectors and inheritance along directories.

The lines of each file, and the whole text of licence files, are compared with
licence templates by the cosine of their TF-IDF vectors; document frequencies are
counted over all files.  A file without a licence of its own takes that of the
nearest directory above it which has a licence file with a known licence.

Only DataFrame functions are used.  A line can only reach the wanted cosine if the
words that it shares with a template make up enough of the template's length; other
lines are left out, without loss, before words are counted.  The templates are part of the program, so their words are the only
thing that is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.llm import common
from counterpoise.workspace import materialize

MIN_COSINE = 0.6
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-][A-Za-z0-9.-]*)?$"
WORD = "[A-Za-z0-9]+"

# Usual notices and opening words of licences, by licence.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def words(text: str | Column) -> Column:
    """Words of ASCII letters and digits, lower-cased."""
    return F.transform(F.regexp_extract_all(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), F.lit(WORD), F.lit(0)), F.lower)


def template_weights(files: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, text: str = "text") -> DataFrame:
    """``template``, ``licence``, ``word``, ``idf``, ``weight``, ``unseen`` (idf of other words); weights of a template have length 1.

    ``idf`` is ``1 + ln((files + 1) / (files with the word + 1))``.
    """
    spark = files.sparkSession
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(templates)], "template int, licence string, body string")
    counted = rows.select("template", "licence", F.explode(words("body")).alias("word")).groupBy("template", "licence", "word").agg(F.count(F.lit(1)).alias("tf"))
    vocabulary = sorted({r["word"] for r in counted.select("word").distinct().collect()})
    known = F.array(*[F.lit(w) for w in vocabulary])
    found = files.select(F.explode(F.array_intersect(words(text), known)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n = files.count()
    weighed = counted.join(F.broadcast(found), "word", "left").withColumn("idf", 1 + F.log(F.lit(n + 1.0) / (F.coalesce("df", F.lit(0)) + 1)))
    length = weighed.groupBy("template").agg(F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2)).alias("length"))
    weighed = weighed.join(F.broadcast(length), "template").select(
        "template", "licence", "word", "idf", (F.col("tf") * F.col("idf") / F.col("length")).alias("weight"), (1 + F.log(F.lit(n + 1.0))).alias("unseen")
    )
    return materialize(weighed.coalesce(1), "templates")


def reachable(weights: DataFrame, min_cosine: float) -> tuple[Column, Column, Callable[[str, str], Column]]:
    """What a text must have to reach the cosine with any template.

    The cosine is at most the length of that part of the template whose words the
    text has, times the share that template words have in the length of the text.
    The first value is an array of words of which the text must have one (without
    them, what is left of each template is too short), the second holds all template
    words, the third tests the words of a text and the template words among them.
    """
    by_template: dict[int, dict[str, float]] = {}
    idfs, unseen = {}, 1.0
    for r in weights.select("template", "word", "weight", "idf", "unseen").collect():
        by_template.setdefault(r["template"], {})[r["word"]] = r["weight"] ** 2
        idfs[r["word"]], unseen = r["idf"], r["unseen"]
    enough = min_cosine**2 - 1e-9
    decisive = set()
    for found in by_template.values():
        rest = 0.0
        for word, square in sorted(found.items(), key=lambda x: (x[1], x[0])):
            rest += square
            if rest >= enough:
                decisive.add(word)
    literal = lambda pairs: F.create_map(*[F.lit(x) for pair in sorted(pairs.items()) for x in pair])
    squares, idf = F.array(*[literal(found) for found in by_template.values()]), literal(idfs)
    array = lambda words_: F.array(*[F.lit(w) for w in sorted(words_)])

    def long_enough(found: str, known: str) -> Column:
        times = lambda w: F.size(F.filter(found, lambda x: x == w))
        inside = F.aggregate(known, F.lit(0.0), lambda a, w: a + (times(w) * idf[w]) * (times(w) * idf[w]))
        outside = (F.size(F.array_distinct(found)) - F.size(known)) * F.lit(unseen**2)
        shared = lambda t: F.aggregate(known, F.lit(0.0), lambda a, w: a + F.coalesce(t[w], F.lit(0.0)))
        return F.array_max(F.transform(squares, shared)) * inside >= F.lit(enough) * (inside + outside)

    return array(decisive), array(idfs), long_enough


def matches(files: DataFrame, weights: DataFrame, min_cosine: float = MIN_COSINE, path: str = "path", text: str = "text") -> DataFrame:
    """``path``, ``licence``, ``cosine`` of the best line (or whole licence file) of each path that has one; ties go to the first licence by name."""
    decisive, vocabulary, long_enough = reachable(weights, min_cosine)
    name = F.element_at(F.split(path, "/"), -1)
    held = files.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(text).alias("text"), name.rlike(LICENCE_FILE).alias("whole"))
    held = held.where(F.arrays_overlap(words("text"), decisive))
    # Words come out of generators, so that they are found once and not again in every test below.
    lines = held.select("path", F.posexplode(F.transform(F.split("text", "\n"), words)).alias("line", "found"))
    whole = held.where("whole").select("path", F.lit(-1).alias("line"), F.explode(F.array(words("text"))).alias("found"))
    units = lines.unionByName(whole).where(F.arrays_overlap("found", decisive))
    units = units.select("path", "line", "found", F.explode(F.array(F.array_intersect("found", vocabulary))).alias("known"))
    units = units.where(long_enough("found", "known")).drop("known")
    # Equal files of one path are one file: their equal lines are counted once.
    counted = units.distinct().withColumn("unit", F.xxhash64("path", "line", "found")).select("path", "line", "unit", F.explode("found").alias("word"))
    counted = counted.groupBy("path", "line", "unit", "word").agg(F.count(F.lit(1)).alias("tf"))
    idf = F.broadcast(weights.select("word", "idf").distinct())
    unseen = weights.select("unseen").first()["unseen"]
    counted = counted.join(idf, "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    # One row for each template that has the word, and one without template for the length of the unit.
    by_template = F.broadcast(weights.groupBy("word").agg(F.collect_list(F.struct("template", "licence", "weight")).alias("in")))
    summed = counted.join(by_template, "word", "left").groupBy("path", "line", "unit")
    spread = summed.agg(
        F.sqrt(F.sum(F.col("w") ** 2)).alias("length"),
        F.flatten(F.collect_list(F.transform("in", lambda t: F.struct(t["template"].alias("template"), t["licence"].alias("licence"), (t["weight"] * F.col("w")).alias("part"))))).alias("parts"),
    )
    dots = spread.select("path", "line", "unit", "length", F.explode("parts").alias("p")).groupBy("path", "line", "unit", "p.template", "p.licence").agg(
        F.round(F.sum("p.part") / F.max("length"), 9).alias("cosine")
    )
    best = dots.where(F.col("cosine") >= min_cosine).groupBy("path").agg(F.min(F.struct((-F.col("cosine")).alias("cosine"), "licence")).alias("best"))
    return best.select("path", "best.licence", (-F.col("best.cosine")).alias("cosine"))


def folder(path: str | Column) -> Column:
    """The directory of a path; the empty text for a file at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherited(dirs: DataFrame, licensed: DataFrame) -> DataFrame:
    """``dir``, ``licence``, ``from_dir`` of those ``dirs`` (column ``dir``) that have a licensed directory at or above them.

    ``licensed`` has one row for each ``dir`` with its ``licence``.  The path of each
    directory is spread to its ancestors and joined with the licensed ones; the
    deepest wins.  Directories are distinct, so a directory with very many files
    is looked up once.
    """
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    spread = dirs.select("dir", F.explode(F.array_distinct(above)).alias("up"))
    met = spread.join(licensed.select(F.col("dir").alias("up"), "licence"), "up")
    best = met.groupBy("dir").agg(F.max(F.struct(F.length("up").alias("depth"), "up", "licence")).alias("best"))
    return best.select("dir", "best.licence", F.col("best.up").alias("from_dir"))


def scan(files: DataFrame, min_cosine: float = MIN_COSINE, path: str = "path", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``files`` with ``licence``, ``cosine``, ``origin`` (``own``, ``inherited`` or ``none``) and ``from_dir``.

    Null and empty texts match nothing and inherit.  Rows of one path are one file:
    the best match of any of them holds for all.  A null path neither matches nor
    inherits.  Of several licence files in a directory the best match counts, then
    the first licence by name.  New columns get a number behind their name where
    ``files`` has that name.
    """
    inner = files.toDF(*[f"c{i}" for i in range(len(files.columns))])
    path_at, text_at = (f"c{files.columns.index(c)}" for c in (path, text))
    weights = template_weights(inner, templates, text_at)
    own = materialize(matches(inner, weights, min_cosine, path_at, text_at), "licences")
    name = F.element_at(F.split("path", "/"), -1)
    at_dir = own.where(name.rlike(LICENCE_FILE)).groupBy(folder("path").alias("dir")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"))
    licensed = at_dir.select("dir", "b.licence")
    dirs = inner.where(F.col(path_at).isNotNull()).select(folder(path_at).alias("dir")).distinct()
    above = materialize(inherited(dirs, licensed), "inherited").select(F.col("dir"), F.col("licence").alias("dir_licence"), "from_dir")
    rows = inner.withColumn("path", F.col(path_at)).withColumn("dir", folder(path_at))
    rows = rows.join(own, "path", "left").join(above, "dir", "left")
    names = common.fresh(files, "licence", "cosine", "origin", "from_dir")
    has_own = F.col("licence").isNotNull()
    return rows.select(
        *inner.columns,
        F.coalesce("licence", "dir_licence"),
        "cosine",
        F.when(has_own, "own").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none"),
        F.when(~has_own, F.col("from_dir")),
    ).toDF(*files.columns, *names)
