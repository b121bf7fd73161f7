"""License scans by diagonal voting, in DataFrame functions only.

A template is a known notice; its rolling word k-grams are hashed with their positions (k = 4, and k = 2 for phrases that
are shorter). All rolling k-gram hashes of a text are joined to the templates' positions. A hit at word p of the text and word t
of the template votes for the diagonal p - t, the place where the template would begin. A phrase is found where all its
grams vote for one diagonal. For a longer template, diagonals that lie near each other are merged into one span, so that
words put in or left out don't part it; the span's similarity is the number of the template's words that its hits cover over
the longer of span and template, and spans and single diagonals from 0.8 up are kept. Hashes have 64 bits: with 1000
templates' grams some 10^16 grams of text give one false hit.

The templates are a parameter and lie in the driver; they are broadcast in slices of at most MAX_GRAMS grams each, whatever
their number. Hits and one row a text are all that is shuffled, never texts or words.

Defined results: a null text is the empty text; texts without a word, and those where nothing is found, have no places
(null), no labels (empty strings) and score 0; repeated rows get one row each; a null doc_id is an id like any other; an empty
table gives no rows; columns beside doc_id and text are not read. Case is that of A-Z: no other letter becomes an ASCII
one, except that the Kelvin sign would, and it is replaced first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm import shared

#: What parts words: the ASCII characters that are no letters or digits (of lower-cased text).
PART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a gram, of longer templates and of phrases.
LONG, SHORT = 4, 2
#: Least similarity of a span; distance within which diagonals are merged; words at which half the score is reached.
LEAST, NEAR, HALF = 0.8, 8, 8
MAX_GRAMS = 200_000


@dataclass(frozen=True)
class Template:
    """A notice of at least two words (of ASCII letters and digits) and its label; base: one of the fixed phrases."""

    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall("[0-9a-z]+", self.text.lower())

    @property
    def k(self) -> int:
        return SHORT if self.base or len(self.words) < LONG else LONG

    @property
    def near(self) -> int:
        """Distance within which its diagonals are merged."""
        return 0 if self.k == SHORT else min(NEAR, len(self.words) // 4)

    @property
    def grams(self) -> list[str]:
        return [" ".join(self.words[i : i + self.k]) for i in range(len(self.words) - self.k + 1)]


#: The base phrases with their labels, then the wording of common public notices.
TEMPLATES = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
    Template("mit", "released under the MIT License"),
    Template("mit", "licensed under the MIT License"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
        "under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
        "implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation",
    ),
    Template(
        "gpl",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    Template(
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions "
        "and the following disclaimer.",
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    Template("unlicense", "This is free and unencumbered software released into the public domain."),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
)


def words(text: Column) -> Column:
    """The words of a text in lower case."""
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u212b")))
    return F.array_remove(F.split(lowered, PART), "")


def _gram(k: int, word) -> Column:
    """The hash of a gram of k words; word(j) is its j-th. k takes part, so no short gram has a long one's hash."""
    return F.xxhash64(F.lit(k), *[word(j) for j in range(k)])


def _grams_of(templates: tuple[Template, ...], spark) -> list[DataFrame]:
    """g, template, t of the templates' grams, in slices; the first slice has the empty gram of template -1, too, by which
    every text has one hit."""
    rows = [(t.k, gram, n, at) for n, t in enumerate(templates) for at, gram in enumerate(t.grams)]
    out = []
    for start in range(0, max(len(rows), 1), MAX_GRAMS):
        part = rows[start : start + MAX_GRAMS] + [(0, "", -1, 0)] * (start == 0)
        frame = spark.createDataFrame(part, "k int, gram string, template int, t int")
        of = lambda k: _gram(k, lambda j: F.get(F.split("gram", " "), F.lit(j)))
        hashed = F.when(F.col("k") == LONG, of(LONG)).when(F.col("k") == SHORT, of(SHORT)).otherwise(of(0))
        out.append(frame.select(hashed.alias("g"), "template", "t"))
    return out


def hits(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, h (the text's hash), n_words, template, p, t: every place p of a text where the gram at t of a template stands;
    and one row of template -1 for each row of docs."""
    texts = docs.select(F.col("doc_id"), F.xxhash64("text").alias("h"), words(F.col("text")).alias("words"))
    counted = texts.withColumn("n_words", F.size("words").cast("bigint"))

    def rolled(k: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size("words") - k), lambda i: _gram(k, lambda j: F.get("words", i + j)))
        return F.when(F.size("words") >= k, each).otherwise(F.array().cast("array<bigint>"))

    # place 0 is the text's own row; then the grams of SHORT words, from place 1; then those of LONG words
    shorter = F.greatest(F.size("words") - SHORT + 1, F.lit(0))
    grams = F.concat(F.array(_gram(0, None)), rolled(SHORT), rolled(LONG))
    placed = counted.select("doc_id", "h", "n_words", shorter.alias("shorter"), F.posexplode(grams).alias("at", "g"))
    p = F.col("at") - 1 - F.when(F.col("at") > F.col("shorter"), F.col("shorter")).otherwise(0)
    found = None
    for slice_ in _grams_of(templates, docs.sparkSession):
        part = placed.join(F.broadcast(slice_), "g").select("doc_id", "h", "n_words", "template", p.alias("p"), "t")
        found = part if found is None else found.unionAll(part)
    return found


def spans(found: DataFrame, templates: tuple[Template, ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, h, template, start, stop, matched, similarity of the hits' spans that pass."""
    spark = found.sparkSession
    about = spark.createDataFrame(
        [(n, t.k, len(t.words), t.near) for n, t in enumerate(templates)], "template int, k int, length int, near int"
    )
    own = ["doc_id", "h", "template", "k", "length", "near"]
    voted = found.where("template >= 0").join(F.broadcast(about), "template")
    diagonals = voted.withColumn("diagonal", F.col("p") - F.col("t")).groupBy(*own, "diagonal").agg(
        F.min("p").alias("start"), (F.max("p") + F.first("k")).alias("stop"), F.sort_array(F.collect_set("t")).alias("ts")
    )
    covered = lambda ts: F.size(F.array_distinct(F.flatten(F.transform(ts, lambda t: F.sequence(t, t + F.col("k") - 1)))))
    along = Window.partitionBy("doc_id", "h", "template").orderBy("diagonal")
    parted = diagonals.where("near > 0").withColumn(
        "island", F.sum(F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= F.col("near"), 0).otherwise(1)).over(along)
    )
    merged = parted.groupBy(*own, "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.flatten(F.collect_list("ts")).alias("ts"), F.count("*").alias("n")
    )
    candidates = diagonals.select(*own, "start", "stop", "ts").unionByName(merged.where("n > 1").select(*own, "start", "stop", "ts"))
    matched = candidates.withColumn("matched", covered(F.col("ts")).cast("bigint"))
    longer = F.greatest(F.col("length"), F.col("stop") - F.col("start"))
    rated = matched.withColumn("similarity", F.col("matched") / longer)
    return rated.where(F.when(F.col("near") == 0, F.col("matched") == F.col("length")).otherwise(F.col("similarity") >= least)).select(
        "doc_id", "h", "template", "start", "stop", "matched", "similarity"
    )


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row. The score is the largest
    of similarity x matched words / (matched words + HALF) over a text's spans."""
    found = shared.written(hits(docs, templates), "hits")
    about = docs.sparkSession.createDataFrame([(n, t.label, t.base) for n, t in enumerate(templates)], "template int, label string, base boolean")
    each = spans(found, templates, least).join(F.broadcast(about), "template").select(
        "doc_id", "h", F.lit(None).cast("bigint").alias("n_words"), "label", "base", F.col("start").cast("bigint").alias("start"),
        (F.col("similarity") * F.col("matched") / (F.col("matched") + HALF)).alias("score"),
    )
    empty = [F.lit(None).cast(t).alias(c) for c, t in each.dtypes[3:]]
    texts = found.where("template = -1").select("doc_id", "h", "n_words", *empty)
    place = F.when(F.col("base"), F.col("start"))
    joined = lambda label: F.array_join(F.sort_array(F.collect_set(label)), ",")
    return (
        texts.unionByName(each)
        .groupBy("doc_id", "h")
        .agg(
            F.count("n_words").cast("int").alias("times"), F.max("n_words").alias("n_words"), F.count(place).alias("n_base"), F.min(place).alias("first_word"),
            F.max(place).alias("last_word"), joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"),
            F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
        )
        .withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
        .drop("h", "times", "time")
    )
