"""Small documents with everything the contracts name: nulls, empty and long texts, copies, repeated rows, odd columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns whose names clash with those that operators use inside.
CLASH = ("bitmap", "fp", "probability", "words", "shingles", "total", "blob", "h", "t", "n", "held")

_SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of".split(), "de": "sch ein ich ung keit ver ge ü ß zu en".split()}


def words(rng: random.Random, n: int, lang: str = "en") -> list[str]:
    return ["".join(rng.choices(_SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n)]


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    out = []
    while n > 0:
        k = rng.randint(4, 12)
        out.append(" ".join(words(rng, k, lang)).capitalize() + rng.choice([". ", ".\n", "! ", ", "]))
        n -= k
    return "".join(out).strip()


def documents(seed: int = 1, count: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    footer = "this line stands in very many of the documents, word for word"
    for i in range(count):
        lang = rng.choice(["en", "de"])
        text = prose(rng, rng.randint(20, 160), lang)
        if i % 4 == 0:
            text += "\n  " + (footer.upper() if i % 8 else footer) + "\t\n" + "short"
        if i % 10 == 9:
            text = rows[i - 3][1]
        if i % 10 == 5 and rows[i - 2][1]:
            text = rows[i - 2][1] + " " + " ".join(words(rng, 1))
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    rows += [
        (count, None, None, None, None),
        (count + 1, "", "en", "s0", 0),
        (count + 2, " \t\n ", "en", "s0", 4),
        (count + 3, prose(rng, 6000), "en", "s1", None),
        (count + 4, "one two", "en", "s0", 7),
        (None, "a text without an id", "en", "s0", None),
        rows[1],
        rows[1],
    ]
    return rows


def frame(spark, rows, clash: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH]) if clash else df
