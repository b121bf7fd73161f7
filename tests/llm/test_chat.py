"""Quotation linking against a conversation worked out by hand."""

import random
import re

from lattica.llm import chat
from tests.llm.fixtures import prose

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rows(spark, data):
    return {(r.conv_id, r.turn): r for r in chat.conversations(spark.createDataFrame(data, SCHEMA)).collect()}


def test_links_orders_and_strips(spark):
    found = rows(
        spark,
        [
            (1, 0, "user", "How do I start?\nAnd how do I stop?"),
            (1, 1, "assistant", "Press the green button."),
            (1, 2, "assistant", "> and HOW do i stop\nPress the red one."),
            (1, 3, "user", ">> how do I start?\n> Press the green button!\nThanks, that works."),
            (1, 4, "user", "Bye."),
            (2, 0, "user", "> and how do I stop?\nno such line here"),
        ],
    )
    assert [found[1, t].reply_to for t in range(5)] == [None, 0, 0, 1, 3]
    assert [found[1, t].n_quoted for t in range(5)] == [0, 0, 1, 2, 0]
    assert [found[1, t].n_linked for t in range(5)] == [0, 0, 1, 2, 0]
    assert found[1, 2].text == "Press the red one." and found[1, 3].text == "Thanks, that works."
    assert found[2, 0].reply_to is None and found[2, 0].text == "no such line here"
    order = sorted(range(5), key=lambda t: found[1, t].path)
    assert order == [0, 2, 1, 3, 4]
    assert found[1, 3].formatted == "<|user|>\nThanks, that works.\n<|end|>"


def test_nulls_repeats_and_empty_tables(spark):
    data = [(None, 0, "user", "a"), (1, None, "user", "b"), (1, 0, None, None), (1, 1, "user", ""), (1, 1, "user", "")]
    out = chat.conversations(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(out) == 5
    assert {(r.conv_id, r.turn, r.reply_to) for r in out} == {(None, 0, None), (1, None, None), (1, 0, None), (1, 1, 0)}
    assert chat.conversations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_conversations_cross_spans(spark):
    n = 3 * chat.SPAN
    data = [(7, t, "user", f"line number {t}") for t in range(n)] + [(7, n + 5, "user", "> line number 3\nyes")]
    found = rows(spark, data)
    assert found[7, n + 5].reply_to == 3 and found[7, n + 5].depth == 1
    assert found[7, chat.SPAN].reply_to == chat.SPAN - 1


def plain(data):
    """(reply_to, linked passages) of each message, by comparing every passage with every earlier message."""

    def cut(text):
        out = []
        for line in (text or "").split("\n"):
            mark = re.match(r"[ \t]*((?:>[ \t]*)+)", line)
            level = mark[1].count(">") if mark else 0
            bare = line[mark.end():] if mark else line
            if not out or out[-1][0] != level:
                out.append((level, []))
            out[-1][1].append(bare)
        words = lambda x: tuple(re.findall(r"[^\W_]+", x.lower()))
        cuts = [(level, words(" ".join(lines)), {words(x) for x in lines} - {()}) for level, lines in out]
        return [c for c in cuts if c[1]]

    def shingles(words):
        return {words[i : i + 5] for i in range(len(words) - 4)}

    found = {}
    messages = sorted(data, key=lambda r: (r[0], r[1]))
    for conv, turn, _, text in messages:
        earlier = [r for r in messages if r[0] == conv and r[1] < turn]
        outer, deeper, n = {}, {}, 0
        for level, words, _ in cut(text):
            if not level:
                continue
            total = max(1, len(shingles(words)))
            votes = {}
            for k in {level - 1, 0}:
                for what in [*shingles(words), ("whole", words)]:
                    holders = []
                    for r in earlier:
                        for lev, w, lines in cut(r[3]):
                            if lev == k and (what in shingles(w) or (what[0] == "whole" and (what[1] == w or what[1] in lines))):
                                holders.append(r[1])
                    if holders:
                        votes.setdefault(max(holders), {})[what] = total if what[0] == "whole" else 1
            if votes:
                score, at = max((sum(v.values()), t) for t, v in votes.items())
                if 2 * score >= total:
                    n += 1
                    side = outer if level == 1 else deeper
                    side[at] = side.get(at, 0) + score
        before = max((r[1] for r in earlier), default=None)
        best = max(((v, deeper.get(t, 0), t) for t, v in outer.items()), default=(0, 0, before))[2]
        found[conv, turn] = (best, n)
    return found


def test_links_equal_those_of_brute_force(spark):
    rng = random.Random(31)
    data = []
    for conv in range(12):
        texts = []
        for turn in range(rng.randint(2, 12)):
            own = rng.choice(["ok", "yes, thanks", prose(rng, 12), prose(rng, 40)])
            lines = [own]
            for _ in range(rng.choice([0, 0, 1, 2]) if texts else 0):
                quoted = rng.choice(texts)
                if rng.random() < 0.4:  # a part of it
                    words = quoted.replace("\n", " \n ").split(" ")
                    at = rng.randrange(len(words))
                    quoted = " ".join(words[at : at + rng.randint(3, 25)])
                if rng.random() < 0.4:  # wrapped anew
                    words = quoted.replace(">", " ").split()
                    quoted = "\n".join(" ".join(words[i : i + 6]) for i in range(0, len(words), 6))
                lines.insert(rng.randint(0, len(lines)), "\n".join(rng.choice(["> ", ">", " > "]) + x for x in quoted.split("\n")))
            texts.append("\n".join(lines))
            data.append((conv, turn * rng.choice([1, 1, 3]) + 100 * turn - 300, "user", texts[-1]))
    out = rows(spark, data)
    want = plain(data)
    assert {k: (r.reply_to, r.n_linked) for k, r in out.items()} == want
    assert sum(n for _, n in want.values()) > 20 and sum(r.depth > 0 for r in out.values()) > 3


def test_wrapped_partial_and_short_quotes(spark):
    said = "The quick brown fox jumps over the lazy dog and then it sleeps for a very long while in the sun."
    found = rows(
        spark,
        [
            (1, 0, "user", said),
            (1, 1, "user", "ok, but the quick answer is no"),
            (1, 2, "user", "ok"),
            (1, 3, "user", "> The quick brown fox\n> jumps over the lazy\n> dog and then it sleeps\nIndeed."),
            (1, 4, "user", "> ok\nGood."),
            (1, 5, "user", "> quick answer\nWhich?"),
        ],
    )
    assert [found[1, t].reply_to for t in range(6)] == [None, 0, 1, 0, 2, 4]
    assert [found[1, t].n_linked for t in range(6)] == [0, 0, 0, 1, 1, 0]


def test_ties_long_texts_and_odd_columns(spark):
    from pyspark.sql import functions as F

    long = "\n".join(f"line {k} of a text that goes on and on" for k in range(4000))
    quote = "\n".join("> " + x for x in long.split("\n")[1000:3000])
    data = [(1, 0, "user", "the same five words here"), (1, 1, "user", "the same five words here"), (1, 2, "user", "> the same five words here\nyes"),
            (1, -5, "user", long), (1, 10**11, "user", quote + "\nall of it"), (1, 2, "user", "> the same five words here\nyes")]
    df = spark.createDataFrame(data, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("k", "h", "own", "found", "place", "level", "path", "head")])
    out = chat.conversations(df).collect()
    found = {(r.turn): r for r in out}
    assert len(out) == 6 and found[2].reply_to == 1 and found[10**11].reply_to == -5 and found[10**11].text == "all of it"
    assert sorted(found, key=lambda t: found[t].path) == [-5, 10**11, 0, 1, 2]
