"""Chat formatting by quotation linking, in DataFrame functions only.

A message is cut into passages: maximal runs of lines of one quote level (the number of leading `>`); level 0 is the
message's own text. A passage is normalised to its words (lower case, runs of letters and digits) over its line breaks, so
a quote that was wrapped anew is the same passage. It is hashed as a whole and by its shingles of SHINGLE_WORDS words; of
what may be quoted, each line is hashed as a whole too, so that a short quote links to a line or passage that says nothing
else, and never to a word within another sentence.

A quoted passage of level n is joined to what an earlier message has at level n - 1, and, where it is quoted deeper, to
what one has of its own; each hash goes to the latest earlier message of the conversation that has it there. The passage
links to the message with the most of its hashes (a whole counts like all shingles) if that has half of them at least. A
message replies to the message that its outermost passages link to with the most hashes (then its deeper ones; the
latest of several), and where none links, to the message before it. One that replies to another than the message before
it opens a branch there. The result has one row a message, without quotes, with the path of branches that lead to it;
sorting a conversation by `path` puts every branch right after the message that it replies to, so no task ever gathers
a conversation.

"The message before" and "the latest earlier message" are found in two steps, within spans of SPAN turns and then among
the spans, so that a conversation of any length is dealt over many tasks. Only conversations with a quote are searched.
Paths of branches double in length with each round; messages outside of branches take no part in the rounds.

Defined results: a null or empty text has no passages and a null text stays null; rows with the same conversation and turn
are one message for the links of others, each keeps its own row; a null conv_id or turn replies to nothing and is a path
of its own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm import shared

SPAN = 1024
SHINGLE_WORDS = 5
_MARK = r"^[ \t]*((?:>[ \t]*)+)"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARK, 1), "[^>]", ""))


def _let(value: Column, of) -> Column:
    """of(value), which is computed once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _whole(words: Column) -> Column:
    return F.xxhash64(F.lit("whole"), F.array_join(words, " "))


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, place, level, words, lines (without marks) of the passages with a word of messages(conv_id, turn, text)."""

    def cut(m: Column) -> Column:
        n = F.size(m["levels"])
        begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(m["levels"], i) != F.get(m["levels"], i - 1)))
        return _let(
            begins,
            lambda s: F.zip_with(
                s,
                F.concat(F.slice(s, 2, F.size(s)), F.array(n)),
                lambda a, b: F.struct(F.get(m["levels"], a).alias("level"), F.slice(m["bare"], a + 1, b - a).alias("lines")),
            ),
        )

    lines = F.split("text", "\n")
    cleaned = _let(
        lines, lambda x: F.struct(F.transform(x, _level).alias("levels"), F.transform(x, lambda y: F.regexp_replace(y, _MARK, "")).alias("bare"))
    )
    return (
        messages.where("text IS NOT NULL")
        .select("conv_id", "turn", F.posexplode(_let(cleaned, cut)).alias("place", "p"))
        .select("conv_id", "turn", "place", "p.level", _words(F.array_join("p.lines", " ")).alias("words"), "p.lines")
        .where(F.size("words") > 0)
    )


def _hashes(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What quotes ask for (conv_id, k, h, turn, place, level, weight, total) and what messages have (conv_id, k, h, turn),
    k being the level at which it must stand."""
    last = F.size("words") - SHINGLE_WORDS
    shingle = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(SHINGLE_WORDS)])
    none = F.array_repeat(F.lit(0).cast("bigint"), 0)
    hashed = found.withColumn("shingles", F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), shingle))).otherwise(none))
    total = F.greatest(F.size("shingles"), F.lit(1))
    weighed = F.concat(
        F.transform("shingles", lambda x: F.named_struct(F.lit("h"), x, F.lit("weight"), F.lit(1))),
        F.array(F.named_struct(F.lit("h"), _whole(F.col("words")), F.lit("weight"), total)),
    )
    levels = F.array_distinct(F.array(F.col("level") - 1, F.lit(0)))
    asked = (
        hashed.where("level > 0")
        .select("conv_id", "turn", "place", "level", total.alias("total"), F.explode(levels).alias("k"), weighed.alias("hashes"))
        .select("conv_id", "turn", "place", "level", "total", "k", F.explode("hashes").alias("x"))
        .select("conv_id", "k", "x.h", "turn", "place", "level", "x.weight", "total")
    )
    line_wholes = F.transform(F.filter(F.transform("lines", _words), lambda w: F.size(w) > 0), _whole)
    held = hashed.select(
        "conv_id", F.col("level").alias("k"), F.explode(F.array_distinct(F.concat("shingles", F.array(_whole(F.col("words"))), line_wholes))).alias("h"), "turn"
    )
    return asked, held.distinct()


def latest_before(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with `found`: the largest non-null `value` of rows of the same keys with a smaller turn."""
    span = F.floor(F.col("turn") / SPAN)
    spanned = rows.withColumn("span", span)
    tops = spanned.groupBy(*keys, "span").agg(F.max(value).alias("top"))
    before = Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "span", F.max("top").over(before).alias("earlier"))
    inside = Window.partitionBy(*keys, "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    return (
        spanned.withColumn("within", F.max(value).over(inside))
        .join(tops, [*keys, "span"])
        .withColumn("found", F.coalesce("within", "earlier"))
        .drop("span", "within", "earlier")
    )


def replies(messages: DataFrame) -> DataFrame:
    """conv_id, turn, previous, reply_to, n_linked of each message of messages(conv_id, turn, text) with neither of these null."""
    known = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    turns = known.select("conv_id", "turn").distinct()
    previous = latest_before(turns.withColumn("at", F.col("turn")), ["conv_id"], "at").select(
        "conv_id", "turn", F.col("found").alias("previous")
    )
    quoting = known.where(F.rlike("text", F.lit(r"(^|\n)[ \t]*>"))).select("conv_id").distinct()
    quoting = shared.checked_broadcast(shared.written(quoting, "quoting"))
    found = shared.written(passages(known.join(quoting, "conv_id", "left_semi")), "passages")
    asked, held = _hashes(found)
    asked = shared.written(asked, "asked")
    wanted = asked.select("conv_id", "k", "h", "turn").distinct().withColumn("own", F.lit(None).cast("bigint"))
    # what nobody quotes needs no search
    have = held.join(asked.select("conv_id", "k", "h").distinct(), ["conv_id", "k", "h"], "left_semi").withColumn("own", F.col("turn"))
    both = wanted.unionByName(have).groupBy("conv_id", "k", "h", "turn").agg(F.max("own").alias("own"))
    latest = latest_before(both, ["conv_id", "k", "h"], "own").where("found IS NOT NULL").select("conv_id", "k", "h", "turn", "found")
    votes = (
        asked.join(latest, ["conv_id", "k", "h", "turn"])
        .groupBy("conv_id", "turn", "place", "level", "total", "found", "h")
        .agg(F.max("weight").alias("weight"))  # found at either level
        .groupBy("conv_id", "turn", "place", "level", "total", "found")
        .agg(F.sum("weight").alias("votes"))
    )
    linked = votes.groupBy("conv_id", "turn", "place", "level", "total").agg(F.max(F.struct("votes", "found")).alias("best"))
    linked = linked.where(2 * F.col("best.votes") >= F.col("total"))
    targets = linked.groupBy("conv_id", "turn", "best.found").agg(
        F.sum(F.when(F.col("level") == 1, F.col("best.votes"))).alias("outer"),
        F.coalesce(F.sum(F.when(F.col("level") > 1, F.col("best.votes"))), F.lit(0)).alias("deeper"),
        F.count(F.lit(1)).alias("passages"),
    )
    best = F.max(F.when(F.col("outer").isNotNull(), F.struct("outer", "deeper", "found"))).alias("best")
    chosen = targets.groupBy("conv_id", "turn").agg(best, F.sum("passages").alias("n_linked"))
    return previous.join(chosen, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "previous", F.coalesce("best.found", "previous").alias("reply_to"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked")
    )


def branches(links: DataFrame) -> DataFrame:
    """conv_id, head, path (for each branch on the way, the turn that it replies to and its first turn) of the branches
    in links(conv_id, turn, head, reply_to, opens). A message replies to an earlier one, so the rounds come to an end."""
    at = links.select("conv_id", F.col("turn").alias("reply_to"), F.col("head").alias("up"))
    opened = links.where("opens").select("conv_id", F.col("turn").alias("head"), "reply_to")
    now = shared.written(
        opened.join(at, ["conv_id", "reply_to"], "left").select("conv_id", "head", F.array("reply_to", "head").alias("path"), "up"),
        "branches",
    )
    while True:
        if not now.where("up IS NOT NULL").take(1):
            return now.select("conv_id", "head", "path")
        above = now.select("conv_id", F.col("head").alias("up"), F.col("path").alias("upper"), F.col("up").alias("next"))
        longer = now.where("up IS NOT NULL").join(above, ["conv_id", "up"]).select(
            "conv_id", "head", F.concat("upper", "path").alias("path"), F.col("next").alias("up")
        )
        now = shared.written(now.where("up IS NULL").union(longer), "branches")


def _sortable(turn: Column) -> Column:
    """16 hex digits in the order of the turns, negative ones first."""
    return F.lpad(F.hex(turn.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, depth, path, n_quoted, n_linked, text (without quotes), formatted."""
    chat = messages.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    known = replies(chat).withColumn("opens", F.col("n_linked") > 0)
    known = known.withColumn("opens", F.col("opens") & (F.col("reply_to") != F.col("previous")))
    known = known.withColumn("start", F.when(F.col("opens"), F.col("turn")))
    known = latest_before(known, ["conv_id"], "start").withColumn("head", F.coalesce("start", "found"))
    links = shared.written(known.select("conv_id", "turn", "head", "reply_to", "n_linked", "opens"), "replies")
    inside = shared.join_back(links.where("head IS NOT NULL"), branches(links), ["conv_id", "head"])
    placed = inside.unionByName(links.where("head IS NULL").withColumn("path", F.lit(None).cast("array<bigint>"))).select(
        F.col("conv_id").alias("c"), F.col("turn").alias("t"), "reply_to", F.coalesce("path", F.array().cast("array<bigint>")).alias("path"), "n_linked"
    )
    lines = F.split("text", "\n")
    own = F.filter(lines, lambda x: _level(x) == 0)
    text = F.regexp_replace(F.array_join(own, "\n"), r"^\n+|\n+$", "")
    clean = F.when(F.col("text").isNotNull(), F.when(F.size(own) < F.size(lines), text).otherwise(F.col("text")))
    return chat.join(placed, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left").select(
        "conv_id",
        "turn",
        "role",
        "reply_to",
        F.coalesce(F.floor(F.size("path") / 2), F.lit(0)).cast("int").alias("depth"),
        F.array_join(
            F.transform(F.concat(F.coalesce("path", F.array().cast("array<bigint>")), F.array("turn")), _sortable), "."
        ).alias("path"),
        F.coalesce(F.size(lines) - F.size(own), F.lit(0)).cast("bigint").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        clean.alias("text"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce(clean, F.lit("")), F.lit("\n<|end|>")).alias("formatted"),
    )
