"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

Texts are lower-cased and cut into words (runs of letters and digits) and five-word shingles. Every text is covered by
windows of shingles, of the lengths that the benchmark's items ask for (CLASSES): an item belongs to the longest one for
which a window that begins anywhere at a multiple of the step still lies within the least part of the item that a match
must share. The item lists the fingerprints of its own parts of that length at every offset that a step can make, from
its beginning, from its end and, if it is long, from every LONGEST shingles between, so that some window of the text is cut
exactly like one of them. Texts no longer than the longest item are also compared as a whole.

A window's SimHash counts ones for all 64 bits at once, in longs that hold one binary digit of the 64 counts each; longer
windows are added from shorter ones, in plain columns that one generated function computes. A multi-index finds the
items: fingerprints within RADIUS differ by at most RADIUS // BLOCKS bits in one of BLOCKS blocks, so an item is listed
under all values of each block within that many bits of its own. Where a candidate lies in a text, all windows of n
shingles are verified by their exact weighted Jaccard similarity, a shingle's weight being the number of times it
occurs; equal windows are verified once.

Recall: the multi-index loses nothing within the radius. At the least similarity of 0.8, parts of items differ by some 10 bits,
but the edits seldom hit all parts alike: of 819 simulated passages of 11 to 54 shingles with words replaced, added or cut off
and a similarity from 0.8 up, 797 had a part within 9 bits (all of those from 0.85 up); a radius of 11 with six blocks finds
818, at twice the time.

Defined results: null and empty texts match nothing; items of fewer than five words have no shingle and match nothing;
a text shorter than an item is compared as a whole; repeated rows give one result; rows with one doc_id but other texts
are compared one by one and the best match counts, as for rows of the benchmark with one item_id; a null doc_id or item_id
is one like any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm import shared

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
RADIUS = 9
BLOCKS = 5
#: (length, step) of windows, in shingles.
CLASSES = ((1, 1), (2, 1), (4, 1), (6, 4), (16, 8), (32, 8))
LONGEST = 32
_EDGES = [round(64 * k / BLOCKS) for k in range(BLOCKS + 1)]


def with_shingles(df: DataFrame, text: str) -> DataFrame:
    """df with shingles, the hashes of its text's five-word shingles in order (null if there are none), and total, their
    number. No filter on them: the optimizer would compute the words anew for it, once a word."""
    worded = df.withColumn("words", F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    at = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(SHINGLE_WORDS)])
    last = F.size("words") - SHINGLE_WORDS
    return (
        worded.withColumn("shingles", F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), at)))
        .withColumn("total", F.greatest(last + 1, F.lit(0)))
        .drop("words")
    )


def simhash(hashes: Column, most: int) -> Column:
    """Bit = 1 where set in over half of the hashes, of which there are `most` at most. Ones are counted for all 64 bits
    at once, in longs that hold one binary digit of the 64 counts each."""
    planes = most.bit_length()
    zero = F.struct(*[F.lit(0).cast("bigint").alias(f"p{k}") for k in range(planes)])

    def add(digits: Column, h: Column) -> Column:
        carry, out = h, []
        for k in range(planes):
            digit = digits[f"p{k}"]
            out.append(digit.bitwiseXOR(carry).alias(f"p{k}"))
            carry = digit.bitwiseAND(carry)
        return F.struct(*out)

    def over_half(digits: Column) -> Column:
        half = F.floor(F.size(hashes) / 2).cast("bigint")
        more, same = F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")
        for k in reversed(range(planes)):
            digit = digits[f"p{k}"]
            wants = -F.shiftright(half, k).bitwiseAND(F.lit(1).cast("bigint"))  # all ones if half has this digit
            more = more.bitwiseOR(same.bitwiseAND(digit).bitwiseAND(F.bitwise_not(wants)))
            same = same.bitwiseAND(F.bitwise_not(digit.bitwiseXOR(wants)))
        return more

    return F.aggregate(hashes, zero, add, over_half)


def classes(least: float) -> list[tuple[int, int, int]]:
    """(least number of shingles of an item, length, step) of the classes of windows."""
    # windows of equal size that reach the similarity share 2 * least / (1 + least) of the item
    return [(1 if n == 1 else ceil((n + step - 1) * (1 + least) / (2 * least) - 1e-9), n, step) for n, step in CLASSES]


def _added(a: list[Column], b: list[Column]) -> list[Column]:
    """The digits of the sums of two counts."""
    carry, out = None, []
    for k in range(max(len(a), len(b))):
        u, v = (x[k] if k < len(x) else None for x in (a, b))
        if u is None or v is None:
            u = v if u is None else u
            out.append(u if carry is None else u.bitwiseXOR(carry))
            carry = None if carry is None else u.bitwiseAND(carry)
        else:
            either, both = u.bitwiseXOR(v), u.bitwiseAND(v)
            out.append(either if carry is None else either.bitwiseXOR(carry))
            carry = both if carry is None else both.bitwiseOR(carry.bitwiseAND(either))
    return out if carry is None else [*out, carry]


def _over(digits: list[Column], half: int) -> Column:
    """Bits whose count is over half."""
    more = F.lit(0).cast("bigint")
    for k, digit in enumerate(digits):
        more = digit.bitwiseAND(more) if half >> k & 1 else digit.bitwiseOR(more)
    return more


def window_fingerprints(texts: DataFrame, lengths: set[int], longest: int) -> DataFrame:
    """doc_id, t, class, start, fp of all windows of texts(doc_id, t, shingles, total) of the given lengths, and of the whole
    text (class 0) where it has at most `longest` shingles. A row stands for eight places at which windows begin."""
    none = F.array_repeat(F.lit(0).cast("bigint"), 0)  # its elements are known not to be null
    whole = F.when((F.col("total") <= longest) & (F.col("total") > 0), simhash(F.col("shingles"), max(1, longest)))
    df = texts.select(
        "doc_id", "t", "total", F.concat(F.coalesce("shingles", none), F.array_repeat(F.lit(0).cast("bigint"), LONGEST + 8)).alias("padded"), whole.alias("whole")
    )
    df = df.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.col("total") - 1, F.lit(0)), F.lit(8))).alias("s"))
    kept = ["doc_id", "t", "total", "whole", "s"]
    df = df.select(*kept, *[F.col("padded")[F.col("s") + k].alias(f"h{k}") for k in range(LONGEST)])
    h = lambda k: F.col(f"h{k}")
    found: list[tuple[int, int, Column]] = []  # length, place, fingerprint
    if 1 in lengths:
        found += [(1, k, h(k)) for k in range(8)]
    if 2 in lengths:
        found += [(2, k, h(k).bitwiseAND(h(k + 1))) for k in range(8)]
    if 4 in lengths:
        three = lambda a, b, c, d: a.bitwiseAND(b).bitwiseAND(c.bitwiseOR(d)).bitwiseOR(c.bitwiseAND(d).bitwiseAND(a.bitwiseOR(b)))
        found += [(4, k, three(*[h(k + i) for i in range(4)])) for k in range(8)]
    fps = {f"f{n}_{k}": fp for n, k, fp in found}

    def layer(df: DataFrame, counts: dict[str, list[Column]], done: dict[str, Column]) -> tuple[DataFrame, dict[str, list[Column]]]:
        """One more layer of sums as columns."""
        columns = {f"{name}_{d}": digit for name, digits in counts.items() for d, digit in enumerate(digits)}
        df = df.select(*kept, *[x.alias(c) for c, x in {**columns, **done}.items()])
        return df, {name: [F.col(f"{name}_{d}") for d in range(len(digits))] for name, digits in counts.items()}

    done = dict(fps)
    marks = [(n, k, f"f{n}_{k}") for n, k, _ in found]
    large = max(lengths, default=0)
    if large >= 6:
        reach = 8 if large == 6 else large  # shingles that the sums need
        df, two = layer(df, {f"a{k}": _added([h(2 * k)], [h(2 * k + 1)]) for k in range(5 if large == 6 else reach // 2)}, done)
        done = {c: F.col(c) for c in done}
        own = {c: two[c] for c in ("a2", "a4")}
        df, four = layer(df, own | {f"b{k}": _added(two[f"a{k}"], two[f"a{k + 1}"]) for k in range(0, reach // 2, 2)}, done)
        if 6 in lengths:
            done |= {f"f6_{o}": _over(_added(four[f"b{o // 2}"], four[f"a{o // 2 + 2}"]), 3) for o in (0, 4)}
            marks += [(6, o, f"f6_{o}") for o in (0, 4)]
        df, eight = layer(df, {f"c{k}": _added(four[f"b{k}"], four[f"b{k + 2}"]) for k in range(0, large // 2, 4) if large > 6}, done)
        done = {c: F.col(c) for c in done}
        df, sixteen = layer(df, {f"d{k}": _added(eight[f"c{k}"], eight[f"c{k + 4}"]) for k in range(0, large // 2, 8) if large > 6}, done)
        if 16 in lengths:
            done["f16_0"] = _over(sixteen["d0"], 8)
        if 32 in lengths:
            done["f32_0"] = _over(_added(sixteen["d0"], sixteen["d8"]), 16)
        marks += [(n, 0, f"f{n}_0") for n in (16, 32) if n in lengths]
    df = df.select(*kept, *[x.alias(c) for c, x in done.items()])
    windows = [F.struct(F.lit(n).alias("class"), (F.col("s") + k).alias("start"), F.col(c).alias("fp"), (F.col("s") + k + n <= F.col("total")).alias("inside")) for n, k, c in marks]
    first = F.struct(F.lit(0).alias("class"), F.lit(0).alias("start"), F.coalesce("whole", F.lit(0)).alias("fp"), (F.col("whole").isNotNull() & (F.col("s") == 0)).alias("inside"))
    return df.select("doc_id", "t", F.explode(F.array(first, *windows)).alias("w")).where("w.inside").select("doc_id", "t", "w.class", "w.start", "w.fp")


def _block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, _EDGES[k]).bitwiseAND(F.lit((1 << _EDGES[k + 1] - _EDGES[k]) - 1))


def _key(of_class: Column, block: int, value: Column) -> Column:
    return F.shiftleft(of_class.cast("bigint") * BLOCKS + block, 64 // BLOCKS + 1).bitwiseOR(value)


def index(items: DataFrame, wanted: list[tuple[int, int, int]], radius: int) -> DataFrame:
    """key, item_fp, ik, offset: the parts of items(ik, n, shingles) that windows may equal and the whole items, each under
    all values of each block within radius // BLOCKS bits of its own."""
    parts = [F.array(F.struct(F.lit(0).alias("class"), F.lit(0).alias("offset"), F.col("shingles").alias("part")))]
    for k, (smallest, length, step) in enumerate(wanted):
        mine = F.col("n") >= smallest
        if k + 1 < len(wanted):
            mine = mine & (F.col("n") < wanted[k + 1][0])
        last = F.col("n") - length
        ends = [F.sequence(F.lit(0), F.least(F.lit(step - 1), last)), F.sequence(F.greatest(last - step + 1, F.lit(0)), last)]
        if length == LONGEST:
            every = F.sequence(F.lit(0), last, F.lit(LONGEST))
            ends.append(F.flatten(F.transform(every, lambda p: F.sequence(p, F.least(p + step - 1, last)))))  # noqa: B023
        offsets = F.array_distinct(F.concat(*ends))
        cut = F.transform(offsets, lambda p: F.struct(F.lit(length).alias("class"), p.alias("offset"), F.slice("shingles", p + 1, length).alias("part")))  # noqa: B023
        parts.append(F.when(mine, cut).otherwise(F.array().cast("array<struct<class: int, offset: int, part: array<bigint>>>")))
    cut = items.select("ik", "n", F.explode(F.concat(*parts)).alias("c")).select("ik", "n", "c.class", "c.offset", "c.part")
    most = items.agg(F.max("n")).first()[0] or 1
    marked = cut.select("ik", "class", "offset", simhash(F.col("part"), most).alias("item_fp"))
    listed = []
    for k in range(BLOCKS):
        width = _EDGES[k + 1] - _EDGES[k]
        flips = [sum(1 << b for b in c) for n in range(radius // BLOCKS + 1) for c in combinations(range(width), n)]
        listed.append(F.transform(F.array(*[F.lit(x).cast("bigint") for x in flips]), lambda x: _key(F.col("class"), k, _block(F.col("item_fp"), k).bitwiseXOR(x))))  # noqa: B023
    return marked.select(F.explode(F.concat(*listed)).alias("key"), "item_fp", "ik", "offset")


def candidates(texts: DataFrame, items: DataFrame, least: float, radius: int) -> DataFrame:
    """doc_id, t, ik, low, high: between which places an item may begin in a text, by its windows' fingerprints."""
    longest = items.agg(F.max("n")).first()[0] or 0
    if not longest:
        return texts.select("doc_id", "t", F.lit(0).cast("bigint").alias("ik"), F.lit(0).alias("low"), F.lit(0).alias("high")).limit(0)
    wanted = classes(least)
    used = [r["n"] for r in items.select("n").distinct().collect()]  # numbers of shingles: few, whatever the benchmark's size
    lengths = {max((c for c in wanted if c[0] <= n), key=lambda c: c[1])[1] for n in used}
    listed = shared.written(index(items, wanted, radius), "index")
    windows = window_fingerprints(with_shingles(texts, "text").drop("text"), lengths, longest)
    blocks = F.array(*[_key(F.col("class"), k, _block(F.col("fp"), k)) for k in range(BLOCKS)])
    probes = windows.select("doc_id", "t", "start", "fp", F.explode(blocks).alias("key"))
    close = probes.join(shared.checked_broadcast(listed), "key").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    at = F.col("start") - F.col("offset")
    return close.groupBy("doc_id", "t", "ik").agg(F.min(at).alias("low"), F.max(at).alias("high"))


def _shared_weight(a: Column, b: Column) -> Column:
    """Sum over shingles of the smaller number of occurrences."""
    once = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    times = lambda x, of: F.size(F.filter(of, lambda y: y == x))
    counted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(times(x, a), times(x, b)))
    return F.when(once, F.size(F.array_intersect(a, b))).otherwise(counted)


def matches(
    docs: DataFrame, benchmark: DataFrame, least: float = MIN_SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """doc_id, item_id, similarity, start (in words) of the best window for each item that a document contains."""
    known = with_shingles(benchmark.select("item_id", "text").distinct(), "text")
    items = known.select("item_id", F.xxhash64("item_id", "text").alias("ik"), "shingles", F.col("total").alias("n")).where("total > 0")
    items = shared.written(items, "items")
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").withColumn("t", F.xxhash64("text"))

    found = candidates(texts, items.select("ik", "n", "shingles"), least, radius)
    found = found.groupBy("doc_id", "t").agg(F.collect_list(F.struct("ik", "low", "high")).alias("of"))  # an item each, once
    found = shared.checked_broadcast(shared.written(found, "candidates"), ["of"])
    found = found.select(F.col("doc_id").alias("d"), F.col("t").alias("dt"), "of")
    sides = shared.checked_broadcast(items.select("ik", "n", F.col("shingles").alias("item")), ["item"])
    near = (
        with_shingles(texts.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("dt"))).select("doc_id", "text", "of"), "text")
        .select("doc_id", "shingles", "total", F.explode("of").alias("o"))
        .select("doc_id", "shingles", "total", "o.*")
        .join(sides, "ik")
        .withColumn("from", F.greatest(F.col("low") - F.col("n"), F.lit(0)))
        .withColumn("around", F.slice("shingles", F.col("from") + 1, F.col("high") - F.col("from") + 2 * F.col("n")))
    )
    # windows that begin at a shared shingle: moving one up to its first shared shingle loses none
    places = F.filter(
        F.transform("around", lambda h, i: F.when(F.array_contains("item", h), i + F.col("from"))), lambda x: x.isNotNull()
    )
    need = F.ceil(F.lit(least) * F.col("n") - 1e-9).cast("int")
    enough = F.transform("at", lambda s, i: F.when(F.get(F.col("at"), i + F.col("need") - 1) - s < F.col("n"), s))
    starts = F.transform(
        F.filter(enough, lambda s: s.isNotNull()), lambda s: F.least(s, F.greatest(F.col("total") - F.col("n"), F.lit(0)))
    )
    windows = (
        near.withColumn("at", places)
        .withColumn("need", need)
        .select("doc_id", "ik", "n", "shingles", F.explode(F.array_distinct(starts)).alias("start"))
        .select("doc_id", "ik", "start", F.slice("shingles", F.col("start") + 1, F.col("n")).alias("window"))
        .withColumn("w1", F.xxhash64("window"))
        .withColumn("w2", F.xxhash64(F.lit(1), "window"))
    )
    windows = shared.written(windows, "windows")
    shares = (
        windows.groupBy("ik", "w1", "w2")
        .agg(F.first("window").alias("window"))
        .join(sides, "ik")
        .withColumn("both", _shared_weight(F.col("window"), F.col("item")))
        .withColumn("similarity", F.col("both") / (F.size("window") + F.size("item") - F.col("both")))
        .where(F.col("similarity") >= least)
        .select("ik", "w1", "w2", "similarity")
    )
    shares = shared.written(shares, "shares")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("minus"))).alias("best")
    return (
        shared.join_small(windows.select("doc_id", "ik", "start", "w1", "w2"), shares, ["ik", "w1", "w2"], "inner")
        .join(shared.checked_broadcast(items.select("ik", "item_id")), "ik")
        .groupBy("doc_id", "item_id")
        .agg(best)
        .select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.minus")).alias("start"))
    )


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no benchmark item; a null doc_id stays."""
    leaks = shared.written(matches(docs, benchmark).select("doc_id").where("doc_id IS NOT NULL").distinct(), "leaks")
    return docs.join(shared.checked_broadcast(leaks), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
