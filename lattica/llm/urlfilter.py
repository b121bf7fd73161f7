"""URL filters with a path-template tree, in DataFrame functions only.

Fixed rules judge first: the longest rule that fits a url's host (or a domain above it) and the start of its path. Urls
without a rule are judged by the templates of their host. Paths are first put into shapes (runs of digits become `#`) and
counted per host and shape, so all that follows works on counts and a host with a third of all pages is one with few
shapes. The tree grows from the host down, to the end of every path. At each node

* a segment stays literal if it has no digits, at least MIN_PAGES pages, and either MIN_SHARE of the pages of its parent or
  a share of bad labels that differs significantly from its parent's; all others share the wildcard `*`;
* literal siblings with enough labels are merged into one branch where, in the order of their share of bad labels, none
  differs significantly from the one before it. A branch is named {first+others~sum}: its first segment, the number of the
  others, and a sum over the hashes of all, so branches of equal names on two hosts are branches of equal members. A
  segment that begins like a branch or a wildcard is escaped by a backslash.

A template is rejected if its smoothed share of bad labels is at least MIN_PURITY and there is evidence of it: labels of its
own host, or labels of the same template on at least MIN_SITES sites (the last two names of a host). It is smoothed in two
steps: the share of all labels is the prior, of the weight of one site, of the share over sites, each site counting once
however many pages it has; this is the prior, of weight PRIOR_WEIGHT, of each host's own template. So one foreign site
never decides about a host without labels.

Labels are given as a column of judge(); without one, the fixed rules label the pages that they fit.

Defined results: a null url, or one without ://, has an empty host and path, no rule and (having no labels of its own
kind) the verdict of the template of such urls; repeated rows and null ids are judged like any other; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm import shared

MIN_PAGES = 5
MIN_SHARE = 0.02
MIN_LABELS = 5
MAX_Z = 2.0
PRIOR_WEIGHT = 20.0
MIN_SITES = 3
MIN_PURITY = 0.9

#: Rule (host/path) -> verdict.
RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    pattern = r"^([^/?#]*)([^?#]*)"
    lower = F.translate(F.regexp_extract(rest, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(F.regexp_extract(rest, pattern, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    found = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        domain, start = rule.split("/", 1)[0], "/" + rule.split("/", 1)[1]
        fits = (host == domain) | F.endswith(host, F.lit("." + domain))
        found.append(F.when(fits & F.startswith(path, F.lit(start)), F.lit(rule)))
    return F.coalesce(*found, F.lit(None).cast("string"))


def _differs(labels: Column, bad: Column, all_labels: Column, all_bad: Column) -> Column:
    """Whether a share of bad labels differs significantly from that of a larger group. The smoothed standard error keeps a
    pure group from calling every other share significant; too few labels never differ."""
    labels, all_labels = F.nullif(labels, F.lit(0)), F.nullif(all_labels, F.lit(0))
    share = all_bad / all_labels
    error = F.sqrt((share * (1 - share) + 1 / (all_labels + 4)) / labels)
    return F.coalesce((labels >= MIN_LABELS) & (F.abs(bad / labels - share) > MAX_Z * error), F.lit(False))


def _steps(nodes: DataFrame) -> DataFrame:
    """host, template, segment, step of nodes(host, template, segment, pages, labels, bad): how each node is named."""
    above = nodes.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in ("pages", "labels", "bad")])
    stands_out = _differs(F.col("labels"), F.col("bad"), F.col("all_labels"), F.col("all_bad"))
    enough = (F.col("pages") >= MIN_SHARE * F.col("all_pages")) | stands_out
    literal = ~F.contains("segment", F.lit("#")) & (F.col("segment") != "") & (F.col("pages") >= MIN_PAGES) & enough
    named = nodes.join(above, ["host", "template"]).withColumn("literal", literal)

    labelled = named.where(F.col("literal") & (F.col("labels") >= MIN_LABELS)).select("host", "template", "segment", "labels", "bad")
    in_order = Window.partitionBy("host", "template").orderBy(F.col("bad") / F.col("labels"), "segment")
    n, b = F.lag("labels").over(in_order), F.lag("bad").over(in_order)
    both = (F.col("bad") + b) / (F.col("labels") + n)
    error = F.sqrt((both * (1 - both) + 1 / (F.col("labels") + n + 4)) * (1 / F.col("labels") + 1 / n))
    begins = F.coalesce(F.abs(F.col("bad") / F.col("labels") - b / n) > MAX_Z * error, F.lit(True))
    groups = labelled.withColumn("begins", begins).withColumn("group", F.sum(F.col("begins").cast("int")).over(in_order))
    code = F.conv(F.substring(F.md5("segment"), 1, 8), 16, 10).cast("bigint")
    sizes = groups.groupBy("host", "template", "group").agg(F.min("segment").alias("first"), F.count("*").alias("size"), F.sum(code).alias("code")).where("size > 1")
    merged = groups.join(sizes, ["host", "template", "group"]).select("host", "template", "segment", "first", "size", "code")
    step = (
        F.when(F.col("segment") == "", "/")
        .when(F.col("size").isNotNull(), F.concat(F.lit("/{"), "first", F.lit("+"), F.col("size") - 1, F.lit("~"), "code", F.lit("}")))
        .when(F.col("literal"), F.concat(F.lit("/"), F.when(F.substring("segment", 1, 1).isin("{", "*", "\\"), "\\").otherwise(""), "segment"))
        .otherwise("/*")
    )
    return named.join(merged, ["host", "template", "segment"], "left").select("host", "template", "segment", step.alias("step"))


def templates(shapes: DataFrame) -> DataFrame:
    """host, shape, template, labels, bad of shapes(host, shape, pages, labels, bad): the tree, level by level. A level holds
    the paths that go on below nodes of at least MIN_PAGES pages; those below smaller nodes have wildcards only."""
    counts = ("pages", "labels", "bad")
    tree = shapes.withColumn("segments", F.split("shape", "/")).withColumn("template", F.lit(""))
    finished = []
    level = 0
    while True:
        level += 1  # the path begins with a slash, so segment 0 is empty
        goes_on = F.size("segments") > level
        finished.append(tree.where(~goes_on).select("host", "shape", "template", "labels", "bad"))
        tree = tree.where(goes_on).withColumn("segment", F.get("segments", F.lit(level)))
        nodes = tree.groupBy("host", "template", "segment").agg(*[F.sum(c).alias(c) for c in counts])
        nodes = shared.written(nodes, "nodes")
        large = nodes.groupBy("host", "template").agg(F.sum("pages").alias("all")).where(F.col("all") >= MIN_PAGES)
        named = _steps(nodes.join(large.select("host", "template"), ["host", "template"], "left_semi"))
        named = shared.written(named, "steps")
        placed = shared.join_small(tree, named, ["host", "template", "segment"], "left")
        rest = F.transform(F.slice("segments", level + 1, F.size("segments")), lambda x: F.when(x == "", "/").otherwise("/*"))
        wild = placed.where("step IS NULL").select("host", "shape", F.concat("template", F.array_join(rest, "")).alias("template"), "labels", "bad")
        finished.append(shared.written(wild, "templates"))
        if not named.take(1):
            break
        further = placed.where("step IS NOT NULL").select("host", "shape", *counts, "segments", F.concat("template", "step").alias("template"))
        tree = shared.written(further, "tree")
    out = finished[0]
    for part in finished[1:]:
        out = out.union(part)
    return out


def rated(placed: DataFrame) -> DataFrame:
    """host, template, purity, evident of placed(host, template, labels, bad); evident: enough is known to reject it."""
    single = shared.written(placed.groupBy("host", "template").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad")), "rated")
    overall = single.agg(F.sum("labels").alias("n"), F.sum("bad").alias("b")).first()
    prior = overall["b"] / overall["n"] if overall["n"] else 0.0
    site = F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0)
    sites = single.where("labels > 0").groupBy("template", site.alias("site")).agg((F.sum("bad") / F.sum("labels")).alias("share"))
    pool = sites.groupBy("template").agg(F.count("*").alias("sites"), F.sum("share").alias("sum"))
    known = shared.join_back(single, shared.written(pool, "pool"), ["template"])
    n = F.coalesce("sites", F.lit(0))
    share = (F.coalesce("sum", F.lit(0.0)) + prior) / (n + 1)
    purity = (F.col("bad") + PRIOR_WEIGHT * share) / (F.col("labels") + PRIOR_WEIGHT)
    return known.select("host", "template", F.round(purity, 9).alias("purity"), ((F.col("labels") > 0) | (n >= MIN_SITES)).alias("evident"))


def judge(pages: DataFrame, rules: dict[str, str] = RULES, bad: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity. bad: a boolean column of pages, null where unlabelled; by
    default the verdict of the fitting rule."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), (F.lit(None).cast("boolean") if bad is None else bad).alias("given"))
    ruled = parsed.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    blocked = [r for r, v in rules.items() if v == "block"]
    by_rule = F.when(F.col("rule").isNotNull(), F.col("rule").isin(blocked) if blocked else F.lit(False))
    ruled = ruled.withColumn("by_rule", by_rule).withColumn("bad", F.col("given") if bad is not None else F.col("by_rule"))
    ruled = ruled.withColumn("shape", F.regexp_replace("path", "[0-9]+", "#"))

    shapes = ruled.groupBy("host", "shape").agg(
        F.count("*").alias("pages"), F.count("bad").alias("labels"), F.sum(F.col("bad").cast("bigint")).alias("bad")
    )
    shapes = shared.written(shapes.select("host", "shape", "pages", "labels", F.coalesce("bad", F.lit(0)).alias("bad")), "shapes")
    placed = shared.written(templates(shapes), "placed")
    by_shape = placed.select("host", "shape", "template").join(rated(placed), ["host", "template"])
    by_shape = shared.written(by_shape, "by-shape")
    verdict = F.when(F.coalesce("by_rule", F.col("evident") & (F.col("purity") >= MIN_PURITY)), "block").otherwise("allow")
    return shared.join_small(ruled, by_shape, ["host", "shape"], "inner").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity"
    )
