"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a text is a blob, addressed by its SHA-256. The ledger holds, for each blob, the rule versions that it
has been scanned by and the spans that each of them found; only pairs of a blob and a rule version that it lacks are
scanned, each on one of the blob's paths, and the findings are joined back to all paths. What rule versions found that are
no longer in use is dropped with them, so an updated ledger equals that of a fresh scan. Spans come from the lengths of
what lies between a rule's matches, added up, so no row ever leaves the JVM.

Defined results: a null text is the empty text; repeated rows each get the findings of their blob; a null doc_id is a
path like any other; blobs of the ledger that no row has any more stay in it; an empty table gives no rows. Spans are
ordered by start and then by kind: the base kinds as listed in BASE, then the others in the order of the rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm import shared


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length counts (0: the match) and the least length; raise the version to scan anew."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Runs of the last two kinds are maximal, so their least lengths can stand in the patterns.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + ADDED

SPANS = "array<struct<start: bigint, stop: bigint, rule: string>>"
LEDGER = f"blob string, scanned array<string>, spans {SPANS}"


def _parts(text: Column, rule: Rule) -> Column:
    """Lengths (gap before a match, match, counting group) of a rule's matches; null without a match."""
    pattern = F.lit(rule.pattern)
    lengths = lambda texts: F.transform(texts, lambda x: F.length(x).cast("bigint"))
    return F.when(
        F.rlike(text, pattern),
        F.arrays_zip(
            lengths(F.split(text, rule.pattern, -1)).alias("gap"),
            lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("match"),
            lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("counts"),
        ),
    )


def _spans(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, spans of texts(blob, text, todo), for the rules in todo and blobs where they find something."""
    each = F.array(
        *[
            F.struct(
                F.lit(r.key).alias("rule"),
                F.lit(r.least).alias("least"),
                F.when(F.array_contains("todo", r.key), _parts(F.col("text"), r)).alias("parts"),
            )
            for r in rules
        ]
    )
    found = (
        texts.select("blob", F.explode(F.filter(each, lambda x: x["parts"].isNotNull())).alias("r"))
        .select("blob", "r.rule", "r.least", F.posexplode("r.parts").alias("k", "p"))
        .select("blob", "rule", "least", "k", "p.gap", "p.match", "p.counts")
        .where("match IS NOT NULL")
        .dropDuplicates(["blob", "rule", "k"])
    )
    before = Window.partitionBy("blob", "rule").orderBy("k")
    placed = found.withColumn("stop", F.sum(F.col("gap") + F.col("match")).over(before)).where("counts >= least")
    span = F.struct((F.col("stop") - F.col("match")).alias("start"), "stop", "rule")
    return placed.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def versions(docs: DataFrame) -> DataFrame:
    """doc_id, blob of every row."""
    return docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))


def scan(docs: DataFrame, paths: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger (columns as LEDGER), brought up to date with the blobs of docs and these rules: superseded and removed
    rules go with what they found, and each blob of docs is scanned by the rules that it lacks."""
    keys = F.array(*[F.lit(r.key) for r in rules]).cast("array<string>")
    no_rules, no_spans = F.array().cast("array<string>"), F.array().cast(SPANS)
    path = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("path")
    first = paths.groupBy("blob").agg(F.min(path).alias("path"))
    if ledger is None:
        todo = first.withColumn("todo", keys)
    else:
        ledger = ledger.select(
            "blob",
            F.array_intersect("scanned", keys).alias("had"),
            F.filter(F.coalesce("spans", no_spans), lambda s: F.array_contains(keys, s["rule"])).alias("old"),
        )
        todo = first.join(ledger.select("blob", "had"), "blob", "left").select(
            "blob", "path", F.array_except(keys, F.coalesce("had", no_rules)).alias("todo")
        )
    todo = todo.where(F.size("todo") > 0)
    texts = docs.select(path, F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    found = _spans(texts.join(todo.hint("shuffle_hash"), ["blob", "path"]), rules)
    new = todo.select("blob", F.col("todo").alias("scanned")).join(found, "blob", "left")
    if ledger is None:
        return new.select("blob", "scanned", F.coalesce("spans", no_spans).alias("spans"))
    return ledger.join(new, "blob", "full").select(
        "blob",
        F.array_union(F.coalesce("had", no_rules), F.coalesce("scanned", no_rules)).alias("scanned"),
        F.sort_array(F.concat(F.coalesce("old", no_spans), F.coalesce("spans", no_spans))).alias("spans"),
    )


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every path: the ledger's findings joined back."""
    base = [r.kind for r in BASE]
    kinds = base + [r.kind for r in rules if r.kind not in base]
    listed = F.array(*[F.lit(k) for k in kinds])
    kind = lambda s: F.substring_index(s["rule"], "@", 1)
    placed = F.transform(
        "spans", lambda s: F.struct(s["start"].alias("start"), F.array_position(listed, kind(s)).alias("place"), s["stop"].alias("stop"), kind(s).alias("kind"))
    )
    some = ledger.where(F.size("spans") > 0).select("blob", F.sort_array(placed).alias("found"))
    joined = shared.join_back(paths, some, ["blob"])
    joined = joined.withColumn("found", F.coalesce("found", F.array().cast("array<struct<start: bigint, place: bigint, stop: bigint, kind: string>>")))
    text = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return joined.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(text(F.filter("found", lambda s: s["place"] <= len(base))), 256).alias("base_sha256"),
        text(F.col("found")).alias("spans"),
    )


def update(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """The findings of every row and the ledger to keep for the next time."""
    paths = shared.written(versions(docs), "paths")
    ledger = shared.written(scan(docs, paths, ledger, rules), "ledger")
    return findings(paths, ledger, rules), ledger


def digests(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    return update(docs, ledger, rules)[0]
