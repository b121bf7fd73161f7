"""Projection onto an atlas in which each type fits variables of its own, and two datasets that share only some variables.

The type (or the pair of types) of a query member is a join key: all types are projected in one plan, each over its own
mask. Masks shrink until no variable misfits its type, types change until they are stable, and what is still not similar is
fitted by two regions of the atlas, the second one found by what the first leaves over. Only what still changes is
computed again. A task holds one pair of blocks of members (see similarity.top) or one member's candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.dense import represent
from lattica.operators import convey, quality, similarity
from lattica.operators.grouping import highest_weight
from lattica.operators.projection import least_essential, projected_fractions
from lattica.sources.shared import checkpointed


@dataclass(frozen=True)
class Fit:
    """Parameters of a projection; `quirk` takes the second anchor's residuals and folds as they have always been taken: the
    atlas less the query's residual (else less the projection), against the first anchor (else against the second)."""

    log: bool = True
    regularization: float = 1e-5
    least_umis: float = 40
    consistency: float = 2.0
    candidates: int = 50
    least_share: float = 1 / 3
    least_weight: float = 1e-5
    most_fold: float = 3.0
    noisy_fold: float = 2.0
    misfit_share: float = 0.5
    most_misfits: int = 3
    essential_share: float = 0.75
    markers_share: float = 1 / 3
    rounds: int = 3
    quirk: bool = True


# variables of two datasets ---------------------------------------------------------------------------------------


def align_variables(atlas_var: DataFrame, query_var: DataFrame, name: str = "var_id") -> DataFrame:
    """name, atlas_id, query_id, in_atlas, in_query, common: one row for each name that either side has."""
    mine = query_var.select(F.col(name).alias("name"), F.col("var_id").alias("query_id"), F.lit(True).alias("in_query"))
    theirs = atlas_var.select(F.col(name).alias("name"), F.col("var_id").alias("atlas_id"), F.lit(True).alias("in_atlas"))
    has = {c: F.coalesce(c, F.lit(False)) for c in ("in_atlas", "in_query")}
    return theirs.join(mine, "name", "full").select(
        "name", "atlas_id", "query_id", *[x.alias(c) for c, x in has.items()], (has["in_atlas"] & has["in_query"]).alias("common")
    )


def to_query_ids(layer: DataFrame, aligned: DataFrame) -> DataFrame:
    """A layer of the atlas over the query's ids of the common variables; the others are left out."""
    ids = aligned.where("common").select(F.col("atlas_id").alias("var_id"), "query_id")
    return layer.join(ids, "var_id").select("obs_id", F.col("query_id").alias("var_id"), "value")


def scattered(values: DataFrame, aligned: DataFrame, default=0.0) -> DataFrame:
    """values(var_id of the query, ...) over the union of both axes: name, in_atlas, in_query and the columns of values; a
    variable without a row has the default (a dict by column, or one for all)."""
    columns = [c for c in values.columns if c != "var_id"]
    joined = aligned.join(values.withColumnRenamed("var_id", "query_id"), "query_id", "left")
    filled = default if isinstance(default, dict) else {c: default for c in columns}
    return joined.select("name", "in_atlas", "in_query", *[F.coalesce(c, F.lit(filled[c])).alias(c) for c in columns])


def missing_essentials(essential: DataFrame, aligned: DataFrame) -> DataFrame:
    """type, name of a type's essential variables (type, name of the atlas) that are not common."""
    return essential.select("type", "name").exceptAll(essential.join(aligned.where("common"), "name", "left_semi").select("type", "name"))


def fitted_variables(atlas: DataFrame, query: DataFrame, var: DataFrame, least: float = 40, only: tuple[str, ...] = (), never: tuple[str, ...] = ()) -> DataFrame:
    """var_id of the common variables with enough in both datasets together; those in all masks `only` and in none of
    `never`, as far as var has such columns (null: not in the mask)."""
    totals = atlas.unionByName(query).groupBy("var_id").agg(F.sum("value").alias("t")).where(F.col("t") >= least)
    kept = var.join(totals, "var_id", "left_semi")
    for names, wanted in ((only, True), (never, False)):
        for c in names:
            if c in var.columns:
                kept = kept.where(F.coalesce(F.col(c).cast("boolean"), F.lit(False)) == wanted)
    return kept.select("var_id")


def masks_by_type(types: DataFrame, fitted: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """type, var_id: the fitted variables for each of types(type), less those of ignored(type, var_id)."""
    # a mask is a row for each type and variable, as many as the masks to be returned
    masks = types.select("type").distinct().crossJoin(fitted.select("var_id"))
    return masks if ignored is None else masks.join(ignored, ["type", "var_id"], "left_anti")


# weights over masks ----------------------------------------------------------------------------------------------


def _packed(rows: DataFrame, members: DataFrame, r: float) -> DataFrame:
    """key, id, x: logs above that of a zero."""
    logs = rows.where("f > 0").select("key", "id", "v", (F.log2(F.col("f") + r) - F.log2(F.lit(r))).alias("x"))
    return checkpointed(similarity.packed(logs, members, ["key", "id"], ["x"]))


def residual_score(p: Fit):
    """The correlation of each query member's residual with that of each atlas member: what is left of the query over its
    projection, and of the atlas over that (or over the projection)."""
    base = np.log2(p.regularization)

    def level(x: np.ndarray) -> np.ndarray:
        return np.log2(np.maximum(x, 0.0) + p.regularization) - base if p.log else np.maximum(x, 0.0)

    def score(mine: pd.DataFrame, theirs: pd.DataFrame, n: int) -> np.ndarray:
        columns = similarity.columns_of(mine["x"], mine["less"], theirs["x"])
        residual, less, atlas = (similarity.dense(c, columns) for c in (mine["x"], mine["less"], theirs["x"]))
        rows = [similarity.correlations(level(residual[i : i + 1]), level(atlas - less[i]), n) for i in range(len(residual))]
        return np.vstack(rows) if rows else np.zeros((0, len(atlas)))

    return score


def _near(fractions: np.ndarray, umis: np.ndarray, places: np.ndarray, anchor: int, p: Fit) -> set[int]:
    """Candidates (by place, up to p.candidates) without the least consistent ones; anchor: whose logs they are held to."""
    order = np.argsort(places, kind="stable")
    order = order[places[order] > 0]
    if not len(order):
        return set()
    first = int(order[0])
    level = np.log2(fractions + p.regularization)
    off = {first: 0.0}
    for i in order[1:].tolist():
        if len(off) >= p.candidates:
            break
        enough = umis[i] + umis[first] >= p.least_umis
        if enough.any():
            off[i] = float(np.abs(level[i] - level[anchor])[enough].max())
    kept = sorted(off, key=lambda i: (off[i], places[i]))
    while len(kept) > p.candidates * p.least_share and off[kept[-1]] > p.consistency:
        kept.pop()
    return {first, *kept}


def fit_member(goal: np.ndarray, fractions: np.ndarray, umis: np.ndarray, places: np.ndarray, seconds: np.ndarray | None, p: Fit) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the atlas rows, whether a row is of the second anchor's only). places, seconds: each row's place by
    correlation with the member and with its residual, 0 for none."""
    chosen = _near(fractions, umis, places, int(np.flatnonzero(places == 1)[0]), p)
    later: set[int] = set()
    if seconds is not None and (seconds > 0).any():
        anchor = int(np.flatnonzero((places if p.quirk else seconds) == 1)[0])
        later = _near(fractions, umis, seconds, anchor, p) - chosen
    rows = sorted(chosen | later)
    data = np.log2(fractions + p.regularization) if p.log else fractions
    aim = np.log2(goal + p.regularization) if p.log else goal
    _, w = represent(aim, data[rows])
    w[w < p.least_weight] = 0.0
    out = np.zeros(len(fractions))
    out[rows] = w / w.sum()
    return out, np.array([i in later for i in range(len(fractions))])


@dataclass(frozen=True)
class Masked:
    """Fractions f and totals u of the atlas and of a query over masks, with a number v for each variable: atlas and query
    (key, id, v, ...), their members (key, id), mask (key, var_id, v), sizes (key, n)."""

    atlas: DataFrame
    query: DataFrame
    atlas_members: DataFrame
    query_members: DataFrame
    mask: DataFrame
    sizes: DataFrame

    @classmethod
    def of(cls, atlas: DataFrame, atlas_umis: DataFrame, atlas_obs: DataFrame, query: DataFrame, of: DataFrame, masks: DataFrame) -> Masked:
        codes = checkpointed(similarity.numbered(masks, "var_id"))
        mask = checkpointed(masks.join(of.select("key").distinct(), "key", "left_semi").join(codes, "var_id"))
        both = atlas.withColumnRenamed("value", "f").join(atlas_umis.withColumnRenamed("value", "u"), ["obs_id", "var_id"], "full").fillna(0.0, ["f", "u"])
        a = checkpointed(both.join(mask, "var_id").select("key", F.col("obs_id").alias("id"), "v", "f", "u"))
        q = checkpointed(query.join(of, "obs_id").join(mask, ["key", "var_id"]).select("key", F.col("obs_id").alias("id"), "v", F.col("value").alias("f")))
        sizes = checkpointed(mask.groupBy("key").agg(F.count("*").alias("n")))  # a row a key
        theirs = sizes.select("key").crossJoin(atlas_obs.select(F.col("obs_id").alias("id")))  # each key is compared with all of the atlas
        return cls(a, q, theirs, of.select("key", F.col("obs_id").alias("id")), mask, sizes)

    def nearest(self, k: int, r: float) -> DataFrame:
        """key, src (query), dst (atlas), weight, place: the k most correlated logs of fractions over the member's mask."""
        return similarity.top(_packed(self.query, self.query_members, r), _packed(self.atlas, self.atlas_members, r), self.sizes, k, apart=False)


def weights(atlas: DataFrame, atlas_umis: DataFrame, atlas_obs: DataFrame, query: DataFrame, of: DataFrame, masks: DataFrame, p: Fit, projected: DataFrame | None = None) -> DataFrame:
    """src (query), dst (atlas), weight, second. of(obs_id, key) names the mask(key, var_id) that a query member is fitted
    over; atlas and query hold fractions, atlas_umis totals. With projected fractions given, a second anchor is added."""
    both = Masked.of(atlas, atlas_umis, atlas_obs, query, of, masks)
    a, q, mine, theirs, mask, sizes = both.atlas, both.query, both.query_members, both.atlas_members, both.mask, both.sizes
    wide = 2 * p.candidates  # a candidate without a significant variable gives its place to the next
    near = both.nearest(wide, p.regularization).select("key", "src", "dst", "place", F.lit(0).alias("later"))
    if projected is not None:
        kept = projected.join(of, "obs_id").join(mask, ["key", "var_id"]).select("key", F.col("obs_id").alias("id"), "v", F.col("value").alias("p"))
        left = q.join(kept, ["key", "id", "v"], "full").fillna(0.0, ["f", "p"]).withColumn("x", F.greatest(F.col("f") - F.col("p"), F.lit(0.0)))
        rows = checkpointed(similarity.packed(left.withColumn("less", F.col("x") if p.quirk else F.col("p")), mine, ["key", "id"], ["x", "less"]))
        plain = checkpointed(similarity.packed(a.withColumn("x", F.col("f")), theirs, ["key", "id"], ["x"]))
        second = similarity.top(rows, plain, sizes, wide, residual_score(p), apart=False)
        near = near.unionByName(second.select("key", "src", "dst", F.lit(0).alias("place"), F.col("place").alias("later")))
    near = near.groupBy("key", "src", "dst").agg(F.max("place").alias("place"), F.max("later").alias("later"))
    cells = similarity.packed(a.withColumnRenamed("id", "dst"), near.select("key", "dst").distinct(), ["key", "dst"], ["f", "u"])
    goals = similarity.packed(q.withColumnRenamed("id", "src"), of.select("key", F.col("obs_id").alias("src")), ["key", "src"], ["f"])
    joined = near.join(cells, ["key", "dst"]).join(goals.withColumnRenamed("f", "goal"), ["key", "src"])

    two = projected is not None

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("dst")
        # all variables of the mask: those that no row has are alike everywhere and change nothing
        columns = similarity.columns_of(part["f"], part["u"], part["goal"].iloc[:1])
        seconds = part["later"].to_numpy() if two else None
        w, second = fit_member(
            similarity.dense(part["goal"].iloc[:1], columns)[0], similarity.dense(part["f"], columns), similarity.dense(part["u"], columns),
            part["place"].to_numpy(), seconds, p,
        )
        return pd.DataFrame({"src": part["src"], "dst": part["dst"], "weight": w, "second": second})[w > 0]

    kinds = dict(of.dtypes)["obs_id"], dict(atlas_obs.dtypes)["obs_id"]
    return joined.groupBy("key", "src").applyInPandas(run, f"src {kinds[0]}, dst {kinds[1]}, weight double, second boolean")


# types -----------------------------------------------------------------------------------------------------------


def _most(var: DataFrame, p: Fit) -> DataFrame:
    noisy = F.coalesce(F.col("noisy_gene").cast("boolean"), F.lit(False)) if "noisy_gene" in var.columns else F.lit(False)
    return var.select("var_id", (F.lit(p.most_fold) + F.when(noisy, p.noisy_fold).otherwise(0.0)).alias("most"))


def misfits(folds: DataFrame, of: DataFrame, masks: DataFrame, var: DataFrame, p: Fit) -> DataFrame:
    """key, var_id: variables of a mask whose fold is too high in at least a share of the key's members."""
    n = of.groupBy("key").agg(F.count("*").alias("n"))
    high = folds.join(of, "obs_id").join(_most(var, p), "var_id").where(F.col("value") > F.col("most")).groupBy("key", "var_id").agg(F.count("*").alias("k"))
    return high.join(masks, ["key", "var_id"], "left_semi").join(n, "key").where(F.col("k") >= F.col("n") * p.misfit_share).select("key", "var_id")


def verdicts(folds: DataFrame, of: DataFrame, masks: DataFrame, var: DataFrame, p: Fit, essential: DataFrame | None = None, least: DataFrame | None = None) -> DataFrame:
    """obs_id, misfits, similar: few enough variables of the member's mask with a high fold, a mask with enough of var's
    marker_gene (if there is such a column), and enough variables of essential(key, var_id) that fit (least(key, least))."""
    high = folds.join(of, "obs_id").join(_most(var, p), "var_id").where(F.col("value") > F.col("most")).select("obs_id", "key", "var_id")
    bad = high.join(masks, ["key", "var_id"], "left_semi").groupBy("obs_id").agg(F.count("*").alias("misfits"))
    out = of.join(bad, "obs_id", "left").withColumn("misfits", F.coalesce("misfits", F.lit(0)))
    good = F.col("misfits") <= p.most_misfits
    if "marker_gene" in var.columns:
        markers = var.where(F.coalesce(F.col("marker_gene").cast("boolean"), F.lit(False))).select("var_id")
        enough = markers.count() * p.markers_share
        held = masks.join(markers, "var_id", "left_semi").groupBy("key").agg(F.count("*").alias("markers"))
        out = out.join(held, "key", "left")
        good = good & (F.coalesce("markers", F.lit(0)) >= enough)
    if essential is not None and least is not None:
        sizes = essential.groupBy("key").agg(F.count("*").alias("essentials"))
        lost = high.join(essential, ["key", "var_id"], "left_semi").groupBy("obs_id").agg(F.count("*").alias("lost"))
        out = out.join(least, "key", "left").join(sizes, "key", "left").join(lost, "obs_id", "left")
        fits = F.coalesce("essentials", F.lit(0)) - F.coalesce("lost", F.lit(0))
        good = good & (F.col("least").isNull() | (fits >= F.col("least")))
    return out.select("obs_id", "misfits", good.alias("similar"))


def by_type(atlas: DataFrame, atlas_umis: DataFrame, atlas_obs: DataFrame, query: DataFrame, query_umis: DataFrame, types: DataFrame, masks: DataFrame, var: DataFrame, p: Fit, type_name: str = "type") -> dict[str, DataFrame]:
    """weights, of(obs_id, key: the type that was fitted), types(obs_id, key: the type by the last weights) and masks(key,
    var_id). Each type's misfits leave its mask and it is projected again until none is left (the last variable stays);
    then members take the types that their weights give, and all is done again, at most p.rounds times, while a member gets
    a type that it has not had."""
    of = checkpointed(types)
    masks = checkpointed(masks)
    seen = of
    for turn in range(1, p.rounds + 1):
        active, parts = of, []
        while True:
            used = checkpointed(weights(atlas, atlas_umis, atlas_obs, query, active, masks, p))
            projected = projected_fractions(used, atlas, p.log, p.regularization)
            folds = checkpointed(quality.projected_folds(query, projected, query_umis, p.regularization, p.least_umis))
            bad = checkpointed(misfits(folds, active, masks, var, p))
            left = masks.join(bad, ["key", "var_id"], "left_anti").select("key").distinct()
            again = checkpointed(bad.select("key").distinct().join(left, "key", "left_semi"))
            still = checkpointed(active.join(again, "key", "left_semi"))
            parts.append(used.join(still.select(F.col("obs_id").alias("src")), "src", "left_anti"))
            if not again.take(1):
                break
            masks = checkpointed(masks.join(bad.join(again, "key", "left_semi"), ["key", "var_id"], "left_anti"))
            active = still
        used = parts[0]
        for part in parts[1:]:
            used = used.unionByName(part)
        used = checkpointed(used)
        now = checkpointed(convey.atlas_to_query(used, atlas_obs, type_name).select("obs_id", F.col(type_name).alias("key")))
        fitted = of
        if turn == p.rounds or not now.join(seen, ["obs_id", "key"], "left_anti").take(1):
            break
        seen = checkpointed(seen.union(now.select(*seen.columns)).distinct())
        missing = now.select("key").distinct().join(masks, "key", "left_anti")
        if missing.take(1):
            raise ValueError("a type of the atlas has no mask")
        of = now
    return {"weights": used, "of": fitted, "types": now if turn < p.rounds else fitted, "masks": masks}


def _pair(primary: str, secondary: str):
    """The mask key of two types, the smaller one first; of one type where the second is missing."""
    a, b = F.col(primary).cast("string"), F.col(secondary).cast("string")
    return F.when(b.isNull() | (a == b), F.to_json(F.array(a))).otherwise(F.to_json(F.array(F.least(a, b), F.greatest(a, b))))


def residuals(atlas: DataFrame, atlas_umis: DataFrame, atlas_obs: DataFrame, query: DataFrame, query_umis: DataFrame, odd: DataFrame, used: DataFrame, masks: DataFrame, var: DataFrame, p: Fit, type_name: str = "type", essential: DataFrame | None = None, least: DataFrame | None = None) -> dict[str, DataFrame]:
    """types(obs_id, type, secondary, similar) and weights of odd(obs_id, key: their type), fitted by two regions of the
    atlas over the masks of both their types, at most p.rounds times or until both types stay. used: their weights so far;
    essential(type, var_id) and least(type, other, least) as in verdicts()."""
    state = checkpointed(odd.select("obs_id", F.col("key").alias("type"), F.lit(None).cast(dict(odd.dtypes)["key"]).alias("secondary")))
    projected = checkpointed(projected_fractions(used.join(odd.select(F.col("obs_id").alias("src")), "src", "left_semi"), atlas, p.log, p.regularization))
    done, weighed, verdict = [], [], []
    for turn in range(1, p.rounds + 1):
        of = checkpointed(state.withColumn("key", _pair("type", "secondary")))
        named = of.select("key", "type").union(of.where("secondary IS NOT NULL").select("key", "secondary")).distinct()
        theirs = checkpointed(named.join(masks.withColumnRenamed("key", "type"), "type").select("key", "var_id").distinct())
        now = checkpointed(weights(atlas, atlas_umis, atlas_obs, query, of.select("obs_id", "key"), theirs, p, projected))
        projected = checkpointed(projected_fractions(now, atlas, p.log, p.regularization))
        by = lambda second: highest_weight(
            now.where(F.col("second") == second).join(atlas_obs.select(F.col("obs_id").alias("dst"), F.col(type_name).alias("t")), "dst").withColumnRenamed("src", "obs_id"),
            "obs_id", "weight", "t",
        )
        new = state.select("obs_id", "type", "secondary").join(by(False).withColumnRenamed("t", "a"), "obs_id", "left").join(by(True).withColumnRenamed("t", "b"), "obs_id", "left")
        new = new.select("obs_id", "type", "secondary", F.coalesce("a", "b").alias("new"), F.when(F.col("a").isNotNull(), F.col("b")).alias("other"))
        stays = (F.col("new") == F.col("type")) & F.col("other").eqNullSafe(F.col("secondary"))
        new = checkpointed(new.withColumn("stays", stays | F.lit(turn == p.rounds)))
        final = new.where("stays").select("obs_id", "type", "secondary")
        folds = quality.projected_folds(query, projected, query_umis, p.regularization, p.least_umis)
        fixed = of.join(final.select("obs_id"), "obs_id", "left_semi").select("obs_id", "key")
        needed = pairs = None
        if essential is not None and least is not None:
            needed = named.join(essential, "type").select("key", "var_id").distinct()
            names = of.select("key", F.least("type", F.coalesce("secondary", "type")).alias("type"), F.greatest("type", F.coalesce("secondary", "type")).alias("other"))
            pairs = names.distinct().join(least, ["type", "other"]).select("key", "least")
        verdict.append(checkpointed(verdicts(folds.join(fixed.select("obs_id"), "obs_id", "left_semi"), fixed, theirs, var, p, needed, pairs)))
        done.append(final)
        weighed.append(now.join(final.select(F.col("obs_id").alias("src")), "src", "left_semi"))
        state = checkpointed(new.where("NOT stays").select("obs_id", F.col("new").alias("type"), F.col("other").alias("secondary")))
        if not state.take(1):
            break
        projected = checkpointed(projected.join(state.select("obs_id"), "obs_id", "left_semi"))
    whole = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(whole(parts[1:]))
    return {"types": checkpointed(whole(done).join(whole(verdict), "obs_id")), "weights": checkpointed(whole(weighed))}


def project(atlas: DataFrame, atlas_umis: DataFrame, atlas_obs: DataFrame, query: DataFrame, query_umis: DataFrame, types: DataFrame, masks: DataFrame, var: DataFrame, p: Fit | None = None, type_name: str = "type", essential: DataFrame | None = None) -> dict[str, DataFrame]:
    """The projection by types and, for members that are not similar, by two regions. atlas and query hold (corrected)
    fractions of the common variables, the umis tables totals; types(obs_id, type) is the first guess, masks(type, var_id)
    what each type may fit, essential(type, var_id) what it needs.

    Returns types (obs_id, type, secondary, similar), weights (src, dst, weight), masks, projected_fraction, projected_fold."""
    p = p or Fit()
    renamed = lambda x: x.withColumnRenamed("type", "key")
    found = by_type(atlas, atlas_umis, atlas_obs, query, query_umis, renamed(types), renamed(masks), var, p, type_name)
    least = alone = None
    if essential is not None:
        least = checkpointed(least_essential(essential.withColumn("mask", F.lit(True)), p.essential_share))
        alone = least.where("type = other").select(F.col("type").alias("key"), "least")
    folds_of = lambda used: quality.projected_folds(query, projected_fractions(used, atlas, p.log, p.regularization), query_umis, p.regularization, p.least_umis)
    first = checkpointed(verdicts(folds_of(found["weights"]), found["of"], found["masks"], var, p, None if essential is None else renamed(essential), alone))
    odd = checkpointed(found["types"].join(first.where("NOT similar"), "obs_id", "left_semi"))
    none = F.lit(None).cast(dict(found["types"].dtypes)["key"])
    same = found["types"].withColumnRenamed("key", "type").withColumn("secondary", none).join(first, "obs_id")
    used = found["weights"].select("src", "dst", "weight")
    if odd.take(1):
        again = residuals(atlas, atlas_umis, atlas_obs, query, query_umis, odd, used, found["masks"], var, p, type_name, essential, least)
        better = checkpointed(again["types"].where("similar"))
        same = same.join(better.select("obs_id"), "obs_id", "left_anti").unionByName(better)
        ids = better.select(F.col("obs_id").alias("src"))
        used = used.join(ids, "src", "left_anti").unionByName(again["weights"].join(ids, "src", "left_semi").select("src", "dst", "weight"))
    used = checkpointed(used)
    return {
        "types": same.select("obs_id", "type", "secondary", "misfits", "similar"), "weights": used, "masks": found["masks"].withColumnRenamed("key", "type"),
        "projected_fraction": projected_fractions(used, atlas, p.log, p.regularization), "projected_fold": folds_of(used),
    }
