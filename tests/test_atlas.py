"""Projection by types, second anchors, alignment of two datasets: against dense numpy versions."""

from __future__ import annotations

import math

import numpy as np
import pytest

from lattica.functions.dense import represent
from lattica.operators import atlas, graph, similarity

P = atlas.Fit(candidates=6, least_umis=4.0, most_misfits=1)


def frame(spark, dense, names="obs_id bigint, var_id bigint, value double"):
    rows = [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense), strict=True)]
    return spark.createDataFrame(rows, names)


def corr(a, b):
    a, b = a - a.mean(), b - b.mean()
    spread = math.sqrt((a @ a) * (b @ b))
    return round(float(a @ b) / spread, similarity.PLACES) if spread > 1e-9 else 0.0


def order(values):
    return sorted(range(len(values)), key=lambda i: (-values[i], i))


def kept(level, umis, ordered, anchor, p):
    first, off = ordered[0], {ordered[0]: 0.0}
    for i in ordered[1:]:
        if len(off) < p.candidates and (enough := umis[i] + umis[first] >= p.least_umis).any():
            off[i] = np.abs(level[i] - level[anchor])[enough].max()
    names = sorted(off, key=lambda i: (off[i], ordered.index(i)))
    while len(names) > p.candidates * p.least_share and off[names[-1]] > p.consistency:
        names.pop()
    return {first, *names}


def plain_weights(af, au, q, mask, p, projected=None):
    """(weights, atlas rows of the second anchor only) of one query member over a mask."""
    log = lambda x: np.log2(x + p.regularization)
    level, goal, umis = log(af[:, mask]), log(q[mask]), au[:, mask]
    first = order([corr(goal, x) for x in level])
    chosen, later = kept(level, umis, first, first[0], p), set()
    if projected is not None:
        residual = np.maximum(q[mask] - projected[mask], 0)
        second = order([corr(log(residual), log(np.maximum(x - (residual if p.quirk else projected[mask]), 0))) for x in af[:, mask]])
        later = kept(level, umis, second, first[0] if p.quirk else second[0], p) - chosen
    rows = sorted(chosen | later)
    w = represent(goal, level[rows])[1]
    w[w < p.least_weight] = 0
    out = np.zeros(len(af))
    out[rows] = w / w.sum()
    return out, later


def plain_projected(w, af, p):
    x = 2 ** (w @ np.log2(af + p.regularization)) - p.regularization
    x[x < 1e-15] = 0
    return x / x.sum()


def plain_type(w, names):
    totals = {}
    for x, t in zip(w, names, strict=True):
        if x > 0:
            totals[t] = totals.get(t, 0) + x
    return min(totals, key=lambda t: (-totals[t], t)) if totals else None


def plain_folds(q, projected, umis, p):
    return np.where(umis >= p.least_umis, np.log2(q + p.regularization) - np.log2(projected + p.regularization), 0.0)


def plain_project(af, au, names, qf, qu, types, masks, p):
    masks, types, n = {t: m.copy() for t, m in masks.items()}, list(types), len(qf)
    seen = [set() for _ in range(n)]
    w, folds = np.zeros((n, len(af))), np.zeros(qf.shape)
    for turn in range(1, p.rounds + 1):
        for t in sorted(set(types)):
            mine = [i for i in range(n) if types[i] == t]
            while True:
                for i in mine:
                    w[i] = plain_weights(af, au, qf[i], masks[t], p)[0]
                    folds[i] = plain_folds(qf[i], plain_projected(w[i], af, p), qu[i], p)
                bad = masks[t] & ((folds[mine] > p.most_fold).sum(axis=0) >= len(mine) * p.misfit_share) & (folds[mine] > p.most_fold).any(axis=0)
                if not bad.any() or not (masks[t] & ~bad).any():
                    break
                masks[t] &= ~bad
        fitted = list(types)
        if turn == p.rounds:
            break
        new = [plain_type(x, names) for x in w]
        changed = False
        for i in range(n):
            seen[i].add(types[i])
            changed |= new[i] not in seen[i]
        types = new
        if not changed:
            break
    similar = [(folds[i] > p.most_fold)[masks[fitted[i]]].sum() <= p.most_misfits for i in range(n)]
    out = [(types[i], None, bool(similar[i])) for i in range(n)]
    for i in range(n):
        if similar[i]:
            continue
        one, two, projected = types[i], None, plain_projected(w[i], af, p)
        for turn in range(1, p.rounds + 1):
            mask = masks[one] | (masks[two] if two is not None else False)
            now, later = plain_weights(af, au, qf[i], mask, p, projected)
            projected = plain_projected(now, af, p)
            split = np.array([k in later for k in range(len(af))])
            a, b = plain_type(now * ~split, names), plain_type(now * split, names)
            a, b = (b, None) if a is None else (a, b)
            if turn == p.rounds or (a, b) == (one, two):
                break
            one, two = a, b
        if (plain_folds(qf[i], projected, qu[i], p) > p.most_fold)[mask].sum() <= p.most_misfits:
            out[i], w[i] = (one, two, True), now
    return out, w, masks


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    profiles = np.tile(rng.gamma(2.0, 0.5, 24) + 0.1, (3, 1))
    profiles[:, 9:] = 0.05
    for t in range(3):  # each type has variables of its own
        profiles[t, 9 + 5 * t : 14 + 5 * t] = 3.0
    names = [k % 3 for k in range(18)]
    au = np.array([rng.poisson(600 * profiles[t] / profiles[t].sum()) for t in names]).astype(float)
    made = [profiles[k % 3] for k in range(9)] + [profiles[0] + profiles[1], profiles[1] + profiles[2], profiles[0] * 0.2 + profiles[2]]
    made += [rng.gamma(0.3, 1.0, 24) for _ in range(3)]
    qu = np.array([rng.poisson(500 * x / x.sum()) for x in made]).astype(float)
    qu[[0, 3, 6], 5] += 400  # a variable that only the query's members of type 0 have
    af, qf = (x / x.sum(axis=1, keepdims=True) for x in (au, qu))
    types = [k % 3 for k in range(9)] + [0, 2, 1, 0, 1, 2]
    masks = {t: np.ones(24, dtype=bool) for t in range(3)}
    masks[1][[2, 3]] = False
    return af, au, names, qf, qu, types, masks


@pytest.mark.parametrize("quirk", [True, False])
def test_projection_by_type_equals_dense(spark, data, quirk):
    af, au, names, qf, qu, types, masks = data
    p = atlas.Fit(candidates=6, least_umis=4.0, most_misfits=1, quirk=quirk)
    want, w, fitted = plain_project(*data, p)
    obs = spark.createDataFrame([(i, t) for i, t in enumerate(names)], "obs_id bigint, type bigint")
    guess = spark.createDataFrame([(i, t) for i, t in enumerate(types)], "obs_id bigint, type bigint")
    mask = spark.createDataFrame([(t, int(v)) for t, m in masks.items() for v in np.flatnonzero(m)], "type bigint, var_id bigint")
    var = spark.createDataFrame([(v,) for v in range(24)], "var_id bigint")
    found = atlas.project(frame(spark, af), frame(spark, au), obs, frame(spark, qf), frame(spark, qu), guess, mask, var, p)
    got = {r.obs_id: (r.type, r.secondary, r.similar) for r in found["types"].collect()}
    assert [got[i] for i in range(len(qf))] == want
    assert {(r.type, r.var_id) for r in found["masks"].collect()} == {(t, int(v)) for t, m in fitted.items() for v in np.flatnonzero(m)}
    assert (0, 5) not in {(r.type, r.var_id) for r in found["masks"].collect()}  # it misfitted
    dense = np.zeros(w.shape)
    for r in found["weights"].collect():
        dense[r.src, r.dst] = r.weight
    assert np.allclose(dense, w, atol=1e-6)
    assert any(two is not None for _, two, _ in want)  # some member has a second region


def test_essentials_decide_who_is_similar(spark):
    p = atlas.Fit()
    rows = [(0, v, 9.0) for v in range(3)] + [(1, 0, 9.0)]
    folds = spark.createDataFrame(rows, "obs_id bigint, var_id bigint, value double")
    of = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "obs_id bigint, key string")
    masks = spark.createDataFrame([(k, v) for k in "ab" for v in range(3)], "key string, var_id bigint")
    var = spark.createDataFrame([(v, v == 0) for v in range(4)], "var_id bigint, marker_gene boolean")
    essential = spark.createDataFrame([("a", 0), ("a", 1)], "key string, var_id bigint")
    least = spark.createDataFrame([("a", 2)], "key string, least bigint")
    plain = {r.obs_id: (r.misfits, r.similar) for r in atlas.verdicts(folds, of, masks, var, p).collect()}
    assert plain == {0: (3, True), 1: (1, True), 2: (0, True)}
    found = {r.obs_id: r.similar for r in atlas.verdicts(folds, of, masks, var, p, essential, least).collect()}
    assert found == {0: False, 1: False, 2: True}
    few = masks.where("var_id > 0")
    assert not any(r.similar for r in atlas.verdicts(folds, of, few, var, p).collect())  # no marker is fitted


def test_alignment_of_two_datasets(spark):
    theirs = spark.createDataFrame([(10, "x"), (11, "y"), (12, "z")], "var_id bigint, gene string")
    mine = spark.createDataFrame([(0, "y"), (1, "w"), (2, "x")], "var_id bigint, gene string")
    aligned = atlas.align_variables(theirs, mine, "gene").cache()
    rows = {r.name: (r.atlas_id, r.query_id, r.in_atlas, r.in_query, r.common) for r in aligned.collect()}
    assert rows == {"x": (10, 2, True, True, True), "y": (11, 0, True, True, True), "z": (12, None, True, False, False), "w": (None, 1, False, True, False)}
    layer = spark.createDataFrame([(5, 10, 1.0), (5, 12, 2.0)], "obs_id bigint, var_id bigint, value double")
    assert [tuple(r) for r in atlas.to_query_ids(layer, aligned).collect()] == [(5, 2, 1.0)]
    essential = spark.createDataFrame([("a", "x"), ("a", "z"), ("b", "y")], "type string, name string")
    assert [tuple(r) for r in atlas.missing_essentials(essential, aligned).collect()] == [("a", "z")]
    back = atlas.scattered(spark.createDataFrame([(2, 1.5)], "var_id bigint, factor double"), aligned, 1.0)
    assert {r.name: r.factor for r in back.collect()} == {"x": 1.5, "y": 1.0, "z": 1.0, "w": 1.0}


def test_blocked_similarity_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    dense = rng.poisson(0.5, (90, 12)).astype(float)
    dense[7] = dense[8]
    dense[9] = 0
    layer = frame(spark, dense)
    obs = spark.createDataFrame([(i,) for i in range(90)], "obs_id bigint")
    var = spark.createDataFrame([(i,) for i in range(12)], "var_id bigint")
    monkeypatch.setattr(similarity, "CELLS", 1)  # blocks of 32
    edges = similarity.similarity(layer, obs, "obs_id", var, "abs_pearson").cache()
    want = {}
    for r in edges.collect():
        want.setdefault(r.src, []).append(-r.weight)
    got = {}
    for r in similarity.top_pearson(layer, obs, "obs_id", var, 5, absolute=True).collect():
        got.setdefault(r.src, []).append(-r.weight)
    assert all(np.allclose(sorted(x)[:5], sorted(got[s])) for s, x in want.items())
    ranks = graph.outgoing_ranks(edges.selectExpr("src", "dst", "round(weight, 12) AS weight")).cache()
    plain = lambda df: sorted((r.src, r.dst, round(r.weight, 9)) for r in df.collect())
    for k in (1, 4):  # with one neighbour, some members have no near pair at all
        near = graph.nearest_ranks(layer, obs, "obs_id", var, k)
        for whole, found in zip(graph.balance(ranks, k), graph.balance(near, k), strict=True):
            assert plain(found) == plain(whole)


def test_graph_grows_until_all_have_neighbours(spark):
    rng = np.random.default_rng(3)
    layer = frame(spark, rng.poisson(0.7, (20, 10)).astype(float))
    obs, var = spark.range(20).withColumnRenamed("id", "obs_id"), spark.range(10).withColumnRenamed("id", "var_id")
    edges = graph.nearest_graph(layer, obs, "obs_id", var, 3)
    assert edges.groupBy("src").count().where("count < 2").count() == 0
    assert edges.groupBy("src").agg({"weight": "sum"}).where("abs(`sum(weight)` - 1) > 1e-9").count() == 0
