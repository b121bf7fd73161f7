"""A pile's nearest-neighbour weights: memory beside the similarity, and strips that change nothing; a task for each pile."""

import tracemalloc

import numpy as np
import pandas as pd
from pyspark import TaskContext

from lattica.functions import dense
from lattica.plans import pipelines


def test_knn_weights_hold_few_square_matrices(monkeypatch):
    rng = np.random.default_rng(4)
    x = np.vstack([np.round(rng.normal(size=(175, 9)), 1)] * 4)  # copies: ties
    similarity = np.abs(x @ x.T)
    whole = dense.knn_weights(similarity.copy(), 20)
    monkeypatch.setattr(dense, "STRIP", 32)
    tracemalloc.start()
    found = dense.knn_weights(similarity, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(found, whole)
    assert peak < 3 * similarity.nbytes


def test_piles_are_not_put_together_in_few_tasks(spark):
    piles = spark.range(80).selectExpr("id AS obs_id", "CAST(id % 20 AS int) AS pile")
    where = lambda part: pd.DataFrame({"n": [len(part)], "task": [TaskContext.get().partitionId()]})
    found = pipelines._by_pile(piles, piles).applyInPandas(where, "n bigint, task int").collect()
    assert len(found) == 20 and all(r.n == 4 for r in found)
    assert len({r.task for r in found}) > 8  # small partitions were one task


def pile(rng, n, kinds, noise=0.3):
    """Weights and totals of n nodes of some kinds."""
    x = rng.normal(size=(kinds, 12))[rng.integers(0, kinds, n)] + noise * rng.normal(size=(n, 12))
    x -= x.mean(axis=1, keepdims=True)
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    return dense.knn_weights(np.abs(x @ x.T), 12), rng.integers(50, 150, n).astype(float)


def test_candidates_seed_small_communities_anew(monkeypatch):
    """Seeds, annealing, splits, cuts, dissolving and new seeds: no node is left out, and rounds begin again while small
    communities are left and that helps."""
    weights, umis = pile(np.random.default_rng(10), 120, 17)
    calls, real = [], dense.choose_seeds
    monkeypatch.setattr(dense, "choose_seeds", lambda w, count, low, high, rng, of=None: calls.append(of) or real(w, count, low, high, rng, of))
    of = dense.candidates(weights, umis, 8, 0, 6, seed=1)
    assert of.min() == 0 and (np.bincount(of) > 0).all()
    assert any(c is not None and (c < 0).sum() > 2 for c in calls)  # before, the ten in small groups had none at last


def test_annealing_ends_where_no_move_raises_the_score():
    rng = np.random.default_rng(6)
    weights, umis = pile(rng, 60, 6)
    links, bounds = dense.Links.of(weights), dense.Bounds(200, 800, 1500, 3, 8, 15)
    of = dense.choose_seeds(weights, 7, 0.85, 0.95, rng)
    assert of.min() == 0 and of.max() == 6
    incoming = weights.sum(axis=0)
    end = dense.anneal(links, of, umis, 200, 1500, 3, 15, rng, target_umis=800, target_size=8)
    score = dense.links_score(links, incoming, end, umis, bounds)
    assert score >= dense.links_score(links, incoming, of, umis, bounds)
    free = dense.Bounds(0, 0, np.inf, 0, 0, np.inf)
    assert abs(dense.links_score(links, incoming, end, umis, free) - dense.partition_score(weights, end, umis, 0, 0)) < 1e-9
    linked = lambda of: np.array([(weights[i, of == of[i]].sum() > dense.EPSILON) * 1 + (weights[of == of[i], i].sum() > dense.EPSILON) for i in range(60)])
    own = linked(end)
    for node in range(60):
        for p in range(7):
            moved = end.copy()
            moved[node] = p
            if (end == end[node]).sum() > 1 and linked(moved).sum() >= own.sum() and (linked(moved) == 0).sum() <= (own == 0).sum():
                assert dense.links_score(links, incoming, moved, umis, bounds) < score + 1e-6


def test_weak_cuts_and_large_communities():
    rng = np.random.default_rng(7)
    block = np.kron(np.eye(2), np.ones((9, 9)))
    np.fill_diagonal(block, 0)
    block[0, 9] = block[9, 0] = 0.01
    links, bounds, umis = dense.Links.of(block), dense.Bounds(0, 0, np.inf, 3, 18, 40), np.ones(18)
    of, hot, most = dense.split_communities(links, np.zeros(18, dtype=int), umis, bounds, 0.1, 7, set(), rng)
    assert len(set(of[:9])) == len(set(of[9:])) == 1 and of[0] != of[9] and most == 2 and sorted(hot) == [0, 1]
    of, hot, most = dense.split_communities(links, np.zeros(18, dtype=int), umis, bounds, 0.1, 10, set(), rng)
    assert sorted(np.bincount(of + 1)) == [9, 9] and most == 2  # the smaller side has no community
    of, hot, most = dense.split_communities(links, np.zeros(18, dtype=int), umis, dense.Bounds(0, 0, np.inf, 3, 6, 11), 0.1, 7, set(), rng)
    assert most == 3 and (of >= 0).sum() == 3 and sorted(hot) == [0, 1, 2]
    atoms = set()
    assert len(dense.split_communities(links, np.repeat([0, 1], 9), umis, bounds, 0.1, 7, atoms, rng)[1]) == 0 and len(atoms) == 2


def test_neighbours_grow_until_each_node_has_two():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 3))
    similarity = -((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    assert (dense.knn_weights(similarity.copy(), 1, least_degree=1) > 0).sum(axis=1).min() == 1
    assert (dense.knn_weights(similarity.copy(), 1) > 0).sum(axis=1).min() >= 2
