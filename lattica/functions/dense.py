"""Sequential algorithms on one pile, group or row, in numpy; they run inside grouped functions, one task each."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

EPSILON = 1e-6
#: Rows (or columns) of a pile's square matrices that are worked on at a time.
STRIP = 256


# partitions of a graph -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Links:
    """The edges of a pile by node: node i is linked, one way or the other, to ends[at[i] : at[i + 1]], with the weights of the
    edges to them and from them."""

    at: np.ndarray
    ends: np.ndarray
    to: np.ndarray
    back: np.ndarray

    @classmethod
    def of(cls, weights: np.ndarray) -> Links:
        n, found = len(weights), []
        for rows in (slice(at, min(at + STRIP, n)) for at in range(0, n, STRIP)):
            i, j = np.nonzero((weights[rows] > 0) | (weights[:, rows].T > 0))
            found.append((i + rows.start, j.astype(np.int32), weights[rows][i, j], weights[:, rows][j, i]))
        i, ends, to, back = (np.concatenate(x) for x in zip(*found, strict=True))
        return cls(np.searchsorted(i, np.arange(n + 1)), ends, to, back)

    def __len__(self) -> int:
        return len(self.at) - 1

    def near(self, node: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = slice(self.at[node], self.at[node + 1])
        return self.ends[part], self.to[part], self.back[part]

    def within(self, members: np.ndarray) -> np.ndarray:
        """The dense weights between some nodes."""
        place = np.full(len(self), -1)
        place[members] = np.arange(len(members))
        out = np.zeros((len(members), len(members)))
        for k, node in enumerate(members):
            ends, to, _ = self.near(node)
            inside = place[ends] >= 0
            out[k, place[ends[inside]]] = to[inside]
        return out

    def sums(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node the weights of its edges within its own community, out and in."""
        node = np.repeat(np.arange(len(self)), np.diff(self.at))
        same = (of[node] == of[self.ends]) & (of[node] >= 0)
        return tuple(np.bincount(node[same], w[same], minlength=len(self)) for w in (self.to, self.back))


def choose_seeds(weights: np.ndarray | Links, count: int, low: float, high: float, rng: np.random.Generator, of: np.ndarray | None = None) -> np.ndarray:
    """A community for each node; those that `of` gives one keep it, and new ones are made up to `count`. Seeds are drawn from the
    nodes whose number of edges from nodes without a community lies in a band of quantiles, and take the strongest of
    these, as many as a new community has on average. Where none has such an edge any more, nodes with the fewest edges are
    seeds of their own. Each of the rest joins a community by the weights of its edges over the community's size."""
    links = weights if isinstance(weights, Links) else Links.of(weights)
    n = len(links)
    of = np.full(n, -1) if of is None else of.copy()
    seed = int(of.max()) + 1
    node_of = np.repeat(np.arange(n), np.diff(links.at))
    if seed < count:
        free = of < 0
        size = max(1, int(free.sum()) // (count - seed))
        degree = np.bincount(node_of[(links.back > 0) & free[links.ends]], minlength=n)
        candidates = np.flatnonzero(free)
        while seed < count and len(candidates := candidates[(of[candidates] < 0) & (degree[candidates] > 0)]):
            order = candidates[np.argsort(degree[candidates], kind="stable")]
            band = order[int(np.floor((len(order) - 1) * low)) : int(np.ceil((len(order) - 1) * high)) + 1]
            node = int(rng.choice(band))
            ends, _, back = links.near(node)
            pull = np.flatnonzero((back > 0) & (of[ends] < 0))
            taken = np.append(ends[pull[np.argsort(-back[pull], kind="stable")[:size]]], node)
            of[taken] = seed
            for x in taken:
                ends, to, _ = links.near(x)
                degree[ends[to > 0]] -= 1
            seed += 1
        if seed < count:
            free = np.flatnonzero(of < 0)
            edges = [np.bincount(node_of[w > 0], minlength=n)[free] + 1 for w in (links.to, links.back)]
            alone = free[np.argsort(edges[0] * edges[1], kind="stable")[: count - seed]]
            of[alone] = np.arange(seed, seed + len(alone))
            seed += len(alone)
    sizes = np.bincount(of[of >= 0], minlength=seed)
    todo = np.flatnonzero(of < 0)
    while len(todo):
        later = []
        for node in todo:
            ends, to, back = links.near(node)
            there = of[ends] >= 0
            share = np.bincount(of[ends[there]], (to + back)[there], minlength=seed) / np.maximum(sizes, 1)
            if share.sum() > 0:
                of[node] = np.searchsorted(np.cumsum(share), rng.random() * share.sum(), side="right").clip(0, seed - 1)
                sizes[of[node]] += 1
            else:
                later.append(node)
        if len(later) == len(todo):  # no edge leads to any community
            of[later] = rng.integers(seed, size=len(later))
            break
        todo = np.array(later, dtype=int)
    return of


def mass(x: float, low: float, high: float) -> float:
    """log2 of what a size lacks to its lower or exceeds of its upper bound, 0 between them; a bound of 0 is none."""
    return float(np.log2(x / low)) if low > x > 0 else float(np.log2(high / x)) if x > high > 0 else 0.0


def masses(x: np.ndarray, low: float, target: float, high: float) -> np.ndarray:
    """The log2 of a factor for each of many sizes: it falls by 2 % from the target to either bound, and fast beyond; without a
    target or bounds it is none."""
    x = np.asarray(x, dtype=float)
    if not (0 < low < target < high < np.inf):
        factor = np.where(x < low, np.log2(max(low, 1e-300) / (low + np.maximum(low - x, 0) + 1e-300)), 0.0)
        return np.where(x > high, np.log2(max(low, 1.0) / (max(low, 1.0) + np.maximum(x - high, 0))), factor)
    inner = np.where(x < target, (target - x) / (target - low), (x - target) / (high - target))
    outer = np.maximum(low - x, 0) + np.maximum(x - high, 0)
    return np.where((x < low) | (x >= high), np.log2(0.98 * low / (low + outer)), np.log2(1 - 0.02 * np.clip(inner, 0, 1)))


def partition_score(weights: np.ndarray, of: np.ndarray, umis: np.ndarray, low: float, high: float) -> float:
    """The stability score of a whole partition, computed from scratch."""
    n = len(of)
    same = (of[:, None] == of[None, :]) & (of[:, None] >= 0)
    inside = weights * same
    s = 0.5 * np.log2(EPSILON + inside.sum(axis=1) * inside.sum(axis=0))
    incoming = weights.sum(axis=0)
    total = n * np.log2(n) - np.log2(incoming[incoming > 0]).sum() + 0.5 * np.log2(EPSILON) * (of < 0).sum()
    for p in np.unique(of[of >= 0]):
        m = of == p
        total += s[m].sum() - m.sum() * np.log2(m.sum()) + m.sum() * mass(umis[m].sum(), low, high)
    return float(total / n)


@dataclass(frozen=True)
class Bounds:
    """Lower bound, target and upper bound of the totals and of the sizes of communities; a target total of 0 is no bound."""

    low_umis: float
    target_umis: float
    high_umis: float
    low_size: float
    target_size: float
    high_size: float

    @property
    def by_size(self) -> bool:
        return not (self.low_umis > 0 or np.isfinite(self.high_umis))

    def bulk(self, size: np.ndarray, umis: np.ndarray | None) -> np.ndarray:
        """The part of the scores of communities that depends on their sizes and totals only."""
        size = np.asarray(size, dtype=float)
        factor = masses(size, self.low_size, self.target_size, self.high_size)
        if not self.by_size:
            factor = np.minimum(factor, masses(umis, self.low_umis, self.target_umis, self.high_umis))
        return size * (factor - np.log2(np.maximum(size, 1)))


def anneal(weights: np.ndarray | Links, of: np.ndarray, umis: np.ndarray, low_umis: float, high_umis: float, low_size: float, high_size: float, rng: np.random.Generator, cooldown_pass: float = 0.02, cooldown_node: float = 0.25, target_umis: float = 0, target_size: float = 0, hot: np.ndarray | None = None, cold_temperature: float = 1.0) -> np.ndarray:
    """Moves nodes between communities until none can raise the score. A move's gain is that of the node's own edges times the
    temperature, and that of the whole score (exact for the two communities) times one less it; a node goes to a community
    where its gain is positive, drawn by the gains. No move may leave more nodes without an edge into their community. The
    temperature falls with each node; a node that did not move is left alone until it has fallen by a share, and those that
    are in none of the `hot` communities until it is as low as cold_temperature. At the end it is 0 for a last climb."""
    links = weights if isinstance(weights, Links) else Links.of(weights)
    of, n = of.copy(), len(of)
    parts = int(of.max()) + 1
    if parts < 2:
        return of
    bounds = Bounds(low_umis, target_umis, high_umis, low_size, target_size, high_size)
    size = np.bincount(of[of >= 0], minlength=parts)
    total = np.bincount(of[of >= 0], weights=umis[of >= 0], minlength=parts)
    bulk = bounds.bulk(size, total)
    of_size = bounds.bulk(np.arange(n + 1), None) if bounds.by_size else None
    # of each node, within its own community: the weights out and in, whether there are any (0 to 2), half the log2 of their product
    own_out, own_in = links.sums(of)
    joined = lambda o, i: (o > EPSILON) * np.int8(1) + (i > EPSILON)
    term = lambda o, i: 0.5 * np.log2(EPSILON + o * i)
    own_links, own_term = joined(own_out, own_in), term(own_out, own_in)
    whole_ends = bool((of >= 0).all())

    def improved(node: int, temperature: float) -> bool:
        here = of[node]
        if here < 0 or size[here] < 2:
            return False
        ends, to, back = links.near(node)
        p = of[ends]
        if not whole_ends:
            ends, to, back, p = (x[p >= 0] for x in (ends, to, back, p))
        out, into = np.bincount(p, to, minlength=parts), np.bincount(p, back, minlength=parts)
        row = joined(out, into)
        near = np.flatnonzero(row)
        near = near[near != here]
        if not len(near):
            return False
        # linked nodes change their own terms: those here lose the node, those there gain it
        turn = 1.0 - 2.0 * (p == here)
        o, i = np.maximum(own_out[ends] + turn * back, 0.0), np.maximum(own_in[ends] + turn * to, 0.0)
        gain = np.bincount(p, term(o, i) - own_term[ends], minlength=parts)
        before, after = own_links[ends], joined(o, i)
        edges, lost = row - row[here], (row == 0) * 1 - (row[here] == 0)
        if len(at := np.flatnonzero(after != before)):
            b, a = before[at].astype(int), after[at].astype(int)
            edges = edges + np.bincount(p[at], a - b, minlength=parts)
            lost = lost + np.bincount(p[at], (a == 0) * 1 - (b == 0), minlength=parts)
            edges, lost = edges + edges[here], lost + lost[here]
        least = int(row[here] == 0)
        near = near[(lost[near] <= 0) & (edges[near] >= least)]
        if not len(near):
            return False
        local = term(out[near], into[near]) - own_term[node]
        if of_size is not None:
            rest, left = of_size[size[near] + 1], of_size[size[here] - 1]
        else:
            rest = bounds.bulk(np.append(size[near] + 1, size[here] - 1), np.append(total[near] + umis[node], total[here] - umis[node]))
            rest, left = rest[:-1], rest[-1]
        gains = local * temperature + (local + gain[near] + gain[here] + rest - bulk[near] + left - bulk[here]) * (1 - temperature)
        good = np.flatnonzero(gains >= EPSILON)
        if not len(good):
            if not least:
                return False
            good = np.arange(len(near))  # any edge is better than none
        pick = good[0]
        if len(good) > 1:
            over = np.cumsum(gains[good] - gains[good].min())
            pick = good[min(int(np.searchsorted(over, rng.random() * over[-1] - EPSILON)), len(good) - 1)]
        there = near[pick]
        for x, way, held in ((here, -1, left), (there, 1, rest[pick])):
            size[x] += way
            total[x] += way * umis[node]
            bulk[x] = held
        of[node] = there
        at = np.flatnonzero((p == here) | (p == there))
        changed = np.append(ends[at], node)
        own_out[changed], own_in[changed] = np.append(o[at], out[there]), np.append(i[at], into[there])
        own_links[changed], own_term[changed] = joined(own_out[changed], own_in[changed]), term(own_out[changed], own_in[changed])
        return True

    frozen = np.zeros(n, dtype=bool) if hot is None else ~np.isin(of, hot)
    heat = np.where(frozen, cold_temperature, 1.0)
    falls = (1 - cooldown_pass / n) ** np.arange(1, n + 1)
    temperature, moved, skipped = 1.0, True, False
    while temperature > 0 or moved:
        if not moved:
            temperature = min(temperature, heat[~frozen].min(initial=temperature)) if skipped else 0.0
        order = rng.permutation(n)
        seen = np.flatnonzero(heat[order] >= temperature * falls)
        moved, skipped = False, len(seen) < n
        for at in seen:
            node, now = order[at], temperature * falls[at]
            frozen[node] = False
            if improved(node, now):
                moved = True
            else:
                heat[node] = now * (1 - cooldown_node)
        temperature *= falls[-1]
    return of


def min_cut(weights: np.ndarray) -> tuple[np.ndarray, float | None]:
    """(side of each node, strength) of the global minimum cut of an undirected weighted graph, by maximum adjacency
    orders. The strength is the mean weight across the cut over the geometric mean of those within the sides; a cut without
    weight has 0, and one beside a side without weight has none."""
    n = len(weights)
    w = (weights + weights.T) / 2
    np.fill_diagonal(w, 0.0)
    whole = w.copy()
    merged = [[i] for i in range(n)]
    alive = list(range(n))
    best, side = np.inf, np.zeros(n, dtype=bool)
    while len(alive) > 1:
        index = np.array(alive)
        added = np.zeros(len(index), dtype=bool)
        pull = np.zeros(len(index))
        last = before = -1
        for _ in range(len(index)):
            k = int(np.where(added, -np.inf, pull).argmax())
            added[k] = True
            before, last = last, k
            cut = pull[k]
            pull = pull + w[index[k], index]
        if cut < best:
            best = float(cut)
            side = np.zeros(n, dtype=bool)
            side[merged[index[last]]] = True
        a, b = index[before], index[last]
        w[a] += w[b]
        w[:, a] += w[:, b]
        w[a, a] = 0.0
        merged[a] = merged[a] + merged[b]
        alive.remove(b)
    mean = lambda a, b: float(whole[np.ix_(a, b)].sum() / max(1, a.sum() * b.sum() if a is not b else a.sum() * (a.sum() - 1)))
    within = np.sqrt(mean(side, side) * mean(~side, ~side))
    across = mean(side, ~side)
    return side, across / within if within > 0 else 0.0 if across == 0 else None


def split_communities(links: Links, of: np.ndarray, umis: np.ndarray, bounds: Bounds, most_strength: float, least_cut: int, atoms: set, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, int]:
    """(community of each node, -1 for none, the communities that changed, how many there are to be): of those that are too large
    only random seeds stay, one for each part of the target size. If there are none, those with a weak cut are split along it;
    a side that is too small for a community loses its place instead. `atoms` are communities known to have no weak cut."""
    of = of.copy()
    count = int(of.max()) + 1
    most, hot, cut = count, [], False
    sizes, totals = np.bincount(of, minlength=count), np.bincount(of, weights=umis, minlength=count)
    for p in range(count):
        if (totals[p] > bounds.high_umis and sizes[p] >= 3 * bounds.low_size) or (sizes[p] > bounds.high_size and totals[p] >= 3 * bounds.low_umis):
            m = np.flatnonzero(of == p)
            parts = round(sizes[p] / bounds.target_size)
            parts = min(len(m), max(2, min(parts, round(totals[p] / bounds.target_umis)) if bounds.target_umis else parts))
            of[m] = -1
            names = [p, *range(most, most + parts - 1)]
            of[rng.choice(m, parts, replace=False)] = names
            hot += names
            most += parts - 1
    if most > count or not most_strength:
        return of, np.array(hot, dtype=int), most
    for p in range(count):
        m = np.flatnonzero(of == p)
        if len(m) < 2 or (key := m.tobytes()) in atoms:
            continue
        side, strength = min_cut(links.within(m))
        if strength is None or strength > most_strength:
            atoms.add(key)
            continue
        hot.append(p)
        if min(side.sum(), len(m) - side.sum()) >= least_cut:
            of[m[side]] = most
            hot.append(most)
            most += 1
        else:
            of[m[side if 2 * side.sum() <= len(m) else ~side]] = -1
            cut = True
    if cut:  # who lost their place may become a community
        hot.append(most)
        most += 1
    return of, np.array(hot, dtype=int), most


def knn_weights(similarity: np.ndarray, k: int, factor: float = 10**0.5, incoming: float = 3.0, outgoing: float = 1.0, least_degree: int = 2) -> np.ndarray:
    """The dense form of the nearest-neighbour graph, for one pile; k grows until every node has enough outgoing edges. Beside
    the similarity, or the result, there is one matrix of small integers; all else is done by strips."""
    n = len(similarity)
    strips = [slice(at, min(at + STRIP, n)) for at in range(0, n, STRIP)]
    ranks = np.empty((n, n), dtype=np.int32)
    for rows in strips:
        s = -similarity[rows]
        s[np.arange(len(s)), np.arange(rows.start, rows.stop)] = np.inf
        np.put_along_axis(ranks[rows], np.argsort(s, axis=1, kind="stable"), np.arange(1, n + 1, dtype=np.int32)[None, :], axis=1)
    del similarity
    node = np.arange(n)
    while True:
        value = np.empty((n, n))
        best, most = np.empty(n, dtype=np.int64), np.empty(n)
        for rows in strips:
            b = np.sqrt(ranks[rows].astype(float) * ranks[:, rows].T)
            b[np.arange(len(b)), np.arange(rows.start, rows.stop)] = np.inf
            best[rows] = b.argmin(axis=1)
            most[rows] = np.maximum(k * factor + 1 - b.min(axis=1), 1.0)
            np.maximum(k * factor + 1 - b, 0.0, out=value[rows])
        value[node, best] = np.maximum(value[node, best], most)
        for v, degree in ((value.T, incoming), (value, outgoing)):
            for rows in strips:
                _keep_largest(v[rows], min(round(k * degree), n - 1))
        value[node, best] = np.maximum(value[node, best], most)
        np.maximum.at(value, (best, node), most)
        if min(np.count_nonzero(value[rows], axis=1).min() for rows in strips) >= min(least_degree, n - 1):
            break
        del value
        k += max(1, k // 10)
    value /= np.maximum(value.sum(axis=1, keepdims=True), 1e-300)
    return value


def _keep_largest(rows: np.ndarray, count: int) -> None:
    """All but the `count` largest of each row become 0, of equal values the first ones stay."""
    if count >= rows.shape[1]:
        return
    least = np.partition(rows, rows.shape[1] - count, axis=1)[:, [rows.shape[1] - count]]
    ties = rows == least
    room = count - (rows > least).sum(axis=1, keepdims=True)
    rows[(rows < least) | (ties & (np.cumsum(ties, axis=1) > room))] = 0.0


def candidates(weights: np.ndarray, umis: np.ndarray, target_size: int, target_umis: float, least_size: int, seed: int, high_factor: float = 2.0, low_factor: float = 0.5, most_strength: float = 0.1, least_cut: int = 7, cooldown_phase: float = 0.75, increase_phase: float = 1.01) -> np.ndarray:
    """A group for each node: seeds, then rounds of annealing, splits of what is too large and cuts of what hangs together weakly,
    until nothing is split or cut. Each of the rounds starts colder for what was not split. Then all communities that are
    too small are dissolved and their nodes get new seeds, one fewer at least, and the rounds begin again, as long as fewer
    nodes are in small communities, or as many at a lower score; else the last but one result stays."""
    links, n = Links.of(weights), len(weights)
    incoming = weights.sum(axis=0)
    del weights
    rng = np.random.default_rng(seed)
    seeds = lambda size, total: max(1, round(min(total / target_umis, size / target_size) if target_umis else size / target_size))
    count = seeds(n, umis.sum())
    if count == 1:
        return np.zeros(n, dtype=int)
    low_size = max(least_size, int(low_factor * target_size))
    bounds = Bounds(
        int(low_factor * target_umis), target_umis, np.ceil(high_factor * target_umis) - 1 if target_umis else np.inf,
        low_size, target_size, max(np.ceil(high_factor * target_size) - 1, low_size + 1),
    )
    of = choose_seeds(links, count, 0.85, 0.95, rng)
    hot, cold, atoms = np.arange(of.max() + 1), 1 - 0.02, set()
    before = (n, np.inf)
    best = of
    while True:
        now = bounds
        while True:
            of = anneal(links, of, umis, now.low_umis, now.high_umis, now.low_size, now.high_size, rng, target_umis=target_umis, target_size=target_size, hot=hot, cold_temperature=cold)
            cold *= 1 - cooldown_phase
            now = replace(now, high_size=now.high_size * increase_phase)
            of, hot, most = split_communities(links, of, umis, now, most_strength, least_cut, atoms, rng)
            if not len(hot):
                break
            of = choose_seeds(links, most, 0.85, 0.95, rng, of)
        small = small_communities(of, umis, bounds, least_size)
        if len(small) < 2:
            break
        lost = np.isin(of, small)
        score = links_score(links, incoming, of, umis, bounds)
        if before <= (int(lost.sum()), score):
            of = best
            break
        before, best = (int(lost.sum()), score), of.copy()
        kept, new = np.unique(of[~lost], return_inverse=True)
        of = np.full(n, -1)
        of[~lost] = new
        more = min(len(small) - 1, seeds(lost.sum(), umis[lost].sum()))
        of = choose_seeds(links, len(kept) + more, 0.85, 0.95, rng, of)
        hot = np.arange(len(kept), of.max() + 1)
    return np.unique(of, return_inverse=True)[1]


def small_communities(of: np.ndarray, umis: np.ndarray, bounds: Bounds, least_size: int) -> np.ndarray:
    """Those of fewer than least_size members, and those below one lower bound that reach less than half the other's upper one."""
    size = np.bincount(of)
    total = np.bincount(of, weights=umis)
    few = (size < bounds.low_size) & ((2 * total < bounds.high_umis) | (bounds.high_umis == np.inf))
    return np.flatnonzero((size < least_size) | few | ((total < bounds.low_umis) & (2 * size < bounds.high_size)))


def links_score(links: Links, incoming: np.ndarray, of: np.ndarray, umis: np.ndarray, bounds: Bounds) -> float:
    """The stability score of a partition of all nodes."""
    n, parts = len(of), int(of.max()) + 1
    out, into = links.sums(of)
    inner = 0.5 * np.log2(EPSILON + out * into).sum()
    sizes, totals = np.bincount(of, minlength=parts), np.bincount(of, weights=umis, minlength=parts)
    return float((n * np.log2(n) - np.log2(incoming[incoming > 0]).sum() + inner + bounds.bulk(sizes, totals).sum()) / n)


# trees -----------------------------------------------------------------------------------------------------------


def ward(points: np.ndarray) -> np.ndarray:
    """Linkage (left, right, height, size) of Ward's method, by updates of squared distances."""
    n = len(points)
    d = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    name, size, out = list(range(n)), np.ones(n), []
    for step in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        height, si, sj = d[i, j], size[i], size[j]
        a, b = sorted((name[i], name[j]))
        out.append((a, b, float(np.sqrt(height)), si + sj))
        live = np.isfinite(d[i]) & np.isfinite(d[j])
        live[[i, j]] = False
        d[i, live] = ((si + size[live]) * d[i, live] + (sj + size[live]) * d[j, live] - size[live] * height) / (si + sj + size[live])
        d[live, i] = d[i, live]
        d[j], d[:, j] = np.inf, np.inf
        name[i], size[i] = n + step, si + sj
    return np.array(out).reshape(-1, 4)


def cut_tree(linkage: np.ndarray, n: int, most: int) -> np.ndarray:
    """A cluster for each leaf: the largest subtrees of at most `most` leaves."""
    leaves = {i: [i] for i in range(n)}
    top = {i: i for i in range(n)}
    for k, (a, b, _, size) in enumerate(linkage):
        leaves[n + k] = leaves[int(a)] + leaves[int(b)]
        if size <= most:
            for x in leaves[n + k]:
                top[x] = n + k
    ids = {c: k for k, c in enumerate(dict.fromkeys(top[i] for i in range(n)))}
    return np.array([ids[top[i]] for i in range(n)])


def correlated_clusters(linkage: np.ndarray, similarity: np.ndarray, least: float) -> list[list[int]]:
    """The largest subtrees, of two or more leaves, whose mean similarity (off the diagonal) is high enough."""
    n = len(similarity)
    leaves = {i: [i] for i in range(n)}
    good: dict[int, list[int]] = {}
    for k, (a, b, _, _) in enumerate(linkage):
        both = leaves[n + k] = leaves[int(a)] + leaves[int(b)]
        block = similarity[np.ix_(both, both)]
        if (block.sum() - np.trace(block)) / (len(both) * (len(both) - 1)) >= least:
            good.pop(int(a), None)
            good.pop(int(b), None)
            good[n + k] = both
    return list(good.values())


# least squares on the simplex ------------------------------------------------------------------------------------


def represent(goal: np.ndarray, basis: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """(residual, weights) of min |goal - weights @ basis| with weights >= 0 and sum 1, by an active set: the free
    weights solve the equality-constrained problem; a negative one leaves, one with a falling gradient enters."""
    k = len(basis)
    gram, target = basis @ basis.T, basis @ goal
    free = np.zeros(k, dtype=bool)
    free[int((gram.diagonal() - 2 * target).argmin())] = True
    w = free.astype(float)
    for _ in range(rounds):
        while True:
            f = np.flatnonzero(free)
            system = np.block([[gram[np.ix_(f, f)] + 1e-12 * np.eye(len(f)), np.ones((len(f), 1))], [np.ones((1, len(f))), np.zeros((1, 1))]])
            new = np.zeros(k)
            new[f] = np.linalg.lstsq(system, np.append(target[f], 1.0), rcond=None)[0][:-1]
            if (new[f] > 0).all():
                w = new
                break
            lower = f[new[f] <= 0]
            share = w[lower] / np.maximum(w[lower] - new[lower], 1e-300)
            w = w + share.min() * (new - w)
            free[lower[share <= share.min() + 1e-15]] = False
            w[~free] = 0.0
        slope = gram @ w - target
        level = slope[free].mean()
        enter = int(np.where(free, np.inf, slope).argmin())
        if free.all() or slope[enter] >= level - 1e-9 * (1 + abs(level)):
            break
        free[enter] = True
    return float(np.linalg.norm(goal - w @ basis)), w


# bins ------------------------------------------------------------------------------------------------------------


def bin_pack(sizes: list[float], most: float) -> list[int]:
    """A bin for each element, no bin over `most` (unless one element is): the largest first, each into the first bin
    with room; then elements move to emptier bins while that evens the fill."""
    bins: list[float] = []
    of = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        for b, fill in enumerate(bins):
            if fill + sizes[k] <= most:
                bins[b] += sizes[k]
                of[k] = b
                break
        else:
            of[k] = len(bins)
            bins.append(sizes[k])
    return _improve(sizes, of, bins, lambda fill: fill <= most)


def bin_fill(sizes: list[float], least: float) -> list[int]:
    """A bin for each element, every bin of at least `least` (if there is so much): as many bins as fit, the largest
    elements first, each into the emptiest bin; bins that stay too small are given up one at a time."""
    count = max(1, int(sum(sizes) // least))
    while True:
        bins, of = [0.0] * count, [0] * len(sizes)
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            b = min(range(count), key=lambda b: (bins[b], b))
            bins[b] += sizes[k]
            of[k] = b
        of = _improve(sizes, of, bins, lambda fill: True)
        fills = [sum(s for s, b in zip(sizes, of, strict=True) if b == x) for x in range(count)]
        if count == 1 or min(fills) >= least:
            return of
        count -= 1


def _improve(sizes: list[float], of: list[int], bins: list[float], fits) -> list[int]:
    """Moves elements, the largest first, to a bin that is emptier by more than their size, as long as any moves."""
    bins, changed = list(bins), True
    while changed:
        changed = False
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            for b in range(len(bins)):
                if b != of[k] and fits(bins[b] + sizes[k]) and bins[of[k]] - bins[b] > sizes[k] + 1e-12:
                    bins[of[k]] -= sizes[k]
                    bins[b] += sizes[k]
                    of[k], changed = b, True
    return of
