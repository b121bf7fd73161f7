"""Near-duplicates of the pipeline against brute force: five words, a similarity of 0.8."""

from __future__ import annotations

import random

import pytest

from lattica.llm import jaccard
from tests.llm.fixtures import documents, frame, words


def grams(text):
    found = (text or "").encode().lower().split()
    return {b" ".join(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def brute(rows):
    sets = [grams(t) for _, t, *_ in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and (sets[i] == sets[j] or 10 * both >= 8 * len(sets[i] | sets[j])):
                root = [root[j] if r == root[i] else r for r in root]
    ids = {r: [x[0] for x, s in zip(rows, root) if s == r and x[0] is not None] for r in root}
    return sorted(((x[0], min(ids[r], default=None)) for x, r in zip(rows, root)), key=str)


def changed(rng, text, times):
    found = text.split(" ")
    for k in rng.sample(range(len(found)), times):
        found[k] = "other" + str(rng.randrange(10**6))
    return " ".join(found)


@pytest.mark.parametrize("hot", [8, 4096])
def test_components_are_those_of_all_pairs(spark, hot):
    rng = random.Random(3)
    rows = documents()
    boilerplate = " ".join(words(rng, 30))
    for g in range(12):
        base = " ".join(words(rng, rng.randint(40, 200)))
        for _ in range(6):
            rows.append((1000 + len(rows), changed(rng, base, rng.randint(0, 7)), "en", "s", 1))
    for _ in range(30):
        rows.append((1000 + len(rows), boilerplate + " " + " ".join(words(rng, rng.randint(2, 40))), "en", "s", 1))
    found = jaccard.near_duplicates(frame(spark, rows, clash=True), hot=hot).collect()
    assert sorted(((r.doc_id, r.component_id) for r in found), key=str) == brute(rows)
    assert jaccard.near_duplicates(frame(spark, [])).collect() == []


def test_stage_drops_copies_at_the_similarity(spark):
    """One word of sixty changed: a Jaccard similarity of 51 / 61, at which fingerprints are some 10 bits apart."""
    import corpus_pipeline

    rng = random.Random(8)
    rows = []
    for g in range(20):
        base = [f"{w}{g}" for w in words(rng, 60)]
        rows += [(2 * g, " ".join(base), "en", "s", 1), (2 * g + 1, " ".join([*base[:30], f"else{g}", *base[31:]]), "en", "s", 1)]
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert {r.doc_id for r in stage(spark, frame(spark, rows), "").collect()} == set(range(0, 40, 2))


def test_stage_links_by_fingerprints_and_by_similarity(spark):
    """b has the fingerprint of a but is less than 0.8 similar to it, and c is similar to b only: all three are one component."""
    import corpus_pipeline
    from lattica.llm import simhash

    rng = random.Random(9)
    while True:  # a short text's shingles are few, so that a change in one often moves few bits
        base = words(rng, 60)
        other = [*base[:20], "x", *base[21:40], "y", *base[41:]]
        a, b = " ".join(base), " ".join(other)
        near = (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() <= simhash.RADIUS
        if near:
            break
    c = " ".join([*other[:10], "z", *other[11:]])
    rows = [(3, a, "en", "s", 1), (2, b, "en", "s", 1), (1, c, "en", "s", 1), (9, " ".join(words(rng, 60)), "en", "s", 1)]
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert {r.doc_id for r in stage(spark, frame(spark, rows), "").collect()} == {1, 9}


def test_other_work_drops_what_a_process_keeps():
    from lattica.llm import shared

    dropped = []
    shared.keeps("one", lambda: dropped.append("one"))
    shared.drop_others("one")
    assert not dropped
    shared.drop_others("")
    shared.drop_others("")
    assert dropped == ["one"]
