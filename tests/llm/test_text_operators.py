"""Quality rules, SimHash, BPE and line dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from lattica.llm import bpe, linededup, quality, simhash
from tests.llm.fixtures import SCHEMA, documents, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# quality


def plain_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_statistics_and_fixed_rules(spark):
    rows = documents() + [(900, "a b c a b c " * 30, "en", "s", 1), (901, "x # y\nx # y\n \n \n", "en", "s", 1), (902, "ü | " * 60, "en", "s", 1)]
    rows = [r for r in rows if r[1] is None or len(r[1]) < 5000]
    found = quality.judge(frame(spark, rows, clash=True), None).collect()
    assert len(found) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        base = plain_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert r.kept == (not r.base_failed)


def test_repeated_words_of_large_vocabularies():
    words = [str(i).encode() for i in range(1 << 20)] + [b"a", b"b", b"c", b"d", b"a", b"b", b"c"]
    assert quality.repeated_words(words) == 6


def test_trees_respect_constraints_and_score_as_grown():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] + rng.normal(scale=0.3, size=2000) < 0.6) & (x[:, 1] > 0.3)).astype(float)
    forest = quality.fit(x, y, monotone=(-1, 0, 0), trees=30)
    grid = np.tile(np.array([0.0, 0.7, 0.5]), (50, 1))
    grid[:, 0] = np.linspace(0, 1, 50)
    assert (np.diff(forest.score(grid)) <= 1e-12).all()
    assert ((forest.score(x) > 0.5) == y).mean() > 0.85
    assert quality.fit(x, np.ones(2000)) is None and quality.fit(x[:0], y[:0]) is None


def test_trained_verdicts_and_kept_rows(spark):
    rng = random.Random(3)
    good = [(i, prose(rng, 120), "en", "s", 1) for i in range(80)]
    bad = [(100 + i, " ".join(w + "###" for w in prose(rng, 120).split()), "en", "s", 1) for i in range(40)]
    docs = frame(spark, good + bad, clash=True)
    labels = spark.createDataFrame([(r[0], int(r[0] < 100), 0) for r in good[:50] + bad[:25]] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    forest = quality.train(docs, labels)
    kept = quality.keep(docs, forest)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in good}
    empty = frame(spark, [])
    assert quality.train(empty, labels) is None
    assert quality.judge(empty, None).collect() == [] and quality.keep(empty, forest).collect() == []


# SimHash


def plain_fingerprint(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark):
    rows = documents()
    found = simhash.near_duplicates(frame(spark, rows, clash=True)).collect()
    assert len(found) == len(rows)
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    assert sorted(map(str, ((r.doc_id, int(r.fingerprint, 16)) for r in found))) == sorted(map(str, prints))
    nodes = sorted({p for _, p in prints})
    root = {p: p for p in nodes}
    for a in nodes:
        for b in nodes:
            if bin(a ^ b).count("1") <= 4 and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    for r in found:
        assert r.component_id == least.get(root[int(r.fingerprint, 16)])
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("hot", [8, 4096])
def test_links_of_crowded_cells(spark, hot):
    """A dense group around one fingerprint, chains of close ones and random ones, with and without chunks."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(300):
        prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    chain = rng.getrandbits(64)
    for _ in range(30):
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        prints.add(chain)
    prints |= {rng.getrandbits(64) for _ in range(200)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), hot=hot)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    got = {p: roots.get(p, p) for p in signed}
    array = np.array(signed, dtype=np.int64)
    want = {p: p for p in signed}
    changed = True
    near = np.bitwise_count(array[:, None].view(np.uint64) ^ array[None, :].view(np.uint64)) <= 4
    while changed:
        changed = False
        for i, p in enumerate(signed):
            low = min(want[signed[j]] for j in np.flatnonzero(near[i]))
            if low < want[p]:
                want[p], changed = low, True
    assert got == want


def test_manhattan_is_a_lower_bound():
    x = np.random.default_rng(1).integers(0, 2**63, 2000, dtype=np.uint64)
    u = simhash.embedding(x)
    assert (np.bitwise_count(u[:-1] ^ u[1:]) <= np.bitwise_count(x[:-1] ^ x[1:])).all()


def test_one_of_each_group_stays(spark):
    rows = documents()
    docs = frame(spark, rows, clash=True)
    kept = simhash.keep(docs)
    assert kept.columns == docs.columns
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {i for i, c in groups.items() if i is None or i == c}


# BPE


@pytest.fixture(scope="module")
def automaton():
    return bpe.load(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(automaton, library):
    rng = random.Random(7)
    pieces = [*"abehtinorsdl  '\n\t!?0123éçñß中文😀A.…\x1c\x85​", "the", "ing", "'s", "<|endoftext|>", "aaaa", "    ", "====", "\r\n", "\U00011de0"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(4000)]
    texts += [" ".join(prose(rng, 200).split()) for _ in range(30)] + ["a" * 5000, "=" * 3000, " " * 999, "", "<|endoftext|>"]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert automaton.encode(text) == ids, text
        assert automaton.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert automaton.decode([automaton.encode("é")[0], 70000]) == library.decode(library.encode("é").ids[:1])


def test_small_automata_merge_leftmost_first():
    labels = {0: b"a", 1: b"b", 2: b"aa", 3: b"aaa", 4: b"ab"}
    machine = bpe.Automaton(labels, [(0, 0, 2), (2, 0, 3), (0, 1, 4)], {})
    assert machine.encode_word(b"aaa") == (3,) and machine.encode_word(b"aaaa") == (2, 2)
    assert machine.encode_word(b"aab") == (2, 1) and machine.encode_word(b"ab") == (4,)
    assert machine.encode_word(b"aaaaa") == (2, 3)


def plain_bpe(word, merges):
    """Merge by merge over the whole word, leftmost first, as the definition has it."""
    tokens = list(word)
    for u, v, made in merges:
        out = []
        for t in tokens:
            if out and out[-1] == u and t == v:
                out[-1] = made
            else:
                out.append(t)
        tokens = out
    return tuple(tokens)


def test_the_byte_automaton_marks_the_last_token_of_every_prefix():
    rng = random.Random(21)
    for _ in range(60):
        labels, merges = {0: b"a", 1: b"b", 2: b"c"}, []
        while len(merges) < 12:
            u, v = rng.choice(list(labels)), rng.choice(list(labels))
            if labels[u] + labels[v] not in labels.values():
                merges.append((u, v, len(labels)))
                labels[len(labels)] = labels[u] + labels[v]
        machine = bpe.Automaton(labels, merges, {})
        for _ in range(40):
            word = bytes(rng.choices(b"abc", k=rng.randint(1, 14)))
            state = machine._start
            for n, byte in enumerate(word, 1):
                state = state[byte]
                assert state.mark == plain_bpe([b - 97 for b in word[:n]], merges)[-1]
            assert machine.encode_word(word) == plain_bpe([b - 97 for b in word], merges)


def test_the_byte_automaton_starts_anew_when_full(automaton, library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 20)
    machine = bpe.Automaton(automaton.labels, automaton.merges, automaton.special)
    for text in ("unbelievably long enough a word", "x" * 300, "internationalisation"):
        assert machine.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert len(machine._states) <= 20


def test_bpe_digests_and_round_trip(spark, automaton, library):
    rows = documents()
    docs = frame(spark, rows, clash=True)
    found = bpe.digests(docs, automaton).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(text or "")))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    back = bpe.decode_documents(bpe.encode_documents(docs, automaton), automaton).collect()
    assert sorted(str((r.doc_id, r.text)) for r in back) == sorted(str((i, t or "")) for i, t, *_ in rows)
    assert bpe.digests(frame(spark, []), automaton).collect() == []


# line dedup


def plain_line_dedup(rows, min_chars=40, min_documents=5):
    holders = {}
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    for i, text, *_ in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= min_chars:
                    holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        stays = [x for x in lines if i is None or len(holders.get(key(x), ())) < min_documents or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return out


def line_rows():
    rng = random.Random(11)
    common = ["é" * 39, "É" * 40, "a common line of forty code points or so, yes", "B" * 41]
    rows = documents()
    for i in range(200, 260):
        lines = rng.choices(common, k=3) + [prose(rng, 10) for _ in range(3)] + rng.choices(["", "  ", "\t" + common[2].upper() + "\r"], k=2)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), "en", "s", 1))
    return rows


def test_line_dedup(spark):
    rows = line_rows()
    docs = frame(spark, rows, clash=True)
    found = linededup.digests(docs).collect()
    want = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in plain_line_dedup(rows)]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    kept = linededup.keep(docs)
    assert kept.columns == docs.columns
    texts = sorted(str((r.doc_id, r.text)) for r in kept.collect())
    assert texts == sorted(str((i, t if r[1] is not None else None)) for r, (i, _, _, t) in zip(rows, plain_line_dedup(rows), strict=True))
    assert linededup.digests(frame(spark, [])).collect() == []


def test_line_dedup_of_a_line_over_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = [(i, "x" * 50 + "\n" + f"{i:060d}", "en", "s", 1) for i in range(2000)]
        found = {r.doc_id: r.n_dropped for r in linededup.digests(frame(spark, rows)).collect()}
        assert found == {i: int(i != 1999) for i in range(2000)}
    finally:
        for k, v in (("spark.sql.shuffle.partitions", "4"), ("spark.sql.adaptive.enabled", "true"), ("spark.sql.files.maxPartitionBytes", "128m")):
            spark.conf.set(k, v)


@pytest.mark.parametrize("copies", [3, 4, 5, 6, 40])
def test_keys_at_the_ends_of_splits(spark, copies):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        rows = [(i, f"{i % 50:060d}\n{i % 50:060d}\n{i:070d}", "en", "s", 1) for i in range(50 * copies)]
        found = sorted((r.doc_id, r.n_dropped) for r in linededup.digests(frame(spark, rows)).collect())
        assert found == [(i, n - m) for i, n, m in ((i, 3, 3 if copies < 5 or i >= 50 * (copies - 1) else 1) for i in range(50 * copies))]
    finally:
        for k, v in (("spark.sql.shuffle.partitions", "4"), ("spark.sql.adaptive.enabled", "true"), ("spark.sql.files.maxPartitionBytes", "128m")):
            spark.conf.set(k, v)


def test_long_chains_settle(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(400)], "x bigint, y bigint")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_bitmaps_round_trip():
    for n in (1, 7, 8, 9, 64, 1000):
        gone = sorted(random.Random(n).sample(range(n), max(1, n // 3)))
        bits = np.ones(gone[-1] + 1, dtype=np.uint8)
        bits[gone] = 0
        import zlib

        packed = zlib.compress(np.packbits(bits).tobytes() + bytes([len(bits) % 8]))
        assert (linededup.unpacked(packed) == bits.astype(bool)).all()
    assert SCHEMA


def test_a_worker_keeps_one_automaton_and_drops_the_others():
    import gc
    import pickle
    import weakref

    machine = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    pickled = pickle.dumps(machine)
    first = bpe.kept(b"first", pickled)
    first.encode("some words, and some others; über")
    assert bpe.kept(b"first", pickled) is first
    gone = weakref.ref(first)
    del first
    bpe.kept(b"second", pickled)
    assert gone() is None and list(bpe._kept) == [b"second"]
    bpe._kept.clear()
    gc.collect()


def test_ids_that_do_not_fit_the_keys_are_refused():
    with pytest.raises(ValueError, match="2\\^20"):
        bpe.Automaton({1 << 20: b"a"}, [], {})
