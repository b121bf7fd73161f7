"""Tokenizer alignment, license scans and importance resampling against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from lattica.llm import alignment, bpe, importance, licenses
from tests.llm.fixtures import SCHEMA, documents, frame, prose, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def by_id(rows):
    """Rows as sorted tuples: ids repeat."""
    return sorted(map(tuple, rows), key=str)


# alignment

ODD = [
    "a<|endoftext|>b </s> <0x41> ☕ ﬁ", "with ▁ in it", "\x00 null", "   ", "\n\n\t x", "naïve Straße 東京 한국 ١٢٣ \U0001f600\U0001f1e9\U0001f1ea",
    "x" * 3000, "1234567890" * 20, "don't we'll  you've", " \u0085  é", " leading", "trailing ",
]


def plain_alignment(texts):
    """Of each text the result columns, by pairs of byte ranges."""
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = {letter: i for i, letter in enumerate(bpe.byte_letters())}
    counts, found = Counter(), []
    for text in texts:
        groups, links = [], []
        if text:
            whole = (" " + text).encode()
            sides = [], []
            for i in a_model.encode(" " + text, add_special_tokens=False).ids:
                sides[0].append((i, bytes(byte_of[c] for c in a_model.id_to_token(i))))
            for i in b_model.encode(text):
                piece = b_model.id_to_piece(i)
                sides[1].append((i, bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()))
            if all(b"".join(x for _, x in side) == whole for side in sides):
                ranges = []
                for side in sides:
                    at, out = 0, []
                    for i, x in side:
                        out.append((at, at + len(x), i))
                        at += len(x)
                    ranges.append(out)
                links = [(i, j) for s, e, i in ranges[0] for t, f, j in ranges[1] if s < f and t < e]
                cuts = sorted({e for _, e, _ in ranges[0]} & {e for _, e, _ in ranges[1]})
                start = 0
                for cut in cuts:
                    groups.append([[i for s, e, i in side if start <= s < cut] for side in ranges])
                    start = cut
        counts.update(links)
        found.append((groups, links))
    top = defaultdict(int)
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    out = []
    for groups, links in found:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((
            sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links),
            sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return out


def test_alignment_equals_pairs_of_byte_ranges(spark):
    rows = [r for r in documents() if r[1] is None or len(r[1]) < 2000] + [(500 + i, t, None, None, None) for i, t in enumerate(ODD)]
    spec = alignment.load(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    want = by_id((r[0], *x) for r, x in zip(rows, plain_alignment([r[1] for r in rows]), strict=True))
    docs = frame(spark, rows, clash=True).repartition(3)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for head in (alignment.HEAD, 40, 0):  # all pairs are held by each task, some are, none is
        assert by_id(alignment.digests(docs, spec, head).select(*columns).collect()) == want
    assert alignment.digests(frame(spark, []), spec).collect() == []


def test_alignment_splits_a_batch_without_a_trace():
    pair = alignment.load(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).open()
    texts = [t.encode() for t in ODD] + [None, b"", b"again and again"]
    whole = alignment.align(pair, texts)
    assert [alignment.align(pair, [t]).groups[0] for t in texts] == whole.groups
    assert sum(int(alignment.align(pair, [t]).n.sum()) for t in texts) == int(whole.n.sum()) == int(whole.n_links.sum())


# licenses


def edited(template, rng, edits):
    out = list(template.words)
    for _ in range(edits):
        at = rng.randrange(2, len(out) - 2)
        rng.choice([lambda: out.insert(at, "zzz"), lambda: out.pop(at), lambda: out.__setitem__(at, "yyy")])()
    return " ".join(out)


def plain_scan(text):
    """Base columns by slices of words; the method's spans by all hits of all templates."""
    found = WORD.findall(lower(text))
    places, labels, score = [], set(), 0.0
    for t in licenses.TEMPLATES:
        if t.near == 0:
            starts = [i for i in range(len(found)) if found[i : i + len(t.words)] == t.words]
            if t.base:
                places += [(s, t.label) for s in starts]
            if starts:
                labels.add(t.label)
                score = max(score, len(t.words) / (len(t.words) + licenses.HALF))
            continue
        hits = defaultdict(list)
        grams = {}
        for at, gram in enumerate(t.grams):
            grams.setdefault(gram, []).append(at)
        for p in range(len(found)):
            for at in grams.get(" ".join(found[p : p + t.k]), ()):
                hits[p - at].append((p, at))
        piles, last = [], None
        for d in sorted(hits):
            if last is None or d - last > t.near:
                piles.append([])
            piles[-1] += hits[d]
            last = d
        for pile in piles + list(hits.values()):
            covered = len({x for _, at in pile for x in range(at, at + t.k)})
            width = max(p for p, _ in pile) + t.k - min(p for p, _ in pile)
            similarity = covered / max(len(t.words), width)
            if similarity >= licenses.LEAST:
                labels.add(t.label)
                score = max(score, similarity * covered / (covered + licenses.HALF))
    starts = [s for s, _ in places]
    return (
        len(found), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})),
        ",".join(sorted(labels)), round(score, 9),
    )


def license_rows():
    rng = random.Random(3)
    long = [t for t in licenses.TEMPLATES if len(t.words) > 16]
    made = [prose(rng, 30) + "\n" + edited(t, rng, edits) + ". " + prose(rng, 10) for t in long for edits in (0, 1, 2, 8)]
    made += [
        "CC BY cc-by, All Rights Reserved! all rights all rights reserved", "gnu general public license general public license", "cc by",
        "the Kelvin cç by İ cc bY", "license mit", " ".join(long[0].words * 3), "all " * 400, "x" * 20000 + " cc by",
        edited(long[0], rng, 0) + " " + " ".join(words(rng, 400)) + " " + edited(long[0], rng, 1), "Released under the MIT License.",
    ]
    return documents() + [(700 + i, t, None, None, None) for i, t in enumerate(made)] + [(700, made[0], None, None, None)]


def test_scan_equals_slices_of_words(spark):
    rows = license_rows()
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    found = licenses.scan(frame(spark, rows, clash=True).repartition(3)).select(*columns).collect()
    assert by_id((*r[:-1], round(r[-1], 9)) for r in found) == by_id((r[0], *plain_scan(r[1])) for r in rows)
    assert licenses.scan(frame(spark, [])).collect() == []
    labels = {r.doc_id: r.labels for r in found}
    exact = [i for i, (_, edits) in enumerate((t, e) for t in licenses.TEMPLATES if len(t.words) > 16 for e in (0, 1, 2, 8)) if edits == 0]
    assert all(labels[700 + i] for i in exact)


def test_many_templates_go_in_slices(spark, monkeypatch):
    rows = license_rows()[-12:]
    want = by_id(licenses.scan(frame(spark, rows)).collect())
    monkeypatch.setattr(licenses, "MAX_GRAMS", 50)
    assert by_id(licenses.scan(frame(spark, rows)).collect()) == want


# importance


def plain_resample(rows, target, depth, buckets, share, least, seed):
    def bucketed(text):
        found = [w.encode() for w in WORD.findall(lower(text))]
        grams = [b" ".join(found[i : i + n]) for n in range(1, depth + 1) for i in range(len(found) - n + 1)]
        return len(found), [zlib.crc32(g) % buckets for g in grams]

    each = [bucketed(r[1]) for r in rows]
    source = Counter(b for _, x in each for b in x)
    aim = Counter(b for t in target for b in bucketed(t)[1])
    s, t = sum(source.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets))))
    out = []
    for r, (n, x) in zip(rows, each, strict=True):
        weight = sum(map(gain, x)) // len(x) if x else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    drawn = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], math.inf if x[0] is None else x[0]))
    ranks = [None] * len(out)
    for rank, x in enumerate(drawn[: share * len(drawn) // 100], 1):
        ranks[next(i for i, y in enumerate(out) if y is x)] = rank
    return by_id((*x[:4], r) for x, r in zip(out, ranks, strict=True))


def test_resampling_equals_counted_features(spark):
    rows = documents() + [(800, "A-b_c" * 30, None, None, None), (801, "é 　x " * 30, None, None, None)]
    target = [rows[3][1], None, "", prose(random.Random(5), 300)]
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    for depth, buckets, share in ((1, 10_000, 10), (3, 50, 35), (1, 7, 100)):
        found = importance.resample(frame(spark, rows, clash=True).repartition(5), aim, depth, buckets, share, 20, 2024)
        assert by_id(found.collect()) == plain_resample(rows, target, depth, buckets, share, 20, 2024)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert importance.resample(spark.createDataFrame([], SCHEMA), none).collect() == []
    rows = [(1, "one word " * 20, None, None, None), (2, None, None, None, None)]
    assert by_id(importance.resample(frame(spark, rows), none, share=100).collect()) == plain_resample(rows, [], 1, 10_000, 100, 20, 2024)


def test_suffix_array_orders_by_words_of_a_document():
    rng = np.random.default_rng(1)
    for depth in (1, 2, 3, 5):
        sizes = rng.integers(0, 30, 12)
        ids = rng.integers(0, 3, sizes.sum())
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))
        key = [tuple(ids[i : i + min(depth, left[i])] + 1) for i in range(len(ids))]
        found = importance.suffix_array(ids, left, depth)
        assert [key[i] for i in found] == sorted(key)
