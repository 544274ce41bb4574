"""Jaccard join and suffix dedup against brute force, with their edge cases."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from flakespark.llm import jaccard, kernels, suffix
from flakespark.llm.components import components

WORDS = [f"w{k}" for k in range(400)]


def brute_jaccard(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = (t or "").translate({k: k + 32 for k in range(65, 91)}).encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    links = dict.fromkeys(sets, 0)
    pairs = []
    ids = list(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                pairs.append((a, b))
                links[a] += 1
                links[b] += 1
    for _ in ids:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i], links[i]) for i in sets}


def near_copies(seed, n):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, 1 + len(w) // 25)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(WORDS)
            w = w[: rng.randint(max(1, int(len(w) * 0.8)), len(w))]
        else:
            w = [rng.choice(WORDS) for _ in range(rng.choice([1, 3, 5, 9, 40, 300, 900]))]
        rows.append((k * 3, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed, block", [(1, 256), (2, 256), (3, 8), (4, 4)])
def test_jaccard_brute(spark, docs, seed, block, monkeypatch):
    # small blocks: groups are dealt by size, bucket and salt, and blocks are paired by their buckets
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(seed, 150) + [(1, None), (2, ""), (4, " \t\n"), (5, "Aa bB"), (7, "aA Bb")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_join(docs(rows)).collect()}
    assert got == brute_jaccard(rows)


def test_jaccard_edges(spark, docs):
    assert jaccard.jaccard_join(docs([])).count() == 0
    same = "a b c d e f g"
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.n_links) for r in jaccard.jaccard_join(docs([(9, same), (9, same), (4, same), (None, same)])).collect())
    assert got == [(False, 4, 4, 2), (False, 9, 4, 2), (False, 9, 4, 2), (True, 0, None, 0)]


def test_jaccard_large_sets_are_small_blocks(spark, docs, monkeypatch):
    # one family of near copies, whose sets fill a block by twos
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 700)
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(300)]
    rows = [(k, " ".join(w if rng.random() > 0.01 else rng.choice(WORDS) for w in base)) for k in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_join(docs(rows)).collect()}
    assert got == brute_jaccard(rows)


def test_words_of_an_algebraic_pattern_differ(spark, docs):
    # the two words of Thue and Morse agree in every polynomial hash modulo a power of two
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    tail = [f"x{k}" for k in range(11)]
    rows = [(1, " ".join([word, *tail])), (2, " ".join([other, *tail])), (3, word), (4, other), (5, " ".join([word, other, word, other, word, other]))]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_join(docs(rows)).collect()}
    assert got == brute_jaccard(rows)


def test_word_hashes_in_slices(monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(WORDS) * rng.choice([1, 1, 40]) for _ in range(n)) for n in (300, 0, 1, 5, 700)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    whole = kernels.word_hashes(data, offsets)
    monkeypatch.setattr(kernels, "SLICE", 100)
    parts = kernels.word_hashes(data, offsets)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and len(set(whole[0].tolist())) == len({w for t in texts for w in t.split()})


def test_blocks_of_a_large_group():
    # the product of blocks equals the product of the whole
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(30)]
    whole = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (jaccard.overlaps(sets, None) == whole).all() and (jaccard.overlaps(sets[:10], sets[10:]) == whole[:10, 10:]).all()
    linked = whole > 33
    np.fill_diagonal(linked, False)
    forest = jaccard._forest(linked, True)
    reach = lambda edges: {min(c) for c in _classes(30, edges)}
    assert len(forest) < 30 and reach(forest) == reach(list(zip(*np.nonzero(linked))))


def _classes(n, edges):
    of = list(range(n))
    for _ in range(n):
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    return [[k for k in range(n) if of[k] == c] for c in set(of)]


def test_sampling_bound():
    # a sample of a linked pair's shingles shows least_shared of them, but for one case in 10^12
    for p in (20, 64, 160):
        c = jaccard.least_shared(p, True, 75)
        from math import comb

        assert sum(comb(p, k) * 0.75**k * 0.25 ** (p - k) for k in range(c)) < 1e-12
    assert jaccard.least_shared(100, False, 75) == 75 and jaccard.least_shared(1, False, 75) == 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(300, 200), (500, 500)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert all(got[k] == 0 for k in range(101)) and got[300] == 200 and got[500] == 500
    assert components(edges.where("a < 0")).count() == 0


def test_components_estimate_stays_small(spark):
    # the driver's estimate of the labels' size was squared each round, to numbers of 100s of MB after some 15 rounds
    labels = components(spark.range(1, 300).selectExpr("id - 1 AS a", "id AS b"))
    assert {r.label for r in labels.collect()} == {0}
    assert labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64


def brute_suffix(rows, length=50):
    seen, out = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = min(seen.get(b[k : k + length], i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] < i:
                gone[k : k + length] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("seed, piece, hot", [(1, suffix.PIECE, suffix.HOT), (2, 3, 1000), (3, 5, 2)])
def test_suffix_brute(spark, docs, seed, piece, hot):
    rng = random.Random(seed)
    rows = []
    passage = "ünï " * 20 + "the shared passage of this corpus, longer than the limit, is here. "
    for k in range(60):
        t = "".join(rng.choice("ab cdé") for _ in range(rng.randint(0, 200)))
        for _ in range(rng.randint(0, 2)):
            cut = rng.randint(0, len(t))
            t = t[:cut] + rng.choice([passage, passage[: rng.randint(10, 120)], "x" * 130, "pair of words. " * rng.randint(4, 30), rows[rng.randrange(len(rows))][1] or "" if rows else ""]) + t[cut:]
        rows.append((k * 2, t))
    rows += [(1, None), (3, ""), (5, "short"), (7, "short"), (9, rows[0][1]), (11, "y" * 49), (13, "y" * 49), (15, "z" * 50), (17, "z" * 50)]
    got = {r.doc_id: tuple(r)[1:] for r in suffix.suffix_dedup(docs(rows), piece=piece, hot=hot).collect()}
    assert got == brute_suffix(rows)


def test_suffix_edges(spark, docs):
    assert suffix.suffix_dedup(docs([])).count() == 0
    long = "q" * 30 + "abcdefghij" * 5
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in suffix.suffix_dedup(docs([(2, long), (2, long), (None, long), (8, long + "é")]), with_text=True).collect())
    assert got == [(False, 2, 0), (False, 2, 0), (False, 8, 80), (True, 0, 0)]
    text = {r.doc_id: r.kept_text for r in suffix.suffix_dedup(docs([(2, long), (8, long + "é")]), with_text=True).collect()}
    assert text[8] == "é"


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(5)
    for alphabet in (1, 2, 5):
        data = rng.integers(0, alphabet, 200).astype(np.uint8) + 97
        raw = data.tobytes()
        order = suffix.suffix_array(data, 16)
        heads = [raw[k : k + 16] for k in order]
        assert heads == sorted(heads)
        prefixes = suffix.common_prefixes(data, order, 16)
        for x in range(1, 200):
            a, b = raw[order[x - 1] :], raw[order[x] :]
            n = next((k for k in range(min(len(a), len(b), 16)) if a[k] != b[k]), min(len(a), len(b), 16))
            assert prefixes[x] == n


@pytest.mark.parametrize("piece, size", [(10_000, 100), (1, 1), (2, 3), (3, 2)])
def test_pieces_of_a_hot_anchor(piece, size):
    rng = random.Random(1)
    for _ in range(40):
        base = bytes(rng.choice(b"ab") for _ in range(30))
        rows = []
        for _ in range(rng.randint(1, 12)):
            b = bytearray(base[: rng.randint(12, 30)])
            if rng.random() < 0.5:
                b[rng.randrange(len(b))] = rng.choice(b"abc\0")
            g = rng.choice([7, 7, 7, 9])
            rows.append((g, rng.randint(0, 6), rng.randint(0, 5), bytes(b) if g == 7 else bytes(b).upper()))
        rows.sort(key=lambda r: r[:2])
        batches = []
        for k in range(0, len(rows), size):
            h, d, s, b = zip(*rows[k : k + size])
            batches.append(pa.record_batch({"h": pa.array(h), "part": pa.array([0] * len(h)), "doc_id": pa.array(d), "start": pa.array(s), "bytes": pa.array(b, pa.binary()), "more": pa.array([None if x % 2 else np.array([x + 40, x + 45]).tobytes() for x in s], pa.binary())}))
        found = [x for b in suffix._marks(iter(batches), 12, piece) for x in b.to_pylist()]
        got = {(x["doc_id"], p) for x in found if x["k1"] is None for p in range(x["start"], x["stop"])}
        undecided = sorted(((x["k1"], x["k2"], x["doc_id"], x["start"], x["stop"], x["more"]) for x in found if x["k1"] is not None), key=lambda x: x[:4])
        merged, names = [], ["k1", "k2", "doc_id", "start", "stop", "more"]
        for k in range(0, len(undecided), size):
            merged.append(pa.record_batch([pa.array(c, pa.binary() if n == "more" else pa.int64()) for n, c in zip(names, zip(*undecided[k : k + size]))], names=names))
        got |= {(x["doc_id"], p) for b in suffix._across_shards(iter(merged)) for x in b.to_pylist() for p in range(x["start"], x["stop"])}
        want = set()
        for g in (7, 9):
            own = [(a, d, x, b) for a, d, s, b in rows if a == g for x in ([s] if s % 2 else [s, s + 40, s + 45])]
            first = {}
            for _, d, _, b in own:
                for k in range(len(b) - 11):
                    first[b[k : k + 12]] = min(first.get(b[k : k + 12], 99), d)
            want |= {(d, p) for _, d, s, b in own for k in range(len(b) - 11) if first[b[k : k + 12]] < d for p in range(s + k, s + k + 12)}
        assert got == want


def test_jaccard_rejects_what_its_classes_do_not_cover(docs):
    with pytest.raises(ValueError):
        jaccard.jaccard_join(docs([(1, "a b c")]), percent=74)


def test_a_hot_anchor_of_unlike_segments_needs_bounded_memory():
    # 200,000 distinct segments of one anchor: what is held does not grow with their number
    import tracemalloc

    def batches(n):
        rng = np.random.default_rng(1)
        for k in range(0, n, 1000):
            noise = rng.integers(97, 123, (1000, 30)).astype(np.uint8)
            texts = [x[:15].tobytes() + b"the anchor of them all" + x[15:].tobytes() for x in noise]
            yield pa.record_batch({"h": pa.array([7] * 1000), "part": pa.array([1] * 1000), "doc_id": pa.array(np.arange(k, k + 1000)), "start": pa.array([0] * 1000), "bytes": pa.array(texts, pa.binary()), "more": pa.nulls(1000, pa.binary())})

    peaks = []
    for n in (20_000, 200_000):
        tracemalloc.start()
        assert sum(b.num_rows for b in suffix._marks(batches(n), 50, 2000)) == 3 * n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] < 200e6


def test_long_rows_come_in_pieces(spark, docs):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2_500_000))
    rows = [(1, "x" + long[1_040_000:1_060_000]), (2, long), (3, long[2_400_000:] + "end")]
    got = {r.doc_id: tuple(r)[1:] for r in suffix.suffix_dedup(docs(rows)).collect()}
    left = long[:1_040_000] + long[1_060_000:]
    assert got[2] == (len(long), 20_000, 1, hashlib.sha256(left.encode()).hexdigest())
    assert got[3] == (100_003, 100_000, 1, hashlib.sha256(b"end").hexdigest())
