"""Toxicity, mixing, site quality and the pipeline: exact search, fitted targets, held-out accuracy, stage effects."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flakespark.llm import evidence, mixing, nearest, sites

FOLDER = "/root/testdata/sf0.001"


def labelled(spark, docs, n=600, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice("the of and a to in red blue sun road tree stone".split()) + rng.choice(["", "s"]) for _ in range(rng.randint(20, 80))]
        toxic, bad = rng.random() < 0.2, rng.random() < 0.2
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vilewordA", "vilewordB", "Nastystem" + rng.choice("xyzuvw")])
        if bad:
            words = [w + rng.choice(["%%%", "$$$"]) if rng.random() < 0.4 else w for w in words]
        rows.append((k, " ".join(words), f"s{k % 3}"))
        labels.append((k, int(not bad), int(toxic)))
    return docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("common", [8, 2048])
def test_search_is_exact(common, monkeypatch):
    monkeypatch.setattr(nearest, "COMMON", common)
    rng = np.random.default_rng(7)
    terms, k = 40, 5
    vectors = [(np.sort(rng.choice(terms, n, replace=False)), rng.integers(1, 9, n)) for n in rng.integers(1, 6, 500)]
    ids, weight = rng.permutation(500) + 1000, rng.random(terms) + 0.1
    weigh = lambda t, c: (1 + np.log(c)) * weight[t]
    unit = lambda t, c: weigh(t, c) / np.linalg.norm(weigh(t, c))
    index = nearest.BlockMaxIndex(ids, rng.integers(0, 2, 500), np.array([len(t) for t, _ in vectors]), np.concatenate([t for t, _ in vectors]), np.concatenate([c for _, c in vectors]), weigh, terms)
    dense = np.zeros((500, terms))
    for row, (t, c) in enumerate(vectors):
        dense[row, t] = unit(t, c)
    for t, c in vectors[:100]:
        places, scores = index.search(t, unit(t, c), k)
        q = np.zeros(terms)
        q[t] = unit(t, c)
        every = sorted(((-round(float(s), 12), int(i)) for s, i in zip(dense @ q, ids) if s > 0))[:k]
        assert [-s for s in scores] == pytest.approx([s for s, _ in every])
        assert [int(i) for i in index.ids[places]] == [i for _, i in every]


def grouped(n=600, terms=200):
    """Vectors of three kinds of examples that share few terms."""
    rng = np.random.default_rng(9)
    share = np.where(np.arange(terms) % 4 == np.arange(4)[:, None], 8.0, 0.1) / (1 + np.arange(terms) // 4)
    vectors = [(np.sort(rng.choice(terms, k, replace=False, p=share[r] / share[r].sum())), rng.integers(1, 9, k)) for k, r in zip(rng.integers(3, 12, n), rng.integers(0, 3, n))]
    ids, labels, weight = rng.permutation(n) + 1000, rng.integers(0, 2, n), rng.random(terms) + 0.1
    text = [np.concatenate([v[k] for v in vectors]) for k in (0, 1)]
    chunk = (ids.tobytes(), labels.astype(np.int8).tobytes(), *map(nearest._packed, (np.array([len(t) for t, _ in vectors]), *text)))
    return vectors, ids, nearest.Examples([chunk], weight, 0.5)


@pytest.mark.parametrize("share", [0.0, 0.07, 2.0])
def test_search_by_sections_is_exact(share, monkeypatch):
    monkeypatch.setattr(nearest, "SECTION", 60)
    monkeypatch.setattr(nearest, "BLOCK", 8)
    monkeypatch.setattr(nearest, "SHARE", share)
    vectors, ids, examples = grouped()
    index, units = examples.index(), [examples.unit(*v) for v in vectors]
    assert len(index.dense) > 2 and index.members.sum() == len(ids) and sorted(index.ids) == sorted(ids)
    dense = np.zeros((len(ids), 200))
    for row, (t, w) in enumerate(units):
        dense[row, t] = w
    for without in (None, ids.tolist()):
        for r, (places, scores) in enumerate(index.search_all(units, 7, without)):
            every = sorted((-round(float(x), 12), int(i)) for x, i in zip(dense @ dense[r], ids) if x > 0 and (without is None or i != ids[r]))[:7]
            assert [-x for x in scores] == pytest.approx([x for x, _ in every])
            assert [int(i) for i in index.ids[places]] == [i for _, i in every]
    # a query that shares terms with one kind alone visits less than all tables
    seen, index.dense = [], [type("Seen", (np.ndarray,), {"__rmatmul__": lambda self, x: seen.append(x.shape) or x @ self.view(np.ndarray), "__array_priority__": 99})(d.shape, d.dtype, d.copy().data) for d in index.dense]
    if share == 0.07:
        index.search_all(units, 7)
        assert seen and sum(n for n, _ in seen) < 0.8 * len(units) * len(index.dense)


def test_index_is_mapped_from_one_file(spark, docs, tmp_path, monkeypatch):
    """Workers map the large arrays of a file that one task makes, and are not sent the examples' terms."""
    vectors, ids, examples = grouped()
    units, path = [examples.unit(*v) for v in vectors], str(tmp_path / "x.index")
    examples.shelve(path)
    assert [p.name for p in tmp_path.iterdir()] == ["x.index"]
    mapped = nearest.Examples([], examples.weight, examples.base, path)
    assert mapped.votes(units, ids.tolist()) == examples.votes(units, ids.tolist())
    again = nearest.Examples([], examples.weight, examples.base, path)
    assert all((a == b).all() and (x == y).all() for (a, x), (b, y) in zip(again.rows(np.arange(50))[1], units)) and (again.rows(np.arange(50))[0] == ids[:50]).all()

    def is_mapped(x):
        import mmap

        while isinstance(x, np.ndarray) and x.base is not None:
            x = x.base
        return isinstance(x, mmap.mmap)

    assert all(is_mapped(getattr(mapped.index(), k)) for k in ("table", "postings", "posted", "slot", "terms", "counts"))

    d, labels = labelled(spark, docs, 300)
    with nearest.passing():
        model = nearest.fit(d, labels)
        head = model.shared.value
        assert head.path in nearest._MADE and not head.chunks
        scores = {r.doc_id: r.score for r in nearest.score(d, model).collect()}
    import os

    assert not os.path.exists(head.path) and head.path not in nearest._MADE
    # where no file can be made, each worker makes an index of its own, with equal scores
    monkeypatch.setattr(nearest.re, "match", lambda *_: None)
    alone = nearest.fit(d, labels)
    assert alone.shared.value.path is None and {r.doc_id: r.score for r in nearest.score(d, alone).collect()} == scores


def test_prefixes_are_looked_up_once(monkeypatch):
    text, offsets = np.frombuffer(b"prefixes unknownword " * 40 + b"prefixed of", np.uint8), np.array([0, 420, 851])
    terms = nearest.row_terms(text, offsets)[1]
    lookup = nearest.Lookup(np.setdiff1d(terms, nearest.span_hashes(text, np.array([9]), np.array([20]))))
    first, asked, find = nearest._counted(text, offsets, lookup), [], nearest.Lookup.find
    monkeypatch.setattr(nearest.Lookup, "find", lambda self, x: asked.append(len(x)) or find(self, x))
    again = nearest._counted(text, offsets, lookup)
    assert all((a == b).all() for a, b in zip(first, again)) and asked == [82, 40, 40, 40, 40]
    number = nearest.Lookup(lookup.vocabulary).find(terms)
    row = nearest.row_terms(text, offsets)[0]
    want, count = np.unique(np.stack([row, number])[:, number >= 0], axis=1, return_counts=True)
    assert (np.stack(first[:2]) == want).all() and (first[2] == count).all()


def test_counts_by_pieces(monkeypatch):
    data = [b"one two two three", b"", b"two " * 50, b"  ", b"three one"]
    text, offsets = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    lookup = nearest.Lookup(np.unique(nearest.row_terms(text, offsets)[1]))
    whole = nearest._counted(text, offsets, lookup)
    monkeypatch.setattr(nearest, "PIECE", 20)
    assert all((a == b).all() for a, b in zip(whole, nearest._counted(text, offsets, lookup))) and whole[2].max() == 50
    assert [len(x) for x in nearest._counted(text[:0], np.zeros(1, np.int64), lookup)] == [0, 0, 0]


def test_scored_text_is_sent_once(spark, docs):
    d, labels = labelled(spark, docs, 60)
    model = nearest.fit(d, labels)
    kept = nearest.score(d, model, columns=d.columns)
    assert "__text" not in kept._jdf.queryExecution().analyzed().toString()
    alone = {r.doc_id: r.score for r in nearest.score(d, model).collect()}
    assert {r.doc_id: r["__score"] for r in kept.collect()} == alone
    assert {r.doc_id: r["__score"] for r in nearest.score(d, model, columns=["doc_id"]).collect()} == alone


def test_postings_are_short():
    # 32 bits a posting, weights within what SLACK allows, the examples of a term in order
    rng = np.random.default_rng(8)
    sizes, terms = np.full(300, 30), np.concatenate([np.sort(rng.choice(3000, 30, replace=False)) for _ in range(300)])
    index = nearest.BlockMaxIndex(np.arange(300), rng.integers(0, 2, 300), sizes, terms, np.ones(9000, np.int64), lambda t, c: 10.0 ** (t % 7 - 5), 3000)
    assert index.postings.itemsize == 4 and index.postings.size
    for term in np.flatnonzero(np.diff(index.posted))[::50].tolist():
        got = np.zeros(index.blocks * nearest.BLOCK)
        index._sum_rare(np.array([term]), np.array([0.5]), got)
        want = [0.5 * 10.0 ** (term % 7 - 5) / index.norm[p] if term in terms[index.start[p] : index.start[p] + 30] else 0 for p in range(300)]
        assert np.count_nonzero(want) and got[:300] == pytest.approx(want, rel=nearest.SLACK / 2, abs=0)


def test_lookup():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000):
        known = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        asked = np.concatenate([known, known + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
        assert nearest.Lookup(known).find(asked).tolist() == [known.tolist().index(x) if x in known else -1 for x in asked.tolist()]


def test_toxicity(spark, docs):
    d, labels = labelled(spark, docs)
    model = nearest.fit(d, labels)
    rows = nearest.score(d.union(docs([(9001, None), (9002, ""), (None, "vilewordA"), (9003, "word " * 50_000)])), model).join(labels, "doc_id", "left").collect()
    fold = [r for r in rows if r.held_out and r.toxic is not None]
    assert sum(r.predicted == r.toxic for r in fold) >= 0.97 * len(fold) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[9001].score == by[9002].score and by[9003].predicted == 0 and by[None].predicted == 1 and not by[None].held_out
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    # no held-out label reaches the model
    flipped = labels.withColumn("toxic", F.when(nearest.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = nearest.fit(d, flipped)
    assert (again.vocabulary == model.vocabulary).all() and again.base == model.base
    empty = nearest.fit(d, labels.where("doc_id < 0"))
    assert nearest.score(d, empty).where("score <> 0 or predicted <> 0").count() == 0
    assert nearest.score(docs([]), model).count() == 0


def test_toxicity_uses_all_terms(spark, docs):
    """Cosines over every term of TERM_ROWS sampled texts, whatever the labels, by plain Python."""
    d, labels = labelled(spark, docs, n=300)
    rows = {r.doc_id: r for r in nearest.score(d, nearest.fit(d, labels)).collect()}
    texts = {r.doc_id: r.text.lower() for r in d.collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect()}

    def count(text):
        out = {}
        for w in text.split():
            for t in [(0, w)] + [(k, w[:k]) for k in nearest.PREFIXES if len(w) > k]:
                out[t] = out.get(t, 0) + 1
        return out

    counts = {k: count(t) for k, t in texts.items()}
    train = [k for k in texts if not rows[k].held_out]
    kept = {t for k in train for t in counts[k] if sum(t in counts[j] for j in train) >= nearest.TERM_ROWS}
    idf = {t: np.log(1 + len(texts) / (1 + sum(t in c for c in counts.values()))) for t in kept}

    distinct = list({texts[k]: k for k in train}.values())
    for t in kept:
        hits = [toxic[k] for k in distinct if t in counts[k]]
        idf[t] *= np.log2(2 + sum(hits) / max(1, len(hits) - sum(hits)))

    def unit(c):
        v = {t: (1 + np.log(n)) * idf[t] for t, n in c.items() if t in kept}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {t: x / norm for t, x in v.items()}

    vectors = {k: unit(c) for k, c in counts.items()}
    assert all(vectors.values()) and len(train) > 200
    base = sum(toxic[k] for k in distinct) / len(distinct)

    def vote(k, others):
        near = sorted((-round(sum(x * vectors[j].get(t, 0) for t, x in vectors[k].items()), 12), j) for j in others)[: nearest.NEIGHBOURS]
        near = [(-c, j) for c, j in near if c]
        return (sum(c * c * toxic[j] for c, j in near) + nearest.PRIOR * base) / (sum(c * c for c, _ in near) + nearest.PRIOR), [j for _, j in near]

    left_out = [vote(k, [j for j in train if j != k])[0] for k in train]
    curve = nearest.isotonic(np.array(left_out), np.array([float(toxic[k]) for k in train]))
    for k in texts:
        raw, near = vote(k, train)
        assert rows[k].neighbours == near, k
        assert rows[k].score == pytest.approx(float(np.interp(raw, *curve)), abs=1e-6), k
    assert {toxic[j] for r in rows.values() for j in r.neighbours} == {0, 1}


def test_equal_texts_with_unlike_labels(spark, docs):
    d, labels = labelled(spark, docs, n=200)
    twice = d.unionByName(d.withColumn("doc_id", F.col("doc_id") + 1000))
    other = labels.unionByName(labels.select((F.col("doc_id") + 1000).alias("doc_id"), "quality", F.lit(0).alias("toxic")))
    one, two = (nearest.fit(twice.repartition(n), other.repartition(n)) for n in (1, 3))
    assert one.base == two.base and (one.vocabulary == two.vocabulary).all() and (one.curve[1] == two.curve[1]).all()


def test_isotonic():
    x, y = nearest.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and 0 < y[0] and y[-1] < 1


class BruteEvidence:
    """Naive Bayes by the rules of the evidence module, in plain Python."""

    def __init__(self, texts, cls, classes):
        distinct = {}
        for k in sorted(cls):
            distinct[texts[k] or ""] = min(cls[k], distinct.get(texts[k] or "", cls[k]))
        sizes = [1 + sum(c == x for x in distinct.values()) for c in classes]
        total = sum(sizes)
        self.priors, self.weights, self.without = [x / total for x in sizes], {}, [0.0] * len(classes)
        counts = {}
        for t, c in distinct.items():
            for w in self.keys(t)[0]:
                counts.setdefault(w, [0] * len(classes))[classes.index(c)] += 1
        for w, own in counts.items():
            n = sum(own)
            z = max((x - n * p) / (n * p * (1 - p) + 1e-9) ** 0.5 for x, p in zip(own, self.priors))
            here = [(x + 2 * n / total) / (size + 2) for x, size in zip(own, sizes)]
            told, untold = ([math.log(f(h) / f(n / total)) for h in here] for f in (lambda x: x, lambda x: 1 - x))
            if n >= evidence.WORD_ROWS and z > evidence.TELLING and max(told) >= evidence.LEAST_WEIGHT:
                self.weights[w] = [a - b for a, b in zip(told, untold)]
                self.without = [a + b for a, b in zip(self.without, untold)]

    def keys(self, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        distinct = len(set(words)) + 1 + (text[:1] in tuple(" \t\n\x0b\f\r"))
        sign = f"^:{20 * distinct // (len(words) + 1)}:{math.floor(math.log(len(words) + 1) / math.log(4) + 1e-12)}"
        return {*words, sign}, len(words)

    def of(self, text):
        keys, n = self.keys(text or "")
        sums = [sum(self.weights[w][k] for w in keys if w in self.weights) + x for k, x in enumerate(self.without)]
        return (sums if n else [0.0] * len(sums)), n

    def posteriors(self, text):
        logits = [math.log(p) + evidence.DAMPING * e for p, e in zip(self.priors, self.of(text)[0])]
        parts = [math.exp(x - max(logits)) for x in logits]
        return [x / sum(parts) for x in parts]


def test_mixing(spark, docs):
    d, labels = labelled(spark, docs)
    d = d.unionByName(docs([(9001, None), (9002, " lead sun"), (9003, "")]))
    targets = {"prose": 0.6, "junk": 0.3, "toxic": 0.1}
    rows = {r.doc_id: r for r in mixing.mix(d, mixing.fit_domains(d, labels), targets).collect()}
    texts = {r.doc_id: r.text for r in d.collect()}
    brute = BruteEvidence(texts, {r.doc_id: "toxic" if r.toxic else "prose" if r.quality else "junk" for r in labels.collect()}, mixing.DOMAINS)
    ids = sorted(texts)
    tokens, p = np.array([brute.of(texts[k])[1] for k in ids]), np.array([brute.posteriors(texts[k]) for k in ids])
    assert len(brute.weights) > 3 and [rows[k].n_tokens for k in ids] == tokens.tolist()
    assert np.abs(p - [[rows[k][f"p_{c}"] for c in mixing.DOMAINS] for k in ids]).max() < 1e-9
    rate = np.array([rows[k].rate for k in ids])
    got = (rate * tokens) @ p
    assert np.abs(got / got.sum() - [0.6, 0.3, 0.1]).max() < 1e-3 and rate.min() >= 0
    # the same steps for each document by itself
    have = tokens @ p
    want = np.array([0.6, 0.3, 0.1]) * have[0] / 0.6
    weight = have.sum() / have
    gram = (p * tokens[:, None]).T @ p / have.sum()
    eta, r = 1 / (np.linalg.eigvalsh(np.sqrt(weight)[:, None] * gram * np.sqrt(weight)).max() + mixing.RIDGE), np.ones(len(ids))
    for _ in range(mixing.STEPS):
        now = (r * tokens) @ p
        if (np.abs(now - want) <= mixing.CLOSE * want).all():
            break
        r = np.maximum(0, r - eta * (p @ ((now - want) / have.sum() * weight) + mixing.RIDGE * (r - 1)))
    assert np.abs(r - rate).max() < 0.02
    model = mixing.fit_domains(d, labels.where("doc_id < 0"))
    same = mixing.mix(docs([(1, None), (1, None), (None, ""), (2, "a b")]), model, mixing.TARGETS).collect()
    assert len(same) == 4 and mixing.mix(docs([]), model, mixing.TARGETS).count() == 0
    mean = spark.range(20_000).select(F.avg(mixing.draw(F.lit(1.3), F.col("id"))).alias("m")).first().m
    assert abs(mean - 1.3) < 0.02


def test_large_evidence_is_not_broadcast(spark, docs, monkeypatch):
    d, labels = labelled(spark, docs, n=200)
    model = mixing.fit_domains(d, labels)
    small = {r.doc_id: r for r in evidence.weigh(d, model).collect()}
    monkeypatch.setattr(evidence, "BROADCAST_WORDS", 0)
    for r in evidence.weigh(d, model).collect():
        assert [r[f"e{k}"] for k in range(3)] == pytest.approx([small[r.doc_id][f"e{k}"] for k in range(3)])


def test_cells_of_many_domains():
    assert mixing.cell_grid(3) == mixing.GRID and math.comb(mixing.cell_grid(12) + 11, 11) <= mixing.CELLS


def test_rates_that_cannot_be_reached_warn():
    with pytest.warns(UserWarning, match="converge"):
        mixing.project(np.array([10.0]), np.array([[5.0, 5.0]]), np.full((1, 2, 2), 2.5), np.array([1.0, 9.0]))


def brute_sites(texts, groups, good, slope, shift, brute):
    clip = lambda e: max(-sites.REACH, min(sites.REACH, e[0] - e[1]))
    words = {k: slope * clip(brute.of(t)[0]) + shift for k, t in texts.items()}
    p = {k: 1 / (1 + math.exp(-w)) for k, w in words.items()}
    middle = sum(p.values()) / len(p)

    def pull(members, towards):
        inner = sum(len(m) * towards[g] * (1 - towards[g]) for g, m in members.items())
        outer = sum(len(m) * (sum(p[k] for k in m) / len(m) - towards[g]) ** 2 for g, m in members.items())
        return sites.MOST_PULL if not inner or not outer else min(sites.MOST_PULL, max(sites.LEAST_PULL, inner / outer - 1))

    def by(key):
        out = {}
        for k in texts:
            out.setdefault(key(k), []).append(k)
        return out

    hosts, paths = by(lambda k: groups[k][0]), by(lambda k: groups[k])
    strength = pull(hosts, dict.fromkeys(hosts, middle))
    host_prior = {h: (sum(p[k] for k in m) + strength * middle) / (len(m) + strength) for h, m in hosts.items()}
    above = {g: host_prior[g[0]] for g in paths}
    strength = pull(paths, above)
    path_prior = {g: (sum(p[k] for k in m) + strength * above[g]) / (len(m) + strength) for g, m in paths.items()}
    odds = lambda x: math.log(x / (1 - x))
    return {k: (host_prior[groups[k][0]], path_prior[groups[k]], 1 / (1 + math.exp(-(odds(path_prior[groups[k]]) - odds(middle) + words[k])))) for k in texts}


def test_site_quality(spark, docs):
    d, labels = labelled(spark, docs)
    fold = labels.where("doc_id % 3 <> 0")
    model = sites.fit_quality(d, fold)
    rows = {r.doc_id: r for r in sites.site_quality(d, model).collect()}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    unseen = [k for k in quality if k % 3 == 0]
    assert sum((rows[k].score >= 0.5) == (quality[k] == 1) for k in unseen) >= 0.95 * len(unseen)
    texts, groups = {r.doc_id: r.text for r in d.collect()}, {r.doc_id: (r.source, r.lang) for r in d.collect()}
    brute = BruteEvidence(texts, {k: "good" if q else "bad" for k, q in quality.items() if k % 3}, sites.CLASSES)
    want = brute_sites(texts, groups, quality, model.slope, model.shift, brute)
    for k, r in rows.items():
        assert (r.host_prior, r.path_prior, r.score) == pytest.approx(want[k], abs=1e-6), k
    # slope and shift are where the penalised likelihood is flat
    x = np.array([round(brute.of(texts[k])[0][0] - brute.of(texts[k])[0][1]) for k in quality if k % 3], float)
    y = np.array([quality[k] for k in quality if k % 3])
    miss = 1 / (1 + np.exp(-np.clip(model.slope * x + model.shift, -40, 40))) - y
    assert abs((miss * x).sum() + 0.1 * (model.slope - 0.5)) < 0.1 and abs(miss.sum() + 1e-3 * model.shift) < 0.1
    # a sparse site stays near the middle: one bad document moves its path less than its own mean
    odd = d.union(docs([(5000, "x%%% y$$$ z%%% the%%% of$$$ and%%%", "lonely")]))
    scored = sites.site_quality(odd, model)
    lonely, mean = scored.where("doc_id = 5000").first(), scored.agg(F.avg("path_prior")).first()[0]
    assert abs(lonely.path_prior - mean) < 0.35
    edge = sites.site_quality(docs([(1, None, None), (None, "", "s"), (1, None, None)]), model).collect()
    assert len(edge) == 3 and all(0 < r.score < 1 for r in edge)
    assert sites.site_quality(docs([]), model).count() == 0
    assert evidence.weigh(docs([(1, "")]), model.evidence).first().e0 == 0


def test_pipeline(spark, tmp_path):
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs, seen = source, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        seen.append(docs)
        if k < 4:
            assert docs.columns == source.columns
    from flakespark.llm.jaccard import jaccard_join

    kept = {r.doc_id for r in seen[1].select("doc_id").collect()}
    joined = {r.doc_id: r.component_id for r in jaccard_join(seen[0]).collect()}
    assert kept == {k for k, c in joined.items() if k == c}
    assert seen[2].count() <= seen[1].count() and seen[2].agg(F.sum(F.length("text"))).first()[0] <= seen[1].agg(F.sum(F.length("text"))).first()[0]
    assert seen[4].select("doc_id").distinct().count() == seen[3].select("doc_id").distinct().count()
    assert {f.__name__ for _, f in corpus_pipeline.STAGES} == {"toxicity", "near_copies", "repeated_strings", "mixture", "packed"}
    rerun = corpus_pipeline.run(spark, FOLDER)
    assert rerun.count() == docs.count()
