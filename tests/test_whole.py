"""Queries over whole tables against plain Python."""

import re

import numpy as np
import pyarrow.parquet as pq

from flakespark.operators import vectors
from flakespark.plans import catalog

FOLDER = "/root/testdata/sf0.001"
MARKS = "{}()[];,.<>=!&|+-*/^%@#"


def embeddings():
    return pq.read_table(f"{FOLDER}/embeddings.parquet").to_pylist()


def test_cosine_pairs_of_a_label(spark):
    rows = embeddings()
    want = {(a["label"], a["vec_id"], b["vec_id"]) for a in rows for b in rows if a["label"] == b["label"] and a["vec_id"] < b["vec_id"]}
    by = {r["vec_id"]: np.array(r["embedding"], float) for r in rows}
    got = catalog.queries()["cosine_pairs"](spark, FOLDER).collect()
    assert {(r.label, r.a, r.b) for r in got} == want and len(got) == len(want)
    assert any(a // 100 != b // 100 for _, a, b in want)
    for r in got[::50]:
        x, y = by[r.a], by[r.b]
        assert abs(r.cosine - x @ y / np.sqrt((x @ x) * (y @ y))) < 1e-5


def test_linkage_of_a_label(spark):
    # ids on both sides of 500 hold the same vectors
    rows = [(k, k % 2, [1.0, 0.0] if k % 4 < 2 else [0.0, 1.0]) for k in range(490, 510)]

    def read(*_):
        return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")

    kept, catalog.read = catalog.read, read
    try:
        got = {r.vec_id: (r.label, r.cluster_id) for r in catalog.average_linkage(spark, FOLDER).collect()}
    finally:
        catalog.read = kept
    assert len(got) == len(rows)
    for k, label, v in rows:
        for j, other, w in rows:
            assert (got[k] == got[j]) == (label == other and v == w)


def test_tokens_of_all_documents(spark):
    def plain(text):
        out, word = [], ""
        for c in text or "":
            if re.match(r"\s", c) or c in MARKS:
                out += [word] if word else []
                word = ""
                out += [c] if c in MARKS else []
            else:
                word += c
        return out + ([word] if word else [])

    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()}
    got = {r.doc_id: (r.tokens, r.n) for r in catalog.queries()["tokenize"](spark, FOLDER).collect()}
    assert got == {k: (" ".join(plain(t)), len(plain(t))) for k, t in docs.items()}
    assert any(t and not t.isascii() for t in docs.values())


def test_union_of_whole_sets(spark):
    docs = pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()
    got = {r.doc_id for r in catalog.queries()["set_operations"](spark, FOLDER).collect()}
    assert {d["doc_id"] for d in docs if d["lang"] == "en"} <= got


def test_linkage_of_a_large_label(spark):
    # 5,200 vectors of one label, in 520 groups of ten that stand apart, and one without a vector
    x = np.repeat(np.random.default_rng(1).normal(size=(520, 48)), 10, axis=0)
    x += np.random.default_rng(2).normal(size=x.shape) / 50
    rows = [(k, 1, v) for k, v in enumerate(x.tolist())] + [(len(x), 1, None)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = {r.vec_id: r.cluster_id for r in vectors.linkage_groups(frame, ["label"], "vec_id", "embedding", 0.2).collect()}
    assert got == {k: k // 10 for k in range(len(rows))}


def test_linkage_without_a_matrix():
    rng = np.random.default_rng(3)
    for n in range(1, 60):
        x = rng.normal(size=(n, 1 + n % 7))
        x[rng.integers(0, n, n // 3)] = x[rng.integers(0, n, n // 3)]
        x[0] *= n % 5 > 0
        norm = np.linalg.norm(x, axis=1)
        x /= np.where(norm > 0, norm, 1)[:, None]
        for threshold in (0.05, 0.5, 1.2):
            assert (vectors.average_linkage_of(x, threshold) == vectors.average_linkage(1 - x @ x.T, threshold)).all()


def test_cosine_pairs_of_tiles(spark, monkeypatch):
    # pairs in and across tiles, odd vectors as SQL's functions have them
    monkeypatch.setattr(vectors, "TILE", 8)
    nan, rng = float("nan"), np.random.default_rng(4)
    odd = [None, [], [0.0, 0.0], [1.0, 2.0, 3.0], [1.0, None], [nan, 1.0], [1e-200, 0.0]]
    rows = [(k, k % 2, v) for k, v in enumerate([*rng.normal(size=(40, 2)).tolist(), *odd, *odd])] + [(None, 1, [1.0, 2.0]), (99, None, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    pairs = vectors.cosine_pairs(frame, ["label"], "vec_id", "embedding")
    assert "zip_with" not in pairs._jdf.queryExecution().optimizedPlan().toString()  # some 10 microseconds a pair
    two = frame.alias("x").join(frame.alias("y"), "label").where("x.vec_id < y.vec_id")
    want = two.select("label", "x.vec_id", "y.vec_id", vectors.cosine("x.embedding", "y.embedding"))
    assert sorted(map(str, map(tuple, pairs.collect()))) == sorted(map(str, map(tuple, want.collect())))
