from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sagebrook.llm import buckets, common, embedding_dedup, minhash
from sagebrook.llm.common import Workspace, components
from sagebrook.llm.shingles import shingle_sets, token_hashes

DOCS = "doc_id long, text string, digest string, component string, node int"


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(ids, texts):
    sets, parent = sets_of(texts), {i: i for i in ids if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and None not in (ids[a], ids[b]) and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(ids[a]), root(ids[b])
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i), i == root(i)) for i, s in zip(ids, sets, strict=True) if i is not None)


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    texts = []
    for _ in range(n):
        words = rng.choices(vocabulary, k=rng.choice([1, 3, 5, 6, 30, 60]))
        for _ in range(rng.choice([1, 1, 3])):
            own = list(words)
            for _ in range(rng.choice([0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n", "\t "]).join(own))
    return texts


def test_shingles_match_python():
    texts = [None, "", " \t\x0b", "A b", "é É x y z", "a b c d e f a b c d e", "x" * 200_000, "one " * 7, " a\x0cb\x85c d e "] + corpus(2, 30)
    for chunked in (pa.array(texts), pa.array(["skip", *texts]).slice(1), pa.array(texts, pa.large_string())):
        assert [len(s) for s in shingle_sets(chunked)] == [len(s) for s in sets_of(texts)]
    a, b, c = shingle_sets(pa.array(["THE cat sat on mats", "the Cat sat on mats", "the cat sat on mat"]))
    assert (a == b).all() and a != c
    assert len(shingle_sets(pa.array([], pa.string()))) == 0 and len(shingle_sets(pa.array([None], pa.string()))[0]) == 0


def test_tokens():
    _, at, kinds = token_hashes(pa.array(["a1!! b", None, "", "é***"]))
    assert np.diff(at).tolist() == [4, 0, 0, 2] and kinds.tolist() == [17, 33, 50, 17, 18, 51]


def test_matches_brute_force(spark):
    texts = corpus()
    ids = list(range(1000, 1000 + len(texts)))
    random.Random(3).shuffle(ids)
    ids, texts = [*ids, 1, 2, 3], [*texts, None, "", texts[0]]
    df = spark.createDataFrame([(i, t, "x", "y", 7) for i, t in zip(ids, texts, strict=True)], DOCS).repartition(3)
    assert sorted(map(tuple, minhash.near_duplicates(spark, df).collect())) == brute(ids, texts)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "UNIT_SHINGLES", 400)
    monkeypatch.setattr(buckets, "UNIT", 30)
    texts = corpus(5, 40)
    base = ["w%d" % i for i in range(60)]
    for i in range(60):
        texts.append(" ".join([*base[: i % 50], f"n{i}", *base[i % 50 + 1 :]]))
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(spark, df).collect())) == brute(ids, texts)


def test_repeated_and_nameless_rows(spark):
    text = " ".join("abcdefghij")
    df = spark.createDataFrame([(5, text), (5, text), (2, text), (None, text), (None, "other words"), (9, None)], "doc_id long, text string")
    rows = sorted(map(tuple, minhash.near_duplicates(spark, df).collect()), key=repr)
    assert rows == sorted([(5, 6, 2, False), (5, 6, 2, False), (2, 6, 2, True), (None, 6, 2, False), (None, 1, None, False), (9, 0, 9, True)], key=repr)


def test_empty_tables(spark):
    assert minhash.near_duplicates(spark, spark.createDataFrame([], DOCS)).collect() == []
    assert embedding_dedup.near_duplicates(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_components_of_a_chain(spark):
    ws = Workspace(spark, "test")
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in components(ws, edges).collect()}
    assert found == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_components_with_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(common, "HEAVY", 10)
    ws = Workspace(spark, "test")
    edges = [(i, i + 1) for i in range(20)] + [(500, i) for i in range(200, 260)] + [(i, i + 300) for i in range(200, 260)]
    found = {r.node: r.component for r in components(ws, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(21)} | {i: 200 for i in [500, *range(200, 260), *range(500, 560)]}


def test_estimate_of_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 800, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:600], rng.integers(0, 2**63, 200, dtype=np.uint64)]))
    same = (minhash.signature(a) == minhash.signature(b)).mean()
    assert same == pytest.approx(0.6, abs=0.12)


def vectors(seed=1, n=300):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for _ in range(n):
        v = rng.standard_normal(16)
        for _ in range(rng.choice([1, 1, 2, 4])):
            rows.append((i, (v + rng.standard_normal(16) * rng.choice([0, 0.05, 0.2])).astype(np.float32).tolist(), int(rng.integers(0, 2))))
            i += 1
    return rows


def brute_vectors(rows):
    good = [(i, np.array(v, float), g) for i, v, g in rows if g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, parent = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, v, g) in enumerate(good):
        for j, w, h in good[:a]:
            if g == h and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                n[i] += 1
                n[j] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, n[i], root(i), i == root(i)) for i, _, _ in rows)


def test_embeddings_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    monkeypatch.setattr(buckets, "UNIT", 60)
    rows = vectors()
    v = rows[0][1]
    rows += [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] + v[1:], 1), (9003, [None] + v[1:], 1), (9004, v, None), (9005, v[:8], rows[0][2]), (9006, [], 1), (9007, [float("inf")] + v[1:], 1)]
    rows += [(9100 + k, v, rows[0][2]) for k in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("component", F.lit("x"))
    assert sorted(map(tuple, embedding_dedup.near_duplicates(spark, df).collect())) == brute_vectors(rows)


def test_shape_grows_with_the_label_and_stays_bounded():
    assert embedding_dedup.shape(10)[1] < embedding_dedup.shape(100_000)[1] and embedding_dedup.shape(0)[1] == embedding_dedup.FEWEST
    assert embedding_dedup.shape(10**12) == embedding_dedup.shape(10**14) and embedding_dedup.shape(10**14)[0] < 130
    assert embedding_dedup.chance(0.1) > embedding_dedup.chance(1.0) > 0


@pytest.mark.parametrize("cosine", [0.931, 0.95])
def test_recall_of_embeddings_near_the_threshold(cosine):
    """Share of pairs at a cosine that share a bucket and pass by their signs, for a small and for a
    very large label."""
    rng = np.random.default_rng(3)
    a, b = (rng.standard_normal((3000, 64)) for _ in range(2))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    likely = embedding_dedup.alike(*(np.frombuffer(b"".join(embedding_dedup.signs(x)), np.uint64).reshape(len(x), -1) if i % 2 == 0 else x for i, x in enumerate((a, a, b, b))))
    for size in (10_000, 10**9):
        shared = (embedding_dedup.buckets(a, *embedding_dedup.shape(size)) == embedding_dedup.buckets(b, *embedding_dedup.shape(size))).any(axis=1)
        assert (likely & shared).mean() >= 0.995


@pytest.mark.parametrize("n", [8, 60, 400])
def test_recall_of_texts_near_the_threshold(n):
    """Sets of n shingles at a similarity of just 0.75 share a band and pass by their sketches; at
    0.5 few pass."""
    rng = np.random.default_rng(4)

    def pair(common):
        every = rng.integers(0, 2**63, 2 * n - common, dtype=np.uint64)
        return np.sort(every[:n]), np.sort(every[n - common :])

    def found(common):
        out = []
        for _ in range(400):
            x, y = (minhash.signature(s) for s in pair(common))
            words = [np.frombuffer(minhash.sketch(s), np.uint64)[None] for s in (x, y)]
            size = np.array([n])
            out.append(bool((minhash.bands(x) == minhash.bands(y)).any() and minhash.alike(words[0], size, words[1], size)[0]))
        return np.mean(out)

    assert found(-(-6 * n // 7)) >= 0.995
    if n > 8:
        assert found(2 * n // 3) < 0.2


def test_half_alike_chains_are_cut():
    """Links of a chain of texts, each at 0.5 to the next, don't connect it."""
    rng = np.random.default_rng(5)
    ring = rng.integers(0, 2**63, 30_000, dtype=np.uint64)
    sketches = np.stack([np.frombuffer(minhash.sketch(minhash.signature(ring[100 * i : 100 * i + 300])), np.uint64) for i in range(250)])
    sizes = np.full(len(sketches), 300)
    assert minhash.alike(sketches[1:], sizes[1:], sketches[:-1], sizes[:-1]).mean() < 0.05
