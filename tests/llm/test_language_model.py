from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagebrook.llm import language_model as lm

DOC = "doc_id long, text string, score double, row long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def made(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        at, text = rng.randrange(60), []
        for _ in range(rng.choice([1, 5, 40])):
            text.append(words[at] if rng.random() > 0.02 else f"rare{rng.randrange(10**6)}")
            at = (at * 7 + rng.choice([1, 1, 1, 2, 30])) % 60
        rows.append((i, rng.choice([" ", "\n", "  "]).join(text), 0.0, 0))
    return rows


HARD = [(None, "of no id", 0.0, 0), (7000, None, 0.0, 0), (7001, "", 0.0, 0), (7002, " \t\n", 0.0, 0), (7003, "ÀB Cd E\x1cF É", 0.0, 0), (7004, "w1 w2 w3", 0.0, 0), (7004, "w1 w2 w3", 0.0, 0), (7005, "w1 w2 " * 30_000, 0.0, 0)]


def learnt(model):
    """Averaged tables, and the parent's probabilities, by hashes."""
    pairs, words = {}, {}
    for r in model.pairs.collect():
        x = lm._unpack(r.data)
        means = x["mean"] / model.kept if r.kind == lm.PAIRS else np.ones(len(x["u"]))
        counts = x.get("c", np.ones(len(x["u"]), int))
        for u, w, c, t in zip(x["u"].tolist(), x["w"].tolist(), counts.tolist(), means.tolist(), strict=True):
            assert (u, w) not in pairs
            pairs[u, w] = (c, t)
    for r in model.words.collect():
        x = lm._unpack(r.data)
        for w, n, mean in zip(x["w"].tolist(), x["n"].tolist(), x["mean"].tolist(), strict=True):
            words[w] = (n, mean / model.kept + model.even)
    return pairs, words


@pytest.mark.parametrize("bucket", [lm.BUCKET, 1500, 150])
def test_against_sums_over_tokens(spark, bucket):
    rows = made(400) + HARD[:-1]
    docs = spark.createDataFrame(rows, DOC)
    model = lm.learn(spark, docs.where(~lm.held_out()), bucket=bucket)
    assert bucket != 150 or len(model.totals.dealing.spread) > 0
    pairs, words = learnt(model)
    train = [tokens(t) for i, t, *_ in rows if not held(i)]
    counts = Counter(w for t in train for w in t)
    both = Counter(p for t in train for p in zip([0, *t[:-1]], t, strict=True))
    total = sum(counts.values())
    assert model.tokens == total and model.totals.words == len(counts)
    assert sorted(n for n, _ in words.values()) == sorted(counts.values())
    assert sorted(c for c, _ in pairs.values()) == sorted(both.values())
    assert all(1 <= t <= c for c, t in pairs.values())
    # Both levels are distributions over all words and one that is unknown.
    assert abs(sum(p for _, p in words.values()) + model.even - 1) < 1e-6
    x, customers, tables = model.totals, Counter(), defaultdict(float)
    for (u, _), (c, t) in pairs.items():
        customers[u] += c
        tables[u] += t

    def predicted(u, w):
        back = (x.strength + x.discount * tables[u]) / (x.strength + customers[u])
        c, t = pairs.get((u, w), (0, 0))
        return (c - x.discount * t) / (x.strength + customers[u]) + back * (words[w][1] if w in words else model.even)

    for u in list(customers)[:20]:
        assert abs(sum(predicted(u, w) for w in words) + predicted(u, 1) - 1) < 1e-5

    import pyarrow as pa

    def hashes(text):
        u, w, _ = lm._tokens(pa.array([text or ""]))
        return list(zip(u.tolist(), w.tolist(), strict=True))

    expected = sorted((i if i is not None else -1, len(tokens(t)), sum(w in counts for w in tokens(t)), total, round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in tokens(t)), 5), round(sum(math.log10(predicted(u, w)) for u, w in hashes(t)), 3)) for i, t, *_ in rows)
    out = lm.score_texts(spark, docs, model).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 3)) for r in out)
    assert [g[:4] for g in got] == [e[:4] for e in expected]
    assert np.allclose([g[4:] for g in got], [e[4:] for e in expected], atol=2e-3)


def test_predicts_better_than_counts(spark):
    rows = made(500) + HARD
    out = lm.score(spark, spark.createDataFrame(rows, DOC), bucket=2000).collect()
    assert len(out) == len(rows) and all(r.held_out == held(r.doc_id) for r in out)
    unseen = [r for r in out if r.held_out]
    assert len(unseen) > 50 and sum(r.score for r in unseen) > 0.75 * sum(r.base_score for r in unseen)
    assert {r.n_tokens for r in out if r.doc_id in (7000, 7001, 7002)} == {1}
    assert len({(r.score, r.n_tokens) for r in out if r.doc_id == 7004}) == 1


def test_reruns_agree(spark):
    docs = spark.createDataFrame(made(100), DOC)
    a, b = ([(r.doc_id, r.score) for r in lm.score(spark, d, bucket=700).orderBy("doc_id").collect()] for d in (docs, docs.repartition(7)))
    assert np.allclose([x[1] for x in a], [x[1] for x in b], rtol=1e-6)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([r for r in made(60) if held(r[0])], DOC)
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(spark, docs).collect()} == {(0, 0, 0.0, 0.0)}
    assert lm.score(spark, docs.limit(0)).collect() == []
    one = lm.score(spark, spark.createDataFrame([(2, "only", 0.0, 0)], DOC)).first()
    assert (one.n_tokens, one.n_known, one.train_tokens) == (2, 2, 2) and 0 > one.score > -1


def test_tables_follow_the_posterior():
    """Drawn numbers of tables against all seatings of five customers."""
    d, strength, p, others, n = 0.6, 1.5, 0.05, 3, 5

    def partitions(k):
        if k == 0:
            return [[]]
        return [q for s in partitions(k - 1) for q in [*[[*s[:i], s[i] + 1, *s[i + 1 :]] for i in range(len(s))], [*s, 1]]]

    weight = np.zeros(n + 1)
    for s in partitions(n):
        shares = math.prod(math.prod(m - d for m in range(1, size)) for size in s)
        weight[len(s)] += shares * math.prod((strength + d * (others + k)) * p for k in range(len(s)))
    many = 40_000
    args = np.full(many, n), np.full(many, math.log(p)), np.full(many, others)
    drawn = lm.seat(*args, d, strength, lm.stirling(d), np.random.default_rng(1))
    assert np.abs(np.bincount(drawn, minlength=n + 1) / many - weight / weight.sum()).max() < 0.01
    assert sum(1 for _ in itertools.islice(partitions(5), 100)) == 52


def test_tables_of_frequent_dishes():
    c = np.array([1, 2, lm.HALL, lm.HALL + 1, 10 * lm.HALL, 10**7 + 3])
    t = lm.seat(c, np.full(6, math.log(1e-3)), np.full(6, 50), 0.7, 1.0, lm.stirling(0.7), np.random.default_rng(2))
    assert t[0] == 1 and (t >= -(-c // lm.HALL)).all() and (t <= c).all()


def test_other_columns_and_model_alone(spark):
    docs = spark.createDataFrame(made(30), DOC).withColumn("held_out", F.lit("x")).withColumn("n_tokens", F.lit(-1))
    assert lm.score(spark, docs).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
