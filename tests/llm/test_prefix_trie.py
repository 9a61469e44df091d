from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sagebrook.llm import prefix_trie

TURN = "conv_id long, turn long, role string, text string, conv string, n long"


def brute(rows):
    """Every node from a dictionary of all prefixes."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), tie, (role, text)))
    own = {c: [t[2] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        opens = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        turns = tuple(own.get(opens, [])[:h] + turns[h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = sum(saved[x] for x in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(p)) for p, m in members.items())


def found(spark, rows, **kw):
    out = prefix_trie.trie(spark, spark.createDataFrame(rows, TURN), **kw).collect()
    return sorted(tuple(r[c] for c in prefix_trie._OUT) for r in out)


def made(seed, n, vocabulary, longest=6):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(vocabulary), "x", 1) for c in range(n) for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("shard", [prefix_trie.SHARD, 600, 3000])
def test_against_all_prefixes(spark, shard):
    rows = made(1, 250, ["a", "bb", "ccc"]) + made(2, 20, ["é", "日本", "🙂"], 40)
    rows += [(1000 + c, t, "user", "same", "x", 1) for c in range(60) for t in range(3)]  # copies over many shards
    random.Random(3).shuffle(rows)
    assert found(spark, rows, shard=shard) == brute(rows)


def test_depths_beyond_what_ranges_look_at(spark, monkeypatch):
    long = [(c, t, "user", "x" if t < 300 else f"{c % 7}", "x", 1) for c in range(5, 40) for t in range(305 + c % 3)]
    assert found(spark, long, shard=40_000) == brute(long)


def test_nulls_ties_and_turnless(spark):
    rows = [
        (None, 0, "user", "of no conversation", "x", 1), (1, None, "user", "null turn first", "x", 1), (1, 0, None, "null role", "x", 1),
        (1, 1, "user", None, "x", 1), (1, 1, "user", "tie", "x", 1), (1, 1, "user", "tie", "x", 1), (-205, 0, "user", "negative", "x", 1),
        (-200, 0, "user", "opens", "x", 1), (104, 0, "", "", "x", 1), (3, 0, "a", "bc", "x", 1), (4, 0, "ab", "c", "x", 1), (7, 0, "user", "word " * 50_000, "x", 1),
    ]
    rows += [(c, 0, "user", "short", "x", 1) for c in range(500, 520)]  # no turn is left where h is more than there is
    assert found(spark, rows) == brute(rows)
    assert any(r[1] == 0 and r[7] != prefix_trie._EMPTY for r in found(spark, rows))


def test_empty(spark):
    assert found(spark, []) == []
    assert [r[:2] for r in found(spark, [(5, 0, "user", "x", "y", 1)])][:1] == [(5, 0)]


def test_repeated_calls_agree(spark):
    rows = made(9, 100, ["a", "b"])
    assert found(spark, rows, shard=500) == found(spark, rows[::-1], shard=5000)
