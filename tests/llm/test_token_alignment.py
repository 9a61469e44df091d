from __future__ import annotations

import hashlib
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sagebrook.llm import token_alignment

DOC = "doc_id long, text string, n_a long, row long"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tokens():
    """Ids and bytes of both tokenizers' tokens, of whole texts."""
    lib_a, lib_b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    lib_a.encode_special_tokens = True
    # The byte alphabet, from single-byte tokens: what each byte of a text is written as.
    byte = {}
    for b in range(256):
        byte[chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b else chr(256 + len([x for x in range(b) if not (33 <= x <= 126 or 161 <= x <= 172 or 174 <= x)]))] = b

    def run(text):
        a = lib_a.encode(" " + text, add_special_tokens=False)
        b = lib_b.encode(text)
        in_b = [lib_b.id_to_piece(i) for i in b]
        in_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and p.endswith(">") else p.replace("▁", " ").encode() for p in in_b]
        return a.ids, [bytes(byte[c] for c in t) for t in a.tokens], b, in_b

    return run


def brute(rows, tokens):
    docs = []
    for doc_id, text, *_ in rows:
        links, groups, n = [], [], (0, 0)
        if text:
            a, ba, b, bb = tokens(text)
            if b"".join(ba) == b"".join(bb) == (" " + text).encode():
                ea, eb, n = np.cumsum(list(map(len, ba))).tolist(), np.cumsum(list(map(len, bb))).tolist(), (len(a), len(b))
                links = [(a[i], b[eb.index(e)]) for i, e in enumerate(ea) if e in set(eb)]
                last = 0
                for cut in [e for e in ea if e in set(eb)]:
                    groups.append(",".join(str(i) for i, e in zip(a, ea, strict=True) if last < e <= cut) + "|" + ",".join(str(i) for i, e in zip(b, eb, strict=True) if last < e <= cut))
                    last = cut
        docs.append((doc_id, n, groups, links))
    count = Counter(x for d in docs for x in d[3])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return sorted(
        (d if d is not None else -1, n[0], n[1], len(g), len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, n, g, x in docs
    )


def found(spark, rows, **kw):
    out = token_alignment.align(spark, spark.createDataFrame(rows, DOC), A, B, **kw).collect()
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in out)


HARD = [
    None, "", " ", "  ", "a", " a", "a ", "  a  b ", "a\nb", "a \n b", "\ta\t\tb", "a\x00b", "a▁b", "▁", "x ▁ y", "ﬁ ½ ｆ", "é é", "日本語 テキスト", "🙂🙃 👨‍👩‍👧", "<|endoftext|> <s> </s> <unk>", "a<|endoftext|>b",
    "<0x41> 0x41", "it's don't 'tis", "1234567 12,345.67", "\xa0x\xa0 y", "​ ﻿ z", "a\x1cb \x1d c \x85 d", "==== ---- ____", "A  B   C    D", "word " * 300, "x" * 5000, "é" * 2000, "мир " * 50, " a 　 b", "a b\r\n c",
]


def test_against_whole_texts(spark, tokens):
    rows = [(i, t, 0, 0) for i, t in enumerate(HARD)] + [(3, "a b", 0, 0), (3, "a b", 0, 0), (None, "of no id", 0, 0)]
    rng = random.Random(5)
    alphabet = [" ", " ", "a", "é", "\n", "▁", "x1", "  ", "'s", "🙂", "日", "\t", "the", ".", "\xa0", "\x1c", "\x85"]
    rows += [(1000 + i, "".join(rng.choices(alphabet, k=rng.randint(1, 30))), 0, 0) for i in range(300)]
    expected = brute(rows, tokens)
    assert found(spark, rows) == expected
    assert found(spark, rows, held=20) == expected  # most pairs come from the join
    assert found(spark, rows, held=0) == expected


def test_given_documents(spark, sf_dir, tokens):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, 0, 0) for r in docs.collect() if len(r.text or "") < 3000]
    assert found(spark, rows) == brute(rows, tokens)


def test_very_long_and_empty(spark, tokens):
    long = [(1, "verylongword" * 20_000, 0, 0), (2, "some words of prose, " * 20_000, 0, 0)]
    rows = found(spark, long)
    for r, (_, text, *_) in zip(rows, long, strict=True):
        a, _, b, _ = tokens(text)
        assert r[1:3] == (len(a), len(b)) and r[3] == r[4] > 0
    assert found(spark, []) == []


def test_forgetful_worker(spark, tokens, monkeypatch):
    aligner, again = token_alignment.Aligner(A, B), token_alignment.Aligner(A, B)
    texts = ["one two three four five", "one two", "six seven one", "x" * 300 + " one", "one two six one two six " * 3, "bad ▁ one", "six one"]
    expected = [aligner([t]) for t in texts]
    monkeypatch.setattr(token_alignment, "REMEMBERED", 4)
    monkeypatch.setattr(token_alignment, "UNIT", 2)
    for t, x in zip(texts, expected, strict=True):
        y = again([t])
        assert (x[0] == y[0]).all() and x[1] == y[1] and (x[2][0] == y[2][0]).all()
    assert len(again.place) <= 6


def test_workers_get_small_batches(spark):
    """Of long texts 10,000 rows are tens of MB, which a worker and the JVM would hold several times."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, most in (("64m", 4 << 20), ("1048576", 1 << 20)):
            spark.conf.set(name, given)
            assert found(spark, [(1, "a b", 0, 0)])[0][:3] == (1, 2, 2)
            assert spark.conf.get(name) == str(most)
    finally:
        spark.conf.set(name, before)


def test_counts_are_summed_in_workers(monkeypatch):
    """A worker holds distinct pairs, not all links, and forgets its pieces when links are looked up."""
    monkeypatch.setattr(token_alignment, "COUNTED", 40)
    texts = ["one two three four"] * 500 + [f"number {i}" for i in range(200)]
    rows = pa.RecordBatch.from_pydict({"row": list(range(700)), "doc_id": list(range(700)), "text": texts})
    out = [r for b in token_alignment._documents(A, B)(rows.slice(k, 10) for k in range(0, 700, 10)) for r in b.to_pylist()]
    links = Counter(x for r in out if r["row"] is not None for x in r["pairs"])
    counted = [r for r in out if r["row"] is None]
    total = Counter()
    for r in counted:
        assert len(r["pairs"]) == len(set(r["pairs"])) <= 200
        total.update(dict(zip(r["pairs"], r["counts"], strict=True)))
    assert total == links and len(counted) <= 1 + len(links) // 40
    sent = SimpleNamespace(value=(np.array(sorted(links)), np.array([links[x] for x in sorted(links)]), np.ones(len(links), bool)))
    looked = pa.RecordBatch.from_pydict({"row": [0], "pairs": [[*links]]}, schema=pa.schema({"row": pa.int64(), "pairs": pa.list_(pa.int64())}))
    assert [x.to_pylist() for x in token_alignment._looked_up(sent)([looked])] == [[{"row": 0, "n_best": len(links), "count_sum": sum(links.values()), "rest": []}]]
    assert not token_alignment._loaded


def test_pieces_encoded_together():
    """Pieces that may follow each other are one call's text; what each gives is as if alone."""
    a, b = token_alignment.Tokenizer(A), token_alignment.Tokenizer(B)
    pieces = sorted({p for t in HARD if t for p in token_alignment.pieces_of(t, True)}, key=hash)
    sizes = np.array([len(p.encode()) for p in pieces])
    for of in (a, b):
        ids, n = of(pieces, sizes)
        alone = [of([p], sizes[k : k + 1])[0].tolist() for k, p in enumerate(pieces)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == alone
    given = []
    a.library = SimpleNamespace(encode_batch_fast=lambda texts, **_: given.append(texts) or [SimpleNamespace(ids=[i for c in t.encode() for i in [a.bytes.index(bytes([c]))]]) for t in texts])
    assert a([" a", " b", "  c", " d "], np.array([2, 2, 3, 3]))[1].tolist() == [2, 2, 3, 3] and given == [[" a b", "  c d "]]


def test_ids_are_written():
    for ids in ([], [0], [10, 0, 7, 50_000, 123_456], list(range(0, 70_000, 997))):
        said, begins = token_alignment.written(np.array(ids, np.int64), np.full(len(ids), ord(",")))
        assert said == "".join(f"{i}," for i in ids).encode() and np.diff(begins).tolist() == [len(str(i)) + 1 for i in ids]


@pytest.mark.parametrize("block", [token_alignment.BLOCK, 3])
def test_products(block, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK", block)
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = rng.integers(0, 2, (rng.integers(1, 7), 5)), rng.integers(0, 2, (5, rng.integers(1, 7)))

        def rows(m):
            return token_alignment.Rows(np.append(0, np.cumsum(m.sum(1))), np.nonzero(m)[1], m.shape[1])

        got = np.zeros((len(x), y.shape[1]), int)
        for i, j, n in rows(x).times(rows(y)):
            assert not got[i, j].any()
            got[i, j] = n
        assert (got == x @ y).all()
        assert (np.nonzero(x.T)[1] == rows(x).transposed().columns).all()


def test_links(spark, tokens):
    text = "don't  align 日本語 naïvely"
    docs = spark.createDataFrame([(1, text, 0, 0), (2, None, 0, 0), (3, "", 0, 0)], DOC)
    a, ba, b, bb = tokens(text)
    ends = [np.cumsum(list(map(len, x))).tolist() for x in (ba, bb)]
    spans = [list(zip([0, *e], e)) for e in ends]  # noqa: B905
    overlap = {(i, j): min(x[1], y[1]) - max(x[0], y[0]) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if min(x[1], y[1]) > max(x[0], y[0])}
    cuts = sorted(set(ends[0]) & set(ends[1]))
    group = lambda e: sum(c < e for c in cuts)
    got = {k: {(r.a_at, r.b_at): r.bytes for r in token_alignment.links(docs, A, B, k).collect()} for k in ("overlap", "end", "group")}
    assert got["overlap"] == overlap
    assert got["end"] == {k: n for k, n in overlap.items() if ends[0][k[0]] == ends[1][k[1]]}
    assert set(got["group"]) == {(i, j) for i, x in enumerate(ends[0]) for j, y in enumerate(ends[1]) if group(x) == group(y)}
    assert token_alignment.align(spark, docs, A, B).where("doc_id = 1").first().n_shared == len(got["group"])
