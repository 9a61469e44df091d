"""How the tokens of two tokenizers lie over each other in the same text.

Over the bytes of ``space + text`` the tokens of each tokenizer are a sparse matrix of tokens by
bytes, kept as compressed rows that are built here by hand. The product A·Bᵀ, row by row after
Gustavson (a row of the product is the sum of the rows of Bᵀ that the entries of A's row name), is
the overlap links: pairs of tokens and the bytes that they share. Where tokens of both end together
the text is cut into groups; the product of the two matrices of tokens by groups is the shared-group
links. Products are made in blocks of rows, so that a long group needs no memory for all its pairs.

Neither tokenizer joins anything over a single space between two characters that aren't blank, so a
text falls into pieces that can be aligned by themselves: its matrices are blocks along a diagonal.
Pieces that a worker doesn't know yet are aligned together, as one product; what they gave is
remembered. Where a tokenizer isn't of that kind a text is one piece.

Counts of id pairs over the corpus are summed up within tasks, then by Spark. The most frequent HELD
pairs are sent to the tasks that look up each document's links; links of all others meet their
counts in a join.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, least_hashes, small_batches

#: Pieces that a worker remembers (some 100 MB), the longest of them, and those that are looked at together.
REMEMBERED, LONGEST, UNIT = 250_000, 200, 20_000
#: Pairs of ids that are sent to tasks (17 bytes each), and entries of a product made at once.
HELD, BLOCK = 1_000_000, 1 << 21
#: Characters of text in one batch of results, and links, then distinct pairs of them, that a task counts before it hands them on.
AT_ONCE, COUNTED = 1 << 20, 1 << 18


class Rows:
    """A sparse matrix by rows: the columns of row i are ``columns[starts[i]:starts[i + 1]]``; all
    entries that are there are 1."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, width: int):
        self.starts, self.columns, self.width = starts, columns, width

    @classmethod
    def of(cls, column_of: np.ndarray, width: int) -> Rows:
        """One entry a row."""
        return cls(np.arange(len(column_of) + 1), column_of, width)

    @classmethod
    def spans(cls, lengths: np.ndarray) -> Rows:
        """Rows of consecutive columns, each row's after the last row's."""
        starts = np.append(0, np.cumsum(lengths))
        return cls(starts, np.arange(starts[-1]), int(starts[-1]))

    def transposed(self) -> Rows:
        row_of = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        by = np.argsort(self.columns, kind="stable")
        return Rows(np.append(0, np.cumsum(np.bincount(self.columns, minlength=self.width))), row_of[by], len(self.starts) - 1)

    def times(self, other: Rows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The product's entries, by row and column: (row, column, value), in blocks of whole rows or
        parts of a row that hold no entry twice."""
        sizes = np.diff(other.starts)[self.columns]
        upto = np.append(0, np.cumsum(sizes))[self.starts]
        at, n = 0, len(self.starts) - 1
        while at < n:
            stop = max(at + 1, int(np.searchsorted(upto, upto[at] + BLOCK, "right")) - 1)
            entries = slice(self.starts[at], self.starts[stop])
            rows = np.repeat(np.arange(at, stop), np.diff(self.starts[at : stop + 1]))
            picked, each = self.columns[entries], sizes[entries]
            if stop == at + 1 and len(picked) == 1:  # one row that names one other: that row, in parts
                a, b = other.starts[picked[0]], other.starts[picked[0] + 1]
                for x in range(a, b, BLOCK):
                    columns = other.columns[x : min(x + BLOCK, b)]
                    yield np.full(len(columns), at), columns, np.ones(len(columns), np.int64)
            else:
                total = int(each.sum())
                first = np.repeat(other.starts[picked] - (np.cumsum(each) - each), each)
                keys = np.repeat(rows, each) * other.width + other.columns[first + np.arange(total)]
                keys.sort(kind="stable")
                new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if total else np.zeros(0, np.int64)
                yield keys[new] // max(1, other.width), keys[new] % max(1, other.width), np.diff(np.append(new, total))
            at = stop


class Tokenizer:
    """Ids of ``space + text`` and the bytes of each id. No special tokens are added or found."""

    def __init__(self, path: str):
        self.json = path.endswith(".json")
        if self.json:
            from tokenizers import Tokenizer as Library

            self.library = Library.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            self.library.encode_special_tokens = True
            with open(path) as f:
                told = json.load(f)
            step = told.get("pre_tokenizer") or {}
            self.splits = not told.get("normalizer") and step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space")
            # Byte-level alphabets write printable bytes as themselves and the others, in order, from U+0100 on.
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
            names = self.library.get_vocab()
            self.bytes = [b""] * (max(names.values()) + 1)
            for name, i in names.items():
                self.bytes[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
        elif path.endswith(".model"):
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
            self.splits = not any("▁" in name.lstrip("▁") for name in names)
            self.bytes = [bytes([int(x[1], 16)]) if (x := re.fullmatch("<0x([0-9A-F]{2})>", name)) else name.replace("▁", " ").encode() for name in names]
        else:
            raise ValueError(f"neither .json nor .model: {path}")
        self.lengths = np.array(list(map(len, self.bytes)), np.int64)
        self.joins = self.json and self.splits and bool(self.lengths.all())

    def __call__(self, pieces: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``pieces``, one after the other, and how many each has. They begin with the space,
        which a .model adds by itself; ``sizes`` are their bytes."""
        if self.joins and len(pieces) > 1:
            # What may follow each other in a text is encoded as one.
            runs: list[list[str]] = [[]]
            for p in pieces:
                if runs[-1] and (p[1:2].isspace() or runs[-1][-1][-1].isspace()):
                    runs.append([])
                runs[-1].append(p)
            ids = np.concatenate([np.array(x.ids, np.int64) for x in self.library.encode_batch_fast(list(map("".join, runs)), add_special_tokens=False)])
            ends, upto = np.cumsum(self.lengths[ids]), np.cumsum(sizes)
            at = np.searchsorted(ends, upto)
            if len(ends) and ends[-1] == upto[-1] and (ends[at] == upto).all():
                return ids, np.diff(at + 1, prepend=0)
        if self.json:
            lists = [x.ids for x in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        else:
            lists = self.library.encode([p[1:] for p in pieces], num_threads=1)
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n


class Aligned:
    """Tokens of some pieces, one after the other, and their products."""

    def __init__(self, a: Tokenizer, b: Tokenizer, pieces: list[str]):
        raw = [p.encode() for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ids, n, given = [], [], []
        for of in (a, b):
            for said, x in zip((ids, n), of(pieces, size), strict=True):
                said.append(x)
            upto = np.append(0, np.cumsum(of.lengths[ids[-1]]))[np.append(0, np.cumsum(n[-1]))]
            given.append((b"".join(map(of.bytes.__getitem__, ids[-1].tolist())), upto))
        same = np.logical_and.reduce([np.diff(upto) == size for _, upto in given])
        if not same.all() or any(text != b"".join(raw) for text, _ in given):
            same &= [all(text[upto[i] : upto[i + 1]] == r for text, upto in given) for i, r in enumerate(raw)]
        self.same = same
        self.n_a, self.n_b = (np.where(same, k, 0) for k in n)
        self.a, self.b = (x[np.repeat(same, k)] for x, k in zip(ids, n, strict=True))
        self.spans_a, self.spans_b = Rows.spans(a.lengths[self.a]), Rows.spans(b.lengths[self.b])
        self.ends_a, self.ends_b = self.spans_a.starts[1:], self.spans_b.starts[1:]
        ends = [(i[e], j[e]) for i, j, _ in self.overlaps() for e in [self.ends_a[i] == self.ends_b[j]]]
        self.links = tuple(np.concatenate([x[k] for x in ends]) if ends else np.zeros(0, np.int64) for k in (0, 1))
        cuts = self.ends_a[self.links[0]]
        self.groups_a, self.groups_b, self.n_groups = np.searchsorted(cuts, self.ends_a), np.searchsorted(cuts, self.ends_b), len(cuts)

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in a, place in b, bytes that both cover)"""
        return self.spans_a.times(self.spans_b.transposed())

    def shared(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in a, place in b, 1) of tokens of one group."""
        return Rows.of(self.groups_a, self.n_groups).times(Rows.of(self.groups_b, self.n_groups).transposed())


def written(ids: np.ndarray, marks: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Decimal ids, each with its mark behind it, and where each begins and the last ends."""
    digits = np.zeros((len(ids), len(str(ids.max(initial=0))) + 1), np.uint8)
    digits[:, -1], left = marks, ids.copy()
    for k in range(digits.shape[1] - 2, -1, -1):
        digits[:, k] = np.where((left > 0) | (k == digits.shape[1] - 2), 48 + left % 10, 0)
        left //= 10
    shown = digits != 0
    return digits[shown].tobytes(), np.append(0, np.cumsum(shown.sum(axis=1)))


_BLANKS = re.compile(r"\A\s| \s|\s |\s\Z")


def pieces_of(text: str, splits: bool) -> list[str]:
    """``space + text`` cut before each single space between characters that aren't blank."""
    parts = text.split(" ")
    if not splits:
        return [" " + text]
    if not _BLANKS.search(text):
        return [" " + p for p in parts]
    out = [""]
    for p in parts:
        before = out[-1]
        if not before or before[-1].isspace() or not p or p[0].isspace():
            out[-1] = f"{before} {p}"
        else:
            out.append(" " + p)
    return out


class Aligner:
    """Aligns texts and remembers their pieces: of too many, those that came more than once."""

    def __init__(self, a: str, b: str):
        self.a, self.b = Tokenizer(a), Tokenizer(b)
        self.splits = self.a.splits and self.b.splits
        self.place: dict[str, int] = {}
        self.numbers, self.said, self.hits = np.zeros((0, 5), np.int64), [], np.zeros(0, np.int64)
        self.keys, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def forget(self) -> None:
        kept = sorted(((p, k) for p, k in self.place.items() if self.hits[k] > 1), key=lambda x: -self.hits[x[1]])[: REMEMBERED // 2]
        at = np.array([k for _, k in kept], np.int64)
        self.place = {p: i for i, (p, _) in enumerate(kept)}
        self.keys, n = self.pairs(at), np.diff(self.starts)[at]
        self.numbers, self.said, self.hits, self.starts = self.numbers[at], [self.said[k] for k in at.tolist()], self.hits[at] // 2, np.append(0, np.cumsum(n))

    def pairs(self, at: np.ndarray) -> np.ndarray:
        """Id pairs of some pieces, one after the other."""
        n = np.diff(self.starts)[at]
        return self.keys[np.repeat(self.starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def learn(self, pieces: list[str]) -> None:
        """Numbers of each piece (same, tokens of a and b, groups, shared-group links), its groups in
        words, and the id pairs that end together."""
        x = Aligned(self.a, self.b, pieces)
        upto = [np.append(0, np.cumsum(n)) for n in (x.n_a, x.n_b)]
        last = np.searchsorted(x.links[0], upto[0])
        in_a, in_b = np.bincount(x.groups_a, minlength=x.n_groups), np.bincount(x.groups_b, minlength=x.n_groups)
        both = np.append(0, np.cumsum(in_a * in_b))
        # Groups in words: a group's tokens of a, then those of b.
        at = np.arange(len(x.a)) + np.append(0, np.cumsum(in_b))[x.groups_a], np.arange(len(x.b)) + np.cumsum(in_a)[x.groups_b]
        ids, marks = np.zeros(len(x.a) + len(x.b), np.int64), np.full(len(x.a) + len(x.b), ord(","))
        ids[at[0]], ids[at[1]] = x.a, x.b
        marks[at[0][x.links[0]]], marks[at[1][x.links[1]]] = ord("|"), ord(";")
        words, begins = written(ids, marks)
        begins = begins[upto[0] + upto[1]].tolist()
        self.place.update(zip(pieces, range(len(self.said), len(self.said) + len(pieces)), strict=True))
        self.said += [words[i : max(i, j - 1)] for i, j in zip(begins, begins[1:])]  # noqa: B905
        self.numbers = np.concatenate([self.numbers, np.stack([x.same.astype(np.int64), x.n_a, x.n_b, np.diff(last), np.diff(both[last])], 1)])
        self.keys = np.concatenate([self.keys, x.a[x.links[0]] << 32 | x.b[x.links[1]]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + last[1:]])
        self.hits = np.append(self.hits, np.zeros(len(pieces), np.int64))

    def known(self, units: list[list[str]]) -> list[np.ndarray]:
        """Places of the pieces of some texts or parts of texts."""
        missing = list({p for of in units for p in of if p not in self.place})
        if len(self.said) + len(missing) > REMEMBERED or len(self.keys) > 8 * REMEMBERED:
            self.forget()
            missing = list({p for of in units for p in of if p not in self.place})
        for at in range(0, len(missing), 4096):
            self.learn(missing[at : at + 4096])
        out = [np.fromiter(map(self.place.__getitem__, of), np.int64, len(of)) for of in units]
        np.add.at(self.hits, np.concatenate(out), 1)
        for p in missing:
            if len(p) > LONGEST:
                del self.place[p]
        return out

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[np.ndarray]]:
        """For each text (tokens of a and b, groups, shared-group links), the digest of its groups,
        and its id pairs."""
        numbers, same = np.zeros((len(texts), 4), np.int64), np.array([bool(t) for t in texts], bool)
        digests, keys, units = [None] * len(texts), [[] for _ in texts], []

        def done() -> None:
            for (i, _), at in zip(units, self.known([of for _, of in units]), strict=True):
                mine = self.numbers[at]
                same[i] &= mine[:, 0].all()
                numbers[i] += mine[:, 1:].sum(axis=0)
                keys[i].append(self.pairs(at))
                said = b";".join([self.said[k] for k in at.tolist()])
                if digests[i] is None:
                    digests[i] = hashlib.sha256(said)
                else:
                    digests[i].update(b";" + said)
            units.clear()

        n = 0
        for i, text in enumerate(texts):
            pieces = pieces_of(text, self.splits) if text else []
            for at in range(0, len(pieces), UNIT):
                units.append((i, pieces[at : at + UNIT]))
                n += len(units[-1][1])
                if n >= UNIT:
                    done()
                    n = 0
        if units:
            done()
        numbers[~same] = 0
        none = np.zeros(0, np.int64)
        return numbers, [d.hexdigest() if ok else "" for d, ok in zip(digests, same, strict=True)], [np.concatenate(k) if ok else none for k, ok in zip(keys, same, strict=True)]


_loaded: dict = {}


def _aligner(a: str, b: str) -> Aligner:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (a, b) not in _loaded:
        _loaded[a, b] = Aligner(a, b)
    return _loaded[a, b]


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Rows whose texts have AT_ONCE characters together, or one row."""
    for batch in (whole.slice(k, 128) for whole in batches for k in range(0, whole.num_rows, 128)):
        texts = batch.column("text").to_pylist()
        at = 0
        while at < len(texts):
            stop, n = at, 0
            while stop < len(texts) and (stop == at or n + len(texts[stop] or "") <= AT_ONCE):
                n += len(texts[stop] or "")
                stop += 1
            yield batch.slice(at, stop - at), texts[at:stop]
            at = stop


def summed(keys: np.ndarray, n: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, and their counts, with those of ``more`` added."""
    new, times = np.unique(np.concatenate([np.zeros(0, np.int64), *more]), return_counts=True)
    keys, n = np.concatenate([keys, new]), np.concatenate([n, times])
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else by
    return keys[first], np.add.reduceat(n[by], first) if len(keys) else n


_ROW = "row long, doc_id long, n_a long, n_b long, n_groups long, n_shared long, groups_sha256 string, pairs array<long>, counts array<long>"


def _documents(a: str, b: str):
    """A row for each document, and rows without one that hold counts of id pairs."""
    names = [f.split()[0] for f in _ROW.split(", ")]

    def counts(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        nulls = [pa.nulls(1, t) for t in (*[pa.int64()] * 6, pa.string())]
        return pa.RecordBatch.from_arrays([*nulls, pa.array([keys], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64()))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, held = _aligner(a, b), []
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        counted = none
        for rows, texts in _some(batches):
            numbers, digests, keys = align(texts)
            pairs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(k) for k in keys])), pa.int32()), pa.array(np.concatenate(keys)))
            columns = [rows.column("row"), rows.column("doc_id"), *[pa.array(numbers[:, k]) for k in range(4)], pa.array(digests), pairs, pa.nulls(len(texts), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            held += keys
            if sum(map(len, held)) > COUNTED:
                counted, held = summed(*counted, held), []
                if len(counted[0]) > COUNTED:
                    yield counts(*counted)
                    counted = none
        counted = summed(*counted, held)
        if len(counted[0]):
            yield counts(*counted)

    return run


def _looked_up(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _loaded.clear()  # a worker that aligned before needs its pieces no more
        keys, n, best = sent.value
        for batch in (whole.slice(k, 128) for whole in batches for k in range(0, whole.num_rows, 128)):
            pairs = batch.column("pairs")
            sizes, flat = np.asarray(pairs.value_lengths()), pairs.flatten().to_numpy()
            of = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.minimum(np.searchsorted(keys, flat), max(0, len(keys) - 1))
            known = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            for total, values in zip(sums, (best, n), strict=True):
                np.add.at(total, of[known], values[at[known]].astype(np.int64))
            rest = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(of[~known], minlength=batch.num_rows))), pa.int32()), pa.array(flat[~known]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, sums), rest], names=["row", "n_best", "count_sum", "rest"])

    return run


def align(spark: SparkSession, docs: DataFrame, a: str, b: str, held: int = HELD) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256, and n_shared, the number of its shared-group links.

    ``a`` and ``b`` are files (.json or .model) that every executor has. Links are token pairs that
    end together; the count of an id pair is how many links of the whole table hold it. A text that
    is null, empty, or not given back byte by byte by either tokenizer has no tokens: zeros and an
    empty digest. Repeated rows each get a row and count each time; a null doc_id stays. An empty
    table gives an empty result. Other columns are ignored. A task holds one text at a time beyond
    AT_ONCE characters. ``held`` changes the work, not the result.
    """
    small_batches(spark)
    ws = Workspace(spark, "alignment")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = ws.save(rows.mapInArrow(_documents(a, b), _ROW), "documents")
    texts = found.where("row is not null")

    each = found.where("row is null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    counts = ws.save(each.groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    # One row for each id of b: no more than its vocabulary.
    most = counts.groupBy((F.col("pair") % (1 << 32)).alias("b")).agg(F.max("n").alias("most"))
    pairs = counts.withColumn("b", F.col("pair") % (1 << 32)).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    pairs = ws.save(pairs, "pairs")

    total = pairs.count()
    kept = pairs if total <= held else least_hashes(pairs.where(F.col("n") >= _common_enough(pairs, held)), "pair", held)
    sent = kept.orderBy("pair").toArrow()
    sent = spark.sparkContext.broadcast(tuple(np.ascontiguousarray(sent[c].to_numpy()) for c in ("pair", "n", "best")))
    sums = texts.select("row", "pairs").mapInArrow(_looked_up(sent), "row long, n_best long, count_sum long, rest array<long>")
    if total <= held:
        sums = sums.drop("rest")
    else:
        sums = ws.save(sums, "sums")
        rest = sums.select("row", F.explode("rest").alias("pair")).groupBy("pair", "row").agg(F.count("*").alias("times")).join(pairs, "pair")
        more = rest.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
        sums = sums.select("row", "n_best", "count_sum").union(more).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = texts.drop("pairs", "counts").join(sums, "row")
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256", "n_shared")


def _common_enough(pairs: DataFrame, held: int) -> int:
    """A count that some ``held`` pairs reach, from a histogram by powers of two."""
    sizes = {r.p: r.n for r in pairs.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("n")).collect()}
    so_far = 0
    for p in sorted(sizes, reverse=True):
        so_far += sizes[p]
        if so_far >= held:
            return 2**p
    return 1


def links(docs: DataFrame, a: str, b: str, kind: str = "overlap") -> DataFrame:
    """(doc_id, a_at, b_at, a_id, b_id, bytes): links between the tokens of each text, by their places
    in it. ``kind`` is overlap (tokens that share bytes), end (those of them that end together) or
    group (all tokens of one group; bytes is null). Long groups have many: a task makes them in blocks."""
    if kind not in ("overlap", "end", "group"):
        raise ValueError(f"no kind of links {kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _aligner(a, b)
        for rows, texts in _some(batches):
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), texts, strict=True):
                if text:
                    x = Aligned(align.a, align.b, [" " + text])
                    for i, j, n in x.shared() if kind == "group" else x.overlaps():
                        if kind == "end":
                            keep = x.ends_a[i] == x.ends_b[j]
                            i, j, n = i[keep], j[keep], n[keep]
                        shared = pa.nulls(len(i), pa.int64()) if kind == "group" else pa.array(n, pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(i), pa.int64()), *map(pa.array, (i, j, x.a[i], x.b[j])), shared], names=["doc_id", "a_at", "b_at", "a_id", "b_id", "bytes"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, a_at long, b_at long, a_id long, b_id long, bytes long")
