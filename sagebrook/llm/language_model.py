"""A hierarchical Pitman-Yor language model of word pairs, trained and applied by Spark.

Each word that precedes another is a restaurant whose dishes are the words that follow it; all of
these restaurants share one parent, the restaurant of single words, whose own parent is even over all
words and one that stands for every unknown word. A restaurant's tables are its parent's customers.
What predictions need of a seating is how many tables have a dish, so this is what is sampled: a
sweep stands up all customers of a dish at once and draws their number of tables from its
distribution given all other tables (the weights are generalised Stirling numbers), first in the
restaurants of contexts, then in their parent. Counts of tables that other tasks are drawing in the
same sweep are those of the sweep before. Customers of a frequent dish are seated in halls of HALL;
tables stand within a hall. Predictive probabilities are averaged over sweeps.

All work is dealt out by context: pairs meet in the bucket of their context's hash, those of contexts
with a large share of all tokens in buckets of the pair's hash. Tasks hand on arrays of a bucket, not
a row for each token. Nothing learnt is dropped or bounded; what grows with the corpus stays in
Parquet and shuffles, and the driver sees totals and the contexts that are dealt out by pair, of
which there are no more than buckets.

A text's probability is a sum over its words and pairs: first as if each word were predicted by the
parent at its context's weight, then, for each pair that was seen, what the context adds to that. So
a text's words and pairs are looked up one by one, wherever they are, and summed up.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, shuffles_removed
from .shingles import mix, word_hashes

#: Tokens whose pairs are in one bucket, tokens that a task sorts at once, customers of one hall.
BUCKET, AT_ONCE, HALL = 2_000_000, 1_000_000, 256
#: Sweeps, and those of them before any is averaged.
SWEEPS, FIRST = 4, 1
STRENGTH = 1.0
#: Repeats within AT_ONCE tokens that make a context a candidate for being dealt out by pair.
REPEATS = 64
#: Texts that a task sorts at once: a text's place and a 48-bit key are one number.
TEXTS_AT_ONCE = 1 << 16

BEGIN, END = np.uint64(0x5BD1E995A3C59AC3), np.uint64(0xC2B2AE3D27D4EB4F)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: Kinds of rows: pairs seen once, and more often; what a bucket asks the owners of words; customers
#: for them; what they answer; the owners' words; contexts that are dealt out by pair; looked-up
#: values; a text's words and pairs; texts; how many pairs were seen twice; what texts get from a bucket.
ONCE, PAIRS, ASKED, CUSTOMERS, ANSWERS, WORDS, DEALT, VALUES, FOUND, TEXTS, TWICE, GAINED = range(12)
_SCHEMA = "kind int, bucket int, src int, total long, data binary"


def _pack(**values) -> bytes:
    """Arrays in few bytes: of ascending numbers the steps, and of numbers the bytes by place."""
    out = {}
    for name, x in values.items():
        if isinstance(x, np.ndarray) and x.dtype.kind in "iu" and x.dtype.itemsize > 1:
            steps = len(x) > 1 and bool((x[1:] >= x[:-1]).all())
            y = np.diff(x, prepend=x.dtype.type(0)) if steps else x
            x = (x.dtype.str, steps, np.ascontiguousarray(y.view(np.uint8).reshape(len(x), x.dtype.itemsize).T))
        out[name] = x
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(out, protocol=5))


def _unpack(data: bytes) -> dict:
    out = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    for name, x in out.items():
        if isinstance(x, tuple):
            y = np.ascontiguousarray(x[2].T).reshape(-1).view(x[0])
            out[name] = np.cumsum(y, dtype=y.dtype) if x[1] else y
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "bucket", "src", "total", "data"])


def _owner(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(u * _ODD[0] + mix(w * _ODD[1]))


def _pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What a pair is looked up by: 47 bits. Among the pairs of a bucket an unseen one is taken for
    another with a chance of 1e-8, an unknown word (below) with one of less than 1e-9."""
    return _pair_hash(u, w) >> np.uint64(17)


def _word_key(w: np.ndarray) -> np.ndarray:
    return (mix(w ^ _ODD[2]) >> np.uint64(17)) | np.uint64(1 << 47)


def _among(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in a sorted array, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


@dataclass(frozen=True)
class Dealing:
    """Which bucket a pair is in, and which owns a word."""

    buckets: int
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # contexts dealt out by pair, sorted

    def of(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        spread = _among(self.spread, u)[1]
        return _owner(np.where(spread, _pair_hash(u, w), u), self.buckets)


def _parts(by: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values of a sorted array."""
    starts = np.flatnonzero(np.append(True, by[1:] != by[:-1])) if len(by) else []
    for a, b in zip(starts, np.append(starts[1:], len(by)) if len(by) else [], strict=True):
        yield int(by[a]), slice(int(a), int(b))


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in ascending order, and the sums of their values."""
    by = np.argsort(key)
    key = key[by]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else by
    return key[starts], *(np.add.reduceat(v[by], starts) if len(key) else v for v in values)


def _pairs(u: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs by context, and their sums."""
    key = _pair_hash(u, w)
    by = np.argsort(key)
    key, u, w = key[by], u[by], w[by]
    starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (u[1:] != u[:-1]) | (w[1:] != w[:-1])))
    u, w, n = u[starts], w[starts], np.add.reduceat(n[by], starts)
    by = np.argsort(u, kind="stable")
    return u[by], w[by], n[by]


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's context, the token, and its text's place in the column."""
    words, at = word_hashes(column)
    n = len(column)
    of = np.repeat(np.arange(n, dtype=np.int32), np.diff(at) + 1)
    ends = at[1:] + np.arange(n)
    w = np.full(len(words) + n, END)
    inner = np.ones(len(w), bool)
    inner[ends] = False
    w[inner] = words
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[np.append(0, ends[:-1] + 1)[:n]] = BEGIN
    return u, w, of


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with their tokens, some AT_ONCE at a time."""
    rows, parts, n = [], [], 0
    for whole in batches:
        for at in range(0, whole.num_rows, 256):  # a long text is in a slice of its own size
            batch = whole.slice(at, 256)
            u, w, of = _tokens(batch.column("text"))
            parts.append((u, w, of + sum(b.num_rows for b in rows)))
            rows.append(batch)
            n += len(w)
            if n >= AT_ONCE or sum(b.num_rows for b in rows) > TEXTS_AT_ONCE - 256:
                yield pa.Table.from_batches(rows), *(np.concatenate(x) for x in zip(*parts, strict=True))
                rows, parts, n = [], [], 0
    if n:
        yield pa.Table.from_batches(rows), *(np.concatenate(x) for x in zip(*parts, strict=True))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, u, _, _ in _gathered(batches):
        bins = (u >> np.uint64(44)).astype(np.int64)
        contexts, n = np.unique(u[np.bincount(bins, minlength=1 << 20)[bins] >= REPEATS], return_counts=True)
        often = n >= REPEATS
        columns = [pa.array([len(u)]), pa.array([contexts[often].view(np.int64)], pa.list_(pa.int64())), pa.array([n[often]], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["n", "contexts", "counts"])


def _counted(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealing = sent.value
        for _, u, w, _ in _gathered(batches):
            u, w, n = _pairs(u, w, np.ones(len(u), np.int64))
            bucket = dealing.of(u, w).astype(np.uint16 if dealing.buckets <= 1 << 16 else np.uint32)
            by = np.argsort(bucket, kind="stable")
            u, w, n = u[by], w[by], n[by]
            for b, part in _parts(bucket[by]):
                yield _batch([(PAIRS, b, -1, 0, _pack(u=u[part], w=w[part], n=n[part]))])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, int, dict]]]]:
    """(bucket, its rows) of rows sorted by bucket. A bucket's rows are to be used up one by one."""
    stream = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "src", "data")), strict=True))
    ahead = next(stream, None)

    def of(bucket: int) -> Iterator[tuple[int, int, dict]]:
        nonlocal ahead
        while ahead is not None and ahead[0] == bucket:
            row, ahead = ahead, None
            yield row[1], row[2], _unpack(row[3])
            ahead = next(stream, None)

    while ahead is not None:
        yield ahead[0], of(ahead[0])


def _merged(sent):
    """All pairs of a bucket, and what it tells the owners of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealing = sent.value
        for bucket, rows in _buckets(batches):
            parts = [(x["u"], x["w"], x["n"]) for _, _, x in rows]
            u, w, c = _pairs(*(np.concatenate([p[k] for p in parts]) for k in range(3)))
            one = c == 1
            out = [(TWICE, bucket, -1, int((c == 2).sum()), b""), (ONCE, bucket, -1, int(one.sum()), _pack(u=u[one], w=w[one])), (PAIRS, bucket, -1, int((~one).sum()), _pack(u=u[~one], w=w[~one], c=c[~one], t=np.ones((~one).sum(), np.int64), mean=np.zeros((~one).sum(), np.float32)))]
            words, alone, both, n = _summed(w, one.astype(np.int64), (~one).astype(np.int64), c)
            for b, part in _parts(_owner(words, dealing.buckets)):
                out.append((ASKED, b, bucket, 0, _pack(w=words[part], alone=alone[part], contexts=(alone + both)[part], n=n[part])))
                if both[part].any():
                    some = both[part] > 0
                    out.append((CUSTOMERS, b, bucket, int(both[part].sum()), _pack(w=words[part][some], t=both[part][some])))
            out += _dealt(dealing, bucket, u, c, np.ones(len(u), np.int64), one)
            yield _batch(out)

    return run


def _dealt(dealing: Dealing, bucket: int, u: np.ndarray, c: np.ndarray, t: np.ndarray, once: np.ndarray) -> list[tuple]:
    """Sums of a bucket's part of contexts that are dealt out by pair: customers, tables, and those
    tables that stay."""
    some = _among(dealing.spread, u)[1]
    if not some.any():
        return []
    contexts, c, t, alone = _summed(u[some], c[some], t[some], once[some].astype(np.int64))
    return [(DEALT, bucket, -1, 0, _pack(u=contexts, c=c, t=t, alone=alone))]


def stirling(d: float, n: int = HALL) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of c customers at t tables, discount d."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[1, 1] = 0
    with np.errstate(divide="ignore"):
        for c in range(1, n):
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], out[c, 1:] + np.log(np.maximum(c - d * np.arange(1, n + 1), 0)))
    return out


def seat(c: np.ndarray, log_p: np.ndarray, others: np.ndarray, d: float, strength: float, numbers: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with c customers, drawn given the parent's logarithms of probabilities and how
    many tables of other dishes are in their restaurants."""
    tables = (c > 0).astype(np.int64)

    def chances(rows: np.ndarray, n: int) -> np.ndarray:
        """Up to a factor, the chances of 1 to n tables for n customers of each dish."""
        k = np.arange(n)
        weight = np.cumsum(np.log(strength + d * (others[rows, None] + k)), axis=1) + log_p[rows, None] * (k + 1) + numbers[n, 1 : n + 1]
        weight -= weight.max(axis=1, keepdims=True)
        return np.exp(weight, out=weight)

    full, rest = c // HALL, c % HALL
    for rows in np.array_split(big := np.flatnonzero(full), max(1, len(big) // 1024)):
        if len(rows):
            p = chances(rows, HALL)
            drawn = rng.multinomial(full[rows], p / p.sum(axis=1, keepdims=True))
            tables[rows] = drawn @ np.arange(1, HALL + 1) + (rest[rows] == 1)
    by = np.argsort(rest, kind="stable")
    for n, part in _parts(rest[by]):
        if n < 2:
            continue
        for at in range(part.start, part.stop, step := max(1, (1 << 19) // n)):
            rows = by[at : min(at + step, part.stop)]
            sums = np.cumsum(chances(rows, n), axis=1)
            drawn = 1 + (sums < rng.random(len(rows))[:, None] * sums[:, -1:]).sum(axis=1)
            tables[rows] = np.where(full[rows] > 0, tables[rows], 0) + drawn
    return tables


@dataclass(frozen=True)
class Totals:
    """What all tasks of a sweep know."""

    dealing: Dealing
    discount: float
    parent_discount: float
    strength: float
    seed: int
    words: int  # distinct ones
    sweep: int = 0
    kept: bool = False
    customers: int = 0
    tables: int = 0  # of the parent
    contexts: tuple = ()  # of those dealt out by pair: sorted hashes, customers, tables

    def even(self) -> float:
        """What every word has besides its own customers."""
        return (self.strength + self.parent_discount * self.tables) / (self.words + 1) / (self.strength + self.customers)


def _context_tables(totals: Totals, u: np.ndarray, t: np.ndarray, alone: np.ndarray, alone_u: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct contexts of a bucket with the tables (and customers) of each one's whole restaurant."""
    c = np.ones(len(u), np.int64) if c is None else c
    contexts, tables, customers = _summed(np.concatenate([u, alone_u]), np.concatenate([t, alone]), np.concatenate([c, alone]))
    if len(totals.contexts):
        at, spread = _among(totals.contexts[0], contexts)
        customers[spread], tables[spread] = totals.contexts[1][at[spread]], totals.contexts[2][at[spread]]
    return contexts, tables, customers


def _seat_parent(sent):
    """Owners seat the customers that their words have now, and answer with what each one holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Totals = sent.value
        numbers = stirling(x.parent_discount)
        for bucket, rows in _buckets(batches):
            asked, came, own = [], [], None
            for kind, src, data in rows:
                if kind == WORDS:
                    own = data
                elif kind == ASKED:
                    asked.append(data)
                else:
                    came.append((src, data))
            if own is None:
                w, alone, n = _summed(np.concatenate([a["w"] for a in asked]), *(np.concatenate([a[c] for a in asked]) for c in ("alone", "n")))
                own = {"w": w, "alone": alone, "n": n, "t": np.ones(len(w), np.int64), "mean": np.zeros(len(w))}
            customers = own["alone"].copy()
            for _, data in came:
                customers[np.searchsorted(own["w"], data["w"])] += data["t"]
            rng = np.random.default_rng([x.seed, 1, x.sweep, bucket])
            level = np.full(len(customers), -np.log(x.words + 1))
            own["t"] = seat(customers, level, np.maximum(x.tables - own["t"], 0), x.parent_discount, x.strength, numbers, rng)
            mass = (customers - x.parent_discount * own["t"]) / (x.strength + x.customers)
            if x.kept:
                own["mean"] = own["mean"] + mass
            out = [(WORDS, bucket, -1, int(own["t"].sum()), _pack(**own))]
            out += [(ANSWERS, src, bucket, 0, _pack(mass=mass[np.searchsorted(own["w"], data["w"])].astype(np.float32))) for src, data in came]
            yield _batch(out)

    return run


def _seat_contexts(sent):
    """Buckets seat the customers of their pairs, and send the tables on as customers of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Totals = sent.value
        numbers = stirling(x.discount)
        for bucket, rows in _buckets(batches):
            alone = {"u": np.zeros(0, np.uint64)}
            pairs, answers = None, []
            for kind, src, data in rows:
                if kind == PAIRS:
                    pairs = data
                elif kind == ONCE:
                    alone = data
                else:
                    answers.append((src, data["mass"]))
            if pairs is None or not len(pairs["u"]):
                continue
            u, w, c, t = (pairs[k] for k in "uwct")
            words, place = np.unique(w, return_inverse=True)
            mass = np.concatenate([m for _, m in sorted(answers, key=lambda a: a[0])]).astype(np.float64)
            lone, n = _summed(alone["u"], np.ones(len(alone["u"]), np.int64))
            contexts, tables, _ = _context_tables(x, u, t, n, lone)
            others = tables[np.searchsorted(contexts, u)] - t
            rng = np.random.default_rng([x.seed, 2, x.sweep, bucket])
            pairs["t"] = t = seat(c, np.log(mass + x.even())[place], others, x.discount, x.strength, numbers, rng)
            if x.kept:
                pairs["mean"] = pairs["mean"] + t.astype(np.float32)
            customers = np.bincount(place, weights=t, minlength=len(words)).astype(np.int64)
            out = [(PAIRS, bucket, -1, int(t.sum()), _pack(**pairs))]
            out += [(CUSTOMERS, b, bucket, 0, _pack(w=words[part], t=customers[part])) for b, part in _parts(_owner(words, x.dealing.buckets))]
            yield _batch(out + _dealt(x.dealing, bucket, u, c, t, np.zeros(len(u), bool)))

    return run


def _answered(sent):
    """Each word's averaged probability, to all buckets that asked for it, and to its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        even, kept = sent.value
        for bucket, rows in _buckets(batches):
            own = None
            for kind, src, data in rows:
                if kind == WORDS:
                    own = data
                    p = own["mean"] / kept + even
                    yield _batch([(WORDS, bucket, -1, 0, _pack(w=own["w"], n=own["n"], p=p))])
                else:
                    yield _batch([(ANSWERS, src, bucket, 0, _pack(p=p[np.searchsorted(own["w"], data["w"])].astype(np.float32)))])

    return run


def _valued(sent):
    """What a text gets for a word or pair of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, even, kept = sent.value
        none = np.zeros(0, np.uint64)
        for bucket, rows in _buckets(batches):
            alone, pairs, words, answers = {"u": none, "w": none}, {"u": none, "w": none, "c": np.zeros(0, np.int64), "mean": np.zeros(0)}, {"w": none, "n": np.zeros(0, np.int64), "p": np.zeros(0)}, []
            for kind, src, data in rows:
                if kind == ANSWERS:
                    answers.append((src, data["p"]))
                else:
                    alone, pairs, words = (data if kind == k else old for k, old in ((ONCE, alone), (PAIRS, pairs), (WORDS, words)))
            n = len(alone["u"])
            u, w = (np.concatenate([alone[k], pairs[k]]) for k in "uw")
            c = np.concatenate([np.ones(n, np.int64), pairs["c"]])
            t = np.concatenate([np.ones(n), pairs["mean"].astype(np.float64) / kept])
            held, shared = (np.zeros(0, np.uint64), *[np.zeros(0)] * 2), np.zeros(0)
            if len(u):
                held = _context_tables(x, u, t, np.zeros(0), none, c)
                place = np.searchsorted(held[0], u)
                asked, of = np.unique(w, return_inverse=True)
                p = np.concatenate([p for _, p in sorted(answers, key=lambda a: a[0])]).astype(np.float64)[of]
                shared = np.log10(1 + (c - x.discount * t) / ((x.strength + x.discount * held[1][place]) * p))
            # A word counts as itself and as the context of the next one.
            at, is_context = _among(held[0], words["w"])
            weight = np.zeros(len(words["w"]))
            weight[is_context] = np.log10((x.strength + x.discount * held[1]) / (x.strength + held[2]))[at[is_context]]
            if len(x.contexts):
                at, spread = _among(x.contexts[0], words["w"])
                weight[spread] = np.log10((x.strength + x.discount * x.contexts[2]) / (x.strength + x.contexts[1]))[at[spread]]
            score = np.log10(words["p"] / even) + weight
            begins = np.flatnonzero(held[0] == BEGIN)
            begin = float(np.log10((x.strength + x.discount * held[1][begins[0]]) / (x.strength + held[2][begins[0]]))) if len(begins) else None
            keys = np.concatenate([_word_key(words["w"]), _pair_key(u, w)])
            by = np.argsort(keys)
            data = {"keys": keys[by], "n": np.concatenate([words["n"], np.zeros(len(u), np.int64)])[by], "score": np.concatenate([score, shared])[by].astype(np.float32)}
            yield _batch([(VALUES, bucket, -1, 0, _pack(**data, begin=begin))])

    return run


def _looked_for(sent):
    """Texts with their lengths, and what is to be looked up for them in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealing = sent.value
        for table, u, w, of in _gathered(batches):
            row, ids = table["row"].to_numpy(), table["doc_id"].to_pylist()
            yield _batch([(TEXTS, int(row[0] % dealing.buckets), -1, 0, _pack(row=row, doc_id=ids, tokens=np.bincount(of, minlength=len(row))))])
            bucket = np.concatenate([_owner(w, dealing.buckets), dealing.of(u, w)]).astype(np.uint16 if dealing.buckets <= 1 << 16 else np.uint32)
            by = np.argsort(bucket, kind="stable")
            both = (np.concatenate([_word_key(w), _pair_key(u, w)]) << np.uint64(16) | np.tile(of, 2).astype(np.uint64))[by]
            for b, part in _parts(bucket[by]):
                each = np.sort(both[part])
                starts = np.flatnonzero(np.append(True, each[1:] != each[:-1]))
                times, each = np.diff(np.append(starts, len(each))), each[starts]
                keys, place = each >> np.uint64(16), (each & np.uint64(0xFFFF)).astype(np.uint16)
                starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                yield _batch([(FOUND, b, -1, 0, _pack(keys=keys[starts], each=np.diff(np.append(starts, len(keys))).astype(np.int32), place=place, times=times.astype(np.int32), first=int(row[0])))])

    return run


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each text that was looked at together gets from a bucket: one row for all of them."""
    for bucket, rows in _buckets(batches):
        values = {"keys": np.zeros(0, np.uint64), "n": np.zeros(0, np.int64), "score": np.zeros(0, np.float32)}
        for kind, _, data in rows:
            if kind == VALUES:
                values = data
            elif kind == TEXTS:
                yield _batch([(TEXTS, bucket, -1, int(data["row"][0]), _pack(**data))])
            else:
                at, known = _among(values["keys"], data["keys"])
                known = np.repeat(known, data["each"])
                at, place, times = np.repeat(at, data["each"])[known], data["place"][known], data["times"][known]
                n = values["n"][at]
                gained = (times * (n > 0), times * np.where(n > 0, np.log10(2 * n + 1), 0), times * values["score"][at].astype(np.float64))
                sums = [np.bincount(place, weights=v) for v in gained]
                some = np.flatnonzero(np.bincount(place))
                if len(some):
                    yield _batch([(GAINED, bucket, -1, int(data["first"]), _pack(place=some.astype(np.uint16), known=sums[0][some].astype(np.int64), base=sums[1][some], score=sums[2][some]))])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that were looked at together, with all that they got."""
    names, now, texts, sums = ["doc_id", "n_tokens", "n_known", "base", "score"], None, None, {}

    def told() -> pa.RecordBatch:
        n = len(texts["tokens"])
        columns = [sums[c][:n].astype(t) for c, t in (("known", np.int64), ("base", np.float64), ("score", np.float64))]
        return pa.RecordBatch.from_arrays([pa.array(texts["doc_id"], pa.int64()), pa.array(texts["tokens"].astype(np.int64)), *map(pa.array, columns)], names=names)

    for batch in batches:
        for first, kind, packed in zip(*(batch.column(c).to_pylist() for c in ("total", "kind", "data")), strict=True):
            if first != now:
                if texts is not None:
                    yield told()
                now, texts, sums = first, None, {c: np.zeros(TEXTS_AT_ONCE) for c in ("known", "base", "score")}
            data = _unpack(packed)
            if kind == TEXTS:
                texts = data
            else:
                for c, total in sums.items():
                    total[data["place"]] += data[c]
    if texts is not None:
        yield told()


@dataclass
class Model:
    """What has been learnt: tables in the shared folder and totals."""

    ws: Workspace
    totals: Totals
    tokens: int
    even: float = 1.0
    kept: int = 1
    pairs: DataFrame | None = None  # ONCE and PAIRS
    words: DataFrame | None = None  # WORDS
    asked: DataFrame | None = None  # ASKED


def _by_bucket(rows: DataFrame, buckets: int, order: Column | str = "kind") -> DataFrame:
    return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", order)


def _spread(rows: DataFrame, before: tuple) -> tuple:
    """Contexts that are dealt out by pair: hashes, customers, tables; ``before`` has the customers
    and the tables of pairs seen once, which stay."""
    parts = [_unpack(r.data) for r in rows.where(F.col("kind") == DEALT).select("data").toLocalIterator()]
    if not parts:
        return before
    u, c, t, alone = _summed(np.concatenate([p["u"] for p in parts]), *(np.concatenate([p[k] for p in parts]) for k in ("c", "t", "alone")))
    if not before:
        return u, c, t, alone
    tables = before[3].copy()
    tables[np.searchsorted(before[0], u)] += t
    return before[0], before[1], tables, before[3]


def learn(spark: SparkSession, docs: DataFrame, *, sweeps: int = SWEEPS, first: int = FIRST, strength: float = STRENGTH, bucket: int = BUCKET, seed: int = 1) -> Model:
    """The model of all rows of ``docs`` (text), after one sweep or more. A null text has no word,
    only its end."""
    ws, context = Workspace(spark, "model"), spark.sparkContext
    texts = docs.select(F.col("text").cast("string").alias("text"))
    sizes = ws.save(texts.mapInArrow(_sizes, "n long, contexts array<long>, counts array<long>"), "sizes")
    tokens = sizes.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-tokens // bucket))
    often = sizes.select(F.explode(F.arrays_zip("contexts", "counts")).alias("x")).groupBy("x.contexts").agg(F.sum("x.counts").alias("n")).where(F.col("n") >= bucket // 2)
    # No more than two for each bucket's worth of tokens.
    spread = np.sort(np.array([r[0] for r in often.collect()], np.int64).view(np.uint64)) if buckets > 1 else np.zeros(0, np.uint64)
    dealing = Dealing(buckets, spread)
    totals = Totals(dealing, 0.5, 0.5, strength, seed, 0)
    if not tokens:
        return Model(ws, totals, 0)
    with shuffles_removed(spark):
        sent = context.broadcast(dealing)
        pairs = ws.save(_by_bucket(texts.mapInArrow(_counted(sent), _SCHEMA), buckets).mapInArrow(_merged(sent), _SCHEMA), "pairs")
        of = {r.kind: r.n for r in pairs.groupBy("kind").agg(F.sum("total").alias("n")).collect()}
        asked = pairs.where(F.col("kind") == ASKED)
        once, state, sent_on = pairs.where(F.col("kind") == ONCE), pairs.where(F.col("kind") == PAIRS), pairs.where(F.col("kind") == CUSTOMERS)
        found = asked.select("bucket", "data").repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_distinct, "words long, alone long, twice long")
        words, alone, doubled = (x or 0 for x in found.agg(F.sum("words"), F.sum("alone"), F.sum("twice")).first())
        totals = Totals(
            dealing, discount=_discount(of[ONCE], of[TWICE]), parent_discount=_discount(alone, doubled),
            strength=strength, seed=seed, words=words, customers=of[ONCE] + of[PAIRS], tables=words, contexts=_spread(pairs, ()),
        )
        owned, even, kept, answers, moved, parent = asked, 0.0, 0, None, None, None
        for sweep in range(sweeps + 1):
            totals = _changed(totals, sweep=sweep, kept=sweep > first or sweep == sweeps)
            if sweep:
                before, both = moved, _by_bucket(once.union(state).union(answers), buckets)
                moved = ws.save(both.mapInArrow(_seat_contexts(context.broadcast(totals)), _SCHEMA), "contexts")
                if before is not None:
                    ws.drop(before)
                state, sent_on = moved.where(F.col("kind") == PAIRS), moved.where(F.col("kind") == CUSTOMERS)
                seated = state.agg(F.sum("total")).first()[0] or 0
                totals = _changed(totals, customers=of[ONCE] + seated, contexts=_spread(moved, totals.contexts))
            before, both = parent, _by_bucket(owned.union(sent_on), buckets)
            parent = ws.save(both.mapInArrow(_seat_parent(context.broadcast(totals)), _SCHEMA), "parent")
            if before is not None:
                ws.drop(before)
            owned, answers = parent.where(F.col("kind") == WORDS), parent.where(F.col("kind") == ANSWERS)
            totals = _changed(totals, tables=owned.agg(F.sum("total")).first()[0])
            if totals.kept:
                even, kept = even + totals.even(), kept + 1
    return Model(ws, totals, tokens, even / kept, kept, once.union(state), owned, asked)


def _changed(totals: Totals, **values) -> Totals:
    return Totals(**{**totals.__dict__, **values})


def _discount(once: int, twice: int) -> float:
    """The usual estimate, from how many dishes have one customer and two."""
    return min(max(once / max(1, once + 2 * twice), 0.05), 0.95)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket's own words: how many there are, and how many follow one context or two."""
    rows = ((b, d) for batch in batches for b, d in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True))
    now, held = None, []

    def told() -> pa.RecordBatch:
        _, n = _summed(np.concatenate([x["w"] for x in held]), np.concatenate([x["contexts"] for x in held]))
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()) for k in (len(n), int((n == 1).sum()), int((n == 2).sum()))], names=["words", "alone", "twice"])

    for b, d in rows:
        if held and b != now:
            yield told()
            held = []
        now = b
        held.append(_unpack(d))
    if held:
        yield told()


def score_texts(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for each row of ``docs`` (doc_id, text)."""
    ws, context, x = model.ws, spark.sparkContext, model.totals
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = x.dealing.buckets
    level = float(np.log10(0.5 / (model.tokens + 0.5 * (x.words + 1))))
    with shuffles_removed(spark):
        begin, values = 0.0, None
        if model.tokens:
            # An owner's words come before the questions about them.
            heard = _by_bucket(model.words.union(model.asked), buckets, F.col("kind") != WORDS)
            answers = ws.save(heard.mapInArrow(_answered(context.broadcast((model.even, model.kept))), _SCHEMA), "answers")
            averaged = x
            if len(x.contexts):
                averaged = _changed(x, contexts=_means(model, x))
            all_ = model.pairs.union(answers)
            values = ws.save(_by_bucket(all_, buckets).mapInArrow(_valued(context.broadcast((averaged, model.even, model.kept))), _SCHEMA), "values")
            ws.keep_only(values)
            begin = _begin(values, averaged)
        wanted = rows.mapInArrow(_looked_for(context.broadcast(x.dealing)), _SCHEMA)
        wanted = wanted.union(values) if values is not None else wanted
        gained = _by_bucket(wanted, buckets).mapInArrow(_looked_up, _SCHEMA)
        together = gained.repartition("total").sortWithinPartitions("total", "bucket")
        out = together.mapInArrow(_added, "doc_id long, n_tokens long, n_known long, base double, score double")
        each = F.log10(F.lit(model.even)) if model.tokens else F.lit(0.0)
        out = out.select(
            "doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
            (F.col("n_tokens") * level + F.col("base")).alias("base_score"), (F.col("n_tokens") * each + begin + F.col("score")).alias("score"),
        )
        return ws.save(out, "scores")


def _means(model: Model, x: Totals) -> tuple:
    """Customers and averaged tables of the contexts that are dealt out by pair."""
    sent = model.ws.spark.sparkContext.broadcast(x.dealing)
    kept = model.kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in map(_unpack, batch.column("data").to_pylist()):
                t = data["mean"].astype(np.float64) / kept if "mean" in data else np.ones(len(data["u"]))
                yield _batch(_dealt(sent.value, 0, data["u"], np.zeros(len(t), np.int64), t, np.zeros(len(t), bool)))

    u, _, t, _ = _spread(model.pairs.select("data").mapInArrow(run, _SCHEMA), ())
    return u, x.contexts[1], t


def _begin(values: DataFrame, x: Totals) -> float:
    """What a text's beginning weighs as a context."""
    if len(x.contexts):
        at, there = _among(x.contexts[0], np.array([BEGIN]))
        if there[0]:
            return float(np.log10((x.strength + x.discount * x.contexts[2][at[0]]) / (x.strength + x.contexts[1][at[0]])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [b for b in (_unpack(d)["begin"] for d in batch.column("data").to_pylist()) if b is not None]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64())], names=["begin"])

    return values.select("data").mapInArrow(run, "begin double").agg(F.max("begin")).first()[0]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def score(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``
    (doc_id, text): the log10 probability of its words and end under the model learnt from all rows
    whose crc32 of doc_id leaves another rest than 1 when divided by 5; ``base_score`` is that of
    smoothed counts of single words.

    A null or empty text is just its end. A row without a doc_id isn't held out. Repeated rows count
    each time and each get their row. Without any row to learn from all words are unknown. An empty
    table gives an empty result; other columns are ignored. Reruns on the same number of buckets agree.
    """
    model = learn(spark, docs.where(~held_out()), **options)
    return score_texts(spark, docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
