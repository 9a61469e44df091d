"""Document quality from random-indexing word vectors and a small network.

A text's tokens are its runs of letters, of digits and of other marks. Random indexing gives every
token a sparse random index vector, which follows from its hash; its word vector is the sum of the
index vectors of its neighbours within WINDOW tokens over all documents, counted in whole numbers:
tasks add up what they read by token, Spark adds these up, and a token has a row of its own. One
seen less than RARE times in all, whatever the corpus's size, has too few neighbours to tell
anything; it takes the vector of all such tokens of its kind (letters, digits or marks, and how
long). Tokens are counted first, so that sums of rare ones don't travel.

A document is the mean and the spread of its tokens' unit vectors, its length and how often it
repeats itself. Workers hold the commonest tokens' vectors, up to HELD of them; what the others add
to a document comes from a join. A two-layer network is fitted on a bounded sample of labelled rows,
SAMPLE of those with the least hashes, and a temperature fitted on a part kept aside makes its
probabilities honest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from .common import Workspace, least_hashes, shuffles_removed
from .shingles import mix, token_hashes

DIMENSIONS = 16
NONZERO = 4
WINDOW = 2
RARE = 20
#: Tokens whose vectors a worker holds; some 70 bytes each.
HELD = 500_000
#: Tokens that a task adds up before it passes sums on.
SUMMED = 400_000
#: Texts that are cut into tokens at once, which bounds what a worker holds.
TEXTS = 64
#: Tokens that it reads before it does so, which keeps sums below 2**31.
READ = 1 << 26
SAMPLE = 20_000
HIDDEN = 32
THRESHOLD = 0.3
FEATURES = 2 * DIMENSIONS + 3
_AXES = [f"v{i}" for i in range(DIMENSIONS)]


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """The sparse random vectors of tokens: NONZERO times 1 or -1, at places that the hash tells."""
    bits = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    out, row = np.zeros((len(hashes), DIMENSIONS), np.int8), np.arange(len(hashes))
    for k in range(NONZERO):
        part = (bits >> np.uint64(8 * k)).astype(np.int64)
        out[row, part % DIMENSIONS] += np.where(part & 128, 1, -1).astype(np.int8)
    return out


def _distinct(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct tokens, order that sorts tokens, starts of each in it, each token's place among the
    distinct ones); there must be some."""
    order = np.argsort(tokens)
    ordered = tokens[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    starts, places = np.flatnonzero(new), np.empty(len(tokens), np.int64)
    places[order] = np.cumsum(new) - 1
    return ordered[starts], order, starts, places


def _grouped(keys: np.ndarray, kinds: np.ndarray, seen: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows added up by key, sorted by it."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    if not len(first):
        return keys, kinds, seen, sums
    return keys[first], kinds[order][first], np.add.reduceat(seen[order], first), np.add.reduceat(sums[order], first, axis=0)


_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def _written(keys: np.ndarray, kinds: np.ndarray, seen: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows with sums as bytes, in the narrowest whole numbers that hold them: most tokens are rare."""
    most = np.abs(sums).max(axis=1, initial=0)
    low = 0
    for width in _WIDTHS:
        high = np.iinfo(width).max
        of = (most >= low) & (most < high)
        low = high
        if of.any():
            size = DIMENSIONS * np.dtype(width).itemsize
            vectors = pa.Array.from_buffers(pa.binary(), int(of.sum()), [None, pa.py_buffer(np.arange(of.sum() + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(sums[of].astype(width).tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(keys[of].view(np.int64)), pa.array(kinds[of]), pa.array(seen[of]), vectors], names=["token", "kind", "seen", "vector"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, seen): how often each token is seen."""
    held, n = [], 0

    def rows() -> pa.RecordBatch:
        keys, places = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        seen = np.bincount(places, np.concatenate([c for _, c in held])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(seen)], names=["token", "seen"])

    for whole in batches:
        for start in range(0, whole.num_rows, TEXTS):
            tokens, _, _ = token_hashes(whole.slice(start, TEXTS).column(0))
            if len(tokens):
                held.append(np.unique(tokens, return_counts=True))
                n += len(held[-1][0])
                if n > SUMMED:
                    yield rows()
                    held, n = [], 0
    if held:
        yield rows()


def _among(ordered: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's place in a sorted array, and whether it is there."""
    at = np.minimum(np.searchsorted(ordered, tokens), max(len(ordered) - 1, 0))
    return at, ordered[at] == tokens if len(ordered) else np.zeros(len(tokens), bool)


def _neighbours(keep):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(token, kind, seen, vector): how often each token is seen, and the sum of its neighbours'
        index vectors. If it is known which tokens to ``keep``, others are added up by kind, as rows
        with their kind in place of the token that are never seen."""
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, DIMENSIONS), np.int32))
        held, n, read = [none], 0, 0
        rare = np.zeros((64, DIMENSIONS), np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                tokens, at, kinds = token_hashes(whole.slice(start, TEXTS).column(0))
                if not len(tokens):
                    continue
                unique, order, starts, places = _distinct(tokens)
                own = index_vectors(unique)[places]
                text = np.repeat(np.arange(len(at) - 1), np.diff(at))
                near = np.zeros((len(tokens), DIMENSIONS), np.int8)  # from -16 to 16
                for d in range(1, WINDOW + 1):
                    same = (text[:-d] == text[d:])[:, None]
                    near[:-d] += own[d:] * same
                    near[d:] += own[:-d] * same
                made = (unique, kinds[order[starts]], np.diff(starts, append=len(tokens)), np.add.reduceat(near[order], starts, axis=0, dtype=np.int32))
                if keep is not None:
                    _, found = _among(keep.value, unique)
                    np.add.at(rare, made[1][~found], made[3][~found])
                    made = tuple(x[found] for x in made)
                held.append(made)
                n, read = n + len(made[0]), read + len(tokens)
                if n > SUMMED or read > READ:
                    held = [_grouped(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    n = len(held[0][0])
                    if n > SUMMED * 3 // 4 or read > READ:
                        yield from _written(*held[0])
                        held, n, read = [none], 0, 0
        yield from _written(*_grouped(*(np.concatenate(x) for x in zip(*held, strict=True))))
        some = np.flatnonzero(np.abs(rare).sum(axis=1))
        if len(some):
            yield from _written(some.astype(np.uint64), some.astype(np.int32), np.zeros(len(some), np.int64), rare[some])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, kind, seen, v0, v1, ...) of rows as _neighbours() makes them, sorted by token. What a
    batch ends with may go on in the next one."""
    last: tuple = ()
    for batch in batches:
        keys, kinds, seen = (batch.column(c).to_numpy() for c in ("token", "kind", "seen"))
        if not len(keys):
            continue
        lengths = pc.binary_length(batch.column("vector")).to_numpy()
        sums = np.zeros((len(keys), DIMENSIONS), np.int64)
        for width in _WIDTHS:
            of = np.flatnonzero(lengths == DIMENSIONS * np.dtype(width).itemsize)
            sums[of] = np.frombuffer(b"".join(batch.column("vector").take(pa.array(of)).to_pylist()), width).reshape(-1, DIMENSIONS)
        if last:
            keys, kinds, seen, sums = (np.concatenate(x) for x in zip(last, (keys, kinds, seen, sums), strict=True))
        keys, kinds, seen, sums = _grouped(keys, kinds, seen, sums)
        last = (keys[-1:], kinds[-1:], seen[-1:], sums[-1:])
        yield _totals(keys[:-1], kinds[:-1], seen[:-1], sums[:-1])
    if last:
        yield _totals(*last)


def _totals(keys: np.ndarray, kinds: np.ndarray, seen: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(kinds), pa.array(seen), *(pa.array(c.copy()) for c in sums.T)], names=["token", "kind", "seen", *_AXES])


def word_vectors(ws: Workspace, docs: DataFrame, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """Unit vectors over all of ``docs`` (text): (token, seen, v0, ...) of the tokens seen RARE times
    or more, and (kind, v0, ...) of each kind of the others. A vector without any sum is 0. Workers
    are told which tokens these are if there are no more than ``held``."""
    schema = "token long, kind int, seen long, " + ", ".join(f"{x} long" for x in _AXES)
    sums = [F.sum(x).alias(x) for x in _AXES]
    often = docs.select("text").mapInArrow(_counts, "token long, seen long").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= RARE)
    often = ws.save(often.select("token"), "often")
    keep = None
    if often.count() <= held:
        keep = ws.spark.sparkContext.broadcast(np.sort(often.toArrow()["token"].to_numpy().view(np.uint64)))
    parts = docs.select("text").mapInArrow(_neighbours(keep), "token long, kind int, seen long, vector binary")
    with shuffles_removed(ws.spark):
        every = ws.save(parts.repartition("token").sortWithinPartitions("token").mapInArrow(_added, schema), "sums")

    def units(df: DataFrame, *keep: str) -> DataFrame:
        norm = F.sqrt(sum(F.col(x).cast("double") * F.col(x) for x in _AXES))
        return df.withColumn("norm", F.when(norm > 0, norm).otherwise(1.0)).select(*keep, *[(F.col(x) / F.col("norm")).cast("float").alias(x) for x in _AXES])

    rare = every.where(F.col("seen") < RARE).groupBy("kind").agg(*sums)
    words, kinds = ws.save(units(every.where(F.col("seen") >= RARE), "token", "seen"), "words"), ws.save(units(rare, "kind"), "kinds")
    ws.drop(every, often)
    return words, kinds


class Vectors:
    """What a worker holds: the vectors of tokens (sorted hashes) and of kinds. ``whole`` says that
    no token has a row of its own but those held here."""

    def __init__(self, words: DataFrame, kinds: DataFrame, held: int):
        total = words.count()
        self.whole = total <= held
        if not self.whole:
            words = words.where(F.col("seen") > _seen_by(words, held))
        table = words.select("token", *_AXES).toArrow()
        tokens = table["token"].to_numpy().view(np.uint64)
        order = np.argsort(tokens)
        self.tokens = tokens[order]
        self.vectors = np.vstack([np.column_stack([table[x].to_numpy() for x in _AXES]).reshape(-1, DIMENSIONS)[order], np.zeros((64, DIMENSIONS))]).astype(np.float32)
        for row in kinds.collect():  # 64 at most
            self.vectors[len(tokens) + row["kind"]] = [row[x] for x in _AXES]

    def places(self, tokens: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's place among the vectors, that of its kind if it isn't held; and whether it is."""
        at, found = _among(self.tokens, tokens)
        return np.where(found, at, len(self.tokens) + kinds), found


def _seen_by(words: DataFrame, most: int) -> int:
    """A power of two, less one, so that no more than so many tokens are seen more often."""
    by = words.groupBy(F.floor(F.log2("seen")).cast("int").alias("power")).count().collect()  # 64 rows at most
    held = 0
    for power, n in sorted(((r["power"], r["count"]) for r in by), reverse=True):
        held += n
        if held > most:
            return (2 << power) - 1
    return 0


def sums_of(column: pa.Array, held: Vectors) -> tuple[np.ndarray, np.ndarray, list]:
    """For each text: (tokens, share of repeats) and the sums of its tokens' vectors and of their
    squares; and, unless all vectors are held, (token, times) of those that aren't held. What their
    kinds add is in the sums, and what their own vectors add beyond that is for a join to find."""
    tokens, at, kinds = token_hashes(column)
    n = len(at) - 1
    text = np.repeat(np.arange(n), np.diff(at))
    if not len(tokens):
        return np.zeros((n, 2)), np.zeros((n, 2 * DIMENSIONS)), [[] for _ in range(n)]
    unique, order, starts, place = _distinct(tokens)
    first = order[starts]
    cells, times = np.unique(text * len(unique) + place, return_counts=True)
    row, word = cells // len(unique), cells % len(unique)
    total = np.diff(at).astype(np.float64)
    again = np.bincount(row, times.astype(np.float64) ** 2, minlength=n) / np.maximum(total, 1) ** 2
    places, found = held.places(unique, kinds[first])
    own = held.vectors[places].astype(np.float64)
    sums = np.zeros((n, 2 * DIMENSIONS))
    starts = np.searchsorted(row, np.arange(n))
    some = total > 0
    if some.any():
        each = own[word] * times[:, None]
        sums[some] = np.hstack([np.add.reduceat(x, starts[some], axis=0) for x in (each, each * own[word])])
    rest: list = [[] for _ in range(n)]
    if not held.whole:
        for k in np.flatnonzero(~found[word]).tolist():
            rest[row[k]].append({"token": int(unique[word[k]].view(np.int64)), "times": int(times[k]), "kind": int(kinds[first[word[k]]])})
    return np.column_stack([total, again]), sums, rest


def features(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    total, again = counts[:, :1], counts[:, 1:]
    mean, square = np.hsplit(sums / np.maximum(total, 1), 2)
    spread = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.hstack([mean, spread, np.log1p(total) / 5, np.log(again + 1e-4), again * np.log1p(total)]).astype(np.float32)


class Network:
    """Two layers, rectified in between, on standardised features; or a constant, if what it is to
    learn has one class or no rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, aside: np.ndarray):
        self.constant = float(y.mean()) if len(y) else 0.5
        fit = ~aside if 0 < y[~aside].sum() < (~aside).sum() else np.ones(len(y), bool)
        self.trained = bool(0 < y[fit].sum() < fit.sum())
        if not self.trained:
            return
        rng = np.random.default_rng(20240508)
        self.mean, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
        z, t = (x[fit] - self.mean) / self.scale, y[fit].astype(np.float32)
        self.layers = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        self.layers = [a.astype(np.float32) for a in self.layers]
        first, second, step = [np.zeros_like(a) for a in self.layers], [np.zeros_like(a) for a in self.layers], 0
        for _ in range(max(30, min(400, 200_000 // len(z)))):
            order = rng.permutation(len(z))
            for a in range(0, len(z), 256):
                of = order[a : a + 256]
                step += 1
                hidden = np.maximum(z[of] @ self.layers[0] + self.layers[1], 0)
                error = (1 / (1 + np.exp(-(hidden @ self.layers[2] + self.layers[3]))) - t[of]) / len(of)
                back = error[:, None] * self.layers[2] * (hidden > 0)
                slopes = [z[of].T @ back + 1e-4 * self.layers[0], back.sum(axis=0), hidden.T @ error + 1e-4 * self.layers[2], error.sum(keepdims=True)]
                for i, g in enumerate(slopes):  # Adam
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    self.layers[i] -= (0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        # The temperature that makes the rows kept aside likeliest.
        self.temperature = 1.0
        check = aside if aside.any() and fit.sum() < len(y) else fit
        raw, want = self.logits(x[check]), y[check]
        loss = [np.logaddexp(0, np.where(want == 1, -raw, raw) / t).mean() for t in np.geomspace(0.5, 8, 41)]
        self.temperature = float(np.geomspace(0.5, 8, 41)[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.layers[0] + self.layers[1], 0)
        return (hidden @ self.layers[2] + self.layers[3]).astype(np.float64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


_FEATURES = ArrayType(FloatType())
_SUMS = "total double, again double, sums array<double>, rest array<struct<token:bigint,times:bigint,kind:int>>"


def _schema(df: DataFrame, without: str, *more: StructField) -> StructType:
    return StructType([f for f in df.schema.fields if f.name != without] + list(more))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def pooled(ws: Workspace, rows: DataFrame, vectors: tuple[DataFrame, DataFrame], most: int, network: Network | None = None) -> DataFrame:
    """``rows`` (row, text and others) with features in place of text: those of the whole text, with
    every token's own vector; or, given a network, with the score that it makes of them, in the same
    pass, so that a task has one Python worker."""
    words, kinds = vectors
    scorer = ws.spark.sparkContext.broadcast(network) if network else None
    result = "score" if network else "features"

    def column(counts: np.ndarray, sums: np.ndarray) -> pa.Array:
        x = features(counts, sums)
        return pa.array(scorer.value(x).astype(np.float64)) if scorer else pa.array(list(x), pa.list_(pa.float32()))

    held = Vectors(words, kinds, most)
    sent = ws.spark.sparkContext.broadcast(held)
    keep = [c for c in rows.columns if c != "text"]
    schema = _schema(rows, "text", StructField(result, DoubleType() if network else _FEATURES))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                counts, sums, rest = sums_of(batch.column("text"), sent.value)
                own = [batch.column(c) for c in keep]
                if sent.value.whole:
                    yield pa.RecordBatch.from_arrays([*own, column(counts, sums)], names=[*keep, result])
                else:
                    made = [pa.array(counts[:, 0]), pa.array(counts[:, 1]), pa.array(list(sums), pa.list_(pa.float64()))]
                    made.append(pa.array(rest, pa.list_(pa.struct([("token", pa.int64()), ("times", pa.int64()), ("kind", pa.int32())]))))
                    yield pa.RecordBatch.from_arrays([*own, *made], names=[*keep, "total", "again", "sums", "rest"])

    if held.whole:
        return rows.mapInArrow(read, schema)
    texts = ws.save(rows.mapInArrow(read, _schema(rows, "text", *StructType.fromDDL(_SUMS).fields)), "texts")
    rest = texts.select("row", F.inline("rest")).join(words.select("token", *_AXES), "token")
    # A kind that no rare token has isn't there, and its vector is 0.
    as_kind = F.broadcast(kinds.select(F.col("kind").alias("of"), *[F.col(x).alias(f"k{x}") for x in _AXES]))
    rest = rest.join(as_kind, F.col("kind") == F.col("of"), "left")
    value, old = [[F.coalesce(F.col(f"{p}{x}").cast("double"), F.lit(0.0)) for x in _AXES] for p in ("", "k")]
    adds = [F.sum(F.col("times") * (a - b)) for a, b in zip(value, old, strict=True)] + [F.sum(F.col("times") * (a * a - b * b)) for a, b in zip(value, old, strict=True)]
    adds = rest.groupBy("row").agg(F.array(*adds).alias("adds"))
    whole = F.zip_with("sums", F.coalesce("adds", F.array_repeat(F.lit(0.0), 2 * DIMENSIONS)), lambda a, b: a + b)
    joined = texts.drop("rest").join(adds, "row", "left").select(*keep, "total", "again", whole.alias("sums"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                counts = np.column_stack([batch.column("total").to_numpy(), batch.column("again").to_numpy()])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), column(counts, _numbers(batch.column("sums")))], names=[*keep, result])

    return joined.mapInArrow(finish, schema)


def _share(doc_id: str, parts: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % parts


def train(ws: Workspace, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held: int = HELD) -> tuple[tuple[DataFrame, DataFrame], Network]:
    """Word vectors over all ``docs`` (doc_id, text), and the network fitted on labelled ones;
    ``labels`` is (doc_id, quality). Rows with crc32(doc_id) mod 5 = 0 are never learnt from. A
    doc_id with several labels has the rounded mean, one with several texts is learnt from the
    least; null labels don't count."""
    vectors = word_vectors(ws, docs, held)
    known = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    known = known.where(_share("doc_id", 5) != 0)
    known = ws.save(known, "known")
    known = ws.save(least_hashes(known, "doc_id", sample), "labels")
    rows = docs.where(_share("doc_id", 5) != 0).join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    made = ws.save(pooled(ws, rows.withColumn("row", F.col("doc_id")), vectors, held).select("doc_id", "quality", "features"), "features")
    table = made.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()  # ``sample`` rows at most
    x = np.array(table["features"].to_pylist(), np.float32).reshape(-1, FEATURES)
    y = table["quality"].to_numpy().astype(int)
    ws.keep_only(*vectors)
    aside = np.array([i % 5 == 0 for i in range(len(y))], bool)
    return vectors, Network(x, y, aside)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held: int = HELD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text).

    score is the probability of label 1, from the text alone; predicted is 1 from THRESHOLD on.
    Null and empty texts have a score like any other, that of no tokens. Without labels, or with
    one label only, all scores are that label's share, or 0.5. A null doc_id isn't held out.
    Repeated rows each get their row; an empty table gives an empty result; other columns are
    ignored. ``held`` bounds what workers hold and changes no result.
    """
    ws = Workspace(spark, "quality")
    texts = _texts(docs)
    vectors, network = train(ws, texts, labels, sample, held)
    scored = pooled(ws, texts.withColumn("row", F.monotonically_increasing_id()), vectors, held, network)
    return scored.select("doc_id", F.coalesce(_share("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, held: int = HELD) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) whose score is THRESHOLD or more, with all
    their columns as they are. Each row is judged by its own text, null and empty ones as texts
    without tokens; repeated rows stay or go together; of an empty table none is left."""
    ws = Workspace(spark, "quality")
    vectors, network = train(ws, _texts(docs), labels, held=held)
    # A struct keeps all columns apart from those that are added.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    return pooled(ws, rows, vectors, held, network).where(F.col("score") >= THRESHOLD).select("doc.*")
