"""A stored index for nearest neighbours: layered graphs of neighbours, one for each shard of the vectors.

Vectors are dealt to shards of some SHARD rows by a hash of their id. A task builds its shard's graph:
on every layer a vector is linked with near ones of which none is nearer to another one than to it, and
these with it. Layer 0 holds all vectors, each one above it a sixteenth of those below. A search goes
down the layers of every shard, keeps the ``beam`` best on the last, and the shards' best are merged.
Neighbours may be missed; ``beam`` is the trade. A collection gets an index from a number of rows on,
below that it is scanned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Settings
from .dense import BATCH, clamp, nearest, top_rows

#: Rows of a shard, links of a vector (twice as many where others link with it), candidates for each
#: link, the part of a layer that the next one holds, and rows that are compared at once.
SHARD, LINKS, CANDIDATES, THINNER, BLOCK = 20_000, 24, 3, 16, 256

_NODES = "shard int, place int, id long, vector array<float>, links array<array<int>>"


def _linked(x: np.ndarray) -> list[np.ndarray]:
    """Links of each row of x, of unit length, the nearest first."""
    n, k = len(x), min(len(x) - 1, LINKS * CANDIDATES)
    if k < 1:
        return [np.zeros(0, np.int64)] * n
    pairs = []
    for at in range(0, n, BLOCK):
        rows = np.arange(at, min(at + BLOCK, n))
        near = x[rows] @ x.T
        near[np.arange(len(rows)), rows] = -np.inf
        some = np.argpartition(-near, k - 1, axis=1)[:, :k]
        scores = np.take_along_axis(near, some, axis=1)
        by = np.lexsort((some, -scores), axis=1)
        some, scores = np.take_along_axis(some, by, axis=1), np.take_along_axis(scores, by, axis=1)
        between = np.einsum("ikd,ijd->ikj", x[some], x[some])
        kept = np.zeros(some.shape, bool)
        for j in range(k):  # kept unless one that is kept is nearer to it; copies are alike to all
            hidden = (kept[:, :j] & (between[:, j, :j] >= scores[:, j, None]) & (between[:, j, :j] < 1 - 1e-6)).any(axis=1)
            kept[:, j] = ~hidden & (kept.sum(axis=1) < LINKS)
        a, b = np.nonzero(kept)
        pairs.append((rows[a], some[a, b], scores[a, b]))
    a, b, s = (np.concatenate(c) for c in zip(*pairs, strict=True))
    both = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = both // n, both % n
    s = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)])
    by = np.lexsort((b, -s, a))
    a, b = a[by], b[by]
    starts = np.searchsorted(a, np.arange(n + 1))
    return [b[i : min(i + 2 * LINKS, j)] for i, j in zip(starts[:-1], starts[1:], strict=True)]


def _levels(ids: np.ndarray) -> np.ndarray:
    """The highest layer of each id, from a hash of it."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    even = ((h >> np.uint64(11)).astype(np.float64) + 1) / 2**53
    return np.minimum(np.floor(-np.log(even) / np.log(THINNER)), 8).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by shard, a shard at a time."""
    held, now = [], None
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        edges = np.flatnonzero(shards[1:] != shards[:-1]) + 1
        for a, b in zip([0, *edges], [*edges, len(shards)], strict=True):
            if b > a:
                if now is not None and shards[a] != now:
                    yield pa.Table.from_batches(held)
                    held = []
                now = shards[a]
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _rows(batches):
        ids, lists = table["id"].to_numpy(), table["vector"].combine_chunks()
        sizes = np.asarray(lists.value_lengths())
        width = int(np.bincount(sizes).argmax())
        x = np.array([v for v, n in zip(lists.to_pylist(), sizes, strict=True) if n == width], np.float64).reshape(-1, width)
        norms = np.linalg.norm(x, axis=1)
        sound = np.isfinite(norms) & (norms > 0)
        ids, x = ids[sizes == width][sound], (x[sound] / norms[sound, None]).astype(np.float32)
        top = _levels(ids)
        links: list[list[np.ndarray]] = [[] for _ in ids]
        for level in range(int(top.max(initial=0)) + 1):
            of = np.flatnonzero(top >= level)
            for i, near in zip(of.tolist(), _linked(x[of]), strict=True):
                links[i].append(of[near].astype(np.int32))
        for at in range(0, len(ids), 2048):
            part = slice(at, min(at + 2048, len(ids)))
            n = len(ids[part])
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(x[part].ravel(), pa.float32()))
            columns = [pa.array(np.full(n, table["shard"][0].as_py()), pa.int32()), pa.array(np.arange(at, at + n), pa.int32()), pa.array(ids[part]), vectors, pa.array(links[part], pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _NODES.split(", ")])


class _Graph:
    """A shard in memory."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("place")
        self.ids = table["id"].to_numpy()
        self.x = table["vector"].combine_chunks().flatten().to_numpy().reshape(len(self.ids), -1)
        links = table["links"].combine_chunks()
        self.of = np.append(0, np.cumsum(np.asarray(links.value_lengths())))  # a node's layers
        inner = links.flatten()
        self.to, self.at = inner.flatten().to_numpy(), np.append(0, np.cumsum(np.asarray(inner.value_lengths())))
        layers = np.diff(self.of)
        self.top = int(layers.max()) - 1
        self.entries = np.flatnonzero(layers == layers.max())
        #: Vectors that queries were compared with.
        self.compared = 0

    def links(self, node: int, level: int) -> np.ndarray:
        k = self.of[node] + level
        return self.to[self.at[k] : self.at[k + 1]]

    def search(self, q: np.ndarray, beam: int) -> list[tuple[float, int]]:
        start = self.entries
        for level in range(self.top, -1, -1):
            found = self._layer(q, start, level, beam if level == 0 else 1)
            start = np.array([i for _, i in found], np.int64)
        return found

    def _layer(self, q: np.ndarray, start: np.ndarray, level: int, beam: int) -> list[tuple[float, int]]:
        """The ``beam`` best that can be reached from ``start`` by going to what is near."""
        seen = np.zeros(len(self.ids), bool)
        seen[start] = True
        scores = (self.x[start] @ q).tolist()
        self.compared += len(start)
        ahead = [(-s, i) for s, i in zip(scores, start.tolist(), strict=True)]
        heapq.heapify(ahead)
        best = heapq.nlargest(beam, ((-s, i) for s, i in ahead))
        heapq.heapify(best)
        while ahead:
            s, node = heapq.heappop(ahead)
            if len(best) == beam and -s < best[0][0]:
                break
            near = self.links(node, level)
            near = near[~seen[near]]
            if len(near):
                seen[near] = True
                self.compared += len(near)
                for s, i in zip((self.x[near] @ q).tolist(), near.tolist(), strict=True):
                    if len(best) < beam:
                        heapq.heappush(best, (s, i))
                        heapq.heappush(ahead, (-s, i))
                    elif s > best[0][0]:
                        heapq.heapreplace(best, (s, i))
                        heapq.heappush(ahead, (-s, i))
        return best


_FOUND = "query_id long, id long, score double, compared long"


def _searched(sent, limit: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, vectors = sent.value
        for table in _rows(batches):
            graph = _Graph(table)
            if graph.x.shape[1] != vectors.shape[1]:
                continue
            out: tuple[list, list, list, list] = ([], [], [], [])
            for query, q in zip(queries.tolist(), vectors, strict=True):
                before = graph.compared
                found = graph.search(q.astype(np.float32), beam)
                at = np.array([i for _, i in found], np.int64)
                scores = np.round(graph.x[at].astype(np.float64) @ q, 6)
                by = np.lexsort((graph.ids[at], -scores))[:limit]
                out[0].extend([query] * len(by))
                out[1].extend(graph.ids[at][by].tolist())
                out[2].extend(scores[by].tolist())
                out[3].extend([graph.compared - before, *[0] * (len(by) - 1)])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int64())], names=["query_id", "id", "score", "compared"])

    return run


class GraphIndex:
    """An index in a folder, of vectors by cosine. Vectors that are null, zero or not finite, or of
    another width than most of their shard, aren't in it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        about = spark.read.schema("shards int, rows long").parquet(f"{folder}/about").first()
        self.shards, self.rows = about.shards, about.rows

    @classmethod
    def create(cls, spark: SparkSession, corpus: DataFrame, folder: str, *, threshold: int = Settings.index_threshold, shard: int = SHARD) -> GraphIndex | None:
        """Index ``corpus`` (id, vector) in a new folder, or leave it, where it has fewer than ``threshold`` rows."""
        rows = corpus.where("id is not null and vector is not null and size(vector) > 0 and not exists(vector, v -> v is null)").select(F.col("id").cast("long").alias("id"), "vector")
        total = rows.count()
        if total < threshold:
            return None
        shards = -(-total // shard)
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).repartition(shards, "shard").sortWithinPartitions("shard", "id")
        built = dealt.select("shard", "id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(_built, _NODES)
        built.write.partitionBy("shard").parquet(f"{folder}/nodes")
        spark.createDataFrame([(shards, total)], "shards int, rows long").coalesce(1).write.parquet(f"{folder}/about")
        return cls(spark, folder)

    def nearest(self, queries: DataFrame, limit: int, *, beam: int = 64) -> DataFrame:
        """(query_id, id, score, rank) as ``dense.nearest`` has them, but for what is missed."""
        return top_rows(self.found(queries, limit, beam=beam).drop("compared"), "query_id", clamp(limit), F.desc("score"), F.asc("id"))

    def found(self, queries: DataFrame, limit: int, *, beam: int = 64) -> DataFrame:
        """(query_id, id, score, compared): each shard's best, and on the first row of a query and
        shard how many vectors it was compared with. A batch of queries goes over all shards."""
        limit = clamp(limit)
        nodes = self.spark.read.schema("place int, id long, vector array<float>, links array<array<int>>, shard int").parquet(f"{self.folder}/nodes")
        # A shard is one file at least; its rows come together, however its files were split.
        nodes = nodes.repartition(self.shards, "shard").sortWithinPartitions("shard", "place")
        out = self.spark.createDataFrame([], _FOUND)
        queries = queries.where("vector is not null and not exists(vector, v -> v is null)")
        batches = max(1, -(-queries.count() // BATCH))
        for batch in range(batches):
            rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == batch).select("query_id", "vector").orderBy("query_id").toArrow()
            vectors = rows["vector"].to_pylist()
            width = max(map(len, vectors), default=0)
            sound = [i for i, v in enumerate(vectors) if len(v) == width and np.isfinite(v).all() and np.any(v)]
            if sound:
                x = np.array([vectors[i] for i in sound], np.float64)
                sent = self.spark.sparkContext.broadcast((rows["query_id"].to_numpy()[sound], x / np.linalg.norm(x, axis=1, keepdims=True)))
                out = out.union(nodes.mapInArrow(_searched(sent, limit, max(beam, limit)), _FOUND))
        return out


def indexed_nearest(spark: SparkSession, corpus: DataFrame, queries: DataFrame, limit: int, folder: str, *, threshold: int = Settings.index_threshold, beam: int = 64) -> DataFrame:
    """As ``dense.nearest`` by cosine, through a new index where the corpus is large enough for one."""
    index = GraphIndex.create(spark, corpus, folder, threshold=threshold)
    return nearest(spark, corpus, queries, limit) if index is None else index.nearest(queries, limit, beam=beam)
