"""Near-duplicate embeddings by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions; a projection plus a random offset, divided
by WIDTH and rounded down, is one hash, and a bucket of a table is the combination of ``k`` of them.
Two vectors at distance c share one hash with the chance p(c) of Datar et al. (2004). A table has as
many hashes as leave some BUCKET unrelated vectors (at right angles) of the largest label together,
up to MOST hashes, beyond which buckets grow; the number of tables follows from that, 129 at most, so
that a pair at the threshold misses all tables with a chance of MISS at most.

Identical vectors of a label form one class. What shares a bucket is compared there, before anything
is connected, by SIGNS signs of other projections (see buckets.py): a pair at the threshold differs
in too many of them with a chance of 3e-7, one at a cosine of 0.7 seldom in as few. Exact cosines in
double precision are then computed between all vectors of each connected group, in units of at most
two blocks, since n_links counts all of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buckets as shared
from .common import Workspace, components, small
from .shingles import mix

COSINE = 0.93
WIDTH = 2.5
MISS = 1e-3
BUCKET, FEWEST, MOST = 200, 4, 23
#: Signs of a sketch, and how many may differ: at the threshold, all but five standard deviations.
SIGNS, DIFFERING = 512, 98
#: Vectors in one block of exact comparisons.
BLOCK = 1000


def chance(distance: float) -> float:
    """That two vectors at this distance share one hash."""
    t = WIDTH / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def shape(vectors: int) -> tuple[int, int]:
    """(tables, hashes in each) for so many vectors to be compared with one another."""
    near, far = chance(math.sqrt(2 - 2 * COSINE)), chance(math.sqrt(2))
    k = max(FEWEST, min(MOST, round(math.log(max(vectors, 1) / BUCKET) / -math.log(far))))
    return math.ceil(math.log(MISS) / math.log1p(-(near**k))), k


@cache
def _sign_directions(dim: int) -> np.ndarray:
    return np.random.default_rng([20240510, dim]).standard_normal((dim, SIGNS)).astype(np.float32)


def signs(units: np.ndarray) -> list[bytes]:
    """On which sides of SIGNS random planes each vector lies."""
    return [row.tobytes() for row in np.packbits(units.astype(np.float32) @ _sign_directions(units.shape[1]) > 0, axis=1)]


def alike(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether signs leave it open that vectors have a cosine of COSINE."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= DIFFERING


@cache
def _directions(dim: int, tables: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([20240504, dim])
    return rng.standard_normal((dim, tables * k)).astype(np.float32), rng.uniform(0, WIDTH, tables * k).astype(np.float32)


def buckets(units: np.ndarray, tables: int, k: int) -> np.ndarray:
    """A 64-bit name of each vector's bucket in each table."""
    directions, offsets = _directions(units.shape[1], tables, k)
    steps = np.floor((units.astype(np.float32) @ directions + offsets) / np.float32(WIDTH)).astype(np.int64).view(np.uint64)
    steps = steps.reshape(len(units), tables, k)
    out = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(units), tables)).copy()
    for i in range(k):
        out = mix(out ^ steps[:, :, i])
    return out.view(np.int64)


def _hashes(tables: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                salt = np.array([hash_label(x) for x in batch.column(1).to_pylist()], np.uint64)
                vectors = [np.array(v, np.float64) for v in batch.column(2).to_pylist()]
                names: list = [None] * len(vectors)
                sketches: list = [None] * len(vectors)
                for dim in {len(v) for v in vectors}:
                    of = [i for i, v in enumerate(vectors) if len(v) == dim]
                    x = np.stack([vectors[i] for i in of])
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    found = mix(buckets(x, tables, k).view(np.uint64) ^ mix(salt[of] + np.uint64(dim))[:, None]).view(np.int64)
                    for i, row, sketch in zip(of, found, signs(x), strict=True):
                        names[i], sketches[i] = row, sketch
                columns = [batch.column(0), pa.array([1] * len(names), pa.int64()), pa.array(names, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "bands", "sketch"])

    return run


def hash_label(label: str) -> int:
    return int.from_bytes(hashlib.blake2b(label.encode(), digest_size=8).digest(), "little")


def _compare(key: tuple, table: pa.Table) -> pa.Table:
    """Links within a unit: of each vector the number of rows that it is linked with, and the
    smallest vector of its group."""
    table = table.sort_by([("component", "ascending"), ("node", "ascending")])
    parts, nodes = table["component"].to_numpy(), table["node"].to_numpy()
    sides, copies = table["side"].to_numpy(), table["copies"].to_numpy()
    labels, vectors = np.array(table["label"].to_pylist(), object), table["embedding"].to_pylist()
    out = ([], [], [])
    edges = (np.flatnonzero(np.diff(parts)) + 1).tolist()
    for a, b in zip([0, *edges], [*edges, len(parts)], strict=True):
        kinds: dict = {}
        for i in range(a, b):
            kinds.setdefault((labels[i], len(vectors[i])), []).append(i)
        for of in map(np.array, kinds.values()):
            if len(of) < 2:
                continue
            x = np.array([vectors[i] for i in of], np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            linked = x @ x.T >= COSINE
            np.fill_diagonal(linked, False)
            if len(np.unique(sides[a:b])) > 1:
                linked &= sides[of][:, None] != sides[of][None, :]
            degree = linked @ copies[of]
            group = np.arange(len(of))
            while True:  # each takes the smallest of its neighbours' groups until none changes
                after = np.minimum(group, np.where(linked, group[None, :], len(of)).min(axis=1))
                after = after[after]
                if (after == group).all():
                    break
                group = after
            for i in np.flatnonzero(degree).tolist():
                for column, value in zip(out, (nodes[of[i]], degree[i], nodes[of[group[i]]]), strict=True):
                    column.append(int(value))
    return pa.table([pa.array(c, pa.int64()) for c in out], names=["node", "links", "hub"])


def near_duplicates(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors`` (vec_id,
    embedding, label).

    Vectors with equal labels are linked at a cosine of 0.93 or more. Vectors that are null, empty
    or zero, hold null or non-finite components, or have no label or vec_id link with nothing, nor
    do vectors of different lengths. n_links counts the other rows linked directly, repeated rows
    too; component_id is the smallest vec_id that can be reached (a null vec_id stays null and
    isn't kept). An empty table gives an empty result; other columns are ignored.
    """
    ws = Workspace(spark, "embeddings")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False))
    vectors = vectors.withColumns({"usable": usable, "h": F.xxhash64("label", "embedding"), "g": F.xxhash64("embedding", F.lit(20240511), "label")})
    classes = vectors.where("usable").groupBy("h", "g").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = ws.save(classes.withColumn("node", F.col("h")), "classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0

    banded = classes.select("node", "label", "embedding").mapInArrow(_hashes(*shape(most)), "node long, size long, bands array<long>, sketch binary")
    groups = components(ws, shared.links(ws, ws.save(banded, "banded"), alike))
    sizes = ws.save(groups.groupBy("component").count().withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")), "sizes")
    packs = max(1, -(-(sizes.where("blocks = 1").agg(F.sum("count")).first()[0] or 0) // (2 * BLOCK)))
    rows = groups.join(small(sizes), "component").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pack = F.concat(F.lit("pack-"), F.pmod(F.xxhash64("component"), F.lit(packs)))
    pair = F.concat_ws("-", "component", F.least("i", "j"), F.greatest("i", "j"))
    rows = rows.select("node", "component", F.when(F.col("blocks") == 1, pack).otherwise(pair).alias("unit"), (F.col("i") > F.col("j")).cast("int").alias("side"))
    units = ws.save(rows, "units")
    found = ws.save(classes.join(small(units), "node").groupBy("unit").applyInArrow(_compare, "node long, links long, hub long"), "found")

    degrees = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(ws, found.select("node", "hub"))
    of = classes.select("h", "g", "node", "first", "copies").join(degrees, "node", "left").join(small(linked), "node", "left")
    of = ws.save(of.select("h", "g", "first", "component", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")).where("n_links > 0"), "of")
    least = ws.save(of.where("component is not null").groupBy("component").agg(F.min("first").alias("least")), "least")
    labels = ws.save(of.join(small(least), "component", "left").select("h", "g", F.coalesce("least", "first").alias("component"), "n_links"), "labels")
    ws.keep_only(labels)
    out = vectors.select("vec_id", "usable", "h", "g").join(small(labels), ["h", "g"], "left")
    out = out.select(
        "vec_id",
        F.when(F.col("usable"), F.coalesce("n_links", F.lit(0).cast("long"))).otherwise(0).alias("n_links"),
        F.coalesce(F.when(F.col("usable"), F.col("component")), "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


NEAR_DUPLICATES_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), links AS MATERIALIZED (
  SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs
), reach AS (
  SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.y FROM reach JOIN links ON links.x = reach.r
), least AS (
  SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id
), degrees AS (
  SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least USING (vec_id) LEFT JOIN degrees USING (vec_id)
"""
