"""Near-duplicate documents by circulant MinHash.

Two permutations of the numbers below 2**32 make the whole signature: a first one, sigma, gives
every shingle its place on a ring of that size; a second one, pi, the number that stands at a place.
Coordinate k of a signature is the least ``pi(sigma(shingle) + k)``: one permutation, shifted
circularly. (Shingles are 64-bit hashes, of which sigma's bijection leaves 32 bits: two of a
million shingles of a text share a place with a chance of some 1e-4 each.)

Signatures are cut into 45 bands of 5 coordinates; texts that share a band are candidates. At a
similarity of 0.75 a pair misses all bands with a chance of (1 - 0.75**5)**45 = 5e-6, so no stage
after this one needs to look for more.

Texts with equal sets become one class first. What shares a band is compared there, before anything
is connected: by sizes, and by sketches of all coordinates (see buckets.py), which tell a pair at
0.75 from one at 0.5 but in one case of a million, so that chains of half-alike texts don't become
groups. The exact Jaccard similarity of what is left is computed over full sets: first of each group's
stars, which takes each set as often as it has links. A group that these connect is done. In the others
every set may meet every other, in units of bounded size: small groups share a unit, large groups are
cut into blocks, and every pair of blocks is a unit of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buckets
from .common import Workspace, components, small
from .shingles import mix, shingle_sets

BANDS, ROWS = 45, 5
#: Bits of each coordinate in a sketch; coordinates that must agree of 225: at 0.75, all but five
#: standard deviations.
BITS, AGREEING = 4, 141
#: Shingles that one unit of exact comparisons takes, and so its memory (some 50 MB).
UNIT_SHINGLES = 500_000
#: Texts that are cut into shingles at once, which bounds what a worker holds.
TEXTS = 64
PERCENT = 75
_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)[:, None]


def _pi(x: np.ndarray) -> np.ndarray:
    """A permutation of the numbers below 2**32, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates of a set's circulant MinHash; the set must not be empty."""
    places = (mix(shingles ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
    out = None
    for a in range(0, len(places), 64):  # what is worked on at once stays in the processor's cache
        part = _pi(places[a : a + 64] + _SHIFTS).min(axis=1)
        out = part if out is None else np.minimum(out, part, out=out)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """One hash for each band; different bands never share one but by chance."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
        out = mix(out ^ column)
    return out.view(np.int64)


def sketch(sig: np.ndarray) -> bytes:
    """The last BITS bits of all coordinates, in whole 64-bit words."""
    nibbles = np.zeros(-(-len(sig) // 16) * 16, np.uint8)
    nibbles[: len(sig)] = sig & np.uint32(15)
    return (nibbles[::2] | nibbles[1::2] << 4).tobytes()


def alike(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether sizes and sketches leave it open that sets have a similarity of 0.75."""
    differ = a ^ b
    differ |= differ >> np.uint64(2)
    differ |= differ >> np.uint64(1)
    count = np.bitwise_count(differ & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)
    return (BANDS * ROWS - count >= AGREEING) & (100 * np.minimum(m, n) >= PERCENT * np.maximum(m, n))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, TEXTS):
            batch = whole.slice(at, TEXTS)
            sets = shingle_sets(batch.column(2))
            signatures = [signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([[] if x is None else bands(x) for x in signatures], pa.list_(pa.int64())),
                    pa.array([b"" if x is None else sketch(x) for x in signatures], pa.binary()),
                ],
                names=["doc_id", "text_key", "n_shingles", "digest", "bands", "sketch"],
            )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of candidates to their sets; of repeated texts one for each partition."""
    seen = set()
    for whole in batches:
        for at in range(0, whole.num_rows, TEXTS):
            batch = whole.slice(at, TEXTS)
            marks = zip(*(batch.column(k).to_pylist() for k in ("unit", "component", "side", "key", "digest", "repeated")), strict=True)
            keep, sets = [], []
            for i, (mark, s) in enumerate(zip(marks, shingle_sets(batch.column("text")), strict=True)):
                data = s.tobytes()
                if mark in seen or hashlib.blake2b(data, digest_size=16).digest() != mark[4]:  # another text of the same hash
                    continue
                if mark[5]:
                    seen.add(mark)
                keep.append(i)
                sets.append(data)
            rows = batch.select(["unit", "side", "key", "component"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(sets, pa.binary())], names=[*rows.schema.names, "shingles"])


def forest(nodes: np.ndarray, sets: list[np.ndarray], sides: np.ndarray) -> list[tuple[int, int]]:
    """The groups that links with 100 * intersection >= 75 * union make of the sets, as pairs of a
    group's first node with each other one. Compares sides 0 with sides 1 if both occur, else all
    with all."""
    n, cross = len(sets), len(np.unique(sides)) > 1
    sizes = np.array([len(s) for s in sets])
    waiting, out = np.arange(n), []
    left = np.ones(n, bool)

    def index(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All shingles of the sets ``of``, sorted, with their sets."""
        every = np.concatenate([sets[i] for i in of]) if len(of) else np.zeros(0, np.uint64)
        whose = np.repeat(of, sizes[of])
        order = np.argsort(every, kind="stable")
        return every[order], whose[order], of

    every, whose, covered = index(waiting)
    for start in range(n):
        if not left[start]:
            continue
        left[start], queue = False, [start]
        while queue:  # a search that leaves what it has reached out of later comparisons
            i = queue.pop()
            open_now = np.count_nonzero(left[covered])
            if open_now == 0:
                continue
            if open_now < len(covered) // 2:
                every, whose, covered = index(covered[left[covered]])
            lo, hi = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            lens = (hi - lo)[hit]
            places = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(lo[hit], lens)
            common = np.bincount(whose[places], minlength=n)
            linked = left & (100 * common >= PERCENT * (sizes[i] + sizes - common)) & (common > 0)
            if cross:
                linked &= sides != sides[i]
            for j in np.flatnonzero(linked).tolist():
                left[j] = False
                queue.append(j)
                out.append((int(nodes[start]), int(nodes[j])))
    return out


def _grouped(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(component, keys, sides, sets) of each component in a unit, each key once."""
    table = table.sort_by([("component", "ascending"), ("side", "ascending"), ("key", "ascending")])
    parts, keys, sides = (table[c].to_numpy() for c in ("component", "key", "side"))
    new = np.append(True, (parts[1:] != parts[:-1]) | (keys[1:] != keys[:-1]) | (sides[1:] != sides[:-1]))
    parts, keys, sides = parts[new], keys[new], sides[new]
    data = table["shingles"].filter(pa.array(new)).to_pylist()
    edges = (np.flatnonzero(np.diff(parts)) + 1).tolist()
    for a, b in zip([0, *edges], [*edges, len(parts)], strict=True):
        yield int(parts[a]), keys[a:b], sides[a:b], [np.frombuffer(x, np.uint64) for x in data[a:b]]


def _pairs(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})


def _verify(key: tuple, table: pa.Table) -> pa.Table:
    return _pairs([x for _, keys, sides, sets in _grouped(table) for x in forest(keys, sets, sides)])


def _verify_stars(key: tuple, table: pa.Table) -> pa.Table:
    """Links between each component's namesake and its others."""
    out = []
    for hub, keys, _, sets in _grouped(table):
        own = sets[int(np.flatnonzero(keys == hub)[0])]
        for k, s in zip(keys.tolist(), sets, strict=True):
            common = np.count_nonzero(own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s)
            if k != hub and 100 * common >= PERCENT * (len(own) + len(s) - common):
                out.append((hub, k))
    return _pairs(out)


def _packed(ws: Workspace, sized: DataFrame) -> DataFrame:
    """(component, blocks, packs): in how many blocks each component of ``sized`` (component,
    n_shingles) is cut, and how many units small ones share."""
    totals = sized.groupBy("component").agg(F.sum("n_shingles").alias("total"))
    totals = ws.save(totals.withColumn("blocks", F.ceil(F.col("total") / (UNIT_SHINGLES // 2)).cast("int")), "totals")
    packs = max(1, -(-(totals.where("blocks = 1").agg(F.sum("total")).first()[0] or 0) // UNIT_SHINGLES))
    return totals.select("component", "blocks", F.pmod(F.xxhash64("component"), F.lit(packs)).alias("pack"))


def _exact(ws: Workspace, docs: DataFrame, classes: DataFrame, dealt: DataFrame, verify) -> DataFrame:
    """Links (u, v) that ``verify`` finds in the units of ``dealt`` (unit, side, key, component)."""
    wanted = classes.select("key", "text_key", "digest", (F.col("copies") > 1).alias("repeated")).join(small(ws.save(dealt, "units")), "key")
    wanted = ws.save(wanted, "wanted")
    found = docs.select("text_key", "text").join(small(wanted), "text_key").select("unit", "side", "key", "component", "digest", "repeated", "text")
    members = found.mapInArrow(_members, "unit string, side int, key long, component long, shingles binary")
    return ws.save(members.groupBy("unit").applyInArrow(verify, "u long, v long"), "exact")


def _stars(ws: Workspace, classes: DataFrame, links: DataFrame) -> DataFrame:
    """Units of each link's sets, by the link's first: (unit, side, key, component)."""
    of = links.join(classes.select(F.col("key").alias("v"), "n_shingles"), "v").select(F.col("u").alias("component"), F.col("v").alias("key"), "n_shingles")
    of = ws.save(of, "sized")
    block = F.pmod(F.xxhash64("key"), F.col("blocks"))
    unit = F.when(F.col("blocks") == 1, F.concat(F.lit("pack-"), "pack")).otherwise(F.concat_ws("-", "component", block))
    rows = of.join(small(_packed(ws, of)), "component").select(unit.alias("unit"), F.lit(0).alias("side"), "key", "component")
    rows = ws.save(rows, "rays")
    return rows.union(rows.select("unit", "side", F.col("component").alias("key"), "component").distinct())


def _squares(ws: Workspace, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """Units in which all sets of a group meet: (unit, side, key, component)."""
    of = ws.save(groups.join(classes.select("key", "n_shingles"), "key"), "sized")
    rows = of.join(small(_packed(ws, of)), "component")
    one = rows.where("blocks = 1").select(F.concat(F.lit("pack-"), "pack").alias("unit"), F.lit(0).alias("side"), "key", "component")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    many = rows.where("blocks > 1").withColumn("i", block).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.concat_ws("-", "component", F.least("i", "j"), F.greatest("i", "j"))
    return one.union(many.select(unit, (F.col("i") > F.col("j")).cast("int"), "key", "component"))


def linked_classes(ws: Workspace, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of the classes (key, text_key, digest, copies, n_shingles, bands, sketch)
    that links connect; ``docs`` is (text_key, text)."""
    rows = classes.select(F.col("key").alias("node"), F.col("n_shingles").alias("size"), "bands", "sketch")
    likely = buckets.links(ws, rows, alike)
    groups = components(ws, likely)
    links = _exact(ws, docs, classes, _stars(ws, classes, likely), _verify_stars)
    linked = components(ws, links)
    if likely.count() != links.count():  # groups that these links don't connect
        of = groups.join(small(linked.withColumnRenamed("component", "exact")), "node", "left").withColumn("exact", F.coalesce("exact", "node"))
        of = ws.save(of.groupBy("component").agg(F.min("exact").alias("a"), F.max("exact").alias("b")).where("a <> b").select("component"), "open")
        rest = _squares(ws, classes, groups.join(small(of), "component").select(F.col("node").alias("key"), "component"))
        linked = components(ws, links.union(_exact(ws, docs, classes, rest, _verify)))
    return linked


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that can be reached over links, itself included; kept is
    whether that is the row's own. A null or wordless text has no shingles and links with nothing.
    Every row is judged by its own text: repeated rows are in one component, rows that share a
    doc_id but not the text may be in several. A row with a null doc_id links with nothing, gets the
    component of its equals, else null, and isn't kept. An empty table gives an empty result; other
    columns of ``docs`` are ignored.
    """
    ws = Workspace(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    sketches = ws.save(docs.mapInArrow(_sketches, "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>, sketch binary"), "sketches")

    classes = sketches.where("n_shingles > 0 and doc_id is not null").groupBy("digest", "n_shingles", "bands", "sketch")
    classes = classes.agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.min("text_key").alias("text_key"))
    classes = ws.save(classes.withColumn("key", F.xxhash64("digest")), "classes")
    linked = linked_classes(ws, docs, classes)

    of = ws.save(classes.select("digest", "doc", "copies", F.col("key").alias("node")).join(small(linked), "node", "left"), "of")
    least = ws.save(of.where("component is not null").groupBy("component").agg(F.min("doc").alias("least")), "least")
    labels = of.where("component is not null or copies > 1").join(small(least), "component", "left").select("digest", F.coalesce("least", "doc").alias("component"))
    labels = ws.save(labels, "labels")
    ws.keep_only(sketches, labels)
    out = sketches.select("doc_id", "n_shingles", "digest").join(small(labels), "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component"))
    return out.select("doc_id", "n_shingles", F.coalesce(component, "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )


NEAR_DUPLICATES_SQL = """
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN ['short ' || array_to_string(w, ' ')] ELSE [] END) AS g
  FROM split
), sizes AS MATERIALIZED (
  SELECT doc_id, count(g) AS n FROM split LEFT JOIN grams USING (doc_id) GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), pairs AS (
  SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 75 * (s.n + t.n - c)
), links AS MATERIALIZED (
  SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs
), reach AS (
  SELECT doc_id, doc_id AS r FROM sizes UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r
), least AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, n AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""
