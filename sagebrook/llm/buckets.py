"""What rows that share a bucket of a hash table have in common: links between them, checked by
sketches, as stars.

Every row (node, size, bands, sketch) is in the bucket of each of its bands. Buckets with one row
are left out. The others are dealt to units of bounded size: many small buckets share a unit, and of
a large one two blocks of rows, all pairs of which are units. Only there sketches meet, which are
small. Within a bucket each row is compared with the smallest one; where all are alike, as copies
are, that is all. Otherwise a search goes from row to alike row and leaves out what it has reached.
What is returned are pairs of each group's first row with its others, in proportion to the rows of
a bucket; every two rows of a bucket whose sketches are alike are in one group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, small

#: Rows in one unit, at most; a block has half of them.
UNIT = 40_000

#: (sketches, sizes, sketches, sizes) -> whether each of the first is like that of the second, for
#: two arrays of equal length, or one and many.
Alike = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def groups(sketches: np.ndarray, sizes: np.ndarray, sides: np.ndarray, alike: Alike) -> list[tuple[int, int]]:
    """Pairs (first, other) of the places of rows in one group. If both sides occur, only rows of
    different sides are compared."""
    left, out = np.arange(len(sketches)), []
    cross = len(np.unique(sides)) > 1
    while len(left):
        first, queue = int(left[0]), [int(left[0])]
        left = left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = alike(sketches[left], sizes[left], sketches[i : i + 1], sizes[i : i + 1])
            if cross:
                hit &= sides[left] != sides[i]
            found = left[hit].tolist()
            if found:
                left = left[~hit]
                queue += found
                out += [(first, j) for j in found]
    return out


def _linked(alike: Alike):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("band", "ascending"), ("node", "ascending")])
        band, nodes, sizes, sides = (table[c].to_numpy() for c in ("band", "node", "size", "side"))
        sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(nodes), -1)
        starts = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
        ends = np.append(starts[1:], len(band))
        hub = np.repeat(starts, ends - starts)
        cross = sides.any()
        star = np.zeros(len(nodes), bool) if cross else alike(sketches, sizes, sketches[hub], sizes[hub])
        whole = np.logical_and.reduceat(star, starts)
        pairs = [np.column_stack([nodes[hub], nodes])[np.repeat(whole, ends - starts) & (hub != np.arange(len(nodes)))]]
        for g in np.flatnonzero(~whole).tolist():
            a, b = starts[g], ends[g]
            found = groups(sketches[a:b], sizes[a:b], sides[a:b], alike)
            if found:
                pairs.append(nodes[a:b][np.array(found)])
        u, v = np.concatenate(pairs).T
        return pa.table({"u": pa.array(u.copy(), pa.int64()), "v": pa.array(v.copy(), pa.int64())})

    return run


def links(ws: Workspace, rows: DataFrame, alike: Alike) -> DataFrame:
    """Distinct (u, v), u below v or the other way round: the stars of all buckets of ``rows`` (node
    long, size long, bands array<long>, sketch binary of whole 64-bit words), which must be saved."""
    each = rows.select("node", F.explode("bands").alias("band"))
    shared = ws.save(each.groupBy("band").agg(F.count("*").alias("members")).where("members > 1"), "shared")
    packs = max(1, -(-(shared.agg(F.sum("members")).first()[0] or 0) // UNIT))
    blocks = F.ceil(F.col("members") / (UNIT // 2)).cast("int")
    hits = each.join(small(shared), "band").withColumn("blocks", F.when(F.col("members") > UNIT, blocks).otherwise(1))
    one = hits.where("blocks = 1").select("node", "band", F.pmod(F.xxhash64("band"), F.lit(packs)).alias("unit"), F.lit(0).alias("side"))
    many = hits.where("blocks > 1").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = packs + F.pmod(F.xxhash64("band", F.least("i", "j"), F.greatest("i", "j")), F.lit(1 << 62))
    many = many.select("node", "band", place.alias("unit"), (F.col("i") > F.col("j")).cast("int").alias("side"))
    dealt = ws.save(one.union(many), "dealt")
    members = dealt.join(small(rows.select("node", "size", "sketch"), 100_000), "node")
    found = members.groupBy("unit").applyInArrow(_linked(alike), "u long, v long").where("u <> v").distinct()
    return ws.save(found, "links")
