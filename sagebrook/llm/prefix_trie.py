"""The prefix trie of conversations: what their beginnings share, and what a cache of them would save.

A conversation is a row of turn ids (a digest of role and text, and the text's code points). Rows
are dealt to shards by ranges of these ids, so that every node, a distinct sequence of first turns,
is a contiguous range of rows. A shard puts its rows into matrices of DEEP depths, padded where
conversations have ended, sorts them with numpy's lexsort, and marks a node's start where this or an
earlier column changes; sums over nodes are reduceats between the marks, taken from the deepest
column upwards. Conversations are in one matrix only as far as they go, so one that is very long
doesn't widen the others' rows.

Only nodes on the paths to a shard's first and last row can go on in other shards. These are handed
on as partial sums under the digest of their path, are added up by Spark, and are put together in
one small pass: two paths a shard, however many conversations there are. Ids of one node's own
conversations are joined to text in pieces of PIECE, and a digest that spans shards reads the pieces
one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, joined

#: Depths of one padded matrix; ids in one piece of text; turns of a row that say which shard it is in.
DEEP, PIECE, RANGED = 16, 4096, 256
#: Bytes of turn ids in a shard (a turn has 20), and in one of those that all tasks of a small table share.
SHARD, LEAST = 32 << 20, 1 << 20

_TURN = np.dtype([("a", ">u8"), ("b", ">u8"), ("n", ">u4")])
_WIDTH = _TURN.itemsize
_EMPTY = hashlib.sha256(b"").hexdigest()
#: What a shard hands on: nodes that are done (0), those whose parent may go on elsewhere (1), parts
#: of nodes that may (2), and pieces of their conversations' ids (3).
DONE, HANGS, PART, IDS = range(4)
_FIELDS = "kind int, key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends_sha256 string, ids string"
_OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_ARROW = pa.schema([(f.split()[0], {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}[f.split()[1]]) for f in _FIELDS.split(", ")])


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, path): each conversation's turns, 20 bytes each, after its first h have been
    replaced by those of the conversation that opens its hundred."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)), F.lpad(F.hex(F.length(text).cast("long")), 8, "0"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), turn.alias("id")).alias("turn"))
    # Dealt by the hundred, a conversation and the one that opens its hundred are in one place.
    rows = rows.withColumn("opens", F.expr("conv_id - conv_id % 100")).repartition("opens")
    own = rows.groupBy("opens", "conv_id").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t["id"]), "")).alias("own"))
    first = own.where("conv_id = opens").select("opens", F.expr(f"substring(own, 1, {5 * _WIDTH})").alias("first"))
    h = f"{_WIDTH} * cast(crc32(cast(conv_id as string)) % 6 as int)"
    path = f"concat(substring(coalesce(first, cast('' as binary)), 1, {h}), substring(own, {h} + 1))"
    return own.join(first, "opens", "left").select("conv_id", F.expr(path).alias("path"))


def _ranks(turns: np.ndarray) -> np.ndarray:
    """The place of each turn among the distinct ones, in their order."""
    order = np.lexsort((turns["n"], turns["b"], turns["a"]))
    s = turns[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    out = np.empty(len(s), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _common(turns: np.ndarray, at: np.ndarray, lengths: np.ndarray, row: int) -> np.ndarray:
    """For each row how many first turns it shares with one of them; from RANGED on all count as shared."""
    out, on = np.zeros(len(at), np.int64), np.arange(len(at))
    for d in range(min(int(lengths[row]), RANGED)):
        on = on[lengths[on] > d]
        on = on[turns[at[on] + d] == turns[at[row] + d]]
        out[on] = d + 1
    out[out == RANGED] = np.iinfo(np.int64).max
    return out


class _Out:
    """Rows of the result, gathered as columns."""

    def __init__(self):
        self.parts: list[pa.RecordBatch] = []

    def add(self, kind: int, **columns) -> None:
        n = len(next(iter(columns.values())))
        if n:
            arrays = [pa.array(np.full(n, kind, np.int32)) if f.name == "kind" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW]
            self.parts.append(pa.RecordBatch.from_arrays(arrays, schema=_ARROW))


def _shard(ids: np.ndarray, turns: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> list[pa.RecordBatch]:
    """The nodes of one shard: ``ids`` in ascending order, and where in ``turns`` each one's begin."""
    n = len(ids)
    # Down the depths: sort by what is known so far and the next columns, and keep where they change.
    order, group, blocks = np.argsort(lengths > 0, kind="stable"), np.zeros(n, np.int64), []
    for base in range(0, int(lengths.max()), DEEP):
        active = np.flatnonzero(lengths[order] > base)  # places in the order so far
        rows = order[active]
        depth = np.arange(base, base + DEEP)
        there = depth < lengths[rows, None]
        where = (at[rows, None] + depth)[there]
        matrix = np.full(there.shape, -1, np.int64)
        matrix[there] = _ranks(turns[where])
        by = np.lexsort((*matrix.T[::-1], group[active]))
        order[active], matrix = rows[by], matrix[by]
        changed = np.empty(matrix.shape, bool)
        known = group[active]
        changed[:, 0] = np.append(True, (known[1:] != known[:-1]) | (matrix[1:, 0] != matrix[:-1, 0]))
        changed[0, 1:] = True
        changed[1:, 1:] = matrix[1:, 1:] != matrix[:-1, 1:]
        np.logical_or.accumulate(changed, axis=1, out=changed)
        blocks.append((base, active, changed, matrix >= 0))
        group[active] = np.cumsum(changed[:, -1])
    ids, at, lengths = ids[order], at[order], lengths[order]
    of_first, of_last = _common(turns, at, lengths, 0), _common(turns, at, lengths, n - 1)
    edge = np.maximum(of_first, of_last)
    out, keys = _Out(), {}

    def key(row: int, depth: int) -> bytes:
        """Digest of an open node's path, from the digest of the one above."""
        if depth == 0:
            return b""
        if depth <= RANGED:
            row = 0 if of_first[row] >= depth else n - 1
        known = next((d for d in range(depth, 0, -1) if (row, d) in keys), 0)
        digest = keys[row, known] if known else b""
        for d in range(known, depth):
            digest = keys[row, d + 1] = hashlib.md5(digest + turns[at[row] + d].tobytes()).digest()
        return digest

    def ends(first: np.ndarray, counts: np.ndarray, depth: int, open_: np.ndarray) -> list[str | None]:
        """Digests of the ids of the conversations that end at each node, which come first in it;
        ids of open nodes are handed on."""
        said = []
        for s, c, o in zip(first.tolist(), counts.tolist(), open_.tolist(), strict=True):
            if o:
                for a in range(s, s + c, PIECE):
                    part = ids[a : min(a + PIECE, s + c)]
                    out.add(IDS, key=[key(s, depth)], conv_id=part[:1], ids=[",".join(map(str, part.tolist()))])
                said.append(None)
            else:
                said.append(hashlib.sha256(",".join(map(str, ids[s : s + c].tolist())).encode()).hexdigest() if c else _EMPTY)
        return said

    # Up the depths: what lies below a node is added to what its first row carries.
    leaves, saved, below = np.zeros(n, np.int64), np.zeros(n, np.int64), None
    for depth in range(int(lengths.max()), -1, -1):
        active, starts, stops = np.arange(n), np.array([0]), np.array([n])
        if depth:
            base, active, changed, there = blocks[(depth - 1) // DEEP]
            k = depth - 1 - base
            starts = np.flatnonzero(changed[:, k])
            real = there[starts, k]
            starts, stops = starts[real], np.append(starts[1:], len(active))[real]
        pairs = np.stack([starts, stops], 1).ravel()
        pairs = pairs[:-1] if pairs[-1] == len(active) else pairs
        first, size = active[starts], stops - starts
        ended = np.add.reduceat(lengths[active] == depth, pairs, dtype=np.int64)[::2]
        least = np.minimum.reduceat(ids[active], pairs)[::2]
        chars = turns["n"][at[first] + depth - 1].astype(np.int64) if depth else np.zeros(1, np.int64)
        open_ = edge[first] >= depth
        children = np.zeros(len(first), np.int64)
        if below is not None:
            up = np.searchsorted(first, below["first"], "right") - 1
            shut = ~below["open"]
            children += np.bincount(up[shut], minlength=len(first))
            for kind, which in ((DONE, shut & ~open_[up]), (HANGS, shut & open_[up])):
                where = np.flatnonzero(which)
                columns = {c: below[c][where] for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")}
                columns |= {"parent_conv_id": least[up[where]]} if kind == DONE else {"parent": [key(int(first[u]), depth) for u in up[where]]}
                out.add(kind, **columns, depth=np.full(len(where), depth + 1), ends_sha256=[below["ends"][i] for i in where])
        own = ~open_
        saved[first[own]] += (size[own] - 1) * chars[own]
        leaves[first[own & (children == 0)]] += 1
        below = {
            "first": first, "open": open_, "conv_id": least, "n_convs": size, "n_children": children, "ends": ends(first, ended, depth, open_),
            "n_leaves": np.add.reduceat(leaves[active], pairs)[::2], "saved_tokens": np.add.reduceat(saved[active], pairs)[::2],
        }
        some = np.flatnonzero(open_)
        paths = [(key(int(first[i]), depth), key(int(first[i]), depth - 1) if depth else None) for i in some]
        columns = {c: below[c][some] for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")}
        out.add(PART, key=[p[0] for p in paths], parent=[p[1] for p in paths], depth=np.full(len(some), depth), chars=chars[some], **columns)
    return out.parts


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches = [b for b in batches if b.num_rows]
    if batches:
        table = pa.Table.from_batches(batches).combine_chunks()
        ids = table["conv_id"].to_numpy()
        paths = table["path"].chunk(0).cast(pa.large_binary())
        raw = paths.buffers()[2]
        offsets = np.frombuffer(paths.buffers()[1], np.int64, len(ids) + 1, paths.offset * 8)
        turns = np.frombuffer(raw, _TURN, int(offsets[-1] - offsets[0]) // _WIDTH, int(offsets[0])) if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, _TURN)
        at, lengths = (offsets[:-1] - offsets[0]) // _WIDTH, np.diff(offsets) // _WIDTH
        by = np.argsort(ids, kind="stable")
        yield from _shard(ids[by], turns, at[by], lengths[by])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of ids whose pieces come one after the other."""
    now, state = None, None
    for batch in batches:
        keys, done = [], []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key != now:
                if state is not None:
                    keys.append(now)
                    done.append(state.hexdigest())
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(done, pa.string())], names=["key", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tree of all open nodes, each once and by depth: their own parts are added to all above."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches).combine_chunks()
    keys, parents = t["key"].to_pylist(), t["parent"].to_pylist()
    depth = t["depth"].to_numpy()
    place = {k: i for i, k in enumerate(keys)}
    up = np.array([place[p] if p is not None else -1 for p in parents], np.int64)
    conv, convs, chars = t["conv_id"].to_numpy(), t["n_convs"].to_numpy(), t["chars"].to_numpy()
    children = t["n_children"].to_numpy() + np.bincount(up[up >= 0], minlength=len(keys))
    # What a shard has summed up for a node holds all nodes below it that are shut, at any depth.
    leaves, saved = (children == 0).astype(np.int64), (convs - 1) * chars
    by = np.argsort(-depth, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(depth[by])) + 1):
        part = part[up[part] >= 0]
        np.add.at(leaves, up[part], leaves[part])
        np.add.at(saved, up[part], saved[part])
    above = pa.array(np.where(up >= 0, conv[np.maximum(up, 0)], 0), mask=up < 0)
    columns = [t["key"].chunk(0), pa.array(conv), pa.array(depth), above, pa.array(convs), pa.array(children), pa.array(leaves + t["n_leaves"].to_numpy()), pa.array(saved + t["saved_tokens"].to_numpy())]
    yield pa.RecordBatch.from_arrays(columns, names=["key", *_OUT[:-1]])


def trie(spark: SparkSession, turns: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row for each node of the trie of ``turns`` (conv_id, turn, role, text): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by turn, null first; equal ones by a digest of role and text. A null role or text is
    empty, rows without a conv_id belong to no conversation, repeated rows are turns of their own.
    An empty table has no nodes. Other columns are ignored. ``shard`` is the bytes of turn ids that
    one task holds; equal conversations of any number are dealt to as many shards as they fill.
    """
    ws = Workspace(spark, "trie")
    rows = ws.save(rebuilt(turns), "conversations")
    size = rows.agg(F.sum(F.octet_length("path") + 16)).first()[0] or 0
    shards = max(1, -(-size // shard), min(int(spark.conf.get("spark.sql.shuffle.partitions")), size // LEAST))
    ranged = rows.repartitionByRange(shards, F.expr(f"substring(path, 1, {RANGED * _WIDTH})"), "conv_id") if shards > 1 else rows.coalesce(1)
    found = ws.save(ranged.select("conv_id", "path").mapInArrow(_nodes, _FIELDS), "nodes")
    ws.drop(rows)

    parts = found.where(F.col("kind") == PART).groupBy("key", "parent", "depth").agg(F.max("chars").alias("chars"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    schema = "key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    pieces = found.where(F.col("kind") == IDS).select("key", "conv_id", "ids").repartition("key").sortWithinPartitions("key", "conv_id")
    digests = pieces.select("key", "ids").mapInArrow(_digests, "key binary, ends_sha256 string")
    opened = parts.coalesce(1).mapInArrow(_together, schema).join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    opened = ws.save(opened, "open")

    hanging = found.where(F.col("kind") == HANGS).drop("parent_conv_id").withColumnRenamed("parent", "above")
    above = opened.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    hanging = joined(hanging, ws.save(above, "above"), "above")
    return found.where(F.col("kind") == DONE).select(_OUT).union(hanging.select(_OUT)).union(opened.select(_OUT))


#: crc32 of a decimal id: each byte is followed by eight steps of a bit.
_CRC32 = """list_reduce(flatten(list_prepend([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''),
    lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda x, e: CASE WHEN e >= 0 THEN xor(x, e) ELSE xor(x >> 1, (x & 1) * 3988292384) END)"""

TRIE_SQL = f"""
WITH own AS (
  SELECT conv_id AS c, list(struct_pack(k := md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')),
      n := length(coalesce(text, ''))) ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
head AS (SELECT c, t, xor({_CRC32}, 4294967295) % 6 AS h FROM own),
built AS (
  SELECT a.c, list_concat(coalesce(list_slice(b.t, 1, a.h), []), list_slice(a.t, a.h + 1, len(a.t))) AS t
  FROM head a LEFT JOIN own b ON b.c = a.c - a.c % 100),
prefixes AS (
  SELECT c, d, len(t) = d AS ends, CASE WHEN d = 0 THEN '' ELSE list_aggregate(list_transform(list_slice(t, 1, d), lambda x: x.k), 'string_agg', '') END AS p,
    CASE WHEN d = 0 THEN 0 ELSE t[d].n END AS chars
  FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM built) x),
node AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY p, d),
child AS (SELECT left(p, (d - 1) * 32) AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
own_part AS (SELECT a.*, coalesce(b.n, 0) AS n_children FROM node a LEFT JOIN child b ON a.p = b.p),
up AS (SELECT left(p, 32 * a) AS p, n_convs, chars, n_children FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM own_part) x),
below AS (SELECT p, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens FROM up GROUP BY p)
SELECT a.conv_id, a.d AS depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, s.n_leaves, s.saved_tokens, a.ends_sha256
FROM own_part a JOIN below s ON a.p = s.p LEFT JOIN node b ON a.d > 0 AND b.p = left(a.p, (a.d - 1) * 32)"""
