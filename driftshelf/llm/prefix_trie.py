"""Prefix trie of conversations: sorted paths, longest common prefixes, range minima.

A conversation is a path of turns, each turn a 16-byte key. Different paths are sorted and
cut into blocks; in a block the conversations that start with a prefix stand side by side,
from the first to the last row between which no two neighbours share fewer turns. Both ends
are binary searches over a sparse table of range minima, one pair for each prefix, so no
prefix waits for another one and nothing is kept open. What a node sums up over its interval
is a difference of running totals. A node that reaches a block's edge is summed up over the
blocks by the hash of its prefix; there are at most two such paths in a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftshelf.operators.keyed import lookup

from .common import CRC_SQL, crc_sql, table, written

KEY = 16
#: Conversations that share a rebuilt opening, and the longest opening, as the contract fixes them.
FAMILY, OPENINGS = 100, 6
#: Bytes of paths looked at together, and of member ids hashed in one go. Results don't depend on them.
BLOCK_BYTES, IDS_BYTES = 8 << 20, 1 << 14
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODES = pa.schema([
    ("node", pa.binary()), ("parent", pa.binary()), ("parent_conv_id", pa.int64()), ("conv_id", pa.int64()),
    ("depth", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
])


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): of each conversation the key and code points of its turns, in order.

    Null turn numbers come first; rows of one turn number are ordered by a hash of role and
    text, so the order is the same in every run. Rows without a conv_id belong to none.
    Texts stay behind: a turn is 16 bytes and a length here.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
            F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("key"),
            F.length(text).alias("chars"),
        ).alias("turn"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """The same columns, each conversation opened with the first turns of its family's first one.

    How many is the checksum of its number modulo 6; the first one's may be fewer, or it may
    be absent. At most 199 conversations share one such opening.
    """
    heads = turns.where(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("family"), F.slice("turns", 1, OPENINGS - 1).alias("head"))
    opening = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENINGS).cast("int")
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = turns.withColumn("opening", opening).withColumn("family", family)
    none = F.filter("turns", lambda _: F.lit(False))
    return own.join(heads, "family", "left").select("conv_id", F.concat(
        F.slice(F.coalesce("head", none), F.lit(1), F.col("opening")),
        F.slice("turns", F.col("opening") + 1, F.greatest(F.size("turns"), F.lit(1))),
    ).alias("turns"))


def _id_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids sorted by path, as comma-joined pieces of one path each."""
    names = ["sequence", "first_id", "ids"]
    for rows in batches:
        out, own, first, ids, size = [], None, None, [], 0
        for sequence, conv in zip(rows["sequence"].to_pylist(), rows["conv_id"].to_pylist()):
            if sequence != own or size > IDS_BYTES:
                if ids:
                    out.append((own, first, ",".join(ids)))
                own, first, ids, size = sequence, conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if ids:
            out.append((own, first, ",".join(ids)))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))], names=names)


def _id_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by path and first id, hashed as one text for each path."""
    names, own, running = ["sequence", "ends"], None, None
    for rows in batches:
        out = []
        for sequence, ids in zip(rows["sequence"].to_pylist(), rows["ids"].to_pylist()):
            if sequence != own:
                if running:
                    out.append((own, running.hexdigest()))
                own, running = sequence, hashlib.sha256()
                running.update(ids.encode())
            else:
                running.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=names)
    if running:
        yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([running.hexdigest()])], names=names)


def end_hashes(members: DataFrame) -> DataFrame:
    """(sequence, ends): SHA-256 of the ascending ids of each sequence's members, comma-joined.

    One path may be that of a third of all conversations: its ids are dealt out by range,
    joined into pieces there, and only the pieces meet in a task, which hashes them as they come.
    """
    pieces = members.repartitionByRange("sequence", "conv_id").sortWithinPartitions("sequence", "conv_id").mapInArrow(
        _id_lists, "sequence string, first_id bigint, ids string")
    return pieces.repartition("sequence").sortWithinPartitions("sequence", "first_id").mapInArrow(
        _id_hashes, "sequence string, ends string")


class RangeMinimum:
    """Minimum of any range of an array from two overlapping ones of a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(last[:len(last) - half], last[half:]))

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of [first, last], ends included."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), dtype=self.levels[0].dtype)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] - (1 << k) + 1])
        return out

    def right(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place up to which no value after `start` is below `least`."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            go = np.flatnonzero(at + 1 < len(level))
            go = go[level[at[go] + 1] >= least[go]]
            at[go] += 1 << k
        return at

    def left(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from which no value after it, up to `start`, is below `least`."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            go = np.flatnonzero(at - (1 << k) >= 0)
            go = go[self.levels[k][at[go] - (1 << k) + 1] >= least[go]]
            at[go] -= 1 << k
        return at


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at their start."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size // KEY
    x, y = np.frombuffer(a, np.uint8, size), np.frombuffer(b, np.uint8, size)
    return int(np.argmax(x != y)) // KEY


def _prefix_hashes(path: bytes, depth: int) -> list[bytes]:
    """Hashes of a path's first 0, 1, ... `depth` turns."""
    running, out = hashlib.md5(), []
    for d in range(depth + 1):
        out.append(running.digest())
        running.update(path[KEY * d:KEY * (d + 1)])
    return out


def _running(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


def interval_nodes(rows: list[tuple], before: bytes | None, after: bytes | None) -> pa.RecordBatch | None:
    """The nodes of a run of sorted paths: (path, members, least id, hash of the ids, code points of each turn).

    `before` and `after` are the paths next to the run. Nodes that reach over its edge bear
    the hash of their prefix and what the run adds to them, the others are whole.
    """
    if not rows:
        return None
    paths, members, least_ids, ends, chars = zip(*rows)
    count, members = len(rows), np.array(members, dtype=np.int64)
    lengths = np.array([len(p) // KEY for p in paths], dtype=np.int64)
    shared = np.array([-1 if before is None else common_turns(before, paths[0])]
                      + [common_turns(a, b) for a, b in zip(paths, paths[1:])], dtype=np.int64)
    left_open, right_open = int(shared[0]), -1 if after is None else common_turns(paths[-1], after)
    # code points up to each depth of each path, in one array
    starts = _running(lengths + 1)[:-1]
    upto = np.concatenate([_running(np.asarray(c, dtype=np.int64)) for c in chars])
    total = upto[starts + lengths]
    # a prefix is a candidate where it is new; those that come in from before are the first path's
    new = np.where(np.arange(count) == 0, 0, shared + 1)
    fresh = lengths - new + 1
    row = np.repeat(np.arange(count), fresh)
    depth = np.arange(fresh.sum()) - np.repeat(_running(fresh)[:-1], fresh) + new[row]

    minima = RangeMinimum(shared)
    ids = RangeMinimum(np.array(least_ids, dtype=np.int64))

    def edges(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        first, last = minima.left(row, depth), minima.right(row, depth)
        return first, last, (first == 0) & (depth <= left_open), (last == count - 1) & (depth <= right_open)

    first, last, from_before, goes_on = edges(depth)
    above = np.maximum(depth - 1, 0)
    n = _running(members)
    n = n[last + 1] - n[first]
    chars_of_members = _running(members * total)
    added = _running(total - upto[starts + np.maximum(shared, 0)])  # by the turns that are new in each path
    distinct = np.where(from_before, added[last + 1] - added[first],
                        total[first] - upto[starts[first] + above] + added[last + 1] - added[first + 1])
    saved = chars_of_members[last + 1] - chars_of_members[first] - n * upto[starts[row] + above] - distinct
    leaf = _running(lengths > np.append(shared[1:], right_open))
    places = np.sort((shared + 1) * (count + 1) + np.arange(count))  # of each number of shared turns

    def branches(begin: np.ndarray) -> np.ndarray:
        key = (depth + 1) * (count + 1)
        return np.searchsorted(places, key + last, side="right") - np.searchsorted(places, key + begin)

    children = np.where(from_before, branches(first), branches(first + 1) + (lengths[first] > depth))
    up_first, up_last, up_before, up_on = edges(above)
    heads = _prefix_hashes(paths[0], left_open) if left_open >= 0 else []
    tails = _prefix_hashes(paths[-1], right_open) if right_open >= 0 else []

    def hashes(depth: np.ndarray, from_before: np.ndarray, goes_on: np.ndarray) -> list[bytes | None]:
        return [heads[d] if b else tails[d] if o else None
                for d, b, o in zip(depth.tolist(), from_before.tolist(), goes_on.tolist())]

    parent_ids = pa.array(ids(up_first, up_last), mask=up_before | up_on | (depth == 0))
    node = hashes(depth, from_before, goes_on)
    parent = [None if d == 0 else h for d, h in zip(depth.tolist(), hashes(above, up_before, up_on))]
    own_end = (depth == lengths[row]) & ~((row == 0) & from_before)
    return pa.RecordBatch.from_arrays([
        pa.array(node, pa.binary()), pa.array(parent, pa.binary()), parent_ids, pa.array(ids(first, last)),
        pa.array(depth), pa.array(n), pa.array(children.astype(np.int64)),
        pa.array(leaf[last + 1] - leaf[first]), pa.array(saved),
        pa.array([ends[i] if e else None for i, e in zip(row.tolist(), own_end.tolist())], pa.string()),
    ], schema=NODES)


def _block_nodes(most: int) -> Callable:
    """Nodes of blocks of sorted paths. The first and last row of a block may be its neighbours' paths."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, before, held, size = None, None, [], 0

        def close(after: bytes | None) -> Iterator[pa.RecordBatch]:
            if (nodes := interval_nodes(held, before, after)) is not None:
                yield nodes

        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("block", "place", "path", "members", "least_id", "ends"))
            for *values, chars in zip(*columns, batch["chars"]):
                at, place, path, *rest = values
                if at != block:
                    yield from close(None)
                    block, before, held, size = at, None, [], 0
                if place == 0:
                    before = path
                elif place == 2:
                    yield from close(path)
                    held = []
                else:
                    if size > most:
                        yield from close(path)
                        before, held, size = held[-1][0], [], 0
                    held.append((path, *rest, chars.values.to_numpy(zero_copy_only=False)))
                    size += len(path) + 64
        yield from close(None)

    return find


def prefix_trie(turns: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """One row for each different prefix of the conversations (conv_id, turns), the empty one included."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    paths = written(turns.select(
        "conv_id", F.md5(path).alias("sequence"), path.alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"),
    ), "paths")
    different = paths.groupBy("sequence").agg(
        F.count("*").alias("members"), F.min("conv_id").alias("least_id"),
        F.first("path").alias("path"), F.first("chars").alias("chars"),
    )
    ends = end_hashes(paths.select("sequence", "conv_id"))
    ordered = written(
        different.join(ends, "sequence").drop("sequence").repartitionByRange("path").sortWithinPartitions("path")
        .withColumn("block", F.spark_partition_id()), "ordered")
    by_block = Window.orderBy("block")  # a row for each partition
    neighbours = ordered.groupBy("block").agg(F.min("path").alias("low"), F.max("path").alias("high")).select(
        "block", F.lag("high").over(by_block).alias("before"), F.lead("low").over(by_block).alias("after"))
    rows = ordered.withColumn("place", F.lit(1))
    for place, name in ((0, "before"), (2, "after")):
        rows = rows.unionByName(
            neighbours.where(F.col(name).isNotNull()).select("block", F.col(name).alias("path"), F.lit(place).alias("place"),
                                                             F.array().cast("array<int>").alias("chars")),
            allowMissingColumns=True)
    fields = ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'string' if f.type == pa.string() else 'bigint'}"
                       for f in NODES)
    found = written(rows.repartition("block").sortWithinPartitions("block", "place", "path")
                    .mapInArrow(_block_nodes(most), fields), "nodes")
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    over = written(found.where("node IS NOT NULL").groupBy("node", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.first("parent").alias("parent"),
        *(F.sum(c).alias(c) for c in sums), F.max("ends_sha256").alias("ends_sha256")), "edge_nodes")
    # closed nodes below an edge node, which may have a third of all children, and edge nodes themselves
    named = over.select(F.col("node").alias("parent"), F.col("conv_id").alias("edge_id"))
    waiting = found.where("node IS NULL").drop("node").unionByName(
        over.drop("node").withColumn("parent_conv_id", F.lit(None).cast("long")))
    whole = lookup(waiting, named, ["parent"], "left", spread=["conv_id", "depth"])
    return whole.select(
        "conv_id", "depth", F.coalesce("edge_id", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations.

    Null role or text is empty, null turns come first, rows without a conv_id are left out.
    Equal turns of different numbers are turns of their own; repeated rows too. Long texts
    are hashed where they lie and never travel; a conversation is one row of 20 bytes a turn.
    An empty table has no node, not even the root. Other columns are never read.
    """
    return prefix_trie(rebuilt(conversation_turns(table(spark, sf_dir, "conversations"))))


SQL = f"""
WITH RECURSIVE {CRC_SQL},
turns AS (
  SELECT conv_id::BIGINT AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
    length(coalesce(text, '')) AS n, turn
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(n ORDER BY turn NULLS FIRST, k) AS ns FROM turns GROUP BY c),
openings AS (SELECT own.*, ({crc_sql('c::VARCHAR')} % {OPENINGS})::BIGINT AS h FROM own, lookup),
paths AS (
  SELECT o.c, list_concat(coalesce(b.ks, [])[1:o.h], o.ks[o.h + 1:]) AS ks,
    list_concat(coalesce(b.ns, [])[1:o.h], o.ns[o.h + 1:]) AS ns
  FROM openings o LEFT JOIN own b ON b.c = o.c - o.c % {FAMILY}),
steps AS (SELECT c, d, md5(array_to_string(ks[1:d], '')) AS p, d = len(ks) AS ends,
    CASE WHEN d > 0 THEN md5(array_to_string(ks[1:d - 1], '')) END AS up, ns[d] AS n
  FROM paths, LATERAL (SELECT unnest(range(len(ks) + 1)) AS d)),
nodes AS (SELECT p, d, any_value(up) AS up, min(c) AS c, count(*) AS n_convs,
    (count(*) - 1) * coalesce(any_value(n), 0) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM steps GROUP BY p, d),
children AS (SELECT up AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up, d),
below AS (SELECT DISTINCT a.p, a.d, v.p AS vp, v.d AS vd
  FROM nodes v JOIN steps s ON s.c = v.c AND s.d = v.d JOIN steps a ON a.c = s.c AND a.d <= v.d),
sums AS (SELECT b.p, b.d, sum(v.saved) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM below b JOIN nodes v ON v.p = b.vp AND v.d = b.vd LEFT JOIN children k ON k.p = v.p AND k.d = v.d GROUP BY b.p, b.d)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, u.c AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
  s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.p = n.p AND s.d = n.d
LEFT JOIN nodes u ON u.p = n.up AND u.d = n.d - 1 LEFT JOIN children k ON k.p = n.p AND k.d = n.d
"""
