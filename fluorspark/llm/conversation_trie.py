"""The trie of conversation prefixes, in shards that are succinct level-order tries.

Turns become labels (16 bytes of a digest of role and text) and lengths as they are read; a pass over each
conversation in order, row by row, chains the labels to prefix digests, which name the nodes. Spark counts each node's members, partially
in the tasks that hold them, so that copies of a conversation shrink to one row a node early.

A node is heavy if its members have more than ``SHARD_ROWS`` turns from it on. Heavy nodes are the upper levels, closed towards the
root. The subtree of a light node with a heavy parent is a prefix shard, of at most that many nodes. Shards are spread
over the tasks; a task builds one LOUDS bitvector over some whole shards (a super-root above them), with labels, lengths
and counts as arrays in level order, and rolls leaves and savings up in reverse level order with ``np.add.at``. The heavy levels are merged apart:
the shards' totals are summed by heavy parent, then along the heavy nodes by doubling jumps, in as many rounds as the
logarithm of their depth. No task holds a group that grows with the table; lists of conversations that end at a node are hashed as a stream
of pieces made in parallel.

Defined results: rows with a null conversation id take no part; null roles and texts are empty; equal turn numbers are ordered by role, then
text, repeated rows stay repeated turns; a conversation whose rebuilt form has no turn ends at the root; ``c % 100`` has the
sign of ``c``; an empty table has no root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, long_ids, slices

SHARD_ROWS = 50_000
#: Nodes of a task's trie at least, if there are as many: shards are put together up to it.
TRIE_ROWS = 20_000
#: Conversation ids of a piece of a node's list.
PIECE = 4096
SHARED, MOST_SHARED = 100, 5
ROOT = b"\0" * 16
_NONE = hashlib.sha256(b"").hexdigest()


def labelled(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (from 1), ``label``, ``size`` (code points): the turns of each conversation in order; texts travel once, to be ordered."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = long_ids(turns, "conv_id").where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))
    return rows.withColumn("pos", pos).select("conv_id", "pos", digest.alias("label"), F.length("text").alias("size"))


def rebuilt(own: DataFrame, shared: int = SHARED, most: int = MOST_SHARED) -> DataFrame:
    """Rows ``conv_id``, ``part``, ``pos``, ``label``, ``size``: of part 0 one row a conversation, of part 1 the leader's first turns, of part 2 its own after as many."""
    take = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most + 1)).cast("int")
    convs = own.where("pos = 1").select("conv_id")
    # a leader's first turns meet at most 2 * shared conversations, each once
    leaders = own.where((F.col("conv_id") % shared == 0) & (F.col("pos") <= most)).withColumnRenamed("conv_id", "leader")
    lead = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % shared).alias("leader"), take.alias("take")).join(leaders, "leader").where("pos <= take")
    columns = ("conv_id", "part", "pos", "label", "size")
    mark = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit(ROOT).alias("label"), F.lit(0).alias("size"))
    after = own.where(F.col("pos") > take).withColumn("part", F.lit(2))
    return mark.unionByName(lead.withColumn("part", F.lit(1)).select(*columns)).unionByName(after.select(*columns))


def paths(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``depth``, ``node``, ``parent``, ``size``, ``left`` and ``ends`` for each prefix of each conversation.

    ``left`` is the number of turns from the node on: conversations are read from their last turn, counted, and again from the first.
    """
    last = Window.partitionBy("conv_id").orderBy(F.desc("part"), F.desc("pos"))
    counted = rows.withColumn("left", F.row_number().over(last))
    ordered = counted.sortWithinPartitions("conv_id", "part", "pos")  # the window's partitioning holds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depth, node = 0, ROOT
        for batch in slices(batches, 10_000):
            depths, nodes, parents = [], [], []
            for part, label in zip(batch.column("part").to_pylist(), batch.column("label").to_pylist(), strict=True):
                if part:
                    parent, depth = node, depth + 1
                    node = hashlib.blake2b(parent + label, digest_size=16).digest()
                else:
                    parent, depth, node = None, 0, ROOT
                depths.append(depth)
                nodes.append(node)
                parents.append(parent)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(depths, pa.int64()), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), batch.column("size"), batch.column("left")],
                names=["conv_id", "depth", "node", "parent", "size", "left"],
            )

    found = ordered.mapInArrow(run, "conv_id long, depth long, node binary, parent binary, size int, left int")
    return found.withColumn("ends", F.col("left") == 1)


def nodes_of(steps: DataFrame) -> DataFrame:
    """One row a node: ``node``, ``parent``, ``depth``, ``conv_id`` (the smallest member), ``n_convs``, ``cost`` (saved by itself) and ``weight`` (turns from it on)."""
    counted = steps.groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("size").alias("size"), F.sum("left").alias("weight"))
    return counted.withColumn("cost", (F.col("n_convs") - 1) * F.col("size")).drop("size")


class Louds:
    """A forest of shards under one super-root: nodes in level order, the bitvector of their degrees, arrays of labels and counts."""

    def __init__(self, depth: np.ndarray, node: np.ndarray, parent: np.ndarray, top: np.ndarray) -> None:
        """``order`` brings rows into level order; tops are the super-root's children. Row numbers of the arrays given are places in ``order``."""
        place = np.zeros(len(depth), dtype=np.int64)  # of each row, in level order, counted from 1; the super-root is 0
        tops = np.flatnonzero(top)
        order, degrees = [tops[np.argsort(node[tops], kind="stable")]], [np.array([len(tops)])]
        below = np.flatnonzero(~top)
        below = below[np.argsort(depth[below], kind="stable")]
        place[order[0]] = np.arange(1, len(tops) + 1)
        self.levels = [(1, len(tops) + 1)]
        # a shard's levels are counted from its top, so that the forest is level by level
        by_node = np.argsort(node, kind="stable")
        up = by_node[np.searchsorted(node[by_node], parent[below])] if len(below) else below
        rank = np.zeros(len(depth), dtype=np.int64)
        start = 0
        for d in np.unique(depth[below]):  # ascending: parents are ranked before their children
            stop = start + int(np.searchsorted(depth[below][start:], d, side="right"))
            rank[below[start:stop]] = rank[up[start:stop]] + 1
            start = stop
        up_of = np.zeros(len(depth), dtype=np.int64)
        up_of[below] = up
        by_rank = np.argsort(rank, kind="stable")
        bounds = np.searchsorted(rank[by_rank], np.arange(1, rank.max(initial=0) + 2))
        for k in range(len(bounds) - 1):
            rows = by_rank[bounds[k] : bounds[k + 1]]
            rows = rows[np.lexsort((node[rows], place[up_of[rows]]))]
            first = self.levels[-1][1]
            place[rows] = np.arange(first, first + len(rows))
            before = self.levels[-1]
            degrees.append(np.bincount(place[up_of[rows]] - before[0], minlength=before[1] - before[0]))
            order.append(rows)
            self.levels.append((first, first + len(rows)))
        degrees.append(np.zeros(self.levels[-1][1] - self.levels[-1][0], dtype=np.int64))
        self.order = np.concatenate(order)
        degree = np.concatenate(degrees)
        # 1 for each child, then 0: the n-th 1 is node n, and as many 0s precede it as its parent's place
        self.bits = np.ones(int(degree.sum()) + len(degree), dtype=bool)
        self.bits[np.cumsum(degree + 1) - 1] = False

    def parents(self) -> np.ndarray:
        """Each node's parent's place, from the super-root's children on."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones))

    def degrees(self) -> np.ndarray:
        """Each node's number of children, the super-root first."""
        return np.diff(np.flatnonzero(~self.bits), prepend=-1) - 1

    def rolled(self, own: np.ndarray) -> np.ndarray:
        """Sums over subtrees of values in level order, the super-root's left out."""
        total, up = np.r_[np.zeros(1, own.dtype), own], self.parents()
        for begin, end in reversed(self.levels):
            np.add.at(total, up[begin - 1 : end - 1], total[begin:end])
        return total[1:]


def rolled_up(shards: DataFrame) -> DataFrame:
    """Rows of light nodes with ``n_children``, ``n_leaves``, ``saved_tokens`` and ``parent_conv_id`` (null for tops). A partition's shards come one after another."""

    def built(rows: pa.Table) -> pa.RecordBatch:
        top = np.array(rows.column("top").to_pylist(), dtype=bool)
        trie = Louds(rows.column("depth").to_numpy(), _bytes(rows, "node"), _bytes(rows, "parent"), top)
        sorted_rows = rows.take(pa.array(trie.order))
        degree = trie.degrees()[1:]
        up = trie.parents()
        convs = sorted_rows.column("conv_id").to_numpy()
        above = np.where(up > 0, convs[up - 1], 0)
        columns = [sorted_rows.column(c).combine_chunks() for c in ("node", "parent", "depth", "conv_id", "n_convs", "top")]
        columns += [pa.array(degree), pa.array(trie.rolled((degree == 0).astype(np.int64))), pa.array(trie.rolled(sorted_rows.column("cost").to_numpy())), pa.array(above, mask=up == 0)]
        return pa.RecordBatch.from_arrays(columns, names=["node", "parent", "depth", "conv_id", "n_convs", "top", "n_children", "n_leaves", "saved_tokens", "parent_conv_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < TRIE_ROWS:
                continue
            rows = pa.Table.from_batches(held)
            shard = rows.column("shard").to_pylist()
            last = len(shard)
            while last and shard[last - 1] == shard[-1]:  # the last shard may go on in the next batch
                last -= 1
            if last:
                yield built(rows.slice(0, last))
            held = rows.slice(last).to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            if len(rows):
                yield built(rows)

    schema = "node binary, parent binary, depth long, conv_id long, n_convs long, top boolean, n_children long, n_leaves long, saved_tokens long, parent_conv_id long"
    return shards.repartition("shard").sortWithinPartitions("shard", "depth").mapInArrow(run, schema)


def _bytes(rows: pa.Table, name: str) -> np.ndarray:
    """A column of 16-byte keys as comparable fixed-width values; trailing zero bytes count."""
    data = np.frombuffer(b"".join(rows.column(name).to_pylist()), dtype=">u8").reshape(-1, 2)
    return data.astype(np.uint64).view([("hi", np.uint64), ("lo", np.uint64)]).reshape(-1)


def merged_levels(heavy: DataFrame, tops: DataFrame) -> DataFrame:
    """Heavy nodes with ``n_children``, ``n_leaves``, ``saved_tokens`` and ``parent_conv_id``: the shards' totals summed up the heavy levels by doubling jumps."""
    light = tops.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("_c"), F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
    inner = heavy.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("_h"))
    own = heavy.join(light, "node", "left").join(inner, "node", "left").na.fill(0, ["_c", "_l", "_s", "_h"])
    own = own.withColumn("n_children", F.col("_c") + F.col("_h"))
    state = cut(
        own.select("node", "parent", "depth", "conv_id", "n_convs", "n_children", F.col("parent").alias("up"), F.when(F.col("n_children") == 0, 1).otherwise(F.col("_l")).cast("long").alias("n_leaves"), (F.col("_s") + F.col("cost")).alias("saved_tokens"))
    )
    # after k rounds a node holds what lies less than 2**k levels below it, and ``up`` is 2**k levels above
    while not state.where("up IS NOT NULL").isEmpty():
        more = state.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
        jump = state.select(F.col("node").alias("up"), F.col("up").alias("_up"))
        step = state.join(more, "node", "left").join(jump, "up", "left").na.fill(0, ["_l", "_s"])
        state = cut(step.select("node", "parent", "depth", "conv_id", "n_convs", "n_children", F.col("_up").alias("up"), (F.col("n_leaves") + F.col("_l")).alias("n_leaves"), (F.col("saved_tokens") + F.col("_s")).alias("saved_tokens")))
    above = state.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return state.drop("up").join(above, "parent", "left")


def end_digests(ends: DataFrame) -> DataFrame:
    """``node`` and ``ends_sha256`` of the ``conv_id`` that end there, in order; pieces of the lists are written in parallel and hashed as a stream."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, PIECE):
            node, ids = batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()
            first = [k for k in range(len(node)) if k == 0 or node[k] != node[k - 1]] + [len(node)]
            runs = list(zip(first, first[1:], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array([node[a] for a, _ in runs], pa.binary()), pa.array([ids[a] for a, _ in runs], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in runs], pa.string())], names=["node", "first", "text"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if node != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = node, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], names=["node", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    dealt = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(pieces, "node binary, first long, text string")
    return dealt.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node binary, ends_sha256 string")


def trie(turns: DataFrame, shared: int = SHARED, most: int = MOST_SHARED) -> DataFrame:
    """One row a node, named by ``node``: conv_id, depth, parent, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    own = cut(labelled(turns))
    steps = cut(paths(rebuilt(own, shared, most)))
    nodes = cut(nodes_of(steps))
    is_heavy = (F.col("weight") > SHARD_ROWS) | (F.col("depth") == 0)
    heavy, light = nodes.where(is_heavy), nodes.where(~is_heavy)
    names = heavy.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    tops = light.join(names.select("parent"), "parent", "left_semi").select("node")
    # a light node's smallest member passes through the same top as the node itself
    shard_of = steps.where("depth > 0").select("node", "conv_id").join(tops, "node", "left_semi").select("conv_id", F.col("node").alias("shard"))
    shards = light.join(shard_of, "conv_id").withColumn("top", F.col("node") == F.col("shard"))
    below = cut(rolled_up(shards))
    above = merged_levels(heavy, below.where("top").select("parent", "n_leaves", "saved_tokens"))
    columns = ("node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    named = below.where("top").drop("parent_conv_id").join(names, "parent")
    whole = below.where("NOT top").select(*columns).unionByName(named.select(*columns)).unionByName(above.select(*columns))
    ended = end_digests(steps.where("ends").select("node", "conv_id"))
    return whole.join(ended, "node", "left").na.fill(_NONE, ["ends_sha256"])


def report(turns: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie(turns).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE_SQL = """
WITH turns AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), own AS MATERIALIZED (
  SELECT conv_id, list(t ORDER BY pos) AS ts FROM turns GROUP BY conv_id
), takes AS (
  SELECT conv_id, ts, conv_id - conv_id % 100 AS leader, CAST(xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))
  ), 4294967295) % 6 AS INTEGER) AS h
  FROM own
), rebuilt AS MATERIALIZED (
  SELECT a.conv_id, list_concat(coalesce(b.ts, [])[1:h], a.ts[h + 1:]) AS ts FROM takes a LEFT JOIN own b ON b.conv_id = a.leader
), steps AS (
  SELECT conv_id, d, ts[1:d] AS prefix, d = len(ts) AS ends FROM (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS d FROM rebuilt)
), nodes AS MATERIALIZED (
  SELECT prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ends,
         (count(*) - 1) * coalesce(length(prefix[d].text), 0) AS cost
  FROM steps GROUP BY prefix, d
), children AS (
  SELECT prefix[1:depth - 1] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (
  SELECT prefix[1:a] AS prefix, sum(cost) AS saved, count(*) FILTER (n IS NULL) AS leaves
  FROM (SELECT x.prefix, x.cost, c.n, unnest(range(x.depth + 1)) AS a FROM nodes x LEFT JOIN children c USING (prefix)) GROUP BY 1
)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(c.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM nodes x JOIN below USING (prefix) LEFT JOIN children c USING (prefix) LEFT JOIN nodes p ON x.depth > 0 AND p.prefix = x.prefix[1:x.depth - 1]
"""
