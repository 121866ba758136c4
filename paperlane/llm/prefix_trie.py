"""Conversations as a trie of shared first turns, held as balanced parentheses.

Distinct conversations are range-sorted by the hashes of their turns, so what shares a start stands together, and a group of equal ones
is one row with a count. Each shard writes its trie as parentheses, an opening one where a node starts and a closing one where its
subtree ends, with the least and greatest excess of blocks and of pairs of blocks above them. `findclose` delimits a subtree, the rank of
`()` pairs counts its leaves, and cumulative arrays over the nodes in order give members and savings of a subtree as differences.

Only nodes on the first or last path of a shard, its spines, can go on in another one. Shards leave spine nodes out of their sums; the spines
of all shards merge by key into one small trie, whose parentheses add what the spine nodes are worth themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._store import written

GROUP, FIRST = 20, 4  # fixed values: conversations that share first turns, and one more than the most turns shared
SHARD = 1 << 18  # nodes or so of a shard
LISTED = 512  # ids of a group that are joined before they meet others
_FAR = np.iinfo(np.int64).max


class Parens:
    """Balanced parentheses (True opens) with excess blocks.

    `least[0]` and `most[0]` hold the least and greatest excess of each block of `WIDTH` parentheses; every level above holds those of pairs.
    The excess changes by one at a time, so a value between the two occurs in the block.
    """

    WIDTH = 64

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1), dtype=np.int64)
        pad = -len(bits) % self.WIDTH
        blocks = np.pad(self.excess, (0, pad), constant_values=_FAR).reshape(-1, self.WIDTH)
        self.least = [blocks.min(axis=1)] if len(bits) else [np.zeros(0, np.int64)]
        self.most = [np.where(blocks == _FAR, -_FAR, blocks).max(axis=1)] if len(bits) else [np.zeros(0, np.int64)]
        while len(self.least[-1]) > 1:
            odd = len(self.least[-1]) % 2
            self.least.append(np.pad(self.least[-1], (0, odd), constant_values=_FAR).reshape(-1, 2).min(axis=1))
            self.most.append(np.pad(self.most[-1], (0, odd), constant_values=-_FAR).reshape(-1, 2).max(axis=1))
        pairs = bits[:-1] & ~bits[1:] if len(bits) else bits
        self.pairs = np.concatenate([[0], np.cumsum(pairs), [pairs.sum()]]).astype(np.int64)

    @classmethod
    def of_depths(cls, depth: np.ndarray) -> Parens:
        """The tree whose nodes, in order, have these depths; the root has 0."""
        bits = np.zeros(2 * len(depth), bool)
        bits[2 * np.arange(len(depth)) - depth] = True
        return cls(bits)

    def _from(self, at: np.ndarray, target: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """First position from `at` on and before `stop` with excess `target`, or -1."""
        found = np.full(len(at), -1, np.int64)
        left = np.arange(len(at))
        at = at.copy()
        while len(left):
            left = left[at[left] < stop[left]]
            hit = self.excess[at[left]] == target[left]
            found[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
        return found

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """Where the parentheses opened at `opens` close."""
        target = self.excess[opens] - 1
        end = np.minimum((opens // self.WIDTH + 1) * self.WIDTH, len(self.bits))
        close = self._from(opens + 1, target, end)
        left = np.flatnonzero(close < 0)
        node, level = opens[left] // self.WIDTH, np.zeros(len(left), np.int64)
        block = np.full(len(left), -1, np.int64)
        going = np.arange(len(left))
        while len(going):  # up until the tree to the right holds the excess
            up = np.zeros(len(going), bool)
            for l in np.unique(level[going]):
                here = level[going] == l
                mine = going[here]
                right = node[mine] + 1
                fits = (node[mine] % 2 == 0) & (right < len(self.least[l]))
                inside = np.minimum(right, len(self.least[l]) - 1)
                want = target[left[mine]]
                fits &= (self.least[l][inside] <= want) & (self.most[l][inside] >= want)
                block[mine[fits]] = right[fits]
                up[np.flatnonzero(here)[~fits]] = True
            going = going[up]
            node[going] //= 2
            level[going] += 1
        for l in range(int(level.max(initial=0)), 0, -1):  # and down to its first block that does
            mine = np.flatnonzero(level == l)
            low, want = block[mine] * 2, target[left[mine]]
            fits = (self.least[l - 1][low] <= want) & (self.most[l - 1][low] >= want)
            block[mine] = np.where(fits, low, low + 1)
            level[mine] -= 1
        at = block * self.WIDTH
        close[left] = self._from(at, target[left], np.minimum(at + self.WIDTH, len(self.bits)))
        return close

    def leaves(self, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """Number of `()` pairs between them."""
        return self.pairs[closes] - self.pairs[opens]


def _parents(depth: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The parent of each node in order (-1: none) and the nodes of each depth."""
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
    parent = np.full(len(depth), -1, np.int64)
    for above, nodes in zip(levels, levels[1:]):
        parent[nodes] = above[np.searchsorted(above, nodes) - 1]
    return parent, levels


def _below(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of `values` over subtrees, from their cumulative array."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first + size] - total[first]


NODES = "shard int, place long, spine boolean, depth long, id1 long, id2 long, up1 long, up2 long, up_spine boolean, up_conv long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string"


def _shard(number: int, paths: pa.ListArray, n: np.ndarray, low: np.ndarray, ends: list[str]) -> Iterator[pa.RecordBatch]:
    """Nodes of sorted distinct paths; sums of spine nodes leave spine nodes out."""
    flat = paths.flatten()
    k1, k2, words = (c.to_numpy(zero_copy_only=False) for c in flat.flatten())
    size = paths.value_lengths().to_numpy().astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(len(k1)) - np.repeat(begin[:-1], size)
    # a turn is new unless the path before has the same turns up to it
    prior = np.concatenate([[0], size[:-1]])
    there = place < np.repeat(prior, size)
    before = np.where(there, place + np.repeat(np.concatenate([[0], begin[:-2]]), size), 0)
    same = there & (k1[before] == k1) & (k2[before] == k2) if len(k1) else there
    shared = np.zeros(len(size), np.int64)
    some = np.flatnonzero(size)
    if len(some):
        shared[some] = np.minimum.reduceat(np.where(same, _FAR, place), begin[some])
    new = place >= np.repeat(shared, size)
    # a node's key is the sum of the mixed hashes of its turns and their places
    keys = []
    for own in (k1, k2):
        x = own.astype(np.int64).view(np.uint64) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x ^ (x >> np.uint64(31)), dtype=np.uint64)])
        key = total[1:] - np.repeat(total[begin[:-1]], size)
        keys.append(np.concatenate([[0], key.view(np.int64)[new]]))
    depth = np.concatenate([[0], place[new] + 1])
    words = np.concatenate([[0], words[new]]).astype(np.int64)
    last = np.concatenate([[0], np.cumsum(new)])[begin[1:]]  # the node each path ends at
    parens = Parens.of_depths(depth)
    nodes = np.arange(len(depth))
    opens = 2 * nodes - depth
    closes = parens.findclose(opens)
    extent = (closes - opens + 1) // 2
    members = np.zeros(len(depth), np.int64)
    members[last] = n
    members = _below(members, nodes, extent)
    parent, levels = _parents(depth)
    least = np.full(len(depth), _FAR)
    least[last] = low
    for level in levels[:0:-1]:
        np.minimum.at(least, parent[level], least[level])
    spine = np.zeros(len(depth), bool)
    spine[: (size[0] if len(size) else 0) + 1] = True
    at = last[-1]
    while at >= 0:
        spine[at] = True
        at = parent[at]
    leaf = extent == 1
    gain = np.where(spine, 0, (members - 1) * words)
    leaves = parens.leaves(opens, closes) - _below(leaf & spine, nodes, extent)
    counted = nodes[1:][~spine[1:]]
    children = np.bincount(parent[counted], minlength=len(depth))
    up = np.maximum(parent, 0)
    names = np.full(len(depth), None, object)
    names[last] = ends
    columns = [
        np.full(len(depth), number), nodes, spine, depth, keys[0], keys[1], keys[0][up], keys[1][up], spine[up], least[up], least, members, children, leaves, _below(gain, nodes, extent), words, names,
    ]
    types = [pa.int32(), pa.int64(), pa.bool_(), *[pa.int64()] * 5, pa.bool_(), *[pa.int64()] * 7, pa.string()]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in NODES.split(", ")])
    for start in range(0, whole.num_rows, 1 << 16):
        yield whole.slice(start, 1 << 16)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [b for b in batches if b.num_rows]
    if rows:
        table = pa.Table.from_batches(rows).combine_chunks()
        paths, n, low, ends = (table.column(c).chunk(0) for c in ("path", "n", "low", "ends"))
        yield from _shard(TaskContext.get().partitionId(), paths, n.to_numpy(), low.to_numpy(), ends.to_pylist())


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The merged spines, in order: sums completed by what spine nodes are worth."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows).combine_chunks()
    depth, conv, n, children, leaves, saved, words = (table.column(c).to_numpy() for c in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words"))
    parent, _ = _parents(depth)
    nodes = np.arange(len(depth))
    opens = 2 * nodes - depth
    extent = (Parens.of_depths(depth).findclose(opens) - opens + 1) // 2
    children = children + np.bincount(parent[1:], minlength=len(depth))
    leaves = leaves + _below(children == 0, nodes, extent)
    saved = saved + _below((n - 1) * words, nodes, extent)
    above = pa.array(conv[np.maximum(parent, 0)], pa.int64(), mask=parent < 0)
    done = pa.table(
        [table.column("id1"), table.column("id2"), pa.array(conv), pa.array(depth), above, pa.array(n), pa.array(children), pa.array(leaves), pa.array(saved), table.column("ends")],
        ["id1", "id2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"],
    )
    yield from done.to_batches(1 << 16)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (e1, e2, conv_id) to rows of at most LISTED ids of one group, joined by commas."""
    for b in batches:
        if not b.num_rows:
            continue
        e1, e2, ids = (c.to_numpy() for c in b.columns)
        start = np.flatnonzero(np.concatenate([[True], (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1])]))
        count = np.diff(np.append(start, len(ids)))
        place = np.arange(len(ids)) - np.repeat(start, count)
        start = np.flatnonzero(place % LISTED == 0)
        edges = [*start.tolist(), len(ids)]
        texts = [",".join(map(str, ids[a:z].tolist())) for a, z in zip(edges, edges[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(e1[start]), pa.array(e2[start]), pa.array(ids[start]), pa.array(np.diff(edges), pa.int64()), pa.array(texts)], ["e1", "e2", "low", "n", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of `_listed` to one row for each group, its whole list hashed bit by bit."""
    key, low, n, digest = None, 0, 0, None
    rows = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, pa.schema([("low", pa.int64()), ("n", pa.int64()), ("ends", pa.string())]))

    for b in batches:
        for e1, e2, first, count, ids in zip(*(c.to_pylist() for c in b.columns)):
            if (e1, e2) != key:
                if key is not None:
                    rows.append({"low": low, "n": n, "ends": digest.hexdigest()})
                key, low, n, digest = (e1, e2), first, 0, hashlib.sha256()
            else:
                digest.update(b",")
            n += count
            digest.update(ids.encode())
        if len(rows) > 10_000:
            yield batch()
            rows.clear()
    if key is not None:
        rows.append({"low": low, "n": n, "ends": digest.hexdigest()})
        yield batch()


def rebuilt(turns: DataFrame) -> DataFrame:
    """Written (conv_id, path, e1, e2): each conversation with the first turns of its group's first one in place of its own."""
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))).where("conv_id IS NOT NULL")
    one = F.struct("turn", F.xxhash64("role", "text").alias("k1"), F.xxhash64("text", F.lit(1), "role").alias("k2"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    convs = written(convs.select("conv_id", F.expr("transform(turns, t -> struct(t.k1, t.k2, t.words))").alias("turns")), "conversations")
    heads = convs.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, FIRST - 1).alias("head"))
    own = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % FIRST).cast("int"))
    path = F.expr("concat(coalesce(slice(head, 1, h), slice(turns, 1, 0)), slice(turns, h + 1, size(turns)))")
    whole = own.join(heads, "base", "left").select("conv_id", path.alias("path"))
    return written(whole.select("conv_id", "path", F.xxhash64("path").alias("e1"), F.xxhash64(F.lit(1), "path").alias("e2")), "rebuilt")


def trie(turns: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row for each distinct sequence of first turns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turns` has conv_id, turn, role and text; others are not looked at. Null roles and texts are empty, a null turn comes first, and turns of the same number
    are ordered by a hash of role and text, so repeated rows are two equal turns. Rows without a conv_id belong to no
    conversation and are left out. An empty table has no node, not even a root. Turns are known by 128-bit hashes; a conversation is one
    row of 20 bytes for each turn, its texts never travel. The hash of a group's ids is taken by one task, a few hundred ids at a time.
    """
    spark = turns.sparkSession
    whole = rebuilt(turns)
    ends = whole.select("e1", "e2", "conv_id").repartitionByRange("e1", "e2", "conv_id").sortWithinPartitions("e1", "e2", "conv_id")
    ends = ends.mapInArrow(_listed, "e1 long, e2 long, low long, n long, ids string").repartition("e1", "e2").sortWithinPartitions("e1", "e2", "low")
    ends = ends.mapInArrow(_hashed, "low long, n long, ends string")
    paths = written(whole.select(F.col("conv_id").alias("low"), "path").join(ends, "low"), "paths")
    total = paths.agg(F.sum(F.size("path") + 1)).first()[0] or 0
    shards = max(1, -(-total // shard), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 13))
    nodes = written(paths.repartitionByRange(shards, "path").sortWithinPartitions("path").mapInArrow(_shards, NODES), "nodes")

    spine = nodes.where("spine").groupBy("id1", "id2", "depth").agg(
        F.min(F.struct("shard", "place")).alias("at"), F.min("conv_id").alias("conv_id"), F.first("words").alias("words"), F.max("ends").alias("ends"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    # two paths of each shard: a table as small as the list of shards, times the turns of a conversation
    spine = spine.repartition(1).sortWithinPartitions("at").drop("at")
    done = "id1 long, id2 long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
    spine = written(spine.mapInArrow(_fold, done), "spine")
    over = spine.select(F.col("id1").alias("up1"), F.col("id2").alias("up2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    inner = nodes.where("NOT spine")
    below = inner.where("up_spine").join(over, ["up1", "up2", "depth"])
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256")]
    rest = inner.where("NOT up_spine").withColumnRenamed("up_conv", "parent_conv_id")
    return spine.select(*out).unionByName(below.select(*out)).unionByName(rest.select(*out))
