"""Documents linked by the Jaccard similarity of their word n-grams, found through a token-group matrix.

1. Equal sets are one node. 2. Nodes that share the smallest value of a hash of their n-grams form a group, and each is
compared with the group's head, the node with most in common with the others; linked ones become one larger group. 3. The
matrix lists, for each n-gram, the groups whose token union has it. Which n-grams enter is decided by a common order, rarest first: two sets similar enough share at
least `SHARED` of the first ones of each. So a node's overlap with the union of a group bounds its overlap with any member, and
only groups that reach the bound, which rises with the sizes of both, are opened. A node and a group meet only by an n-gram that can be
the first one that the node shares with a member: both have enough n-grams from there on. Near copies whose own changes fill that
part do not meet, however many they are. 4. The node, of the smaller group, is compared as a whole set with the most shared node of the other group,
and if they are still apart with the members of the opened group that reach the bound themselves.

All links between different texts count in the components; none is lost to a cap. Nodes and n-grams are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ._components import components
from ._ids import slices
from ._store import written

WORDS = 5
LEAST = 4  # n-grams of a set that may be linked with a different one: 4 of 5 are 80 percent, 3 of 4 are no more than 75
GROUPINGS = 4  # hash functions that groups are formed by
BINS = 32  # of hash values, whose first n-grams tell how close a set is to others
SHARED = 2  # n-grams that the first parts of two linked sets share at least
SKETCH_BITS = 22  # of the table of repeated n-grams that orders them
STRETCH = 1 << 21  # n-grams among which repeated ones are looked for
BITMAP_BITS = 24
TEXTS_AT_ONCE = 2000  # rows with a text that go to Python together
PAIRS_AT_ONCE = 200  # pairs of whole sets that go to Python together
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[4]
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, hashes: dict[bytes, int], size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; with fewer words, of all of them as one run; none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size_here = min(size, len(w))
    n = len(w) - size_here + 1
    h = np.full(n, size_here, np.uint64)
    for k in range(size_here):
        h = _mix(h * _ODD[0] + w[k : k + n])
    return np.unique(h)


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(20)).astype(np.int64) & ((1 << SKETCH_BITS) - 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _node(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _firsts(s: np.ndarray) -> np.ndarray:
    """The first n-gram in each of BINS equal parts of the range of hashes, shortened; that of the next part for an empty one."""
    at = np.searchsorted(s, np.arange(BINS, dtype=np.uint64) * np.uint64((1 << 64) // BINS))
    return (s[np.minimum(at, len(s) - 1)] >> np.uint64(20)).astype(np.uint32).view(np.int32)


def summarize(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """One row for each document (doc_id, n, node, group values), and rows of the frequency table (chunk, counts), in one pass.

    Only n-grams that several sets of one stretch have are counted. Most n-grams are alone and would drown the others in a table of fixed size.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = _Hashes(), np.zeros(1 << SKETCH_BITS, np.int32)
        stretch: list[np.ndarray] = []
        filled, seen = 0, set()

        def fold() -> None:
            found = np.concatenate(stretch) if stretch else np.zeros(0, np.uint64)
            stretch.clear()
            found.sort()
            first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(found)))
            np.add.at(counts, _slot(found[first[times > 1]]), times[times > 1].astype(np.int32))
            seen.clear()

        names = ["doc_id", "n", "node", "mins", "firsts", "chunk", "counts"]
        mins_type, firsts_type, none = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.nulls
        for b in slices(batches):
            ids, ns, nodes, mins, firsts = b.column(0), [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, hashes, size)
                ns.append(len(s))
                node = _node(s) if len(s) else None
                nodes.append(node)
                mins.append([int(x) for x in np.array([_mix(s * odd).min() for odd in _ODD[:GROUPINGS]]).view(np.int64)] if len(s) >= LEAST else None)
                firsts.append(_firsts(s) if len(s) >= LEAST else None)
                if node is not None and node not in seen:  # copies are one set
                    seen.add(node)
                    stretch.append(s)
                    filled += len(s)
                    if filled > STRETCH:
                        fold()
                        filled = 0
            k = len(ns)
            yield pa.RecordBatch.from_arrays([ids, pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(mins, mins_type), pa.array(firsts, firsts_type), none(k, pa.int32()), none(k, pa.binary())], names)
        fold()
        parts = np.split(counts, 64)
        for i in range(64):
            if parts[i].any():
                yield pa.RecordBatch.from_arrays([none(1, pa.int64()), none(1, pa.int64()), none(1, pa.int64()), none(1, mins_type), none(1, firsts_type), pa.array([i], pa.int32()), pa.array([parts[i].tobytes()], pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n long, node long, mins array<long>, firsts array<int>, chunk int, counts binary")


def frequency_table(rows: DataFrame) -> np.ndarray:
    """Powers of two of the sums of the tables of all tasks: 2**SKETCH_BITS bytes, whatever the size of the data."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chunk = None, None
        for b in batches:
            chunk = b.column(0)[0].as_py()
            for x in b.column(1):
                part = np.frombuffer(x.as_buffer(), np.int32)
                total = part.astype(np.int64) if total is None else total + part
        often = np.ceil(np.log2(total + 1)).astype(np.uint8)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "counts": pa.array([often.tobytes()], pa.binary())})

    out = np.zeros((64, (1 << SKETCH_BITS) // 64), np.uint8)
    for r in rows.where("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect():
        out[r["chunk"]] = np.frombuffer(r["counts"], np.uint8)
    return out.ravel()


def first_part(s: np.ndarray, table: np.ndarray, percent: int) -> np.ndarray:
    """The rarest n-grams of a set in their order: as many as leave `SHARED` of them to any set of `percent` overlap."""
    keep = len(s) - -(-percent * len(s) // 100) + SHARED
    order = np.argsort(table[_slot(s)].astype(np.uint64) << np.uint64(56) | s >> np.uint64(8), kind="stable")  # ties in the order of the hash: one order for all sets
    return s[order[:keep]]


def matrix_rows(docs: DataFrame, table: np.ndarray, percent: int, size: int = WORDS) -> DataFrame:
    """(token, node, reach): the first part of each document's set; copies within a task once.

    Sets of n and m n-grams that are linked have percent * (n + m) / (100 + percent) in common or more. If an n-gram with i before it is the
    first common one, none of the i is common; so 100 * n - (100 + percent) * i, its reach, is percent * m at least.
    """
    spread = docs.sparkSession.sparkContext.broadcast(table)  # of fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, order, seen = _Hashes(), spread.value, set()
        for b in slices(batches):
            tokens, nodes, reach = [], [], []
            for text in b.column(0).to_pylist():
                s = shingles(text, hashes, size)
                if len(s) < LEAST:
                    continue
                node = _node(s)
                if node in seen:
                    continue
                seen.add(node)
                part = first_part(s, order, percent)
                tokens.append(part)
                nodes.append(np.full(len(part), node, np.int64))
                reach.append(100 * len(s) - (100 + percent) * np.arange(len(part)))
            if tokens:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(tokens)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(reach))], ["token", "node", "reach"])

    return docs.select("text").mapInArrow(work, "token long, node long, reach long")


def shared_least(n_a: Column, n_b: Column, percent: int) -> Column:
    """How many n-grams the first parts of two linked sets of these sizes share at least; `SHARED` or more for sizes that fit.

    Linked sets have at least `common` n-grams together, so at most n - common of either are missing from the other. The part that ends
    first in the common order lies in the other set but for these, and what both have up to there is in both parts.
    """
    common = F.ceil(percent * (n_a + n_b) / (100 + percent) - 1e-6)  # rounding may only lower it
    left_out = F.ceil(percent * F.greatest(n_a, n_b) / 100 + 1e-6)  # or raise this
    return SHARED + common - left_out


def _place(doc_id: np.ndarray) -> np.ndarray:
    return (_mix(doc_id.astype(np.int64).view(np.uint64) * _ODD[1]) & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)


def sets_of(docs: DataFrame, wanted: DataFrame, size: int = WORDS) -> DataFrame:
    """(node, grams) of the nodes in `wanted` (node, doc_id of one document with that set).

    A bitmap of fixed size over hashed ids keeps most other documents' texts out of the join.
    """
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, chunk = np.zeros(1 << (BITMAP_BITS - 6), bool), None
        for b in batches:
            chunk = b.column(0)[0].as_py()
            bits[_place(b.column(1).to_numpy()) & (len(bits) - 1)] = True
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _place(b.column(0).to_numpy())
            _, one = np.unique(at, return_index=True)  # ids of one place set the same bit
            yield pa.RecordBatch.from_arrays([pa.array((at[one] >> (BITMAP_BITS - 6)).astype(np.int32)), b.column(0).take(pa.array(one))], ["chunk", "doc_id"])

    wanted = written(wanted.select("node", "doc_id"), "wanted")
    bitmap = np.zeros((64, 1 << (BITMAP_BITS - 6)), bool)
    ids = wanted.select("doc_id").mapInArrow(chunks, "chunk int, doc_id long")
    for r in ids.groupBy("chunk").applyInArrow(mark, "chunk int, bits binary").collect():
        bitmap[r["chunk"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    spread = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap.ravel()))

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes = spread.value, _Hashes()  # eight places a byte, the first is the highest bit
        for b in slices(batches):
            at = _place(b.column(0).to_numpy())
            b = b.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))
            if not b.num_rows:
                continue
            sets = [shingles(t, hashes, size) for t in b.column(1).to_pylist()]
            keep = [i for i, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([_node(sets[i]) for i in keep], pa.int64()), pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["doc_id", "node", "grams"])

    found = docs.select("doc_id", "text").mapInArrow(sieve, "doc_id long, node long, grams binary")
    return written(found.join(wanted, ["doc_id", "node"], "left_semi").dropDuplicates(["doc_id", "node"]).select("node", "grams"), "sets", TEXTS_AT_ONCE)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of `pairs` whose whole sets have at least `percent` of their union in common."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("left_grams"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("right_grams"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "left_grams", "right_grams").mapInArrow(compare, "a long, b long")


def join_groups(docs: DataFrame, percent: int = 80, size: int = WORDS) -> DataFrame:
    """For every row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included).

    Words are lower-cased in A-Z and split at ASCII white space. Null, empty and wordless texts have an empty set and are linked
    with nothing. Equal texts are linked, repeated rows too; the answer of a row with a null id is that of its text. Other columns are not
    looked at; an empty table gives no rows. Needs percent > 75, by which sets below four n-grams are linked only if equal.
    """
    if not 75 < percent <= 100:
        raise ValueError("percent must be above 75 and at most 100")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(summarize(docs, size), "summaries", TEXTS_AT_ONCE)
    table = frequency_table(rows)
    own = rows.where("chunk is null").select("doc_id", "n", "node", "mins", "firsts")
    nodes = own.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("mins").alias("mins"), F.min("firsts").alias("firsts"))
    nodes = written(nodes, "nodes")
    known = nodes.select("node", "doc_id", "n")

    # groups by smallest hash value, each node against the group's head: that with most in common with the others, as the text is that
    # copies were made from. So copies far from each other meet in one star instead of staying groups of their own
    members = nodes.where("mins is not null").select("node", "n", F.posexplode("mins").alias("grouping", "value"))
    values = members.groupBy("grouping", "value").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    members = written(members.join(values, ["grouping", "value"]), "members")
    crowd = nodes.join(members.where("many > 2").select("node"), "node", "left_semi").select("node", F.posexplode("firsts").alias("bin", "first"))
    common = crowd.groupBy("bin", "first").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    scores = crowd.join(common, ["bin", "first"]).groupBy("node").agg(F.sum("times").alias("score"))
    members = members.join(scores, "node", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    heads = members.groupBy("grouping", "value").agg(F.max(F.struct("score", "node", "n")).alias("head"))
    close = (F.least("n", "head.n") * 100 >= F.greatest("n", "head.n") * percent) & (F.col("node") != F.col("head.node"))
    pairs = written(members.join(heads, ["grouping", "value"]).where(close).select(F.col("node").alias("a"), F.col("head.node").alias("b")).distinct(), "pairs")
    links = written(linked(pairs, _sets(docs, pairs, known, size), percent), "links", PAIRS_AT_ONCE)
    groups = written(components(links), "groups")

    # the matrix: n-grams that several groups have, with the groups
    by_token = W.partitionBy("token")
    cells = matrix_rows(docs, table, percent, size)
    cells = cells.withColumns({"low": F.min("node").over(by_token), "high": F.max("node").over(by_token)}).where("low <> high").select("token", "node", "reach")
    cells = cells.join(groups, "node", "left").select("token", "node", "reach", F.coalesce("component", "node").alias("group")).distinct()
    cells = written(cells, "cells", TEXTS_AT_ONCE)
    matrix = cells.select("token", "group").distinct()
    shared = matrix.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count(F.lit(1)).alias("times")).where("low <> high").select("token", "times")
    cells = written(cells.join(shared, "token"), "shared")
    sizes = cells.groupBy("node").agg(F.count(F.lit(1)).alias("held"), F.sum("times").alias("score")).join(known.select("node", "n"), "node")
    cells = written(cells.drop("times").join(sizes, "node"), "sized")
    peers = cells.select("group", "node", "score").distinct().groupBy("group").agg(F.count(F.lit(1)).alias("many"), F.max(F.struct("score", "node")).alias("top"))
    peers = written(peers.select("group", "many", F.col("top.node").alias("head")), "peers")
    matrix = cells.groupBy("token", F.col("group").alias("other")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("held").alias("most_held"), F.max(F.struct("reach", "node")).alias("best"))
    matrix = written(matrix.withColumn("farthest", F.col("best.reach")), "matrix")

    # which groups a node's overlap with the union lets open: it must reach what the sizes of some member ask for
    smallest = F.greatest("least", F.ceil(F.col("n") * percent / 100 - 1e-6))
    largest = F.least("most", F.floor(F.col("n") * 100 / percent + 1e-6))
    asked = F.least(shared_least(F.col("n"), smallest, percent), shared_least(F.col("n"), largest, percent)) - 1
    within = (smallest <= largest) & (asked <= F.least("held", "most_held"))
    # the smaller group's nodes meet the larger group by what may be their first common n-gram
    begins = (F.col("reach") >= percent * smallest) & (F.col("farthest") >= percent * F.col("n"))
    mine = cells.join(peers.drop("head"), "group")
    theirs = matrix.join(peers.select(F.col("group").alias("other"), F.col("many").alias("other_many")), "other")
    before = (F.col("many") < F.col("other_many")) | ((F.col("many") == F.col("other_many")) & (F.col("group") < F.col("other")))
    begun = written(mine.join(theirs, "token").where(before & within & begins).select("node", "other").distinct(), "begun")
    size_a = known.select(F.col("node").alias("a"), F.col("n").alias("n_a"))
    size_b = known.select(F.col("node").alias("b"), F.col("n").alias("n_b"))
    fit = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent

    def compared(candidates: DataFrame, links: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
        candidates = written(candidates, "candidates")
        if candidates.isEmpty():
            return links, groups
        links = written(links.unionByName(linked(candidates, _sets(docs, candidates, known, size), percent)), "links", PAIRS_AT_ONCE)
        return links, written(components(links), "groups")

    # first the group's node that shares most, which joins most copies of one text; whole groups only for what is still apart
    heads = peers.select(F.col("group").alias("other"), F.col("head").alias("b"))
    named = begun.join(heads, "other").select(F.col("node").alias("a"), "b").join(size_a, "a").join(size_b, "b").where(fit).select("a", "b")
    several = groups.select(F.col("component").alias("other")).distinct()  # a group of one node is that node, compared now
    links, groups = compared(named, links, groups)

    def apart(pairs: DataFrame) -> DataFrame:
        now = lambda name: groups.select(F.col("node").alias(name), F.col("component").alias(f"{name}_group"))
        pairs = pairs.join(now("node"), "node", "left").join(now("other"), "other", "left")
        return pairs.where(F.coalesce("node_group", "node") != F.coalesce("other_group", "other")).select("node", "other")

    # of the rest only groups whose union has enough of the node's first part for some member are opened
    met = apart(begun.join(several, "other", "left_semi")).join(cells, "node").join(matrix, ["token", "other"]).where(within)
    met = met.groupBy("node", "other").agg(F.count(F.lit(1)).alias("overlap"), F.min("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    opened = written(met.where((F.col("overlap") >= SHARED) & (F.col("overlap") >= asked)).select("node", "other"), "opened")
    # for each n-gram that they may have as the first common one, the member that has the fewest n-grams before it
    cells_a = cells.select(F.col("node").alias("a"), "token", F.col("n").alias("n_a"), F.col("held").alias("held_a"), F.col("reach").alias("reach_a"))
    bests = matrix.select("token", "other", "least", "farthest", F.col("best.node").alias("b"))
    begins = (F.col("reach_a") >= percent * F.col("least")) & (F.col("farthest") >= percent * F.col("n_a"))
    nearest = opened.withColumnRenamed("node", "a").join(cells_a, "a").join(bests, ["token", "other"]).where(begins).select("a", "b").distinct()
    links, groups = compared(nearest.join(size_a, "a").join(size_b, "b").where(fit).select("a", "b"), links, groups)
    # its members that have as many n-grams of the node's first part as the two sizes ask for
    cells_b = cells.select(F.col("node").alias("b"), F.col("group").alias("other"), "token", F.col("n").alias("n_b"), F.col("held").alias("held_b"), F.col("reach").alias("reach_b"))
    both = shared_least(F.col("n_a"), F.col("n_b"), percent)
    begins = (F.col("reach_a") >= percent * F.col("n_b")) & (F.col("reach_b") >= percent * F.col("n_a"))
    begun = apart(opened).withColumnRenamed("node", "a").join(cells_a, "a").join(cells_b, ["token", "other"]).where(fit & (both <= F.least("held_a", "held_b")) & begins)
    begun = written(begun.select("a", "b").distinct(), "begun")
    met = begun.join(cells_a, "a").join(cells_b, ["token", "b"])
    met = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap"), F.min("n_a").alias("n_a"), F.min("n_b").alias("n_b")).where((F.col("overlap") >= SHARED) & (F.col("overlap") >= both))
    links, groups = compared(met.select("a", "b"), links, groups)

    placed = known.join(groups, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("group"))
    lowest = placed.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    answer = written(placed.join(lowest, "group").select("node", "component_id"), "answer")
    return own.join(answer, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _sets(docs: DataFrame, pairs: DataFrame, known: DataFrame, size: int) -> DataFrame:
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    keyed = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id")  # nodes of rows without an id are found too
    return sets_of(docs.select(keyed, "text"), known.join(wanted, "node", "left_semi").select("node", keyed), size)
