"""Language-model scores with a probabilistic suffix tree over words.

Symbols are the words of a text and one end. The root is the smoothed distribution of single words. A context of the
last one or more words becomes a state if it is frequent and its own next-symbol distribution pays on the training text
itself, each occurrence left out in turn, by at least `least_gain` nats; that is the divergence test. A state lists every
continuation seen in training, however rare, discounted; words never seen there share what is left in proportion to the next
shorter state, so each state is a distribution. A word is scored in the longest state that is a suffix of what precedes it.

Texts are tokenised once, into written blocks of word numbers. Words, and the continuations of states, are unbounded in number and never
reach the driver: a block sends its distinct ones, packed, to buckets by hash, which add them up and send the sums back to the block.
Continuations of one word meet in the bucket of the word if it is rare, else in that of the word and the last one of the context, so
that a bucket has at hand what a longer context is compared with. A state is any context of at least `state` of all training tokens, the
least probability that defines the tree; whatever its words, none is left out before it is counted, for no context is more frequent than
a part of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ._ids import slices
from ._store import written

END = b"\n"  # no word has white space, so no word is this


@dataclass(frozen=True)
class Shares:
    """Parts of all training tokens: of a state, of a word or continuation that all tasks are told of. So at most 1/state states and 1/continuation continuations of a depth.

    Rarer continuations are in the tree as well; only the blocks that have them are told. So `continuation` does not change the result.
    """

    state: float = 2e-5
    continuation: float = 2e-6
    depth: int = 2
    discount: float = 0.5
    least_gain: float = 20.0


WORD_BITS, CONTEXT_BITS = 31, 16
BLOCK = 1 << 19  # tokens of a block, after which it ends with the text
BUCKET = 1 << 22  # tokens of the corpus for each bucket; only a part of them are distinct words or continuations
FEW = {"batch_rows": 8, "read_rows": 8}  # blocks are large rows


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, split at ASCII white space, then the end."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    words.append(END)
    return words


def is_held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of the id as text has remainder `fold`. Null ids never have."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


class _Codes(dict):
    """Numbers of words from 0, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


_UNNUMBERED = np.int64(-1 << 63)


def _long(values: list | np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64())


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte: first the lowest byte of each."""
    width = 8 if len(values) and (values.min() < 0 or values.max() >> 31) else 4
    planes = np.ascontiguousarray(values, f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return len(values).to_bytes(8, "little") + bytes([width]) + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def _unpacked(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data[9:], width * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(f"<i{width}").ravel()


def _blocks(docs: DataFrame) -> DataFrame:
    """Written blocks of whole texts: block, tokens, ids and held_out and sizes of its texts, hashes of its words, and symbols, the place of each token's word there."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        codes, ids, outs, symbols = _Codes(), [], [], []

        def flushed() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(x) for x in symbols], np.int64)
            columns = [_long([block]), _long([int(sizes.sum())]), pa.array([ids], pa.list_(pa.int64())), pa.array([outs], pa.list_(pa.bool_())), pa.array([_packed(sizes)]), pa.array([np.array([_hash(w) for w in codes], np.int64).tobytes()]), pa.array([_packed(np.concatenate(symbols))])]
            yield pa.RecordBatch.from_arrays(columns, ["block", "tokens", "ids", "held_out", "sizes", "words", "symbols"])

        held = 0
        for b in slices(batches):
            for doc_id, text, out in zip(*(c.to_pylist() for c in b.columns)):
                words = tokens_of(text)
                symbols.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
                ids.append(doc_id)
                outs.append(out)
                held += len(words)
                if held >= BLOCK:
                    yield from flushed()
                    codes, ids, outs, symbols = _Codes(), [], [], []
                    block, held = block + 1, 0
        if symbols:
            yield from flushed()

    schema = "block long, tokens long, ids array<long>, held_out array<boolean>, sizes binary, words binary, symbols binary"
    return written(docs.select("doc_id", "text", "held_out").mapInArrow(build, schema), "blocks", batch_rows=2000)


@dataclass
class _Block:
    """Texts in a row: hashes of the distinct words, and of each token its word, its place in its text and whether it is learned from."""

    number: int
    words: np.ndarray
    symbol: np.ndarray
    place: np.ndarray
    train: np.ndarray

    @classmethod
    def of(cls, row: dict) -> _Block:
        sizes = _unpacked(row["sizes"])
        train = np.repeat(~np.array(row["held_out"], bool), sizes)
        return cls(row["block"], np.frombuffer(row["words"], np.int64), _unpacked(row["symbols"]), _places(sizes), train)


@dataclass
class _Vocabulary:
    """Words that all tasks know, numbered from 1, the most frequent first; the first `contexts` stand in contexts. `states`: contexts of two or more words that are counted, sorted."""

    contexts: int
    hashes: np.ndarray
    number: np.ndarray
    states: np.ndarray
    buckets: int = 1

    @classmethod
    def of(cls, contexts: int, words: np.ndarray | list[int]) -> _Vocabulary:
        words = np.array(words, np.int64)
        order = np.argsort(words)
        return cls(contexts, words[order], order + 1, np.zeros(0, np.int64))

    def named(self, words: np.ndarray) -> np.ndarray:
        """Numbers of words known by hash; below zero, the hash, of others."""
        at, known = _find(self.hashes, words)
        names = words | _UNNUMBERED
        names[known] = self.number[at[known]]
        return names

    def pairs(self, block: _Block, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens in counted contexts of `depth` words, their pair, and of the distinct pairs the state, the word's place in the block and the bucket."""
        name = self.named(block.words)
        as_context = np.where((name > 0) & (name <= self.contexts), name, 0)[block.symbol]
        state, alive = np.zeros(len(block.symbol), np.int64), np.ones(len(block.symbol), bool)
        for d in range(1, depth + 1):
            previous = preceding(as_context, d, block.place)
            alive &= previous > 0
            state |= previous << (CONTEXT_BITS * (d - 1))
        if depth > 1:
            alive &= _find(self.states, state)[1]
        at = np.flatnonzero(alive)
        codes, pair = np.unique(state[at] << WORD_BITS | block.symbol[at], return_inverse=True)
        state, word = codes >> WORD_BITS, codes & ((1 << WORD_BITS) - 1)
        name = name[word] if depth else block.words[word] | _UNNUMBERED  # no word is numbered before words are counted
        last = np.where(name > 0, state & ((1 << CONTEXT_BITS) - 1), 0)
        bucket = (_key(last, name).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)) % np.uint64(self.buckets)
        return at, pair, state, word, bucket.astype(np.int64)


def _key(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Identity of a named word in a context."""
    return (word.view(np.uint64) + state.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


_SUMS = "bucket int, block long, state binary, word binary, n binary, shorter binary, c binary"


def _level(blocks: DataFrame, vocabulary: _Vocabulary, depth: int, below: DataFrame | None, listed: int | None = None) -> DataFrame:
    """Written sums of a depth, packed: with block -1 the (state, word, n, shorter, c) of a bucket; with a block, n of each pair that it asked for, or 0 from `listed` on.

    `n`: how often a word follows a state in training; `shorter`: how often it follows the next shorter context; `c`: how
    often it occurs at all; both as far as `below`, the sums of the depth before, has it in the same bucket, else 0. Words are named by the vocabulary; at depth 0 the state is 0 and words are hashes.
    """
    spread = blocks.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by Shares

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block, vocabulary = _Block.of(row), spread.value
                at, pair, state, word, bucket = vocabulary.pairs(block, depth)
                n = np.bincount(pair, weights=block.train[at], minlength=len(state)).astype(np.int64)
                order, bounds = _dealt(bucket)
                name = vocabulary.named(block.words) if depth else block.words
                parts = [order[i:j] for i, j in zip(bounds, bounds[1:])]
                if parts:
                    columns = [pa.array(bucket[order[bounds[:-1]]], pa.int32()), _long([block.number] * len(parts)), pa.array([_packed(state[p]) for p in parts]), pa.array([_packed(name[word[p]]) for p in parts]), pa.array([_packed(n[p]) for p in parts])]
                    yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "state", "word", "n"])

    def add_up(rows: pa.Table) -> pa.Table:
        block, packed = rows.column("block").to_numpy(), {c: rows.column(c).to_pylist() for c in ("state", "word", "n", "c")}

        def column(name: str, some: np.ndarray) -> np.ndarray:
            return np.concatenate([np.zeros(0, np.int64), *(_unpacked(packed[name][i]) for i in some)])

        asked, before = np.flatnonzero(block >= 0), np.flatnonzero(block < 0)
        state, word, each = column("state", asked), column("word", asked), [int.from_bytes(packed["n"][i][:8], "little") for i in asked]
        _, first, pair = np.unique(_key(state, word), return_index=True, return_inverse=True)
        n = np.bincount(pair, weights=column("n", asked), minlength=len(first)).astype(np.int64)
        told = n if listed is None else np.where(n < listed, n, 0)
        answers = [_packed(x) for x in np.split(told[pair], np.cumsum(each)[:-1])] if len(asked) else []
        seen = np.flatnonzero(n > 0)
        seen = seen[np.argsort(state[first[seen]], kind="stable")]
        state, word, n = state[first[seen]], word[first[seen]], n[seen]
        shorter, c = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64) if depth else n
        if len(before):
            key = _key(column("state", before), column("word", before) | (_UNNUMBERED if depth == 1 else 0))
            order = np.argsort(key)
            at, found = _find(key[order], _key(state & ((1 << CONTEXT_BITS * (depth - 1)) - 1), word))
            shorter[found], c[found] = (column(name, before)[order][at[found]] for name in ("n", "c"))
        number, here = rows.column("bucket")[0].as_py(), len(answers)
        out = [[_packed(state)], [_packed(word)], [_packed(n)], [_packed(shorter)], [_packed(c)]]
        out = [[None] * here + out[0], [None] * here + out[1], answers + out[2], [None] * here + out[3], [None] * here + out[4]]
        return pa.Table.from_arrays([pa.array([number] * (here + 1), pa.int32()), _long([*block[asked].tolist(), -1]), *(pa.array(x, pa.binary()) for x in out)], ["bucket", "block", "state", "word", "n", "shorter", "c"])

    asked = blocks.select("block", "held_out", "sizes", "words", "symbols").mapInArrow(ask, "bucket int, block long, state binary, word binary, n binary").withColumn("c", F.lit(None).cast("binary"))
    if below is not None:
        asked = asked.unionByName(below.where("block = -1").select(asked.columns))
    return written(asked.groupBy("bucket").applyInArrow(add_up, _SUMS), "sums", **FEW)


def _dealt(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket, and where each bucket begins in it, with the end of the last."""
    order = np.argsort(bucket, kind="stable")
    return order, np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))


def _listed(sums: DataFrame, least: int = 1) -> DataFrame:
    """Rows (state, word, n, shorter, c) of packed sums with n of at least `least`."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                columns = [_unpacked(row[x]) for x in b.schema.names]
                some = np.flatnonzero(columns[2] >= least)
                for at in range(0, len(some), 100_000):
                    yield pa.RecordBatch.from_arrays([_long(x[some[at : at + 100_000]]) for x in columns], b.schema.names)

    return sums.where("block = -1").select("state", "word", "n", "shorter", "c").mapInArrow(unpack, "state long, word long, n long, shorter long, c long")


def count_words(blocks: DataFrame) -> tuple[DataFrame, int, int, int]:
    """Sums of the words of blocks, as those of the empty context; how many tokens and words are learned from; the number of buckets."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [_unpacked(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([_long([int(n.sum()) for n in each]), _long([len(n) for n in each])], ["tokens", "words"])

    buckets = max(1, (blocks.agg(F.sum("tokens")).first()[0] or 0) // BUCKET)
    sums = _level(blocks, replace(_Vocabulary.of(0, []), buckets=buckets), 0, None)
    total, distinct = (x or 0 for x in sums.where("block = -1").select("n").mapInArrow(add, "tokens long, words long").agg(F.sum("tokens"), F.sum("words")).first())
    return sums, total, distinct, buckets


def _contexts(blocks: DataFrame, words: DataFrame, vocabulary: _Vocabulary, depth: int, least: int, listed: int | None = None) -> tuple[list[DataFrame], _Vocabulary]:
    """Sums of each depth, and the vocabulary with the contexts that were counted.

    A context is counted if it occurs `least` times as the end of a counted shorter one with its next word, which it does at least as
    often as it is followed by anything.
    """
    if depth * CONTEXT_BITS + WORD_BITS > 63:
        raise ValueError("depth allows longer contexts than codes have room for")
    levels: list[DataFrame] = []
    for d in range(1, depth + 1):
        if d > 1:  # at most 1/share of them
            longer = _listed(levels[-1], least).where(F.col("word").between(1, vocabulary.contexts))
            found = longer.select((F.shiftleft("state", CONTEXT_BITS) + F.col("word")).alias("state")).toPandas()["state"]
            vocabulary = replace(vocabulary, states=np.sort(np.concatenate([vocabulary.states, found.to_numpy(np.int64)])))
        levels.append(_level(blocks, vocabulary, d, levels[-1] if levels else words, listed))
    return levels, vocabulary


def count_contexts(docs: DataFrame, contexts: int, words: list[int], depth: int, least: int = 1) -> DataFrame:
    """(state, word, n, shorter, c, depth): how often a word follows a context of 1 to `depth` context words in training documents, see `_level`.

    `word` is its number, or below zero a hash if it has none. `words` are the hashes of numbered words, the first `contexts` of them context words. A context of more words is counted if it occurs `least` times.
    """
    blocks = _blocks(docs)
    counted, _, _, buckets = count_words(blocks)
    levels, _ = _contexts(blocks, counted, replace(_Vocabulary.of(contexts, words), buckets=buckets), depth, least)
    return _all_listed(levels)


def _all_listed(levels: list[DataFrame]) -> DataFrame:
    out = None
    for depth, sums in enumerate(levels, 1):
        level = _listed(sums).withColumn("depth", F.lit(depth))
        out = level if out is None else out.unionByName(level)
    return out


def _places(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def preceding(as_context: np.ndarray, back: int, place: np.ndarray) -> np.ndarray:
    """Context number of the token `back` places before; before each text stands an end, as at the end of the one before."""
    return np.where(place < back - 1, 0, np.roll(as_context, back))


@dataclass
class Tree:
    """States with their continuations, sorted by state << WORD_BITS | word; those that its holder knows."""

    codes: np.ndarray
    log_p: np.ndarray
    states: np.ndarray
    log_rest: np.ndarray  # what words never seen there get, times their probability in the next shorter state
    size: np.ndarray  # occurrences of each state

    def score(self, symbol: np.ndarray, as_context: np.ndarray, root: np.ndarray, depth: int, place: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each token; `root`: that of single words; `place`: in its text, for several texts in a row."""
        out = root.copy()
        place = np.arange(len(symbol)) if place is None else place
        state = np.zeros(len(symbol), np.int64)
        alive = np.arange(len(symbol))
        for d in range(1, depth + 1):
            previous = preceding(as_context, d, place)
            alive = alive[previous[alive] > 0]
            state[alive] |= previous[alive] << (CONTEXT_BITS * (d - 1))
            i, known = _find(self.states, state[alive])
            at = alive[known]
            out[at] += self.log_rest[i[known]]
            at = at[symbol[at] > 0]
            j, listed = _find(self.codes, state[at] << WORD_BITS | symbol[at])
            out[at[listed]] = self.log_p[j[listed]]
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


def grow(counts: DataFrame, root: dict[int, float], total: int, shares: Shares) -> Tree:
    """The tree from (state, word, n, shorter, c), see `count_contexts`; level by level, each state against the longest kept one below it.

    `root` has the probabilities of numbered words, and at 0 that of a word never seen; one seen c times has c + 1 times as much.
    All continuations make up a state. What comes to the driver are sums of states of at least `shares.state` and of these, continuations of at
    least `shares.continuation` of all training tokens: at most depth / share rows of either kind. Only these continuations are in the tree it returns.
    """
    least, discount = least_listed(total, shares), shares.discount
    single = np.zeros(max(root, default=0) + 1)
    single[list(root.keys())] = list(root.values())
    states, sizes, rests = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    names = ["size", "kinds", "old", "gain", "often", "once", "old_once"]
    for d in range(1, shares.depth + 1):
        spread = counts.sparkSession.sparkContext.broadcast((single, states, sizes))
        level = counts.where(F.col("depth") == d)

        def add(batches: Iterator[pa.RecordBatch], d: int = d, spread=spread) -> Iterator[pa.RecordBatch]:
            single, states, sizes = spread.value
            for b in batches:
                state, word, n, shorter, c = (x.to_numpy() for x in b.columns)
                old = np.where(word > 0, single[np.maximum(word, 0)], (c + 1) * single[0])
                i, known = _find(states, state & ((1 << CONTEXT_BITS * (d - 1)) - 1))  # the suffix: without the word farthest back
                old[known] = (shorter[known] - discount) / sizes[i[known]]
                many = n > 1
                gain = np.zeros(len(n))  # each occurrence left out of its own estimate, before it is divided by the others
                gain[many] = n[many] * np.log((n[many] - 1 - discount) / old[many])
                distinct, at = np.unique(state, return_inverse=True)
                sums = [np.bincount(at, weights=x, minlength=len(distinct)) for x in (n, np.ones(len(n)), old, gain, n * many, ~many, old * ~many)]
                yield pa.RecordBatch.from_arrays([_long(distinct), *(pa.array(x) for x in sums)], ["state", *names])

        sums = level.select("state", "word", "n", "shorter", "c").mapInArrow(add, f"state long, {', '.join(f'{x} double' for x in names)}")
        sums = sums.groupBy("state").agg(*(F.sum(x).alias(x) for x in names)).where(F.col("size") >= least_state(total, shares)).toPandas().sort_values("state")
        size, kinds, old, gain, often, once, old_once = (sums[x].to_numpy(float) for x in names)
        unseen = np.maximum(1e-12, 1 - old)
        rest = discount * kinds / size / unseen
        # a continuation seen once is unseen without that occurrence, and adds to what the unseen ones share
        alone = discount * np.maximum(kinds - 1, 1e-9) / np.maximum(1, size - 1) / (unseen + old_once / np.maximum(1, once))
        gain = gain - often * np.log(np.maximum(1, size - 1)) + once * np.log(alone)
        keep = (gain >= shares.least_gain) & (rest > 0)
        # longer contexts have larger numbers, so all stays sorted
        states, sizes, rests = np.concatenate([states, sums["state"].to_numpy(np.int64)[keep]]), np.concatenate([sizes, size[keep]]), np.concatenate([rests, rest[keep]])
    rows = counts.where((F.col("word") > 0) & (F.col("n") >= least)).select("state", "word", "n").toPandas().sort_values(["state", "word"])
    state, word, n = rows["state"].to_numpy(np.int64), rows["word"].to_numpy(np.int64), rows["n"].to_numpy(float)
    i, kept = _find(states, state)
    return Tree((state << WORD_BITS | word)[kept], np.log10((n[kept] - discount) / sizes[i[kept]]), states, np.log10(rests), sizes)


def least_state(total: int, shares: Shares) -> int:
    return max(4, int(np.ceil(shares.state * total)))


def least_listed(total: int, shares: Shares) -> int:
    """Words and continuations of so many occurrences are known to all tasks."""
    return max(1, int(np.ceil(shares.continuation * total)))


def score(docs: DataFrame, held_out: Column | None = None, shares: Shares = Shares()) -> DataFrame:
    """For every row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the whole text).

    Learns from rows that are not held out. Null texts are empty: one end. Rows that repeat an id are rows of their own; null ids
    are training rows. Only doc_id and text are looked at. An empty table gives no rows; without training rows nothing is known and
    both scores are those of unknown tokens. A text stays whole in one block, eight bytes a word while it is counted or scored.
    """
    flag = is_held_out(F.col("doc_id")) if held_out is None else held_out
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), flag.alias("held_out"))
    blocks = _blocks(docs)
    counted, total, distinct, buckets = count_words(blocks)
    least = least_listed(total, shares)
    frequent = _listed(counted, min(least, least_state(total, shares)))  # with all that stand in contexts; at most 1/share rows
    frequent = frequent.select("word", "n").toPandas().sort_values(["n", "word"], ascending=[False, True])
    words, often = frequent["word"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64)
    contexts = int((often >= least_state(total, shares)).sum())
    if contexts >= 1 << CONTEXT_BITS:
        raise ValueError("shares allow more words than codes have room for")
    mass = float(total + distinct + 1)
    root = {0: 1 / mass} | dict(enumerate(((often + 1) / mass).tolist(), 1))
    levels, vocabulary = _contexts(blocks, counted, replace(_Vocabulary.of(contexts, words), buckets=buckets), shares.depth, least_state(total, shares), least)
    tree = grow(_all_listed(levels), root, total, shares)
    spread = docs.sparkSession.sparkContext.broadcast((vocabulary, tree))
    depth, discount = shares.depth, shares.discount
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def judge(texts: pa.Table, answers: pa.Table) -> pa.Table:
        vocabulary, tree = spread.value
        row = texts.to_pylist()[0]  # a block is one row
        block = _Block.of(row)
        told = sorted(zip(*(answers.column(c).to_pylist() for c in ("depth", "bucket", "n"))))
        number = np.maximum(0, vocabulary.named(block.words))
        c, codes, log_p = np.zeros(len(block.words), np.int64), [np.zeros(0, np.int64)], [np.zeros(0)]
        for d in range(depth + 1):
            _, _, state, word, bucket = vocabulary.pairs(block, d)
            n = np.zeros(len(state), np.int64)
            n[_dealt(bucket)[0]] = np.concatenate([np.zeros(0, np.int64), *(_unpacked(x) for of, _, x in told if of == d)])
            if not d:
                c[word] = n
                continue
            i, kept = _find(tree.states, state)
            j, known = _find(tree.codes, state << WORD_BITS | number[word])
            rare, known = kept & (n > 0), known & (n == 0)
            p = np.zeros(len(n))
            p[rare] = np.log10((n[rare] - discount) / tree.size[i[rare]])
            p[known] = tree.log_p[j[known]]
            codes.append((state << WORD_BITS | word + 1)[rare | known])
            log_p.append(p[rare | known])
        here = Tree(np.concatenate(codes), np.concatenate(log_p), tree.states, tree.log_rest, tree.size)
        as_context = np.where(number <= vocabulary.contexts, number, 0)
        scores = here.score(block.symbol + 1, as_context[block.symbol], np.log10((c + 1) / mass)[block.symbol], depth, block.place)
        first = np.flatnonzero(block.place == 0)
        sums = [np.add.reduceat(x, first) for x in (np.ones(len(scores), np.int64), (c > 0).astype(np.int64)[block.symbol], np.log10((c + 1) / mass)[block.symbol], scores)]
        columns = [_long(row["ids"]), pa.array(row["held_out"], pa.bool_()), _long(sums[0]), _long(sums[1]), _long(np.full(len(first), total)), pa.array(sums[2]), pa.array(sums[3])]
        return pa.Table.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = None
    for d, sums in enumerate([counted, *levels]):
        own = sums.where("block >= 0").select("block", F.lit(d).alias("depth"), "bucket", "n")
        answers = own if answers is None else answers.unionByName(own)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, schema)
