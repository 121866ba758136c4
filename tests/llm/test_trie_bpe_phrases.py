"""Prefix trie, chunked BPE and phrase mining against plain loops, on whole small tables and on odd rows."""

import base64
import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from paperlane.llm import bpe, phrases, prefix_trie

DATA = "/root/testdata/sf0.001"
EMPTY = hashlib.sha256(b"").hexdigest()


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- trie ----------------------------------------------------------------------------------------------------------


def plain_trie(given):
    """(conv_id, depth, parent's, convs, children, leaves, saved, ends) of every node of (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in given:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in convs.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for node, held in members.items():
        gain = (len(held) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += gain
    out = Counter()
    for node, held in members.items():
        ends = ",".join(str(c) for c in sorted(held) if len(whole[c]) == len(node))
        out[min(held), len(node), min(members[node[:-1]]) if node else None, len(held), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def trie_rows(frame, **options):
    return Counter(tuple(r) for r in prefix_trie.trie(frame, **options).collect())


def test_trie_matches_plain_loops(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    frame = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    assert trie_rows(frame) == plain_trie(given)
    assert trie_rows(frame, shard=7) == plain_trie(given)  # many shards, all of them with spines


@pytest.mark.parametrize("shard", [4, 50, 1 << 18])
def test_trie_of_shared_starts_and_copies(spark, shard):
    rng = np.random.default_rng(5)
    given = []
    for c in range(240):
        turns = [("user", "hello there")] if c % 3 else []  # a first turn that most share
        turns += [("assistant", f"a  b{x}\tc") for x in rng.integers(0, 3, int(rng.integers(0, 7)))]
        given += [(c, i, *t) for i, t in enumerate(turns)] if c % 4 else [(c, 0, "user", "copy"), (c, 1, "user", "of one"), (c, 2, None, None), (c, 3, "user", "conversation")]
    given += [(-45, None, None, "null turn first"), (-45, -9, "x", "then"), (-40, 1, "x", None), ((1 << 63) - 1, 5, "u", "far"), (-(1 << 63), 5, "u", "far")]
    given += [(1000, i, "u", f"turn {i // 2}") for i in range(300)] + [(1001, i, "u", f"turn {i // 2}") for i in range(301)]
    given += [(7000, 1, "r", "same"), (7000, 1, "r", "same"), (None, 1, "r", "no conversation")]
    frame = spark.createDataFrame([(*g, "x", 1) for g in given], "conv_id long, turn long, role string, text string, path string, low long")
    assert trie_rows(frame, shard=shard) == plain_trie(given)


def test_trie_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie_rows(spark.createDataFrame([], schema)) == Counter()
    assert trie_rows(spark.createDataFrame([(None, 1, "a", "b")], schema)) == Counter()
    got = trie_rows(spark.createDataFrame([(1, 0, "a", "b")], schema))  # its only turn is one of the first, those of an absent conversation
    h = zlib.crc32(b"1") % 4
    ends = hashlib.sha256(b"1").hexdigest()
    assert got == Counter([(1, 0, None, 1, 0, 1, 0, ends)] if h else [(1, 0, None, 1, 1, 1, 0, EMPTY), (1, 1, 1, 1, 0, 1, 0, ends)])


def test_a_group_of_many_copies_is_hashed_in_order(spark):
    given = [(20 * i, 0, "u", "same") for i in range(1500)]
    frame = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    assert trie_rows(frame) == plain_trie(given)


@pytest.mark.parametrize("seed", range(6))
def test_findclose_by_blocks_equals_a_stack(seed):
    rng = np.random.default_rng(seed)
    depth = [0]
    for _ in range(int(rng.integers(0, 3000))):
        depth.append(int(rng.integers(max(1, depth[-1] - (3 if seed % 2 else 400)), depth[-1] + 2)))
    depth = np.array(depth)
    tree = prefix_trie.Parens.of_depths(depth)
    stack, close, pairs = [], {}, 0
    for i, b in enumerate(tree.bits.tolist()):
        if b:
            stack.append(i)
            pairs += not tree.bits[i + 1]
        else:
            close[stack.pop()] = i
    opens = np.flatnonzero(tree.bits)
    assert opens.tolist() == (2 * np.arange(len(depth)) - depth).tolist()
    assert tree.findclose(opens).tolist() == [close[i] for i in opens.tolist()]
    assert tree.leaves(opens[:1], tree.findclose(opens[:1]))[0] == pairs


# --- bpe -----------------------------------------------------------------------------------------------------------

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


ODD = [
    None, "", " ", "a", "  two  spaces   three    four\t\t\ttabs \n\n\n lines\r\n \r\n end   ", "don't we'll they're I've 'tis 'S 'll''re '''s x'", "letters" * 90, " " * 333, "1234567890" * 40 + "x",
    "!?" * 200 + "a" + "é" * 150 + "́" * 70, "日本語テキスト。" * 30 + "　" * 25 + "中", "\U0001f600\U0001f3fd‍" * 60, "\U000107bb\U00011de0 new letters \U000107bc" * 12, "½Ⅷ²٣ " * 50, "\x1c\x1d\x85 \xa0 " * 40,
    "<|endoftext|> is text", "'" * 99 + "re" + " '" * 50, "x" * 39 + "'" + "ve" + "y" * 38 + " 's" * 40, "\n" * 41 + "a" + " " * 41 + "b" + " \n" * 41, "ab " * 500,
]


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 16), (41, 40), (17, 9), (1 << 16, 1 << 10)])
def test_bpe_of_stitched_chunks_equals_whole_texts(spark, plain, chunk, overlap):
    frame = spark.createDataFrame([(i if i % 5 else None, t, "x", 3) for i, t in enumerate([*ODD, *ODD[:3]])], "doc_id long, text string, ids string, piece int")
    coded = bpe.decode(bpe.encode(frame, RANKS, PATTERN, chunk=chunk, overlap=overlap), RANKS, PATTERN)
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows_of(bpe.digests(coded)))
    want = Counter()
    for doc, text, *_ in frame.collect():
        ids = np.array(plain(text or ""), "<u4")
        want[doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert got == want
    if chunk == 40:
        pieces = Counter(r["row_key"] for r in coded.collect() if r["row_key"])
        assert max(pieces.values()) > 10  # "ab ab ..." meets in every overlap
        assert bpe.digests(bpe.decode(bpe.encode(frame.limit(0), RANKS, PATTERN), RANKS, PATTERN)).count() == 0


def test_bpe_of_documents(spark, plain):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: r for r in rows_of(bpe.digests(bpe.decode(bpe.encode(docs, RANKS, PATTERN, chunk=3000, overlap=60), RANKS, PATTERN)))}
    assert len(got) == docs.count()
    for r in docs.collect():
        ids = np.array(plain(r["text"] or ""), "<u4")
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_random_texts_of_few_kinds_of_characters(spark, plain):
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("ab' s\n1!　é"), int(rng.integers(0, 400)), p=[0.2, 0.1, 0.1, 0.2, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids_sha256"] for r in rows_of(bpe.digests(bpe.decode(bpe.encode(frame, RANKS, PATTERN, chunk=30, overlap=14), RANKS, PATTERN)))}
    assert got == {i: hashlib.sha256(np.array(plain(t), "<u4").tobytes()).hexdigest() for i, t in enumerate(texts)}


# --- phrases -------------------------------------------------------------------------------------------------------


def plain_phrases(given, least, top):
    found, total = defaultdict(Counter), Counter()
    for lang, text in given:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m, i in itertools.product(range(1, 6), range(len(words))):
                if i + m <= len(words):
                    found[lang][tuple(words[i : i + m])] += 1
    out = set()
    for lang, f in found.items():
        kept = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        dropped = {q[i:j] for q, a in kept.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q) and f[q[i:j]] == a}
        ranked = []
        for p, a in kept.items():
            if p not in dropped:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out


@pytest.mark.parametrize(("least", "top", "first"), [(5, 40, 3), (5, 2000, 1 << 15), (20, 15, 1), (3, 300, 60)])
def test_phrases_match_plain_counts(spark, monkeypatch, least, top, first):
    monkeypatch.setattr(phrases, "KEYS", 64)  # several passes
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    given = [(r["lang"], r["text"]) for r in docs.collect()]
    got = [tuple(r) for r in phrases.mine(docs, least=least, top=top, first_words=first).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_phrases(given, least, top)


def test_phrases_of_odd_rows(spark):
    loop = "Tick TOCK \t tick tock, tick tock"
    rows = [(None, loop)] * 6 + [("und", "tick tock")] * 3 + [("xx", None), ("xx", ""), ("xx", " \t\n.,"), ("ß", "É é a b É é\x1cc " * 9), ("ß", "a.b a;b a:b\ra b a\x0bb")] + [("long", "u v " * 40_000), ("long", "w")]
    rows += [("tie", " ".join(f"p{i} q{i} . " for i in range(9)))] * 4
    frame = spark.createDataFrame([(lang, t, 1, "x") for lang, t in rows], "lang string, text string, n int, word string")
    for first, top in ((1, 4), (2, 100), (1 << 15, 4)):
        got = {tuple(r) for r in phrases.mine(frame, least=3, top=top, first_words=first).collect()}
        assert got == plain_phrases(rows, 3, top)
    assert phrases.mine(frame.limit(0)).count() == 0
    assert phrases.mine(frame, least=1 << 40).count() == 0


def test_blocks_of_phrases_are_read_one_by_one(spark, monkeypatch):
    """However many blocks a task's files hold, one is in memory at a time; counts of stretches add up."""
    arrays = phrases._arrays

    def watched(batches):
        for b in batches:
            assert b.num_rows == 1, "blocks travel together"
            yield from arrays([b])

    monkeypatch.setattr(phrases, "_arrays", watched)
    rows = [(lang, f"u v w x {lang} u v. w x y {i % 3} u v") for i in range(12) for lang in ("de", "en", "fr", "it")]
    frame = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    assert {tuple(r) for r in phrases.mine(frame, least=3, top=50).collect()} == plain_phrases(rows, 3, 50)
    batch = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    assert [spark.conf.get(key) for key in batch] == ["10000", "4096"]


def test_long_texts_are_dealt_to_blocks_at_breaks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 1000)
    text = "ab cd ef, " * 1_300_000
    blocks = phrases._blocks(spark.createDataFrame([("x", text)], "lang string, text string"))
    sizes = [r["n"] for r in blocks.selectExpr("size(filter(codes, c -> c > 0)) AS n").collect()]
    assert len(sizes) > 2 and sum(sizes) == 3_900_000 and all(n % 3 == 0 for n in sizes)


def test_stretches_count_each_place_once():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 5, 4000).astype(np.int32)
    known = [{"code": c, "id": 10 + c, "f": c} for c in range(1, 5)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["x"]), pa.array([codes], pa.list_(pa.int32())), pa.array([known], pa.list_(pa.struct([("code", pa.int32()), ("id", pa.int64()), ("f", pa.int64())])))], ["lang", "codes", "known"]
    )
    before, phrases.AT_ONCE = phrases.AT_ONCE, 700
    try:
        parts = list(phrases._arrays([batch]))
    finally:
        phrases.AT_ONCE = before
    ids = np.where(codes > 0, codes + 10, 0)
    assert len(parts) == 6 and np.concatenate([ids_[first:end] for _, ids_, _, first, end in parts]).tolist() == ids.tolist()
    for k, (_, ids_, often, first, end) in enumerate(parts):
        assert ids_.tolist() == ids[max(0, 700 * k - 1) : 700 * (k + 1) + phrases.LONGEST].tolist() and often.tolist() == np.maximum(ids_ - 10, 0).tolist()


def test_words_are_not_cut_where_texts_are_read_in_parts():
    text = b" ".join(b"%d" % i for i in range(5000))
    for size in (1, 7, 100, 1 << 22):
        assert b" ".join(phrases._parts(text, size)).split() == text.split()
