"""Ids word by word against the tokenizer's own, and what a Python worker keeps of them."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from paperlane.llm import queries
from paperlane.llm._ids import LONGEST, Encoder

ODD = [" "] * 8 + list("abtheXYZ019.,!'\"$*-_()\n\t\r\0\x1c\x85  éß×÷ªº²¼ŝɏɐ́中文…“😀﻿") + ["'s", "'t", " the", "<|endoftext|>", "  ", "...", "\n\n"]


@pytest.fixture
def code():
    return Encoder(queries.tokenizer())


def whole(code, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in code.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_any_text_has_the_ids_of_the_whole(code):
    r = random.Random(5)
    for single in (False, True) * 20:
        texts = ["".join(r.choice(ODD) for _ in range(r.choice([0, 1, 2, 5, 30, 200]))) for _ in range(40)]
        if single:
            texts = [" ".join(w for w in t.replace("\0", "").replace("<|endoftext|>", "").split(" ") if w) for t in texts]
        assert code.encode(texts) == whole(code, texts)
        ids, bounds = code.encode_flat(pa.array(["x", *texts]).slice(1))
        assert [ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds, bounds[1:])] == whole(code, texts)
    assert code.encode([]) == [] and code.encode([""]) == [b""]


def test_long_words_are_not_kept(code):
    texts = [f"a {'x' * 5000}{i} {'yz' * 4000}{i} b" for i in range(20)]
    assert code.encode(texts) == whole(code, texts)
    assert max(map(len, code.known)) <= LONGEST


def test_a_word_is_encoded_once_whatever_its_punctuation(code):
    asked, fresh = [], code._fresh
    code._fresh = lambda texts: asked.extend(texts) or fresh(texts)
    texts = [f"so qzzxv{m} end" for m in ("", ".", ",", "!", "...", ").", "'")]
    assert code.encode(texts) == whole(code, texts)
    assert sum("qzzxv" in t for t in asked) == 1 and sum(t.count("qzzxv") for t in asked) == 1


def test_every_stage_of_the_pipeline_takes_small_batches(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []

    def stage(session, docs, folder):
        seen.append(int(session.conf.get(key)))
        return docs.limit(5)

    before = spark.conf.get(key)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, stage) for name, _ in corpus_pipeline.STAGES])
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == 5
    assert len(seen) == 5 and max(seen) <= 2000
    assert spark.conf.get(key) == before
