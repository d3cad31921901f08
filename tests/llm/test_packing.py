import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inciflow.llm import packing
from inciflow.llm.queries import vocabulary
from tests.conftest import SF
from tests.llm.fixtures import NASTY, nasty


@pytest.fixture(scope="module")
def encoder():
    return packing.WordEncoder(vocabulary())


def whole(encoder, text):
    return encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_give_the_ids_of_whole_texts(encoder, spark):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += [t or "" for _, t in NASTY]
    texts += ["It's  WE'LL don't", "a<|endoftext|>b c", "é ́x ÉtÉ İI", "1 22\t3.5%", " x y z", "\x1c \x85 a\x1fb", "中文 \U0001f600", "ΣΣ Σ"]
    for t in texts:
        assert encoder.ids(t.encode()).tolist() == whole(encoder, t)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_words_give_the_ids_of_any_text(encoder, text):
    assert encoder.ids(text.encode()).tolist() == whole(encoder, text)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_level_is_the_one_with_the_least_sum_of_squares(sizes):
    packer = packing.SumOfSquares(16)
    for n, s in enumerate(sizes):
        if s == 16:
            continue
        levels = [h for h in range(0, 17 - s) if h == 0 or packer.count[h]]

        def cost(h, s=s):
            after = packer.count.copy()
            after[h] -= h > 0
            after[h + s] += 1
            return int((after[1:16] ** 2).sum())

        assert cost(packer.level(s)) == min(map(cost, levels))
        packer.put(n, 0, np.zeros(s, dtype="<u4"))


def check(rows, texts, encoder, size):
    """Every id lies in one piece, sequences are gapless, full or a power of two."""
    docs = defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
    for doc_id, text in texts.items():
        ids = np.array([*whole(encoder, text or ""), 2], dtype="<u4")
        at = 0
        for r in sorted(docs[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size and at & (at - 1) == 0


def test_all_ids_in_gapless_sequences(encoder, spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    check(packing.pack(docs, vocabulary()).collect(), texts, encoder, 4096)


def test_odd_rows(encoder, spark):
    docs = nasty(spark)
    rows = packing.pack(docs, vocabulary(), 64).collect()
    total = sum(len(whole(encoder, t or "")) + 1 for _, t in NASTY)
    assert sum(r["length"] for r in rows) == total
    assert packing.pack(docs.limit(0), vocabulary()).count() == 0
