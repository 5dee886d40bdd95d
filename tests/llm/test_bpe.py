"""BPE against the tokenizer itself."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from plain import TEXTS, sha

from shelfmark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    signs = " \n\t'stmdrevl\xa0\x85\x1c²¼µªa.é漢🙂"
    return [*TEXTS, *("".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(200)), "a<|endoftext|><|endoftext|> b"]


@pytest.mark.parametrize("frequent", [bpe.FREQUENT, 50, 0])
def test_digests(spark, texts, monkeypatch, frequent):
    monkeypatch.setattr(bpe.encode_blocks, "__defaults__", (frequent,))
    monkeypatch.setattr(bpe, "SAMPLE", 50)
    monkeypatch.setattr(bpe, "BLOCK", 2000)
    monkeypatch.setattr(bpe, "PER_BUCKET", 30)
    tokenizer = bpe.load(PATH)
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    want = [
        (k, len(i), sha(",".join(map(str, i))), sha(tokenizer.decode(i, skip_special_tokens=False))) for k, i in enumerate(ids)
    ]
    rows = [(k, t, 1, 2) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid int, codes int").repartition(4)
    assert sorted(tuple(r) for r in bpe.digests(docs, PATH).collect()) == want


def test_ids_and_texts(spark, docs):
    tokenizer = bpe.load(PATH)
    encoded = bpe.encode(docs, PATH)
    assert encoded.count() == docs.count()
    by_id = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    for r in bpe.decode(encoded, PATH).collect():
        if r.doc_id is not None:
            assert r.ids == tokenizer.encode(by_id[r.doc_id], add_special_tokens=False).ids
            assert r.decoded == by_id[r.doc_id]
    broken = spark.createDataFrame([([0, 187, 50256],), (None,), ([],)], "ids array<int>")
    got = [r.decoded for r in bpe.decode(broken, PATH).collect()]
    assert got == [tokenizer.decode([0, 187, 50256], skip_special_tokens=False), None, ""]


def test_packing():
    words = ["", "a\x00b", "é\n", "漢"]
    assert bpe.unpack_words(*bpe.pack_words([w.encode() for w in words])).to_pylist() == words
    numbers = [0, 1, 255, 256, 70_000, 2**31 - 1]
    assert bpe.unpack(bpe.pack(bpe.np.array(numbers))).tolist() == numbers


def test_nothing(no_docs):
    assert bpe.digests(no_docs, PATH).count() == 0
