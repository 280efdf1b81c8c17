"""BPE against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from semaspark.llm import bpe, queries
from semaspark.llm.bpe import ByteBpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return ByteBpe(PATH), Tokenizer.from_file(PATH)


def test_random_texts_match_the_library(both):
    mine, theirs = both
    rng = random.Random(7)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "a", "é", "'s", "'ll", "<|endoftext|>", "9", "½", "_", "!", "日本", "the", " ing", "\r\n", "́", "🙂", "don't", "x1", "　"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    ids = mine.encode(texts)
    want = [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in ids] == want
    assert [mine.decode(x) for x in ids] == [theirs.decode(w, skip_special_tokens=False) for w in want]


def test_long_words_and_empty_texts(both):
    mine, theirs = both
    texts = ["a" * 5000, "ab" * 3000, "the" * 1000, "", None]
    want = [e.ids for e in theirs.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in mine.encode(texts)] == want


def test_decoding_bytes_that_are_no_text(both):
    mine, theirs = both
    for ids in ([0xE2], [447, 13], [187, 188, 220]):
        assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_operator_keeps_columns_and_handles_nulls(spark):
    df = spark.createDataFrame([(1, "the end", "x"), (2, None, "y"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, ids string")
    out = {(r.doc_id, tuple(r.ids), r.decoded) for r in bpe.round_trip(df, PATH).collect()}
    assert out == {(1, (1169, 886), "the end"), (2, (), ""), (3, (), "")}
    once = bpe.encode(df, PATH, keep=["doc_id"])
    assert sorted((r.doc_id, r.decoded) for r in bpe.decode(once, PATH, keep=["doc_id"]).collect()) == [(1, "the end"), (2, ""), (2, ""), (3, "")]
    assert bpe.round_trip(df.limit(0), PATH).count() == 0


def test_query_matches_the_library_on_all_documents(spark, sf, both):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op2_bpe_round_trip(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in docs:
        ids = both[1].encode(d.text or "", add_special_tokens=False).ids
        assert got[d.doc_id] == (len(ids), sha(",".join(map(str, ids))), sha(both[1].decode(ids, skip_special_tokens=False)))
    assert len(got) == len(docs)
