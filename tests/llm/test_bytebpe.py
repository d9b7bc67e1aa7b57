"""Byte-level encoding against the library, and its two tiers by themselves."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from framewright.llm import bytebpe

PATH = P.path("byte_bpe_50k.tiktoken")
ODD = ["", None, " ", "\n\n  \n ", "we're 'RE I'll 'l x　  ", "日本語 中文 👩‍👩‍👧", "<|endoftext|>\x00\x1f\x85", "'r" * 9, "a" * 3000, "ab" * 3000, "zqxj" * 900, "...!!! 12345678901234", "é" * 500]
SCHEMA = "doc_id long, text string, _text string, n_tokens string"


@pytest.fixture(scope="module")
def tokenizer():
    return bytebpe.tokenizer(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library(tokenizer):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokenizer.ranks, special_tokens={})


def test_documents_against_the_library(spark, library):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10_000 + k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (10_003, ODD[3]), (20_000, " ".join(f"word{k}zq" for k in range(300_000)))]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(4)
    got = bytebpe.encode_decode(docs, PATH, P.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for i, text in rows:
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    kept = bytebpe.encode_decode(docs.where("doc_id = 10004"), PATH, P.PATTERN, ids=True).first()
    assert kept["ids"] == library.encode_ordinary(ODD[4])
    assert bytebpe.encode_decode(docs.where("false"), PATH, P.PATTERN).count() == 0


def test_stretches_do_not_change_ids(tokenizer, library, monkeypatch):
    text = " ".join(t or "" for t in ODD) + "  it's  \n they've 'd   end   "
    for size in (1, 5, 40, 333):
        monkeypatch.setattr(bytebpe, "_STRETCH", size)
        assert tokenizer.encode(text).tolist() == library.encode_ordinary(text)


def test_perfect_hash_is_minimal_and_misses_nothing(tokenizer):
    numbers = tokenizer.index.number
    assert sorted(numbers.tolist()) == list(range(len(tokenizer.ranks)))
    for token, rank in list(tokenizer.ranks.items())[::97]:
        data = np.frombuffer(token, np.uint8)
        assert tokenizer.whole(data, np.array([0]), np.array([len(data)])).tolist() == [rank]
    foreign = b"qzxwvj"
    assert foreign not in tokenizer.ranks
    assert tokenizer.whole(np.frombuffer(foreign, np.uint8), np.array([0]), np.array([6])).tolist() == [-1]


def test_equal_hashes_do_not_pass_for_a_token(tokenizer, monkeypatch):
    """Every span lands on the same key; only the bytes tell."""
    word = b"the"
    key = tokenizer.hashes.of(np.frombuffer(word, np.uint8), np.array([0]), np.array([3]))
    monkeypatch.setattr(tokenizer.hashes, "of", lambda data, start, end: np.repeat(key, len(end)))
    data = np.frombuffer(b"thethattho", np.uint8)
    got = tokenizer.whole(data, np.array([0, 3, 7]), np.array([3, 7, 10]))
    assert got.tolist() == [tokenizer.ranks[word], -1, -1]


def test_words_of_the_vocabulary_do_not_reach_the_heap(tokenizer, library, monkeypatch):
    def none(self, word):
        raise AssertionError(word)

    monkeypatch.setattr(bytebpe.Merges, "__missing__", none)
    text = "the whole of this line is in the vocabulary"
    assert tokenizer.encode(text).tolist() == library.encode_ordinary(text)
    with pytest.raises(AssertionError):
        bytebpe.ByteTokenizer(PATH, P.PATTERN).encode("qzxwvj")


def test_heap_joins_the_leftmost_of_equal_pairs(tokenizer, library):
    merges = bytebpe.Merges(tokenizer.ranks)
    for word in (b"aaaaaaa", b"ababab", b"\xff\xfe\xff", b"xzqxzqxzq", b"mississippi" * 20):
        assert merges[word] == library._encode_single_piece(word)
