"""Near duplicates of the pipeline against exact similarities of all pairs."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from framewright.llm import near

class Draw:
    """A small generator of numbers, the same in every run."""

    def __init__(self, seed):
        self.state = seed

    def below(self, n):
        self.state = (self.state * 6364136223846793005 + 1442695040888963407) % 2**64
        return (self.state >> 33) % n

    def some(self, n, count):
        return sorted(range(n), key=lambda _: self.below(1 << 30))[:count]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _similarity(a, b):
    a, b = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def _kept(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], COLUMNS).repartition(3)
    return {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}


def _components(n, linked):
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(k) for k in range(n)]


def test_near_copies_against_all_pairs(spark):
    rng, texts = Draw(3), {}
    for group in range(60):
        base = [f"w{rng.below(5000)}" for _ in range((40, 150, 400)[rng.below(3)])]
        for _ in range(4):
            words = list(base)
            for at in rng.some(len(words), rng.below(1 + max(1, len(words) // 40))):
                words[at] = f"x{rng.below(10**6)}"
            texts[rng.below(10**9)] = " ".join(words)
    ids = sorted(texts)
    share = {(a, b): _similarity(texts[ids[a]], texts[ids[b]]) for a in range(len(ids)) for b in range(a)}
    assert sum(0.8 <= s <= 0.95 for s in share.values()) > 60 and sum(0.5 < s < 0.8 for s in share.values()) > 30
    root = _components(len(ids), lambda a, b: share[a, b] >= 0.8)
    assert _kept(spark, texts) == {ids[k] for k in root}


def test_links_and_blocks_connect_what_brute_force_connects(spark):
    rng = Draw(4)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(60):
        words = list(base)
        for at in rng.some(120, 1 + rng.below(2)):
            words[at] = f"x{rng.below(10**6)}"
        texts.append(" ".join(words))
    sets = [near.shingle_set(t, 5) for t in texts]
    want = _components(60, lambda a, b: _similarity(texts[a], texts[b]) >= 0.8)
    u, v = near.links_among(np.arange(60), np.concatenate(sets), np.array(list(map(len, sets))), 0.8)
    links = set(zip(u.tolist(), v.tolist()))
    assert _components(60, lambda a, b: (a, b) in links or (b, a) in links) == want and 1 < len(set(want)) < 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["_id"]: r["_least"] for r in near.near_copies(docs, block=1000).collect()}
    assert [got[k] for k in range(60)] == want


def test_a_frequent_line_does_not_make_copies(spark):
    """Long texts of which a repeated line is 30 % agree in their SimHash bits, not in their shingles."""
    rng = Draw(5)
    line = "please read the terms of use before you copy this page "
    texts = {k: " ".join(line + " ".join(f"w{rng.below(10**6)}" for _ in range(26)) for _ in range(270)) for k in range(4)}
    assert _kept(spark, texts) == set(texts)


def test_texts_of_equal_short_hashes_stay(spark, monkeypatch):
    """Three numbers for all texts at first: only the digests tell them apart."""
    short = near._number
    monkeypatch.setattr(near, "_number", lambda digest, attempt: F.pmod(short(digest, attempt), F.lit(3)) if attempt < 2 else short(digest, attempt))
    texts = {k: f"text {k} has words of its own {k * k} and no others {k + 7}" for k in range(20)}
    texts |= {100 + k: texts[k] for k in range(5)} | {200: None, 201: "", 202: ""}
    assert _kept(spark, texts) == {*range(20), 200, 201}


def test_texts_longer_than_a_stretch():
    words = [f"w{k}" for k in range(300_000)]
    whole = near.shingle_set(" ".join(words), 5)
    assert len(whole) == 299_996 and len(np.intersect1d(whole, near.shingle_set(" ".join(words[131_000:131_200]), 5))) == 196


def test_odd_rows(spark):
    rows = [(5, None), (4, None), (None, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (3, "other words with this id"), (7, ""), (8, " "), (None, "alone here")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], COLUMNS)
    got = corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(4, None), (3, "a b c d e f g"), (3, "a b c d e f g"), (3, "other words with this id"), (7, ""), (8, " "), (None, "alone here")]))
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), "").count() == 0


def test_fingerprints_bring_candidates_that_no_band_has(spark):
    """Texts of one phrase said often and some words of their own: equal SimHash bits, and 0.4 of the shingles shared."""
    rng, texts = Draw(6), {}
    for group in range(12):
        phrase = " ".join(f"p{rng.below(10**6)}" for _ in range(21))
        for k in range(2):
            texts[2 * group + k] = " ".join([phrase] * 200 + [f"w{rng.below(10**6)}" for _ in range(13)])
    assert all(0.3 < _similarity(texts[2 * k], texts[2 * k + 1]) < 0.5 for k in range(12))
    keys = near.band_keys([texts[k] for k in range(24)], 5)
    assert sum(not np.intersect1d(keys[2 * k], keys[2 * k + 1]).size for k in range(12)) > 6
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["_id"]: r["_least"] for r in near.near_copies(docs, least=0.3).collect()}
    assert got == {k: k - k % 2 for k in range(24)}


def test_fingerprint_pairs_connect_equal_and_near_ones(spark):
    fp = [(1, 0b1), (2, 0b1), (3, 0b1111), (4, 0b1111111), (5, -1), (6, -1), (7, 1 << 40)]
    got = {tuple(r) for r in near.fingerprint_pairs(spark.createDataFrame(fp, "_node long, _fp long"), 3).collect()}
    assert {(1, 2), (5, 6), (1, 3), (3, 4), (1, 7)} <= got and all((a < 5 or a == 7) == (b < 5 or b == 7) for a, b in got)
