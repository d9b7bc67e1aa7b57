"""Importance resampling against a plain version, and the selection against sorting."""

import hashlib
import math
import re
import zlib

import pytest

from framewright.llm import resampling

SCHEMA = "doc_id long, text string, score string, n_words int, a long, _id long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, 3) for r in rows], SCHEMA)


def _features(text, hi):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[k : k + n]) for n in range(1, hi + 1) for k in range(len(words) - n + 1)]


def _brute(docs, target, hi, n, least, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % n
    s, t = [0] * n, [0] * n
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f in _features(text, hi)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + n) / ((a + 1) * (sum(t) + n)))) for a, b in zip(s, t)]
    out = []
    for i, text in docs:
        n_words, found = _features(text, hi)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n_words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = rank
    return [tuple(r[:5]) for r in out]


def _docs():
    words = "the River quay lantern 7 naïve été old mill and of walked northern ships winter".split()
    docs = [(k, " ".join(words[(k * j * j + j) % len(words)] for j in range(5 + k % 60)) + ("! " if k % 3 else "")) for k in range(150)]
    long = ("all the ships of the old mill " * 60_000, "quay, " * 5)
    return docs + [(200, None), (201, ""), (202, "..."), (None, long[1] * 5), (203, long[0]), (204, docs[40][1]), (40, docs[40][1]), (40, docs[40][1]), (-5, docs[41][1])]


@pytest.mark.parametrize("hi, n, percent, chunk", [(1, 10_000, 10, 1 << 20), (3, 97, 33, 9), (2, 5, 100, 1)])
def test_draw_against_a_plain_version(spark, hi, n, percent, chunk):
    target = ["northern lantern quay", None, "", "The old river, naïve winter ships"]
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.draw_documents(table(spark, _docs()).repartition(6), texts, sizes=(1, hi), n_buckets=n, percent=percent, chunk=chunk)
    want = _brute(_docs(), target, hi, n, 20, percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_cutoff_is_the_key_at_its_place(spark):
    rows = [(k * 37 % 11, k * 53 % 7, k) for k in range(400)]
    keys = spark.createDataFrame(rows, "a long, b long, c long").repartition(7).persist()
    for place in (1, 2, 57, 200, 399, 400):
        assert resampling.cutoff_key(keys, place, chunk=16) == sorted(rows)[place - 1]
    with pytest.raises(ValueError):
        resampling.cutoff_key(keys, 401)


def test_a_pivot_discards_a_quarter():
    """Whatever the chunks hold, a quarter of the keys lies on each side of the pivot."""
    for skew in (1, 2, 5):
        chunks = [[(k**skew % 1009, c, k) for k in range(1, 3 + 11 * c)] for c in range(9)]
        medians = [(len(c), sorted(c)[(len(c) - 1) // 2]) for c in chunks]
        pivot, whole = resampling.weighted_median(medians), sum(chunks, [])
        assert min(sum(k <= pivot for k in whole), sum(k >= pivot for k in whole)) * 4 >= len(whole)


def test_stretches_do_not_change_features(monkeypatch):
    text = "one two  three four five six seven eight nine ten " * 3
    whole = [b for _, f in resampling.feature_buckets(text, 1, 3, resampling.Buckets(1 << 30)) for b in f.tolist()]
    monkeypatch.setattr(resampling, "_STRETCH", 6)
    parts = [b for _, f in resampling.feature_buckets(text, 1, 3, resampling.Buckets(1 << 30)) for b in f.tolist()]
    assert sorted(parts) == sorted(whole) and len(whole) == 30 + 29 + 28


def test_nothing_to_draw(spark):
    texts = spark.createDataFrame([("x",)], "text string")
    assert resampling.draw_documents(table(spark, _docs()).where("false"), texts).count() == 0
    few = resampling.draw_documents(table(spark, [(1, "too short"), (2, None)]), texts.where("false")).collect()
    assert [(r["doc_id"], r["n_features"], r["rank"]) for r in sorted(few)] == [(1, 2, None), (2, 0, None)]
