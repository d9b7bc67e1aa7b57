"""The prefix trie and the list ranking against plain versions."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

from framewright.llm import listrank, trie

SCHEMA = "conv_id long, turn long, role string, text string, g long, part string, depth long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash", 9) for r in rows], SCHEMA)


def _brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        seq = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append((c, d == len(seq)))
    out = set()
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = lambda x: [y for y in members if len(y) == len(x) + 1 and y[: len(x)] == x]
        ends = ",".join(str(c) for c in sorted(c for c, end in convs if end))
        saved = sum((len(members[x]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", x[-1][1])) for x in below if x)
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        out.add((min(c for c, _ in convs), len(node), parent, len(convs), len(kids(node)), sum(not kids(x) for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _rows():
    said = ["hello there", "a  b\tc", "", None, "naïve ünï", "x" * 50_000, "same"]
    rows = []
    for c in range(130):
        for t in range(1 + (c * 7) % 6):
            rows.append((c * 3 if c % 5 else c, t, ("user", "assistant")[t % 2], said[(c // 9 + t * (c % 4)) % 7]))
    rows += [(40, t % 5 or None, None, f"turn {t % 9}") for t in range(400)]  # a long conversation with ties, repeats and null turns
    rows += [(500 + k, 0, "user", "hello there") for k in range(60)]  # copies
    rows += [(7, None, "user", "null turn"), (None, 1, "user", "no conversation"), (901, None, None, None), (2**62, 3, "a", "b")]
    return rows


def _names(df):
    return df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def test_trie_against_all_prefixes(spark):
    rows = _rows()
    turns = table(spark, rows).repartition(5)
    got = trie.prefix_trie(turns, block=16, limit=8).collect()
    found = [tuple(r)[:8] for r in got]
    assert len(found) == len(set(found)) and set(found) == _brute(rows)
    by_name = {(r["conv_id"], r["depth"]): r for r in got}
    assert sorted([r["enter"] for r in got] + [r["exit"] for r in got]) == list(range(2 * len(got)))
    for r in got:
        up = by_name.get((r["parent_conv_id"], r["depth"] - 1))
        assert up is None or up["enter"] < r["enter"] < r["exit"] < up["exit"]


def test_a_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(trie, "_RUN", 7)
    monkeypatch.setattr(trie, "_SHARE", 0.3)  # most keys take the plain join
    rows = _rows()
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        placed = trie._placed_turns(table(spark, rows), "conv_id", "turn", "role", "text")
        assert sorted(r["nth"] for r in placed.where("conv = 40").collect()) == list(range(1, 1 + sum(r[0] == 40 for r in rows)))
        assert {tuple(r) for r in _names(trie.prefix_trie(table(spark, rows))).collect()} == _brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_no_conversations(spark):
    assert trie.prefix_trie(table(spark, [(1, 1, "a", "b")]).where("false")).count() == 0
    assert trie.prefix_trie(table(spark, [(None, 1, "a", "b")])).count() == 0


def test_list_sums_of_a_scattered_list(spark):
    n = 3000
    order = sorted(range(n), key=lambda k: zlib.crc32(str(k).encode()))  # no locality at all
    following = {a: b for a, b in zip(order, order[1:])}
    weight = lambda k: k * k % 11
    rows = [(k, following.get(k), weight(k), 1) for k in range(n)]
    stored = spark.createDataFrame(rows, "id long, next long, w long, place long")
    got = {r["id"]: (r["w"], r["place"]) for r in listrank.list_sums(stored, ["w", "place"], block=64, limit=100).collect()}
    sums = 0
    for place, k in enumerate(order):
        assert got[k] == (sums, place)
        sums += weight(k)


def test_chains_in_a_block():
    ids, following = np.array([5, 9, 2, 7]), np.array([9, 40, 7, -1])
    head, before, last = listrank.chains_of(ids, following, np.array([[1], [2], [3], [4]]))
    assert head.tolist() == [5, 5, 2, 2] and before[:, 0].tolist() == [0, 1, 0, 3] and last.tolist() == [1, -1, 3, -1]
