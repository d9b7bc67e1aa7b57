"""The operators on pages, vectors and conversations against plain versions."""

import gzip
import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from framewright.llm import chat, topk, tree, warc


def test_archive_round_trip(spark, tmp_path):
    long, other = "<p>" + "é" * 60 + "</p>", "<b>" + "z" * 200 + "</b>"
    rows = [(3, "http://a/1", long, "x"), (1, "http://b\r\nX: y", long, "x"), (2, None, long, "x"), (7, "u", "short", "x"), (8, "u", "short", "x"), (9, "u", None, "x"), (10, "u", "", "x"), (None, "u", long, "x"), (11, "u", other, "x"), (11, "u", other, "x"), (5, "u", "y" * 300_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    warc.write_archive(pages, str(tmp_path / "a"))
    got = warc.read_archive(spark, str(tmp_path / "a"))
    found = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect())
    want = []
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        owner = min(j for j, _, h, _ in rows if j is not None and (h or "") == (html or ""))
        again = len(raw) >= 100 and i != owner
        want.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", owner if again else None))
    assert found == sorted(want, key=str)
    for r in got.collect():
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and b"\r\nX: y" not in head
        assert int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0]) == len(block) - 4
        assert r["record_type"] == "revisit" or block[:-4].endswith(bytes(r["payload"]))
    members = warc.gzip_members(got).collect()
    assert sorted(gzip.decompress(bytes(m["member"])) for m in members) == sorted(bytes(r["record"]) for r in got.collect())
    stored = spark.read.parquet(str(tmp_path / "a" / "payloads"))
    assert stored.count() == len({h or "" for _, _, h, _ in rows})


def test_a_payload_of_many_pages_is_read_by_several_keys(spark, tmp_path):
    rows = [(i, f"u{i}", "x" * 150 if i % 3 else f"own {i}") for i in range(120)] + [(500, "u", "two" * 50), (501, "u", "two" * 50)]
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a"))
    heads = spark.read.parquet(str(tmp_path / "a" / "headers")).groupBy("digest", "copy").count().collect()
    copies = defaultdict(dict)
    for r in heads:
        copies[r["digest"]][r["copy"]] = r["count"]
    hot = copies[hashlib.sha256(b"x" * 150).hexdigest()]
    assert len(hot) > 8 and max(hot.values()) < 25
    assert set(copies[hashlib.sha256(b"two" * 50).hexdigest()]) <= {0, 1}
    got = warc.read_archive(spark, str(tmp_path / "a")).collect()
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in got) == sorted((i, h) for i, _, h in rows)


def test_empty_archive(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.read_archive(spark, str(tmp_path / "a")).count() == 0


def _vectors(n=700, width=12):
    m = np.sin(np.arange(n * width) * 12.9898).reshape(n, width) * (1 + np.cos(np.arange(n))[:, None])
    rows = [(int(i), [float(x) for x in v], "c") for i, v in enumerate(m)]
    rows[5:9] = [(i, rows[4][1], "c") for i in range(5, 9)]  # ties
    rows += [(800, None, "c"), (801, [1.0, None] + [0.0] * 10, "c"), (802, [math.nan] + [1.0] * 11, "c"), (803, [math.inf] + [1.0] * 11, "c"), (804, [0.0] * 12, "c"), (None, [9.0] * 12, "c"), (100, rows[100][1], "c"), (805, [3e7] * 12, "c"), (900, [-3e7] * 12, "c")]
    return rows


SCHEMA = "vec_id long, embedding array<double>, _v string"


def _usable(rows, zero):
    return {i: v for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))}


@pytest.mark.parametrize("lists", [1, 2, 5])
def test_top_k_against_all_scores(spark, lists):
    rows = _vectors()
    df = spark.createDataFrame(rows, SCHEMA)
    got = defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 100 = 0"), lists=lists, query_block=3, vector_block=90).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in _usable(rows, True).items()}
    asked = [i for i in whole if i % 100 == 0]
    assert set(got) == set(asked)
    for q in asked:
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:10]
        if q != 900:  # beyond the exact range of doubles
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_entries_of_a_list_are_those_that_reach_the_share():
    q, c = (np.floor(np.sin(np.arange(n * 6) * s).reshape(n, 6) * 1024) for n, s in ((40, 7.77), (900, 3.33)))
    c *= np.geomspace(1, 0.01, 900)[:, None]
    c = np.floor(c)
    share = np.partition(q @ c.T, -20, axis=1)[:, -20] / 2
    share[3], share[7] = -np.inf, -5.0
    length = np.linalg.norm(c, axis=1)
    order = np.argsort(-length, kind="stable")
    for some in (slice(8, 40), slice(0, 40)):
        row, col = np.nonzero(q[some] @ c.T >= share[some, None])
        assert set(topk.collected(q[some], c, share[some], length, order)) == set(row * len(c) + col)


def test_a_list_is_read_only_as_far_as_it_can_reach():
    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                read.append(len(key))
            return super().__getitem__(key)

    read, q = [], np.array([[3.0, 4.0]])
    c = np.array([[k, 0.0] for k in range(1, 101)])
    length = np.linalg.norm(c, axis=1)
    found = topk.collected(q, c.view(Counted), np.array([290.0]), length, np.argsort(-length))
    assert sorted(found.tolist()) == [96, 97, 98, 99] and read == [43]


def test_small_strips_give_the_same_scores(spark, monkeypatch):
    df = spark.createDataFrame(_vectors(450)[:450], SCHEMA)
    asked = df.where("vec_id % 50 = 0")
    whole, strips_of_two = (sorted(tuple(r) for r in topk.top_k(df, asked, vector_block=n).collect()) for n in (8192, 1 << 20))
    assert len(whole) == 90 and strips_of_two == whole
    monkeypatch.setattr(topk, "_STRIP", 9)
    q, c = np.arange(12.0).reshape(3, 4), np.arange(20.0).reshape(5, 4)
    row, col = np.divmod(np.arange(15), 5)
    assert (topk.completed(q, c, row, col) == (q @ c.T).ravel()).all()


def test_repeated_rows_count_each_and_scores_are_exact_beyond_doubles(spark):
    big = [(i, [1e6 + i % 7, 1e6 / (1 + i % 5), -1e6 + 0.001 * i, 3.0], "c") for i in range(210)]
    rows = big + [r for r in big if r[0] % 37 == 18 or r[0] == 100] + [(55, [2e6, 1.0, 0.0, 0.0], "c")] * 13 + [(400, None, "c"), (None, [9e6] * 4, "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if i is not None and v]
    want = []
    for query in (0, 100, 200):
        scores = [(-sum(a * b for a, b in zip(v, w)), i) for q, v in whole if q == query for i, w in whole if i != query]
        want += [(query, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:10])]
    assert any(float(a[3]) != a[3] or a[3] > 2**53 for a in want) and len({a[2] for a in want if a[0] == 0}) < 10
    for blocks in ({}, {"query_block": 2, "vector_block": 20}):
        got = topk.top_k(df, df.where("vec_id % 100 = 0"), repeats=True, **blocks)
        assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)


def test_few_candidates_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], "c"), (100, [-1.0, 2.0], "c"), (7, [-5.0, 0.0], "c")], SCHEMA)
    rows = sorted(tuple(r) for r in topk.top_k(few, few.where("vec_id % 100 = 0")).collect())
    assert [(r[0], r[1], r[2]) for r in rows] == [(0, 1, 100), (0, 2, 7), (100, 1, 7), (100, 2, 0)]
    assert tree.nearest(few, few).count() == 6
    assert topk.top_k(few.where("false"), few.where("false")).count() == 0
    assert tree.nearest(few.where("false"), few.where("false")).count() == 0


def test_tree_recall_and_scores(spark):
    rows = _vectors(3000)
    df = spark.createDataFrame(rows, SCHEMA)
    got = defaultdict(list)
    for r in tree.nearest(df, df.where("vec_id % 20 = 0"), leaf_rows=40, branches=6, chunk_rows=64, part_rows=50).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    usable = _usable(rows, False)
    ids, m = np.array(list(usable)), np.array(list(usable.values()))
    hit = 0
    for q in (i for i in usable if i % 20 == 0):
        score = m @ np.array(usable[q])
        score[ids == q] = -np.inf
        true = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        found = sorted(got[q])
        assert [k for k, _, _ in found] == list(range(1, 21)) and len({i for _, i, _ in found}) == 20
        assert all(np.isclose(s, np.dot(usable[i], usable[q])) for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hit += len(true & {i for _, i, _ in found})
    assert hit / (20 * len(got)) > 0.9


def test_a_query_never_gets_too_few(spark):
    """One visit would do for the trials' recall, but small leaves hold fewer than k rows."""
    rows = _vectors(400)
    df = spark.createDataFrame(rows, SCHEMA)
    counts = tree.nearest(df, df.where("vec_id % 20 = 0"), recall=0.01, leaf_rows=5, branches=8).groupBy("query_id").count().collect()
    assert {r["count"] for r in counts} == {20}


def test_chats_round_trip(spark):
    said = ["hi", "</s>[INST] ok [/INST]", None, "", "[\\INST] <\\\\s>", "<<SYS>>x<</SYS>>\n[ROLE]", "é👩‍👧"]
    rows = [(c, k, ("system", "user", "assistant", "user", "assistant", "tool[/ROLE]", None)[k % 7], said[(c + k) % 7], "x") for c in range(7) for k in range(9)]
    rows += [(1, 3, "user", "twice", "x"), (1, 3, "user", "twice", "x"), (None, 0, "user", "n", "x"), (50, None, "user", "q", "x"), (50, 1, "assistant", "a", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position string")
    segments = chat.format_chats(turns)
    got = {r["conv_id"]: r for r in chat.read_chats(segments).collect()}
    talks = defaultdict(list)
    for c, k, who, text, _ in rows:
        talks[c].append((-1 if k is None else k, who or "", text or ""))
    for c, talk in talks.items():
        talk.sort()
        whole = "".join(f"{who}\n{text}\n" for _, who, text in talk)
        loss = "".join(text for _, who, text in talk if who == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(talk), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[50]["in_order"] and not got[0]["in_order"]
    inner = segments.where("position % 3 = 1").collect()
    assert not any(control in r["text"] for r in inner for control in chat.INSTRUCTION.controls)
    assert chat.read_chats(chat.format_chats(turns.where("false"))).count() == 0


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_chats_are_read_by_their_marks(size):
    """Where the formatted string is cut tells the reader nothing."""
    t = chat.INSTRUCTION
    turns = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]"), ("tool[/ROLE]", " [/TURN"), ("", ""), ("user", "<"), ("assistant", "<\\s></s>\\"), ("system", "[INST] <")]
    string, flags = "", []
    for who, said in turns:
        marks = t.marks(who)
        for text, loss in ((marks.before, False), (t.escaped(said), marks.loss), (marks.after, False)):
            string += text
            flags += [loss] * len(text)
    reader = chat._Reader(t)
    at = 0
    while at < len(string):
        end = at + 1
        while end < len(string) and end - at < size and flags[end] == flags[at]:
            end += 1
        reader.feed(string[at:end], flags[at])
        at = end
    whole, loss = "".join(f"{w}\n{s}\n" for w, s in turns), "".join(s for w, s in turns if w == "assistant")
    want = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(string), False)
    assert reader.close() == want


@pytest.mark.parametrize("string", ["hello", "[INST] no end", "[INST] a [/INST]<s", "[ROLE]x"])
def test_a_string_that_is_no_conversation_is_refused(string):
    with pytest.raises(ValueError):
        reader = chat._Reader(chat.INSTRUCTION)
        reader.feed(string, False)
        reader.close()


def test_marks_that_could_be_misread_are_refused():
    other, turns = chat.INSTRUCTION.other, chat.INSTRUCTION.turns
    for marks in (chat.Marks("<u>", "end"), chat.Marks("<u>", "<e><"), chat.Marks("[ROLE]", "<e>")):
        with pytest.raises(ValueError):
            chat.Template(roles={"user": marks}, other=other, turns=turns, controls=("<u>", "<e>", *chat.INSTRUCTION.controls))


def test_a_long_conversation_is_read_turn_by_turn(spark):
    turns = spark.range(30_000).selectExpr("1 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat('<s>', int(id % 5)) AS text")
    row = chat.read_chats(chat.format_chats(turns)).first()
    loss = "".join("<s>" * (i % 5) for i in range(1, 30_000, 2))
    assert (row["n_turns"], row["loss_chars"], row["in_order"]) == (30_000, len(loss), True)
    assert row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("held_rows", [1, 50, 1 << 20])
def test_best_of_a_task(held_rows):
    """Ties, ids given twice and every size of the buffer against sorting all pairs."""
    n = np.arange(900)
    query, vec, score = n * 7 % 13, n * 31 % 37, (n * 17 % 11).astype(float)
    cut = [slice(i, i + 60) for i in range(0, 900, 60)] + [slice(0, 0)]
    batches = [tree.pa.RecordBatch.from_pydict(tree._scored(query[c], vec[c], score[c])) for c in cut]
    best = defaultdict(dict)
    for q, v, s in zip(query.tolist(), vec.tolist(), score.tolist()):
        best[q][v] = max(s, best[q].get(v, -math.inf))
    want = {q: sorted(found.items(), key=lambda vs: (-vs[1], vs[0]))[:5] for q, found in best.items()}
    left = list(tree.best_of_task(batches, 5, held_rows))
    sent = [tuple(r.values()) for b in left for r in b.to_pylist()]
    again = list(tree.best_of_task(left, 5))[0].to_pylist()
    assert len(sent) <= 900 and (held_rows < 900 or len(sent) == 5 * len(want))
    for q in want:
        assert [(r["vec_id"], r["score"]) for r in again if r["query_id"] == q] == want[q]
    assert list(tree.best_of_task([], 5)) == []
    assert [b.num_rows for b in tree.best_of_task([batches[-1]], 5)] == [0]
