"""The operators on texts against plain versions of their contracts."""

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import chain

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framewright.llm import bpe, langid, notices, packing, simhash, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, _text string, score double"
PASSAGE = "the quiet river carried seven lanterns past the old mill while nobody in the village was awake to see them"
ODD = ["", None, " ", "\n\n", "7 8 9", " wide space　　x", "tabs\t\there \r\n  twice", "naïve ÉCOLE straße İstanbul ǅ", "<|endoftext|> and <|startoftext|>x", "日本語のテキスト 中文", "👩‍👩‍👧 emoji ́́", "don't we'll I'M x's", "\x00nul\x1f\x85 ", "a" * 3000, "ab" * 700 + " end", "...!!!??? 12345678901234 3.14"]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "clash", 1.0) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [r for r in rows if r[1] is None or len(r[1]) < 20_000][:120]
    base = max((r[1] or "" for r in rows), key=len)
    new = [(1000 + k, t, None) for k, t in enumerate(ODD)]
    new += [(2000, f"one {PASSAGE} two", "en"), (2001, f"{PASSAGE}", "en"), (2002, f"x{PASSAGE} y {PASSAGE[:60]}", "en"), (2003, base, "en"), (2003, base, "en"), (2004, base + " more", "en"), (2005, "é" * 40, None), (2006, "x" + "é" * 40, None), (None, PASSAGE, None), (2007, "ab" * 80, None), (2008, "b" + "ab" * 60, None)]
    return rows + new


@pytest.fixture(scope="module")
def docs(spark, sample):
    return table(spark, sample).repartition(5).persist()


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


def test_repeats_against_all_windows(docs, sample):
    got = by_id(suffixes.remove_repeats(docs))
    first = {}
    order = lambda i: (1 << 63) - 1 if i is None else i
    for i, t, _ in sample:
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            w = raw[k : k + 50]
            first[w] = min(first.get(w, 1 << 64), order(i))
    assert sum(map(len, got.values())) == len(sample)
    for i, t, _ in sample:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < order(i):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        r = next(r for r in got[i] if r["n_bytes"] == len(raw))
        assert (r["n_removed"], r["n_spans"]) == (sum(gone), len(re.findall(b"\1+", bytes(gone)))), i
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert r["kept_text"] == kept.decode("utf-8", "ignore")


def test_small_strips_find_the_same(docs, sample, monkeypatch):
    want = sorted(map(tuple, suffixes.remove_repeats(docs).drop("kept_text").collect()), key=repr)
    monkeypatch.setattr(suffixes, "_STRIP", 100)
    assert sorted(map(tuple, suffixes.remove_repeats(docs).drop("kept_text").collect()), key=repr) == want


def test_suffix_order_survives_colliding_hashes(monkeypatch):
    import numpy as np

    data = np.frombuffer(b"banana bandana ananas banana", np.uint8)
    start = np.arange(len(data))
    limit, group = len(data) - start, np.zeros(len(data), np.int64)
    want = sorted(start, key=lambda s: data[s:].tobytes())
    assert suffixes.suffix_order(data, start, limit, group)[0].tolist() == want
    monkeypatch.setattr(suffixes, "_TABLE", np.zeros(256, np.uint64))  # every prefix hash is equal
    order, common = suffixes.suffix_order(data, start, limit, group)
    assert order.tolist() == want and common[1] == 1


def _fingerprint(text):
    words = [w for w in re.split(rb"[ \t-\r]+", (text or "").encode().lower()) if w]
    runs = [words[k : k + 3] for k in range(len(words) - 2)] if len(words) >= 3 else [words] * bool(words)
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_simhash_against_all_pairs(docs, sample):
    got = by_id(simhash.simhash_components(docs))
    ids, prints = [s[0] for s in sample], [_fingerprint(s[1]) for s in sample]
    parent = list(range(len(ids)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, i in enumerate(ids):
        least[root(k)] += [i] if i is not None else []
    for k, i in enumerate(ids):
        assert {(r["fingerprint"], r["component_id"]) for r in got[i]} >= {(f"{prints[k]:016x}", min(least[root(k)], default=None))}
    assert sum(map(len, got.values())) == len(ids)


def test_links_connect_what_brute_force_connects(spark):
    """Chains and dense clusters of fingerprints, beyond the size that is compared in full."""
    core = 0x0123456789ABCDEF
    prints = {core ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)} | {(k * 0x9E3779B97F4A7C15) & (2**64 - 1) for k in range(300)}
    chain = 0xF0F0F0F0F0F0F0F0
    for k in range(0, 60, 3):
        chain ^= 7 << k
        prints.add(chain)
    signed = [p - 2**64 if p >> 63 else p for p in sorted(prints)]
    links = simhash.near_links(spark.createDataFrame([(s,) for s in signed], "_fp long")).collect()
    assert all(((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 3 for r in links)

    def components(pairs):
        parent = {s: s for s in signed}

        def root(k):
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for u, v in pairs:
            parent[root(u)] = root(v)
        out = defaultdict(set)
        for s in signed:
            out[root(s)].add(s)
        return {frozenset(x) for x in out.values()}

    brute = [(a, b) for k, a in enumerate(signed) for b in signed[:k] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    assert components([(r.u, r.v) for r in links]) == components(brute)


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 5, 8])
def test_large_groups_link_what_the_chains_pass(distance, monkeypatch):
    """A key that many fingerprints share: components by the longer chains equal those of all pairs that pass."""
    key = np.uint64(0xABCDE)
    spread = np.arange(600, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    low = np.uint64((1 << simhash.WIDTH * simhash.equal_segments(distance)) - 1)
    near = [spread[k % 300] ^ np.uint64(1 << (20 + k * 7 % 44)) ^ np.uint64(1 << (20 + k * 11 % 44)) for k in range(500)]
    ring = np.unique(np.r_[spread[:300], np.array(near, np.uint64)] & ~low | key & low)
    assert len(ring) > simhash._SMALL or distance < 2  # at 0 and 1 the key leaves room for few
    compared, passes = [], simhash.chain_passes
    monkeypatch.setattr(simhash, "chain_passes", lambda a, b, d: (compared.append(len(a)), passes(a, b, d))[1])
    links = [(a, b) for u, v in simhash._links_by_longer_chains(ring, distance) for a, b in zip(u.tolist(), v.tolist())]
    u, v = np.triu_indices(len(ring), 1)
    ok = passes(ring[u], ring[v], distance) & (np.bitwise_count(ring[u] ^ ring[v]) <= distance)

    def components(pairs):
        parent = list(range(len(ring)))

        def root(k):
            while parent[k] != k:
                k = parent[k]
            return k

        for a, b in pairs:
            parent[root(a)] = root(b)
        return [root(k) == root(j) for k in range(len(ring)) for j in range(k)]

    assert set(links) | {(b, a) for a, b in links} <= {p for a, b in zip(u[ok].tolist(), v[ok].tolist()) for p in ((a, b), (b, a))}
    assert components(links) == components(zip(u[ok].tolist(), v[ok].tolist()))
    if distance in (2, 3):
        assert links and sum(compared) < len(u) / 4


def test_base_phrases_against_a_word_scan(docs, sample, spark):
    more = [(3000, "All rights reserved; all RIGHTS reserved. cc-by CC BY", None), (3001, "allrights reserved accby", None), (3002, "Licensed undr the Apache Licence, version 2", None), (3003, "license license gnu genral public license", None), (3004, "cc by cc by", None)]
    got = by_id(notices.scan_notices(docs.unionByName(table(spark, more))))
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for i, t, _ in [*sample, *more]:
        words = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for phrase, label in notices.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        want = (len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert want in [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got[i]], i
        assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in got[i])
    assert "apache" in got[3002][0]["labels"] and got[3002][0]["spans"][0]["edits"] == 2
    assert "gpl-like" in got[3003][0]["labels"]


def test_a_false_seed_does_not_hide_a_notice():
    """A seed of the first part inside a notice whose first part is damaged."""
    search = notices.NoticeSearch((("abcd efgh ijkl", "x"),), 2)
    assert search.find("abxd efgh ijkl abcd")[0][2] == 1
    assert search.find("zz abcd abxd efgh ijkl")[0][2] == 1


def _edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_found_notices_against_edit_distances():
    """Lines of damaged notices, characters added in front included, against distances at all runs of words."""
    notice, state = "mozilla public license", 7
    search = notices.NoticeSearch(((notice, "x"),), 2)
    assert search.find("emgzilla public license") == {0: (0, 23, 2)}
    hits = 0
    for _ in range(4000):
        line = notice
        for _ in range(state // 65536 % 4):
            state = (state * 1103515245 + 12345) % 2**31
            at, what = state // 64 % (len(line) + 1), state // 8192 % 3
            at = at % 3 if state // 131072 % 3 == 0 else at
            line = line[:at] + "mzx e"[state // 1024 % 5] * (what != 0) + line[at + (what != 1) :]
        state = (state * 1103515245 + 12345) % 2**31
        line = " ".join((("ab " if state // 4096 % 2 else "") + line + (" mozilla" if state // 512 % 3 == 0 else "")).split())
        cuts = [0, *(k + 1 for k, c in enumerate(line) if c == " "), len(line) + 1]
        runs = [line[a : b - 1] for a in cuts for b in cuts if a < b]
        least = min((_edit_distance(r, notice) for r in runs if abs(len(r) - len(notice)) <= 2), default=9)
        found = search.find(line)
        assert (found[0][2] if found else 9) == (least if least <= 2 else 9), line
        hits += bool(found)
    assert 1000 < hits < 4000


def test_every_place_of_a_notice_has_a_span(spark):
    apache, mit = notices.NOTICES[0][0], notices.NOTICES[1][0]
    wrong = apache.replace("under", "undr")
    rows = [(1, f"{apache} x {wrong} y {apache} {mit} z {apache}", None), (2, f"x {apache} " * 50, None), (3, apache.replace("e", "é", 2), None), (4, apache.replace("e", "é", 3), None), (5, "é è " + apache.replace("a", "а", 2), None)]
    got = by_id(notices.scan_notices(table(spark, rows)))
    spans = lambda i: [(s["label"], s["first"], s["last"], s["edits"]) for s in got[i][0]["spans"]]
    assert spans(1) == [("apache", 0, 4, 0), ("apache", 6, 10, 1), ("apache", 12, 16, 0), ("apache", 25, 29, 0), ("mit", 17, 23, 0)]
    assert spans(2) == [("apache", 1 + 6 * k, 5 + 6 * k, 0) for k in range(50)]
    assert spans(3) == [("apache", 0, 4, 2)] and not spans(4) and got[4][0]["labels"] == ""
    assert spans(5) == [("apache", 2, 6, 2)] and got[5][0]["score"] == 1 - 2 / len(apache)


def test_encoding_equals_the_library(docs, sample):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation(), library.no_padding()
    got = by_id(bpe.encode_decode(docs, path))
    for i, t, _ in sample:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert want in [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got[i]], t


def test_long_words_stream(spark):
    t = bpe.transducer(public_tokenizers.path("word_bpe_49k.json"))
    for word in ("a" * 5000, "haha" * 900, "antidisestablishmentarianism" * 60, "qxzj" * 1000):
        assert list(t.word_ids(word)) == t.library.encode(word, add_special_tokens=False).ids


def _spelled(t, word):
    return word.encode().decode("latin-1").translate(t.table)


def test_ordinary_words_are_emitted_before_they_end():
    """The transducer does the work on words of any length, with a small buffer."""
    t = bpe.transducer(public_tokenizers.path("word_bpe_49k.json"))
    words = ["photosynthesizing", "wohnungseigentum", "unglaublichkeiten", "straßenbahnhaltestelle", "incomprehensibility", "desafortunadamente"]
    early = 0
    for word in words:
        read = 0

        def symbols(word=word):
            nonlocal read
            for c in _spelled(t, word):
                read += 1
                yield c

        found = []
        for token in t.word_ids(symbols()):
            early += read < len(_spelled(t, word))
            found.append(token)
        assert found == t.library.encode(word, add_special_tokens=False).ids
    assert early >= len(words) // 2


def test_words_in_use_are_not_encoded_again(monkeypatch):
    """A full table drops what was not used lately; words of every text stay, and the ids are the library's."""
    monkeypatch.setattr(bpe, "_REMEMBERED", 80)
    t, asked = bpe.Transducer(public_tokenizers.path("word_bpe_49k.json")), []
    chunk = t._chunk
    monkeypatch.setattr(t, "_chunk", lambda c: asked.append(c) or chunk(c))
    for k in range(60):
        text = " ".join(f"common straße {chr(97 + k % 26)}{'qxzj'[k % 4] * (k % 12 + 1)}{chr(97 + i)}word incomprehensibilities" for i in range(5))
        assert t.encode(text) == t.library.encode(text, add_special_tokens=False).ids
    assert asked.count("common") == asked.count("straße") == 1 and len(asked) > 150
    for table in (t.known, t.looks, t.ends):
        assert len(table.young) <= table.half and len(table.older) <= table.half


def test_words_as_text_and_as_symbols_give_the_same_ids():
    t = bpe.transducer(public_tokenizers.path("word_bpe_49k.json"))
    for word in ("a", "incomprehensibility", "straße", "thtionblendednahaverkeit", "ab" * 349, "ab" * 350, "ab" * 351, "\u4e2d", "one\u4e2dtwo", "wohnungs\u4e2d"):
        assert list(t.word_ids(word)) == list(t.word_ids(iter(word)))


def test_emitted_tokens_hold_for_every_continuation():
    t = bpe.transducer(public_tokenizers.path("word_bpe_49k.json"))
    state, checked = 7, 0
    for _ in range(1500):
        letters = []
        for _ in range(22):
            state = state * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
            letters.append("aabcdeehilnnorsstttuy"[(state >> 33) % 21])
        word = "".join(letters)
        stable = t._stable([t.vocab[c] for c in word[:12]], word[:12])
        checked += len(stable)
        for end in range(13, 23):
            assert t.library.encode(word[:end], add_special_tokens=False).ids[: len(stable)] == stable
    assert checked > 500


@pytest.mark.parametrize("stretch", [1, 9, 200])
def test_stretches_of_a_text_give_its_ids(monkeypatch, stretch):
    monkeypatch.setattr(bpe, "_STRETCH", stretch)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        t = bpe.transducer(public_tokenizers.path(name))
        for text in ("", " ", "a b", "one  two\n three <|endoftext|> fo\u0301 \u0301x  ", "it's 'll 12 34 --- ... \u4e2d\u6587 \U0001f469\u200d\U0001f467 end " * 9):
            ids = t.library.encode(text, add_special_tokens=False).ids
            assert list(chain.from_iterable(t.stream(text))) == ids
            assert "".join(t.decode(t.stream(text))) == "".join(t.decode([ids]))
            if name.startswith("word"):
                assert "".join(t.decode(t.stream(text))) == t.library.decode(ids, skip_special_tokens=False)


def test_packing_holds_every_id_once(docs, sample):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, group_size=64).collect()
    want = defaultdict(int)
    for i, t, _ in sample:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 1024):
            raw = b"".join(x.to_bytes(4, "little") for x in ids[at : at + 1024])
            want[i, at, len(raw) // 4, zlib.crc32(raw), len(ids)] += 1
    found = defaultdict(int)
    for r in rows:
        found[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
    assert found == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        end = 0
        for at, n in sorted(held):
            assert at == end
            end += n
        assert end <= 1024
    total = sum(r["length"] for r in rows)
    assert total / (1024 * len(sequences)) > 0.8


def test_first_fit_decreasing_against_a_plain_loop():
    import numpy as np

    sizes = np.array([1 + (k * 7919 + k * k) % 1024 for k in range(1500)])
    bins, offsets = packing.first_fit_decreasing(sizes, 1024)
    held: list[int] = []
    for item in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        where = next((b for b, used in enumerate(held) if used + sizes[item] <= 1024), len(held))
        held += [0] * (where == len(held))
        assert (bins[item], offsets[item]) == (where, held[where])
        held[where] += int(sizes[item])


def test_stretches_are_remembered_up_to_a_bound(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(packing, "_REMEMBERED", 5)
    tokenizer = packing.StretchTokenizer(path)
    texts = [t or "" for t in ODD] + ["one two three\nfour five six seven\n", "one\ttwo", "seven eight one", "soft\u00adhyphen zero\u200bwidth"]
    for _ in range(2):
        want = [b"".join(i.to_bytes(4, "little") for i in tokenizer.library.encode(t, add_special_tokens=False).ids) for t in texts]
        assert tokenizer.encode(texts) == want and len(tokenizer.known) <= 5


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    languages, model = langid.train_languages(docs.where(~langid.held_out()))
    rows = langid.predict_languages(docs.where(langid.held_out()), languages, model, keep=["lang"]).where("lang IS NOT NULL").collect()
    good = sum(r["lang"] == r["lang_pred"] for r in rows)
    assert good / len(rows) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_mixed_text_names_its_languages(spark):
    train = table(spark, [(1, "the cat and the dog were there with this thing " * 20, "en"), (2, "le chat et la souris sont dans une maison avec les autres " * 20, "fr"), (3, "nothing", None)])
    languages, model = langid.train_languages(train)
    mixed = table(spark, [(4, "the dog and the cat were there le chat et les autres souris sont dans une maison la", None), *[(10 + k, t, None) for k, t in enumerate(ODD)], (None, "the cat", None)])
    got = by_id(langid.predict_languages(mixed, languages, model))
    assert sorted(got[4][0]["languages"]) == ["en", "fr"] and abs(sum(got[4][0]["proportions"]) - 1) < 1e-3
    for k, t in enumerate(ODD):
        assert (got[10 + k][0]["lang_pred"] == "und") == (not any(map(str.isalpha, t or ""))), t
    nothing = langid.train_languages(train.where("false"))
    assert {r["lang_pred"] for r in langid.predict_languages(mixed, *nothing).collect()} == {"und"}


def test_mixture_of_all_languages_is_named_whole(spark):
    parts = {"en": "the cat and the dog were there with this thing ", "fr": "le chat et la souris sont dans une maison avec les autres ", "de": "der hund und die katze waren nicht mehr zwischen den tischen ", "es": "el gato y los perros estaban muy lejos cuando llegaba señor "}
    parts["fi"] = "kissa ja koira olivat siellä yhdessä tämän talon kanssa "
    train = table(spark, [(k, t * 20, name) for k, (name, t) in enumerate(parts.items())])
    languages, model = langid.train_languages(train)
    mixed = table(spark, [(10 + n, " ".join(t * 10 for t in list(parts.values())[:n]), None) for n in range(1, 6)])
    for i, rows in by_id(langid.predict_languages(mixed, languages, model)).items():
        n = i - 10
        assert sorted(rows[0]["languages"]) == sorted(list(parts)[:n]), n
        assert abs(rows[0]["score"] - max(rows[0]["proportions"])) < 1e-9 and abs(rows[0]["score"] - 1 / n) < 0.1


def test_empty_tables(docs):
    none = docs.where("false")
    path = public_tokenizers.path("byte_bpe_50k.json")
    languages, model = langid.train_languages(docs)
    for df in (suffixes.remove_repeats(none), simhash.simhash_components(none), simhash.keep_first_of_each(none), notices.scan_notices(none), packing.pack_documents(none, path), bpe.encode_decode(none, public_tokenizers.path("word_bpe_49k.json")), langid.predict_languages(none, languages, model)):
        assert df.count() == 0


def test_one_of_each_group_stays(docs, sample):
    kept = [r["doc_id"] for r in simhash.keep_first_of_each(docs).select("doc_id").collect()]
    components = {r["component_id"] for r in simhash.simhash_components(docs).collect()}
    assert set(kept) == components and docs.count() == len(sample)
    assert docs.where(F.col("doc_id") == 2003).count() == 2
