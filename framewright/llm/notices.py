"""License notices, found word for word and with a few wrong characters.

A text is lower-cased (A-Z only) and read as words joined by single spaces.
Base phrases count where their words stand in a row. Longer notices may have
up to ``edits`` wrong, missing or added characters: such a notice is split
into ``edits + 1`` parts, of which one must be intact (the pigeonhole
principle). One automaton finds all intact parts in a pass; around each, the
regex library's bounded-error matching verifies the notice and gives its span
and errors. Every place of a notice has its span; of spans of one notice that
overlap, the one with the fewest errors stays.

Nulls and texts without words have zero counts, null positions, no labels and
score 0. Rows are independent: no shuffle. A whole text is read, and its
memory is a few times its size.
"""

from __future__ import annotations

from bisect import bisect
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from framewright.llm.blobs import pieces

#: fixed values: phrase and label
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: notice and label of those that may hold errors
NOTICES = (
    ("licensed under the apache license", "apache"),
    ("permission is hereby granted free of charge", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license", "mpl"),
    ("gnu general public license", "gpl-like"),
    ("creative commons attribution", "cc-like"),
    ("all rights reserved", "reserved-like"),
    ("provided as is without warranty of any kind", "as-is"),
    ("this work is in the public domain", "public-domain"),
)
EDITS = 2
_APART = bytes(32 if b < 48 or 57 < b < 97 or 122 < b < 128 else b for b in range(256))
_APART = bytes(_APART[b + 32] if 65 <= b <= 90 else _APART[b] for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_APART).split()


def split_evenly(notice: str, parts: int) -> list[tuple[int, str]]:
    cuts = [len(notice) * k // parts for k in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class NoticeSearch:
    def __init__(self, notices, edits: int):
        self.notices, self.edits = notices, edits
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (notice, _) in enumerate(notices):
            for at, part in split_evenly(notice, edits + 1):
                seeds.setdefault(part, []).append((k, at))
        self.seeds = ahocorasick.Automaton()
        for part, places in seeds.items():
            self.seeds.add_word(part, (len(part), places))
        if seeds:
            self.seeds.make_automaton()
        # whole words only, so that a notice does not match inside a longer one
        self.patterns = [regex.compile(rf"(?be)(?<![^ ])(?:{regex.escape(n)}){{e<={edits}}}(?![^ ])") for n, _ in notices]

    def find_all(self, line: str) -> dict[int, list[tuple[int, int, int]]]:
        """For each notice found: start, end and errors of its spans in order; of those that overlap, the ones with the fewest errors."""
        found: dict[int, set[tuple[int, int, int]]] = {}
        if not len(self.seeds):
            return {}
        tried: dict[int, set[int]] = {}
        intact: dict[int, int] = {}  # where the last span without errors ends
        for last, (size, places) in self.seeds.iter(line):
            for k, at in places:
                notice, first = self.notices[k][0], last - size + 1
                if first < intact.get(k, 0):
                    continue
                done = tried.setdefault(k, set())
                # the notice begins at a word's start, as many places off as there may be edits before the seed
                for start in range(max(0, first - at - self.edits), first - at + self.edits + 1):
                    if start in done or (start and line[start - 1] != " "):
                        continue
                    done.add(start)
                    m = self.patterns[k].match(line, start, min(len(line), start + len(notice) + self.edits + 1))
                    if m:
                        found.setdefault(k, set()).add((m.start(), m.end(), sum(m.fuzzy_counts)))
                        if not sum(m.fuzzy_counts):
                            intact[k] = max(intact.get(k, 0), m.end())
        return {k: apart(spans) for k, spans in found.items()}

    def find(self, line: str) -> dict[int, tuple[int, int, int]]:
        """For each notice found: start, end and errors of its best span, the first of equal ones."""
        return {k: min(spans, key=lambda s: s[2]) for k, spans in self.find_all(line).items()}


def apart(spans) -> list[tuple[int, int, int]]:
    """Spans that do not overlap, in order: each in turn by errors, then by place, if it is clear of those before."""
    out: list[tuple[int, int, int]] = []
    for span in sorted(spans, key=lambda s: (s[2], s)):
        k = bisect(out, span)
        if (not k or out[k - 1][1] <= span[0]) and (k == len(out) or span[1] <= out[k][0]):
            out.insert(k, span)
    return out


@lru_cache(maxsize=4)
def _search(notices, edits: int) -> NoticeSearch:
    return NoticeSearch(notices, edits)


def places_of(line: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase's words stand; ``line`` has a space around every word."""
    wanted, out, at, word, counted = b" " + phrase + b" ", [], line.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        word += line.count(b" ", counted, at)
        counted = at
        out.append(word)
        at = line.find(wanted, at + 1)
    return out


def scan_notices(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base=BASE, notices=NOTICES, edits: int = EDITS
) -> DataFrame:
    """One row a document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``score`` is 1 with a base phrase, else the best share of a notice's
    characters that needed no edit. ``spans`` gives label, first and last word
    and edits of every place of every notice, with or without errors.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int64())])
    types = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))]

    def one(value):
        words = words_of(value)
        line = b" " + b" ".join(words) + b" "
        found = {label: at for phrase, label in base if (at := places_of(line, phrase.encode()))}
        labels, score, spans = set(found), 1.0 if found else 0.0, []
        read = line.decode("utf-8", "surrogatepass").strip(" ")  # an edit is a character, not a byte
        for k, at in _search(notices, edits).find_all(read).items():
            notice, label = notices[k]
            labels.add(label)
            word, counted = 0, 0
            for start, end, errors in at:
                score = max(score, 1 - errors / len(notice))
                first = word + read.count(" ", counted, start)
                word, counted = first + read.count(" ", start, end), end
                spans.append({"label": label, "first": first, "last": word, "edits": errors})
        places = [p for at in found.values() for p in at]
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found)), ",".join(sorted(labels)), score, spans

    def run(batches):
        for batch in pieces(batches, "_text", 4 << 20):
            rows = list(zip(*map(one, batch.column(0).to_pylist()))) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(list(r), t) for r, (_, t) in zip(rows, types)]], names=["_id", *[n for n, _ in types]])

    schema = f"_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,edits:long>>"
    done = docs.select(F.col(text).alias("_text"), F.col(doc_id).alias("_id")).mapInArrow(run, schema)
    return done.withColumnRenamed("_id", doc_id)
