"""Byte-pair encoding as a streaming transducer, and its inverse.

A merge list has a sufficient lookahead: however a word goes on, the tokens of
what was read so far stay as they are, except those that end within the last
``lookahead`` symbols. Merges run in the order of rank. The first place where
two continuations differ can only move left when a rule of a higher rank than
the one before joins the token left of it; that rule's right half must begin
with the left half of the rule before. The lookahead is the greatest sum of
left halves along such a chain, found by one pass over the rules in rank order.

That bound holds in every context; most need a few symbols. While the left side
of a place is merged by itself, its last token passes through a short list of
tokens, each there until a merge of a known rank. A rule can join the place only
if its left half is in that list, its rank comes before that merge, and its right
half can be what follows: it begins with the symbols that were read, or they
with it. If no rule is left, the tokens before the place are stable.

So a word of any length is encoded with a bounded buffer: every few symbols,
merge, emit what is stable, go on; the general bound is for the places that the
context leaves open. Every word takes this way; those that fit into the buffer
are remembered in a bounded table, as are the looks at what is stable and the ends
of words, which many words share. A text is encoded in stretches cut at single
spaces, and each one's ids go to the digest and the decoder and are dropped. The
decoder turns ids into bytes and feeds them to an incremental UTF-8 machine,
which holds back the bytes of an unfinished character.

Nulls and empty texts give no ids. Rows are independent: no shuffle.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice, repeat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from framewright.llm.blobs import pieces

_REMEMBERED = 600_000
_NO_RULE = 1 << 60
#: symbols read between two looks at what is stable
_STEP = 8
#: characters in a stretch of a text; it ends before the next single space
_STRETCH = 1 << 16
#: longest buffer whose look or end is remembered
_SHARED = 4 * _STEP
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: characters for which Python's own splitting and lower case agree with the tokenizer file's rules
_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-ɏ]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte value."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def sufficient_lookahead(rules: list[tuple[str, str]], length) -> int:
    """Symbols that must follow a token before it is stable, for rules in rank order."""
    made: dict[str, list[tuple[str, str]]] = {}
    reach: dict[str, int] = {}  # by left half: the longest chain that ends in a rule with it
    most = 0
    for left, right in rules:
        spine, waiting = set(), [right]
        while waiting:
            token = waiting.pop()
            if token not in spine:
                spine.add(token)
                waiting.extend(rule[0] for rule in made.get(token, ()))
        here = length(left) + max((reach.get(t, 0) for t in spine), default=0)
        reach[left] = max(reach.get(left, 0), here)
        made.setdefault(left + right, []).append((left, right))
        most = max(most, here)
    return most


class _Recent:
    """What was last computed by key, at most ``size`` of it: a key that is used again outlives those that are not."""

    def __init__(self, size: int):
        self.half, self.young, self.older = size // 2, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.older.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.half:
            self.older, self.young = self.young, {}
        self.young[key] = value


class Transducer:
    """The merge list of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        rules = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): k for k, (a, b) in enumerate(rules)}
        self.product = [self.vocab[a + b] for a, b in rules]
        self.length = lambda t: len(t.removesuffix(self.suffix)) if self.suffix else len(t)
        self.lookahead = sufficient_lookahead(rules, self.length)
        self.window = self.lookahead + max(map(self.length, self.vocab)) + 1
        self.symbols = {v: self.length(t) for t, v in self.vocab.items()}
        # by left half and first symbol of the right half: its spelling, whether it ends a word, and the rank
        self.followers: dict[tuple[int, str], list[tuple[str, bool, int]]] = {}
        for k, (a, b) in enumerate(rules):
            plain = b.removesuffix(self.suffix) if self.suffix else b
            self.followers.setdefault((self.vocab[a], plain[0]), []).append((plain, plain != b, k))
        self.alphabet = byte_alphabet()
        self.table = {b: c for b, c in enumerate(self.alphabet)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        split = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        # words of white-space-free text are found by the file's own pattern
        self.pattern = regex.compile(split[0]["pattern"]["Regex"]) if split and split[0]["invert"] and split[0]["behavior"] == "Removed" else None
        self.lower = '"Lowercase"' in json.dumps(spec["normalizer"])
        surfaces = {v: t for t, v in [*self.vocab.items(), *self.special.items()]}
        self.joined_by_space = spec["decoder"] is None
        value = {c: b for b, c in enumerate(self.alphabet)}
        special_ids = set(self.special.values())
        whole = lambda i, t: t.encode() if self.joined_by_space or i in special_ids else bytes(value[c] for c in t)
        self.bytes_of = [whole(i, surfaces[i]) if i in surfaces else b"" for i in range(max(surfaces) + 1)]
        self.decimal = [str(i).encode() for i in range(len(self.bytes_of))]
        self.known = _Recent(_REMEMBERED)
        self.looks, self.ends = _Recent(_REMEMBERED // 4), _Recent(_REMEMBERED // 4)
        self.foreign = re.compile(f"[^{re.escape(''.join(t for t in self.vocab if len(t) == 1))}]")

    def merged(self, ids: list[int], spine: list[tuple[int, int]] | None = None) -> list[int]:
        """The merge list applied in place: always the lowest rank, the leftmost of equal ones.

        ``spine`` receives the tokens that were last in turn, each with the highest
        rank that was applied while it was there; the one that stays has no bound.
        """
        get, product = self.rank.get, self.product
        ranks = list(map(get, zip(ids, ids[1:]), repeat(_NO_RULE)))
        tail, highest = ids[-1] if ids else None, -1
        while ranks:
            best = min(ranks)
            if best == _NO_RULE:
                break
            at = ranks.index(best)
            if best > highest:
                highest = best
            new = ids[at] = product[best]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get((ids[at - 1], new), _NO_RULE)
            if at < len(ranks):
                ranks[at] = get((new, ids[at + 1]), _NO_RULE)
            elif spine is not None:
                spine.append((tail, highest))
                tail, highest = new, -1
        if spine is not None and ids:
            spine.append((tail, _NO_RULE))
        return ids

    def _closed(self, left: list[int], tokens: list[int], follows: str) -> bool:
        """Whether nothing that begins with ``follows`` can change the tokens of the symbols ``left``."""
        spine: list[tuple[int, int]] = []
        if self.merged(list(left), spine) != tokens:
            return False
        for token, until in spine:
            for plain, ends, rank in self.followers.get((token, follows[0]), ()):
                if rank < until and (follows.startswith(plain) and not (ends and len(plain) < len(follows)) or plain.startswith(follows)):
                    return False
        return True

    def _stable(self, buffer: list[int], follows: str) -> list[int]:
        """The tokens at the buffer's start that no continuation changes; ``follows`` spells the buffer and what was read after it."""
        out, tokens, used, first = [], self.merged(list(buffer)), 0, 0
        place = 0
        for k, token in enumerate(tokens):
            place += self.symbols[token]
            if place >= len(follows):
                break
            if self._closed(buffer[used:place], tokens[first : k + 1], follows[place:]):
                out.extend(tokens[first : k + 1])
                used, first = place, k + 1
        if not out and len(buffer) >= self.window:
            for token in tokens:
                if used + self.symbols[token] > len(buffer) - self.lookahead:
                    break
                used += self.symbols[token]
                out.append(token)
        return out

    def word_ids(self, symbols: Iterable[str]) -> Iterator[int]:
        """Tokens of one word, each as soon as it is seen to be stable. The buffer never passes ``window`` symbols."""
        # an ordinary word is read from where it lies; the last symbol is held back: only the end of the word tells whether it takes the suffix
        ordinary = isinstance(symbols, str) and len(symbols) < self.window
        rest, spelled, due = iter(symbols), "", _STEP
        if ordinary and not self.foreign.search(symbols):
            rest, spelled = iter(()), symbols
        while True:
            while len(spelled) <= due and (read := "".join(islice(rest, due + 1 - len(spelled)))):
                spelled += read
                spelled = self.foreign.sub("", spelled[:-1]) + spelled[-1]
            if len(spelled) <= due:
                break
            stable, used = self._look(spelled[:due])
            yield from stable
            spelled = spelled[used:]
            due = min(due - used + _STEP, max(self.window, due - used + 1))
        if spelled:
            yield from self._end(spelled)

    def _look(self, spelled: str) -> tuple[tuple[int, ...], int]:
        """The stable tokens at the start of the symbols, and how many symbols they take."""
        found = self.looks.get(spelled)
        if found is None:
            stable = self._stable([self.vocab[s] for s in spelled], spelled)
            found = tuple(stable), sum(map(self.symbols.__getitem__, stable))
            if len(spelled) <= _SHARED:
                self.looks.put(spelled, found)
        return found

    def _end(self, spelled: str) -> tuple[int, ...]:
        """The tokens of a word's last symbols."""
        found = self.ends.get(spelled)
        if found is None:
            ids, end = [self.vocab[s] for s in spelled[:-1]], spelled[-1] + self.suffix
            found = tuple(self.merged(ids + [self.vocab[end]] if end in self.vocab else ids))
            if len(spelled) <= _SHARED:
                self.ends.put(spelled, found)
        return found

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a stretch without white space, in normal form; a word in it may be known by itself."""
        known, ids = self.known, []
        words = self.pattern.findall(chunk)
        for word in words:
            found = known.get(word)
            if found is None:
                # a printable ASCII character stands for its own byte
                spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.table)
                found = tuple(self.word_ids(spelled))
                if len(spelled) < self.window:
                    known.put(word, found)
            ids.extend(found)
        found = tuple(ids)
        if len(words) != 1 and len(chunk) < self.window:
            known.put(chunk, found)
        return found

    def _plain(self, text: str) -> list[int]:
        """Ids of a text whose white space separates words in every rule of the file."""
        chunks = (text.lower() if self.lower else text).split()
        found = list(map(self.known.young.get, chunks))
        if None in found:
            here: dict[str, tuple[int, ...]] = {}
            for k, ids in enumerate(found):
                if ids is None:
                    chunk = chunks[k]
                    ids = here.get(chunk)
                    if ids is None:
                        ids = here[chunk] = self.known.get(chunk) or self._chunk(chunk)
                    found[k] = ids
        return list(chain.from_iterable(found))

    def _any(self, text: str) -> list[int]:
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        words = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return list(chain.from_iterable(self.word_ids(w) for w, _ in words if w))

    def encode(self, text: str) -> list[int]:
        """The ids of a text, as the library gives without added special tokens."""
        out, at = [], 0
        for m in self.specials.finditer(text) if self.specials else ():
            out.extend(self._part(text[at : m.start()]))
            out.append(self.special[m[0]])
            at = m.end()
        out.extend(self._part(text[at:] if at else text))
        return out

    def _part(self, text: str) -> list[int]:
        if not text:
            return []
        return self._plain(text) if self.pattern and not _PLAIN.search(text) else self._any(text)

    def stream(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, a stretch at a time. No rule of such a file reaches over a single space into what is before it."""
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + _STRETCH)
            end = cut.start() if cut else len(text)
            yield self.encode(text[at:end])
            at = end

    def decode(self, stretches: Iterable[list[int]], at_once: int = 1 << 14) -> Iterator[str]:
        """The text of the ids in pieces."""
        machine, between = codecs.getincrementaldecoder("utf-8")("replace"), b" " if self.joined_by_space else b""
        begun, bytes_of = False, self.bytes_of
        for ids in stretches:
            for lo in range(0, len(ids), at_once):
                raw = between.join([bytes_of[i] for i in ids[lo : lo + at_once]])
                yield machine.decode((between if begun else b"") + raw)
                begun = True
        yield machine.decode(b"", final=True)


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """One row a document: the id, n_tokens, digests of the ids and of the decoded text, and the ids if asked for."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        t = transducer(path)
        decimal = t.decimal
        for batch in pieces(batches, "_text", 4 << 20):
            n, digest, decoded, lists = [], [], [], []
            for value in batch.column(0).to_pylist():
                count, numbers, back, kept = 0, hashlib.sha256(), hashlib.sha256(), []

                def read(value=value):
                    nonlocal count
                    for found in t.stream(value or ""):
                        if found:
                            numbers.update((b" " if count else b"") + b" ".join([decimal[i] for i in found]))
                            count += len(found)
                        if ids:
                            kept.extend(found)
                        yield found

                for part in t.decode(read()):
                    back.update(part.encode())
                n.append(count)
                digest.append(numbers.hexdigest())
                decoded.append(back.hexdigest())
                lists.append(kept)
            out = [batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(lists, pa.list_(pa.int32()))] if ids else []), names=names)

    names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else [])]
    schema = f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    done = docs.select(F.col(text).alias("_text"), F.col(doc_id).alias("_id")).mapInArrow(run, schema)
    return done.select(F.col("_id").alias(doc_id), *names[1:])
