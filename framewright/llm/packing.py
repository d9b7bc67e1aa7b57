"""Packing of tokenized documents into sequences of a fixed length.

A document's ids, with an end id after them, are cut into full pieces and one
remainder. Pieces are dealt by a hash of what they are into groups
of about ``group_size``, and each group is packed alone by first-fit
decreasing: a tournament tree over the bins' free room finds the first bin
that takes a piece in logarithmic time. Only the pieces' numbers are shuffled,
never their ids; the number of groups follows the number of pieces.

Tokenizing remembers the ids of space-delimited stretches in a bounded table,
those that come first. That is exact where no two white-space characters meet,
as the tokenizer's words do not cross such a space; other texts, and those
with control or format characters, go to the library whole.

Nulls and empty texts are one piece that holds the end id. Rows with the same
id are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from framewright.llm.blobs import pieces
from framewright.session import materialize

_REMEMBERED = 500_000
_LONGEST = 200
_SIDE_BY_SIDE = ("  ", "\n\n", " \n", "\n ", "<|")


def irregular(text: str) -> bool:
    """Whether white space meets, a special token may stand, or there are other spaces, line ends or controls."""
    return any(x in text for x in _SIDE_BY_SIDE) or not text.replace("\n", "").isprintable()


class StretchTokenizer:
    """The ids of a text, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        vocab = self.library.get_vocab()
        self.after_space = np.zeros(max(vocab.values()) + 1, bool)
        self.after_space[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True  # the byte alphabet's space

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words that each begin with their only space: one call, cut before every such id."""
        ids = np.array(self.library.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, "<u4")
        heads = np.flatnonzero(self.after_space[ids])
        if len(heads) != len(words):
            return self._fresh(words)
        raw, cuts = ids.tobytes(), [*(4 * heads).tolist(), 4 * len(ids)]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _fresh(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        stretches: list[str] = []
        ends: list[int] = []
        whole: list[str] = []
        for t in texts:
            if irregular(t):
                whole.append(t)
                ends.append(-1)
            else:
                stretches += t.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
                ends.append(len(stretches))
        found = list(map(self.known.get, stretches))
        missing = [k for k, ids in enumerate(found) if ids is None]
        new = list({stretches[k] for k in missing})
        words = [c for c in new if c[0] == " " and len(c) > 1]
        fresh = dict(zip(words, self._words(words)))
        others = [c for c in new if c not in fresh]
        fresh.update(zip(others, self._fresh(others)))
        for k in missing:
            found[k] = fresh[stretches[k]]
        room = _REMEMBERED - len(self.known)
        self.known.update((c, fresh[c]) for c in new[: max(0, room)] if len(c) <= _LONGEST)
        out, at, rest = [], 0, iter(self._fresh(whole))
        for end in ends:
            out.append(next(rest) if end < 0 else b"".join(found[at:end]))
            at = at if end < 0 else end
        return out


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> StretchTokenizer:
    return StretchTokenizer(path)


def cut_documents(docs: DataFrame, path: str, doc_id: str, text: str, capacity: int, end_id: int) -> DataFrame:
    """One row a piece: ``_id``, start, length, ids_crc32, doc_tokens."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        tokenizer, end = _tokenizer(path), np.array([end_id], "<u4").tobytes()
        for batch in pieces(batches, "_text", 1 << 20):
            row, start, length, crc, total = [], [], [], [], []
            for k, ids in enumerate(tokenizer.encode([t or "" for t in batch.column(0).to_pylist()])):
                ids += end
                for at in range(0, len(ids), 4 * capacity):
                    piece = ids[at : at + 4 * capacity]
                    row.append(k), start.append(at // 4), length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece)), total.append(len(ids) // 4)
            numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(row, pa.int64())), *numbers], names=names)

    source = docs.select(F.col(text).alias("_text"), F.col(doc_id).alias("_id"))
    return source.mapInArrow(run, f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; larger items first, each into the first bin with room."""
    order = np.argsort(-sizes, kind="stable")
    leaves = 1 << max(0, int(len(sizes) - 1).bit_length())
    room = [capacity] * (2 * leaves)  # room[k] is the most room below node k
    used = [0] * leaves
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[item], offsets[item] = node - leaves, used[node - leaves]
        used[node - leaves] += size
        room[node] -= size
        while node > 1:
            node >>= 1
            most = room[2 * node] if room[2 * node] > room[2 * node + 1] else room[2 * node + 1]
            if room[node] == most:
                break
            room[node] = most
    return bins, offsets


def pack_documents(
    docs: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 1024,
    end_id: int = 0,
    group_size: int = 8192,
    seed: int = 1,
) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = materialize(cut_documents(docs, path, doc_id, text, capacity, end_id), "pieces")
    groups = 1 + cut.count() // group_size
    dealt = F.pmod(F.xxhash64(F.lit(seed), "_id", "start", "ids_crc32"), F.lit(groups)).cast("int")

    def pack(key, rows):
        rows = rows.sort_by([("length", "descending"), ("_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(rows.column("length").to_numpy(), capacity)
        sequence = bins + (key[0].as_py() << 40)
        return rows.drop_columns("_group").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    done = cut.withColumn("_group", dealt).groupBy("_group").applyInArrow(pack, schema)
    return done.withColumnRenamed("_id", doc_id)
