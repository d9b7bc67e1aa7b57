"""Language identification by inference of a mixture.

A document is a bag of words, each drawn from one of its languages. A language
gives a word the product of its smoothed byte trigram probabilities.
Expectation maximisation estimates the proportions of the languages in each
document, first over all languages, then over the largest one, two and so on
up to all; the set with the best penalised likelihood is kept. The prediction is
the language with the largest proportion in that set.

Training counts every labelled row it is given: one sparse count per task and
language goes to the shuffle. What is sent to the tasks for prediction is
``BINS`` numbers for each language, whatever the number of documents.

Nulls: a null text, or one without a letter, is ``und`` with score 0 and no
proportions; rows with a null language teach nothing. An empty or unlabelled
training table makes every document ``und``. Repeated rows are predicted each.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framewright.llm.blobs import pack, pieces, unpack

BINS = 1 << 15
UNKNOWN = "und"
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_AS_SPACE = bytes(b if b >= 128 or b in _LETTERS else 32 for b in range(256))
_ASCII_LETTER = re.compile("[a-zA-Z]")
_PIECE = 2 << 20


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(_ASCII_LETTER.search(text) or any(map(str.isalpha, text)))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin of each letter's trigram, where each word starts among them, and each word's text."""
    raw = [t.lower().encode("utf-8", "surrogatepass").translate(_AS_SPACE) for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b" " + b" ".join(raw) + b"  ", np.uint8)
    wide = data.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    code *= np.uint32(0x9E3779B1)
    code >>= np.uint32(17)
    inner = data[1:-1] != 32
    at = np.flatnonzero(inner)
    first = np.flatnonzero(data[at] == 32)
    owner = np.searchsorted(ends, at[first], side="right")
    return code[at].astype(np.int32), first, owner


def train_languages(docs: DataFrame, text: str = "text", lang: str = "lang", smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """The learned languages, sorted, and the log probability of every bin in each."""

    def count(batches):
        totals: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BINS, np.int64))
        for batch in pieces(batches, "_text", _PIECE):
            grouped = defaultdict(list)
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grouped[name].append(t)
            for name, texts in grouped.items():
                totals[name] += np.bincount(trigrams(texts)[0], minlength=BINS)
            if len(totals) > 256:
                yield emit(totals)
                totals.clear()
        yield emit(totals)

    def emit(totals):
        bodies = []
        for row in totals.values():
            used = np.flatnonzero(row)
            bodies.append(pack(used.astype(np.uint16), row[used]))
        return pa.RecordBatch.from_pydict({"lang": pa.array(list(totals), pa.string()), "body": pa.array(bodies, pa.binary())})

    def add(key, rows):
        total = np.zeros(BINS, np.int64)
        for body in rows.column("body").to_pylist():
            used, n = unpack(body)
            total[used] += n
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "body": pa.array([pack(total)], pa.binary())})

    labelled = docs.select(F.col(text).alias("_text"), F.col(lang).alias("_lang")).where("_text IS NOT NULL AND _lang IS NOT NULL")
    counted = labelled.mapInArrow(count, "lang string, body binary").groupBy("lang").applyInArrow(add, "lang string, body binary")
    rows = sorted((r["lang"], r["body"]) for r in counted.collect())  # one row a language
    if not rows:
        return [], np.zeros((0, BINS), np.float32)
    counts = np.stack([unpack(body)[0] for _, body in rows]).astype(np.float64) + smooth
    return [name for name, _ in rows], np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def word_likelihoods(model: np.ndarray, code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log likelihood of each word in each language, less the word's best."""
    out = np.empty((len(first), len(model)), np.float32)
    for k, row in enumerate(model):
        out[:, k] = np.add.reduceat(row[code], first)
    return out


def mixture(like: np.ndarray, first: np.ndarray, sizes: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after ``rounds`` of expectation maximisation, and the log likelihood under them."""
    for _ in range(rounds):
        joint = like * np.repeat(share, sizes, axis=0)
        joint /= np.maximum(joint.sum(1, keepdims=True), 1e-30)
        share = np.add.reduceat(joint, first, axis=0) / sizes[:, None]
    total = (like * np.repeat(share, sizes, axis=0)).sum(1)
    return share, np.add.reduceat(np.log(np.maximum(total, 1e-30)), first)


def infer(model: np.ndarray, texts: list[str], penalty: float, rounds: int) -> np.ndarray:
    """Proportions of the languages in each text; all zero where no word is found."""
    result = np.zeros((len(texts), len(model)), np.float32)
    code, first, owner = trigrams(texts)
    if not len(first) or not len(model):
        return result
    log_like = word_likelihoods(model, code, first)
    like = np.exp(log_like - log_like.max(1, keepdims=True))
    head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    sizes = np.diff(np.r_[head, len(owner)])
    full, _ = mixture(like, head, sizes, np.full((len(head), len(model)), 1 / len(model), np.float32), rounds)
    place = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    best, score = full, np.full(len(head), -np.inf)
    for n in range(1, len(model) + 1):
        if (-penalty * (n - 1) * np.log(sizes + 1) <= score).all():
            break  # no likelihood is above one, so no larger set is better
        share = np.where(place < n, np.maximum(full, 1e-6), 0).astype(np.float32)
        share, fit = mixture(like, head, sizes, share / share.sum(1, keepdims=True), rounds if n > 1 else 0)
        fit = fit - penalty * (n - 1) * np.log(sizes + 1)
        better = fit > score
        best, score = np.where(better[:, None], share, best), np.where(better, fit, score)
    result[owner[head]] = best
    return result


def predict_languages(
    docs: DataFrame,
    languages: list[str],
    model: np.ndarray,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    penalty: float = 3.0,
    rounds: int = 8,
) -> DataFrame:
    """One row a document: the id, the columns in ``keep``, lang_pred, score, and languages and proportions of the chosen set.

    A text that is kept is the one that was read; it is sent once.
    """
    kept = keep or []
    place = {c: "_text" if c == text else f"_keep_{i}" for i, c in enumerate(kept)}
    source = docs.select(F.col(text).alias("_text"), F.col(doc_id).alias("_id"), *[F.col(c).alias(p) for c, p in place.items() if c != text])
    back = 0 if text in place else 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[back:])

    def predict(batches):
        for batch in pieces(batches, "_text", _PIECE):
            texts = batch.column(0).to_pylist()
            share = infer(model, [t or "" for t in texts], penalty, rounds)
            order = np.argsort(-share, axis=1, kind="stable")
            names, scores, sets, shares = [], [], [], []
            for t, row, by in zip(texts, share, order):
                used = [k for k in by if row[k] > 0]
                known = bool(used) and has_letter(t)
                names.append(languages[used[0]] if known else UNKNOWN)
                scores.append(min(1.0, float(row[used[0]])) if known else 0.0)
                sets.append([languages[k] for k in used] if known else [])
                shares.append([float(row[k]) for k in used] if known else [])
            out = batch.columns[back:] + [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[back:], "_p", "_s", "_l", "_m"])

    done = source.mapInArrow(predict, f"{schema}, _p string, _s double, _l array<string>, _m array<double>")
    return done.select(
        F.col("_id").alias(doc_id),
        *[F.col(place[c]).alias(c) for c in kept],
        F.col("_p").alias("lang_pred"),
        F.col("_s").alias("score"),
        F.col("_l").alias("languages"),
        F.col("_m").alias("proportions"),
    )


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
