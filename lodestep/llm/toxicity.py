"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams, with marks at both ends, hashed into buckets;
a document's vector is the mean over its distinct words and ``PAD`` zero vectors, which steady short texts; a
two-class softmax reads it. Embeddings and softmax are trained
together on a bounded sample. As the reading is linear, the trained model folds into one number for each
bucket, so a misspelling never seen scores by the n-grams it shares. Documents are scored where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestep.llm import _labels, _text

GRAMS = (3, 4, 5, 6)
BITS = 21
SCALE = 50.0
PAD = 20
_MULTIPLY = np.uint32(0x9E3779B1)
_WORD: list[np.ndarray] = []


def _is_word() -> np.ndarray:
    """Whether each code point is a letter or digit; made once in a worker."""
    if not _WORD:
        _WORD.append(np.array([chr(c).isalnum() for c in range(0x110000)]))
    return _WORD[0]


class Grams(NamedTuple):
    """n-gram places of some texts: bucket and validity by n, and each word's place, n-gram count and text."""

    buckets: list[np.ndarray]
    valid: list[np.ndarray]
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    rows: np.ndarray


def grams(texts: list[str]) -> Grams:
    """All n-grams of the lower-cased words of ``texts``. A place's n-gram may begin or end on the separator beside a word."""
    joined = "\x00\x00".join(t.replace("\x00", " ").lower() for t in texts)
    codes = np.frombuffer(f"\x00{joined}\x00\x00".encode("utf-32-le", "surrogatepass"), "<u4")
    word = _is_word()[codes]
    edge = np.diff(word.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = np.flatnonzero((codes[1:] == 0) & (codes[:-1] == 0))[: max(len(texts) - 1, 0)]
    rows = np.searchsorted(cuts, starts)
    symbols = np.where(word, codes, np.uint32(1))
    h = np.zeros(len(codes), np.uint32)
    inner = np.ones(len(codes), bool)
    buckets, valid = [], []
    for n in range(1, max(GRAMS) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        h = (h[:size] ^ symbols[n - 1 :]) * _MULTIPLY
        h ^= h >> np.uint32(15)
        if n >= 3:
            inner = inner[:size] & word[n - 2 : n - 2 + size]
        if n in GRAMS:
            buckets.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
            valid.append(inner)
    length = ends - starts
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_text.mix(symbols.astype(np.uint64)) * _text.powers(len(codes)), out=total[1:])
    names = _text.mix((total[ends] - total[starts]) * _text.inverse_powers(len(codes))[starts]) ^ _text.mix(rows.astype(np.uint64))
    once = np.sort(np.unique(names, return_index=True)[1])  # a word counts once in a text, however often it is repeated
    starts, ends, rows, length = starts[once], ends[once], rows[once], length[once]
    counts = sum(np.maximum(0, length + 3 - n) for n in GRAMS)
    return Grams(buckets, valid, starts, ends, counts, rows)


def word_scores(found: Grams, table: np.ndarray, size: int) -> np.ndarray:
    """Mean of the buckets' numbers over each word's n-grams."""
    total = np.zeros(size + 1)
    for b, ok in zip(found.buckets, found.valid, strict=True):
        total[1 : len(b) + 1] += np.where(ok, table[b], 0.0)
    np.cumsum(total, out=total)
    return (total[found.ends - 1] - total[found.starts - 1]) / np.maximum(found.counts, 1)


class Model(NamedTuple):
    """One number for each bucket and an intercept; a document's logit is the mean over its words plus the intercept."""

    table: np.ndarray
    bias: float


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row offsets, buckets, weights): each text's n-grams, weighted so that its words count alike."""
    offsets, buckets, weights = [0], [], []
    for text in texts:
        found = grams([text])
        at, w = [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(found.starts):
            per_word = 1.0 / np.maximum(found.counts, 1) / (len(found.starts) + PAD)
            for b, ok in zip(found.buckets, found.valid, strict=True):
                use = np.flatnonzero(ok)
                owner = np.searchsorted(found.starts - 1, use, "right") - 1
                inside = (owner >= 0) & (use < found.ends[owner])
                at.append(b[use[inside]].astype(np.int64))
                w.append(per_word[owner[inside]])
        some, inverse = np.unique(np.concatenate(at), return_inverse=True)
        buckets.append(some.astype(np.int32))
        weights.append(np.bincount(inverse, np.concatenate(w), len(some)).astype(np.float32))
        offsets.append(offsets[-1] + len(some))
    return np.array(offsets), np.concatenate(buckets), np.concatenate(weights)


def train(
    texts: list[str], y: list[int], share: float, dim: int = 4, epochs: int = 14, batch: int = 64, rate: float = 3.0, least_docs: int = 6, seed: int = 1
) -> Model:
    """Trains embeddings (2**21 x ``dim``) and softmax by gradient descent with momentum; the intercept is moved to the share of label 1.

    n-grams of fewer than ``least_docs`` documents keep a zero vector and the others are weighted by inverse
    document frequency, so that what repeats across documents of a class outweighs what is peculiar to one.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    truth = np.array(y, float)
    share = min(max(share, 1e-4), 1 - 1e-4)
    if not 0 < truth.sum() < len(truth):
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))) if len(truth) else 0.0)
    offsets, buckets, weights = _features(texts)  # 8 bytes an n-gram: some 100 MB for 4,000 texts of 6,000 characters
    seen_in = np.bincount(buckets, minlength=1 << BITS)
    common = seen_in >= least_docs
    used, place = np.flatnonzero(common), (np.cumsum(common) - 1).astype(np.int32)
    kept = common[buckets]
    offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
    inverse, weights = place[buckets[kept]], weights[kept]
    del buckets, kept
    idf = SCALE * np.log((1 + len(truth)) / seen_in[used])
    weights *= idf[inverse]
    emb, soft, bias = rng.normal(0, 0.05, (len(used), dim)), rng.normal(0, 0.5, (dim, 2)), np.zeros(2)
    params, rates = (emb, soft, bias), (rate, 0.05, 0.05)
    speed = [np.zeros_like(p) for p in params]
    for _ in range(epochs):
        order = rng.permutation(len(truth))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            take = np.concatenate([np.arange(offsets[d], offsets[d + 1]) for d in docs])
            row = np.repeat(np.arange(len(docs)), offsets[docs + 1] - offsets[docs])
            feature, w = inverse[take], weights[take]
            hidden = np.stack([np.bincount(row, w * emb[feature, k], len(docs)) for k in range(dim)], 1)
            z = hidden @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - np.stack([1 - truth[docs], truth[docs]], 1)) / len(docs)
            back = error @ soft.T
            step = np.stack([np.bincount(feature, w * back[row, k], len(used)) for k in range(dim)], 1)
            for param, v, g, r in zip(params, speed, (step, hidden.T @ error, error.sum(0)), rates, strict=True):
                v *= 0.9
                v += g
                param -= r * v
    table = np.zeros(1 << BITS, np.float32)
    table[used] = idf * (emb @ (soft[:, 1] - soft[:, 0]))
    seen = truth.mean()
    return Model(table, float(bias[1] - bias[0] + np.log(share / (1 - share)) - np.log(seen / (1 - seen))))


def logits(texts: list[str], model: Model) -> np.ndarray:
    found = grams(texts)
    n = len(texts)
    sums = np.bincount(found.rows, word_scores(found, model.table, max((len(b) for b in found.buckets), default=0) + 8), n) if len(found.starts) else np.zeros(n)
    words = np.bincount(found.rows, minlength=n) if len(found.starts) else np.zeros(n)
    return sums / (words + PAD) + model.bias


def score(docs: DataFrame, model: Model, threshold: float = 0.5, most_chars: int = 1 << 18) -> DataFrame:
    """(doc_id, score, predicted) for each row of ``docs``; the model (8 MB) goes to the tasks as a broadcast.

    Null and empty texts, and texts without words, get the intercept's score. Whole texts are scored, in groups
    of about ``most_chars`` characters. Repeated rows score alike; a null doc_id stays null.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out, at = [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= most_chars):
                    size += len(texts[end])
                    end += 1
                out.append(logits(texts[at:end], own))
                at = end
            if out:
                z = np.clip(np.concatenate(out), -30, 30)
                p = 1 / (1 + np.exp(-z))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, most_chars: int = 6000) -> Model:
    """Trains on at most ``per_class`` labelled documents of each class outside the held-out fold (see ``_labels.sample``).

    Without labels every score is 0.5; with one class only it is near that class.
    """
    return train(*_labels.sample(docs, labels, "toxic", per_class, most_chars))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; the score is the chance of label 1.

    Null and empty texts are scored as a text without words. Without labels every score is 0.5; with a class missing it is the share of
    that class. Repeated rows score alike; a null doc_id stays null and is not held out. An empty table gives no rows.
    """
    found = score(docs, fit(docs, labels, **how), threshold)
    return found.select("doc_id", _labels.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how: int) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more; all columns stay and nothing is shuffled.

    Null and empty texts are scored as in ``judge``, rows without an id by their text, and repeated rows go or stay together. An empty table gives no rows.
    """
    model, text = fit(docs, labels, **how), docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))
    least = float(np.log(threshold / (1 - threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            keep, at = [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= 1 << 18):
                    size += len(texts[end])
                    end += 1
                keep.append(logits(texts[at:end], own) < least)
                at = end
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
