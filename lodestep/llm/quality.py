"""Quality by compression: zstandard dictionaries of good and of bad text.

Each block of a text is compressed with a dictionary built from good labelled text and with one built from bad
text. The difference of the two sizes, normalised by the text's length, says which it resembles. A logistic calibration turns it into a score,
beside what else compression shows, as ``features`` lists it: the size without a dictionary, that squared, log length, the difference times log length,
and the size with the good dictionary.
Documents are scored where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestep.llm import _labels

BLOCK = 2048
LEVEL = 3


class Model(NamedTuple):
    """Dictionary bytes and the calibration: means, scales and weights of the features, the last weight an intercept."""

    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def build_dictionary(texts: list[bytes], size: int) -> bytes:
    """Content for a raw dictionary: as many bytes from every text, from a hashed place on, up to ``size`` bytes.

    A piece has ``size`` over the number of texts bytes, but 64 at least and 512 at most; with fewer texts each gives more pieces, in turn, until
    all is used. Only where 64 bytes of every text are more than ``size`` do texts go without, the last in the order of their hashes.
    """
    used = sorted((crc32(t), t) for t in texts if t)
    piece = min(512, max(64, size // max(1, len(used))))
    counts = [-(-len(t) // piece) for _, t in used]
    out, total, turn = [], 0, 0
    while total < size and turn < max(counts, default=0):
        for (place, t), n in zip(used, counts, strict=True):
            if turn < n and total < size:
                at = (place + turn) % n * piece
                out.append(t[at : at + piece])
                total += len(out[-1])
        turn += 1
    return b"".join(out)[:size]


class Scorer:
    def __init__(self, good: bytes, bad: bytes):
        import zstandard as z

        def tool(content: bytes):
            if len(content) < 8:
                return z.ZstdCompressor(level=LEVEL, write_content_size=False)
            data = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            return z.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)

        self.good, self.bad, self.plain = tool(good), tool(bad), tool(b"")

    def features(self, text: bytes) -> tuple[float, ...]:
        """Of a whole text, by blocks and by length: size difference, size without a dictionary, that squared, log length, difference times log length, size with the good dictionary."""
        good = bad = plain = 0
        for i in range(0, len(text), BLOCK):
            block = text[i : i + BLOCK]
            good += len(self.good.compress(block))
            bad += len(self.bad.compress(block))
            plain += len(self.plain.compress(block))
        n = len(text) + 40
        return (bad - good) / n, plain / n, (plain / n) ** 2, np.log(n), (bad - good) / n * np.log(n), good / n


def calibrate(features: np.ndarray, y: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method with a small ridge, intercept moved to the share of label 1."""
    mean, scale = features.mean(0), features.std(0) + 1e-9
    x = np.hstack([(features - mean) / scale, np.ones((len(y), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    seen, share = y.mean(), min(max(share, 1e-4), 1 - 1e-4)
    w[-1] += np.log(share / (1 - share)) - np.log(seen / (1 - seen))
    return mean, scale, w


def train(texts: list[str], y: list[int], share: float, size: int = 1 << 17) -> Model:
    """Dictionaries from every other text of a class, the calibration from the rest. A missing class: the share for every text."""
    truth, raw = np.array(y), [t.encode() for t in texts]
    flat = Model(b"", b"", np.zeros(6), np.ones(6), np.append(np.zeros(6), np.log(max(share, 1e-4) / max(1 - share, 1e-4)) if len(y) else 0.0))
    by = [np.flatnonzero(truth == k) for k in (0, 1)] if len(y) else [[], []]
    if min(map(len, by)) < 2:
        return flat
    good, bad = (build_dictionary([raw[i] for i in by[k][::2]], size) for k in (1, 0))
    scorer = Scorer(good, bad)
    rest = np.concatenate([b[1::2] for b in by])
    return Model(good, bad, *calibrate(np.array([scorer.features(raw[i]) for i in rest]), truth[rest].astype(float), share))


def scores(texts: list[str], model: Model, scorer: Scorer) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    x = (np.array([scorer.features(t.encode()) for t in texts]) - model.mean) / model.scale
    return 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, most_chars: int = 8000, size: int = 1 << 17) -> Model:
    """Trains on at most ``per_class`` labelled documents of each class outside the held-out fold (see ``_labels.sample``); each dictionary has at most ``size`` bytes."""
    return train(*_labels.sample(docs, labels, "quality", per_class, most_chars), size)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; the score is the chance of quality label 1.

    Null and empty texts are scored as a text of no bytes. Without labels every score is 0.5; with a class missing
    it is the share of that class. Whole texts are compressed, block by block. Repeated rows score alike; a null
    doc_id stays null and is not held out. The dictionaries (two of ``size`` bytes) go to the tasks as a broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(fit(docs, labels, **how)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        scorer = Scorer(model.good, model.bad)
        for batch in batches:
            p = scores([t or "" for t in batch.column(1).to_pylist()], model, scorer)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return found.select("doc_id", _labels.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
