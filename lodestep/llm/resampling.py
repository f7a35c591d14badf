"""Importance resampling towards a target's distribution of hashed n-grams, by a streaming CRC ring.

A scan of a document keeps the zlib states of its last starts: each word extends the state of every start that is still open by a
space and the word, and opens a start, so the crc32 of every run of 1 to n words comes from a state that is already there. Tasks
add buckets up where the texts lie; what leaves them is one count a bucket. A Gumbel term drawn by the id turns the best scores into a
weighted draw without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestep.llm._order import numbered
from lodestep.llm._shared import Scratch, fresh
from lodestep.llm._text import ALNUM

#: Rows of the result for which another file is written.
ROWS_A_FILE = 250_000
#: Word bytes as they are, A-Z as a-z, every other byte as a space.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if ALNUM[b] else 32 for b in range(256))


def words(text: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, A-Z lower-cased, as lists from some ``most`` bytes each."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + most)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _shifts(longest: int) -> np.ndarray:
    """At [n, j, b], what n zero bytes after it make of the state ``b << 8 * j``: zlib's states are linear, so any state is the xor of four of these."""
    byte = np.array([crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
    out = [(np.arange(256, dtype=np.uint32)[None] << np.array([[0], [8], [16], [24]], np.uint32)).ravel()]
    for _ in range(longest):
        out.append(out[-1] >> np.uint32(8) ^ byte[out[-1] & 255])
    return np.concatenate(out)


#: Words of fewer bytes extend all states at once by table, longer ones call zlib for each.
LONG = 64
_SHIFT = _shifts(LONG)
_SPACE = np.array([crc32(b" " + bytes(n)) ^ crc32(bytes(n)) for n in range(LONG)], np.uint32)


class Ring:
    """The zlib states of the last ``n`` starts of a document; they outlast a list of words, so runs go over the borders of lists."""

    def __init__(self, n: int):
        self.last = [np.zeros(0, np.uint32)] * n  # at k, the state of the run of k + 1 words that ended last, once there is one

    def extend(self, found: list[bytes]) -> list[np.ndarray]:
        """At k, the crc32 of every run of k + 1 words that ends in ``found``, in order: a run's state extended by a space and the next word."""
        many = len(found)
        crc, length = np.fromiter(map(crc32, found), np.uint32, many), np.fromiter(map(len, found), np.int64, many)
        long, length = np.flatnonzero(length >= LONG), np.minimum(length, LONG - 1)
        spaced, row, out = _SPACE[length] ^ crc, (length + 1) * 1024, [crc]  # a space and a word on their own
        for last in self.last[:-1]:
            states = np.concatenate([last, out[-1]])  # the last of them waits for the next list's first word
            first, states = many + 1 - len(states), states[:-1]
            at = row[first:]
            made = spaced[first:] ^ _SHIFT[at + (states & 255)] ^ _SHIFT[at + (states >> 8 & 255) + 256] ^ _SHIFT[at + (states >> 16 & 255) + 512] ^ _SHIFT[at + (states >> 24) + 768]
            for i in long[np.searchsorted(long, first) :]:
                made[i - first] = crc32(b" " + found[i], int(states[i - first]))
            out.append(made)
        self.last = [np.concatenate([old, new])[-1:] for old, new in zip(self.last, out, strict=True)]
        return out


def buckets(text: bytes, n: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, the buckets of the runs of 1 to ``n`` words that end in them) for a text, some megabyte at a time; a run's bucket is its crc32 modulo ``size``."""
    ring = Ring(n)
    for found in words(text):
        yield len(found), np.concatenate(ring.extend(found)) % np.uint32(size)


def _texts(df: DataFrame) -> Column:
    return F.coalesce(df["text"].cast("string"), F.lit("")).alias("text")


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()  # the texts' own bytes: no copy before this one


def bucket_counts(docs: DataFrame, n: int = 3, size: int = 10_000) -> np.ndarray:
    """How many features of all texts are in each bucket. Null and empty texts have none; an empty table gives zeros.

    ``size`` numbers reach the driver, whatever the number of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, many = np.zeros(size, np.int64), [], 0
        for batch in batches:
            for text in _bytes(batch.column(0)):
                for _, found in buckets(text, n, size):
                    held.append(found)
                    many += len(found)
                if many > 1 << 18:
                    counts += np.bincount(np.concatenate(held), minlength=size)
                    held, many = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=size)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["bucket", "n"])

    out = np.zeros(size, np.int64)
    for r in docs.select(_texts(docs)).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``size`` rows
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths, rounded down, of the log of how much likelier a bucket is in the target than in the source; one is added to every count."""
    s, t, size = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weights(docs: DataFrame, gains: np.ndarray, n: int = 3) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document: the sum of its features' gains."""
    size = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in _bytes(batch.column(1)):
                n_words = n_features = weight = 0
                for many, found in buckets(text, n, size):
                    n_words, n_features, weight = n_words + many, n_features + len(found), weight + int(gains[found].sum())
                rows.append((n_words, n_features, weight))
            columns = [pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ([], [], []))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), _texts(docs)).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int, doc_id: Column) -> Column:
    """Thousandths, rounded down, of a Gumbel draw by the first 32 bits of the sha256 of ``seed:doc_id``; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, n: int = 3, size: int = 10_000, least_words: int = 20, seed: int = 42) -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score and rank: ``percent`` of those with ``least_words`` words or more are drawn, the best by score.

    Features are the runs of 1 to ``n`` words of whole texts; ``docs`` is the source of the counts. The drawn have ranks from 1, ties to the smaller
    doc_id, a null one last; the others' rank is null. Null and empty texts have no features and weight 0. Rows that repeat an id are
    documents of their own, with the same draw. An empty table gives no rows; an empty target is as likely to hold any bucket. Texts
    are scanned twice and never shuffled.
    """
    gains = bucket_gains(bucket_counts(docs, n, size), bucket_counts(target, n, size))
    with Scratch(docs.sparkSession) as scratch:
        scored = scratch.write(weights(docs, gains, n).withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id"))))
        able = F.col("n_words") >= least_words
        rows, count = scored.agg(F.count("*"), F.count_if(able)).first()
        drawn = count * percent // 100
        ranked = numbered(scored.where(able), [F.desc("score"), F.asc_nulls_last("doc_id")], scratch, "row")
        rank = F.when(F.col("row") < drawn, F.col("row") + 1)
        every = ranked.withColumn("rank", rank).drop("row").unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
        return every.coalesce(1 + rows // ROWS_A_FILE).checkpoint()  # rows of 48 bytes


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws; rows that share an id go or stay together, and rows without one go."""
    key = fresh(docs, "drawn_id")[0]
    ids = resample(docs, target, **options).where("rank is not null and doc_id is not null").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(ids, docs["doc_id"].cast("long") == ids[key], "left_semi")
