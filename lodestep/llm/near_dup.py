"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

A signature has ``chunks * 4`` symbols of 16 bits. Two signatures that differ in at most ``2 * chunks - 1`` symbols
differ in at most one symbol of some chunk (pigeonhole). That one allowed error is enumerated: each chunk is
indexed under its four sub-keys that leave one symbol out, so every pair within that distance shares a key. With
ten chunks a pair of Jaccard similarity 0.8 shares none with probability below 4e-8. Pairs that share a key are
confirmed on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestep.llm import _text
from lodestep.llm._shared import Scratch
from lodestep.llm.graph import SKETCH, SKETCH_SCHEMA, Links, odd_sketches

U = np.uint64
CHUNK = 4


def _hash_family(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(77))
    return rng.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, k, dtype=np.uint32)


def _min_symbols(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """k 16-bit MinHash symbols for each run of ``hashes`` that begins at ``starts`` (no run is empty)."""
    a, b = _hash_family(k)
    x = (hashes >> U(32)).astype(np.uint32)
    work, out = np.empty_like(x), np.empty((len(starts), k), np.uint32)
    for i in range(k):
        np.multiply(x, a[i], out=work)
        np.add(work, b[i], out=work)
        out[:, i] = np.minimum.reduceat(work, starts)
    return _text.mix(out.astype(U)) >> U(48)


def _sub_keys(symbols: np.ndarray, chunks: int) -> np.ndarray:
    """For each chunk of four symbols, the four keys of three symbols that leave one out, tagged by chunk and place."""
    s = symbols.reshape(len(symbols), chunks, CHUNK)
    keys = np.empty((len(symbols), chunks, CHUNK), U)
    for j in range(CHUNK):
        x, y, z = (s[:, :, i] for i in range(CHUNK) if i != j)
        keys[:, :, j] = (x << U(32)) | (y << U(16)) | z | ((np.arange(chunks, dtype=U) * U(CHUNK) + U(j)) << U(48))
    return keys.reshape(len(symbols), chunks * CHUNK).astype(np.int64)


def _shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for part in _text.slices(column):
        yield _text.distinct(*_text.shingles(_text.words(part, _text.NON_SPACE), size))


def signatures(docs: DataFrame, size: int, chunks: int) -> DataFrame:
    """(doc_id, n, h1, h2, keys): distinct shingles, a 128-bit digest of the set, and the index keys; none without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, keys = [], [], [], []
            for sets, offsets in _shingle_sets(batch.column(1), size):
                count = np.diff(offsets)
                some = np.flatnonzero(count)
                starts = offsets[:-1][some]
                digest = np.zeros((2, len(count)), U)
                own = np.zeros((len(count), chunks * CHUNK), np.int64)
                if len(some):
                    digest[0, some] = np.add.reduceat(_text.mix(sets), starts)
                    digest[1, some] = np.add.reduceat(_text.mix(sets ^ U(0x5851F42D4C957F2D)), starts)
                    own[some] = _sub_keys(_min_symbols(sets, starts, chunks * CHUNK), chunks)
                n.append(count), h1.append(digest[0]), h2.append(digest[1])
                keys.extend(own[i] if count[i] else own[i][:0] for i in range(len(count)))
            if n:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).cast(pa.int64()),
                        pa.array(np.concatenate(n), pa.int64()),
                        pa.array(np.concatenate(h1).view(np.int64)),
                        pa.array(np.concatenate(h2).view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(np.concatenate([[0], np.cumsum([len(x) for x in keys])]), pa.int32()),
                            pa.array(np.concatenate(keys)),
                        ),
                    ],
                    names=["doc_id", "n", "h1", "h2", "keys"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, keys array<long>")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(node, items, n, sketch): the full set of each document that has words, its size and odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for sets, offsets in _shingle_sets(batch.column(1), size):
                rows = len(offsets) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).cast(pa.int64()).slice(first, rows),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(sets.view(np.int64))),
                        pa.array(np.diff(offsets), pa.int32()), *odd_sketches(sets, offsets),
                    ],
                    names=["node", "items", "n", *SKETCH],
                )
                first += rows

    return docs.select("doc_id", "text").mapInArrow(run, f"node long, items array<long>, n int, {SKETCH_SCHEMA}").where("n > 0")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, chunks: int = 10) -> DataFrame:
    """Components of documents whose word-shingle sets have a Jaccard similarity of at least ``percent`` / 100.

    Returns (doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, any other columns):
    the set's size, the smallest doc_id reachable over links, and whether it is that one. Words are the runs of
    bytes other than ASCII white space with A-Z lower-cased; a text of fewer words than a shingle is one shingle.
    Null, empty and blank texts have no set, are linked with nothing and are kept. Rows that repeat a doc_id count
    as one node, linked as any of them is. Rows without a doc_id take no part: component_id is null, kept is true. Ids of
    other types count as the 64-bit number that they write out, or as none. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text")
    with Scratch(spark) as scratch:
        signed = scratch.write(signatures(docs, shingle_words, chunks))
        real = signed.where("n > 0 and doc_id is not null")
        classes = scratch.write(real.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("node")))
        bands = (
            real.join(classes.select(F.col("node").alias("doc_id"), "h1", "h2"), ["doc_id", "h1", "h2"], "left_semi")
            .select("keys", F.col("doc_id").alias("node"), F.col("n").alias("size"))
        )

        def sets_of(nodes: DataFrame) -> DataFrame:
            nodes = nodes.select(F.col("node").alias("doc_id")).hint("shuffle_hash")
            return scratch.write(shingle_sets(docs.join(nodes, "doc_id", "left_semi"), shingle_words))

        fits = 100 * F.least("size", "hub_size") >= percent * F.greatest("size", "hub_size")
        labels = Links(sets_of, percent, fits, scratch).components(bands)
        found = signed.join(classes, ["h1", "h2", "n"], "left")
        if labels is not None:
            found = found.join(labels, "node", "left")
        else:
            found = found.withColumn("component", F.lit(None).cast("long"))
        found = found.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))).select(
            "doc_id", F.col("n").alias("n_shingles"), "component_id",
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
        return found.checkpoint()


def keep_one(docs: DataFrame, **how: int) -> DataFrame:
    """``docs`` without the documents whose component has a smaller doc_id; all columns stay. Odd cases as in ``near_duplicates``: rows without an id or a set stay."""
    gone = near_duplicates(docs, **how).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    same = docs["doc_id"].try_cast("long") == gone["_gone"]
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti").select(*docs.columns)
