"""Benchmark decontamination with suffix arrays over shards of the training text.

A task builds the suffix array of each shard of the words it reads, binary-searches every benchmark suffix in it
and joins the window matches on one diagonal into longest verbatim matches with their places. Documents are never
shuffled. The benchmark's words lie in the shared folder and are read in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestep.llm import _text
from lodestep.llm._shared import Scratch

U = np.uint64
#: Ranks of a shard's words fit in 21 bits, so three fit in a key.
BITS = 21
SHARD_WORDS = (1 << BITS) - 4096
BLOCK_WORDS = 1 << 22


class Block(NamedTuple):
    """Windows of some benchmark items: word hashes, and for each window its first word, length, item and place in it."""

    hashes: np.ndarray
    first: np.ndarray
    length: np.ndarray
    item: np.ndarray
    place: np.ndarray
    names: list[str]


def _block(items: list[tuple[str, np.ndarray]], window: int) -> Block:
    first, length, item, place, at = [], [], [], [], 0
    for i, (_, h) in enumerate(items):
        n = max(1, len(h) - window + 1)
        first.append(at + np.arange(n))
        length.append(np.full(n, min(window, len(h))))
        item.append(np.full(n, i))
        place.append(np.arange(n))
        at += len(h)
    join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    return Block(join([h for _, h in items]).astype(U), *map(join, (first, length, item, place)), [name for name, _ in items])


_BLOCKS: dict[tuple[str, int], list[Block]] = {}


def _blocks(uri: str, window: int) -> Iterator[Block]:
    """The benchmark in blocks of at most ``BLOCK_WORDS`` words and one item more; a single block stays in the worker."""
    if (uri, window) in _BLOCKS:
        yield from _BLOCKS[uri, window]
        return
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    items, words, made = [], 0, []
    for batch in ds.dataset(path, format="parquet", filesystem=store).to_batches(batch_size=1024):
        for name, hashes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            items.append((name, np.asarray(hashes.values).view(U)))
            words += len(items[-1][1])
            if words >= BLOCK_WORDS:
                made.append(None)
                yield _block(items, window)
                items, words = [], 0
    last = _block(items, window)
    if not made:
        _BLOCKS.clear()
        _BLOCKS[uri, window] = [last]
    yield last


def write_benchmark(benchmark: DataFrame, scratch: Scratch) -> str:
    """Writes (item_id as text, word hashes) of the items that have words and an id; returns the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for part in _text.slices(batch.column(1)):
                found, rows = _text.words(part, _text.ALNUM), part.last - part.first
                h = np.where(found.hashes == 0, U(1), found.hashes).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows).cast(pa.string()), pa.ListArray.from_arrays(pa.array(found.offsets, pa.int32()), pa.array(h))],
                    names=["item_id", "words"],
                )
                first += rows

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null")
    table = scratch.write(items.mapInArrow(run, "item_id string, words array<long>").where("size(words) > 0"))
    return table.inputFiles()[0].rpartition("/")[0] if table.inputFiles() else ""


class SuffixArray:
    """Suffixes of a shard's word hashes in order of their words, sorted to at least ``depth`` words."""

    def __init__(self, hashes: np.ndarray, depth: int):
        self.vocabulary, rank = np.unique(hashes, return_inverse=True)
        n = len(hashes)
        self.ranks = np.concatenate([rank.astype(np.int64), np.full(depth + 1, -1, np.int64)])  # the end sorts first
        order, level = None, rank.astype(np.int64) + 1
        sorted_to, todo = 1, np.arange(n)
        while True:
            padded = np.concatenate([level, np.zeros(2 * sorted_to, np.int64)])
            key = (padded[todo] << (2 * BITS)) | (padded[todo + sorted_to] << BITS) | padded[todo + 2 * sorted_to]
            by = np.argsort(key)
            place, key = todo[by], key[by]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            if order is None:
                order, slots = place, np.arange(n)
            else:
                order[slots] = place
            # A group keeps the rank of its first slot, so ranks of suffixes sorted before stay as they are.
            group = np.maximum.accumulate(np.where(new, slots, 0))
            level = level.copy()
            level[place] = group + 1
            sorted_to *= 3
            alone = new & np.concatenate([new[1:], [True]])
            if sorted_to >= depth or alone.all():
                break
            slots = slots[~alone]
            todo = order[slots]
        self.order = order

    def ranges(self, words: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, low, high): for each sequence ``words[first : first + length]`` that occurs, its range in ``order``."""
        spot = np.searchsorted(self.vocabulary, words)
        known = self.vocabulary[np.minimum(spot, len(self.vocabulary) - 1)] == words
        missing = np.concatenate([[0], np.cumsum(~known)])
        which = np.flatnonzero(missing[first + length] == missing[first])
        first, length = first[which], length[which]
        low = self._bound(spot, first, length, False)
        high = self._bound(spot, first, length, True)
        found = high > low
        return which[found], low[found], high[found]

    def _bound(self, words: np.ndarray, first: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
        low, high = np.zeros(len(first), np.int64), np.full(len(first), len(self.order), np.int64)
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                return low
            middle = (low[live] + high[live]) >> 1
            at, f, n = self.order[middle], first[live], length[live]
            side = np.zeros(len(live), np.int64)
            for k in range(int(n.max(initial=0))):
                undecided = np.flatnonzero((side == 0) & (n > k))
                if not len(undecided):
                    break
                side[undecided] = np.sign(self.ranks[at[undecided] + k] - words[f[undecided] + k])
            right = side <= 0 if after else side < 0
            low[live[right]] = middle[right] + 1
            high[live[~right]] = middle[~right]


def _occurrences(hashes: np.ndarray, block: Block, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in ``hashes``, windows of ``block``) of every match, some millions at a time."""
    for start in range(0, len(hashes), SHARD_WORDS):
        shard = hashes[start : start + SHARD_WORDS + window - 1]
        array = SuffixArray(shard, window)
        which, low, high = array.ranges(block.hashes, block.first, block.length)
        total = np.cumsum(high - low)
        at = 0
        while at < len(which):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 22), "right")))
            size = high[at:end] - low[at:end]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            yield start + array.order[np.repeat(low[at:end], size) + inside], np.repeat(which[at:end], size)
            at = end


class Judged(NamedTuple):
    """Of each document in a run of documents: words, hit words, and the sorted ids of the items found."""

    n_words: np.ndarray
    n_hit: np.ndarray
    items: list[list[str]]


def _groups(column: pa.Array, most_words: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, offsets) of consecutive documents, about ``most_words`` words at a time; a 0 ends each document."""
    hashes, counts, size = [], [], 0
    for part in _text.slices(column):
        found = _text.words(part, _text.ALNUM)
        n = np.diff(found.offsets)
        h = np.where(found.hashes == 0, U(1), found.hashes)
        hashes.append(np.insert(h, found.offsets[1:], U(0)))
        counts.append(n + 1)
        size += len(h) + len(n)
        if size >= most_words:
            yield np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            hashes, counts, size = [], [], 0
    if counts:
        yield np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def judge(column: pa.Array, uri: str, window: int) -> Iterator[Judged]:
    for hashes, offsets in _groups(column):
        marks = np.zeros(len(hashes) + 1, np.int64)
        found: list[set[str]] = [set() for _ in range(len(offsets) - 1)]
        for block in _blocks(uri, window) if uri else ():
            for at, which in _occurrences(hashes, block, window):
                np.add.at(marks, at, 1)
                np.add.at(marks, at + block.length[which], -1)
                pairs = np.unique((np.searchsorted(offsets, at, "right") - 1) * len(block.names) + block.item[which])
                for pair in pairs.tolist():
                    found[pair // len(block.names)].add(block.names[pair % len(block.names)])
        hit = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
        yield Judged(np.diff(offsets) - 1, hit[offsets[1:]] - hit[offsets[:-1]], [sorted(x) for x in found])


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """How much of each document lies in verbatim benchmark passages; one row for each row of ``docs``.

    Returns doc_id, n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256 (of the found
    item_ids, sorted as text and joined by commas) and contaminated. Words are runs of ASCII letters and digits
    and of bytes beyond ASCII, A-Z lower-cased. A window is ``window`` consecutive words of an item, or all of a
    shorter item that has words. Null and empty texts have no words; items without words or id find nothing;
    repeated item_ids count once; repeated rows are judged alike. Empty tables give no rows or no hits.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        uri = write_benchmark(benchmark, scratch)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                first = 0
                for x in judge(batch.column(1), uri, window):
                    rows = len(x.items)
                    digest = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in x.items]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(first, rows), pa.array(x.n_words, pa.int64()), pa.array(x.n_hit, pa.int64()),
                            pa.array([len(i) for i in x.items], pa.int64()), pa.array(digest), pa.array(x.n_hit > 0),
                        ],
                        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                    )
                    first += rows

        kind = docs.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
        return docs.select("doc_id", "text").mapInArrow(run, schema).checkpoint()


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The longest verbatim matches: (doc_id, word_start, n_words, item_id, item_word_start), each at least a window.

    Words, windows and odd cases as in ``overlaps``: null and empty texts and items without words or id match nothing, repeated rows match alike,
    a passage that an item holds several times is a match for each place, and empty tables give no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        uri = write_benchmark(benchmark, scratch)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, base = batch.column(0), 0
                for hashes, offsets in _groups(batch.column(1)):
                    for block in _blocks(uri, window) if uri else ():
                        found = list(_occurrences(hashes, block, window))
                        if not found:
                            continue
                        at, which = (np.concatenate(x) for x in zip(*found, strict=True))
                        doc = np.searchsorted(offsets, at, "right") - 1
                        item, place = block.item[which], block.place[which]
                        by = np.lexsort([at, at - place, item, doc])
                        at, doc, item, place, length = at[by], doc[by], item[by], place[by], block.length[which][by]
                        new = np.ones(len(at), bool)
                        same = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1])
                        new[1:] = ~(same & (at[1:] == at[:-1] + 1) & (place[1:] == place[:-1] + 1))
                        first = np.flatnonzero(new)
                        last = np.append(first[1:], len(at)) - 1
                        yield pa.RecordBatch.from_arrays(
                            [
                                ids.take(pa.array(doc[first] + base)), pa.array(at[first] - offsets[doc[first]], pa.int64()),
                                pa.array(at[last] + length[last] - at[first], pa.int64()),
                                pa.array([block.names[i] for i in item[first]], pa.string()), pa.array(place[first], pa.int64()),
                            ],
                            names=["doc_id", "word_start", "n_words", "item_id", "item_word_start"],
                        )
                    base += len(offsets) - 1

        kind = docs.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {kind}, word_start long, n_words long, item_id string, item_word_start long"
        return docs.select("doc_id", "text").mapInArrow(run, schema).checkpoint()


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the documents that contain a window of the benchmark; all columns stay.

    Null and empty texts hold no window and stay. Each row is judged by its own text, so repeated rows go or stay together. An empty
    benchmark leaves everything. The rows are written to the shared folder before the benchmark's tables are removed.
    """
    text = docs.columns.index("text")
    with Scratch(docs.sparkSession) as scratch:
        uri = write_benchmark(benchmark, scratch)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = [x.n_hit for x in judge(batch.column(text), uri, window)]
                if hit:
                    yield batch.filter(pa.array(np.concatenate(hit) == 0))

        return docs.mapInArrow(run, docs.schema).checkpoint()
