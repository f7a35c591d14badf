"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard confirmation, distributed union-find.

Lines are normalised (case, white space). Equal lines share a digest and are one node. ``bands`` bands of three
MinHash values find candidates (a pair of similarity 0.8 shares none with probability 2e-4 for twelve bands, before what other
members of its component add); candidates are confirmed on their full shingle sets, and one line stays of each component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestep.llm import _text
from lodestep.llm._shared import Scratch, forget_shuffles, fresh, partitions
from lodestep.llm.graph import SKETCH, SKETCH_SCHEMA, Keys, Links, differences, odd_sketches

U = np.uint64
ROWS = 3
#: So many lines a task remembers, to give a line's text out, and work its keys out, once where its copies lie close.
REMEMBERED = 1 << 18


def normalise(line: str) -> str:
    return " ".join(line.lower().split())


def _shingles(lines: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``size``-character shingle of each line, and the lines' offsets; a shorter line is one shingle. No line is empty."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    start = np.cumsum(length) - length
    count = np.maximum(length - size + 1, 1)
    offsets = np.concatenate([[0], np.cumsum(count)])
    total = np.zeros(len(codes) + size, U)  # what the last windows reach beyond the text is never used
    np.cumsum(codes * _text.powers(len(codes)), out=total[1 : len(codes) + 1])
    back = _text.inverse_powers(len(codes))
    begins = np.repeat(np.tile([True, False], len(lines)), np.stack([count, length - count], 1).ravel())  # not within a line's last characters
    h = ((total[size:] - total[:-size]) * back)[begins]
    short = np.flatnonzero(length < size)
    if len(short):
        at = start[short]
        h[offsets[short]] = (total[at + length[short]] - total[at]) * back[at] + length[short].astype(U)
    return _text.mix(h), offsets


def _band_keys(hashes: np.ndarray, offsets: np.ndarray, bands: int) -> np.ndarray:
    """A row of keys for each line, a key for each band; every line has a shingle."""
    rng = np.random.Generator(np.random.PCG64(99))
    a = rng.integers(0, 2**31, bands * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, bands * ROWS, dtype=np.uint32)
    x = (hashes >> U(32)).astype(np.uint32)
    work, least = np.empty_like(x), np.empty((bands * ROWS, len(offsets) - 1), np.uint32)
    for i in range(bands * ROWS):
        np.multiply(x, a[i], out=work)
        np.add(work, b[i], out=work)
        np.minimum.reduceat(work, offsets[:-1], out=least[i])
    keys = np.zeros((bands, len(offsets) - 1), U)
    for i in range(ROWS):
        keys = _text.mix(keys * U(0x9E3779B97F4A7C15) + least[i::ROWS].astype(U) + np.arange(i + 1, bands * ROWS + 1, ROWS, dtype=U)[:, None])
    return keys.T.view(np.int64)


def _runs(texts: list[str | None], least: int, most_chars: int = 1 << 17) -> Iterator[list[tuple[int, int, int, int, str]]]:
    """(row, line number, first and end character, normalised line) of the lines long enough to judge, some at a time."""
    out, size = [], 0
    for row, text in enumerate(texts):
        at = 0
        for number, line in enumerate((text or "").split("\n")):
            plain = normalise(line)
            if plain and len(plain) >= least:
                out.append((row, number, at, at + len(line), plain))
                size += len(plain)
                if size >= most_chars:
                    yield out
                    out, size = [], 0
            at += len(line) + 1
    if out:
        yield out


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The batches cut small, so that few texts are Python strings at a time however long the texts are."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def _digests(lines: tuple[str, ...]) -> tuple[list[bytes], np.ndarray]:
    """128-bit digests, as bytes and as two whole numbers each."""
    import xxhash

    raw = [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines]
    return raw, np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)


def lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, text_hash, line, first_char, end_char, node, d2, plain) of every line long enough to judge.

    ``node`` and ``d2`` are the digest's halves. ``plain``, the normalised line, is null where a task has given it before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in _pieces(batches):
            for some in _runs(batch.column(2).to_pylist(), least_chars):
                row, number, start, end, plain = zip(*some, strict=True)
                raw, digest = _digests(plain)
                given = []
                for text, d in zip(plain, raw, strict=True):
                    given.append(None if d in seen else text)
                    seen.add(d)
                if len(seen) > REMEMBERED:
                    seen.clear()
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows), batch.column(1).take(rows), pa.array(number, pa.int64()), pa.array(start, pa.int64()),
                        pa.array(end, pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(given, pa.string()),
                    ],
                    names=["doc_id", "text_hash", "line", "first_char", "end_char", "node", "d2", "plain"],
                )

    return docs.mapInArrow(run, "doc_id long, text_hash long, line long, first_char long, end_char long, node long, d2 long, plain string")


def line_keys(shingle: int, bands: int) -> Keys:
    """Of batches (node, plain): (node, size, keys), once for each node where its rows lie close; the size is not used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _pieces(batches, 1024):
            fresh_rows = _unseen(batch, seen)
            if len(seen) > REMEMBERED:
                seen.clear()
            plain = fresh_rows.column(1).to_pylist()
            for first, last in _by_chars(plain, 1 << 17):
                keys = _band_keys(*_shingles(plain[first:last], shingle), bands)
                ends = pa.array(np.arange(0, keys.size + 1, bands), pa.int32())
                keys = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(keys).ravel()))
                yield pa.RecordBatch.from_arrays([fresh_rows.column(0).slice(first, last - first), pa.array(np.zeros(last - first, np.int64)), keys], names=["node", "size", "keys"])

    return run


def _unseen(batch: pa.RecordBatch, seen: set[int]) -> pa.RecordBatch:
    """The rows of ``batch`` whose first column is not in ``seen``, one for each, which then are in it."""
    keep = []
    for i, node in enumerate(batch.column(0).to_pylist()):
        if node not in seen:
            seen.add(node)
            keep.append(i)
    return batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))


def _by_chars(plain: list[str], most: int) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of lines of ``most`` characters together at most; a longer line is a run of its own."""
    at = 0
    while at < len(plain):
        end, size = at, 0
        while end < len(plain) and (end == at or size + len(plain[end]) <= most):
            size += len(plain[end])
            end += 1
        yield at, end
        at = end


def _set_runs(plain: list[str], shingle: int, most_chars: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, hashes, offsets): the distinct shingles of each line, sorted, for some lines at a time."""
    for at, end in _by_chars(plain, most_chars):
        yield at, end, *_text.distinct(*_shingles(plain[at:end], shingle))


def _sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each line, sorted."""
    for _, _, h, offsets in _set_runs(column.to_pylist(), shingle):
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            yield h[a:b]


def sketched(found: DataFrame, shingle: int) -> DataFrame:
    """(node, items, n, sketch) of (node, items): the size and the odd sketch of each line's shingle set. All rows of a node lie in one partition; one of them counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _pieces(batches, 1024):
            batch = _unseen(batch, seen)
            for first, last, h, offsets in _set_runs(batch.column(1).to_pylist(), shingle):
                some = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.diff(offsets), pa.int32()), *odd_sketches(h, offsets)], names=["node", "items", "n", *SKETCH])

    return found.mapInArrow(run, f"node long, items string, n int, {SKETCH_SCHEMA}")


def line_links(shingle: int, percent: int):
    """Of pairs (a, b, x, y) of lines, those whose whole shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 1024):
            keep = []
            for x, y in zip(_sets(batch.column(2), shingle), _sets(batch.column(3), shingle), strict=True):
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return lambda pairs: pairs.mapInArrow(run, "a long, b long")


def _distinct_lines(found: DataFrame) -> DataFrame:
    """(node, clash, several, first_doc): whether unlike digests share the node, whether it occurs more than once, and its least doc_id."""
    return found.withColumn("place", F.xxhash64("doc_id", "text_hash", "line")).groupBy("node").agg(
        (F.min("d2") != F.max("d2")).alias("clash"), (F.min("place") != F.max("place")).alias("several"), F.min("doc_id").alias("first_doc"),
    )


def _dealt(found: DataFrame, scratch: Scratch) -> DataFrame:
    """``found``, written in buckets by node: all that follows reads lines by their node."""
    out = scratch.dealt(found.repartition(partitions(found.sparkSession), "node"), "node")
    forget_shuffles(found.sparkSession)
    return out


def _told_apart(found: DataFrame) -> DataFrame:
    """``found`` with a node of its own for every digest that shares its first half with another one."""
    shared = found.groupBy("node").agg(F.min("d2").alias("first_d2"), F.max("d2").alias("last_d2")).where("first_d2 != last_d2").drop("last_d2")
    own = F.when(F.col("d2") != F.col("first_d2"), F.xxhash64("node", "d2")).otherwise(F.col("node"))
    return found.join(shared, "node", "left").withColumn("node", own).select(*found.columns)


def _labels(found: DataFrame, shingle: int, percent: int, bands: int, scratch: Scratch) -> DataFrame | None:
    """(node, component) of the lines that have links to unlike lines; None without any."""
    texts = found.where("plain is not null").select("node", "plain")

    def sets_of(nodes: DataFrame) -> DataFrame:
        near = texts.join(nodes.hint("shuffle_hash"), "node", "left_semi").withColumnRenamed("plain", "items")
        return scratch.dealt(sketched(near, shingle), "node")

    search = Links(sets_of, percent, F.lit(True), scratch, verify=line_links(shingle, percent), items_of=differences(lambda column: _sets(column, shingle)))
    return search.components(texts, line_keys(shingle, bands))


def line_groups(docs: DataFrame, shingle: int = 8, percent: int = 80, bands: int = 12, least_chars: int = 1) -> DataFrame:
    """Lines that have equal or near-equal lines elsewhere, and which one of each group stays.

    Returns (doc_id, text_hash, line, first_char, end_char, component, kept) for every line in a group of two or more;
    the line with the least doc_id, then the least line number, stays. Two lines are linked when the Jaccard similarity of
    their character-shingle sets is at least ``percent`` / 100; groups are the connected components. Lines of fewer
    than ``least_chars`` normalised characters are not judged; with 1, only blank ones are not. Null and empty texts have no lines; rows
    without a doc_id take no part; ``text_hash`` tells rows apart that share a doc_id, and rows that repeat both count as one.
    """
    with Scratch(docs.sparkSession) as scratch:
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").where("doc_id is not null")
        found = _dealt(lines(docs, least_chars), scratch)
        distinct = scratch.write(_distinct_lines(found))
        if not distinct.where("clash").isEmpty():  # two texts were one node: begin again with a node for each
            found = _dealt(_told_apart(found), scratch)
            distinct = scratch.write(_distinct_lines(found))
        labels = _labels(found, shingle, percent, bands, scratch)
        if labels is None:
            marked = distinct.where("several").withColumn("component", F.col("node"))
        else:
            joined = distinct.join(labels, "node", "left").where("component is not null or several")
            marked = joined.withColumn("component", F.coalesce("component", "node"))
        marked = scratch.write(marked.select("node", "component", "first_doc"))
        groups = marked.groupBy("component").agg(F.min("first_doc").alias("first_doc"))
        owners = scratch.write(marked.select("node", "component").join(groups, "component"))
        grouped = scratch.write(found.drop("plain", "d2").join(owners, "node").distinct().drop("node"))  # rows that repeat have one node
        first = grouped.where("doc_id = first_doc").groupBy("component").agg(F.min(F.struct("line", "text_hash")).alias("first"))
        result = grouped.join(first, "component").withColumn(
            "kept", F.expr("doc_id = first_doc and line = first.line and text_hash = first.text_hash")
        )
        return result.select("doc_id", "text_hash", "line", "first_char", "end_char", "component", "kept").checkpoint()


def remove_lines(docs: DataFrame, drop_emptied: bool = False, **how: int) -> DataFrame:
    """``docs`` without the lines that repeat another line; ``n_chars`` counts the new text where that column exists.

    Rows stay, unless ``drop_emptied``: then a row goes when it held lines that were judged and nothing but white space
    is left of it, as all it said stays elsewhere. Null, empty and blank texts and rows without a doc_id stay as they are. Rows of one doc_id and one
    text are treated alike, so a text that only such rows repeat stays in each. Columns of any name pass through.
    """
    doc, text_hash, gone_lines = fresh(docs, "gone_doc", "gone_hash", "gone_lines")
    gone = line_groups(docs, **how).where("not kept").groupBy(
        F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash)
    ).agg(F.collect_set("line").alias(gone_lines))  # of one document's lines
    joined = docs.join(gone, (docs["doc_id"].cast("long") == F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(text_hash)), "left")
    left = F.filter(F.split(docs["text"], "\n"), lambda x, i: ~F.array_contains(gone_lines, i.cast("long")))
    new = F.when(F.col(gone_lines).isNull(), docs["text"]).otherwise(F.array_join(left, "\n"))
    changed = {"text": new.alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col(gone_lines).isNull(), docs["n_chars"]).otherwise(F.length(new).cast(kind)).alias("n_chars")
    if drop_emptied:
        joined = joined.where(F.col(gone_lines).isNull() | new.rlike(r"\S"))
    return joined.select(*[changed.get(c, docs[c]) for c in docs.columns])
