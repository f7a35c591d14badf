"""Repeated passages by hashing units of text: lines, cut further into sentences.

Units are normalised (white space, ASCII case), their digests grouped over all documents, the occurrence that ranks
first (least doc_id, then place) is kept and the others are marked. Marked units that follow each other form a
passage, reported with its offsets in the original text. ``repeats`` joins to each passage the words on both sides that also
stand beside its first occurrence, and reports passages of any length; ``repeated_passages`` gives runs of whole units.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestep.llm import _text
from lodestep.llm._shared import Scratch, fresh

U = np.uint64
#: A unit of fewer words says little alone: its digest takes in the unit before it.
SHORT = 5
_STOP = np.isin(np.arange(256), list(b".!?"))
_MULTIPLIERS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))


def _units(part: _text.Slice, sentences: bool, alone: bool) -> tuple[np.ndarray, ...]:
    """(text in the slice, place in the text, start, end, first word, words, digest, digest) of each unit; offsets in characters."""
    found = _text.words(part, _text.NON_SPACE)
    n = len(found.hashes)
    empty = np.zeros(0, np.int64)
    if not n:
        return (empty,) * 6 + (np.zeros(0, U),) * 2
    text = np.repeat(np.arange(len(found.offsets) - 1), np.diff(found.offsets))
    lines = np.concatenate([[0], np.cumsum(part.data == 10)])
    new = np.ones(n, bool)
    new[1:] = (text[1:] != text[:-1]) | (lines[found.starts[1:]] != lines[found.ends[:-1]])
    line = new.copy()
    if sentences:
        ends = found.ends[:-1]
        doubled = _STOP[part.data[np.maximum(ends - 2, 0)]] & (ends - 2 >= found.starts[:-1])
        new[1:] |= _STOP[part.data[ends - 1]] & ~doubled
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    place = np.arange(n) - np.repeat(first, last - first + 1)
    digests = []
    for k, m in enumerate(_MULTIPLIERS):
        weight = _text.mix((place + 1).astype(U) * m)
        digests.append(np.add.reduceat(_text.mix(found.hashes ^ U(k)) * (weight | U(1)), first))
    owner = text[first]
    leans = (last - first + 1 < SHORT) & np.concatenate([[False], owner[1:] == owner[:-1]])
    if alone:
        leans &= ~(line[first] & np.append(line, True)[last + 1])
    short = np.flatnonzero(leans)
    digests = [np.where(np.isin(np.arange(len(d)), short), _text.mix(d ^ _text.mix(np.roll(d, 1))), d) for d in digests]
    chars = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
    zero = chars[part.offsets[owner]]
    start, end = chars[found.starts[first]] - zero, chars[found.ends[last]] - zero
    number = np.arange(len(first)) - np.searchsorted(owner, owner)
    return owner, number, start, end, first - found.offsets[owner], last - first + 1, *digests


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash): ``text_hash`` tells rows apart that share a doc_id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).where("doc_id is not null")


def units(docs: DataFrame, sentences: bool = True, alone: bool = False) -> DataFrame:
    """(doc_id, text_hash, unit, first_char, end_char, first_word, words, h1, h2, first_here) for every unit that has words.

    With ``alone``, a short unit that is a whole line is judged by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch.column(1)):
                owner, number, start, end, word, words, h1, h2 = _units(part, sentences, alone)
                if not len(owner):
                    continue
                key = _text.mix(h1 ^ (h2 * U(3))) ^ _text.mix(owner.astype(U))
                first_here = np.zeros(len(owner), bool)
                first_here[np.unique(key, return_index=True)[1]] = True
                rows = pa.array(owner + part.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows), batch.column(2).take(rows), pa.array(number, pa.int64()),
                        pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(word, pa.int64()), pa.array(words, pa.int64()),
                        pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(first_here),
                    ],
                    names=["doc_id", "text_hash", "unit", "first_char", "end_char", "first_word", "words", "h1", "h2", "first_here"],
                )

    schema = "doc_id long, text_hash long, unit long, first_char long, end_char long, first_word long, words long, h1 long, h2 long, first_here boolean"
    return _texts(docs).mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, sentences: bool = True, least_words: int = 30) -> DataFrame:
    """(doc_id, first_char, end_char, n_words, n_units, first_doc_id): passages that repeat what ranks before them.

    Each is the longest run of consecutive units of a document that occurred before (in a document with a smaller
    doc_id, or earlier in the same one), if the run has ``least_words`` words or more. Offsets count the characters of the
    original text, white space around the passage left out. ``first_doc_id`` is the least document that keeps
    one of the units. Null, empty and blank texts have no units; rows without a doc_id take no part; rows that repeat a
    doc_id are the same document, so none repeats the other.
    """
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.write(units(docs, sentences).drop("text_hash", "first_word"))
        groups = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc_id")).where("n > 1").drop("n")
        groups = scratch.write(groups)  # a table of its own, so that a unit that is everywhere can be split over tasks
        marked = found.join(groups, ["h1", "h2"]).where("doc_id != first_doc_id or not first_here").distinct()
        marked = scratch.write(marked.select("doc_id", "unit", "first_char", "end_char", "words", "first_doc_id"))
        run = F.col("unit") - F.row_number().over(Window.partitionBy("doc_id").orderBy("unit"))
        passages = marked.withColumn("run", run).groupBy("doc_id", "run").agg(
            F.min("first_char").alias("first_char"), F.max("end_char").alias("end_char"), F.sum("words").alias("n_words"),
            F.count("*").alias("n_units"), F.min("first_doc_id").alias("first_doc_id"),
        )
        return passages.where(F.col("n_words") >= least_words).drop("run").checkpoint()


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Characters looked at beyond each end at first; what still matches there looks at four times as many in the next turn.
NEAR = 256


def _common(mine: str, theirs: str, mine_ends: bool, theirs_ends: bool) -> tuple[int, int, int, bool]:
    """(characters of each side, words, whether the pieces end before the match does) of the whole words that both begin with.

    A piece that does not end its text may cut its last word.
    """
    chars = other = n = 0
    left, right = _WORD.finditer(mine), _WORD.finditer(theirs)
    while True:
        a, b = next(left, None), next(right, None)
        if a is None or b is None:
            open_ = not ((a is None and mine_ends) or (b is None and theirs_ends))
            return chars, other, n, open_
        x, y = a[0].translate(_LOWER), b[0].translate(_LOWER)
        cut_x, cut_y = a.end() == len(mine) and not mine_ends, b.end() == len(theirs) and not theirs_ends
        if cut_x or cut_y:
            return chars, other, n, (cut_x or x.startswith(y)) and (cut_y or y.startswith(x)) and (x.startswith(y) or y.startswith(x))
        if x != y:
            return chars, other, n, False
        chars, other, n = a.end(), b.end(), n + 1


EDGE = "doc_id long, text_hash long, run long, side int, at long, o_doc long, o_hash long, o_at long, n long"


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges moved out over the words that match, and whether more may match."""
    for batch in batches:
        d = batch.to_pydict()
        at, o_at, n, more = [], [], [], []
        for side, a, b, k, mine, theirs, ends, o_ends in zip(
            d["side"], d["at"], d["o_at"], d["n"], d["mine"], d["theirs"], d["mine_ends"], d["theirs_ends"], strict=True
        ):
            chars, other, words, open_ = _common(mine[::side], theirs[::side], ends, o_ends)
            at.append(a + side * chars)
            o_at.append(b + side * other)
            n.append(k + words)
            more.append(open_)
        changed = {"at": pa.array(at, pa.int64()), "o_at": pa.array(o_at, pa.int64()), "n": pa.array(n, pa.int64())}
        names = [x.split()[0] for x in EDGE.split(", ")]
        yield pa.RecordBatch.from_arrays([changed.get(c, batch.column(c)) for c in names] + [pa.array(more, pa.bool_())], names=[*names, "more"])


PIECE = "doc_id long, text_hash long, side int, at long, piece string, ends boolean"


def _pieces(size: int):
    """From texts with the places that are asked for: the ``size`` characters beyond each, and whether the text ends there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [x.split()[0] for x in PIECE.split(", ")], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
        rows: list[tuple] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for doc, key, text, places in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text", "places")], strict=True):
                for p in places:
                    side, at = p["side"], p["at"]
                    rows.append((doc, key, side, at, *((text[max(at - size, 0) : at], at <= size) if side < 0 else (text[at : at + size], at + size >= len(text)))))
                    if len(rows) >= 20_000:
                        yield made()
                        rows.clear()
        if rows:
            yield made()

    return run


def _grow(edges: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The edges at the last word that matches outwards, in the passage and beside its first occurrence.

    A turn reads each text once, for all the places that are asked of it on either side, so a long text costs its length; a place that many
    passages meet is cut once, and they meet the piece, never the text.
    """
    texts, size, done = _texts(docs), NEAR, []
    key = ["doc_id", "text_hash", "side", "at"]
    while True:
        asked = edges.select(*key).union(edges.select("o_doc", "o_hash", "side", "o_at")).distinct()
        places = asked.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("side", "at")).alias("places"))  # of one text
        cut = places.join(texts, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "places").mapInArrow(_pieces(size), PIECE)
        cut = scratch.write(cut.dropDuplicates(key))  # rows that repeat a text
        mine = edges.join(cut.withColumnsRenamed({"piece": "mine", "ends": "mine_ends"}), key)
        theirs = cut.withColumnsRenamed({"doc_id": "o_doc", "text_hash": "o_hash", "at": "o_at", "piece": "theirs", "ends": "theirs_ends"})
        both = mine.join(theirs, ["o_doc", "o_hash", "side", "o_at"])
        moved = scratch.write(both.mapInArrow(_grown, f"{EDGE}, more boolean"))
        done.append(moved.where("not more").drop("more"))
        edges = moved.where("more").drop("more")
        if edges.isEmpty():
            break
        size *= 4
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out.distinct()


def repeats(docs: DataFrame, sentences: bool = True, least_words: int = 1, with_hash: bool = False) -> DataFrame:
    """(doc_id, first_char, end_char, n_words, n_units, first_doc_id): everything that repeats what ranks before it.

    Every unit but its first occurrence is marked, whatever its length; a short unit that is a whole line is judged by itself, another takes
    in the unit before it. A run of marked units is joined with the words before it that also stand before the first
    occurrence of its first unit, and with those after it that follow the first occurrence of its last unit, so a
    passage cut inside its sentences is reported to the word. Passages that then meet or overlap are one. Only
    ``least_words`` is asked of the result. ``n_units`` counts whole units. Odd rows are as in ``repeated_passages``; texts that share a
    doc_id have passages of their own, which the column text_hash tells apart if ``with_hash``.
    """
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.write(units(docs, sentences, alone=True))
        place = F.struct("doc_id", "unit", "text_hash", "first_char", "end_char")
        groups = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("o")).where("n > 1").drop("n")
        groups = scratch.write(groups)  # a table of its own, so that a unit that is everywhere can be split over tasks
        marked = found.join(groups, ["h1", "h2"]).where("doc_id != o.doc_id or not first_here")
        marked = scratch.write(marked.drop("h1", "h2", "first_here").distinct())
        run = F.col("unit") - F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("unit"))
        runs = scratch.write(marked.withColumn("run", run).groupBy("doc_id", "text_hash", "run").agg(
            F.min("first_char").alias("first_char"), F.max("end_char").alias("end_char"), F.min("first_word").alias("first_word"),
            F.max(F.col("first_word") + F.col("words")).alias("end_word"), F.count("*").alias("n_units"),
            F.min("o.doc_id").alias("first_doc_id"), F.min_by("o", "unit").alias("left"), F.max_by("o", "unit").alias("right"),
        ))
        edge = lambda side, at, o: runs.select(
            "doc_id", "text_hash", "run", F.lit(side).alias("side"), F.col(at).alias("at"), F.col(f"{o}.doc_id").alias("o_doc"),
            F.col(f"{o}.text_hash").alias("o_hash"), F.col(f"{o}.{at}").alias("o_at"), F.lit(0).cast("long").alias("n"),
        )
        edges = _grow(edge(-1, "first_char", "left").union(edge(1, "end_char", "right")), docs, scratch)
        ends = edges.groupBy("doc_id", "text_hash", "run").agg(*[
            F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{name}_{c}") for side, name in ((-1, "left"), (1, "right")) for c in ("at", "n")
        ])
        wide = runs.drop("left", "right").join(ends, ["doc_id", "text_hash", "run"]).select(
            "doc_id", "text_hash", "n_units", "first_doc_id", F.col("left_at").alias("first_char"), F.col("right_at").alias("end_char"),
            (F.col("first_word") - F.col("left_n")).alias("first_word"), (F.col("end_word") + F.col("right_n")).alias("end_word"),
        )
        order = Window.partitionBy("doc_id", "text_hash").orderBy("first_word", "end_word")
        before = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
        apart = wide.withColumn("new", F.coalesce(F.col("first_word") > before, F.lit(True)).cast("int"))
        passages = apart.withColumn("passage", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "text_hash", "passage").agg(
            F.min("first_char").alias("first_char"), F.max("end_char").alias("end_char"),
            (F.max("end_word") - F.min("first_word")).alias("n_words"), F.sum("n_units").alias("n_units"), F.min("first_doc_id").alias("first_doc_id"),
        )
        return passages.where(F.col("n_words") >= least_words).drop("passage", *([] if with_hash else ["text_hash"])).distinct().checkpoint()


@F.pandas_udf(StringType())
def _without(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Each text without its spans, which are in order and apart, in one pass; a text without spans as it is."""
    out = []
    for text, first, last in zip(texts, starts, ends, strict=True):
        if text is None or first is None or not len(first):
            out.append(text)
            continue
        out.append("".join([text[a:b] for a, b in zip([0, *last], [*first, len(text)], strict=True)]))
    return pd.Series(out, dtype=object)


def remove_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the passages cut out of their texts, each text in one pass; all columns stay.

    Where ``passages`` has text_hash, as ``repeats`` gives it on request, a passage is cut from the text that it was found in alone; without that
    column rows that share a doc_id must share a text. Null texts, rows without a doc_id and rows without passages stay as they are.
    Passages of a text must not overlap; repeated ones count once.
    """
    span_doc, span_hash, spans = fresh(docs, "span_doc", "span_hash", "spans")
    hashed = "text_hash" in passages.columns
    keys = [F.col("doc_id").alias(span_doc), *([F.col("text_hash").alias(span_hash)] if hashed else [])]
    found = passages.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("first_char", "end_char"))).alias(spans))  # of one text
    cut = _without(docs["text"], F.transform(spans, lambda s: s["first_char"]), F.transform(spans, lambda s: s["end_char"]))
    same = docs["doc_id"].cast("long") == F.col(span_doc)
    joined = docs.join(found, same & (F.xxhash64(docs["text"]) == F.col(span_hash)) if hashed else same, "left")
    return joined.select(*[cut.alias(c) if c == "text" else docs[c] for c in docs.columns])
