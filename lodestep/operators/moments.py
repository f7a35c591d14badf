"""Sums of tables of numbers over all rows: folded up within each task, added up in a tree, as packed binary rows.

What a task gives is as large as the table that it sums, never as its rows. Tables are cut into pieces; pieces meet in sixteen
slots first and then as sixteen rows for each piece, so no task holds more than some pieces, and the driver gets each number once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE, SLOTS = 1 << 15, 16
_SCHEMA = "key long, slot int, piece int, data binary"
_NAMES = ["key", "slot", "piece", "data"]
Fold = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]]


def _row(key: int, slot: int, piece: int, numbers: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([slot], pa.int32()), pa.array([piece], pa.int32()), pa.array([numbers.tobytes()], pa.binary())], names=_NAMES)


def _leaves(fold: Fold) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId() % SLOTS
        for key, total in fold(batches):
            flat = np.ascontiguousarray(total, np.float64).ravel()
            for piece, at in enumerate(range(0, len(flat), PIECE)):
                yield _row(key, slot, piece, flat[at : at + PIECE])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int, int], np.ndarray] = {}
    for batch in batches:
        for key, slot, piece, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            numbers = np.frombuffer(data)
            at = (key, slot, piece)
            held[at] = held[at] + numbers if at in held else numbers
    for at, numbers in held.items():
        yield _row(*at, numbers)


def _meet(table: pa.Table) -> pa.Table:
    whole = np.sum([np.frombuffer(x) for x in table["data"].to_pylist()], axis=0)
    return pa.Table.from_batches([_row(table["key"][0].as_py(), 0, table["piece"][0].as_py(), whole)])


def tree_sum(df: DataFrame, fold: Fold) -> dict[int, np.ndarray]:
    """The sum over all tasks of the numbers that ``fold`` gives for each key from a task's rows; a key's numbers are always as many. Empty without any."""
    slots = df.mapInArrow(_leaves(fold), _SCHEMA).repartition("key", "piece", "slot").mapInArrow(_add, _SCHEMA)
    pieces: dict[int, dict[int, np.ndarray]] = {}
    for r in slots.groupBy("key", "piece").applyInArrow(_meet, _SCHEMA).toLocalIterator():
        pieces.setdefault(r["key"], {})[r["piece"]] = np.frombuffer(r["data"])
    return {key: np.concatenate([found[i] for i in sorted(found)]) for key, found in pieces.items()}


def whole_vectors(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """(the rows of ``df`` whose vector and its components are not null, and finite, the vectors' length).

    Vectors of unlike length, and none at all, are an error.
    """
    v = F.col(vector)
    rows = df.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    least, most = rows.agg(F.min(F.size(v)), F.max(F.size(v))).first()
    if least is None:
        raise ValueError(f"no row has a whole vector in {vector}")
    if least != most:
        raise ValueError(f"vectors of unlike length in {vector}: {least} to {most}")
    return rows, least


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """A column of lists, each of ``size`` numbers, as rows."""
    return np.asarray(column.flatten(), float).reshape(-1, size)


def packed(table: np.ndarray) -> np.ndarray:
    """The upper triangle of a square table."""
    return table[np.triu_indices(len(table))]


def unpacked(triangle: np.ndarray) -> np.ndarray:
    size = int((np.sqrt(8 * len(triangle) + 1) - 1) / 2)
    table = np.zeros((size, size))
    table[np.triu_indices(size)] = triangle
    return table + np.triu(table, 1).T


def gram(df: DataFrame, vector: str, size: int, numbers: list[Column], by: Column | None = None) -> dict[int, np.ndarray]:
    """For each value of ``by`` (0 without it), the sums of products of one, the vector's components and ``numbers``, as a square table of that order.

    Rows with a null among ``numbers`` are left out.
    """
    names = [f"x{i}" for i in range(len(numbers))]
    rows = df.select((F.lit(0) if by is None else by).cast("long").alias("by"), F.col(vector).cast("array<double>").alias("v"), *[x.cast("double").alias(n) for x, n in zip(numbers, names, strict=True)]).dropna()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.asarray(batch.column(0))
            x = np.column_stack([np.ones(batch.num_rows), matrix(batch.column(1), size), *[np.asarray(batch.column(i + 2), float) for i in range(len(names))]])
            for k in np.unique(key):
                own = x if len(tables) < 2 and (key == k).all() else x[key == k]
                if int(k) not in tables:
                    tables[int(k)] = np.zeros((x.shape[1],) * 2)
                for at in range(0, len(own), 4096):
                    part = own[at : at + 4096]
                    tables[int(k)] += part.T @ part
        for k, table in tables.items():
            yield k, packed(table)

    return {k: unpacked(v) for k, v in tree_sum(rows, fold).items()}
