"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks. In a block each dimension has its list of candidates in order of value. The
queries read the lists in parallel, from both ends; what is met is scored in full, and a query stops at the depth
where the bound on anything unread, the query times the values last read, is below its k-th score. Queries whose bound has not
fallen when most of the block is met score it whole. Every query meets every block; a window merges at most k rows a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestep.llm._shared import Scratch

LONG = np.iinfo(np.int64)


def finite(embedding: Column) -> Column:
    """The components as doubles; null for a null vector or one with a null or non-finite component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), embedding.cast("array<double>"))


def whole(x: np.ndarray, factor: int = 64) -> np.ndarray:
    """floor(factor * x): as 64-bit numbers where they are small, else as Python's whole numbers, exact at any size."""
    if np.abs(x).max(initial=0) < 2.0**40:
        return np.floor(x * factor).astype(np.int64)
    exact = lambda v: int(v) * factor if abs(v) >= 2.0**53 else int(np.floor(v * factor))
    return np.array([[exact(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


class Lists:
    """Sorted lists of a block: ``order[i, d]`` is the candidate with the i-th largest value of dimension d."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        by_id = np.argsort(ids, kind="stable")  # so that the smaller id is the smaller place
        self.vectors, self.ids, self.rows = vectors[by_id], ids[by_id], rows[by_id]
        self.place = {int(r): i for i, r in enumerate(self.rows)}
        self.order = np.argsort(-self.vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, self.order, axis=0)

    def _numbers(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, vectors, sorted values) in the fastest kind of number that holds every inner product exactly."""
        most = int(np.abs(self.vectors).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(queries.shape[1], 1)
        kind = float if most < 1 << 53 else np.int64 if most < 1 << 63 else object
        return queries.astype(kind), self.vectors.astype(kind), self.sorted.astype(kind)

    def _best(self, scores: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of one query by score, then by place."""
        if len(scores) > k and scores.dtype != object:
            keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            scores, places = scores[keep], places[keep]
        ranked = sorted(range(len(scores)), key=lambda i: (-scores[i], places[i]))[:k]
        return places[ranked], scores[ranked]

    def top(self, queries: np.ndarray, own_rows: np.ndarray, k: int, first: int = 8) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For each query its (places, scores), the k best by score, then by place, without its own row; and how many candidates it scored.

        The queries read the lists together, both ends of each, twice as deep each time, until their bounds let them stop or most of
        the block has been met; those that are left then score it whole.
        """
        n, (q, v, ranked) = len(self.ids), self._numbers(queries)
        own = np.array([self.place.get(int(r), -1) for r in own_rows], np.int64)
        up, down = np.where(q > 0, q, 0 * q), np.where(q < 0, q, 0 * q)
        out: list = [None] * len(q)
        scored, left, depth = np.full(len(q), n), np.arange(len(q)), first
        while len(left) and depth < n:
            met = np.unique(np.concatenate([self.order[:depth].ravel(), self.order[n - depth :].ravel()]))
            if 4 * len(met) > 3 * n:
                break
            bounds = up[left] @ ranked[depth - 1] + down[left] @ ranked[n - depth]
            found = self._score(q[left], v, own[left], met, k)
            stops = np.array([len(s) == k and bound < s[-1] for (_, s), bound in zip(found, bounds, strict=True)], bool)
            for i, of in zip(left[stops], [f for f, s in zip(found, stops, strict=True) if s], strict=True):
                out[i] = of
            scored[left[stops]] = len(met)
            left, depth = left[~stops], 2 * depth
        for i, of in zip(left, self._score(q[left], v, own[left], np.arange(n), k), strict=True):
            out[i] = of
        return out, scored

    def _score(self, q: np.ndarray, v: np.ndarray, own: np.ndarray, places: np.ndarray, k: int, some: int = 256) -> list[tuple[np.ndarray, np.ndarray]]:
        """The k best of ``places`` for each query, by one product for ``some`` queries at a time."""
        out = []
        for first in range(0, len(q), some):
            for scores, mine in zip(q[first : first + some] @ v[places].T, own[first : first + some], strict=True):
                others = places != mine
                out.append(self._best(scores[others], places[others], k))
        return out


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones padded with zeros."""
    lists = column.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    row = np.repeat(np.arange(len(lists)), lengths)
    out[row, np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy(zero_copy_only=False)
    return whole(out)


def search(vectors: DataFrame, is_query: Column, k: int = 20, block_rows: int = 8192, query_rows: int = 4096, with_share: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with every other row; ties to the smaller vec_id.

    ``vectors`` has vec_id and embedding. Rows without an id, and vectors that are null or hold null or
    non-finite components, take no part. Vectors of different lengths are compared as if padded with zeros. Components and scores are
    whole numbers of any size; a score beyond 64 bits is ranked as it is and given as the nearest that fits. Rows that repeat a
    vec_id are candidates and queries of their own. With fewer than k other rows all are returned; without candidates none.
    ``with_share`` adds share_scored, the part of all rows that was scored in full for the query in the row's block.
    """
    with Scratch(vectors.sparkSession) as scratch:
        clean = vectors.select("vec_id", finite(F.col("embedding")).alias("v"), is_query.alias("q")).where("vec_id is not null and v is not null")
        clean = scratch.write(clean.withColumn("row", F.monotonically_increasing_id()))
        rows, asked, width = clean.agg(F.count("*"), F.count_if("q"), F.max(F.size("v"))).first()
        blocks, turns = max(1, -(-rows // block_rows)), max(1, -(-asked // query_rows))
        spread = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        candidates = clean.select("row", "vec_id", "v", spread(blocks).alias("block"), every(turns).alias("turn"))
        queries = clean.where("q").select(F.col("row").alias("q_row"), F.col("vec_id").alias("q_id"), F.col("v").alias("q_v"), spread(turns).alias("turn"), every(blocks).alias("block"))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            names = ("row", "query_id", "vec_id", "score", "high", "scored")
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            out: list[list] = [[] for _ in names]
            if left.num_rows and right.num_rows:
                lists = Lists(_matrix(left["v"], width or 0), left["vec_id"].to_numpy(), left["row"].to_numpy())
                own, ids = right["q_row"].to_numpy(), right["q_id"].to_numpy()
                found, scored = lists.top(_matrix(right["q_v"], width or 0), own, k)
                for row, query_id, (best, scores), n in zip(own.tolist(), ids.tolist(), found, scored.tolist(), strict=True):
                    exact = [int(s) for s in scores]
                    beyond = [str(s) if not LONG.min <= s <= LONG.max else None for s in exact]
                    columns = ([row] * len(best), [query_id] * len(best), lists.ids[best].tolist(), [min(max(s, LONG.min), LONG.max) for s in exact], beyond, [n] * len(best))
                    for column, x in zip(out, columns, strict=True):
                        column.extend(x)
            return pa.table({name: pa.array(x, kind) for name, x, kind in zip(names, out, kinds, strict=True)})

        grouped = candidates.groupBy("block", "turn").cogroup(queries.groupBy("block", "turn"))
        found = grouped.applyInArrow(run, "row long, query_id long, vec_id long, score long, high string, scored long")
        # Beyond 64 bits: more digits, then the digits, are larger above zero and smaller below it.
        big, sign = F.length(F.regexp_replace("high", "-", "")), F.when(F.col("score") > 0, 1).otherwise(-1)
        digits = F.when(F.col("score") > 0, F.col("high")).otherwise(F.translate("high", "0123456789", "9876543210"))
        order = Window.partitionBy("row").orderBy(F.desc("score"), F.desc(F.coalesce(sign * big, F.lit(0))), F.desc(F.coalesce(digits, F.lit(""))), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        share = [(F.col("scored") / F.lit(max(rows, 1))).alias("share_scored")] if with_share else []
        return ranked.select("query_id", "rank", "vec_id", "score", *share).checkpoint()
