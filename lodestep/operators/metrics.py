"""Ranking and agreement metrics as aggregations and windows; scores tie by average rank.

No window runs over a whole table or a whole group: ranks come from counts of distinct scores, which are dealt into ranges of
scores; each range is ordered alone and starts where those before it end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestep.functions import vectors as V


def score_counts(df: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """Positives and all rows for each distinct score in each group."""
    return df.groupBy(*by, score).agg(F.count_if(positive).alias("pos"), F.count("*").alias("n"))


#: Ranges that a group's distinct scores are dealt into at most, and the scores for which another range is made.
MOST_RANGES, RANGE_SCORES = 1024, 50_000


def ranged(counts: DataFrame, score: str, by: list[str], name: str = "_range", most: int = MOST_RANGES, each: int = RANGE_SCORES) -> DataFrame:
    """``counts`` with ``name``: the number from 0 of the range of its group's scores that a row is in, which never splits equal scores.

    Bounds are approximate quantiles of the rows' scores, one set a group and only for groups of more than ``each`` rows (of 16, for one group alone), so at
    most ``most`` numbers for each such group reach the driver, as with Spark's own range partitioning. They are collected once, so that two uses of the
    ranges agree. A null score is in the first range, NaN in the last.
    """
    steps = (most - 1).bit_length()
    marks = F.percentile_approx(score, F.array(*[F.lit(i / most) for i in range(1, most)]), F.lit(20 * most))
    least = each if by else 16
    rows = counts.groupBy(*by).agg(F.count(score).alias("_n"), marks.alias("_q")).where(F.col("_n") > least).collect()
    bounds = []
    for r in rows:
        kept = min(most, 1 << max(4 if not by else 1, (r["_n"] // each).bit_length()))
        bounds.append((*[r[c] for c in by], sorted(set(r["_q"][most // kept - 1 :: most // kept]))))
    if not bounds:
        return counts.withColumn(name, F.lit(0))
    kind = next(f.dataType for f in counts.schema.fields if f.name.lower() == score.lower())
    if by:
        schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in counts.select(*by).schema.fields], T.StructField("_bounds", T.ArrayType(kind))])
        table = counts.sparkSession.createDataFrame(bounds, schema)
        same = [counts[c].eqNullSafe(table[c]) for c in by]
        joined = counts.join(F.broadcast(table), same, "left").select(*[counts[c] for c in counts.columns], "_bounds")  # a row for each ``each`` rows at most
    else:
        joined = counts.withColumn("_bounds", F.array(*[F.lit(x).cast(kind) for x in bounds[0][-1]]))
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
    found = F.aggregate(halves, F.lit(0), lambda lo, half: lo + F.when(F.get("_bounds", lo + half - 1) <= F.col(score), half).otherwise(0))
    return joined.withColumn(name, F.coalesce(found, F.lit(0))).drop("_bounds")


def _in_order(parts: DataFrame, by: list[str], columns: list[str], descending: bool = False) -> DataFrame:
    """One row for each group with ``_parts``, its ranges' rows in order: at most ``MOST_RANGES``."""
    return parts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_range", *columns)), not descending).alias("_parts"), *[F.sum(c).alias(c) for c in columns])


def auc(df: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve by rank sum, ties by average rank; null where a class is missing. ``by`` may be empty."""
    counts = ranged(score_counts(df, score, positive, by), score, by)
    w = Window.partitionBy(*by, "_range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    neg = F.col("n") - F.col("pos")
    inner = counts.withColumn("_below", F.coalesce(F.sum(neg).over(w), F.lit(0)))
    parts = inner.groupBy(*by, "_range").agg(F.sum(F.col("pos") * (F.col("_below") + neg / 2.0)).alias("u"), F.sum("pos").cast("double").alias("p"), F.sum(neg).cast("double").alias("q"))
    start = F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("u"))
    whole = F.aggregate("_parts", start, lambda a, x: F.struct((a["q"] + x["q"]).alias("q"), (a["u"] + x["u"] + x["p"] * a["q"]).alias("u")))
    out = _in_order(parts, by, ["u", "p", "q"]).where("size(_parts) > 0")
    return out.select(*by, F.round(F.try_divide(whole["u"], F.col("p") * F.col("q")), 6).alias("auc"))


def average_precision(df: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """Step-wise average precision over distinct thresholds. ``by`` may be empty."""
    counts = ranged(score_counts(df, score, positive, by), score, by)
    parts = counts.groupBy(*by, "_range").agg(F.sum("pos").alias("p"), F.sum("n").alias("m"))
    start = F.struct(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("m"), F.expr("cast(array() as array<struct<_range: int, p: bigint, m: bigint>>)").alias("l"))
    before = lambda a, x: F.struct(
        (a["p"] + x["p"]).alias("p"), (a["m"] + x["m"]).alias("m"), F.concat(a["l"], F.array(F.struct(x["_range"].alias("_range"), a["p"].alias("p"), a["m"].alias("m")))).alias("l")
    )
    above = _in_order(parts, by, ["p", "m"], descending=True).select(*by, F.inline(F.aggregate("_parts", start, before)["l"])).withColumnsRenamed({"p": "_p0", "m": "_m0"})
    w = Window.partitionBy(*by, "_range").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.select(*by, "_range", "pos", F.sum("pos").over(w).alias("tp"), F.sum("n").over(w).alias("seen"))
    joined = cum.join(above, [cum[c].eqNullSafe(above[c]) for c in (*by, "_range")]).select(*[cum[c] for c in by], "pos", (F.col("tp") + F.col("_p0")).alias("tp"), (F.col("seen") + F.col("_m0")).alias("seen"))
    out = joined.groupBy(*by).agg(F.sum(F.col("tp") / F.col("seen") * F.col("pos")).alias("s"), F.sum("pos").alias("p"))
    return out.select(*by, F.round(F.try_divide("s", "p"), 6).alias("average_precision"))


def precision_at(df: DataFrame, score: str, tie: str, positive: str, ks: list[int]) -> DataFrame:
    """Precision and lift among the k best rows, for each k that the table reaches; ties by ``tie``."""
    best = df.orderBy(F.desc(score), tie).limit(max(ks)).select(F.col(positive).cast("double").alias("hit"), score, tie)
    ranked = best.withColumn("rn", F.row_number().over(Window.orderBy(F.desc(score), tie)))
    base = df.agg(F.avg(F.col(positive).cast("double")).alias("base"), F.count("*").alias("n"))
    grid = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ks))).alias("k"))
    joined = ranked.join(F.broadcast(grid), F.col("rn") <= F.col("k")).groupBy("k").agg(F.avg("hit").alias("precision"))
    return joined.crossJoin(F.broadcast(base)).where("k <= n").select(
        "k", F.round("precision", 6).alias("precision_at_k"), F.round(F.try_divide("precision", "base"), 6).alias("lift")
    )


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """0 where nothing was found."""
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """2 x 2 counts of two 0/1 labellers with agreement, Cohen's kappa, recall and specificity of ``b`` against ``a``."""
    cell = lambda x, y: F.count_if((F.col(a) == x) & (F.col(b) == y)).cast("double")
    c = df.agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    po = (F.col("tp") + F.col("tn")) / n
    pe = ((F.col("tp") + F.col("fn")) * (F.col("tp") + F.col("fp")) + (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn"))) / (n * n)
    return c.select(
        *[F.col(x).cast("long").alias(x) for x in ("tp", "fp", "fn", "tn")], F.round(po, 6).alias("agreement"),
        F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"),
        F.round(F.try_divide("tn", F.col("tn") + F.col("fp")), 6).alias("specificity"),
    )


def retrieval(queries: DataFrame, targets: DataFrame, similarity: Column, own: Column) -> DataFrame:
    """Rank of each query's own target among all targets: recall at 1 and 10, mean reciprocal rank, median rank.

    ``targets`` is a set of stated size that each query is held against; the pairs are only counted.
    """
    pairs = queries.crossJoin(targets).withColumn("sim", similarity).withColumn("own", own)
    mine = Window.partitionBy("q_id")
    ranks = pairs.withColumn("own_sim", F.max(F.when(F.col("own"), F.col("sim"))).over(mine)).groupBy("q_id").agg(
        (1 + F.count_if(F.col("sim") > F.col("own_sim"))).alias("rank")
    )
    return _ranked(ranks)


def _ranked(ranks: DataFrame) -> DataFrame:
    return ranks.agg(
        F.round(F.avg((F.col("rank") <= 1).cast("double")), 6).alias("recall1"), F.round(F.avg((F.col("rank") <= 10).cast("double")), 6).alias("recall10"),
        F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"), F.percentile("rank", 0.5).alias("median_rank"),
    )


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), float)


def retrieval_ranks(vectors: DataFrame, is_query: Column, block_rows: int = 8192, query_rows: int = 4096) -> DataFrame:
    """(q_id, rank) of each query's own target, the vector of the next id, among every other row by cosine to nine digits.

    Rows are dealt into blocks by hash and queries into turns; a task counts what is nearer than the own target in one
    block for one turn, and the counts are summed, so no pair is a row. Vectors have one length; rows without an id or a vector, and
    queries without a target, take no part; ids are distinct.
    """
    unit = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), V.unit(F.col("embedding")).alias("v"), is_query.alias("q"))
    rows, asked = unit.agg(F.count("*"), F.count_if("q")).first()
    blocks, turns = max(1, -(-rows // block_rows)), max(1, -(-asked // query_rows))
    spread = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = unit.select((F.col("vec_id") - 1).alias("q_id"), F.col("v").alias("own"))
    asking = unit.where("q").select(F.col("vec_id").alias("q_id"), F.col("v").alias("q_v"))
    queries = asking.join(own, "q_id").select("q_id", "q_v", "own", spread("q_id", turns).alias("turn"), every(blocks).alias("block"))
    candidates = unit.select(F.col("vec_id").alias("other"), F.col("v").alias("other_v"), spread("vec_id", blocks).alias("block"), every(turns).alias("turn"))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, nearer = right["q_id"].to_numpy(), np.zeros(right.num_rows, np.int64)
        if left.num_rows and right.num_rows:
            others, other_ids = _rows(left["other_v"]), left["other"].to_numpy()
            asks = _rows(right["q_v"])
            least = np.round((asks * _rows(right["own"])).sum(1), 9)
            for first in range(0, len(ids), 256):
                some = slice(first, first + 256)
                above = np.round(asks[some] @ others.T, 9) > least[some, None]
                above &= (other_ids != ids[some, None]) & (other_ids != ids[some, None] + 1)
                nearer[some] = above.sum(1)
        return pa.table({"q_id": pa.array(ids, pa.int64()), "nearer": pa.array(nearer)})

    grouped = candidates.groupBy("block", "turn").cogroup(queries.groupBy("block", "turn"))
    return grouped.applyInArrow(count, "q_id long, nearer long").groupBy("q_id").agg((1 + F.sum("nearer")).alias("rank"))


def retrieval_whole(vectors: DataFrame, is_query: Column) -> DataFrame:
    """Recall at 1 and 10, mean reciprocal rank and median rank of ``retrieval_ranks``."""
    return _ranked(retrieval_ranks(vectors, is_query))
