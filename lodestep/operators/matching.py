"""Largest one-to-one matching of two classes on a line, within groups and a width.

Taking points in order and giving each the first free one of the other class that is still within the width leaves as few unmatched as can be.
Equal points are one with a count. The points of a group are swept in ranges; what still waits at a range's end is carried to
the next, and ranges are swept again while what they are handed changes, which is until the carries agree. The k-th matched
row of one class then meets the k-th of the other.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestep.operators import metrics as M
from lodestep.operators import resampling as R
from lodestep.sources.shared import written


def sweep(points: Iterator[tuple[float, int, int]], waiting: list[tuple[float, int, int]], width: float) -> tuple[list[tuple[float, int, int]], list[tuple[float, int, int]]]:
    """(matched, left): (value, rows of the first class, of the second) that are matched by the points of a range, and what still waits at its end.

    ``points`` are in order, as is ``waiting``, which came before them and is of one class.
    """
    queue, matched, last = deque([list(x) for x in waiting]), {}, None
    note = lambda value, a, b: matched.__setitem__(value, (matched.get(value, (0, 0))[0] + a, matched.get(value, (0, 0))[1] + b))
    for value, *counts in points:
        last = value
        while queue and value - queue[0][0] > width:
            queue.popleft()
        for cls in (0, 1):  # those who wait for this class take its new points first
            while queue and counts[cls] and queue[0][2 - cls]:
                head = queue[0]
                take = min(head[2 - cls], counts[cls])
                note(head[0], *((0, take) if cls == 0 else (take, 0)))
                note(value, *((take, 0) if cls == 0 else (0, take)))
                head[2 - cls] -= take
                counts[cls] -= take
                if not head[2 - cls]:
                    queue.popleft()
        both = 0 if queue else min(counts)
        if both:
            note(value, both, both)
            counts = [c - both for c in counts]
        if any(counts):
            queue.append([value, *counts])
    return [(v, a, b) for v, (a, b) in matched.items()], [tuple(x) for x in queue if last is None or last - x[0] <= width]


def matched_counts(points: DataFrame, exact: list[str], width: float) -> DataFrame:
    """(``exact``, _near, _a, _b): how many rows of either class are matched at each point of (``exact``, _range, _near, n_a, n_b)."""
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    keys = ", ".join(f"`{c}` {kinds[c]}" for c in exact)
    schema = f"{keys + ', ' if keys else ''}_range int, _out boolean, _near double, _a long, _b long"
    names = [*exact, "_range", "_out", "_near", "_a", "_b"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        given = sorted(zip(*[right[c].to_pylist() for c in ("_near", "_a", "_b")], strict=True))
        rows = sorted(zip(*[left[c].to_pylist() for c in ("_near", "n_a", "n_b")], strict=True))
        found, left_over = sweep(iter(rows), given, width)
        side = left if left.num_rows else right
        many = len(found) + len(left_over)
        same = [pa.array([side[c][0].as_py()] * many, side.schema.field(c).type) for c in (*exact, "_range")]
        out = [pa.array([False] * len(found) + [True] * len(left_over), pa.bool_())]
        return pa.Table.from_arrays([*same, *out, *[pa.array([x[i] for x in found + left_over], t) for i, t in enumerate((pa.float64(), pa.int64(), pa.int64()))]], names=names)

    ends = points.groupBy(*exact).agg(F.max("_range").alias("_last"))
    more = (ends.agg(F.max("_last")).first()[0] or 0) + 1
    carried, swept = None, None
    for _ in range(more):
        if carried is None:
            handed = points.sparkSession.createDataFrame([], schema)
        else:  # to the next range of the group, where there is one; ranges are numbered without gaps by their bounds, but some may be empty
            handed = carried
        grouped = points.groupBy(*exact, "_range").cogroup(handed.groupBy(*exact, "_range"))
        swept = written(grouped.applyInArrow(run, schema))
        if more == 1:
            break
        sent = swept.where("_out").join(ends, exact).where("_range < _last") if exact else swept.where("_out").crossJoin(F.broadcast(ends)).where("_range < _last")
        following = written(sent.select(*exact, (F.col("_range") + 1).cast("int").alias("_range"), "_out", "_near", "_a", "_b"))
        if carried is not None and following.exceptAll(carried).isEmpty() and carried.exceptAll(following).isEmpty():
            break
        carried = following
    return swept.where("not _out").groupBy(*exact, "_near").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))


def matched(df: DataFrame, key: str, positive: str, exact: list[str], near: str, width: float, each: int = 50_000, pile: int = 100_000) -> DataFrame:
    """(``exact``, a_key, b_key): as many rows of either class as can be paired one to one, equal in ``exact`` and at most ``width`` apart in ``near``.

    a is the class without ``positive``, b the one with it; both are paired in order of ``near``, equal points in order of ``key`` (by hash first where more than
    ``pile`` rows share a point, so that no task orders them all). Nulls, NaN and infinite points pair with nothing; ``key`` tells rows apart. A
    group of more than ``each`` distinct points is swept in ranges. An empty table gives no pairs.
    """
    columns = [F.col(key).alias("_key"), F.col(positive).alias("_pos"), *exact, F.col(near).cast("double").alias("_near")]
    rows = df.select(*columns).dropna().where("_near not in (double('inf'), double('-inf'))")
    counts = rows.groupBy(*exact, "_near").agg(F.count_if(~F.col("_pos")).alias("n_a"), F.count_if("_pos").alias("n_b"))
    points = written(M.ranged(counts, "_near", exact, each=each))
    hits = matched_counts(points, exact, width)
    # How many of either class are matched before a point: within its range by a window, before its range by the ranges' sums.
    at = points.join(hits, [*exact, "_near"])
    order = Window.partitionBy(*exact, "_range").orderBy("_near").rowsBetween(Window.unboundedPreceding, -1)
    inner = at.select(*exact, "_range", "_near", "n_a", "n_b", "_a", "_b", *[F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"{c}0") for c in ("_a", "_b")])
    sums = at.groupBy(*exact, "_range").agg(F.sum("_a").alias("sa"), F.sum("_b").alias("sb"))
    listed = sums.groupBy(*exact).agg(F.collect_list(F.struct("_range", "sa", "sb")).alias("_l"))  # a row for each range of a group
    before = lambda c: F.aggregate(F.filter("_l", lambda x: x["_range"] < F.col("_range")), F.lit(0).cast("long"), lambda a, x: a + x[c])
    whole = inner.join(listed, exact) if exact else inner.crossJoin(F.broadcast(listed))
    whole = whole.select(*exact, "_near", *[F.struct(F.col(f"n_{c}").alias("n"), F.col(f"_{c}").alias("m"), (F.col(f"_{c}0") + before(f"s{c}")).alias("k")).alias(f"_{c}") for c in ("a", "b")])
    placed = rows.join(whole, [*exact, "_near"]).select("_key", "_pos", *exact, "_near", F.when(F.col("_pos"), F.col("_b")).otherwise(F.col("_a")).alias("_m")).where("_m.m > 0")
    salted = placed.withColumn("_salt", F.when(F.col("_m.n") > pile, F.pmod(F.xxhash64("_key"), F.lit(64))).otherwise(0).cast("int"))
    place = F.row_number().over(Window.partitionBy(*exact, "_pos", "_near", "_salt").orderBy("_key"))
    large = salted.where(F.col("_m.n") > pile).groupBy(*exact, "_pos", "_near", "_salt").agg(F.count("*").alias("_n"))  # 64 rows for each ``pile`` rows at most
    upto = Window.partitionBy(*exact, "_pos", "_near").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = large.select(*exact, "_pos", "_near", "_salt", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    ranked = salted.withColumn("_place", place).join(starts, [*exact, "_pos", "_near", "_salt"], "left").withColumn("_place", F.col("_place") + F.coalesce("_start", F.lit(0)))
    kept = ranked.where("_place <= _m.m").select("_key", "_pos", *exact, (F.col("_m.k") + F.col("_place")).alias("_k"))
    side = lambda c, name: kept.where(c).select(*exact, "_k", F.col("_key").alias(name))
    return side("not _pos", "a_key").join(side("_pos", "b_key"), [*exact, "_k"]).select(*exact, "a_key", "b_key")


def pair_accuracy(pairs: DataFrame, ordered: Column, key: Column, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """(statistic, value, lo, hi, significant): the share of pairs that a score puts in the right order, and that less one half, with 95 % intervals by resampling pairs."""
    sums = R.poisson_sums(pairs, key, [ordered.cast("double"), F.lit(1.0)], draws, seed)
    return R.intervals(pairs.sparkSession, sums, {"accuracy": lambda s: s[:, 0] / s[:, 1], "above_chance": lambda s: s[:, 0] / s[:, 1] - 0.5})
