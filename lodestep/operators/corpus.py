"""Corpus algebra: candidate types, contrastive pairs, validation, keyed logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestep.functions import patterns as P

RANK = {"high": 3, "medium": 2, "low": 1}


def candidate_type(correct: Column, matches: Column, mechanism: Column, gap: Column, source: Column) -> Column:
    """Struct (type, confidence, decided_by). A judged mechanism decides before the gap, the gap before the approach."""
    def said(kind: str, confidence: str, by: str) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), F.lit(by).alias("decided_by"))

    right = F.coalesce(correct, F.lit(False))
    return (
        F.when(~right & matches.eqNullSafe(True), said("C", "low", "answer+approach"))
        .when(~right, said("D", "high", "answer_only"))
        .when(mechanism.isin(P.MECHANISMS_SOUND), said("A", "high", "answer+mechanism"))
        .when(mechanism.isin(P.MECHANISMS_FLAWED), said("B", "high", "answer+mechanism"))
        .when(gap & (source == "claude_api_block"), said("B", "high", "answer+thinking_gap"))
        .when(gap, said("B", "medium", "answer+thinking_gap"))
        .when(matches.eqNullSafe(False), said("B", "medium", "answer+approach"))
        .when(matches, said("A", "high", "answer+approach"))
        .otherwise(said("A", "low", "answer_only"))
    )


def wire_pairs(df: DataFrame) -> DataFrame:
    """Adds anchor, negative, pair_id and cross_model to (grp, type, model, ...): what a group holds decides, so one row a group is joined back."""
    models = lambda t: F.array_sort(F.collect_set(F.when(F.col("type") == t, F.col("model"))))
    groups = df.groupBy("grp").agg(models("A").alias("_a"), models("B").alias("_b"))
    joined = df.join(groups, "grp")
    anchor, negative = (F.col("type") == "A") & (F.size("_b") > 0), (F.col("type") == "B") & (F.size("_a") > 0)
    paired = anchor | negative
    return joined.withColumns(
        {"anchor": anchor, "negative": negative, "pair_id": F.when(paired, F.concat(F.col("grp").cast("string"), F.lit("_pair"))), "cross_model": paired & (F.col("_a") != F.col("_b"))}
    ).drop("_a", "_b")


def best_pairs(df: DataFrame) -> DataFrame:
    """(grp, a_pos, b_pos, cross_model, conf): each group's best A and B, different models first, then confidence, then position.

    For each group, type and model only the best candidate can be in the best pair, so candidates meet as one row for each model.
    """
    rank = F.lit(0)
    for name, value in RANK.items():
        rank = F.when(F.col("confidence") == name, value).otherwise(rank)
    best = df.where(F.col("type").isin("A", "B")).groupBy("grp", "type", "model").agg(F.max(F.struct(rank.alias("conf"), (-F.col("pos")).alias("at"))).alias("m"))
    side = lambda t, p: best.where(F.col("type") == t).select("grp", F.col("model").alias(f"{p}_model"), F.col("m.conf").alias(f"{p}_conf"), (-F.col("m.at")).alias(f"{p}_pos"))
    pairs = side("A", "a").join(side("B", "b"), "grp")
    cross, conf = F.col("a_model") != F.col("b_model"), F.col("a_conf") + F.col("b_conf")
    top = pairs.groupBy("grp").agg(F.max(F.struct(cross.alias("cross_model"), conf.alias("conf"), (-F.col("a_pos")).alias("a"), (-F.col("b_pos")).alias("b"))).alias("t"))
    return top.select("grp", (-F.col("t.a")).alias("a_pos"), (-F.col("t.b")).alias("b_pos"), "t.cross_model", "t.conf")


def validate(df: DataFrame, checks: list[tuple[str, Column, float | None, float | None]]) -> DataFrame:
    """(name, passed, shown) of each (name, statistic, least, most) check; one aggregation, one row a check."""
    stats = df.agg(*[c.alias(n) for n, c, _, _ in checks])

    def row(name: str, lo: float | None, hi: float | None) -> Column:
        inside = F.lit(True) if lo is None else F.col(name) >= lo
        inside = inside if hi is None else inside & (F.col(name) <= hi if lo is not None else F.col(name) < hi)
        return F.struct(F.lit(name).alias("name"), inside.alias("passed"), F.round(F.col(name).cast("double"), 6).alias("shown"))

    return stats.select(F.inline(F.array(*[row(n, lo, hi) for n, _, lo, hi in checks])))


#: Fixed bounds of the checks that a corpus passes before training: bands of the rate of right answers by dataset, and the others.
CORRECT_BANDS = {"OmniMath": (0.40, 0.60), "OlympiadBench": (0.40, 0.60), "MATH": (0.55, 0.75)}
TOTAL, TYPE_B, LEAST_PAIRS, LEAST_GAP, LEAST_INCLUDED, LEAST_CLEAN, MOST_COST = (2650, 2750), (0.35, 0.55), 250, 0.15, 0.90, 0.80, 25.0


def validation_report(candidates: DataFrame, pairs: DataFrame, allow_small: bool = False) -> DataFrame:
    """(place, name, status, shown) of each check that a corpus has the rows for, then overall: PASS where none fails.

    ``candidates`` has dataset, answer_correct, candidate_type, has_extended_thinking, thinking_response_gap, include_in_training, quality_flags and
    total_cost_usd. With ``allow_small`` a failing check of a count is SKIP and does not count. A check of a rate without rows is
    left out; a null flag counts as false.
    """
    c, yes = F.col, lambda x: F.coalesce(x, F.lit(False)).cast("double")
    rate = lambda of, hit: F.avg(F.when(of, yes(hit)))
    share = lambda hit: F.coalesce(F.avg(yes(hit)), F.lit(0.0))
    inside = lambda x, lo, hi: x.between(lo, hi)
    every = [("total_candidates", F.count("*").cast("double"), lambda x: inside(x, *TOTAL), True)]
    every += [(f"{d}_correct_rate", rate(c("dataset") == d, c("answer_correct")), lambda x, b=b: inside(x, *b), False) for d, b in CORRECT_BANDS.items()]
    every += [
        ("type_b_of_correct", rate((c("dataset") == "OmniMath") & c("answer_correct"), c("candidate_type") == "B"), lambda x: inside(x, *TYPE_B), False),
        ("contrastive_pairs", F.first("_pairs").cast("double"), lambda x: x >= LEAST_PAIRS, True),
        ("thinking_gap_rate", rate(c("has_extended_thinking"), c("thinking_response_gap")), lambda x: x >= LEAST_GAP, False),
        ("included_rate", share(c("include_in_training")), lambda x: x >= LEAST_INCLUDED, False),
        ("clean_rate", share(F.size("quality_flags") == 0), lambda x: x >= LEAST_CLEAN, False),
        ("total_cost", F.coalesce(F.sum("total_cost_usd"), F.lit(0.0)), lambda x: x < MOST_COST, False),
    ]
    number = pairs.agg(F.count("*").alias("_n")).first()["_n"]
    stats = candidates.withColumn("_pairs", F.lit(number)).agg(*[F.coalesce(s, F.lit(float(number))).alias(n) if n == "contrastive_pairs" else s.alias(n) for n, s, _, _ in every])

    def row(i: int, name: str, passes, count: bool) -> Column:
        ok = passes(c(name))
        status = F.when(ok, "PASS").when(F.lit(allow_small and count), "SKIP").otherwise("FAIL")
        return F.when(c(name).isNotNull(), F.struct(F.lit(i).alias("place"), F.lit(name).alias("name"), status.alias("status"), F.round(name, 6).alias("shown")))

    rows = stats.select(F.array_compact(F.array(*[row(i, n, passes, count) for i, (n, _, passes, count) in enumerate(every)])).alias("r"))
    overall = F.struct(F.lit(len(every)).alias("place"), F.lit("overall").alias("name"), F.when(F.exists("r", lambda x: x["status"] == "FAIL"), "FAIL").otherwise("PASS").alias("status"), F.lit(None).cast("double").alias("shown"))
    return rows.select(F.inline(F.concat("r", F.array(overall))))


def labels_from(first_error: Column, n: Column) -> Column:
    """0 before the first error, 1 at it, -1 after; all 0 where the index is negative."""
    steps = F.sequence(F.lit(0), n - 1)
    return F.transform(steps, lambda j: F.when((first_error < 0) | (j < first_error), 0).when(j == first_error, 1).otherwise(-1))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
