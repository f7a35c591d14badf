"""Queries over matched pairs, bootstraps of thousands of draws and weighted epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestep.functions import text as T
from lodestep.operators import matching as K
from lodestep.operators import resampling as R
from lodestep.plans.control_queries import sweep_sql
from lodestep.plans.metric_queries import SCORED, scored
from lodestep.plans.registry import query
from lodestep.sources.tables import table

_BY_WORDS = f"select doc_id as key, source, pos, ln(1 + w) ll from {SCORED}"


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("ll", F.log1p("w"))
    pairs = K.matched(rows, "doc_id", "pos", ["source"], "ll", 0.1)
    score = lambda side: rows.select(F.col("doc_id").alias(f"{side}_key"), F.col("score").alias(f"{side}_score"))
    joined = pairs.join(score("a"), "a_key").join(score("b"), "b_key")
    return joined.select("source", F.col("a_key").alias("a_id"), F.col("b_key").alias("b_id"), (F.col("a_score") < F.col("b_score")).alias("ordered"))


@query(f"with recursive {sweep_sql(_BY_WORDS, 'source')} select z.source, a_key a_id, b_key b_id, x.score < y.score as ordered from z join {SCORED} x on x.doc_id = a_key join {SCORED} y on y.doc_id = b_key where a_key is not null")
def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many sound and unsound solutions of one source as can be paired one to one, log lengths at most a tenth apart, and whether the score puts a pair in order."""
    return _matched(spark, sf_dir)


@query()
def matched_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of matched pairs that a score puts in order, with the interval of 10,000 resamples of pairs."""
    pairs = _matched(spark, sf_dir)
    return K.pair_accuracy(pairs, F.col("ordered"), F.struct("a_id", "b_id"), 10_000, 67)


@query()
def f1_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of two rules and their difference with intervals of 10,000 resamples of documents, the same for all three."""
    rows = scored(spark, sf_dir)
    pos, short, even = F.col("pos"), F.col("w") < 200, F.col("score") % 2 == 0
    numbers = [c.cast("double") for rule in (short, even) for c in (pos & rule, ~pos & rule, pos & ~rule)]
    sums = R.poisson_sums(rows, F.col("doc_id"), numbers, 10_000, 68)
    first, second = (lambda s: R.f1_of(s[:, 0], s[:, 1], s[:, 2])), (lambda s: R.f1_of(s[:, 3], s[:, 4], s[:, 5]))
    return R.intervals(spark, sums, {"short": first, "even": second, "short_less_even": lambda s: first(s) - second(s)})


@query()
def judge_gap_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much better length, marks of formulas and lines together tell a judge's label than the human one, each label fitted anew in 2,000 resamples."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n_steps"), T.latex_density(F.col("text")).alias("latex"))
    rows = scored(spark, sf_dir).join(docs, "doc_id")
    levels = [F.round(F.log1p("w") * 4).alias("ll"), F.least(F.col("n_steps"), F.lit(20)).alias("steps"), F.round(F.col("latex") * 10).alias("latex")]
    judge = (F.col("score") % 3 == 0) | (F.col("w") < 50)
    return R.judge_gap(rows.select(*levels, F.col("pos").cast("int").alias("human"), judge.cast("int").alias("judge")), ["ll", "steps", "latex"], "human", "judge", 2_000, 69)


@query()
def weighted_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each order is drawn when as many draws as there are orders are made in proportion to priority and hardness."""
    hard = F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_custkey") % 100) / 100.0)
    priority = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(1)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (priority * (0.5 + F.coalesce(hard, F.lit(0.5)))).alias("w"))
    return R.weighted_epoch(rows, "k", "w", None, 70)
