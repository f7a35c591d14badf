"""Score panels, selection, sweeps, sampling plans and judge work lists: aggregations and windows within bounded groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestep.functions.rand import h, u
from lodestep.operators import metrics as M
from lodestep.operators import sampling as S


def chain_scores(steps: DataFrame) -> DataFrame:
    """(id, by_min, by_mean, b, steps) of (id, i, p, bad): one less the least and the mean step score, and whether a step is bad."""
    return steps.groupBy("id").agg(
        (1 - F.min("p")).alias("by_min"), F.round(1 - F.avg("p"), 9).alias("by_mean"), F.bool_or("bad").alias("b"), F.count("*").alias("steps")
    )


def base_rate_f1(df: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: the share of positives, the score's quantile that leaves as many above it, the F1 there, and 2p / (1 + p) of calling all positive."""
    base = df.agg(F.avg(F.col(positive).cast("double"))).first()[0] or 0.0
    cut = df.agg(F.percentile(score, 1.0 - base).alias("_t"))
    above = F.col(score) >= F.col("_t")
    n = lambda c: F.count_if(c).cast("double")
    f1 = M.f1(n(F.col(positive) & above), n(~F.col(positive) & above), n(F.col(positive) & ~above))
    return df.crossJoin(F.broadcast(cut)).agg(  # one row
        F.lit(round(base, 6)).alias("base"), F.round(F.max("_t"), 6).alias("threshold"), F.round(f1, 6).alias("f1"), F.lit(round(2 * base / (1 + base), 6)).alias("trivial_f1")
    )


def metric_bundle(df: DataFrame, score: str, positive: str, by: list[str], least: int) -> DataFrame:
    """Rows, base rate, AUC and area under precision and recall of each group of ``least`` rows or more with both classes."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(positive).alias("_p")).where(f"n >= {least} and _p > 0 and _p < n")
    both = M.auc(df, score, positive, by).join(M.average_precision(df, score, positive, by).withColumnRenamed("average_precision", "auprc"), by)
    return counts.join(both, by).select(*by, "n", F.round(F.col("_p") / F.col("n"), 6).alias("base_rate"), "auc", "auprc")


def centred(df: DataFrame, columns: list[str], by: list[str], train: Column) -> DataFrame:
    """Adds c_<column>: less its group's mean over the training rows; groups without any are left out."""
    means = df.where(train).groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    return df.join(means, by).select(*[df[c] for c in df.columns], *[(F.col(c) - F.col(f"_m_{c}")).alias(f"c_{c}") for c in columns])


def ridge_1d(df: DataFrame, y: str, x: str, train: Column, strength: float) -> DataFrame:
    """Adds residual: y less its ridge fit on the centred column x over the training rows."""
    products = df.where(train).agg((F.sum(F.col(x) * F.col(y)) / (F.sum(F.col(x) * F.col(x)) + strength)).alias("_beta"))
    return df.crossJoin(F.broadcast(products)).withColumn("residual", F.col(y) - F.col("_beta") * F.col(x)).drop("_beta")  # one row


def selection_pressure(df: DataFrame, score: str, positive: str, length: str, confound: str) -> DataFrame:
    """One row: the confound's correlation with label and score, length and positives in the highest fifth, and a verdict."""
    cut = df.agg(F.percentile(score, 0.8).alias("_q"))
    top = F.col(score) >= F.col("_q")
    out = df.crossJoin(F.broadcast(cut)).agg(  # one row
        F.round(F.corr(F.col(positive).cast("double"), confound), 6).alias("r_length"), F.round(F.corr(F.col(score).cast("double"), confound), 6).alias("r_score"),
        F.round(F.avg(F.when(top, F.col(length))), 4).alias("top_length"), F.round(F.avg(F.when(top, F.col(positive).cast("double"))), 6).alias("top_unsound"),
    )
    r = F.abs("r_length")
    return out.withColumn("verdict", F.when(r >= 0.3, "confounded").when(r >= 0.1, "weak").otherwise("clean"))


def best_of_pool(df: DataFrame, seed: int, n: int) -> DataFrame:
    """(g, chosen, ok, random, random_ok, n) of (g, pos, ok, s): the best by s and the first of ``n`` members in hash order; groups of two or more."""
    order = Window.partitionBy("g").orderBy(h(seed, F.col("g"), F.col("pos")), "pos", "s", "ok")
    pool = df.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
    best = lambda c: F.max_by(c, F.struct("s", -F.col("rn")))
    picked = pool.groupBy("g").agg(best("pos").alias("chosen"), best("ok").alias("ok"), F.min_by("pos", "rn").alias("random"), F.min_by("ok", "rn").alias("random_ok"), F.count("*").alias("n"))
    return picked.where("n >= 2")


def paired_bootstrap(df: DataFrame, group: str, difference: str, draws: int, seed: int, blocks: int = 1000) -> DataFrame:
    """(mean, lo, hi, significant): the mean difference and its 95 % interval over resampled groups.

    Groups are summed into ``blocks`` blocks by hash first and the blocks are resampled, so what is drawn does not grow with the table.
    """
    sums = df.groupBy((h(seed, F.col(group)) % blocks).alias("block")).agg(F.sum(difference).alias("s"), F.count("*").alias("n"))
    numbered = sums.withColumn("idx", F.row_number().over(Window.orderBy("block")) - 1)  # at most ``blocks`` rows
    drawn = S.bootstrap(numbered, draws, seed).join(F.broadcast(numbered), "idx").groupBy("b").agg((F.sum("s") / F.sum("n")).alias("d"))
    lo, hi = F.percentile("d", 0.025), F.percentile("d", 0.975)
    mean = sums.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("mean"))
    return mean.crossJoin(drawn.agg(F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"), (~((lo <= 0) & (hi >= 0))).alias("significant")))


def early_stopping(df: DataFrame, run: str, epoch: str, score: str, patience: int) -> DataFrame:
    """(run, best_epoch, stopped): the best epoch before ``patience`` epochs bring no new best; stopped is null where they never do.

    The first epoch with a score is a best; one with a null score or NaN never is, and counts as an epoch without. A run without any score has a
    null best_epoch, and its patience runs from its first epoch.
    """
    order = Window.partitionBy(run).orderBy(epoch)  # a run's epochs
    value = F.when(~F.isnan(F.col(score).cast("double")), F.col(score))
    before = F.max(value).over(order.rowsBetween(Window.unboundedPreceding, -1))
    seen = df.withColumn("_better", F.coalesce(value > before, value.isNotNull() & before.isNull()))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumn("_last", F.coalesce(F.max(F.when(F.col("_better"), F.col(epoch))).over(upto), F.min(epoch).over(upto)))
    stop = seen.withColumn("_stop", F.min(F.when(F.col(epoch) - F.col("_last") >= patience, F.col(epoch))).over(Window.partitionBy(run)))
    open_ = F.col("_stop").isNull() | (F.col(epoch) < F.col("_stop"))
    return stop.groupBy(run).agg(F.max(F.when(F.col("_better") & open_, F.col(epoch))).cast("int").alias("best_epoch"), F.max("_stop").cast("int").alias("stopped"))


def stratified_split(df: DataFrame, key: str, stratum: str, seed: int, share: float, buckets: int = 64) -> DataFrame:
    """Adds is_train: exactly floor(share * n) rows of each stratum, the first in hash order.

    Rows are ranked within a stratum's hash ranges and start where the ranges before end, so no stratum is ordered in one task.
    """
    hashed = df.withColumn("_h", h(seed, F.col(key))).withColumn("_b", F.expr(f"cast(_h * {buckets} div 4294967296 as int)"))
    sizes = hashed.groupBy(stratum, "_b").agg(F.count("*").alias("_n"))
    mine = Window.partitionBy(stratum)  # ``buckets`` rows
    sizes = sizes.select(
        stratum, "_b", F.coalesce(F.sum("_n").over(mine.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"), F.sum("_n").over(mine).alias("_all")
    )
    rank = F.col("_s") + F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_h", key))
    return hashed.join(sizes, [stratum, "_b"]).withColumn("is_train", rank <= F.floor(F.col("_all") * share)).select(*df.columns, "is_train")


def weighted_draws(df: DataFrame, key: str, weight: str, draws: int, seed: int, buckets: int = 256) -> DataFrame:
    """(draw, key): ``draws`` draws with replacement in proportion to whole-number weights, keys in order.

    Weights are summed up within ranges of keys and across the ranges, so no running sum goes over the whole table in one task; a draw
    finds its range first and its key within it.
    """
    ends = df.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    ranged = df.select(F.col(key).alias("_k"), F.col(weight).alias("_w")).crossJoin(F.broadcast(ends))  # one row
    ranged = ranged.withColumn("_b", F.floor((F.col("_k") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo") + 1) / F.lit(buckets))).cast("int"))
    sizes = ranged.groupBy("_b").agg(F.sum("_w").alias("_n"))
    order = Window.orderBy("_b")  # ``buckets`` rows
    sizes = sizes.select("_b", (F.sum("_n").over(order) - F.col("_n")).alias("_from"), F.sum("_n").over(order).alias("_to"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    points = df.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(sizes)
    points = points.withColumn("_x", _point(seed))
    points = points.where("_x >= _from and _x < _to").select("draw", "_b", (F.col("_x") - F.col("_from")).alias("_x"))
    running = F.sum("_w").over(Window.partitionBy("_b").orderBy("_k"))
    keyed = ranged.select("_b", "_k", running.alias("_end"), (running - F.col("_w")).alias("_begin"))
    return keyed.join(F.broadcast(points), "_b").where("_x >= _begin and _x < _end").select("draw", F.col("_k").alias(key))  # ``draws`` rows


def _point(seed: int) -> Column:
    """floor(hash * total / 2**32), exact for totals below 10**18."""
    return F.floor(h(seed, F.col("draw")).cast("decimal(10, 0)") * F.col("_total").cast("decimal(18, 0)") / F.lit(4294967296).cast("decimal(10, 0)")).cast("long")


def judge_worklist(df: DataFrame, answer: str, gold: str, error: str) -> DataFrame:
    """Adds verdict (skip, no_answer, correct, residual) and the prompt of what is residual."""
    a, g = F.col(answer), F.col(gold)
    verdict = F.when(F.col(error).isNotNull(), "skip").when(a.isNull(), "no_answer").when(g.isNull(), "skip").when(a == g, "correct").otherwise("residual")
    prompt = F.concat(F.lit("Gold answer: "), g, F.lit("\nExtracted answer: "), a, F.lit("\nSame value? YES or NO."))
    return df.withColumn("verdict", verdict).withColumn("prompt", F.when(F.col("verdict") == "residual", prompt))


def mechanism_prompt(problem: Column, reference: Column, solution: Column) -> Column:
    """What a judge of reasoning gets: the problem, a reference or that there is none, and a solution whose answer is right."""
    ref = F.when(F.trim(reference) == "", "Reference: none").otherwise(F.concat(F.lit("Reference:\n"), reference))
    return F.concat(F.lit("Problem:\n"), problem, F.lit("\n\n"), ref, F.lit("\n\nSolution with the right answer:\n"), solution, F.lit("\n\nCheck each step, then end with LABEL."))


def verify_prompt(problem: Column, gold: Column, answer: Column) -> Column:
    return F.concat(F.lit("Problem:\n"), problem, F.lit("\n\nGold answer: "), gold, F.lit("\nAnswer: "), answer, F.lit("\n\nSame value? YES or NO."))


def approach_prompt(solution: Column) -> Column:
    return F.concat(F.lit("Name the approach of this solution in one word.\n\n"), solution)


def call_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Prices are for a million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def split_id(request: Column, mark: str = "__c") -> Column:
    """Struct (record, candidate) of an id, cut at its last mark; candidate is null where no number follows."""
    return F.struct(F.regexp_extract(request, f"(?s)^(.*){mark}", 1).alias("record"), F.substring_index(request, mark, -1).try_cast("long").alias("candidate"))


def hardest(df: DataFrame, split: str, key: str, golds: str, level: str, most: int, lo: float, hi: float) -> DataFrame:
    """(split, k, gold, difficulty): the ``most`` hardest rows of each split with a difficulty from ``lo`` to ``hi``, ties by key; the first gold answer of a list; a level that is no number is -1."""
    difficulty = F.coalesce(F.col(level).try_cast("double"), F.lit(-1.0))
    rows = df.select(F.col(split).alias("split"), F.col(key).alias("k"), F.get(golds, F.lit(0)).alias("gold"), difficulty.alias("difficulty")).where(F.col("difficulty").between(lo, hi))
    rank = F.row_number().over(Window.partitionBy("split").orderBy(F.desc("difficulty"), "k"))
    return rows.withColumn("_rn", rank).where(F.col("_rn") <= most).drop("_rn")


def label_by_word(reply: Column, labels: list[str]) -> Column:
    """The first of ``labels`` that stands in the reply as a word; unknown without one."""
    low = F.lower(reply)
    found = [F.when(low.rlike(f"(^|[^a-z0-9_]){x}($|[^a-z0-9_])"), F.lit(x)) for x in labels]
    return F.coalesce(*found, F.lit("unknown"))


def source_tier(source: Column) -> Column:
    return F.when(source == "claude_api_block", "high").when(source == "inline_think_tags", "medium").otherwise("none")


def reasoning_text(think: Column, response: Column, raw: Column) -> Column:
    """Thinking, else response, else the raw text."""
    return F.coalesce(F.nullif(think, F.lit("")), F.nullif(response, F.lit("")), raw)


def chosen_path(steps: str) -> Column:
    """(i, text, rating) of each step's chosen completion; steps without one are left out."""
    picked = F.transform(steps, lambda s: F.struct(s["i"].alias("i"), F.get(s["completions"], s["chosen"])["text"].alias("text"), F.get(s["completions"], s["chosen"])["rating"].alias("rating")))
    return F.filter(picked, lambda s: s["text"].isNotNull())


def mask_vector(v: Column, key: Column, share: float, seed: int) -> Column:
    """Each component 0 with a chance of ``share``."""
    return F.transform(v, lambda x, i: F.when(u(seed, key, i) < share, F.lit(0.0)).otherwise(x))


def shuffle_vector(v: Column, key: Column, seed: int) -> Column:
    """The components in hash order."""
    order = F.array_sort(F.transform(v, lambda x, i: F.struct(h(seed, key, i).alias("h"), i.alias("i"), x.alias("x"))))
    return F.transform(order, lambda s: s["x"])
