"""Queries over score panels, judge work lists, selection, sweeps, sampling plans and controlled evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestep.functions import text as T
from lodestep.functions import vectors as V
from lodestep.functions.rand import h, sql_h
from lodestep.operators import confound as C
from lodestep.operators import metrics as M
from lodestep.operators import panel as N
from lodestep.operators import sampling as S
from lodestep.plans.metric_queries import SCORED, scored
from lodestep.plans.registry import query
from lodestep.plans.text_queries import strip_sql
from lodestep.sources.tables import table
from lodestep.streaming import incremental

#: Step scores of chains: orders are chains, their items steps; the first item with a discount of 0.08 or more is the error.
STEPS = "(select l_orderkey id, l_linenumber - 1 i, 1 - l_tax p, l_discount >= 0.08 bad from lineitem)"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), (F.col("l_linenumber") - 1).alias("i"), (1 - F.col("l_tax")).alias("p"), (F.col("l_discount") >= 0.08).alias("bad")
    )


CHAINS = f"(select id, 1 - min(p) by_min, round(1 - avg(p), 9) by_mean, bool_or(bad) b, count(*) n from {STEPS} group by id)"


@query(f"""select id, round(by_min, 6) by_min, round(by_mean, 6) by_mean, case when b then 'B' else 'A' end chain, cast(n as bigint) steps from {CHAINS} where n >= 2""")
def chain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain scores from step scores, one less the least and one less the mean, with the chain's label; chains of two steps or more."""
    c = N.chain_scores(steps(spark, sf_dir)).where("steps >= 2")
    return c.select("id", F.round("by_min", 6).alias("by_min"), F.round("by_mean", 6).alias("by_mean"), F.when(F.col("b"), "B").otherwise("A").alias("chain"), "steps")


@query(f"""with c as {CHAINS}, r as (select avg(case when b then 1.0e0 else 0 end) base from c), o as (select list(by_mean order by by_mean) l, (count(*) - 1) * (1 - any_value(base)) x from c, r), t as (select l[cast(floor(x) as int) + 1] + (x - floor(x)) * (l[least(cast(floor(x) as int) + 2, len(l))] - l[cast(floor(x) as int) + 1]) t from o),
 k as (select cast(count(*) filter (b and by_mean >= t) as double) tp, cast(count(*) filter (not b and by_mean >= t) as double) fp, cast(count(*) filter (b and by_mean < t) as double) fn from c, t)
 select round(base, 6) base, round(t, 6) threshold, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) f1, round(2 * base / (1 + base), 6) trivial_f1 from r, t, k""")
def base_rate_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score above which as many chains lie as are unsound, its F1, and the F1 of calling everything unsound."""
    return N.base_rate_f1(N.chain_scores(steps(spark, sf_dir)), "by_mean", "b")


@query(f"""with s as {STEPS}, r as (select bad, rank() over (order by p desc) + (count(*) over (partition by p) - 1) / 2.0e0 r from s), a as (select sum(case when bad then r else 0 end) s, cast(count(*) filter (bad) as double) k, cast(count(*) as double) n from r),
 v as (select round((s - k * (k + 1) / 2) / nullif(k * (n - k), 0), 6) auc from a), m as (select round(avg(case when bad then p end), 6) mean_error, round(avg(case when not bad then p end), 6) mean_other from s)
 select auc, mean_error, mean_other, case when auc < 0.55e0 then 'abort' when auc < 0.65e0 then 'flag' else 'pass' end gate from v, m""")
def step_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether low step scores find errors at all: AUC, mean score of error and other steps, and the gate that it passes."""
    s = steps(spark, sf_dir).withColumn("low", -F.col("p"))
    auc = M.auc(s, "low", "bad", [])
    means = s.agg(F.round(F.avg(F.when(F.col("bad"), F.col("p"))), 6).alias("mean_error"), F.round(F.avg(F.when(~F.col("bad"), F.col("p"))), 6).alias("mean_other"))
    return auc.crossJoin(means).select("auc", "mean_error", "mean_other", F.when(F.col("auc") < 0.55, "abort").when(F.col("auc") < 0.65, "flag").otherwise("pass").alias("gate"))


@query(f"""with t as (select source, score, sum(case when pos then 1 else 0 end) p, count(*) n from {SCORED} group by 1, 2), c as (select source, score, p, n, sum(p) over w tp, sum(n) over w seen from t window w as (partition by source order by score desc)),
 ap as (select source, sum(cast(tp as double) / seen * p) / nullif(sum(p), 0) auprc, sum(n) n, sum(p) p from c group by source),
 r as (select source, pos, rank() over (partition by source order by score) + (count(*) over (partition by source, score) - 1) / 2.0e0 r from {SCORED}), a as (select source, sum(case when pos then r else 0 end) s from r group by source)
 select source, cast(n as bigint) n, round(p / cast(n as double), 6) base_rate, round((s - p * (p + 1) / 2.0e0) / nullif(cast(p as double) * (n - p), 0), 6) auc, round(auprc, 6) auprc from ap join a using (source) where n >= 12 and p > 0 and p < n""")
def difficulty_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What length alone tells within each source: AUC, area under precision and recall, base rate; small and one-class sources are left out."""
    return N.metric_bundle(scored(spark, sf_dir), "score", "pos", ["source"], 12)


#: Four fifths of the documents, by hash.
TRAIN_SQL = f"{sql_h(60, 'doc_id')} % 5 <> 0"


def _train() -> Column:
    return h(60, F.col("doc_id")) % 5 != 0


RESIDUAL = f"""m as (select *, ln(1 + w) x, cast(score as double) y from {SCORED}), g as (select source, avg(x) mx, avg(y) my from m where {TRAIN_SQL} group by source)"""


@query(f"""with {RESIDUAL}, c as (select m.*, x - mx xc, y - my yc from m join g using (source)), t as (select sum(xc * yc) / (sum(xc * xc) + 1) beta from c where {TRAIN_SQL})
 select doc_id, round(yc - beta * xc, 4) residual from c, t""")
def ridge_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of a score on log length within sources, by ridge regression of unit strength fit on training rows."""
    m = N.centred(scored(spark, sf_dir).select("doc_id", "source", F.log1p("w").alias("x"), F.col("score").cast("double").alias("y")), ["x", "y"], ["source"], _train())
    out = N.ridge_1d(m, "c_y", "c_x", _train(), 1.0)
    return out.select("doc_id", F.round("residual", 4).alias("residual"))


AUC_OF = lambda name, score: f"(select round((sum(case when pos then r else 0 end) - cast(count(*) filter (pos) as double) * (count(*) filter (pos) + 1) / 2) / nullif(cast(count(*) filter (pos) as double) * count(*) filter (not pos), 0), 6) from (select pos, rank() over (order by round({score}, 6)) + (count(*) over (partition by round({score}, 6)) - 1) / 2.0e0 r from v)) {name}"


@query(f"""with {RESIDUAL}, t as (select regr_slope(y, x) b, regr_intercept(y, x) a from m where {TRAIN_SQL}), tc as (select regr_slope(y - my, x - mx) b from m join g using (source) where {TRAIN_SQL}),
 v as (select pos, y raw, y - t.a - t.b * x ctl, y - my - tc.b * (x - mx) ctl_source from m join g using (source), t, tc where not ({TRAIN_SQL}))
 select {AUC_OF('raw', 'raw')}, {AUC_OF('controlled', 'ctl')}, {AUC_OF('controlled_source', 'ctl_source')}""")
def controlled_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score's held-out AUC as it is, with length taken out, and with length and source taken out; both fits on training rows alone."""
    train = _train()
    m = scored(spark, sf_dir).select("doc_id", "source", "pos", F.log1p("w").alias("x"), F.col("score").cast("double").alias("y"))
    both = N.centred(C.residualize(m, ["y"], ["x"], train), ["x", "y"], ["source"], train)
    both = N.ridge_1d(both, "c_y", "c_x", train, 0.0).where(~train)
    arms = {"raw": "y", "controlled": "y_residual", "controlled_source": "residual"}
    long = both.select("pos", F.inline(F.array(*[F.struct(F.lit(name).alias("arm"), F.round(column, 6).alias("score")) for name, column in arms.items()])))
    auc = M.auc(long, "score", "pos", ["arm"])
    return auc.agg(*[F.max(F.when(F.col("arm") == name, F.col("auc"))).alias(name) for name in arms])


@query(f"""with a as (select round(corr(case when pos then 1.0e0 else 0 end, ln(1 + w)), 6) r_length, round(corr(cast(score as double), ln(1 + w)), 6) r_score from {SCORED}),
 q as (select quantile_cont(score, 0.8) q from {SCORED}) select r_length, r_score, (select round(avg(w), 4) from {SCORED}, q where score >= q) top_length, (select round(avg(case when pos then 1.0e0 else 0 end), 6) from {SCORED}, q where score >= q) top_unsound,
 case when abs(r_length) >= 0.3e0 then 'confounded' when abs(r_length) >= 0.1e0 then 'weak' else 'clean' end verdict from a""")
def selection_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How choosing by a score moves length and soundness: correlations, and the means among the highest fifth, with a verdict by fixed bounds."""
    return N.selection_pressure(scored(spark, sf_dir).withColumn("ll", F.log1p("w")), "score", "pos", "w", "ll")


POOL = f"(select l_orderkey g, l_linenumber pos, l_returnflag = 'N' ok, l_quantity s, row_number() over (partition by l_orderkey order by {sql_h(51, 'l_orderkey', 'l_linenumber')}, l_linenumber, l_quantity, l_returnflag = 'N') rn from lineitem)"


@query(f"""with p as (select * from {POOL} where rn <= 4), c as (select g, arg_max(pos, (s, -rn)) chosen, arg_max(ok, (s, -rn)) ok, arg_min(pos, rn) random, arg_min(ok, rn) random_ok, count(*) n from p group by g)
 select g, cast(chosen as integer) chosen, ok, cast(random as integer) random, random_ok, cast(n as bigint) n from c where n >= 2""")
def best_of_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-scored and a random member of a hashed pool of four, side by side; ties go to the earlier in hash order."""
    return N.best_of_pool(_pool(spark, sf_dir), 51, 4)


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("pos"), (F.col("l_returnflag") == "N").alias("ok"), F.col("l_quantity").alias("s"))


@query()
def paired_choice_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference between the best-scored and the random choice, with the interval of 1,000 paired resamples of problems."""
    chosen = N.best_of_pool(_pool(spark, sf_dir), 51, 4).select("g", (F.col("ok").cast("int") - F.col("random_ok").cast("int")).alias("d"))
    return N.paired_bootstrap(chosen, "g", "d", 1000, 52)


@query("""with d as (select label, unnest(range(0, len(embedding))) dim, cast(unnest(embedding) as double) x from embeddings), m as (select dim, abs(avg(case when label < 5 then x end) - avg(case when label >= 5 then x end)) gap from d group by dim),
 r as (select dim, gap, row_number() over (order by round(gap, 9) desc, dim) rn from m) select cast(dim as integer) dim, round(gap, 6) gap, cast(rn as integer) as rank from r where rn <= 5""")
def top_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five dimensions whose class means lie furthest apart."""
    d = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    gap = F.abs(F.avg(F.when(F.col("label") < 5, F.col("x").cast("double"))) - F.avg(F.when(F.col("label") >= 5, F.col("x").cast("double"))))
    best = d.groupBy("dim").agg(gap.alias("gap")).orderBy(F.round("gap", 9).desc(), "dim").limit(5)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.round("gap", 9).desc(), "dim"))).select("dim", F.round("gap", 6).alias("gap"), "rank")  # five rows


@query(f"""with d as (select source, regr_r2(case when pos then 1.0e0 else 0 end, ln(1 + w)) r2 from {SCORED} group by source), k as (select source, round(coalesce(r2, 0), 6) r2 from d) select arg_max(source, (r2, source)) peak, max(r2) r2, cast(count(*) as bigint) n from k""")
def peak_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group in which log length explains most of the label."""
    d = scored(spark, sf_dir).groupBy("source").agg(F.round(F.coalesce(F.nanvl(F.regr_r2(F.col("pos").cast("double"), F.log1p("w")), F.lit(0.0)), F.lit(0.0)), 6).alias("r2"))
    return d.agg(F.max_by("source", F.struct("r2", "source")).alias("peak"), F.max("r2").alias("r2"), F.count("*").alias("n"))


SWEEP = "(select extract(year from o_orderdate) e, o_orderpriority run, avg(o_totalprice) s from orders group by 1, 2)"


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("e"), F.col("o_orderpriority").alias("run")).agg(F.avg("o_totalprice").alias("s"))


@query(f"""with s as {SWEEP}, l as (select *, round(s, 4) > lag(round(s, 4)) over (partition by run order by e) rises from s) select run, coalesce(bool_and(rises), true) monotonic, cast(count(*) as bigint) n from l group by run""")
def monotonic_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a metric rises at each step of an ordered sweep."""
    s = _sweep(spark, sf_dir).withColumn("s", F.round("s", 4))
    rises = F.col("s") > F.lag("s").over(Window.partitionBy("run").orderBy("e"))  # a run's epochs
    return s.withColumn("rises", rises).groupBy("run").agg(F.coalesce(F.every("rises"), F.lit(True)).alias("monotonic"), F.count("*").alias("n"))


@query(f"""with s as (select run, e, round(s, 4) s from {SWEEP}), m as (select *, max(s) over (partition by run order by e rows between unbounded preceding and 1 preceding) before from s),
 i as (select *, before is null or s > before better from m), b as (select *, max(case when better then e end) over (partition by run order by e) last from i),
 stop as (select run, min(e) stop from b where e - last >= 2 group by run) select b.run, cast(max(case when better and (stop is null or e < stop) then e end) as integer) best_epoch, cast(any_value(stop) as integer) stopped from b left join stop using (run) group by b.run""")
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best epoch of each run when it stops after two epochs without a new best."""
    return N.early_stopping(_sweep(spark, sf_dir).withColumn("s", F.round("s", 4)), "run", "e", "s", 2)


@query(f"""with s as {SWEEP} select run, round(avg(s), 4) mean, round(stddev_pop(s), 4) sd, cast(count(*) as bigint) seeds from s group by run""")
def seed_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population deviation of a metric over seeds."""
    return _sweep(spark, sf_dir).groupBy("run").agg(F.round(F.avg("s"), 4).alias("mean"), F.round(F.stddev_pop("s"), 4).alias("sd"), F.count("*").alias("seeds"))


@query(f"""with r as (select doc_id, lang, length(text) n, floor(length(text) / 256) w from documents where text is not null), b as (select *, (row_number() over (partition by lang, w order by {sql_h(53, 'doc_id')}, doc_id) - 1) // 8 batch from r)
 select lang, cast(w as bigint) win, cast(batch as bigint) batch, cast(count(*) as bigint) n, max(n) - min(n) spread from b group by 1, 2, 3 having count(*) >= 4""")
def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of like length in hash order, eight to a batch; batches of fewer than four are left out."""
    r = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "lang", F.length("text").alias("n"))
    r = r.withColumn("win", F.floor(F.col("n") / 256))
    rank = S.rank_by_hash(53, F.col("doc_id"), [F.col("lang"), F.col("win")])
    b = r.withColumn("batch", F.floor((rank - 1) / 8)).groupBy("lang", "win", "batch").agg(F.count("*").alias("n"), (F.max("n") - F.min("n")).alias("spread"))
    return b.where("n >= 4")


@query(f"""with r as (select doc_id, source, row_number() over (partition by quality order by {sql_h(54, 'doc_id')}, doc_id) rn, count(*) over (partition by quality) n, quality from documents join labels using (doc_id))
 select doc_id, coalesce(quality, -1) quality, rn <= floor(n * 0.75e0) is_train from r""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact 75/25 split within each class, in hash order; each class is ranked within hash ranges."""
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id")
    return N.stratified_split(docs.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality")), "doc_id", "quality", 54, 0.75)


@query(f"""select doc_id, cast({sql_h(55, 'doc_id')} % 5 as integer) fold from documents""")
def k_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds by hash."""
    return table(spark, sf_dir, "documents").select("doc_id", (h(55, F.col("doc_id")) % 5).cast("int").alias("fold"))


@query(f"""select doc_id from documents order by {sql_h(56, 'doc_id')}, doc_id limit 50""")
def sweep_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents of a fixed seed, the same for every dose of a sweep."""
    return table(spark, sf_dir, "documents").select("doc_id").orderBy(h(56, F.col("doc_id")), "doc_id").limit(50)


PRIORITY = "case o_orderpriority when '1-URGENT' then 3 when '2-HIGH' then 2 else 1 end"


@query(f"""select o_orderkey k, round({PRIORITY} * (0.5e0 + coalesce(case when o_orderkey % 3 = 0 then null else (o_custkey % 100) / 100.0e0 end, 0.5e0)), 6) weight, cast(unnest(range(1, case when o_orderstatus = 'P' then 4 else 2 end)) as integer) replica from orders""")
def sampling_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights from priority and hardness, and three replicas of pairs across models."""
    o = table(spark, sf_dir, "orders")
    hard = F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_custkey") % 100) / 100.0)
    weight = F.round(_priority() * (0.5 + F.coalesce(hard, F.lit(0.5))), 6)
    return o.select(F.col("o_orderkey").alias("k"), weight.alias("weight"), F.explode(F.sequence(F.lit(1), F.when(F.col("o_orderstatus") == "P", 3).otherwise(1))).alias("replica"))


def _priority() -> Column:
    return F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(1)


@query(f"""with o as (select o_orderkey k, {PRIORITY} w from orders), c as (select k, sum(w) over (order by k) - w lo, sum(w) over (order by k) hi, sum(w) over () total from o),
 d as (select i draw, ({sql_h(57, 'i')} * (select max(total) from c)) // 4294967296 x from range(0, 200) t(i)) select cast(draw as bigint) draw, k from d join c on x >= lo and x < hi""")
def weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred draws with replacement in proportion to weight."""
    return N.weighted_draws(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), _priority().cast("long").alias("w")), "k", "w", 200, 57)


REFERENCE = {"web": 0.52, "books": 0.04, "code": 0.19}
RATES = ", ".join(f"('{k}', {v}e0)" for k, v in REFERENCE.items())


@query(f"""with r as (select source, avg(case when pos then 1.0e0 else 0 end) rate, count(*) n from {SCORED} group by source), x(source, known) as (values {RATES}), j as (select r.source, rate, n, coalesce(known, 0) known from r left join x using (source))
 select source, round(rate, 6) rate, cast(n as bigint) n, cast(known as double) as reference, cast(row_number() over (order by known, source) as integer) place from j""")
def rate_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares by source beside given ones, in their order; a source without one counts as 0."""
    rates = scored(spark, sf_dir).groupBy("source").agg(F.avg(F.col("pos").cast("double")).alias("rate"), F.count("*").alias("n"))
    known = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in REFERENCE.items() for x in kv]), F.col("source")), F.lit(0.0))
    place = F.row_number().over(Window.orderBy("reference", "source"))  # one row for each source
    return rates.withColumn("reference", known).select("source", F.round("rate", 6).alias("rate"), "n", "reference", place.alias("place"))


@query("""select conv_id, turn, cast(unnest(range(0, 4)) as integer) candidate, concat('conv', conv_id, '_t', turn, '_c', unnest(range(0, 4))) request from conversations where role = 'user'""")
def request_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four requests for each problem, with ids of their own."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("candidate"))
    return rows.select("*", F.concat(F.lit("conv"), "conv_id", F.lit("_t"), "turn", F.lit("_c"), "candidate").alias("request"))


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s]+'), lambda w: w <> '')"
#: The answer is a text's first word, the gold answer its conversation's most frequent first word; a text of under four words failed.
WORK = f"(select conv_id, turn, case when len(w) < 4 then 'too short' end error, case when starts_with(role, 's') then null else lower(w[1]) end answer, gold from (select conv_id, turn, role, {_WORDS} w from conversations) left join (select conv_id, arg_min(a, (-n, a)) gold from (select conv_id, lower({_WORDS}[1]) a, count(*) n from conversations group by all) where a is not null group by conv_id) using (conv_id))"


@query(f"""select conv_id, turn, case when error is not null then 'skip' when answer is null then 'no_answer' when gold is null then 'skip' when answer = gold then 'correct' else 'residual' end verdict,
 case when error is null and answer is not null and gold is not null and answer <> gold then 'Gold answer: ' || gold || chr(10) || 'Extracted answer: ' || answer || chr(10) || 'Same value? YES or NO.' end prompt from {WORK}""")
def judge_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge still has to see, and the prompt that it gets: no failed, missing or already settled answers."""
    said = table(spark, sf_dir, "conversations").withColumn("w", T.words(F.col("text"))).withColumn("a", F.lower(F.get("w", F.lit(0))))
    votes = said.where("a is not null").groupBy("conv_id", "a").agg(F.count("*").alias("n"))
    gold = votes.groupBy("conv_id").agg(F.min_by("a", F.struct(-F.col("n"), "a")).alias("gold"))
    rows = said.join(gold, "conv_id", "left").select("conv_id", "turn", F.when(F.size("w") < 4, "too short").alias("error"), F.when(~F.startswith("role", F.lit("s")), F.col("a")).alias("answer"), "gold")
    return N.judge_worklist(rows, "answer", "gold", "error").select("conv_id", "turn", "verdict", "prompt")


#: Words that the given replies hold, for the labels of a judge.
LABELS = ["the", "und", "la"]


@query(f"""select conv_id, turn, case {' '.join(f"when regexp_matches(lower(text), '(^|[^a-z0-9_]){x}($|[^a-z0-9_])') then '{x}'" for x in LABELS)} else 'unknown' end label from conversations""")
def approach_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first known label, in declared order, that a reply holds as a word."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", N.label_by_word(F.col("text"), LABELS).alias("label"))


LIMITS = "case when event_type = 'error' then 'Rate limit: Limit ' || cast(floor(value * 100) as bigint) || ', Used ' || user_id else event_type || ' ' || props end"


@query(f"""select event_id, try_cast(nullif(regexp_extract({LIMITS}, 'Limit ([0-9]+)', 1), '') as bigint) lim, coalesce(greatest(512, try_cast(nullif(regexp_extract({LIMITS}, 'Limit ([0-9]+)', 1), '') as bigint) - 500), 512) cap, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y%m%dT%H%M%SZ') as stamp from events""")
def rate_limit_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit that an error event's message names, the cap that follows from it, and the event's day and stamp."""
    limited = F.concat(F.lit("Rate limit: Limit "), F.floor(F.col("value") * 100).cast("long"), F.lit(", Used "), "user_id")
    said = F.when(F.col("event_type") == "error", limited).otherwise(F.concat_ws(" ", "event_type", "props"))
    limit = F.nullif(F.regexp_extract(said, "Limit ([0-9]+)", 1), F.lit("")).try_cast("long")
    cap = F.when(limit.isNotNull(), F.greatest(F.lit(512), limit - 500)).otherwise(F.lit(512))
    day, stamp = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")
    return table(spark, sf_dir, "events").select("event_id", limit.alias("lim"), cap.cast("long").alias("cap"), day.alias("day"), stamp.alias("stamp"))


#: A text's first line is its thinking, what is left its response; the source is told by the role.
TIERED = """(select conv_id, turn, text, case role when 'assistant' then 'claude_api_block' when 'user' then 'inline_think_tags' else 'none' end src, case when contains(text, chr(10)) then split_part(text, chr(10), 1) else '' end think,
 case when contains(text, chr(10)) then substr(text, instr(text, chr(10)) + 1) else '' end resp from conversations)"""


@query(f"""select conv_id, turn, case src when 'claude_api_block' then 'high' when 'inline_think_tags' then 'medium' else 'none' end tier, md5(coalesce(nullif(think, ''), nullif(resp, ''), text)) reasoning, think <> '' and resp <> '' both_present from {TIERED}""")
def source_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tier of the thinking's source, whether thinking and response are both there, and the text to read as reasoning."""
    role, text = F.col("role"), F.col("text")
    src = F.when(role == "assistant", "claude_api_block").when(role == "user", "inline_think_tags").otherwise("none")
    cut = F.contains(text, F.lit("\n"))
    think, resp = F.when(cut, F.split_part(text, F.lit("\n"), F.lit(1))).otherwise(""), F.when(cut, F.substr(text, F.instr(text, "\n") + 1)).otherwise("")
    rows = table(spark, sf_dir, "conversations").withColumns({"src": src, "think": think, "resp": resp})
    both = (F.col("think") != "") & (F.col("resp") != "")
    return rows.select("conv_id", "turn", N.source_tier(F.col("src")).alias("tier"), F.md5(N.reasoning_text(F.col("think"), F.col("resp"), text)).alias("reasoning"), both.alias("both_present"))


TREE = "(select l_orderkey k, l_linenumber i, list_extract([l_returnflag, l_linestatus, cast(l_suppkey as varchar)], cast(l_partkey % 4 + 1 as integer)) text, list_extract([1, 0, -1], cast(l_partkey % 4 + 1 as integer)) rating, (l_returnflag, l_linestatus, cast(l_suppkey as varchar), l_partkey % 4) tie from lineitem)"


@query(f"""select k, coalesce(string_agg(text, '>' order by i, tie) filter (text is not null), '') path, cast(count(text) as bigint) steps, cast(coalesce(min(case when rating = -1 then i end), 0) as integer) first_bad from {TREE} group by k""")
def tree_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen completion of each step of a rating tree; steps without one are left out."""
    done = lambda t, r: F.struct(F.col(t).cast("string").alias("text"), F.lit(r).alias("rating"))
    completions = F.array(done("l_returnflag", 1), done("l_linestatus", 0), done("l_suppkey", -1))
    step = F.struct(F.col("l_linenumber").alias("i"), completions.alias("completions"), (F.col("l_partkey") % 4).cast("int").alias("chosen"))
    trees = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(step)).alias("steps"))  # an order's items
    return trees.withColumn("p", N.chosen_path("steps")).select(
        "k", F.array_join(F.transform("p", lambda s: s["text"]), ">").alias("path"), F.size("p").cast("long").alias("steps"),
        F.coalesce(F.get(F.filter("p", lambda s: s["rating"] == -1), F.lit(0))["i"], F.lit(0)).cast("int").alias("first_bad"),
    )


@query("""with o as (select o_orderstatus finish, o_orderkey % 10 = 0 qc, o_orderkey % 15 = 1 screening, o_custkey % 4 = 0 b from orders), k as (select * from o where not qc and not screening)
 select (select count(*) from o) scanned, (select count(*) from o where qc) qc, (select count(*) from o where screening and not qc) screening, cast(count(*) filter (finish = 'F') as bigint) finished, cast(count(*) filter (finish = 'O') as bigint) gave_up,
 cast(count(*) filter (finish = 'F' and b) as bigint) type_b, round(100.0e0 * count(*) filter (finish = 'F' and b) / nullif(count(*) filter (finish = 'F'), 0), 4) percent_b from k""")
def tree_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From scanned trees to unsound solutions: what is left out is counted too. One pass."""
    finish, b = F.col("o_orderstatus"), F.col("o_custkey") % 4 == 0
    qc, screening = F.col("o_orderkey") % 10 == 0, F.col("o_orderkey") % 15 == 1
    kept = ~qc & ~screening
    f, fb = F.count_if(kept & (finish == "F")), F.count_if(kept & (finish == "F") & b)
    return table(spark, sf_dir, "orders").agg(
        F.count("*").alias("scanned"), F.count_if(qc).alias("qc"), F.count_if(screening & ~qc).alias("screening"), f.alias("finished"), F.count_if(kept & (finish == "O")).alias("gave_up"),
        fb.alias("type_b"), F.round(F.try_divide(100.0 * fb, f), 4).alias("percent_b"),
    )


@query(f"""select cast(count(*) as bigint) chains, cast(count(*) filter (b) as bigint) chains_b, min(n) shortest, median(n) middle, max(n) longest, cast(sum(n) as bigint) steps from {CHAINS}""")
def chain_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of chains and their shortest, middle and longest length."""
    c = N.chain_scores(steps(spark, sf_dir))
    return c.agg(F.count("*").alias("chains"), F.count_if("b").alias("chains_b"), F.min("steps").alias("shortest"), F.median("steps").alias("middle"), F.max("steps").alias("longest"), F.sum("steps").alias("steps"))


@query("""with l as (select quality, toxic, count(*) n from labels group by 1, 2) select cast(coalesce(sum(case when quality = 1 and toxic = 0 then n end), 0) as bigint) confirmed, cast(coalesce(sum(case when quality = 0 and toxic = 0 then n end), 0) as bigint) rescued,
 cast(coalesce(sum(case when quality = 1 and toxic = 1 then n end), 0) as bigint) over_count, cast(sum(n) as bigint) total from l""")
def judgement_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity against validity: confirmed, rescued and over-counted judgements."""
    q, t = F.col("quality"), F.col("toxic")
    return table(spark, sf_dir, "labels").agg(
        F.count_if((q == 1) & (t == 0)).alias("confirmed"), F.count_if((q == 0) & (t == 0)).alias("rescued"), F.count_if((q == 1) & (t == 1)).alias("over_count"), F.count("*").alias("total")
    )


@query("""with f as (select conv_id, list(text order by turn) s, count(*) n from conversations group by conv_id) select conv_id, cast(conv_id % 5 as integer) idx, case when conv_id % 5 < n then right(s[conv_id % 5 + 1], 40) end step_tail from f""")
def flagged_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of the step that an index points to; null where the chain has no such step."""
    f = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s"))  # a conversation's turns
    return f.select("conv_id", (F.col("conv_id") % 5).cast("int").alias("idx"), F.right(F.get("s", (F.col("conv_id") % 5).cast("int"))["text"], F.lit(40)).alias("step_tail"))


@query("""with v as (select label, vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings), p as (select label, arg_min(v, vec_id) a, arg_max(v, vec_id) b from v group by label),
 z as (select label, t / 10.0e0 t, list_transform(range(1, len(a) + 1), lambda i: (1 - t / 10.0e0) * a[i] + t / 10.0e0 * b[i]) z, a, b from p, range(1, 10) x(t))
 select label, t, round(list_cosine_similarity(z, a), 6) to_a, round(list_cosine_similarity(z, a), 6) >= round(list_cosine_similarity(z, b), 6) nearest_is_a from z""")
def interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points between two vectors of a class and which end each is nearer to."""
    v = table(spark, sf_dir, "embeddings").select("label", "vec_id", V.doubles(F.col("embedding")).alias("v"))
    p = v.groupBy("label").agg(F.min_by("v", "vec_id").alias("a"), F.max_by("v", "vec_id").alias("b"))
    z = p.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(9)))).withColumn("t", F.col("t") / 10.0).withColumn("z", F.zip_with("a", "b", lambda x, y: (1 - F.col("t")) * x + F.col("t") * y))
    to_a, to_b = F.round(V.cosine(F.col("z"), F.col("a")), 6), F.round(V.cosine(F.col("z"), F.col("b")), 6)
    return z.select("label", "t", to_a.alias("to_a"), (to_a >= to_b).alias("nearest_is_a"))


@query(f"""with v as (select vec_id, embedding, list_sort(list_transform(range(1, len(embedding) + 1), lambda i: {{'h': {sql_h(59, 'vec_id', 'i - 1')}, 'i': i}})) o, unnest(range(0, len(embedding))) d from embeddings)
 select vec_id, cast(d as integer) dim, case when {sql_h(58, 'vec_id', 'd')} < 4294967296 * 0.3e0 then 0.0e0 else round(cast(embedding[d + 1] as double), 6) end masked, round(cast(embedding[o[d + 1].i] as double), 6) shuffled from v""")
def vector_corruptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with components masked, and with their order shuffled, by hash."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", V.rounded(V.doubles(F.col("embedding"))).alias("v"))
    made = F.arrays_zip(N.mask_vector(F.col("v"), F.col("vec_id"), 0.3, 58).alias("masked"), N.shuffle_vector(F.col("v"), F.col("vec_id"), 59).alias("shuffled"))
    return v.select("vec_id", F.posexplode(made).alias("dim", "c")).select("vec_id", "dim", "c.masked", "c.shuffled")


@query("""with p as (select cast(l_linenumber - 1 as integer) pos, cast(count(*) as bigint) steps from lineitem group by 1), d as (select cast(unnest(range(0, 16)) as integer) dim)
 select pos, steps, dim, round(case when dim % 2 = 0 then sin(pos * exp(-ln(10000.0e0) * dim / 16)) else cos(pos * exp(-ln(10000.0e0) * (dim - 1) / 16)) end, 6) as value from p, d""")
def position_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sines and cosines that encode the places which steps have in their chains, with how many steps have each."""
    places = table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") - 1).cast("int").alias("pos")).agg(F.count("*").alias("steps"))
    grid = places.select("pos", "steps", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("dim"))
    angle = F.col("pos") * F.exp(-F.log(F.lit(10000.0)) * (F.col("dim") - F.col("dim") % 2) / 16)
    return grid.select("pos", "steps", "dim", F.round(F.when(F.col("dim") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)), 6).alias("value"))


@query("""with a as (select doc_id from documents join labels using (doc_id) where quality = 1 order by doc_id limit 20 offset 5), b as (select doc_id from documents join labels using (doc_id) where quality = 0 order by doc_id limit 20 offset 5) select doc_id, 'A' side from a union all select doc_id, 'B' side from b""")
def calibration_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of sound and a page of unsound documents, one after the other: the report's own offset and limit."""
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    page = lambda y, side: docs.where(F.col("quality") == y).orderBy("doc_id").offset(5).limit(20).select("doc_id", F.lit(side).alias("side"))
    return page(1, "A").unionAll(page(0, "B"))


@query(f"""with w as (select page_id k, list_filter(regexp_split_to_array(html, '[\\s]+'), lambda w: w <> '') w from pages)
 select k, round(len(list_filter(w, lambda t: contains(t, chr(92)) or contains(t, '$') or contains(t, '^') or contains(t, '_{{'))) / cast(greatest(len(w), 1) as double), 6) as share from w""")
def latex_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a page's tokens that look like formulas."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), F.round(T.latex_token_share(F.col("html")), 6).alias("share"))


NESTED = "[^{}]*"
for _ in range(7):
    NESTED = f"(?:[^{{}}]|\\{{{NESTED}\\}})*"
BOXED = "'first \\boxed{1}, then \\boxed{' || html || '} is the value. Done' || case when page_id % 2 = 0 then '}' else ' \\boxed{open {' || url end"


@query(f"""with r as (select page_id k, list_extract(string_split({BOXED}, '\\boxed{{'), -1) rest from pages) select k, md5({strip_sql(f"case when regexp_matches(rest, '^{NESTED}\\}}') then regexp_extract(rest, '^({NESTED})\\}}', 1) else rest end")}) boxed from r""")
def boxed_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last boxed group around whole pages, whose own braces nest in it, and a group that is never closed."""
    tail = F.when(F.col("page_id") % 2 == 0, "}").otherwise(F.concat(F.lit(" \\boxed{open {"), "url"))
    text = F.concat(F.lit("first \\boxed{1}, then \\boxed{"), "html", F.lit("} is the value. Done"), tail)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), F.md5(T.last_boxed(text)).alias("boxed"))


@query("""select strftime(ts, '%Y-%m-%d %H') as hour, event_type, cast(count(*) as bigint) n from events where ts is not null group by 1, 2""")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type in tumbling hours: the window that the stream uses, over the whole table."""
    seen = incremental.windowed_counts(table(spark, sf_dir, "events").select("ts", "event_type"), "ts", "event_type")
    return seen.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")
