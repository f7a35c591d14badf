"""Queries over evaluation: ranking metrics, agreement, thresholds, matching, resampling, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestep.functions import text as T
from lodestep.functions.rand import sql_h
from lodestep.operators import metrics as M
from lodestep.operators import sampling as S
from lodestep.plans.registry import query
from lodestep.plans.text_queries import words_sql
from lodestep.sources.tables import table


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with their length as a score and unsound ones as positives."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("score"), T.n_words(F.col("text")).alias("w"))
    labels = table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", (F.col("quality") == 0).alias("pos"))
    return docs.join(labels, "doc_id")


SCORED = f"(select d.doc_id, d.source, length(text) score, len({words_sql('text')}) w, quality = 0 pos from documents d join labels l on d.doc_id = l.doc_id where quality is not null)"


@query(f"""with r as (select source, pos, rank() over (partition by source order by score) + (count(*) over (partition by source, score) - 1) / 2.0e0 r from {SCORED}),
 a as (select source, sum(case when pos then r else 0 end) s, cast(sum(case when pos then 1 else 0 end) as double) p, cast(count(*) as double) n from r group by source)
 select source, round((s - p * (p + 1) / 2) / nullif(p * (n - p), 0), 6) auc from a""")
def auc_rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the ROC curve of length against soundness, by source."""
    return M.auc(scored(spark, sf_dir), "score", "pos", ["source"])


@query(f"""with t as (select source, score, sum(case when pos then 1 else 0 end) p, count(*) n from {SCORED} group by 1, 2),
 c as (select source, p, sum(p) over w tp, sum(n) over w seen from t window w as (partition by source order by score desc))
 select source, round(sum(cast(tp as double) / seen * p) / nullif(sum(p), 0), 6) average_precision from c group by source""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.average_precision(scored(spark, sf_dir), "score", "pos", ["source"])


@query(f"""with r as (select pos, row_number() over (order by score desc, doc_id) rn from {SCORED}), b as (select avg(case when pos then 1.0e0 else 0 end) base, count(*) n from {SCORED})
 select k, round(avg(case when pos then 1.0e0 else 0 end), 6) precision_at_k, round(avg(case when pos then 1.0e0 else 0 end) / nullif(any_value(base), 0), 6) lift
 from r, b, (select unnest([10, 20, 30, 50, 100]) k) where rn <= k and k <= n group by k""")
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and lift among the longest documents."""
    return M.precision_at(scored(spark, sf_dir), "score", "doc_id", "pos", [10, 20, 30, 50, 100])


@query("""with c as (select cast(count(*) filter (quality = 1 and toxic = 1) as double) tp, cast(count(*) filter (quality = 0 and toxic = 1) as double) fp,
 cast(count(*) filter (quality = 1 and toxic = 0) as double) fn, cast(count(*) filter (quality = 0 and toxic = 0) as double) tn from labels),
 k as (select *, tp + fp + fn + tn n from c), p as (select *, (tp + tn) / n po, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n) pe from k)
 select cast(tp as bigint) tp, cast(fp as bigint) fp, cast(fn as bigint) fn, cast(tn as bigint) tn, round(po, 6) agreement, round((po - pe) / nullif(1 - pe, 0), 6) kappa,
 round(tp / nullif(tp + fn, 0), 6) recall, round(tn / nullif(tn + fp, 0), 6) specificity from p""")
def confusion_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two labellers."""
    return M.kappa(table(spark, sf_dir, "labels"), "quality", "toxic")


@query(f"select round(corr(case when pos then 1.0e0 else 0.0e0 end, ln(1 + w)), 6) r, cast(count(*) as bigint) n from {SCORED}")
def point_biserial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of the label with log length."""
    return scored(spark, sf_dir).agg(F.round(F.corr(F.col("pos").cast("double"), F.log1p("w")), 6).alias("r"), F.count("*").alias("n"))


#: Step scores and labels of orders' line items: the first item with a discount of 0.08 or more is the error.
STEPS = "(select l_orderkey id, l_linenumber - 1 i, l_tax * 10 p, l_discount >= 0.08 bad from lineitem)"


@query(f"""with s as {STEPS}, c as (select id, min(case when bad then i end) gold, max(p) mp, arg_max(i, (p, -i)) pred from s group by id),
 e as (select *, case when mp > 0.4 then pred else -1 end loc, coalesce(gold, -1) g from c)
 select round(avg(case when g >= 0 then case when loc = g then 1.0e0 else 0 end end), 6) exact, round(avg(case when g >= 0 then case when loc >= 0 and abs(loc - g) <= 1 then 1.0e0 else 0 end end), 6) within_one,
 round(avg(case when g < 0 then case when loc < 0 then 1.0e0 else 0 end end), 6) clean,
 round(2 * avg(case when g >= 0 then case when loc = g then 1.0e0 else 0 end end) * avg(case when g < 0 then case when loc < 0 then 1.0e0 else 0 end end) /
 nullif(avg(case when g >= 0 then case when loc = g then 1.0e0 else 0 end end) + avg(case when g < 0 then case when loc < 0 then 1.0e0 else 0 end end), 0), 6) f1 from e""")
def score_localise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a verifier sees the first error: exact, within one step, clean chains left alone, and their harmonic mean."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") - 1).alias("i"), (F.col("l_tax") * 10).alias("p"), (F.col("l_discount") >= 0.08).alias("bad"))
    c = s.groupBy("id").agg(F.coalesce(F.min(F.when(F.col("bad"), F.col("i"))), F.lit(-1)).alias("g"), F.max("p").alias("mp"), F.max_by("i", F.struct("p", -F.col("i"))).alias("pred"))
    at = F.when(F.col("mp") > 0.4, F.col("pred")).otherwise(-1)
    e = c.select("g", at.alias("at"))
    share = lambda of, hit: F.avg(F.when(of, hit.cast("double")))
    wrong, right = F.col("g") >= 0, F.col("g") < 0
    exact, clean = share(wrong, F.col("at") == F.col("g")), share(right, F.col("at") < 0)
    return e.agg(
        F.round(exact, 6).alias("exact"), F.round(share(wrong, (F.col("at") >= 0) & (F.abs(F.col("at") - F.col("g")) <= 1)), 6).alias("within_one"),
        F.round(clean, 6).alias("clean"), F.round(F.try_divide(2 * exact * clean, exact + clean), 6).alias("f1"),
    )


@query(f"""with g as (select t / 33.0e0 thr from range(1, 34) x(t)), c as (select thr, cast(sum(case when pos and z >= thr then 1 else 0 end) as double) tp, cast(sum(case when not pos and z >= thr then 1 else 0 end) as double) fp,
 cast(sum(case when pos and z < thr then 1 else 0 end) as double) fn from (select pos, w / 2000.0e0 z from {SCORED}), g group by thr), f as (select thr, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) f1 from c)
 select round(thr, 6) threshold, round(f1, 6) f1 from f order by f1 desc, thr limit 1""")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of 33 with the best F1; the first of the best."""
    z = scored(spark, sf_dir).select("pos", (F.col("w") / 2000.0).alias("z"))
    grid = spark.range(1, 34).select((F.col("id") / 33.0).alias("thr"))
    above = F.col("z") >= F.col("thr")
    c = z.crossJoin(F.broadcast(grid)).groupBy("thr").agg(
        F.count_if(F.col("pos") & above).cast("double").alias("tp"), F.count_if(~F.col("pos") & above).cast("double").alias("fp"), F.count_if(F.col("pos") & ~above).cast("double").alias("fn")
    )
    best = c.withColumn("f1", M.f1(F.col("tp"), F.col("fp"), F.col("fn"))).orderBy(F.desc("f1"), "thr").limit(1)
    return best.select(F.round("thr", 6).alias("threshold"), F.round("f1", 6).alias("f1"))


@query(f"""with r as (select doc_id, row_number() over (order by {sql_h(11, 'doc_id')}, doc_id) rn, count(*) over () n from documents) select doc_id, rn <= floor(n * 0.8e0) is_train from r""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact 80/20 split in hash order."""
    return S.train_split(table(spark, sf_dir, "documents").select("doc_id"), 11, "doc_id")


@query("""with g as (select o_custkey, row_number() over (order by o_custkey) rn, count(*) over () n from (select distinct o_custkey from orders))
 select o.o_orderkey, g.rn <= floor(n * 0.8e0) is_train from orders o join g using (o_custkey)""")
def split_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in key order: the first 80 % train, so no group is on both sides."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    last = S.kth_least(orders.select("o_custkey").distinct(), "o_custkey", 0.8)  # one row
    return orders.crossJoin(F.broadcast(last)).select("o_orderkey", (F.col("o_custkey") <= F.col("last")).alias("is_train"))


@query(f"""with r as (select doc_id, source, quality, row_number() over (partition by source, quality order by {sql_h(12, 'doc_id')}, doc_id) rn from documents join labels using (doc_id))
 select doc_id, source, quality from r where rn <= 2""")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents of each class and source, the first in hash order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    rank = S.rank_by_hash(12, F.col("doc_id"), [F.col("source"), F.col("quality")])
    return docs.withColumn("rn", rank).where("rn <= 2").drop("rn")


@query("""with c as (select l_orderkey k, l_returnflag answer, count(*) n, min(l_linenumber) first from lineitem group by 1, 2), r as (select *, row_number() over (partition by k order by n desc, first, answer) rn from c)
 select k, answer, cast(n as bigint) votes from r where rn = 1""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent answer of each problem; ties to the first seen."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("answer")).agg(F.count("*").alias("n"), F.min("l_linenumber").alias("first"))
    best = c.groupBy("k").agg(F.min_by(F.struct("answer", "n"), F.struct(-F.col("n"), "first", "answer")).alias("b"))
    return best.select("k", "b.answer", F.col("b.n").alias("votes"))


@query("""with i as (select l_orderkey k, l_returnflag = 'N' ok, l_extendedprice s, l_linenumber pos, l_returnflag answer from lineitem),
 p as (select k, avg(case when ok then 1.0e0 else 0 end) random, bool_or(ok) oracle, arg_max(ok, (s, -pos)) rerank from i group by k),
 v as (select k, answer, count(*) n, min(pos) f from i group by 1, 2), m as (select k, arg_min(answer, (-n, f, answer)) = 'N' majority from v group by k)
 select cast(count(*) as bigint) problems, round(avg(random), 6) random, round(avg(case when majority then 1.0e0 else 0 end), 6) majority, round(avg(case when rerank then 1.0e0 else 0 end), 6) rerank,
 round(avg(case when oracle then 1.0e0 else 0 end), 6) oracle from p join m using (k) where random > 0 and random < 1""")
def rerank_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random, majority, best-scored and oracle choice on problems with both right and wrong candidates."""
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_returnflag") == "N").alias("ok"), F.col("l_extendedprice").alias("s"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("answer"))
    votes = i.groupBy("k", "answer").agg(
        F.count("*").alias("n"), F.min("pos").alias("f"), F.sum(F.col("ok").cast("double")).alias("right"), F.max(F.struct("s", -F.col("pos"), "ok")).alias("top")
    )
    p = votes.groupBy("k").agg(
        (F.sum("right") / F.sum("n")).alias("random"), (F.max("right") > 0).alias("oracle"), F.max("top")["ok"].alias("rerank"), (F.min_by("answer", F.struct(-F.col("n"), "f", "answer")) == "N").alias("majority")
    )
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c)
    return p.where("random > 0 and random < 1").agg(F.count("*").alias("problems"), *map(mean, ("random", "majority", "rerank", "oracle")))


BOOT = f"""g as (select source, row_number() over (order by source) - 1 idx, count(*) over () n from (select distinct source from {SCORED})),
 c as (select source, cast(sum(case when pos and w < 200 then 1 else 0 end) as double) tp, cast(sum(case when not pos and w < 200 then 1 else 0 end) as double) fp, cast(sum(case when pos and w >= 200 then 1 else 0 end) as double) fn,
 cast(sum(case when pos and score % 2 = 0 then 1 else 0 end) as double) tp2, cast(sum(case when not pos and score % 2 = 0 then 1 else 0 end) as double) fp2, cast(sum(case when pos and score % 2 = 1 then 1 else 0 end) as double) fn2 from {SCORED} group by source),
 d as (select b, {sql_h(13, 'b', 'slot')} % n idx from (select unnest(range(0, 50)) b), (select unnest(range(0, n)) slot, n from (select any_value(n) n from g))),
 s as (select b, sum(tp) tp, sum(fp) fp, sum(fn) fn, sum(tp2) tp2, sum(fp2) fp2, sum(fn2) fn2 from d join g using (idx) join c using (source) group by b),
 f as (select b, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) f1, coalesce(2 * tp2 / nullif(2 * tp2 + fp2 + fn2, 0), 0) f2 from s)"""


def _bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    n = lambda c: F.count_if(c).cast("double")
    short, even, pos = F.col("w") < 200, F.col("score") % 2 == 0, F.col("pos")
    counts = rows.groupBy("source").agg(
        n(pos & short).alias("tp"), n(~pos & short).alias("fp"), n(pos & ~short).alias("fn"), n(pos & even).alias("tp2"), n(~pos & even).alias("fp2"), n(pos & ~even).alias("fn2")
    )
    groups = counts.withColumn("idx", F.row_number().over(Window.orderBy("source")) - 1)
    draws = S.bootstrap(groups, 50, 13)
    sums = draws.join(groups, "idx").groupBy("b").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tp2", "fp2", "fn2")])
    f = lambda a, b, c: M.f1(F.col(a), F.col(b), F.col(c))
    return sums.select("b", f("tp", "fp", "fn").alias("f1"), f("tp2", "fp2", "fn2").alias("f2"))


@query(f"with {BOOT} select round(quantile_cont(f1, 0.025), 6) lo, round(quantile_cont(f1, 0.975), 6) hi, round(avg(f1), 6) mean_f1 from f")
def bootstrap_f1_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile interval of F1 over resampled groups."""
    return _bootstrap(spark, sf_dir).agg(
        F.round(F.percentile("f1", 0.025), 6).alias("lo"), F.round(F.percentile("f1", 0.975), 6).alias("hi"), F.round(F.avg("f1"), 6).alias("mean_f1")
    )


@query(f"with {BOOT} select round(quantile_cont(f1 - f2, 0.025), 6) lo, round(quantile_cont(f1 - f2, 0.975), 6) hi, not (quantile_cont(f1 - f2, 0.025) <= 0 and quantile_cont(f1 - f2, 0.975) >= 0) significant from f")
def paired_diff_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the difference of two rules on the same resamples."""
    d = _bootstrap(spark, sf_dir).select((F.col("f1") - F.col("f2")).alias("d"))
    lo, hi = F.percentile("d", 0.025), F.percentile("d", 0.975)
    return d.agg(F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"), (~((lo <= 0) & (hi >= 0))).alias("significant"))


@query(f"""with r as (select k, row_number() over (order by {sql_h(14, 'k')}, k) rn, w, p from (select doc_id k, len({words_sql('text')}) w, length(text) p from documents)), g as (select floor((rn - 1) / 8) g, k, w, p from r)
 select cast(g as bigint) grp, arg_max(k, (p, -k)) by_score, arg_min(k, (w, k)) by_length, cast(count(*) as bigint) n from g group by g""")
def best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-groups of eight in hash order, and what two selectors choose from each."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), T.n_words(F.col("text")).alias("w"), F.length("text").alias("p"))
    ranked = S.bounded_rank(rows, 14, "k").withColumn("grp", F.floor((F.col("rank") - 1) / 8).cast("long"))
    return ranked.groupBy("grp").agg(F.max_by("k", F.struct("p", -F.col("k"))).alias("by_score"), F.min_by("k", F.struct("w", "k")).alias("by_length"), F.count("*").alias("n"))



