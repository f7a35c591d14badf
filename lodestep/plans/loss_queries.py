"""Queries over losses, attributions, separations by dimension, judge gaps and slim rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestep.functions import vectors as V
from lodestep.functions.rand import sql_h
from lodestep.operators import losses as L
from lodestep.operators import metrics as M
from lodestep.plans.metric_queries import SCORED, scored
from lodestep.plans.registry import query
from lodestep.sources.tables import table

#: So many vectors are a batch.
BATCH = 32
COS = "(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"
VECTORS = f"(select vec_id, vec_id // {BATCH} batch, label, list_transform(embedding, lambda x: cast(x as double)) v from embeddings)"
PAIRS = "(select a.vec_id // 2 pair, a.batch, a.label, a.v a, b.v b from v a join v b on a.vec_id % 2 = 0 and b.vec_id = a.vec_id + 1)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.expr(f"vec_id div {BATCH}").alias("batch"), "label", V.doubles(F.col("embedding")).alias("v"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).withColumn("pair", F.expr("vec_id div 2"))
    a = v.where("vec_id % 2 = 0").select("pair", "batch", "label", F.col("v").alias("a"))
    return a.join(v.where("vec_id % 2 = 1").select("pair", F.col("v").alias("b")), "pair")


@query(f"""with v as {VECTORS}, p as {PAIRS}, m as (select x.pair, x.pair = y.pair own, {COS.format(a='x.a', b='y.b')} / 0.07e0 s from p x join p y using (batch)),
 r as (select ln(sum(exp(s))) - sum(case when own then s else 0 end) l from m group by pair),
 c as (select a.vec_id, a.label = b.label same, {COS.format(a='a.v', b='b.v')} / 0.1e0 s from v a join v b on a.batch = b.batch and a.vec_id <> b.vec_id), k as (select ln(sum(exp(s))) - avg(case when same then s end) l from c group by vec_id),
 t as (select greatest(0, list_distance(x.a, x.b) - list_distance(x.a, y.b) + 0.5e0) l from p x join p y on y.pair = x.pair + 1)
 select 'ranking' loss, (select round(avg(l), 6) from r) as value union all select 'class_contrast', (select round(avg(l), 6) from k) union all select 'triplet', (select round(avg(l), 6) from t)""")
def contrast_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-batch ranking loss of pairs, supervised contrastive loss of classes, and triplet loss against the next pair."""
    pairs = _pairs(spark, sf_dir)
    ranking = L.ranking_loss(pairs, "batch", "pair", "a", "b", 0.07).select(F.lit("ranking").alias("loss"), F.col("loss").alias("value"))
    classes = L.class_contrast_loss(_vectors(spark, sf_dir), "batch", "vec_id", "v", "label", 0.1).select(F.lit("class_contrast").alias("loss"), F.col("loss").alias("value"))
    far = pairs.select((F.col("pair") - 1).alias("pair"), F.col("b").alias("n"))
    triplet = pairs.join(far, "pair").agg(F.round(F.avg(L.triplet_loss(F.col("a"), F.col("b"), F.col("n"))), 6).alias("value"))
    return ranking.union(classes).union(triplet.select(F.lit("triplet").alias("loss"), "value"))


@query(f"""with v as {VECTORS}, p as {PAIRS}, s as (select (l_tax - 0.04) * 50 x, case when l_linenumber % 3 = 0 then -1 when l_discount >= 0.08 then 1 else 0 end y from lineitem)
 select (select round(avg(1 - {COS.format(a='a', b='b')}), 6) from p) denoise, (select round(avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))), 6) from s where y >= 0) step_entropy, (select cast(count(*) as bigint) from s where y >= 0) labelled""")
def reconstruction_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of one less the cosine of each vector with its reconstruction, and the cross entropy of step logits over labelled steps alone."""
    denoise = _pairs(spark, sf_dir).agg(F.round(F.avg(1 - V.cosine(F.col("a"), F.col("b"))), 6).alias("denoise"))
    label = F.when(F.col("l_linenumber") % 3 == 0, -1).when(F.col("l_discount") >= 0.08, 1).otherwise(0)
    loss = L.cross_entropy_of_logit((F.col("l_tax") - 0.04) * 50, label)
    steps = table(spark, sf_dir, "lineitem").select(loss.alias("l")).agg(F.round(F.avg("l"), 6).alias("step_entropy"), F.count("l").alias("labelled"))
    return denoise.crossJoin(steps)  # one row each


@query("""with e as (select vec_id, vec_id % 12 layer, unnest(range(0, len(embedding))) d, cast(unnest(embedding) as double) x from embeddings), s as (select vec_id, layer, d // 8 head, sum(x * ((d * 7) % 5 - 2) / 10.0e0) w from e group by all)
 select cast(layer as integer) layer, cast(head as integer) head, round(avg(abs(w)), 6) written, cast(count(*) as bigint) n from s group by layer, head""")
def head_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each head of each layer writes onto a direction: the mean size of its part's product with the direction's part."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 12).cast("int").alias("layer"), F.posexplode(V.doubles(F.col("embedding"))).alias("d", "x"))
    part = e.groupBy("vec_id", "layer", F.expr("cast(d div 8 as int)").alias("head")).agg(F.sum(F.col("x") * ((F.col("d") * 7) % 5 - 2) / 10.0).alias("w"))
    return part.groupBy("layer", "head").agg(F.round(F.avg(F.abs("w")), 6).alias("written"), F.count("*").alias("n"))


@query("""with e as (select label % 2 = 1 pos, unnest(range(0, len(embedding))) d, cast(unnest(embedding) as double) x from embeddings where label is not null),
 r as (select d, pos, rank() over (partition by d order by x) + (count(*) over (partition by d, x) - 1) / 2.0e0 r from e), a as (select d, sum(case when pos then r else 0 end) s, cast(count(*) filter (pos) as double) p, cast(count(*) as double) n from r group by d)
 select cast(d as integer) dim, round((s - p * (p + 1) / 2) / nullif(p * (n - p), 0), 6) auc from a""")
def dimension_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each component alone tells odd labels, as its AUC over exact values."""
    e = table(spark, sf_dir, "embeddings").where("label is not null").select((F.col("label") % 2 == 1).alias("pos"), F.posexplode(V.doubles(F.col("embedding"))).alias("dim", "x"))
    return M.auc(e, "x", "pos", ["dim"])


@query(f"""with r as (select doc_id, cast(floor(ln(1 + w) * 10) as bigint) lvl, pos human, score % 3 = 0 or w < 50 judge from {SCORED}), c as (select {sql_h(64, 'doc_id')} % 50 block, lvl, cast(count(*) filter (human) as double) p1, cast(count(*) filter (judge) as double) p2, cast(count(*) as double) n from r group by all),
 g as (select block, row_number() over (order by block) - 1 idx, count(*) over () m from (select distinct block from c)), d as (select b, {sql_h(64, 'b', 'slot')} % m idx from (select unnest(range(0, 200)) b), (select unnest(range(0, m)) slot, m from (select any_value(m) m from g)) union all select -1, idx from g),
 s as (select b, lvl, sum(p1) p1, sum(p2) p2, sum(n) n from d join g using (idx) join c using (block) group by all), w as (select *, coalesce(sum(n) over (partition by b order by lvl rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2 k from s),
 a as (select b, (sum(k * p1) - sum(p1) * (sum(p1) + 1) / 2) / nullif(sum(p1) * (sum(n) - sum(p1)), 0) a1, (sum(k * p2) - sum(p2) * (sum(p2) + 1) / 2) / nullif(sum(p2) * (sum(n) - sum(p2)), 0) a2 from w group by b), f as (select b, greatest(a2, 1 - a2) - greatest(a1, 1 - a1) d from a)
 select round(max(d) filter (b < 0), 6) gap, round(quantile_cont(d, 0.025) filter (b >= 0), 6) lo, round(quantile_cont(d, 0.975) filter (b >= 0), 6) hi, quantile_cont(d, 0.025) filter (b >= 0) > 0 or quantile_cont(d, 0.975) filter (b >= 0) < 0 significant from f""")
def judge_gap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more a judge's label goes with length than the human label does, with an interval over resampled blocks of documents."""
    judge = (F.col("score") % 3 == 0) | (F.col("w") < 50)
    rows = scored(spark, sf_dir).select("doc_id", F.floor(F.log1p("w") * 10).alias("lvl"), F.col("pos").alias("human"), judge.alias("judge"))
    return L.auc_gap_interval(rows, "doc_id", "lvl", "human", "judge", 200, 64)


@query(f"""with v as {VECTORS}, p as {PAIRS}, g as (select pair % 3 tier, label % 2 = 1 b, round(list_distance(a, b), 6) gap from p), r as (select tier, b, gap, rank() over (partition by tier order by gap) + (count(*) over (partition by tier, gap) - 1) / 2.0e0 r from g),
 a as (select tier, sum(case when b then r else 0 end) s, cast(count(*) filter (b) as double) k, cast(count(*) as double) n, avg(case when b then gap end) gb, avg(case when not b then gap end) ga from r group by tier)
 select cast(tier as integer) tier, cast(n as bigint) n, round(gb, 6) gap_unsound, round(ga, 6) gap_other, round((s - k * (k + 1) / 2) / nullif(k * (n - k), 0), 6) auc from a""".replace("p as (select a.vec_id // 2 pair, a.batch, a.label, a.v a, b.v b", "p as (select a.vec_id // 2 pair, a.batch, a.label, a.v a, b.v b2").replace("list_distance(a, b)", "list_distance(a, b2)"))
def thinking_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each tier the mean distance of thinking and response vectors of unsound and other solutions, and its AUC."""
    rows = _pairs(spark, sf_dir).select((F.col("pair") % 3).cast("int").alias("tier"), (F.col("label") % 2 == 1).alias("odd"), F.round(V.distance(F.col("a"), F.col("b")), 6).alias("gap"))
    mean = lambda c: F.round(F.avg(F.when(c, F.col("gap"))), 6)
    means = rows.groupBy("tier").agg(F.count("*").alias("n"), mean(F.col("odd")).alias("gap_unsound"), mean(~F.col("odd")).alias("gap_other"))
    return means.join(M.auc(rows, "gap", "odd", ["tier"]), "tier")


@query("""select doc_id, left(text, 200) head, left(text, 500) longer, right(text, 1200) tail from documents""")
def slim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a few columns with their texts' beginnings and ends, as a reviewer reads them."""
    return table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(200)).alias("head"), F.left("text", F.lit(500)).alias("longer"), F.right("text", F.lit(1200)).alias("tail"))


@query("select doc_id, lang, source from documents order by doc_id limit 25 offset 40")
def worklist_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of a work list in the order of ids."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").orderBy("doc_id").offset(40).limit(25)
