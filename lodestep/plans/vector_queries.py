"""Queries over vectors: pooling, retrieval, projections, standardisation, residuals, probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestep.functions import text as T
from lodestep.functions import vectors as V
from lodestep.operators import confound as C
from lodestep.operators import metrics as M
from lodestep.plans.metric_queries import SCORED, scored
from lodestep.plans.registry import query
from lodestep.plans.text_queries import words_sql
from lodestep.sources.tables import table


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each component."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


LONG = "(select vec_id, label, unnest(range(0, len(embedding))) dim, cast(unnest(embedding) as double) x from embeddings)"


@query(f"select label, cast(dim as integer) dim, round(avg(x), 6) mean, round(stddev_pop(x), 6) sd from {LONG} group by label, dim")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and spread of each dimension over a chain's steps."""
    return long(spark, sf_dir).groupBy("label", "dim").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("sd"))


@query(f"""with l as (select vec_id, label, cast(embedding[1] as double) a from embeddings), w as (select vec_id, label, exp(a - max(a) over (partition by label)) e from l),
 s as (select vec_id, label, e / sum(e) over (partition by label) p from w) select s.label, cast(dim as integer) dim, round(sum(p * x), 6) pooled from s join {LONG} v using (vec_id) group by s.label, dim""")
def attn_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax-weighted sum of a chain's steps; the weights' sums come from one pass, no window over a chain."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.get("embedding", F.lit(0)).cast("double").alias("a"))
    top = v.groupBy("label").agg(F.max("a").alias("top"))
    weighted = v.join(top, "label").withColumn("e", F.exp(F.col("a") - F.col("top")))
    parts = weighted.select("label", "e", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg((F.sum(F.col("e") * F.col("x")) / F.sum("e")).alias("p"))
    return parts.select("label", "dim", F.round("p", 6).alias("pooled"))


@query("""with u as (select label, vec_id, list_transform(embedding, lambda x: cast(x as double) / sqrt(list_sum(list_transform(embedding, lambda y: cast(y as double) * y)))) v from embeddings)
 select a.label, round(avg(list_dot_product(a.v, b.v)), 6) mean_cosine from u a join u b on a.label = b.label and a.vec_id <> b.vec_id group by a.label""")
def pairwise_cosine_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of a class's pairs in closed form: no pair is made."""
    unit = table(spark, sf_dir, "embeddings").select("label", V.unit(F.col("embedding")).alias("v")).select("label", F.posexplode("v").alias("dim", "x"))
    sums = unit.groupBy("label", "dim").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    out = sums.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").cast("double").alias("n"))
    return out.select("label", F.round(F.try_divide(F.col("q") - F.col("n"), F.col("n") * (F.col("n") - 1)), 6).alias("mean_cosine"))


@query("""with q as (select vec_id id, embedding v from embeddings where vec_id % 100 = 0), s as (select q.id, t.vec_id = q.id + 1 own, round(list_cosine_similarity(cast(q.v as double[]), cast(t.embedding as double[])), 9) sim from q, embeddings t where t.vec_id <> q.id),
 r as (select id, 1 + count(*) filter (sim > o) rank from (select *, max(case when own then sim end) over (partition by id) o from s) where o is not null group by id)
 select round(avg(case when rank <= 1 then 1.0e0 else 0 end), 6) recall1, round(avg(case when rank <= 10 then 1.0e0 else 0 end), 6) recall10, round(avg(1.0e0 / rank), 6) mrr, quantile_cont(cast(rank as double), 0.5) median_rank from r""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each stated query, an id divisible by 100, finds its own target among every other row."""
    return M.retrieval_whole(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query()
def retrieval_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each query finds its own target among every other row of the table."""
    return M.retrieval_whole(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("""with a as (select vec_id, vec_id // 2 grp, embedding v from embeddings where vec_id % 2 = 0), b as (select vec_id, vec_id // 2 grp, embedding v from embeddings where vec_id % 2 = 1)
 select e.vec_id, case when e.vec_id % 2 = 1 then round(greatest(0.0e0, least(1.0e0, (list_cosine_similarity(cast(b.v as double[]), cast(a.v as double[])) + 1) / 2)), 4) end hardness from embeddings e left join a on a.grp = e.vec_id // 2 left join b on b.vec_id = e.vec_id""")
def hardness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closeness of each group's unsound member to its sound one, written onto the unsound one only."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 2).alias("grp"), "embedding")
    a = v.where("vec_id % 2 = 0").select("grp", F.col("embedding").alias("a"))
    close = F.round(V.cosine01(F.col("embedding"), F.col("a")), 4)
    return v.join(a, "grp", "left").select("vec_id", F.when(F.col("vec_id") % 2 == 1, close).alias("hardness"))


DOT = "(0.5e0 * (cast(embedding[1] as double) + embedding[2] + embedding[3] + embedding[4]))"


def _moved_sql(by: str) -> str:
    """Every component of every vector, the first four moved by ``by`` times their share of the unit direction."""
    return f"select vec_id, cast(d as integer) dim, round(cast(embedding[d + 1] as double) + case when d < 4 then ({by}) * 0.5e0 else 0 end, 6) x from (select *, unnest(range(0, len(embedding))) d from embeddings)"


def _directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.array(*[F.lit(0.5 if i < 4 else 0.0) for i in range(64)])
    v = table(spark, sf_dir, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"), w.alias("w"))
    return v.withColumn("d", V.dot(F.col("v"), F.col("w")))


def _moved(v: DataFrame, by: Column) -> DataFrame:
    return v.select("vec_id", F.posexplode(V.rounded(V.add(F.col("v"), F.col("w"), by))).alias("dim", "x"))


@query(_moved_sql(f"-{DOT}"))
def project_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors without their part along a unit direction."""
    return _moved(_directed(spark, sf_dir), -F.col("d"))


@query(_moved_sql(f"(select avg({DOT}) from embeddings) - {DOT}"))
def mean_ablate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part along a direction replaced by its mean."""
    v = _directed(spark, sf_dir)
    mean = v.agg(F.avg("d").alias("m"))
    return _moved(v.crossJoin(F.broadcast(mean)), F.col("m") - F.col("d"))  # one row


@query(_moved_sql(f"2 * (select stddev_pop({DOT}) from embeddings)"))
def steer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two standard deviations added along a direction."""
    v = _directed(spark, sf_dir)
    sd = v.agg(F.stddev_pop("d").alias("s"))
    return _moved(v.crossJoin(F.broadcast(sd)), 2 * F.col("s"))  # one row


@query(f"""with f as (select doc_id, lang, cast(len({words_sql('text')}) as double) w from documents), m as (select avg(w) mu, stddev_pop(w) sd from f)
 select doc_id, round((w - mu) / case when sd = 0 then 1 else sd end, 6) z_len, cast(lang = 'en' as integer) is_en, cast(lang = 'de' as integer) is_de, cast(lang = 'fr' as integer) is_fr, cast(lang = 'es' as integer) is_es from f, m""")
def standardise_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confound columns: standardised length and one indicator for each category."""
    f = table(spark, sf_dir, "documents").select("doc_id", "lang", T.n_words(F.col("text")).cast("double").alias("w"))
    return C.standardise(f, ["w"]).select("doc_id", F.round("z_w", 6).alias("z_len"), *[(F.col("lang") == x).cast("int").alias(f"is_{x}") for x in ("en", "de", "fr", "es")])


@query(f"""with m as (select *, ln(1 + w) x, cast(score as double) y from {SCORED}), t as (select regr_slope(y, x) b, regr_intercept(y, x) a from m where doc_id % 5 <> 0)
 select doc_id, round(y - (a + b * x), 4) residual from m, t""")
def residualize_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of a score on log length, the line fit on training rows only and applied to all."""
    m = scored(spark, sf_dir).select("doc_id", F.log1p("w").alias("x"), F.col("score").cast("double").alias("y"))
    out = C.residualize(m, ["y"], ["x"], F.col("doc_id") % 5 != 0)
    return out.select("doc_id", F.round("y_residual", 4).alias("residual"))


@query(f"""with m as (select doc_id, lang, ln(1 + len({words_sql('text')})) y from documents), g as (select lang, avg(y) mu from m where doc_id % 5 <> 0 group by lang)
 select doc_id, round(y - mu, 6) residual from m join g using (lang)""")
def residualize_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals on category indicators by the normal equations; equal to taking each category's training mean away."""
    m = table(spark, sf_dir, "documents").select("doc_id", "lang", F.log1p(T.n_words(F.col("text"))).alias("y"))
    m = m.select("*", *[(F.col("lang") == x).cast("double").alias(f"c_{x}") for x in ("de", "es", "fr")])
    out = C.residualize(m, ["y"], ["c_de", "c_es", "c_fr"], F.col("doc_id") % 5 != 0)
    return out.select("doc_id", F.round("y_residual", 6).alias("residual"))


@query("""with c as (select greatest(0, least(1, t / 10.0e0)) t from range(0, 11) x(t)), e as (select c.t, avg(list_distance(cast(a.embedding as double[]), list_transform(cast(a.embedding as double[]), lambda x: x * (1 - c.t)))) err from embeddings a, c group by c.t),
 b as (select min(err) lo, max(err) hi from e) select round(t, 6) dose, round(err, 6) mean_error, round((select min(t) from e, b where err >= lo + 0.5e0 * (hi - lo)), 6) breakdown from e""")
def breakdown_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean error by dose and the first dose at which half the range is reached."""
    v = table(spark, sf_dir, "embeddings").select(V.doubles(F.col("embedding")).alias("v"))
    doses = spark.range(0, 11).select((F.col("id") / 10.0).alias("t"))
    err = v.crossJoin(F.broadcast(doses)).select("t", V.distance(F.col("v"), V.scaled(F.col("v"), 1 - F.col("t"))).alias("e")).groupBy("t").agg(F.avg("e").alias("err"))
    everything = Window.partitionBy()  # eleven doses
    half = F.min("err").over(everything) + 0.5 * (F.max("err").over(everything) - F.min("err").over(everything))
    marked = err.withColumn("half", half).withColumn("breakdown", F.min(F.when(F.col("err") >= F.col("half"), F.col("t"))).over(everything))
    return marked.select(F.round("t", 6).alias("dose"), F.round("err", 6).alias("mean_error"), F.round("breakdown", 6).alias("breakdown"))


@query()
def probe_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regularised linear probe of one class: accuracy, F1 and AUC on held-out vectors."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") == 0).cast("double").alias("y"), "embedding")
    return C.probe(v, "embedding", "y", F.col("vec_id") % 5 != 0)


@query()
def pca_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors on their first two principal components."""
    return C.pca(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), "embedding", 2)


@query()
def loo_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes that leave one group out, tested on that group."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") < 5).cast("double").alias("y"), "embedding", (F.col("vec_id") % 3).alias("grp"))
    return C.leave_one_out(v, "embedding", "y", "grp", [0, 1, 2])
