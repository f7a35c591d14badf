"""Queries over cross-fitted control, directions and erasure, matching, judge errors and grids of corruptions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestep.functions import patterns as P
from lodestep.functions import vectors as V
from lodestep.functions.rand import h, sql_h
from lodestep.operators import confound as C
from lodestep.operators import controls as K
from lodestep.operators import corrupt as X
from lodestep.operators import probes as R
from lodestep.plans.corruption_queries import STEPS as STEPS_SQL
from lodestep.plans.corruption_queries import documents
from lodestep.plans.metric_queries import SCORED, scored
from lodestep.plans.registry import query
from lodestep.plans.text_queries import q
from lodestep.sources.tables import table

FOLD_SQL = f"{sql_h(61, 'doc_id')} % 5"


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("doc_id", "pos", F.log1p("w").alias("ll"), F.col("w").cast("double").alias("w"), F.col("score").cast("double").alias("score"))
    return rows.withColumn("fold", (h(61, F.col("doc_id")) % 5).cast("int"))


def _crossfit_sql(x: str, y: str, strength: str) -> str:
    """Common table expressions: rows m (doc_id, f, x, y) and coefficients c (f, a, b) fitted on the other folds."""
    return f"""m as (select doc_id, {FOLD_SQL} f, cast({x} as double) x, cast({y} as double) y from {SCORED}),
 s as (select f, cast(count(*) as double) n, avg(x) mx, avg(y) my, sum(x) sx, sum(y) sy from m group by f), g as (select a.f, sum(b.n) n, sum(b.sx) / sum(b.n) mx, sum(b.sy) / sum(b.n) my from s a join s b on a.f <> b.f group by a.f),
 c as (select g.f, sum((x - g.mx) * (y - g.my)) / (sum((x - g.mx) * (x - g.mx)) + {strength}) b, any_value(g.mx) mx, any_value(g.my) my from g join m on m.f <> g.f group by g.f)"""


@query(f"with {_crossfit_sql('ln(1 + w)', 'score', '0')} select doc_id, cast(f as integer) fold, round(y - c.my - c.b * (x - c.mx), 3) residual from m join c using (f)")
def crossfit_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score's residuals on log length, each row's fit made on the four folds that it is not in."""
    out, _ = K.crossfit(_folded(spark, sf_dir), ["score"], ["ll"], "fold")
    return out.select("doc_id", "fold", F.round("score_residual", 3).alias("residual"))


def _stage_sql(name: str, x: str, y: str) -> str:
    return f"""select '{name}' stage, (with {_crossfit_sql(x, y, '1')}, r as (select f, sum((y - c.my - c.b * (x - c.mx)) ** 2) e, var_pop(y) * count(*) v from m join c using (f) group by f)
 select round(avg(1 - e / v), 5) from r) r2"""


@query(" union all ".join([_stage_sql("characters", "score", "ln(1 + w)"), _stage_sql("words", "w", "ln(1 + w)"), _stage_sql("label", "case when pos then 1 else 0 end", "ln(1 + w)")]))
def stage_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each stage tells log length: five-fold held-out R2 of ridge regression of unit strength."""
    rows = _folded(spark, sf_dir).withColumn("label", F.col("pos").cast("double"))
    stages = {"characters": "score", "words": "w", "label": "label"}
    found = [(name, round(K.crossfit(rows, ["ll"], [c], "fold", 1.0)[1]["ll"], 5)) for name, c in stages.items()]
    return spark.createDataFrame(found, "stage string, r2 double")


@query()
def kernel_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score's cross-fitted residuals on what is not linear in log length: ridge regression on random Fourier features."""
    rows, names = K.fourier_features(C.standardise(_folded(spark, sf_dir), ["ll"]), ["z_ll"], 32, 0.5, 62)
    out, _ = K.crossfit(rows, ["score"], names, "fold", 1.0)
    return out.select("doc_id", "fold", F.round("score_residual", 3).alias("residual"))


@query()
def judge_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a label can be told from confounds alone: the held-out AUC of each of five folds and their mean, as ``fold`` -1."""
    rows = C.standardise(_folded(spark, sf_dir), ["ll", "score"]).select("fold", F.col("pos").cast("int").alias("label"), F.array("z_ll", "z_score").alias("v"))
    models = [R.Model(f"fold {f}", f, [0, 1]) for f in range(5)]
    weights = R.fit_logistic(rows, "v", 2, "label", "fold", models)
    found = R.held_out_metrics(R.held_out_scores(rows, "v", 2, "label", "fold", models, weights), ["fold"])
    # A grouping set: the folds' rows and, in the same pass, the mean over them.
    every = F.grouping_id() == 1
    return found.select(F.col("fold").cast("int").alias("f"), "n", "auc").groupingSets([["f"], []], "f").agg(every.alias("m"), F.sum("n").alias("n"), F.round(F.avg("auc"), 6).alias("auc")).select(
        F.when(F.col("m"), -1).otherwise(F.col("f")).alias("fold"), "n", "auc"
    )


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("label is not null").select("vec_id", "embedding", "label", (F.col("label") % 2).alias("odd"))


def _components(v: DataFrame, change: K.Change) -> DataFrame:
    out = K.changed(v.select("vec_id", "embedding"), "embedding", change)
    return out.select("vec_id", F.posexplode(V.rounded(F.col("embedding"))).alias("dim", "x"))


@query("""with e as (select vec_id, cast(label as double) y, unnest(range(0, len(embedding))) d, cast(unnest(embedding) as double) x from embeddings where label is not null), c as (select d, covar_pop(x, y) c from e group by d),
 w as (select d, c / sqrt(sum(c * c) over ()) w from c), p as (select vec_id, sum(x * w) p from e join w using (d) group by vec_id) select vec_id, cast(d as integer) dim, round(x - p * w, 6) x from e join w using (d) join p using (vec_id)""")
def pls_ablate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors without the direction that goes most with the label."""
    rows = _embedded(spark, sf_dir)
    _, covariance, cross, _ = K.vector_moments(rows, "embedding", ["label"])
    return _components(rows, K.ablation(K.pls_directions(covariance, cross, 1)))


@query()
def erase_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors changed the least so that no linear function of them goes with the label."""
    rows = _embedded(spark, sf_dir)
    mean, covariance, cross, _ = K.vector_moments(rows, "embedding", ["label"])
    return _components(rows, K.erasure(mean, covariance, cross))


@query()
def oblique_erase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors without two directions that go with the label, what lies along four that go with its parity put back."""
    rows = _embedded(spark, sf_dir)
    _, covariance, cross, _ = K.vector_moments(rows, "embedding", ["label", "odd"])
    basis, kept = K.pls_directions(covariance, cross[:, :1], 2), K.pls_directions(covariance, cross[:, 1:], 4)
    return _components(rows, K.oblique_ablation(basis, kept))


def sweep_sql(rows: str, exact: str, width: str = "0.1e0") -> str:
    """Common table expressions from ``rows`` (``exact``, key, pos, ll): z has a_key and b_key of the pairs that a sweep of both classes in order makes, group by group."""
    lists = ", ".join(f"list({c} order by ll, key) filter ({p}) {n}" for n, c, p in (("a", "key", "not pos"), ("al", "ll", "not pos"), ("b", "key", "pos"), ("bl", "ll", "pos")))
    close = f"abs(al[i] - bl[j]) <= {width}"
    return f"""r as ({rows}), g as (select {exact}, {lists} from r group by all having count(*) filter (pos) > 0 and count(*) filter (not pos) > 0),
 z as (select {exact}, 1 i, 1 j, cast(null as bigint) a_key, cast(null as bigint) b_key from g union all select {exact}, case when {close} or al[i] < bl[j] then i + 1 else i end, case when {close} or al[i] > bl[j] then j + 1 else j end,
  case when {close} then a[i] end, case when {close} then b[j] end from z join g using ({exact}) where i <= len(a) and j <= len(b))"""


_CLOSE = f"select d.doc_id as key, d.source, len(s.steps) steps, quality = 0 pos, ln(1 + length(d.text)) ll from documents d join {STEPS_SQL} s using (doc_id) join labels l using (doc_id) where quality is not null and d.text is not null"


@query(f"with recursive {sweep_sql(_CLOSE, 'source, steps')} select source, cast(steps as integer) steps, a_key, b_key from z where a_key is not null")
def matched_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many sound and unsound documents of one source and one number of steps as can be paired one to one, lengths at most a tenth apart on a log scale."""
    rows = documents(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    labels = table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", (F.col("quality") == 0).alias("pos"))
    rows = rows.join(labels, "doc_id").select("doc_id", "source", F.size("steps").alias("steps"), "pos", F.log1p(F.length("text")).alias("ll"))
    return K.matched(rows, "doc_id", "pos", ["source", "steps"], "ll", 0.1)


@query(f"""with i as (select l_orderkey k, l_quantity / sum(l_quantity) over (partition by l_orderkey) a, l_discount >= 0.08 e from lineitem),
 s as (select k, sum(case when e then a else 0 end) es, count(*) filter (e) en, sum(case when e then 0 else a end) os, count(*) filter (not e) o_n from i group by k having count(*) filter (e) > 0 and count(*) filter (not e) > 0),
 b as (select {sql_h(63, 'k')} % 200 block, count(*) c, sum(es) es, sum(en) en, sum(os) os, sum(o_n) o_n from s group by 1), g as (select *, row_number() over (order by block) - 1 idx, count(*) over () n from b),
 d as (select b, {sql_h(63, 'b', 'slot')} % n idx from (select unnest(range(0, 1000)) b), (select unnest(range(0, n)) slot, n from (select any_value(n) n from g))),
 f as (select b, sum(es) / sum(en) - sum(os) / sum(o_n) d from d join g using (idx) group by b)
 select (select cast(sum(c) as bigint) from b) as groups, (select round(sum(es) / sum(en) - sum(os) / sum(o_n), 6) from b) gap, round(quantile_cont(d, 0.025), 6) lo, round(quantile_cont(d, 0.975), 6) hi, quantile_cont(d, 0.025) > 0 or quantile_cont(d, 0.975) < 0 excludes_zero from f""")
def attention_gap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention on error steps less that on other steps of the same chains, with an interval over resampled chains."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", (F.col("l_discount") >= 0.08).alias("e"))
    whole = items.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    rows = items.join(whole, "l_orderkey").select("l_orderkey", (F.col("l_quantity") / F.col("q")).alias("a"), "e")
    return K.gap_interval(rows, "l_orderkey", "a", "e", 1000, 63)


@query(f"""with s as (select doc_id, text, steps, {sql_h(8, 'doc_id')} % greatest(len(steps) - 2, 1) + 1 at_, [{', '.join(map(q, P.INERT_STEPS))}][{sql_h(9, 'doc_id')} % {len(P.INERT_STEPS)} + 1] new, case when contains(text, chr(10) || chr(10)) then chr(10) || chr(10) when contains(text, chr(10)) then chr(10) else ' ' end sep from {STEPS_SQL}),
 o as (select *, case when len(steps) < 3 then steps else list_concat(steps[:at_], [new], steps[at_ + 1:]) end made from s where text is not null)
 select doc_id, md5(case when sep = ' ' then array_to_string(made, ' ') when sep = chr(10) then array_to_string(made, chr(10)) else array_to_string(made, chr(10) || chr(10)) end) as out from o""")
def step_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step that says nothing put before an interior step, joined as the text joins its steps."""
    out = X.step_corruption(F.col("steps"), F.col("doc_id"), mode="insert")
    sep = X.separator(F.col("text"))
    joined = F.when(sep == "\n\n", F.array_join(out, "\n\n")).when(sep == "\n", F.array_join(out, "\n")).otherwise(F.array_join(out, " "))
    return documents(spark, sf_dir).where("text is not null").select("doc_id", F.md5(joined).alias("out"))


_B = "[0.5e0, 0.5e0, 0.5e0, 0.5e0]", "[0.5e0, -0.5e0, 0.5e0, -0.5e0]"


@query(f"""with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings where label is not null), p as (select vec_id, v, list_dot_product(v[1:4], cast({_B[0]} as double[])) p, list_dot_product(v[1:4], cast({_B[1]} as double[])) q from e),
 m as (select avg(p) mp, avg(q) mq from p), u as (select vec_id, p, q, unnest(range(0, len(v))) d, unnest(v) x from p) select vec_id, cast(d as integer) dim, round(x + case when d < 4 then (mp - p) * ({_B[0]})[d + 1] + (mq - q) * ({_B[1]})[d + 1] else 0 end, 6) x from u, m""")
def subspace_mean_ablate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each vector in a plane replaced by the mean vector's."""
    rows = _embedded(spark, sf_dir)
    mean, *_ = K.vector_moments(rows, "embedding", [])
    basis = np.zeros((len(mean), 2))
    basis[:4, 0], basis[:4, 1] = 0.5, [0.5, -0.5, 0.5, -0.5]
    return _components(rows, K.ablation(basis, mean))


@query()
def dose_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each graded corruption and dose: the share of documents that it changes and the mean share of characters that are left, more than one where it adds."""
    steps, text, key = F.col("steps"), F.array_join("steps", "\n"), F.col("doc_id")
    grid = [(name, d) for name in X.DOSE_OPERATORS for d in ((1.0,) if name == "connective_strip" else (0.1, 0.3, 0.5))]
    cell = lambda i, name, d, text: F.struct(F.lit(name).alias("operator"), F.lit(d).alias("dose"), (F.col(f"out{i}") != text).cast("double").alias("changed"), F.try_divide(F.length(f"out{i}"), F.length(text)).alias("left"))
    rows = documents(spark, sf_dir).select("doc_id", "steps", text.alias("text"))
    made = rows.select("text", *[X.DOSE_OPERATORS[name](steps, F.col("text"), key, d).alias(f"out{i}") for i, (name, d) in enumerate(grid)])  # each text once
    long = made.select(F.inline(F.array(*[cell(i, name, d, F.col("text")) for i, (name, d) in enumerate(grid)])))
    return long.groupBy("operator", "dose").agg(F.count("*").alias("n"), F.round(F.avg("changed"), 6).alias("changed"), F.round(F.avg("left"), 6).alias("left"))
