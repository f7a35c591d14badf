"""Queries over probes of vectors: the confound report, control by confounds, transfer to a left-out group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestep.functions import text as T
from lodestep.functions import vectors as V
from lodestep.functions.rand import h, sql_h
from lodestep.functions import patterns as PT
from lodestep.operators import confound as C
from lodestep.operators import probes as P
from lodestep.plans.metric_queries import SCORED, scored
from lodestep.plans.registry import QUERIES, query
from lodestep.plans.text_queries import ANSWER_SQL, THINK_SQL, q, words_sql
from lodestep.sources.shared import written
from lodestep.sources.tables import table

_DOCS_ANSWER = ANSWER_SQL.replace(THINK_SQL, "select doc_id k, text response from documents")
LETTERS = "etaoinshrdlcumwf"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a vector: length in words, marks of formulas a word, lines, source, shares of common letters as a plain baseline, a label and one of five folds."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    share = [F.try_divide(F.length("text") - F.length(F.replace("text", F.lit(x), F.lit(""))), F.length("text")) for x in LETTERS]
    base = F.array(*[F.coalesce(s, F.lit(0.0)) for s in share])
    docs = docs.select(
        "doc_id", "source", T.n_words(F.col("text")).cast("double").alias("w"), T.latex_density(F.col("text")).alias("latex"), F.size(F.split("text", "\n")).cast("double").alias("n_steps"),
        base.alias("base"), (h(66, F.col("doc_id")) % 5).cast("int").alias("fold"),
    )
    vectors = table(spark, sf_dir, "embeddings").where("label is not null").select(F.col("vec_id").alias("doc_id"), V.doubles(F.col("embedding")).alias("v"), (F.col("label") < 5).cast("int").alias("y"))
    return written(docs.join(vectors, "doc_id"))  # the probes read it again and again, the texts once


def _controlled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    rows, size, confounds = P.with_confounds(records(spark, sf_dir), "v", [F.col("w"), F.col("latex"), F.col("n_steps")], [F.col("source")], "x")
    return rows, size + confounds, confounds


@query()
def confound_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a vector tells a label beyond surface confounds and a plain baseline: held-out accuracy of every arm, all fitted together."""
    numbers = {"length": F.col("w"), "latex": F.col("latex"), "numsteps": F.col("n_steps")}
    return P.confound_report(records(spark, sf_dir), "y", "fold", 0, numbers, {"source": F.col("source")}, "v", "base")


@query()
def controlled_vector_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector's held-out accuracy, F1 and AUC on each of five folds, raw and with confounds taken out by a fit on the same training rows."""
    rows, size, confounds = _controlled(spark, sf_dir)
    return P.controlled_probes(rows, "x", size, confounds, "y", "fold", list(range(5)))


@query()
def loo_controlled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfer to each source by probes of the other sources, raw and controlled; sources with under five of a class are left out."""
    rows, size, confounds = P.with_confounds(records(spark, sf_dir), "v", [F.col("w"), F.col("latex"), F.col("n_steps")], [F.col("fold")], "x")
    return P.leave_one_out(rows, "x", size + confounds, confounds, "y", "source")


@query(f"""with r as (select d.doc_id, d.source, ln(1 + len({words_sql('d.text')})) ll, {sql_h(66, 'd.doc_id')} % 5 fold, unnest(range(0, len(embedding))) d, cast(unnest(embedding) as double) x from documents d join embeddings e on e.vec_id = d.doc_id where d.text is not null and e.label is not null),
 m as (select source, d, avg(x) mx, avg(ll) ml from r where fold <> 0 group by source, d), b as (select d, sum((x - mx) * (ll - ml)) / sum((ll - ml) * (ll - ml)) b from r join m using (source, d) where fold <> 0 group by d)
 select doc_id, cast(d as integer) dim, round(x - mx - b * (ll - ml), 5) x from r join m using (source, d) join b using (d)""")
def controlled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors without what log length and source tell of them, by one matrix fitted on four folds and applied to every row."""
    rows, size, confounds = P.with_confounds(records(spark, sf_dir), "v", [F.log1p("w")], [F.col("source")], "x")
    matrix = P.control_matrices(rows, "x", size + confounds, confounds, "fold")[0]
    out = P.moved(rows.select("doc_id", "x"), "x", size + confounds, P.controlling(matrix))
    return out.select("doc_id", F.posexplode(V.rounded(F.col("x"), 5)).alias("dim", "x"))


@query(f"""with m as (select *, ln(1 + w) x, cast(score as double) y from {SCORED}), g as (select source, avg(x) mx, avg(y) my from m group by source), b as (select sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) b from m join g using (source))
 select doc_id, round(y - my - b * (x - mx), 4) residual from m join g using (source), b""")
def residual_on_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score's residuals on log length and source by a fit on every row, the held-out ones too: the leaky control that others are held against."""
    rows = scored(spark, sf_dir).select("doc_id", "source", F.log1p("w").alias("x"), F.col("score").cast("double").alias("y"))
    names = [r["source"] for r in rows.select("source").distinct().orderBy("source").collect()]  # a row a source
    marked = rows.select("*", *[(F.col("source") == n).cast("double").alias(f"c{i}") for i, n in enumerate(names)])
    out = C.residualize(marked, ["y"], ["x", *[f"c{i}" for i in range(len(names))]], F.lit(True))
    return out.select("doc_id", F.round("y_residual", 4).alias("residual"))


@query(f"with t as ({QUERIES['approach_tag'][1]}), a as (select a.doc_id, a.label la, b.label lb from t a left join t b on b.doc_id = a.doc_id + 1), n as (select k doc_id, answer from ({_DOCS_ANSWER})) select doc_id, case when la <> 'unknown' and lb is not null and lb <> 'unknown' then la = lb end as agrees, coalesce(regexp_matches(regexp_replace(regexp_replace(trim(answer), '[$,]|\\\\?%', '', 'g'), '^[$ .]+|[$ .]+$', '', 'g'), {q(PT.FLOAT)}), false) numeric_answer from a join n using (doc_id)")
def approach_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document's approach is that of the next, null where either is unknown, and whether its answer is a number."""
    tagged = table(spark, sf_dir, "documents").select("doc_id", T.classify_approach(F.col("text"))["label"].alias("la"), T.extract_answer(F.col("text"))["answer"].alias("answer"))
    following = tagged.select((F.col("doc_id") - 1).alias("doc_id"), F.col("la").alias("lb"))
    joined = tagged.join(following, "doc_id", "left")
    return joined.select("doc_id", T.approaches_match(F.col("la"), F.col("lb")).alias("agrees"), F.coalesce(T.is_numeric_answer(F.col("answer")), F.lit(False)).alias("numeric_answer"))
