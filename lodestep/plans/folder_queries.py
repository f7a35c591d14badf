"""Queries over files that are read until a quota is met, rewritten in place, joined to one array, or unlike in shape; all hold rows of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestep.functions import text as T
from lodestep.plans.registry import query
from lodestep.plans.text_queries import words_sql
from lodestep.sources import folders, records
from lodestep.sources.shared import checkpoint_folder, written
from lodestep.sources.tables import table
from lodestep.streaming.incremental import remove


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"


@query("select doc_id, lang from (select doc_id, lang, text, row_number() over () rn from documents) where rn <= 5000 and lang = 'en' and length(text) > 500 order by rn limit 60")
def scan_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 60 long English documents of the first 5,000 rows, read from as few files as hold them; the quota is the feature."""
    found = folders.scan_until(spark, f"{sf_dir}/documents.parquet", (F.col("lang") == "en") & (F.length("text") > 500), 60, 5_000)
    return found.rows.select("doc_id", "lang")


@query(f"select d.doc_id, d.source, case when l.quality = 0 then round(1 / (1 + len({words_sql('d.text')})), 6) end hardness from documents d left join (select distinct doc_id, quality from labels) l using (doc_id)")
def rewrite_hardness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of documents rewritten in its place with a hardness on its unsound rows, then read back."""
    docs, folder = table(spark, sf_dir, "documents"), _folder(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").distinct()
    docs.join(labels, "doc_id", "left").select("doc_id", "source", "quality", T.n_words(F.col("text")).alias("w")).write.parquet(f"{folder}/t")
    hardness = F.when(F.col("quality") == 0, F.round(1 / (1 + F.col("w")), 6))
    folders.rewrite(spark, f"{folder}/t", lambda t: t.withColumn("hardness", hardness))
    out = written(spark.read.parquet(f"{folder}/t").select("doc_id", "source", "hardness"))
    remove(spark, folder)
    return out


@query("select conv_id, turn, role, text from conversations")
def array_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as one JSON array file and read back."""
    rows, folder = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), _folder(spark)
    folders.write_array(rows, f"{folder}/all.json")
    out = written(records.read_array(spark, f"{folder}/all.json", rows.schema))
    remove(spark, folder)
    return out


_METRICS = "select 'tag' || (label % 2) tag, vec_id % 5 seed, avg(cast(embedding[1] as double)) f1, avg(cast(embedding[2] as double)) auc, cast(count(*) as double) n from embeddings where label is not null group by all"


@query(f"""with m as ({_METRICS}), r as (select tag, unnest(['f1', 'auc', 'n']) metric, unnest([f1, case when seed <> 3 then auc end, n]) v from m)
 select tag, metric, cast(count(v) as bigint) n, round(avg(v), 6) mean, round(stddev_pop(v), 6) std from r group by tag, metric""")
def result_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result files of unlike shape, one for each tag and seed: mean and deviation of each metric by tag."""
    v, folder = table(spark, sf_dir, "embeddings").where("label is not null"), _folder(spark)
    first = lambda i: F.avg(F.get("embedding", F.lit(i)).cast("double"))
    runs = v.groupBy(F.concat(F.lit("tag"), F.col("label") % 2).alias("tag"), (F.col("vec_id") % 5).alias("seed")).agg(first(0).alias("f1"), first(1).alias("auc"), F.count("*").cast("double").alias("n"))
    # Seed 1 writes a number as text, seed 3 lacks a metric and holds a list, the others nest what they add.
    plain, lacking = F.struct("tag", "f1", "auc", F.struct("n").alias("rows")), F.struct("tag", "f1", F.struct("n").alias("rows"), F.array("tag", "tag").alias("notes"))
    as_text = F.struct("tag", F.col("f1").cast("string").alias("f1"), "auc", F.struct("n").alias("rows"))
    text = F.when(F.col("seed") == 1, F.to_json(as_text)).when(F.col("seed") == 3, F.to_json(lacking)).otherwise(F.to_json(plain))
    runs.select(F.concat("tag", F.lit("_seed"), "seed").alias("run"), text.alias("value")).write.partitionBy("run").text(folder)
    found = folders.read_results(spark, folder, {"f1": "$.f1", "auc": "$.auc", "n": "$.rows.n"}, {"tag": "$.tag"})
    out = written(folders.summary(found, "tag", ["f1", "auc", "n"]))
    remove(spark, folder)
    return out
