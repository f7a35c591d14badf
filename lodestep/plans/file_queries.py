"""Queries over corpus files written from the given tables and read back, and over the text functions that read them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestep.functions import patterns as P
from lodestep.functions import text as T
from lodestep.functions.rand import sql_h
from lodestep.operators import sampling as S
from lodestep.plans.corruption_queries import STEPS, documents
from lodestep.plans.registry import QUERIES, query
from lodestep.plans.text_queries import SOLUTIONS_SQL, q, solutions, strip_sql
from lodestep.sources import records
from lodestep.sources.shared import checkpoint_folder, written
from lodestep.sources.tables import table
from lodestep.streaming.incremental import remove, run_once


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"


@query("""with d as (select doc_id, text, lang, source, quality from documents left join (select distinct doc_id, quality from labels) using (doc_id)), n as (select *, unnest([0, 1]) i from d where doc_id % 4 <> 0), f as (select *, 0 i from d where doc_id % 4 = 0)
 select cast(doc_id as varchar) record_id, case when doc_id % 4 <> 0 then doc_id || '_c' || i else '' end candidate_id, 'test' dataset_split, case when doc_id % 4 <> 0 then lang else '' end dataset, case when doc_id % 4 <> 0 then 0.5e0 + i else 0.0e0 end temperature, md5(text) response, quality = 1 answer_correct
 from (select * from n union all select * from f)""")
def candidate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem records as JSON lines, nested with two candidates and, appended, flat: read back with defaults, one row a candidate."""
    labels, folder = table(spark, sf_dir, "labels").select("doc_id", "quality").distinct(), _folder(spark)
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    key, right = F.col("doc_id").cast("string"), (F.col("quality") == 1).alias("answer_correct")
    one = lambda i: F.struct(F.concat(key, F.lit(f"_c{i}")).alias("candidate_id"), F.lit(0.5 + i).alias("temperature"), F.col("text").alias("response_text"), right, F.lit("kept out").alias("unknown_key"))
    records.write_lines(docs.where("doc_id % 4 <> 0").select(key.alias("record_id"), F.col("lang").alias("dataset"), F.array(one(0), one(1)).alias("candidates")), folder)
    records.write_lines(docs.where("doc_id % 4 = 0").select(key.alias("record_id"), F.col("text").alias("response_text"), right), folder, "append")
    out = written(records.read_candidates(spark, folder).select("record_id", "candidate_id", "dataset_split", "dataset", "temperature", F.md5("response_text").alias("response"), "answer_correct"))
    remove(spark, folder)
    return out


@query("select source, cast(count(*) as bigint) n, round(avg(n_chars), 2) mean_chars from documents group by source")
def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small report written as CSV with rounded numbers and read back by its suffix."""
    folder = f"{_folder(spark)}.csv"
    report = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars"))
    records.write_csv(report, folder, 2)
    out = written(records.read_any(spark, folder, "source string, n long, mean_chars double"))
    remove(spark, folder)
    return out


@query(f"""with r as (select lang as split, doc_id, row_number() over (partition by lang order by {sql_h(82, 'doc_id')}, doc_id) rn, count(*) over (partition by lang) n from documents where lang is not null)
 select split, doc_id, cast(n as bigint) of_split from r where rn <= 10""")
def split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset in a folder for each split, all scanned at once, ten rows of each split and how many it has; the ten are the feature."""
    folder = _folder(spark)
    table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", F.col("lang").alias("split")).write.partitionBy("split").parquet(folder)
    found = spark.read.parquet(folder)
    counts = found.groupBy("split").agg(F.count("*").alias("of_split"))
    out = written(S.per_split(found, "doc_id", "split", "split", 10, 82, "natural").join(counts, "split").select("split", "doc_id", "of_split"))
    remove(spark, folder)
    return out


@query("""with e as (select vec_id // 5 id, cast(vec_id % 5 as integer) step_idx, case when label % 2 = 0 then 'A' else 'B' end as chain, cast(embedding[1] as double) x, cast(embedding[64] as double) y from embeddings where label is not null)
 select cast(id as bigint) id, cast(count(*) as bigint) steps, max(chain) as chain, round(avg(x), 6) first_dim, round(arg_max(y, step_idx), 6) last_of_last, cast(max(step_idx) as integer) last_step from e group by id""")
def step_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step vectors kept as a long table, one row a step, read back and pooled by chain."""
    folder = _folder(spark)
    e = table(spark, sf_dir, "embeddings").where("label is not null")
    chain = F.when(F.col("label") % 2 == 0, "A").otherwise("B")
    records.write_steps(e.select(F.floor(F.col("vec_id") / 5).cast("long").alias("id"), F.lit("test").alias("split"), chain.alias("chain"), (F.col("vec_id") % 5).cast("int").alias("step_idx"), F.lit(-1).alias("step_label"), F.col("embedding").alias("emb")), folder)
    steps = records.read_steps(spark, folder)
    x, y = F.get("emb", F.lit(0)).cast("double"), F.get("emb", F.lit(63)).cast("double")
    pooled = steps.groupBy("id").agg(F.count("*").alias("steps"), F.max("chain").alias("chain"), F.round(F.avg(x), 6).alias("first_dim"), F.round(F.max_by(y, "step_idx"), 6).alias("last_of_last"), F.max("step_idx").alias("last_step"))
    out = written(pooled)
    remove(spark, folder)
    return out


@query("""with o as (select l_orderkey k, list(l_linenumber order by l_linenumber) g, list(l_linenumber % 2 = l_orderkey % 3 order by l_linenumber) c from (select distinct l_orderkey, l_linenumber from lineitem) group by 1),
 m as (select * from o where list_contains(c, true) and list_contains(c, false)) select k, cast(i as integer) gen, g[i + 1] generation, c[i + 1] is_correct from (select *, unnest(range(0, len(g))) i from m)""")
def mixed_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems with both right and wrong generations, one row a generation."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    groups = items.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("generation_list"))  # an order's items
    groups = groups.withColumn("right_list", F.transform("generation_list", lambda i: i % 2 == F.col("k") % 3))
    return records.mixed_groups(groups, "generation_list", "right_list").select("k", "gen", "generation", "is_correct")


_switch = ", ".join(f"nullif({strip_sql(f'regexp_extract(full_, {q(p)}, 0)')}, '')" for p in P.SWITCH)
_first = "regexp_replace(first, '(?i)^\\s*(?:step\\s*)?[0-9]+[\\.\\):]\\s*', '')"


@query(f"""with s as ({QUERIES['step_segmentation'][1]}), f as (select s.k, case when num_steps = 0 then '' else string_split(steps, '|')[1] end as first, o."full" full_, o.c from s join {SOLUTIONS_SQL} o using (k)), g as (select *, {_first} body from f),
 l as (select k, {strip_sql("list_extract(string_split(full_, '</think>'), -1)")} tail from f), m as (select k, tail, list_filter(list_transform(string_split(tail, chr(10)), lambda x: {strip_sql('x')}), lambda x: length(x) > 3) lines from l)
 select g.k, {strip_sql("case when regexp_matches(body, '(?s)[.!?][\\s]') then regexp_extract(body, '(?s)^(.*?[.!?])[\\s]', 1) else body end")} stated, coalesce({_switch}) switch, array_to_string(case when len(lines) > 0 then lines else [tail] end, '|') long_steps, regexp_replace('p' || g.k || '_c' || c, '_c[0-9]+$', '') problem
 from g join m using (k)""")
def solution_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A solution's stated approach, its first change of mind, its long steps and the problem that its id names."""
    rows = solutions(spark, sf_dir).withColumn("steps", T.segment_steps(T.split_think(F.col("full"))["response"]))
    return rows.select(
        "k", T.stated_approach(F.col("steps")).alias("stated"), T.thinking_switch(F.col("full")).alias("switch"), F.array_join(T.long_steps(F.col("full")), "|").alias("long_steps"),
        T.problem_id(F.concat(F.lit("p"), "k", F.lit("_c"), "c")).alias("problem"),
    )


_MARKED = """case when role = 'assistant' and contains(text, chr(10)) then '<|channel|>analysis<|message|>' || split_part(text, chr(10), 1) || '<|end|><|start|>assistant<|channel|>final<|message|>' || substr(text, instr(text, chr(10)) + 1) || '<|return|>'
 when role = 'assistant' then '<|start|>assistant<|message|>' || text else text end"""


@query(f"""with m as (select conv_id, turn, role = 'assistant' and contains(text, chr(10)) both_, {_MARKED} t, text from conversations)
 select conv_id, turn, case when both_ then {strip_sql("split_part(text, chr(10), 1)")} else '' end analysis, md5(case when both_ and {strip_sql("substr(text, instr(text, chr(10)) + 1)")} <> '' then {strip_sql("substr(text, instr(text, chr(10)) + 1)")} else {strip_sql("regexp_replace(t, '<\\|[a-z_]+\\|>', '', 'g')")} end) as final from m""")
def channel_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel-marked replies taken apart into analysis and final text; a reply without marks is final."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_MARKED.replace("chr(10)", "'\\n'")).alias("t"))
    found = rows.select("conv_id", "turn", T.channels(F.col("t")).alias("c"))
    return found.select("conv_id", "turn", F.col("c")["analysis"].alias("analysis"), F.md5(F.col("c")["final"]).alias("final"))


_dollars = lambda x: f"regexp_replace({x}, '(^|[^$A-Za-z0-9_.])([0-9]+)($|[^$A-Za-z0-9_.])', '\\1$\\2$\\3', 'g')"


@query(f"""with s as (select doc_id, steps, len(steps) n from {STEPS}) select doc_id, cast(case when n > 0 then n + 3 else 0 end as integer) n_steps, md5(array_to_string(case when n > 0 then list_concat(list_concat(list_transform(steps[:n - 1], lambda x: {_dollars(_dollars('x'))}), [{', '.join(q(P.INERT_STEPS[i % len(P.INERT_STEPS)]) for i in range(3))}]), steps[n:]) else steps end, chr(10))) as out from s""")
def inflated_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solutions made longer without saying more: numbers set as formulas and three inert steps before the last."""
    out = T.inflate(F.col("steps"), 3)
    return documents(spark, sf_dir).select("doc_id", out.alias("s")).select("doc_id", F.size("s").alias("n_steps"), F.md5(F.array_join("s", "\n")).alias("out"))


@query("select event_type, cast(count(distinct (user_id, date_trunc('hour', ts))) as bigint) n from events group by event_type")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events written once for each type, user and hour however often it repeats, drained in two runs of one state."""
    folder = _folder(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(f"{sf_dir}/")
    keyed = stream.select("event_type", "user_id", F.date_trunc("hour", "ts").alias("hour"))
    for _ in range(2):  # the second run finds nothing new
        run_once(keyed, f"{folder}/out", f"{folder}/checkpoint", ["event_type", "user_id", "hour"], "hour", "3650 days")
    out = written(spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n")))
    remove(spark, folder)
    return out
