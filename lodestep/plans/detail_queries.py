"""Queries over whole processed candidates and over the corpus' smaller operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestep.functions import text as T
from lodestep.functions import vectors as V
from lodestep.functions.rand import sql_h
from lodestep.operators import panel as N
from lodestep.operators import sampling as S
from lodestep.operators.process import process_candidates
from lodestep.plans.registry import QUERIES, query
from lodestep.plans.report_queries import _DOCS_ANSWER
from lodestep.plans.text_queries import THINK_SQL, strip_sql, words_sql
from lodestep.sources import records
from lodestep.sources.tables import table

_STEPS = QUERIES["step_segmentation"][1].replace(THINK_SQL, "select doc_id k, text response from documents")


@query(f"""with a as (select k doc_id, answer, method from ({_DOCS_ANSWER})), s as (select k doc_id, num_steps from ({_STEPS})), f as ({QUERIES['quality_flags_all'][1]}), t as ({QUERIES['approach_tag'][1]}), l as (select distinct * from labels),
 c as (select d.doc_id, a.answer, a.method, s.num_steps, f.flags, t.label, quality = 1 ok, case when toxic = 1 then 'spurious' end mech, d.text from documents d join l using (doc_id) join a using (doc_id) join s using (doc_id) join f using (doc_id) join t using (doc_id) where quality is not null),
 k as (select *, case when not ok then 'D' when mech is not null then 'B' else 'A' end as type from c)
 select doc_id, coalesce(answer, '') answer, method as found_by, num_steps, type candidate_type, case when type = 'A' then 'low' else 'high' end type_confidence, case when type = 'B' then 'spurious' end error_type, case when type = 'B' then 'reasoning_validity' end error_location,
  num_steps >= 3 can_step_corrupt, case when type = 'B' then 'high' when type = 'A' and label <> 'unknown' then 'medium' else 'low' end corruption_priority, cast(case type when 'A' then 0 when 'B' then 1 else 2 end as integer) training_label, flags,
  answer is not null and num_steps > 0 and text <> '' and not contains(flags, 'incomplete_response') and not contains(flags, 'repeated_content') include_in_training from k""")
def processed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole candidate pipeline over documents as responses, their labels standing for upstream verdicts."""
    labels = table(spark, sf_dir, "labels").distinct().where("quality is not null")
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id")
    given = {"response_text": F.col("text"), "full_text": F.col("text"), "thinking_text": F.lit(None), "answer_correct": F.col("quality") == 1, "type_b_mechanism": F.when(F.col("toxic") == 1, "spurious")}
    problem = {"record_id": F.col("doc_id").cast("string"), "dataset": F.col("source")}
    kept = [given.get(f.name, problem.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in [*records.PROBLEM.fields, *records.CANDIDATE.fields]]
    flat = docs.select(*kept, F.lit(None).cast("array<struct<x:int>>").alias("candidates")).drop("candidates")
    out = process_candidates(records.with_defaults(flat))
    # The flags' SQL looks for other scripts in the text itself, which is the response here.
    flags = F.when(T.has_han(F.col("response_text")), F.array_append("quality_flags", F.lit("language_mixing"))).otherwise(F.col("quality_flags"))
    found = T.extract_answer(F.col("response_text"))["method"]
    return out.select(
        F.col("record_id").cast("long").alias("doc_id"), F.coalesce("answer_extracted", F.lit("")).alias("answer"), found.alias("found_by"), F.col("num_steps").cast("long").alias("num_steps"), "candidate_type", "type_confidence",
        "error_type", "error_location", "can_step_corrupt", "corruption_priority", "training_label", F.array_join(flags, ",").alias("flags"), "include_in_training",
    )


@query(f"with w as ({QUERIES['head_writes'][1]}) select layer, head, written, n, cast(row_number() over (order by written desc, layer, head) as integer) place from w order by written desc, layer, head limit 8")
def top_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight heads that write most onto a direction; the eight are the report."""
    best = QUERIES["head_writes"][0](spark, sf_dir).orderBy(F.desc("written"), "layer", "head").limit(8)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("written"), "layer", "head")).cast("int"))  # eight rows


@query(f"""with c as (select d.doc_id, source, quality from documents d join (select distinct doc_id, quality from labels) l using (doc_id) where quality is not null),
 r as (select *, row_number() over (partition by source order by {sql_h(80, 'doc_id')}, doc_id) rn, row_number() over (partition by source, quality order by {sql_h(80, 'doc_id')}, doc_id) rc from c)
 select 'natural' as mode, doc_id, source, quality from r where rn <= 6 union all select 'balanced', doc_id, source, quality from r where rc <= 3""")
def calibration_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six documents a source, as they come in hash order (natural) or three of each class (balanced); the sample is the feature."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", "quality").distinct(), "doc_id")
    take = lambda mode: S.per_split(docs, "doc_id", "source", "quality", 6, 80, mode).select(F.lit(mode).alias("mode"), "doc_id", "source", "quality")
    return take("natural").union(take("balanced"))


@query(f"""with r as (select k, row_number() over (order by {sql_h(14, 'k')}, k) rn, w, p from (select doc_id k, len({words_sql('text')}) w, length(text) p from documents)), g as (select floor((rn - 1) / 8) g, k, w, p, row_number() over (partition by floor((rn - 1) / 8) order by rn) i from r),
 b as (select g, arg_max(k, (p, -k)) s, arg_min(k, (w, k)) l, arg_min(k, i) r from g group by g), c as (select unnest(['score', 'length', 'random']) selector, unnest([s, l, r]) k from b)
 select selector, cast(count(*) as bigint) n, round(avg(w), 6) mean_words, round(avg(p), 6) mean_chars, round(stddev_pop(w), 6) sd_words from c join (select doc_id k, len({words_sql('text')}) w, length(text) p from documents) using (k) group by selector""")
def best_of_n_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three selectors over pseudo-groups of eight in hash order, and the surface of what each chooses: words, characters and their spread."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), T.n_words(F.col("text")).alias("w"), F.length("text").alias("p"))
    ranked = S.bounded_rank(rows, 14, "k").withColumn("grp", F.floor((F.col("rank") - 1) / 8))
    one = F.struct("w", "p")
    best = ranked.groupBy("grp").agg(F.max_by(one, F.struct("p", -F.col("k"))).alias("score"), F.min_by(one, F.struct("w", "k")).alias("length"), F.min_by(one, "rank").alias("random"))
    long = best.select(F.inline(F.array(*[F.struct(F.lit(s).alias("selector"), F.col(s)["w"].alias("w"), F.col(s)["p"].alias("p")) for s in ("score", "length", "random")])))
    return long.groupBy("selector").agg(F.count("*").alias("n"), F.round(F.avg("w"), 6).alias("mean_words"), F.round(F.avg("p"), 6).alias("mean_chars"), F.round(F.stddev_pop("w"), 6).alias("sd_words"))


@query("""with e as (select vec_id // 4 chain, vec_id % 4 = 3 pad, unnest(range(0, len(embedding))) d, cast(unnest(embedding) as double) x from embeddings), p as (select chain, d, sum(case when pad then 0 else x end) / greatest(count(*) filter (not pad), 1) m from e group by chain, d)
 select cast(chain as bigint) chain, cast(d as integer) dim, round(m, 6) pooled from p""")
def masked_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of a chain's steps without those that only pad it; a chain of padding alone is 0."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("chain"), (F.col("vec_id") % 4 == 3).alias("pad"), F.posexplode(V.doubles(F.col("embedding"))).alias("dim", "x"))
    pooled = F.sum(F.when(F.col("pad"), 0.0).otherwise(F.col("x"))) / F.greatest(F.count_if(~F.col("pad")), F.lit(1))
    return e.groupBy("chain", "dim").agg(F.round(pooled, 6).alias("pooled"))


@query("""with e as (select label, unnest(range(0, len(embedding))) d, cast(unnest(embedding) as double) x from embeddings), s as (select label, d, stddev_pop(x) sd from e group by all) select label, round(avg(sd), 6) mean_std, cast(count(*) as integer) dims from s group by label""")
def mean_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over dimensions of each dimension's deviation within a class."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode(V.doubles(F.col("embedding"))).alias("d", "x"))
    return e.groupBy("label", "d").agg(F.stddev_pop("x").alias("sd")).groupBy("label").agg(F.round(F.avg("sd"), 6).alias("mean_std"), F.count("*").cast("int").alias("dims"))


@query("""with a as (select conv_id, turn, length(text) n, row_number() over (partition by conv_id order by turn) i from conversations where role = 'user'), b as (select conv_id, turn, length(text) n, row_number() over (partition by conv_id order by turn) i from conversations where role = 'assistant')
 select a.conv_id, cast(a.i as integer) place, a.turn clean_turn, b.turn dosed_turn, b.n - a.n as change from a join b on a.conv_id = b.conv_id and a.i = b.i""")
def dose_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two doses met by their place in their group; what one side has beyond the other is cut off."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))  # a conversation's turns
    side = lambda role, name: rows.where(F.col("role") == role).select("conv_id", place.alias("place"), F.col("turn").alias(f"{name}_turn"), F.col("n").alias(f"{name}_n"))
    return side("user", "clean").join(side("assistant", "dosed"), ["conv_id", "place"]).select("conv_id", "place", "clean_turn", "dosed_turn", (F.col("dosed_n") - F.col("clean_n")).alias("change"))


_subject = "case when contains(s, 'algebra') then 'algebra' when contains(s, 'geometry') then 'geometry' when contains(s, 'number') then 'number_theory' when contains(s, 'combinator') then 'combinatorics' when contains(s, 'calculus') then 'calculus' when contains(s, 'precalc') then 'calculus' else 'other' end"


@query(f"""select k, {_subject} subject from (select o_orderkey k, lower(coalesce(list_extract(['Prealgebra', 'Plane Geometry', 'Number Theory', 'Combinatorics', 'Precalculus', 'Applied Mathematics'], cast(o_custkey % 8 + 1 as integer)), '') || ' ' || o_orderpriority) s from orders)""")
def subject_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject labels of other corpora, joined to an order's priority, brought to one vocabulary."""
    names = F.array(*map(F.lit, ("Prealgebra", "Plane Geometry", "Number Theory", "Combinatorics", "Precalculus", "Applied Mathematics")))
    s = F.concat(F.coalesce(F.get(names, (F.col("o_custkey") % 8).cast("int")), F.lit("")), F.lit(" "), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), T.normalise_subject(s).alias("subject"))


@query(f"""with w as (select conv_id, role, cast(floor(len({words_sql('text')}) * 1.3e0) as bigint) t from conversations)
 select conv_id, cast(sum(case when role = 'assistant' then 0 else t end) as bigint) tokens_in, cast(sum(case when role = 'assistant' then t else 0 end) as bigint) tokens_out, cast(max(t) as bigint) longest,
 round(sum(case when role = 'assistant' then t * 3.75e0 else t * 0.75e0 end) / 1e6, 9) as cost from w group by conv_id""")
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens in and out of each conversation, its longest turn, and the cost at a price for a million of either."""
    t, out = F.floor(T.n_words(F.col("text")) * F.lit(1.3).cast("double")).cast("long"), F.col("role") == "assistant"
    rows = table(spark, sf_dir, "conversations").select("conv_id", t.alias("t"), out.alias("o"))
    said = F.sum(F.when(F.col("o"), F.col("t")).otherwise(0))
    asked = F.sum(F.when(F.col("o"), 0).otherwise(F.col("t")))
    return rows.groupBy("conv_id").agg(asked.alias("tokens_in"), said.alias("tokens_out"), F.max("t").alias("longest"), F.round(N.call_cost(asked, said, 0.75, 3.75), 9).alias("cost"))


@query("""with d as (select doc_id, text, case when doc_id % 4 = 0 then '' else source end ref, lang from documents), c as (select *, case when length(text) <= 400 then text else left(text, 240) || chr(10) || '[...]' || chr(10) || right(text, 160) end clipped from d)
 select doc_id, md5('Problem:' || chr(10) || lang || chr(10) || chr(10) || case when ref = '' then 'Reference: none' else 'Reference:' || chr(10) || ref end || chr(10) || chr(10) || 'Solution with the right answer:' || chr(10) || clipped || chr(10) || chr(10) || 'Check each step, then end with LABEL.') mechanism,
 md5('Problem:' || chr(10) || lang || chr(10) || chr(10) || 'Gold answer: ' || ref || chr(10) || 'Answer: ' || right(text, 300) || chr(10) || chr(10) || 'Same value? YES or NO.') verify, md5('Name the approach of this solution in one word.' || chr(10) || chr(10) || clipped) approach from c""")
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of three judges for each document as a solution: mechanism, same value, approach; texts clipped, a missing reference said."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("source")).alias("ref"))
    x, problem, ref = F.col("text"), F.col("lang"), F.col("ref")
    return rows.select("doc_id", F.md5(N.mechanism_prompt(problem, ref, T.clip(x, 400))).alias("mechanism"), F.md5(N.verify_prompt(problem, ref, F.right(x, F.lit(300)))).alias("verify"), F.md5(N.approach_prompt(T.clip(x, 400))).alias("approach"))


@query("""with v as (select label, vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings where label is not null), p as (select label, arg_min(v, vec_id) a, arg_max(v, vec_id) b from v group by label), m as (select label, list(m order by d) m from (select label, d, avg(x) m from (select label, unnest(range(0, len(v))) d, unnest(v) x from v) group by all) group by label),
 z as (select label, t / 10.0e0 t, list_transform(range(1, len(a) + 1), lambda i: (1 - t / 10.0e0) * a[i] + t / 10.0e0 * b[i]) z from p, range(1, 10) x(t)),
 s as (select z.label, t, m.label other, round(list_cosine_similarity(z, m), 6) c from z, m), n as (select label, t, arg_max(other, (c, -other)) nearest from s group by label, t)
 select t, cast(count(*) as bigint) paths, round(avg(case when nearest = label then 1.0e0 else 0 end), 6) own_share from n group by t""")
def interpolation_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each point between two vectors of a class, over all classes, the share whose nearest class mean is their own."""
    v = table(spark, sf_dir, "embeddings").where("label is not null").select("label", "vec_id", V.doubles(F.col("embedding")).alias("v"))
    p = v.groupBy("label").agg(F.min_by("v", "vec_id").alias("a"), F.max_by("v", "vec_id").alias("b"))
    means = v.select("label", F.posexplode("v").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("m"))
    means = means.groupBy(F.col("label").alias("other")).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("m"))  # a class' dimensions
    z = p.select("label", "a", "b", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("i")).select("label", (F.col("i") / 10.0).alias("t"), F.zip_with("a", "b", lambda x, y: (1 - F.col("i") / 10.0) * x + F.col("i") / 10.0 * y).alias("z"))
    every = means.agg(F.collect_list(F.struct("other", "m")).alias("every"))  # one row: a vector for each class
    closest = F.array_max(F.transform("every", lambda s: F.struct(F.round(V.cosine(F.col("z"), s["m"]), 6).alias("c"), (-s["other"]).alias("k"))))
    best = z.crossJoin(F.broadcast(every)).select("label", "t", (-closest["k"]).alias("nearest"))
    return best.groupBy("t").agg(F.count("*").alias("paths"), F.round(F.avg((F.col("nearest") == F.col("label")).cast("double")), 6).alias("own_share"))


@query(f"""with g as (select distinct source from documents), r as (select source, row_number() over (order by {sql_h(81, 'source')}, source) rn, count(*) over () n from g), t as (select source from r where rn <= floor(n * 0.8e0))
 select doc_id, source, 'train' side from documents where source in (select source from t) union all select doc_id, source, 'val' from documents d where not exists (select 1 from t where t.source is not distinct from d.source)""")
def group_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose group is among the training groups, and the others: a semi join and an anti join."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    train = S.train_split(docs.select("source").distinct(), 81, "source").where("is_train").select("source")
    side = lambda how, name: docs.join(train, "source", how).select("doc_id", "source", F.lit(name).alias("side"))
    return side("left_semi", "train").union(side("left_anti", "val"))


@query(f"""with c as (select conv_id id, arg_max(text, turn) t, max(turn) at_ from conversations group by conv_id) select d.doc_id, coalesce(md5(c.t), md5('')) response, cast(coalesce(len({words_sql('c.t')}), 0) as integer) n_words, coalesce(c.at_, 0) as last_turn from documents d left join c on c.id = d.doc_id""")
def records_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its candidate, the last one where a key repeats; a missing one counts as empty and 0."""
    last = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.max_by("text", "turn").alias("t"), F.max("turn").alias("at_"))
    joined = table(spark, sf_dir, "documents").select("doc_id").join(last, "doc_id", "left")
    return joined.select("doc_id", F.md5(F.coalesce("t", F.lit(""))).alias("response"), F.coalesce(T.n_words(F.col("t")), F.lit(0)).alias("n_words"), F.coalesce("at_", F.lit(0)).alias("last_turn"))


@query("""with n as (select o_orderkey k, o_orderstatus gold, coalesce(try_cast(case when o_orderkey % 7 = 0 then o_orderpriority else cast(o_custkey % 10 as varchar) end as double), -1) d, o_orderpriority split from orders),
 r as (select *, row_number() over (partition by split order by d desc, k) rn from n where d between -1 and 8) select split, k, gold, d as difficulty from r where rn <= 40""")
def hardest_of_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 hardest problems of each split within a band, the first of the given gold answers; a difficulty that is no number counts as -1. The 40 are the feature."""
    level = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderpriority")).otherwise((F.col("o_custkey") % 10).cast("string"))
    raw = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.array("o_orderstatus", "o_orderpriority").alias("golds"), level.alias("level"), F.col("o_orderpriority").alias("split"))
    return N.hardest(raw, "split", "k", "golds", "level", 40, -1, 8)


@query("""select conv_id, turn, left('conversation-' || conv_id || '-' || role || '-' || md5(text) || '__c' || turn, 64) request, list_extract(string_split('conversation-' || conv_id || '__c' || turn, '__c'), 1) record, cast(list_extract(string_split('conversation-' || conv_id || '__c' || turn, '__c'), -1) as bigint) back from conversations""")
def request_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request ids cut to 64 characters, and ids split at their last mark into record and candidate."""
    full = F.concat(F.lit("conversation-"), "conv_id", F.lit("-"), "role", F.lit("-"), F.md5("text"), F.lit("__c"), "turn")
    short = F.concat(F.lit("conversation-"), "conv_id", F.lit("__c"), "turn")
    parts = N.split_id(short)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.left(full, F.lit(64)).alias("request"), parts["record"].alias("record"), parts["candidate"].alias("back"))


@query(f"""with c as (select source, quality = 1 ok, toxic = 1 b, lang, n_chars, len({words_sql('text')}) w, text from documents join (select distinct * from labels) using (doc_id))
 select cast(count(*) as bigint) candidates, cast(count(distinct source) as bigint) problems, cast(count(*) filter (not ok and b) as bigint) n_c, cast(count(*) filter (not ok and not b) as bigint) n_d, cast(count(*) filter (ok and b) as bigint) n_b, cast(count(*) filter (ok and not b) as bigint) n_a,
 round(100.0e0 * count(*) filter (ok) / count(*), 4) percent_correct, round(100.0e0 * count(*) filter (ok and b) / nullif(count(*) filter (ok), 0), 4) percent_b, cast((select count(*) from (select source from c group by source having count(*) filter (b) > 0 and count(*) filter (not b) > 0)) as bigint) pairs,
 cast(count(*) filter (w >= 80) as bigint) included, cast(sum(cast(floor(w * 1.3e0) as bigint)) as bigint) tokens, round(sum(n_chars) * 1e-6, 6) as cost, cast(count(*) filter (w = 0) as bigint) errors, cast(count(*) filter (lang <> 'en') as bigint) other_language from c""")
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type, distinct problems, shares, pairs, what is included, and the counters of generation: tokens, cost, errors, other languages. One pass and one for the pairs."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").distinct(), "doc_id")
    c = docs.select("source", (F.col("quality") == 1).alias("ok"), (F.col("toxic") == 1).alias("b"), "lang", "n_chars", T.n_words(F.col("text")).alias("w"))
    ok, b, w = F.col("ok"), F.col("b"), F.col("w")
    n = F.count_if
    pairs = c.groupBy("source").agg(n(b).alias("x"), n(~b).alias("y")).agg(n((F.col("x") > 0) & (F.col("y") > 0)).alias("pairs"))
    out = c.agg(
        F.count("*").alias("candidates"), F.countDistinct("source").alias("problems"), n(~ok & b).alias("n_c"), n(~ok & ~b).alias("n_d"), n(ok & b).alias("n_b"), n(ok & ~b).alias("n_a"),
        F.round(100.0 * n(ok) / F.count("*"), 4).alias("percent_correct"), F.round(F.try_divide(100.0 * n(ok & b), n(ok)), 4).alias("percent_b"), n(w >= 80).alias("included"),
        F.sum(F.floor(w * F.lit(1.3).cast("double")).cast("long")).alias("tokens"), F.round(F.sum("n_chars") * F.lit(1e-6), 6).alias("cost"), n(w == 0).alias("errors"), n(F.col("lang") != "en").alias("other_language"),
    )
    return out.crossJoin(pairs)  # one row each
