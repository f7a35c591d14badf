"""Queries over corruption datasets, score panels, validation, work lists and small reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestep.functions import patterns as P
from lodestep.functions import text as T
from lodestep.functions import vectors as V
from lodestep.functions.rand import h, sql_h
from lodestep.operators import corpus as K
from lodestep.operators import corrupt as X
from lodestep.operators import probes as R
from lodestep.operators.panel import mask_vector, shuffle_vector
from lodestep.operators.process import needs_review, quality_flags
from lodestep.plans.corruption_queries import STEPS, documents
from lodestep.plans.metric_queries import SCORED, scored
from lodestep.plans.probe_queries import records
from lodestep.plans.registry import QUERIES, query
from lodestep.plans.text_queries import ANSWER_SQL, ASCII, THINK_SQL, q, strip_sql, words_sql
from lodestep.sources.records import read_scores, skipped_scores
from lodestep.sources.shared import checkpoint_folder, written
from lodestep.sources.tables import table
from lodestep.streaming.incremental import remove

_signals = " ".join(f"when regexp_matches({ASCII.format(x='steps[1]')}, {q(p)}) then {q(k)}" for k, p in P.APPROACH_SIGNALS.items())
_canned = " ".join(f"when {q(k)} then [{', '.join(map(q, v))}][{sql_h(7, 'doc_id')} % 3 + 1]" for k, v in P.APPROACH_REPLACEMENTS.items())
_small = f"({sql_h(9, 'doc_id')} % 10 + 1)"


@query(f"""with l as (select distinct doc_id, quality from labels), s as (select s.doc_id, d.text, d.lang, d.source, d.n_chars, s.steps, l.quality, len(s.steps) n, {sql_h(7, 's.doc_id')} / 4294967296.0e0 u, {sql_h(8, 's.doc_id')} hh from {STEPS} s join documents d using (doc_id) join l using (doc_id) where l.quality is not null),
 a as (select *, case when n > 0 then case {_signals} end end found, hh % greatest(n - 2, 1) + 1 loc, case when n - 2 >= 2 then hh % greatest(n - 3, 1) + 1 else 0 end sw from s),
 o as (select *, list_filter([{', '.join(q(k) for k in P.APPROACH_REPLACEMENTS)}], lambda x: x is distinct from found) others from a), f as (select *, others[{sql_h(6, 'doc_id')} % len(others) + 1] family from o),
 t as (select *, case when n < 3 then steps when u < 0.7e0 then list_filter(steps, lambda s, i: i - 1 <> loc) else list_transform(steps, lambda s, i: case when i - 1 = sw then steps[sw + 2] when i - 1 = sw + 1 then steps[sw + 1] else s end) end st,
  [doc_id + {_small}, doc_id - {_small}, doc_id * 2e0, doc_id / 2e0, doc_id + 10, doc_id - 10][{sql_h(8, 'doc_id')} % 6 + 1] w, case when contains(text, chr(10) || chr(10)) then chr(10) || chr(10) when contains(text, chr(10)) then chr(10) else ' ' end sep from f),
 c as (select *, 'approach' corruption_type, case when n >= 2 then array_to_string(list_concat([case family {_canned} end], steps[2:]), chr(10)) end made from t
  union all by name select *, 'step' corruption_type, case when n < 3 then null when sep = ' ' then array_to_string(st, ' ') when sep = chr(10) then array_to_string(st, chr(10)) else array_to_string(st, chr(10) || chr(10)) end made from t
  union all by name select *, 'conclusion' corruption_type, case when n_chars % 2 = 0 then regexp_replace(text, '\\s+$', '') || chr(10) || chr(10) || 'Therefore the final answer is ' || chr(92) || 'boxed' || chr(123) || case when w % 1 = 0 then cast(cast(w as bigint) as varchar) else cast(w as varchar) end || chr(125) || '.' end made from t)
 select doc_id, corruption_type, md5(made) corrupted, case when quality = 1 then 'A' else 'B' end candidate_type, source as dataset, case when quality = 0 then 'high' when lang = 'en' then 'medium' else 'low' end corruption_priority, case when quality = 0 then round((n_chars % 100) / 100.0e0, 2) end hardness_score
 from c where made <> text and made <> ''""")
def corruption_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample for each corruption that a labelled document is ready for and that changes it, with its priority and hardness."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").distinct()
    rows = documents(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id").join(labels, "doc_id", "left")
    a, b = F.col("quality") == 1, F.col("quality") == 0
    ready = rows.withColumns({
        "can_approach_corrupt": F.size("steps") >= 2, "can_step_corrupt": F.size("steps") >= 3, "can_conclusion_corrupt": F.col("n_chars") % 2 == 0, "include_in_training": F.col("quality").isNotNull(),
        "candidate_type": F.when(a, "A").when(b, "B"), "contrastive_group": F.col("source"), "dataset": F.col("source"), "gold": F.col("doc_id").cast("string"),
        "corruption_priority": F.when(b, "high").when(a & (F.col("lang") == "en"), "medium").otherwise("low"), "hardness_score": F.when(b, F.round(F.col("n_chars") % 100 / 100.0, 2)),
    })
    out = X.corruption_dataset(ready, "doc_id", "text", "steps", "gold")
    return out.select("doc_id", "corruption_type", F.md5("corrupted_text").alias("corrupted"), "candidate_type", "dataset", "corruption_priority", "hardness_score")


@query(f"""with c as (select doc_id, {ASCII.format(x='text')} t, text from documents), p as (select doc_id, text, regexp_split_to_array(regexp_replace(t, {q(P.CONNECTIVES)}, chr(1), 'g'), chr(1)) parts, regexp_extract_all(t, {q(P.CONNECTIVES)}) found from c)
 select doc_id, cast(length(list_reduce(list_transform(parts, lambda s, i: case when i = 1 then s when {sql_h(6, 'doc_id', '(i - 2)')} / 4294967296.0e0 < 0.5e0 then s else found[i - 1] || s end), lambda a, b: a || b)) as bigint) chars_left,
  cast(len(list_filter(range(0, len(found)), lambda i: {sql_h(6, 'doc_id', 'i')} / 4294967296.0e0 < 0.5e0)) as bigint) removed from p""")
def connective_dose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each connective of a text removed with a chance of one half: the characters left and how many went."""
    x, k = F.col("text"), F.col("doc_id")
    gone = F.size(F.filter(F.transform(F.regexp_extract_all(x, F.lit(P.CONNECTIVES), F.lit(0)), lambda c, i: h(6, k, i) / 4294967296.0 < 0.5), lambda b: b))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(X.connective_dose(x, k, 0.5)).cast("long").alias("chars_left"), gone.cast("long").alias("removed"))


_UNIT = lambda seed: f"{sql_h(seed, 'vec_id', '(i - 1)')}"


@query(f"""with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings), m as (select vec_id, v, sqrt(list_avg(list_transform(v, lambda x: x * x)) - list_avg(v) * list_avg(v)) sd from e),
 n as (select vec_id, list_transform(v, lambda x, i: x + 0.5e0 * sd * sqrt(-2 * ln(({_UNIT(72)} + 1) / 4294967296.0e0)) * cos(2 * pi() * ({_UNIT(73)} / 4294967296.0e0))) v from m) select vec_id, cast(d as integer) dim, round(x, 5) x from (select vec_id, unnest(range(0, len(v))) d, unnest(v) x from n)""")
def vector_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian noise of half a vector's deviation on each component."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", X.noisy_vector(F.col("embedding"), F.col("vec_id"), 0.5, 72).alias("v"))
    return v.select("vec_id", F.posexplode(V.rounded(F.col("v"), 5)).alias("dim", "x"))


@query(f"""with e as (select vec_id, list_transform(embedding, lambda x, i: case when {_UNIT(74)} / 4294967296.0e0 < 0.25e0 then 0e0 else cast(x as double) end) v from embeddings), p as (select vec_id, list_sort(list_transform(v, lambda x, i: {{'h': {_UNIT(75)}, 'i': i, 'x': x}})) s from e),
 w as (select vec_id, list_transform(s, lambda y: y.x) v from p), m as (select vec_id, v, sqrt(list_avg(list_transform(v, lambda x: x * x)) - list_avg(v) * list_avg(v)) sd from w),
 n as (select vec_id, list_transform(v, lambda x, i: x + 0.1e0 * sd * sqrt(-2 * ln(({_UNIT(76)} + 1) / 4294967296.0e0)) * cos(2 * pi() * ({_UNIT(77)} / 4294967296.0e0))) v from m) select vec_id, cast(d as integer) dim, round(x, 5) x from (select vec_id, unnest(range(0, len(v))) d, unnest(v) x from n)""")
def vector_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vector corruptions in turn: a quarter of the components masked, the rest shuffled, then noise."""
    e, k = table(spark, sf_dir, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v")), F.col("vec_id")
    masked = e.select("vec_id", mask_vector(F.col("v"), k, 0.25, 74).alias("v")).select("vec_id", shuffle_vector(F.col("v"), k, 75).alias("v"))
    return masked.select("vec_id", F.posexplode(V.rounded(X.noisy_vector(F.col("v"), k, 0.1, 76), 5)).alias("dim", "x"))


_DOCS_ANSWER = ANSWER_SQL.replace(THINK_SQL, "select doc_id k, text response from documents")


@query(f"""with f as ({QUERIES['quality_flags'][1]}), a as (select k doc_id, answer from ({_DOCS_ANSWER})), t as ({QUERIES['approach_tag'][1]}), d as (select doc_id, {strip_sql('text')} s from documents)
 select doc_id, array_to_string(list_filter([case when very_short then 'very_short' end, case when s = '' then 'no_steps_found' end, case when answer is null then 'answer_not_extracted' end, case when label = 'unknown' then 'approach_unknown' end,
  case when repeated_content then 'repeated_content' end, case when incomplete then 'incomplete_response' end, case when language_mixing then 'language_mixing' end], lambda x: x is not null), ',') flags from f join a using (doc_id) join t using (doc_id) join d using (doc_id)""")
def quality_flags_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven quality flags of each document as a response, its own text standing for the thinking, too."""
    x = F.col("text")
    flags = quality_flags(x, x, F.size(T.segment_steps(x)), T.extract_answer(x)["answer"], T.classify_approach(x)["label"])
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(flags, ",").alias("flags"))


@query(f"""with r as (select doc_id, text || chr(10) || 'The answer is ' || n_chars t, case when doc_id % 3 = 0 then n_chars + 1 else n_chars end gold from documents), a as ({QUERIES['approach_tag'][1].replace('from documents', "from (select doc_id, text || chr(10) || 'The answer is ' || n_chars as text from documents)")})
 select doc_id, doc_id % 3 <> 0 correct, doc_id % 3 <> 0 and label = 'unknown' needs_review from r join a using (doc_id)""")
def review_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which responses reach their gold answer, and which of those by an approach that no keyword tells."""
    response, gold = F.concat("text", F.lit("\nThe answer is "), "n_chars"), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).cast("string")
    rows = table(spark, sf_dir, "documents").select("doc_id", response.alias("r"), gold.alias("gold"))
    return needs_review(rows, "r", "gold").select("doc_id", "correct", "needs_review")


_dataset = "['OmniMath', 'OlympiadBench', 'MATH'][cast(regexp_extract(source, '[0-9]+') as integer) % 3 + 1]"


@query(f"""with c as (select {_dataset} ds, quality = 1 ok, toxic = 1 b, lang = 'en' et, n_chars % 5 = 0 gap, len({words_sql('text')}) w, n_chars * 1e-6 cost, source from documents join (select distinct * from labels) using (doc_id)),
 p as (select count(*) n from (select source from c group by source having count(*) filter (b) > 0 and count(*) filter (not b) > 0)),
 rate as (select avg(case when ds = 'OmniMath' then case when ok then 1e0 else 0 end end) o, avg(case when ds = 'OlympiadBench' then case when ok then 1e0 else 0 end end) y, avg(case when ds = 'MATH' then case when ok then 1e0 else 0 end end) m,
  avg(case when ds = 'OmniMath' and ok then case when b then 1e0 else 0 end end) br, avg(case when et then case when gap then 1e0 else 0 end end) g, avg(case when w >= 20 then 1e0 else 0 end) i, avg(case when w >= 80 then 1e0 else 0 end) q, sum(cost) cost, count(*) n from c),
 r as (select unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) place, unnest(['total_candidates', 'OmniMath_correct_rate', 'OlympiadBench_correct_rate', 'MATH_correct_rate', 'type_b_of_correct', 'contrastive_pairs', 'thinking_gap_rate', 'included_rate', 'clean_rate', 'total_cost']) as name,
  unnest([n between 2650 and 2750, o between 0.4 and 0.6, y between 0.4 and 0.6, m between 0.55 and 0.75, br between 0.35 and 0.55, (select n from p) >= 250, g >= 0.15, i >= 0.9, q >= 0.8, cost < 25]) ok,
  unnest([cast(n as double), o, y, m, br, cast((select n from p) as double), g, i, q, cost]) shown from rate), s as (select place, name, case when ok then 'PASS' when name in ('total_candidates', 'contrastive_pairs') then 'SKIP' else 'FAIL' end status, round(shown, 6) shown from r where shown is not null)
 select place, name, status, shown from s union all select 10, 'overall', case when count(*) filter (status = 'FAIL') > 0 then 'FAIL' else 'PASS' end, null from s""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of a corpus by their fixed bounds, counts skipped where small, and the overall result."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").distinct(), "doc_id")
    w = T.n_words(F.col("text"))
    dataset = F.get(F.array(*map(F.lit, ("OmniMath", "OlympiadBench", "MATH"))), F.regexp_extract("source", "[0-9]+", 0).cast("int") % 3)
    c = docs.select(
        dataset.alias("dataset"), (F.col("quality") == 1).alias("answer_correct"), F.when(F.col("toxic") == 1, "B").otherwise("A").alias("candidate_type"), (F.col("lang") == "en").alias("has_extended_thinking"),
        (F.col("n_chars") % 5 == 0).alias("thinking_response_gap"), (w >= 20).alias("include_in_training"), F.when(w < 80, F.array(F.lit("very_short"))).otherwise(F.array()).alias("quality_flags"), (F.col("n_chars") * F.lit(1e-6)).alias("total_cost_usd"), "source",
    )
    both = c.groupBy("source").agg(F.count_if(F.col("candidate_type") == "B").alias("b"), F.count("*").alias("n")).where("b > 0 and b < n")
    return K.validation_report(c, both, allow_small=True)


def _scores(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Score blobs of three scorers over orders' items, a thousand orders a blob; one scorer scored almost nothing, one gives scores that do not align."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") >= 0.08).cast("int").alias("bad"), "l_tax", "l_quantity")
    score = {"tax": 1 - F.col("l_tax") * 10, "blend": F.round(1 - F.col("l_quantity") / 100 - 0.4 * F.col("bad"), 6), "few": 1 - F.col("l_tax")}
    orders = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "bad", *[s.cast("double").alias(m) for m, s in score.items()]))).alias("o"))  # items move once for all scorers
    scored = lambda m: F.struct(F.lit(m).alias("model"), F.transform("o", lambda x: F.struct(x["l_linenumber"].alias("l_linenumber"), x[m].alias("s"), x["bad"].alias("bad"))).alias("p"))
    steps = orders.select("l_orderkey", F.inline(F.array(*map(scored, score)))).where("model <> 'few' or l_orderkey <= 10")
    row = F.struct(F.col("l_orderkey").cast("string").alias("id"), F.transform("p", lambda x: x["s"]).alias("step_scores"), F.when(F.col("l_orderkey") % 97 == 0, F.array(F.lit(0))).otherwise(F.transform("p", lambda x: x["bad"])).alias("step_labels"))
    blobs = steps.withColumn("_blob", F.floor(F.col("l_orderkey") / 1000)).groupBy("model", "_blob").agg(F.collect_list(row).alias("rows"))  # a thousand orders at most
    blobs.withColumn("skipped", (F.col("_blob") % 2).cast("int")).drop("_blob").write.json(folder)


_CHAINS = "select l_orderkey k, max(case when l_discount >= 0.08 then 1 else 0 end) y, cast(count(*) as double) n_steps from lineitem group by 1"


@query()
def score_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step scorers read from their files, each under the same control for confounds, least and mean score; failed scorers are reported."""
    folder = f"{checkpoint_folder(spark)}/scores-{uuid.uuid4().hex}"
    _scores(spark, sf_dir, folder)
    steps = written(read_scores(spark, folder, multi_line=False))
    remove(spark, folder)
    chains = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max((F.col("l_discount") >= 0.08).cast("int")).alias("y"), F.count("*").cast("double").alias("n_steps"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.log1p("o_totalprice").alias("price"))
    rows = chains.join(orders, "o_orderkey").select(F.col("o_orderkey").cast("string").alias("id"), "y", "n_steps", "price", "o_orderpriority", (h(78, F.col("o_orderkey")) % 5).cast("int").alias("fold"))
    return R.score_panel(steps, rows, "y", "fold", 0, [F.col("n_steps"), F.col("price")], [F.col("o_orderpriority")])


@query("""with c as (select l_orderkey k, count(*) n from lineitem group by 1), m as (select unnest(['tax', 'blend', 'few']) model), r as (select model, k, k % 97 = 0 and n <> 1 odd, k // 1000 b from c, m where model <> 'few' or k <= 10)
 select model, cast(count(*) filter (not odd) as bigint) kept, cast(count(*) filter (odd) as bigint) misaligned, cast((select count(distinct b) from r r2 where r2.model = r.model and b % 2 = 1) as bigint) skipped from r group by model""")
def score_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each scorer's files align, do not, or were skipped."""
    folder = f"{checkpoint_folder(spark)}/scores-{uuid.uuid4().hex}"
    _scores(spark, sf_dir, folder)
    out = written(skipped_scores(spark, folder, multi_line=False))
    remove(spark, folder)
    return out


@query()
def over_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What source indicators take away from a vector's controlled AUC, fold by fold."""
    return R.over_control(records(spark, sf_dir), "v", [F.col("w"), F.col("latex"), F.col("n_steps")], [F.col("source")], "y", "fold", [0, 1, 2])


@query()
def stratified_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear probe on an exact stratified split: accuracy, F1, macro F1 and AUC."""
    v = table(spark, sf_dir, "embeddings").where("label is not null").select("vec_id", (F.col("label") < 3).cast("int").alias("y"), V.doubles(F.col("embedding")).alias("v"))
    return R.stratified_probe(v, "v", "y", F.col("vec_id"))
