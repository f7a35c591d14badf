"""Queries over the corpus algebra: types, pairs, validation, trees, requests, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestep.operators import corpus as K
from lodestep.plans.registry import query
from lodestep.plans.text_queries import words_sql
from lodestep.sources.tables import table
from lodestep.streaming import incremental

#: What the type rule looks at, from documents and their labels; every branch has rows.
GRID = """select doc_id, quality = 1 correct, case when n_chars % 3 = 0 then null else toxic = 0 end matches, case when lang = 'de' then 'sound_canonical' when lang = 'fr' then 'flawed_lucky' end mechanism,
 case when n_chars % 2 = 0 then null else doc_id % 3 = 0 end gap, case lang when 'en' then 'claude_api_block' when 'es' then 'inline_think_tags' else 'none' end source from documents join (select distinct * from labels) using (doc_id)"""
CASES = [
    ("not correct and matches is not distinct from true", "C", "low", "answer+approach"), ("not correct", "D", "high", "answer_only"),
    ("mechanism in ('sound_canonical', 'sound_alternative')", "A", "high", "answer+mechanism"),
    ("mechanism in ('flawed_lucky', 'unfaithful', 'spurious')", "B", "high", "answer+mechanism"),
    ("gap and source = 'claude_api_block'", "B", "high", "answer+thinking_gap"), ("gap", "B", "medium", "answer+thinking_gap"),
    ("matches is not distinct from false", "B", "medium", "answer+approach"), ("matches", "A", "high", "answer+approach"),
]
_case = lambda i, last: "case " + " ".join(f"when {c[0]} then '{c[i]}'" for c in CASES) + f" else '{last}' end"


@query(f"select doc_id, correct, matches, mechanism, gap, source, {_case(1, 'A')} as type, {_case(2, 'low')} confidence, {_case(3, 'answer_only')} decided_by from ({GRID})")
def type_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type rule on what documents and their labels say."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").distinct(), "doc_id")
    lang, n = F.col("lang"), F.col("n_chars")
    rows = rows.select(
        "doc_id", (F.col("quality") == 1).alias("correct"), F.when(n % 3 != 0, F.col("toxic") == 0).alias("matches"), F.when(lang == "de", "sound_canonical").when(lang == "fr", "flawed_lucky").alias("mechanism"),
        F.when(n % 2 != 0, F.col("doc_id") % 3 == 0).alias("gap"), F.when(lang == "en", "claude_api_block").when(lang == "es", "inline_think_tags").otherwise("none").alias("source"),
    )
    return rows.select("*", K.candidate_type(F.col("correct"), F.col("matches"), F.col("mechanism"), F.col("gap"), F.col("source")).alias("t")).select(
        "doc_id", "correct", "matches", "mechanism", "gap", "source", "t.type", "t.confidence", "t.decided_by"
    )


#: Conversations as groups of candidates: the type from the text's length, the model from the role, the confidence from the turn.
CANDIDATES = "(select conv_id grp, turn pos, role model, case when length(text) % 3 = 0 then 'B' when length(text) % 3 = 1 then 'A' else 'D' end as type, case when turn % 3 = 0 then 'high' when turn % 3 = 1 then 'medium' else 'low' end confidence from conversations)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, turn = F.length("text") % 3, F.col("turn") % 3
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("grp"), F.col("turn").alias("pos"), F.col("role").alias("model"), F.when(size == 0, "B").when(size == 1, "A").otherwise("D").alias("type"),
        F.when(turn == 0, "high").when(turn == 1, "medium").otherwise("low").alias("confidence"),
    )


@query(f"""with c as {CANDIDATES}, g as (select grp, bool_or(type = 'A') has_a, bool_or(type = 'B') has_b, list_sort(list_distinct(list(model) filter (type = 'A'))) am, list_sort(list_distinct(list(model) filter (type = 'B'))) bm from c group by grp)
 select c.grp, c.pos, type = 'A' and has_b anchor, type = 'B' and has_a negative, case when (type = 'A' and has_b) or (type = 'B' and has_a) then c.grp || '_pair' end pair_id,
 coalesce(((type = 'A' and has_b) or (type = 'B' and has_a)) and am <> bm, false) as cross_model from c join g using (grp)""")
def pair_wiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors, negatives and pair ids within groups."""
    return K.wire_pairs(candidates(spark, sf_dir)).select("grp", "pos", "anchor", "negative", "pair_id", "cross_model")


@query(f"""with c as {CANDIDATES}, r as (select *, case confidence when 'high' then 3 when 'medium' then 2 else 1 end conf from c),
 p as (select a.grp, a.pos a_pos, b.pos b_pos, a.model <> b.model as cross_model, a.conf + b.conf conf, row_number() over (partition by a.grp order by a.model <> b.model desc, a.conf + b.conf desc, a.pos, b.pos) rn
 from r a join r b on a.grp = b.grp and a.type = 'A' and b.type = 'B') select grp, a_pos, b_pos, cross_model, cast(conf as integer) conf from p where rn = 1""")
def best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sound and unsound candidate of each group, found without making the group's pairs."""
    return K.best_pairs(candidates(spark, sf_dir))


@query(f"""with c as (select source dataset, quality = 1 correct, toxic = 1 b, n_chars, len({words_sql('text')}) w from documents join labels using (doc_id)),
 m as (select cast(count(*) as double) n, avg(case when correct then 1.0e0 else 0 end) ok, avg(case when correct then case when b then 1.0e0 else 0 end end) br, avg(case when w >= 80 then 1.0e0 else 0 end) inc, sum(n_chars) * 1e-6 cost from c)
 select name, passed, round(shown, 6) shown from (select unnest(['total', 'correct_rate', 'b_rate', 'include_rate', 'cost']) name, unnest([n between 2650 and 2750, ok between 0.55 and 0.9, br between 0.05 and 0.55, inc >= 0.5, cost < 25]) passed, unnest([n, ok, br, inc, cost]) shown from m)""")
def validation_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named checks of a corpus in one pass."""
    from lodestep.functions import text as T

    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", T.n_words(F.col("text")).alias("w"))
    c = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    correct = F.col("quality") == 1
    checks = [
        ("total", F.count("*").cast("double"), 2650, 2750), ("correct_rate", F.avg(correct.cast("double")), 0.55, 0.9),
        ("b_rate", F.avg(F.when(correct, (F.col("toxic") == 1).cast("double"))), 0.05, 0.55), ("include_rate", F.avg((F.col("w") >= 80).cast("double")), 0.5, None),
        ("cost", F.sum("n_chars") * F.lit(1e-6), None, 25),
    ]
    return K.validate(c, checks)


@query("""with g as (select conv_id, list(struct_pack(turn := turn, role := role, n := length(text)) order by turn) path from conversations where role = 'user' group by conv_id)
 select conv_id, cast(len(path) as bigint) depth, cast(path[1].turn as bigint) first_turn, cast(list_sum(list_transform(path, lambda s: s.n)) as bigint) chars, cast(coalesce(list_position(list_transform(path, lambda s: s.n > 200), true), 0) - 1 as bigint) first_bad from g""")
def tree_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen path of each tree and its first bad step."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.length("text").alias("n"))
    paths = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "n"))).alias("path"))  # a conversation's turns
    bad = F.coalesce(F.array_position(F.transform("path", lambda s: s["n"] > 200), True), F.lit(0)) - 1
    return paths.select(
        "conv_id", F.size("path").cast("long").alias("depth"), F.get("path", F.lit(0))["turn"].alias("first_turn"),
        F.aggregate("path", F.lit(0).cast("long"), lambda a, s: a + s["n"]).alias("chars"), bad.cast("long").alias("first_bad"),
    )


@query("""with r as (select conv_id, turn // 2 depth, turn, role, row_number() over (partition by conv_id, turn // 2 order by turn) rn from conversations)
 select conv_id, string_agg(role, '>' order by depth) chain, cast(count(*) as bigint) steps from r where rn = 1 group by conv_id""")
def preferred_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step for each depth, the first seen, joined in order of depth."""
    depth = F.floor(F.col("turn") / 2)
    first = table(spark, sf_dir, "conversations").groupBy("conv_id", depth.alias("depth")).agg(F.min_by("role", "turn").alias("role"))
    chain = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "role"))).alias("c"))
    return chain.select("conv_id", F.array_join(F.transform("c", lambda s: s["role"]), ">").alias("chain"), F.size("c").cast("long").alias("steps"))


@query("""with q as (select 'verify-' || conv_id || '-' || turn id, conv_id, turn from conversations), a as (select id, case when turn % 2 = 0 then ' Yes, same' else 'no' end reply from q where turn % 5 <> 4)
 select q.id, q.conv_id, q.turn, cast(regexp_extract(q.id, 'verify-([0-9]+)-([0-9]+)', 1) as bigint) back, coalesce(starts_with(upper(trim(reply)), 'YES'), false) verdict, reply is null missing from q left join a using (id)""")
def custom_id_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with ids of their own and the replies joined back to them."""
    q = table(spark, sf_dir, "conversations").select(F.concat(F.lit("verify-"), "conv_id", F.lit("-"), "turn").alias("id"), "conv_id", "turn")
    a = q.where("turn % 5 <> 4").select("id", F.when(F.col("turn") % 2 == 0, " Yes, same").otherwise("no").alias("reply"))
    return q.join(a, "id", "left").select(
        "id", "conv_id", "turn", F.regexp_extract("id", r"verify-([0-9]+)-([0-9]+)", 1).cast("long").alias("back"),
        F.coalesce(F.startswith(F.upper(F.trim("reply")), F.lit("YES")), F.lit(False)).alias("verdict"), F.col("reply").isNull().alias("missing"),
    )


@query("""select conv_id, turn, cast(case when j < e then 0 when j = e then 1 else -1 end as integer) label, cast(j as integer) step from
 (select conv_id, turn, turn % 4 - 1 e, unnest(range(0, 4)) j from conversations) where e >= 0 union all select conv_id, turn, 0, cast(unnest(range(0, 4)) as integer) from conversations where turn % 4 = 0""")
def step_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step labels from the first error's index: good before it, bad at it, unknown after; all good in a clean chain."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", K.labels_from(F.col("turn") % 4 - 1, F.lit(4)).alias("l"))
    return rows.select("conv_id", "turn", F.posexplode("l").alias("step", "label"))


@query("""select event_type, cast(count(*) as bigint) n, round(sum(value), 4) total from events group by event_type""")
def stream_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table drained as a stream: the same totals as a batch."""
    return incremental.drain_totals(spark, sf_dir)


@query("""with s as (select o_orderpriority prio, o_orderstatus st, o_totalprice v from orders) select prio, cast(sum(case when st = 'F' then 1 else 0 end) as bigint) n_f, cast(sum(case when st = 'O' then 1 else 0 end) as bigint) n_o,
 cast(sum(case when st = 'P' then 1 else 0 end) as bigint) n_p, round(sum(v * 3 + v * 15) / 1000000, 2) cost from s group by prio""")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by state pivoted, and the token cost formula."""
    s = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("prio"), F.col("o_orderstatus").alias("st"), F.col("o_totalprice").alias("v"))
    n = lambda x: F.count_if(F.col("st") == x)
    return s.groupBy("prio").agg(n("F").alias("n_f"), n("O").alias("n_o"), n("P").alias("n_p"), F.round(F.sum(F.col("v") * 3 + F.col("v") * 15) / 1000000, 2).alias("cost"))


@query("""with r as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn from orders) select o_custkey, o_orderkey, o_totalprice from r where rn = 1""")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed log after upserts: the latest row of each key."""
    return K.latest(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""with h as (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) rn from orders where o_totalprice between 1000 and 200000)
 select o_orderpriority, o_orderkey, o_totalprice from h where rn <= 25""")
def hardest_per_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 hardest problems of each split within a difficulty band."""
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    band = table(spark, sf_dir, "orders").where("o_totalprice between 1000 and 200000")
    return band.withColumn("rn", F.row_number().over(w)).where("rn <= 25").select("o_orderpriority", "o_orderkey", "o_totalprice")


@query("""with o as (select o_orderkey k from orders) select k, case k % 4 when 0 then 'A' when 1 then 'D' when 2 then 'A' else 'B' end as candidate_type, case k % 4 when 0 then 'low' when 1 then 'high' when 2 then 'high' else 'high' end as type_confidence,
 cast(k as varchar) normalised_gold, case k % 4 when 0 then 'boxed' when 1 then 'answer_is' when 2 then 'boxed' else 'last_number' end as found_by, cast(2 as integer) as num_steps, k % 2 = 0 as include_in_training from o""")
def processed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole candidate pipeline over nested problem records made from orders."""
    from lodestep.operators.process import process_candidates
    from lodestep.sources import records

    k = F.col("o_orderkey").cast("string")
    texts = [("The area is found.\nSo \\boxed{", k, "} holds"), ("We guess.\nThe answer is 1", k, " or so"), ("x\n\\boxed{", k, "} ok"), ("It is\n", k, " now")]
    given = {"temperature": F.lit(0.5), "answer_correct": F.when(F.col("o_orderkey") % 4 == 3, True), "type_b_mechanism": F.when(F.col("o_orderkey") % 4 == 3, "spurious").when(F.col("o_orderkey") % 4 == 2, "sound_canonical"),
             "response_text": F.get(F.array(*[F.concat(F.lit(a), b, F.lit(c)) for a, b, c in texts]), (F.col("o_orderkey") % 4).cast("int"))}
    fields = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in records.CANDIDATE.fields]
    problem = {"record_id": k, "gold_answer": k}
    raw = table(spark, sf_dir, "orders").select(
        *[problem.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in records.PROBLEM.fields], F.array(F.struct(*fields)).alias("candidates"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in records.CANDIDATE.fields],
    )
    out = process_candidates(records.flatten(raw))
    found = F.regexp_extract(F.coalesce("extraction_warning", F.lit("method: boxed")), r"method: (\w+)", 1)
    return out.select(F.col("record_id").cast("long").alias("k"), "candidate_type", "type_confidence", "normalised_gold", found.alias("found_by"), "num_steps", "include_in_training")
