"""Queries over corruptions and damages of solutions; lines are the steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestep.functions import patterns as P
from lodestep.functions import text as T
from lodestep.functions.rand import sql_h
from lodestep.operators import corrupt as X
from lodestep.plans.registry import query
from lodestep.plans.text_queries import ASCII, SOLUTIONS_SQL, q, solutions, strip_sql, words_sql
from lodestep.sources.tables import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text and its lines as steps."""
    steps = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda s: s != "")
    return table(spark, sf_dir, "documents").select("doc_id", "text", steps.alias("steps"))


STEPS = f"(select doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') steps from documents)"


def _chosen(seed: int, n: str, k: str, offset: int = 0) -> str:
    """The k indexes with the least hashes, in DuckDB."""
    pairs = f"list_sort(list_transform(range({offset}, {offset} + {n}), lambda i: {{'h': {sql_h(seed, 'doc_id', 'i')}, 'i': i}}))"
    return f"list_transform(list_slice({pairs}, 1, {k}), lambda s: s.i)"


def _joined(c: Column) -> Column:
    return F.md5(F.array_join(c, "\n"))


@query(f"""with w as (select doc_id, text, {words_sql('text')} w from documents), k as (select *, least(len(w), greatest(1, cast(floor(len(w) * 0.15e0) as integer))) k from w), h as (select *, {_chosen(1, 'len(w)', 'k')} hit from k)
 select doc_id, md5(case when len(w) > 0 then array_to_string(list_transform(w, lambda x, i: case when list_contains(hit, i - 1) then '[MASK]' else x end), ' ') else text end) out from h""")
def diffuse_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(X.diffuse_mask(F.col("text"), F.col("doc_id"), 0.15)).alias("out"))


@query(f"""with k as (select *, len(steps) - 2 n, least(len(steps) - 2, greatest(1, cast(floor((len(steps) - 2) * 0.3e0) as integer))) k from {STEPS}), h as (select *, {_chosen(2, 'greatest(n, 0)', 'k', 1)} gone from k)
 select doc_id, md5(array_to_string(case when len(steps) >= 3 then list_filter(steps, lambda s, i: not list_contains(gone, i - 1)) else steps end, chr(10))) out from h""")
def step_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", _joined(X.step_delete(F.col("steps"), F.col("doc_id"), 0.3)).alias("out"))


@query(f"""with k as (select *, least(len(steps) - 2, greatest(1, cast(floor((len(steps) - 2) * 0.3e0) as integer))) k from {STEPS}), s as (select *, {sql_h(3, 'doc_id')} % greatest(len(steps) - 2 - k + 1, 1) + 1 st from k)
 select doc_id, md5(array_to_string(case when len(steps) >= 4 then list_filter(steps, lambda s, i: i - 1 < st or i - 1 >= st + k) else steps end, chr(10))) out from s""")
def region_excise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", _joined(X.region_excise(F.col("steps"), F.col("doc_id"), 0.3)).alias("out"))


@query(f"select doc_id, cast(length(regexp_replace({ASCII.format(x='text')}, {q(P.CONNECTIVES)}, '', 'g')) as bigint) chars_left from documents")
def connective_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(X.connective_strip(F.col("text"))).cast("long").alias("chars_left"))


@query(f"""with s as (select k, list_transform(string_split(t, chr(10)), lambda x: x) steps from (select o_orderkey k, 'first 1' || chr(10) || 'then ' || o_orderkey || ' and 2.5' || chr(10) || 'x ' || o_custkey || chr(10) || 'last 3' t from orders))
 select k, array_to_string(list_transform(steps, lambda s, i: case when i > 1 and i < len(steps) and {sql_h(4, 'k', '(i - 1)')} / 4294967296.0e0 < 0.5e0 then regexp_replace(s, '[0-9]+(?:\\.[0-9]+)?', '[NUM]', 'g') else s end), '|') out from s""")
def result_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("first 1\nthen "), "o_orderkey", F.lit(" and 2.5\nx "), "o_custkey", F.lit("\nlast 3"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.split(text, "\n").alias("steps"))
    return rows.select("k", F.array_join(X.result_mask(F.col("steps"), F.col("k"), 0.5), "|").alias("out"))


@query(f"""with w as (select doc_id, text, {words_sql('text')} w from documents), l as (select *, list_filter(w, lambda s, i: {sql_h(9, 'doc_id', '(i - 1)')} / 4294967296.0e0 >= 0.25e0) k from w)
 select doc_id, md5(case when len(w) < 4 then text when len(k) = 0 then w[1] else array_to_string(k, ' ') end) out from l""")
def word_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.corrupt_words(F.col("text"), F.col("doc_id"))).alias("out"))


_STEP7 = f"""with s as (select *, len(steps) n, {sql_h(7, 'doc_id')} / 4294967296.0e0 u, {sql_h(8, 'doc_id')} h from {STEPS}),
 a as (select *, h % greatest(n - 2, 1) + 1 loc, case when n - 2 >= 2 then h % greatest(n - 3, 1) + 1 else 0 end sw from s)"""


@query(f"""{_STEP7} select doc_id, md5(array_to_string(case when n < 3 then steps when u < 0.7e0 then list_filter(steps, lambda s, i: i - 1 <> loc)
 else list_transform(steps, lambda s, i: case when i - 1 = sw then steps[sw + 2] when i - 1 = sw + 1 then steps[sw + 1] else s end) end, chr(10))) out from a""")
def step_corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", _joined(X.step_corruption(F.col("steps"), F.col("doc_id"))).alias("out"))


@query(f"""with f as (select k, '1. ' || k || ' is ' || c || '.' one, c from {SOLUTIONS_SQL}), s as (select k, case when regexp_matches(one, 'total') then 'additive' end found from f),
 o as (select k, list_filter([{', '.join(q(k) for k in P.APPROACH_REPLACEMENTS)}], lambda x: x is distinct from found) others from s), g as (select k, others[{sql_h(6, 'k')} % len(others) + 1] family from o)
 select k, family, case family {' '.join(f"when {q(k)} then [{', '.join(map(q, v))}][{sql_h(7, 'k')} % 3 + 1]" for k, v in P.APPROACH_REPLACEMENTS.items())} end first_step from g""")
def approach_corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canned sentence that replaces a first step, and its family."""
    rows = solutions(spark, sf_dir).select("k", F.array(F.concat(F.lit("1. "), "k", F.lit(" is "), "c", F.lit(".")), F.lit("end")).alias("steps"))
    first = rows.select("k", F.get(X.approach_corruption(F.col("steps"), F.col("k")), F.lit(0)).alias("first_step"))
    family = F.coalesce(*[F.when(F.col("first_step").isin(v), F.lit(k)) for k, v in P.APPROACH_REPLACEMENTS.items()])
    return first.select("k", family.alias("family"), "first_step")


_small = f"({sql_h(9, 'k')} % 10 + 1)"


@query(f"""with r as (select o_orderkey k, cast(o_totalprice as double) v from orders), p as (select k, [v + {_small}, v - {_small}, v * 2, v / 2, v + 10, v - 10][{sql_h(8, 'k')} % 6 + 1] w from r)
 select k, 'the answer ' || chr(92) || 'boxed' || chr(123) || case when w % 1 = 0 then cast(cast(w as bigint) as varchar) else cast(round(w, 4) as varchar) end || chr(125) || ' is' as out from p""")
def conclusion_corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("the answer \\boxed{"), "o_totalprice", F.lit("} is")).alias("r"))
    return rows.select("k", X.conclusion_corruption(F.col("r"), F.lit(None).cast("string"), F.col("k")).alias("out"))


@query(f"""select cast(count(*) as bigint) n, round(avg(case when len(steps) >= 3 then 1.0e0 when len(steps) = 2 then case when {' or '.join(f'{sql_h(40 + t, "doc_id")} % 3 = 2' for t in range(6))} then 1.0e0 else 0 end else 0 end), 6) structural from {STEPS}""")
def damage_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of documents that structural damage applies to."""
    hit = X.apply_damage(F.col("steps"), "structural", F.col("doc_id"))
    return documents(spark, sf_dir).select(hit.isNotNull().cast("double").alias("s")).agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("structural"))


@query()
def damage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One damage of each kind for each constructed solution, with its provenance; nothing where a kind does not apply."""
    rows = solutions(spark, sf_dir).select("k", T.segment_steps(T.split_think(F.col("full"))["response"]).alias("steps"))
    each = F.array(*[X.apply_damage(F.col("steps"), kind, F.col("k")) for kind in X.DAMAGES])
    return rows.select("k", F.inline(F.array_compact(each))).select("k", "damage_type", "operation", "step_indices", "detail", "steps")


_place = f"{sql_h(5, 'doc_id', 'x.j')} % (len(a.steps) + 1)"


@query(f"""with s as (select doc_id, steps, len(steps) n, greatest(1, cast(floor(len(steps) * 0.3e0) as bigint)) k from {STEPS}),
 o as (select doc_id, n, case when n > 0 then list_reduce(list_transform(range(1, k + 1), lambda j: {{'steps': cast([] as varchar[]), 'j': j}}), lambda a, x: {{'steps': list_concat(list_concat(a.steps[:{_place}], [[{', '.join(map(q, P.INERT_STEPS))}][{sql_h(105, 'doc_id', 'x.j')} % {len(P.INERT_STEPS)} + 1]]), a.steps[{_place} + 1:]), 'j': x.j}}, {{'steps': steps, 'j': cast(0 as bigint)}}).steps else steps end o from s)
 select doc_id, cast(n as integer) n_before, cast(len(o) as integer) n_after, md5(array_to_string(o, chr(10))) as out from o""")
def excess_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distractor steps put in."""
    out = X.excess_inject(F.col("steps"), F.col("doc_id"), 0.3)
    return documents(spark, sf_dir).select("doc_id", F.size("steps").alias("n_before"), F.size(out).alias("n_after"), _joined(out).alias("out"))


@query(f"""with d as (select unnest([0.1e0, 0.3e0, 0.5e0]) dose), s as (select doc_id, dose, len(steps) n, case when len(steps) >= 3 then least(len(steps) - 2, greatest(1, cast(floor((len(steps) - 2) * dose) as integer))) else 0 end k from {STEPS}, d)
 select dose, round(avg(cast(k as double) / greatest(n, 1)), 6) mean_share, cast(sum(k) as bigint) dropped from s group by dose""")
def dose_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many steps each dose of step deletion takes."""
    rows = documents(spark, sf_dir)
    doses = [F.struct(F.lit(d).alias("dose"), (F.size("steps") - F.size(X.step_delete(F.col("steps"), F.col("doc_id"), d))).alias("k")) for d in (0.1, 0.3, 0.5)]
    long = rows.select(F.size("steps").alias("n"), F.inline(F.array(*doses)))
    return long.groupBy("dose").agg(F.round(F.avg(F.col("k") / F.greatest("n", F.lit(1))), 6).alias("mean_share"), F.sum("k").cast("long").alias("dropped"))
