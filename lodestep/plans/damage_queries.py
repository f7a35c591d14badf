"""Every single damage of a solution beside SQL that gives the same steps, place and detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestep.functions import patterns as P
from lodestep.functions import text as T
from lodestep.functions.rand import sql_h
from lodestep.operators import corrupt as X
from lodestep.plans.corruption_queries import STEPS, documents
from lodestep.plans.registry import query
from lodestep.plans.text_queries import SOLUTIONS_SQL, q, solutions, strip_sql, words_sql

#: Solutions' lines as steps; what damages look for is in them.
_S = f"""s as (select k, steps, len(steps) n from (select k, list_filter(list_transform(string_split("full", chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') steps from {SOLUTIONS_SQL}))"""


#: The same with two more lines, in which variables stand again.
_S_VARIABLES = _S.replace("lambda x: x <> '') steps", "lambda x: x <> '') || ['so x + y = ' || c, 'y - x is ' || k || ', x x'] steps")


def _h(seed: int) -> str:
    return sql_h(seed, "k")


def _sites(patterns: list[str]) -> str:
    """(i, m) of every match, by step and text."""
    found = " || ".join(f"flatten(list_transform(steps, lambda s, i: list_transform(regexp_extract_all(s, {q(p)}), lambda m: {{'i': i - 1, 'm': m}})))" for p in patterns)
    return f"list_sort({found})"


def _put(new: str) -> str:
    """The steps with the first place of the chosen text in its step replaced."""
    return f"list_transform(steps, lambda s, i: case when i - 1 = site.i then left(s, instr(s, site.m) - 1) || {new} || substr(s, instr(s, site.m) + length(site.m)) else s end)"


_squeezed = lambda x: f"regexp_replace({x}, '\\s{{2,}}', ' ', 'g')"
_shift = "[-2, -1, 1, 2]"


_STRUCTURAL = f"""{_S}, a as (select *, {_h(20)} % greatest(n - 2, 1) + 1 d, {_h(21)} % greatest(n - 1, 1) w, {_h(22)} % greatest(n, 1) u from s),
 r as (select k, 'drop_step' operation, '[' || d || ']' indices, left(steps[d + 1], 80) detail, list_filter(steps, lambda s, i: i - 1 <> d) made from a where n >= 3
 union all select k, 'swap_steps', '[' || w || ', ' || (w + 1) || ']', 'adjacent order inverted', list_transform(steps, lambda s, i: case when i - 1 = w then steps[w + 2] when i - 1 = w + 1 then steps[w + 1] else s end) from a where n >= 3
 union all select k, 'duplicate_step', '[' || u || ']', left(steps[u + 1], 80), list_concat(steps[:u + 1], steps[u + 1:]) from a where n >= 2)"""


def _rows(rows: DataFrame, ops: list) -> DataFrame:
    found = [op(F.col("steps"), F.col("k")) for op in ops]
    long = rows.select("k", F.explode(F.array_compact(F.array(*found))).alias("d"))
    indices = F.concat(F.lit("["), F.array_join(F.col("d")["step_indices"].cast("array<string>"), ", "), F.lit("]"))
    return long.select("k", F.col("d")["operation"].alias("operation"), indices.alias("indices"), F.col("d")["detail"].alias("detail"), F.md5(F.array_join(F.col("d")["steps"], "\n")).alias("out"))


def _steps(spark: SparkSession, sf_dir: str, more: Column | None = None) -> DataFrame:
    lines = F.filter(F.transform(F.split("full", "\n"), T.strip), lambda s: s != "")
    return solutions(spark, sf_dir).select("k", (lines if more is None else F.concat(lines, more)).alias("steps"))


_MD5 = "select k, operation, indices, detail, md5(array_to_string(made, chr(10))) as out from ({})"


@query(f"with {_STRUCTURAL} {_MD5.format('select * from r')}")
def damage_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step left out, two neighbours swapped, a step said twice: the damaged steps, where, and what was there."""
    return _rows(_steps(spark, sf_dir), [X.drop_step, X.swap_steps, X.duplicate_step])


@query(f"""with {_S}, a as (select *, {_sites(P.REFERENCES)} sites from s), b as (select *, sites[{_h(23)} % greatest(len(sites), 1) + 1] site from a where len(sites) > 0), c as (select *, try_cast(nullif(regexp_extract(site.m, '[0-9]+'), '') as bigint) num from b),
 d as (select *, num is not null and {_h(25)} % 2 = 0 mis, regexp_replace(site.m, '[0-9]+', cast(greatest(1, num + {_shift}[{_h(24)} % 4 + 1]) as varchar), 'g') wrong from c),
 r as (select k, case when mis then 'misdirect_reference' else 'drop_reference' end operation, '[' || site.i || ']' indices, site.m detail, case when mis then {_put('wrong')} else list_transform({_put("''")}, lambda s: {strip_sql(_squeezed('s'))}) end made from d) {_MD5.format('select * from r')}""")
def damage_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference to another step pointed elsewhere or taken out."""
    return _rows(_steps(spark, sf_dir), [X.break_reference])


@query(f"""with {_S}, a as (select *, {_sites(P.CONSTRAINTS)} sites from s), b as (select *, sites[{_h(26)} % greatest(len(sites), 1) + 1] site from a where len(sites) > 0),
 c as (select *, list_transform({_put("''")}, lambda s: trim({_squeezed('s')}, ' ,;')) made from b), r as (select k, 'remove_condition' operation, '[' || site.i || ']' indices, left(site.m, 70) detail, made from c where len({words_sql('made[site.i + 1]')}) >= 2) {_MD5.format('select * from r')}""")
def damage_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition taken out of a step that keeps two words or more."""
    return _rows(_steps(spark, sf_dir), [X.remove_constraint])


@query(f"""with {_S}, a as (select *, list_sort(flatten(list_transform(steps, lambda s, i: list_transform(list_filter(regexp_extract_all(s, '[A-Za-z0-9_.]+'), lambda t: regexp_full_match(t, '[0-9]+')), lambda m: {{'i': i - 1, 'm': m}})))) sites from s),
 b as (select *, sites[{_h(29)} % greatest(len(sites), 1) + 1] site from a where len(sites) > 0), c as (select *, cast(site.m as hugeint) old from b), d as (select *, cast(old + case when old > 2 then {_shift}[{_h(30)} % 4 + 1] else {_h(30)} % 2 + 1 end as varchar) new from c),
 r as (select k, 'numeric_perturb' operation, '[' || site.i || ']' indices, site.m || ' -> ' || new detail, list_transform(steps, lambda s, i: case when i - 1 = site.i then regexp_replace(s, '(^|[^A-Za-z0-9_.])' || site.m || '([^A-Za-z0-9_.]|$)', '\\1' || new || '\\2') else s end) made from d) {_MD5.format('select * from r')}""")
def damage_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One whole number of a step changed by one or two."""
    return _rows(_steps(spark, sf_dir), [X.numeric_perturb])


_letter = "'(^|[^A-Za-z' || chr(92) || chr(92) || '])' || v || '([^A-Za-z]|$)'"
_renamed = f"regexp_replace(regexp_replace(s, {_letter}, '\\1' || new || '\\2', 'g'), {_letter}, '\\1' || new || '\\2', 'g')"


@query(f"""with {_S_VARIABLES}, f as (select *, flatten(list_transform(steps, lambda s, i: list_transform(list_distinct(list_filter(regexp_extract_all(s, chr(92) || chr(92) || '?[A-Za-z]+'), lambda t: length(t) = 1)), lambda v: {{'v': v, 'i': i - 1}}))) found from s),
 a as (select *, list_sort(list_distinct(list_transform(found, lambda x: x.v))) names from f), b as (select *, list_filter(names, lambda v: len(list_filter(found, lambda x: x.v = v)) >= 2 and v not in ('a', 'A', 'I')) several from a),
 c as (select *, several[{_h(27)} % greatest(len(several), 1) + 1] v from b where len(several) > 0), d as (select *, list_sort(list_transform(list_filter(found, lambda x: x.v = v), lambda x: x.i)) places, coalesce(list_filter(['q', 'w', 'z', 'k', 'm'], lambda x: not list_contains(names, x))[1], 'q') new from c),
 e as (select *, places[{_h(28)} % len(places) + 1] at_ from d), r as (select k, 'notation_drift' operation, '[' || at_ || ']' indices, v || ' -> ' || new detail, list_transform(steps, lambda s, i: case when i - 1 = at_ then {_renamed} else s end) made from e) {_MD5.format('select * from r')}""")
def damage_notation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variable of two or more steps renamed in one of them."""
    more = F.array(F.concat(F.lit("so x + y = "), "c"), F.concat(F.lit("y - x is "), "k", F.lit(", x x")))
    return _rows(_steps(spark, sf_dir, more), [X.notation_drift])


_D = f"s as (select doc_id k, steps, len(steps) n from {STEPS})"
_NUMBERS = "flatten(list_transform(steps, lambda s: list_filter(regexp_extract_all(s, '[A-Za-z0-9_.]+'), lambda t: regexp_full_match(t, '[0-9]+'))))"
_LETTERS = "flatten(list_transform(steps, lambda s: list_distinct(list_filter(regexp_extract_all(s, chr(92) || chr(92) || '?[A-Za-z]+'), lambda t: length(t) = 1))))"


def _seed(op: object, t: int) -> str:
    return _h(X.SEEDS[op] + 1000 * t)


def _any(tries: list[str]) -> str:
    return "(" + " or ".join(tries) + ")"


#: Whether any of six draws of an operation and a place applies, kind by kind.
_STRUCTURAL_HIT = _any([f"case {_h(40 + t)} % 3 when 2 then n >= 2 else n >= 3 end" for t in range(6)])
_LEFT = f"regexp_replace(left(steps[site.i + 1], instr(steps[site.i + 1], site.m) - 1) || substr(steps[site.i + 1], instr(steps[site.i + 1], site.m) + length(site.m)), '\\s{{2,}}', ' ', 'g')"
_ENOUGH = f"len({words_sql(f'trim({_LEFT}, ' + chr(39) + ' ,;' + chr(39) + ')')}) >= 2"
_CONSTRAINT_HIT = _any([_ENOUGH.replace("site", f"(cs[{_seed(X.remove_constraint, t)} % greatest(len(cs), 1) + 1])") for t in range(6)])
_OTHER_HIT = _any([f"case {_h(40 + t)} % 2 when 0 then several else len(nums) > 0 end" for t in range(6)])


@query(f"""with {_D}, a as (select *, {_sites(P.REFERENCES)} rs, {_sites(P.CONSTRAINTS)} cs, {_NUMBERS} nums, {_LETTERS} letters from s),
 b as (select *, len(list_filter(list_distinct(letters), lambda v: v not in ('a', 'A', 'I') and len(list_filter(letters, lambda x: x = v)) >= 2)) > 0 several from a),
 h as (select unnest(['structural', 'dependency', 'constraint', 'other']) damage_type, unnest([{_STRUCTURAL_HIT}, len(rs) > 0, len(cs) > 0 and {_CONSTRAINT_HIT}, {_OTHER_HIT}]) hit from b)
 select damage_type, cast(count(*) as bigint) n, round(avg(case when hit then 1.0e0 else 0 end), 6) rate from h group by damage_type""")
def damage_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind of damage the share of documents that it applies to."""
    hits = [F.struct(F.lit(kind).alias("damage_type"), X.apply_damage(F.col("steps"), kind, F.col("doc_id")).isNotNull().cast("double").alias("hit")) for kind in X.DAMAGES]
    long = documents(spark, sf_dir).select(F.inline(F.array(*hits)))
    return long.groupBy("damage_type").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("rate"))
