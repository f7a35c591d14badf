"""Queries over the text of solutions: features, steps, answers, approaches, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestep.functions import patterns as P
from lodestep.functions import text as T
from lodestep.plans.registry import query
from lodestep.sources.tables import table


def q(s: str) -> str:
    """A DuckDB string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(items: list[str]) -> str:
    return "[" + ", ".join(map(q, items)) + "]"


#: White-space words, and a text whose letters beyond ASCII count as letters at word boundaries.
WORDS = "list_filter(regexp_split_to_array(coalesce({x}, ''), '[\\s]+'), lambda w: w <> '')"
ASCII = "regexp_replace({x}, '[\\x{{80}}-\\x{{10FFFF}}]', 'z', 'g')"
STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def words_sql(x: str) -> str:
    return WORDS.format(x=x)


def strip_sql(x: str) -> str:
    return STRIP.format(x=x)


#: Solutions built from orders, alike in both engines; each branch of the text functions has a case.
SOLUTION = """case @k % 8
 when 0 then '1. Let x denote the total.' || chr(10) || '2. We compute ' || @K || ' + ' || @C || '.' || chr(10) || '3. Therefore the answer is ' || chr(92) || 'boxed{' || @S || '}.'
 when 1 then 'First we list out the pattern.' || chr(10) || chr(10) || 'Since step 2 gives ' || @K || ', check it again.' || chr(10) || chr(10) || 'So the answer is ' || @K || '.'
 when 2 then 'The area of the triangle is $' || @K || '$.' || chr(10) || 'We verify for all n, the ratio holds.' || chr(10) || 'x = ' || @C
 when 3 then '<think>Let me try counting. Wait, that is wrong. Let x be the variable and solve for the equation now.</think>The probability is random. ' || chr(92) || 'boxed{C = ' || @K || ',000}'
 when 4 then '[THINKING]hold on, the prime is divisible by a long list of other things that we know of[/THINKING][RESPONSE]Given a b c, it ends'
 when 5 then '<think>no response because the tokens ran out'
 when 6 then 'Nested ' || chr(92) || 'boxed{1} then ' || chr(92) || 'boxed{{' || @K || '}' || chr(92) || 'frac{1}{2}}'
 else '' end"""


def _filled(k: str, c: str) -> str:
    """The solution's SQL over two key columns; both engines take it."""
    text = "cast({} as varchar(40))".format
    return SOLUTION.replace("@S", text(f"{k} + {c}")).replace("@K", text(k)).replace("@C", text(c)).replace("@k", k)


def solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    return orders.withColumn("full", F.expr(_filled("k", "c")))


SOLUTIONS_SQL = f'(select o_orderkey k, o_custkey c, {_filled("o_orderkey", "o_custkey")} "full" from orders)'


@query("""select d.source, cast(count(*) as bigint) n, cast(sum(case when quality = 0 then 1 else 0 end) as bigint) n_b,
 round(avg(case when quality = 0 then 1.0e0 else 0.0e0 end), 6) rate,
 round(avg(cast(len(""" + words_sql("text") + """) as double)), 6) mean_words,
 round(avg(cast(len(string_split(text, chr(10))) as double)), 6) mean_steps
 from documents d join labels l on d.doc_id = l.doc_id where quality is not null group by d.source order by d.source""")
def type_b_rate_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of unsound solutions by source, with the length and step confounds."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", T.n_words(F.col("text")).alias("w"), F.size(F.split("text", "\n")).alias("s")
    )
    labels = table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", "quality")
    return docs.join(labels, "doc_id").groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("n_b"),
        F.round(F.avg((F.col("quality") == 0).cast("double")), 6).alias("rate"),
        F.round(F.avg(F.col("w").cast("double")), 6).alias("mean_words"), F.round(F.avg(F.col("s").cast("double")), 6).alias("mean_steps"),
    ).orderBy("source")


@query(f"""select doc_id, cast(len({words_sql('text')}) as bigint) len_words, round(ln(1 + len({words_sql('text')})), 6) log_len,
 round(cast(length(text) - length(replace(text, chr(92), '')) + length(text) - length(replace(text, '$', '')) as double) / greatest(len({words_sql('text')}), 1), 6) latex_char,
 cast(greatest(1, len(regexp_extract_all(text, '(?m)^\\s*(?:[0-9]+[.):]|[-*])\\s'))) as bigint) n_steps_given from documents""")
def confound_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, LaTeX density and step count of each text."""
    x = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.n_words(x).alias("len_words"), F.round(F.log1p(T.n_words(x)), 6).alias("log_len"), F.round(T.latex_density(x), 6).alias("latex_char"),
        F.greatest(F.lit(1), F.regexp_count(x, F.lit(r"(?m)^\s*(?:[0-9]+[.):]|[-*])\s"))).cast("long").alias("n_steps_given"),
    )


STEP_TYPE_SQL = f"""case when i = n - 1 or regexp_matches(z, {q(P.CONCLUDE)}) then 'conclusion' when regexp_matches(z, {q(P.VERIFY)}) then 'verification'
 when regexp_matches(z, {q(P.APPROACH)}) then 'approach_statement' when regexp_matches(z, {q(P.SETUP)}) or i = 0 then 'setup' else 'computation' end"""


@query(f"""with s as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') steps from documents),
 e as (select doc_id, len(steps) n, unnest(range(0, len(steps))) i, unnest(steps) step from s),
 z as (select *, {ASCII.format(x='step')} z from e)
 select doc_id, cast(i as bigint) step_idx, {STEP_TYPE_SQL} step_type, cast(length(step) as bigint) step_chars from z""")
def step_explode_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a typed step."""
    steps = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda s: s != "")
    long = table(spark, sf_dir, "documents").select("doc_id", steps.alias("steps")).select("doc_id", F.size("steps").alias("n"), F.posexplode("steps").alias("i", "step"))
    return long.select("doc_id", F.col("i").cast("long").alias("step_idx"), T.step_type(F.col("step"), F.col("i"), F.col("n")).alias("step_type"), F.length("step").cast("long").alias("step_chars"))


BRACKET = "(?s)\\[THINKING\\](.*?)\\[/THINKING\\](.*)"
_clean = lambda x: strip_sql(f"replace(replace({x}, '[THINKING]', ''), '<think>', '')")
_after = lambda x: strip_sql(f"regexp_replace({x}, '^\\[RESPONSE\\]', '')")
THINK_SQL = f"""select k, c, "full", case when contains("full", '</think>') then {_clean("split_part(\"full\", '</think>', 1)")} when regexp_matches("full", {q(BRACKET)}) then {_clean(f'regexp_extract("full", {q(BRACKET)}, 1)')}
 when contains("full", '<think>') then {strip_sql("substr(\"full\", instr(\"full\", '<think>') + 7)")} else '' end think,
 case when contains("full", '</think>') then {_after("substr(\"full\", instr(\"full\", '</think>') + 8)")} when regexp_matches("full", {q(BRACKET)}) then {_after(f'regexp_extract("full", {q(BRACKET)}, 2)')}
 when contains("full", '<think>') then '' else {_after('"full"')} end response from {SOLUTIONS_SQL}"""


@query(f"select k, think, response, case when think <> '' then '[THINKING]' || think || '[/THINKING][RESPONSE]' || response else response end as assembled, contains(\"full\", '<think>') as tagged from ({THINK_SQL})")
def think_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thinking and response apart, and put together again in canonical form."""
    parts = solutions(spark, sf_dir).select("k", "full", T.split_think(F.col("full")).alias("p")).select("k", "full", "p.*")
    return parts.select("k", "think", "response", T.assemble(F.col("think"), F.col("response")).alias("assembled"), F.col("full").contains("<think>").alias("tagged"))


CONTENT = "(?s)^((?:[^{}]|\\{(?:[^{}]|\\{(?:[^{}]|\\{[^{}]*\\})*\\})*\\})*)\\}"
_rest = "list_extract(regexp_split_to_array(response, '\\\\boxed\\{'), -1)"
ANSWER_SQL = f"""select *, case when boxed is not null then boxed when said then {strip_sql(f'regexp_extract(response, {q(P.ANSWER_IS)}, 1)')} else number end answer,
 case when boxed is not null then 'boxed' when said then 'answer_is' when number is not null then 'last_number' else 'none' end method from (
 select *, case when contains(response, chr(92) || 'boxed{{') then {strip_sql(f'case when regexp_matches({_rest}, {q(CONTENT)}) then regexp_extract({_rest}, {q(CONTENT)}, 1) else {_rest} end')} end boxed,
 regexp_matches(response, {q(P.ANSWER_IS)}) said, list_extract(regexp_extract_all(array_to_string(list_slice(string_split(response, chr(10)), -3, -1), chr(10)), {q(P.NUMBER)}), -1) number from ({THINK_SQL}))"""


@query(f"select k, answer, method from ({ANSWER_SQL})")
def extract_answer_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final answer of each solution and how it was found."""
    response = T.split_think(F.col("full"))["response"]
    return solutions(spark, sf_dir).select("k", T.extract_answer(response).alias("a")).select("k", "a.*")


_plain = lambda x: f"regexp_replace(replace(replace(replace({strip_sql(f'coalesce({x}, {q('')})')}, '$', ''), ',', ''), '%', ''), '^[$ .]+|[$ .]+$', '', 'g')"
_norm = lambda x: f"case when regexp_matches({_plain(x)}, {q(P.FLOAT)}) and try_cast({_plain(x)} as double) % 1 = 0 then cast(cast(try_cast({_plain(x)} as double) as bigint) as varchar) else {_plain(x)} end"
_right = lambda x: f"case when contains({x}, '=') then {strip_sql(f'list_extract(string_split({x}, {q('=')}), -1)')} else {x} end"
_num = lambda x: f"case when regexp_matches({x}, {q(P.FLOAT)}) then try_cast({x} as double) end"
GIVEN = """case k % 7 when 0 then 'C = ' || k when 1 then k || ',000' when 2 then '$' || k || '.0$' when 3 then ' ' || k || '.5%' when 4 then k || '.0004' when 5 then '1d' else '' end"""
GOLD = """case k % 7 when 0 then cast(k as varchar(20)) when 1 then cast(k * 1000 as varchar(20)) when 2 then k || '.' when 3 then k || '.5' when 4 then cast(k as varchar(20)) when 5 then '1' else '' end"""


@query(f"""with a as (select o_orderkey k, {GIVEN.replace('k', 'o_orderkey').replace('o_orderkey %', 'o_orderkey %')} e, {GOLD.replace(' k', ' o_orderkey').replace('(k', '(o_orderkey')} g from orders),
 n as (select k, e, g, {_norm('e')} ne, {_norm(_right('e'))} nr, {_norm('g')} ng, {_norm(_right('g'))} gr from a),
 m as (select *, list_filter(list_intersect([ne, nr], [ng, gr]), lambda x: x <> '') same from n)
 select k, ne normalised, case when trim(e) = trim(g) and trim(e) <> '' then 'exact' when trim(e) = '' and trim(g) = '' then 'none' when len(same) > 0 then 'normalised'
 when coalesce(abs(({_num('ne')}) - ({_num('ng')})) < 1e-3, false) then 'float' else 'none' end as method from m""")
def normalise_and_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written answers against gold ones."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    rows = rows.select("k", F.expr(GIVEN).alias("e"), F.expr(GOLD).alias("g"))
    return rows.select("k", T.normalise_answer(F.col("e")).alias("normalised"), T.answers_match(F.col("e"), F.col("g"))["method"].alias("method"))


def _hits_sql(groups: dict[str, list[str]], x: str) -> str:
    return ", ".join(f"list_filter({sql_list(v)}, lambda w: contains(lower({x}), w)) as h_{k}" for k, v in groups.items())


_labels = ", ".join(f"case when len(h_{k}) > 0 then '{k}' end" for k in P.APPROACH_KEYWORDS)
_all = " || ".join(f"h_{k}" for k in P.APPROACH_KEYWORDS)


@query(f"""with h as (select doc_id, {_hits_sql(P.APPROACH_KEYWORDS, 'text')} from documents), l as (select doc_id, list_filter([{_labels}], lambda x: x is not null) s, list_slice({_all}, 1, 5) kw from h)
 select doc_id, case when len(s) = 0 then 'unknown' when len(s) > 1 then 'mixed' else s[1] end as label, array_to_string(kw, ',') keywords from l""")
def approach_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approach by keywords."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.classify_approach(F.col("text")).alias("a"))
    return rows.select("doc_id", "a.label", F.array_join("a.keywords", ",").alias("keywords"))


_tails = ", ".join(f"case when regexp_matches(t, {q(p)}) then {{'l': length(list_extract(regexp_split_to_array(t, {q(p)}), -1)), 's': list_extract(regexp_split_to_array(t, {q(p)}), -1)}} end" for p in P.ABANDON)


@query(f"""with t as (select k, {strip_sql('think')} t from ({THINK_SQL})), s as (select *, list_min(list_filter([{_tails}], lambda x: x is not null)).s tail, {words_sql('t')} w from t)
 select k, case when coalesce(len({words_sql('tail')}) >= 5, false) then {strip_sql('tail')} when len(w) > 0 then array_to_string(list_slice(w, greatest(len(w) - least(len(w), greatest(20, len(w) // 4)) + 1, 1), len(w)), ' ') else '' end as region from s""")
def settled_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the thinking after its last change of mind."""
    return solutions(spark, sf_dir).select("k", T.settled_region(T.split_think(F.col("full"))["think"]).alias("region"))


@query(f"""with w as (select doc_id, text, {words_sql('text')} w from documents),
 g as (select doc_id, max(n) m from (select doc_id, array_to_string(list_slice(w, i, i + 19), ' ') g, count(*) n from (select doc_id, w, unnest(range(1, len(w) - 18)) i from w where len(w) >= 40) group by 1, 2) group by 1)
 select w.doc_id, len(w) < 80 as very_short, coalesce(m > 3, false) as repeated_content,
 case when {strip_sql('text')} = '' then true when contains(text, chr(92) || 'boxed{{') then false else not regexp_matches(list_extract(string_split({strip_sql('text')}, chr(10)), -1), '[.!?}}$]$') or len({words_sql(f'list_extract(string_split({strip_sql("text")}, chr(10)), -1)')}) < 4 end as incomplete,
 regexp_matches(text, {q(P.HAN)}) as language_mixing from w left join g using (doc_id)""")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Very short, looping, cut-off and language-mixed texts."""
    x = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.fewer_words(x, 80).alias("very_short"), T.has_repeated_ngram(x).alias("repeated_content"), T.is_incomplete(x).alias("incomplete"), T.has_han(x).alias("language_mixing")
    )


@query(f"""with w as (select doc_id, {words_sql('text')} w from documents), g as (select doc_id, array_to_string(list_slice(w, i, i + 4), ' ') g, count(*) n from (select doc_id, w, unnest(range(1, len(w) - 3)) i from w where len(w) >= 10) group by 1, 2)
 select doc_id, cast(max(n) as bigint) most, cast(count(*) as bigint) n_distinct from g group by 1""")
def ngram_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a document's most frequent five words in a row occur."""
    long = table(spark, sf_dir, "documents").where(~T.fewer_words(F.col("text"), 10))
    return long.select("doc_id", T.ngram_counts(F.col("text"), 5).alias("c")).select("doc_id", F.col("c")["most"].alias("most"), F.col("c")["distinct"].alias("n_distinct"))


_size = {k: f"len(list_filter({sql_list(v)}, lambda w: contains(lower(text), w)))" for k, v in P.SUBJECT_KEYS.items()}
_top = f"greatest({', '.join(_size.values())})"


@query(f"select doc_id, case when {_top} = 0 then 'other' {' '.join(f'when {s} = {_top} then {q(k)}' for k, s in _size.items())} end as subject from documents")
def subject_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject by the most keys."""
    return table(spark, sf_dir, "documents").select("doc_id", T.infer_subject(F.col("text")).alias("subject"))


_NUM_DUCK = "(?im)^\\s*(?:step\\s*)?[0-9]+[\\.\\):]\\s+"
_cut = lambda parts: f"list_filter(list_transform({parts}, lambda s: {strip_sql('s')}), lambda s: s <> '')"


@query(f"""with t as (select k, {strip_sql('response')} t from ({THINK_SQL})), c as (select k, t, len(regexp_extract_all(t, {q(_NUM_DUCK)})) m,
 {_cut(f"string_split(regexp_replace(t, {q('(' + _NUM_DUCK + ')')}, chr(1) || '\\1', 'g'), chr(1))")} a, {_cut("regexp_split_to_array(t, '\\n\\s*\\n')")} b, {_cut("string_split(t, chr(10))")} l,
 {_cut("string_split(regexp_replace(t, '([.!?])\\s+([A-Z\\\\])', '\\1' || chr(1) || '\\2', 'g'), chr(1))")} s from t),
 r as (select k, case when t = '' then [] when m >= 2 and len(a) >= 2 then a when len(b) >= 2 then b when len(l) >= 2 then l else s end steps from c)
 select k, cast(len(steps) as bigint) num_steps, array_to_string(steps, '|') steps from r""")
def step_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses cut into numbered steps, paragraphs, lines or sentences."""
    steps = T.segment_steps(T.split_think(F.col("full"))["response"])
    return solutions(spark, sf_dir).select("k", steps.alias("s")).select("k", F.size("s").cast("long").alias("num_steps"), F.array_join("s", "|").alias("steps"))


REPLY = """case k % 5 when 0 then 'It seems spurious. LABEL: sound_canonical' when 1 then 'unfaithful, no, flawed_lucky' when 2 then 'label: none; it is spurious' when 3 then 'Label: spurious or unfaithful' else 'no idea' end"""
_known = P.MECHANISMS_SOUND + P.MECHANISMS_FLAWED
_firsts = ", ".join(f"case when contains(tail, '{k}') then {{'at': instr(tail, '{k}'), 'k': '{k}'}} end" for k in _known)
_lasts = ", ".join(f"case when contains(t, '{k}') then {{'at': -instr(reverse(t), '{k[::-1]}') - {len(k)}, 'k': '{k}'}} end" for k in _known)


@query(f"""with t as (select o_orderkey k, lower({REPLY.replace('case k', 'case o_orderkey')}) t from orders), s as (select *, list_extract(string_split(t, 'label:'), -1) tail from t),
 r as (select *, list_min(list_filter([{_firsts}], lambda x: x is not null)).k f, list_max(list_filter([{_lasts}], lambda x: x is not null)).k l from s)
 select k, case when contains(t, 'label:') then coalesce(f, l) else l end as mechanism from r""")
def mechanism_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict in a judge's free reply."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).withColumn("reply", F.expr(REPLY))
    return rows.select("k", T.mechanism_label(F.col("reply")).alias("mechanism"))


@query(r"""select doc_id, md5(case when length(text) <= 500 then text else left(text, 300) || chr(10) || '[...]' || chr(10) || right(text, 200) end) clipped,
 cast(floor(len(list_filter(regexp_split_to_array(text, '[\s]+'), lambda w: w <> '')) * 1.3e0) as bigint) est_tokens from documents""")
def clip_and_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts clipped for a judge's prompt, and the token estimate."""
    x = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clip(x, 500)).alias("clipped"), F.floor(T.n_words(x) * F.lit(1.3).cast("double")).cast("long").alias("est_tokens"))



