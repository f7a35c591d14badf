"""The registered queries of the training-data operators; each is thin and applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestep.llm import decontam, fim, fuzzy_lines, near_dup, packing, quality, repeats, resampling, sharding, token_files, topk, toxicity, url_filter
from lodestep.sources.tables import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, _tokenizer("byte_bpe_50k.json"), spaces="leading", end_id=1, size=2048)


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(table(spark, sf_dir, "pages"), URL_RULES, url_filter.labelled_urls(spark))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents"), sentences=True)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.line_groups(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.round_trip(docs, _tokenizer("word_bpe_49k.json"), spaces="dropped", end_id=1)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(table(spark, sf_dir, "documents"), seed=1, percent=90, percent_spm=20)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    restored = fim.restore(F.col("output"), F.col("form"))
    chars = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n", "form", *chars, digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, n=3, size=10_000, least_words=20, seed=42)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.layout(table(spark, sf_dir, "documents"), shards=8, seed=42)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_packing": op2_packing,
        "op3_url_filter": op3_url_filter,
        "op4_repeats": op4_repeats,
        "op5_near_dup": op5_near_dup,
        "op6_fuzzy_lines": op6_fuzzy_lines,
        "op7_token_files": op7_token_files,
        "op8_topk": op8_topk,
        "op9_decontam": op9_decontam,
        "op10_toxicity": op10_toxicity,
        "op11_fim": op11_fim,
        "op12_resampling": op12_resampling,
        "op13_sharding": op13_sharding,
    }


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = f"""with recursive d as (select doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') w from documents),
 s as (select distinct doc_id, array_to_string(list_slice(w, p, p + least(4, len(w)) - 1), ' ') || ' ' || least(4, len(w)) g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) p from d where len(w) > 0)),
 n as (select doc_id, count(*) n from s group by doc_id),
 c as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
 l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
 e as (select a, b from l union select b, a from l),
 r as (select doc_id a, doc_id b from documents union select r.a, e.b from r join e on r.b = e.a)
 select d.doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, m.c component_id, m.c = d.doc_id kept from d left join n using (doc_id) join (select a, min(b) c from r group by a) m on m.a = d.doc_id"""

OP8_SQL = """with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select q.vec_id query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
 r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rn from s)
 select query_id, cast(rn as integer) as rank, vec_id, score from r where rn <= 20"""

WORD = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
OP9_SQL = f"""with d as (select doc_id, regexp_extract_all({LOWER}, {WORD}) w from documents),
 i as (select cast(item_id as varchar) id, regexp_extract_all({LOWER}, {WORD}) w from benchmark where item_id is not null),
 win as (select distinct id, l, array_to_string(list_slice(w, p, p + l - 1), ' ') g from (select id, w, least(10, len(w)) l, unnest(range(1, len(w) - least(10, len(w)) + 2)) p from i where len(w) > 0)),
 dw as (select doc_id, p, l, array_to_string(list_slice(w, p, p + l - 1), ' ') g from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) p from d, (select distinct l from win) where len(w) >= l)),
 hit as (select doc_id, p, l, id from dw join win using (l, g)),
 pos as (select doc_id, count(distinct q) n from (select doc_id, unnest(range(p, p + l)) q from hit) group by 1),
 its as (select doc_id, count(*) n_items, string_agg(id, ',' order by id) s from (select distinct doc_id, id from hit) group by 1)
 select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n, 0) > 0 contaminated
 from d left join pos using (doc_id) left join its using (doc_id)"""


OP11_SQL = """with h as (select doc_id, coalesce(text, '') t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) d from documents),
 u as (select doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') u, [cast('0x' || substr(d, 8 * i + 1, 8) as bigint) for i in [0, 1, 2, 3]] h from h),
 k as (select *, len(u) n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) lo, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) hi,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end form from u),
 p as (select *, array_to_string(u[:lo], '') p, array_to_string(u[lo + 1:hi], '') m, array_to_string(u[hi + 1:], '') s from k)
 select doc_id, cast(n as bigint) n, form, cast(case when form <> 'plain' then length(p) end as bigint) prefix_chars, cast(case when form <> 'plain' then length(m) end as bigint) middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(t) restored_sha256 from p"""


def _nibbles() -> list[int]:
    """What four bits of a CRC-32 state become, by its polynomial."""
    out = list(range(16))
    for _ in range(4):
        out = [x >> 1 ^ (x & 1) * 0xEDB88320 for x in out]
    return out


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes in DuckDB SQL, four bits at a time; null for an empty text."""
    fold = lambda x: f"xor({x} >> 4, {_nibbles()}[({x} & 15) + 1])"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: cast('0x' || b as bigint))"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {data}), lambda c, b: {fold(fold('xor(c, b)'))}), 4294967295)"


OP12_SQL = f"""with x as (select row_number() over () r, doc_id, regexp_extract_all({LOWER}, {WORD}) w from documents), y as (select row_number() over () r, regexp_extract_all({LOWER}, {WORD}) w from benchmark),
 g as (select r, array_to_string(w[p:p + k - 1], ' ') g from (select r, w, k, unnest(range(1, len(w) - k + 2)) p from x, range(1, 4) n(k))), gt as (select array_to_string(w[p:p + k - 1], ' ') g from (select w, k, unnest(range(1, len(w) - k + 2)) p from y, range(1, 4) n(k))),
 b as (select g, {crc32_sql("g")} % 10000 b from (select g from g union select g from gt)),
 f as (select r, b, count(*) n from g join b using (g) group by r, b), s as (select b, sum(n) s from f group by b), t as (select b, count(*) t from gt join b using (g) group by b),
 v as (select b.b, floor(1000 * ln((coalesce(t, 0) + 1e0) * ((select coalesce(sum(s), 0) from s) + 10000e0) / ((coalesce(s, 0) + 1e0) * ((select coalesce(sum(t), 0) from t) + 10000e0)))) v from range(10000) b(b) left join s using (b) left join t using (b)),
 w as (select r, sum(n) n, sum(n * v) w from f join v using (b) group by r),
 d as (select doc_id, len(x.w) >= 20 able, cast(coalesce(n, 0) as bigint) n_features, cast(coalesce(w.w, 0) as bigint) weight,
  cast(coalesce(w.w, 0) + floor(-1000e0 * ln(-ln((cast('0x' || sha256('42:' || coalesce(cast(doc_id as varchar), ''))[:8] as bigint) + 0.5e0) / 4294967296e0))) as bigint) score from x left join w using (r)),
 o as (select *, row_number() over (partition by able order by score desc, doc_id) rn, count(*) over (partition by able) c from d)
 select doc_id, n_features, weight, score, cast(case when able and rn <= c * 5 // 100 then rn end as bigint) rank from o"""


def _op13_sql(shards: int = 8, seed: int = 42) -> str:
    """The permutation in SQL: six rounds over two halves, and the walk as a recursion."""
    low, mixed = "4294967295", "xor(r, {key})"
    for _ in range(2):
        mixed = f"((xor({mixed} >> 16, {mixed}) * {sharding.MIX}) & {low})"
    half = "(select k from n)"
    turns = ", ".join(
        f"t{i + 1} as (select i, r l, xor(l, xor(m >> 16, m) & ((1 << {half}) - 1)) r from (select i, l, r, {mixed.format(key=key)} m from t{i}))" for i, key in enumerate(sharding.round_keys(seed))
    )
    once = f"(with t0 as (select i, x >> {half} l, x & ((1 << {half}) - 1) r from {{src}}), {turns} select i, (l << {half}) | r x from t{len(sharding.round_keys(seed))})"
    return f"""with recursive d as (select cast(doc_id as bigint) doc_id, coalesce(text, '') t from documents), i as (select *, row_number() over (order by doc_id nulls first, sha256(t)) - 1 i from d),
 n as (select count(*) n, greatest(1, cast(ceil(length(ltrim(bin(greatest(count(*) - 1, 1)), '0')) / 2.0e0) as bigint)) k from d),
 z as (select i, x from {once.format(src="(select i, i x from i)")} union all select i, x from {once.format(src="(select i, x from z where x >= (select n from n))")})
 select doc_id, cast(octet_length(encode(t)) + 1 as bigint) size, coalesce({crc32_sql("t")}, 0) text_crc32, 'rows' law, cast(x % {shards} as integer) shard, cast(x // {shards} as bigint) slot, cast(null as integer) grown_shard
 from i join z using (i) where x < (select n from n)"""


OP13_SQL = _op13_sql()


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the operators whose rows SQL can express; the others are tested against brute force."""
    return {"op5_near_dup": OP5_SQL, "op8_topk": OP8_SQL, "op9_decontam": OP9_SQL, "op11_fim": OP11_SQL, "op12_resampling": OP12_SQL, "op13_sharding": OP13_SQL}
