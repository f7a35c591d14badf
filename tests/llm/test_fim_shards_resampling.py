"""Fill-in-middle, sharding and resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestep.llm import fim, resampling, sharding

ODD = [
    "", None, "a", "\x01", "\x02", "\x01\x02\x02\x01ab\x020\x021 x", "<P>", "<P", "S>", "a<S>b", "x <M>", "\U0001f600é\n\r\n b", "x" * 200_000, "ab 1" * 50_000, "$0 \\ $1", " \x85",
    "word " * 30, "Zoë went HOME and " * 8,
]
SCHEMA = "doc_id long, text string, N string, Shard string, fim_text string, order_place int"


def odd_rows():
    rows = [(i, ODD[i % len(ODD)], "n", "s", "f", 1) for i in range(360)]
    return rows + [(None, "some text that has no id", "", "", "", 2)] * 3 + [(7, "again seven", None, None, None, None), (8, ODD[8], "n", "s", "f", 1)]


def key(i):
    return "" if i is None else str(i)


def plain_fim(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), hashlib.sha256(f"1:{key(i)}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, lo), (lo, hi), (hi, n)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, None, text
    return (n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def test_fim_equals_plain_cuts_and_is_undone(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    out = fim.transform(df)
    assert [c.lower() for c in out.columns] == ["doc_id", "text", "shard", "fim_text", "order_place", "n", "form", "prefix", "middle", "suffix", "output"]
    got = out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(odd_rows()) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix, r.middle, r.suffix, r.output) == plain_fim(r.doc_id, r.text), r.doc_id
        assert r.back == (r.text or "")
    assert fim.transform(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fim_stays_in_the_jvm(spark):
    plan = fim.transform(spark.createDataFrame(odd_rows()[:3], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and plan.count("regexp_replace") == 1


def plain_permuted(x, rows, seed):
    bits = max(1, math.ceil((max(rows - 1, 1)).bit_length() / 2))
    keys = [int(hashlib.sha256(f"{seed}:{r}".encode()).hexdigest()[:8], 16) for r in range(6)]
    while True:
        left, right = x >> bits, x % (1 << bits)
        for k in keys:
            m = right ^ k
            for _ in range(2):
                m = ((m >> 16) ^ m) * 0x45D9F3B % (1 << 32)
            left, right = right, left ^ (((m >> 16) ^ m) % (1 << bits))
        x = (left << bits) | right
        if x < rows:
            return x


@pytest.mark.parametrize("rows", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_permutation_is_one_to_one_and_turns_back(rows):
    numbers = np.arange(rows)
    got = sharding.permute(numbers, rows, 42)
    assert sorted(got) == list(range(rows)) and (sharding.permute(got, rows, 42, back=True) == numbers).all()
    assert [plain_permuted(x, rows, 42) for x in range(min(rows, 300))] == got[:300].tolist()


def test_permutation_of_large_numbers_and_of_none():
    rows = 10**15
    some = np.random.default_rng(1).integers(0, rows, 500)
    got = sharding.permute(some, rows, 9)
    assert (sharding.permute(got, rows, 9, back=True) == some).all() and [plain_permuted(int(x), rows, 9) for x in some[:50]] == got[:50].tolist()
    assert len(sharding.permute(np.zeros(0, np.int64), 0, 1)) == 0
    with pytest.raises(ValueError):
        sharding.permute(np.array([5]), 5, 1)


def test_layout_is_even_gapless_and_the_same_however_split(spark):
    rows = odd_rows()
    found = []
    for parts in (1, 7):
        got = sharding.layout(spark.createDataFrame(rows, SCHEMA).repartition(parts), 8, 42).collect()
        found.append(sorted(map(tuple, got), key=lambda r: (r[4], r[5])))
    assert found[0] == found[1] and len(found[0]) == len(rows)
    slots = {}
    for i, size, crc, law, shard, slot, grown in found[0]:
        slots.setdefault(shard, []).append(slot)
        assert law == "rows" and grown is None
    assert all(v == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    for row in (0, 1, 50, len(rows) - 1):
        at = plain_permuted(row, len(rows), 42)
        data = (order[row][1] or "").encode()
        assert (order[row][0], len(data) + 1, zlib.crc32(data), "rows", at % 8, at // 8, None) in found[0]
        assert sharding.row_at(at % 8, at // 8, 8, len(rows), 42) == row
    assert sharding.layout(spark.createDataFrame([], SCHEMA)).count() == 0


def test_written_shards_hold_whole_rows_in_slot_order(spark, tmp_path):
    rows = odd_rows()
    sharding.write_shards(spark.createDataFrame(rows, SCHEMA).repartition(5), f"file://{tmp_path}/out", 3, 1)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    got = back.collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((r[0] or -1, r[1] or "") for r in rows)
    for shard in range(3):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
        files = sorted((tmp_path / "out" / f"shard={shard}").glob("part-*"))
        import pyarrow.parquet as pq

        slots = [x for f in files for x in pq.ParquetFile(f).read(["slot"])["slot"].to_pylist()]
        assert slots == sorted(slots)


def plain_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))


def plain_buckets(text):
    w = plain_words(text)
    return [zlib.crc32(b" ".join(w[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_ring_gives_the_crc_of_every_run_over_borders_of_lists():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.choice([1, 2, 3, 4])
        found = [bytes(rng.choice(b"abcdefg\xc3\xa9") for _ in range(rng.choice([1, 2, 9, 62, 63, 64, 65, 200]))) for _ in range(rng.randrange(30))]
        ring, got, at = resampling.Ring(n), [[] for _ in range(n)], 0
        while at < len(found):
            step = rng.randrange(7)
            for g, o in zip(got, ring.extend(found[at : at + step])):
                g += o.tolist()
            at += step
        assert got == [[zlib.crc32(b" ".join(found[i : i + k])) for i in range(len(found) - k + 1)] for k in range(1, n + 1)]
    text = " ".join(f"Wörd{i % 321}-x" for i in range(5000)).encode()
    pieces = [len(b) for _, b in resampling.buckets(text, 3, 10_000)]
    assert [w for some in resampling.words(text, 1000) for w in some] == plain_words(text.decode()) and sum(pieces) == 3 * len(plain_words(text.decode())) - 3


def plain_resample(rows, target, percent=5, least=20):
    s, t = Counter(b for r in rows for b in plain_buckets(r[1])), Counter(b for x in target for b in plain_buckets(x))
    many, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (many + 10_000) / ((s[b] + 1) * (wanted + 10_000))))
    out = []
    for i, text, *_ in rows:
        found = plain_buckets(text)
        h = int(hashlib.sha256(f"42:{key(i)}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        out.append([i, len(plain_words(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


def test_resampling_equals_plain_counts_and_draws(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "it's", "x" * 90]
    rows = odd_rows() + [(1000 + i, " ".join(rng.choices(words, k=rng.randrange(60))), "", "", "", 0) for i in range(300)]
    target = [" ".join(rng.choices(words[:9], k=40)) for _ in range(20)] + [None, ""]
    docs, goal = spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(docs, goal, percent=10)
    want = plain_resample(rows, target, percent=10)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    drawn = resampling.draw(docs, goal, percent=10)
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == {r[0] for r in want if r[5] is not None and r[0] is not None}
    assert resampling.resample(spark.createDataFrame([], SCHEMA), goal).count() == 0
    none = resampling.resample(docs, spark.createDataFrame([], "text string")).collect()
    assert sorted((tuple(r) for r in none), key=str) == plain_resample(rows, [])


def test_rows_that_tie_are_no_one_tasks(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text in every row").alias("text")).repartition(6)
    got = sharding.layout(rows, 4, 3).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(4) for k in range(750)]
