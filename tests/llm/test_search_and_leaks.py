import hashlib
import math
import random
import re

import numpy as np
import pytest

from lodestep.llm import decontam, topk
from pyspark.sql import functions as F


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(docs, items, window):
    out = []
    windows = {}
    for i, text in items:
        w = words(text)
        if i is None or not w:
            continue
        size = min(window, len(w))
        for p in range(len(w) - size + 1):
            windows.setdefault(tuple(w[p : p + size]), set()).add(str(i))
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for p in range(len(w) - size + 1):
                if tuple(w[p : p + size]) in windows:
                    hit |= set(range(p, p + size))
                    found |= windows[tuple(w[p : p + size])]
        ids = sorted(found)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def test_overlaps_match_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = ["Aa", "bb", "çç", "d4", "ee", "f-g", "h", "日本"] + [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 8, 10, 25])))) for i in range(25)]
    items += [(None, "not an item of any kind"), (90, None), (91, "  --  "), (92, items[0][1]), (11, items[1][1])]
    docs = []
    for i in range(150):
        text = " ".join(rng.choices(vocabulary, k=rng.randrange(0, 80)))
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)[1] or ""
            text += rng.choice([" ", "\n", " ... "]) + w.upper() + " " + rng.choice(vocabulary)
        docs.append((i, text))
    docs += [(200, None), (201, ""), (202, docs[3][1]), (202, docs[3][1]), (None, items[4][1])]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0)
    for window in (10, 4):
        assert sorted(map(tuple, decontam.overlaps(d, b, window).collect()), key=key) == sorted(brute(docs, items, window), key=key)
    kept = decontam.remove_contaminated(d, b, 10)
    assert kept.columns == d.columns and kept.count() == sum(not r[5] for r in brute(docs, items, 10))
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.overlaps(d, none).where("contaminated").count() == 0 and decontam.overlaps(d, none).count() == len(docs)
    assert decontam.overlaps(spark.createDataFrame([], "doc_id long, text string"), b).count() == 0
    for m in decontam.matches(d.where("doc_id is not null and doc_id != 202"), b, 10).collect():
        w = words(dict(docs)[m.doc_id])[m.word_start : m.word_start + m.n_words]
        assert any(str(i) == m.item_id and words(t)[m.item_word_start : m.item_word_start + m.n_words] == w for i, t in items)


def test_suffix_array_across_shards(monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_WORDS", 50)
    rng = np.random.default_rng(1)
    h = rng.integers(1, 5, 400).astype(np.uint64)
    block = decontam._block([("a", h[95:118].copy()), ("b", h[10:14].copy())], 8)
    found = set()
    for at, which in decontam._occurrences(h, block, 8):
        found |= set(zip(at.tolist(), which.tolist()))
    want = set()
    for k in range(len(block.first)):
        w = block.hashes[block.first[k] : block.first[k] + block.length[k]]
        want |= {(p, k) for p in range(400 - len(w) + 1) if (h[p : p + len(w)] == w).all()}
    assert found == want


def exact(rows, k):
    v = [(i, [math.floor(64 * float(np.float32(x))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for n, (i, q) in enumerate(v):
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for m, (j, c) in enumerate(v) if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 0.02])
def test_topk_matches_brute_force(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(int(i), (rng.normal(size=6) * scale).tolist()) for i in range(400)]
    rows += [(1000, [0.0] * 6), (1001, None), (1020, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (1040, [float("inf")] * 6), (1060, [None] + [1.0] * 5), (None, [1.0] * 6), (7, [0.5] * 6), (1080, [1.0]), (1100, [])]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = sorted(map(tuple, topk.search(df, F.col("vec_id") % 20 == 0, 20, block_rows=90, query_rows=11).collect()))
    assert got == exact(rows, 20)
    small = df.where("vec_id in (0, 5)")
    assert topk.search(small, F.col("vec_id") % 20 == 0, 20).count() == 1
    assert topk.search(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_threshold_algorithm_stops_early():
    rng = np.random.default_rng(2)
    v = np.zeros((5000, 4), np.int64)
    v[:, 0] = rng.integers(0, 100_000, 5000)
    lists = topk.Lists(v, np.arange(5000), np.arange(5000))
    [(best, scores)], scored = lists.top(np.array([[3, 0, 0, 0]]), np.array([-1]), 20)
    assert scored[0] < 500 and scores[0] == 3 * v[:, 0].max()


def test_threshold_algorithm_stops_where_some_directions_lead():
    """Components of falling size, as of vectors turned to their principal axes: most queries read a part of the block, and lose nothing."""
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(8000, 4)) * 1000 * 0.3 ** np.arange(4)).astype(np.int64)
    lists = topk.Lists(v, np.arange(8000), np.arange(8000))
    found, scored = lists.top(v[:200], np.arange(200), 20)
    assert scored.mean() < 4000 and scored.min() < 1000
    for i, (best, scores) in enumerate(found):
        want = sorted((-int(s), j) for j, s in enumerate(v @ v[i]) if j != i)[:20]
        assert [(-int(s), int(j)) for j, s in zip(best, scores)] == want


def test_topk_is_exact_for_large_components(spark):
    rows = [(0, [1e7, 0.0]), (1, [1e7, 1.0]), (2, [5e6, 0.0]), (3, [3e18, 0.0]), (4, [-1e30, 2.0]), (5, [1e30, -2.0]), (20, [1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df, F.col("vec_id") % 20 == 0, 20, block_rows=3).collect()
    whole = {i: [int(x) * 64 if abs(x) >= 2**53 else math.floor(64 * x) for x in e] for i, e in rows}
    for q in (0, 20):
        want = sorted((-sum(a * b for a, b in zip(whole[q], c)), j) for j, c in whole.items() if j != q)
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[1] for m in mine] == [j for _, j in want]
        assert [m[2] for m in mine] == [min(max(-s, -(2**63)), 2**63 - 1) for s, _ in want]
    assert dict(((r.query_id, r.vec_id), r.score) for r in got)[0, 1] == 409600000000000000
