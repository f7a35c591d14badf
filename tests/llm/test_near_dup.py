import random
import re

import pytest

from lodestep.llm import graph, near_dup


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(rows, size, percent):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for p, i in enumerate(ids):
        for j in ids[p + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    rows, base = [], [rng.choices(vocabulary, k=60) for _ in range(12)]
    for i in range(260):
        w = list(base[i % 12])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(60)] = rng.choice(vocabulary)
        rows.append((1000 - i, " ".join(w).upper() if i % 9 == 0 and "é" not in "".join(w) else "\n".join(w)))
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one two"), (2004, "ONE  two"), (2005, "one two three"), (2006, "x " * 30000), (2007, "x " * 400)]
    return rows


@pytest.mark.parametrize("small", [32, 1])
def test_matches_brute_force(spark, monkeypatch, small):
    """By pairs within small keys, and by the prefix filter alone."""
    monkeypatch.setattr(graph, "SMALL", small)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, node string, component int").repartition(3)
    for size in (4, 5) if small > 1 else (4,):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df, size, 80).collect()}
        assert got == brute(rows, size, 80)


def test_empty_table_nulls_and_repeats(spark):
    schema = "doc_id long, text string, key int"
    assert near_dup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f", 1), (3, "a b c d e f", 1), (3, "a b c d e f", 1), (7, "A b c d e f", None)]
    got = sorted(near_dup.near_duplicates(spark.createDataFrame(rows, schema)).collect(), key=lambda r: (r.doc_id or 0))
    assert [(r.doc_id, r.component_id, r.kept) for r in got] == [(None, None, True), (3, 3, True), (3, 3, True), (7, 3, False)]
    kept = near_dup.keep_one(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "key"] and kept.count() == 3
