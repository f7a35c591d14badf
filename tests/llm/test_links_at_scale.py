import random

import numpy as np
from pyspark.sql import functions as F

from lodestep.llm import graph
from lodestep.llm._shared import Scratch


def test_sketches_differ_in_no_more_bits_than_sets_in_items():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, k)) for k in (1, 3, 50, 400, 900, 3000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.choice(pool, 20)])) for s in sets]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sketch = np.stack([c.to_numpy() for c in graph.odd_sketches(np.concatenate(sets), offsets, rows=5)], axis=1).view(np.uint64)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            apart = int(np.bitwise_count(sketch[i] ^ sketch[j]).sum())
            assert apart <= len(np.setxor1d(x, y)) and (apart - len(x) - len(y)) % 2 == 0


def test_shared_keys_are_those_of_two_distinct_rows(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(300), rng.randrange(40), 5) for _ in range(500)] + [(1000, i, i) for i in range(4000)] + [(2000, 7, 5)] * 3
    rows += [(-5, 1, 1), (-5, 1, 1), (-6, 1, 1), (-6, 2, 1)]
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(map(tuple, graph.shared_keys(spark.createDataFrame(rows, "key long, node long, size long").repartition(4)).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert got == sorted(r for r in set(rows) if len({q for q in set(rows) if q[0] == r[0]}) > 1)


def test_a_group_of_edited_copies_gives_few_candidates(spark, monkeypatch):
    """400 copies of one set with edits of their own beyond the threshold, and three pairs of them that are alike: before, shared items gave thousands of candidates."""
    rng = random.Random(9)
    base = [rng.getrandbits(62) for _ in range(300)]
    sets = []
    for _ in range(400):
        own = set(rng.sample(base, 262)) | {rng.getrandbits(62) for _ in range(38)}
        sets.append(own)
    alike = [(10, 200), (11, 201), (12, 202)]
    for a, b in alike:
        sets[b] = set(sorted(sets[a])[5:]) | {rng.getrandbits(62) for _ in range(5)}
    items = np.concatenate([np.array(sorted(s), np.uint64) for s in sets])
    columns = graph.odd_sketches(items, np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    sketches = np.stack([c.to_numpy() for c in columns], axis=1)
    rows = [(i, sorted(s), len(s), *map(int, k)) for i, (s, k) in enumerate(zip(sets, sketches, strict=True))]
    table = spark.createDataFrame(rows, f"node long, items array<long>, n int, {graph.SKETCH_SCHEMA}")
    pairs, items_made = [], []
    rest, of = graph.Links._rest, graph.array_items
    monkeypatch.setattr(graph.Links, "_rest", lambda self, live: pairs.append((made := self.scratch.write(rest(self, live))).count()) or made)
    counted = lambda sets: items_made.append((made := of(sets)).count()) or made
    with Scratch(spark) as scratch:
        links = graph.Links(lambda nodes: table.join(nodes, "node", "left_semi"), 80, F.lit(True), scratch, items_of=counted)
        found = links.components(spark.createDataFrame([(1, i) for i in range(400)], "key long, node long"))
        assert sorted(map(tuple, found.where("node != component").collect())) == sorted((b, a) for a, b in alike)
    assert sum(pairs) < 200 and sum(items_made) < 300 * 400 * 2 // 3


def _table(spark, sets):
    """(node, items, n, sketch) of sets by node; a node may have several."""
    offsets = np.concatenate([[0], np.cumsum([len(s) for _, s in sets])])
    columns = graph.odd_sketches(np.concatenate([np.array(sorted(s), np.uint64) for _, s in sets]), offsets)
    sketches = np.stack([c.to_numpy() for c in columns], axis=1)
    rows = [(i, sorted(s), len(s), *map(int, k)) for (i, s), k in zip(sets, sketches, strict=True)]
    return spark.createDataFrame(rows, f"node long, items array<long>, n int, {graph.SKETCH_SCHEMA}")


def test_differences_to_hubs_lose_no_link(spark, monkeypatch):
    """Two groups of copies with edits of their own, half of them beyond the threshold, in keys of one and of both, against brute force."""
    rng = random.Random(4)
    base = [rng.getrandbits(62) for _ in range(120)]
    sets = []
    for i in range(240):
        k = rng.choice((2, 6, 12, 14, 16, 20, 40))
        shared = base if i < 160 else [*base[:90], *range(1000, 1030)]
        sets.append((i, set(rng.sample(shared, len(shared) - k)) | {rng.getrandbits(62) for _ in range(k)}))
    for a, b in ((3, 90), (7, 91), (170, 230)):  # alike beyond the hub
        sets[b] = (b, set(sorted(sets[a][1])[4:]) | {rng.getrandbits(62) for _ in range(4)})
    sets.append((5, set(base[:60])))  # a second set of one node
    monkeypatch.setattr(graph, "SMALL", 2)
    monkeypatch.setattr(graph, "BESIDE_HUB", 16)
    keys = [(k, i) for i, _ in sets for k in ((1,) if i < 160 else (1, 2))]
    with Scratch(spark) as scratch:
        table = _table(spark, sets)
        links = graph.Links(lambda nodes: table.join(nodes, "node", "left_semi"), 80, F.lit(True), scratch)
        got = {r.node: r.component for r in links.components(spark.createDataFrame(keys, "key long, node long")).collect()}
    root = {i: i for i, _ in sets}
    for i, x in sets:
        for j, y in sets:
            if i < j and 5 * len(x & y) >= 4 * len(x | y) and root[i] != root[j]:
                least, most = sorted((root[i], root[j]))
                root = {n: least if r == most else r for n, r in root.items()}
    assert {i: got.get(i, i) for i in root} == root


def test_near_copies_give_few_first_items(spark, monkeypatch):
    """300 copies with few edits and 20 with many in one key: before, each gave up to a fifth of its items to be met, now half of what it differs in."""
    rng = random.Random(5)
    base = [rng.getrandbits(62) for _ in range(150)]
    sets = []
    for i in range(320):
        k = rng.randrange(3, 12) if i < 300 else rng.randrange(30, 40)
        sets.append((i, set(rng.sample(base, 150 - k)) | {rng.getrandbits(62) for _ in range(k)}))
    monkeypatch.setattr(graph, "SMALL", 2)
    heads, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df: (made := write(self, df), heads.append(made.count() if {"item", "place"} <= set(df.columns) else 0))[0])
    with Scratch(spark) as scratch:
        table = _table(spark, sets)
        links = graph.Links(lambda nodes: table.join(nodes, "node", "left_semi"), 80, F.lit(True), scratch)
        links.components(spark.createDataFrame([(1, i) for i, _ in sets], "key long, node long"))
    assert 0 < sum(heads) < 3600


def test_links_that_no_hub_shows_are_found_by_their_differences(spark, monkeypatch):
    """Chains far from every hub, in one key, found by the filter alone, whatever the threshold."""
    monkeypatch.setattr(graph, "SMALL", 2)
    rng = random.Random(6)
    for percent in (50, 80):
        sets = [(0, set(range(200)))]
        for i in range(1, 60):
            if i % 6 == 1:
                now = set(rng.sample(range(200), 90)) | {rng.getrandbits(60) for _ in range(rng.randrange(5, 60))}
            else:
                gone = rng.sample(sorted(now), len(now) * (100 - percent) // (rng.choice((150, 210, 260))))
                now = (now - set(gone)) | {rng.getrandbits(60) for _ in range(len(gone) // 2)}
            sets.append((i, now))
        with Scratch(spark) as scratch:
            table = _table(spark, sets)
            links = graph.Links(lambda nodes: table.join(nodes, "node", "left_semi"), percent, F.lit(True), scratch)
            live = spark.createDataFrame([(9, i, 0, i, 1000 - i) for i, _ in sets], "key long, node long, size long, component long, weight long")
            links.sets = scratch.write(table)
            got = {tuple(r) for r in links._rest(live).collect()}
        alike = {(i, j) for i, x in sets for j, y in sets if 0 < i < j and 100 * len(x & y) >= percent * len(x | y)}
        assert len(alike) > 20 and not alike - got


def test_components_of_few_and_of_many_tasks_are_those_of_union_find(spark, monkeypatch):
    """Stars made in one task end the search; in many, rounds follow. Before, every size took all rounds."""
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 90)] + [(rng.randrange(200, 500), rng.randrange(200, 500)) for _ in range(160)] + [(7, 7), (None, 3), (-5, 600)]
    least = {}
    for a, b in edges:
        if a is not None and a != b:
            for x in (a, b):
                least.setdefault(x, x)
    while True:
        before = dict(least)
        for a, b in edges:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    written, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df: written.append(1) or write(self, df))
    for size in (1 << 19, 40):
        monkeypatch.setattr(graph, "CONTRACTED", size)
        with Scratch(spark) as scratch:
            got = [tuple(r) for r in graph.components(df, scratch).collect()]
        assert sorted(got) == sorted(least.items())
        if size > 40:
            assert len(written) == 2
        else:
            assert len(written) > 4


def test_keys_are_moved_many_to_a_row(spark):
    """A task's 40,000 keys are as many rows as there are buckets; before, each key was one. Arrays of keys give what rows of keys give."""
    rng = np.random.default_rng(2)
    rows = np.stack([rng.integers(-(2**63), 2**63, 40_000), np.arange(40_000) % 2000, np.full(40_000, 3)], axis=1)
    packed = graph._packed(rows, 4)
    assert packed.num_rows <= 16
    back = np.concatenate([np.frombuffer(x, np.int64).reshape(3, -1).T for x in packed.column(1).to_pylist()])
    assert sorted(map(tuple, back.tolist())) == sorted(map(tuple, rows.tolist()))
    keyed = spark.createDataFrame([(1, [5, 6, 7], 3), (2, [5, 8], 3), (3, [], 1), (4, [9, 9], 2), (5, [7], 4)], "node long, keys array<long>, size long").repartition(3)
    assert sorted(map(tuple, graph.shared_keys(keyed).collect())) == [(5, 1, 3), (5, 2, 3), (7, 1, 3), (7, 5, 4)]
