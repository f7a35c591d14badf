"""Distributed union-find and the search for links among rows that share keys.

Neither emits the pairs of a group: a key's members are compared with one hub each, components grow from the
links found, and only members whose components still differ are compared further.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestep.llm import _text
from lodestep.llm._shared import Scratch, forget_shuffles, partitions


#: The sketches of a key of so many members can all be compared: 256 for each member at most. What is larger is met by an exact prefix filter.
SMALL = 512
#: So many sets at most, about, are compared with their hub by one copy of the hub's set.
BESIDE_HUB = 256
#: So many keys a task packs at a time, and so many edges at most, about, it makes stars of.
PACKED, CONTRACTED = 1 << 19, 1 << 19
#: Columns of a set's odd sketch: 512 bits, each the parity of the set's items that fall on it.
SKETCH = [f"s{i}" for i in range(8)]
SKETCH_SCHEMA = ", ".join(f"{s} long" for s in SKETCH)


def odd_sketches(hashes: np.ndarray, offsets: np.ndarray, rows: int = 1024) -> list[pa.Array]:
    """The columns of ``SKETCH`` for each run of distinct ``hashes``: two sets differ in at least as many items as their sketches in bits."""
    bits = len(SKETCH) * 64
    out = np.zeros((len(offsets) - 1, len(SKETCH)), np.int64)
    for first in range(0, len(out), rows):
        last = min(first + rows, len(out))
        row = np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1]))
        at = (hashes[offsets[first] : offsets[last]] & np.uint64(bits - 1)).astype(np.int64)
        odd = np.bincount(row * bits + at, minlength=(last - first) * bits).astype(np.uint8) & 1
        out[first:last] = np.packbits(odd.reshape(last - first, bits), axis=1).view(np.int64)
    return [pa.array(np.ascontiguousarray(x)) for x in out.T]


#: Makes batches (node, size, keys), keys an array, of the batches of a table.
Keys = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def shared_keys(bands: DataFrame, keys_of: Keys | None = None) -> DataFrame:
    """The distinct rows (key, node, size) whose key another row has too, by one shuffle. Without a size it is 0; ``keys``, an array, may stand for a row for each key.

    With ``keys_of`` the rows are what it makes of ``bands``. They are moved many at a time, as one binary value for each bucket of keys; a task then
    sorts one bucket after the other, and holds 24 bytes for each row of it.
    """
    buckets = partitions(bands.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in keys_of(batches) if keys_of else batches:
            for first in range(0, batch.num_rows, 8192):
                some = batch.slice(first, 8192)
                count = some.column(2).value_lengths().to_numpy()
                own = [np.repeat(some.column(i).to_numpy(), count) for i in (0, 1)]
                held.append(np.stack([some.column(2).flatten().to_numpy(), *own], axis=1))
                n += len(held[-1])
                if n >= PACKED:
                    yield _packed(np.concatenate(held), buckets)
                    held, n = [], 0
        if n:
            yield _packed(np.concatenate(held), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now:
                    yield from _shared(held)
                    now, held = bucket, []
                held.append(np.frombuffer(block, np.int64).reshape(3, -1).T)
        yield from _shared(held)

    if not keys_of:
        keys = F.col("keys") if "keys" in bands.columns else F.array(F.col("key").cast("long"))
        size = F.col("size").cast("long") if "size" in bands.columns else F.lit(0).cast("long")
        bands = bands.select(F.col("node").cast("long").alias("node"), size.alias("size"), keys.alias("keys"))
    rows = bands.mapInArrow(pack, "bucket int, block binary")
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "key long, node long, size long")


def _packed(rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(bucket, block): the rows (key, node, size) of each bucket of keys."""
    bucket = _text.mix(rows[:, 0].view(np.uint64)) % np.uint64(4 * buckets)
    order = np.argsort(bucket.astype(np.uint16 if 4 * buckets <= 1 << 16 else np.uint32), kind="stable")
    rows, counts = rows[order], np.bincount(bucket.astype(np.int64), minlength=4 * buckets)
    some = np.flatnonzero(counts)
    ends = np.cumsum(counts[some])
    blocks = [rows[a:b].T.tobytes() for a, b in zip(ends - counts[some], ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "block"])


def _shared(held: list[np.ndarray], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Of one bucket's rows, those whose key another row has, each once."""
    if not held:
        return
    rows = np.concatenate(held)
    for distinct in (False, True):  # most keys are of one row: only the others are put in order whole
        rows = rows[np.lexsort(rows.T[::-1]) if distinct else np.argsort(rows[:, 0])]
        if distinct:
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
            rows = rows[new]
        same = rows[1:, 0] == rows[:-1, 0]
        shared = np.zeros(len(rows), bool)
        shared[1:] |= same
        shared[:-1] |= same
        rows = rows[shared]
    for first in range(0, len(rows), most):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in rows[first : first + most].T], names=["key", "node", "size"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's edges (u, v) as one star for each component that they make: (u, least node of it)."""
    ends = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate([np.concatenate(x) for x in zip(*ends, strict=True)]), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:  # roots hang themselves on their least neighbour, then every node on its root
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while ((up := label[label]) != label).any():
            label = up
    own = np.flatnonzero(label != np.arange(len(nodes)))
    for first in range(0, len(own), 1 << 16):
        some = own[first : first + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[label[some]])], names=["u", "v"])


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the component is the smallest node reachable.

    Tasks of ``CONTRACTED`` edges, about, make stars of their own edges. While there is more than one such task, large-star and small-star steps
    follow, each a grouped minimum and one join, until the edges no longer change; every step is written to the shared folder.
    Null ends and self-links are ignored. No edges: no rows.
    """
    state = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")
    ).distinct()
    state, before = scratch.write(state), None
    for _ in range(rounds):
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, parts = now, now[0] // CONTRACTED + 1
        state = scratch.write((state.coalesce(1) if parts == 1 else state.repartition(parts, "u")).mapInArrow(_stars, "u long, v long"))
        if parts == 1:
            break
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A table of its own: then the join has two exchanges and Spark can split a hub's rows over tasks.
        least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        state = scratch.write(small.union(small_min.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def grown(labels: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` (node, component), as ``components`` gives them, after the links ``edges`` (a, b) as well: only components that these touch are worked on."""
    named = edges
    for end in ("a", "b"):
        own = labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
        named = named.join(own, end, "left").withColumn(f"{end}_component", F.coalesce(f"{end}_component", end))
    moved = scratch.write(components(named.select(F.col("a_component").alias("a"), F.col("b_component").alias("b")), scratch))
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("least"))
    old = labels.join(to, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    return scratch.write(old.union(moved.join(labels, "node", "left_anti")))


def _hub_pairs(members: DataFrame, away: bool, scratch: Scratch) -> DataFrame:
    """Each member of a key with the key's hub; pairs known to share a component are left out.

    The hub is the heaviest member, or, with ``away``, the heaviest outside that one's component.
    """
    most = lambda c: F.max_by(c, "weight").alias(f"hub_{c}")
    able = members
    if away:
        main = scratch.write(members.groupBy("key").agg(F.max_by("component", "weight").alias("main")))
        able = members.join(main, "key").where("component != main")
    hub = scratch.write(able.groupBy("key").agg(most("node"), most("size"), most("component")))
    return members.join(hub, "key").where("component != hub_component").select(
        F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b"), "size", "hub_size"
    )


def array_links(percent: int) -> Callable[[DataFrame], DataFrame]:
    """Of pairs (a, b, x, y) with sets x and y as arrays without repeats, those whose Jaccard similarity is ``percent`` / 100 or more."""

    def verify(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("x", "y")).cast("long")
        return pairs.where(100 * both >= percent * (F.size("x").cast("long") + F.size("y").cast("long") - both)).select("a", "b")

    return verify


def differences(sets: Callable[[pa.Array], Iterator[np.ndarray]]) -> Callable[[DataFrame], DataFrame]:
    """Of rows of sets beside their hub's, the items in which each differs from the hub's set, with the number of these (``apart``) and the size of that set (``hub_n``).

    Rows are (hub, part, place, node, own, component, hub_component, n, items). In each (hub, part) the row of ``place`` 0 holds the
    hub's set, the others the sets to compare with it. ``sets`` makes sets of hashes without repeats of a column of ``items``. A set that equals the hub's gives no row.
    """
    kept = ["hub", "node", "own", "component", "hub_component", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, 128):
                some = batch.slice(first, 128)
                out, beside, size = [], [], 0
                for i, (own, place) in enumerate(zip(sets(some.column("items")), some.column("place").to_pylist(), strict=True)):
                    if place:
                        out.append(np.setxor1d(own.view(np.int64), centre, assume_unique=True))
                        beside.append((i, len(centre)))
                        size += len(out[-1])
                    else:
                        centre = own.view(np.int64)
                    if out and (size >= 1 << 17 or i == some.num_rows - 1):
                        row, hub_n = np.array(beside).T
                        apart = np.array([len(x) for x in out])
                        at = pa.array(np.repeat(row, apart))
                        yield pa.RecordBatch.from_arrays(
                            [*(some.column(c).take(at) for c in kept), *(pa.array(np.repeat(x, apart), pa.int64()) for x in (apart, hub_n)), pa.array(np.concatenate(out))],
                            names=[*kept, "apart", "hub_n", "item"],
                        )
                        out, beside, size = [], [], 0

    schema = ", ".join(f"{c} long" for c in [*kept, "apart", "hub_n", "item"])
    return lambda rows: rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "place").mapInArrow(run, schema)


def _array_sets(column: pa.Array) -> Iterator[np.ndarray]:
    values, ends = column.flatten().to_numpy(), np.cumsum([0, *column.value_lengths().to_pylist()])
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield values[a:b]


#: ``differences`` of sets that are arrays of long.
array_items = differences(_array_sets)


class Links:
    """Finds the components of the graph whose links are the similar pairs of nodes, from candidates that share a key.

    Two nodes are linked when the Jaccard similarity of their whole sets is at least ``percent`` / 100. ``sets_of``
    takes nodes (node) and returns a written table (node, items, n, the columns of ``SKETCH``), one row or more each, which is read many times; ``verify`` keeps the linked ones of
    pairs (a, b, x, y) with the items of both; ``items_of`` takes sets apart as ``differences`` says. ``fits`` is a cheap
    necessary condition on the columns ``size`` and ``hub_size`` of the bands.
    """

    def __init__(
        self,
        sets_of: Callable[[DataFrame], DataFrame],
        percent: int,
        fits: Column,
        scratch: Scratch,
        verify: Callable[[DataFrame], DataFrame] | None = None,
        items_of: Callable[[DataFrame], DataFrame] = array_items,
    ):
        self.sets_of, self.percent, self.fits, self.scratch = sets_of, percent, fits, scratch
        self.verify, self.items_of = verify or array_links(percent), items_of
        self.sets: DataFrame | None = None

    def components(self, bands: DataFrame, keys_of: Keys | None = None) -> DataFrame | None:
        """(node, component) of the nodes that have links, from (key or keys, node) and, for ``fits``, size, or what ``keys_of`` makes of ``bands``; None without any.

        First every key's members meet the key's heaviest node, then the heaviest that is not in its component, and components grow from
        the links. A node weighs what its keys hold: in a group of edited copies the text that they were made from shares keys with most
        of them and is linked with most, so few of the group are left for the steps below.
        Keys of two members need no hub. Keys whose members are in one component are done, and so are keys of
        three after the second round: all their pairs have met. Of the other keys, those of at most ``SMALL`` members have all
        their pairs of different components met; the members of the larger ones meet by an exact prefix filter (see
        ``_rest``), so no link that could join two components is lost to the choice of hubs.
        """
        members = self.scratch.write(shared_keys(bands, keys_of))
        forget_shuffles(bands.sparkSession)
        self.sets = self.sets_of(members.select("node").distinct())
        forget_shuffles(bands.sparkSession)
        held = self.scratch.write(members.groupBy("key").agg(
            F.count("*").alias("held"), F.min("node").alias("a"), F.max("node").alias("b"),
            F.min_by("size", "node").alias("size"), F.max_by("size", "node").alias("hub_size"),
        ))
        live = self.scratch.write(self._weighed(members, held.where("held > 2").select("key", "held")))
        labels = None
        for turn in range(3):
            if labels is not None:
                live = live.drop("component").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
            if turn:
                mixed = live.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
                mixed = mixed.where((F.col("lo") != F.col("hi")) & (F.col("n") > turn + 1)).select("key")
                live = self.scratch.write(live.join(mixed, "key", "left_semi"))
                if live.isEmpty():
                    break
            if turn < 2:
                pairs = _hub_pairs(live, bool(turn), self.scratch)
                if not turn:
                    pairs = pairs.union(held.where("held = 2").select("a", "b", "size", "hub_size"))
                pairs = pairs.where(self.fits & (F.col("a") != F.col("b"))).select("a", "b")
            else:
                pairs = self._small_keys(live).union(self._rest(live))
            found = self.scratch.write(self._verified(pairs, sketched=turn == 2))
            if not found.isEmpty():
                labels = components(found, self.scratch) if labels is None else grown(labels, found, self.scratch)
            forget_shuffles(bands.sparkSession)
        return labels

    def _weighed(self, members: DataFrame, held: DataFrame) -> DataFrame:
        """``members`` of the keys in ``held``, each a component of its own, with a weight: the members of all these keys of the node, then a hash, so that equal ones have an order."""
        some = self.scratch.write(members.join(held, "key"))
        weights = some.groupBy("node").agg(F.sum("held").alias("all_held"))
        weight = F.expr("65536 * all_held + pmod(xxhash64(node), 65536)").alias("weight")
        return some.join(weights, "node").select("key", "node", "size", F.col("node").alias("component"), weight)

    def _sketches(self, name: str) -> DataFrame:
        """``name`` for the node, with the size and the sketch of its sets under names that begin with it."""
        return self.sets.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", *SKETCH)])

    def _possible(self, x: str, y: str) -> Column:
        """Whether sizes and sketches leave it open that two sets are similar: they differ in as many items as their sketches in bits, or more."""
        n, m = F.col(f"{x}_n").cast("long"), F.col(f"{y}_n").cast("long")
        apart = sum((F.bit_count(F.col(f"{x}_{s}").bitwiseXOR(F.col(f"{y}_{s}"))) for s in SKETCH[1:]), F.bit_count(F.col(f"{x}_{SKETCH[0]}").bitwiseXOR(F.col(f"{y}_{SKETCH[0]}"))))
        fits = 100 * F.least(n, m) >= self.percent * F.greatest(n, m)
        return fits & ((100 + self.percent) * apart.cast("long") <= (100 - self.percent) * (n + m))

    def _verified(self, pairs: DataFrame, sketched: bool) -> DataFrame:
        """The linked ones of ``pairs`` (a, b); ``sketched``: their sketches have been compared."""
        pairs = pairs.distinct()
        if not sketched:
            near = pairs.join(self._sketches("a"), "a").join(self._sketches("b"), "b").where(self._possible("a", "b"))
            pairs = near.select("a", "b").distinct()
        pairs = self.scratch.write(pairs)
        left = self.sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
        right = self.sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
        return self.verify(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"))

    def _small_keys(self, live: DataFrame) -> DataFrame:
        """Pairs of different components within keys of at most ``SMALL`` members, as far as sketches leave them open."""
        few = self.scratch.write(live.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") <= SMALL).select("key"))
        some = live.join(few, "key", "left_semi").select("key", F.col("node").alias("a"), "component")
        left = self.scratch.write(some.join(self._sketches("a"), "a"))
        right = left.select("key", F.col("component").alias("other_component"), *[F.col(f"a{c}").alias(f"b{c}") for c in ("", "_n", *(f"_{s}" for s in SKETCH))])
        meet = left.join(right, "key").where((F.col("component") != F.col("other_component")) & (F.col("a") < F.col("b")) & self._possible("a", "b"))
        return meet.select("a", "b").distinct()

    def _rest(self, live: DataFrame) -> DataFrame:
        """Of the members of keys of more than ``SMALL``: pairs of different components that may be similar, none left out, by a prefix filter on differences.

        All members of a key are held against its hub h as d = set xor h's set, which is short for edited copies however long they are. Two
        sets x and y have |x xor y| = |dx| + |dy| - 2 |dx and dy|, and are similar when that is at most q (|x| + |y|), q = (100 - percent) / (100 + percent).
        A set is near when it is similar to h's, else far. Two near ones are linked through h. If x is far, |dx| > q (|x| + |h|), and as |y| <= |h| + |dy|,
        similar y must share a difference with it: 2 |dx and dy| > |dy| + q (|h| - |y|). So, in any order of differences that holds for all of a hub's sets, a similar pair meets in
        the first |dy| - floor((|dy| + q (|h| - |y|)) / 2) of y (``short``), about half of it. For a far x with a near y, |dx and dy| <= |dy| gives
        |dx and dy| >= |dx| - |x| (100 - percent) / percent, and the prefix of x that follows (``long``), which also holds for any other pair. Differences
        that could meet nobody come first in the order, then those with the fewest pairs to weigh; at the first one that a pair shares enough must follow in both.
        """
        p, no = self.percent, F.lit(0).cast("long")
        many = live.groupBy("key").agg(F.count("*").alias("n"), F.max_by("node", "weight").alias("hub"), F.max_by("component", "weight").alias("hub_component"))
        many = self.scratch.write(many.where(F.col("n") > SMALL).drop("n"))
        if many.isEmpty():
            return many.select(F.col("hub").alias("a"), F.col("hub").alias("b"))
        units = live.join(many, "key").where("node != hub").groupBy("hub", "node").agg(F.min("component").alias("component"), F.min("hub_component").alias("hub_component"))
        units = self.scratch.write(units)
        parts = units.groupBy("hub").agg((F.count("*") / BESIDE_HUB + 1).cast("long").alias("parts"))
        sets = self.sets.select("node", F.xxhash64("items").alias("own"), F.col("n").cast("long").alias("n"), "items")
        columns = ["hub", "part", "place", "node", "own", "component", "hub_component", "n", "items"]
        beside = units.join(parts, "hub").withColumn("part", F.expr("pmod(xxhash64(node), parts)")).join(sets, "node").withColumn("place", F.lit(1))
        hubs = parts.join(sets.withColumnRenamed("node", "hub").groupBy("hub").agg(F.min("items").alias("items")), "hub")  # one set of it
        hubs = hubs.withColumn("part", F.explode(F.sequence(no, F.col("parts") - 1))).withColumn("place", F.lit(0))
        hubs = hubs.withColumns({c: no for c in columns if c not in hubs.columns})
        diffs = self.items_of(hubs.select(*columns).union(beside.select(*columns)))
        diffs = self.scratch.write(diffs.withColumn("far", F.expr(f"{100 + p} * apart > {100 - p} * (n + hub_n)")))
        counts = diffs.groupBy("hub", "item").agg(
            (F.count_if("far") * (F.count("*") - 1)).alias("meetings"), F.min("component").alias("lo"), F.max("component").alias("hi"),
        ).where("meetings > 0 and lo != hi").select("hub", "item", "meetings")
        one = Window.partitionBy("hub", "node", "own")
        heads = diffs.join(counts, ["hub", "item"]).withColumn(
            "place", F.col("apart") - F.count("*").over(one) + F.row_number().over(one.orderBy("meetings", "item"))
        ).withColumn("long", F.expr(f"least(apart, {100 - p} * n div {p} + 1)")).withColumn(
            "short", F.expr(f"place <= apart - ({100 + p} * apart + {100 - p} * (hub_n - n)) div {2 * (100 + p)}")
        ).where("place <= long and (far or short)")
        sketches = self.sets.select("node", F.xxhash64("items").alias("own"), *[F.col(s).alias(f"a_{s}") for s in SKETCH])
        heads = heads.join(sketches, ["node", "own"]).withColumnsRenamed({"node": "a", "n": "a_n"})
        heads = self.scratch.write(heads.select("hub", "item", "component", "far", "short", "place", "apart", "a", "a_n", *[f"a_{s}" for s in SKETCH]))
        others = heads.where("far").select(
            "hub", "item", *[F.col(c).alias(f"other_{c}") for c in ("component", "short", "place", "apart")], *[F.col(f"a{c}").alias(f"b{c}") for c in ("", "_n", *(f"_{s}" for s in SKETCH))]
        )
        needed = F.expr(f"(apart + other_apart - {100 - p} * (a_n + b_n) div {100 + p} + 1) div 2")
        meet = heads.join(others, ["hub", "item"]).where(
            F.expr("component != other_component and (not far or a < b and short and other_short)")
            & (F.least(F.expr("apart - place"), F.expr("other_apart - other_place")) + 1 >= needed)
            & self._possible("a", "b")
        )
        # A node of several sets may have met its hub with another one of them.
        through = diffs.where("not far and component != hub_component").select(F.col("node").alias("a"), F.col("hub").alias("b"))
        return meet.select("a", "b").union(through).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
