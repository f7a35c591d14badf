"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Documents are numbered from 0 in the order of their ids, whatever the files they lie in. A Feistel network over the least even number of bits
that holds all numbers permutes them; a result beyond the table goes through the network again until it is within. Shard and slot
are the remainder and the quotient of the permuted number, so they follow from the row number, the count and the seed alone, in
both directions, and shards differ by one row at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestep.llm._order import numbered
from lodestep.llm._shared import Scratch, fresh

#: A 32-bit finaliser's multiplier; below 2**27, so products of 32-bit numbers stay below 2**63 on every engine.
MIX = 0x45D9F3B
LOW = (1 << 32) - 1


def half_bits(rows: int) -> int:
    """Bits of each half of the network: the least k with 4**k >= rows."""
    return max(1, -(-max(rows - 1, 1).bit_length() // 2))


def round_keys(seed: int, rounds: int = 6) -> list[int]:
    """The first 32 bits of the sha256 of ``seed:round``."""
    return [int(hashlib.sha256(f"{seed}:{r}".encode()).hexdigest()[:8], 16) for r in range(rounds)]


def _mixed(half: np.ndarray, key: int, bits: int) -> np.ndarray:
    x = half ^ key
    for _ in range(2):
        x = ((x >> 16) ^ x) * MIX & LOW
    return ((x >> 16) ^ x) & ((1 << bits) - 1)


def _once(x: np.ndarray, keys: list[int], bits: int, back: bool) -> np.ndarray:
    left, right = x >> bits, x & ((1 << bits) - 1)
    for key in reversed(keys) if back else keys:
        left, right = (right ^ _mixed(left, key, bits), left) if back else (right, left ^ _mixed(right, key, bits))
    return left << bits | right


def permute(numbers: np.ndarray, rows: int, seed: int, back: bool = False) -> np.ndarray:
    """The permuted numbers, each below ``rows`` as the given ones are; with ``back``, the numbers that they came from.

    A walk ends, as it goes round a cycle that holds the number it began with; the network has less than four times as many
    numbers as there are rows (four at least), so it takes under four turns in the mean. Up to 2**62 rows.
    """
    x = np.array(numbers, np.int64)
    if len(x) and not (0 <= x.min() and x.max() < rows <= 1 << 62):
        raise ValueError(f"numbers must be from 0 to {rows - 1}")
    keys, bits = round_keys(seed), half_bits(rows)
    x = _once(x, keys, bits, back)
    while len(beyond := np.flatnonzero(x >= rows)):
        x[beyond] = _once(x[beyond], keys, bits, back)
    return x


def row_at(shard: int, slot: int, shards: int, rows: int, seed: int) -> int:
    """The row number that stands at a slot of a shard, without the table."""
    return int(permute(np.array([slot * shards + shard]), rows, seed, back=True)[0])


def assign(docs: DataFrame, scratch: Scratch, shards: int = 8, seed: int = 42) -> DataFrame:
    """``docs`` with row, shard and slot (in place of columns of these names): slots of a shard are gapless from 0, and counts differ by one at most.

    Rows are numbered by doc_id as a 64-bit number, a null one first, then by the sha256 of their text; rows equal in both are in any
    order, which changes no (doc_id, text, shard, slot). An empty table gives no rows. ``text`` itself is only shuffled if ``docs`` still holds it.
    """
    kept = [c for c in docs.columns if c.lower() not in ("row", "shard", "slot")]
    source = docs.select(*[f"`{c}`" for c in kept])
    digest, row = fresh(source, "shard_digest", "shard_row")
    whole = source.withColumn(digest, F.sha2(F.col("text").cast("binary"), 256)) if "text" in kept else source.withColumnRenamed("text_digest", digest)
    order = [F.asc_nulls_first(F.col("doc_id").cast("long")), F.asc_nulls_first(digest)]
    numbers = numbered(whole, order, scratch, row).drop(digest)
    rows = numbers.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            at = permute(table[row].to_numpy(), rows, seed)
            table = table.append_column("shard", pa.array((at % shards).astype(np.int32))).append_column("slot", pa.array(at // shards))
            yield from table.to_batches()

    schema = numbers.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).schema
    return numbers.mapInArrow(run, schema).withColumnRenamed(row, "row")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, text_digest): UTF-8 bytes of the text plus 1 and its unsigned crc32; null is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("text_digest"),
    )


def layout(docs: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law (``rows``), shard, slot and grown_shard (null: another count of shards deals all anew).

    Only ids and digests are shuffled, never texts. Odd cases as in ``assign``; a null text has size 1.
    """
    with Scratch(docs.sparkSession) as scratch:
        placed = assign(sizes(docs), scratch, shards, seed)
        return placed.select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
        ).checkpoint()


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 42) -> None:
    """Writes ``docs`` as Parquet under ``path``, a folder shard=<n> for each shard, with row and slot; the files of a shard are in slot order by name.

    Odd cases as in ``assign``. Whole rows are shuffled twice: into the order of the numbers and into that of the shards.
    """
    with Scratch(docs.sparkSession) as scratch:
        placed = assign(docs, scratch, shards, seed)
        placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
