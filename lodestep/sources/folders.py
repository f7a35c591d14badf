"""Reading until a quota is met, rewriting in place, one JSON array file, and folders of result files of unlike shape.

Files are listed, renamed and joined through Hadoop's file system, so any store works; rows are read and written by tasks.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


#: What ways of writing one path differ in: its scheme and the slashes after it.
BARE = "^([a-z0-9]+:)?/*"


def _bare(path: str) -> str:
    return re.sub(BARE, "", path)


class Scan(NamedTuple):
    """Rows that passed, and what was read for them."""

    rows: DataFrame
    files_read: int
    files: int
    scanned: int
    passed: int


def scan_until(spark: SparkSession, path: str, keep: Column, limit: int, max_scan: int | None = None, first_files: int = 1) -> Scan:
    """The first ``limit`` rows of the Parquet files at ``path`` for which ``keep`` holds, in the order of file names and rows, of the first ``max_scan`` rows.

    Files are read in turns, each with twice as many as the one before, and only counts come back; it stops when the quota is met or enough
    rows are scanned, so files behind that are never opened but for their footers' schema. Fewer rows come back where the files hold no more. A null
    condition does not hold.
    """
    whole = spark.read.parquet(path)
    files, schema = sorted(whole.inputFiles()), whole.schema
    reader = lambda some: (spark.read.schema(schema) if [_bare(path)] == [_bare(f) for f in files] else spark.read.schema(schema).option("basePath", path)).parquet(*some)
    most = float("inf") if max_scan is None else max_scan
    used: list[tuple[str, int]] = []  # file, rows before it
    scanned = passed = at = 0
    many = max(1, first_files)
    while at < len(files) and passed < limit and scanned < most:
        turn = files[at : at + many]
        name = F.col("_metadata.file_path")
        counted = reader(turn).select(name.alias("f"), F.coalesce(keep, F.lit(False)).alias("k"))
        counts = {r["f"]: (r["n"], r["k"]) for r in counted.groupBy("f").agg(F.count("*").alias("n"), F.count_if("k").alias("k")).collect()}  # a row a file
        by_name = {_bare(f): n for f, n in counts.items()}
        for f in turn:
            if passed >= limit or scanned >= most:
                break
            n, k = by_name.get(_bare(f), (0, 0))
            used.append((f, scanned))
            scanned, passed = scanned + n, passed + k
        at, many = at + len(turn), many * 2
    names = [f.name for f in schema.fields]
    if not used:
        return Scan(spark.createDataFrame([], schema), at, len(files), 0, 0)
    rows = reader([f for f, _ in used])
    before = spark.createDataFrame([(_bare(f), n) for f, n in used], "_file string, _before long")
    file = F.regexp_replace("_metadata.file_path", BARE, "")
    placed = rows.select("*", file.alias("_file"), F.col("_metadata.row_index").alias("_row")).join(F.broadcast(before), "_file")  # a row a file
    placed = placed.withColumn("_place", F.col("_before") + F.col("_row"))
    held = placed.where(F.coalesce(keep, F.lit(False))).where(F.lit(True) if max_scan is None else F.col("_place") < max_scan)
    return Scan(held.orderBy("_place").limit(limit).select(*names), at, len(files), int(min(scanned, most)), passed)


def rewrite(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], kind: str = "parquet", same_count: bool = True) -> int:
    """Replaces the table at ``path`` by ``change`` of it and returns its rows.

    The new rows are written beside it and counted before anything is touched; with ``same_count`` another number of rows is an error. Then the old
    folder is renamed away, the new one into its place, and the old one deleted; where a step fails the old one is put back and what was
    written is removed, so a reader finds the old or the new table whole.
    """
    store, at = _store(spark, path)
    mark = uuid.uuid4().hex
    new, old = _path(spark, f"{path.rstrip('/')}.new-{mark}"), _path(spark, f"{path.rstrip('/')}.old-{mark}")
    moved = False
    try:
        before = spark.read.format(kind).load(path)
        change(before).write.format(kind).save(new.toString())
        rows = spark.read.format(kind).load(new.toString()).count()
        if same_count and rows != before.count():
            raise ValueError(f"{rows} rows were written for {before.count()}")
        if not store.rename(at, old):
            raise OSError(f"{path} cannot be renamed")
        moved = True
        if not store.rename(new, at):
            raise OSError(f"{new.toString()} cannot be renamed")
    except BaseException:
        if moved and not store.exists(at):
            store.rename(old, at)
        store.delete(new, True)
        raise
    store.delete(old, True)
    spark.catalog.refreshByPath(path)
    return rows


def write_array(df: DataFrame, path: str) -> None:
    """Writes ``df`` as one JSON array file at ``path``, an object a line, nulls kept; no row passes through the driver's memory.

    Tasks write part files whose lines end with commas; the commit joins them in order, as streams, between brackets, under another name, and
    renames that to ``path`` when it is whole, over a file that was there. An empty table is an empty array.
    """
    spark = df.sparkSession
    store, at = _store(spark, path)
    mark = uuid.uuid4().hex
    parts, joined = f"{path}.parts-{mark}", _path(spark, f"{path}.joined-{mark}")
    jvm, separator = spark.sparkContext._jvm, ",\n"
    try:
        df.write.option("ignoreNullFields", False).option("lineSep", separator).json(parts)
        found = sorted((s.getPath().toString(), s.getLen()) for s in store.listStatus(_path(spark, parts)) if s.getPath().getName().startswith("part-") and s.getLen())
        out = store.create(joined, True)
        try:
            out.writeBytes("[\n")
            for i, (name, length) in enumerate(found):
                source = store.open(_path(spark, name))
                # The last line's separator is left out.
                jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, length - (len(separator) if i == len(found) - 1 else 0))
                source.close()
            out.writeBytes("\n]\n")
        finally:
            out.close()
        if store.exists(at):
            store.delete(at, False)
        if not store.rename(joined, at):
            raise OSError(f"{joined.toString()} cannot be renamed")
    finally:
        store.delete(_path(spark, parts), True)
        store.delete(joined, False)


def read_results(spark: SparkSession, path: str, numbers: dict[str, str], texts: dict[str, str], seed_pattern: str = r"_seed(\d+)") -> DataFrame:
    """One row for each JSON file under ``path``, whatever its shape: (file, seed, texts, numbers), missing or unreadable values null.

    A file is one VARIANT; ``numbers`` and ``texts`` name paths in it (``$.f1_B``), so files that lack a key, nest others or write a number as text load
    in one scan. The seed comes from the file's path. A file that is no JSON has null values; a file is read whole by one task.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    v = F.try_parse_json("value")
    numeric = [F.coalesce(F.try_variant_get(v, at, "double"), F.try_variant_get(v, at, "string").try_cast("double")).alias(n) for n, at in numbers.items()]
    seed = F.nullif(F.regexp_extract("_metadata.file_path", seed_pattern, 1), F.lit("")).cast("int")
    return files.select(F.col("_metadata.file_path").alias("file"), seed.alias("seed"), *[F.try_variant_get(v, at, "string").alias(n) for n, at in texts.items()], *numeric)


def summary(results: DataFrame, tag: str, numbers: list[str]) -> DataFrame:
    """(``tag``, metric, n, mean, std) over a tag's seeds: deviations of the population, missing values left out, six places."""
    long = results.select(tag, F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in numbers])))
    return long.groupBy(tag, "metric").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))
