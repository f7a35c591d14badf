"""Token ids in binary files of independent zstandard frames with a trailing seek table.

A file holds one frame per document, each with its content checksum, in ascending doc_id order; a skippable frame
with the doc_ids; and the seek table of the public zstandard seekable format (a skippable frame at the end:
compressed size, plain size and a checksum for each frame, then the number of frames, a flag byte and a magic
number). Any zstandard decoder reads the file whole; ``read_documents`` reads only the frames asked for.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestep.llm import tokens
from lodestep.llm._shared import Scratch

#: Fixed by the zstandard frame and seekable formats.
SKIPPABLE, SEEK_SKIPPABLE, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
CHECKSUMS = 0x80
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
NO_ID = -(2**63)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _check(plain: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


class FrameWriter:
    """Writes frames to a stream and keeps only the index in memory."""

    def __init__(self, out, level: int = 1):
        import zstandard

        self.out, self.entries, self.doc_ids = out, [], []
        self.tool = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int, plain: bytes) -> None:
        packed = self.tool.compress(plain)
        self.out.write(packed)
        self.entries.append((len(packed), len(plain), _check(plain)))
        self.doc_ids.append(doc_id)

    def finish(self) -> None:
        ids = np.array(self.doc_ids, "<i8").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(ids)) + ids)
        table = np.array(self.entries, ENTRY).tobytes()
        self.out.write(struct.pack("<II", SEEK_SKIPPABLE, len(table) + FOOTER.size) + table)
        self.out.write(FOOTER.pack(len(self.entries), CHECKSUMS, SEEK_MAGIC))


def read_index(source) -> tuple[np.ndarray, np.ndarray]:
    """(doc_ids, entries) from the end of an open file."""
    end = source.size()
    source.seek(end - FOOTER.size)
    frames, flags, magic = FOOTER.unpack(source.read(FOOTER.size))
    if magic != SEEK_MAGIC or not flags & CHECKSUMS:
        raise ValueError("no seek table with checksums")
    table, ids = frames * ENTRY.itemsize, frames * 8
    source.seek(end - FOOTER.size - table - 8 - ids)
    raw = source.read(ids + 8 + table)
    return np.frombuffer(raw, "<i8", frames), np.frombuffer(raw, ENTRY, frames, ids + 8)


def read_documents(uri: str, doc_ids: Iterable[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) of the documents asked for, or of all; only their frames are read and decompressed."""
    import zstandard

    store, path = _open(uri)
    tool = zstandard.ZstdDecompressor()
    with store.open_input_file(path) as source:
        found, entries = read_index(source)
        at = np.concatenate([[0], np.cumsum(entries["packed"], dtype=np.int64)])
        wanted = range(len(found)) if doc_ids is None else np.flatnonzero(np.isin(found, list(doc_ids)))
        for i in wanted:
            source.seek(int(at[i]))
            plain = tool.decompress(source.read(int(entries["packed"][i])), max_output_size=int(entries["plain"][i]))
            if len(plain) != entries["plain"][i] or _check(plain) != entries["check"][i]:
                raise ValueError(f"frame {i} of {uri} is damaged")
            yield int(found[i]), np.frombuffer(plain, "<u4")


def write_tokens(docs: DataFrame, uri: str, tokenizer: str, spaces: str, end_id: int) -> DataFrame:
    """Tokenises ``docs`` into files under ``uri`` in ascending doc_id order; returns their manifest, lazily.

    One file for each range partition of doc_id: (path, first_doc_id, n_docs, n_tokens). A task writes to a name
    of its own and renames it when it is whole, so a repeated task leaves the same file. Null texts are
    empty; each document's ids end with ``end_id``. A null doc_id is kept as the least 64-bit integer. Rows that
    repeat a doc_id are documents of their own, ordered by text.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, writer, total, first = TaskContext.get(), None, 0, None
        store, folder = _open(uri)
        store.create_dir(folder, recursive=True)
        name = f"{folder}/tokens-{context.partitionId():06d}.zst"
        own = f"{name}.{context.taskAttemptId()}"
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, raw in tokens.encode_batches(keys, texts, tokenizer, spaces):
                if writer is None:
                    writer, first = FrameWriter(store.open_output_stream(own)), key
                writer.add(key, raw + end)
                total += len(raw) // 4 + 1
        if writer is not None:
            writer.finish()
            writer.out.close()
            store.move(own, name)
            yield pa.RecordBatch.from_pylist(
                [{"path": f"{uri}/{name.rpartition('/')[2]}", "first_doc_id": first, "n_docs": len(writer.entries), "n_tokens": total}]
            )

    ordered = (
        docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return ordered.mapInArrow(run, "path string, first_doc_id long, n_docs long, n_tokens long")


def read_back(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that ``manifest`` lists.

    The tokens before each file are added up over the manifest, a row a file. An id that stands for null is null again; documents that
    repeat an id are rows of their own; an empty manifest gives no rows. A frame that fails its checksum is an error.
    """
    before = F.sum("n_tokens").over(Window.orderBy("first_doc_id", "path").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for doc_id, ids in read_documents(path):
                    rows.append((None if doc_id == NO_ID else doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(rows) == 50_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return files.repartition(max(1, manifest.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def round_trip(docs: DataFrame, tokenizer: str, spaces: str, end_id: int) -> DataFrame:
    """Writes ``docs`` to token files in the shared folder and returns what the files hold; the files are then removed. Odd cases as in ``write_tokens``."""
    with Scratch(docs.sparkSession) as scratch:
        manifest = scratch.write(write_tokens(docs, f"{scratch.path}/tokens", tokenizer, spaces, end_id))
        return read_back(manifest).checkpoint()
