"""Token-id files of bit planes: fixed-size blocks of ids, transposed, each plane compressed.

A file holds the ids of documents in ascending doc_id order:

    magic | blocks | document table | chunk index | footer

A block of ``BLOCK_IDS`` ids (the last may be shorter) is a matrix of ids by bits. Its transpose
is stored, plane by plane: plane k has bit k of every id, packed eight to a byte, and compressed
with zstandard on its own. High planes are nearly constant and shrink to nothing. Planes above the
largest id of a block are left out. The chunk index has per block its byte offset, id count,
plane count and the size of each plane; the document table has doc_id and id count per document;
the footer points to both. Blocks ignore document borders.

Writing: rows are sorted into ranges of doc_id by Spark, one task writes the files of a range and
starts a new one every ``FILE_IDS`` ids. A file is written under the name of the attempt and then
renamed, so a repeated or speculative attempt leaves one complete file of the same content.
"""

from __future__ import annotations

import itertools
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .frames import batch, binary_column, map_batches, written
from .wordbpe import encoder

MAGIC = b"BITPLN01"
FOOTER = struct.Struct("<QQQQ8s")
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 23
LEVEL = 3

_ROWS = "doc_id long, tie long, n long, ids binary"


# ------------------------------------------------------------------ blocks
def pack_block(ids: np.ndarray, level: int = LEVEL) -> list[bytes]:
    """Compressed bit planes of a block of unsigned 32-bit ids, lowest bit first."""
    ids = np.ascontiguousarray(ids, "<u4")
    top = int(ids.max()).bit_length() if len(ids) else 0
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    planes = np.packbits(bits[:, :top].T, axis=1, bitorder="little")
    squeeze = zstandard.ZstdCompressor(level=level)
    return [squeeze.compress(p.tobytes()) for p in planes]


def unpack_block(planes: list[bytes], n: int) -> np.ndarray:
    bits = np.zeros((32, n), np.uint8)
    expand = zstandard.ZstdDecompressor()
    for k, plane in enumerate(planes):
        raw = np.frombuffer(expand.decompress(plane, max_output_size=(n + 7) // 8), np.uint8)
        bits[k] = np.unpackbits(raw, count=n, bitorder="little")
    packed = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little"))
    return packed.view("<u4").reshape(n)


class PlaneWriter:
    """Streams documents to one file; holds one block."""

    def __init__(self, out, block_ids: int = BLOCK_IDS):
        self.out, self.block_ids = out, block_ids
        self.at, self.held, self.waiting = len(MAGIC), [], 0
        self.index: list[list[int]] = []
        self.documents: list[tuple[int | None, int]] = []
        self.ids = 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append((doc_id, len(ids)))
        self.ids += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block_ids:
            flat = np.concatenate(self.held)
            full = len(flat) - len(flat) % self.block_ids
            for a in range(0, full, self.block_ids):
                self._block(flat[a:a + self.block_ids])
            self.held, self.waiting = [flat[full:]], len(flat) - full

    def _block(self, ids: np.ndarray) -> None:
        planes = pack_block(ids)
        self.index.append([self.at, len(ids), *map(len, planes)])
        for plane in planes:
            self.out.write(plane)
            self.at += len(plane)

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.held))
        table = zstandard.compress(json.dumps(self.documents).encode())
        index = zstandard.compress(json.dumps(self.index).encode())
        self.out.write(table + index + FOOTER.pack(self.at, len(table), len(index), self.ids,
                                                   MAGIC))


def read_file(content: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of every document of a file, in order, one block in memory at a time."""
    at, table_size, index_size, total, magic = FOOTER.unpack_from(content,
                                                                  len(content) - FOOTER.size)
    if magic != MAGIC or not content.startswith(MAGIC):
        raise ValueError("not a bit-plane file")
    documents = json.loads(zstandard.decompress(content[at:at + table_size]))
    index = json.loads(zstandard.decompress(content[at + table_size:at + table_size
                                                    + index_size]))

    def blocks():
        for offset, n, *sizes in index:
            ends = list(itertools.accumulate(sizes, initial=offset))
            yield unpack_block([content[a:z] for a, z in zip(ends, ends[1:])], n)

    source, held = blocks(), np.zeros(0, np.uint32)
    for doc_id, n in documents:
        parts, have = [], 0
        while have < n:
            if not len(held):
                held = next(source)
            take = held[:n - have]
            held = held[len(take):]
            parts.append(take)
            have += len(take)
        yield doc_id, np.concatenate(parts) if parts else np.zeros(0, np.uint32)


# ------------------------------------------------------------------ encoding
def encode_rows(documents: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """(doc_id, tie, n, ids): each whole text through the tokenizers library, end id appended.
    ``ids`` are n little-endian numbers of two bytes, or of four where one needs more.

    ``tie`` orders rows that share a doc_id: by a hash of the text. A null text is empty.
    """
    slim = documents.select(F.col(key).cast("long").alias("doc_id"),
                            F.xxhash64(text).alias("tie"), F.col(text).alias("text"))

    def run(batches):
        coder = encoder(tokenizer)
        last = np.array([end_id], np.uint32)
        for b in batches:
            found = [np.concatenate((ids, last)) for ids in coder.batch(b.column(2))]
            found = [x.astype("<u2" if x.max() < 1 << 16 else "<u4") for x in found]
            yield batch(["doc_id", "tie", "n", "ids"], [
                b.column(0), b.column(1), pa.array([len(x) for x in found], pa.int64()),
                binary_column([x.tobytes() for x in found])])

    return map_batches(slim, run, _ROWS)


# ------------------------------------------------------------------ files
def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:",
                                                                               "file://", 1))


def write_planes(rows: DataFrame, folder: str, file_ids: int = FILE_IDS) -> DataFrame:
    """Write (doc_id, tie, n, ids) rows to ``folder``; returns (file, n_ids) of each file.

    ``rows`` should be a written table, because finding the ranges reads it once more. The folder
    must be reachable from every executor. File names sort in the order of their ids.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id",
                                                                                  "tie")

    def run(batches):
        from pyspark import TaskContext

        store, base = _open(folder)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        store.create_dir(base, recursive=True)
        count, writer, sink, temporary = 0, None, None, ""
        done = []

        def finish():
            writer.close()
            sink.close()
            name = f"ids-{part:06d}-{count:06d}.planes"
            store.move(temporary, f"{base}/{name}")
            done.append((name, writer.ids))

        for b in batches:
            for doc_id, n, raw in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(),
                                      b.column("ids")):
                if writer is None:
                    temporary = f"{base}/_{part:06d}-{count:06d}-{attempt}"
                    sink = store.open_output_stream(temporary)
                    writer = PlaneWriter(sink)
                raw = raw.as_buffer()
                writer.add(doc_id, np.frombuffer(raw, f"<u{raw.size // n}").astype("<u4"))
                if writer.ids >= file_ids:
                    finish()
                    writer, count = None, count + 1
        if writer is not None:
            finish()
        yield batch(["file", "n_ids"], [pa.array([x[0] for x in done], pa.string()),
                                        pa.array([x[1] for x in done], pa.int64())])

    return written(map_batches(ordered, run, "file string, n_ids long"), "manifest")


def read_planes(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    ``start`` counts the ids of all documents before it. The manifest has a row per file, each of
    millions of ids; its running sums are made on the driver.
    """
    files = sorted((r["file"], r["n_ids"]) for r in manifest.collect())
    starts = itertools.accumulate((n for _, n in files), initial=0)
    begins = spark.createDataFrame([(f, s) for (f, _), s in zip(files, starts)],
                                   "file string, begin long")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.planes").load(folder)
    named = content.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(batches):
        for b in batches:
            for begin, raw in zip(b.column("begin").to_pylist(), b.column("content")):
                rows, at = [], begin
                for doc_id, ids in read_file(raw.as_buffer().to_pybytes()):
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                yield batch(["doc_id", "start", "n_tokens", "ids_crc32"],
                            [pa.array(list(c), pa.int64()) for c in zip(*rows)] if rows else
                            [pa.array([], pa.int64())] * 4)

    # One file name and number per file of many megabytes: small beside the files themselves.
    return map_batches(named.join(F.broadcast(begins), "file").select("begin", "content"), run,
                       "doc_id long, start long, n_tokens long, ids_crc32 long")


def plane_round_trip(documents: DataFrame, tokenizer: str, end_id: int = 1, key: str = "doc_id",
                     text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode, write as bit planes, read back: (doc_id, start, n_tokens, ids_crc32) per row.

    Null ids come first. Rows that share a doc_id follow in the order of a hash of their text;
    equal rows are interchangeable. A null or empty text has the end id only. An empty table
    writes no file and gives no rows. Other columns are not read.
    """
    spark = documents.sparkSession
    rows = written(encode_rows(documents, tokenizer, end_id, key, text), "encoded")
    folder = shared_dir(spark, "planes")
    manifest = write_planes(rows, folder, file_ids)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, "
                                         "ids_crc32 long")
    return read_planes(spark, folder, manifest)
