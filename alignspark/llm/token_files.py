"""Token-id files with shuffled bit or byte planes.

File: magic, then the compressed planes of each block, then the index, then the
index's offset and the magic again.  A block holds ``block`` ids (the last one
fewer).  Its ids, as unsigned 32-bit integers, are transposed into 4 byte
planes or 32 bit planes, and each plane is compressed with zstandard by itself;
planes of high bits are all zero and shrink to nothing.  The index (zstandard
over little-endian 64-bit integers) lists for each block its offset, its number
of ids and the compressed size of each plane, and for each document its id and
its number of ids, since any id, the end id too, may occur inside a text.

Shards are written by the task that sorted their range of document ids, under
a name of their own first and then renamed, so a lost executor leaves no
partial shard and a repeated task writes the same bytes again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, common

MAGIC = b"PLANES01"
NULL_ID = -(1 << 63)


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Transpose ids into 4 byte planes or 32 bit planes."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file; memory is one block."""

    def __init__(self, out, block: int = 1 << 16, kind: str = "byte", level: int = 3) -> None:
        if kind not in ("bit", "byte"):
            raise ValueError("kind must be 'bit' or 'byte'")
        self.out, self.block, self.kind = out, block, kind
        self.zip = zstandard.ZstdCompressor(level=level)
        self.held, self.n_held, self.at = [], 0, len(MAGIC)
        self.blocks: list[tuple[int, ...]] = []
        self.docs: list[tuple[int, int]] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((NULL_ID if doc_id is None else doc_id, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            every = np.concatenate(self.held)
            for at in range(0, len(every) - self.block + 1, self.block):
                self._write(every[at : at + self.block])
            rest = every[len(every) // self.block * self.block :]
            self.held, self.n_held = [rest], len(rest)

    def _write(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) for p in to_planes(ids, self.kind)]
        self.blocks.append((self.at, len(ids), *map(len, planes)))
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> int:
        """Returns the number of ids in the file."""
        if self.n_held:
            self._write(np.concatenate(self.held))
        n_planes = 4 if self.kind == "byte" else 32
        head = np.array([len(self.blocks), len(self.docs), n_planes], "<i8")
        index = self.zip.compress(b"".join((head.tobytes(), np.array(self.blocks, "<i8").tobytes(), np.array(self.docs, "<i8").tobytes())))
        self.out.write(index + struct.pack("<q", self.at) + MAGIC)
        return sum(n for _, n in self.docs)


class PlaneReader:
    """Reads one file through any seekable handle."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.seek(0, 2)
        source.seek(size - 16)
        at, magic = struct.unpack("<q8s", source.read(16))
        if magic != MAGIC:
            raise ValueError("not a plane file")
        source.seek(at)
        flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(source.read(size - 16 - at)), "<i8")
        n_blocks, n_docs, self.n_planes = map(int, flat[:3])
        cut = 3 + n_blocks * (2 + self.n_planes)
        self.blocks = flat[3:cut].reshape(n_blocks, 2 + self.n_planes)
        self.docs = flat[cut:].reshape(n_docs, 2)

    def block(self, k: int) -> np.ndarray:
        at, n, *sizes = map(int, self.blocks[k])
        self.source.seek(at)
        raw, unzip, planes = self.source.read(sum(sizes)), zstandard.ZstdDecompressor(), []
        for size in sizes:
            planes.append(unzip.decompress(raw[:size]))
            raw = raw[size:]
        return from_planes(planes, n, "byte" if self.n_planes == 4 else "bit")

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Documents in file order; memory is one document and one block."""
        held, n_held, k = [], 0, 0
        for doc_id, n in self.docs.tolist():
            while n_held < n:
                held.append(self.block(k))
                n_held, k = n_held + len(held[-1]), k + 1
            # one array is cut without a copy
            every = held[0] if len(held) == 1 else np.concatenate(held) if held else np.zeros(0, "<u4")
            yield (None if doc_id == NULL_ID else doc_id), every[:n]
            held, n_held = [every[n:]], n_held - n


def _write_shards(folder: str, path: str, end: int | None, block: int, kind: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task = byte_bpe.encoder(path), TaskContext.get()
        shard = task.partitionId()
        fs, base = pafs.FileSystem.from_uri(folder)
        name, tmp = f"{base}/shard-{shard:06d}.planes", f"{base}/.shard-{shard:06d}-{task.taskAttemptId()}"
        tail = b"" if end is None else struct.pack("<I", end)
        fs.create_dir(base, recursive=True)
        n_docs = 0
        with fs.open_output_stream(tmp) as out:
            writer = PlaneWriter(out, block, kind)
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    writer.add(doc_id, np.frombuffer(bpe.encode(text) + tail, "<u4"))
                    n_docs += 1
            n = writer.close()
        try:
            fs.move(tmp, name)
        except OSError:
            if fs.get_file_info(name).type == pafs.FileType.NotFound:
                raise
            fs.delete_file(tmp)  # another attempt was first, with the same bytes
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/shard-{shard:06d}.planes"], "n_docs": [n_docs], "n_ids": [n]})

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int | None = 0, block: int = 1 << 16, kind: str = "byte") -> list[tuple[str, int]]:
    """Encode texts and write them as shards in ascending id order: [(path, ids in all shards before)].

    Null texts count as empty, null ids come first, repeated ids are ordered by
    text, an empty table writes shards without documents.  The folder is a URI
    that executors and driver can write (file:, hdfs:, s3:).  The driver gets
    one row for each shard.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sorted_rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    shards = sorted_rows.mapInArrow(_write_shards(folder, tokenizer, end, block, kind), "shard long, path string, n_docs long, n_ids long").collect()
    found, start = [], 0
    for s in sorted(shards, key=lambda s: s["shard"]):
        if s["n_docs"]:
            found.append((s["path"], start))
            start += s["n_ids"]
    return found


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fs, name = pafs.FileSystem.from_uri(path)
            rows: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
            with fs.open_input_file(name) as source:
                size = 0
                for doc_id, ids in PlaneReader(source).documents():
                    for k, v in zip(rows, (doc_id, start, len(ids), ids.tobytes()), strict=True):
                        rows[k].append(v)
                    start, size = start + len(ids), size + 4 * len(ids)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pydict(rows, schema=_READ)
                        rows, size = {k: [] for k in rows}, 0
            yield pa.RecordBatch.from_pydict(rows, schema=_READ)


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def read_token_files(spark: SparkSession, shards: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) from the files."""
    if not shards:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    listed = spark.createDataFrame(shards, "path string, start long").repartition(len(shards))
    return listed.mapInArrow(_read_shards, "doc_id long, start long, n_tokens long, ids binary")


def crc32_of(ids: bytes) -> int:
    return zlib.crc32(ids)


def token_file_digest(docs: DataFrame, tokenizer: str, **kw) -> DataFrame:
    """Write the files to the shared folder, read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    shards = write_token_files(docs, common.table_path(spark, "tokens"), tokenizer, **kw)
    return read_token_files(spark, shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
