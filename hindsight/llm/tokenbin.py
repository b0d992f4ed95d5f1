"""Token-id shards by plane shuffling.

Texts are range-partitioned by doc_id; each task encodes its documents in order and writes shards into
the shared folder. A shard is a run of fixed-size id blocks: every block is transposed into byte planes
(or bit planes), each plane is compressed with zstandard, and a footer holds the chunk index (offset,
ids and plane lengths of each block) and the documents' lengths. The manifest is a written table with
one row per shard; shards of lost task attempts are in no manifest row and are never read.

Defined cases: null or empty texts have the end id only; a null doc_id sorts first; rows that repeat a
doc_id stay separate documents, in order of their text's hash; extra columns are ignored; an empty
table has no shard.

Layout: MAGIC, blocks, footer (Arrow stream: documents; then JSON: chunk index), 3 little-endian
64-bit numbers (offset of the documents, offset of the JSON, its length), MAGIC.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_dir, partitions, shipped, stored
from .words import library_coder

MAGIC = b"PLANES1\n"
MANIFEST = "part int, seq int, path string, n_docs long, n_ids long, bytes long"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block, lowest first; only as many as its largest id needs."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    if not bits:
        return [raw[:, k].tobytes() for k in range(-(-top // 8))]
    spread = np.unpackbits(raw, axis=1, bitorder="little")[:, :top]
    return [np.packbits(spread[:, k], bitorder="little").tobytes() for k in range(top)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if bits:
        out = np.zeros(n, np.uint32)
        for k, p in enumerate(planes):
            out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little").astype(np.uint32) << np.uint32(k)
        return out
    raw = np.zeros((n, 4), np.uint8)
    for k, p in enumerate(planes):
        raw[:, k] = np.frombuffer(p, np.uint8)
    return raw.view("<u4").ravel()


class ShardWriter:
    def __init__(self, uri: str, block: int, bits: bool, level: int):
        fs, name = pafs.FileSystem.from_uri(uri)
        self.out = fs.open_output_stream(name, compression=None)
        self.out.write(MAGIC)
        self.uri, self.block, self.bits, self.at = uri, block, bits, len(MAGIC)
        self.z = zstandard.ZstdCompressor(level=level)
        self.held, self.n_held, self.n_ids = [], 0, 0
        self.index, self.doc_ids, self.sizes = [], [], []

    def add(self, doc_ids: list, sizes: list[int], ids: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.sizes += sizes
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            full = np.concatenate(self.held)
            whole = len(full) // self.block * self.block
            for i in range(0, whole, self.block):
                self._put(full[i : i + self.block])
            self.held, self.n_held = [full[whole:]], len(full) - whole

    def _put(self, ids: np.ndarray) -> None:
        planes = [self.z.compress(p) for p in to_planes(ids, self.bits)]
        self.index.append([self.at, len(ids), [len(p) for p in planes]])
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> dict:
        if self.n_held:
            self._put(np.concatenate(self.held))
        docs = pa.table({"doc_id": pa.array(self.doc_ids, pa.int64()), "n_tokens": pa.array(self.sizes, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(docs)
        table, meta = sink.getvalue().to_pybytes(), json.dumps({"bits": self.bits, "block": self.block, "index": self.index}).encode()
        self.out.write(table + meta + struct.pack("<QQQ", self.at, self.at + len(table), len(meta)) + MAGIC)
        self.out.close()
        return {"path": self.uri, "n_docs": len(self.sizes), "n_ids": self.n_ids, "bytes": self.at + len(table) + len(meta) + 24 + len(MAGIC)}


class ShardReader:
    """A shard's chunk index and documents; blocks are read and rebuilt one by one."""

    def __init__(self, uri: str):
        fs, name = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(name)
        tail = self.file.read_at(24 + len(MAGIC), self.file.size() - 24 - len(MAGIC))
        if tail[24:] != MAGIC:
            raise ValueError(f"{uri} isn't a whole shard")
        docs, meta, size = struct.unpack("<QQQ", tail[:24])
        self.docs = pa.ipc.open_stream(self.file.read_at(meta - docs, docs)).read_all()
        self.meta = json.loads(self.file.read_at(size, meta))

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.meta["index"][k]
        data, planes = self.file.read_at(sum(sizes), at), []
        for s in sizes:
            planes.append(zstandard.decompress(data[:s]))
            data = data[s:]
        return from_planes(planes, n, self.meta["bits"])

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, offset in the shard, ids) in order."""
        held, k, at, offset = np.empty(0, np.uint32), 0, 0, 0
        for doc_id, n in zip(*(self.docs[c].to_pylist() for c in ("doc_id", "n_tokens")), strict=True):
            parts = []
            need = n
            while need > len(held) - at:
                parts.append(held[at:])
                need -= len(held) - at
                held, at, k = self.block(k), 0, k + 1
            parts.append(held[at : at + need])
            at += need
            yield doc_id, offset, np.concatenate(parts)
            offset += n


def write_shards(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = 2, block: int = 1 << 16, bits: bool = False, level: int = 3, max_ids: int = 1 << 25) -> DataFrame:
    """Encodes docs(doc_id, text) in ascending doc_id order and writes shards under out; gives the manifest."""
    end, file = [] if end_id is None else [end_id], shipped(docs.sparkSession, tokenizer)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer, done = library_coder(SparkFiles.get(file)), None, []
        for b in batches:
            ids_of = b.column("doc_id")
            for first, rows, ids, sizes in coder.slices(b.column("text")):
                if end:
                    ids = np.insert(ids, np.cumsum(sizes), end_id)
                    sizes = sizes + 1
                if writer is None or writer.n_ids >= max_ids:
                    if writer:
                        done.append(writer.close())
                    fs, root = pafs.FileSystem.from_uri(out)
                    fs.create_dir(root, recursive=True)
                    writer = ShardWriter(f"{out}/{uuid.uuid4().hex}.planes", block, bits, level)
                writer.add(ids_of.slice(first, rows).to_pylist(), sizes.tolist(), ids)
        if writer:
            done.append(writer.close())
        part = TaskContext.get().partitionId()
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        kinds = {"part": pa.int32(), "seq": pa.int32(), "path": pa.string()}
        rows = [x | {"part": part, "seq": i} for i, x in enumerate(done)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.int64())) for c in names], names=names)

    tie = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tie.alias("tie"))
    ordered = ordered.repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return stored(ordered.select("doc_id", "text").mapInArrow(task, MANIFEST), f"{out}/manifest.parquet")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards' bytes.

    start: ids of all documents before it. The running sum is over shards (one row each), not documents.
    """

    def task(frames):
        import pandas as pd

        for frame in frames:
            for path, before in zip(frame.path, frame.before, strict=True):
                rows = [(d, before + offset, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, offset, ids in ShardReader(path).documents()]
                out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield out.astype({"doc_id": "Int64"})

    w = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("path", F.coalesce(F.sum("n_ids").over(w), F.lit(0)).alias("before"))
    return shards.repartition(max(1, manifest.count())).mapInPandas(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_planes(spark, sf_dir: str) -> DataFrame:
    """Position, number of ids and their CRC of every document, read back from the shards of all documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_shards(docs, new_dir(spark, "planes"), public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(manifest)
