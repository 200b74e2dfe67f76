"""Token ids in sorted-string-table shards.

A shard holds the documents of one range of identifiers in ascending order: prefix-compressed entries in zstd blocks, a sparse
index with each block's first key, a Bloom filter over the keys, and a footer. `SSTable.get` reads footer, index and filter
once and then at most one block for each lookup.

    block:  entries of varint shared key bytes, varint other key bytes, varint value bytes, key bytes, value; zstd-compressed
    index:  for each block its first key (8 bytes), place and size (8 bytes each)
    filter: bits, 10 for each key, 7 probes by double hashing
    footer: place and size of index and filter, documents, tokens (8 bytes each), b"WSSTABL1"

Keys are doc_ids as 8 big-endian bytes with the sign bit turned, so that bytes sort as numbers do. Values are the ids as
little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, drop_path, id_and_text, materialize, mix, new_path
from .tokens import encoder

MAGIC, BLOCK_BYTES, BITS, PROBES, END = b"WSSTABL1", 1 << 16, 10, 7, 2
FOOTER = struct.Struct("<6Q8s")
INDEX = struct.Struct("<8sQQ")


def open_store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


def key_bytes(doc_id: int) -> bytes:
    return struct.pack(">Q", doc_id + (1 << 63))


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def probes(keys: np.ndarray, bits: int) -> np.ndarray:
    one, two = mix(keys, 1), mix(keys, 2) | U64(1)
    return (one[:, None] + two[:, None] * np.arange(PROBES, dtype=U64)) % U64(bits)


class Writer:
    """Writes one shard; keys must come in ascending order, and a repeated key is kept as another entry."""

    def __init__(self, sink):
        self.sink, self.place, self.index, self.keys, self.tokens = sink, 0, [], [], 0
        self.block, self.size, self.last, self.first = [], 0, b"", b""
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int, value: bytes) -> None:
        key, shared = key_bytes(doc_id), 0
        if self.block:
            while shared < 8 and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += [varint(shared), varint(8 - shared), varint(len(value)), key[shared:], value]
        self.size += len(value) + 8
        self.last = key
        self.keys.append(doc_id)
        self.tokens += len(value) // 4
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.pack.compress(b"".join(self.block))
            self.index.append((self.first, self.place, len(data)))
            self.sink.write(data)
            self.place += len(data)
            self.block, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(INDEX.pack(*x) for x in self.index)
        bits = max(64, -(-len(self.keys) * BITS // 8) * 8)
        flags = np.zeros(bits, dtype=bool)
        flags[probes(np.array(self.keys, dtype=np.int64).view(U64), bits).ravel().astype(np.int64)] = True
        bloom = np.packbits(flags).tobytes()
        self.sink.write(index + bloom)
        self.sink.write(FOOTER.pack(self.place, len(index), self.place + len(index), len(bloom), len(self.keys), self.tokens, MAGIC))
        self.sink.close()


class SSTable:
    def __init__(self, path: str):
        store, inner = open_store(path)
        self.file = store.open_input_file(inner)
        end = self.file.size()
        at, size, filter_at, filter_size, self.docs, self.tokens, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, end - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.blocks = list(INDEX.iter_unpack(self.file.read_at(size, at)))
        self.firsts = [b[0] for b in self.blocks]
        self.bloom = np.unpackbits(np.frombuffer(self.file.read_at(filter_size, filter_at), dtype=np.uint8))

    def entries(self, block: int):
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(self.blocks[block][2], self.blocks[block][1]))
        at, key = 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            other, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + other]
            at += other
            yield struct.unpack(">Q", key)[0] - (1 << 63), data[at : at + size]
            at += size

    def __iter__(self):
        for block in range(len(self.blocks)):
            yield from self.entries(block)

    def get(self, doc_id: int) -> np.ndarray | None:
        """The ids of a document (the first entry of a repeated key), or None."""
        if not self.bloom[probes(np.array([doc_id], dtype=np.int64).view(U64), len(self.bloom)).astype(np.int64)].all():
            return None
        block = max(bisect.bisect_left(self.firsts, key_bytes(doc_id)) - 1, 0)
        for b in range(block, min(block + 2, len(self.blocks))):
            for found, value in self.entries(b):
                if found == doc_id:
                    return np.frombuffer(value, dtype="<u4")
        return None


def _write(folder: str, tokenizer: str):
    def run(batches):
        encode, writer, path, first, last = encoder(tokenizer).encode, None, "", 0, 0
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            for part, _, _ in chunks(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if writer is None:
                        path, first = f"{folder}/{uuid.uuid4().hex}.sst", doc_id
                        store, inner = open_store(path)
                        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                        writer = Writer(store.open_output_stream(inner))
                    writer.add(doc_id, encode(text or "") + end)
                    last = doc_id
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "first": [first], "last": [last], "docs": [len(writer.keys)], "tokens": [writer.tokens]})

    return run


def write_sstables(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Writes the shards of docs and returns their manifest: path, first, last, docs, tokens and start (ids in shards before).

    Each text (null: empty) is encoded whole and gets the end id 2. Rows of null doc_id have no key and are left out; repeated
    doc_ids stay, in the order of their texts. A shard's name is new for each attempt and only a finished attempt's name
    reaches the manifest, so lost executors and repeated attempts leave no wrong rows. Other columns are ignored. The
    manifest, one row a shard, is gathered on the driver.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "sst")
    ranged = id_and_text(docs).where("doc_id is not null").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = "path string, first long, last long, docs long, tokens long"
    shards = sorted(materialize(ranged.mapInArrow(_write(folder, tokenizer), schema), "manifest").collect(), key=lambda r: r["first"])
    rows, start = [], 0
    for r in shards:
        rows.append((*r, start))
        start += r["tokens"]
    return spark.createDataFrame(rows, schema + ", start long")


def read_sstables(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, as read from the shards."""

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                table = SSTable(path)
                for b in range(len(table.blocks)):
                    found = list(table.entries(b))
                    sizes = np.array([len(v) // 4 for _, v in found], dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k for k, _ in found], pa.int64()), pa.array(start + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array([zlib.crc32(v) for _, v in found], pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    start += int(sizes.sum())

    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_id: int) -> np.ndarray | None:
    """One document's ids by binary search over the shards' ranges and in the shard."""
    for r in manifest.where((F.col("first") <= doc_id) & (F.col("last") >= doc_id)).orderBy("first").collect():
        if (ids := SSTable(r["path"]).get(doc_id)) is not None:
            return ids
    return None


def remove_sstables(manifest: DataFrame) -> None:
    for r in manifest.collect():
        drop_path(manifest.sparkSession, r["path"])
