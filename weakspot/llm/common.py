"""Shared pieces of the training-data operators: shared storage, Arrow batches, word splitting and hashing.

All hashes are computed from the bytes alone, so every executor gives equal content the same name without a shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: any run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes of text handled at once in one Python worker.
CHUNK_BYTES = 1 << 19
U64 = np.uint64


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A public tokenizer file in `folder`, or in the installed package of such files."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir, or a new local one where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="weakspot-")
        spark.sparkContext.setCheckpointDir(at)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return at


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *spent: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again; lost executors then cost no recomputation.

    `spent`: written tables that nothing needs any more once df is written; they are deleted.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    drop(*spent)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that materialize has written."""
    for table in tables:
        drop_path(table.sparkSession, table.written_at)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Sets of ids up to this size are broadcast; larger ones are joined by a shuffle.
BROADCAST_IDS = 500_000


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id isn't among ids (one column doc_id, written out by now); null is an id like others."""
    name = free_name("doc_id", docs.columns)
    ids = ids.select(F.col("doc_id").alias(name)).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids[name]), "left_anti")


#: Bytes of an Arrow batch on its way to Python, where the session sets none.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches: the JVM and the worker each hold a batch more than once, outside the heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def id_and_text(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the published splitmix64 finaliser)."""
    x = x + U64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    t = x >> U64(30)
    x ^= t
    x *= U64(0xBF58476D1CE4E5B9)
    np.right_shift(x, U64(27), out=t)
    x ^= t
    x *= U64(0x94D049BB133111EB)
    np.right_shift(x, U64(31), out=t)
    x ^= t
    return x


#: Odd factors of the pair names (fixed by this module only: names never leave a run).
LEFT, RIGHT = U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93)


def _paired(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    h = one * LEFT
    h += two
    h ^= h >> U64(32)
    h *= RIGHT
    h ^= h >> U64(29)
    return h


class Slices:
    """64-bit names of any slices of a sequence of 64-bit values.

    Stretches of 1, 2, 4, .. values are named from the names of their halves, and a slice from the two stretches, the longest
    that fit, at its start and its end. Each name is a nonlinear function of its parts, so that no pattern of few values
    (such as Thue-Morse words under a polynomial) makes different slices agree. Two salts give independent names.
    """

    def __init__(self, values: np.ndarray, salt: int = 0):
        self.values, self.salt = mix(values, 200 + salt), salt

    def _levels(self, top: int):
        """The names of all stretches of 1, 2, .. 2**top values."""
        h = self.values
        for k in range(top + 1):
            yield h
            if k < top:
                h = _paired(h[: -1 << k], h[1 << k :])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = end - start
        out = mix(np.zeros(len(length), dtype=U64), 300 + self.salt)
        level = np.frexp(length)[1] - 1  # of the largest power of 2 in the length
        for k, h in enumerate(self._levels(int(level.max(initial=-1)))):
            at = np.flatnonzero(level == k)
            n = length[at]
            out[at] = mix(h[start[at]] * LEFT + h[start[at] + n - (1 << k)] * RIGHT + n.astype(U64), 400 + self.salt)
        return out


def eight_bytes(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number; zeros beyond the end."""
    return np.ndarray((len(raw) + 1,), dtype="<u8", buffer=raw.tobytes() + bytes(8), strides=(1,))[: len(raw)]


def byte_grams(raw: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """64-bit names of all strings of `length` bytes (8 or more), made like those of Slices from stretches of 8, 16, .. bytes."""
    h, width = mix(eight_bytes(raw)[: len(raw) - 7], 600 + salt), 8
    while 2 * width <= length:
        h = _paired(h[:-width], h[width:])
        width *= 2
    n = max(0, len(raw) - length + 1)
    return mix(h[:n] * LEFT + h[length - width :][:n] * RIGHT + U64(length), 601 + salt)


#: Words of more bytes are named by a cryptographic hash of the whole.
LONG_WORD = 256
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def word_names(raw: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit names of byte strings, 8 bytes at a time; two salts give independent names."""
    size = end - start
    out = mix(size.astype(U64), 500 + salt)
    if not len(out):
        return out
    eight = eight_bytes(raw)
    live, at = np.flatnonzero(size <= LONG_WORD), 0
    while len(live):
        out[live] = mix(out[live] ^ (eight[start[live] + at] & _MASKS[np.minimum(size[live] - at, 8)]), 501 + salt)
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([salt])).digest(), "little")
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and each row's offsets into them; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES):
    """Slices of a batch whose texts have about `most` bytes together; a longer text is a slice of its own."""
    raw, offsets = text_bytes(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield batch.slice(row, end - row), raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of several texts that lie one after another in raw: byte extents, row numbers and 64-bit names."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets, n = raw, offsets, len(raw)
        inside = ~SEPARATOR[raw]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, offsets)  # of each row, and the number of words
        self.name = word_names(raw, self.start, self.end)

    @functools.cached_property
    def other(self) -> np.ndarray:
        """Names independent of `name`: both together are 128 bits."""
        return word_names(self.raw, self.start, self.end, 1)

    def __len__(self) -> int:
        return len(self.start)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], .. starts[0] + counts[0] - 1, starts[1], .."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    begin = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(begin - starts, counts)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask of n positions: those in [s, s + length) of any start."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + length, n), -1)
    return np.cumsum(change[:-1]) > 0


# -- marks: stretches of a text, found by other tasks, on their way back to the text ---------------------------------------------

def text_key() -> Column:
    """Names a text within the rows of its doc_id, so that rows of one id and different texts keep their own marks."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def free_name(name: str, *taken: list[str]) -> str:
    while any(name.lower() == c.lower() for columns in taken for c in columns):
        name += "_"
    return name


def with_marks(docs: DataFrame, marks: DataFrame, *spent: DataFrame, only: bool = False) -> tuple[DataFrame, DataFrame]:
    """docs with, as a last column, the list of their marks (null where there is none), or with `only` those that have marks;
    and the written table of the lists.

    marks: doc_id, tk (text_key of the text), and what the list shall hold; null is an id like others. `spent` as in
    materialize.
    """
    held = [c for c in marks.columns if c not in ("doc_id", "tk")]
    lists = materialize(marks.groupBy("doc_id", "tk").agg(F.collect_list(F.struct(*held)).alias("at")), "marks", *spent)
    one, two, three = (free_name(x, docs.columns) for x in ("m_id", "m_tk", "m_at"))
    by = lists.select(F.col("doc_id").alias(one), F.col("tk").alias(two), F.col("at").alias(three))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(one)) & (text_key() == F.col(two))
    columns = [*[docs[c] for c in docs.columns], three]
    if lists.count() > BROADCAST_IDS:  # each text travels once
        return docs.join(by, same, "inner" if only else "left").select(*columns), lists
    # only texts that have marks travel
    ids = F.broadcast(by.select(one, two))
    marked = docs.join(ids, same, "left_semi").join(by, same).select(*columns)
    if only:
        return marked, lists
    return marked.union(docs.join(ids, same, "left_anti").withColumn(three, F.lit(None).cast(by.schema[three].dataType))), lists
