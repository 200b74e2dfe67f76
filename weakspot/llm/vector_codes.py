"""Product codes of vectors by Lloyd's rounds that carry on from each other.

A vector's components are integers, so sums are exact in any order. Each round writes every vector's new assignments beside the
ones before; only parts whose assignment changed give minus and plus contributions to the running sums, which are added up in
each task before they are shuffled. The sums (a row an entry and component) are a written table too, and the next codebooks,
bounded by entries times width, are computed from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, drop, free_name, materialize, small_batches

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Width times the square of a vector's largest integer component may be up to this, so that squared distances fit in 64 bits.
LARGEST = float(1 << 60)
#: Vectors compared with a codebook at once in a task.
BLOCK = 2048
SUMS = "part int, entry int, place int, total long"


def usable(column: Column, parts: int = PARTS, scale: int = SCALE) -> Column:
    """Whether a vector is there, has no null or non-finite component, and has a width that `parts` divides."""
    width = F.size(column)
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (scale * scale * x.cast("double") * x.cast("double") * width < LARGEST)
    return column.isNotNull() & (width > 0) & (width % parts == 0) & F.forall(column, fits)


def kept_vectors(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """vec_id, label and v, the integer components, of the vectors that take part; widths may still differ."""
    v = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("int"))
    return vectors.where(usable(F.col("embedding"), parts, scale)).select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))


def first_codebooks(kept: DataFrame, parts: int, entries: int) -> tuple[DataFrame, list[np.ndarray]]:
    """The vectors of the width of the smallest vec_id, and codebooks of the parts of the `entries` first ones."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = [r["v"] for r in kept.select("vec_id", "v").orderBy(*order).limit(entries).collect()]
    if not first:
        return kept, []
    width = len(first[0])
    kept = kept.where(F.size("v") == width)
    if any(len(v) != width for v in first):
        first = [r["v"] for r in kept.select("vec_id", "v").orderBy(*order).limit(entries).collect()]
    return kept, np.split(np.array(first, dtype=np.int64), parts, axis=1)


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For each row of integers the number of the nearest entry by squared distance, the lowest among equals; exact."""
    out = np.empty(len(x), dtype=np.int64)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max()))
    by_products = 4 * most * most * x.shape[1] < 1 << 53  # all of a product's terms are then whole doubles
    turned, norms = book.T.astype(float), (book.astype(float) ** 2).sum(1)
    for a in range(0, len(x), BLOCK):
        rows = x[a : a + BLOCK]
        if by_products:
            d = norms - 2 * (rows.astype(float) @ turned)
        else:
            d = np.stack([((rows - entry) ** 2).sum(1) for entry in book], axis=1)
        out[a : a + BLOCK] = d.argmin(1)
    return out


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _assigned(x: np.ndarray, books: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([nearest(part, book) for part, book in zip(np.split(x, len(books), axis=1), books, strict=True)], axis=1).astype(np.uint8)


def _bytes(codes: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in codes], pa.binary())


def _assign_rows(books: Sequence[np.ndarray]):
    width = sum(book.shape[1] for book in books)

    def run(batches):
        for batch in batches:
            columns = {c: batch.column(c) for c in ("vec_id", "label", "v")}
            yield pa.RecordBatch.from_pydict(columns | {"was": batch.column("now"), "now": _bytes(_assigned(_matrix(batch, width), books))})

    return run


def _change_rows(shape: tuple[int, int, int]):
    """Sums of what left (minus) and what came (plus), of a whole task; place -1 counts parts."""
    parts, entries, width = shape

    def run(batches):
        total = np.zeros((parts, entries, width + 1), dtype=np.int64)
        for batch in batches:
            x = np.split(_matrix(batch, parts * width), parts, axis=1)
            now = np.frombuffer(b"".join(batch.column("now").to_pylist()), dtype=np.uint8).reshape(-1, parts)
            had = batch.column("was").is_valid().to_numpy(zero_copy_only=False)
            was = np.zeros_like(now)
            was[had] = np.frombuffer(b"".join(batch.column("was").drop_null().to_pylist()), dtype=np.uint8).reshape(-1, parts)
            for p in range(parts):
                moved = ~had | (was[:, p] != now[:, p])
                for sign, rows, entry in ((1, moved, now[:, p]), (-1, moved & had, was[:, p])):
                    of = entry[rows]
                    total[p, :, 0] += sign * np.bincount(of, minlength=entries)
                    for j in range(width):  # a batch's sums are whole doubles
                        total[p, :, j + 1] += sign * np.bincount(of, x[p][rows, j], entries).astype(np.int64)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"part": pa.array(at[0], pa.int32()), "entry": pa.array(at[1], pa.int32()), "place": pa.array(at[2] - 1, pa.int32()), "total": pa.array(total[at])})

    return run


def _moved(books: Sequence[np.ndarray], sums: DataFrame) -> list[np.ndarray]:
    """The codebooks' entries at the floors of their parts' means; entries without parts stay."""
    parts, entries, width = len(books), *books[0].shape
    held = np.zeros((parts, entries, width + 1), dtype=np.int64)
    for r in sums.collect():  # at most parts * entries * (width + 1) numbers
        held[r["part"], r["entry"], r["place"] + 1] = r["total"]
    n = held[:, :, :1]
    return list(np.where(n > 0, held[:, :, 1:] // np.maximum(n, 1), np.stack(books)))


def fit_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """The vectors that take part with their last assignments (vec_id, label, v, was, now), and the codebooks after `rounds`.

    The codebooks start as the parts of the vectors of smallest vec_id. A round without changes ends the work, as all later
    ones would be the same.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a part's code is one byte: there can be 1 to 256 entries")
    small_batches(vectors.sparkSession)
    kept, books = first_codebooks(kept_vectors(vectors, parts, scale), parts, entries)
    table, sums, spent = kept.withColumn("now", F.lit(None).cast("binary")), None, []
    if not books:
        return table.withColumn("was", F.col("now")), books
    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    schema = f"vec_id long, label {types['label']}, v array<int>, was binary, now binary"
    for _ in range(rounds):
        table = materialize(table.mapInArrow(_assign_rows(books), schema), "assigned", *spent)
        spent = [table]
        changed = table.where(~F.col("was").eqNullSafe(F.col("now"))).select("v", "was", "now")
        changes = changed.mapInArrow(_change_rows((parts, *books[0].shape)), SUMS)
        if sums is not None and not changed.limit(1).count():
            break
        old = sums
        sums = (changes if old is None else old.union(changes)).groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))
        sums = materialize(sums, "sums", *([old] if old is not None else []))
        books = _moved(books, sums)
    if sums is not None:
        drop(sums)
    return table, books


def digest(books: Sequence[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def _code_rows(books: Sequence[np.ndarray]):
    width = sum(book.shape[1] for book in books)

    def run(batches):
        for batch in batches:
            x = _matrix(batch, width)
            codes = _assigned(x, books)
            error = sum(((part - book[codes[:, p]]) ** 2).sum(1) for p, (part, book) in enumerate(zip(np.split(x, len(books), axis=1), books, strict=True)))
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "code": pa.array([c.tobytes().hex() for c in codes], pa.string()), "error": pa.array(error.astype(np.int64))})

    return run


def encode(table: DataFrame, books: Sequence[np.ndarray]) -> DataFrame:
    """vec_id, label, code and error (squared distance to what the code stands for) of a table of vec_id, label and v."""
    label = dict(table.dtypes)["label"]
    schema = f"vec_id long, label {label}, code string, error long"
    if not len(books):
        return table.sparkSession.createDataFrame([], schema)
    return table.select("vec_id", "label", "v").mapInArrow(_code_rows(books), schema)


def decode(codes: DataFrame, books: Sequence[np.ndarray], scale: int = SCALE) -> DataFrame:
    """codes with a last column, embedding: the vector that a code stands for."""
    width = sum(book.shape[1] for book in books)
    flat = [np.asarray(book) / scale for book in books]

    @F.pandas_udf("array<double>")
    def back(code):
        return code.map(lambda c: None if c is None else np.concatenate([book[i] for book, i in zip(flat, bytes.fromhex(c), strict=True)]) if width else [])

    name = free_name("embedding", codes.columns)
    return codes.withColumn(name, back(F.col("code")))


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each vector that takes part.

    Null vectors, vectors with a null or non-finite component, and vectors whose width `parts` doesn't divide (empty ones too)
    are left out; so are those of another width than the vector of smallest vec_id, and those with a component so large that
    squared distances would pass 64 bits (for 64 components: 131,072 and more, before scaling by 1,024). Repeated rows and
    vec_ids are vectors of their own; null vec_ids come last. Fewer vectors than entries make smaller codebooks. Rows of null
    label form one group. Other columns are ignored; an empty table gives no rows.
    """
    table, books = fit_codebooks(vectors, parts, entries, rounds, scale)
    coded = materialize(encode(table, books), "codes")
    if hasattr(table, "written_at"):
        drop(table)
    labels = materialize(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    # a common label would put its rows into one task; beyond the bound AQE splits such a join
    if labels.count() <= BROADCAST_IDS:
        labels = F.broadcast(labels)
    found = coded.join(labels, coded["label"].eqNullSafe(labels["of"]))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
