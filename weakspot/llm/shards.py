"""Sharding by a keyed permutation of global row numbers.

Rows are numbered by their order in the whole table: a range exchange sorts the keys, each written partition counts its rows,
and the counts of the partitions before it (one number a partition) turn a row's place into its number. A Feistel network over
the least power of two that holds all numbers, walked along its cycle until it is back among them, permutes the numbers. The
permuted number divided by the count of shards gives slot and shard. So shards differ by one row at most, and either way of
the mapping can be computed from the number of rows and the seed, with no table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, free_name, materialize, mix

SHARDS = 40
#: Feistel rounds; an even number, so that the halves get their widths back.
ROUNDS = 8
#: Bytes that a row counts besides its text.
ROW_BYTES = 16
#: monotonically_increasing_id holds the partition above this many bits and the row's place in it below.
PLACE_BITS = 33


class Permutation:
    """A permutation of 0 .. n - 1 that n and the seed decide."""

    def __init__(self, n: int, seed: int = 0):
        bits = max(2, int(n - 1).bit_length())
        self.n, self.low, self.high = n, bits // 2, bits - bits // 2
        self.keys = mix(np.arange(ROUNDS, dtype=U64), seed)

    def _step(self, x: np.ndarray) -> np.ndarray:
        a, b = self.low, self.high  # widths of left and right
        left, right = x >> U64(b), x & U64((1 << b) - 1)
        for key in self.keys:
            left, right = right, left ^ (mix(right ^ key) & U64((1 << a) - 1))
            a, b = b, a
        return left << U64(b) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        a, b = self.low, self.high
        left, right = x >> U64(b), x & U64((1 << b) - 1)
        for key in self.keys[::-1]:
            a, b = b, a
            left, right = right ^ (mix(left ^ key) & U64((1 << a) - 1)), left
        return left << U64(b) | right

    def _walk(self, step, x) -> np.ndarray:
        out = np.asarray(x).astype(U64)
        live = np.arange(len(out))
        while len(live):
            out[live] = step(out[live])
            live = live[out[live] >= U64(self.n)]
        return out.astype(np.int64)

    def __call__(self, x) -> np.ndarray:
        """The permuted numbers of an array of numbers under n."""
        return self._walk(self._step, x)

    def inverse(self, x) -> np.ndarray:
        return self._walk(self._back, x)


def place_of(numbers, n: int, shards: int = SHARDS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers in a table of n rows."""
    at = Permutation(n, seed)(numbers)
    return at % shards, at // shards


def number_at(shard, slot, n: int, shards: int = SHARDS, seed: int = 0) -> np.ndarray:
    """The row numbers at places (arrays of shard and slot) of a table of n rows."""
    return Permutation(n, seed).inverse(np.asarray(slot) * shards + np.asarray(shard))


def placed(rows: DataFrame, order: Sequence[Column], shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """rows with columns shard and slot as the last ones, numbered by `order`.

    Rows that are equal in `order` are dealt by their place in the input, so that a value which many rows share fills several
    partitions; which of them gets which number is then free, so `order` should tell apart all rows that differ.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")
    tie, place = free_name("_tie", rows.columns), free_name("_place", rows.columns)
    keys = [free_name(f"_order{i}", rows.columns) for i in range(len(order))]
    by = [*keys, tie]
    held = materialize(rows.withColumns(dict(zip(keys, order, strict=True))).withColumn(tie, F.monotonically_increasing_id()), "rows")
    ranged = held.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(place, F.monotonically_increasing_id())
    ranged = materialize(ranged.drop(*by), "ranged", held)
    part = F.shiftright(F.col(place), PLACE_BITS)
    counts = {r["part"]: r["n"] for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row a partition
    before = np.zeros(max(counts, default=0) + 2, dtype=np.int64)
    for p, n in counts.items():
        before[p + 1] = n
    before = before.cumsum()
    n = int(before[-1])

    @F.pandas_udf("shard int, slot long")
    def where(at: pd.Series) -> pd.DataFrame:
        at = at.to_numpy()
        shard, slot = place_of(before[at >> PLACE_BITS] + (at & ((1 << PLACE_BITS) - 1)), n, shards, seed)
        return pd.DataFrame({"shard": shard.astype(np.int32), "slot": slot})

    to = free_name("_to", rows.columns)
    return ranged.withColumn(to, where(F.col(place))).select(*rows.columns, f"{to}.shard", f"{to}.slot")


def _order() -> list[Column]:
    """doc_id first, then what tells its rows apart by text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.col("doc_id").cast("long"), F.octet_length(text).cast("long"), F.crc32(text), F.xxhash64(text)]


def shard_plan(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs; texts don't travel.

    law is `rows`: the shards' counts are one apart at most, slots count from 0 without gaps, and grown_shard is null. size is
    the text's UTF-8 bytes and 16; a null text has none. Null doc_ids come first in the numbering; rows of one doc_id go by
    their texts, and repeated rows get places of their own. Other columns are ignored; an empty table gives no rows.
    """
    id_, size, crc, tie = _order()
    slim = docs.select(id_.alias("doc_id"), (size + ROW_BYTES).alias("size"), crc.alias("text_crc32"), tie.alias("tie"))
    found = placed(slim, [F.col(c) for c in slim.columns], shards, seed)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """All columns of docs with the shard and slot of shard_plan; docs' own columns of these names are left out."""
    held = docs.drop(*[c for c in docs.columns if c.lower() in ("shard", "slot")])
    return placed(held, _order(), shards, seed)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 0) -> None:
    """Writes docs to path, a folder `shard=<number>` a shard; a shard's files, by name, hold its rows in the order of slots.

    A shard may have several files, so that no task holds a whole one. An empty table gives no shards.
    """
    sharded(docs, shards, seed).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
