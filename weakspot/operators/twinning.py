"""Statistically similar parts of a table: rows are cut into small blocks at exact medians, and in each block a nearest-neighbour chain deals them.

The chains are those of data twinning (Vakayil and Joseph, 2022); a block bounds a chain's work, which grows with its square.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch
from .ordering import row_numbers

BLOCK = 2048
#: Blocks up to this many are broadcast with their bounds (a few numbers each); more are joined by a shuffle.
MOST_BROADCAST = 100_000


def _few(df: DataFrame, count: int) -> DataFrame:
    return F.broadcast(df) if count <= MOST_BROADCAST else df


def blocks(df: DataFrame, key: str, features: Sequence[str], levels: int) -> DataFrame:
    """df with block: `levels` times, every block is halved at the median rank of its widest feature, ties by key.

    So blocks of one level differ by one row at most, however many rows share a value. All blocks of a level are ranked by one
    sort of the whole table in the order of block, value and key, over range partitions; the level is then written out.
    Where the features' widths are equal the first one counts; the larger half is the lower one. Keys must not repeat.
    """
    spark = df.sparkSession
    out = df.withColumn("block", F.lit(0).cast("long"))
    for level in range(levels):
        widths = out.groupBy("block").agg(*[(F.max(f) - F.min(f)).alias(f"_w_{i}") for i, f in enumerate(features)])
        widest = F.array_max(F.array(*[F.col(f"_w_{i}") for i in range(len(features))]))
        value = F.lit(None).cast("double")
        for i, f in reversed(list(enumerate(features))):
            value = F.when(F.col(f"_w_{i}") == widest, F.col(f).cast("double")).otherwise(value)
        valued = out.join(_few(widths, 1 << level), "block").select(*df.columns, "block", value.alias("_v"))
        placed = row_numbers(valued, ["block", "_v", key], "_place")
        bounds = placed.groupBy("block").agg(F.min("_place").alias("_from"), F.count("*").alias("_n"))
        upper = 2 * (F.col("_place") - F.col("_from")) >= F.col("_n")
        out = placed.join(_few(bounds, 1 << level), "block").withColumn("block", 2 * F.col("block") + upper.cast("long")).select(*df.columns, "block")
        path = scratch(spark, "blocks")
        out.write.parquet(path)
        out = spark.read.schema(out.schema).parquet(path)
    return out


def levels_for(n: int, block: int) -> int:
    """Halvings that leave at least half of `block` rows, and at most `block`, in every block."""
    return max(0, int(np.ceil(np.log2(max(n, 1) / block))))


def _squared(x: np.ndarray, at: int) -> np.ndarray:
    return ((x - x[at]) ** 2).sum(axis=1)


def nearest_chain(x: np.ndarray) -> np.ndarray:
    """Rows from the one nearest the mean on, each time to the nearest row left; the first among equals."""
    order, left = [], np.ones(len(x), dtype=bool)
    at = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    while True:
        order.append(at)
        left[at] = False
        if len(order) == len(x):
            return np.array(order)
        at = int(np.where(left, _squared(x, at), np.inf).argmin())


def twin_chain(x: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds and order of visits: from the row farthest from the mean, a seed takes its r - 1 nearest rows with it, and the row
    nearest to the last of them is the next seed."""
    order: list[int] = []
    seeds = []
    left = np.ones(len(x), dtype=bool)
    at = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()) if len(x) else 0
    while left.any():
        seeds.append(at)
        left[at] = False
        d = np.where(left, _squared(x, at), np.inf)
        near = np.argsort(d, kind="stable")[: min(r - 1, int(left.sum()))]
        left[near] = False
        order += [at, *near.tolist()]
        if left.any():
            at = int(np.where(left, _squared(x, order[-1]), np.inf).argmin())
    return np.array(seeds, dtype=int), np.array(order, dtype=int)


def multiplets_of(x: np.ndarray, k: int, strategy: int) -> np.ndarray:
    """The part of each row of a block: 1 peels a twin of one row in k - i at a time, 2 halves again and again, 3 deals one chain."""
    part = np.zeros(len(x), dtype=np.int32)
    if strategy == 3:
        _, order = twin_chain(x, k)
        part[order] = np.arange(len(x)) % k
    elif strategy == 1:
        rest = np.arange(len(x))
        for i in range(k - 1):
            seeds, _ = twin_chain(x[rest], k - i)
            part[rest[seeds]] = i
            rest = np.delete(rest, seeds)
        part[rest] = k - 1
    else:
        groups = [np.arange(len(x))]
        while len(groups) < k:
            halves = []
            for g in groups:
                seeds, _ = twin_chain(x[g], 2)
                halves += [g[np.sort(seeds)], np.delete(g, seeds)]
            groups = halves
        for i, g in enumerate(groups):
            part[g] = i
    return part


def _dealt(df: DataFrame, key: str, features: Sequence[str], block: int, deals: dict) -> DataFrame:
    """df with what each of deals (by name of its column) gives for the standardised rows of each block, in the order of their keys; constant features are 0."""
    levels = levels_for(df.count(), block)
    stats = df.agg(*[F.avg(f).alias(f"_a_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    z = [((F.col(f) - F.col(f"_a_{f}")) / F.when(F.col(f"_s_{f}") > 0, F.col(f"_s_{f}")).otherwise(1.0)).alias(f"_z_{f}") for f in features]
    ready = blocks(df.crossJoin(F.broadcast(stats)).select(key, *z), key, [f"_z_{f}" for f in features], levels)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        x = rows[[f"_z_{f}" for f in features]].to_numpy(float)
        return pd.DataFrame({key: rows[key].to_numpy(), **{name: deal(x) for name, deal in deals.items()}})

    # a block is much work for few bytes, so its number of tasks doesn't follow the shuffle's size
    ready = ready.repartition(min(1 << levels, 4096), "block")
    found = ready.groupBy("block").applyInPandas(one, ", ".join([f"{key} {dict(df.dtypes)[key]}", *(f"{name} int" for name in deals)]))
    return df.drop(*deals).join(found, key)


def twin_folds(df: DataFrame, key: str, features: Sequence[str], k: int, block: int = BLOCK) -> DataFrame:
    """df with fold: in each block the chain starts at the row nearest the mean and always goes on to the nearest row left.

    Blocks hold about `block` rows, so a task's work is bounded; features are standardised over all rows.
    """

    def deal(x):
        fold = np.zeros(len(x), dtype=np.int32)
        fold[nearest_chain(x)] = np.arange(len(x)) % k
        return fold

    return _dealt(df, key, features, block, {"fold": deal})


def multiplets(df: DataFrame, key: str, features: Sequence[str], k: int, strategy: int = 1, block: int = BLOCK) -> DataFrame:
    """df with part, 0 .. k - 1: disjoint parts that are distributed alike, by one of three strategies in each block.

    1 is the best and costs k - 1 chains, 2 needs a power of 2, 3 is one chain. Parts of a block differ by one row at most
    with 2 and 3 (of two halves the first is the larger), and with 1 too. Keys must not repeat and features not be null.
    """
    return every_multiplets(df, key, features, k, (strategy,), block).withColumnRenamed(f"part_{strategy}", "part")


def every_multiplets(df: DataFrame, key: str, features: Sequence[str], k: int, strategies: Sequence[int] = (1, 2, 3), block: int = BLOCK) -> DataFrame:
    """df with part_1, part_2, part_3: multiplets() by each of the strategies, over blocks that are cut once for all."""
    if not set(strategies) <= {1, 2, 3}:
        raise ValueError("the strategy is 1, 2 or 3")
    if k < 2 or 2 * k > block:
        raise ValueError("k must be at least 2, and a block hold at least twice as many rows")
    if 2 in strategies and k & (k - 1):
        raise ValueError("strategy 2 needs a power of 2")
    return _dealt(df.drop("part"), key, features, block, {f"part_{s}": lambda x, s=s: multiplets_of(x, k, s) for s in strategies})


def twin_split(df: DataFrame, key: str, features: Sequence[str], ratio: int, block: int = BLOCK) -> DataFrame:
    """df with twin: one row in `ratio` of each block (rounded up), spread like the whole: the seeds of its chain."""
    if ratio < 2 or 2 * ratio > block:
        raise ValueError("the ratio must be at least 2, and a block hold at least twice as many rows")

    def deal(x):
        out = np.zeros(len(x), dtype=np.int32)
        out[twin_chain(x, ratio)[0]] = 1
        return out

    return _dealt(df, key, features, block, {"twin": deal}).withColumn("twin", F.col("twin") == 1)


def fold_archive(df: DataFrame, key: str, features: Sequence[str], k: int, n: int, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """place, fold, and the features of n rows drawn from k multiplets in turn; within a part by the hash of seed and key.

    Each part's hashes are ranked under a group limit, so a task keeps n rows of a part at most.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), key), key)
    ranked = multiplets(df, key, features, k, 3, block).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= -(-n // k))
    place = (F.col("_r") - 1) * k + F.col("part")
    return ranked.withColumn("place", place.cast("int")).where(F.col("place") < n).select("place", F.col("part").alias("fold"), key, *features)
