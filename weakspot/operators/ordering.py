"""Running sums and ranks over a whole table in one order, without gathering it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch


def running_sums(df: DataFrame, order: Sequence[str | Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of its column over all rows before and including the row in the order.

    The rows are range-partitioned, sorted and written once, so that each row's partition and place are fixed; partitions add
    the totals of those before them (one row a partition). Rows equal in the order have any order among themselves.
    """
    spark = df.sparkSession
    path = scratch(spark, "ordered")
    values = {f"_v_{n}": c for n, c in sums.items()}
    placed = df.withColumns(values).orderBy(*order).withColumn("_m", F.monotonically_increasing_id())
    placed.write.parquet(path)
    # the upper bits of the number are the partition in which the row was written
    held = spark.read.schema(placed.schema).parquet(path).withColumn("_p", F.shiftright("_m", 33))
    totals = held.groupBy("_p").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in zip(sums, values, strict=True)])
    before = Window.orderBy("_p")
    totals = totals.select("_p", *[(F.sum(f"_t_{n}").over(before) - F.col(f"_t_{n}")).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy("_p").orderBy("_m")
    out = held.join(F.broadcast(totals), "_p")
    return out.withColumns({n: F.sum(f"_v_{n}").over(inside) + F.col(f"_o_{n}") for n in sums}).select(*df.columns, *sums)


def row_numbers(df: DataFrame, order: Sequence[str | Column], alias: str = "place") -> DataFrame:
    """df with each row's 1-based place in the order."""
    return running_sums(df, order, {alias: F.lit(1).cast("long")})


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], alias: str = "quantiles") -> DataFrame:
    """by, and an array of the interpolated quantiles of each group's values, nulls aside; groups are few (their sizes are broadcast).

    Distinct values are counted and ordered over range partitions, so no task holds a group's values; of each group only the
    two rows around each quantile are gathered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    upto = running_sums(counts, [*by, value], {"_u": F.col("_c")})
    sizes = upto.groupBy(*by).agg(F.sum("_c").alias("_n"), (F.max("_u") - F.sum("_c")).alias("_from"))
    ranks = []
    for i, share in enumerate(shares):
        at = (F.col("_n") - 1) * F.lit(float(share))
        ranks += [F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), f(at).cast("long").alias("rank")) for side, f in ((0, F.floor), (1, F.ceil))]
    held = upto.join(F.broadcast(sizes), list(by)) if by else upto.crossJoin(F.broadcast(sizes))
    end = F.col("_u") - F.col("_from")
    found = held.select(*by, "_n", F.col(value).cast("double").alias("_v"), F.inline(F.filter(F.array(*ranks), lambda r: (r["rank"] < end) & (r["rank"] >= end - F.col("_c")))))
    ends = found.groupBy(*by, "_n", "i").agg(F.min(F.when(F.col("side") == 0, F.col("_v"))).alias("a"), F.min(F.when(F.col("side") == 1, F.col("_v"))).alias("b"))
    share = F.get(F.array(*[F.lit(float(s)) for s in shares]), F.col("i"))
    at = (F.col("_n") - 1) * share
    one = ends.select(*by, "i", (F.col("a") + (F.col("b") - F.col("a")) * (at - F.floor(at))).alias("q"))
    return one.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias(alias))
