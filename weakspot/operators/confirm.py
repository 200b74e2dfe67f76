"""Confirmation on fresh rows: influence-function and bootstrap intervals, and corrections for many claims."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import hash_uniform
from ..functions.digests import hash_numbers
from .evaluate import ratio


def critical_value(claims: int, alpha: float = 0.05) -> float:
    return NormalDist().inv_cdf(1 - alpha / (2 * claims))


def _split_means(rows: DataFrame, mask: Column, loss: str, tag: str) -> list[Column]:
    inside = F.coalesce(mask, F.lit(False))
    return [F.avg(inside.cast("double")).alias(f"pi{tag}"), F.avg(F.when(inside, F.col(loss))).alias(f"in{tag}"), F.avg(F.when(~inside, F.col(loss))).alias(f"out{tag}")]


def _influence(mask: Column, loss: str, tag: str) -> Column:
    m = F.coalesce(mask, F.lit(False)).cast("double")
    pi = F.col(f"pi{tag}")
    return ratio(m * (F.col(loss) - F.col(f"in{tag}")), pi) - ratio((1 - m) * (F.col(loss) - F.col(f"out{tag}")), 1 - pi)


def influence_interval(rows: DataFrame, mask: Column, loss: str, z: float) -> DataFrame:
    """One row: n, share, mean_in, mean_out, gap, se, low, high of the difference of means."""
    held = rows.crossJoin(F.broadcast(rows.agg(*_split_means(rows, mask, loss, ""))))
    psi = F.when(F.coalesce(mask, F.lit(False)), (F.col(loss) - F.col("in")) / F.col("pi")).otherwise(-(F.col(loss) - F.col("out")) / (1 - F.col("pi")))
    out = held.agg(F.count("*").alias("n"), F.first("pi").alias("share"), F.first("in").alias("mean_in"), F.first("out").alias("mean_out"), (F.stddev_samp(psi) / F.sqrt(F.count("*"))).alias("se"))
    gap = F.col("mean_in") - F.col("mean_out")
    return out.select("n", "share", "mean_in", "mean_out", gap.alias("gap"), "se", (gap - z * F.col("se")).alias("low"), (gap + z * F.col("se")).alias("high"))


def paired_interval(rows: DataFrame, a: Column, b: Column, loss: str, z: float) -> DataFrame:
    """Difference of two regions' gaps on the same rows, with the error of the rows' paired influence."""
    held = rows.crossJoin(F.broadcast(rows.agg(*_split_means(rows, a, loss, "1"), *_split_means(rows, b, loss, "2"))))
    psi = _influence(a, loss, "1") - _influence(b, loss, "2")
    out = held.agg(F.first((F.col("in1") - F.col("out1")) - (F.col("in2") - F.col("out2"))).alias("difference"), (F.stddev_samp(psi) / F.sqrt(F.count("*"))).alias("se"))
    return out.select("difference", "se", (F.col("difference") - z * F.col("se")).alias("low"), (F.col("difference") + z * F.col("se")).alias("high"))


#: Upper ends of the Poisson(1) distribution's steps, from 0 on.
def _poisson_steps(upto: int = 9) -> list[float]:
    out, total = [], 0.0
    for k in range(upto):
        total += math.exp(-1) / math.factorial(k)
        out.append(round(total, 12))
    return out


def poisson_weight(key: str, boot: Column, seed: str = "boot") -> Column:
    """A Poisson(1) weight for row and replicate, from a hash: the same on every attempt and in every engine."""
    u = hash_uniform(F.lit(seed), F.col(key).cast("string"), boot.cast("string"))
    return sum(((u >= s).cast("int") for s in _poisson_steps()), F.lit(0))


def _replicate_sums(boots: int, seed: str = "boot"):
    """A task's sums for each replicate, by the weights that poisson_weight() gives: n1, s1 inside, n, s of all rows, and how
    many losses are known inside (k1) and in all (k)."""
    least = [np.uint32(math.ceil(x * 2**32)) for x in _poisson_steps()]
    tails = [str(b).encode() for b in range(boots)]

    def sums(batches):
        total, k1, k, rows = np.zeros((boots, 4)), 0, 0, 0
        for batch in batches:
            loss, inside = batch.column("_l"), np.asarray(batch.column("_i").cast(pa.float64()))
            known, value = np.asarray(loss.is_valid()), np.asarray(loss.fill_null(0.0))
            # concat_ws() leaves a null key out
            heads = [f"{seed}|{x}|".encode() if x is not None else f"{seed}|".encode() for x in batch.column("_key").to_pylist()]
            of_row = np.stack([inside, np.where(inside > 0, value, 0.0), np.ones(len(value)), value], axis=1)
            for boot, places, numbers in hash_numbers(heads, tails):
                weight = np.zeros(len(places), dtype=np.uint8)
                for x in least:
                    weight += numbers >= x
                total[boot] += weight.astype(float) @ of_row[places]
            k1, k, rows = k1 + int((known & (inside > 0)).sum()), k + int(known.sum()), rows + batch.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(range(boots), pa.int32()), *map(pa.array, total.T), pa.array([k1] * boots, pa.int64()), pa.array([k] * boots, pa.int64())], names=["boot", "n1", "s1", "n", "s", "k1", "k"])

    return sums


def bootstrap_ratios(rows: DataFrame, key: str, mask: Column, loss: str, boots: int, against: str = "all") -> DataFrame:
    """boot, theta: mean loss inside over that of all rows (or of the rest), minus 1, in each Poisson replicate.

    Tasks weigh their rows for all replicates by poisson_weight()'s hashes, taken many at a time, so only boots x partitions
    rows move.
    """
    inside = F.coalesce(mask, F.lit(False))
    wide = rows.select(F.col(key).cast("string").alias("_key"), F.col(loss).cast("double").alias("_l"), inside.alias("_i"))
    found = wide.mapInArrow(_replicate_sums(boots), "boot int, n1 double, s1 double, n double, s double, k1 long, k long")
    parts = found.groupBy("boot").agg(*[F.sum(c).alias(c) for c in ("n1", "s1", "n", "s", "k1", "k")])
    parts = parts.withColumns({"s1": F.when(F.col("k1") > 0, F.col("s1")), "s": F.when(F.col("k") > 0, F.col("s"))})
    if against == "all":
        base = ratio(F.col("s"), F.col("n"))
    else:
        base = ratio(F.col("s") - F.col("s1"), F.col("n") - F.col("n1"))
    return parts.select("boot", (ratio(ratio(F.col("s1"), F.col("n1")), base) - 1).alias("theta"))


def percentile_interval(ratios: DataFrame, threshold: float, alpha: float = 0.05) -> DataFrame:
    """boots, undefined, low, high, passed (low over the threshold; false if any replicate is undefined)."""
    out = ratios.agg(F.count("*").alias("boots"), F.count_if(F.col("theta").isNull()).alias("undefined"), F.percentile("theta", alpha / 2).alias("low"), F.percentile("theta", 1 - alpha / 2).alias("high"))
    return out.withColumn("passed", (F.col("undefined") == 0) & (F.col("low") > threshold))


def confirm_inflation(rows: DataFrame, key: str, mask: Column, loss: str, threshold: float = 0.0, boots: int = 200, alpha: float = 0.05) -> DataFrame:
    if boots < 100:
        raise ValueError("give at least 100 replicates")
    return percentile_interval(bootstrap_ratios(rows, key, mask, loss, boots), threshold, alpha)


def jackknife(rows: DataFrame, mask: Column, loss: str) -> DataFrame:
    """theta and acceleration from the closed form of each row's leave-one-out ratio of inside to outside mean."""
    inside = F.coalesce(mask, F.lit(False))
    one = rows.agg(F.count_if(inside).alias("m"), F.sum(F.when(inside, F.col(loss))).alias("s"), F.count("*").alias("n"), F.sum(loss).alias("t"))
    held = rows.select(inside.alias("_i"), F.col(loss).alias("_l")).crossJoin(F.broadcast(one))
    m, s, n, t, x = (F.col(c) for c in ("m", "s", "n", "t", "_l"))
    rest_n, rest_s = n - m, t - s
    without_in = ratio(ratio(s - x, (m - 1).cast("double")), ratio(rest_s, rest_n.cast("double")))
    without_out = ratio(ratio(s, m.cast("double")), ratio(rest_s - x, (rest_n - 1).cast("double")))
    held = held.withColumn("v", F.when(F.col("_i"), without_in).otherwise(without_out))
    mean = held.agg(F.avg("v").alias("mv"), F.first(ratio(ratio(s, m.cast("double")), ratio(rest_s, rest_n.cast("double")))).alias("theta"), F.first("m").alias("support"))
    d = F.col("mv") - F.col("v")
    sums = held.select("v").crossJoin(F.broadcast(mean)).agg(F.first("theta").alias("theta"), F.first("support").alias("support"), F.sum(d * d * d).alias("c"), F.sum(d * d).alias("q"))
    return sums.select((F.col("theta") - 1).alias("theta"), "support", F.coalesce(ratio(F.col("c"), 6 * F.pow("q", F.lit(1.5))), F.lit(0.0)).alias("acceleration"))


def bca(rows: DataFrame, key: str, mask: Column, loss: str, margin: float = 0.0, boots: int = 400, alpha: float = 0.05, least: int = 30) -> dict:
    """Bias-corrected accelerated interval of the ratio contrast, and the p-value of contrast <= margin.

    Replicates and the jackknife are two aggregations; only the `boots` ratios and one row come to the driver.
    """
    at = jackknife(rows, mask, loss).first()
    if at["support"] < least or at["theta"] is None:
        return {"theta": at["theta"], "low": None, "high": None, "p": 1.0, "support": at["support"]}
    found = sorted(r["theta"] for r in bootstrap_ratios(rows, key, mask, loss, boots, "rest").collect() if r["theta"] is not None)
    n, normal, a = len(found), NormalDist(), at["acceleration"]
    if n < boots // 2:
        return {"theta": at["theta"], "low": None, "high": None, "p": 1.0, "support": at["support"]}
    share = lambda v: min(max(sum(x < v for x in found) / n, 1 / (n + 1)), n / (n + 1))
    z0 = normal.inv_cdf(share(at["theta"]))

    def end(q):
        z = z0 + normal.inv_cdf(q)
        place = normal.cdf(z0 + z / (1 - a * z)) * (n - 1)
        low = int(place)
        return found[low] + (place - low) * (found[min(low + 1, n - 1)] - found[low])

    z = normal.inv_cdf(share(margin)) - z0
    return {"theta": at["theta"], "low": end(alpha / 2), "high": end(1 - alpha / 2), "p": normal.cdf(z / (1 + a * z) - z0), "support": at["support"]}


def confirm_frozen(frozen, rows: DataFrame, key: str, loss: str, margin: float = 0.0, boots: int = 400, alpha: float = 0.05, least: int = 30) -> dict:
    """A frozen rule (anything with predicate()) tested on fresh rows: the interval and p-value of bca, and n, the rows given."""
    return bca(rows, key, frozen.predicate(), loss, margin, boots, alpha, least) | {"n": rows.count()}


def benjamini_hochberg(claims: DataFrame, key: str, p: str, alpha: float) -> DataFrame:
    """claims with adjusted and rejected; null p-values take no part. Claims are a study's list, so one window holds them."""
    known = claims.where(F.col(p).isNotNull() & ~F.isnan(p))
    order = Window.orderBy(p, key)
    every = Window.partitionBy()
    ranked = known.withColumn("_r", F.row_number().over(order)).withColumn("_g", F.count("*").over(every)).withColumn("_v", F.col(p) * F.col("_g") / F.col("_r"))
    adjusted = F.least(F.lit(1.0), F.min("_v").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    last = F.max(F.when(F.col("_v") <= alpha, F.col("_r"))).over(every)
    out = ranked.select(key, adjusted.alias("adjusted"), F.coalesce(F.col("_r") <= last, F.lit(False)).alias("rejected"))
    return claims.join(out, key, "left").fillna(False, ["rejected"])


def holm(claims: DataFrame, key: str, p: str, alpha: float) -> DataFrame:
    known = claims.where(F.col(p).isNotNull() & ~F.isnan(p))
    order = Window.orderBy(p, key)
    ranked = known.withColumn("_r", F.row_number().over(order)).withColumn("_v", F.col(p) * (F.count("*").over(Window.partitionBy()) - F.col("_r") + 1))
    adjusted = F.least(F.lit(1.0), F.max("_v").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = ranked.select(key, adjusted.alias("adjusted")).withColumn("rejected", F.col("adjusted") <= alpha)
    return claims.join(out, key, "left").fillna(False, ["rejected"])


def optimism(discovery: DataFrame, confirmation: DataFrame, key: str) -> DataFrame:
    """key, discovery, confirmation, optimism of each finalist."""
    return discovery.select(key, F.col("value").alias("discovery")).join(confirmation.select(key, F.col("value").alias("confirmation")), key).withColumn("optimism", F.col("discovery") - F.col("confirmation"))


def prevalence_floor(n: int, least: int, z: float, grid: int = 20_000) -> float:
    """The smallest prevalence on a grid at which n rows hold `least` events with the normal lower bound at z."""
    for i in range(1, grid + 1):
        p = i / grid
        if n * p - z * (n * p * (1 - p)) ** 0.5 >= least:
            return p
    return 1.0
