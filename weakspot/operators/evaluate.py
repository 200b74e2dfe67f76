"""Aggregates over regions and groups. Totals are taken once; what lies outside a region is total minus inside."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import edges_at_most
from ..functions.scoring import entropy, log_score
from .ordering import exact_quantiles, running_sums


#: Vectors of a block in energy_distance: at least so many, in this number of blocks a side until they hold the most. A block
#: meets all others, so what is moved grows with the number of blocks.
ENERGY_BLOCK, ENERGY_BLOCKS, ENERGY_MOST = 512, 8, 32_768
#: Vectors of a block that are multiplied at once.
ENERGY_TILE = 1024


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def totals(rows: DataFrame, loss: str) -> DataFrame:
    """One row: n, total."""
    return rows.agg(F.count(loss).alias("n"), F.sum(loss).alias("total"))


def fold_totals(rows: DataFrame, fold: str, loss: str) -> DataFrame:
    """fold, n, total; raises where a fold has fewer than two rows."""
    out = rows.groupBy(fold).agg(F.count("*").alias("n"), F.sum(loss).alias("total"))
    return out.withColumn("n", F.when(F.col("n") >= 2, F.col("n")).otherwise(F.raise_error(F.lit("a fold has fewer than two rows")).cast("long")))


def measure(members: DataFrame, rows: DataFrame, key: str, loss: str, tau: float) -> DataFrame:
    """cand, m, contrast, mean_in, mean_out, sd_in, tail_rate, var_in of each region of the membership relation.

    contrast = mean_in / mean_out - 1. Regions of fewer than two rows, of all rows, or without loss outside give null contrast.
    """
    inside = members.select("cand", key).join(rows.select(key, loss), key).groupBy("cand").agg(
        F.count("*").alias("m"), F.sum(loss).alias("s"), F.stddev_samp(loss).alias("sd_in"), F.var_samp(loss).alias("var_in"), F.avg((F.col(loss) > tau).cast("double")).alias("tail_rate")
    )
    out = inside.crossJoin(F.broadcast(totals(rows, loss)))
    mean_out = ratio(F.col("total") - F.col("s"), (F.col("n") - F.col("m")).cast("double"))
    out = out.withColumn("mean_in", F.col("s") / F.col("m")).withColumn("mean_out", mean_out)
    valid = (F.col("m") >= 2) & (F.col("m") < F.col("n")) & (F.col("mean_out") > 0)
    return out.select("cand", "m", F.when(valid, F.col("mean_in") / F.col("mean_out") - 1).alias("contrast"), "mean_in", "mean_out", "sd_in", "tail_rate", "var_in")


def loss_reads(n: int, sizes: Sequence[int], replicates: int = 0) -> int:
    """Losses that a run reads: n once for the totals, m for each measured region and once more where it is replicated."""
    return n + sum(sizes) * (1 + (replicates > 0))


def replicates(members: DataFrame, rows: DataFrame, key: str, loss: str, fold: str) -> DataFrame:
    """cand, folds, se, floor: the contrast with each fold left out, inside and outside; jackknife error and least value."""
    inside = members.select("cand", key).join(rows.select(key, fold, loss), key).groupBy("cand", fold).agg(F.count("*").alias("m"), F.sum(loss).alias("s"))
    by_fold = rows.groupBy(fold).agg(F.count("*").alias("n"), F.sum(loss).alias("t"))
    cells = inside.select("cand").distinct().crossJoin(F.broadcast(by_fold)).join(inside, ["cand", fold], "left").fillna(0, ["m", "s"])
    all_of = Window.partitionBy("cand")
    left = lambda c: F.sum(c).over(all_of) - F.col(c)
    cells = cells.select("cand", left("m").alias("m"), left("s").alias("s"), left("n").alias("n"), left("t").alias("t"))
    mean_out = ratio(F.col("t") - F.col("s"), (F.col("n") - F.col("m")).cast("double"))
    value = ratio(ratio(F.col("s"), F.col("m").cast("double")), mean_out) - 1
    out = cells.withColumn("v", value).groupBy("cand").agg(F.count("v").alias("folds"), F.var_pop("v").alias("q"), F.min("v").alias("floor"))
    k = F.col("folds")
    return out.select("cand", "folds", F.when(k >= 2, F.sqrt((k - 1) * F.col("q"))).alias("se"), F.when(k >= 2, F.col("floor")).alias("floor"))


def pooled_variance(measured: DataFrame) -> DataFrame:
    return measured.where("var_in is not null and not isnan(var_in)").agg(F.avg("var_in").alias("pooled"))


def cluster_summary(rows: DataFrame, cluster: str, y: str, loss: str) -> DataFrame:
    """Each cluster against the rest: n, share, brier, rest_brier, excess, gap, se, low, high, inflation, prevalence."""
    squared = F.sum(F.col(loss) * F.col(loss))
    part = rows.groupBy(cluster).agg(F.count("*").alias("n"), F.sum(loss).alias("s"), squared.alias("q"), F.avg(y).alias("prevalence"))
    out = part.crossJoin(F.broadcast(rows.agg(F.count("*").alias("all_n"), F.sum(loss).alias("all_s"), squared.alias("all_q"))))
    n, rest = F.col("n"), F.col("all_n") - F.col("n")
    b1, b0 = F.col("s") / n, ratio(F.col("all_s") - F.col("s"), rest.cast("double"))
    v1 = ratio(F.col("q") - n * b1 * b1, (n - 1).cast("double"))
    v0 = ratio(F.col("all_q") - F.col("q") - rest * b0 * b0, (rest - 1).cast("double"))
    se = F.sqrt(v1 / n + ratio(v0, rest.cast("double")))
    return out.select(
        cluster, "n", (n / F.col("all_n")).alias("share"), b1.alias("brier"), b0.alias("rest_brier"), (b1 - F.col("all_s") / F.col("all_n")).alias("excess"),
        (b1 - b0).alias("gap"), se.alias("se"), (b1 - b0 - 1.96 * se).alias("low"), (b1 - b0 + 1.96 * se).alias("high"), (ratio(b1, b0) - 1).alias("inflation"), "prevalence",
    )


def auc(rows: DataFrame, y: str, p: str, by: Sequence[str] = (), digits: int = 10) -> DataFrame:
    """ROC AUC from counts of each distinct rounded score, ties averaged; null where one class is missing.

    The running count of negatives is taken over distinct scores, not rows, and without groups over all partitions at once.
    """
    by = list(by)
    level = rows.groupBy(*by, F.round(p, digits).alias("_p")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    if by:
        below = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    else:
        level = running_sums(level, ["_p"], {"under": F.col("neg")}).withColumn("under", F.col("under") - F.col("neg"))
    won = F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2.0))
    return level.groupBy(*by).agg(ratio(won, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def cluster_metrics(rows: DataFrame, cluster: str, y: str, p: str, loss: str) -> DataFrame:
    """cluster_summary with the cluster's AUC and the overall prevalence."""
    overall = rows.agg(F.avg(y).alias("overall_prevalence"))
    return cluster_summary(rows, cluster, y, loss).join(auc(rows, y, p, [cluster]), cluster, "left").crossJoin(F.broadcast(overall))


def cluster_weakness(rows: DataFrame, cluster: str, y: str, p: str, base_p: str, clusters: int) -> DataFrame:
    """Each of `clusters` numbers, also empty ones: n, rate, mean_pred, entropy, score, base_score, improvement, lift, coverage."""
    part = rows.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(y).alias("rate"), F.avg(p).alias("mean_pred"), F.avg(log_score(y, p)).alias("score"), F.avg(log_score(y, base_p)).alias("base_score"), F.sum(log_score(y, p)).alias("s"))
    all_rows = rows.agg(F.avg(log_score(y, p)).alias("mean"), F.sum(log_score(y, p)).alias("total"))
    out = rows.sparkSession.range(clusters).select(F.col("id").cast("int").alias(cluster)).join(part, cluster, "left").crossJoin(F.broadcast(all_rows))
    return out.select(
        cluster, F.coalesce("n", F.lit(0)).alias("n"), "rate", "mean_pred", entropy("rate").alias("entropy"), "score", "base_score",
        (F.col("score") - entropy("rate")).alias("excess"), (F.col("base_score") - F.col("score")).alias("improvement"), ratio(F.col("score"), F.col("mean")).alias("lift"), F.coalesce(ratio(F.col("s"), F.col("total")), F.lit(0.0)).alias("coverage"),
    )


def cluster_error_report(rows: DataFrame, cluster: str, y: str, p: str) -> DataFrame:
    """cluster, n, share, event_rate, mean_pred, logloss, logloss_ratio; worst first."""
    part = rows.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(y).alias("event_rate"), F.avg(p).alias("mean_pred"), F.avg(log_score(y, p)).alias("logloss"))
    out = part.crossJoin(F.broadcast(rows.agg(F.count("*").alias("all_n"), F.avg(log_score(y, p)).alias("mean"))))
    out = out.select(cluster, "n", (F.col("n") / F.col("all_n")).alias("share"), "event_rate", "mean_pred", "logloss", ratio(F.col("logloss"), F.col("mean")).alias("logloss_ratio"))
    return out.orderBy(F.desc("logloss"), cluster)


def lift_and_coverage(rows: DataFrame, loss: str, masks: dict[str, Column]) -> DataFrame:
    """region, support, lift, coverage: mean loss inside over the overall mean; share of the loss above it that lies inside.

    All masks are taken in one pass after the mean.
    """
    held = rows.crossJoin(F.broadcast(rows.agg(F.avg(loss).alias("_base"))))
    over = F.greatest(F.col(loss) - F.col("_base"), F.lit(0.0))
    cells = []
    for name, mask in masks.items():
        inside = F.coalesce(mask, F.lit(False))
        cells.append(F.struct(F.lit(name).alias("region"), F.count_if(inside).alias("support"), ratio(F.avg(F.when(inside, F.col(loss))), F.max("_base")).alias("lift"), ratio(F.coalesce(F.sum(F.when(inside, over)), F.lit(0.0)), F.sum(over)).alias("coverage")))
    return held.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def r_squared(rows: DataFrame, y: str, fitted: str) -> DataFrame:
    residual = F.sum((F.col(y) - F.col(fitted)) ** 2)
    spread = F.var_pop(y) * F.count(y)
    return rows.agg(F.sqrt(F.avg((F.col(y) - F.col(fitted)) ** 2)).alias("rmse"), (1 - ratio(residual, spread)).alias("r2"))


def average_ranks(df: DataFrame, column: str, alias: str, by: Sequence[str] = ()) -> DataFrame:
    """df with the rank of a column, ties averaged. The running count is over distinct values, which join back."""
    by = list(by)
    level = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_c"))
    if by:
        level = level.withColumn("_u", F.sum("_c").over(Window.partitionBy(*by).orderBy(column)))
    else:
        level = running_sums(level, [column], {"_u": F.col("_c")})
    level = level.select(*by, column, (F.col("_u") - (F.col("_c") - 1) / 2.0).alias(alias))
    return df.join(level, [*by, column], "left")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    ranked = average_ranks(average_ranks(df.select(a, b).dropna(), a, "_ra"), b, "_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("spearman"))


def histogram(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """bin, n over len(edges) + 1 bins with open ends, empty bins included."""
    cuts = F.array(*[F.lit(float(e)) for e in edges])
    found = df.where(F.col(column).isNotNull()).groupBy(edges_at_most(cuts, F.col(column)).alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin")).join(found, "bin", "left").fillna(0, ["n"])


def js_profile(rows: DataFrame, mask: Column, features: Sequence[str], bins: int = 10) -> DataFrame:
    """feature, js (bits), top_bin, region_share, rest_share, enrichment (their ratio), and region's and rest's means and medians: where region and rest differ, largest js first.

    Bins are cut at the distinct deciles of all rows. All features go through one long relation.
    """
    long = rows.select(mask.alias("inside"), F.explode(F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*features))).alias("feature", "x")).where("x is not null and inside is not null")
    cuts = exact_quantiles(long, ["feature"], "x", [i / bins for i in range(1, bins)], "cuts").withColumn("cuts", F.array_sort(F.array_distinct("cuts")))
    binned = long.join(F.broadcast(cuts), "feature").select("feature", "inside", edges_at_most(F.col("cuts"), F.col("x")).alias("bin"))  # one row a feature
    cell = binned.groupBy("feature", "bin").agg(F.count_if("inside").alias("a"), F.count_if(~F.col("inside")).alias("b"))
    all_of = Window.partitionBy("feature")
    p, q = ratio(F.col("a"), F.sum("a").over(all_of).cast("double")), ratio(F.col("b"), F.sum("b").over(all_of).cast("double"))
    cell = cell.select("feature", "bin", p.alias("p"), q.alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / F.col("m"))).otherwise(0.0)
    enriched = F.round(ratio(F.col("p"), F.col("q")), 10)
    best = F.max_by("bin", F.struct(F.coalesce(enriched, F.lit(-1.0)), -F.col("bin")))
    top = lambda x: F.max_by(x, F.struct(F.coalesce(enriched, F.lit(-1.0)), -F.col("bin")))
    js = cell.groupBy("feature").agg((F.sum(part("p") + part("q")) / 2).alias("js"), best.alias("top_bin"), top("p").alias("region_share"), top("q").alias("rest_share"), F.max(enriched).alias("enrichment"))
    means = [F.avg(F.when(F.col("inside"), F.col("x"))).alias("region_mean"), F.avg(F.when(~F.col("inside"), F.col("x"))).alias("rest_mean")]
    medians = exact_quantiles(long, ["feature", "inside"], "x", [0.5], "m").groupBy("feature").agg(*[F.max(F.when(side, F.get("m", F.lit(0)))).alias(f"{name}_median") for name, side in (("region", F.col("inside")), ("rest", ~F.col("inside")))])
    middle = long.groupBy("feature").agg(*means).join(medians, "feature")
    return js.join(middle, "feature").orderBy(F.desc("js"), "feature")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    pairs = lambda n: n * (n - 1) / 2.0
    cell = df.groupBy(a, b).agg(F.count("*").alias("c"))
    joint = cell.agg(F.sum(pairs(F.col("c"))).alias("joint"), F.sum("c").alias("n"))
    side = lambda x, name: cell.groupBy(x).agg(F.sum("c").alias("c")).agg(F.sum(pairs(F.col("c"))).alias(name))
    one = joint.crossJoin(side(a, "sa")).crossJoin(side(b, "sb"))
    chance = F.col("sa") * F.col("sb") / pairs(F.col("n"))
    return one.select(F.coalesce(ratio(F.col("joint") - chance, (F.col("sa") + F.col("sb")) / 2 - chance), F.lit(1.0)).alias("ari"))


def jaccard(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.agg(ratio(F.count_if(a & b), F.count_if(a | b).cast("double")).alias("jaccard"))


def _distance_sum(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> float:
    """Sum of n * m * |x - y| over all pairs: by a product of matrices, and exactly where that would cancel."""
    squares = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]
    d = np.maximum(squares - 2 * (x @ y.T), 0)
    near = np.nonzero(d < 1e-6 * squares)
    d[near] = ((x[near[0]] - y[near[1]]) ** 2).sum(1)
    return float(n @ np.sqrt(d) @ m)


def _tiled_sum(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> float:
    """The same by tiles, so that no matrix of a whole pair of blocks is held."""
    tiles = [(i, j) for i in range(0, len(x), ENERGY_TILE) for j in range(0, len(y), ENERGY_TILE)]
    return sum(_distance_sum(x[i : i + ENERGY_TILE], n[i : i + ENERGY_TILE], y[j : j + ENERGY_TILE], m[j : j + ENERGY_TILE]) for i, j in tiles)


def energy_blocks(n: int) -> int:
    """Blocks of a side of n distinct vectors."""
    return max(1, min(-(-n // ENERGY_BLOCK), ENERGY_BLOCKS), -(-n // ENERGY_MOST))


def energy_distance(a: DataFrame, b: DataFrame, vector: str) -> DataFrame:
    """2 E|A - B| - E|A - A'| - E|B - B'| over all pairs, for vectors of one length; null vectors are left out.

    The work is quadratic by definition. Equal vectors are one with a count; the distinct ones are dealt to blocks by hash, at
    most ENERGY_MOST in each, a task takes pairs of blocks as products of tiles, and only a sum for each pair leaves it. What
    is moved grows with the vectors while ENERGY_BLOCKS suffice (524,288 in all), then by each vector's meetings with blocks.
    """
    spark = a.sparkSession

    def packed(x: DataFrame, side: str, first: int) -> tuple[DataFrame, int]:
        once = x.where(F.col(vector).isNotNull()).groupBy(F.col(vector).alias("v")).agg(F.count("*").alias("n"))
        blocks = energy_blocks(once.count())

        def pack(part: pd.DataFrame) -> pd.DataFrame:
            x = np.array(part["v"].tolist(), dtype=float)
            return pd.DataFrame({"block": part["block"].iloc[:1].to_numpy(), "x": [x.tobytes()], "k": [part["n"].to_numpy(float).tobytes()]})

        dealt = once.withColumn("block", (F.pmod(F.xxhash64("v"), F.lit(blocks)) + first).cast("int"))
        return dealt.groupBy("block").applyInPandas(pack, "block int, x binary, k binary").withColumn("side", F.lit(side)), first + blocks

    left, split = packed(a, "a", 0)
    right, total = packed(b, "b", split)
    every = left.union(right)
    one, two = (every.select(*[F.col(c).alias(f"{c}{i}") for c in every.columns]) for i in (1, 2))
    # |x - y| is symmetric: pairs of a side's own blocks are met once and count twice
    pairs = spark.range(total * total).select((F.col("id") % total).cast("int").alias("block1"), F.floor(F.col("id") / total).cast("int").alias("block2")).where("block1 <= block2")
    met = pairs.join(one, "block1").join(two, "block2").repartition(min(total * (total + 1) // 2, 4096), "block1", "block2")

    def distances(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                n, m = np.frombuffer(r.k1), np.frombuffer(r.k2)
                x, y = np.frombuffer(r.x1).reshape(len(n), -1), np.frombuffer(r.x2).reshape(len(m), -1)
                twice = 2 if r.side1 == r.side2 and r.block1 != r.block2 else 1
                yield pd.DataFrame({"pair": [r.side1 + r.side2], "total": [twice * _tiled_sum(x, n, y, m)], "n": [twice * n.sum() * m.sum()]})

    sums = met.mapInPandas(distances, "pair string, total double, n double")
    mean = lambda p: F.try_divide(F.sum(F.when(F.col("pair") == p, F.col("total"))), F.sum(F.when(F.col("pair") == p, F.col("n"))))
    return sums.agg((2 * mean("ab") - mean("aa") - mean("bb")).alias("energy"))


def hypervolume(points: DataFrame, share: str, value: str) -> DataFrame:
    """Area under positive values over growing share; points are a frontier's few rows."""
    step = F.col(share) - F.coalesce(F.lag(share).over(Window.orderBy(share)), F.lit(0.0))
    return points.withColumn("_a", F.greatest(F.col(value), F.lit(0.0)) * step).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"))


def effective_sample(df: DataFrame, by: str, weight: str) -> DataFrame:
    w = F.sum(weight)
    return df.groupBy(by).agg(ratio(w * w, F.sum(F.col(weight) * F.col(weight))).alias("ess"))


def interval_coverage(df: DataFrame, y: str, mean: str, sd: str, z: float) -> DataFrame:
    inside = F.abs(F.col(y) - F.col(mean)) <= z * F.col(sd)
    return df.agg(F.avg(inside.cast("double")).alias("covered"), F.sqrt(F.avg((F.col(y) - F.col(mean)) ** 2)).alias("rmse"))
