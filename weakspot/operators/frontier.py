"""Overlap of regions, nondominated sets, ownership shares, and lookups along search histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import lift_and_coverage, ratio


def overlaps(members: DataFrame, key: str) -> DataFrame:
    """a, b, shared, overlap: rows that two regions share, also as a share of a's rows; pairs without any are left out."""
    m = members.select("cand", key)
    sizes = m.groupBy("cand").agg(F.count("*").alias("m"))
    shared = m.withColumnRenamed("cand", "a").join(m.withColumnRenamed("cand", "b"), key).groupBy("a", "b").agg(F.count("*").alias("shared"))
    return shared.join(sizes.withColumnRenamed("cand", "a"), "a").select("a", "b", "shared", (F.col("shared") / F.col("m")).alias("overlap"))


def archive_overlap(members: DataFrame, archive: DataFrame, key: str) -> DataFrame:
    """cand, overlap: the largest share of its rows that a candidate has in common with one archived region; 0 if none."""
    sizes = members.groupBy("cand").agg(F.count("*").alias("m"))
    shared = members.select("cand", key).join(archive.select(F.col("cand").alias("other"), key), key).groupBy("cand", "other").agg(F.count("*").alias("c"))
    return sizes.join(shared.groupBy("cand").agg(F.max("c").alias("c")), "cand", "left").select("cand", F.coalesce(F.col("c") / F.col("m"), F.lit(0.0)).alias("overlap"))


def resampling_covariance(over: DataFrame, measured: DataFrame, s2: float) -> DataFrame:
    """a, b, covariance of two regions' contrasts: s2 * overlap / (m * mean_out of a * mean_out of b)."""
    one = measured.select(F.col("cand").alias("a"), F.col("m"), F.col("mean_out").alias("oa"))
    two = measured.select(F.col("cand").alias("b"), F.col("mean_out").alias("ob"))
    return over.join(one, "a").join(two, "b").select("a", "b", (s2 * F.col("overlap") / (F.col("m") * F.col("oa") * F.col("ob"))).alias("covariance"))


def distinct_regions(ranked: list, shared: dict[tuple, float], most: float) -> list:
    """Greedy in rank order: a region stays if it overlaps no kept one over `most`. For a search's few hundred regions."""
    kept: list = []
    for c in ranked:
        if all(max(shared.get((c, k), 0.0), shared.get((k, c), 0.0)) <= most for k in kept):
            kept.append(c)
    return kept


#: Points that pareto() takes.
MOST_POINTS = 20_000


def pareto(points: DataFrame, objectives: Sequence[str], key: str) -> DataFrame:
    """Points that no other point dominates (as good in all objectives, larger is better, and better in one); equals all stay.

    A theta anti-join for the few points of a frontier; they are gathered once, and their number is checked.
    """
    rows = points.limit(MOST_POINTS + 1).collect()
    if len(rows) > MOST_POINTS:
        raise ValueError(f"over {MOST_POINTS} points; use skyline() for two objectives")
    points = points.sparkSession.createDataFrame(rows, points.schema)
    other = points.select(*[F.col(o).alias(f"_{o}") for o in objectives])
    as_good = better = None
    for o in objectives:
        ge, gt = F.col(f"_{o}") >= F.col(o), F.col(f"_{o}") > F.col(o)
        as_good, better = (ge, gt) if as_good is None else (as_good & ge, better | gt)
    return points.join(F.broadcast(other), as_good & better, "left_anti")


def skyline(points: DataFrame, first: str, second: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Two objectives by one sort: largest first, kept where the second strictly exceeds all before; of equals the least key."""
    before = Window.partitionBy(*by).orderBy(F.desc(first), F.desc(second), key).rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("_best", F.max(second).over(before)).where(F.col("_best").isNull() | (F.col(second) > F.col("_best"))).drop("_best")


def nondominated_share(points: DataFrame, first: str, second: str, key: str) -> DataFrame:
    before = Window.orderBy(F.desc(first), F.desc(second), key).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(second).over(before)
    return points.select(F.when(best.isNull() | (F.col(second) > best), 1.0).otherwise(0.0).alias("k")).agg(F.avg("k").alias("share"))


def weakness_frontier(rows: DataFrame, loss: str, masks: dict[str, Column], least: int = 40) -> DataFrame:
    """region, support, lift, coverage of the masks that no other dominates in lift and coverage, among those of `least` rows."""
    return pareto(lift_and_coverage(rows, loss, masks).where(F.col("support") >= least), ["lift", "coverage"], "region")


def owners(scores: DataFrame, delta: float = 0.0) -> DataFrame:
    """cond, cand of the candidates within delta of a condition's best score."""
    return scores.withColumn("_top", F.max("score").over(Window.partitionBy("cond"))).where(F.col("score") >= F.col("_top") - delta).select("cond", "cand")


def coverage_shares(scores: DataFrame, weights: DataFrame | None = None, delta: float = 0.0) -> DataFrame:
    """cand, share of every candidate: each condition's weight, in equal parts to its owners; weights (cond, v) sum to 1."""
    own = owners(scores, delta).withColumn("k", F.count("*").over(Window.partitionBy("cond")))
    if weights is None:
        n = scores.agg(F.count_distinct("cond").alias("n"))
        held = own.crossJoin(F.broadcast(n)).withColumn("part", 1.0 / (F.col("k") * F.col("n")))
    else:
        total = weights.agg(F.sum("v").alias("n"))
        held = own.join(weights, "cond").crossJoin(F.broadcast(total)).withColumn("part", F.col("v") / (F.col("k") * F.col("n")))
    share = held.groupBy("cand").agg(F.sum("part").alias("share"))
    return scores.select("cand").distinct().join(share, "cand", "left").fillna(0.0, ["share"])


def reduce_cover(owned: dict, shares: dict) -> set:
    """Drops candidates, least share first, whose conditions all have another owner left. For collected, few candidates."""
    kept = set(owned)
    for c in sorted(owned, key=lambda c: (shares.get(c, 0.0), str(c))):
        others = set().union(*(owned[k] for k in kept if k != c)) if len(kept) > 1 else set()
        if owned[c] <= others:
            kept.discard(c)
    return kept


def selection_probabilities(shares: DataFrame, epsilon: float) -> DataFrame:
    """cand, probability = (1 - epsilon) * share / total + epsilon / K; uniform where all shares are 0."""
    one = shares.agg(F.sum("share").alias("total"), F.count("*").alias("K"))
    part = F.coalesce(ratio(F.col("share"), F.col("total")), 1.0 / F.col("K"))
    return shares.crossJoin(F.broadcast(one)).select("cand", ((1 - epsilon) * part + epsilon / F.col("K")).alias("probability"))


def primary(points: DataFrame, least_share: float = 0.10) -> DataFrame:
    """The frontier point of largest contrast among those of the least share; then larger share, earlier id."""
    return skyline(points, "contrast", "share", "id").where(F.col("share") >= least_share).orderBy(F.desc("contrast"), F.desc("share"), "id").limit(1)


def worst_cluster(summary: DataFrame, cluster: str, least: int = 50, least_share: float = 0.01) -> DataFrame:
    return summary.where((F.col("n") >= least) & (F.col("share") >= least_share)).orderBy(F.desc(F.round("brier", 10)), cluster).limit(1)


def best_so_far(history: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """History with the running best; one method's history is one run's steps."""
    return history.withColumn("best", F.max(value).over(Window.partitionBy(*by).orderBy(order)))


def best_within(history: DataFrame, by: Sequence[str], budgets: Sequence[int]) -> DataFrame:
    """For each budget of loss reads the best value found by then; null where nothing was.

    Aggregates once for each budget in one pass, with no join against the history.
    """
    best = [F.struct(F.lit(b).alias("budget"), F.max(F.when(F.col("reads") <= b, F.col("value"))).alias("best")) for b in budgets]
    return history.groupBy(*by).agg(F.array(*best).alias("c")).select(*by, F.inline("c"))


def cell_unions(cells: int) -> list[tuple[int, ...]]:
    return [(i,) if i == j else (i, j) for i in range(cells) for j in range(i, cells)]


def simplex(spark, k: int) -> DataFrame:
    """a, b, c: whole numbers that sum to k."""
    one = lambda name: spark.range(k + 1).select(F.col("id").cast("int").alias(name))
    return one("a").crossJoin(one("b")).where(F.col("a") + F.col("b") <= k).withColumn("c", F.lit(k) - F.col("a") - F.col("b"))
