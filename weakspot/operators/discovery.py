"""Discovery of weak regions: candidate samples, region evolution, leaf anchors, medoid loops, comparisons of methods."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import first_nearest
from . import trees as T
from .confirm import poisson_weight
from .evaluate import measure, ratio
from .models import kmeans_centres
from .ordering import row_numbers
from .regions import membership


def sample_candidates(rows: DataFrame, features: Sequence[str], key: str, n: int, seed: int = 0, shape: str = "simplex") -> list[tuple[list[float], list[float]]]:
    """Centres on n observed rows (the n least hashes of key and seed) with Dirichlet shapes, or unit cubes."""
    chosen = rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n).select(*features).collect()
    dice = np.random.default_rng(seed)
    return [([float(r[f]) for f in features], (dice.dirichlet(np.ones(len(features))) if shape == "simplex" else np.ones(len(features))).tolist()) for r in chosen]


def required_support(losses: Sequence[float], sizes: Sequence[int], target: float, draws: int = 400, seed: int = 0) -> int | None:
    """The smallest size whose simulated 95 % interval of the mean is at most `target` wide on either side."""
    x, dice = np.asarray(losses, float), np.random.default_rng(seed)
    for m in sorted(sizes):
        means = x[dice.integers(0, len(x), (draws, m))].mean(axis=1)
        if (np.quantile(means, 0.975) - np.quantile(means, 0.025)) / 2 <= target:
            return m
    return None


def required_support_of(rows: DataFrame, loss: str, sizes: Sequence[int], target: float, draws: int = 400, seed: int = 0) -> int | None:
    """required_support() of all rows, without gathering them: only the drawn places of the ordered losses come to the driver.

    At most draws x the sum of sizes numbers, whatever the table's size; the result is required_support()'s of the sorted losses.
    """
    numbered = row_numbers(rows.where(F.col(loss).isNotNull()).select(loss), [loss], "place")
    n = numbered.count()
    if not n:
        return None
    dice = np.random.default_rng(seed)
    drawn = {m: dice.integers(0, n, (draws, m)) for m in sorted(sizes)}
    places = np.unique(np.concatenate([d.ravel() for d in drawn.values()]))
    wanted = rows.sparkSession.createDataFrame([(int(p) + 1,) for p in places], "place long")
    found = numbered.join(wanted, "place").orderBy("place").select(loss).collect()
    x = np.array([r[loss] for r in found], float)
    for m, d in drawn.items():
        means = x[np.searchsorted(places, d)].mean(axis=1)
        if (np.quantile(means, 0.975) - np.quantile(means, 0.025)) / 2 <= target:
            return m
    return None


def discover(rows: DataFrame, features: Sequence[str], key: str, loss: str, regions: int, m: int, generations: int = 5, sigma: float = 0.6, seed: int = 0) -> DataFrame:
    """region, centre, weakness: k-means centres moved by one Gaussian try a generation; all regions' tries are one job."""
    dice = random.Random(seed)
    centres = kmeans_centres(rows, features, regions, 1, seed)
    spark, one = rows.sparkSession, [1.0] * len(features)
    best: list = [None] * len(centres)

    def weakness(points):
        frame = spark.createDataFrame([(i, p, one, m) for i, p in enumerate(points)], "cand int, z array<double>, w array<double>, m int")
        held = membership(rows, frame, features, key, "ball")
        found = {r["cand"]: r["contrast"] for r in measure(held, rows, key, loss, math.inf).collect()}
        return [found.get(i) if found.get(i) is not None else -math.inf for i in range(len(points))]

    best = list(zip(weakness(centres), centres, strict=True))
    for g in range(generations):
        step = sigma * (1 - g / generations) + 0.05
        tries = [[x + dice.gauss(0, step) for x in c] for _, c in best]
        for i, (v, c) in enumerate(zip(weakness(tries), tries, strict=True)):
            if v > best[i][0]:
                best[i] = (v, c)
    ranked = sorted(best, key=lambda b: -b[0])
    return spark.createDataFrame([(i, [float(x) for x in c], float(v)) for i, (v, c) in enumerate(ranked)], "region int, centre array<double>, weakness double")


def climb(rows: DataFrame, features: Sequence[str], key: str, loss: str, regions: int, m: int, step: float = 0.5, rounds: int = 40, seed: int = 0, centres: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """region, centre, weakness, base, evals: k-means centres (or those given) moved along one feature at a time, weakest region first.

    weakness is the mean loss of the m nearest rows, base that of all rows. In a round each centre goes to the best of its
    neighbours, `step` up or down in one feature, if that is strictly weaker (ties: the first feature, up before down), else it
    stays for good. The neighbourhoods of all centres that still move are one job, so rounds, not regions, set the number of
    jobs. evals counts the neighbours that all centres have tried. No rows give no regions.
    """
    spark, one = rows.sparkSession, [1.0] * len(features)

    def weakness(points):
        frame = spark.createDataFrame([(i, p, one, m) for i, p in enumerate(points)], "cand int, z array<double>, w array<double>, m int")
        near = membership(rows, frame, features, key, "ball").select("cand", key)
        found = {r["cand"]: r["mean"] for r in near.join(rows.select(key, loss), key).groupBy("cand").agg(F.avg(loss).alias("mean")).collect()}  # one row a point
        return [found.get(i) if found.get(i) is not None else -math.inf for i in range(len(points))]

    result = "region int, centre array<double>, weakness double, base double, evals long"
    base = rows.agg(F.avg(loss)).first()[0]
    if base is None:
        return spark.createDataFrame([], result)
    at = [[float(x) for x in c] for c in (kmeans_centres(rows, features, regions, 1, seed) if centres is None else centres)]
    value, moving, evals = weakness(at), list(range(len(at))), 0
    for _ in range(rounds):
        around = [[x + sign * step * (i == f) for i, x in enumerate(at[j])] for j in moving for f in range(len(features)) for sign in (1, -1)]
        if not around:
            break
        tried, each = weakness(around), 2 * len(features)
        evals += len(around)
        still = []
        for place, j in enumerate(moving):
            best = max(range(place * each, (place + 1) * each), key=lambda i: (tried[i], -i))
            if tried[best] > value[j]:
                at[j], value[j] = around[best], tried[best]
                still.append(j)
        moving = still
    order = sorted(range(len(at)), key=lambda j: -value[j])
    return spark.createDataFrame([(i, at[j], float(value[j]), float(base), evals) for i, j in enumerate(order)], result)


def condition_scores(rows: DataFrame, candidates: DataFrame, features: Sequence[str], key: str, loss: str, conditions: int) -> DataFrame:
    """cand, cond, score: mean loss of a candidate's rows over all rows' mean, minus 1, under each bootstrap condition."""
    near = membership(rows, candidates, features, key, "ball").select("cand", key)
    weighted = rows.select(key, loss).withColumn("cond", F.explode(F.sequence(F.lit(0), F.lit(conditions - 1)))).withColumn("w", poisson_weight(key, F.col("cond"), "cond"))
    base = weighted.groupBy("cond").agg(ratio(F.sum(F.col("w") * F.col(loss)), F.sum("w").cast("double")).alias("base"))
    inside = near.join(weighted, key).groupBy("cand", "cond").agg(ratio(F.sum(F.col("w") * F.col(loss)), F.sum("w").cast("double")).alias("mean"))
    return inside.join(F.broadcast(base), "cond").select("cand", "cond", (ratio(F.col("mean"), F.col("base")) - 1).alias("score"))


def leaf_contrasts(rows: DataFrame, key: str, codes: str, loss: str, anchors: Mapping[int, Sequence[int]], m: int, tie: Column) -> DataFrame:
    """anchor, contrast of every anchor's m nearest rows by shared leaves, in one pass."""
    near = T.leaf_neighbours(rows, key, codes, dict(anchors), m, tie).withColumnRenamed("anchor", "cand")
    return measure(near, rows, key, loss, math.inf).select(F.col("cand").alias("anchor"), "contrast")


def ownership(records: Sequence[Mapping], tolerances: Mapping[str, float], explore: float = 0.05) -> tuple[list[int], list[float]]:
    """Places and chances of the nondominated records as parents.

    Each objective belongs in equal parts to the frontier's records within its tolerance of its best; a record's chance is its
    part of all objectives, but for `explore`, which is spread evenly over the frontier.
    """
    names = list(tolerances)
    value = np.array([[r[n] for n in names] for r in records], float)
    frontier = [i for i, v in enumerate(value) if not ((value >= v).all(axis=1) & (value > v).any(axis=1)).any()]
    part = np.zeros(len(frontier))
    for j, name in enumerate(names):
        near = value[frontier, j] >= value[frontier, j].max() - tolerances[name]
        part += near / near.sum() / len(names)
    return frontier, ((1 - explore) * part + explore / len(frontier)).tolist()


def partition_cells(classes: DataFrame, partitions: Sequence[Sequence[Sequence[int]]]) -> list[dict[int, tuple[int, float]]]:
    """Rows and loss sum of each cell of several sets of medoids, in one job over the classes of leaf codes (codes, n, s)."""
    cell = lambda medoids: first_nearest(F.array(*[F.round(T.distance_to(F.col("codes"), m), 10) for m in medoids]))
    cells = F.array(*[F.struct(F.lit(i).alias("part"), cell(m).cast("int").alias("cell")) for i, m in enumerate(partitions)])
    out: list[dict] = [{} for _ in partitions]
    for r in classes.select("n", "s", F.inline(cells)).groupBy("part", "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        out[r["part"]][r["cell"]] = (r["n"], r["s"])
    return out


def medoid_loop(
    rows: DataFrame, key: str, loss: str, codes: str, pool: Sequence[Sequence[int]], counts: Sequence[int], k: int = 4, budget: int = 1600, subsets: int = 16, brood: int = 1, least: int = 30,
    region: tuple[int, float, float] = (50, 0.01, 0.8), tolerances: Mapping[str, float] | None = None, explore: float = 0.05, neighbours: int = 200, seed: int = 0,
) -> list[dict]:
    """Search over sets of k medoids from a bounded pool (codes, and the rows each stands for): a record a partition.

    Seeds are PAM's medoids of the pool and of `subsets` representative parts of it. Then a tenth of the sets are drawn afresh;
    the others replace one (three in four) or two medoids of a parent, chosen by ownership of contrast and share, half of them
    by one of the replaced medoid's nearest `neighbours`. A partition costs k region scores, up to the budget. It is valid if
    each cell has `least` rows and one is a region: enough rows and a share within bounds; its contrast is the largest gap of
    mean loss to the rest among those. Partitions are measured over the classes of leaf codes, a brood (or all seeds) a job.
    """
    from .anchors import _written, leaf_classes
    from .twinning import multiplets_of

    dice = np.random.default_rng(seed)
    tolerances = dict(tolerances or {"contrast": 0.005, "share": 0.02})
    matrix = np.array(pool)
    weight = np.asarray(counts)
    classes = _written(leaf_classes(rows, key, codes, loss), "classes").persist()
    whole = classes.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    records: list[dict] = []

    def record(proposals):
        cells_of = partition_cells(classes, [[pool[i] for i in chosen] for chosen, _, _ in proposals])
        for (chosen, operation, parent), cells in zip(proposals, cells_of, strict=True):
            gaps = []
            for c, (n, s) in cells.items():
                rest = whole["n"] - n
                if n >= region[0] and region[1] <= n / whole["n"] <= region[2] and rest:
                    gaps.append((round(s / n - (whole["s"] - s) / rest, 12), -c, n / whole["n"]))
            top = max(gaps, default=(None, None, None))
            valid = len(cells) == k and all(n >= least for n, _ in cells.values()) and bool(gaps)
            records.append({"id": len(records), "parent_id": parent, "operation": operation, "medoids": [int(i) for i in chosen], "counts": [cells[c][0] for c in sorted(cells)], "valid": valid, "contrast": top[0], "share": top[2]})

    # one-hot leaves: their distances are those of the codes
    hot = np.concatenate([matrix[:, [t]] == np.unique(matrix[:, t]) for t in range(matrix.shape[1])], axis=1).astype(float)
    starts = [(T.pam(T.dissimilarity(matrix), k, counts=weight)[0], "pam", None)]
    parts = min(subsets, len(pool) // (2 * k))
    if parts >= 2:
        part = multiplets_of(hot, parts, 1)
        for j in range(parts):
            at = np.flatnonzero(part == j)
            starts.append((at[T.pam(T.dissimilarity(matrix[at]), k, counts=weight[at])[0]].tolist(), "seed", None))
    record(starts[: max(1, budget // k)])

    def child(good):
        if not good or dice.random() < 0.1:
            return dice.choice(len(pool), k, replace=False).tolist(), "restart", None
        frontier, chance = ownership(good, tolerances, explore)
        parent = good[frontier[int(dice.choice(len(frontier), p=np.array(chance) / sum(chance)))]]
        chosen = list(parent["medoids"])
        for _ in range(1 if dice.random() < 0.75 else 2):
            place = int(dice.integers(k))
            free = np.setdiff1d(np.arange(len(pool)), chosen)
            if dice.random() < 0.5:
                near = (matrix[free] != matrix[chosen[place]]).mean(axis=1)
                free = free[np.argsort(near, kind="stable")[:neighbours]]
            chosen[place] = int(dice.choice(free))
        return chosen, "replace", parent["id"]

    while len(pool) > k and (len(records) + 1) * k <= budget:
        good = [r for r in records if r["valid"]]
        record([child(good) for _ in range(min(brood, budget // k - len(records)))])
    classes.unpersist()
    return records


def twice_the_same(rows: DataFrame, candidates: DataFrame, features: Sequence[str], key: str, loss: str) -> DataFrame:
    """cand, contrast, same: whether measuring again gives the same contrast to the last bit but rounding."""
    once = [measure(membership(rows, candidates, features, key), rows, key, loss, math.inf).select("cand", F.round("contrast", 12).alias(f"c{i}")) for i in (0, 1)]
    return once[0].join(once[1], "cand").select("cand", F.col("c0").alias("contrast"), F.col("c0").eqNullSafe(F.col("c1")).alias("same"))


def comparison_table(runs: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, runs, least, middle, most: the seeds of each setting side by side."""
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), F.min(value).alias("least"), F.percentile(value, 0.5).alias("middle"), F.max(value).alias("most"))
