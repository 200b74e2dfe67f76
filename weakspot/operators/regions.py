"""Regions of covariate space: standardising, grids, candidate memberships, frozen rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import first_nearest, snap_down, snap_up
from .ordering import exact_quantiles

#: Candidates are broadcast up to this many rows; they are a search's list, not data.
MOST_CANDIDATES = 100_000


def moments(df: DataFrame, features: Sequence[str], ddof: int) -> DataFrame:
    """One row: mu_f and sd_f of each feature; a deviation of 0 counts as 1."""
    sd = F.stddev_samp if ddof else F.stddev_pop
    return df.agg(*[F.avg(f).alias(f"mu_{f}") for f in features], *[F.when(sd(f) > 0, sd(f)).otherwise(1.0).alias(f"sd_{f}") for f in features])


def standardize(df: DataFrame, features: Sequence[str], ddof: int = 0, stats: DataFrame | None = None) -> DataFrame:
    """df with z_f = (f - mu_f) / sd_f, by the moments of df or those given (one row)."""
    stats = moments(df, features, ddof) if stats is None else stats
    return df.crossJoin(F.broadcast(stats)).withColumns({f"z_{f}": (F.col(f) - F.col(f"mu_{f}")) / F.col(f"sd_{f}") for f in features}).drop(*stats.columns)


def unstandardize(df: DataFrame, features: Sequence[str], stats: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(stats)).withColumns({f: F.col(f"z_{f}") * F.col(f"sd_{f}") + F.col(f"mu_{f}") for f in features}).drop(*stats.columns)


def constant_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    row = df.agg(*[(F.min(f) == F.max(f)).alias(f) for f in features]).first()
    return [f for f in features if row[f]]


def bin_grid(df: DataFrame, feature: str, bins: int) -> DataFrame:
    """One row, edges: midpoints of the distinct values if there are at most `bins`, else distinct inner quantiles.

    Distinct values are counted up to bins + 1 by a distinct-limit, so no set grows with the data.
    """
    few = df.select(F.col(feature).alias("v")).where("v is not null").distinct().limit(bins + 1).agg(F.array_sort(F.collect_list("v")).alias("values"))
    held = exact_quantiles(df, [], feature, [i / bins for i in range(1, bins)], "cuts")
    cuts = held.agg(F.coalesce(F.first("cuts"), F.array().cast("array<double>")).alias("cuts"))
    v = F.col("values")
    middle = F.transform(F.slice(v, 1, F.size(v) - 1), lambda x, i: (x + F.get(v, i + 1)) / 2)
    return few.crossJoin(cuts).select(F.when(F.size(v) <= bins, F.when(F.size(v) > 1, middle).otherwise(F.array().cast("array<double>"))).otherwise(F.array_sort(F.array_distinct("cuts"))).alias("edges"))


def _ranks(gaps: Sequence[np.ndarray], missing: Sequence[np.ndarray], shapes: np.ndarray, ball: bool) -> tuple[np.ndarray, np.ndarray]:
    """u and d of rows as membership() ranks them before it rounds: nulls first (-inf), no number last (inf)."""
    d = gaps[0] * gaps[0]
    for g in gaps[1:]:
        d = d + g * g
    d = np.sqrt(d)
    d[np.isnan(d)] = np.inf
    d[np.logical_or.reduce(missing)] = -np.inf
    if ball:
        return d, d
    u = np.full(len(d), -np.inf)
    for g, gone, w in zip(gaps, missing, shapes, strict=True):
        u = np.maximum(u, np.where(gone, -np.inf, g / w))
    u[np.isnan(u)] = np.inf
    return u, d


def _may_be_near(candidates: Sequence[tuple], ball: bool, slack: float):
    """A task's filter of (candidate's place, row): drops a row where m rows that the task has met surely come before it.

    Distances are the same sums here and in the JVM; rounding may bring together what lies within `slack`, so only rows farther
    than that are dropped, and of rows at the m-th's very radius those whose Euclidean distance is.
    """

    def near(batches):
        held = {}  # place: u and d of the m nearest rows met, and the bounds that follow
        for batch in batches:
            columns = [batch.column(i) for i in range(1, batch.num_columns)]
            missing = [np.asarray(c.is_null()) for c in columns]
            values = [np.asarray(c.fill_null(0.0)) for c in columns]
            places, found, waiting = [], [], 0
            for place, (z, w, m) in enumerate(candidates):
                if z is None:
                    kept = np.arange(batch.num_rows)
                else:
                    u, d = _ranks([np.abs(x - c) for x, c in zip(values, z, strict=True)], missing, w, ball)
                    old_u, old_d, far, farther = held.get(place, (np.empty(0), np.empty(0), np.inf, np.inf))
                    kept = np.flatnonzero(u <= far + slack)
                    if not len(kept):
                        continue
                    u, d = u[kept], d[kept]
                    us, ds = np.concatenate([old_u, u]), np.concatenate([old_d, d])
                    if len(us) >= m:
                        some = np.flatnonzero(us <= np.partition(us, m - 1)[m - 1])
                        some = some[np.lexsort((ds[some], us[some]))[:m]]
                        us, ds = us[some], ds[some]
                        far = us[-1]
                        sure = np.isfinite(far) and not ((us >= far - slack) & (us < far)).any()
                        farther = ds[-1] if sure else np.inf
                    held[place] = us, ds, far, farther
                    kept = kept[(u <= far + slack) & ~((u == far) & (d > farther + slack))]
                places.append(np.full(len(kept), place, dtype=np.int32))
                found.append(kept)
                waiting += len(kept)
                if waiting >= 100_000:
                    yield _taken(batch, places, found)
                    places, found, waiting = [], [], 0
            if waiting:
                yield _taken(batch, places, found)

    return near


def _taken(batch: pa.RecordBatch, places: list, found: list) -> pa.RecordBatch:
    rows = batch.take(pa.array(np.concatenate(found)))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(places)), *rows.columns], names=["_place", *batch.schema.names])


def membership(rows: DataFrame, candidates: DataFrame, features: Sequence[str], key: str, metric: str = "box", digits: int = 10) -> DataFrame:
    """cand, key, u: the m nearest rows of each candidate (cand, z: array, w: array, m).

    Radius u is the largest |x - z| / w for boxes and the Euclidean distance for balls; ties go by Euclidean distance, then by
    key. Ranks are taken on values rounded to `digits`, so engines agree. Pairs of candidate and row never leave the task that
    makes them unless they may be among the nearest; what is left is ranked under a group limit.
    """
    listed = candidates.select("cand", "z", "w", "m").limit(MOST_CANDIDATES + 1).collect()
    if len(listed) > MOST_CANDIDATES:
        raise ValueError(f"over {MOST_CANDIDATES} candidates; give at most {MOST_CANDIDATES} at once")
    spark, p, most = rows.sparkSession, len(features), max((r["m"] or 0 for r in listed), default=0)
    bounded = []
    for r in listed:
        z, w = list(r["z"] or [])[:p], list(r["w"] or [])[:p]
        w = np.maximum([1e-9 if x is None else float(x) for x in w] + [1e-9] * (p - len(w)), 1e-9)
        # a centre that lacks a coordinate has no bound here
        known = len(z) == p and None not in z
        bounded.append((np.array(z, float) if known else None, w, r["m"] or 0))
    used = [i for i, r in enumerate(listed) if (r["m"] or 0) > 0]
    one = rows.select(F.col(key).alias("_key"), *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)])
    names = ", ".join(f"_f{i} double" for i in range(p))
    near = one.mapInArrow(_may_be_near([bounded[i] for i in used], metric == "ball", 2 * 10.0**-digits), f"_place int, _key {one.schema['_key'].dataType.simpleString()}, {names}")
    schema = ", ".join(["_place int", *(f"{c} {t}" for c, t in candidates.select("cand", "z", "w", "m").dtypes)])
    frozen = spark.createDataFrame([(n, *listed[i]) for n, i in enumerate(used)], schema)
    gaps = [F.abs(F.col(f"_f{i}") - F.get("z", F.lit(i))) for i in range(p)]
    euclid = F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))
    box = [g / F.greatest(F.get("w", F.lit(i)), F.lit(1e-9)) for i, g in enumerate(gaps)]
    u = euclid if metric == "ball" else F.greatest(*box) if len(box) > 1 else box[0]
    pairs = near.join(F.broadcast(frozen), "_place")
    pairs = pairs.select("cand", "m", F.col("_key").alias(key), F.round(u, digits).alias("u"), F.round(euclid, digits).alias("d"))
    order = Window.partitionBy("cand").orderBy("u", "d", key)
    # a literal bound lets the group limit apply; each candidate's own m follows
    ranked = pairs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.lit(most))
    return ranked.where("r <= m").select("cand", key, "u")


def nearest_admissible(rows: DataFrame, mask: Column, features: Sequence[str], key: str, m: int, metric: str = "box") -> DataFrame:
    """key, u of the region of m rows that stands for any set of rows: the cube (or ball) around the set's centroid.

    A set without rows has no centroid and gives no region. The region's frozen rule is its centre and largest u.
    """
    centre = rows.where(F.coalesce(mask, F.lit(False))).agg(F.array(*[F.avg(f) for f in features]).alias("z"))
    one = centre.where(F.get("z", F.lit(0)).isNotNull()).select(F.lit(0).alias("cand"), "z", F.array(*[F.lit(1.0)] * len(features)).alias("w"), F.lit(m).alias("m"))
    return membership(rows, one, features, key, metric).select(key, "u")


def nearest_mean(rows: DataFrame, candidates: DataFrame, features: Sequence[str], key: str, value: str) -> DataFrame:
    """cand, n, mean of `value` over the m nearest rows."""
    near = membership(rows, candidates, features, key, "ball")
    return near.join(rows.select(key, value), key).groupBy("cand").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


@dataclass(frozen=True)
class Box:
    """lo <= x <= hi for each feature; None leaves a side open."""

    bounds: Mapping[str, tuple[float | None, float | None]]

    def predicate(self) -> Column:
        out = F.lit(True)
        for f, (lo, hi) in self.bounds.items():
            if lo is not None:
                out = out & (F.col(f) >= F.lit(float(lo)))
            if hi is not None:
                out = out & (F.col(f) <= F.lit(float(hi)))
        return out


@dataclass(frozen=True)
class Ball:
    """Standardised Euclidean distance to the centre of at most radius (or under it, if strict)."""

    centre: Mapping[str, float]
    radius: float
    mean: Mapping[str, float]
    deviation: Mapping[str, float]
    strict: bool = False
    digits: int = 10

    def distance(self) -> Column:
        terms = [((F.col(f) - F.lit(float(self.mean[f]))) / F.lit(float(self.deviation[f])) - F.lit(float(c))) ** 2 for f, c in self.centre.items()]
        return F.round(F.sqrt(sum(terms[1:], terms[0])), self.digits)

    def predicate(self) -> Column:
        return self.distance() < self.radius if self.strict else self.distance() <= self.radius


def radius_for(df: DataFrame, distance: Column, count: int) -> float:
    """The distance at 0-based order place `count`: a strict radius then takes `count` rows, ties apart."""
    rows = df.select(distance.alias("d")).orderBy("d").limit(count + 1).agg(F.max("d"), F.count("*")).first()
    if rows[1] <= count:
        raise ValueError("more rows asked for than there are")
    return rows[0]


def nearest_centre(features: Sequence[str], centres: Sequence[Sequence[float]], digits: int = 10) -> Column:
    """0-based number of the nearest centre, the first among equals."""
    return first_nearest(F.array(*[F.round(sum(((F.col(f) - F.lit(float(c))) ** 2 for f, c in zip(features, centre, strict=True)), F.lit(0.0)), digits) for centre in centres]))


def routed(mask: Column, inside: Column, outside: Column) -> Column:
    """The segment's model where the mask holds, the other elsewhere and where the mask is null."""
    return F.when(mask, inside).otherwise(outside)


def freeze_box(z: Mapping[str, float], w: Mapping[str, float], gamma: float, stats: Mapping[str, tuple[float, float]], edges: Mapping[str, Sequence[float]]) -> Box:
    """Faces z -+ gamma w in standard units, turned to raw units and moved outward to grid edges; beyond the grid a side is open."""
    bounds = {}
    for f in z:
        mu, sd = stats[f]
        lo, hi = (z[f] - gamma * w[f]) * sd + mu, (z[f] + gamma * w[f]) * sd + mu
        bounds[f] = (max((e for e in edges[f] if e <= lo), default=None), min((e for e in edges[f] if e >= hi), default=None))
    return Box(bounds)


def snapped(df: DataFrame, lo: str, hi: str, edges: str) -> DataFrame:
    """df with lo and hi moved outward to the row's edges; null beyond them."""
    return df.withColumns({lo: snap_down(F.col(edges), F.col(lo)), hi: snap_up(F.col(edges), F.col(hi))})


def stratified_split(df: DataFrame, key: str, target: str, shares: Mapping[str, float], seed: str = "0") -> DataFrame:
    """df with `split`: within each class of the target, rows ordered by a hash of key and seed, cut at the shares.

    The rank within a class is made of the row's place in its hash bucket and the buckets' running count, so no task sorts a
    whole class.
    """
    from ..functions.arrays import hash_number

    named = df.withColumn("_h", hash_number(F.col(key).cast("string"), F.lit(seed)))
    named = named.withColumn("_b", F.shiftrightunsigned("_h", 20))
    sizes = named.groupBy(target, "_b").agg(F.count("*").alias("_k"))
    before = Window.partitionBy(target).orderBy("_b")
    sizes = sizes.withColumn("_before", F.sum("_k").over(before) - F.col("_k")).withColumn("_n", F.sum("_k").over(Window.partitionBy(target)))
    place = F.row_number().over(Window.partitionBy(target, "_b").orderBy("_h", key)) + F.col("_before") - 1
    out = named.join(F.broadcast(sizes.drop("_k")), [target, "_b"])  # at most 4096 buckets a class
    out = out.withColumn("_q", place / F.col("_n"))
    split, upto = None, 0.0
    for name, share in shares.items():
        upto += share
        split = F.when(F.col("_q") < upto - 1e-12, name) if split is None else split.when(F.col("_q") < upto - 1e-12, name)
    return out.withColumn("split", split.otherwise(list(shares)[-1])).drop("_h", "_b", "_before", "_n", "_q")


def round_robin(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """df with fold = place in the order, modulo k."""
    from .ordering import row_numbers

    return row_numbers(df, order, "_place").withColumn("fold", ((F.col("_place") - 1) % k).cast("int")).drop("_place")
