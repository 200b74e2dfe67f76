"""Learned models. Statistics are gathered by Spark; what is fitted becomes column expressions, so scoring stays in the JVM."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import edges_under
from ..functions.scoring import sigmoid
from .trees import Leaf, Split, additive


@dataclass
class Scorer:
    """A fitted model as a column expression over its features."""

    expression: Column
    trees: list = field(default_factory=list)
    base: float = 0.0
    parts: dict = field(default_factory=dict)

    def score(self, df: DataFrame, alias: str = "score") -> DataFrame:
        return df.withColumn(alias, self.expression)


def grid(df: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Distinct quantiles of each feature, in one job."""
    row = df.agg(*[F.percentile_approx(f, [i / bins for i in range(1, bins)], 10_000).alias(f) for f in features]).first()
    return {f: sorted(set(map(float, row[f] or []))) for f in features}


def _best_split(cells: dict, cuts: dict, signs: Mapping[str, int], low: float, high: float, ridge: float, least: float):
    """(gain, feature, cut number, left value, right value) of one node from its (gradient, hessian) histograms."""
    value = lambda g, h: min(max(-g / (h + ridge), low), high)
    gain_of = lambda g, h, v: -(g * v + 0.5 * (h + ridge) * v * v)
    best = None
    for f, edges in cuts.items():
        g, h = cells[f]
        gs, hs, gt, ht = np.cumsum(g), np.cumsum(h), float(g.sum()), float(h.sum())
        root = gain_of(gt, ht, value(gt, ht))
        for i in range(len(edges)):
            gl, hl = float(gs[i]), float(hs[i])
            gr, hr = gt - gl, ht - hl
            if min(hl, hr) < least:
                continue
            a, b = value(gl, hl), value(gr, hr)
            if signs.get(f, 0) * (b - a) < 0:
                continue
            gain = gain_of(gl, hl, a) + gain_of(gr, hr, b) - root
            if gain > 1e-9 and (best is None or gain > best[0]):
                best = (gain, f, i, a, b)
    return best


def boost(
    df: DataFrame, features: Sequence[str], target: str, loss: str = "squared", trees: int = 50, depth: int = 2, bins: int = 32, rate: float = 0.1,
    signs: Mapping[str, int] | None = None, pairs: Sequence[tuple[str, str]] | None = None, weight: str | None = None, ridge: float = 1.0, least: float = 1.0, first: Column | None = None,
) -> Scorer:
    """Gradient boosting on histograms, with monotone signs and, if `pairs` is given, trees on those pairs in turn.

    One aggregation a level: sums of gradient and hessian by node, feature and bin, at most 2**depth * features * bins rows.
    A split against a sign is refused, and children are bounded by the middle of their values, so scores keep the signs.
    """
    signs = dict(signs or {})
    cuts = grid(df, features, bins)
    w = F.col(weight) if weight else F.lit(1.0)
    prepared = df.select(F.col(target).cast("double").alias("_y"), w.cast("double").alias("_w"), *features, *([first.alias("_first")] if first is not None else []), *[edges_under(F.array(*map(F.lit, cuts[f])) if cuts[f] else F.array().cast("array<double>"), F.col(f)).alias(f"_b_{f}") for f in features]).cache()
    one = prepared.agg(F.sum(F.col("_y") * F.col("_w")), F.sum("_w")).first()
    mean = (one[0] or 0.0) / (one[1] or 1.0)
    if first is not None:
        base, start = 0.0, F.col("_first")
    elif loss == "logistic":
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        base, start = math.log(mean / (1 - mean)), F.lit(math.log(mean / (1 - mean)))
    else:
        base, start = mean, F.lit(mean)
    grown: list = []
    gains: list[float] = []
    for t in range(trees):
        allowed = list(pairs[t % len(pairs)]) if pairs else list(features)
        score = start + additive(grown) if grown else start
        if loss == "logistic":
            p = sigmoid(score)
            g, h = F.col("_w") * (p - F.col("_y")), F.col("_w") * F.greatest(p * (1 - p), F.lit(1e-6))
        else:
            g, h = F.col("_w") * (score - F.col("_y")), F.col("_w")
        rows = prepared.withColumn("_g", g).withColumn("_h", h)
        nodes = {(): (-math.inf, math.inf)}
        splits: dict = {}
        values: dict = {(): 0.0}
        for _ in range(depth):
            if not nodes:
                break
            place = F.lit(None).cast("string")
            for path in nodes:
                inside = F.lit(True)
                for k, side in enumerate(path):
                    s = splits[path[:k]]
                    inside = inside & ((F.col(f"_b_{s[1]}") <= s[2]) if side == 0 else (F.col(f"_b_{s[1]}") > s[2]))
                place = F.when(inside, "".join(map(str, path)) or "r").otherwise(place)
            long = rows.select(place.alias("node"), "_g", "_h", F.inline(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"_b_{f}").alias("b")) for f in allowed]))).where("node is not null")
            cells: dict = {}
            for r in long.groupBy("node", "f", "b").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect():
                held = cells.setdefault(r["node"], {f: (np.zeros(len(cuts[f]) + 1), np.zeros(len(cuts[f]) + 1)) for f in allowed})
                held[r["f"]][0][r["b"]] += r["g"]
                held[r["f"]][1][r["b"]] += r["h"]
            below = {}
            for path, (low, high) in nodes.items():
                name = "".join(map(str, path)) or "r"
                found = name in cells and _best_split(cells[name], {f: cuts[f] for f in allowed}, signs, low, high, ridge, least)
                if not found:
                    continue
                splits[path] = found
                _, f, _, a, b = found
                middle = (a + b) / 2
                sign = signs.get(f, 0)
                below[(*path, 0)] = (low, min(high, middle)) if sign > 0 else (max(low, middle), high) if sign < 0 else (low, high)
                below[(*path, 1)] = (max(low, middle), high) if sign > 0 else (low, min(high, middle)) if sign < 0 else (low, high)
                values[(*path, 0)], values[(*path, 1)] = a, b
            nodes = below
        if not splits:
            break
        count = 0

        def build(path, splits=splits, values=values):
            nonlocal count
            if path not in splits:
                count += 1
                return Leaf(count - 1, rate * values[path])
            _, f, i, _, _ = splits[path]
            return Split(f, cuts[f][i], build((*path, 0)), build((*path, 1)))

        grown.append(build(()))
        gains.append(sum(s[0] for s in splits.values()))
    prepared.unpersist()
    total = additive(grown, base) if first is None else first + additive(grown)
    return Scorer(sigmoid(total) if loss == "logistic" else total, grown, base, {"gains": gains, "cuts": cuts, "margin": total})


def fit_error_model(df: DataFrame, features: Sequence[str], error: str, trees: int = 120, depth: int = 2) -> Scorer:
    """The error of another model, boosted on the features."""
    return boost(df, features, error, "squared", trees, depth)


def fit_logistic(df: DataFrame, features: Sequence[str], y: str, ridge: float = 0.0, weight: str | None = None) -> Scorer:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="skip").transform(df)
    extra = {"weightCol": weight} if weight else {}
    model = LogisticRegression(featuresCol="_v", labelCol=y, regParam=ridge, **extra).fit(ready)
    z = sum((F.lit(float(c)) * F.col(f) for c, f in zip(model.coefficients, features, strict=True)), F.lit(float(model.intercept)))
    return Scorer(sigmoid(z), parts={"coefficients": list(map(float, model.coefficients)), "intercept": float(model.intercept)})


def kmeans(df: DataFrame, features: Sequence[str], k: int, starts: int = 5, seed: int = 0) -> DataFrame:
    """df with cluster: the best of several k-means starts by cost."""
    centres = kmeans_centres(df, features, k, starts, seed)
    from .regions import nearest_centre

    return df.withColumn("cluster", nearest_centre(features, centres))


def kmeans_centres(df: DataFrame, features: Sequence[str], k: int, starts: int = 5, seed: int = 0) -> list[list[float]]:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="skip").transform(df).select("_v").cache()
    models = [KMeans(k=k, featuresCol="_v", seed=seed + s).fit(ready) for s in range(starts)]
    ready.unpersist()
    best = min(models, key=lambda m: m.summary.trainingCost)
    return sorted([list(map(float, c)) for c in best.clusterCenters()])


def gaussian_gate(features: Sequence[str], centres: Sequence[Sequence[float]], scale: float) -> list[Column]:
    """Responsibilities of spherical Gaussians of one width, computed from differences, so they don't underflow."""
    d = [sum(((F.col(f) - float(c)) ** 2 for f, c in zip(features, centre, strict=True)), F.lit(0.0)) / (2 * scale * scale) for centre in centres]
    least = F.least(*d) if len(d) > 1 else d[0]
    raw = [F.exp(least - x) for x in d]
    total = sum(raw[1:], raw[0])
    return [x / total for x in raw]


def moment_gates(df: DataFrame, features: Sequence[str], cluster: str) -> tuple[list[list[float]], list[float], list[float]]:
    """Centres, widths and weights of spherical Gaussians from the moments of a partition's parts, in the order of its numbers."""
    rows = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("n"), *[F.avg(f).alias(f"a_{f}") for f in features], *[F.var_pop(f).alias(f"v_{f}") for f in features]).orderBy(cluster).collect()  # a row a part
    total = sum(r["n"] for r in rows)
    return [[float(r[f"a_{f}"]) for f in features] for r in rows], [max(1e-9, math.sqrt(sum(r[f"v_{f}"] for f in features) / len(features))) for r in rows], [r["n"] / total for r in rows]


def soft_gates(features: Sequence[str], centres: Sequence[Sequence[float]], widths: Sequence[float], weights: Sequence[float]) -> list[Column]:
    """Responsibilities of spherical Gaussians of their own widths and weights, from differences of logarithms."""
    logs = []
    for centre, width, weight in zip(centres, widths, weights, strict=True):
        far = sum(((F.col(f) - float(c)) ** 2 for f, c in zip(features, centre, strict=True)), F.lit(0.0))
        logs.append(F.lit(math.log(weight) - len(features) * math.log(width)) - far / (2 * width * width))
    most = F.greatest(*logs) if len(logs) > 1 else logs[0]
    raw = [F.exp(x - most) for x in logs]
    total = sum(raw[1:], raw[0])
    return [x / total for x in raw]


def pack_gates(centres: Sequence[Sequence[float]], widths: Sequence[float], weights: Sequence[float]) -> np.ndarray:
    """All of a gate's numbers as one vector without bounds, for a search: centres, log widths, log weights."""
    return np.concatenate([np.ravel(centres), np.log(widths), np.log(weights)])


def unpack_gates(x: Sequence[float], features: int) -> tuple[list[list[float]], list[float], list[float]]:
    """What pack_gates() packed; weights sum to 1 again, whatever a search did to them."""
    x = np.asarray(x, float)
    k = len(x) // (features + 2)
    raw = np.exp(x[-k:] - x[-k:].max())
    return x[: k * features].reshape(k, features).tolist(), np.exp(x[k * features : -k]).tolist(), (raw / raw.sum()).tolist()


def fit_fanova(df: DataFrame, features: Sequence[str], y: str, signs: Mapping[str, int] | None = None, pairs: int = 5, trees: int = 30, main_depth: int = 4) -> Scorer:
    """Main effects first (trees of one feature), then the strongest pairs on what is left. Pairs are ranked by a detector's gains."""
    detector = boost(df, features, y, "logistic", trees, 2)
    ranked: dict = {}
    for t, gain in zip(detector.trees, detector.parts["gains"], strict=True):
        names = sorted(_features(t))
        for a in names:
            for b in names:
                if a < b:
                    ranked[a, b] = ranked.get((a, b), 0.0) + gain / max(1, len(names) * (len(names) - 1) // 2)
    top = [p for p, _ in sorted(ranked.items(), key=lambda x: (-x[1], x[0]))[:pairs]]
    mains = boost(df, features, y, "logistic", trees, main_depth, signs=signs, pairs=[(f,) for f in features])
    if not top:
        return mains
    both = boost(df, features, y, "logistic", trees, 2, signs=signs, pairs=top, first=mains.parts["margin"])
    return Scorer(both.expression, mains.trees + both.trees, mains.base, {"pairs": top, "margin": both.parts["margin"]})


def _features(tree) -> set:
    return set() if isinstance(tree, Leaf) else {tree.feature} | _features(tree.left) | _features(tree.right)
