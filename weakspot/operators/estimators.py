"""Estimators of Spark's machine-learning protocol: parameters, copy, fit, transform, save and load; models are column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import edges_under
from ..functions.scoring import sigmoid
from . import trees as T
from .models import boost, grid
from .regions import nearest_centre

Numbers = TypeConverters.toListFloat


class UnsupportedPartition(ValueError):
    """A part has too few rows to be calibrated, or an expert no weight."""


# -- saving -------------------------------------------------------------------------------------------------------------------


class _StateWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"state": self.instance.state})


class _StateReader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.kind(metadata["state"])
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out


class _Stored(Model, MLReadable, MLWritable):
    """A model whose fitted numbers are `state`, lists and dicts that JSON holds exactly."""

    def __init__(self, state: dict | None = None):
        super().__init__()
        self.state = state or {}

    def write(self):
        return _StateWriter(self)

    @classmethod
    def read(cls):
        return _StateReader(cls)


def packed_tree(node) -> list:
    return [node.code, node.value] if isinstance(node, T.Leaf) else [node.feature, node.threshold, packed_tree(node.left), packed_tree(node.right)]


def unpacked_tree(x: list):
    return T.Leaf(int(x[0]), float(x[1])) if len(x) == 2 else T.Split(x[0], float(x[1]), unpacked_tree(x[2]), unpacked_tree(x[3]))


# -- shared parameters --------------------------------------------------------------------------------------------------------


class _Inputs(Params):
    features = Param(Params._dummy(), "features", "names of the input columns", TypeConverters.toListString)
    label = Param(Params._dummy(), "label", "the target's column", TypeConverters.toString)
    weight = Param(Params._dummy(), "weight", "column of positive weights; empty: 1 each", TypeConverters.toString)
    score = Param(Params._dummy(), "score", "column that transform adds", TypeConverters.toString)
    signs = Param(Params._dummy(), "signs", "-1, 0 or 1 for each feature: the score may only fall, do anything, or only rise", TypeConverters.toListInt)
    trees = Param(Params._dummy(), "trees", "trees of a model", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "depth of a tree", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "share of each tree's values that counts", TypeConverters.toFloat)
    bins = Param(Params._dummy(), "bins", "bins of a feature's histogram", TypeConverters.toInt)

    def value(self, name: str):
        return self.getOrDefault(name)

    def _directions(self, needed: bool) -> dict[str, int]:
        features, signs = self.value("features"), self.value("signs")
        if len(set(features)) != len(features) or not features:
            raise ValueError("features must be given, each once")
        if signs and len(signs) != len(features) or set(signs) - {-1, 0, 1} or needed and not any(signs):
            raise ValueError("signs must give -1, 0 or 1 for each feature" + (", with one that isn't 0" if needed else ""))
        return dict(zip(features, signs, strict=True)) if signs else {}

    def _prepared(self, df: DataFrame) -> DataFrame:
        """The inputs as doubles with _y and _w, cached; refuses labels, weights and features that can't be fitted."""
        weight = self.value("weight")
        out = df.select(*[F.col(f).cast("double").alias(f) for f in self.value("features")], F.col(self.value("label")).cast("double").alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
        finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)
        bad = lambda c: F.count_if(~finite(c))
        out.persist()
        one = out.agg(*[bad(f).alias(f) for f in self.value("features")], F.count_if(~finite("_w") | ~(F.col("_w") > 0)).alias("_w"), bad("_y").alias("_y")).first()
        if any(one):
            out.unpersist()
        if any(one[f] for f in self.value("features")):
            raise ValueError("features must be finite")
        if one["_w"]:
            raise ValueError("weights must be finite and positive")
        if one["_y"]:
            raise ValueError("labels must be finite")
        return out


# -- boosted trees ------------------------------------------------------------------------------------------------------------


class BoostedTrees(_Inputs, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Gradient boosting on histograms with optional monotone signs; loss is squared or logistic."""

    loss = Param(Params._dummy(), "loss", "squared or logistic", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, features=None, label="y", weight="", score="score", signs=None, trees=50, depth=2, rate=0.1, bins=32, loss="squared"):
        super().__init__()
        self._setDefault(label="y", weight="", score="score", signs=[], trees=50, depth=2, rate=0.1, bins=32, loss="squared")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> BoostedTreesModel:
        signs, ready = self._directions(False), self._prepared(df)
        found = boost(ready, self.value("features"), "_y", self.value("loss"), self.value("trees"), self.value("depth"), self.value("bins"), self.value("rate"), signs, weight="_w")
        ready.unpersist()
        model = BoostedTreesModel({"trees": list(map(packed_tree, found.trees)), "base": float(found.base), "loss": self.value("loss")})
        return self._copyValues(model)


class BoostedTreesModel(_Inputs, _Stored):
    loss = BoostedTrees.loss

    @property
    def expression(self) -> Column:
        total = T.additive([unpacked_tree(t) for t in self.state["trees"]], self.state["base"])
        return sigmoid(total) if self.state["loss"] == "logistic" else total

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.value("score"), self.expression)


# -- monotone mixture ---------------------------------------------------------------------------------------------------------


def bin_columns(features: Sequence[str], cuts: dict[str, list[float]]) -> list[Column]:
    return [edges_under(F.array(*map(F.lit, cuts[f])) if cuts[f] else F.array().cast("array<double>"), F.col(f)).cast("int") for f in features]


def grow_stumps(df: DataFrame, bins: Sequence[str], sizes: Sequence[int], targets: Sequence[Column], weights: Sequence[Column], trees: int, rate: float, ridge: float = 1.0, least: float = 1.0):
    """Several logistic models of boosted stumps at once: base[m], and table[m][f][bin], what a bin of a feature adds.

    Stumps add up by feature, so a model of any number of them is one table a feature. A step is one aggregation for all
    models: models x features x bins rows come to the driver.
    """
    totals = df.agg(*[F.sum(w * y).alias(f"p{m}") for m, (y, w) in enumerate(zip(targets, weights, strict=True))], *[F.sum(w).alias(f"n{m}") for m, w in enumerate(weights)]).first()
    count = len(targets)
    share = [min(max((totals[f"p{m}"] or 0.0) / (totals[f"n{m}"] or 1.0), 1e-6), 1 - 1e-6) for m in range(count)]
    base = [math.log(p / (1 - p)) for p in share]
    table = [[np.zeros(n) for n in sizes] for _ in range(count)]
    for _ in range(trees):
        cells = []
        for m in range(count):
            p = sigmoid(stump_margin(bins, base[m], table[m]))
            g, h = weights[m] * (p - targets[m]), weights[m] * F.greatest(p * (1 - p), F.lit(1e-6))
            cells.append(F.struct(F.lit(m).alias("m"), g.alias("g"), h.alias("h")))
        long = df.select(*bins, F.inline(F.array(*cells))).select("m", "g", "h", F.posexplode(F.array(*bins)).alias("f", "b"))
        held = [[np.zeros((n, 2)) for n in sizes] for _ in range(count)]
        for r in long.groupBy("m", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            held[r["m"]][r["f"]][r["b"]] = r["g"], r["h"]
        for m in range(count):
            best = None
            for f, cell in enumerate(held[m]):
                left = cell.cumsum(axis=0)[:-1]
                right = cell.sum(axis=0) - left
                gain = np.where((left[:, 1] >= least) & (right[:, 1] >= least), left[:, 0] ** 2 / (left[:, 1] + ridge) + right[:, 0] ** 2 / (right[:, 1] + ridge), -np.inf)
                if len(gain) and (best is None or gain.max() > best[0] + 1e-12):
                    i = int(gain.argmax())
                    best = (float(gain[i]), f, i, left[i], right[i])
            if best and math.isfinite(best[0]):
                _, f, i, left, right = best
                table[m][f][: i + 1] -= rate * left[0] / (left[1] + ridge)
                table[m][f][i + 1 :] -= rate * right[0] / (right[1] + ridge)
    return base, table


def stump_margin(bins: Sequence[str | Column], base: float, table: Sequence[np.ndarray]) -> Column:
    out = F.lit(float(base))
    for b, values in zip(bins, table, strict=True):
        out = out + F.get(F.array(*map(F.lit, map(float, values))), F.col(b) if isinstance(b, str) else b)
    return out


def fit_curves(df: DataFrame, margins: Sequence[Column], targets: Sequence[Column], weight: Column, rounds: int = 25) -> list[tuple[float, float]]:
    """Slope and shift of a sigmoid of each margin by Newton's steps, towards targets a little inside 0 and 1 (Platt); a job a step for all."""
    n = df.agg(*[F.sum(weight * y).alias(f"p{i}") for i, y in enumerate(targets)], F.sum(weight).alias("n")).first()
    soft = [F.when(y > 0.5, (n[f"p{i}"] + 1) / (n[f"p{i}"] + 2)).otherwise(1 / (n["n"] - n[f"p{i}"] + 2)) for i, y in enumerate(targets)]
    found = [(1.0, 0.0)] * len(margins)
    for _ in range(rounds):
        sums = []
        for i, (x, t) in enumerate(zip(margins, soft, strict=True)):
            q = sigmoid(found[i][0] * x + found[i][1])
            d, h = weight * (t - q), weight * F.greatest(q * (1 - q), F.lit(1e-9))
            sums += [F.sum(v).alias(f"{k}{i}") for k, v in (("a", d * x), ("b", d), ("xx", h * x * x), ("x", h * x), ("h", h))]
        one = df.agg(*sums).first()
        moved = 0.0
        for i in range(len(margins)):
            hess = np.array([[one[f"xx{i}"], one[f"x{i}"]], [one[f"x{i}"], one[f"h{i}"]]]) + 1e-9 * np.eye(2)
            step = np.clip(np.linalg.solve(hess, [one[f"a{i}"], one[f"b{i}"]]), -2, 2)
            found[i] = (found[i][0] + float(step[0]), found[i][1] + float(step[1]))
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-9:
            break
    return found


class _Mixture(_Inputs):
    gateFeatures = Param(Params._dummy(), "gateFeatures", "columns that decide a row's part; empty: all features", TypeConverters.toListString)
    clusters = Param(Params._dummy(), "clusters", "parts and experts, at least 2", TypeConverters.toInt)
    folds = Param(Params._dummy(), "folds", "folds of the gate's calibration, at least 2", TypeConverters.toInt)
    gateTrees = Param(Params._dummy(), "gateTrees", "stumps of the gate", TypeConverters.toInt)
    gateRate = Param(Params._dummy(), "gateRate", "share of each stump that counts", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of k-means and folds", TypeConverters.toInt)
    centres = Param(Params._dummy(), "centres", "fixed centres in standard units, one after another; empty: k-means", Numbers)
    means = Param(Params._dummy(), "means", "means that go with fixed centres", Numbers)
    deviations = Param(Params._dummy(), "deviations", "deviations that go with fixed centres", Numbers)

    def gated(self) -> list[str]:
        return self.value("gateFeatures") or self.value("features")


class MonotoneMixture(_Mixture, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """A mixture of monotone boosted experts under a calibrated gate of stumps.

    Gate features are standardised by weighted moments and cut by weighted k-means (or by given centres with their moments,
    which are not fitted again). Stumps learn the parts one against the rest; sigmoid curves fitted to out-of-fold scores turn
    their margins into probabilities, normalised over the parts (with two parts: one and its complement). Each expert is
    fitted to all rows, weighted by its gate, and the score pools the experts' probabilities. All fold's stumps grow in the
    same jobs. Parts with fewer rows than folds are refused.
    """

    @keyword_only
    def __init__(self, *, features=None, label="y", weight="", score="score", signs=None, trees=50, depth=2, rate=0.05, bins=32, gateFeatures=None, clusters=2, folds=5, gateTrees=100, gateRate=0.1, seed=0, centres=None, means=None, deviations=None):
        super().__init__()
        self._setDefault(label="y", weight="", score="score", signs=[], trees=50, depth=2, rate=0.05, bins=32, gateFeatures=[], clusters=2, folds=5, gateTrees=100, gateRate=0.1, seed=0, centres=[], means=[], deviations=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _checked(self) -> dict[str, int]:
        signs, gate, k = self._directions(True), self.gated(), self.value("clusters")
        if len(set(gate)) != len(gate) or set(gate) - set(self.value("features")):
            raise ValueError("gateFeatures must be features, each once")
        if k < 2 or self.value("folds") < 2 or self.value("gateTrees") < 1 or self.value("trees") < 1:
            raise ValueError("there must be at least 2 clusters, 2 folds, and a tree of each kind")
        fixed = [len(self.value(p)) for p in ("centres", "means", "deviations")]
        if any(fixed) and fixed != [k * len(gate), len(gate), len(gate)]:
            raise ValueError("fixed centres need clusters x gate features numbers, with a mean and a deviation for each feature")
        if not np.isfinite([*self.value("centres"), *self.value("means"), *self.value("deviations")]).all() or any(d <= 0 for d in self.value("deviations")):
            raise ValueError("fixed centres and moments must be finite, deviations positive")
        return signs

    def _fit(self, df: DataFrame) -> MonotoneMixtureModel:
        signs = self._checked()
        ready = self._prepared(df)
        try:
            return self._fitted(ready, signs)
        finally:
            ready.unpersist()

    def _fitted(self, ready: DataFrame, signs: dict[str, int]) -> MonotoneMixtureModel:
        features, gate, k, folds = self.value("features"), self.gated(), self.value("clusters"), self.value("folds")
        if {r[0] for r in ready.select("_y").distinct().limit(3).collect()} != {0.0, 1.0}:
            raise ValueError("the label must have both values, 0 and 1")
        means, deviations, centres = self.value("means"), self.value("deviations"), self.value("centres")
        if not centres:
            w = F.sum("_w")
            one = ready.agg(*[(F.sum(F.col("_w") * F.col(f)) / w).alias(f"m_{f}") for f in gate], *[(F.sum(F.col("_w") * F.col(f) * F.col(f)) / w).alias(f"q_{f}") for f in gate]).first()
            means = [float(one[f"m_{f}"]) for f in gate]
            deviations = [float(d) if (d := math.sqrt(max(0.0, one[f"q_{f}"] - m * m))) > 1e-12 else 1.0 for f, m in zip(gate, means, strict=True)]
        state = {"means": list(means), "deviations": list(deviations)}
        z = [f"_z{i}" for i in range(len(gate))]
        ready = ready.withColumns(dict(zip(z, MonotoneMixtureModel.standard(gate, state), strict=True)))
        points = np.reshape(centres, (k, len(gate))).tolist() if centres else weighted_centres(ready, z, "_w", k, self.value("seed"))
        cuts = grid(ready, z, self.value("bins"))
        state |= {"centres": points, "cuts": [cuts[f] for f in z]}
        fold = F.pmod(F.xxhash64(F.lit(self.value("seed")), *z, F.monotonically_increasing_id()), F.lit(folds)).cast("int")
        held = ready.withColumns({"_c": nearest_centre(z, points), "_fold": fold} | {f"_b{i}": b for i, b in enumerate(bin_columns(z, cuts))}).persist()
        bins, sizes = [f"_b{i}" for i in range(len(z))], [len(cuts[f]) + 1 for f in z]
        # the gate sees a row's bins, part and fold only, so it is fitted to cells of equal ones with their summed weights
        cells = held.groupBy(*bins, "_c", "_fold").agg(F.sum("_w").alias("_w"), F.count("*").alias("_n")).persist()
        counts = {r["_c"]: r["n"] for r in cells.groupBy("_c").agg(F.sum("_n").alias("n")).collect()}
        if any(counts.get(c, 0) < folds for c in range(k)):
            cells.unpersist()
            held.unpersist()
            raise UnsupportedPartition(f"a part has fewer than {folds} rows: {[counts.get(c, 0) for c in range(k)]}")
        classes = [1] if k == 2 else list(range(k))
        target = {c: (F.col("_c") == c).cast("double") for c in classes}
        # the models of all rows first, then those without each fold
        models = [(c, None) for c in classes] + [(c, x) for c in classes for x in range(folds)]
        base, table = grow_stumps(cells, bins, sizes, [target[c] for c, _ in models], [F.col("_w") if x is None else F.col("_w") * (F.col("_fold") != x).cast("double") for _, x in models], self.value("gateTrees"), self.value("gateRate"))
        outside = []
        for c in classes:
            margin = F.lit(0.0)
            for (of, x), b, t in zip(models, base, table, strict=True):
                if of == c and x is not None:
                    margin = F.when(F.col("_fold") == x, stump_margin(bins, b, t)).otherwise(margin)
            outside.append(margin)
        curves = fit_curves(cells, outside, [target[c] for c in classes], F.col("_w"))
        state |= {"base": base[: len(classes)], "table": [[t.tolist() for t in tables] for tables in table[: len(classes)]], "curves": [list(c) for c in curves]}
        model = MonotoneMixtureModel(state)
        self._copyValues(model)
        gates = model.gates([F.col(b) for b in bins])
        mass = cells.agg(*[F.sum(F.col("_w") * g).alias(f"g{i}") for i, g in enumerate(gates)]).first()
        cells.unpersist()
        if any(not v or v <= 0 for v in mass):
            held.unpersist()
            raise UnsupportedPartition("every expert must get weight")
        experts = [boost(held.withColumn("_gate", F.col("_w") * g), features, "_y", "logistic", self.value("trees"), self.value("depth"), self.value("bins"), self.value("rate"), signs, weight="_gate") for g in gates]
        held.unpersist()
        state |= {"experts": [{"base": float(e.base), "trees": list(map(packed_tree, e.trees))} for e in experts], "counts": [counts[c] for c in range(k)], "mass": list(map(float, mass))}
        return model


def weighted_centres(df: DataFrame, features: Sequence[str], weight: str, k: int, seed: int, starts: int = 5) -> list[list[float]]:
    """Centres of the best of several weighted k-means starts by cost, in order."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=list(features), outputCol="_v").transform(df).select("_v", weight).persist()
    found = [KMeans(k=k, featuresCol="_v", weightCol=weight, seed=seed + s).fit(ready) for s in range(starts)]
    ready.unpersist()
    return sorted([list(map(float, c)) for c in min(found, key=lambda m: m.summary.trainingCost).clusterCenters()])


class MonotoneMixtureModel(_Mixture, _Stored):
    """Adds to rows: the score (pooled probability of 1), `<score>_gate` and `<score>_experts` (arrays) and `<score>_cluster`."""

    @staticmethod
    def standard(gate: Sequence[str], state: dict) -> list[Column]:
        return [(F.col(f).cast("double") - m) / d for f, m, d in zip(gate, state["means"], state["deviations"], strict=True)]

    def gates(self, bins: Sequence[Column]) -> list[Column]:
        p = [sigmoid(a * stump_margin(bins, b, t) + c) for b, t, (a, c) in zip(self.state["base"], self.state["table"], self.state["curves"], strict=True)]
        if len(p) == 1:
            return [1 - p[0], p[0]]
        total = sum(p[1:], p[0])
        return [x / total for x in p]

    def experts(self) -> list[Column]:
        return [sigmoid(T.additive([unpacked_tree(t) for t in e["trees"]], e["base"])) for e in self.state["experts"]]

    def _transform(self, df: DataFrame) -> DataFrame:
        gate, score = self.gated(), self.value("score")
        z = [f"_z{i}" for i in range(len(gate))]
        bins = [f"_b{i}" for i in range(len(gate))]
        cuts = dict(zip(z, self.state["cuts"], strict=True))
        out = df.withColumns(dict(zip(z, self.standard(gate, self.state), strict=True)))
        out = out.withColumns(dict(zip(bins, bin_columns(z, cuts), strict=True)))
        out = out.withColumns({f"{score}_cluster": nearest_centre(z, self.state["centres"]), f"{score}_gate": F.array(*self.gates([F.col(b) for b in bins])), f"{score}_experts": F.array(*self.experts())})
        pooled = F.aggregate(F.zip_with(f"{score}_gate", f"{score}_experts", lambda g, e: g * e), F.lit(0.0), lambda a, x: a + x)
        return out.withColumn(score, pooled).drop(*z, *bins)
