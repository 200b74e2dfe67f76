"""A regression tree of the loss, grown best split first from distributed histograms, and parts of the fitted loss kernel."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import edges_under
from . import trees as T
from .models import fit_error_model
from .mixtures import spectral_cells

#: Known leaves whose children are measured ahead, with those that have to be.
AHEAD = 8


def cut_points(rows: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Middles between a feature's distinct values where there are up to `bins` of them, else distinct quantiles."""
    few = rows.agg(*[F.approx_count_distinct(f, 0.02).alias(f) for f in features]).first()
    out: dict[str, list[float]] = {}
    small = [f for f in features if few[f] <= 1.2 * bins]
    for f in small:
        values = [r[0] for r in rows.select(F.col(f).cast("double")).where(F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))).distinct().limit(2 * bins).collect()]
        if len(values) <= bins:
            values.sort()
            out[f] = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    many = [f for f in features if f not in out]
    if many:
        row = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), [i / bins for i in range(1, bins)], 10_000).alias(f) for f in many]).first()
        out |= {f: sorted(set(map(float, row[f] or []))) for f in many}
    return {f: out[f] for f in features}


@dataclass
class Node:
    """Rows, loss sum and squares of a node, and its best split: gain, feature, number of the cut, left (n, s, q)."""

    n: int
    s: float
    q: float
    split: tuple | None = None

    @property
    def error(self) -> float:
        return max(0.0, self.q - self.s * self.s / self.n) if self.n else 0.0


@dataclass
class ErrorTree:
    """A fitted tree: `tree` for scoring, the paths of its leaves in the order of their codes, and what each holds."""

    tree: T.Split | T.Leaf
    leaves: list[tuple[int, ...]]
    nodes: dict[tuple[int, ...], Node] = field(default_factory=dict)

    def strongest(self, least: int) -> int:
        """The code of the leaf of largest mean loss among those of `least` rows; the first among equals."""
        means = [(round(self.nodes[p].s / self.nodes[p].n, 12), -i) for i, p in enumerate(self.leaves) if self.nodes[p].n >= max(1, least)]
        if not means:
            raise ValueError("no leaf reached the required support")
        return -max(means)[1]

    def region(self, least: int) -> Column:
        """The strongest leaf as a predicate."""
        return T.code(self.tree) == self.strongest(least)


def _best(hist: dict[str, np.ndarray], cuts: dict[str, list[float]], node: Node, least: int) -> tuple | None:
    """The split of largest reduction of squared error; the first feature and the lowest cut among equals."""
    best = None
    for f, edges in cuts.items():
        if not edges:
            continue
        left = hist[f].cumsum(axis=0)[: len(edges)]
        n, s = left[:, 0], left[:, 1]
        rest_n, rest_s = node.n - n, node.s - s
        fits = (n >= least) & (rest_n >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, s * s / n + rest_s * rest_s / rest_n - node.s * node.s / node.n, -np.inf)
        i = int(gain.argmax())
        floor = 1e-12 * max(1.0, node.q)
        if gain[i] > floor and (best is None or gain[i] > best[0] + floor):
            best = (float(gain[i]), f, i, tuple(left[i]))
    return best


def fit_error_tree(rows: DataFrame, features: Sequence[str], loss: str, least: int, max_leaves: int = 32, alpha: float = 0.0, bins: int = 64) -> ErrorTree:
    """A tree of at most max_leaves leaves of `least` rows each, grown by the largest gain and pruned by cost-complexity alpha.

    One aggregation measures all leaves that wait for their best split, and the children of the leaves likely to be split
    next: nodes x features x bins rows come to the driver. Features with up to `bins` distinct values are split exactly,
    others at quantiles. Null and NaN values go right; rows of null loss are left out. Leaves are numbered from left to right.
    """
    held = rows.where(F.col(loss).isNotNull())
    cuts = cut_points(held, features, bins)
    edges = {f: F.array(*map(F.lit, cuts[f])) if cuts[f] else F.array().cast("array<double>") for f in features}
    bin_of = [F.when(F.isnan(F.col(f).cast("double")) | F.col(f).isNull(), F.lit(len(cuts[f]))).otherwise(edges_under(edges[f], F.col(f).cast("double"))).cast("int").alias(f"_b_{f}") for f in features]
    prepared = held.select(F.col(loss).cast("double").alias("_r"), *bin_of).persist()
    nodes: dict[tuple[int, ...], Node] = {}

    def inside(path) -> Column:
        out = F.lit(True)
        for k, side in enumerate(path):
            _, f, i, _ = nodes[path[:k]].split
            out = out & ((F.col(f"_b_{f}") <= i) if side == 0 else (F.col(f"_b_{f}") > i))
        return out

    def measure(paths):
        place = F.lit(None).cast("int")
        for i, path in enumerate(paths):
            place = F.when(inside(path), i).otherwise(place)
        cells = [F.struct(F.lit(j).alias("f"), F.col(f"_b_{f}").alias("b")) for j, f in enumerate(features)]
        long = prepared.select(place.alias("node"), "_r", F.inline(F.array(*cells))).where("node is not null")
        found = [{f: np.zeros((len(cuts[f]) + 1, 3)) for f in features} for _ in paths]
        for r in long.groupBy("node", "f", "b").agg(F.count("*").alias("n"), F.sum("_r").alias("s"), F.sum(F.col("_r") * F.col("_r")).alias("q")).collect():
            found[r["node"]][features[r["f"]]][r["b"]] = r["n"], r["s"], r["q"]
        for path, hist in zip(paths, found, strict=True):
            n, s, q = hist[features[0]].sum(axis=0)
            nodes[path] = Node(int(n), float(s), float(q))
            nodes[path].split = _best(hist, cuts, nodes[path], max(1, least))

    leaves = [()]
    while len(leaves) < max_leaves:
        waiting = [p for p in leaves if p not in nodes]
        if waiting:
            known = sorted((p for p in leaves if p in nodes and nodes[p].split), key=lambda p: (-nodes[p].split[0], p))[:AHEAD]
            measure(waiting + [(*p, side) for p in known for side in (0, 1) if (*p, side) not in nodes])
        ready = [p for p in leaves if nodes[p].split]
        if not ready:
            break
        top = max(ready, key=lambda p: (nodes[p].split[0], tuple(-x for x in p)))
        leaves.remove(top)
        leaves += [(*top, 0), (*top, 1)]
    waiting = [p for p in leaves if p not in nodes]
    if waiting:
        measure(waiting)
    prepared.unpersist()
    kept = set(_pruned(leaves, nodes, alpha))
    order: list = []

    def build(path):
        if path in kept:
            order.append(path)
            node = nodes[path]
            return T.Leaf(len(order) - 1, node.s / node.n if node.n else math.nan)
        _, f, i, _ = nodes[path].split
        return T.Split(f, cuts[f][i], build((*path, 0)), build((*path, 1)))

    return ErrorTree(build(()), order, nodes)


def _pruned(leaves, nodes, alpha: float) -> list[tuple[int, ...]]:
    """Leaves after collapsing, weakest link first, all nodes whose split saves at most alpha a leaf (errors a row)."""
    leaves, total = list(leaves), max(1, nodes[()].n)
    while alpha > 0 and len(leaves) > 1:
        weakest = None
        for node in sorted({p[:k] for p in leaves for k in range(len(p))}, key=lambda p: (len(p), p)):
            below = [p for p in leaves if p[: len(node)] == node]
            link = (nodes[node].error - sum(nodes[p].error for p in below)) / total / (len(below) - 1)
            if weakest is None or link < weakest[0]:
                weakest = (link, node)
        if weakest[0] > alpha:
            break
        leaves = [p for p in leaves if p[: len(weakest[1])] != weakest[1]] + [weakest[1]]
    return leaves


def leaf_cells(rows: DataFrame, fitted: ErrorTree, loss: str, least: int) -> DataFrame:
    """cell, n, mean, best of each leaf over any rows; best marks the region that the fit chose, so it can be confirmed."""
    chosen = fitted.strongest(least)
    return rows.where(F.col(loss).isNotNull()).groupBy(T.code(fitted.tree).alias("cell")).agg(F.count("*").alias("n"), F.avg(loss).alias("mean")).withColumn("best", F.col("cell") == chosen)


def loss_kernel_parts(rows: DataFrame, key: str, features: Sequence[str], loss: str, least: int, k: int = 8, landmarks: int = 500, trees: int = 60, depth: int = 3, seed: int = 0) -> DataFrame:
    """cluster, n, mean, best, agreement: spectral parts of the leaf kernel of an error model fitted to these rows.

    best marks the part of largest mean loss among those of `least` rows (no part is marked where none has them); agreement is
    the share of its rows that the router by mean leaf vectors, the rule for new rows, sends to it as well.
    """
    held = rows.where(F.col(loss).isNotNull())
    model = fit_error_model(held, features, loss, trees, depth)
    # part and route follow from a row's leaves, so classes of equal ones stand for their rows
    labels = spectral_cells(held, key, model.trees, landmarks, k, seed, [loss, "_codes"])
    classes = labels.groupBy("_codes", "cluster").agg(F.count("*").alias("n"), F.sum(loss).alias("s")).persist()
    embedded = classes.select("_codes", "cluster", "n", F.posexplode("_codes").alias("tree", "leaf"))
    sizes = classes.groupBy("cluster").agg(F.sum("n").alias("k"))
    means = embedded.groupBy("cluster", "tree", "leaf").agg(F.sum("n").alias("c")).join(F.broadcast(sizes), "cluster").select("cluster", "tree", "leaf", (F.col("c") / F.col("k")).alias("weight"))
    sent = T.route(embedded.drop("cluster"), means, "_codes").withColumnRenamed("cluster", "sent")
    agreed = F.sum(F.col("n") * (F.col("sent") == F.col("cluster")).cast("double")) / F.sum("n")
    cells = classes.join(sent, "_codes").groupBy("cluster").agg(agreed.alias("agreement"), (F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("n")).select("cluster", "n", "mean", "agreement")
    # one row a part
    top = cells.where(F.col("n") >= least).agg(F.max_by("cluster", F.struct(F.round("mean", 12), -F.col("cluster"))).alias("_top"))
    return cells.crossJoin(F.broadcast(top)).select("cluster", "n", "mean", F.coalesce(F.col("cluster") == F.col("_top"), F.lit(False)).alias("best"), "agreement")
