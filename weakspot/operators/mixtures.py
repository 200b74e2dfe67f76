"""Mixtures and decompositions: Nystroem spectral cells, purified effect tables, softmax gates, group partitions."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import log_loss, sigmoid
from . import trees as T
from .models import fit_logistic


#: Groups whose losses the softmax mixture follows.
MOST_GROUPS = 10_000


def spectral_cells(rows: DataFrame, key: str, trees: Sequence, landmarks: int, k: int, seed: int = 0, also: Sequence[str] = ()) -> DataFrame:
    """key, cluster and the columns in `also` (_codes: the leaves): Nystroem coordinates of the leaf kernel from a bounded set of landmark rows, then k-means.

    The landmarks' kernel is decomposed on the driver; every row's coordinates are sums of literals over its leaves.
    """
    coded = rows.withColumn("_codes", T.codes(trees))
    chosen = coded.orderBy(F.xxhash64(F.lit(seed), key), key).limit(landmarks).select("_codes").collect()
    c = np.unique(np.array([r["_codes"] for r in chosen]), axis=0)
    kernel = (c[:, None, :] == c[None, :, :]).mean(axis=2)
    degree = kernel.sum(axis=1)
    value, vector = np.linalg.eigh(kernel / np.sqrt(degree[:, None] * degree[None, :]))
    top = np.argsort(-value)[: min(k, len(value))]
    weight = vector[:, top] / np.sqrt(degree)[:, None] / np.maximum(value[top], 1e-9)
    leaves = [np.unique(c[:, t]) for t in range(len(trees))]
    # for each tree, the summed weights of the landmarks in a leaf, by coordinate; other leaves are 0
    tables = [dict(zip(held.tolist(), [weight[c[:, t] == leaf].sum(axis=0) / len(trees) for leaf in held], strict=True)) for t, held in enumerate(leaves)]
    none = np.zeros(len(top))

    @F.pandas_udf("array<double>")
    def coordinates(codes):
        known: dict[bytes, list[float]] = {}  # of a batch's distinct leaf vectors

        def of(row):
            name = row.tobytes()
            if name not in known:
                known[name] = sum((table.get(int(leaf), none) for table, leaf in zip(tables, row, strict=True)), none).tolist()
            return known[name]

        return codes.map(of)

    names = [f"_s{j}" for j in range(len(top))]
    coded = coded.select(key, *also, coordinates("_codes").alias("_s")).select(key, *also, *[F.get("_s", F.lit(j)).alias(n) for j, n in enumerate(names)])
    from .models import kmeans

    return kmeans(coded, names, k, 2, seed).select(key, *also, "cluster")


def best_leaf(rows: DataFrame, loss: str, cell: Column, least: int) -> DataFrame:
    """cell, n, mean of the cell of largest mean loss among those of `least` rows; the lowest cell among equals."""
    return rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.avg(loss).alias("mean")).where(F.col("n") >= least).orderBy(F.desc(F.round("mean", 10)), "cell").limit(1)


def purify(table: np.ndarray, weight: np.ndarray, rounds: int = 200, least: float = 1e-10) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """mean, two main effects and the interaction of a table, each with weighted mean 0 along every axis.

    Mass moves from the table to the mains until nothing over `least` moves.
    """
    rest, a, b, mean = table.astype(float).copy(), np.zeros(table.shape[0]), np.zeros(table.shape[1]), 0.0
    wa, wb = weight.sum(axis=1), weight.sum(axis=0)
    for _ in range(rounds):
        da = np.divide((rest * weight).sum(axis=1), wa, out=np.zeros_like(a), where=wa > 0)
        rest -= da[:, None]
        db = np.divide((rest * weight).sum(axis=0), wb, out=np.zeros_like(b), where=wb > 0)
        rest -= db[None, :]
        a, b = a + da, b + db
        if max(np.abs(da).max(initial=0), np.abs(db).max(initial=0)) < least:
            break
    total = weight.sum()
    ma, mb = float((a * wa).sum() / total), float((b * wb).sum() / total)
    mean += ma + mb
    return mean, a - ma, b - mb, rest


def effect_tables(rows: DataFrame, trees: Sequence, cuts: dict, pair: tuple[str, str]) -> dict:
    """The purified table of a pair of features: the trees' sum on the grid of cuts, weighted by the rows of each cell."""
    from ..functions.arrays import edges_under

    f, g = pair
    grid = lambda x: [-math.inf, *cuts[x]]
    middle = lambda x, i: (cuts[x][i] if i < len(cuts[x]) else (cuts[x][-1] + 1 if cuts[x] else 0.0))
    table = np.zeros((len(grid(f)), len(grid(g))))
    for i, j in itertools.product(range(table.shape[0]), range(table.shape[1])):
        point = {f: middle(f, i), g: middle(g, j)}
        table[i, j] = sum(_value(t, point) for t in trees)
    weight = np.zeros_like(table)
    place = lambda x: edges_under(F.array(*[F.lit(float(e)) for e in cuts[x]]) if cuts[x] else F.array().cast("array<double>"), F.col(x))
    for r in rows.groupBy(place(f).alias("i"), place(g).alias("j")).count().collect():  # at most the grid's cells
        weight[r["i"], r["j"]] = r["count"]
    mean, a, b, rest = purify(table, weight)
    total = max(1.0, weight.sum())
    importance = {f: float((a**2 * weight.sum(axis=1)).sum() / total), g: float((b**2 * weight.sum(axis=0)).sum() / total), "pair": float((rest**2 * weight).sum() / total)}
    return {"mean": mean, f: a, g: b, "pair": rest, "importance": importance}


def _value(tree, point) -> float:
    while isinstance(tree, T.Split):
        tree = tree.left if point[tree.feature] <= tree.threshold else tree.right
    return tree.value


def partitions(groups: Sequence, parts: int) -> list[list[list]]:
    """All ways to deal groups to at most `parts` experts, each once."""
    out: list[list[list]] = []

    def deal(i, held):
        if i == len(groups):
            out.append([list(h) for h in held])
            return
        for h in held:
            h.append(groups[i])
            deal(i + 1, held)
            h.pop()
        if len(held) < parts:
            held.append([groups[i]])
            deal(i + 1, held)
            held.pop()

    deal(0, [])
    return out


def partition_frontier(rows: DataFrame, group: str, groups: Sequence, features: Sequence[str], y: str, parts: int = 2) -> DataFrame:
    """partition, mean, worst: log loss of one logistic model a block, overall and in the worst group; nondominated ones only."""
    fitted: dict = {}
    out = []
    for p in partitions(list(groups), parts):
        score = F.lit(None).cast("double")
        for block in p:
            key = tuple(sorted(block))
            if key not in fitted:
                fitted[key] = fit_logistic(rows.where(F.col(group).isin(list(block))), features, y, 1e-4).expression
            score = F.when(F.col(group).isin(list(block)), fitted[key]).otherwise(score)
        by = rows.groupBy(group).agg(F.sum(log_loss(F.col(y), score)).alias("s"), F.count("*").alias("n")).collect()
        out.append((str(p), sum(r["s"] for r in by) / sum(r["n"] for r in by), max(r["s"] / r["n"] for r in by)))
    keep = [a for a in out if not any(b[1] <= a[1] and b[2] <= a[2] and b[1:] != a[1:] for b in out)]
    return rows.sparkSession.createDataFrame(keep, "partition string, mean double, worst double")


def _softmax_rows(x: np.ndarray, y: np.ndarray, gate: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """A row for each of x: 1, its loss, and the loss's gradient by gate and by coef, both flat."""
    z = x @ gate
    r = np.exp(z - z.max(axis=1, keepdims=True))
    r /= r.sum(axis=1, keepdims=True)
    q = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
    p = np.clip((r * q).sum(axis=1), 1e-7, 1 - 1e-7)
    loss = -(y * np.log(p) + (1 - y) * np.log(1 - p))
    dp = ((p - y) / (p * (1 - p)))[:, None]
    by = lambda d: (x[:, :, None] * (dp * d)[:, None, :]).reshape(len(x), -1)
    return np.hstack([np.ones((len(x), 1)), loss[:, None], by(r * (q - (r * q).sum(axis=1, keepdims=True))), by(r * q * (1 - q))])


def softmax_mixture(rows: DataFrame, features: Sequence[str], y: str, group: str, experts: int = 2, steps: int = 400, rate: float = 0.05, worst: bool = False, seed: int = 0) -> tuple[dict, dict]:
    """A softmax gate over logistic experts by Adam, for the mean loss or (softly) the worst group's, over all rows.

    Returns parameters, for mixture_expression(), and {mean, worst} losses of the last step. Each step is one job: tasks add up
    losses and gradients by group, so only a row a group comes to the driver; more than MOST_GROUPS groups are refused. Rows
    with a null feature, y or group take no part; without any rows the parameters are the first ones and there are no losses.
    Sums depend on the order of tasks in their last digits.
    """
    dice = np.random.default_rng(seed)
    width = len(features) + 1
    gate, coef = dice.normal(0, 0.1, (width, experts)), dice.normal(0, 0.1, (width, experts))
    size = 2 + 2 * width * experts
    held = [np.zeros_like(gate), np.zeros_like(coef), np.zeros_like(gate), np.zeros_like(coef)]
    names = ["_g", "_y", *(f"_x{i}" for i in range(len(features)))]
    values = [F.col(y).cast("double"), *(F.col(f).cast("double") for f in features)]
    used = rows.select(F.col(group).cast("string").alias("_g"), *[v.alias(n) for v, n in zip(values, names[1:], strict=True)]).dropna().persist()

    def sums(gate, coef):
        def run(batches):
            total: dict = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                code = batch.column(0).dictionary_encode()
                at = code.indices.to_numpy()
                flat = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
                each = _softmax_rows(np.column_stack([*flat[1:], np.ones(batch.num_rows)]), flat[0], gate, coef)
                by = np.argsort(at, kind="stable")
                starts = np.flatnonzero(np.diff(at[by], prepend=-1))
                for name, s in zip(code.dictionary.take(pa.array(at[by][starts])).to_pylist(), np.add.reduceat(each[by], starts, axis=0), strict=True):
                    total[name] = total[name] + s if name in total else s
                if len(total) > MOST_GROUPS:
                    raise ValueError(f"over {MOST_GROUPS} groups")
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([s.tolist() for s in total.values()], pa.list_(pa.float64()))], names=["_g", "s"])

        found = used.mapInArrow(run, "_g string, s array<double>").groupBy("_g").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(size)])
        return sorted(found.limit(MOST_GROUPS + 1).collect())

    losses: dict = {}
    known: list = []
    try:
        for t in range(1, steps + 1):
            found = sums(gate, coef)
            if len(found) > MOST_GROUPS:
                raise ValueError(f"over {MOST_GROUPS} groups")
            if not found:
                break
            known, table = [r[0] for r in found], np.array([r[1:] for r in found])
            n, by = table[:, 0], table[:, 1] / table[:, 0]
            losses = {"mean": float(table[:, 1].sum() / n.sum()), "worst": float(by.max())}
            w = np.exp((by - by.max()) * 20) / n if worst else np.ones(len(n))
            gradient = w @ table[:, 2:] / (w @ n)
            for i, (param, g) in enumerate(zip((gate, coef), np.split(gradient, 2), strict=True)):
                g = g.reshape(width, experts)
                held[i] = 0.9 * held[i] + 0.1 * g
                held[i + 2] = 0.999 * held[i + 2] + 0.001 * g * g
                param -= rate * (held[i] / (1 - 0.9**t)) / (np.sqrt(held[i + 2] / (1 - 0.999**t)) + 1e-8)
    finally:
        used.unpersist()
    return {"gate": gate, "coef": coef, "groups": known}, losses


def mixture_expression(parameters: dict, features: Sequence[str]) -> Column:
    gate, coef = parameters["gate"], parameters["coef"]
    line = lambda m, k: sum((F.lit(float(m[i, k])) * F.col(f) for i, f in enumerate(features)), F.lit(float(m[-1, k])))
    z = [line(gate, k) for k in range(gate.shape[1])]
    top = F.greatest(*z) if len(z) > 1 else z[0]
    e = [F.exp(v - top) for v in z]
    total = sum(e[1:], e[0])
    return sum(((w / total) * sigmoid(line(coef, k)) for k, w in enumerate(e)), F.lit(0.0))
