"""Corrections of a model's margin in leaf space, mixed by gates: all components and folds are fitted in the same jobs.

A row is the one-hot vector of its leaves. Its second moments are added up in tasks; the driver keeps the leading eigenvectors
(their number is bounded by the trees' leaves), and each step of reweighted least squares adds up the Gram matrices of all
models in that basis. Rows of one batch with equal leaves have one vector, so their weights are added first and the matrices
are made for the distinct vectors. What is fitted is a value a leaf, so scores are plain tree expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import sigmoid
from . import trees as T
from .evaluate import auc

#: Partial sums of a model are first added up in so many tasks.
FAN = 32
P_CLIP, LEAST_WEIGHT = 1e-6, 1e-6


def leaf_index(trees: Sequence) -> list[np.ndarray]:
    """For each tree, the column of each of its leaf codes among all leaves."""
    out, at = [], 0

    def codes(node):
        return [node.code] if isinstance(node, T.Leaf) else codes(node.left) + codes(node.right)

    for tree in trees:
        held = sorted(codes(tree))
        place = np.full(max(held) + 1, -1)
        place[held] = at + np.arange(len(held))
        out.append(place)
        at += len(held)
    return out


def _revalued(node, place: np.ndarray, values: np.ndarray):
    if isinstance(node, T.Leaf):
        return T.Leaf(node.code, float(values[place[node.code]]))
    return T.Split(node.feature, node.threshold, _revalued(node.left, place, values), _revalued(node.right, place, values))


def _columns(codes: pa.ListArray, index: Sequence[np.ndarray]) -> np.ndarray:
    held = codes.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(index))
    return np.stack([place[held[:, t]] for t, place in enumerate(index)], axis=1)


def _distinct(at: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of leaf columns, and for each row which of them it is."""
    key, most = np.zeros(len(at), dtype=np.int64), 1
    for t in range(at.shape[1]):
        if most * leaves >= 2**62:
            key, most = np.unique(key, return_inverse=True)[1].astype(np.int64), len(at)
        key, most = key * leaves + at[:, t], most * leaves
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    return at[first], which


def _partial(totals: np.ndarray) -> pa.RecordBatch:
    """A task's sums, a row a model."""
    return pa.RecordBatch.from_pydict({"model": pa.array(np.arange(len(totals), dtype=np.int32)), "total": pa.array([t.tobytes() for t in totals], pa.binary())})


def summed(parts: DataFrame, count: int, size: int) -> np.ndarray:
    """count x size sums of rows (model int, total binary), by way of FAN tasks a model."""

    def add(frames):
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            for model, total in zip(frame["model"], frame["total"], strict=True):
                held[model] = held.get(model, 0) + np.frombuffer(total)
        if held:
            yield pd.DataFrame({"model": list(held), "total": [x.tobytes() for x in held.values()]})

    once = parts.repartition(FAN, F.col("model"), F.spark_partition_id()).mapInPandas(add, "model int, total binary")
    out = np.zeros((count, size))
    for r in once.repartition(min(count, FAN), "model").mapInPandas(add, "model int, total binary").collect():  # a row a model
        out[r["model"]] += np.frombuffer(bytes(r["total"]))
    return out


def basis(coded: DataFrame, index: Sequence[np.ndarray], keep: float = 0.9995) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors (leaves x m) and eigenvalues of the rows' second moments, the fewest with `keep` of the trace."""
    leaves = sum(int((p >= 0).sum()) for p in index)

    def moments(batches):
        total = np.zeros((leaves, leaves))
        for batch in batches:
            at, which = _distinct(_columns(batch.column("_codes"), index), leaves)
            n = np.bincount(which, minlength=len(at)).astype(float)
            for a in range(0, len(at), 4096):
                hot = np.zeros((len(at[a : a + 4096]), leaves))
                np.put_along_axis(hot, at[a : a + 4096], 1.0, axis=1)
                total += hot.T @ (n[a : a + 4096, None] * hot)
        yield _partial((total / len(index))[None])

    second = summed(coded.select("_codes").mapInArrow(moments, "model int, total binary"), 1, leaves * leaves).reshape(leaves, leaves)
    value, vector = np.linalg.eigh(second)
    value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
    m = min(leaves, int(np.searchsorted(np.cumsum(value) / max(value.sum(), 1e-300), keep) + 1))
    return vector[:, :m], value[:m]


def evidence(gram: np.ndarray, slope: np.ndarray, power: float, n: float, ridges: int = 41) -> tuple[np.ndarray, np.ndarray]:
    """The grid of ridges, anchored at the mean of the Gram's diagonal, and n log(residual / n) + log det(1 + Gram / ridge) at each."""
    s, q = np.linalg.eigh(gram)
    s, b = np.maximum(s, 0), q.T @ slope
    grid = max(float(np.diag(gram).mean()), 1e-12) * 10.0 ** np.linspace(-8, 2, ridges)
    left = np.maximum(power - (b * b / (s + grid[:, None])).sum(axis=1), 1e-12)
    n = max(n, 1e-12)
    return grid, n * np.log(left / n) + np.log1p(s / grid[:, None]).sum(axis=1)


@dataclass
class Corrections:
    """Values of all leaves for each model, and how each was fitted."""

    trees: list
    index: list
    values: np.ndarray
    ridges: np.ndarray
    weights: np.ndarray
    rounds: int

    def margin(self, model: int) -> Column:
        """What a model adds to the base margin."""
        return T.additive([_revalued(t, p, self.values[model]) for t, p in zip(self.trees, self.index, strict=True)])

    def looked_up(self, codes: str, at: str, models: Sequence[int]) -> Column:
        """What the model at place `at` of models adds, by the row's leaf codes; null where there is no such place."""
        out = F.lit(0.0)
        for t, place in enumerate(self.index):
            values = np.where(place >= 0, self.values[list(models)][:, place], 0.0)
            out = out + F.get(F.array(*map(F.lit, values.ravel().tolist())), F.col(at) * len(place) + F.get(codes, F.lit(t)))
        return out


def labelled(rows: DataFrame, trees: Sequence, y: str) -> DataFrame:
    """rows of known label with it as _y and their leaves as _codes."""
    return rows.where(F.col(y).isNotNull()).withColumns({"_y": F.col(y).cast("double"), "_codes": T.codes(trees)})


def fit_corrections(rows: DataFrame, trees: Sequence, y: str, base: Column, weights: Sequence[Column], rounds: int = 5, ridges: int = 41, keep: float = 0.9995, tolerance: float = 1e-5, vectors: np.ndarray | None = None, cached: bool = False) -> Corrections:
    """One logistic correction of the margin `base` for each column of weights, by reweighted least squares in leaf space.

    Each round is one job for all models. The ridge of each model is the one of largest evidence in the first and the last
    round. Weights of 0 leave a row out; a model without weight corrects nothing. Rows of null label are left out. vectors is
    the rows' basis where it is known. Rows that come from cached ones are read again in each round, others are cached as they
    are coded.
    """
    index, trees = leaf_index(trees), list(trees)
    coded = labelled(rows, trees, y).select("_y", base.cast("double").alias("_base"), "_codes", *[F.coalesce(w.cast("double"), F.lit(0.0)).alias(f"_w{h}") for h, w in enumerate(weights)])
    if not cached:
        coded.persist()
    if vectors is None:
        vectors, _ = basis(coded, index, keep)
    m, count = vectors.shape[1], len(weights)
    projection = vectors / math.sqrt(len(trees))
    leaves = len(projection)
    beta, ridge = np.zeros((count, m)), np.zeros(count)

    def sums(batches):
        total = np.zeros((count, m * m + m + 2))
        for batch in batches:
            at, which = _distinct(_columns(batch.column("_codes"), index), leaves)
            y_, base_ = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_base"))
            x = np.zeros((len(at), m))
            for t in range(len(index)):
                x += projection[at[:, t]]
            added = lambda v: np.bincount(which, v, len(at))  # noqa: B023, E731
            for h in range(count):
                held = batch.column(f"_w{h}").to_numpy(zero_copy_only=False)
                add = (x @ beta[h])[which]
                p = np.clip(1 / (1 + np.exp(-np.clip(base_ + add, -30, 30))), P_CLIP, 1 - P_CLIP)
                w = np.maximum(p * (1 - p), LEAST_WEIGHT)
                z = add + (y_ - p) / w
                g = held * w
                total[h, : m * m] += (x.T @ (added(g)[:, None] * x)).ravel()
                total[h, m * m : -2] += x.T @ added(g * z)
                total[h, -2] += (g * z * z).sum()
                total[h, -1] += held.sum()
        yield _partial(total)

    n, used = np.zeros(count), 0
    for used in range(1, rounds + 1):
        found = summed(coded.mapInArrow(sums, "model int, total binary"), count, m * m + m + 2)
        new = np.zeros_like(beta)
        for h in range(count):
            gram, slope, power, n[h] = found[h, : m * m].reshape(m, m), found[h, m * m : -2], found[h, -2], found[h, -1]
            if n[h] <= 0:
                continue
            if used in (1, rounds):
                grid, curve = evidence(gram, slope, power, n[h], ridges)
                ridge[h] = grid[int(curve.argmin())]
            new[h] = np.linalg.solve(gram + ridge[h] * np.eye(m), slope)
        moved = np.linalg.norm(new - beta, axis=1) / (np.linalg.norm(new, axis=1) + 1e-12)
        beta = new
        if used > 1 and (moved < tolerance).all():
            break
    if not cached:
        coded.unpersist()
    return Corrections(trees, index, beta @ projection.T, ridge, n, used)


def pooled(fitted: Corrections, base: Column, gates: Sequence[Column], first: int = 0) -> Column:
    """The mixture's probability: gates of sigmoids of the corrected margins."""
    return sum((g * sigmoid(base + fitted.margin(first + h)) for h, g in enumerate(gates)), F.lit(0.0))


def fold_aucs(rows: DataFrame, trees: Sequence, y: str, base: Column, gates: Sequence[Column], fold: str, folds: int, least: float = 40.0, **fitting) -> list[float] | None:
    """AUC of each fold under the mixture fitted to the other folds; None where a gate starves a component of any fit.

    The fits of all folds are one set of jobs, their AUCs one more.
    """
    names = [f"_g{h}" for h in range(len(gates))]
    # gates are computed once a row and scores looked up by leaf: as one expression they pass what the JVM compiles
    ready = rows.withColumns({"_at": F.col(fold), "_margin": base.cast("double")} | dict(zip(names, gates, strict=True)))
    support = ready.agg(*[F.sum(F.when(F.col("_at") != k, F.col(g)).otherwise(0.0)).alias(f"s{k}_{g}") for k in range(folds) for g in names]).first()
    if any((s or 0.0) < least for s in support):
        return None
    if not rows.is_cached:
        ready.persist()
    fitted = fit_corrections(ready, trees, y, F.col("_margin"), [F.col(g) * (F.col("_at") != k).cast("double") for k in range(folds) for g in names], cached=True, **fitting)
    coded = ready.withColumn("_codes", T.codes(trees))
    parts = [F.col(g) * sigmoid(F.col("_margin") + fitted.looked_up("_codes", "_at", range(h, folds * len(names), len(names)))) for h, g in enumerate(names)]
    score = sum(parts[1:], parts[0])
    found = {r["_at"]: r["auc"] for r in auc(coded.select(y, "_at", score.alias("_score")), y, "_score", ["_at"]).collect()}  # a row a fold
    if not rows.is_cached:
        ready.unpersist()
    return [found.get(k) for k in range(folds)]


def fold_objective(rows: DataFrame, trees: Sequence, y: str, base: Column, gate_of: Callable[[np.ndarray], Sequence[Column]], fold: str, folds: int, penalty: float = -1.0, **other) -> Callable[[np.ndarray], float]:
    """The mean AUC over folds as a function of a gate's parameters; the penalty for gates that starve a component.

    Every value reads the rows several times: give them cached. The basis doesn't depend on the gate and is found once.
    """
    known: list = []

    def score(x: np.ndarray) -> float:
        if not known:
            known.append(basis(labelled(rows, trees, y), leaf_index(trees), other.get("keep", 0.9995))[0])
        found = fold_aucs(rows, trees, y, base, gate_of(x), fold, folds, vectors=known[0], **other)
        return penalty if found is None or any(v is None for v in found) else float(np.mean(found))

    return score


def es_search(score: Callable[[np.ndarray], float], start: Sequence[float], scales: Sequence[float], evals: int, seed: int = 0, sigma: float = 0.5, shrink: float = 0.85, restart_below: float = 0.02) -> tuple[np.ndarray, list[tuple[int, float, float, float]]]:
    """A (1 + 1) strategy with one step size over scaled parameters; the step starts anew once it is under restart_below.

    Returns the best parameters and the history: step, tried, best, sigma.
    """
    dice = np.random.default_rng(seed)
    at, scales, first = np.asarray(start, float), np.asarray(scales, float), sigma
    best = score(at)
    history = [(0, best, best, sigma)]
    for step in range(1, evals + 1):
        child = at + sigma * scales * dice.normal(size=len(at))
        found = score(child)
        if found > best:
            at, best, sigma = child, found, sigma / shrink
        else:
            sigma *= shrink
        if sigma < restart_below:
            sigma = first
        history.append((step, found, best, sigma))
    return at, history
