"""Corrections in leaf space against dense algebra, folds' AUC against brute force, and the search's rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weakspot.operators import leaf_mixture as L
from weakspot.operators import trees as T

TREES = [T.Split("a", 0.0, T.Leaf(0, 0), T.Split("b", 0.4, T.Leaf(3, 0), T.Leaf(1, 0))), T.Split("b", -0.3, T.Leaf(0, 0), T.Leaf(1, 0)), T.Split("a", 0.9, T.Leaf(0, 0), T.Leaf(1, 0))]


@pytest.fixture(scope="module")
def rows(spark):
    dice = np.random.default_rng(7)
    x = dice.normal(size=(400, 2))
    y = dice.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 1.5 * (x[:, 1] > 0))))
    return spark.createDataFrame([(i, float(a), float(b), int(t), i % 4) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, y int, fold int").repartition(5).persist()


def dense(data):
    """One-hot leaves over the square root of the number of trees, in the order of trees and codes."""
    places = {(t, c): i for i, (t, c) in enumerate((t, c) for t, held in enumerate(([0, 1, 3], [0, 1], [0, 1])) for c in held)}
    psi = np.zeros((len(data), 7))
    for i, r in enumerate(data):
        for t, c in enumerate(r["codes"]):
            psi[i, places[t, c]] = 1 / math.sqrt(3)
    return psi


def by_hand(psi, y, base, gamma, rounds=5):
    """Least squares on the dense matrix; the ridge by a grid of direct solves."""
    beta, ridge = np.zeros(psi.shape[1]), 0.0
    for k in range(1, rounds + 1):
        p = np.clip(1 / (1 + np.exp(-(base + psi @ beta))), 1e-6, 1 - 1e-6)
        w = np.maximum(p * (1 - p), 1e-6)
        z, g = psi @ beta + (y - p) / w, gamma * w
        a, b = psi.T @ (g[:, None] * psi), psi.T @ (g * z)
        if k in (1, rounds):
            value, vector = np.linalg.eigh(psi.T @ psi)
            kept = vector[:, value > 1e-9]
            scale = np.diag(kept.T @ a @ kept).mean()
            best = None
            for lam in scale * 10.0 ** np.linspace(-8, 2, 41):
                solved = np.linalg.solve(a + lam * np.eye(len(a)), b)
                n = gamma.sum()
                left = (g * z * z).sum() - b @ solved
                curve = n * math.log(left / n) + np.linalg.slogdet(np.eye(len(a)) + a / lam)[1]
                if best is None or curve < best[0]:
                    best = (curve, lam)
            ridge = best[1]
        new = np.linalg.solve(a + ridge * np.eye(len(a)), b)
        done = k > 1 and np.linalg.norm(new - beta) / (np.linalg.norm(new) + 1e-12) < 1e-5
        beta = new
        if done:
            break
    return beta, ridge


def test_corrections_are_those_of_dense_algebra(rows):
    base = 0.3 * F.col("a") - 0.1
    weights = [F.lit(1.0), F.when(F.col("a") > 0, 0.9).otherwise(0.2), F.lit(0.0)]
    fitted = L.fit_corrections(rows, TREES, "y", base, weights, keep=1 - 1e-12)
    data = rows.withColumn("codes", T.codes(TREES)).withColumn("base", base).withColumns({f"m{h}": fitted.margin(h) for h in range(3)}).collect()
    psi, y, offset = dense(data), np.array([float(r["y"]) for r in data]), np.array([r["base"] for r in data])
    for h, gamma in enumerate((np.ones(400), np.where(np.array([r["a"] for r in data]) > 0, 0.9, 0.2))):
        beta, ridge = by_hand(psi, y, offset, gamma)
        assert fitted.ridges[h] == pytest.approx(ridge, rel=1e-6) and fitted.weights[h] == pytest.approx(gamma.sum())
        assert [r[f"m{h}"] for r in data] == pytest.approx((psi @ beta).tolist(), abs=1e-6)
    assert all(r["m2"] == 0 for r in data) and fitted.weights[2] == 0


def test_basis_keeps_the_trace(rows):
    coded = rows.select(T.codes(TREES).alias("_codes"))
    psi = dense(rows.withColumn("codes", T.codes(TREES)).collect())
    value = np.linalg.eigvalsh(psi.T @ psi)[::-1]
    for keep in (0.5, 0.9, 0.999):
        vectors, found = L.basis(coded, L.leaf_index(TREES), keep)
        m = len(found)
        assert found == pytest.approx(value[:m]) and value[:m].sum() >= keep * value.sum() > value[: m - 1].sum()
        assert np.allclose(vectors.T @ vectors, np.eye(m))


def test_evidence_curve(rows):
    dice = np.random.default_rng(1)
    x, z = dice.normal(size=(50, 4)), dice.normal(size=50)
    grid, curve = L.evidence(x.T @ x, x.T @ z, z @ z, 50.0, 9)
    for lam, value in zip(grid, curve, strict=True):
        cov = np.eye(50) + x @ x.T / lam
        assert value == pytest.approx(50 * math.log(z @ np.linalg.solve(cov, z) / 50) + np.linalg.slogdet(cov)[1])


def auc_of(y, p):
    p = np.round(p, 10)
    pairs = p[y == 1][:, None] - p[y == 0][None]
    return ((pairs > 0) + 0.5 * (pairs == 0)).mean()


def gates_of(x):
    g = 1 / (1 + F.exp(-(F.col("a") - float(x[0])) * 3))
    return [g, 1 - g]


def test_folds_are_scored_by_the_others_fits(rows):
    base = F.lit(0.0)
    found = L.fold_aucs(rows, TREES, "y", base, gates_of([0.2]), "fold", 4, rounds=3)
    for k in (0, 2):
        fitted = L.fit_corrections(rows.where(F.col("fold") != k), TREES, "y", base, gates_of([0.2]), rounds=3)
        held = rows.where(F.col("fold") == k).select("y", L.pooled(fitted, base, gates_of([0.2])).alias("p")).collect()
        # eigenvectors of all rows and of the others span nearly the same space
        assert found[k] == pytest.approx(auc_of(np.array([r["y"] for r in held]), np.array([r["p"] for r in held])), abs=0.02)
    assert np.mean(found) > 0.6
    assert L.fold_aucs(rows, TREES, "y", base, gates_of([50.0]), "fold", 4) is None
    score = L.fold_objective(rows, TREES, "y", base, gates_of, "fold", 4, rounds=2)
    assert score(np.array([50.0])) == -1.0 and score(np.array([0.2])) > 0.6


def test_search():
    seen = []

    def score(x):
        seen.append(x.copy())
        return -float(((x - [1.0, -2.0]) ** 2).sum())

    best, history = L.es_search(score, [0.0, 0.0], [1.0, 2.0], 300, sigma=0.5)
    assert len(history) == 301 and [h[2] for h in history] == sorted(h[2] for h in history) and history[-1][2] > -0.05
    assert score(best) == history[-1][2]
    sigmas = [h[3] for h in history]
    assert min(sigmas) >= 0.02 and any(b == 0.5 and a < 0.03 for a, b in zip(sigmas, sigmas[1:], strict=False))


def test_equal_leaves_are_one_vector_and_the_basis_is_found_once(rows, monkeypatch):
    dice = np.random.default_rng(2)
    # 40 trees of 100 leaves: numbers of whole rows pass 64 bits
    at = dice.integers(0, 3, (500, 40)) * 33 + np.arange(40) * 100
    at = np.concatenate([at, at[::2]])
    found, which = L._distinct(at, 4000)
    assert (found[which] == at).all() and len(found) == len(np.unique(at, axis=0))
    calls, real = [], L.basis
    monkeypatch.setattr(L, "basis", lambda *a: calls.append(1) or real(*a))
    score = L.fold_objective(rows, TREES, "y", F.lit(0.0), gates_of, "fold", 4, rounds=2)
    values = [score(np.array([x])) for x in (0.2, 0.4, 0.2)]
    assert len(calls) == 1 and values[0] == pytest.approx(values[2], abs=1e-12) and values[0] != values[1]


def test_scores_are_looked_up_by_leaf(rows):
    fitted = L.fit_corrections(rows, TREES, "y", F.lit(0.1), [F.lit(1.0), (F.col("fold") != 1).cast("double")], rounds=2)
    found = rows.withColumn("codes", T.codes(TREES)).withColumn("at", F.col("fold") - 1).select("at", fitted.looked_up("codes", "at", [1, 0]).alias("v"), fitted.margin(1).alias("m0"), fitted.margin(0).alias("m1")).collect()
    assert {r["at"] for r in found} == {-1, 0, 1, 2}
    assert all(r["v"] == pytest.approx(r[f"m{r['at']}"]) if r["at"] in (0, 1) else r["v"] is None for r in found)
