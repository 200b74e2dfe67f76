"""The softmax mixture's training over all rows against gradients taken by differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weakspot.operators import mixtures as X


def losses(x, y, gate, coef):
    z = np.exp(x @ gate)
    p = (z / z.sum(axis=1, keepdims=True) / (1 + np.exp(-x @ coef))).sum(axis=1)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p))


def case(n=400):
    dice = np.random.default_rng(3)
    x = dice.normal(size=(n, 2))
    group = (x[:, 0] > 0.8).astype(int)
    y = (dice.random(n) < 1 / (1 + np.exp(-2 * x[:, 1] * np.where(group == 1, -1, 1)))).astype(float)
    return x, y, group


def test_gradient_by_differences():
    x, y, _ = case(50)
    x = np.hstack([x, np.ones((50, 1))])
    dice = np.random.default_rng(4)
    gate, coef = dice.normal(size=(3, 2)), dice.normal(size=(3, 2))
    found = X._softmax_rows(x, y, gate, coef)
    assert np.allclose(found[:, 1], losses(x, y, gate, coef))
    for part, param in ((found[:, 2:8], gate), (found[:, 8:], coef)):
        for i in range(6):
            step = np.zeros(6)
            step[i] = 1e-6
            step = step.reshape(3, 2)
            up, down = ((losses(x, y, gate + s, coef) if param is gate else losses(x, y, gate, coef + s)) for s in (step, -step))
            assert np.allclose(part[:, i], (up - down) / 2e-6, atol=1e-5)


@pytest.mark.parametrize("worst", [False, True])
def test_all_rows_train(spark, worst):
    x, y, group = case()
    rows = spark.createDataFrame([(float(a), float(b), float(v), int(g)) for (a, b), v, g in zip(x, y, group, strict=True)], "a double, b double, y double, grp int").repartition(3)
    steps, rate = 6, 0.05
    fitted, found = X.softmax_mixture(rows.unionByName(rows.limit(2).withColumn("a", F.lit(None).cast("double"))), ["a", "b"], "y", "grp", steps=steps, rate=rate, worst=worst)
    # the same steps on whole arrays, with weights spread over the rows
    dice = np.random.default_rng(0)
    full = np.hstack([x, np.ones((len(x), 1))])
    params = [dice.normal(0, 0.1, (3, 2)), dice.normal(0, 0.1, (3, 2))]
    first, second = [0.0, 0.0], [0.0, 0.0]
    for t in range(1, steps + 1):
        each = X._softmax_rows(full, y, *params)
        by = np.array([each[group == g, 1].mean() for g in (0, 1)])
        w = np.array([np.exp(20 * (by[g] - by.max())) / (group == g).sum() if worst else 1.0 for g in group])
        gradient = (w[:, None] * each[:, 2:]).sum(axis=0) / w.sum()
        for i in (0, 1):
            g = gradient[6 * i : 6 * i + 6].reshape(3, 2)
            first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - rate * first[i] / (1 - 0.9**t) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(fitted["gate"], params[0]) and np.allclose(fitted["coef"], params[1])
    assert found["mean"] == pytest.approx(each[:, 1].mean()) and found["worst"] == pytest.approx(by.max())
    assert fitted["groups"] == ["0", "1"]


def test_without_rows(spark):
    rows = spark.createDataFrame([], "a double, y double, grp int")
    fitted, found = X.softmax_mixture(rows, ["a"], "y", "grp", steps=3)
    assert fitted["groups"] == [] and found == {} and fitted["gate"].shape == (2, 2)
