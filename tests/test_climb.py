"""Climbing regions against a plain climb over the same points."""

import numpy as np
import pytest

from weakspot.operators.discovery import climb


def plain(x, loss, centre, m, step, rounds):
    """The centre where a climb ends, its weakness and the neighbours tried."""

    def weak(c):
        near = np.lexsort((np.arange(len(x)), ((x - c) ** 2).sum(axis=1)))[:m]
        return loss[near].mean()

    at, value, tries = np.array(centre, float), weak(np.array(centre, float)), 0
    for _ in range(rounds):
        around = [at + sign * step * np.eye(x.shape[1])[f] for f in range(x.shape[1]) for sign in (1, -1)]
        values = [weak(c) for c in around]
        tries += len(around)
        if max(values) <= value:
            break
        at, value = around[int(np.argmax(values))], max(values)
    return at, value, tries


@pytest.mark.parametrize("rounds", [0, 2, 12])
def test_climb(spark, rounds):
    dice = np.random.default_rng(11)
    x = dice.normal(size=(1500, 2))
    loss = 1 + np.exp(-((x - [1.4, -0.9]) ** 2).sum(axis=1)) + 0.05 * dice.random(1500)
    rows = spark.createDataFrame([(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, loss, strict=True))], "id long, a double, b double, loss double")
    starts = [[-1.0, 1.0], [1.0, -1.0], [0.0, 0.0]]
    found = climb(rows, ["a", "b"], "id", "loss", 3, 60, 0.4, rounds, centres=starts).orderBy("region").collect()
    expected = sorted((plain(x, loss, c, 60, 0.4, rounds) for c in starts), key=lambda e: -e[1])
    assert [r["weakness"] for r in found] == pytest.approx([e[1] for e in expected])
    assert all(np.allclose(r["centre"], e[0]) for r, e in zip(found, expected, strict=True))
    assert {r["evals"] for r in found} == {sum(e[2] for e in expected)}
    assert found[0]["base"] == pytest.approx(loss.mean())


def test_climb_from_seeds_and_without_rows(spark):
    rows = spark.createDataFrame([(i, float(i % 10), float(i % 10 >= 8)) for i in range(200)], "id long, a double, loss double")
    found = climb(rows, ["a"], "id", "loss", 2, 20, 1.0, 10).collect()
    assert len(found) == 2 and found[0]["weakness"] >= found[1]["weakness"] >= 0
    assert found[0]["weakness"] == 1.0
    assert climb(rows.limit(0), ["a"], "id", "loss", 2, 20).count() == 0
