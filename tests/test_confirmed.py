"""Confirmation, section scores, provenance and energy distance against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weakspot.operators import confirm, evaluate, evidence, regions, trees


def test_confirm_frozen(spark):
    dice = np.random.default_rng(5)
    x, loss = dice.normal(size=3000), dice.gamma(2.0, 1.0, 3000)
    loss = np.where(x > 1, loss * 1.8, loss)
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, loss))], "id long, x double, loss double")
    found = confirm.confirm_frozen(regions.Box({"x": (1.0, None)}), rows, "id", "loss")
    inside = x >= 1
    assert found["n"] == 3000 and found["support"] == inside.sum()
    assert math.isclose(found["theta"], loss[inside].mean() / loss[~inside].mean() - 1, rel_tol=1e-9)
    assert found["low"] < found["theta"] < found["high"] and found["p"] < 0.01
    # the bootstrap's spread, drawn anew
    again = []
    for _ in range(400):
        at = dice.integers(0, 3000, 3000)
        i = inside[at]
        again.append(loss[at][i].mean() / loss[at][~i].mean() - 1)
    low, high = np.quantile(again, [0.025, 0.975])
    assert abs(found["low"] - low) < 0.06 and abs(found["high"] - high) < 0.06
    few = confirm.confirm_frozen(regions.Box({"x": (3.5, None)}), rows, "id", "loss")
    assert few["p"] == 1.0 and few["low"] is None
    none = confirm.confirm_frozen(regions.Box({"x": (1.0, None)}), rows.withColumn("loss", F.lit(1.0)), "id", "loss", margin=0.5)
    assert none["theta"] == pytest.approx(0.0) and none["p"] > 0.5


CASES = [
    ("AUC is 0.7744 on 200 rows.", [("0.7744", "s"), ("0.7", "s")], [], [], (1, 0.5, 1, 0.5, 1)),
    ("", [("1", "s")], [("only here", None)], ["drift"], (1, 0, 0, 1, 1)),
    ("Drift was small, only here.", [], [("Only Here", None)], ["drift"], (0, 1, 1, 1, 0)),
    ("Drift is not reported.", [], [], ["drift", "fairness"], (1, 1, 1, 1, 1)),
    ("v1.5 and 1.5 (a+b)", [("1.5", None), ("a+b", "s")], [], [], (1, 1, 1, 1, 0.5)),
]


@pytest.mark.parametrize("text, values, qualifiers, gaps, want", CASES)
def test_section_scores(spark, text, values, qualifiers, gaps, want):
    facts = "array<struct<tail: string, span: string>>"
    row = spark.createDataFrame([("s", text, values, qualifiers, gaps)], f"section string, text string, values {facts}, qualifiers {facts}, gaps array<string>")
    r = evidence.section_scores(row).first()
    names = ("faithfulness", "completeness", "qualification", "numerical_fidelity", "provenance")
    found = tuple(r[n] for n in names)
    assert found == want
    assert r["overall"] == pytest.approx(sum(found) / 5)


def test_load_provenance(spark):
    text = '{"triples": [{"triple": ["a", "r", "1"], "evidence": [{"span": "first"}, {"span": "second"}]}, {"triple": ["b", "r", "2"], "evidence": []}, {"triple": ["c", "r", "3"], "evidence": [{}]}, {"triple": ["a", "r", "1"], "evidence": [{"span": "last"}]}]}'
    documents = spark.createDataFrame([("one", text), ("gone", None), ("odd", "no JSON"), ("empty", "{}")], "source string, content string")
    found = sorted(tuple(r) for r in evidence.load_provenance(documents).collect())
    assert found == [("one", "a", "r", "1", "last"), ("one", "b", "r", "2", None), ("one", "c", "r", "3", "")]


def test_energy_distance_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "ENERGY_BLOCK", 7)
    dice = np.random.default_rng(1)
    a, b = dice.normal(size=(40, 3)), dice.normal(0.5, 1, size=(25, 3))
    frame = lambda x: spark.createDataFrame([(row.tolist(),) for row in x], "v array<double>")
    mean = lambda x, y: np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2)).mean()
    want = 2 * mean(a, b) - mean(a, a) - mean(b, b)
    assert evaluate.energy_distance(frame(a), frame(b), "v").first()["energy"] == pytest.approx(want)
    assert evaluate.energy_distance(frame(a), frame(a), "v").first()["energy"] == pytest.approx(0.0, abs=1e-9)


def test_class_kernel_is_the_kernel_of_rows(spark):
    dice = random.Random(2)
    rows = [(i, [dice.randrange(3) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, codes array<int>")
    of = {r["id"]: r["class"] for r in trees.class_of(df, "id", "codes").collect()}
    k = {(r["a"], r["b"]): r["similarity"] for r in trees.class_kernel(df, "id", "codes").collect()}
    for i, x in rows:
        for j, y in rows:
            assert k.get((of[i], of[j]), 0.0) == pytest.approx(sum(a == b for a, b in zip(x, y)) / 4)


def test_energy_moves_each_vector_as_often_at_every_size(spark, monkeypatch):
    """Blocks grow before their number does; pairs of them are multiplied by tiles."""
    assert [evaluate.energy_blocks(n) for n in (0, 1, 513, 5000, 200_000, 262_144, 400_000)] == [1, 1, 2, 8, 8, 8, 13]
    monkeypatch.setattr(evaluate, "ENERGY_TILE", 7)
    dice = np.random.default_rng(8)
    x, n, y, m = dice.normal(size=(30, 3)), dice.integers(1, 4, 30).astype(float), dice.normal(size=(17, 3)), np.ones(17)
    want = sum(n[i] * np.linalg.norm(x[i] - y[j]) for i in range(30) for j in range(17))
    assert evaluate._tiled_sum(x, n, y, m) == pytest.approx(want)
