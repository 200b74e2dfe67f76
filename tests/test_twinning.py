"""Exact blocks, twin chains and the three strategies of multiplets; energy distance of common vectors."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from weakspot.operators import evaluate
from weakspot.operators import twinning as W


def table(spark, n=301, seed=4):
    dice = np.random.default_rng(seed)
    return spark.createDataFrame([(i, float(a), float(b), 3.5, float(a > 0)) for i, (a, b) in enumerate(dice.normal(size=(n, 2)) * (2, 1))], "id long, a double, b double, same double, two double")


def halved(rows, features, levels):
    """Blocks by sorting in Python: the larger half below."""
    groups = {0: sorted(rows)}
    for _ in range(levels):
        out = {}
        for g, held in groups.items():
            width = [max((r[1 + f] for r in held), default=0) - min((r[1 + f] for r in held), default=0) for f in range(features)]
            axis = width.index(max(width))
            held = sorted(held, key=lambda r: (r[1 + axis], r[0]))
            cut = (len(held) + 1) // 2
            out[2 * g], out[2 * g + 1] = held[:cut], held[cut:]
        groups = out
    return {r[0]: g for g, held in groups.items() for r in held}


@pytest.mark.parametrize("features", [["a", "b"], ["same"], ["two", "same"]])
def test_blocks_are_exact_halves(spark, features):
    df = table(spark).repartition(5)
    found = {r["id"]: r["block"] for r in W.blocks(df, "id", features, 4).collect()}
    rows = [(r["id"], *[r[f] for f in features]) for r in df.collect()]
    assert found == halved(rows, len(features), 4)
    sizes = collections.Counter(found.values())
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1


def test_blocks_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(W, "MOST_BROADCAST", 0)
    df = table(spark, 90)
    assert {r["id"]: r["block"] for r in W.blocks(df, "id", ["a", "b"], 3).collect()} == halved([(r["id"], r["a"], r["b"]) for r in df.collect()], 2, 3)
    assert W.blocks(df.limit(0), "id", ["a"], 2).collect() == []


def test_twin_chain_by_hand():
    x = np.array([[0.0], [1.0], [2.0], [10.0], [11.0], [12.5]])
    seeds, order = W.twin_chain(x, 2)
    # 12.5 is farthest from the mean; its nearest row is 11, then 10 with 2, then 1 with 0
    assert order.tolist() == [5, 4, 3, 2, 1, 0] and seeds.tolist() == [5, 3, 1]
    seeds, order = W.twin_chain(x, 4)
    assert order.tolist() == [5, 4, 3, 2, 1, 0] and seeds.tolist() == [5, 1]
    assert [v.tolist() for v in W.twin_chain(x[:0], 3)] == [[], []]
    # the mean is 6.08
    assert W.nearest_chain(x).tolist() == [3, 4, 5, 2, 1, 0]


@pytest.mark.parametrize("strategy", [1, 2, 3])
@pytest.mark.parametrize("n, k", [(64, 4), (65, 4), (10, 2), (7, 2), (32, 8)])
def test_parts_of_a_block(strategy, n, k):
    x = np.random.default_rng(n).normal(size=(n, 3))
    part = W.multiplets_of(x, k, strategy)
    sizes = np.bincount(part, minlength=k)
    assert len(sizes) == k and sizes.max() - sizes.min() <= 1
    same = W.multiplets_of(np.zeros((n, 2)), k, strategy)
    assert np.bincount(same, minlength=k).max() - np.bincount(same, minlength=k).min() <= 1


def energy(x, y):
    d = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)).mean()
    return 2 * d(x, y) - d(x, x) - d(y, y)


@pytest.mark.parametrize("strategy", [1, 2, 3])
def test_multiplets_are_nearer_than_random_parts(spark, strategy):
    df = table(spark, 400).withColumn("part", F.lit("clash"))
    rows = W.multiplets(df, "id", ["a", "b"], 4, strategy, block=200).collect()
    assert len(rows) == 400
    x, part = np.array([[r["a"] / 2, r["b"]] for r in rows]), np.array([r["part"] for r in rows])
    dice = np.random.default_rng(0)
    mean = np.mean([energy(x[part == i], x) for i in range(4)])
    chance = np.mean([energy(x[p == i], x) for p in [dice.permutation(np.arange(400) % 4) for _ in range(20)] for i in range(4)])
    assert mean < 0.5 * chance
    assert np.bincount(part).tolist() == [100] * 4


def test_splits_and_refusals(spark):
    df = table(spark, 200)
    out = W.twin_split(df, "id", ["a", "b", "same"], 5, block=64).collect()
    assert len(out) == 200 and sum(r["twin"] for r in out) == 40
    for bad in (dict(k=3, strategy=2), dict(k=4, strategy=4), dict(k=1), dict(k=40, block=64)):
        with pytest.raises(ValueError):
            W.multiplets(df, "id", ["a"], **bad)
    with pytest.raises(ValueError):
        W.twin_split(df, "id", ["a"], 1)
    drawn = W.fold_archive(df, "id", ["a", "b"], 4, 10).orderBy("place").collect()
    assert [(r["place"], r["fold"]) for r in drawn] == [(i, i % 4) for i in range(10)] and len({r["id"] for r in drawn}) == 10


def test_energy_of_common_vectors(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "ENERGY_BLOCK", 4)
    dice = np.random.default_rng(2)
    a = [[1.0, 1.0]] * 300 + dice.normal(size=(20, 2)).tolist()
    b = [[1.0, 1.0 + 1e-9]] * 100 + [[1.0, 1.0]] * 50 + dice.normal(size=(30, 2)).tolist()
    frame = lambda v: spark.createDataFrame([(x,) for x in [*v, None]], "v array<double>")
    assert evaluate.energy_distance(frame(a), frame(b), "v").first()["energy"] == pytest.approx(energy(np.array(a), np.array(b)))
    assert evaluate.energy_distance(frame(a), frame([]), "v").first()["energy"] is None
    plan = evaluate.energy_distance(frame(a), frame(b), "v")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_all_strategies_share_their_blocks(spark, monkeypatch):
    df = table(spark, 500)
    made = []
    first = W.blocks
    monkeypatch.setattr(W, "blocks", lambda *a: made.append(1) or first(*a))
    out = {r["id"]: (r["part_1"], r["part_2"], r["part_3"]) for r in W.every_multiplets(df, "id", ["a", "b"], 4, block=64).collect()}
    assert len(made) == 1 and len(out) == 500
    for s in (1, 2, 3):
        assert {r["id"]: r["part"] for r in W.multiplets(df, "id", ["a", "b"], 4, s, block=64).collect()} == {i: p[s - 1] for i, p in out.items()}
