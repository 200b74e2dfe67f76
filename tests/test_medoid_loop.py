"""The medoid loop: ownership by hand, cells by brute force, budget, moves and validity."""

import numpy as np
import pytest

from weakspot.operators import discovery as D
from weakspot.operators import trees as T

TREES = [T.Split("a", t, T.Leaf(0, 0), T.Leaf(1, 0)) for t in (-1.0, 0.0, 1.0)] + [T.Split("b", t, T.Leaf(0, 0), T.Leaf(1, 0)) for t in (-0.5, 0.5)]


@pytest.fixture(scope="module")
def rows(spark):
    dice = np.random.default_rng(3)
    x = dice.normal(size=(800, 2))
    loss = 0.2 + 0.5 * ((x[:, 0] > 0) & (x[:, 1] > 0.5)) + 0.1 * dice.random(800)
    df = spark.createDataFrame([(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, loss, strict=True))], "id long, a double, b double, loss double")
    return df.withColumn("codes", T.codes(TREES)).persist()


def test_ownership():
    records = [dict(contrast=c, share=s) for c, s in ((0.10, 0.10), (0.098, 0.2), (0.05, 0.5), (0.04, 0.49), (0.01, 0.51))]
    frontier, chance = D.ownership(records, {"contrast": 0.005, "share": 0.02}, 0.1)
    # the fourth is dominated; contrast belongs to the first two, share to the third and the last
    assert frontier == [0, 1, 2, 4] and chance == pytest.approx([0.9 * 0.25 + 0.025] * 4)
    frontier, chance = D.ownership(records[:3], {"contrast": 0.0, "share": 0.02}, 0.0)
    assert chance == pytest.approx([0.5, 0, 0.5]) and sum(chance) == pytest.approx(1)


@pytest.fixture(scope="module")
def pool(rows):
    return sorted(T.code_classes(rows, "id", "codes"))


def test_pool_is_bounded(rows, pool):
    assert sum(n for _, _, n in pool) == 800 and len(pool) == rows.select("codes").distinct().count()
    few = T.code_classes(rows, "id", "codes", most=5)
    assert len(few) == 5 and all(c in [p[0] for p in pool] for c, _, _ in few) and [c[1] for c in few] == sorted(c[1] for c in few)
    with pytest.raises(ValueError):
        T.dissimilarity(np.zeros((T.MOST_POOL + 1, 1)))


def test_loop(rows, pool):
    codes = [c for c, _, _ in pool]
    records = D.medoid_loop(rows, "id", "loss", "codes", codes, [n for _, _, n in pool], k=2, budget=61, subsets=3, brood=4, least=20, seed=5)
    assert len(records) == 30 and [r["id"] for r in records] == list(range(30))
    assert [r["operation"] for r in records[:4]] == ["pam", "seed", "seed", "seed"] and {r["operation"] for r in records[4:]} == {"replace", "restart"}
    assert records[0]["medoids"] == T.pam(T.dissimilarity(np.array(codes)), 2, counts=[n for _, _, n in pool])[0]
    data = rows.collect()
    held, loss = np.array([r["codes"] for r in data]), np.array([r["loss"] for r in data])
    for r in records:
        assert len(set(r["medoids"])) == 2
        if r["operation"] == "replace":
            parent = records[r["parent_id"]]
            assert parent["valid"] and r["parent_id"] < r["id"] and r["medoids"] != parent["medoids"]
        cell = np.argmin([np.round((held != np.array(codes[m])).mean(axis=1), 10) for m in r["medoids"]], axis=0)
        sizes = np.bincount(cell, minlength=2)
        assert r["counts"] == [n for n in sizes if n]
        gaps = [(loss[cell == c].mean() - loss[cell != c].mean(), n / 800) for c, n in enumerate(sizes) if 50 <= n <= 640]
        assert r["valid"] == (min(sizes) >= 20 and bool(gaps))
        if gaps:
            assert (r["contrast"], r["share"]) == pytest.approx(max(gaps))
    assert D.medoid_loop(rows, "id", "loss", "codes", codes, [n for _, _, n in pool], k=2, budget=61, subsets=3, brood=4, least=20, seed=5) == records


def test_small_pools_and_budgets(rows, pool):
    codes, counts = [c for c, _, _ in pool][:2], [n for _, _, n in pool][:2]
    assert len(D.medoid_loop(rows, "id", "loss", "codes", codes, counts, k=2, budget=100)) == 1
    assert len(D.medoid_loop(rows, "id", "loss", "codes", [c for c, _, _ in pool], [n for _, _, n in pool], k=4, budget=4)) == 1
