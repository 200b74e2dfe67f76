"""Neighbourhoods in leaf space against brute force over rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weakspot.operators import anchors as A
from weakspot.operators import trees as T

TREES = [T.Split("a", 0.0, T.Split("b", -0.5, T.Leaf(0, 0), T.Leaf(1, 0)), T.Leaf(2, 0)), T.Split("b", 0.3, T.Leaf(0, 0), T.Split("a", 0.8, T.Leaf(1, 0), T.Leaf(2, 0))), T.Split("a", -0.7, T.Leaf(0, 0), T.Leaf(1, 0))]


def table(spark, n=300, seed=1):
    dice = np.random.default_rng(seed)
    x = dice.normal(size=(n, 2)).round(3)
    loss = (x[:, 0] > 0.5) * 0.5 + dice.random(n).round(3)
    return spark.createDataFrame([(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, loss, strict=True))], "id long, a double, b double, loss double")


def brute(codes, loss, anchor, m, weights):
    """Rows by shared leaves; the last level fills its places by its mean."""
    level = (codes == anchor) @ np.array(weights)
    inside, left = 0.0, m
    for v in sorted(set(level.tolist()), reverse=True):
        at = level == v
        take = min(left, at.sum())
        inside += loss[at].mean() * take
        left -= take
        if not left:
            break
    contrast = (inside / m) / ((loss.sum() - inside) / (len(loss) - m)) - 1 if len(loss) > m else None
    return contrast, v / sum(weights)


@pytest.mark.parametrize("block, weights", [(1024, None), (3, None), (2, [3, 1, 2])])
def test_every_row_as_anchor(spark, monkeypatch, block, weights):
    monkeypatch.setattr(A, "BLOCK", block)
    df = table(spark).withColumn("codes", T.codes(TREES))
    rows = df.orderBy("id").collect()
    codes, loss = np.array([r["codes"] for r in rows]), np.array([r["loss"] for r in rows])
    of = {r["id"]: r["class"] for r in T.class_of(df, "id", "codes").collect()}
    found = {r["class"]: r for r in A.exhaustive_contrasts(df, "id", "codes", "loss", 40, weights).collect()}
    assert set(found) == set(of.values()) and sum(r["n"] for r in found.values()) == len(rows)
    for i in range(len(rows)):
        contrast, threshold = brute(codes, loss, codes[i], 40, weights or [1, 1, 1])
        assert found[of[i]]["contrast"] == pytest.approx(contrast) and found[of[i]]["threshold"] == pytest.approx(threshold)


def test_region_of_all_rows_has_no_contrast(spark):
    df = table(spark, 20).withColumn("codes", T.codes(TREES))
    assert {r["contrast"] for r in A.exhaustive_contrasts(df, "id", "codes", "loss", 20).collect()} == {None}
    assert {r["contrast"] for r in A.exhaustive_contrasts(df, "id", "codes", "loss", 50).collect()} == {None}
    assert A.exhaustive_contrasts(df.limit(0), "id", "codes", "loss", 5).collect() == []
    nulls = df.withColumn("loss", F.when(F.col("id") > 0, F.col("loss")))
    assert sum(r["n"] for r in A.exhaustive_contrasts(nulls, "id", "codes", "loss", 5).collect()) == 19


def test_anchors_that_are_no_rows(spark, monkeypatch):
    df = table(spark).withColumn("codes", T.codes(TREES))
    points = spark.createDataFrame([(7, -2.0, 2.0), (9, 2.0, -2.0)], "anchor long, a double, b double").withColumn("codes", T.codes(TREES))
    rows = df.collect()
    codes, loss = np.array([r["codes"] for r in rows]), np.array([r["loss"] for r in rows])
    for r in A.anchor_contrasts(df, "id", "codes", "loss", points, 40).collect():
        at = A.codes_at(TREES, dict(a=-2.0, b=2.0) if r["anchor"] == 7 else dict(a=2.0, b=-2.0))
        assert (r["contrast"], r["threshold"]) == pytest.approx(brute(codes, loss, np.array(at), 40, [1, 1, 1]))
    with pytest.raises(ValueError):
        A.listed_levels([[0]] * (A.MOST_LISTED + 1), df, [1])


def test_search_over_anchors(spark):
    df = table(spark)
    history, best = A.leaf_search(df, "id", TREES, ["a", "b"], [0.0, 0.0], [1.0, 1.0], "loss", 40, [-1.0, -1.0], budget=40 * 30, brood=4, fit_reads=100)
    reads = [h[1] for h in history]
    assert reads == [100 + 40 * (i + 1) for i in range(len(history))] and reads[-5] < 1200
    assert [h[3] for h in history] == sorted(h[3] for h in history)
    coded = df.withColumn("codes", T.codes(TREES))
    rows = coded.collect()
    codes, loss = np.array([r["codes"] for r in rows]), np.array([r["loss"] for r in rows])
    assert best["codes"] == A.codes_at(TREES, dict(zip("ab", best["z"], strict=True)))
    assert best["contrast"] == pytest.approx(brute(codes, loss, np.array(best["codes"]), 40, [1, 1, 1])[0]) and best["contrast"] > history[0][2]
    # the frozen rule takes all rows of the last level
    inside = coded.where(A.frozen_leaf_region(F.col("codes"), best["codes"], best["threshold"])).count()
    level = (codes == np.array(best["codes"])).mean(axis=1)
    assert inside == (level >= best["threshold"] - 1e-9).sum() >= 40
    again, same = A.leaf_search(df, "id", TREES, ["a", "b"], [0.0, 0.0], [1.0, 1.0], "loss", 40, [-1.0, -1.0], budget=40 * 30, brood=4, fit_reads=100)
    assert again == history and same["z"] == best["z"] and math.isfinite(best["contrast"])
