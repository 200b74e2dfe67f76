"""The estimator protocol, boosted stumps, and the monotone mixture."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from weakspot.operators import estimators as S


def table(spark, n=600, seed=3):
    dice = np.random.default_rng(seed)
    part = dice.integers(0, 2, n)
    a, b = dice.normal(size=n) + 4 * part, dice.normal(size=n)
    p = 1 / (1 + np.exp(-np.where(part == 1, 1.5 * (a - 4) - 1, -0.5 * b + 0.3 * a)))
    y = (dice.random(n) < p).astype(int)
    return spark.createDataFrame([(i, float(u), float(v), int(t), float(w)) for i, (u, v, t, w) in enumerate(zip(a, b, y, dice.random(n) + 0.5, strict=True))], "id long, a double, b double, y int, w double").repartition(3).persist()


@pytest.fixture(scope="module")
def rows(spark):
    return table(spark)


SMALL = dict(features=["a", "b"], signs=[1, 0], trees=4, rate=0.5, folds=3, gateTrees=8, gateRate=0.5)


@pytest.fixture(scope="module")
def fitted(rows):
    return S.MonotoneMixture(**SMALL, weight="w").fit(rows)


def test_gate_and_pool(rows, fitted):
    out = fitted.transform(rows).collect()
    for r in out:
        assert sum(r["score_gate"]) == pytest.approx(1) and all(0 <= g <= 1 for g in r["score_gate"])
        assert r["score"] == pytest.approx(sum(g * e for g, e in zip(r["score_gate"], r["score_experts"], strict=True)))
        z = [(r[f] - m) / d for f, m, d in zip("ab", fitted.state["means"], fitted.state["deviations"], strict=True)]
        assert r["score_cluster"] == int(np.argmin([sum((x - c) ** 2 for x, c in zip(z, centre, strict=True)) for centre in fitted.state["centres"]]))
    w, x = np.array([r["w"] for r in out]), np.array([[r["a"], r["b"]] for r in out])
    mean = (w[:, None] * x).sum(0) / w.sum()
    assert fitted.state["means"] == pytest.approx(mean.tolist())
    assert fitted.state["deviations"] == pytest.approx(np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / w.sum()).tolist())
    gate = np.array([r["score_gate"] for r in out])
    assert fitted.state["mass"] == pytest.approx((w[:, None] * gate).sum(0).tolist())
    # the gate tells the parts, and the mixture the outcome
    assert np.mean(gate.argmax(1) == np.array([r["score_cluster"] for r in out])) > 0.95
    y, p = np.array([r["y"] for r in out]), np.array([r["score"] for r in out])
    assert p[y == 1].mean() > p[y == 0].mean() + 0.05


def test_experts_are_monotone_on_a_grid(spark, fitted):
    grid = spark.createDataFrame([(float(a), float(b)) for a in np.linspace(-3, 8, 60) for b in (-2.0, 0.0, 2.0)], "a double, b double")
    out = fitted.transform(grid).orderBy("b", "a").collect()
    for e in range(2):
        for b in (-2.0, 0.0, 2.0):
            p = [r["score_experts"][e] for r in out if r["b"] == b]
            assert all(x <= y + 1e-12 for x, y in zip(p, p[1:], strict=False))


def test_save_load_copy(rows, fitted, tmp_path):
    want = {r["id"]: r["score"] for r in fitted.transform(rows).collect()}
    fitted.write().overwrite().save(str(tmp_path / "model"))
    back = S.MonotoneMixtureModel.load(str(tmp_path / "model"))
    assert back.uid == fitted.uid and back.state == fitted.state and {r["id"]: r["score"] for r in back.transform(rows).collect()} == want
    named = fitted.copy({fitted.score: "p"})
    assert {r["id"]: r["p"] for r in named.transform(rows).collect()} == want and "p" not in fitted.transform(rows).columns
    e = S.MonotoneMixture(**SMALL, weight="w")
    e.write().overwrite().save(str(tmp_path / "estimator"))
    again = S.MonotoneMixture.load(str(tmp_path / "estimator"))
    assert {p.name: v for p, v in again.extractParamMap().items()} == {p.name: v for p, v in e.extractParamMap().items()}
    # one row by itself
    one = rows.where("id = 17")
    assert fitted.transform(one).first()["score"] == want[17]


def test_fixed_centres_are_not_fitted_again(rows, fitted):
    state = fitted.state
    moved = [[c + 0.05 for c in centre] for centre in state["centres"]]
    fixed = S.MonotoneMixture(**SMALL, centres=[x for c in moved for x in c], means=state["means"], deviations=state["deviations"]).fit(rows)
    assert fixed.state["centres"] == moved and fixed.state["means"] == state["means"]


def test_three_parts_and_sparse_gate(rows):
    model = S.MonotoneMixture(**(SMALL | dict(clusters=3, gateTrees=4, trees=2)), gateFeatures=["a"]).fit(rows)
    assert len(model.state["curves"]) == 3 and len(model.state["means"]) == 1
    out = model.transform(rows.withColumn("b", F.col("b") + 100)).select("id", "score_gate", "score_cluster").collect()
    same = {r["id"]: (r["score_gate"], r["score_cluster"]) for r in model.transform(rows).collect()}
    assert all((r["score_gate"], r["score_cluster"]) == same[r["id"]] and sum(r["score_gate"]) == pytest.approx(1) for r in out)


@pytest.mark.parametrize("bad", [dict(signs=[0, 0]), dict(signs=[2, 0]), dict(signs=[1]), dict(clusters=1), dict(folds=1), dict(gateTrees=0), dict(gateFeatures=["c"]), dict(gateFeatures=["a", "a"]), dict(features=["a", "a"]), dict(centres=[1.0]), dict(centres=[0.0] * 4, means=[0.0] * 2, deviations=[1.0, 0.0])])
def test_refused_parameters(rows, bad):
    with pytest.raises(ValueError):
        S.MonotoneMixture(**(SMALL | bad)).fit(rows)


def test_refused_rows(rows):
    for broken in (rows.withColumn("w", F.lit(0.0)), rows.withColumn("w", F.lit(math.nan)), rows.withColumn("a", F.when(F.col("id") > 0, F.col("a"))), rows.withColumn("y", F.lit(1)), rows.withColumn("y", F.lit(2))):
        with pytest.raises(ValueError):
            S.MonotoneMixture(**SMALL, weight="w").fit(broken)
    with pytest.raises(S.UnsupportedPartition):
        S.MonotoneMixture(**SMALL, centres=[0.0, 0.0, 1000.0, 0.0], means=[0.0, 0.0], deviations=[1.0, 1.0]).fit(rows)


def test_boosted_trees_in_a_pipeline(rows, tmp_path):
    model = Pipeline(stages=[S.BoostedTrees(features=["a", "b"], label="y", loss="logistic", trees=5, signs=[1, 0], score="first"), S.BoostedTrees(features=["first", "b"], label="w", trees=3)]).fit(rows)
    want = {r["id"]: (r["first"], r["score"]) for r in model.transform(rows).collect()}
    model.write().overwrite().save(str(tmp_path / "pipeline"))
    back = PipelineModel.load(str(tmp_path / "pipeline"))
    assert {r["id"]: (r["first"], r["score"]) for r in back.transform(rows).collect()} == want
    assert all(0 < p < 1 for p, _ in want.values())


def test_stumps_are_those_of_plain_loops(spark, rows):
    """Two models at once, one without a fold, against loops in numpy."""
    cuts = {"a": [0.0, 2.0, 4.0], "b": [-1.0, 0.5]}
    held = rows.withColumns(dict(zip(("_b0", "_b1"), S.bin_columns(["a", "b"], cuts), strict=True)))
    y, some = F.col("y").cast("double"), (F.col("id") % 3 > 0).cast("double")
    base, found = S.grow_stumps(held, ["_b0", "_b1"], [4, 3], [y, y], [F.lit(1.0), some], 6, 0.3)
    data = held.collect()
    bins, target = np.array([[r["_b0"], r["_b1"]] for r in data]), np.array([float(r["y"]) for r in data])
    for m, w in enumerate((np.ones(len(data)), np.array([float(r["id"] % 3 > 0) for r in data]))):
        share = (w * target).sum() / w.sum()
        margin, tables = np.full(len(data), math.log(share / (1 - share))), [np.zeros(4), np.zeros(3)]
        assert base[m] == pytest.approx(margin[0])
        for _ in range(6):
            p = 1 / (1 + np.exp(-margin))
            g, h = w * (p - target), w * np.maximum(p * (1 - p), 1e-6)
            f, i = max(((f, i) for f in (0, 1) for i in range(len(cuts["ab"[f]]))), key=lambda c: sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (bins[:, c[0]] <= c[1], bins[:, c[0]] > c[1])))
            for side in (bins[:, f] <= i, bins[:, f] > i):
                v = -0.3 * g[side].sum() / (h[side].sum() + 1)
                margin[side] += v
            tables[f][: i + 1] -= 0.3 * g[bins[:, f] <= i].sum() / (h[bins[:, f] <= i].sum() + 1)
            tables[f][i + 1 :] -= 0.3 * g[bins[:, f] > i].sum() / (h[bins[:, f] > i].sum() + 1)
        assert all(np.allclose(a, b) for a, b in zip(found[m], tables, strict=True))


def test_curves(spark, rows):
    """Margins already right up to a slope of 2 and a shift of 1."""
    dice = np.random.default_rng(0)
    x = dice.normal(size=4000)
    y = dice.random(4000) < 1 / (1 + np.exp(-(2 * x + 1)))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    (a, b), (c, d) = S.fit_curves(df, [F.col("x"), -F.col("x")], [F.col("y"), 1 - F.col("y")], F.lit(1.0))
    assert a == pytest.approx(2, abs=0.25) and b == pytest.approx(1, abs=0.2) and c == pytest.approx(a, abs=1e-3) and d == pytest.approx(-b, abs=1e-3)


def test_the_gate_is_fitted_to_cells(rows, monkeypatch):
    """Stumps and curves read cells of equal bins, part and fold; the numbers are those of the rows themselves."""
    grown, curved = S.grow_stumps, S.fit_curves
    seen = []

    def grow(df, bins, sizes, targets, weights, *rest):
        seen.append((df.count(), df.agg(F.sum("_w")).first()[0], math.prod(sizes)))
        # each cell as rows of a third of its weight
        split = df.withColumn("_w", F.col("_w") / 3).crossJoin(df.sparkSession.range(3).select(F.col("id").alias("_third")))
        found, again = grown(df, bins, sizes, targets, weights, *rest), grown(split, bins, sizes, targets, weights, *rest)
        assert found[0] == pytest.approx(again[0]) and all(a == pytest.approx(b) for x, y in zip(found[1], again[1], strict=True) for a, b in zip(x, y, strict=True))
        return found

    monkeypatch.setattr(S, "grow_stumps", grow)
    monkeypatch.setattr(S, "fit_curves", lambda df, *a: seen.append((df.count(),)) or curved(df, *a))
    S.MonotoneMixture(**(SMALL | dict(gateTrees=2, trees=1, bins=4)), weight="w").fit(rows)
    (n, weight, places), (m,) = seen
    assert n == m <= places * 2 * 3 < rows.count()
    assert weight == pytest.approx(rows.agg(F.sum("w")).first()[0])
