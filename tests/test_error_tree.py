"""The error tree against a plain exact one, pruning by hand, and parts of the fitted loss kernel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weakspot.operators import error_tree as E
from weakspot.operators import trees as T


def table(spark, n=240, seed=2):
    dice = np.random.default_rng(seed)
    a, b = dice.integers(0, 9, n).astype(float), dice.integers(0, 5, n).astype(float)
    r = np.round(0.3 * (a > 5) + 0.5 * (a > 5) * (b < 2) - 0.2 * (b > 3) + 0.3 * dice.random(n), 3)
    return spark.createDataFrame([(i, float(x), float(y), float(v)) for i, (x, y, v) in enumerate(zip(a, b, r, strict=True))], "id long, a double, b double, loss double")


def plain(x, r, least, most):
    """Leaves (sets of rows) of a best-first tree that tries every middle between values."""

    def split(at):
        best = None
        for f in range(x.shape[1]):
            v = np.unique(x[at, f])
            for t in (v[1:] + v[:-1]) / 2:
                left, right = at[x[at, f] <= t], at[x[at, f] > t]
                if min(len(left), len(right)) < least:
                    continue
                gain = r[left].sum() ** 2 / len(left) + r[right].sum() ** 2 / len(right) - r[at].sum() ** 2 / len(at)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, left, right)
        return best

    leaves = [(np.arange(len(r)), split(np.arange(len(r))))]
    while len(leaves) < most and any(s for _, s in leaves):
        i = max((i for i, (_, s) in enumerate(leaves) if s), key=lambda i: leaves[i][1][0])
        _, (_, left, right) = leaves.pop(i)
        leaves += [(left, split(left)), (right, split(right))]
    return sorted(sorted(at.tolist()) for at, _ in leaves)


def cells(df, fitted):
    out: dict = {}
    for r in df.select("id", T.code(fitted.tree).alias("c")).collect():
        out.setdefault(r["c"], []).append(r["id"])
    return out


@pytest.mark.parametrize("least, most", [(10, 32), (1, 6), (60, 32), (10, 2)])
def test_tree_is_the_exact_one(spark, least, most):
    df = table(spark)
    rows = df.orderBy("id").collect()
    x, r = np.array([[v["a"], v["b"]] for v in rows]), np.array([v["loss"] for v in rows])
    fitted = E.fit_error_tree(df, ["a", "b"], "loss", least, most)
    found = cells(df, fitted)
    assert sorted(sorted(v) for v in found.values()) == plain(x, r, least, most)
    assert sorted(found) == list(range(len(found)))
    best = fitted.strongest(least)
    assert r[found[best]].mean() == pytest.approx(max(r[v].mean() for v in found.values()))
    assert {v["id"] for v in df.where(fitted.region(least)).collect()} == set(found[best])
    held = {v["cell"]: v for v in E.leaf_cells(df, fitted, "loss", least).collect()}
    assert {c: v["n"] for c, v in held.items()} == {c: len(v) for c, v in found.items()} and [c for c, v in held.items() if v["best"]] == [best]


def test_pruning(spark):
    df = table(spark)
    whole = E.fit_error_tree(df, ["a", "b"], "loss", 10)
    sizes = [len(E.fit_error_tree(df, ["a", "b"], "loss", 10, alpha=a).leaves) for a in (1e-5, 1e-3, 1e-2, 1.0)]
    assert len(whole.leaves) >= sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] == 1
    # every link that is left saves more than alpha
    fitted = E.fit_error_tree(df, ["a", "b"], "loss", 10, alpha=1e-3)
    for node in {p[:k] for p in fitted.leaves for k in range(len(p))}:
        below = [p for p in fitted.leaves if p[: len(node)] == node]
        assert (fitted.nodes[node].error - sum(fitted.nodes[p].error for p in below)) / 240 / (len(below) - 1) > 1e-3


def test_tree_of_odd_rows(spark):
    df = table(spark, 60)
    odd = df.withColumn("a", F.when(F.col("id") % 3 > 0, F.col("a"))).withColumn("loss", F.when(F.col("id") % 7 > 0, F.col("loss"))).withColumn("code", F.lit("x"))
    fitted = E.fit_error_tree(odd, ["a", "b"], "loss", 5)
    assert sum(fitted.nodes[p].n for p in fitted.leaves) == odd.where("loss is not null").count() == sum(v["n"] for v in E.leaf_cells(odd, fitted, "loss", 5).collect())
    assert len(E.fit_error_tree(df.withColumn("loss", F.lit(0.25)), ["a", "b"], "loss", 5).leaves) == 1
    with pytest.raises(ValueError):
        E.fit_error_tree(df, ["a"], "loss", 5).strongest(100)
    empty = E.fit_error_tree(df.limit(0), ["a", "b"], "loss", 5)
    assert len(empty.leaves) == 1


def test_quantile_cuts(spark):
    df = spark.range(2000).select("id", (F.col("id") / 2000).alias("a"), (F.col("id") >= 1500).cast("double").alias("loss"))
    fitted = E.fit_error_tree(df, ["a"], "loss", 50, max_leaves=2, bins=16)
    assert fitted.tree.threshold == pytest.approx(0.75, abs=1e-3)


def test_parts_of_the_loss_kernel(spark):
    df = table(spark)
    found = E.loss_kernel_parts(df, "id", ["a", "b"], "loss", 20, k=4, landmarks=60, trees=6, depth=2).collect()
    assert sum(r["n"] for r in found) == 240
    best = [r for r in found if r["best"]]
    assert len(best) == 1 and best[0]["mean"] == max(r["mean"] for r in found if r["n"] >= 20) > df.agg(F.avg("loss")).first()[0]
    assert all(0 <= r["agreement"] <= 1 for r in found) and best[0]["agreement"] > 0.5
    assert not any(r["best"] for r in E.loss_kernel_parts(df, "id", ["a", "b"], "loss", 1000, k=2, landmarks=40, trees=2, depth=1).collect())


def test_parts_are_routed_by_classes_of_equal_leaves(spark, monkeypatch):
    df, seen, real, cells = table(spark), [], E.T.route, E.spectral_cells
    monkeypatch.setattr(E.T, "route", lambda e, means, key: seen.append((key, e.select(key).distinct().count())) or real(e, means, key))
    monkeypatch.setattr(E, "spectral_cells", lambda *a: seen.append(cells(*a).persist()) or seen[-1])
    found = {r["cluster"]: r for r in E.loss_kernel_parts(df, "id", ["a", "b"], "loss", 20, k=3, landmarks=60, trees=3, depth=1).collect()}
    labels, (key, n) = seen
    assert key == "_codes" and n <= 8 < df.count()
    # the same from the rows themselves
    rows = labels.collect()
    ones = {r["id"]: set(enumerate(r["_codes"])) for r in rows}
    parts = {c: [r for r in rows if r["cluster"] == c] for c in {r["cluster"] for r in rows}}
    weight = {c: {cell: sum(cell in ones[r["id"]] for r in held) / len(held) for cell in {x for r in held for x in ones[r["id"]]}} for c, held in parts.items()}
    sent = {i: min(weight, key=lambda c: (-round(sum(weight[c].get(x, 0) for x in of), 10), c)) for i, of in ones.items()}
    for c, held in parts.items():
        assert found[c]["n"] == len(held) and found[c]["mean"] == pytest.approx(sum(r["loss"] for r in held) / len(held))
        assert found[c]["agreement"] == pytest.approx(sum(sent[r["id"]] == c for r in held) / len(held))
    labels.unpersist()
