"""Identities, brute force and refusals of the engine's operators."""

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from weakspot import catalog
from weakspot.functions import scoring as S
from weakspot.functions.arrays import edges_at_most, hash_uniform, snap_down, snap_up
from weakspot.operators import confirm as C
from weakspot.operators import discovery as D
from weakspot.operators import evaluate as E
from weakspot.operators import evidence as V
from weakspot.operators import frontier as P
from weakspot.operators import mixtures as X
from weakspot.operators import models as M
from weakspot.operators import regions as R
from weakspot.operators import search as Q
from weakspot.operators import surrogate as U
from weakspot.operators import trees as T
from weakspot.operators.twinning import blocks, twin_folds
from weakspot.plans.leaves import coded
from weakspot.plans.scored import scored
from weakspot.sources import files
from weakspot.streaming.regions import region_totals, stored

EVENTS = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    dice = np.random.default_rng(0)
    n = 600
    x, z, r = dice.normal(size=n), dice.integers(0, 4, n).astype(float), dice.gamma(2, 1, n)
    data = [(i, float(x[i]), float(z[i]), float(r[i] * (2 if x[i] > 1 else 1)), int(i % 7), int(dice.random() < 0.3 + 0.1 * z[i])) for i in range(n)]
    return spark.createDataFrame(data, "id long, a double, b double, loss double, fold int, y int").cache()


@pytest.fixture(scope="module")
def cands(spark):
    return spark.createDataFrame([(0, [1.0, 1.0], [1.0, 1.0], 60), (1, [-0.5, 2.0], [0.5, 2.0], 45), (2, [0.0, 0.0], [1.0, 0.0], 101)], "cand int, z array<double>, w array<double>, m int")


def test_support_is_exact_and_ties_go_by_distance_then_key(rows, cands):
    held = R.membership(rows, cands, ["a", "b"], "id").collect()
    data = rows.select("id", "a", "b").collect()
    for c in cands.collect():
        u = lambda r: round(max(abs(r["a"] - c["z"][0]) / max(c["w"][0], 1e-9), abs(r["b"] - c["z"][1]) / max(c["w"][1], 1e-9)), 10)  # noqa: B023, E731
        d = lambda r: round(math.dist((r["a"], r["b"]), c["z"]), 10)  # noqa: B023, E731
        want = {r["id"] for r in sorted(data, key=lambda r: (u(r), d(r), r["id"]))[: c["m"]]}
        assert {r["id"] for r in held if r["cand"] == c["cand"]} == want


def test_group_limit_is_in_the_plan(rows, cands):
    plan = R.membership(rows, cands, ["a", "b"], "id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_contrast_identity_and_replicates(rows, cands):
    members = R.membership(rows, cands, ["a", "b"], "id")
    found = {r["cand"]: r for r in E.measure(members, rows, "id", "loss", 3.0).collect()}
    reps = {r["cand"]: r for r in E.replicates(members, rows, "id", "loss", "fold").collect()}
    inside = {c: {r["id"] for r in members.where(F.col("cand") == c).collect()} for c in found}
    data = [(r["id"], r["loss"], r["fold"]) for r in rows.collect()]
    ratio = lambda part, ids: (np.mean([v for i, v, _ in part if i in ids]) / np.mean([v for i, v, _ in part if i not in ids])) - 1
    for c, r in found.items():
        share, base = len(inside[c]) / len(data), np.mean([v for _, v, _ in data])
        assert r["contrast"] == pytest.approx(ratio(data, inside[c]))
        assert r["mean_in"] / base - 1 == pytest.approx((1 - share) * r["contrast"] / (1 + share * r["contrast"]))
        left = [ratio([d for d in data if d[2] != f], inside[c]) for f in range(7)]
        assert reps[c]["se"] == pytest.approx(math.sqrt(6 / 7 * sum((v - np.mean(left)) ** 2 for v in left)))
        assert reps[c]["floor"] == pytest.approx(min(left))


def test_degenerate_regions_have_no_contrast(spark, rows):
    members = rows.select(F.lit(0).alias("cand"), "id").union(spark.createDataFrame([(1, 5)], "cand int, id long"))
    assert all(r["contrast"] is None for r in E.measure(members, rows, "id", "loss", 1.0).collect())


def test_tail_rate(spark):
    losses = spark.createDataFrame([(i, v) for i, v in enumerate([0.1, 0.2, 5.0, 6.0, 0.3, 0.4, 0.5, 0.6])], "id long, loss double")
    members = spark.createDataFrame([(0, i) for i in range(4)], "cand int, id long")
    assert E.measure(members, losses, "id", "loss", 1.0).first()["tail_rate"] == 0.5


def test_overlaps(spark):
    members = spark.createDataFrame([(c, i) for c, r in enumerate((range(10), range(5, 15), range(50, 60))) for i in r], "cand int, id long")
    found = {(r["a"], r["b"]): r["overlap"] for r in P.overlaps(members, "id").collect()}
    assert found[0, 1] == 0.5 and (0, 2) not in found and found[2, 2] == 1.0
    assert P.distinct_regions([0, 1, 2], found, 0.4) == [0, 2] and P.distinct_regions([0, 1, 2], found, 0.5) == [0, 1, 2]


def test_pareto_forms_agree(spark):
    dice = random.Random(3)
    points = spark.createDataFrame([(i, dice.random(), dice.random()) for i in range(300)], "id int, contrast double, share double")
    a = {r["id"] for r in P.pareto(points, ["contrast", "share"], "id").collect()}
    assert a == {r["id"] for r in P.skyline(points, "contrast", "share", "id").collect()}
    twins = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 0.5, 0.5)], "id int, contrast double, share double")
    assert {r["id"] for r in P.pareto(twins, ["contrast", "share"], "id").collect()} == {1, 2}
    assert [r["id"] for r in P.skyline(twins, "contrast", "share", "id").collect()] == [1]


def test_corrections(spark):
    dice = random.Random(1)
    ps = [dice.random() ** 3 for _ in range(30)] + [None, float("nan")]
    claims = spark.createDataFrame(list(enumerate(ps)), "claim int, p double")
    bh = {r["claim"]: r for r in C.benjamini_hochberg(claims, "claim", "p", 0.1).collect()}
    holm = {r["claim"]: r for r in C.holm(claims, "claim", "p", 0.1).collect()}
    assert len(bh) == len(holm) == 32
    assert all(bh[c]["rejected"] for c, r in holm.items() if r["rejected"])
    assert all(not bh[c]["rejected"] and bh[c]["adjusted"] is None for c in (30, 31))


def test_critical_value():
    assert C.critical_value(19) == pytest.approx(3.0077865564732638)


def test_bootstrap(rows):
    mask = F.col("a") > 1
    found = C.bca(rows, "id", mask, "loss", 0.0, 200)
    assert found["low"] < found["theta"] < found["high"] and found["p"] < 0.05
    assert C.bca(rows, "id", F.col("id") < 3, "loss")["low"] is None
    assert C.confirm_inflation(rows, "id", mask, "loss", 0.0, 100).first()["passed"]
    with pytest.raises(ValueError):
        C.confirm_inflation(rows, "id", mask, "loss", boots=50)


def test_influence_interval_is_the_plain_one(rows):
    r = C.influence_interval(rows, F.col("a") > 1, "loss", 1.96).first()
    d = [(x["a"] > 1, x["loss"]) for x in rows.collect()]
    one, two = np.array([v for m, v in d if m]), np.array([v for m, v in d if not m])
    assert r["gap"] == pytest.approx(one.mean() - two.mean())
    assert r["se"] == pytest.approx(math.sqrt(one.var() / len(one) + two.var() / len(two)), rel=0.01)
    same = C.paired_interval(rows, F.col("a") > 1, F.col("a") > 1, "loss", 1.96).first()
    assert same["difference"] == same["se"] == 0


def test_group_statistics(rows):
    assert E.adjusted_rand(rows, "fold", "fold").first()[0] == 1.0
    both = rows.withColumn("k", F.lit(True)).union(rows.withColumn("k", F.lit(False)))
    assert all(r["js"] == pytest.approx(0) for r in E.js_profile(both, F.col("k"), ["a", "b"]).collect())
    a = E.auc(rows, "y", "a").first()[0]
    pos, neg = [[r["a"] for r in rows.collect() if r["y"] == k] for k in (1, 0)]
    assert a == pytest.approx(np.mean([(p > q) + 0.5 * (p == q) for p in np.round(pos, 10) for q in np.round(neg, 10)]))
    assert E.auc(rows.where("y = 1"), "y", "a").first()[0] is None
    with pytest.raises(Exception, match="fewer than two"):
        E.fold_totals(rows.where("id < 8"), "fold", "loss").collect()


def test_slices_and_stresses(rows):
    assert rows.where(S.slice_predicate("")).count() == rows.where(S.slice_predicate("none")).count() == 600
    assert rows.where(S.slice_predicate("(a > 0 & b == 2) | ~(y == 1)")).count() == rows.where("(a > 0 and b = 2) or not (y = 1)").count()
    for text in ("c*2", "a/2", "a*", "drop table"):
        with pytest.raises(ValueError):
            S.stress(rows, text)


def test_guards(spark):
    bad = spark.createDataFrame([(1.0,), (-1.0,), (float("nan"),), (None,), (float("inf"),)], "loss double")
    assert S.check_losses(bad, ["loss"]).first()["bad_loss"] == 4
    with pytest.raises(ValueError):
        S.checked(bad, ["loss"])
    with pytest.raises(TypeError):
        S.check_losses(bad, [], ["loss"])


def test_edges(spark):
    row = spark.range(1).select(edges_at_most(F.array(F.lit(1.0), F.lit(2.0)), F.lit(2.0)), snap_down(F.array(F.lit(1.0), F.lit(2.0)), F.lit(0.5)), snap_up(F.array(F.lit(1.0), F.lit(2.0)), F.lit(1.5)), hash_uniform(F.lit("x"))).first()
    assert row[0] == 2 and row[1] is None and row[2] == 2.0 and 0 <= row[3] < 1


def test_frozen_box_is_outward():
    box = R.freeze_box({"a": 0.0}, {"a": 1.0}, 1.0, {"a": (10.0, 2.0)}, {"a": [0.0, 7.0, 9.0, 13.0]})
    assert box.bounds["a"] == (7.0, 13.0)
    assert R.freeze_box({"a": 0.0}, {"a": 9.0}, 1.0, {"a": (10.0, 2.0)}, {"a": [0.0, 13.0]}).bounds["a"] == (None, None)


def test_split_shares(rows):
    out = R.stratified_split(rows, "id", "y", {"train": 0.5, "discovery": 0.25, "confirm": 0.25})
    counts = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    for y in (0, 1):
        n = sum(v for (k, _), v in counts.items() if k == y)
        assert abs(counts[y, "train"] - n / 2) <= 1 and abs(counts[y, "confirm"] - n / 4) <= 1


def test_twin_folds_are_balanced(rows):
    out = twin_folds(rows, "id", ["a", "b"], 4, block=200).cache()
    assert out.count() == 600
    sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 8
    means = [r[0] for r in out.groupBy("fold").agg(F.avg("a")).select("avg(a)").collect()]
    assert max(means) - min(means) < 0.25


def test_pam_of_counts_is_pam_of_all_rows():
    dice = np.random.default_rng(5)
    codes = dice.integers(0, 4, (400, 3)) // dice.integers(1, 3, (400, 3))
    first, counts = np.unique(codes, axis=0, return_index=True, return_counts=True)[1:]
    order = np.argsort(first)
    medoids, total = T.pam(T.dissimilarity(codes), 4)
    found, inertia = T.pam(T.dissimilarity(codes[first[order]]), 4, counts=counts[order])
    assert inertia == pytest.approx(total)
    assert [first[order][m] for m in found] == medoids


@pytest.mark.skipif(not Path(EVENTS).exists(), reason="the driver's tables aren't here")
def test_registered_medoids_stand_for_every_event(spark):
    """Inertia of all 10,000 events to l10's medoids, and s12's pool, by all rows."""
    out = catalog.queries()["l10_medoids"](spark, EVENTS).collect()
    codes = {r["id"]: r["codes"] for r in coded(spark, EVENTS).select("id", "codes").collect()}
    held = np.array(list(codes.values()))
    nearest = np.min([(held != codes[r["row"]]).mean(axis=1) for r in out], axis=0)
    assert out[0]["inertia"] == pytest.approx(nearest.sum())
    pool = sorted({tuple(c) for c in codes.values()})
    start, _ = T.pam(T.dissimilarity(np.array(pool)), 4, counts=[(held == c).all(axis=1).sum() for c in pool])
    assert catalog.queries()["s12_medoid_loop"](spark, EVENTS).first()["medoids"] == start


def test_required_support_of_rows_counts_late_ones(spark):
    """The second half of the rows is what makes losses vary."""
    losses = [0.5] * 3000 + [0.0, 1.0] * 1500
    rows = spark.createDataFrame(list(enumerate(losses)), "id long, loss double")
    found = D.required_support_of(rows, "loss", [10, 50, 400], 0.1)
    assert found == D.required_support(sorted(losses), [10, 50, 400], 0.1) == 50
    assert D.required_support(losses[:2000], [10, 50, 400], 0.1) == 10
    assert D.required_support_of(rows.where("id < 0"), "loss", [10], 0.1) is None


@pytest.mark.skipif(not Path(EVENTS).exists(), reason="the driver's tables aren't here")
def test_registered_support_reads_all_of_the_fold(spark, monkeypatch):
    held = []
    monkeypatch.setattr(D, "required_support_of", lambda rows, *a: held.append(rows.count()) or 25)
    catalog.queries()["g10_required_support"](spark, EVENTS)
    assert held == [scored(spark, EVENTS).where("fold = 0").count()]


def test_trees(spark, rows):
    trees = [T.Split("a", 0.0, T.Leaf(0, 0.1), T.Split("b", 1.0, T.Leaf(1, 0.2), T.Leaf(2, -0.3)))] * 2
    out = rows.select(T.additive(trees, 1.0).alias("s"), (1 + 2 * T.value(trees[0])).alias("w"), F.expr(T.sql(trees[0], "value").replace("::DOUBLE", "D")).alias("q")).collect()
    assert all(r["s"] == pytest.approx(r["w"]) and r["q"] * 2 + 1 == pytest.approx(r["s"]) for r in out)


@pytest.mark.skipif(not Path(EVENTS).exists(), reason="the driver's tables aren't here")
def test_registered_twins_hold_every_event(spark):
    """10,000 events are several blocks."""
    for name, column, k in (("g06_twin_folds", "fold", 5), ("g07_twin_split", "twin", 4)):
        out = catalog.queries()[name](spark, EVENTS).cache()
        assert out.count() == out.select("id").distinct().count() == spark.read.parquet(f"{EVENTS}/events.parquet").count()
        share = [r["count"] / out.count() for r in out.groupBy(column).count().collect()]
        assert min(share) == pytest.approx(1 / k, abs=0.01)


def test_plan_of_blocks_grows_with_levels_only(rows):
    """Each level is written out, so the last plan is the reading of a table."""
    plan = blocks(rows.select("id", "a", "b"), "id", ["a", "b"], 6)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join") == 0 and plan.count("Relation") == 1


def test_pam_finds_blobs():
    dice = np.random.default_rng(1)
    x = np.concatenate([dice.normal(c, 0.3, (60, 2)) for c in ((0, 0), (4, 4), (-4, 4))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    medoids, total = T.pam(d, 3)
    assert sorted(m // 60 for m in medoids) == [0, 1, 2] and total < 100


def test_monotone_boosting(spark):
    dice = np.random.default_rng(2)
    x = dice.uniform(-2, 2, 400)
    y = (dice.random(400) < 1 / (1 + np.exp(-(x + np.sin(3 * x))))).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y int")
    model = M.boost(df, ["x"], "y", "logistic", trees=12, depth=2, signs={"x": 1})
    grid = spark.createDataFrame([(float(v),) for v in np.linspace(-2, 2, 81)], "x double").orderBy("x")
    scores = [r["score"] for r in model.score(grid).orderBy("x").collect()]
    assert all(b >= a - 1e-12 for a, b in zip(scores, scores[1:])) and scores[-1] > scores[0] + 0.3
    assert S.monotone_violations(df, lambda c: M_expression(model, c), {"x": 1}).first()["rate"] == 0


def M_expression(model, columns):
    out = F.lit(model.base)

    def walk(node):
        return F.lit(node.value) if isinstance(node, T.Leaf) else F.when(columns[node.feature] <= node.threshold, walk(node.left)).otherwise(walk(node.right))

    for t in model.trees:
        out = out + walk(t)
    return S.sigmoid(out)


def test_purify():
    dice = np.random.default_rng(0)
    table, weight = dice.normal(size=(4, 5)), dice.uniform(0.1, 1, (4, 5))
    mean, a, b, rest = X.purify(table, weight)
    assert np.allclose(mean + a[:, None] + b[None] + rest, table)
    assert np.allclose((rest * weight).sum(0), 0, atol=1e-8) and np.allclose((rest * weight).sum(1), 0, atol=1e-8)
    assert abs((a * weight.sum(1)).sum()) < 1e-8


def test_partitions_and_covers():
    assert len(X.partitions([1, 2, 3], 2)) == 4
    assert P.reduce_cover({"a": {1}, "b": {1, 2}, "c": {2}}, {"a": 0.1, "b": 0.5, "c": 0.4}) == {"b"}
    assert D.required_support([1.0] * 50, [10, 20], 0.1) == 10


def test_searches_count_reads(rows):
    e = Q.SparkEvaluator(rows, ["a", "b"], "id", "loss", 50)
    history = Q.hill_climb(e, [0.0, 1.0], [1.0, 1.0], rounds=2)
    assert e.reads == 600 + 50 * len(history) and [h[3] for h in history] == sorted(h[3] for h in history)


def test_gaussian_process_interpolates():
    x = np.linspace(0, 3, 12)[:, None]
    gp = U.BlendedProcess(1.0).fit(x, np.zeros((12, 1)), np.sin(x[:, 0]))
    mean, sd = gp.predict(x, np.zeros((12, 1)))
    assert np.abs(mean - np.sin(x[:, 0])).max() < 0.1 and (sd >= 0).all()
    assert U.expected_improvement(mean, sd, 5.0).max() < 1e-3


def test_gates_sum_to_one(rows):
    g = M.gaussian_gate(["a", "b"], [[0.0, 0.0], [50.0, 50.0], [1e4, 0.0]], 0.5)
    assert all(r[0] == pytest.approx(1) for r in rows.select(sum(g[1:], g[0])).collect())


def test_soft_gates_and_their_vector(spark, rows):
    d = rows.withColumn("h", F.col("id") % 3)
    held = M.moment_gates(d, ["a", "b"], "h")
    back = M.unpack_gates(M.pack_gates(*held), 2)
    assert all(np.allclose(x, y) for x, y in zip(held, back, strict=True)) and sum(held[2]) == pytest.approx(1)
    x = np.array([[r["a"], r["b"], r["h"]] for r in d.collect()])
    assert np.allclose(held[0], [x[x[:, 2] == k, :2].mean(0) for k in range(3)]) and np.allclose(held[1], [math.sqrt(x[x[:, 2] == k, :2].var(0).mean()) for k in range(3)])
    for r in d.select("a", "b", F.array(*M.soft_gates(["a", "b"], *held)).alias("g")).limit(20).collect():
        density = [w / s**2 * math.exp(-((r["a"] - c[0]) ** 2 + (r["b"] - c[1]) ** 2) / (2 * s * s)) for c, s, w in zip(*held, strict=True)]
        assert r["g"] == pytest.approx([v / sum(density) for v in density])


def test_verdicts(spark):
    store = spark.createDataFrame([("s/a", "3", "int", "f", "x", "/a"), ("s/b", "0.25", "float", "f", "x", "/b"), ("s/c", "true", "bool", "f", "x", "/c"), ("s/d", "Up", "str", "f", "x", "/d")], "id string, value string, vtype string, source string, sha256 string, pointer string")
    cases = [
        ("1", "s/a", "3", "int", "Supported"), ("2", "s/a", "4", "int", "Contradicted"), ("3", "s/a", "3", "str", "Unscorable"), ("4", "s/a", "true", "bool", "Unscorable"), ("5", "s/b", "0.2500004", "float", "Supported"),
        ("6", "s/b", "0.251", "float", "Contradicted"), ("7", "s/z", "1", "int", "Absent"), ("8", None, "1", "int", "Unscorable"), ("9", "s/c", "True", "bool", "Supported"), ("10", "s/d", "up", "str", "Contradicted"), ("11", "s/b", "0", "int", "Contradicted"), ("12", "s/a", None, "int", "Unscorable"),
    ]
    claims = spark.createDataFrame([c[:4] for c in cases], "claim string, id string, value string, vtype string")
    found = {r["claim"]: r["verdict"] for r in V.verify(claims, store).collect()}
    assert found == {c[0]: c[4] for c in cases}
    now = spark.createDataFrame([("f", "y")], "source string, sha256 string")
    with pytest.raises(ValueError):
        V.audited(store, now, "s")


def test_json(tmp_path, spark):
    for text in ('{"a": 1, "a": 2}', "[NaN]", "[Infinity]"):
        with pytest.raises(ValueError):
            files.strict_json(text)
    with pytest.raises(ValueError):
        files.strict_dump(float("nan"))
    doc = {"a/b": [{"~": 1.5}, "x"], "n": True}
    assert V.resolve_pointer(doc, "/a~1b/0/~0") == 1.5 and [t for _, _, t in V.flatten(doc)] == ["float", "str", "bool"]
    assert V.pointer_path("/a~1b/0") == "$['a/b'][0]"
    path = str(tmp_path / "new")
    files.write_new(spark.range(3), path)
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_new(spark.range(3), path)


def test_manifest(tmp_path, spark):
    (tmp_path / "a.bin").write_bytes(b"x")
    found = files.digests(spark, str(tmp_path))
    files.verify_manifest(found, found)
    with pytest.raises(ValueError):
        files.verify_manifest(found.withColumn("digest", F.lit("no")), found)


def test_stream_equals_table(tmp_path, spark, rows):
    timed = rows.withColumn("ts", F.timestamp_seconds(F.col("id") * 60))
    timed.write.parquet(str(tmp_path / "in"))
    stream = region_totals(spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in")), "ts", F.col("a") > 1, "loss")
    stored(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    want = {r["window_start"]: r for r in region_totals(timed, "ts", F.col("a") > 1, "loss").collect()}
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(found) >= len(want) - 2 and all(r["m"] == want[r["window_start"]]["m"] and r["total"] == pytest.approx(want[r["window_start"]]["total"]) for r in found)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
