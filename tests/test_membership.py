"""membership() makes its pairs in tasks; it must rank as one sort of all pairs does, ties and missing values too."""

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from weakspot.operators import regions as R

CANDIDATE = "cand int, z array<double>, w array<double>, m int"


def sorted_pairs(rows, candidates, features, metric, digits=10):
    gaps = [F.abs(F.col(f) - F.get("z", F.lit(i))) for i, f in enumerate(features)]
    euclid = F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))
    box = [g / F.greatest(F.get("w", F.lit(i)), F.lit(1e-9)) for i, g in enumerate(gaps)]
    u = euclid if metric == "ball" else F.greatest(*box)
    pairs = rows.crossJoin(candidates).select("cand", "m", "id", F.round(u, digits).alias("u"), F.round(euclid, digits).alias("d"))
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("cand").orderBy("u", "d", "id")))
    return {(r["cand"], r["id"], r["u"]) for r in ranked.where("r <= m").collect() if not (r["u"] is not None and math.isnan(r["u"]))}, ranked.where("r <= m").count()


def test_members_are_those_of_one_sort_of_all_pairs(spark):
    dice = np.random.default_rng(3)
    # few distinct values, so that radii tie; values within the rounding of each other; nulls, nan and infinities
    odd = [None, math.nan, math.inf, -math.inf]
    rows = []
    for i in range(6000):
        a = float(dice.integers(0, 40)) / 10 + float(dice.integers(0, 3)) * 3e-11
        b = float(dice.integers(0, 5))
        rows.append((f"k{i * 7919 % 6000}", a if i % 601 else odd[i // 601 % 4], b if i % 701 else odd[i // 701 % 4]))
    frame = spark.createDataFrame(rows, "id string, a double, b double").repartition(3).persist()
    centres = [(i, [float(dice.normal(2, 1)), float(dice.normal(2, 1))], [float(dice.uniform(0.1, 2)), 1.0], int(m)) for i, m in enumerate([1, 5, 60, 300, 2500, 6000, 9000, 0])]
    centres += [(20, [2.0, 2.0], [0.0, 1.0], 50), (21, [math.nan, 1.0], [1.0, 1.0], 20), (22, [None, 1.0], [1.0, 1.0], 20), (23, [1.0, 1.0], [None, 1.0], 20), (24, [1.0, 1.0], [1.0, 1.0], None)]
    cands = spark.createDataFrame(centres, CANDIDATE)
    for metric in ("box", "ball"):
        want, n = sorted_pairs(frame, cands, ["a", "b"], metric)
        got = R.membership(frame, cands, ["a", "b"], "id", metric).collect()
        assert len(got) == n
        assert {(r["cand"], r["id"], r["u"]) for r in got if not (r["u"] is not None and math.isnan(r["u"]))} == want
    frame.unpersist()


def test_pairs_stay_in_their_tasks(spark):
    """The sort before the group limit takes what may be near only, not every pair of candidate and row."""
    rows = spark.range(40_000).select("id", (F.rand(1) * 10).alias("a"), (F.rand(2) * 10).alias("b")).persist()
    cands = spark.createDataFrame([(i, [i % 10 + 0.3, i // 10 + 0.7], [1.0, 1.0], 10) for i in range(100)], CANDIDATE)
    held = R.membership(rows, cands, ["a", "b"], "id")
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert held.count() == 1000
    rows.unpersist()


def test_pairs_that_leave_a_pools_tasks_grow_slower_than_the_rows(spark):
    """A pool of a sweep's size over rows and over four copies of them under shifted keys, in one task each."""
    dice = np.random.default_rng(11)
    values = np.round(dice.normal(size=(40_000, 2)), 2)
    once = [(i, float(a), float(b)) for i, (a, b) in enumerate(values)]
    pool = [(z, dice.dirichlet([1.0, 1.0]), 60) for z in dice.normal([0.9, 0.5], 0.6, (80, 2))]
    left = []
    for copies in (1, 4):
        rows = spark.createDataFrame([(i + 40_000 * k, a, b) for k in range(copies) for i, a, b in once], "id long, a double, b double").coalesce(1).persist()
        cands = spark.createDataFrame([(i, z.tolist(), w.tolist(), m) for i, (z, w, m) in enumerate(pool)], CANDIDATE)
        held = R.membership(rows, cands, ["a", "b"], "id")
        assert held.count() == 80 * 60
        left.append(pairs_sorted(held))
        rows.unpersist()
    assert 80 * 60 <= left[0] < 0.05 * 80 * 40_000 and left[1] < 2 * left[0]


def pairs_sorted(held):
    """Rows that the first sort of a plan takes, run on its own."""
    plan = held._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() not in ("Window", "WindowGroupLimit"):
        plan = plan.children().head()
    while plan.nodeName() in ("Window", "WindowGroupLimit"):
        plan = plan.children().head()
    session = held.sparkSession
    return session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan).count()
