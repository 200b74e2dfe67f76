"""Replicates are summed in tasks from hashes taken in bulk; the weights must be those of the column expression."""

import hashlib

import pytest
from pyspark.sql import functions as F

from weakspot.functions.digests import hash_numbers
from weakspot.operators import confirm as C
from weakspot.operators.evaluate import ratio


def test_bulk_hashes_are_md5s():
    heads = [b"", b"boot|7|", b"x" * 47, b"x" * 53, b"x" * 55, b"x" * 64, "é".encode() * 90, *(f"boot|{11**i}|".encode() for i in range(18))]
    tails = [b"", b"0", b"10", b"399", b"y" * 70]
    met = 0
    for t, places, numbers in hash_numbers(heads, tails):
        for i, number in zip(places, numbers, strict=True):
            assert int(hashlib.md5(heads[i] + tails[t]).hexdigest()[:8], 16) == int(number)
            met += 1
    assert met == len(heads) * len(tails)


def by_explode(rows, mask, boots, against):
    w, i = C.poisson_weight("id", F.col("boot")), F.coalesce(mask, F.lit(False))
    wide = rows.withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(boots - 1)))).select("boot", "loss", i.alias("i"), w.alias("w"))
    parts = wide.groupBy("boot").agg(F.sum(F.when(F.col("i"), F.col("w"))).alias("n1"), F.sum(F.when(F.col("i"), F.col("w") * F.col("loss"))).alias("s1"), F.sum("w").alias("n"), F.sum(F.col("w") * F.col("loss")).alias("s"))
    s, n = (F.col("s"), F.col("n")) if against == "all" else (F.col("s") - F.col("s1"), F.col("n") - F.col("n1"))
    theta = ratio(ratio(F.col("s1"), F.col("n1").cast("double")), ratio(s, n.cast("double"))) - 1
    return {r["boot"]: r["theta"] for r in parts.select("boot", theta.alias("theta")).collect()}


@pytest.mark.parametrize("against", ["all", "rest"])
def test_replicates_are_those_of_the_weights(spark, against):
    rows = spark.createDataFrame([(None if i == 3 else f"{i * 37}", None if i % 11 == 0 else i % 7 / 3, float(i % 5)) for i in range(500)], "id string, loss double, a double").repartition(3)
    for mask in (F.col("a") > 2, F.col("a") > 9, F.when(F.col("a") > 1, F.lit(None)).otherwise(F.col("loss").isNull())):
        got = {r["boot"]: r["theta"] for r in C.bootstrap_ratios(rows, "id", mask, "loss", 20, against).collect()}
        want = by_explode(rows, mask, 20, against)
        assert got.keys() == want.keys()
        assert all(got[b] == (None if v is None else pytest.approx(v, abs=1e-12)) for b, v in want.items())
    assert not C.bootstrap_ratios(rows.where("a > 9"), "id", F.lit(True), "loss", 20, against).collect()


def test_replicates_make_no_row_for_each_weight(spark):
    plan = C.bootstrap_ratios(spark.range(10).select("id", F.lit(1.0).alias("loss")), "id", F.col("id") > 3, "loss", 100)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
