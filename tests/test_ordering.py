"""Exact quantiles from counts of distinct values against numpy."""

import numpy as np
import pytest

from weakspot.operators.ordering import exact_quantiles


@pytest.mark.parametrize("kind", ["ties", "apart"])
def test_exact_quantiles(spark, kind):
    dice = np.random.default_rng(1)
    rows = [(g, None if i % 17 == 0 else float(dice.integers(0, 9)) if kind == "ties" else float(dice.normal())) for g in ("a", "b", "c") for i in range({"a": 300, "b": 7, "c": 2}[g])]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = {r["g"]: r["q"] for r in exact_quantiles(df, ["g"], "x", shares, "q").collect()}
    assert set(found) == {"a", "b", "c"}
    for g, q in found.items():
        assert q == pytest.approx(np.quantile([x for h, x in rows if h == g and x is not None], shares).tolist())
    assert exact_quantiles(df, [], "x", shares, "q").first()["q"] == pytest.approx(np.quantile([x for _, x in rows if x is not None], shares).tolist())
    assert exact_quantiles(df.limit(0), ["g"], "x", shares).collect() == []
