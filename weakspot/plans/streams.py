"""Queries over streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.regions import region_totals
from .registry import registrar, rounded
from .scored import table

REGISTRY: dict = {}
query = registrar(REGISTRY)


@query("stream_region_totals", "SELECT date_trunc('day', ts) AS window_start, count(*) AS n, count(*) FILTER (value > 60) AS m, round(sum(value), 4) AS total, round(sum(value) FILTER (value > 60), 4) AS inside FROM events GROUP BY 1")
def totals(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = region_totals(e, "ts", F.col("value") > 60, "value", "1 day")
    return rounded(out, 4).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
