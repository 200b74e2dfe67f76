"""Frozen regions over a stream: the same predicates, with windowed totals and late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def region_totals(rows: DataFrame, time: str, mask: Column, loss: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, n, m, total, inside of each time window; works on streams and on tables alike."""
    marked = rows.withWatermark(time, late) if rows.isStreaming else rows
    inside = F.coalesce(mask, F.lit(False))
    out = marked.groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), F.count_if(inside).alias("m"), F.sum(loss).alias("total"), F.sum(F.when(inside, F.col(loss))).alias("inside"))
    return out.select(F.col("w.start").alias("window_start"), "n", "m", "total", "inside")


def contrasts(totals: DataFrame) -> DataFrame:
    """window_start, contrast of the region's mean loss to the rest's."""
    mean_in = F.try_divide(F.col("inside"), F.col("m").cast("double"))
    mean_out = F.try_divide(F.col("total") - F.coalesce("inside", F.lit(0.0)), (F.col("n") - F.col("m")).cast("double"))
    return totals.select("window_start", (F.try_divide(mean_in, mean_out) - 1).alias("contrast"))


def stored(stream: DataFrame, path: str, checkpoint: str):
    """Appends finished windows to Parquet, reading what is there now and then ending; both folders must be shared."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
