"""Maps over streams: windowed histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwork.operators.stats import bin_of


def windowed_histogram(events: DataFrame, time: str, x: str, lo: float, hi: float, n: int, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, bin, count) of tumbling windows; rows later than ``late`` are dropped, state is kept until then."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).withColumn("bin", bin_of(x, lo, hi, n)).where("bin is not null")
    return timed.groupBy(F.window(time, every).alias("w"), "bin").agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), "bin", "count")
