"""Daily cell statistics of a stream of pixels.

The aggregates are the batch ones, grouped by day window and cell; a watermark
closes days, so state is bounded by the cells of the open days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.functions.grid import Grid
from terracell.operators import filters


def grid_stream(pixels: DataFrame, grid: Grid, time: str = "ts", late: str = "1 day", mask: int = 1, wanted: int = 1) -> DataFrame:
    """Per day and cell: count, mean, extremes, variance and random uncertainty."""
    rows = pixels.where(filters.bits_match(F.col("qc"), mask, wanted) & filters.coordinates_valid(F.col("lat"), F.col("lon")))
    cells = grid.assign(rows).withWatermark(time, late)
    x = F.col("measurement")
    out = cells.groupBy(F.window(time, "1 day"), "cell_id").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"), F.var_samp(x).alias("variance"), (F.sqrt(F.sum(F.col("unc_ran") * F.col("unc_ran"))) / F.count(x)).alias("unc_random")
    )
    return out.withColumn("day", F.to_date("window.start")).drop("window")


def write_days(fields: DataFrame, path: str, checkpoint: str):
    """Append closed days to Parquet; the checkpoint makes restarts exact."""
    return fields.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").start()
