"""Observation tables derived from the test tables (they hold no coordinates of their own).

Every column is integer arithmetic and one division, so SQL engines agree on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.functions import timebase
from terracell.functions.grid import Axis, Grid

#: 10 degree grid on which test fields live
GRID = Grid(Axis(-90.0, 10.0, 18), Axis(-180.0, 10.0, 36))
NLAT, NLON = 18, 36


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latitude_of(key: Column) -> Column:
    return F.pmod(key * 7919, F.lit(18000)) / F.lit(100.0) - F.lit(90.0)


def longitude_of(key: Column) -> Column:
    return F.pmod(key * 104729, F.lit(36000)) / F.lit(100.0) - F.lit(180.0)


def swath(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as satellite pixels."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        "l_orderkey",
        "l_suppkey",
        F.col("l_partkey").alias("location_id"),
        latitude_of(F.col("l_orderkey")).alias("lat"),
        longitude_of(F.col("l_partkey")).alias("lon"),
        (F.lit(200.0) + F.col("l_quantity") * 2).alias("measurement"),
        (F.lit(0.1) + F.col("l_discount")).alias("unc_ran"),
        (F.lit(0.1) + F.col("l_tax")).alias("unc_atm"),
        (F.lit(0.2) + F.col("l_discount")).alias("unc_sfc"),
        F.lit(0.2).alias("unc_sys"),
        F.col("l_linenumber").alias("qc"),
        timebase.day_number(F.col("l_shipdate")).alias("day"),
        F.col("l_returnflag").alias("source"),
        F.col("l_linestatus").alias("observable"),
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as a location table."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("location_id"), latitude_of(k).alias("latitude"), longitude_of(k).alias("longitude"))


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field on the 10 degree grid; every fifth cell by its number of observations is missing."""
    cells = GRID.assign(swath(spark, sf_dir)).groupBy("lat_idx", "lon_idx").agg(
        F.count(F.lit(1)).alias("n"), F.avg("measurement").alias("m"), F.avg("unc_ran").alias("u"), F.avg("unc_atm").alias("i")
    )
    known = F.col("n") % 5 != 0
    return cells.select("lat_idx", "lon_idx", F.when(known, F.col("m")).alias("tas"), F.when(known, F.col("u") * 4).alias("unc"), F.when(known, F.col("i") * 4).alias("influence"), "n")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a daily series per cell (user)."""
    e = table(spark, sf_dir, "events")
    day = timebase.day_number(F.col("ts"))
    return e.groupBy(F.col("user_id").alias("cell"), day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("top"))


def station_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as daily extremes per station (supplier)."""
    s = swath(spark, sf_dir)
    return s.groupBy(F.col("l_suppkey").alias("station"), "day").agg(F.min("measurement").alias("tmin"), F.max("measurement").alias("tmax"), F.min("unc_ran").alias("umin"), F.max("unc_ran").alias("umax"), F.count(F.lit(1)).alias("n"))


def breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as break points of stations 1..40, with likelihoods 0..127."""
    o = table(spark, sf_dir, "orders")
    station = (F.pmod("o_custkey", F.lit(40)) + 1).cast("int")
    return o.select(station.alias("station"), timebase.day_number(F.col("o_orderdate")).alias("break_day"), F.pmod(F.col("o_orderkey") * 31, F.lit(128)).cast("int").alias("likelihood"))
