"""Registered queries: each operator over its whole test table, with the SQL that must give the same rows.

A filter stands only where it is the operator, or where it thins one side of a join
on purpose, so that some rows have no partner; the docstring says so.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terracell.functions import geometry, physics, timebase
from terracell.functions import grid as gridding_functions
from terracell.functions.grid import Axis, Grid
from terracell.operators import aggregate, filters, flags, joins, merge, models, stencil, temporal
from terracell.operators.flags import Bit
from terracell.operators.gmrf import coo, delayed, elements, mesh, solve, spde
from terracell.plans.gridding import Quality, grid_day
from terracell.sources import adaptor, catalogue, readers, sinks
from terracell.sources.adaptor import GRID, NLAT, NLON

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# --- SQL of the adaptor tables ----------------------------------------------------------------------------------------

DAY = "date_diff('day', DATE '1850-01-01', cast({} AS date))"
SWATH = f"""swath AS (SELECT l_orderkey, l_suppkey, l_partkey AS location_id,
  cast((l_orderkey * 7919) % 18000 AS double) / 100 - 90 AS lat, cast((l_partkey * 104729) % 36000 AS double) / 100 - 180 AS lon,
  cast(200 AS double) + l_quantity * 2 AS measurement, cast(0.1 AS double) + l_discount AS unc_ran, cast(0.1 AS double) + l_tax AS unc_atm,
  cast(0.2 AS double) + l_discount AS unc_sfc, cast(0.2 AS double) AS unc_sys, l_linenumber AS qc, {DAY.format("l_shipdate")} AS day,
  l_returnflag AS source, l_linestatus AS observable FROM lineitem)"""
CELLS = f"{SWATH}, cells AS (SELECT *, cast(trunc((lat + 90) / 10) AS int) AS lat_idx, cast(trunc((lon + 180) / 10) AS int) AS lon_idx FROM swath)"
FIELD = f"""{CELLS}, field AS (SELECT lat_idx, lon_idx, n, CASE WHEN n % 5 <> 0 THEN m END AS tas, CASE WHEN n % 5 <> 0 THEN u * 4 END AS unc,
  CASE WHEN n % 5 <> 0 THEN i * 4 END AS influence
  FROM (SELECT lat_idx, lon_idx, count(*) AS n, avg(measurement) AS m, avg(unc_ran) AS u, avg(unc_atm) AS i FROM cells GROUP BY 1, 2))"""
SERIES = f"series AS (SELECT user_id AS cell, {DAY.format('ts')} AS day, count(*) AS n, max(event_id) AS top FROM events GROUP BY 1, 2)"
STATION_DAYS = f"""{SWATH}, station_days AS (SELECT l_suppkey AS station, day, min(measurement) AS tmin, max(measurement) AS tmax, min(unc_ran) AS umin, max(unc_ran) AS umax, count(*) AS n
  FROM swath GROUP BY 1, 2)"""
BREAKS = f"breaks AS (SELECT cast(o_custkey % 40 + 1 AS int) AS station, {DAY.format('o_orderdate')} AS break_day, cast((o_orderkey * 31) % 128 AS int) AS likelihood FROM orders)"
LOCATIONS = "locations AS (SELECT s_suppkey AS location_id, cast((s_suppkey * 7919) % 18000 AS double) / 100 - 90 AS latitude, cast((s_suppkey * 104729) % 36000 AS double) / 100 - 180 AS longitude FROM supplier)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# --- gridding -----------------------------------------------------------------------------------------------------------


@query(
    "grid_flagship",
    f"""WITH {CELLS}, g AS (SELECT lat_idx, lon_idx, count(*) AS n_total, count(*) FILTER (WHERE qc & 3 = 1) AS n_valid,
  avg(measurement) FILTER (WHERE qc & 3 = 1) AS m, min(measurement) FILTER (WHERE qc & 3 = 1) AS lo, max(measurement) FILTER (WHERE qc & 3 = 1) AS hi,
  var_samp(measurement) FILTER (WHERE qc & 3 = 1) AS v, sum(unc_ran * unc_ran) FILTER (WHERE qc & 3 = 1) AS r2,
  avg(unc_atm * unc_atm) FILTER (WHERE qc & 3 = 1) AS a2, avg(unc_sfc * unc_sfc) FILTER (WHERE qc & 3 = 1) AS s2, avg(unc_sys * unc_sys) FILTER (WHERE qc & 3 = 1) AS y2
  FROM cells WHERE qc & 1 = 1 AND lat <> -32768 AND lon <> -32768 GROUP BY 1, 2)
SELECT cast(lat_idx * 36 + lon_idx AS bigint) AS cell_id, n_total, n_valid, round(m, 6) AS ts_mean, lo AS ts_min, hi AS ts_max, round(v, 6) AS ts_variance,
  round(sqrt(r2 / nullif(n_valid * n_valid, 0)), 6) AS unc_random, round(sqrt(a2), 6) AS u_atm, round(sqrt(s2), 6) AS u_sfc, round(sqrt(y2), 6) AS u_sys,
  round((n_total - n_valid) * sqrt(v) / nullif(n_total - 1, 0), 6) AS unc_sampling,
  cast(coalesce(round((round(m, 6) - 273.15) / 0.005), -32768) AS int) AS ts_packed FROM g""",
)
def grid_flagship(spark, sf_dir):
    out = grid_day(adaptor.swath(spark, sf_dir), GRID, Quality(1, 1, 3, 1))
    out = out.withColumn("ts_mean", r6("ts_mean"))
    return out.select(
        "cell_id", "n_total", "n_valid", "ts_mean", "ts_min", "ts_max", r6("ts_variance").alias("ts_variance"), r6("unc_random").alias("unc_random"),
        r6("u_atm").alias("u_atm"), r6("u_sfc").alias("u_sfc"), r6("u_sys").alias("u_sys"), r6("unc_sampling").alias("unc_sampling"), physics.TEMPERATURE.pack(F.col("ts_mean")).alias("ts_packed"),
    )


@query(
    "grid_daily",
    f"""WITH {CELLS} SELECT day, cast(lat_idx * 36 + lon_idx AS bigint) AS cell_id, count(*) AS n_total, count(*) FILTER (WHERE qc & 3 = 1) AS n_valid,
  round(avg(measurement) FILTER (WHERE qc & 3 = 1), 6) AS ts_mean FROM cells WHERE qc & 1 = 1 GROUP BY day, lat_idx, lon_idx""",
)
def grid_daily(spark, sf_dir):
    out = grid_day(adaptor.swath(spark, sf_dir), GRID, Quality(1, 1, 3, 1), keys=("day",))
    return out.select(big("day").alias("day"), "cell_id", "n_total", "n_valid", r6("ts_mean").alias("ts_mean"))


@query(
    "grid_count_total_valid",
    f"""WITH {CELLS}, g AS (SELECT lat_idx, lon_idx, count(*) AS n_total, count(*) FILTER (WHERE qc & 7 = 1) AS n_valid, var_samp(measurement) FILTER (WHERE qc & 7 = 1) AS v FROM cells GROUP BY 1, 2)
SELECT cast(lat_idx * 36 + lon_idx AS bigint) AS cell_id, n_total, n_valid, round((n_total - n_valid) * sqrt(v) / nullif(n_total - 1, 0), 6) AS unc_sampling FROM g""",
)
def grid_count_total_valid(spark, sf_dir):
    out = aggregate.grid_surface(GRID.assign(adaptor.swath(spark, sf_dir)), ["cell_id"], valid=filters.bits_match(F.col("qc"), 7, 1))
    return out.select("cell_id", "n_total", "n_valid", r6("unc_sampling").alias("unc_sampling"))


@query(
    "bin_registry",
    f"""WITH {CELLS} SELECT lat_idx, count(measurement) AS n, round(sum(measurement), 6) AS total, round(avg(measurement), 6) AS mean, round(sum(unc_ran * unc_ran), 6) AS squares,
  round(sqrt(sum(unc_ran * unc_ran)) / count(unc_ran), 6) AS random, round(sqrt(avg(unc_atm * unc_atm)), 6) AS correlated, round(var_samp(measurement), 6) AS variance FROM cells GROUP BY lat_idx""",
)
def bin_registry(spark, sf_dir):
    wanted = {"n": ("count", "measurement"), "total": ("sum", "measurement"), "mean": ("mean", "measurement"), "squares": ("sumsq", "unc_ran"), "random": ("random", "unc_ran"), "correlated": ("correlated", "unc_atm"), "variance": ("variance", "measurement")}
    out = aggregate.bin_statistics(GRID.assign(adaptor.swath(spark, sf_dir)), ["lat_idx"], wanted)
    return out.select("lat_idx", "n", *[r6(c).alias(c) for c in wanted if c != "n"])


@query(
    "deviation_second_pass",
    f"""WITH {CELLS}, m AS (SELECT lat_idx, lon_idx, avg(measurement) AS mean FROM cells GROUP BY 1, 2)
SELECT cast(c.lat_idx * 36 + c.lon_idx AS bigint) AS cell_id, round(sum((measurement - mean) * (measurement - mean)), 5) AS sumsqdev, count(*) AS n
FROM cells AS c JOIN m USING (lat_idx, lon_idx) GROUP BY 1""",
)
def deviation_second_pass(spark, sf_dir):
    """Sum of squared deviations: variance times (n - 1), so no second pass is made."""
    out = GRID.assign(adaptor.swath(spark, sf_dir)).groupBy("cell_id").agg(F.var_samp("measurement").alias("v"), F.count(F.lit(1)).alias("n"))
    return out.select("cell_id", F.round(F.coalesce(F.col("v") * (F.col("n") - 1), F.lit(0.0)), 5).alias("sumsqdev"), "n")


@query(
    "axis_bin_edges",
    f"""WITH {SWATH} SELECT l_orderkey, location_id, cast(trunc((lat + 90) / 2.5) AS int) AS v1, cast(trunc((lat + 91.25) / 2.5 - 0.5) AS int) AS v2,
  round(-90 + 2.5 * (trunc((lat + 90) / 2.5) + 0.5), 6) AS centre, round(-90 + 2.5 * trunc((lat + 90) / 2.5), 6) AS edge FROM swath""",
)
def axis_bin_edges(spark, sf_dir):
    axis = Axis(-90.0, 2.5, 72)
    i = axis.index(F.col("lat"))
    return adaptor.swath(spark, sf_dir).select("l_orderkey", "location_id", i.alias("v1"), axis.index_from_zeroth(F.col("lat")).alias("v2"), r6(axis.centre(i)).alias("centre"), r6(axis.edge(i)).alias("edge"))


@query("lon_wrap", "SELECT l_partkey, round(CASE WHEN x >= 180 THEN x - 360 ELSE x END, 6) AS lon FROM (SELECT l_partkey, cast((l_partkey * 104729) % 36000 AS double) / 100 AS x FROM lineitem)")
def lon_wrap(spark, sf_dir):
    rows = adaptor.table(spark, sf_dir, "lineitem")
    x = F.pmod(F.col("l_partkey") * 104729, F.lit(36000)) / F.lit(100.0)
    return rows.select("l_partkey", r6(gridding_functions.wrap_longitude(x)).alias("lon"))


@query(
    "ocean_box",
    f"""WITH {SWATH}, b AS (SELECT l_orderkey, location_id, floor((lat + 0.001 + 90) / 5) AS y, floor((lon + 0.001 + 180) / 5) AS x FROM swath)
SELECT l_orderkey, location_id, cast(greatest(0, least(35, y)) AS int) AS box_lat, cast(CASE WHEN x >= 72 THEN 0 WHEN x < 0 THEN 71 ELSE x END AS int) AS box_lon FROM b""",
)
def ocean_box(spark, sf_dir):
    y, x = gridding_functions.ocean_box(F.col("lat"), F.col("lon"), 5.0)
    return adaptor.swath(spark, sf_dir).select("l_orderkey", "location_id", y.alias("box_lat"), x.alias("box_lon"))


@query("qc_bit_filter", f"WITH {SWATH} SELECT qc, count(*) AS n, round(sum(measurement), 4) AS total FROM swath WHERE qc & 5 = 5 AND lat <> -32768 GROUP BY qc")
def qc_bit_filter(spark, sf_dir):
    rows = adaptor.swath(spark, sf_dir).where(filters.bits_match(F.col("qc"), 5, 5) & filters.coordinates_valid(F.col("lat"), F.col("lon")))
    return rows.groupBy("qc").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("measurement"), 4).alias("total"))


@query(
    "pack_int16",
    f"""WITH {FIELD}, p AS (SELECT lat_idx, lon_idx, cast(coalesce(round((tas - 273.15) / 0.005), -32768) AS int) AS tas_packed, cast(coalesce(round(unc / 0.001), -32768) AS int) AS unc_packed FROM field)
SELECT *, round(CASE WHEN tas_packed <> -32768 THEN tas_packed * 0.005 + 273.15 END, 6) AS tas_back FROM p""",
)
def pack_int16(spark, sf_dir):
    out = adaptor.field(spark, sf_dir).select("lat_idx", "lon_idx", physics.TEMPERATURE.pack(F.col("tas")).alias("tas_packed"), physics.UNCERTAINTY.pack(F.col("unc")).alias("unc_packed"))
    return out.withColumn("tas_back", r6(physics.TEMPERATURE.unpack(F.col("tas_packed"))))


# --- time ---------------------------------------------------------------------------------------------------------------


@query(
    "days_since_epoch",
    f"SELECT event_id, cast({DAY.format('ts')} AS bigint) AS day, round({DAY.format('ts')} + (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / cast(86400000000 AS double), 6) AS decimal_day FROM events",
)
def days_since_epoch(spark, sf_dir):
    t = F.col("ts")
    return adaptor.table(spark, sf_dir, "events").select("event_id", big(timebase.day_number(t)).alias("day"), r6(timebase.decimal_day(t)).alias("decimal_day"))


@query(
    "decimal_year",
    """SELECT event_id, round(year(ts) + cast(epoch_us(ts) - epoch_us(y) AS double) / (epoch_us(y + INTERVAL 1 YEAR) - epoch_us(y)), 8) AS decimal_year,
  round((year(ts) - 1850) * 12 + month(ts) - 1 + cast(epoch_us(ts) - epoch_us(m) AS double) / (epoch_us(m + INTERVAL 1 MONTH) - epoch_us(m)), 8) AS decimal_month
FROM (SELECT event_id, cast(ts AS timestamp) AS ts, cast(date_trunc('year', ts) AS timestamp) AS y, cast(date_trunc('month', ts) AS timestamp) AS m FROM events)""",
)
def decimal_year(spark, sf_dir):
    t = F.col("ts")
    return adaptor.table(spark, sf_dir, "events").select("event_id", F.round(timebase.decimal_year(t), 8).alias("decimal_year"), F.round(timebase.decimal_month(t), 8).alias("decimal_month"))


@query(
    "month_operation_dates",
    """SELECT k AS month_offset, strftime(unnest(generate_series(m, m + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)), '%Y-%m-%d') AS day
FROM (SELECT k, CAST(DATE '2011-11-01' + k * INTERVAL 1 MONTH AS timestamp) AS m FROM range(0, 8) AS t(k))""",
)
def month_operation_dates(spark, sf_dir):
    return spark.range(8).select(F.col("id").alias("month_offset"), F.explode(timebase.month_days(F.lit("2011-11-17").cast("date"), F.col("id").cast("int"))).alias("day")).withColumn("day", F.col("day").cast("string"))


@query(
    "day_of_year_pentad",
    """SELECT o_orderkey, cast(n AS int) AS doy, cast(ceil(n / 5.0) - 1 AS int) AS pentad, cast((y - 1850) * 12 + mo AS int) AS months FROM (SELECT o_orderkey, year(d) AS y, month(d) AS mo,
  dayofyear(d) - CASE WHEN ((year(d) % 4 = 0 AND year(d) % 100 <> 0) OR year(d) % 400 = 0) AND dayofyear(d) > 59 THEN 1 ELSE 0 END AS n FROM (SELECT o_orderkey, cast(o_orderdate AS date) AS d FROM orders))""",
)
def day_of_year_pentad(spark, sf_dir):
    d = F.to_date("o_orderdate")
    n = timebase.model_day_of_year(d)
    return adaptor.table(spark, sf_dir, "orders").select("o_orderkey", n.cast("int").alias("doy"), timebase.pentad(n).alias("pentad"), timebase.month_count(F.lit("1850-01-01").cast("date"), d).cast("int").alias("months"))


@query(
    "operation_steps",
    """SELECT kind, step, cast(day AS varchar) AS day FROM (SELECT 'daily' AS kind, cast(i AS int) AS step, DATE '2003-02-20' + cast(i AS int) AS day FROM range(0, 20) AS t(i)
UNION ALL SELECT 'annual', cast(i AS int), cast(DATE '2000-01-01' + i * INTERVAL 1 YEAR AS date) FROM range(0, 5) AS t(i)
UNION ALL SELECT 'monthly', cast(i AS int), m + cast(floor(date_diff('day', m, cast(m + INTERVAL 1 MONTH AS date)) / 2) AS int) FROM (SELECT i, cast(DATE '2004-01-01' + i * INTERVAL 1 MONTH AS date) AS m FROM range(0, 12) AS t(i)))""",
)
def operation_steps(spark, sf_dir):
    kinds = (("daily", "2003-02-20", "2003-03-11"), ("annual", "2000-01-01", "2004-01-01"), ("monthly", "2004-01-01", "2004-12-01"))
    parts = [catalogue.steps(spark, *k).select(F.lit(k[0]).alias("kind"), "step", F.col("time").cast("string").alias("day")) for k in kinds]
    return parts[0].union(parts[1]).union(parts[2])


# --- geometry and basis functions ---------------------------------------------------------------------------------------


@query(
    "harmonics",
    f"""WITH {SWATH}, y AS (SELECT event_id, year(ts) + cast(epoch_us(ts) - epoch_us(y) AS double) / (epoch_us(y + INTERVAL 1 YEAR) - epoch_us(y)) AS t
  FROM (SELECT event_id, cast(ts AS timestamp) AS ts, cast(date_trunc('year', ts) AS timestamp) AS y FROM events))
SELECT event_id AS id, round(sin(2 * pi() * t), 6) + 0 AS a, round(cos(2 * pi() * t), 6) + 0 AS b, round(sin(4 * pi() * t), 6) + 0 AS c, round(cos(4 * pi() * t), 6) + 0 AS d FROM y
UNION ALL SELECT l_orderkey, round(cos(2 * radians(lat)), 6) + 0, round(sin(2 * radians(lat)), 6) + 0, round(cos(4 * radians(lat)), 6) + 0, round(sin(4 * radians(lat)), 6) + 0 FROM swath""",
)
def harmonics(spark, sf_dir):
    season = [c for _, c in timebase.season_angles(F.col("ts"), 2)]
    lat = [c for _, c in geometry.latitude_harmonics(F.col("lat"))]
    one = adaptor.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), *[r6(c).alias(n) for n, c in zip("abcd", season, strict=True)])
    two = adaptor.swath(spark, sf_dir).select(F.col("l_orderkey").alias("id"), *[r6(c).alias(n) for n, c in zip("abcd", lat, strict=True)])
    return one.union(two)


@query(
    "polar_cartesian",
    f"""WITH {LOCATIONS}, v AS (SELECT location_id, latitude, cos(radians(latitude)) * cos(radians(longitude)) AS x, cos(radians(latitude)) * sin(radians(longitude)) AS y, sin(radians(latitude)) AS z FROM locations)
SELECT location_id, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y, round(z, 6) + 0 AS z, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) + 0 AS lat, round(degrees(atan2(y, x)), 6) + 0 AS lon,
  round(degrees(acos(greatest(-1, least(1, z)))), 6) + 0 AS from_pole, round(degrees(750.0 / 6371), 6) + 0 AS dlat, round(degrees(750.0 / (6371 * sin(radians(90 - latitude)))), 6) + 0 AS dlon FROM v WHERE abs(latitude) < 90""",
)
def polar_cartesian(spark, sf_dir):
    loc = adaptor.locations(spark, sf_dir)
    v = geometry.to_vector(F.col("latitude"), F.col("longitude"))
    lat, lon = geometry.to_degrees(*v)
    pole = geometry.angle(v, (F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    named = {"x": v[0], "y": v[1], "z": v[2], "lat": lat, "lon": lon, "from_pole": F.degrees(pole), "dlat": geometry.latitude_span(F.lit(750.0)), "dlon": geometry.longitude_span(F.lit(750.0), F.col("latitude"))}
    return loc.where(F.abs("latitude") < 90).select("location_id", *[r6(c).alias(n) for n, c in named.items()])


@query(
    "basis_functions",
    """SELECT p_partkey, round(CASE WHEN r < 1 THEN power(1 - r, 6) * (35 * r * r + 18 * r + 3) / 3 ELSE 0 END, 8) AS wendland, round(greatest(0, 1 - abs(r * 2 - 1) / 0.7), 8) AS hat
FROM (SELECT p_partkey, cast(p_partkey % 150 AS double) / 100 AS r FROM part)""",
)
def basis_functions(spark, sf_dir):
    r = F.pmod("p_partkey", F.lit(150)) / F.lit(100.0)
    return adaptor.table(spark, sf_dir, "part").select("p_partkey", F.round(physics.wendland4(r), 8).alias("wendland"), F.round(physics.hat(r * 2 - 1, 0.7), 8).alias("hat"))


@query(
    "barycentric_weights",
    f"""WITH {LOCATIONS}, v AS (SELECT location_id, cos(radians(latitude)) * cos(radians(longitude)) AS x, cos(radians(latitude)) * sin(radians(longitude)) AS y, sin(radians(latitude)) AS z FROM locations)
SELECT location_id, round(abs(x) / (abs(x) + abs(y) + abs(z)), 6) AS wa, round(abs(y) / (abs(x) + abs(y) + abs(z)), 6) AS wb, round(abs(z) / (abs(x) + abs(y) + abs(z)), 6) AS wc, round(sqrt(3) / 2, 6) AS area FROM v""",
)
def barycentric_weights(spark, sf_dir):
    """Weights in the octant triangle that holds the point."""
    v = tuple(F.abs(c) for c in geometry.to_vector(F.col("latitude"), F.col("longitude")))
    zero, one = F.lit(0.0), F.lit(1.0)
    corners = ((one, zero, zero), (zero, one, zero), (zero, zero, one))
    w = geometry.barycentric(v, *corners)
    return adaptor.locations(spark, sf_dir).select("location_id", *[r6(c).alias(n) for n, c in zip(("wa", "wb", "wc"), w, strict=True)], r6(geometry.triangle_area(*corners)).alias("area"))


# --- joins --------------------------------------------------------------------------------------------------------------


@query(
    "obs_location_join",
    f"""WITH {SWATH}, {LOCATIONS} SELECT loc.location_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, count(*) AS n, round(avg(measurement), 6) AS mean
FROM swath JOIN locations AS loc ON l_suppkey = loc.location_id GROUP BY 1, 2, 3""",
)
def obs_location_join(spark, sf_dir):
    obs = adaptor.swath(spark, sf_dir).select(F.col("l_suppkey").alias("location_id"), "measurement")
    out = joins.with_location(obs, adaptor.locations(spark, sf_dir)).groupBy("location_id", "latitude", "longitude").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("measurement")).alias("mean"))
    return out.select("location_id", r6("latitude").alias("latitude"), r6("longitude").alias("longitude"), "n", "mean")


@query(
    "tmean_from_minmax",
    f"""WITH {STATION_DAYS}, a AS (SELECT station, day, CASE WHEN n % 3 <> 0 THEN tmin END AS m, umin AS u FROM station_days), b AS (SELECT station, day, tmax AS m, umax AS u FROM station_days WHERE day % 2 = 0)
SELECT station, cast(day AS bigint) AS day, round((a.m + b.m) / 2, 6) AS measurement, round(CASE WHEN a.m IS NOT NULL AND b.m IS NOT NULL THEN sqrt((a.u * a.u + b.u * b.u) / 2) END, 6) AS unc FROM a JOIN b USING (station, day)""",
)
def tmean_from_minmax(spark, sf_dir):
    """Every station day's minimum; maxima are thinned to even days, so that some have no partner."""
    days = adaptor.station_days(spark, sf_dir)
    low = days.select("station", "day", F.when(F.col("n") % 3 != 0, F.col("tmin")).alias("measurement"), F.col("umin").alias("unc"))
    high = days.where("day % 2 = 0").select("station", "day", F.col("tmax").alias("measurement"), F.col("umax").alias("unc"))
    out = joins.mean_of_extremes(low, high, ["station", "day"])
    return out.select("station", big("day").alias("day"), r6("measurement").alias("measurement"), r6("unc").alias("unc"))


@query(
    "append_sources",
    """SELECT location_id, count(*) AS n FROM (SELECT s_suppkey AS location_id FROM supplier UNION ALL SELECT c_custkey + 100000 FROM customer) GROUP BY 1""",
)
def append_sources(spark, sf_dir):
    one = adaptor.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("location_id"))
    two = adaptor.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("location_id"))
    return joins.append_sources(one, two, 100000).groupBy("location_id").agg(F.count(F.lit(1)).alias("n"))


@query("holdout_anti", f"WITH {SWATH} SELECT l_suppkey AS station, count(*) AS n, round(avg(measurement), 6) AS mean FROM swath WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 = 1) GROUP BY 1")
def holdout_anti(spark, sf_dir):
    held = adaptor.table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 1").select(F.col("s_suppkey").alias("station"))
    rows = joins.without(adaptor.swath(spark, sf_dir).withColumnRenamed("l_suppkey", "station"), held, "station")
    return rows.groupBy("station").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("measurement")).alias("mean"))


@query("location_subset", f"WITH {SWATH} SELECT location_id, cast(day AS bigint) AS day, measurement FROM swath WHERE location_id IN (SELECT p_partkey FROM part WHERE p_partkey % 9 = 2)")
def location_subset(spark, sf_dir):
    wanted = adaptor.table(spark, sf_dir, "part").where("p_partkey % 9 = 2").select(F.col("p_partkey").alias("location_id"))
    return readers.retrieve_locations(adaptor.swath(spark, sf_dir), wanted).select("location_id", big("day").alias("day"), "measurement")


@query("daily_totals", f"WITH {SWATH} SELECT cast(day AS bigint) AS day, count(*) AS n FROM swath GROUP BY 1")
def daily_totals(spark, sf_dir):
    return readers.totals(adaptor.swath(spark, sf_dir)).select(big("day").alias("day"), "n")


_NEXT = """WITH {breaks}, obs AS (SELECT o_orderkey, cast(o_custkey % 40 + 1 AS int) AS station, {day} AS day FROM orders)
SELECT o_orderkey, obs.station, cast(obs.day AS bigint) AS day, cast(min(break_day) AS bigint) AS next_break FROM obs LEFT JOIN breaks ON breaks.station = obs.station AND break_day {op} obs.day GROUP BY 1, 2, 3"""


def _next_break(spark, sf_dir, inclusive):
    obs = adaptor.table(spark, sf_dir, "orders").select("o_orderkey", (F.pmod("o_custkey", F.lit(40)) + 1).cast("int").alias("station"), timebase.day_number(F.col("o_orderdate")).alias("day"))
    out = joins.next_break(obs, adaptor.breaks(spark, sf_dir), inclusive=inclusive)
    return out.select("o_orderkey", "station", big("day").alias("day"), big("next_break").alias("next_break"))


@query("next_break_asof", _NEXT.format(breaks=BREAKS, day=DAY.format("o_orderdate"), op=">"))
def next_break_asof(spark, sf_dir):
    return _next_break(spark, sf_dir, False)


@query("next_break_inclusive", _NEXT.format(breaks=BREAKS, day=DAY.format("o_orderdate"), op=">="))
def next_break_inclusive(spark, sf_dir):
    return _next_break(spark, sf_dir, True)


@query(
    "nearest_date",
    f"""WITH {SWATH}, d AS (SELECT DISTINCT day FROM swath), f AS (SELECT DISTINCT {DAY.format('o_orderdate')} AS file_day FROM orders WHERE o_orderkey % 29 = 0),
n AS (SELECT day, file_day, row_number() OVER (PARTITION BY day ORDER BY abs(day - file_day), file_day) AS k FROM d JOIN f ON abs(day - file_day) < 10)
SELECT cast(d.day AS bigint) AS day, cast(n.file_day AS bigint) AS file_day FROM d LEFT JOIN n ON n.day = d.day AND n.k = 1""",
)
def nearest_date(spark, sf_dir):
    """Every day of the pixels; the files are thinned, so that some days have none near."""
    days = adaptor.swath(spark, sf_dir).select("day").distinct()
    files = adaptor.table(spark, sf_dir, "orders").where("o_orderkey % 29 = 0").select(timebase.day_number(F.col("o_orderdate")).alias("file_day"))
    return joins.nearest_date(days, files, "day", "file_day", 10).select(big("day").alias("day"), big("file_day").alias("file_day"))


@query(
    "bilinear_covariate",
    f"""WITH {CELLS}, node AS (SELECT lat_idx, lon_idx, avg(measurement) AS c FROM cells GROUP BY 1, 2),
edge AS (SELECT lat_idx, avg(c) AS c FROM node WHERE lat_idx IN (0, 17) GROUP BY 1),
grid AS (SELECT lat_idx AS i, lon_idx AS j, c FROM node UNION ALL SELECT CASE WHEN lat_idx = 0 THEN -1 ELSE 18 END, k, c FROM edge, range(0, 36) AS t(k)),
o AS (SELECT location_id, latitude AS lat, longitude AS lon, (latitude + 85) / 10 AS y, (longitude + 175) / 10 AS x FROM ({LOCATIONS.removeprefix("locations AS (").removesuffix(")")})),
e AS (SELECT location_id, lat, lon, cast(floor(y) AS int) + dy AS i, (cast(floor(x) AS int) + dx + 36) % 36 AS j, (CASE WHEN dy = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN dx = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w
  FROM o, range(0, 2) AS a(dy), range(0, 2) AS b(dx))
SELECT location_id, round(sum(w * c), 6) AS covariate FROM e JOIN grid USING (i, j) GROUP BY location_id""",
)
def bilinear_covariate(spark, sf_dir):
    nodes = GRID.assign(adaptor.swath(spark, sf_dir)).groupBy("lat_idx", "lon_idx").agg(F.avg("measurement").alias("covariate"))
    obs = adaptor.locations(spark, sf_dir).select("location_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return joins.bilinear(obs, nodes, GRID.lat, GRID.lon, "covariate").select("location_id", r6("covariate").alias("covariate"))


@query(
    "merge_flag_files",
    f"""WITH {CELLS}, a AS (SELECT lat_idx, lon_idx, bit_or(qc) AS q FROM cells WHERE source = 'A' AND qc < 4 GROUP BY 1, 2), b AS (SELECT lat_idx, lon_idx, bit_or(qc * 64) & 65535 AS q FROM cells WHERE source = 'N' AND qc < 4 GROUP BY 1, 2)
SELECT lat_idx, lon_idx, cast(coalesce(a.q, 0) | CASE WHEN coalesce(b.q, 0) & 128 <> 0 THEN (coalesce(b.q, 0) & 65407) | 4096 ELSE coalesce(b.q, 0) END AS int) AS qc FROM a FULL JOIN b USING (lat_idx, lon_idx)""",
)
def merge_flag_files(spark, sf_dir):
    cells = GRID.assign(adaptor.swath(spark, sf_dir)).where("qc < 4")
    a = flags.combine_rows(cells.where("source = 'A'"), ["lat_idx", "lon_idx"], "qc")
    b = flags.combine_rows(cells.where("source = 'N'").withColumn("qc", F.col("qc") * 64), ["lat_idx", "lon_idx"], "qc")
    return joins.merge_flags(a, b, ["lat_idx", "lon_idx"], "qc", Bit.AREAL_LOW, Bit.MISSING_MARINE)


@query(
    "step_input_join",
    f"""WITH s AS (SELECT i AS step, cast({DAY.format("DATE '1995-01-01'")} + i AS bigint) AS key FROM range(0, 60) AS t(i)), f AS (SELECT cast({DAY.format('o_orderdate')} AS bigint) AS key, o_orderkey AS file FROM orders)
SELECT step, key, count(file) AS n, min(file) AS first_file, max(file) AS last_file FROM s JOIN f USING (key) GROUP BY 1, 2""",
)
def step_input_join(spark, sf_dir):
    steps = spark.range(60).select(F.col("id").alias("step"), (F.col("id") + timebase.day_number(F.lit("1995-01-01").cast("date"))).alias("key"))
    files = adaptor.table(spark, sf_dir, "orders").select(big(timebase.day_number(F.col("o_orderdate"))).alias("key"), F.col("o_orderkey").alias("file"))
    out = joins.steps_with_files(steps, files, "skip")
    return out.select("step", "key", big(F.size("files")).alias("n"), F.col("files")[0].alias("first_file"), F.element_at("files", -1).alias("last_file"))


@query(
    "step_input_allowed",
    """WITH s AS (SELECT i AS step, i AS key FROM range(0, 400) AS t(i)), f AS (SELECT s_suppkey AS key, s_suppkey * 10 AS file FROM supplier)
SELECT step, cast(coalesce(min(file), -1) AS bigint) AS first_file FROM s LEFT JOIN f USING (key) GROUP BY 1""",
)
def step_input_allowed(spark, sf_dir):
    steps = spark.range(400).select(F.col("id").alias("step"), F.col("id").alias("key"))
    files = adaptor.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") * 10).alias("file"))
    return joins.steps_with_files(steps, files, "allowed").select("step", F.col("files")[0].alias("first_file"))


@query(
    "operation_parameters",
    f"""WITH s AS (SELECT i AS step FROM range(0, 120) AS t(i)), a AS (SELECT {DAY.format('o_orderdate')} - {DAY.format("DATE '1996-01-01'")} AS step, o_orderkey AS file FROM orders),
b AS (SELECT {DAY.format('l_shipdate')} - {DAY.format("DATE '1996-01-01'")} AS step, l_orderkey AS file FROM lineitem),
g AS (SELECT s.step, (SELECT count(*) FROM a WHERE a.step = s.step) AS na, (SELECT count(*) FROM b WHERE b.step = s.step) AS nb FROM s)
SELECT cast(step AS bigint) AS step, cast(row_number() OVER (ORDER BY step) - 1 AS int) AS operation, na, nb FROM g WHERE na > 0 AND nb > 0""",
)
def operation_parameters(spark, sf_dir):
    start = timebase.day_number(F.lit("1996-01-01").cast("date"))
    a = adaptor.table(spark, sf_dir, "orders").select(big(timebase.day_number(F.col("o_orderdate")) - start).alias("step"), F.col("o_orderkey").alias("file"))
    b = adaptor.table(spark, sf_dir, "lineitem").select(big(timebase.day_number(F.col("l_shipdate")) - start).alias("step"), F.col("l_orderkey").alias("file"))
    out = catalogue.resolve(spark.range(120).withColumnRenamed("id", "step"), [("a", a, "skip"), ("b", b, "skip")])
    return out.select("step", "operation", big(F.size("a")).alias("na"), big(F.size("b")).alias("nb"))


@query(
    "annual_batch_days",
    f"""WITH c AS (SELECT cast(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1996-12-31', INTERVAL 1 DAY)) AS date) AS day), f AS (SELECT cast(o_orderdate AS date) AS day, min(o_orderkey) AS file FROM orders GROUP BY 1)
SELECT cast(year(c.day) AS int) AS year, count(*) AS days, count(*) FILTER (WHERE file IS NULL) AS gaps, string_agg(cast(coalesce(file, -1) AS varchar), ',' ORDER BY c.day) AS files FROM c LEFT JOIN f USING (day) GROUP BY 1""",
)
def annual_batch_days(spark, sf_dir):
    calendar = spark.sql("SELECT explode(sequence(DATE'1995-01-01', DATE'1996-12-31', INTERVAL 1 DAY)) AS day")
    files = adaptor.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.min("o_orderkey").alias("file"))
    out = catalogue.annual_batches(files, calendar)
    return out.select("year", big(F.size("files")).alias("days"), big(F.size(F.filter("files", lambda x: x == -1))).alias("gaps"), F.array_join(F.transform("files", lambda x: x.cast("string")), ",").alias("files"))


@query(
    "filename_patterns",
    """WITH n AS (SELECT o_orderkey, 'obs_' || o_orderstatus || '_' || strftime(o_orderdate, '%Y%m%d') || CASE WHEN o_orderkey % 2 = 0 THEN '.nc' ELSE '.txt' END AS name FROM orders)
SELECT o_orderkey, name, strftime(strptime(regexp_extract(name, '(\\d{8})', 1), '%Y%m%d'), '%Y-%m-%d') AS day, regexp_extract(name, '^obs_([A-Za-z]+)_', 1) AS tag FROM n WHERE regexp_matches(name, '^obs_[A-Za-z]+_\\d{8}\\.nc$')""",
)
def filename_patterns(spark, sf_dir):
    o = adaptor.table(spark, sf_dir, "orders")
    name = F.concat(F.lit("obs_"), "o_orderstatus", F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.when(F.col("o_orderkey") % 2 == 0, ".nc").otherwise(".txt"))
    out = catalogue.matches(o.select("o_orderkey", name.alias("name")), "obs_%A_%Y%m%d.nc")
    return out.select("o_orderkey", "name", F.to_date("time").cast("string").alias("day"), F.col("tags")[0].alias("tag"))


@query(
    "output_entries",
    """SELECT name, cast(row_number() OVER (ORDER BY name) - 1 AS int) AS entry FROM (SELECT DISTINCT 'tas_' || strftime(o_orderdate, '%Y%m') || '.nc' AS name FROM orders)""",
)
def output_entries(spark, sf_dir):
    return catalogue.outputs(adaptor.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("time")), "tas_%Y%m.nc")


# --- aggregates ---------------------------------------------------------------------------------------------------------


@query(
    "diagnostic_grid",
    f"""WITH {CELLS} SELECT cast(lat_idx * 36 + lon_idx AS bigint) AS cell_id, count(*) AS n_obs, min(measurement) AS obs_min, max(measurement) AS obs_max, round(min(unc_ran), 6) AS unc_min, round(max(unc_ran), 6) AS unc_max,
  round(sum(measurement / unc_ran), 4) AS weighted_sum, round(sum(1 / unc_ran), 6) AS precision_sum, round(sum(measurement / unc_ran) / sum(1 / unc_ran), 6) AS weighted_mean FROM cells GROUP BY 1""",
)
def diagnostic_grid(spark, sf_dir):
    out = aggregate.diagnostics(GRID.assign(adaptor.swath(spark, sf_dir)), ["cell_id"], unc="unc_ran")
    return out.select("cell_id", "n_obs", "obs_min", "obs_max", r6("unc_min").alias("unc_min"), r6("unc_max").alias("unc_max"), F.round("weighted_sum", 4).alias("weighted_sum"), r6("precision_sum").alias("precision_sum"), r6("weighted_mean").alias("weighted_mean"))


@query(
    "diagnostic_multisource",
    f"""WITH {CELLS} SELECT source, observable, lat_idx, count(*) AS n_obs, min(measurement) AS obs_min, max(measurement) AS obs_max, round(sum(measurement / unc_ran) / sum(1 / unc_ran), 6) AS weighted_mean FROM cells GROUP BY 1, 2, 3""",
)
def diagnostic_multisource(spark, sf_dir):
    out = aggregate.diagnostics(GRID.assign(adaptor.swath(spark, sf_dir)), ["source", "observable", "lat_idx"], unc="unc_ran")
    return out.select("source", "observable", "lat_idx", "n_obs", "obs_min", "obs_max", r6("weighted_mean").alias("weighted_mean"))


@query(
    "diagnostic_side_by_side",
    f"""WITH {CELLS} SELECT lat_idx, {", ".join(f"round(avg(measurement) FILTER (WHERE source = '{s}'), 6) AS {s}_mean" for s in "ANR")} FROM cells GROUP BY 1""",
)
def diagnostic_side_by_side(spark, sf_dir):
    out = aggregate.side_by_side(GRID.assign(adaptor.swath(spark, sf_dir)), ["lat_idx"], "source", ["A", "N", "R"], {"mean": F.col("measurement")})
    return out.select("lat_idx", *[r6(f"{s}_mean").alias(f"{s}_mean") for s in "ANR"])


_SOURCES = f"{CELLS}, src AS (SELECT lat_idx, lon_idx, source, avg(measurement) AS field, avg(unc_ran) AS unc FROM cells GROUP BY 1, 2, 3 HAVING count(*) % 4 <> 0)"


def _sources(spark, sf_dir):
    g = GRID.assign(adaptor.swath(spark, sf_dir)).groupBy("lat_idx", "lon_idx", "source").agg(F.avg("measurement").alias("field"), F.avg("unc_ran").alias("unc"), F.count(F.lit(1)).alias("n"))
    return g.where("n % 4 <> 0").drop("n")


@query("merge_mean", f"WITH {_SOURCES} SELECT lat_idx, lon_idx, round(avg(field), 6) AS merged, count(field) AS n_sources FROM src GROUP BY 1, 2")
def merge_mean(spark, sf_dir):
    return merge.merged_mean(_sources(spark, sf_dir), ["lat_idx", "lon_idx"]).select("lat_idx", "lon_idx", r6("merged").alias("merged"), "n_sources")


@query(
    "merge_uncertainty",
    f"""WITH {_SOURCES}, rho AS (SELECT * FROM (VALUES ('A', 'N', 0.5), ('A', 'R', 0.25), ('N', 'R', -0.1)) AS t(a, b, rho)),
own AS (SELECT lat_idx, lon_idx, count(unc) AS n, sum(unc * unc) AS s FROM src GROUP BY 1, 2),
mixed AS (SELECT x.lat_idx, x.lon_idx, sum(2 * rho * x.unc * y.unc) AS s FROM src AS x JOIN src AS y USING (lat_idx, lon_idx) JOIN rho ON rho.a = x.source AND rho.b = y.source GROUP BY 1, 2)
SELECT lat_idx, lon_idx, n AS n_valid, round(sqrt(own.s + coalesce(mixed.s, 0)) / n, 6) AS merged_unc FROM own LEFT JOIN mixed USING (lat_idx, lon_idx)""",
)
def merge_uncertainty(spark, sf_dir):
    rho = spark.createDataFrame([("A", "N", 0.5), ("R", "A", 0.25), ("N", "R", -0.1)], "src_i string, src_j string, rho double")
    return merge.merged_uncertainty(_sources(spark, sf_dir), rho, ["lat_idx", "lon_idx"]).withColumn("merged_unc", r6("merged_unc"))


@query("break_station_stats", f"WITH {BREAKS} SELECT station, count(*) AS n_breaks, min(break_day)::bigint AS first_break, max(likelihood)::int AS best FROM breaks GROUP BY 1")
def break_station_stats(spark, sf_dir):
    return adaptor.breaks(spark, sf_dir).groupBy("station").agg(F.count(F.lit(1)).alias("n_breaks"), big(F.min("break_day")).alias("first_break"), F.max("likelihood").alias("best"))


@query("break_hard_cutoff", f"WITH {BREAKS} SELECT station, break_day::bigint AS break_day, likelihood FROM breaks WHERE likelihood >= 96")
def break_hard_cutoff(spark, sf_dir):
    return adaptor.breaks(spark, sf_dir).where(filters.hard_cutoff(F.col("likelihood"), 96)).select("station", big("break_day").alias("break_day"), "likelihood")


@query("break_laplace", f"WITH {BREAKS} SELECT station, break_day::bigint AS break_day, likelihood FROM breaks WHERE exp(-0.05 * abs(likelihood - 127)) >= 0.3")
def break_laplace(spark, sf_dir):
    return adaptor.breaks(spark, sf_dir).where(filters.laplace_cutoff(F.col("likelihood"), 0.05, 0.3)).select("station", big("break_day").alias("break_day"), "likelihood")


_CLIMATE = f"""{CELLS}, dated AS (SELECT *, DATE '1850-01-01' + cast(day AS int) AS d FROM cells),
climate AS (SELECT lat_idx, month(d) AS m, quantile_cont(measurement, 0.25) AS q1, quantile_cont(measurement, 0.5) AS q2, quantile_cont(measurement, 0.75) AS q3 FROM dated GROUP BY 1, 2)"""


def _dated(spark, sf_dir):
    return GRID.assign(adaptor.swath(spark, sf_dir)).withColumn("m", F.month(timebase.date_of(F.col("day"))))


@query("cell_quartiles", f"WITH {_CLIMATE} SELECT lat_idx, cast(m AS int) AS m, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3 FROM climate")
def cell_quartiles(spark, sf_dir):
    return aggregate.quartiles(_dated(spark, sf_dir), ["lat_idx", "m"], "measurement").select("lat_idx", "m", *[r6(q).alias(q) for q in ("q1", "q2", "q3")])


@query(
    "location_threshold_flags",
    f"""WITH {_CLIMATE} SELECT l_orderkey, location_id, measurement, cast(CASE WHEN measurement < q2 - 1.5 * (q2 - q1) THEN 8192 ELSE 0 END | CASE WHEN measurement > q2 + 1.5 * (q3 - q2) THEN 16384 ELSE 0 END AS int) AS qc
FROM dated LEFT JOIN climate ON dated.lat_idx = climate.lat_idx AND month(d) = m""",
)
def location_threshold_flags(spark, sf_dir):
    rows = _dated(spark, sf_dir)
    climate = aggregate.quartiles(rows, ["lat_idx", "m"], "measurement")
    out = flags.location_flags(rows, climate, ["lat_idx", "m"], "measurement", 1.5)
    return out.select("l_orderkey", "location_id", "measurement", "qc")


@query("area_weighted_mean", f"WITH {SWATH} SELECT source, cast(trunc((lat + 90) / 30) AS int) AS band, round(sum(cos(radians(lat)) * measurement) / sum(cos(radians(lat))), 6) AS weighted_mean FROM swath GROUP BY 1, 2")
def area_weighted_mean(spark, sf_dir):
    rows = adaptor.swath(spark, sf_dir).withColumn("band", Axis(-90.0, 30.0, 6).index(F.col("lat")))
    return aggregate.weighted_mean(rows, ["source", "band"], "measurement", geometry.area_weight(F.col("lat"))).withColumn("weighted_mean", r6("weighted_mean"))


@query(
    "distinct_locations",
    """WITH s AS (SELECT event_id, cast(trunc(cast(360000000 AS double) * lat) AS bigint) + cast(trunc(cast(1000000 AS double) * lon) AS bigint) AS sig FROM (SELECT event_id, cast((user_id * 7919) % 18000 AS double) / 100 - 90 AS lat, cast((user_id * 104729) % 36000 AS double) / 100 - 180 AS lon FROM events))
SELECT event_id, cast(dense_rank() OVER (ORDER BY sig) - 1 AS bigint) AS location_id FROM s""",
)
def distinct_locations(spark, sf_dir):
    u = F.col("user_id")
    rows = adaptor.table(spark, sf_dir, "events").select("event_id", adaptor.latitude_of(u).alias("lat"), adaptor.longitude_of(u).alias("lon"))
    return readers.with_distinct_locations(rows, "lat", "lon")[0].select("event_id", "location_id")


@query(
    "sample_spread",
    f"""WITH {STATION_DAYS}, e AS (SELECT station, unnest(list(tmax ORDER BY day)) AS x FROM station_days GROUP BY 1)
SELECT station, round(avg(x), 6) AS sample_mean, round(stddev_pop(x), 6) AS sample_std, round(sqrt(avg((x - 250) * (x - 250))), 6) AS sample_rms FROM e GROUP BY 1""",
)
def sample_spread(spark, sf_dir):
    rows = adaptor.station_days(spark, sf_dir).groupBy("station").agg(F.collect_list("tmax").alias("samples"), F.lit(250.0).alias("value"))
    out = aggregate.sample_spread(rows, "samples", "value")
    return out.select("station", *[r6(c).alias(c) for c in ("sample_mean", "sample_std", "sample_rms")])


@query(
    "variance_ratio",
    f"""WITH {FIELD} SELECT lat_idx, lon_idx, round(least(unc * unc / nullif(influence * influence, 0), 1), 6) AS variance_ratio, round(1 - least(unc * unc / nullif(influence * influence, 0), 1), 6) AS influence FROM field WHERE unc IS NOT NULL""",
)
def variance_ratio(spark, sf_dir):
    rows = adaptor.field(spark, sf_dir).where("unc IS NOT NULL").withColumnRenamed("influence", "prior")
    out = aggregate.variance_ratio(rows, "unc", "prior")
    return out.select("lat_idx", "lon_idx", r6("variance_ratio").alias("variance_ratio"), r6("influence").alias("influence"))


@query(
    "product_assembly",
    f"""WITH {_SOURCES}, w AS (SELECT lat_idx, lon_idx, max(field) FILTER (WHERE source = 'A') AS a, max(field) FILTER (WHERE source = 'N') AS n, max(field) FILTER (WHERE source = 'R') AS r,
  max(unc) FILTER (WHERE source = 'A') AS ua, max(unc) FILTER (WHERE source = 'N') AS un, max(unc) FILTER (WHERE source = 'R') AS ur FROM src GROUP BY 1, 2)
SELECT lat_idx, lon_idx, round(a + n + r, 6) AS value, round(sqrt(ua * ua + un * un + ur * ur), 6) AS unc, round(a + n + r - 3, 6) AS sample_0, round(a + n + r + 3, 6) AS sample_1 FROM w WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL""",
)
def product_assembly(spark, sf_dir):
    rows = _sources(spark, sf_dir)
    part = lambda s: rows.where(F.col("source") == s).select("lat_idx", "lon_idx", F.col("field").alias("value"), "unc", F.array(F.col("field") - 1, F.col("field") + 1).alias("samples"))
    out = aggregate.assemble_product([part(s) for s in "ANR"], ["lat_idx", "lon_idx"])
    return out.select("lat_idx", "lon_idx", r6("value").alias("value"), r6("unc").alias("unc"), r6(F.col("samples")[0]).alias("sample_0"), r6(F.col("samples")[1]).alias("sample_1"))


# --- windows over time --------------------------------------------------------------------------------------------------


@query(
    "window_flags",
    f"""WITH {SERIES}, c AS (SELECT cell, day, CASE WHEN top % 3 <> 0 THEN 1 ELSE 0 END AS k FROM series)
SELECT cell, cast(day AS bigint) AS day, cast(coalesce(sum(k) OVER a, 0) AS bigint) AS n_prior, cast(coalesce(sum(k) OVER b, 0) AS bigint) AS n_post, coalesce(sum(k) OVER a, 0) < 5 AS prior_flag, coalesce(sum(k) OVER b, 0) < 5 AS post_flag
FROM c WINDOW a AS (PARTITION BY cell ORDER BY day RANGE BETWEEN 15 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY cell ORDER BY day RANGE BETWEEN 1 FOLLOWING AND 15 FOLLOWING)""",
)
def window_flags(spark, sf_dir):
    rows = adaptor.series(spark, sf_dir).withColumn("constrained", F.col("top") % 3 != 0)
    return temporal.constraint_window(rows, ["cell"]).select("cell", big("day").alias("day"), "n_prior", "n_post", "prior_flag", "post_flag")


@query(
    "persistent_outlier",
    f"""WITH {SERIES} SELECT cell, cast(day AS bigint) AS day, cast(sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) OVER w AS bigint) AS n_outliers, sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) OVER w >= 7 AS persistent
FROM series WINDOW w AS (PARTITION BY cell ORDER BY day RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING)""",
)
def persistent_outlier(spark, sf_dir):
    rows = adaptor.series(spark, sf_dir).withColumn("outlier", F.col("n") >= 2)
    return temporal.persistence_window(rows, ["cell"]).select("cell", big("day").alias("day"), "n_outliers", "persistent")


@query(
    "calendar_flags",
    """WITH s AS (SELECT o_custkey % 5 AS cell, cast(o_orderdate AS date) AS d, min(o_orderkey) % 3 <> 0 AS k FROM orders GROUP BY 1, 2),
x AS (SELECT cell, d, k, year(d) AS y, month(d) AS m, day(d) AS dd, true AS own FROM s UNION ALL SELECT cell, d, k, year(d), 2, 29, false FROM s WHERE month(d) = 2 AND day(d) = 28 AND NOT ((year(d) % 4 = 0 AND year(d) % 100 <> 0) OR year(d) % 400 = 0)),
w AS (SELECT *, cast(coalesce(sum(k::int) OVER (PARTITION BY cell, m, dd ORDER BY y RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS n_prior,
  cast(coalesce(sum(k::int) OVER (PARTITION BY cell, m, dd ORDER BY y RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS bigint) AS n_post, cast(sum(k::int) OVER (PARTITION BY cell, m, dd) AS bigint) AS n_total FROM x)
SELECT cell, cast(d AS varchar) AS date, n_prior, n_post, n_total, n_prior < 1 AS prior_flag, n_post < 1 AS post_flag, n_total < 3 AS missing_flag FROM w WHERE own""",
)
def calendar_flags(spark, sf_dir):
    rows = adaptor.table(spark, sf_dir, "orders").groupBy(F.pmod("o_custkey", F.lit(5)).alias("cell"), F.to_date("o_orderdate").alias("date")).agg((F.min("o_orderkey") % 3 != 0).alias("constrained"))
    return temporal.calendar_window(rows, ["cell"]).select("cell", F.col("date").cast("string").alias("date"), "n_prior", "n_post", "n_total", "prior_flag", "post_flag", "missing_flag")


@query("first_of_run", f"WITH {BREAKS} SELECT station, cast(min(break_day) AS bigint) AS break_day FROM breaks GROUP BY 1")
def first_of_run(spark, sf_dir):
    return temporal.first_of_run(adaptor.breaks(spark, sf_dir), ["break_day"], "station").where("is_first").select("station", big("break_day").alias("break_day"))


@query("running_offsets", f"WITH {SERIES}, c AS (SELECT cell, sum(n) AS n FROM series GROUP BY 1) SELECT cell, cast(n AS bigint) AS n, cast(coalesce(sum(n) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS \"offset\" FROM c")
def running_offsets(spark, sf_dir):
    return temporal.offsets(adaptor.series(spark, sf_dir).groupBy("cell").agg(F.sum("n").alias("n")), "cell")


# --- stencils -----------------------------------------------------------------------------------------------------------

_NEAR = """near AS (SELECT t.lat_idx, t.lon_idx, s.tas, s.unc, s.influence FROM (SELECT lat_idx, lon_idx FROM field) AS t, range(-{h}, {h} + 1) AS a(dy), range(-{h}, {h} + 1) AS b(dx), field AS s
  WHERE s.lat_idx = CASE WHEN t.lat_idx + dy < 0 THEN -(t.lat_idx + dy) WHEN t.lat_idx + dy > 17 THEN 34 - (t.lat_idx + dy) ELSE t.lat_idx + dy END AND s.lon_idx = (t.lon_idx + dx + 36) % 36)"""


@query("spatial_mean", f"WITH {FIELD}, {_NEAR.format(h=2)} SELECT lat_idx, lon_idx, round(avg(tas), 6) AS window_mean FROM near GROUP BY 1, 2")
def spatial_mean(spark, sf_dir):
    return stencil.moving_mean(adaptor.field(spark, sf_dir), [], "tas", NLAT, NLON, 5).select("lat_idx", "lon_idx", r6("window_mean").alias("window_mean"))


@query("spatial_quartiles", f"WITH {FIELD}, {_NEAR.format(h=3)} SELECT lat_idx, lon_idx, round(quantile_cont(tas, 0.25), 6) AS q1, round(quantile_cont(tas, 0.5), 6) AS q2, round(quantile_cont(tas, 0.75), 6) AS q3 FROM near GROUP BY 1, 2")
def spatial_quartiles(spark, sf_dir):
    return stencil.moving_quartiles(adaptor.field(spark, sf_dir), [], "tas", NLAT, NLON, 7).select("lat_idx", "lon_idx", *[r6(q).alias(q) for q in ("q1", "q2", "q3")])


@query(
    "spatial_adaptive_quartiles",
    f"""WITH {FIELD}, t AS (SELECT lat_idx, lon_idx, cast(least(ceil(degrees(1500.0 / 6371) / 10), 9) AS int) AS hy, cast(least(ceil(degrees(1500.0 / (6371 * sin(radians(90 - (-90 + 10 * (lat_idx + 0.5)))))) / 10), 9) AS int) AS hx FROM field),
near AS (SELECT t.lat_idx, t.lon_idx, s.tas FROM t, range(-9, 10) AS a(dy), range(-9, 10) AS b(dx), field AS s WHERE abs(dy) <= hy AND abs(dx) <= hx
  AND s.lat_idx = CASE WHEN t.lat_idx + dy < 0 THEN -(t.lat_idx + dy) WHEN t.lat_idx + dy > 17 THEN 34 - (t.lat_idx + dy) ELSE t.lat_idx + dy END AND s.lon_idx = (t.lon_idx + dx + 36) % 36)
SELECT lat_idx, lon_idx, round(quantile_cont(tas, 0.25), 6) AS q1, round(quantile_cont(tas, 0.5), 6) AS q2, round(quantile_cont(tas, 0.75), 6) AS q3 FROM near GROUP BY 1, 2""",
)
def spatial_adaptive_quartiles(spark, sf_dir):
    out = stencil.adaptive_quartiles(adaptor.field(spark, sf_dir), [], "tas", NLAT, NLON, 10.0, 1500.0)
    return out.select("lat_idx", "lon_idx", *[r6(q).alias(q) for q in ("q1", "q2", "q3")])


@query("dilate_exceedance", f"WITH {FIELD}, {_NEAR.format(h=2)} SELECT lat_idx, lon_idx, coalesce(bool_or(tas > 255), false) AS dilated FROM near GROUP BY 1, 2")
def dilate_exceedance(spark, sf_dir):
    rows = adaptor.field(spark, sf_dir).withColumn("hot", F.col("tas") > 255)
    return stencil.dilate(rows, [], "hot", NLAT, NLON).select("lat_idx", "lon_idx", "dilated")


@query(
    "cloud_local_mean",
    f"""WITH {FIELD}, m AS (SELECT t.lat_idx, t.lon_idx, any_value(t.tas) AS tas, avg(s.tas) AS mean, count(s.tas) AS k FROM field AS t JOIN field AS s ON abs(s.lat_idx - t.lat_idx) <= 2 AND abs(s.lon_idx - t.lon_idx) <= 2 AND NOT (s.lat_idx = t.lat_idx AND s.lon_idx = t.lon_idx)
  WHERE t.lat_idx BETWEEN 2 AND 15 AND t.lon_idx BETWEEN 2 AND 33 GROUP BY 1, 2)
SELECT f.lat_idx, f.lon_idx, round(m.mean, 6) AS neighbour_mean, cast(m.k AS bigint) AS neighbours, coalesce(m.k >= 2 AND m.mean - f.tas > 3, false) AS cloud FROM field AS f LEFT JOIN m USING (lat_idx, lon_idx)""",
)
def cloud_local_mean(spark, sf_dir):
    out = stencil.cloud_mask(adaptor.field(spark, sf_dir), [], "tas", NLAT, NLON, excess=3.0)
    return out.select("lat_idx", "lon_idx", r6("neighbour_mean").alias("neighbour_mean"), big("neighbours").alias("neighbours"), "cloud")


@query(
    "uncertainty_flags",
    f"""WITH {FIELD}, {_NEAR.format(h=6)}, n2 AS (SELECT lat_idx, lon_idx, avg(unc) AS u FROM near GROUP BY 1, 2), {_NEAR.format(h=2).replace("near AS", "near2 AS")}, n3 AS (SELECT lat_idx, lon_idx, avg(influence) AS i FROM near2 GROUP BY 1, 2)
SELECT lat_idx, lon_idx, cast(CASE WHEN u > 0.6 THEN 32 ELSE 0 END AS int) AS climatology, cast(CASE WHEN i < 0.56 THEN 1 ELSE 0 END AS int) AS influence_flag FROM n2 JOIN n3 USING (lat_idx, lon_idx)""",
)
def uncertainty_flags(spark, sf_dir):
    rows = adaptor.field(spark, sf_dir)
    out = flags.uncertainty_flag(rows, [], "unc", NLAT, NLON, 13, Bit.CLIMATOLOGY_UNC, 0.6).withColumnRenamed("qc", "climatology")
    out = flags.influence_flag(out, [], "influence", NLAT, NLON, 5, 0.56).withColumnRenamed("qc", "influence_flag")
    return out.select("lat_idx", "lon_idx", "climatology", "influence_flag")


@query(
    "extreme_flags",
    f"""WITH {FIELD}, shifted AS (SELECT lat_idx, lon_idx, (tas - 250) * 12 + 260 AS tas, unc, influence FROM field), {_NEAR.format(h=2).replace("field", "shifted")}
SELECT lat_idx, lon_idx, cast(CASE WHEN bool_or(tas < 193.15) THEN 512 ELSE 0 END | CASE WHEN bool_or(tas > 333.15) THEN 1024 ELSE 0 END AS int) AS qc FROM near GROUP BY 1, 2""",
)
def extreme_flags(spark, sf_dir):
    rows = adaptor.field(spark, sf_dir).withColumn("tas", (F.col("tas") - 250) * 12 + 260)
    return flags.extreme_flags(rows, [], "tas", NLAT, NLON).select("lat_idx", "lon_idx", "qc")


@query(
    "areal_flags",
    f"""WITH {FIELD}, {_NEAR.format(h=3)}, q AS (SELECT lat_idx, lon_idx, quantile_cont(tas, 0.25) AS q1, quantile_cont(tas, 0.5) AS q2, quantile_cont(tas, 0.75) AS q3 FROM near GROUP BY 1, 2),
x AS (SELECT lat_idx, lon_idx, coalesce(tas < q1 - 1.5 * (q2 - q1), false) AS lo, coalesce(tas > q3 + 1.5 * (q3 - q2), false) AS hi FROM field JOIN q USING (lat_idx, lon_idx)),
z AS (SELECT t.lat_idx, t.lon_idx, bool_or(s.lo) AS lo, bool_or(s.hi) AS hi FROM x AS t, range(-2, 3) AS a(dy), range(-2, 3) AS b(dx), x AS s
  WHERE s.lat_idx = CASE WHEN t.lat_idx + dy < 0 THEN -(t.lat_idx + dy) WHEN t.lat_idx + dy > 17 THEN 34 - (t.lat_idx + dy) ELSE t.lat_idx + dy END AND s.lon_idx = (t.lon_idx + dx + 36) % 36 GROUP BY 1, 2)
SELECT lat_idx, lon_idx, cast(CASE WHEN lo THEN 128 ELSE 0 END | CASE WHEN hi THEN 256 ELSE 0 END AS int) AS qc FROM z""",
)
def areal_flags(spark, sf_dir):
    return flags.areal_flags(adaptor.field(spark, sf_dir), [], "tas", NLAT, NLON, 7, 1.5).select("lat_idx", "lon_idx", "qc")


# --- masks --------------------------------------------------------------------------------------------------------------

_RULES = "((q & 36864) = 32768 OR (q & 64) <> 0 OR (q & 32) <> 0 OR (q & 128) <> 0 OR (q & 256) <> 0 OR (q & 512) <> 0 OR (q & 1024) <> 0 OR (q & 8192) <> 0 OR (q & 16384) <> 0)"


@query("mask_rules", f"SELECT o_orderkey, cast(q AS int) AS qc, {_RULES} OR (y > 2012 AND (q & 4096) <> 0) AS masked FROM (SELECT o_orderkey, (o_orderkey * 40503) % 65536 AS q, 2000 + o_orderkey % 20 AS y FROM orders)")
def mask_rules(spark, sf_dir):
    rows = adaptor.table(spark, sf_dir, "orders").select("o_orderkey", F.pmod(F.col("o_orderkey") * 40503, F.lit(65536)).cast("int").alias("qc"), (2000 + F.pmod("o_orderkey", F.lit(20))).alias("y"))
    return rows.select("o_orderkey", "qc", flags.masked(F.col("qc"), F.col("y")).alias("masked"))


@query(
    "apply_mask",
    f"""SELECT o_orderkey, {_RULES} AS masked, CASE WHEN NOT {_RULES} THEN o_totalprice END AS tas, CASE WHEN NOT {_RULES} THEN o_totalprice + 1 END AS member_1 FROM (SELECT o_orderkey, o_totalprice, (o_orderkey * 517) % 65536 AS q FROM orders)""",
)
def apply_mask(spark, sf_dir):
    rows = adaptor.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("tas"), F.array("o_totalprice", F.col("o_totalprice") + 1).alias("ensemble"), F.pmod(F.col("o_orderkey") * 517, F.lit(65536)).cast("int").alias("qc"))
    out = filters.apply_mask(rows, filters.any_rule(F.col("qc"), flags.MASK_RULES), ["tas"], ["ensemble"])
    return out.select("o_orderkey", "masked", "tas", F.col("ensemble")[1].alias("member_1"))


@query(
    "tmin_gt_tmax",
    f"""WITH {STATION_DAYS}, x AS (SELECT station, day, tmin + CASE WHEN n % 2 = 0 THEN 50 ELSE 0 END AS a, tmax AS b FROM station_days)
SELECT station, cast(day AS bigint) AS day, a > b AS swapped, CASE WHEN NOT a > b THEN a END AS tasmin, CASE WHEN NOT a > b THEN b END AS tasmax FROM x""",
)
def tmin_gt_tmax(spark, sf_dir):
    rows = adaptor.station_days(spark, sf_dir).select("station", "day", (F.col("tmin") + F.when(F.col("n") % 2 == 0, 50).otherwise(0)).alias("tasmin"), F.col("tmax").alias("tasmax"))
    return filters.minimum_above_maximum(rows).select("station", big("day").alias("day"), "swapped", "tasmin", "tasmax")


@query("combine_flags", f"WITH {CELLS} SELECT lat_idx, lon_idx, cast(bit_or(1 << (qc % 12)) AS int) AS qc FROM cells WHERE qc < 5 GROUP BY 1, 2")
def combine_flags(spark, sf_dir):
    rows = GRID.assign(adaptor.swath(spark, sf_dir)).where("qc < 5").withColumn("qc", F.expr("shiftleft(1, qc % 12)"))
    return flags.combine_rows(rows, ["lat_idx", "lon_idx"], "qc")


@query(
    "land_threshold",
    f"""WITH {FIELD} SELECT lat_idx, lon_idx, CASE WHEN NOT coalesce(unc > 0.62 OR influence < 0.56 OR lat_idx < 2, false) THEN tas END AS tas FROM field""",
)
def land_threshold(spark, sf_dir):
    rows = adaptor.field(spark, sf_dir).withColumn("ice", F.col("lat_idx") < 2)
    return filters.land_threshold(rows, "tas", "unc", "influence", "ice", 0.62, 0.56).select("lat_idx", "lon_idx", "tas")


@query(
    "ice_masks",
    """WITH i AS (SELECT o_orderkey, cast(o_custkey % 5 AS int) AS land_mask, CASE WHEN o_custkey % 7 <> 0 THEN cast(o_custkey % 100 AS double) / 100 END AS frac, CASE WHEN o_custkey % 11 <> 0 THEN cast(o_orderkey % 90 AS double) / 10 END AS std,
  cast(240 + o_orderkey % 45 AS double) AS tm, cast(o_orderkey % 3 AS int) AS nday, cast(o_custkey % 3 AS int) AS nnight FROM orders),
b AS (SELECT *, cast(235 + o_orderkey % 40 AS double) AS bin FROM i)
SELECT o_orderkey, land_mask NOT IN (1, 4) AS m_land_ice, coalesce(frac < 0.3, true) AS m_sea_ice_conc, coalesce(frac < 0.3, true) OR land_mask IN (1, 4) AS m_sea_ice, land_mask NOT IN (1, 4) AND coalesce(frac < 0.3, true) AS m_ice,
  coalesce(frac < 0.3, true) OR land_mask IN (1, 4) OR coalesce(frac >= 0.85, false) AS m_marginal,
  (land_mask NOT IN (1, 4) AND coalesce(frac < 0.3, true)) OR coalesce(std > 7.07, false) OR tm > 278.15 OR nday = 0 OR nnight = 0 OR abs(tm - bin) > 10 AS reject_mean,
  (land_mask NOT IN (1, 4) AND coalesce(frac < 0.3, true)) OR coalesce(std > 7.07, false) OR tm > 278.15 OR nnight = 0 AS reject_min,
  (land_mask NOT IN (1, 4) AND coalesce(frac < 0.3, true)) OR coalesce(std > 7.07, false) OR tm > 278.15 OR nday = 0 OR abs(tm + 5 - bin) > 20 AS reject_max FROM b""",
)
def ice_masks(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n_day, n_night, bin_t = F.pmod(k, F.lit(3)).cast("int"), F.pmod(c, F.lit(3)).cast("int"), (235 + F.pmod(k, F.lit(40))).cast("double")
    rows = adaptor.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.pmod(c, F.lit(5)).cast("int").alias("land_mask"),
        F.when(c % 7 != 0, F.pmod(c, F.lit(100)) / F.lit(100.0)).alias("sea_ice_fraction"),
        F.when(c % 11 != 0, F.pmod(k, F.lit(90)) / F.lit(10.0)).alias("std"),
        (240 + F.pmod(k, F.lit(45))).cast("double").alias("t_mean"),
        (235 + F.pmod(k, F.lit(45))).cast("double").alias("t_min"),
        (245 + F.pmod(k, F.lit(45))).cast("double").alias("t_max"),
        F.array(*[bin_t for _ in range(8)]).alias("bin_t"),
        F.array(*[n_day if b in filters.DAY_BINS else n_night for b in range(8)]).alias("bin_n"),
    )
    return filters.ice_masks(rows).select("o_orderkey", "m_land_ice", "m_sea_ice_conc", "m_sea_ice", "m_ice", "m_marginal", "reject_mean", "reject_min", "reject_max")


# --- models -------------------------------------------------------------------------------------------------------------

_ICE = f"{SWATH}, ice AS (SELECT l_orderkey, location_id, measurement AS ts, day, CASE WHEN lat >= 0 THEN 'north' ELSE 'south' END AS hemisphere, CASE WHEN observable = 'O' THEN 'land' ELSE 'sea' END AS part, unc_ran AS u, unc_atm AS us, unc_sfc + 0.3 AS ul FROM swath)"
_COEFFICIENTS = (("north", "land", 1.5, 0.9, 0.4, -0.2), ("north", "sea", -0.5, 1.1, 0.1, 0.3), ("south", "land", 2.5, 0.8, -0.6, 0.5), ("south", "sea", 0.25, 1.0, 0.2, 0.1))


def _ice(spark, sf_dir):
    rows = adaptor.swath(spark, sf_dir).select(
        "l_orderkey", "location_id", F.col("measurement").alias("ts"), "day", F.when(F.col("lat") >= 0, "north").otherwise("south").alias("hemisphere"), F.when(F.col("observable") == "O", "land").otherwise("sea").alias("part"),
        F.lit("tasmin").alias("observable"), F.col("unc_ran").alias("unc_uncorrelated"), F.col("unc_atm").alias("unc_synoptic"), (F.col("unc_sfc") + 0.3).alias("unc_large_scale"),
    )
    table = spark.createDataFrame([(h, p, "tasmin", *c) for h, p, *c in _COEFFICIENTS], "hemisphere string, part string, observable string, c0 double, c1 double, c2 double, c3 double")
    return models.ice_model(rows, table)


_C = "c AS (SELECT * FROM (VALUES " + ", ".join(f"('{h}', '{p}', {a}, {b}, {c}, {d})" for h, p, a, b, c, d in _COEFFICIENTS) + ") AS t(hemisphere, part, c0, c1, c2, c3))"


@query(
    "ice_regression",
    f"WITH {_ICE}, {_C} SELECT l_orderkey, location_id, ts, round(c1 * (ts - 273.15) + c0 + c2 * cos(2 * pi() * (day - 18262) / 365.2425) + c3 * sin(2 * pi() * (day - 18262) / 365.2425) + 273.15, 6) AS tair FROM ice JOIN c USING (hemisphere, part)",
)
def ice_regression(spark, sf_dir):
    return _ice(spark, sf_dir).select("l_orderkey", "location_id", "ts", r6("tair").alias("tair"))


@query(
    "ice_uncertainty",
    f"""WITH {_ICE}, {_C}, k AS (SELECT * FROM (VALUES ('north', 'land', 2.2, 1.8), ('north', 'sea', 2.9, 1.8), ('south', 'land', 1.5, 1.8), ('south', 'sea', 5.7, 1.8)) AS t(hemisphere, part, rus, rel)),
p AS (SELECT l_orderkey, location_id, ts, cast(sqrt(u * u + rus * rus) * c1 AS double) AS ru, cast(sqrt((us * c1) * (us * c1) + rel * rel) AS double) AS ssu, cast(c1 * 0.2 AS double) AS lsu, cast(c1 * (ul - 0.2 + 2) AS double) AS cu FROM ice JOIN c USING (hemisphere, part) JOIN k USING (hemisphere, part))
SELECT l_orderkey, location_id, ts, round(ru, 6) AS ru, round(ssu, 6) AS ssu, round(lsu, 6) AS lsu, round(cu, 6) AS cu, round(sqrt(ru * ru + ssu * ssu + lsu * lsu), 6) AS total, round(sqrt(ru * ru + ssu * ssu + lsu * lsu + cu * cu), 6) AS total_cloud FROM p""",
)
def ice_uncertainty(spark, sf_dir):
    rows = _ice(spark, sf_dir).join(F.broadcast(models.ice_constants(spark)), ["hemisphere", "part", "observable"])
    return models.ice_budget(rows).select("l_orderkey", "location_id", "ts", *[r6(c).alias(c) for c in ("ru", "ssu", "lsu", "cu", "total", "total_cloud")])


_LAND_1, _LAND_2 = (2.0, 0.5, 0.4, 3.0, -1.5, 0.01, 0.0), (1.0, 0.0, 0.9, 2.0, 0.0, 0.02, -0.5)
_LAND = f"{SWATH}, land AS (SELECT l_orderkey, location_id, measurement, CASE WHEN qc % 3 <> 0 THEN measurement - 273.15 END AS d, CASE WHEN location_id % 5 <> 0 THEN measurement - 280.15 END AS n, unc_ran AS fvc, unc_atm AS dem, abs(lat) AS solz, unc_sfc AS snow, unc_ran AS ud, unc_atm AS un FROM swath)"


def _land(spark, sf_dir):
    rows = adaptor.swath(spark, sf_dir)
    predictors = {"lst_day": F.when(F.col("qc") % 3 != 0, F.col("measurement") - 273.15), "lst_night": F.when(F.col("location_id") % 5 != 0, F.col("measurement") - 280.15), "fvc": F.col("unc_ran"), "dem": F.col("unc_atm"), "solz": F.abs("lat"), "snow": F.col("unc_sfc")}
    return rows, predictors


@query(
    "land_regression_fallback",
    f"""WITH {_LAND}, m AS (SELECT l_orderkey, location_id, measurement, 2.0 + 0.5 * d + 0.4 * n + 3.0 * fvc - 1.5 * dem + 0.01 * solz AS m1, 1.0 + 0.9 * n + 2.0 * fvc + 0.02 * solz - 0.5 * snow AS m2 FROM land)
SELECT l_orderkey, location_id, measurement, round(coalesce(m1, m2), 6) AS tair, cast(CASE WHEN m1 IS NOT NULL THEN 1 WHEN m2 IS NOT NULL THEN 2 END AS int) AS model FROM m""",
)
def land_regression_fallback(spark, sf_dir):
    rows, p = _land(spark, sf_dir)
    value, number = models.land_fallback([(1, models.land_temperature(_LAND_1, p)), (2, models.land_temperature(_LAND_2, p))])
    return rows.select("l_orderkey", "location_id", "measurement", r6(value).alias("tair"), number.alias("model"))


@query(
    "land_uncertainty",
    f"""WITH {_LAND} SELECT l_orderkey, location_id, measurement, round(sqrt(0.25 * ud * ud + 0.16 * un * un + 9.0 * 0.01), 6) AS unc_random, round(sqrt(0.25 * ud * ud + 0.16 * un * un + 0.49), 6) AS unc_atm,
  round(sqrt(0.25 * ud * ud + 0.16 * un * un + 9.0 * 0.01), 6) AS unc_sfc, cast(0.1 AS double) AS unc_sys FROM land""",
)
def land_uncertainty(spark, sf_dir):
    rows, _ = _land(spark, sf_dir)
    parts = models.land_budget(_LAND_1, {"lst_day": F.col("unc_ran"), "lst_night": F.col("unc_atm"), "fvc": F.lit(0.1)}, 0.7)
    return rows.select("l_orderkey", "location_id", "measurement", *[r6(c).alias(n) for n, c in parts.items()])


_BASIS = ["1.0 / 365", *[f"{f}({k} * pi() * doy / 365) / (SELECT sum(power({f}({k} * pi() * d / 365), 2)) FROM range(1, 366) AS t(d))" for k in (2, 4) for f in ("sin", "cos")]]


@query(
    "ocean_fourier_offset",
    f"""WITH {CELLS}, p AS (SELECT k AS param, lat_idx, lon_idx, avg(measurement) / 40 - 4 - k AS mean, stddev_pop(measurement) / 30 AS sd FROM cells, range(0, 5) AS t(k) WHERE qc % 5 = k OR qc = 6 GROUP BY 1, 2, 3),
o AS (SELECT l_orderkey, location_id, lat_idx, lon_idx, measurement, cast(1 + day % 365 AS int) AS doy FROM cells WHERE qc = 5),
w AS (SELECT lat_idx, lon_idx, {", ".join(f"max(mean) FILTER (WHERE param = {k}) AS m{k}, max(greatest(sd, 0.3)) FILTER (WHERE param = {k}) AS s{k}" for k in range(5))} FROM p WHERE abs(mean) < 10 AND abs(sd) <= 10 GROUP BY 1, 2),
b AS (SELECT *, {", ".join(f"{e} AS b{k}" for k, e in enumerate(_BASIS))} FROM o)
SELECT l_orderkey, location_id, measurement, round({" + ".join(f"b{k} * m{k}" for k in range(5))}, 6) + 0 AS "offset", round(sqrt({" + ".join(f"b{k} * b{k} * s{k} * s{k}" for k in range(5))}), 6) AS offset_unc FROM b JOIN w USING (lat_idx, lon_idx)""",
)
def ocean_fourier_offset(spark, sf_dir):
    cells = GRID.assign(adaptor.swath(spark, sf_dir))
    number = F.explode(F.sequence(F.lit(0), F.lit(4)))
    p = cells.select("*", number.alias("param")).where((F.col("qc") % 5 == F.col("param")) | (F.col("qc") == 6)).groupBy("param", "lat_idx", "lon_idx")
    p = p.agg((F.avg("measurement") / 40 - 4 - F.col("param")).alias("mean"), (F.stddev_pop("measurement") / 30).alias("stdev"))
    obs = cells.where("qc = 5").withColumn("doy", (1 + F.pmod("day", F.lit(365))).cast("int"))
    return models.ocean_offset(obs, p).select("l_orderkey", "location_id", "measurement", r6("offset").alias("offset"), r6("offset_unc").alias("offset_unc"))


@query(
    "altitude_adjust",
    """SELECT s_suppkey, round(6.5 * (a - b), 6) AS adjustment, round(1.1 * abs(a - b), 6) AS adjustment_unc, round(sqrt(power(1.1 * abs(a - b), 2) + 0.09), 6) AS total_unc, round(280 + 4.5 * a, 6) AS sea_level
FROM (SELECT s_suppkey, cast(s_suppkey % 40 AS double) / 10 AS a, cast(s_suppkey % 7 AS double) / 5 AS b FROM supplier)""",
)
def altitude_adjust(spark, sf_dir):
    k = F.col("s_suppkey")
    a, b = F.pmod(k, F.lit(40)) / F.lit(10.0), F.pmod(k, F.lit(7)) / F.lit(5.0)
    u = physics.altitude_uncertainty(a, b)
    named = {"adjustment": physics.altitude_adjustment(a, b), "adjustment_unc": u, "total_unc": physics.quadrature(u, F.lit(0.3)), "sea_level": physics.remove_altitude(F.lit(280.0), a)}
    return adaptor.table(spark, sf_dir, "supplier").select("s_suppkey", *[r6(c).alias(n) for n, c in named.items()])


@query("remap_columns", f"WITH {SWATH} SELECT l_orderkey AS id, measurement + 10 AS shifted, round(sqrt(unc_ran * unc_ran + unc_atm * unc_atm + unc_sys * unc_sys), 6) AS total FROM swath")
def remap_columns(spark, sf_dir):
    spec = {"id": ("copy", "l_orderkey"), "shifted": ("copy", "measurement", 10), "total": ("total", ["unc_ran", "unc_atm", "unc_sys"])}
    return models.remap(adaptor.swath(spark, sf_dir), spec).withColumn("total", r6("total"))


@query(
    "solar_zenith",
    f"""WITH {LOCATIONS}, g AS (SELECT location_id, latitude, longitude, 2 * pi() * (location_id % 365) / 365 AS g FROM locations),
s AS (SELECT *, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS d,
  12 - longitude / 15 - 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) / 60 AS noon FROM g)
SELECT location_id, round(noon, 6) AS noon, round(degrees(acos(greatest(-1, least(1, sin(radians(latitude)) * sin(d) + cos(radians(latitude)) * cos(d) * cos(radians((9 - noon) * 15)))))), 6) AS zenith FROM s""",
)
def solar_zenith(spark, sf_dir):
    doy = F.pmod("location_id", F.lit(365)) + 1
    lat, lon = F.col("latitude"), F.col("longitude")
    return adaptor.locations(spark, sf_dir).select("location_id", r6(physics.solar_noon_hour(doy, lon)).alias("noon"), r6(physics.solar_zenith(doy, F.lit(9.0), lat, lon)).alias("zenith"))


# --- sources ------------------------------------------------------------------------------------------------------------


@query(
    "station_reader",
    f"""WITH {STATION_DAYS}, s AS (SELECT station, cast(day AS bigint) AS day, tmax, cast(station % 30 AS double) / 10 AS km, cast(station % 4 AS double) / 2 AS ref FROM station_days WHERE day % 3 = 0 AND station % 5 <> 1)
SELECT station AS location_id, day, round(tmax + 6.5 * (km - ref), 6) AS measurement, round(sqrt(power(1.1 * abs(km - ref), 2) + 0.09), 6) AS unc FROM s""",
)
def station_reader(spark, sf_dir):
    """Station series with quality codes, hold-out stations and altitude adjustment."""
    st = F.col("station")
    rows = adaptor.station_days(spark, sf_dir).select(
        st.cast("string").alias("station_code"), "station", F.lit(0.0).alias("latitude"), F.lit(190.0).alias("longitude"), (F.pmod(st, F.lit(30)) * F.lit(100.0)).alias("elevation"), "day",
        F.col("tmin").alias("tasmin"), F.col("tmax").alias("tasmax"), F.lit(0).alias("tasmin_qc"), F.when(F.col("day") % 3 == 0, 0).otherwise(1).alias("tasmax_qc"),
    )
    held = rows.where(st % 5 == 1).select("station_code").distinct()
    reference = rows.select("station").distinct().withColumn("reference_elevation", F.pmod(st, F.lit(4)) * F.lit(500.0))
    out = readers.land_stations(rows, "Tmax", held_out=held, altitude_reference=reference)
    return out.select("location_id", big("day").alias("day"), r6("measurement").alias("measurement"), r6("unc").alias("unc"))


@query(
    "single_day_means",
    f"""WITH {STATION_DAYS}, d AS (SELECT station, day, tmax - 1 AS m, umax AS u FROM station_days WHERE station % 3 = 0), x AS (SELECT station, day, (tmin + tmax) / 2 AS m, sqrt((umin * umin + umax * umax) / 2) AS u FROM station_days)
SELECT station, cast(day AS bigint) AS day, round(coalesce(d.m, x.m), 6) AS measurement, round(coalesce(d.u, x.u), 6) AS unc FROM d FULL JOIN x USING (station, day)""",
)
def single_day_means(spark, sf_dir):
    """Means as observed (every third station has some), else from the extremes of the day, which all have."""
    days = adaptor.station_days(spark, sf_dir)
    part = lambda name, value, unc, where: days.where(where).select("station", "day", F.lit(name).alias("observable"), value.alias("measurement"), F.col(unc).alias("unc"))
    obs = part("Tmean", F.col("tmax") - 1, "umax", "station % 3 = 0").union(part("Tmin", F.col("tmin"), "umin", "true")).union(part("Tmax", F.col("tmax"), "umax", "true"))
    out = readers.single_day(obs, ["station", "day"])
    return out.select("station", big("day").alias("day"), r6("measurement").alias("measurement"), r6("unc").alias("unc"))


@query(
    "granule_status",
    """WITH e AS (SELECT TIMESTAMP '2024-01-05' + i * INTERVAL 5 MINUTE AS g FROM range(0, 288) AS t(i)), p AS (SELECT DISTINCT time_bucket(INTERVAL 5 MINUTE, cast(ts AS timestamp)) AS g FROM events)
SELECT strftime(e.g, '%Y-%m-%d %H:%M') AS granule, CASE WHEN p.g IS NOT NULL THEN 'ok' ELSE 'missing' END AS status FROM e LEFT JOIN p USING (g)""",
)
def granule_status(spark, sf_dir):
    present = adaptor.table(spark, sf_dir, "events").select(F.window(F.col("ts").cast("timestamp"), "5 minutes")["start"].alias("granule"))
    out = readers.granule_status(readers.granules(spark, "20240105"), present)
    return out.select(F.date_format("granule", "yyyy-MM-dd HH:mm").alias("granule"), "status")


@query("grid_as_source", f"WITH {FIELD} SELECT cast(lat_idx * 36 + lon_idx AS bigint) AS location_id, round(tas, 6) AS measurement, round(-90 + 10 * (lat_idx + 0.5), 6) AS latitude, round(-180 + 10 * (lon_idx + 0.5), 6) AS longitude FROM field WHERE tas IS NOT NULL")
def grid_as_source(spark, sf_dir):
    obs = readers.gridded(adaptor.field(spark, sf_dir).withColumn("day", F.lit(0)), GRID, "tas", "unc")
    out = joins.with_location(obs, GRID.lookup(spark))
    return out.select("location_id", r6("measurement").alias("measurement"), r6("latitude").alias("latitude"), r6("longitude").alias("longitude"))


@query(
    "two_hemispheres",
    f"""WITH {FIELD} SELECT cast((lat_idx - CASE WHEN lat_idx >= 9 THEN 9 ELSE 0 END + CASE WHEN lat_idx >= 9 THEN 11 ELSE 0 END) * 36 + lon_idx AS bigint) AS location_id, round(tas, 6) AS tas FROM field""",
)
def two_hemispheres(spark, sf_dir):
    rows = adaptor.field(spark, sf_dir)
    part = lambda low, high: rows.where(F.col("lat_idx").between(low, high)).select(big((F.col("lat_idx") - low) * NLON + F.col("lon_idx")).alias("location_id"), r6("tas").alias("tas"))
    return readers.two_hemispheres(part(0, 8), part(9, 17), 9, 2, NLON)


@query("station_matrix", f"WITH {STATION_DAYS} SELECT cast(day AS bigint) AS day, max(tmax) FILTER (WHERE station = 3) AS s3, max(tmax) FILTER (WHERE station = 4) AS s4 FROM station_days WHERE station IN (3, 4) GROUP BY 1")
def station_matrix(spark, sf_dir):
    from terracell.sources import sinks

    out = sinks.station_matrix(adaptor.station_days(spark, sf_dir).where("station IN (3, 4)"), "tmax", [3, 4])
    return out.select(big("day").alias("day"), F.col("3").alias("s3"), F.col("4").alias("s4"))


@query(
    "bias_groups",
    f"""WITH {SWATH} SELECT source, g, count(*) AS n FROM (SELECT source, CASE WHEN source = 'N' THEN CASE WHEN lat < 0 THEN 1 ELSE 0 END ELSE 0 END AS g FROM swath) GROUP BY 1, 2""",
)
def bias_groups(spark, sf_dir):
    name = F.when(F.col("source") == "N", "ice").otherwise("land")
    return adaptor.swath(spark, sf_dir).groupBy("source", joins.bias_group(name, F.col("lat")).alias("g")).agg(F.count(F.lit(1)).alias("n"))


@query("unmatched_files", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def unmatched_files(spark, sf_dir):
    name = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "'tas_'yyyyMMdd'.nc'")).otherwise(F.date_format("o_orderdate", "'tas-'yyyyMMdd'.nc'"))
    return catalogue.unmatched(adaptor.table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name")), ["tas_%Y%m%d.nc"]).select("o_orderkey")


@query(
    "catalogue_update",
    """WITH old AS (SELECT 'd' AS dataset, o_orderkey % 2 AS subset, row_number() OVER (PARTITION BY o_orderkey % 2 ORDER BY o_orderkey) - 1 AS entry, 'f' || lpad(cast(o_orderkey AS varchar), 9, '0') AS path FROM orders WHERE o_orderkey % 5 = 0),
fresh AS (SELECT o_orderkey % 2 AS subset, 'f' || lpad(cast(o_orderkey AS varchar), 9, '0') AS path FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0)
SELECT cast(subset AS int) AS subset, cast(entry AS int) AS entry, path FROM old UNION ALL
SELECT cast(f.subset AS int), cast((SELECT max(entry) FROM old WHERE old.subset = f.subset) + row_number() OVER (PARTITION BY f.subset ORDER BY path) AS int), path FROM fresh AS f""",
)
def catalogue_update(spark, sf_dir):
    o = adaptor.table(spark, sf_dir, "orders")
    entry = lambda where: o.where(where).select(F.lit("d").alias("dataset"), F.pmod("o_orderkey", F.lit(2)).cast("int").alias("subset"), F.concat(F.lit("f"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("path"))
    w = Window.partitionBy("subset").orderBy("path")
    old = entry("o_orderkey % 5 = 0").withColumn("entry", F.row_number().over(w) - 1)
    new = entry("o_orderkey % 3 = 0").withColumn("entry", F.lit(0))
    return catalogue.update(old, new).select("subset", "entry", "path")


# --- sparse matrices ------------------------------------------------------------------------------------------------------

_DESIGN = """obs AS (SELECT o_orderkey AS "row", cast((o_orderkey * 7919) % 18000 AS double) / 100 - 90 AS lat, o_orderstatus AS source, 200 + cast(o_orderkey % 97 AS double) AS measurement, cast(1 + o_custkey % 10 AS double) / 10 AS unc_ran FROM orders),
design AS (SELECT "row", 0 AS col, cast(1 AS double) AS value FROM obs UNION ALL SELECT "row", 1, cos(2 * radians(lat)) FROM obs UNION ALL SELECT "row", 2, sin(2 * radians(lat)) FROM obs UNION ALL SELECT "row", 3, cos(4 * radians(lat)) FROM obs UNION ALL
  SELECT "row", 4, sin(4 * radians(lat)) FROM obs UNION ALL SELECT "row", 5, cast(1 AS double) FROM obs WHERE source = 'O')"""


def _design(spark, sf_dir):
    """(observations, design) of a model with mean, latitude harmonics and one source's bias."""
    k = F.col("o_orderkey")
    obs = adaptor.table(spark, sf_dir, "orders").select(
        k.alias("row"), adaptor.latitude_of(k).alias("lat"), F.when(F.col("o_orderstatus") == "O", 0).alias("group"), (F.lit(200.0) + F.pmod(k, F.lit(97))).alias("measurement"),
        ((1 + F.pmod("o_custkey", F.lit(10))) / F.lit(10.0)).alias("unc_ran"),
    )
    model = elements.combination([elements.grand_mean(), elements.latitude_harmonics(), elements.bias("group", 1)])
    return obs, model.design(obs)


@query(
    "info_matrix",
    f"""WITH {_DESIGN} SELECT cast(a.col AS bigint) AS i, cast(b.col AS bigint) AS j, round(sum(a.value * b.value / (unc_ran * unc_ran)), 4) + 0 AS value FROM design AS a JOIN design AS b USING ("row") JOIN obs USING ("row") GROUP BY 1, 2""",
)
def info_matrix(spark, sf_dir):
    obs, design = _design(spark, sf_dir)
    q = obs.select("row", (1 / (F.col("unc_ran") * F.col("unc_ran"))).alias("q"))
    return coo.information_matrix(design, q).select("i", "j", (F.round("value", 4) + F.lit(0.0)).alias("value"))


@query("info_vector", f"""WITH {_DESIGN} SELECT cast(col AS bigint) AS i, round(sum(value * (measurement - 250) / (unc_ran * unc_ran)), 3) + 0 AS value FROM design JOIN obs USING ("row") GROUP BY 1""")
def info_vector(spark, sf_dir):
    obs, design = _design(spark, sf_dir)
    q = obs.select("row", (1 / (F.col("unc_ran") * F.col("unc_ran"))).alias("q"))
    r = obs.select("row", (F.col("measurement") - 250).alias("r"))
    return coo.information_vector(design, q, r).select("i", (F.round("value", 3) + F.lit(0.0)).alias("value"))


def _state(spark):
    return spark.createDataFrame([(k, 1.5 - 0.25 * k) for k in range(6)], "col bigint, value double")


@query("projection_spmv", f"""WITH {_DESIGN} SELECT "row", round(sum(value * (1.5 - 0.25 * col)), 6) + 0 AS value FROM design GROUP BY 1""")
def projection_spmv(spark, sf_dir):
    return coo.expected(_design(spark, sf_dir)[1], _state(spark)).select("row", r6("value").alias("value"))


@query("projection_deviation", f"""WITH {_DESIGN} SELECT "row", round(sqrt(sum(value * value * power(1.5 - 0.25 * col, 2))), 6) AS value FROM design GROUP BY 1""")
def projection_deviation(spark, sf_dir):
    return coo.deviation(_design(spark, sf_dir)[1], _state(spark)).select("row", r6("value").alias("value"))


@query(
    "sparse_product",
    """WITH a AS (SELECT l_orderkey % 60 AS r, l_partkey % 50 AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
SELECT cast(x.r AS bigint) AS "row", cast(y.r AS bigint) AS col, round(sum(x.v * y.v), 3) AS value FROM a AS x JOIN a AS y ON x.c = y.c GROUP BY 1, 2""",
)
def sparse_product(spark, sf_dir):
    t = adaptor.table(spark, sf_dir, "lineitem")
    a = t.groupBy(F.pmod("l_orderkey", F.lit(60)).alias("row"), F.pmod("l_partkey", F.lit(50)).alias("col")).agg(F.sum("l_quantity").alias("value"))
    return coo.matmul(a, coo.transpose(a)).select("row", "col", F.round("value", 3).alias("value"))


@query(
    "latitude_spline",
    f"""WITH {LOCATIONS}, n AS (SELECT location_id AS "row", k AS col, abs(latitude - (-180 + k)) / 5 AS r FROM locations, range(0, 361) AS t(k))
SELECT "row", col, round(power(1 - r, 6) * (35 * r * r + 18 * r + 3) / 3, 8) AS value FROM n WHERE r < 1""",
)
def latitude_spline(spark, sf_dir):
    rows = adaptor.locations(spark, sf_dir).select(F.col("location_id").alias("row"), F.col("latitude").alias("lat"))
    return elements.latitude_spline().design(rows).select("row", "col", F.round("value", 8).alias("value"))


@query(
    "space_time_kronecker",
    f"""WITH e AS (SELECT event_id AS "row", ({DAY.format('ts')} - 63552) / 5.0 AS x, cast((user_id * 7919) % 18000 AS double) / 100 - 90 AS lat FROM events),
t AS (SELECT "row", lat, floor(x) + d AS k, 1 - abs(x - floor(x) - d) AS v FROM e, range(0, 2) AS s(d)),
h AS (SELECT "row", 0 AS c, cos(2 * radians(lat)) AS v FROM e UNION ALL SELECT "row", 1, sin(2 * radians(lat)) FROM e UNION ALL SELECT "row", 2, cos(4 * radians(lat)) FROM e UNION ALL SELECT "row", 3, sin(4 * radians(lat)) FROM e)
SELECT cast(k * 4 + c AS bigint) AS col, count(*) AS n, round(sum(t.v * h.v), 5) + 0 AS value FROM t JOIN h USING ("row") WHERE t.v > 0 AND k BETWEEN 0 AND 6 GROUP BY 1""",
)
def space_time_kronecker(spark, sf_dir):
    e = adaptor.table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("row"), timebase.day_number(F.col("ts")).alias("time"), adaptor.latitude_of(F.col("user_id")).alias("lat"))
    model = elements.space_time(elements.time_nodes(63552.0, 5.0, 7), elements.latitude_harmonics())
    return model.design(rows).groupBy("col").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("value"), 5) + F.lit(0.0)).alias("value"))


@query("gmrf_small_solve")
def gmrf_small_solve(spark, sf_dir):
    """Posterior mean of the small model: information sums in Spark, a 6 x 6 solve on the driver."""
    obs, design = _design(spark, sf_dir)
    q = obs.select("row", (1 / (F.col("unc_ran") * F.col("unc_ran"))).alias("q"))
    r = obs.select("row", (F.col("measurement") - 250).alias("r"))
    posterior = coo.add(coo.information_matrix(design, q).withColumnsRenamed({"i": "row", "j": "col"}), spark.createDataFrame([(k, k, 1.0) for k in range(6)], "row bigint, col bigint, value double"))
    x = solve.map_solution(posterior, coo.information_vector(design, q, r), 6)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "param_id bigint, value double")


@query("gmrf_conjugate_gradients")
def gmrf_conjugate_gradients(spark, sf_dir):
    """The same posterior mean without collecting the system."""
    obs, design = _design(spark, sf_dir)
    q = obs.select("row", (1 / (F.col("unc_ran") * F.col("unc_ran"))).alias("q"))
    r = obs.select("row", (F.col("measurement") - 250).alias("r"))
    posterior = coo.add(coo.information_matrix(design, q).withColumnsRenamed({"i": "row", "j": "col"}), spark.createDataFrame([(k, k, 1.0) for k in range(6)], "row bigint, col bigint, value double"))
    return solve.conjugate_gradients(posterior.cache(), coo.information_vector(design, q, r), 1e-9).withColumnRenamed("col", "param_id")


@query("mesh_locate")
def mesh_locate(spark, sf_dir):
    """Triangle, vertices and weights of every pixel's place on a level 4 mesh."""
    rows = adaptor.swath(spark, sf_dir).select("l_orderkey", "location_id", "lat", "lon")
    return mesh.locate(rows, 4)


@query("quality_control")
def quality_control(spark, sf_dir):
    """All flags of a series of daily fields, then the masked product."""
    from terracell.plans import quality

    f = adaptor.field(spark, sf_dir)
    days = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.struct((k * 3 + 60000).alias("day"), k.alias("k")))
    fields = f.withColumn("d", F.explode(days)).select("*", "d.*").select(
        "day", "lat_idx", "lon_idx", (F.col("tas") + F.when((F.col("k") == 5) & (F.col("lat_idx") == 7), 120).otherwise(0)).alias("tas"), F.col("unc").alias("climatology_unc"), F.col("unc").alias("large_scale_unc"),
        (F.col("influence") + F.when(F.col("k") % 4 == 0, 0.5).otherwise(0.0)).alias("influence"), F.when(F.col("lon_idx") < 12, 100).otherwise(0).alias("coastal_influence"),
    )
    out = quality.threshold_flags(fields, NLAT, NLON)
    out = quality.outlier_flags(quality.window_flags(out), "tas", NLAT, NLON, 7)
    return quality.masked_product(out, ["tas"]).select("day", "lat_idx", "lon_idx", "qc", "masked", r6("tas").alias("tas"))


# --- further operators ----------------------------------------------------------------------------------------------------


@query(
    "monthly_anomalies",
    f"""WITH {CELLS}, m AS (SELECT year(d) AS y, month(d) AS mo, lat_idx, lon_idx, avg(measurement) - 250 AS a FROM (SELECT *, DATE '1850-01-01' + cast(day AS int) AS d FROM cells) GROUP BY 1, 2, 3, 4)
SELECT cast({DAY.format("make_date(y, mo, 1)")} + floor(day(last_day(make_date(y, mo, 1))) / 2) AS bigint) AS day, cast(lat_idx * 36 + lon_idx AS bigint) AS location_id, round(a, 6) + 0 AS measurement FROM m""",
)
def monthly_anomalies(spark, sf_dir):
    cells = GRID.assign(adaptor.swath(spark, sf_dir)).withColumn("d", timebase.date_of(F.col("day")))
    months = cells.groupBy(F.year("d").alias("year"), F.month("d").alias("month"), "lat_idx", "lon_idx").agg((F.avg("measurement") - 250).alias("anomaly"), F.lit(0.5).alias("unc"))
    return readers.monthly_anomalies(months, GRID).select(big("day").alias("day"), "location_id", r6("measurement").alias("measurement"))


@query(
    "bias_by_year",
    f"""WITH {BREAKS}, y AS (SELECT y AS year, {DAY.format("make_date(y, 1, 1)")} AS day FROM range(1992, 2003) AS t(y)), s AS (SELECT DISTINCT station FROM breaks)
SELECT s.station, cast(year AS bigint) AS year, cast((SELECT min(break_day) FROM breaks AS b WHERE b.station = s.station AND b.break_day > y.day) AS bigint) AS next_break FROM s, y""",
)
def bias_by_year(spark, sf_dir):
    return joins.bias_by_year(adaptor.breaks(spark, sf_dir), 1992, 2002).select("station", "year", big("next_break").alias("next_break"))


@query("bin_extremes", f"WITH {CELLS} SELECT lat_idx, lon_idx, count(measurement) AS n, min(measurement) AS low, max(measurement) AS high, count(measurement) > 20 AS over_capacity FROM cells GROUP BY 1, 2")
def bin_extremes(spark, sf_dir):
    """Extremes over every observation, and whether a bin holds more than its capacity."""
    return aggregate.extremes(GRID.assign(adaptor.swath(spark, sf_dir)), ["lat_idx", "lon_idx"], "measurement", 20)


@query(
    "same_coordinates",
    f"""WITH {CELLS}, a AS (SELECT DISTINCT round(-90 + 2.5 * trunc((lat + 90) / 2.5), 6) AS latitude, cast(trunc((lat + 90) / 2.5) AS int) AS i FROM cells), b AS (SELECT DISTINCT round(-90 + 10 * lat_idx, 6) AS latitude, lat_idx AS j FROM cells)
SELECT latitude, i, j FROM a JOIN b USING (latitude)""",
)
def same_coordinates(spark, sf_dir):
    """Latitude edges of the pixels' cells that a fine and a coarse grid share."""
    rows = adaptor.swath(spark, sf_dir)
    edges = lambda axis: rows.select(axis.index(F.col("lat")).alias("idx")).distinct().select("idx", axis.edge(F.col("idx")).alias("latitude"))
    return readers.same_coordinate(edges(Axis(-90.0, 2.5, 72)), edges(GRID.lat), "latitude")


@query(
    "same_time_files",
    """SELECT a.o_orderkey AS primary_file, b.o_orderkey AS auxiliary_file FROM orders AS a JOIN orders AS b ON a.o_orderdate = b.o_orderdate WHERE b.o_orderkey % 40 = 1""",
)
def same_time_files(spark, sf_dir):
    """Every primary file; the auxiliary ones are thinned, so that some have no partner."""
    o = adaptor.table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "time")
    out = readers.same_time(o.select("time", F.col("o_orderkey").alias("primary_file")), o.where("o_orderkey % 40 = 1").select("time", F.col("o_orderkey").alias("auxiliary_file")))
    return out.select("primary_file", "auxiliary_file")


@query(
    "batch_of_operations",
    """SELECT cast(operation AS int) AS operation, name FROM (SELECT name, row_number() OVER (ORDER BY name) - 1 AS operation FROM (SELECT DISTINCT 'tas_' || strftime(o_orderdate, '%Y%m') || '.nc' AS name FROM orders)) WHERE operation BETWEEN 24 AND 35""",
)
def batch_of_operations(spark, sf_dir):
    """The third batch of twelve of the monthly outputs."""
    names = catalogue.outputs(adaptor.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("time")), "tas_%Y%m.nc")
    return catalogue.batch(names.select(F.col("entry").alias("operation"), "name"), 12, 2)


@query(
    "factor_jacobian",
    f"""WITH e AS (SELECT event_id AS "row", ({DAY.format('ts')} - 63552) / 5.0 AS x, cast((user_id * 7919) % 18000 AS double) / 100 - 90 AS lat FROM events),
t AS (SELECT "row", floor(x) + d AS k, 1 - abs(x - floor(x) - d) AS v FROM e, range(0, 2) AS s(d)), level AS (SELECT "row", sum(v * (k + 1)) AS f FROM t WHERE v > 0 AND k BETWEEN 0 AND 6 GROUP BY 1),
h AS (SELECT "row", 0 AS c, cos(2 * radians(lat)) AS v FROM e UNION ALL SELECT "row", 1, sin(2 * radians(lat)) FROM e UNION ALL SELECT "row", 2, cos(4 * radians(lat)) FROM e UNION ALL SELECT "row", 3, sin(4 * radians(lat)) FROM e)
SELECT cast(c AS bigint) AS col, count(*) AS n, round(sum(h.v * f), 4) + 0 AS value FROM h JOIN level USING ("row") GROUP BY 1""",
)
def factor_jacobian(spark, sf_dir):
    e = adaptor.table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("row"), timebase.day_number(F.col("ts")).alias("time"), adaptor.latitude_of(F.col("user_id")).alias("lat"))
    time_state = spark.range(7).select(F.col("id").alias("col"), (F.col("id") + 1.0).alias("value"))
    space, _ = elements.factor(elements.latitude_harmonics(), elements.time_nodes(63552.0, 5.0, 7), time_state, time_state)
    return space.design(rows).groupBy("col").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("value"), 4) + F.lit(0.0)).alias("value"))


@query("regional_solves")
def regional_solves(spark, sf_dir):
    """Local fields of every base triangle, each solved in its own group."""
    k = F.col("o_orderkey")
    obs = adaptor.table(spark, sf_dir, "orders").select(k.alias("row"), adaptor.latitude_of(k).alias("lat"), adaptor.longitude_of(F.col("o_custkey")).alias("lon"), F.lit(4.0).alias("q"), (F.pmod(k, F.lit(97)) - 48.0).alias("r"))
    return solve.solve_regions(elements.region_designs(obs, 2, 0), obs.select("row", "q", "r"), 1.0)


@query(
    "obs_summary",
    f"""WITH {SWATH}, c AS (SELECT unnest(generate_series(min(day), max(day))) AS d FROM swath), k AS (SELECT day AS d, count(*) AS n FROM swath GROUP BY 1)
SELECT count(*) AS days, sum(coalesce(n, 0))::bigint AS total, count(*) FILTER (WHERE n IS NULL) AS missing_days, round(avg(n), 6) AS mean_per_day FROM c LEFT JOIN k USING (d)""",
)
def obs_summary(spark, sf_dir):
    """Every observation, over the calendar from the first to the last."""
    rows = adaptor.swath(spark, sf_dir)
    calendar = rows.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return aggregate.observation_summary(rows, calendar).withColumn("mean_per_day", r6("mean_per_day"))


@query(
    "satellite_pairs",
    f"""WITH {SWATH}, p AS (SELECT l_orderkey AS granule, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, location_id, qc, measurement, unc_ran, unc_atm) AS "row", location_id AS col, measurement,
  CASE WHEN location_id % 3 <> 0 THEN unc_ran END AS a, unc_atm AS b FROM swath)
SELECT cast(granule AS bigint) AS granule, "row", col, measurement, round(a, 6) AS unc_ran, round(b, 6) AS unc_atm, round(cast(granule % 7 AS double) / 10, 6) AS unc_sys FROM p WHERE a IS NOT NULL""",
)
def satellite_pairs(spark, sf_dir):
    """Every pixel: numbered within its granule, so that none shares a position; one without an auxiliary value drops out."""
    w = Window.partitionBy("l_orderkey").orderBy("l_suppkey", "location_id", "qc", "measurement", "unc_ran", "unc_atm")
    s = adaptor.swath(spark, sf_dir).withColumn("row", big(F.row_number().over(w)))
    s = s.select(F.col("l_orderkey").alias("granule"), "row", F.col("location_id").alias("col"), "measurement", F.when(F.col("location_id") % 3 != 0, F.col("unc_ran")).alias("unc_ran"), "unc_atm")
    scalars = s.select("granule").distinct().withColumn("unc_sys", F.pmod("granule", F.lit(7)) / F.lit(10.0))
    out = readers.satellite_pairs(s.select("granule", "row", "col", "measurement"), s.drop("measurement"), ["unc_ran", "unc_atm"], scalars)
    return out.select("granule", "row", "col", "measurement", r6("unc_ran").alias("unc_ran"), r6("unc_atm").alias("unc_atm"), r6("unc_sys").alias("unc_sys"))


# --- sources that are read from lines and files -----------------------------------------------------------------------


@query("break_points", f"WITH {BREAKS} SELECT station, cast(break_day AS bigint) AS break_day, likelihood FROM breaks WHERE station = 7 AND likelihood IS NOT NULL")
def break_points(spark, sf_dir):
    """The breaks of one station."""
    return readers.break_points(adaptor.breaks(spark, sf_dir), 7).select("station", big("break_day").alias("break_day"), "likelihood")


@query(
    "ship_reports",
    f"""SELECT cast(o_orderkey AS varchar) AS ship, {DAY.format('o_orderdate')}::int AS day, round((o_custkey % 1800 - 900) * 0.1, 6) AS latitude,
  round(CASE WHEN o_orderkey % 3600 >= 1800 THEN (o_orderkey % 3600) * 0.1 - 360 ELSE (o_orderkey % 3600) * 0.1 END, 6) AS longitude, round((o_custkey % 4000 - 1000) * 0.01 + 273.15, 6) AS measurement, cast(1.1 AS double) AS unc FROM orders""",
)
def ship_reports(spark, sf_dir):
    """orders as fixed-width lines, read as ship reports."""
    titles = ["ID", "year", "month", "day", "Lat", "Lon", "Air"]
    d, k, c = F.col("o_orderdate"), F.col("o_orderkey"), F.col("o_custkey")
    values = [k, F.year(d), F.month(d), F.dayofmonth(d), F.pmod(c, F.lit(1800)) - 900, F.pmod(k, F.lit(3600)), F.pmod(c, F.lit(4000)) - 1000]
    lines = adaptor.table(spark, sf_dir, "orders").select(F.concat(*[F.lpad(v.cast("string"), 8, " ") for v in values]).alias("value"))
    out = readers.ship_reports(lines, titles)
    return out.select("ship", "day", r6("latitude").alias("latitude"), r6("longitude").alias("longitude"), r6("measurement").alias("measurement"), "unc")


@query(
    "lake_reports",
    f"""WITH r AS (SELECT o_orderdate, cast((o_custkey * 7919) % 18000 AS double) / 100 - 90 AS lat, cast((o_custkey * 104729) % 36000 AS double) / 100 - 180 AS lon, cast(o_orderkey % 300 AS double) / 10 AS t FROM orders),
s AS (SELECT *, cast(trunc(cast(360000000 AS double) * lat) AS bigint) + cast(trunc(cast(1000000 AS double) * lon) AS bigint) AS sig FROM r)
SELECT cast({DAY.format('o_orderdate')} AS bigint) AS day, cast(dense_rank() OVER (ORDER BY sig) - 1 AS bigint) AS location_id, round(t + 273.15, 6) AS measurement, cast(5.0 AS double) AS unc FROM s""",
)
def lake_reports(spark, sf_dir):
    """orders as tab-separated lines, read as lake temperatures."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    line = F.concat_ws("\t", F.date_format("o_orderdate", "yyyy-MM-dd"), adaptor.latitude_of(c).cast("string"), adaptor.longitude_of(c).cast("string"), (F.pmod(k, F.lit(300)) / 10.0).cast("string"))
    rows = adaptor.table(spark, sf_dir, "orders").select(F.from_csv(line, readers.LAKE, {"sep": "\t"}).alias("r")).select("r.*")
    obs, _ = readers.lake_reports(rows)
    return obs.select(big("day").alias("day"), "location_id", r6("measurement").alias("measurement"), "unc")


@query("ocean_source", f"WITH {SWATH} SELECT l_orderkey, location_id, round(measurement - 250 + 273.15, 6) AS measurement, cast(100.0 AS double) AS correlation_km FROM swath")
def ocean_source(spark, sf_dir):
    rows = adaptor.swath(spark, sf_dir).select("l_orderkey", "location_id", (F.col("measurement") - 250).alias("tas"))
    return readers.ocean(rows).select("l_orderkey", "location_id", r6("measurement").alias("measurement"), "correlation_km")


@query("retrieve_day", f"WITH {SWATH} SELECT l_orderkey, location_id, measurement FROM swath WHERE day = {DAY.format("DATE '1996-03-13'")}")
def retrieve_day(spark, sf_dir):
    day = spark.range(1).select(timebase.day_number(F.lit("1996-03-13").cast("date"))).first()[0]
    return readers.retrieve_day(adaptor.swath(spark, sf_dir), day).select("l_orderkey", "location_id", "measurement")


@query("missing_source", f"WITH {SWATH} SELECT location_id, count(*) AS n FROM swath GROUP BY 1")
def missing_source(spark, sf_dir):
    """A source without observations changes nothing beside one that has some."""
    rows = adaptor.swath(spark, sf_dir).select("location_id", "measurement")
    return rows.unionByName(readers.missing(spark).select("location_id", "measurement")).groupBy("location_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "location_pointers",
    f"""WITH {SWATH} SELECT location_id, cast(day AS bigint) AS day, cast(48 + 24 * (row_number() OVER (PARTITION BY day ORDER BY l_orderkey, location_id, l_suppkey, qc, measurement) - 1) AS bigint) AS "offset" FROM swath""",
)
def location_pointers(spark, sf_dir):
    """Where each place's records stand in the files of its days."""
    out = readers.location_pointers(adaptor.swath(spark, sf_dir), ["l_orderkey", "location_id", "l_suppkey", "qc", "measurement"])
    return out.select("location_id", big("day").alias("day"), "offset")


@query(
    "station_status",
    f"""WITH {BREAKS}, w AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY break_day, likelihood) - 1 AS k, lag(break_day) OVER (PARTITION BY station ORDER BY break_day, likelihood) AS before FROM breaks)
SELECT station, cast(k AS int) AS status_index, cast(break_day AS bigint) AS break_day, likelihood, cast(before + 1 AS bigint) AS from_day FROM w""",
)
def station_status(spark, sf_dir):
    out = sinks.station_status(adaptor.breaks(spark, sf_dir))
    return out.select("station", "status_index", big("break_day").alias("break_day"), "likelihood", big("from_day").alias("from_day"))


@query(
    "ice_input",
    f"""WITH {SWATH} SELECT l_orderkey, location_id, cast(day AS bigint) AS day, coalesce(unc_atm < 0.3, true) OR qc NOT IN (1, 4) IS NULL AS conc, qc NOT IN (1, 4) AS land_ice,
  coalesce(cast(qc * 1.5 AS double) > 7.07, false) AS m_std, coalesce(measurement > 278.15, false) AS m_value, CASE WHEN qc % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN qc % 3 = 0 THEN 2 ELSE 0 END = 0 AS m_day_count FROM swath""",
)
def ice_input(spark, sf_dir):
    """Pixels as ice temperature fields, through the reader's renaming into the masks."""
    m, qc = F.col("measurement"), F.col("qc")
    rows = adaptor.swath(spark, sf_dir).select(
        "l_orderkey", "location_id", "lat", "lon", F.col("unc_atm").alias("sea_ice_fraction"), qc.alias("land_mask"), m.alias("surface_temperature"), (m - 1).alias("surface_temperature_min"), (m + 1).alias("surface_temperature_max"),
        (qc * 1.5).alias("surface_temperature_std"), F.array(*[m] * 8).alias("surface_temperature_3d"),
        F.array(F.lit(1), F.lit(0), F.when(qc % 2 == 0, 3).otherwise(0), F.when(qc % 3 == 0, 2).otherwise(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0)).alias("nobs_3d"),
        F.col("unc_ran").alias("uncorrelated_uncertainty"), F.col("unc_atm").alias("synoptically_correlated_uncertainty"), F.col("unc_sys").alias("large_scale_correlated_uncertainty"), timebase.date_of(F.col("day")).alias("time"),
    )
    keyed = rows.withColumn("lat", F.struct("l_orderkey", "location_id", "lat"))  # the keys travel with the place
    out = filters.ice_masks(readers.ice_fields(keyed))
    return out.select("lat.l_orderkey", "lat.location_id", big("day").alias("day"), F.col("m_sea_ice_conc").alias("conc"), F.col("m_land_ice").alias("land_ice"), "m_std", "m_value", "m_day_count")


# --- functions and operators ------------------------------------------------------------------------------------------


@query("remove_altitude", f"WITH {FIELD} SELECT lat_idx, lon_idx, round(tas + 4.5 * (cast((lat_idx * 7 + lon_idx * 3) % 40 AS double) / 10), 6) AS sea_level FROM field")
def remove_altitude(spark, sf_dir):
    """A field as it would be at sea level."""
    km = F.pmod(F.col("lat_idx") * 7 + F.col("lon_idx") * 3, F.lit(40)) / F.lit(10.0)
    return adaptor.field(spark, sf_dir).select("lat_idx", "lon_idx", r6(physics.remove_altitude(F.col("tas"), km)).alias("sea_level"))


@query("marine_mask", f"WITH {FIELD} SELECT lat_idx, lon_idx, coalesce(unc * 100 > 95, false) AS masked, coalesce(unc * 100 >= 50, false) AS flagged FROM field")
def marine_mask(spark, sf_dir):
    rows = adaptor.field(spark, sf_dir).withColumn("coastal_influence", F.col("unc") * 100)
    return rows.select("lat_idx", "lon_idx", filters.marine(rows).alias("masked"), filters.marine(rows, more_than=50.0, inclusive=True).alias("flagged"))


@query("prune_pairs", "SELECT * FROM (VALUES ('A', 'N', 0.5)) AS t(src_i, src_j, rho) WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'A') AND EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'N')")
def prune_pairs(spark, sf_dir):
    """Correlations that are left when a source has no observations (X), and the sources they are between."""
    rho = spark.createDataFrame([("A", "N", 0.5), ("A", "X", 0.25), ("X", "N", -0.1)], "src_i string, src_j string, rho double")
    return merge.prune_pairs(rho, adaptor.swath(spark, sf_dir).select("source").distinct())


@query(
    "latent_flags",
    """SELECT o_orderkey AS "row", cast(CASE WHEN sum(CASE WHEN c % 3 = 0 THEN v ELSE 0 END) > 0 THEN 32 ELSE 0 END AS int) AS qc
FROM (SELECT o_orderkey, o_custkey % 7 AS c, o_orderkey % 4 AS v FROM orders UNION ALL SELECT o_orderkey, o_custkey % 5 + 7, o_orderkey % 3 FROM orders) GROUP BY 1 HAVING bool_or(c % 3 = 0)""",
)
def latent_flags(spark, sf_dir):
    """Rows of a design that touch weakly constrained parameters (every third one)."""
    o, k, c = adaptor.table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    design = o.select(k.alias("row"), (c % 7).alias("col"), (k % 4).alias("value")).union(o.select(k, c % 5 + 7, k % 3))
    constraint = spark.range(12).select(F.col("id").alias("col"), F.when(F.col("id") % 3 == 0, 0.1).otherwise(0.9).alias("constraint"))
    return flags.latent_flag(design, constraint, 5).select("row", F.col("qc").cast("int").alias("qc"))


@query("ordered_members", f"WITH {FIELD} SELECT lat_idx, lon_idx, round(tas + 2, 6) AS first, round(tas + 10, 6) AS second, round(tas + 1, 6) AS third FROM field")
def ordered_members(spark, sf_dir):
    """Ensemble columns in the order of the numbers in their names."""
    t = F.col("tas")
    rows = adaptor.field(spark, sf_dir).select("lat_idx", "lon_idx", (t + 1).alias("tas_20"), (t + 2).alias("tas_3"), (t + 10).alias("tas_10"))
    out = aggregate.ordered_members(rows, ["tas_20", "tas_3", "tas_10"])
    return out.select("lat_idx", "lon_idx", *[r6(F.col("ensemble")[k]).alias(n) for k, n in enumerate(("first", "second", "third"))])


@query("thin_samples", "SELECT l_orderkey, count(*) AS n, sum(l_partkey)::bigint AS total FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) AS k FROM lineitem) WHERE k <= 3 GROUP BY 1")
def thin_samples(spark, sf_dir):
    """The first three samples of every ensemble."""
    rows = adaptor.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey"))), lambda x: x["l_partkey"]).alias("samples"))
    out = aggregate.thin(rows, "samples", 3)
    return out.select("l_orderkey", big(F.size("samples")).alias("n"), big(F.aggregate("samples", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("total"))


@query("pattern_lacks", "SELECT DISTINCT l_orderkey AS \"row\", l_partkey AS col FROM lineitem WHERE (l_orderkey, l_partkey) NOT IN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber <= 2)")
def pattern_lacks(spark, sf_dir):
    """Entries of one sparsity pattern that another lacks."""
    rows = adaptor.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), "l_linenumber")
    return coo.same_pattern(rows, rows.where("l_linenumber <= 2")).distinct()


@query("station_bias", f"WITH {BREAKS}, k AS (SELECT station, dense_rank() OVER (ORDER BY station) - 1 AS i FROM (SELECT DISTINCT station FROM breaks)) SELECT station, cast(i AS bigint) AS bias_index, round(cast((i + 3) * 37 % 11 AS double) / 10, 6) AS bias FROM k")
def station_bias(spark, sf_dir):
    """The stations' biases, a slice of a model's state."""
    k = F.col("id")
    stations = adaptor.breaks(spark, sf_dir).select("station").distinct()
    stations = temporal.offsets(stations.withColumn("n", F.lit(1)), "station").select("station", F.col("offset").alias("bias_index"))
    state = spark.range(100).select(k.alias("col"), (F.pmod(k * 37, F.lit(11)) / 10.0).alias("value"))
    out = elements.station_bias(state, 3, stations)
    return out.select("station", "bias_index", r6("bias").alias("bias"))


@query(
    "insitu_land_bias",
    f"""WITH {BREAKS}, kept AS (SELECT DISTINCT station, break_day FROM breaks WHERE likelihood >= 96), k AS (SELECT station, break_day, row_number() OVER (ORDER BY station, break_day) - 1 AS i FROM kept),
obs AS (SELECT o_orderkey AS "row", cast(o_custkey % 40 + 1 AS int) AS station, {DAY.format('o_orderdate')} AS day FROM orders), n AS (SELECT "row", obs.station, min(break_day) AS break_day FROM obs JOIN kept ON kept.station = obs.station AND break_day >= obs.day GROUP BY 1, 2)
SELECT cast(i AS bigint) AS col, count(*) AS n, min("row") AS first_row FROM n JOIN k USING (station, break_day) GROUP BY 1""",
)
def insitu_land_bias(spark, sf_dir):
    """Each observation's bias column: the break that ends its homogeneous period."""
    obs = adaptor.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), (F.pmod("o_custkey", F.lit(40)) + 1).cast("int").alias("station"), timebase.day_number(F.col("o_orderdate")).alias("day"))
    element, _ = elements.insitu_land_bias(adaptor.breaks(spark, sf_dir), 96)
    return element.design(obs).groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"))


@query("geography_element", SQL["bilinear_covariate"].replace("location_id, round(sum(w * c), 6) AS covariate", "location_id AS \"row\", round(sum(w * c) * 0.5, 6) + 0 AS value"))
def geography_element(spark, sf_dir):
    """A covariate map's value at each place, as a design's only column."""
    cells = GRID.assign(adaptor.swath(spark, sf_dir)).select(GRID.lat.centre(F.col("lat_idx")).alias("y"), GRID.lon.centre(F.col("lon_idx")).alias("x"), "measurement")
    nodes = readers.covariate_map(cells, GRID.lat, GRID.lon, "y", "x", "measurement")
    obs = adaptor.locations(spark, sf_dir).select(F.col("location_id").alias("row"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return elements.geography(nodes, GRID.lat, GRID.lon, 0.5).design(obs).select("row", r6("value").alias("value"))


# --- meshes -------------------------------------------------------------------------------------------------------------


def _mesh_sql(level: int) -> str:
    """Common tables: the mesh's triangles with their plane normals (as literals), and the pixels located by plane tests."""
    m = mesh.Mesh.build(level)
    p = m.points[m.triangles]
    sides = [np.cross(p[:, (k + 1) % 3], p[:, (k + 2) % 3]) for k in range(3)]
    rows = []
    for t in range(len(m.triangles)):
        n = [sides[k][t] for k in range(3)]
        long = [float(np.linalg.norm(x)) for x in n]
        numbers = ", ".join(f"{float(v)!r}" for x in n for v in x)
        rows.append(f"({t}, {m.ids[t]}, {', '.join(str(int(v)) for v in m.triangles[t])}, {numbers}, {', '.join(map(repr, long))})")
    names = "t, triangle_id, a, b, c, " + ", ".join(f"n{k}{x}" for k in range(3) for x in "xyz") + ", l0, l1, l2"
    dot = lambda k: f"(x * n{k}x + y * n{k}y + z * n{k}z)"
    return f"""{SWATH}, tri AS (SELECT * FROM (VALUES {', '.join(rows)}) AS t({names})),
place AS (SELECT DISTINCT lat, lon, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM swath),
tested AS (SELECT lat, lon, t, triangle_id, a, b, c, {dot(0)} AS w0, {dot(1)} AS w1, {dot(2)} AS w2, round(least({dot(0)} / l0, {dot(1)} / l1, {dot(2)} / l2), 12) AS low FROM place, tri),
located AS (SELECT * FROM tested WHERE low >= -1e-9 QUALIFY row_number() OVER (PARTITION BY lat, lon ORDER BY low DESC, t) = 1)"""


@query(
    "mesh_locate_coarse",
    f"""WITH {_mesh_sql(2)} SELECT l_orderkey, location_id, triangle_id, cast(a AS bigint) AS va, cast(b AS bigint) AS vb, cast(c AS bigint) AS vc, round(w0 / (w0 + w1 + w2), 6) + 0 AS wa, round(w1 / (w0 + w1 + w2), 6) + 0 AS wb, round(w2 / (w0 + w1 + w2), 6) + 0 AS wc
FROM swath JOIN located USING (lat, lon)""",
)
def mesh_locate_coarse(spark, sf_dir):
    """Triangle, vertices and weights of every pixel's place on a level 2 mesh."""
    out = mesh.locate(adaptor.swath(spark, sf_dir).select("l_orderkey", "location_id", "lat", "lon"), 2)
    v, w = F.col("vertices"), F.col("weights")
    return out.select("l_orderkey", "location_id", "triangle_id", *[v[k].alias(f"v{n}") for k, n in enumerate("abc")], *[r6(w[k]).alias(f"w{n}") for k, n in enumerate("abc")])


@query("mesh_faces", f"WITH {_mesh_sql(0)} SELECT cast(t AS int) AS face, count(*) AS n FROM swath JOIN located USING (lat, lon) GROUP BY 1")
def mesh_faces(spark, sf_dir):
    """Number of pixels per base face, by plane tests on columns."""
    return mesh.exhaustive(adaptor.swath(spark, sf_dir)).groupBy("face").agg(F.count(F.lit(1)).alias("n"))


@query("domain_filter", f"WITH {_mesh_sql(0)} SELECT triangle_id, count(*) AS n FROM swath JOIN located USING (lat, lon) WHERE t % 3 = 0 GROUP BY 1")
def domain_filter(spark, sf_dir):
    """Pixels inside the active triangles (every third base face)."""
    active = mesh.Mesh.build(0).frames(spark)[1].where(F.shiftright("triangle_id", mesh.BASE_SHIFT) % 3 == 0)
    rows = mesh.within(mesh.locate(adaptor.swath(spark, sf_dir).select("lat", "lon"), 0), active)
    return rows.groupBy("triangle_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "spatial_bias",
    f"""WITH {_mesh_sql(0)}, m AS (SELECT a, b, c, w0 / (w0 + w1 + w2) AS wa, w1 / (w0 + w1 + w2) AS wb, w2 / (w0 + w1 + w2) AS wc FROM swath JOIN located USING (lat, lon) WHERE source = 'A')
SELECT cast(col AS bigint) AS col, count(*) AS n, round(sum(value), 4) + 0 AS value FROM (SELECT a AS col, wa AS value FROM m UNION ALL SELECT b, wb FROM m UNION ALL SELECT c, wc FROM m) GROUP BY 1""",
)
def spatial_bias(spark, sf_dir):
    """Column sums of a local field that acts on one source's pixels only."""
    rows = adaptor.swath(spark, sf_dir).select(F.monotonically_increasing_id().alias("row"), "lat", "lon", (F.col("source") == "A").alias("is_a"))
    return elements.spatial_bias(0, "is_a").design(rows).groupBy("col").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("value"), 4) + F.lit(0.0)).alias("value"))


def _spde_sql(level: int, log_sigma: float, log_rho: float) -> str:
    m = mesh.Mesh.build(level)
    kappa, tau = spde.scales(log_sigma, log_rho)
    points = ", ".join(f"({i}, {', '.join(repr(float(v)) for v in p)})" for i, p in enumerate(m.points))
    triangles = ", ".join(f"({', '.join(str(int(v)) for v in t)})" for t in m.triangles)
    edge = {"a": ("c", "b"), "b": ("a", "c"), "c": ("b", "a")}  # opposite to each corner
    edges = ", ".join(f"p{u}.{x} - p{v}.{x} AS e{c}{x}" for c, (u, v) in edge.items() for x in "xyz")
    dot = lambda i, j: f"(e{i}x * e{j}x + e{i}y * e{j}y + e{i}z * e{j}z)"
    entries = " UNION ALL ".join(f"SELECT {i} AS r, {j} AS k, {dot(i, j)} / (4 * area) AS v FROM t" for i in "abc" for j in "abc")
    return f"""WITH p AS (SELECT id, x::double AS x, y::double AS y, z::double AS z FROM (VALUES {points}) AS t(id, x, y, z)), f AS (SELECT * FROM (VALUES {triangles}) AS t(a, b, c)),
e AS (SELECT a, b, c, {edges} FROM f JOIN p AS pa ON pa.id = a JOIN p AS pb ON pb.id = b JOIN p AS pc ON pc.id = c),
t AS (SELECT *, sqrt({dot('a', 'a')} * {dot('b', 'b')} - {dot('a', 'b')} * {dot('a', 'b')}) / 2 AS area FROM e),
mass AS (SELECT r, sum(area) / 3 AS m FROM (SELECT a AS r, area FROM t UNION ALL SELECT b, area FROM t UNION ALL SELECT c, area FROM t) GROUP BY 1),
k AS (SELECT r, k, sum(v) AS v FROM ({entries} UNION ALL SELECT r, r, {kappa * kappa!r} * m FROM mass) GROUP BY 1, 2)
SELECT cast(x.r AS bigint) AS "row", cast(y.k AS bigint) AS col, round(sum({tau * tau!r} * x.v * y.v / m), 6) + 0 AS value FROM k AS x JOIN k AS y ON x.k = y.r JOIN mass ON mass.r = x.k GROUP BY 1, 2"""


@query("spde_precision", _spde_sql(2, -0.2, -0.7))
def spde_precision(spark, sf_dir):
    """The prior precision of a Matern field on a level 2 mesh, assembled by joins and sums."""
    out = spde.precision_table(*mesh.Mesh.build(2).frames(spark), -0.2, -0.7)
    return out.select("row", "col", r6("value").alias("value"))


@query("spde_posterior")
def spde_posterior(spark, sf_dir):
    """A field on a level 3 mesh from all orders: prior and information as tables, solved by the sparse factor."""
    k = F.col("o_orderkey")
    obs = adaptor.table(spark, sf_dir, "orders").select(k.alias("row"), adaptor.latitude_of(k).alias("lat"), adaptor.longitude_of(F.col("o_custkey")).alias("lon"), F.lit(4.0).alias("q"), (F.pmod(k, F.lit(97)) - 48.0).alias("r"))
    design = elements.local(3).design(obs)
    m = mesh.Mesh.build(3)
    information = coo.information_matrix(design, obs.select("row", "q")).withColumnsRenamed({"i": "row", "j": "col"})
    posterior = solve.Entries.collected(coo.add(spde.precision_table(*m.frames(spark), 3.0, -0.7), information), len(m.points))
    factor = solve.SparseFactor(posterior)
    x = factor.solve(solve.dense_vector(coo.information_vector(design, obs.select("row", "q"), obs.select("row", "r")), len(m.points)))
    return spark.createDataFrame([(i, float(v), float(d)) for i, (v, d) in enumerate(zip(x, factor.deviations(), strict=True))], "col bigint, value double, std double")


@query("regional_matern")
def regional_matern(spark, sf_dir):
    """Local fields of every base triangle under a Matern prior on its own view of the mesh."""
    k = F.col("o_orderkey")
    obs = adaptor.table(spark, sf_dir, "orders").select(k.alias("row"), adaptor.latitude_of(k).alias("lat"), adaptor.longitude_of(F.col("o_custkey")).alias("lon"), F.lit(4.0).alias("q"), (F.pmod(k, F.lit(97)) - 48.0).alias("r"))
    return solve.solve_regions(elements.region_designs(obs, 3, 0), obs.select("row", "q", "r"), solve.matern_regions(3, 0, 3.0, -0.7))


@query("delayed_field")
def delayed_field(spark, sf_dir):
    """A spatial field that is a new draw in each year of the orders, solved year by year."""
    k = F.col("o_orderkey")
    obs = adaptor.table(spark, sf_dir, "orders").select(k.alias("row"), F.year("o_orderdate").cast("bigint").alias("time"), adaptor.latitude_of(k).alias("lat"), adaptor.longitude_of(F.col("o_custkey")).alias("lon"), F.lit(4.0).alias("q"), (F.pmod(k, F.lit(97)) - 48.0).alias("r"))
    sums = delayed.updates(elements.local(2).design(obs), obs.select("row", "time", "q", "r"))
    return delayed.solve_each(sums, spde.precision(spde.whole(mesh.Mesh.build(2)), 3.0, -0.7), samples=2).drop("samples")


@query(
    "delayed_updates",
    f"""WITH {_mesh_sql(0).replace(SWATH, f"swath AS (SELECT o_orderkey, year(o_orderdate) AS time, cast((o_orderkey * 7919) % 18000 AS double) / 100 - 90 AS lat, cast((o_custkey * 104729) % 36000 AS double) / 100 - 180 AS lon, cast(o_orderkey % 97 - 48 AS double) AS r FROM orders)")},
e AS (SELECT time, r, unnest([a, b, c]) AS col, unnest([w0, w1, w2]) / (w0 + w1 + w2) AS v FROM swath JOIN located USING (lat, lon))
SELECT cast(time AS bigint) AS time, cast(col AS bigint) AS i, round(sum(4 * v * r), 4) + 0 AS value FROM e GROUP BY 1, 2""",
)
def delayed_updates(spark, sf_dir):
    """Each year's sums J'Wy, kept for later solves."""
    k = F.col("o_orderkey")
    obs = adaptor.table(spark, sf_dir, "orders").select(k.alias("row"), F.year("o_orderdate").cast("bigint").alias("time"), adaptor.latitude_of(k).alias("lat"), adaptor.longitude_of(F.col("o_custkey")).alias("lon"), F.lit(4.0).alias("q"), (F.pmod(k, F.lit(97)) - 48.0).alias("r"))
    sums = delayed.updates(elements.local(0).design(obs), obs.select("row", "time", "q", "r"))
    return sums.where("i >= 0 AND j = -1").select("time", "i", (F.round("value", 4) + F.lit(0.0)).alias("value"))


__all__ = ["QUERIES", "SQL", "Grid"]
