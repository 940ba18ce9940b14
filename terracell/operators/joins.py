"""Joins of observations, locations, breaks, files and covariate grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracell.functions import timebase
from terracell.functions.grid import Axis


def with_location(obs: DataFrame, location: DataFrame) -> DataFrame:
    """Observations with coordinates, many to one. The planner broadcasts a small lookup by its size."""
    return obs.join(location.select("location_id", "latitude", "longitude"), "location_id")


def mean_of_extremes(low: DataFrame, high: DataFrame, keys: list[str], value: str = "measurement", unc: str = "unc", corr: str | None = None) -> DataFrame:
    """Daily means from minima and maxima at the same keys.

    The uncertainty of the mean is sqrt((a*a + b*b) / 2), for each correlated
    component too. A missing extreme makes the mean missing.
    """
    names = [value, unc] + ([corr] if corr else [])
    a = low.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in names])
    b = high.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in names])
    half = lambda x, y: F.sqrt((x * x + y * y) / 2)
    out = a.join(b, keys)
    known = F.col(f"_a_{value}").isNotNull() & F.col(f"_b_{value}").isNotNull()
    columns = [
        ((F.col(f"_a_{value}") + F.col(f"_b_{value}")) / 2).alias(value),
        F.when(known, half(F.col(f"_a_{unc}"), F.col(f"_b_{unc}"))).alias(unc),
    ]
    if corr:
        columns.append(F.when(known, F.zip_with(f"_a_{corr}", f"_b_{corr}", half)).alias(corr))
    return out.select(*keys, *columns)


def append_sources(first: DataFrame, second: DataFrame, offset: int, column: str = "location_id") -> DataFrame:
    """Union with the second source's location ids shifted past the first's."""
    return first.unionByName(second.withColumn(column, F.col(column) + F.lit(offset).cast("bigint")))


def without(df: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not held out."""
    return df.join(held.select(key).distinct(), key, "left_anti")


def only(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is wanted."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def next_break(obs: DataFrame, breaks: DataFrame, station: str = "station", day: str = "day", break_day: str = "break_day", inclusive: bool = False, period: int = 366) -> DataFrame:
    """Each observation with its station's first break after its day (NULL if none).

    No range join: within a station's ``period`` days, breaks and observations are
    laid in one sequence from late to early, and every observation takes the last
    break seen. What later periods hold comes as one more mark, the first break of
    the next period that has any, found on one row a station and period. So a task
    sorts a station's period, not its whole series.
    """
    kind = breaks.schema[break_day].dataType
    of = lambda c: F.floor(c / period).cast("bigint")
    marks = breaks.where(F.col(break_day).isNotNull()).select(F.col(station), F.col(break_day).cast("double").alias("_day"), F.col(break_day).alias("_break"), of(F.col(break_day)).alias("_period"))
    first = marks.groupBy(station, "_period").agg(F.min("_break").alias("_break"))
    asked = obs.where(F.col(day).isNotNull()).select(station, of(F.col(day)).alias("_period")).distinct().withColumn("_break", F.lit(None).cast(kind))
    periods = first.unionByName(asked).groupBy(station, "_period").agg(F.max("_break").alias("_break"))
    later = F.last("_break", ignorenulls=True).over(Window.partitionBy(station).orderBy(F.col("_period").desc()).rowsBetween(Window.unboundedPreceding, -1))
    carried = periods.select(station, "_period", later.alias("_break")).where(F.col("_break").isNotNull()).withColumn("_day", F.lit(float("inf")))
    rows = obs.withColumns({"_day": F.col(day).cast("double"), "_break": F.lit(None).cast(kind), "_period": of(F.col(day)), "_obs": F.lit(True)})
    both = rows.unionByName(marks.unionByName(carried.select(*marks.columns)), allowMissingColumns=True)
    # on equal days a break comes before the observation only if it counts for it
    tie = F.when(F.col("_obs"), F.lit(1 if inclusive else 0)).otherwise(F.lit(0 if inclusive else 1))
    w = Window.partitionBy(station, "_period").orderBy(F.col("_day").desc(), tie).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("next_break", F.last("_break", ignorenulls=True).over(w))
    return seen.where("_obs").drop("_day", "_break", "_obs", "_period")


def nearest_date(rows: DataFrame, files: DataFrame, day: str, file_day: str, within: int = 10) -> DataFrame:
    """Each row with the file nearest in time, closer than ``within`` days; the earlier wins ties.

    Dates are few against rows: candidates come from an equi-join on buckets of
    ``within`` days and their neighbours, not from comparing all pairs.
    """
    bucket = lambda c: F.floor(c / within).cast("bigint")
    days = rows.select(day).distinct()
    near = files.select(F.col(file_day), F.explode(F.array(*[bucket(F.col(file_day)) + F.lit(k) for k in (-1, 0, 1)])).alias("_b")).distinct()
    pairs = days.withColumn("_b", bucket(F.col(day))).join(near, "_b").where(F.abs(F.col(day) - F.col(file_day)) < within)
    best = pairs.groupBy(day).agg(F.min_by(file_day, F.struct(F.abs(F.col(day) - F.col(file_day)), F.col(file_day))).alias(file_day))
    return rows.join(best, day, "left")


def bilinear(obs: DataFrame, nodes: DataFrame, lat: Axis, lon: Axis, value: str, lat_column: str = "lat", lon_column: str = "lon") -> DataFrame:
    """Observations with a covariate interpolated from a regular grid of nodes (lat_idx, lon_idx, value).

    Weights are piecewise linear; longitude is periodic; beyond the first and
    last row of centres the nearest row's mean stands in. The grid is packed once
    into squares of four neighbouring nodes, so each observation meets one row in
    one equi-join and is neither copied nor grouped again. A missing node counts as
    absent; observations without any node drop out.
    """
    y = (F.col(lat_column) - (lat.start + lat.step / 2)) / lat.step
    x = (F.col(lon_column) - (lon.start + lon.step / 2)) / lon.step
    edge = nodes.where(F.col("lat_idx").isin(0, lat.count - 1)).groupBy("lat_idx").agg(F.avg(value).alias("_v"))
    beyond = edge.select(F.when(F.col("lat_idx") == 0, -1).otherwise(lat.count).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(lon.count - 1))).alias("j"), "_v")
    table = nodes.select(F.col("lat_idx").alias("i"), F.col("lon_idx").alias("j"), F.col(value).alias("_v")).unionByName(beyond)
    corners = [(dy, dx) for dy in (0, 1) for dx in (0, 1)]
    square = F.explode(F.array(*[F.struct((F.col("i") - dy).alias("i"), F.pmod(F.col("j") - dx, F.lit(lon.count)).cast("int").alias("j"), F.lit(k).alias("k")) for k, (dy, dx) in enumerate(corners)]))
    squares = table.select("_v", square.alias("_s")).groupBy(F.col("_s.i").alias("_i"), F.col("_s.j").alias("_j")).agg(*[F.max(F.when(F.col("_s.k") == k, F.col("_v"))).alias(f"_v{k}") for k in range(4)])
    met = obs.withColumns({"_y": y, "_x": x, "_i": F.floor(y).cast("int"), "_j": F.pmod(F.floor(x).cast("int"), F.lit(lon.count)).cast("int")}).join(squares, ["_i", "_j"])
    fy, fx = F.col("_y") - F.floor("_y"), F.col("_x") - F.floor("_x")
    terms = [F.col(f"_v{k}") * (fy if dy else 1 - fy) * (fx if dx else 1 - fx) for k, (dy, dx) in enumerate(corners)]
    total = sum((F.coalesce(t, F.lit(0.0)) for t in terms[1:]), F.coalesce(terms[0], F.lit(0.0)))
    return met.select(*obs.columns, F.when(F.coalesce(*terms).isNotNull(), total).alias(value))


def bias_group(source: Column, lat: Column) -> Column:
    """Index of a source's bias group: ice has one per hemisphere, others one."""
    return F.when(source == "ice", (lat < 0).cast("int")).otherwise(F.lit(0))


def merge_flags(first: DataFrame, second: DataFrame, keys: list[str], flag: str, from_bit: int, to_bit: int) -> DataFrame:
    """Flags of two tables combined; ``from_bit`` of the second is moved to ``to_bit`` first."""
    f = F.coalesce(F.col("_second"), F.lit(0))
    moved = F.when(f.bitwiseAND(F.lit(1 << from_bit)) != 0, f.bitwiseAND(F.lit(0xFFFF ^ (1 << from_bit))).bitwiseOR(F.lit(1 << to_bit))).otherwise(f)
    out = first.join(second.select(*keys, F.col(flag).alias("_second")), keys, "full")
    return out.select(*keys, F.coalesce(F.col(flag), F.lit(0)).bitwiseOR(moved).cast("int").alias(flag))


def steps_with_files(steps: DataFrame, files: DataFrame, policy: str = "not_allowed") -> DataFrame:
    """Steps (step, key) with the files (key, file) of their key, in order.

    The policy says what a step without files means: ``skip`` drops it, ``allowed``
    gives -1, ``not_allowed`` raises an error when the row is computed.
    """
    grouped = files.groupBy("key").agg(F.sort_array(F.collect_list("file")).alias("files"))
    if policy == "skip":
        return steps.join(grouped, "key")
    out = steps.join(grouped, "key", "left")
    if policy == "allowed":
        return out.withColumn("files", F.coalesce("files", F.array(F.lit(-1).cast(files.schema["file"].dataType))))
    if policy == "not_allowed":
        return out.withColumn("files", F.when(F.col("files").isNotNull(), F.col("files")).otherwise(F.raise_error(F.lit("no file for a step")).cast("array<bigint>")))
    raise ValueError(f"unknown policy {policy!r}")


def bias_by_year(breaks: DataFrame, first: int, last: int, station: str = "station", break_day: str = "break_day") -> DataFrame:
    """(station, year, next_break): the break period active on 1 January of each year from first to last."""
    rows = breaks.select(station).distinct().withColumn("year", F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"))))
    rows = rows.withColumn("day", timebase.day_number(F.make_date(F.col("year").cast("int"), F.lit(1), F.lit(1))))
    return next_break(rows, breaks, station, "day", break_day).select(station, "year", "next_break")
