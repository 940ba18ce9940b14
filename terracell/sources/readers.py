"""Readers of observation sources. All are lazy; filters and columns reach the scan."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terracell.functions import physics, timebase
from terracell.functions.grid import Axis, Grid, wrap_longitude
from terracell.operators import joins
from terracell.sources import schema

# Uncertainties (K) that sources state once for all.
LAND_UNCERTAINTY, SHIP_UNCERTAINTY, LAKE_UNCERTAINTY, OCEAN_CORRELATION_KM = 0.3, 1.1, 5.0, 100.0


def granules(spark: SparkSession, when: str) -> DataFrame:
    """Expected granule times: one for YYYYmmddHHMM, every five minutes of the day for YYYYmmdd."""
    if len(when) == 12:
        return spark.sql(f"SELECT to_timestamp('{when}', 'yyyyMMddHHmm') AS granule")
    if len(when) == 8:
        day = f"to_timestamp('{when}', 'yyyyMMdd')"
        return spark.sql(f"SELECT explode(sequence({day}, {day} + INTERVAL '23:55' HOUR TO MINUTE, INTERVAL 5 MINUTES)) AS granule")
    raise ValueError(f"{when!r} is neither a day nor a minute")


def granule_status(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Each expected granule with ``ok`` or ``missing``; processing goes on without the missing ones."""
    have = present.select("granule").distinct().withColumn("_p", F.lit(True))
    return expected.join(have, "granule", "left").select("granule", F.when(F.col("_p"), "ok").otherwise("missing").alias("status"))


def satellite_pairs(primary: DataFrame, auxiliary: DataFrame, fields: list[str], scalars: DataFrame | None = None) -> DataFrame:
    """Pixels with their auxiliary uncertainties: pixels that lack any auxiliary field drop out.

    ``scalars`` has one value per granule; a granule without one gets 0 unless it
    has valid pixels, which raises an error when computed.
    """
    keys = ["granule", "row", "col"]
    out = primary.join(auxiliary.select(*keys, *fields), keys)
    out = out.dropna(subset=fields)
    if scalars is not None:
        names = [c for c in scalars.columns if c != "granule"]
        out = out.join(scalars, "granule", "left")
        out = out.withColumns({c: F.coalesce(F.col(c), F.raise_error(F.lit("a granule with valid pixels has no scalar uncertainty")).cast("double")) for c in names})
    return out


def land_stations(series: DataFrame, observable: str, day: int | None = None, held_out: DataFrame | None = None, altitude_reference: DataFrame | None = None) -> DataFrame:
    """Station series as observations: quality code 0 only, optionally one day, without held-out stations, at reference altitude."""
    column, qc = {"Tmin": ("tasmin", "tasmin_qc"), "Tmax": ("tasmax", "tasmax_qc")}[observable]
    rows = series.where((F.col(qc) == 0) & F.col(column).isNotNull())
    if day is not None:
        rows = rows.where(F.col("day") == day)
    if held_out is not None:
        rows = joins.without(rows, held_out, "station_code")
    value, unc = F.col(column), F.lit(LAND_UNCERTAINTY)
    if altitude_reference is not None:
        rows = rows.join(altitude_reference.select("station", "reference_elevation"), "station")
        km = lambda c: F.col(c) / 1000
        value = value + physics.altitude_adjustment(km("elevation"), km("reference_elevation"))
        unc = physics.quadrature(physics.altitude_uncertainty(km("elevation"), km("reference_elevation")), unc)
    return rows.select(F.lit("insitu_land").alias("source"), F.lit(observable).alias("observable"), "day", F.col("station").cast("bigint").alias("location_id"), value.alias("measurement"), unc.alias("unc"), wrap_longitude(F.col("longitude")).alias("longitude"), "latitude")


def break_points(breaks: DataFrame, station: int | None = None) -> DataFrame:
    """Breaks with a likelihood, of one station if given."""
    rows = breaks.where(F.col("likelihood").isNotNull())
    return rows if station is None else rows.where(F.col("station") == station)


def ships(spark: SparkSession, path: str, titles: list[str], width: int = 8) -> DataFrame:
    """Fixed-width ship reports (plain or gzip): columns of eight characters in the order of the titles row.

    Latitude and longitude are in tenths of a degree, air temperature in
    hundredths of a degree Celsius.
    """
    return ship_reports(spark.read.text(path), titles, width)


def ship_reports(lines: DataFrame, titles: list[str], width: int = 8) -> DataFrame:
    """Ship observations from lines of text (column ``value``)."""
    line = F.col("value")
    at = {t: F.trim(F.substring(line, width * k + 1, width)) for k, t in enumerate(titles)}
    rows = lines.where(~line.startswith(titles[0]) & (F.trim(line) != ""))
    day = F.make_date(at["year"].cast("int"), at["month"].cast("int"), at["day"].cast("int"))
    return rows.select(
        at["ID"].alias("ship"),
        (at["Lat"].cast("double") * 0.1).alias("latitude"),
        wrap_longitude(at["Lon"].cast("double") * 0.1).alias("longitude"),
        timebase.day_number(day).alias("day"),
        (at["Air"].cast("double") * 0.01 + physics.KELVIN).alias("measurement"),
        F.lit(SHIP_UNCERTAINTY).alias("unc"),
    )


def location_signature(lat, lon):
    """One number per place, to a millionth of a degree."""
    return (F.lit(360e6) * lat).cast("bigint") + (F.lit(1e6) * lon).cast("bigint")


BANDS = 4096


def with_distinct_locations(df: DataFrame, lat: str, lon: str) -> tuple[DataFrame, DataFrame]:
    """(rows with location_id, locations): places numbered from 0 in the order of their signatures.

    Signatures fall into ``BANDS`` equal bands; a place's number is the count of
    places in lower bands plus its rank in its own, so no task ranks all places.
    """
    rows = df.withColumn("_sig", location_signature(F.col(lat), F.col(lon)))
    ids = rows.groupBy("_sig").agg(F.first(lat).alias("latitude"), F.first(lon).alias("longitude"))
    width = 2 * (360_000_000 * 90 + 360_000_000) // BANDS
    ids = ids.withColumn("_band", F.floor(F.col("_sig") / width))
    counts = ids.groupBy("_band").agg(F.count(F.lit(1)).alias("_n"))  # at most about BANDS rows
    before = counts.select("_band", F.coalesce(F.sum("_n").over(Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_band").orderBy("_sig"))
    ids = ids.withColumn("_rank", rank).join(F.broadcast(before), "_band").withColumn("location_id", (F.col("_before") + F.col("_rank") - 1).cast("bigint")).drop("_band", "_rank", "_before")
    return rows.join(ids.select("_sig", "location_id"), "_sig").drop("_sig"), ids.drop("_sig")


LAKE = "DateTime date, lat double, lon double, fTa double"


def lakes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tab-separated lake temperatures: (observations, locations)."""
    return lake_reports(spark.read.csv(path, sep="\t", header=True, schema=LAKE))


def lake_reports(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, locations) from rows of date, place and degrees Celsius."""
    rows = rows.select(timebase.day_number(F.col("DateTime")).alias("day"), "lat", "lon", (F.col("fTa") + physics.KELVIN).alias("measurement"), F.lit(LAKE_UNCERTAINTY).alias("unc"))
    return with_distinct_locations(rows, "lat", "lon")


def gridded(field: DataFrame, grid: Grid, value: str, unc: str) -> DataFrame:
    """A field as observations: the cell is the location."""
    cell = grid.cell(F.col("lat_idx"), F.col("lon_idx"))
    return field.where(F.col(value).isNotNull()).select("day", cell.alias("location_id"), F.col(value).alias("measurement"), F.col(unc).alias("unc"))


def two_hemispheres(south: DataFrame, north: DataFrame, south_rows: int, gap_rows: int, nlon: int) -> DataFrame:
    """Two gridded sources of equal longitudes as one: the north's ids start past the south's rows and the gap."""
    return joins.append_sources(south, north, (south_rows + gap_rows) * nlon)


def ocean(df: DataFrame, celsius: str = "tas") -> DataFrame:
    return df.withColumn("measurement", F.col(celsius) + physics.KELVIN).withColumn("correlation_km", F.lit(OCEAN_CORRELATION_KM))


def missing(spark: SparkSession) -> DataFrame:
    """A source without observations."""
    return spark.createDataFrame([], schema.OBS)


def single_day(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Daily means: as observed where there is a Tmean, else from Tmin and Tmax."""
    direct = obs.where(F.col("observable") == "Tmean").select(*keys, F.col("measurement").alias("_m"), F.col("unc").alias("_u"))
    low, high = (obs.where(F.col("observable") == o) for o in ("Tmin", "Tmax"))
    made = joins.mean_of_extremes(low, high, keys)
    out = direct.join(made, keys, "full")
    return out.select(*keys, F.coalesce("_m", "measurement").alias("measurement"), F.coalesce("_u", "unc").alias("unc"))


_HEADER = 48  # bytes: format id, code id, lookup id, sixteen each


def encode_raw(rows: list[tuple[int, float, float]], ids: tuple[bytes, bytes, bytes]) -> bytes:
    """A raw observation file: three 16-byte ids, then (u8 location, f8 measurement, f8 uncertainty) records."""
    if any(len(i) != 16 for i in ids):
        raise ValueError("ids have 16 bytes")
    return b"".join([*ids, *(struct.pack("<Qdd", *r) for r in rows)])


def _record(correlated: int) -> np.dtype:
    return np.dtype([("location_id", "<u8"), ("measurement", "<f8"), ("unc", "<f8"), ("unc_corr", "<f8", (correlated,))])


def _decoded(raw: np.ndarray, correlated: int) -> dict[str, object]:
    corr = pa.FixedSizeListArray.from_arrays(pa.array(raw["unc_corr"].reshape(-1)), correlated).cast(pa.list_(pa.float64())) if correlated else pa.array([[]] * len(raw), pa.list_(pa.float64()))
    return {"location_id": pa.array(raw["location_id"].astype(np.int64)), "measurement": pa.array(raw["measurement"]), "unc": pa.array(raw["unc"]), "unc_corr": corr}


def raw_observations(spark: SparkSession, path: str, correlated: int = 0) -> DataFrame:
    """Raw binary observation files: path, location_id, measurement, unc, unc_corr. A file (a day) is decoded in one task, as arrays."""
    record = _record(correlated)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                body = memoryview(content.as_buffer())[_HEADER:]
                if len(body) % record.itemsize:
                    raise ValueError(f"{name}: not a whole number of records")
                raw = np.frombuffer(body, dtype=record)
                columns = _decoded(raw, correlated)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(raw), pa.string()), *columns.values()], names=["path", *columns])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(decode, "path string, location_id bigint, measurement double, unc double, unc_corr array<double>")


def location_pointers(obs: DataFrame, order: list[str], correlated: int = 0) -> DataFrame:
    """(location_id, day, offset): where each location's records begin in the files of its days.

    A day's file holds its observations in ``order``; a record is numbered within its
    day only. The table is laid out by location, so one is looked up without the others.
    """
    number = F.row_number().over(Window.partitionBy("day").orderBy(*order)) - 1
    rows = obs.select("location_id", "day", (F.lit(_HEADER) + F.lit(_record(correlated).itemsize) * number).cast("bigint").alias("offset"))
    return rows.repartition("location_id").sortWithinPartitions("location_id", "day", "offset")


def read_at(files: DataFrame, pointers: DataFrame, correlated: int = 0) -> DataFrame:
    """(location_id, day, measurement, unc, unc_corr) of the pointed records; files: (day, content)."""
    record = _record(correlated)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for day, content, offsets in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                at = (np.array(offsets.as_py()) - _HEADER) // record.itemsize
                raw = np.frombuffer(memoryview(content.as_buffer())[_HEADER:], dtype=record)[at]
                columns = _decoded(raw, correlated)
                yield pa.RecordBatch.from_arrays([pa.array([day.as_py()] * len(raw), pa.int32()), *columns.values()], names=["day", *columns])

    wanted = pointers.groupBy("day").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    met = files.select(F.col("day").cast("int").alias("day"), "content").join(wanted.withColumn("day", F.col("day").cast("int")), "day").select("day", "content", "offsets")
    out = met.mapInArrow(pick, "day int, location_id bigint, measurement double, unc double, unc_corr array<double>")
    return out.select("location_id", "day", "measurement", "unc", "unc_corr")


def encode_locations(rows: list[tuple[float, float]], ids: tuple[bytes, bytes]) -> bytes:
    """A raw location lookup: two 16-byte ids, then (f8 latitude, f8 longitude) in the order of location ids."""
    if any(len(i) != 16 for i in ids):
        raise ValueError("ids have 16 bytes")
    return b"".join([*ids, *(struct.pack("<dd", *r) for r in rows)])


def raw_locations(spark: SparkSession, path: str) -> DataFrame:
    """(lookup_id, location_id, latitude, longitude) of raw location lookups."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = memoryview(content.as_buffer())
                raw = np.frombuffer(data[32:], dtype="<f8").reshape(-1, 2)
                name = pa.array([bytes(data[16:32]).hex()] * len(raw), pa.string())
                yield pa.RecordBatch.from_arrays([name, pa.array(np.arange(len(raw))), pa.array(raw[:, 0].copy()), pa.array(raw[:, 1].copy())], names=["lookup_id", "location_id", "latitude", "longitude"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, schema.LOCATION)


def retrieve_day(obs: DataFrame, day: int) -> DataFrame:
    return obs.where(F.col("day") == day)


def retrieve_locations(obs: DataFrame, wanted: DataFrame) -> DataFrame:
    """All observations of some locations, each location's in the order of its days within a partition."""
    return joins.only(obs, wanted, "location_id").repartition("location_id").sortWithinPartitions("location_id", "day")


def totals(obs: DataFrame) -> DataFrame:
    return obs.groupBy("day").agg(F.count(F.lit(1)).alias("n"))


def monthly_anomalies(grid_months: DataFrame, grid: Grid, value: str = "anomaly", unc: str = "unc") -> DataFrame:
    """A monthly ensemble grid as observations in the middle of each month: (source, day, location_id, measurement, unc)."""
    first = F.make_date(F.col("year"), F.col("month"), F.lit(1))
    middle = timebase.day_number(first) + F.floor(F.dayofmonth(F.last_day(first)) / 2).cast("int")
    cell = grid.cell(F.col("lat_idx"), F.col("lon_idx"))
    rows = grid_months.where(F.col(value).isNotNull())
    return rows.select(F.lit("monthly").alias("source"), middle.alias("day"), cell.alias("location_id"), F.col(value).alias("measurement"), F.col(unc).alias("unc"))


def same_time(primary: DataFrame, auxiliary: DataFrame, time: str = "time") -> DataFrame:
    """Files of two kinds with equal times."""
    return primary.join(auxiliary, time)


def same_coordinate(one: DataFrame, other: DataFrame, column: str, decimals: int = 6) -> DataFrame:
    """Positions of equal coordinate values in two axes: (coordinate, i, j)."""
    key = lambda df, name: df.select(F.round(column, decimals).alias(column), F.col("idx").alias(name))
    return key(one, "i").join(key(other, "j"), column)


def ice_fields(rows: DataFrame, time: str = "time") -> DataFrame:
    """A day's ice temperature fields as the input of the ice quality masks (``filters.ice_masks``): renamed, with the day number.

    The three-hour temperatures and counts are arrays of eight; others have one value a cell.
    """
    names = {"surface_temperature": "t_mean", "surface_temperature_min": "t_min", "surface_temperature_max": "t_max", "surface_temperature_std": "std", "surface_temperature_3d": "bin_t", "nobs_3d": "bin_n"}
    same = ["lat", "lon", "land_mask", "sea_ice_fraction"]
    uncertainty = {"uncorrelated_uncertainty": "unc_ran", "synoptically_correlated_uncertainty": "unc_atm", "large_scale_correlated_uncertainty": "unc_sys"}
    return rows.select(timebase.day_number(F.to_date(time)).alias("day"), *same, *[F.col(a).alias(b) for a, b in {**names, **uncertainty}.items()])


def ice_input(spark: SparkSession, path: str) -> DataFrame:
    """Ice temperature fields of files, ready for the masks."""
    return ice_fields(spark.read.schema(schema.ICE_INPUT + ", surface_temperature_3d array<double>, nobs_3d array<int>, time timestamp").parquet(path))


def covariate_map(table: DataFrame, lat: Axis, lon: Axis, latitude: str, longitude: str, covariate: str) -> DataFrame:
    """Nodes (lat_idx, lon_idx, value) of a map given as places and values; several values of a cell are averaged."""
    rows = table.where(F.col(covariate).isNotNull()).select(lat.index(F.col(latitude)).alias("lat_idx"), lon.index(wrap_longitude(F.col(longitude))).alias("lon_idx"), F.col(covariate).cast("double").alias("value"))
    return rows.groupBy("lat_idx", "lon_idx").agg(F.avg("value").alias("value"))


def read_correlation_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Correlation ranges as ``sinks.write_correlation_ranges`` wrote them."""
    return spark.read.schema(schema.CORRELATION_RANGE).json(path)


def correlation_ranges(spark: SparkSession, ranges: dict[tuple[str, str], list[float]]) -> DataFrame:
    """Length scales of each source and observable's correlated errors, in their order."""
    rows = [(s, o, k, float(x)) for (s, o), scales in ranges.items() for k, x in enumerate(scales)]
    return spark.createDataFrame(rows, schema.CORRELATION_RANGE)
