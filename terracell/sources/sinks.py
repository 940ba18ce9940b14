"""Writers of fields and stations with packing and metadata, state storage, and verification of outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terracell.functions import physics, timebase

# Packed variables of the daily field.
FIELD_PACKING = {"tas": physics.TEMPERATURE, "tasuncertainty": physics.UNCERTAINTY, "tasobservationinfluence": physics.FRACTION}


def output_name(variable: str, collection: str, framework: str, realisation: int, day: str) -> str:
    return f"{variable}_{collection}_{framework}_{realisation}_{day}"


def packed(df: DataFrame, packing: dict[str, physics.Packing]) -> DataFrame:
    """df with variables as integers; scale, offset and fill are column metadata."""
    out = df.withColumns({c: p.pack(F.col(c)) for c, p in packing.items()})
    for c, p in packing.items():
        out = out.withMetadata(c, {"scale_factor": p.scale, "add_offset": p.offset, "fill": p.fill})
    return out


def unpacked(df: DataFrame) -> DataFrame:
    """df with packed variables as numbers, by their metadata."""
    out = {}
    for f in df.schema.fields:
        if "scale_factor" in (f.metadata or {}):
            m = f.metadata
            out[f.name] = physics.Packing(m["scale_factor"], m["add_offset"], m["fill"]).unpack(F.col(f.name))
    return df.withColumns(out)


def write_field(df: DataFrame, path: str, packing: dict[str, physics.Packing] | None = None) -> None:
    """Daily fields as Parquet by year; the rows of a year are spread by day, so no task writes a whole year."""
    rows = packed(df, FIELD_PACKING if packing is None else packing)
    rows = rows.withColumn("year", F.year(timebase.date_of(F.col("day"))))
    rows.repartition("year", "day").sortWithinPartitions("lat_idx", "lon_idx").write.partitionBy("year").mode("overwrite").parquet(path)


def write_aggregate(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_stations(df: DataFrame, path: str) -> None:
    """Station series, laid out by station so that one is read without the others."""
    df.repartition("station").sortWithinPartitions("station", "day").write.mode("overwrite").parquet(path)


def station_status(breaks: DataFrame) -> DataFrame:
    """Per station its breaks in order: (station, status_index, break_day, likelihood, from_day, to_day).

    The bounds are the days of one homogeneous period: after the break before (NULL for the first) up to the break.
    """
    w = Window.partitionBy("station").orderBy("break_day", "likelihood")
    index, before = (F.row_number().over(w) - 1).cast("int"), F.lag("break_day").over(w)
    return breaks.select("station", index.alias("status_index"), "break_day", "likelihood", (before + 1).cast("int").alias("from_day"), F.col("break_day").alias("to_day"))


def write_station_files(series: DataFrame, breaks: DataFrame, path: str) -> None:
    """Both files of station data: the temperature series and the status of each station."""
    write_stations(series, f"{path}/temperature")
    write_stations(station_status(breaks).withColumn("day", F.col("break_day")), f"{path}/status")


def write_locations(locations: DataFrame, path: str) -> None:
    """A location lookup as Parquet, in the order of ids."""
    locations.repartitionByRange("location_id").sortWithinPartitions("location_id").write.mode("overwrite").parquet(path)


def write_correlation_ranges(ranges: DataFrame, path: str) -> None:
    """Correlation ranges as JSON lines; they are a few per source."""
    ranges.coalesce(1).write.mode("overwrite").json(path)


def station_matrix(df: DataFrame, value: str, stations: list[int]) -> DataFrame:
    """One row per day and one column per station."""
    return df.groupBy("day").pivot("station", stations).agg(F.first(value))


class StateStore:
    """Component states as Parquet by (component, kind, time_index)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, component: str, kind: str, time_index: int, state: DataFrame) -> None:
        rows = state.select(F.lit(component).alias("component"), F.lit(kind).alias("kind"), F.lit(time_index).alias("time_index"), "*")
        rows.write.partitionBy("component", "kind", "time_index").mode("append").parquet(self.path)

    def read(self, component: str, kind: str, time_index: int) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        return rows.where((F.col("component") == component) & (F.col("kind") == kind) & (F.col("time_index") == time_index)).drop("component", "kind", "time_index")


def verify(df: DataFrame, wanted: dict[str, str], metadata: dict[str, dict] | None = None) -> DataFrame:
    """Outcome of each check of a table's schema: (description, outcome)."""
    have = {f.name: f for f in df.schema.fields}
    rows = [(f"variable {n} exists", n in have) for n in wanted]
    rows += [(f"variable {n} is {t}", n in have and have[n].dataType.simpleString() == t) for n, t in wanted.items()]
    for n, m in (metadata or {}).items():
        rows += [(f"variable {n} has {k} = {v}", n in have and (have[n].metadata or {}).get(k) == v) for k, v in m.items()]
    rows += [(f"variable {n} is expected", n in wanted) for n in have]
    return df.sparkSession.createDataFrame(rows, "description string, outcome boolean")
