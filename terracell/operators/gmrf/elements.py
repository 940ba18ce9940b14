"""Model elements: each turns observations (row, lat, lon, t, ...) into design entries (row, col, value)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracell.functions import geometry, timebase
from terracell.functions.grid import Axis
from terracell.functions.physics import hat, wendland4
from terracell.operators import joins, temporal
from terracell.operators.gmrf import coo, mesh


@dataclass(frozen=True)
class Element:
    """A named part of a model: its number of columns and how rows become entries."""

    name: str
    columns: int
    design: Callable[[DataFrame], DataFrame]


def _columns(df: DataFrame, values: list[Column]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(k).cast("bigint").alias("col"), v.cast("double").alias("value")) for k, v in enumerate(values)])
    return df.select("row", F.explode(entries).alias("e")).select("row", "e.col", "e.value")


def grand_mean() -> Element:
    return Element("grand_mean", 1, lambda df: df.select("row", F.lit(0).cast("bigint").alias("col"), F.lit(1.0).alias("value")))


def latitude_harmonics() -> Element:
    return Element("latitude_harmonics", 4, lambda df: _columns(df, [c for _, c in geometry.latitude_harmonics(F.col("lat"))]))


def seasonal_harmonics(harmonics: int) -> Element:
    return Element("seasonal_harmonics", 2 * harmonics, lambda df: _columns(df, [c for _, c in timebase.season_angles(F.col("t"), harmonics)]))


def covariate(column: str, scale: float = 1.0) -> Element:
    return Element(column, 1, lambda df: df.where(F.col(column).isNotNull()).select("row", F.lit(0).cast("bigint").alias("col"), (F.col(column) * scale).alias("value")))


def geography(nodes: DataFrame, lat: Axis, lon: Axis, scale: float = 1.0) -> Element:
    """A map's value at the observation, interpolated from its nodes (``readers.covariate_map``) and rescaled."""

    def design(df: DataFrame) -> DataFrame:
        met = joins.bilinear(df.select("row", "lat", "lon"), nodes, lat, lon, "value")
        return met.select("row", F.lit(0).cast("bigint").alias("col"), (F.col("value") * scale).alias("value"))

    return Element("geography", 1, design)


def insitu_land_bias(breaks: DataFrame, least: int | None = None) -> tuple[Element, DataFrame]:
    """(element, its columns): one bias for each break of a station, active from the break before up to it.

    Breaks below the likelihood ``least`` are left out. An observation after its
    station's last break has no entry. The columns are (bias_index, station, break_day).
    """
    kept = breaks.where(F.col("likelihood") >= least) if least is not None else breaks
    kept = kept.select("station", "break_day").distinct()
    first = temporal.offsets(kept.groupBy("station").agg(F.count(F.lit(1)).alias("n")), "station")  # a row a station
    rank = F.row_number().over(Window.partitionBy("station").orderBy("break_day")) - 1
    columns = kept.join(first.select("station", "offset"), "station").select((F.col("offset") + rank).alias("bias_index"), "station", "break_day")

    def design(df: DataFrame) -> DataFrame:
        active = joins.next_break(df.select("row", "station", "day"), kept, inclusive=True).where(F.col("next_break").isNotNull())
        met = active.join(columns.withColumnRenamed("break_day", "next_break"), ["station", "next_break"])
        return met.select("row", F.col("bias_index").alias("col"), F.lit(1.0).alias("value"))

    return Element("insitu_land_bias", kept.count(), design), columns


def bias(group: str, groups: int) -> Element:
    """Indicator of the observation's bias group (NULL: none)."""
    return Element("bias", groups, lambda df: df.where(F.col(group).isNotNull()).select("row", F.col(group).cast("bigint").alias("col"), F.lit(1.0).alias("value")))


def local(level: int) -> Element:
    """Barycentric weights of the three vertices around an observation."""
    def design(df: DataFrame) -> DataFrame:
        at = mesh.locate(df.select("row", "lat", "lon"), level)
        return at.select("row", F.explode(F.arrays_zip("vertices", "weights")).alias("e")).select("row", F.col("e.vertices").alias("col"), F.col("e.weights").alias("value"))

    return Element("local", 10 * 4**level + 2, design)


def spatial_bias(level: int, group: str) -> Element:
    """A local field that acts on one group of observations only."""
    inner = local(level)
    return Element("spatial_bias", inner.columns, lambda df: inner.design(df.where(F.col(group))))


def latitude_spline(nodes: int = 361, first: float = -180.0, step: float = 1.0, span: float = 5.0) -> Element:
    """Wendland functions on a line of latitude nodes padded beyond the poles; only nodes within the span appear."""
    def design(df: DataFrame) -> DataFrame:
        low = F.greatest(F.lit(0), F.ceil((F.col("lat") - span - first) / step))
        high = F.least(F.lit(nodes - 1), F.floor((F.col("lat") + span - first) / step))
        near = df.select("row", "lat", F.explode(F.sequence(low, high)).alias("col"))
        r = F.abs(F.col("lat") - (first + step * F.col("col"))) / span
        return near.select("row", F.col("col").cast("bigint").alias("col"), wendland4(r).alias("value")).where("value > 0")

    return Element("latitude_spline", nodes, design)


def time_nodes(first: float, step: float, nodes: int, wrapped: bool = False, column: str = "time") -> Element:
    """Piecewise linear functions of time; wrapped: the last node is followed by the first."""
    def design(df: DataFrame) -> DataFrame:
        x = (F.col(column) - first) / step
        k = F.floor(x)
        two = F.array(F.struct(k.alias("k"), hat(x - k, 1.0).alias("v")), F.struct((k + 1).alias("k"), hat(x - k - 1, 1.0).alias("v")))
        out = df.select("row", F.explode(two).alias("e")).select("row", F.col("e.k").alias("col"), F.col("e.v").alias("value")).where("value > 0")
        return out.withColumn("col", F.pmod("col", F.lit(nodes)).cast("bigint")) if wrapped else out.where(F.col("col").between(0, nodes - 1))

    return Element("time_nodes", nodes, design)


def space_time(time: Element, space: Element) -> Element:
    """Kronecker product: column = time column * space columns + space column."""
    return Element(f"{time.name}*{space.name}", time.columns * space.columns, lambda df: coo.kronecker(time.design(df), space.design(df), space.columns))


def combination(parts: list[Element]) -> Element:
    return Element("+".join(p.name for p in parts), sum(p.columns for p in parts), lambda df: coo.beside([(p.design(df), p.columns) for p in parts]))


#: element names that a description may use
LOADERS: dict[str, Callable[..., Element]] = {"grand_mean": grand_mean, "latitude_harmonics": latitude_harmonics, "seasonal_harmonics": seasonal_harmonics, "covariate": covariate}


def load(descriptions: list[dict]) -> Element:
    """Combination of elements named in a description (a list of {"element": name, **parameters})."""
    made = []
    for d in descriptions:
        d = dict(d)
        name = d.pop("element")
        if name not in LOADERS:
            raise ValueError(f"unknown element {name!r}")
        made.append(LOADERS[name](**d))
    return combination(made)


def factor(space: Element, time: Element, space_state: DataFrame, time_state: DataFrame) -> tuple[Element, Element]:
    """The two linear parts of a product of a space and a time field at the current states.

    The product's Jacobian in the space field is its design scaled by the time
    field's value at the observation, and the other way round.
    """

    def scaled(part: Element, other: Element, state: DataFrame) -> Element:
        def design(df: DataFrame) -> DataFrame:
            level = coo.expected(other.design(df), state).select("row", F.col("value").alias("_level"))
            return part.design(df).join(level, "row").select("row", "col", (F.col("value") * F.col("_level")).alias("value"))

        return Element(f"{part.name}|{other.name}", part.columns, design)

    return scaled(space, time, time_state), scaled(time, space, space_state)


def region_designs(df: DataFrame, level: int, region_level: int) -> DataFrame:
    """Local designs of all regions at once: (region, row, col, value), a region being a coarse triangle.

    Regions are solved apart, so ``region`` is the key of what follows.
    """
    at = mesh.locate(df.select("row", "lat", "lon"), level).withColumn("region", mesh.parent(F.col("triangle_id"), region_level))
    return at.select("region", "row", F.explode(F.arrays_zip("vertices", "weights")).alias("e")).select("region", "row", F.col("e.vertices").alias("col"), F.col("e.weights").alias("value"))


def station_bias(state: DataFrame, first: int, stations: DataFrame) -> DataFrame:
    """(station, bias): the slice of a state that belongs to the stations' bias columns."""
    return state.where(F.col("col") >= first).select((F.col("col") - first).alias("bias_index"), F.col("value").alias("bias")).join(stations, "bias_index")
