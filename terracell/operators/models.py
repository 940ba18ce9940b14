"""Surface to air temperature models for ice, land and ocean, with their uncertainty budgets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.functions.physics import KELVIN

# Fixed values of the ice model: reference day, days a year, and budget constants (K).
ICE_DAY0, ICE_YEAR = 18262, 365.2425
ICE_LARGE_SCALE = 0.2
ICE_CLOUD_OFFSET = {"tas": 0.0, "tasmin": 2.0, "tasmax": 0.0}
ICE_RANDOM = {
    ("north", "land"): {"tas": 1.6, "tasmin": 2.2, "tasmax": 2.1},
    ("north", "sea"): {"tas": 0.0, "tasmin": 2.9, "tasmax": 2.0},
    ("south", "land"): {"tas": 1.6, "tasmin": 1.5, "tasmax": 3.8},
    ("south", "sea"): {"tas": 1.7, "tasmin": 5.7, "tasmax": 2.9},
}
ICE_RELATION = {"land": {"tas": 1.5, "tasmin": 1.8, "tasmax": 2.0}, "sea": {"tas": 1.7, "tasmin": 1.8, "tasmax": 2.1}}


def ice_constants(spark: SparkSession) -> DataFrame:
    """Twelve rows: hemisphere, part, observable, ru_s, rel, cloud_offset."""
    rows = [(h, p, o, r, ICE_RELATION[p][o], ICE_CLOUD_OFFSET[o]) for (h, p), by in ICE_RANDOM.items() for o, r in by.items()]
    return spark.createDataFrame(rows, "hemisphere string, part string, observable string, ru_s double, rel double, cloud_offset double")


def ice_temperature(ts: Column, day: Column, c0: Column, c1: Column, c2: Column, c3: Column) -> Column:
    """Air temperature from skin temperature with an annual cycle."""
    theta = 2 * F.pi() * (day - ICE_DAY0) / ICE_YEAR
    return c1 * (ts - KELVIN) + c0 + c2 * F.cos(theta) + c3 * F.sin(theta) + KELVIN


def ice_model(obs: DataFrame, coefficients: DataFrame) -> DataFrame:
    """obs with ``tair`` by the coefficients of (hemisphere, part, observable), a small table."""
    out = obs.join(coefficients, ["hemisphere", "part", "observable"])
    return out.withColumn("tair", ice_temperature(F.col("ts"), F.col("day"), F.col("c0"), F.col("c1"), F.col("c2"), F.col("c3"))).drop("c0", "c2", "c3")


def ice_budget(df: DataFrame) -> DataFrame:
    """df with the uncertainty components and totals; wants c1, ru_s, rel, cloud_offset and the three input uncertainties."""
    u, us, ul, c1 = F.col("unc_uncorrelated"), F.col("unc_synoptic"), F.col("unc_large_scale"), F.col("c1")
    df = df.where(u.isNotNull() & us.isNotNull() & ul.isNotNull())
    df = df.withColumns(
        {
            "ru": F.sqrt(u * u + F.col("ru_s") * F.col("ru_s")) * c1,
            "ssu": F.sqrt((us * c1) * (us * c1) + F.col("rel") * F.col("rel")),
            "lsu": c1 * ICE_LARGE_SCALE,
            "cu": c1 * (ul - ICE_LARGE_SCALE + F.col("cloud_offset")),
        }
    )
    plain = F.col("ru") * F.col("ru") + F.col("ssu") * F.col("ssu") + F.col("lsu") * F.col("lsu")
    return df.withColumn("total", F.sqrt(plain)).withColumn("total_cloud", F.sqrt(plain + F.col("cu") * F.col("cu")))


LAND_PREDICTORS = ("lst_day", "lst_night", "fvc", "dem", "solz", "snow")
LAND_SYSTEMATIC = 0.1


def land_temperature(coefficients: tuple[float, ...], predictors: dict[str, Column]) -> Column:
    """Regression in degrees Celsius; a predictor whose coefficient is 0 may be missing."""
    out: Column = F.lit(float(coefficients[0]))
    for b, name in zip(coefficients[1:], LAND_PREDICTORS, strict=True):
        if b != 0:
            out = out + F.lit(float(b)) * predictors[name]
    return out


def land_fallback(candidates: list[tuple[int, Column]]) -> tuple[Column, Column]:
    """(value, model number): the first model in order that has a value."""
    number = F.lit(None).cast("int")
    for n, c in reversed(candidates):
        number = F.when(c.isNotNull(), F.lit(n)).otherwise(number)
    return F.coalesce(*[c for _, c in candidates]), number


def land_budget(coefficients: tuple[float, ...], uncertainties: dict[str, Column], calibration: float) -> dict[str, Column]:
    """Random, atmospheric, surface and systematic components of a land model."""
    squares = {name: F.lit(float(b * b)) * uncertainties[name] * uncertainties[name] for b, name in zip(coefficients[1:], LAND_PREDICTORS, strict=True) if b != 0 and name in uncertainties}
    total = lambda names: sum((squares[n] for n in names if n in squares), F.lit(0.0))
    return {
        "unc_random": F.sqrt(total(LAND_PREDICTORS)),
        "unc_atm": F.sqrt(total(("lst_day", "lst_night", "dem", "solz")) + calibration * calibration),
        "unc_sfc": F.sqrt(total(LAND_PREDICTORS)),
        "unc_sys": F.lit(LAND_SYSTEMATIC),
    }


OCEAN_DAYS = 365
OCEAN_MEAN_MOST, OCEAN_SD_MOST, OCEAN_SD_LEAST = 10.0, 10.0, 0.3


def ocean_basis(day: Column) -> list[Column]:
    """Constant and two harmonics of the day of the year, each over the sum of its squares in a year."""
    angle = 2 * F.pi() * day / OCEAN_DAYS
    raw = [F.lit(1.0), F.sin(angle), F.cos(angle), F.sin(2 * angle), F.cos(2 * angle)]
    power = [float(OCEAN_DAYS), *[sum(f(2 * math.pi * k * d / OCEAN_DAYS) ** 2 for d in range(1, OCEAN_DAYS + 1)) for k in (1, 2) for f in (math.sin, math.cos)]]
    return [r / F.lit(p) for r, p in zip(raw, power, strict=True)]


def ocean_offset(df: DataFrame, parameters: DataFrame, day: str = "doy") -> DataFrame:
    """df with the sea-air offset of its cell and day.

    ``parameters``: param 0..4, lat_idx, lon_idx, mean, stdev; only those within
    limits count, and a deviation below the floor is raised to it.
    """
    kept = parameters.where((F.abs("mean") < OCEAN_MEAN_MOST) & (F.abs("stdev") <= OCEAN_SD_MOST))
    wide = kept.groupBy("lat_idx", "lon_idx").agg(*[F.max(F.when(F.col("param") == k, F.col("mean"))).alias(f"_m{k}") for k in range(5)], *[F.max(F.when(F.col("param") == k, F.greatest("stdev", F.lit(OCEAN_SD_LEAST)))).alias(f"_s{k}") for k in range(5)])
    out = df.join(wide, ["lat_idx", "lon_idx"])
    basis = ocean_basis(F.col(day))
    offset = sum((basis[k] * F.col(f"_m{k}") for k in range(1, 5)), basis[0] * F.col("_m0"))
    spread = sum((basis[k] * basis[k] * F.col(f"_s{k}") * F.col(f"_s{k}") for k in range(1, 5)), basis[0] * basis[0] * F.col("_s0") * F.col("_s0"))
    return out.withColumn("offset", offset).withColumn("offset_unc", F.sqrt(spread)).drop(*[f"_{c}{k}" for c in "ms" for k in range(5)])


def remap(df: DataFrame, columns: dict[str, tuple]) -> DataFrame:
    """Select by a specification: ("copy", column, offset), ("day", column) or ("total", [columns])."""
    from terracell.functions.timebase import day_number

    def build(spec: tuple) -> Column:
        kind, arg, *rest = spec
        if kind == "copy":
            return F.col(arg) + rest[0] if rest else F.col(arg)
        if kind == "day":
            return day_number(F.col(arg))
        if kind == "total":
            return F.sqrt(sum((F.col(c) * F.col(c) for c in arg[1:]), F.col(arg[0]) * F.col(arg[0])))
        raise ValueError(f"unknown column rule {kind!r}")

    return df.select(*[build(spec).alias(name) for name, spec in columns.items()])
