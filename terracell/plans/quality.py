"""Quality control of daily fields: all flags in the order they depend on each other, then masking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.functions import timebase
from terracell.operators import filters, flags, temporal
from terracell.operators.flags import Bit

CELL = ["lat_idx", "lon_idx"]


def threshold_flags(fields: DataFrame, nlat: int, nlon: int) -> DataFrame:
    """Climatology, large scale, influence and marine flags of each day."""
    day = ["day"]
    out = flags.uncertainty_flag(fields, day, "climatology_unc", nlat, nlon, 13, Bit.CLIMATOLOGY_UNC).withColumnRenamed("qc", "_a")
    out = flags.uncertainty_flag(out, day, "large_scale_unc", nlat, nlon, 17, Bit.LARGE_SCALE_UNC).withColumnRenamed("qc", "_b")
    out = flags.influence_flag(out, day, "influence", nlat, nlon).withColumnRenamed("qc", "_c")
    marine = flags.flag(F.col("coastal_influence") == 100, Bit.MISSING_MARINE)
    return out.withColumn("qc", flags.combine(F.col("_a"), F.col("_b"), F.col("_c"), marine)).drop("_a", "_b", "_c")


def window_flags(fields: DataFrame) -> DataFrame:
    """Temporal and calendar constraint flags on top of ``qc``."""
    constrained = F.col("qc").bitwiseAND(F.lit(1 << Bit.DAY)) == 0
    out = temporal.constraint_window(fields.withColumn("constrained", constrained), CELL)
    out = out.withColumn("qc", flags.combine(F.col("qc"), flags.flag(F.col("prior_flag"), Bit.PRIOR_WINDOW), flags.flag(F.col("post_flag"), Bit.POST_WINDOW)))
    out = out.drop("n_prior", "n_post", "prior_flag", "post_flag")
    some = F.col("qc").bitwiseAND(F.lit(flags.CALENDAR_DAY)) != flags.CALENDAR_DAY
    out = temporal.calendar_window(out.withColumns({"constrained": some, "date": timebase.date_of(F.col("day"))}), CELL)
    extra = (flags.flag(F.col("prior_flag"), Bit.PRIOR_CALENDAR), flags.flag(F.col("post_flag"), Bit.POST_CALENDAR), flags.flag(F.col("missing_flag"), Bit.MISSING))
    return out.withColumn("qc", flags.combine(F.col("qc"), *extra)).drop("n_prior", "n_post", "n_total", "prior_flag", "post_flag", "missing_flag", "constrained", "date")


def outlier_flags(fields: DataFrame, value: str, nlat: int, nlon: int, width: int) -> DataFrame:
    """Extreme, areal and persistent outlier flags on top of ``qc``."""
    day = ["day"]
    base = fields.withColumnRenamed("qc", "_before")
    out = flags.extreme_flags(base, day, value, nlat, nlon).withColumnRenamed("qc", "_e")
    out = flags.areal_flags(out, day, value, nlat, nlon, width).withColumnRenamed("qc", "_r")
    out = out.withColumn("qc", flags.combine(F.col("_before"), F.col("_e"), F.col("_r"))).drop("_before", "_e", "_r")
    out = temporal.persistence_window(out.withColumn("outlier", F.col("qc").bitwiseAND(F.lit(flags.OUTLIERS)) != 0), CELL)
    return out.withColumn("qc", flags.combine(F.col("qc"), flags.flag(F.col("persistent"), Bit.PERSISTENT_OUTLIER))).drop("outlier", "n_outliers", "persistent")


def masked_product(fields: DataFrame, values: list[str], ensembles: list[str] = ()) -> DataFrame:
    """Fields with everything emptied where the flags say so."""
    return filters.apply_mask(fields, flags.masked(F.col("qc"), F.year(timebase.date_of(F.col("day")))), values, list(ensembles))
