"""Row filters and masks on bit fields, coordinates, breaks and input quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAD_COORDINATE = -32768.0


def bits_match(qc: Column, mask: int, wanted: int) -> Column:
    """Whether the masked bits equal the wanted ones."""
    return qc.bitwiseAND(F.lit(mask)) == wanted


def coordinates_valid(lat: Column, lon: Column) -> Column:
    return (lat != BAD_COORDINATE) & (lon != BAD_COORDINATE)


def on_day(df: DataFrame, day: int, column: str = "day") -> DataFrame:
    """Rows of one day; partition pruning applies when the table is laid out by day."""
    return df.where(F.floor(column) == day)


def hard_cutoff(likelihood: Column, least: int) -> Column:
    return likelihood >= least


def laplace_cutoff(likelihood: Column, decay: float, least: float, top: int = 127) -> Column:
    """Whether the Laplace kernel of the distance from the top likelihood reaches ``least``."""
    return F.exp(-F.lit(decay) * F.abs(likelihood - top)) >= least


def null_where(df: DataFrame, condition: Column, columns: list[str]) -> DataFrame:
    """df with the columns emptied where the condition holds (unknown: not)."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(~hit, F.col(c)) for c in columns})


def minimum_above_maximum(df: DataFrame, low: str = "tasmin", high: str = "tasmax", also: tuple[str, ...] = ()) -> DataFrame:
    """df with both extremes (and ``also``) emptied where minimum exceeds maximum, and ``swapped``."""
    bad = F.coalesce(F.col(low) > F.col(high), F.lit(False))
    return null_where(df.withColumn("swapped", bad), F.col("swapped"), [low, high, *also])


def land_threshold(df: DataFrame, value: str, sampling: str, clear: str, ice: str, most: float = 10.0, least_clear: float = 0.1) -> DataFrame:
    """Empties land temperatures with high sampling uncertainty, little clear sky or ice cover."""
    bad = (F.col(sampling) > most) | (F.col(clear) < least_clear) | F.col(ice)
    return null_where(df, bad, [value])


def any_rule(qc: Column, rules: list[tuple[int, int | None]]) -> Column:
    """Whether any rule holds: all bits of ``must`` and of ``override`` (if any) where the pair asks for both.

    A rule is (must, override) as bit numbers. It masks if ``must`` is set and
    ``override`` is not: qc restricted to both bits equals the must bit.
    """

    def one(rule: tuple[int, int | None]) -> Column:
        must, override = rule
        mask = (1 << must) | ((1 << override) if override is not None else 0)
        return qc.bitwiseAND(F.lit(mask)) == (1 << must)

    return reduce(lambda a, b: a | b, [one(r) for r in rules])


def apply_mask(df: DataFrame, mask: Column, values: list[str], ensembles: list[str] = ()) -> DataFrame:
    """df with values and every ensemble member emptied where the mask holds."""
    out = df.withColumn("masked", F.coalesce(mask, F.lit(False)))
    out = null_where(out, F.col("masked"), values)
    return out.withColumns({c: F.when(F.col("masked"), F.transform(c, lambda x: F.lit(None).cast("double"))).otherwise(F.col(c)) for c in ensembles})


# Limits of the ice input checks.
SEA_ICE_LEAST, MARGINAL_LEAST, STD_MOST, TEMPERATURE_MOST = 0.3, 0.85, 7.07, 278.15
COMBINED_BIN_MOST, DAY_BIN_MOST = 10.0, 20.0
LAND_ICE_CLASSES = (1, 4)
DAY_BINS, NIGHT_BINS = (2, 3, 4, 5), (0, 1, 6, 7)


def _mean_of(array: str, bins: tuple[int, ...]) -> Column:
    """Mean of an array column's entries at these places, unknown ones left out."""
    picked = F.filter(F.array(*[F.col(array)[i] for i in bins]), lambda x: x.isNotNull())
    return F.aggregate(picked, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(picked), F.lit(0))


def _count_of(array: str, bins: tuple[int, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(array)[i], F.lit(0)) for i in bins])


def ice_masks(df: DataFrame) -> DataFrame:
    """df with the ice quality masks; true rejects.

    Wants land_mask, sea_ice_fraction, std, t_mean, t_min, t_max, and arrays of
    eight three-hour bins: bin_t, bin_n. What is unknown rejects for the sea ice
    and count masks and keeps for the others.
    """
    reject, keep = (lambda c: F.coalesce(c, F.lit(True))), (lambda c: F.coalesce(c, F.lit(False)))
    df = df.withColumns(
        {
            "m_land_ice": ~F.col("land_mask").isin(*LAND_ICE_CLASSES),
            "m_sea_ice_conc": reject(F.col("sea_ice_fraction") < SEA_ICE_LEAST),
            "m_std": keep(F.col("std") > STD_MOST),
            "m_value": keep(F.col("t_mean") > TEMPERATURE_MOST),
            "m_day_count": reject(_count_of("bin_n", DAY_BINS) == 0),
            "m_night_count": reject(_count_of("bin_n", NIGHT_BINS) == 0),
            "m_combined": keep(F.abs(F.col("t_mean") - _mean_of("bin_t", DAY_BINS + NIGHT_BINS)) > COMBINED_BIN_MOST),
            "m_day_bin": keep(F.abs(F.col("t_max") - _mean_of("bin_t", DAY_BINS)) > DAY_BIN_MOST),
            "m_night_bin": F.lit(False),  # its condition, an absolute value below -20, never holds
        }
    )
    df = df.withColumns(
        {
            "m_sea_ice": F.col("m_sea_ice_conc") | ~F.col("m_land_ice"),
            "m_ice": F.col("m_land_ice") & F.col("m_sea_ice_conc"),
        }
    )
    any_of = lambda *names: reduce(lambda a, b: a | b, [F.col(n) for n in names])
    return df.withColumns(
        {
            "m_marginal": F.col("m_sea_ice") | keep(F.col("sea_ice_fraction") >= MARGINAL_LEAST),
            "reject_mean": any_of("m_ice", "m_std", "m_value", "m_day_count", "m_night_count", "m_combined"),
            "reject_min": any_of("m_ice", "m_std", "m_value", "m_night_count", "m_night_bin"),
            "reject_max": any_of("m_ice", "m_std", "m_value", "m_day_count", "m_day_bin"),
        }
    )


def marine(df: DataFrame, influence: str = "coastal_influence", more_than: float = 95.0, inclusive: bool = False) -> Column:
    """Sea cells by coastal influence; masking uses > 95, flagging exactly 100."""
    c = F.col(influence)
    return F.coalesce(c >= more_than if inclusive else c > more_than, F.lit(False))
