"""Grid aggregation with uncertainty propagation, diagnostics and information sums.

All first-order statistics of a cell come from one grouped aggregate, so a day is
one partial aggregation and one shuffle of cells, whatever the number of
observations. The variance needs no second pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name -> aggregate of a value column; plug in more with ``register``
REGISTRY: dict[str, Callable[[Column], Column]] = {
    "count": lambda x: F.count(x),
    "sum": lambda x: F.sum(x),
    "mean": lambda x: F.avg(x),
    "min": lambda x: F.min(x),
    "max": lambda x: F.max(x),
    "sumsq": lambda x: F.sum(x * x),
    "variance": lambda x: F.var_samp(x),
    "random": lambda x: F.sqrt(F.sum(x * x)) / F.count(x),
    "correlated": lambda x: F.sqrt(F.avg(x * x)),
}


def register(name: str, build: Callable[[Column], Column]) -> None:
    if name in REGISTRY:
        raise ValueError(f"aggregate {name!r} exists")
    REGISTRY[name] = build


def bin_statistics(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Named aggregates per bin: {output: (registered name, column)}."""
    return df.groupBy(*keys).agg(*[REGISTRY[kind](F.col(column)).alias(out) for out, (kind, column) in wanted.items()])


def grid_surface(
    df: DataFrame,
    keys: list[str],
    value: str = "measurement",
    valid: Column | None = None,
    random: str = "unc_ran",
    correlated: dict[str, str] | None = None,
) -> DataFrame:
    """Counts, mean, extremes, variance and uncertainties per cell.

    ``valid`` marks the observations that enter the statistics; all rows enter
    the total. Random errors shrink with the number of observations, correlated
    ones do not. Sampling uncertainty follows from what is missing:
    (total - valid) * sqrt(variance) / (total - 1).
    """
    valid = F.lit(True) if valid is None else valid
    correlated = {"unc_atm": "unc_atm", "unc_sfc": "unc_sfc", "unc_sys": "unc_sys"} if correlated is None else correlated
    x = F.when(valid, F.col(value))
    square = lambda c: F.when(valid, F.col(c) * F.col(c))
    first = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count(x).alias("n_valid"),
        F.avg(x).alias("ts_mean"),
        F.min(x).alias("ts_min"),
        F.max(x).alias("ts_max"),
        F.var_samp(x).alias("ts_variance"),
        F.sum(square(random)).alias("_random"),
        *[F.avg(square(c)).alias(f"_{name}") for name, c in correlated.items()],
    )
    n = F.col("n_valid")
    out = first.withColumns(
        {
            "unc_random": F.sqrt(F.try_divide(F.col("_random"), n * n)),
            **{f"u_{name.removeprefix('unc_')}": F.sqrt(F.col(f"_{name}")) for name in correlated},
            "unc_sampling": F.try_divide((F.col("n_total") - n) * F.sqrt("ts_variance"), F.col("n_total") - 1),
        }
    )
    return out.drop("_random", *[f"_{name}" for name in correlated])


def diagnostics(df: DataFrame, keys: list[str], value: str = "measurement", unc: str = "unc") -> DataFrame:
    """Count, extremes and the precision-weighted mean (weights 1/uncertainty) per bin."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.min(value).alias("obs_min"),
        F.max(value).alias("obs_max"),
        F.min(unc).alias("unc_min"),
        F.max(unc).alias("unc_max"),
        F.sum(F.col(value) / F.col(unc)).alias("weighted_sum"),
        F.sum(1 / F.col(unc)).alias("precision_sum"),
    ).withColumn("weighted_mean", F.col("weighted_sum") / F.col("precision_sum"))


def side_by_side(df: DataFrame, keys: list[str], group: str, names: list[str], values: dict[str, Column]) -> DataFrame:
    """One row per bin with the aggregates of each named group in its own columns."""
    return df.groupBy(*keys).agg(*[build_when(F.col(group) == n, v).alias(f"{n}_{k}") for n in names for k, v in values.items()])


def build_when(condition: Column, value: Column) -> Column:
    return F.avg(F.when(condition, value))


def observation_summary(df: DataFrame, calendar: DataFrame, day: str = "day") -> DataFrame:
    """Days, observations, missing days and the mean number per non-missing day."""
    per_day = calendar.select(day).distinct().join(df.groupBy(day).agg(F.count(F.lit(1)).alias("n")), day, "left")
    return per_day.agg(
        F.count(F.lit(1)).alias("days"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"),
        F.count_if(F.col("n").isNull()).alias("missing_days"),
        F.avg("n").alias("mean_per_day"),
    )


def quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact quartiles with linear interpolation."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"))


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: Column) -> DataFrame:
    w = F.when(F.col(value).isNotNull(), weight)
    return df.groupBy(*keys).agg((F.sum(F.col(value) * w) / F.sum(w)).alias("weighted_mean"))


def sample_spread(df: DataFrame, samples: str, value: str) -> DataFrame:
    """df with the population spread of an ensemble array and its root mean square deviation from ``value``."""
    n = F.size(samples)
    mean = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x) / n
    spread = lambda centre: F.sqrt(F.aggregate(F.transform(samples, lambda x: (x - centre) * (x - centre)), F.lit(0.0), lambda a, x: a + x) / n)
    return df.withColumn("sample_mean", mean).withColumn("sample_std", spread(F.col("sample_mean"))).withColumn("sample_rms", spread(F.col(value)))


def variance_ratio(df: DataFrame, posterior: str, prior: str, clip: bool = True) -> DataFrame:
    """df with (posterior / prior) squared and the observation influence 1 - ratio."""
    r = F.try_divide(F.col(posterior) * F.col(posterior), F.col(prior) * F.col(prior))
    r = F.least(r, F.lit(1.0)) if clip else r
    return df.withColumn("variance_ratio", r).withColumn("influence", 1 - F.col("variance_ratio"))


def assemble_product(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Sum of components per cell: values add, uncertainties in quadrature, ensembles member by member."""
    out = None
    for i, p in enumerate(parts):
        p = p.select(*keys, F.col("value").alias(f"v{i}"), F.col("unc").alias(f"u{i}"), F.col("samples").alias(f"s{i}"))
        out = p if out is None else out.join(p, keys)
    total = lambda c: sum((F.col(f"{c}{i}") for i in range(1, len(parts))), F.col(f"{c}0"))
    squares = sum((F.col(f"u{i}") * F.col(f"u{i}") for i in range(1, len(parts))), F.col("u0") * F.col("u0"))
    samples = F.col("s0")
    for i in range(1, len(parts)):
        samples = F.zip_with(samples, f"s{i}", lambda a, b: a + b)
    return out.select(*keys, total("v").alias("value"), F.sqrt(squares).alias("unc"), samples.alias("samples"))


def extremes(df: DataFrame, keys: list[str], value: str, capacity: int) -> DataFrame:
    """Count, minimum and maximum over all observations of a bin, and whether they exceed ``capacity``."""
    n = F.count(value)
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(n.alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), (n > capacity).alias("over_capacity"))


def ordered_members(df: DataFrame, members: list[str]) -> DataFrame:
    """df with ensemble columns gathered into one array, by the number at the end of their names."""
    import re

    order = sorted(members, key=lambda m: int(re.search(r"(\d+)$", m)[1]))
    return df.withColumn("ensemble", F.array(*order)).drop(*members)


def thin(df: DataFrame, samples: str, most: int = 10) -> DataFrame:
    """df with only the first samples of an ensemble."""
    return df.withColumn(samples, F.slice(samples, 1, most))
