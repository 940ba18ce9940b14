"""Windows over days and years of a cell. Frames are by value, so gaps count as absent days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def constraint_window(df: DataFrame, keys: list[str], day: str = "day", constrained: str = "constrained", reach: int = 15, least: int = 5) -> DataFrame:
    """df with the number of constrained days before and after, and whether they are too few."""
    w = Window.partitionBy(*keys).orderBy(day)
    ones = F.col(constrained).cast("int")
    before = F.coalesce(F.sum(ones).over(w.rangeBetween(-reach, -1)), F.lit(0)).cast("bigint")
    after = F.coalesce(F.sum(ones).over(w.rangeBetween(1, reach)), F.lit(0)).cast("bigint")
    df = df.withColumn("n_prior", before).withColumn("n_post", after)
    return df.withColumn("prior_flag", F.col("n_prior") < least).withColumn("post_flag", F.col("n_post") < least)


def persistence_window(df: DataFrame, keys: list[str], day: str = "day", outlier: str = "outlier", reach: int = 10, least: int = 7) -> DataFrame:
    """df with the number of outlier days around each day, itself included, and whether they persist."""
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(-reach, reach)
    n = F.coalesce(F.sum(F.col(outlier).cast("int")).over(w), F.lit(0)).cast("bigint")
    return df.withColumn("n_outliers", n).withColumn("persistent", F.col("n_outliers") >= least)


def calendar_window(df: DataFrame, keys: list[str], date: str = "date", constrained: str = "constrained", least_side: int = 1, least_total: int = 3) -> DataFrame:
    """df with the number of years, earlier and later, in which this calendar day is constrained.

    29 February looks at 28 February in the years that have none; so each row is
    counted under its own calendar day, and the 28th of a common year also under
    the 29th.
    """
    rows = df.withColumns({"_y": F.year(date), "_m": F.month(date), "_d": F.dayofmonth(date), "_own": F.lit(True)})
    y = F.col("_y")
    leap = ((F.pmod(y, F.lit(4)) == 0) & (F.pmod(y, F.lit(100)) != 0)) | (F.pmod(y, F.lit(400)) == 0)
    stand_in = rows.where((F.col("_m") == 2) & (F.col("_d") == 28) & ~leap).withColumns({"_d": F.lit(29), "_own": F.lit(False)})
    w = Window.partitionBy(*keys, "_m", "_d").orderBy("_y")
    ones = F.col(constrained).cast("int")
    count = lambda frame: F.coalesce(F.sum(ones).over(frame), F.lit(0)).cast("bigint")
    out = rows.unionByName(stand_in).withColumns(
        {
            "n_prior": count(w.rangeBetween(Window.unboundedPreceding, -1)),
            "n_post": count(w.rangeBetween(1, Window.unboundedFollowing)),
            "n_total": count(w.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )
    out = out.where("_own").drop("_y", "_m", "_d", "_own")
    return out.withColumns({"prior_flag": F.col("n_prior") < least_side, "post_flag": F.col("n_post") < least_side, "missing_flag": F.col("n_total") < least_total})


def first_of_run(df: DataFrame, order: list[str], key: str) -> DataFrame:
    """df with whether a row begins a new run of ``key`` (per key: its first row in order)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("is_first", F.row_number().over(w) == 1)


def offsets(counts: DataFrame, order: str, n: str = "n") -> DataFrame:
    """Running total of the rows before each, for a small table of counts."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum(n).over(w), F.lit(0)).cast("bigint"))
