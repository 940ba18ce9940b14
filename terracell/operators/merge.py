"""Merging instruments: cell means, and uncertainties whose errors correlate between sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged_mean(df: DataFrame, keys: list[str], field: str = "field") -> DataFrame:
    """Mean over the sources that have the cell."""
    return df.groupBy(*keys).agg(F.avg(field).alias("merged"), F.count(field).alias("n_sources"))


def prune_pairs(rho: DataFrame, present: DataFrame) -> DataFrame:
    """Correlations between sources that are both present."""
    one, two = present.select(F.col("source").alias("src_i")), present.select(F.col("source").alias("src_j"))
    return rho.join(one, "src_i", "left_semi").join(two, "src_j", "left_semi")


def merged_uncertainty(df: DataFrame, rho: DataFrame, keys: list[str], unc: str = "unc") -> DataFrame:
    """sqrt(sum u_i^2 + sum 2 rho_ij u_i u_j) / n per cell; a missing u counts as 0.

    ``rho``: (src_i, src_j, rho), one row per unordered pair. Sources are few, so
    the pairs of a cell come from its own collected sources: one grouped pass
    over the field and no join. The correlation table goes into the plan as a literal
    map, whose size is the square of the number of instruments.
    """
    pairs = {f"{r['src_i']}|{r['src_j']}": r["rho"] for r in rho.select("src_i", "src_j", "rho").collect()}
    known = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]) if pairs else F.create_map().cast("map<string,double>")
    cells = df.groupBy(*keys).agg(
        F.count(unc).alias("n_valid"),
        F.sum(F.coalesce(F.col(unc) * F.col(unc), F.lit(0.0))).alias("_own"),
        F.array_sort(F.collect_list(F.struct(F.col("source").alias("s"), F.coalesce(F.col(unc), F.lit(0.0)).alias("u")))).alias("_parts"),
    )
    look = lambda a, b: F.coalesce(F.try_element_at(known, F.concat_ws("|", a, b)), F.try_element_at(known, F.concat_ws("|", b, a)), F.lit(0.0))
    later = lambda a: F.filter("_parts", lambda b: b["s"] > a["s"])
    both = F.aggregate(F.flatten(F.transform("_parts", lambda a: F.transform(later(a), lambda b: 2 * look(a["s"], b["s"]) * a["u"] * b["u"]))), F.lit(0.0), lambda acc, x: acc + x)
    return cells.select(*keys, "n_valid", F.try_divide(F.sqrt(F.col("_own") + both), F.col("n_valid")).alias("merged_unc"))
