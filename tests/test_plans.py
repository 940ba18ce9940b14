"""Physical plans: what is read and what is shuffled."""

import re

import pytest
from pyspark.sql import functions as F

from terracell.plans import queries as observations

DATA = "/root/testdata/sf0.001"


def plan(spark, name):
    return observations.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "exchanges"), [("grid_flagship", 1), ("grid_daily", 1), ("diagnostic_grid", 1), ("bin_registry", 1), ("deviation_second_pass", 1), ("mask_rules", 0), ("land_regression_fallback", 0), ("persistent_outlier", 2), ("window_flags", 2)])
def test_shuffles(spark, name, exchanges):
    assert len(re.findall(r"\bExchange (?:hash|range|Single)", plan(spark, name))) == exchanges


def test_columns_are_pruned(spark):
    schema = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, "daily_totals"))
    assert schema == ["l_shipdate:timestamp_ntz"] or schema == ["l_shipdate:timestamp"]


#: location on a mesh descends its levels over Arrow batches; quartiles of windows are taken over views of a tile's array
MESH = {"mesh_locate_coarse", "domain_filter", "spatial_bias", "delayed_updates"}
TILES = {"spatial_quartiles", "spatial_adaptive_quartiles", "areal_flags"}


def test_no_python_in_observation_plans(spark):
    python = {n for n in observations.SQL if re.search("Python|Pandas|Arrow|MapIn", plan(spark, n))}
    assert python == MESH | TILES
    assert not any("Generate explode(sequence(-" in plan(spark, n) for n in TILES)


def test_day_filter_prunes_partitions(spark, tmp_path):
    df = spark.range(40).select((F.col("id") % 4).cast("int").alias("day"), F.col("id").alias("x"))
    df.write.partitionBy("day").parquet(str(tmp_path / "p"))
    from terracell.sources import readers

    text = readers.retrieve_day(spark.read.parquet(str(tmp_path / "p")), 2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*day.* = 2\)", text)
