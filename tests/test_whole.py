"""Registered queries over every row of their tables."""

import os
import random

import pytest

from terracell.operators import aggregate
from terracell.plans import queries as observations

DATA = "/root/testdata/sf0.001"


def test_extremes_of_full_bins(spark):
    rng = random.Random(11)
    values = {"few": [5.0, 1.0, 3.0], "many": [rng.random() for _ in range(50)]}
    df = spark.createDataFrame([*((k, v) for k, vs in values.items() for v in vs), ("few", None), ("none", None)], "cell string, v double")
    got = {r.cell: (r.n, r.low, r.high, r.over_capacity) for r in aggregate.extremes(df, ["cell"], "v", 20).collect()}
    assert got == {k: (len(vs), min(vs), max(vs), len(vs) > 20) for k, vs in values.items()}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["axis_bin_edges", "lon_wrap", "ocean_box", "location_threshold_flags", "ice_regression", "ice_uncertainty", "remap_columns", "mesh_locate"])
def test_whole_queries_return_every_row(spark, name):
    assert observations.QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/lineitem.parquet").count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_whole_pairs_keep_every_pixel_that_has_both_sides(spark):
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet")
    assert observations.QUERIES["satellite_pairs"](spark, DATA).count() == rows.where("l_partkey % 3 <> 0").count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_whole_summary_counts_every_observation(spark):
    assert observations.QUERIES["obs_summary"](spark, DATA).first()["total"] == spark.read.parquet(f"{DATA}/lineitem.parquet").count()
