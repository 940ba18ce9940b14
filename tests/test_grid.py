"""Axes, cells and aggregates on hand-computed examples."""

import math

import pytest
from pyspark.sql import functions as F

from terracell.functions import geometry, physics, timebase
from terracell.functions.grid import Axis, Grid
from terracell.operators import aggregate, filters, joins, merge
from terracell.plans.gridding import Quality, grid_day


def column(spark, values, expression, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_axis_truncates(spark):
    assert column(spark, [0.25, 0.65, 0.8, 1.6, 1.65], Axis(-0.5, 0.5, 5).index) == [1, 2, 2, 4, 4]


def test_axis_wraps(spark):
    assert column(spark, [0.0, -3.2, 4.0, 2.2, 3.99], Axis(-4.0, 1.0, 8, wrap=True).index) == [4, 0, 0, 6, 7]


def test_axis_outside(spark):
    assert column(spark, [-3.0], Axis(-1.5, 0.5, 10).index) == [None]
    assert column(spark, [-1.7], Axis(-1.5, 0.5, 10).index) == [0]
    assert column(spark, [-1.7], lambda v: Axis(-1.5, 0.5, 10).index(v, lower_checked=True)) == [None]
    with pytest.raises(Exception, match="outside"):
        column(spark, [5.9], lambda v: Axis(1.0, 1.0, 3).index(v, strict=True))


def test_flat_cells(spark):
    lat, lon = Axis(-2.0, 2.0, 2), Axis(-2.5, 1.0, 5)
    points = [(-0.2, 1.6), (-1.2, 1.4), (1.8, 2.3), (1.7, 1.5), (0.0, -2.5)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "k int, lat double, lon double")
    got = Grid(lat, lon).assign(df).orderBy("k").select("cell_id").collect()
    assert [r[0] for r in got] == [4, 3, 9, 9, 5]


def test_diagnostics_of_one_day(spark):
    grid = Grid(Axis(32.5, 5.0, 5), Axis(-15.0, 10.0, 4))
    places = spark.createDataFrame([(0, 45.0, -8.9), (1, 38.0, 22.1), (2, 42.0, 0.0), (3, 58.0, -5.0), (4, 41.0, 10.0)], "location_id bigint, latitude double, longitude double")
    obs = spark.createDataFrame([(57500, 0, 275.0, 5.0), (57499, 1, 301.0, 6.0), (57500, 3, 204.0, 7.0), (57500, 4, 310.0, 8.0)], "day int, location_id bigint, measurement double, unc double")
    rows = grid.assign(joins.with_location(obs, places), "latitude", "longitude")
    got = {(r.lat_idx, r.lon_idx): r for r in aggregate.diagnostics(filters.on_day(rows, 57500), ["lat_idx", "lon_idx"]).collect()}
    assert {(1, 2), (2, 0)} <= set(got)
    assert got[(1, 2)].weighted_sum == pytest.approx(310 / 8)
    assert got[(2, 0)].weighted_sum == pytest.approx(275 / 5)
    assert filters.on_day(rows, 57501).count() == 0


def test_mean_of_extremes(spark):
    schema = "location_id bigint, measurement double, unc double, unc_corr array<double>"
    a = spark.createDataFrame([(0, 270.0, 3.0, [3.0]), (1, None, 6.0, [5.0]), (2, 290.0, 4.0, [3.0]), (3, 300.0, 2.0, [7.0])], schema)
    b = spark.createDataFrame([(0, 280.0, 4.0, [4.0]), (1, 280.0, 6.0, [5.0]), (2, 300.0, 3.0, [4.0]), (3, None, 2.0, [8.0])], schema)
    got = joins.mean_of_extremes(a, b, ["location_id"], corr="unc_corr").orderBy("location_id").collect()
    assert [r.measurement for r in got] == [275.0, None, 295.0, None]
    assert got[0].unc == pytest.approx(3.5355, abs=1e-4) and got[2].unc == pytest.approx(3.5355, abs=1e-4)
    assert got[0].unc_corr[0] == pytest.approx(3.5355, abs=1e-4)


def test_grid_counts_double_when_data_double(spark):
    data = [(r, c, -4.0 + 2 * r, 0.5 + c, 10.0 * r + c, (r + c) % 4) for r in range(5) for c in range(6)]
    df = spark.createDataFrame(data, "r int, c int, lat double, lon double, measurement double, qc int").withColumns({n: F.lit(0.5) for n in ("unc_ran", "unc_atm", "unc_sfc", "unc_sys")})
    grid = Grid(Axis(-5.0, 2.0, 5), Axis(0.0, 1.0, 6))
    one = {r.cell_id: r for r in grid_day(df, grid, Quality(1, 1, 3, 3)).collect()}
    two = {r.cell_id: r for r in grid_day(df.union(df), grid, Quality(1, 1, 3, 3)).collect()}
    for k, r in one.items():
        assert two[k].n_total == 2 * r.n_total and two[k].n_valid == 2 * r.n_valid and two[k].ts_mean == r.ts_mean
        if r.n_valid:
            assert r.ts_min <= r.ts_mean <= r.ts_max
            assert r.unc_random == pytest.approx(0.5 / math.sqrt(r.n_valid)) and r.u_sys == pytest.approx(0.5)
    assert all(r.n_total >= r.n_valid for r in one.values())


def test_merge_of_two_instruments(spark):
    df = spark.createDataFrame([("A", 1, 3.0, 1.0), ("B", 1, 5.0, 2.0), ("A", 2, 7.0, 1.5)], "source string, cell int, field double, unc double")
    rho = spark.createDataFrame([("B", "A", 0.5)], "src_i string, src_j string, rho double")
    mean = {r.cell: r.merged for r in merge.merged_mean(df, ["cell"]).collect()}
    unc = {r.cell: r.merged_unc for r in merge.merged_uncertainty(df, rho, ["cell"]).collect()}
    assert mean == {1: 4.0, 2: 7.0}
    assert unc[1] == pytest.approx(math.sqrt(1 + 4 + 2 * 0.5 * 2) / 2) and unc[2] == 1.5
    assert merge.prune_pairs(rho, df.where("source = 'A'").select("source").distinct()).count() == 0


def test_day_numbers(spark):
    df = spark.sql("SELECT TIMESTAMP'2015-11-05 00:00:00' AS a, TIMESTAMP'2015-11-05 15:32:47' AS b")
    r = df.select(timebase.day_number(F.col("a")), timebase.decimal_day(F.col("b"))).first()
    assert r[0] == 60573 and r[1] == pytest.approx(60573.647766204, abs=1e-8)


def test_altitude(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0)], "a double, b double")
    got = df.select(physics.altitude_adjustment(F.col("a"), F.col("b")), physics.altitude_uncertainty(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (-6.5, 1.1)]


def test_packing_round_trip(spark):
    df = spark.createDataFrame([(273.15,), (None,), (301.235,)], "v double")
    packed = df.select("v", physics.TEMPERATURE.pack(F.col("v")).alias("p"))
    got = packed.select("v", "p", physics.TEMPERATURE.unpack(F.col("p")).alias("u")).collect()
    assert [r.p for r in got] == [0, -32768, 5617] and got[1].u is None and got[2].u == pytest.approx(301.235)


def test_barycentric_weights_sum_to_one(spark):
    df = spark.createDataFrame([(0.3, 0.2, 0.9), (0.5, 0.5, 0.5)], "x double, y double, z double")
    one, zero = F.lit(1.0), F.lit(0.0)
    w = geometry.barycentric(tuple(F.col(c) for c in "xyz"), (one, zero, zero), (zero, one, zero), (zero, zero, one))
    for r in df.select(*w).collect():
        assert sum(r) == pytest.approx(1.0)


def test_registry_refuses_a_taken_name():
    with pytest.raises(ValueError):
        aggregate.register("mean", lambda x: x)
