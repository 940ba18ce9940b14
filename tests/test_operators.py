"""Masks, windows, flags, stencils and joins on hand-computed or brute-force examples."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.operators import filters, flags, joins, stencil, temporal
from terracell.operators.flags import Bit


@pytest.mark.parametrize(
    ("must", "override", "qc", "expected"),
    [(15, 12, 1 << 15, True), (15, 12, 1 << 15 | 1 << 12, False), (15, 12, 1 << 12, False), (6, None, 1 << 6 | 1, True), (6, None, 1, False), (6, None, 0, False)],
)
def test_mask_rule(spark, must, override, qc, expected):
    df = spark.createDataFrame([(qc,)], "qc int")
    assert df.select(filters.any_rule(F.col("qc"), [(must, override)])).first()[0] is expected


def test_marine_masks_only_late_years(spark):
    df = spark.createDataFrame([(1 << Bit.MISSING_MARINE, 2012), (1 << Bit.MISSING_MARINE, 2013)], "qc int, y int")
    assert [r[0] for r in df.select(flags.masked(F.col("qc"), F.col("y"))).collect()] == [False, True]


def test_flag_names(spark):
    df = spark.createDataFrame([(0,), (1 << Bit.PERSISTENT_OUTLIER | 1,), (0xFFFF,)], "qc int")
    got = [r[0] for r in df.select(flags.names(F.col("qc"))).collect()]
    assert got[0] == [] and got[1] == ["DAY", "PERSISTENT_OUTLIER"] and len(got[2]) == 16


def test_flags_are_idempotent(spark):
    df = spark.createDataFrame([(5,), (0,)], "a int")
    once = df.select(flags.combine(F.col("a"), F.lit(4)).alias("a"))
    assert [r.a for r in once.select(flags.combine(F.col("a"), F.lit(4)).alias("a")).collect()] == [r.a for r in once.collect()] == [5, 4]


BREAKS = [(4, 47116), (4, 51499), (4, 53325), (4, 54056), (6, 38715), (6, 39811), (7, 47116), (8, 23740), (8, 24836), (8, 27027)]


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("day", [23740, 38715, 51499, 54056, 99999])
def test_next_break(spark, day, inclusive):
    breaks = spark.createDataFrame(BREAKS, "station int, break_day int")
    obs = spark.createDataFrame([(s, day) for s in (4, 6, 7, 8, 9)], "station int, day int")
    got = {r.station: r.next_break for r in joins.next_break(obs, breaks, inclusive=inclusive).collect()}
    after = lambda b: b >= day if inclusive else b > day
    assert got == {s: min((b for t, b in BREAKS if t == s and after(b)), default=None) for s in (4, 6, 7, 8, 9)}


def test_nearest_date_earlier_wins(spark):
    rows = spark.createDataFrame([(10,), (20,), (40,)], "day int")
    files = spark.createDataFrame([(8,), (12,), (29,), (50,)], "file_day int")
    got = {r.day: r.file_day for r in joins.nearest_date(rows, files, "day", "file_day", 10).collect()}
    assert got == {10: 8, 20: 12, 40: None}


def test_missing_input_policies(spark):
    steps = spark.createDataFrame([(0, 0), (1, 1)], "step bigint, key bigint")
    files = spark.createDataFrame([(0, 7), (0, 5)], "key bigint, file bigint")
    assert [r.files for r in joins.steps_with_files(steps, files, "skip").collect()] == [[5, 7]]
    assert [r.files for r in joins.steps_with_files(steps, files, "allowed").orderBy("step").collect()] == [[5, 7], [-1]]
    with pytest.raises(Exception, match="no file"):
        joins.steps_with_files(steps, files).collect()
    with pytest.raises(ValueError):
        joins.steps_with_files(steps, files, "whatever")


def grid_frame(spark, a):
    return spark.createDataFrame([(i, j, None if np.isnan(a[i, j]) else float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "lat_idx int, lon_idx int, v double")


def window(a, i, j, h):
    n, m = a.shape
    rows = [r if 0 <= r < n else -r if r < 0 else 2 * (n - 1) - r for r in range(i - h, i + h + 1)]
    return a[np.ix_(rows, [c % m for c in range(j - h, j + h + 1)])]


def test_moving_windows_against_brute_force(spark):
    g = np.random.default_rng(5)
    a = g.normal(280, 10, size=(9, 14))
    a[g.random(a.shape) < 0.2] = np.nan
    df = grid_frame(spark, a)
    mean = {(r.lat_idx, r.lon_idx): r.window_mean for r in stencil.moving_mean(df, [], "v", 9, 14, 5).collect()}
    quart = {(r.lat_idx, r.lon_idx): (r.q1, r.q2, r.q3) for r in stencil.moving_quartiles(df, [], "v", 9, 14, 5).collect()}
    hot = {(r.lat_idx, r.lon_idx): r.dilated for r in stencil.dilate(df.withColumn("f", F.col("v") > 295), [], "f", 9, 14).collect()}
    for i in range(9):
        for j in range(14):
            w = window(a, i, j, 2)
            assert mean[i, j] == pytest.approx(np.nanmean(w))
            assert quart[i, j] == pytest.approx(tuple(np.nanquantile(w, [0.25, 0.5, 0.75])))
            assert hot[i, j] == bool((w > 295).any())


def test_cloud_mask_needs_neighbours(spark):
    a = np.full((6, 6), 270.0)
    a[2, 2] = 255.0
    a[3, 3] = np.nan
    got = {(r.lat_idx, r.lon_idx): r.cloud for r in stencil.cloud_mask(grid_frame(spark, a), [], "v", 6, 6).collect()}
    assert [k for k, v in got.items() if v] == [(2, 2)]
    lonely = np.full((6, 6), np.nan)
    lonely[2, 2], lonely[2, 3] = 200.0, 270.0
    assert not any(r.cloud for r in stencil.cloud_mask(grid_frame(spark, lonely), [], "v", 6, 6).collect())


def test_calendar_window_on_29_february(spark):
    days = [date(2000, 2, 29), date(2001, 2, 28), date(2002, 2, 28), date(2004, 2, 29), date(2003, 3, 1)]
    df = spark.createDataFrame([(1, d, True) for d in days], "cell int, date date, constrained boolean")
    got = {r.date: (r.n_prior, r.n_post, r.n_total) for r in temporal.calendar_window(df, ["cell"]).collect()}
    assert got[date(2000, 2, 29)] == (0, 3, 4)
    assert got[date(2004, 2, 29)] == (3, 0, 4)
    assert got[date(2001, 2, 28)] == (0, 1, 2)
    assert len(got) == 5


def test_constraint_window_counts_absent_days_as_unconstrained(spark):
    rng = random.Random(3)
    rows = [(c, d, rng.random() < 0.6) for c in range(3) for d in range(60) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "cell int, day int, constrained boolean")
    got = {(r.cell, r.day): (r.n_prior, r.n_post) for r in temporal.constraint_window(df, ["cell"]).collect()}
    for c, d, _ in rows:
        near = [(e - d) for k, e, ok in rows if k == c and ok]
        assert got[c, d] == (sum(-15 <= x <= -1 for x in near), sum(1 <= x <= 15 for x in near))


def test_swapped_extremes_are_emptied(spark):
    df = spark.createDataFrame([(3.0, 1.0, 9.0), (1.0, 3.0, 9.0), (None, 1.0, 9.0)], "tasmin double, tasmax double, u double")
    got = [(r.tasmin, r.tasmax, r.u, r.swapped) for r in filters.minimum_above_maximum(df, also=("u",)).collect()]
    assert got == [(None, None, None, True), (1.0, 3.0, 9.0, False), (None, 1.0, 9.0, False)]


def test_mask_empties_ensembles(spark):
    df = spark.createDataFrame([(1.0, [1.0, 2.0], True), (1.0, [1.0, 2.0], False)], "v double, e array<double>, m boolean")
    got = [(r.v, r.e) for r in filters.apply_mask(df, F.col("m"), ["v"], ["e"]).collect()]
    assert got == [(None, [None, None]), (1.0, [1.0, 2.0])]
