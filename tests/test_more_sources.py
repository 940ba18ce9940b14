"""Raw files, pointers, status tables, checksums, groups, windows in tiles, breaks over periods."""

import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.functions.grid import Axis
from terracell.operators import joins, stencil
from terracell.sources import catalogue, readers, schema, sinks


def test_pointers_find_records_in_raw_days(spark, tmp_path):
    g = np.random.default_rng(1)
    ids = (b"a" * 16, b"b" * 16, b"c" * 16)
    obs, contents = [], []
    for day in range(3):
        rows = [(int(g.integers(0, 5)), float(g.normal()), float(g.random())) for _ in range(20)]
        obs += [(k, day, *r) for k, r in enumerate(rows)]
        contents.append((day, bytearray(readers.encode_raw(rows, ids))))
        (tmp_path / f"{day}.bin").write_bytes(bytes(contents[-1][1]))
    df = spark.createDataFrame(obs, "k int, day int, location_id bigint, measurement double, unc double")
    table = readers.location_pointers(df, ["k"]).cache()
    assert sorted((r.location_id, r.day, r.offset) for r in table.collect()) == sorted((o[2], o[1], 48 + 24 * o[0]) for o in obs)
    wanted = table.where("location_id = 3")
    got = readers.read_at(spark.createDataFrame(contents, "day int, content binary"), wanted)
    assert sorted((r.day, r.measurement, r.unc) for r in got.collect()) == sorted((o[1], o[3], o[4]) for o in obs if o[2] == 3)
    whole = readers.raw_observations(spark, str(tmp_path)).collect()
    assert sorted((r.location_id, r.measurement, r.unc, tuple(r.unc_corr)) for r in whole) == sorted((*o[2:], ()) for o in obs)


def test_raw_files_with_correlated_parts(spark, tmp_path):
    raw = np.zeros(2, dtype=readers._record(2))
    raw["location_id"], raw["measurement"], raw["unc_corr"] = [4, 9], [1.5, 2.5], [[1, 2], [3, 4]]
    (tmp_path / "x.bin").write_bytes(b"i" * 48 + raw.tobytes())
    assert [(r.location_id, r.measurement, r.unc_corr) for r in readers.raw_observations(spark, str(tmp_path), 2).collect()] == [(4, 1.5, [1.0, 2.0]), (9, 2.5, [3.0, 4.0])]
    (tmp_path / "x.bin").write_bytes(b"i" * 50)
    with pytest.raises(Exception, match="whole number of records"):
        readers.raw_observations(spark, str(tmp_path), 2).collect()


def test_location_lookups_and_ranges_read_back(spark, tmp_path):
    places = [(10.5, -20.25), (-90.0, 180.0)]
    (tmp_path / "l.bin").write_bytes(readers.encode_locations(places, (b"f" * 16, b"\x01" * 16)))
    got = readers.raw_locations(spark, str(tmp_path / "l.bin"))
    assert [(r.lookup_id, r.location_id, r.latitude, r.longitude) for r in got.orderBy("location_id").collect()] == [("01" * 16, k, *p) for k, p in enumerate(places)]
    sinks.write_locations(got, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    ranges = readers.correlation_ranges(spark, {("land", "Tmean"): [100.0, 5.5], ("ice", "Tmin"): [3.0]})
    sinks.write_correlation_ranges(ranges, str(tmp_path / "r"))
    assert sorted(map(tuple, readers.read_correlation_ranges(spark, str(tmp_path / "r")).collect())) == sorted(map(tuple, ranges.collect()))


def test_station_files(spark, tmp_path):
    breaks = spark.createDataFrame([(1, 50, 90), (1, 20, 100), (2, 5, 3)], "station int, break_day int, likelihood int")
    series = spark.createDataFrame([(1, 10, 280.0), (2, 11, 281.0)], "station int, day int, tas double")
    sinks.write_station_files(series, breaks, str(tmp_path))
    got = spark.read.parquet(str(tmp_path / "status")).orderBy("station", "status_index").collect()
    assert [(r.station, r.status_index, r.from_day, r.to_day) for r in got] == [(1, 0, None, 20), (1, 1, 21, 50), (2, 0, None, 5)]
    assert spark.read.parquet(str(tmp_path / "temperature")).count() == 2


def test_ice_fields_of_files(spark, tmp_path):
    row = (70.0, 10.0, 250.0, 249.0, 251.0, 1.0, 1, 0.9, 0.1, 0.2, 0.3, [250.0] * 8, [1] * 8, "2010-03-04 12:00:00")
    ddl = schema.ICE_INPUT + ", surface_temperature_3d array<double>, nobs_3d array<int>"
    df = spark.createDataFrame([row[:-1]], ddl).withColumn("time", F.lit(row[-1]).cast("timestamp"))
    df.write.parquet(str(tmp_path / "ice"))
    got = readers.ice_input(spark, str(tmp_path / "ice")).first()
    assert (got.t_mean, got.t_min, got.t_max, got.std, got.bin_n, got.unc_sys) == (250.0, 249.0, 251.0, 1.0, [1] * 8, 0.3)
    assert got.day == (np.datetime64("2010-03-04") - np.datetime64("1850-01-01")).astype(int)


@pytest.mark.parametrize("content", [b"", b"a", b"hello\n", bytes(range(256)) * 300])
def test_checksums_are_those_of_the_command(tmp_path, content):
    path = tmp_path / "f"
    path.write_bytes(content)
    assert catalogue.cksum(content) == int(subprocess.run(["cksum", str(path)], capture_output=True, text=True, check=True).stdout.split()[0])


def test_discovery_with_checksums(spark, tmp_path):
    (tmp_path / "obs_20100101.nc").write_bytes(b"hello\n")
    got = catalogue.discover(spark, str(tmp_path), "d", ["obs_%Y%m%d.nc"], checksum=True).first()
    assert (got.checksum, got["size"]) == (3015617425, 6)


def test_a_group_of_operations_runs_as_one(spark):
    seen = []

    @catalogue.operation("collect_group")
    def collect_group(rows):
        seen.extend(rows)
        return len(rows)

    operations = spark.createDataFrame([(k, [k, k + 1]) for k in range(10)], "operation int, files array<int>").repartition(3)
    assert catalogue.run_group("collect_group", operations, 4, 1) == 4
    assert [r["operation"] for r in seen] == [4, 5, 6, 7] and seen[0]["files"] == [4, 5]
    assert [r["operation"] for r in catalogue.run_group("collect_group", operations, 4, 2, just_list=True)] == [8, 9] and len(seen) == 4
    with pytest.raises(ValueError):
        catalogue.run_group("collect_group", operations, 0, 0)


def brute_quartiles(field, nlat, nlon, hy, hx):
    out = {}
    for i, j in field:
        got = []
        for dy in range(-hy(i), hy(i) + 1):
            r = i + dy
            r = -r if r < 0 else 2 * (nlat - 1) - r if r >= nlat else r
            got += [field[r, (j + dx) % nlon] for dx in range(-hx(i), hx(i) + 1) if (r, (j + dx) % nlon) in field and field[r, (j + dx) % nlon] is not None]
        out[i, j] = tuple(np.percentile(got, [25, 50, 75])) if got else None
    return out


@pytest.mark.parametrize(("nlat", "nlon", "width"), [(18, 36, 5), (9, 8, 7), (150, 70, 3)])
def test_tiled_quartiles_equal_brute_force(spark, nlat, nlon, width):
    g = np.random.default_rng(width)
    field = {(i, j): None if g.random() < 0.2 else float(g.normal()) for i in range(nlat) for j in range(nlon) if g.random() < 0.9}
    df = spark.createDataFrame([(7, i, j, v, "x") for (i, j), v in field.items()], "day int, lat_idx int, lon_idx int, tas double, note string")
    got = stencil.moving_quartiles(df, ["day"], "tas", nlat, nlon, width)
    assert got.columns == [*df.columns, "q1", "q2", "q3"]
    want = brute_quartiles(field, nlat, nlon, lambda i: width // 2, lambda i: width // 2)
    rows = {(r.lat_idx, r.lon_idx): r for r in got.collect()}
    assert set(rows) == set(field)
    assert all((rows[k].q1 is None) if w is None else np.allclose((rows[k].q1, rows[k].q2, rows[k].q3), w) for k, w in want.items())


def test_breaks_over_many_periods_equal_brute_force(spark):
    g = np.random.default_rng(3)
    breaks = [(int(g.integers(0, 4)), int(g.integers(0, 6000))) for _ in range(40)]
    obs = [(k, int(g.integers(0, 5)), int(g.integers(-500, 7000))) for k in range(400)] + [(1000 + k, s, d) for k, (s, d) in enumerate(breaks)] + [(5000, 1, None)]
    b = spark.createDataFrame(breaks, "station int, break_day int")
    o = spark.createDataFrame(obs, "k int, station int, day int")
    for inclusive in (False, True):
        for period in (100, 366, 100_000):
            got = {r.k: r.next_break for r in joins.next_break(o, b, inclusive=inclusive, period=period).collect()}
            want = {k: min((x for s2, x in breaks if s2 == s and (x >= d if inclusive else x > d)), default=None) if d is not None else None for k, s, d in obs}
            assert got == want


def test_bilinear_leaves_rows_whole(spark):
    """Repeated rows stay, missing nodes count as absent, and rows without any node drop out."""
    lat, lon = Axis(-90.0, 10.0, 18), Axis(-180.0, 10.0, 36)
    nodes = spark.createDataFrame([(9, 18, 1.0), (9, 19, 3.0), (10, 18, 5.0)], "lat_idx int, lon_idx int, value double")
    obs = spark.createDataFrame([(1, 10.0, 10.0), (1, 10.0, 10.0), (2, -60.0, -100.0), (3, 5.0, 5.0)], "k int, lat double, lon double")
    got = sorted((r.k, r.value) for r in joins.bilinear(obs, nodes, lat, lon, "value").collect())
    assert got == [(1, 2.25), (1, 2.25), (3, 1.0)]
