"""Readers, writers, catalogues and the streaming variant, by round trips."""

import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from terracell.functions.grid import Axis, Grid
from terracell.sources import catalogue, readers, sinks
from terracell.streaming import gridding


def test_ship_reports(spark, tmp_path):
    titles = ["ID", "Lat", "Lon", "year", "month", "day", "hour", "Air"]
    rows = [["SHIP1", "-455", "1900", "2001", "12", "31", "6", "1234"], ["SHIP2", "10", "-200", "2002", "1", "1", "0", "-50"]]
    with gzip.open(tmp_path / "ships.txt.gz", "wt") as f:
        for r in [titles, *rows]:
            f.write("".join(x.ljust(8) for x in r) + "\n")
    got = readers.ships(spark, str(tmp_path), titles).orderBy("ship").collect()
    assert [(r.latitude, r.longitude) for r in got] == [(pytest.approx(-45.5), pytest.approx(-170.0)), (pytest.approx(1.0), pytest.approx(-20.0))]
    assert got[0].measurement == pytest.approx(285.49) and got[1].day - got[0].day == 1 and got[0].unc == 1.1


def test_lakes_share_locations(spark, tmp_path):
    (tmp_path / "lake.tsv").write_text("DateTime\tlat\tlon\tfTa\n2001-01-01\t60.5\t20.25\t1.5\n2001-01-02\t60.5\t20.25\t2.5\n2001-01-01\t10.0\t5.0\t20\n")
    obs, places = readers.lakes(spark, str(tmp_path / "lake.tsv"))
    got = obs.orderBy("location_id", "day").collect()
    assert [r.location_id for r in got] == [0, 1, 1] and got[1].measurement == pytest.approx(274.65) and places.count() == 2


def test_raw_binary_round_trip(spark, tmp_path):
    rows = [(1, 280.5, 0.3), (2**40, -1.25, 1.0)]
    (tmp_path / "a.bin").write_bytes(readers.encode_raw(rows, (b"f" * 16, b"c" * 16, b"u" * 16)))
    got = readers.raw_observations(spark, str(tmp_path)).orderBy("location_id").collect()
    assert [(r.location_id, r.measurement, r.unc, r.unc_corr) for r in got] == [(*r, []) for r in rows]


def test_granules(spark):
    assert readers.granules(spark, "20150101").count() == 288
    assert readers.granules(spark, "201501012355").first()[0] == datetime(2015, 1, 1, 23, 55)
    with pytest.raises(ValueError):
        readers.granules(spark, "2015")


def test_missing_source_is_empty(spark):
    assert readers.missing(spark).count() == 0


def test_field_round_trip_and_verification(spark, tmp_path):
    df = spark.createDataFrame([(60000, 1, 2, 280.125, 0.5, 0.75), (60400, 1, 3, None, 0.25, 0.5)], "day int, lat_idx int, lon_idx int, tas double, tasuncertainty double, tasobservationinfluence double")
    sinks.write_field(df, str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    assert sorted(p.name for p in (tmp_path / "f").iterdir() if p.name.startswith("year")) == ["year=2014", "year=2015"]
    got = sinks.unpacked(back).orderBy("day").collect()
    assert got[0].tas == pytest.approx(280.125, abs=0.0026) and got[1].tas is None and got[1].tasuncertainty == pytest.approx(0.25)
    outcome = {r.description: r.outcome for r in sinks.verify(back, {"day": "int", "tas": "int", "gone": "int"}, {"tas": {"scale_factor": 0.005}}).collect()}
    assert outcome["variable day is int"] and outcome["variable tas has scale_factor = 0.005"] and not outcome["variable gone exists"] and not outcome["variable lat_idx is expected"]
    assert sinks.output_name("tas", "c", "f", 0, "20150101") == "tas_c_f_0_20150101"


def test_state_store(spark, tmp_path):
    store = sinks.StateStore(spark, str(tmp_path / "s"))
    store.write("local", "state", 3, spark.createDataFrame([(0, 1.5)], "param_id bigint, value double"))
    store.write("local", "state", 4, spark.createDataFrame([(0, 2.5)], "param_id bigint, value double"))
    assert [r.value for r in store.read("local", "state", 4).collect()] == [2.5]


def test_discovery(spark, tmp_path):
    for name in ("a_20010203.nc", "a_20010204.nc", "Land_land_x.nc", "Land_sea_x.nc", "other.txt"):
        (tmp_path / name).write_bytes(name.encode())
    got = catalogue.discover(spark, str(tmp_path), "d", ["a_%Y%m%d.nc", "%A_%a_x.nc"], checksum=True).orderBy("subset", "entry").collect()
    assert [(r.subset, r.entry, r.time and r.time.day, r.tags) for r in got] == [(0, 0, 3, []), (0, 1, 4, []), (1, 0, None, ["Land"])]
    assert all(r.checksum is not None and r.size > 0 for r in got)


def test_name_pattern_errors_and_repeats(spark):
    assert catalogue.to_regex("%Y/%Y.nc") == ("^(\\d{4})/\\1\\.nc$", ["Y"])
    with pytest.raises(ValueError):
        catalogue.to_regex("%Q")


def test_operations_run_by_registry_only():
    @catalogue.operation("double")
    def double(x):
        return 2 * x

    assert catalogue.run("double", 4) == 8
    with pytest.raises(KeyError):
        catalogue.run("os.system")


def test_stream_equals_batch(spark, tmp_path):
    data = [(f"2024-01-0{1 + k % 4} 0{k % 9}:00:00", -80.0 + k, -170.0 + 3 * k, float(k), 1 if k % 3 else 0, 0.5) for k in range(60)]
    df = spark.createDataFrame(data, "ts string, lat double, lon double, measurement double, qc int, unc_ran double").withColumn("ts", F.to_timestamp("ts"))
    late = spark.createDataFrame([("2024-02-01 00:00:00", 0.0, 0.0, 0.0, 1, 0.5)], "ts string, lat double, lon double, measurement double, qc int, unc_ran double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    grid = Grid(Axis(-90.0, 30.0, 6), Axis(-180.0, 60.0, 6))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = gridding.write_days(gridding.grid_stream(stream, grid), str(tmp_path / "out"), str(tmp_path / "check"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(str(r.day), r.cell_id): (r.n, r.mean) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = grid.assign(df.where("qc = 1")).groupBy(F.to_date("ts").cast("string").alias("d"), "cell_id").agg(F.count(F.lit(1)).alias("n"), F.avg("measurement").alias("m")).collect()
    assert got == {(r.d, r.cell_id): (r.n, r.m) for r in want}


def test_archive_members(spark, tmp_path):
    import io
    import tarfile

    for name, mode in (("a.tar", "w"), ("b.tar.gz", "w:gz")):
        with tarfile.open(tmp_path / name, mode) as tar:
            for k in range(3):
                info = tarfile.TarInfo(f"x_{k}.nc")
                info.size = k
                tar.addfile(info, io.BytesIO(b"y" * k))
    got = catalogue.archive_members(spark, str(tmp_path)).collect()
    assert sorted((r.archive.rsplit("/", 1)[1], r.name, r.size) for r in got) == [(a, f"x_{k}.nc", k) for a in ("a.tar", "b.tar.gz") for k in range(3)]


def test_catalogue_snapshot(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a_20010203.nc").write_bytes(b"1")
    rows = catalogue.discover(spark, str(tmp_path / "in"), "d", ["a_%Y%m%d.nc"])
    key = catalogue.write_snapshot(rows, str(tmp_path / "c"), "v1")
    back = catalogue.read_snapshot(spark, str(tmp_path / "c"))
    assert back.first().catalogue_id == key and back.first().time == datetime(2001, 2, 3)
    assert catalogue.entry_path(back, "d", 0, 0).first()[0].endswith("a_20010203.nc")
    assert catalogue.check_toolchain(back, "v1").count() == 0 and catalogue.check_toolchain(back, "v2").count() == 1


def test_descriptions_are_checked():
    d = catalogue.describe("grid", "daily", "2001-01-01", "2001-12-31", {"lst": ("a_%Y%m%d.nc", "skip")}, "o_%Y%m%d.nc")
    assert d["inputs"]["lst"]["missing"] == "skip"
    for bad in (("hourly", "skip", "a"), ("daily", "never", "a"), ("daily", "skip", "%Z")):
        with pytest.raises(ValueError):
            catalogue.describe("grid", bad[0], "", "", {"lst": ("a.nc", bad[1])}, bad[2])


def test_correlation_ranges(spark):
    got = readers.correlation_ranges(spark, {("land", "Tmin"): [100, 5.5]}).orderBy("idx").collect()
    assert [(r.source, r.observable, r.idx, r.range) for r in got] == [("land", "Tmin", 0, 100.0), ("land", "Tmin", 1, 5.5)]
