import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridertide.config import NetworkConfig, StationConfig
from ridertide.operators.buckets import bucket_table, counts_of, require_counts, series_counts, station_counts
from ridertide.operators.stations import station_maps
from ridertide.plans import station
from ridertide.sources import events, places, tables, weather

EVENTS = """APP_ID;PLACE_ID;TRAN_DATE;TRANSPORT_TYPE_ID;VALIDATION_MODE;EXTRA
a;1;2024-01-01 00:00:05;1;10;x
b;2.0;2024-01-01 00:20:00;1;11;y
c;1;not a time;1;10;z
d;3;2024-01-01 00:05:00;2;10;w
e;1;2024-01-01 00:14:59;1;12;v
"""


@pytest.fixture()
def tap_file(tmp_path):
    path = tmp_path / "taps.csv"
    path.write_text(EVENTS)
    return str(path)


def test_event_reading_and_filters(spark, tap_file):
    raw = events.read_events_csv(spark, tap_file)
    assert "EXTRA" in raw.columns and dict(raw.dtypes)["TRAN_DATE"] == "timestamp_ntz"
    terms = events.filter_terms(1, (1, 2), (10, 11))
    assert terms == ["TRANSPORT_TYPE_ID = 1", "PLACE_ID IN (1, 2)", "VALIDATION_MODE IN (10, 11)"]
    kept = events.filter_events(raw, terms)
    assert set(kept.columns) == set(events.EVENT_COLUMNS)
    assert sorted(r["APP_ID"] for r in kept.collect()) == ["a", "b", "c"]
    assert sorted(r["APP_ID"] for r in events.timed_events(kept).collect()) == ["a", "b"]
    assert events.filter_terms() == [] and events.filter_events(raw, []).count() == 5


def test_filters_reach_the_scan(spark, tmp_path, tap_file):
    tables.write_parquet(events.read_events_csv(spark, tap_file), str(tmp_path / "full"))
    full = events.read_events_parquet(spark, str(tmp_path / "full"))
    slim = events.filter_events(full, events.filter_terms(1, (1, 2)))
    plan = series_counts(slim, NetworkConfig())._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(TRANSPORT_TYPE_ID,1)" in plan and "In(PLACE_ID, [1,2])" in plan
    assert "VALIDATION_MODE" not in plan and "APP_ID" not in plan and "EXTRA" not in plan


def test_places_with_aliases_and_mark(spark, tmp_path):
    path = tmp_path / "REF_1.csv"
    path.write_bytes("﻿id;transport_type_id;station id;Station Name;LINE_ID\n5;1;7; Park ;8\nx;1;7;Park;8\n".encode())
    df = places.read_places(spark, str(path))
    rows = df.orderBy(F.col("PLACE_ID").asc_nulls_last()).collect()
    assert (rows[0]["PLACE_ID"], rows[0]["ST_NAME"], rows[0]["LN_NAME"], rows[0]["PLACE_NAME"]) == (5, "Park", "8", "Park")
    assert rows[1]["PLACE_ID"] is None


def test_places_without_header(spark, tmp_path):
    path = tmp_path / "REF_2.csv"
    path.write_text("5;50;Gate;1;;;7;Park;P;8;Blue;B\n6;60;Gate 2;1;;;7;Park;P;8;Blue;B\n")
    df = places.read_places(spark, str(path))
    assert df.count() == 2
    assert df.first()["LN_NAME_SHORT"] == "B" and "COL_4" in df.columns


def test_places_need_columns(spark, tmp_path):
    path = tmp_path / "REF_3.csv"
    path.write_text("a;b\n1;2\n")
    with pytest.raises(ValueError, match="required"):
        places.read_places(spark, str(path))


def test_latest_file(spark, tmp_path):
    for name in ("REF_1.csv", "REF_3.csv", "REF_2.csv", "OTHER_9.csv"):
        (tmp_path / name).write_text("x")
    assert places.latest_file(spark, str(tmp_path), "REF_*.csv").endswith("REF_3.csv")
    with pytest.raises(FileNotFoundError):
        places.latest_file(spark, str(tmp_path), "NONE_*.csv")


def test_weather_keeps_last_row_of_an_hour(spark, tmp_path):
    path = tmp_path / "weather.csv"
    path.write_text(
        "time,temperature_2m,rain,other\n2024-01-01T00:00,1.5,0,q\n2024-01-01 00:30:00,2.5,bad,q\n"
        "2024-01-01T01:00,3.5,1,q\nnever,9,9,q\n"
    )
    rows = weather.read_weather(spark, str(path)).orderBy("weather_hour").collect()
    assert [r["weather_temperature_2m"] for r in rows] == [2.5, 3.5]
    assert rows[0]["weather_rain"] is None and rows[0]["weather_hour"] == dt.datetime(2024, 1, 1)


def test_weather_guards(spark):
    with pytest.raises(ValueError):
        weather.hourly_weather(spark.createDataFrame([(1,)], "x int"), F.col("x"))
    none = spark.createDataFrame([("2024-01-01", 1)], "time string, x int")
    assert weather.hourly_weather(none, F.col("x")) is None
    unread = spark.createDataFrame([("never", 1.0)], "time string, rain double")
    with pytest.raises(ValueError):
        weather.require_times(weather.hourly_weather(unread, F.lit(1)))


def test_station_metadata(spark, tmp_path):
    assert tables.read_station_metadata(spark, None) is None
    spark.range(3).write.parquet(str(tmp_path / "m.parquet"))
    assert tables.read_station_metadata(spark, str(tmp_path / "m.parquet")).count() == 3
    (tmp_path / "m.csv").write_text("a,b\n1,2\n")
    assert tables.read_station_metadata(spark, str(tmp_path / "m.csv")).columns == ["a", "b"]
    with pytest.raises(ValueError):
        tables.read_station_metadata(spark, "m.xlsx")


def test_buckets_round_trip(spark, tmp_path, tap_file):
    cfg = NetworkConfig(line_codes=None)
    ref = spark.createDataFrame(
        [(1, 1, 7, "Park", 8), (2, 1, 7, "Park", 8), (3, 1, 9, "Hall", 8)],
        "PLACE_ID bigint, TYPE_ID bigint, ST_CODE bigint, ST_NAME string, LN_CODE bigint",
    )
    stations, mapped = station_maps(places.tidy_places(ref), cfg)
    taps = events.timed_events(events.read_events_csv(spark, tap_file))
    counts = station_counts(taps, mapped, cfg)
    buckets = bucket_table(counts, stations, cfg)
    tables.write_buckets(buckets, str(tmp_path / "b"), ["LN_CODE", "ST_CODE", cfg.time_col])
    stored = tables.read_buckets(spark, str(tmp_path / "b"))
    got = {(r["ST_NAME"], r[cfg.time_col]): r["count"] for r in stored.collect()}
    day = dt.datetime(2024, 1, 1)
    assert got == {("Park", day): 2.0, ("Park", day.replace(minute=15)): 1.0, ("Hall", day): 1.0}
    again = {tuple(r) for r in counts_of(stored, cfg).collect()}
    assert again == {tuple(r) for r in counts.select("station_key", "step", "count").collect()}
    with pytest.raises(ValueError):
        require_counts(counts.filter("count < 0"))


def test_csv_sink(spark, tmp_path):
    paths = tables.write_csv_tables({"one": spark.range(2), "two": spark.range(3)}, str(tmp_path))
    assert spark.read.option("header", True).csv(paths["two"]).count() == 3


def test_buckets_lie_in_ranges_over_the_files(spark, tmp_path):
    """A filter on one line reads a share of the files."""
    rows = [(line, station, i, 1.0) for line in range(8) for station in range(5) for i in range(40)]
    table = spark.createDataFrame(rows, "LN_CODE long, ST_CODE long, bucket_60m long, count double").repartition(6)
    path = str(tmp_path / "buckets")
    tables.write_buckets(table, path, ["LN_CODE", "ST_CODE", "bucket_60m"], files=16)
    read = spark.read.parquet(path)
    files = {r[0] for r in read.select(F.input_file_name()).distinct().collect()}
    assert len(files) > 8 and read.count() == len(rows)
    spans = read.groupBy(F.input_file_name().alias("f")).agg(F.min("LN_CODE").alias("lo"), F.max("LN_CODE").alias("hi")).collect()
    assert sum(r["lo"] <= 3 <= r["hi"] for r in spans) <= 4


def test_event_layers(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", 1, 5, 1, "x", "more"), ("no time", 1, 5, 1, "y", "more"), ("2024-01-01 00:00:02", 2, 5, 1, "z", "more"), ("2024-01-01 00:00:03", 1, 6, 1, "w", "more")]
    raw = str(tmp_path / "raw")
    columns = "TRAN_DATE string, TRANSPORT_TYPE_ID int, PLACE_ID int, VALIDATION_MODE int, APP_ID string, OTHER string"
    spark.createDataFrame(rows, columns).write.option("header", True).option("sep", ";").csv(raw)
    cfg = StationConfig(place_ids=(5,))
    got = station.layered_events(spark, raw, cfg, str(tmp_path / "layers"))
    assert [(r["APP_ID"], r["PLACE_ID"]) for r in got.collect()] == [("x", 5)] and "OTHER" not in got.columns
    assert spark.read.parquet(str(tmp_path / "layers" / "full")).count() == 4
    assert spark.read.parquet(str(tmp_path / "layers" / "filtered")).count() == 2


def test_station_metadata_of_a_run(spark, tmp_path):
    path = str(tmp_path / "meta.parquet")
    spark.createDataFrame([(1, "a")], "id int, name string").write.parquet(path)
    assert station.station_metadata_of(spark, StationConfig(station_metadata_path=path)).collect()[0]["name"] == "a"
    assert station.station_metadata_of(spark, StationConfig()) is None
    assert station.station_metadata_of(spark, StationConfig(station_metadata_path=str(tmp_path / "none.csv"))) is None
