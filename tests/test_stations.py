import pytest
from pyspark.sql import functions as F

from ridertide.config import NetworkConfig
from ridertide.operators import stations

PLACE = "PLACE_ID bigint, TYPE_ID bigint, ST_CODE bigint, ST_NAME string, ST_NAME_SHORT string, LN_CODE bigint, LN_NAME string, LN_NAME_SHORT string, IS_TEST int"


@pytest.fixture()
def reference(spark):
    rows = [
        (4, 1, 30, "C", "c", 8, "Blue line", "Blue", 0),
        (2, 1, 10, "A", "a", 8, "Blue line", "Blue", None),
        (1, 1, 10, "A", "a1", 8, "Blue line", "Blue", 0),
        (3, 1, 20, "B", "b", 8, "Blue line", "Blue", 1),
        (5, 1, 10, "A", "a", 609, "Ring", "Ring", 0),
        (6, 1, 20, "B", "b", 609, "Ring", "Ring", 0),
        (7, 1, 10, "X", "x", 9, "Кольцевая", "К", 0),
        (8, 2, 10, "T", "t", 8, "Tram", "Tram", 0),
        (9, 1, None, "N", "n", 8, "Blue line", "Blue", 0),
        (10, 1, 10, "F", "f", 77, "Far", "Far", 0),
    ]
    return spark.createDataFrame(rows, PLACE)


def test_place_filters(reference):
    every = stations.place_map(reference, NetworkConfig())
    assert {r["PLACE_ID"] for r in every.collect()} == {1, 2, 3, 4, 5, 6, 7}
    blue = stations.place_map(reference, NetworkConfig(line_filter="BLU", line_codes=None))
    assert {r["PLACE_ID"] for r in blue.collect()} == {1, 2, 3, 4}


def test_summary_and_structure(reference):
    full, _ = stations.station_maps(reference, NetworkConfig())
    rows = {r["station_key"]: r for r in full.collect()}
    a = rows["ln00008_st00010"]
    assert (a["n_place_ids"], a["place_ids"], a["ST_NAME_SHORT"]) == (2, "1,2", "a1")
    norms = [rows[f"ln00008_st000{c}"]["station_order_norm"] for c in (10, 20, 30)]
    assert norms == [0.0, 0.5, 1.0]
    assert [rows[f"ln00008_st000{c}"]["is_terminal_proxy"] for c in (10, 20, 30)] == [1, 0, 1]
    assert rows["ln00008_st00020"]["distance_to_nearest_terminal_norm"] == 0.5
    for key in ("ln00609_st00020", "ln00009_st00010"):
        assert rows[key]["is_ring_line_proxy"] == 1 and rows[key]["is_terminal_proxy"] == 0
        assert rows[key]["distance_to_nearest_terminal_proxy"] == 0.0
    assert rows["ln00009_st00010"]["station_order_norm"] == 0.0


def test_labelled_maps(reference):
    out = stations.labelled_station_maps(reference, "Blue")
    assert {r["PLACE_ID"] for r in out["line_places"].collect()} == {1, 2, 4}
    label = out["line_stations"].filter(F.col("ST_CODE") == 10).first()["station_label"]
    assert label == "A | Blue"
    with_test = stations.labelled_place_map(reference, None, "Blue", include_test=True)
    assert {r["PLACE_ID"] for r in with_test.collect()} == {1, 2, 3, 4}
