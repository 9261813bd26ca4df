"""Census maps: lookups, what is left out, and the projection."""

import math

import pytest
from pyspark.sql import functions as F

from arealmap.functions import geometry as G
from arealmap.sources import census


def test_states():
    rows = census.states()
    assert len(rows) == 52 and len({x[0] for x in rows}) == len({x[1] for x in rows}) == 52
    by = {x[0]: x for x in rows}
    assert by["06"] == ("06", "CA", "California", "West", "Pacific") and by["11"][2:] == ("District of Columbia", "South", "South Atlantic") and by["72"][3:] == (None, None)
    assert {d for ds in census.REGIONS.values() for d in ds} == set(census.DIVISIONS)


def test_projection_keeps_its_origin_and_shape(spark):
    at = spark.createDataFrame([(-96.0, 40.0), (-96.0, 41.0), (-97.0, 40.0), (-95.0, 40.0)], "lon double, lat double").select(census.albers(F.col("lon"), F.col("lat")).alias("p")).collect()
    o, up, left, right = ((r.p.x, r.p.y) for r in at)
    assert math.hypot(*o) < 1e-6 and up[1] > 100_000 and up[0] == pytest.approx(0, abs=1e-6)
    assert left[0] == pytest.approx(-right[0]) and left[1] == pytest.approx(right[1]) and left[1] > 0


def test_rows_left_out_and_new_columns(spark):
    box = G.box(F.lit(-100.0), F.lit(35.0), F.lit(-99.0), F.lit(36.0))
    rows = [(0, "06", "01", 10, 4, 0, 5), (1, "02", "00", 10, 4, 6, 5), (2, "11", "98", 10, 4, 6, 5), (3, "72", "98", 10, 4, 6, 0), (4, "36", "ZZ", 10, 4, 6, 5), (5, None, "01", 10, 4, 6, 5)]
    raw = spark.createDataFrame(rows, "region_id long, STATE string, CONGRESSIONAL_DISTRICT string, Population long, White long, Asian long, `Total Race` long").withColumn("geom", box)
    raw = raw.withColumns({"Black or African American": F.lit(1), "Hispanic or Latino": F.lit(2)})
    ids = lambda **o: sorted(r.region_id for r in census.census_map(raw, **o).collect())
    assert ids() == [0, 2, 4, 5] and ids(contiguous=False) == [0, 1, 2, 3, 4, 5]
    assert ids(level="congressional_district") == [0, 5] and ids(level="congressional_district", contiguous=False) == [0, 1, 2, 3, 5]
    held = {r.region_id: r for r in census.census_map(raw, race=True, contiguous=False, simplify=1000.0).collect()}
    assert held[0]["White %"] == 0.8 and held[3]["Asian %"] is None and held[5]["Region"] is None and held[3]["State Name"] == "Puerto Rico"
    assert held[0]["Population Density"] == pytest.approx(10 / 10_050, rel=0.02)
    with pytest.raises(ValueError):
        census.census_map(raw, level="county")
