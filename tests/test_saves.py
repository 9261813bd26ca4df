"""Saves that tell torn tables, and results that come back as they were."""

import glob
import json
import shutil

import pytest
from pyspark.sql import functions as F

from arealmap import fixtures as X
from arealmap.kernels import circles, flow, raster, voronoi
from arealmap.operators import history
from arealmap.plans import cartograms
from arealmap.sources import manifest


def test_options_as_json():
    held = [flow.Options(grid_size=(64, 32), density_mod=raster.Pipeline(raster.DensitySmooth(0.5), raster.BorderExtension(1.0, 2.0))), circles.PhysicsOptions(), voronoi.Options(relaxation=voronoi.Relaxation(1.5), repair_stages=("adjacency",)), None, {"a": (1, [2.5, "x"])}]
    for x in held:
        again = manifest.decoded(json.loads(json.dumps(manifest.encoded(x))))
        assert manifest.encoded(again) == manifest.encoded(x) and type(again) is type(x)
    assert manifest.decoded(manifest.encoded(held[2])) == held[2]
    with pytest.raises(ValueError):
        manifest.encoded(lambda i: 1.0)


def test_saves_are_whole_or_not_there(spark, tmp_path):
    path = str(tmp_path / "run")
    one = spark.range(50).withColumn("a.b", F.col("id") * 2).withColumn("m", F.create_map(F.lit("k"), "id"))
    with pytest.raises(FileNotFoundError):
        manifest.load_run(spark, path)
    assert manifest.save_run(path, {"t": one}, note="first") == 1
    with pytest.raises(ValueError):
        manifest.save_run(path, {"t": one}, bad=object())
    assert manifest.numbers(spark, path) == [1] and len(glob.glob(f"{path}/t-*")) == 1
    assert manifest.save_run(path, {"t": one.where("id < 5"), "none": one.where("false")}, note="second") == 2
    tables, told = manifest.load_run(spark, path)
    assert tables["t"].count() == 5 and tables["none"].count() == 0 and tables["none"].columns == ["id", "a.b", "m"] and told == {"note": "second"}
    tables, told = manifest.load_run(spark, path, 1)
    assert tables["t"].count() == 50 and told["note"] == "first"
    folder = json.loads(open(glob.glob(f"{path}/manifest-00000002.json")[0]).read())["tables"]["t"]["folder"]
    shutil.copy(glob.glob(f"{path}/{folder}/part-*.parquet")[0], f"{path}/{folder}/part-again.parquet")
    with pytest.raises(ValueError, match="isn't as it was saved"):
        manifest.load_run(spark, path)
    shutil.rmtree(f"{path}/{folder}")
    with pytest.raises(ValueError, match="missing"):
        manifest.load_run(spark, path)
    assert manifest.load_run(spark, path, 1)[0]["t"].count() == 50


def test_layouts_and_symbols_come_back(spark, sf_dir, tmp_path):
    made = cartograms.symbol_cartogram(X.nation_map(spark, sf_dir), "value", layout="centroid", symbol="square", canonical="square")
    rules = made.places.where("region_id % 4 = 1").select("region_id", F.lit(0).alias("seq"), F.lit("diamond").alias("symbol"), F.lit(None).cast("double").alias("scale"), F.lit(None).cast("double").alias("rotation"), F.lit(None).cast("boolean").alias("reflection"), F.lit(None).cast("map<string,string>").alias("params"))
    made = made.restyle(rules, "square", canonical="square")
    made.save(str(tmp_path / "symbols"))
    again = cartograms.SymbolCartogram.load(spark, str(tmp_path / "symbols"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(again.symbols) == rows(made.symbols) and again.made["layout"] == "centroid" and again.style["symbol"] == "square"
    laid = cartograms.layout_result(X.nation_map(spark, sf_dir), "value", "packing", options={"max_iterations": 20})
    laid.save(str(tmp_path / "layout"))
    back = cartograms.LayoutResult.load(spark, str(tmp_path / "layout"))
    assert back.made == laid.made and rows(back.places) == rows(laid.places) and back.made["options"] == {"max_iterations": 20}
    with pytest.raises(ValueError):
        cartograms.Workflow.load(spark, str(tmp_path / "layout"))


def test_as_of(spark):
    """Runs apart, iterations asked before the first, at one, between and after the last, and several rows to a snapshot."""
    snaps = spark.createDataFrame([(k, i, r, float(10 * i + r)) for k, its in (("a", (1, 6, 11)), ("b", (4,))) for i in its for r in range(3)], "run string, iteration int, region_id int, v double")
    asked = spark.createDataFrame([(k, i) for k in "abc" for i in (0, 1, 5, 6, 20)] + [("a", 5)], "run string, iteration int")
    got = {(r.run, r.iteration, r.region_id): (r.recorded, r.v) for r in history.as_of(snaps, asked, ["run"]).collect()}
    want = {}
    for k, its in (("a", (1, 6, 11)), ("b", (4,))):
        for i in (0, 1, 5, 6, 20):
            past = [x for x in its if x <= i]
            for r in range(3) if past else ():
                want[k, i, r] = (past[-1], float(10 * past[-1] + r))
    assert got == want
