"""GeoJSON, CSV and JSON in; cartogram tables out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.adjacency import shared_dir

#: Regions and territories that contiguous maps leave out.
NON_CONTIGUOUS = ("02", "15", "60", "66", "69", "72", "78")
POPULATION = "year int, state_fips string, state_name string, state_abbr string, population long"


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the one that driver and executors share."""
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _points(coords):
    return F.transform(coords, lambda c: G.point_of(c[0], c[1]))


def _polygon(parts):
    """Rings of an array of polygons: the first of each is its exterior."""
    ring = lambda r, k, part: F.struct(part.cast("int").alias("part"), F.when(k == 0, F.lit(1)).otherwise(F.lit(-1)).cast("tinyint").alias("sign"), _points(r).alias("pts"))
    return F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda r, k: ring(r, k, i))))


def read_geojson(spark: SparkSession, path: str, properties: str, id_column: str = "region_id") -> DataFrame:
    """Features of one or many GeoJSON documents, one row each: (id, the properties of the given DDL, geom).

    A document is read whole by one task, so large collections belong in many files.
    """
    shape = f"struct<features:array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>>"
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", shape, {"mode": "FAILFAST"}).alias("d"))
    rows = docs.select(F.posexplode("d.features").alias(id_column, "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    as_ = lambda depth: F.from_json(text, "array<" * depth + "double" + ">" * depth)
    flat = lambda pts, part=0: F.array(F.struct(F.lit(part).alias("part"), F.lit(0).cast("tinyint").alias("sign"), pts.alias("pts")))
    rings = (
        F.when(kind == "Polygon", _polygon(F.array(as_(3)))).when(kind == "MultiPolygon", _polygon(as_(4)))
        .when(kind == "Point", flat(_points(F.array(as_(1))))).when(kind.isin("MultiPoint", "LineString"), flat(_points(as_(2))))
        .when(kind == "MultiLineString", F.transform(as_(3), lambda l, i: F.struct(i.cast("int").alias("part"), F.lit(0).cast("tinyint").alias("sign"), _points(l).alias("pts"))))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported geometry: "), F.coalesce(kind, F.lit("null")))))
    )
    return rows.select(F.col(id_column).cast("long").alias(id_column), "f.properties.*", F.struct(kind.alias("kind"), rings.alias("rings")).alias("geom"))


def features(regions: DataFrame) -> DataFrame:
    """(feature): one GeoJSON feature per row, written as text lines."""
    rest = [c for c in regions.columns if c != "geom"]
    line = lambda r: F.transform(r["pts"], lambda p: F.array(p["x"], p["y"]))
    parts = F.array_sort(F.array_distinct(F.transform("geom.rings", lambda r: r["part"])))
    polygons = F.transform(parts, lambda k: F.transform(F.filter("geom.rings", lambda r: r["part"] == k), line))
    shape = F.when(F.size(parts) == 1, F.struct(F.lit("Polygon").alias("type"), F.to_json(polygons[0]).alias("c"))).otherwise(F.struct(F.lit("MultiPolygon").alias("type"), F.to_json(polygons).alias("c")))
    return regions.select(F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*rest)), F.lit(',"geometry":{"type":"'), shape["type"], F.lit('","coordinates":'), shape["c"], F.lit("}}")).alias("feature"))


def write_geojson(regions: DataFrame, path: str) -> None:
    """Newline-delimited features: any number of tasks write at once."""
    features(regions).write.mode("overwrite").text(path)


def read_feature_lines(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """The inverse of ``write_geojson``."""
    shape = f"struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>"
    held = spark.read.text(path).select(F.from_json("value", shape).alias("f"))
    text = F.col("f.geometry.coordinates")
    rings = F.when(F.col("f.geometry.type") == "Polygon", _polygon(F.array(F.from_json(text, "array<array<array<double>>>")))).otherwise(_polygon(F.from_json(text, "array<array<array<array<double>>>>")))
    return held.select("f.properties.*", F.struct(F.col("f.geometry.type").alias("kind"), rings.alias("rings")).alias("geom"))


def read_population(spark: SparkSession, path: str) -> DataFrame:
    """(year, state_fips, state_name, state_abbr, population); codes keep their zeros."""
    return spark.read.csv(path, header=True, schema=POPULATION)


def census_columns(raw: DataFrame, race: list[str] = (), poverty: str | None = None, level: str = "state", contiguous: bool = True) -> DataFrame:
    """Derived columns of landed census rows (state_fips, population, land_area_m2, ...): millions, per square kilometre, shares in per cent."""
    held = raw.where(~F.col("state_fips").isin(*NON_CONTIGUOUS)) if contiguous else raw
    if level != "state" and contiguous:
        held = held.where(F.col("state_fips") != "11")
    out = {"Population (Millions)": F.col("population") / 1e6, "Population Density": F.col("population") / (F.col("land_area_m2") / 1e6)}
    for c in [*race, *([poverty] if poverty else [])]:
        out[f"{c} %"] = F.col(c) / F.col("population") * 100
    return held.withColumns(out)


def save_tables(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """A run's tables as Parquet, each partitioned by run."""
    for name, df in tables.items():
        df.withColumn("run", F.lit(run_id)).write.mode("append").partitionBy("run").parquet(f"{path}/{name}")


def load_table(spark: SparkSession, path: str, name: str, run_id: str | None = None) -> DataFrame:
    held = spark.read.parquet(f"{path}/{name}")
    return held.where(F.col("run") == run_id).drop("run") if run_id else held


def save_document(regions: DataFrame, convergence: DataFrame, path: str, **facts) -> None:
    """One JSON document of a finished map: facts, features and convergence.  For a map's size, not a corpus's."""
    shape = features(regions).agg(F.concat(F.lit("["), F.array_join(F.collect_list("feature"), ","), F.lit("]")).alias("f"))
    steps = convergence.agg(F.to_json(F.array_sort(F.collect_list(F.struct("iteration", *[c for c in convergence.columns if c != "iteration"])))).alias("c"))
    known = F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in facts.items()))) if facts else F.lit("{}")
    doc = shape.join(steps).select(F.concat(F.lit('{"facts":'), known, F.lit(',"features":'), "f", F.lit(',"convergence":'), "c", F.lit("}")).alias("value"))
    doc.coalesce(1).write.mode("overwrite").text(path)


def load_document(spark: SparkSession, path: str, properties: str, steps: str, facts: str = "status string") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, regions, convergence) of a saved document."""
    shape = f"struct<facts:struct<{facts}>,features:array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>,convergence:array<struct<{steps}>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("d"))
    f = doc.select(F.explode("d.features").alias("f"))
    text = F.col("f.geometry.coordinates")
    rings = F.when(F.col("f.geometry.type") == "Polygon", _polygon(F.array(F.from_json(text, "array<array<array<double>>>")))).otherwise(_polygon(F.from_json(text, "array<array<array<array<double>>>>")))
    regions = f.select("f.properties.*", F.struct(F.col("f.geometry.type").alias("kind"), rings.alias("rings")).alias("geom"))
    return doc.select("d.facts.*"), regions, doc.select(F.explode("d.convergence").alias("c")).select("c.*")


def export_history(history: DataFrame, path: str, output_format: str = "csv") -> None:
    """A history as CSV or JSON lines; an empty one writes nothing as CSV."""
    if output_format not in ("csv", "json"):
        raise ValueError("output_format is csv or json")
    if output_format == "csv":
        if history.take(1):
            history.write.mode("overwrite").csv(path, header=True)
    else:
        history.write.mode("overwrite").json(path)
