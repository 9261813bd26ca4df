"""Runs as versioned tables with a manifest that is committed last.

A save writes each table into a folder of its own, then a numbered JSON manifest that
names them with their rows and digests, under another name first and renamed when it is whole.  Readers see
only what a manifest names: a save that broke off leaves folders that nobody reads,
and a table that lost files or rows is told by its manifest.
"""

from __future__ import annotations

import dataclasses
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import circles, flow, raster, voronoi
from ..operators.grids import Grid

FORMAT = 1
#: What an option may be made of beside plain values.
KNOWN = {f"{c.__module__.rsplit('.', 1)[-1]}.{c.__name__}": c for c in (flow.Options, circles.PhysicsOptions, circles.PackingOptions, voronoi.Options, voronoi.Relaxation, Grid, raster.Pipeline, raster.DensitySmooth, raster.BorderExtension, raster.VelocitySmooth, raster.BoundaryDecay, raster.BoundaryNormalDecay)}


def encoded(value):
    """An option as plain JSON values; what couldn't be made again from them is refused."""
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, tuple):
        return {"tuple": [encoded(x) for x in value]}
    if isinstance(value, list):
        return [encoded(x) for x in value]
    if isinstance(value, dict):
        return {"map": {str(k): encoded(v) for k, v in value.items()}}
    name = next((k for k, c in KNOWN.items() if type(value) is c), None)
    if name is None:
        raise ValueError(f"{type(value).__name__} can't be saved as an option")
    held = {f.name: getattr(value, f.name) for f in dataclasses.fields(value)} if dataclasses.is_dataclass(value) else vars(value)
    return {"type": name, "fields": {k: encoded(v) for k, v in held.items()}}


def decoded(value):
    if isinstance(value, list):
        return [decoded(x) for x in value]
    if not isinstance(value, dict):
        return value
    if "tuple" in value:
        return tuple(decoded(x) for x in value["tuple"])
    if "map" in value:
        return {k: decoded(v) for k, v in value["map"].items()}
    held, kind = {k: decoded(v) for k, v in value["fields"].items()}, KNOWN[value["type"]]
    if dataclasses.is_dataclass(kind):
        return kind(**held)
    made = kind.__new__(kind)
    made.__dict__.update(held)
    return made


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Of the saves that were finished, oldest first."""
    files, where = _folder(spark, path)
    if not files.exists(where):
        return []
    names = [x.getPath().getName() for x in files.listStatus(where)]
    return sorted(int(m[1]) for m in (re.fullmatch(r"manifest-(\d+)\.json", n) for n in names) if m)


def _told(df: DataFrame) -> dict:
    """Rows of a table and a digest that doesn't depend on their order."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) for c in df.columns)).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return {"rows": row.n, "digest": str(row.h)}


def save_run(path: str, tables: dict[str, DataFrame], **facts) -> int:
    """Save tables and facts (options among them); the number of the save."""
    if not tables:
        raise ValueError("nothing to save")
    known = {k: encoded(v) for k, v in facts.items()}  # what can't be saved is told before anything is written
    spark, held = next(iter(tables.values())).sparkSession, {}
    for name, df in tables.items():
        folder = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{path}/{folder}")
        held[name] = {"folder": folder, "schema": df.schema.jsonValue()} | _told(spark.read.schema(df.schema).parquet(f"{path}/{folder}"))
    number = (numbers(spark, path) or [0])[-1] + 1
    text = json.dumps({"format": FORMAT, "number": number, "tables": held, "facts": known})
    files, draft = _folder(spark, f"{path}/.draft-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    last = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-{number:08d}.json")
    if files.exists(last) or not files.rename(draft, last):
        raise FileExistsError(f"another save has taken number {number}")
    return number


def load_run(spark: SparkSession, path: str, number: int | None = None, check: bool = True) -> tuple[dict[str, DataFrame], dict]:
    """(tables, facts) of a save, the last one if not told; tables that aren't as they were saved are refused."""
    from pyspark.sql.types import StructType

    known = numbers(spark, path)
    if not known or (number is not None and number not in known):
        raise FileNotFoundError(f"no finished save {number or ''} in {path}")
    number = known[-1] if number is None else number
    files, where = _folder(spark, f"{path}/manifest-{number:08d}.json")
    told = json.loads(spark.read.text(where.toString(), wholetext=True).first()[0])
    if told["format"] > FORMAT:
        raise ValueError(f"format {told['format']} is newer than {FORMAT}")
    tables = {}
    for name, x in told["tables"].items():
        if not files.exists(_folder(spark, f"{path}/{x['folder']}")[1]):
            raise ValueError(f"the table {name} of save {number} is missing")
        tables[name] = spark.read.schema(StructType.fromJson(x["schema"])).parquet(f"{path}/{x['folder']}")
        if check and _told(tables[name]) != {k: x[k] for k in ("rows", "digest")}:
            raise ValueError(f"the table {name} of save {number} isn't as it was saved")
    return tables, {k: decoded(v) for k, v in told["facts"].items()}
