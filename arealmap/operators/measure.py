"""Areas, targets, errors, normalised shares and sizes of regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

#: Square metres, by unit, of a density's denominator.
AREA_UNITS = {"m2": 1.0, "km2": 1e6, "sqft": 0.3048**2, "ha": 1e4, "sqmi": 1609.344**2}


def area_scale(source: str, target: str) -> float:
    """What turns an area in one unit into the other: square metres to square kilometres is 1e-6."""
    for unit in (source, target):
        if unit not in AREA_UNITS:
            raise ValueError(f"unknown area unit {unit!r}; known: {', '.join(AREA_UNITS)}")
    return AREA_UNITS[source] / AREA_UNITS[target]


def by_map(df: DataFrame) -> Window:
    """One window per map where the rows name their map, else one over all of them."""
    return Window.partitionBy("map_id") if "map_id" in df.columns else Window.partitionBy()


def map_keys(df: DataFrame) -> list[str]:
    return ["map_id"] if "map_id" in df.columns else []


def per_map(df: DataFrame, **sums: Column) -> DataFrame:
    """``df`` with aggregates of its map beside each row: a partial aggregate and one small join, not a window over all rows."""
    keys = map_keys(df)
    totals = df.groupBy(*keys).agg(*(c.alias(n) for n, c in sums.items()))
    return df.join(F.broadcast(totals)) if not keys else df.join(totals, keys)


def original_state(regions: DataFrame, value: str = "value", scale: float = 1.0) -> DataFrame:
    """Each region's area, target area at equal density, log2 error, signed error in per cent, and density."""
    held = regions.withColumn("area", G.area(F.col("geom")))
    held = per_map(held, _v=F.sum(value), _a=F.sum("area"))
    held = held.withColumn("target_area", F.col(value) / (F.col("_v") / F.col("_a")))
    held = with_errors(held, "area", "target_area")
    return held.withColumn("density", F.col(value) / (F.col("area") * scale)).drop("_v", "_a")


def log_error(current: Column, target: Column) -> Column:
    """log2 of the ratio; a target of 0 is an infinite error."""
    return F.when(target == 0, F.lit(float("inf"))).otherwise(F.log2(current / target))


def error_pct(log: Column) -> Column:
    return F.signum(log) * (F.pow(F.lit(2.0), F.abs(log)) - 1) * 100


def with_errors(df: DataFrame, current: str, target: str) -> DataFrame:
    return df.withColumn("log_error", log_error(F.col(current), F.col(target))).withColumn("error_pct", error_pct(F.col("log_error")))


def error_summary(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean and largest log error; the percentages are those of the aggregated logarithms, not means of percentages."""
    mean, most = F.avg(F.abs("log_error")), F.max(F.abs("log_error"))
    pct = lambda c: (F.pow(F.lit(2.0), c) - 1) * 100
    return df.groupBy(*(keys or map_keys(df))).agg(mean.alias("mean_log_error"), most.alias("max_log_error"), pct(mean).alias("mean_error_pct"), pct(most).alias("max_error_pct"))


def convergence_status(series: DataFrame, mean_tol: float = 0.05, max_tol: float = 0.10, patience: int = 5) -> DataFrame:
    """Status of each iteration: converged within both tolerances, stalled once the mean error has risen more than ``patience`` times in all."""
    keys = map_keys(series)
    order = Window.partitionBy(*keys).orderBy("iteration")
    rose = (F.col("mean_log_error") > F.lag("mean_log_error").over(order)).cast("int")
    rises = F.sum(F.coalesce(rose, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    good = (F.col("mean_log_error") < F.log2(F.lit(1 + mean_tol))) & (F.col("max_log_error") < F.log2(F.lit(1 + max_tol)))
    return series.withColumn("rises", rises).withColumn("status", F.when(good, "converged").when(F.col("rises") > patience, "stalled").otherwise("running"))


def validate(summary: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """Warnings of a finished map: largest error above 10 %, stalled, invalid geometries."""
    found = [F.when(F.col("max_error_pct") > 10, F.lit("max error above 10%")), F.when(F.col("status") == "stalled", F.lit("stalled")) if "status" in summary.columns else F.lit(None)]
    if broken is not None:
        summary = summary.join(F.broadcast(broken.agg(F.count("*").alias("n_invalid"))))
        found.append(F.when(F.col("n_invalid") > 0, F.lit("invalid geometries")))
    return summary.withColumn("warnings", F.array_compact(F.array(*found))).withColumn("is_valid", F.size("warnings") == 0)


NORMALIZATIONS = ("sum", "maximum", "row", None)


def fractions(df: DataFrame, columns: list[str], normalization: str | None = None, invert: bool = False, check: bool = True) -> DataFrame:
    """``f_<column>`` of each column, and ``f_complement``, what a row leaves to 1.

    By the sum of all values, the largest row sum, the row's own sum (0 where that is
    0), or the values as they are; inverted ones are 1 less the fraction.  ``check`` looks
    at the values first, in one pass, and refuses what has no fractions.
    """
    if normalization not in NORMALIZATIONS:
        raise ValueError(f"normalization must be one of {NORMALIZATIONS}")
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns not found: {missing}")
    if normalization == "row" and len(columns) == 1:
        raise ValueError("a single column has no shares of its row")
    values = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    row_sum = reduce(lambda a, b: a + b, values.values())
    if check:
        kinds = dict(df.dtypes)
        if bad := [c for c in columns if kinds[c].split("(")[0] not in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]:
            raise ValueError(f"columns are not numeric: {bad}")
        low, high = df.agg(F.min(F.least(*values.values()) if len(columns) > 1 else values[columns[0]]), F.max(row_sum)).first()
        if low is not None and low < 0:
            raise ValueError("negative values have no fractions")
        if not high:
            raise ValueError("all values are zero")
    held = df.withColumn("_row", row_sum)
    if normalization == "sum":
        held = per_map(held, _by=F.sum("_row"))
    elif normalization == "maximum":
        held = per_map(held, _by=F.max("_row"))
    else:
        held = held.withColumn("_by", F.col("_row") if normalization == "row" else F.lit(1.0))
    share = lambda c: F.when(F.col("_by") == 0, F.lit(0.0)).otherwise(values[c] / F.col("_by"))
    put = (lambda c: F.least(F.greatest(1 - share(c), F.lit(0.0)), F.lit(1.0))) if invert else share
    held = held.withColumns({f"f_{c}": put(c) for c in columns})
    whole = reduce(lambda a, b: a + b, (F.col(f"f_{c}") for c in columns))
    if check and held.agg(F.max(whole)).first()[0] > 1 + 1e-9:
        raise ValueError("fractions of a row add up to more than 1")
    return held.withColumn("f_complement", F.least(F.greatest(1 - whole, F.lit(0.0)), F.lit(1.0))).drop("_row", "_by")


def dot_counts(df: DataFrame, columns: list[str], n_dots: int = 100, normalization: str | None = None, invert: bool = False) -> DataFrame:
    """(region_id, category, dots): half-to-even rounded numbers of dots; one column without a normalization goes by the largest."""
    if len(columns) == 1 and normalization is None:
        normalization = "maximum"
    held = fractions(df, columns, normalization, invert)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.bround(F.col(f"f_{c}") * n_dots).cast("long").alias("dots"), F.col(c).cast("double").alias("value")) for c in columns))).alias("e")
    kept = [c for c in ("map_id", "region_id", "geom") if c in df.columns]
    return held.select(*kept, each).select(*kept, "e.category", "e.dots", "e.value")


def long_partitions(df: DataFrame, columns: list[str], prefix: str = "geometry_") -> DataFrame:
    """Wide part geometries as rows (region_id, category, geom, color_value, is_complement), without empty ones."""
    each = [F.struct(F.lit(c).alias("category"), F.col(prefix + c).alias("geom"), F.col(f"f_{c}").alias("color_value"), F.lit(c == "complement").alias("is_complement")) for c in columns]
    return df.select("region_id", F.explode(F.array(*each)).alias("e")).select("region_id", "e.*").where("geom is not null and size(geom.rings) > 0")


SCALES = {"sqrt": F.sqrt, "linear": lambda c: c, "log": F.log1p}


def symbol_sizes(df: DataFrame, value: str, scale: str = "sqrt", largest: float | Column | None = None, size_max_value: float | None = None, clip: bool = True, total_area: Column | None = None) -> DataFrame:
    """``size``: the scaled value by its maximum (or that of ``size_max_value``), times ``largest``.

    ``total_area`` rescales so that the circles' areas add up to it.
    """
    if scale not in SCALES:
        raise ValueError(f"scale must be one of {tuple(SCALES)}")
    held = df.withColumn("_s", SCALES[scale](F.abs(F.col(value).cast("double"))))
    if size_max_value is None:
        held = per_map(held, _m=F.max("_s"))
        held = held.withColumn("_s", F.when(F.col("_m") > 0, F.col("_s") / F.col("_m")).otherwise(F.lit(0.0))).drop("_m")
    else:
        held = held.withColumn("_s", F.col("_s") / SCALES[scale](F.lit(float(abs(size_max_value)))))
        if clip:
            held = held.withColumn("_s", F.least(F.greatest("_s", F.lit(0.0)), F.lit(1.0)))
    held = held.withColumn("size", F.col("_s") * (F.lit(1.0) if largest is None else F.lit(largest) if isinstance(largest, int | float) else largest))
    if total_area is not None:
        held = per_map(held, _q=F.sum(F.lit(3.141592653589793) * F.col("size") * F.col("size")), _t=total_area)
        held = held.withColumn("size", F.col("size") * F.sqrt(F.col("_t") / F.col("_q"))).drop("_q", "_t")
    return held.drop("_s")


def layout_input(regions: DataFrame, value: str | None = None, scale: str = "sqrt", size_max_value: float | None = None, clip: bool = True, normalization: str = "max") -> DataFrame:
    """(region_id, x, y, size, area): centroids and radii.  The unit radius comes from the mean area of all rows; rows without a value go after that."""
    if value is not None and value not in regions.columns:
        raise ValueError(f"column {value!r} not found")
    if not regions.take(1):
        raise ValueError("the map is empty")
    held = regions.withColumn("area", G.area(F.col("geom"))).withColumn("_c", G.centroid(F.col("geom")))
    held = per_map(held, _r0=F.sqrt(F.avg("area") / 3.141592653589793), _all=F.sum("area"))
    held = held.withColumn("x", F.col("_c.x")).withColumn("y", F.col("_c.y"))
    if value is None:
        return held.withColumn("size", F.col("_r0")).drop("_c", "_r0", "_all")
    held = held.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    sized = symbol_sizes(held, value, scale, F.col("_r0"), size_max_value, clip, F.sum("area") if normalization == "total" else None)
    return sized.drop("_c", "_r0", "_all")


def layout_transforms(layout: DataFrame) -> DataFrame:
    """``scale``: each size by the mean size."""
    return per_map(layout, _mean=F.avg("size")).withColumn("scale", F.col("size") / F.col("_mean")).drop("_mean")


def compare(original: DataFrame, morphed: DataFrame) -> DataFrame:
    """(region_id, dx, dy, displacement, area_change): centroid shifts and area ratios, 1 where the original has no area."""
    side = lambda df, n: df.select("region_id", G.centroid(F.col("geom")).alias(n + "c"), G.area(F.col("geom")).alias(n + "a"))
    both = side(original, "o").join(side(morphed, "m"), "region_id")
    dx, dy = F.col("mc.x") - F.col("oc.x"), F.col("mc.y") - F.col("oc.y")
    return both.select("region_id", dx.alias("dx"), dy.alias("dy"), F.hypot(dx, dy).alias("displacement"), F.when(F.col("oa") == 0, 1.0).otherwise(F.col("ma") / F.col("oa")).alias("area_change"))


def comparison_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(F.avg("displacement").alias("mean_displacement"), F.max("displacement").alias("max_displacement"), F.avg("area_change").alias("mean_area_change"))


def area_cv(df: DataFrame, column: str = "area", weight: str | None = None) -> DataFrame:
    """Standard deviation by mean, of areas by their weights if there are any."""
    v = F.col(column) / F.col(weight) if weight else F.col(column)
    return df.groupBy(*map_keys(df)).agg((F.stddev_pop(v) / F.avg(v)).alias("area_cv"))


def area_errors(df: DataFrame, area: str = "area", weight: str | None = None) -> DataFrame:
    """``area_error_pct`` of cells against their share of the whole area."""
    w = F.col(weight) if weight else F.lit(1.0)
    held = per_map(df, _a=F.sum(area), _w=F.sum(w))
    return held.withColumn("area_error_pct", (F.col(area) / (F.col("_a") * w / F.col("_w")) - 1) * 100).drop("_a", "_w")


def rescaled(df: DataFrame, column: str, low: float, high: float, out: str) -> DataFrame:
    """Values spread linearly over a range; the middle of it where they are all the same."""
    held = per_map(df, _lo=F.min(column), _hi=F.max(column))
    put = F.when(F.col("_hi") > F.col("_lo"), low + (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (high - low)).otherwise(F.lit((low + high) / 2))
    return held.withColumn(out, put).drop("_lo", "_hi")


def with_column(symbols: DataFrame, name: str, source: DataFrame | None = None) -> DataFrame:
    """``symbols`` with a column to show: the source's, if it has it, else their own."""
    if source is not None and name in source.columns:
        return symbols.drop(name).join(source.select("region_id", name), "region_id")
    if name in symbols.columns:
        return symbols
    known = sorted(c for c in {*symbols.columns, *(source.columns if source is not None else ())} if not c.startswith("_"))
    raise ValueError(f"no column {name!r}; known: {', '.join(known)}")
