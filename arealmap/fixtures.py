"""Maps derived from the test tables, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as G


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region_id, grp, value): a nation's order total, 0 where it has none."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    spent = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    totals = spent.groupBy("c_nationkey").agg(F.sum("v").alias("v"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("region_id"), F.col("n_regionkey").alias("grp"), F.col("n_name").alias("name"))
    return nations.join(totals, F.col("region_id") == F.col("c_nationkey"), "left").select("region_id", "grp", "name", F.round(F.coalesce("v", F.lit(0.0)), 2).alias("value"))


def nation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation n as the unit square in column n % 5 and row n div 5."""
    x0, y0 = (F.col("region_id") % 5).cast("double"), F.floor(F.col("region_id") / 5).cast("double")
    return nation_values(spark, sf_dir).withColumn("geom", G.box(x0, y0, x0 + 1, y0 + 1))


def nation_lshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same squares; of each three the second lacks its upper right quarter, the third its middle."""
    n = F.col("region_id")
    x0, y0 = (n % 5).cast("double"), F.floor(n / 5).cast("double")
    notch = F.array(*(G.point(x0 + a, y0 + b) for a, b in ((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1), (0, 0))))
    whole, cut = G.geom("Polygon", G.ring(G.box_points(x0, y0, x0 + 1, y0 + 1))), G.geom("Polygon", G.ring(notch))
    holed = G.geom("Polygon", G.ring(G.box_points(x0, y0, x0 + 1, y0 + 1)), G.ring(G.box_points(x0 + 0.25, y0 + 0.25, x0 + 0.75, y0 + 0.75), 0, -1))
    return nation_values(spark, sf_dir).withColumn("geom", F.when(n % 3 == 0, whole).when(n % 3 == 1, cut).otherwise(holed))


def part_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part p as a unit square on rows of 50; its value is its price."""
    low = table(spark, sf_dir, "part").agg(F.min("p_partkey").alias("low"))
    parts = table(spark, sf_dir, "part").join(F.broadcast(low)).withColumn("k", F.col("p_partkey") - F.col("low"))
    x0, y0 = (F.col("k") % 50).cast("double"), F.floor(F.col("k") / 50).cast("double")
    return parts.select(F.col("p_partkey").alias("region_id"), (F.col("p_size") % 5).alias("grp"), F.col("p_retailprice").alias("value"), G.box(x0, y0, x0 + 1, y0 + 1).alias("geom"))


def nation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region_id, c1, c2, c3): a nation's order totals by status F, O and P."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    part = lambda s: F.round(F.coalesce(F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), F.lit(0.0)), 2)
    totals = orders.groupBy("c_nationkey").agg(part("F").alias("c1"), part("O").alias("c2"), part("P").alias("c3"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("region_id"))
    wide = nations.join(totals, F.col("region_id") == F.col("c_nationkey"), "left")
    return wide.select("region_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("c1", "c2", "c3")))


def user_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("point_id")).distinct()
    return users.select("point_id", (5.0 * ((37 * F.col("point_id")) % 101) / 101).alias("x"), (5.0 * ((53 * F.col("point_id")) % 103) / 103).alias("y"))


def seed_sites(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """The ``n`` suppliers of the smallest keys as weighted points."""
    chosen = table(spark, sf_dir, "supplier").orderBy("s_suppkey").limit(n)
    return chosen.select(F.col("s_suppkey").alias("site_id"), (5.0 * ((37 * F.col("s_suppkey")) % 101) / 101).alias("x"), (5.0 * ((53 * F.col("s_suppkey")) % 103) / 103).alias("y"), (1.0 + F.col("s_nationkey")).alias("weight"))


def order_sums(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """(k, total, orders): all orders dealt into ``n`` by their key; their total in millions and their number."""
    k = F.pmod(F.col("o_orderkey"), F.lit(n)).cast("int")
    return table(spark, sf_dir, "orders").groupBy(k.alias("k")).agg((F.sum("o_totalprice") / 1e6).alias("total"), F.count("*").alias("orders"))


def order_field(cells: DataFrame, sf_dir: str, width: int, height: int) -> DataFrame:
    """Cells (iy, ix, ...) with a velocity made of the orders that fall to them: their total, and a tenth of their number less 0.3."""
    sums = order_sums(cells.sparkSession, sf_dir, width * height)
    held = cells.withColumn("k", F.col("iy") * width + F.col("ix")).join(sums, "k", "left")
    return held.withColumns({"vx": F.coalesce("total", F.lit(0.0)), "vy": 0.1 * F.coalesce("orders", F.lit(0)) - 0.3}).drop("k", "total", "orders")


def part_bounds(spark: SparkSession, sf_dir: str) -> tuple[float, float, float, float]:
    """Bounds of the part map, which grows with the parts."""
    b = part_map(spark, sf_dir).select(G.bounds(F.col("geom")).alias("b"))
    return tuple(b.agg(F.min("b.xmin"), F.min("b.ymin"), F.max("b.xmax"), F.max("b.ymax")).first())


def nation_bounds(spark: SparkSession, sf_dir: str) -> tuple[float, float, float, float]:
    b = nation_map(spark, sf_dir).select(G.bounds(F.col("geom")).alias("b"))
    return tuple(b.agg(F.min("b.xmin"), F.min("b.ymin"), F.max("b.xmax"), F.max("b.ymax")).first())


#: The same in SQL, as common table expressions.
NATION = """nm AS (
  SELECT n.n_nationkey AS region_id, n.n_regionkey AS grp, n.n_name AS name, round(coalesce(v.v, 0.0), 2) AS value,
         CAST(n.n_nationkey % 5 AS DOUBLE) AS x0, CAST(n.n_nationkey // 5 AS DOUBLE) AS y0
  FROM nation n LEFT JOIN (SELECT c.c_nationkey, sum(o.o_totalprice) AS v FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1) v
    ON n.n_nationkey = v.c_nationkey)"""
LSHAPE = (
    NATION
    + """, shape(kind, ring, sign, seq, dx, dy) AS (VALUES
  (0,0,1,0,0.0,0.0),(0,0,1,1,1.0,0.0),(0,0,1,2,1.0,1.0),(0,0,1,3,0.0,1.0),(0,0,1,4,0.0,0.0),
  (1,0,1,0,0.0,0.0),(1,0,1,1,1.0,0.0),(1,0,1,2,1.0,0.5),(1,0,1,3,0.5,0.5),(1,0,1,4,0.5,1.0),(1,0,1,5,0.0,1.0),(1,0,1,6,0.0,0.0),
  (2,0,1,0,0.0,0.0),(2,0,1,1,1.0,0.0),(2,0,1,2,1.0,1.0),(2,0,1,3,0.0,1.0),(2,0,1,4,0.0,0.0),
  (2,1,-1,0,0.25,0.25),(2,1,-1,1,0.75,0.25),(2,1,-1,2,0.75,0.75),(2,1,-1,3,0.25,0.75),(2,1,-1,4,0.25,0.25)),
 vx AS (SELECT region_id, value, grp, ring, sign, seq, x0 + CAST(dx AS DOUBLE) AS x, y0 + CAST(dy AS DOUBLE) AS y FROM nm JOIN shape ON region_id % 3 = kind),
 ed AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM vx WINDOW w AS (PARTITION BY region_id, ring ORDER BY seq)),
 rg AS (SELECT region_id, ring, any_value(sign) AS sign, abs(sum(x*y2 - x2*y)) / 2 AS a, sum((x+x2)*(x*y2-x2*y)) / 6 * sign(sum(x*y2-x2*y)) AS mx,
        sum((y+y2)*(x*y2-x2*y)) / 6 * sign(sum(x*y2-x2*y)) AS my, sum(sqrt((x2-x)**2 + (y2-y)**2)) AS len FROM ed WHERE x2 IS NOT NULL GROUP BY 1, 2),
 ar AS (SELECT region_id, sum(sign*a) AS area, sum(sign*mx) / sum(sign*a) AS cx, sum(sign*my) / sum(sign*a) AS cy, sum(len) AS perimeter FROM rg GROUP BY 1)"""
)
FLAGS = """fl AS (
  SELECT n.n_nationkey AS region_id, coalesce(c1, 0.0) AS c1, coalesce(c2, 0.0) AS c2, coalesce(c3, 0.0) AS c3
  FROM nation n LEFT JOIN (SELECT c.c_nationkey, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0.0), 2) AS c1,
    round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0.0), 2) AS c2, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0.0), 2) AS c3
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1) v ON n.n_nationkey = v.c_nationkey)"""
POINTS = """pt AS (SELECT DISTINCT user_id AS point_id, 5.0::DOUBLE * ((37 * user_id) % 101) / 101 AS x, 5.0::DOUBLE * ((53 * user_id) % 103) / 103 AS y FROM events)"""
SITES = """st AS (SELECT s_suppkey AS site_id, 5.0::DOUBLE * ((37 * s_suppkey) % 101) / 101 AS x, 5.0::DOUBLE * ((53 * s_suppkey) % 103) / 103 AS y, CAST(1 + s_nationkey AS DOUBLE) AS weight
  FROM supplier ORDER BY s_suppkey LIMIT 10)"""

def order_sums_sql(n: int) -> str:
    return f"oc AS (SELECT CAST(o_orderkey % {n} AS INT) AS k, sum(o_totalprice) / 1e6 AS total, count(*) AS orders FROM orders GROUP BY 1)"


def order_field_sql(cells: str, width: int, height: int) -> str:
    return order_sums_sql(width * height) + f", fd AS (SELECT {cells}.*, coalesce(total, 0.0)::DOUBLE AS vx, 0.1::DOUBLE * coalesce(orders, 0) - 0.3::DOUBLE AS vy FROM {cells} LEFT JOIN oc ON k = iy * {width} + ix)"


#: Width and height of the part map.
PART_BOUNDS = """pb AS (SELECT least(50, max(p_partkey) - min(p_partkey) + 1)::DOUBLE AS w, ((max(p_partkey) - min(p_partkey)) // 50 + 1)::DOUBLE AS h FROM part)"""
