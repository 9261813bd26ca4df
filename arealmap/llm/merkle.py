"""A Merkle manifest of a table: a tree of digests over each group's rows, and one over the groups.

Level by level: nodes are partitioned by group and parent index, an ordered window
over each whole run collects its digests once, and these are both what the parent
hashes and what its children need as siblings; one row of each run goes on to the
next level.  Runs hold ``fanout`` digests at most, so a group with a third of all
rows is spread over as many keys as it has runs.  Rows get their places from one
range shuffle: they are numbered inside each range, and the ranges' counts shift
the numbers, so no group passes through one task.

The way of a leaf to the root is handed down again from the top: each run's way
once, to its own children.

Defined cases: a null field is written ``-``, which no value can be, an empty text
``0:``; null groups are one group, before all others; rows of one group go by key,
null keys first, and rows of one key by digest, so equal rows have equal digests
and either order gives the same tree; a group of one row has that row's digest as
its root; an empty table gives an empty result.  Texts are only read to be hashed,
one at a time.  Columns that aren't asked for are ignored, whatever they are called.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_of, durable, small_side

#: Fields of a document in the order in which its leaf has them, and children of a node.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field with its length in bytes before it."""
    text = [x.cast("string") for x in fields]
    return digest(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in text))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way lead to."""
    return F.aggregate(path, start, lambda h, x: digest(x["left"], h, x["right"]))


def siblings(path: Column) -> Column:
    """The digests beside a way, level by level, left to right, in one text."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def _step(at: Column, fanout: int) -> Column:
    """What stands left and right of place ``at`` in a run's children."""
    side = lambda start, n: F.array_join(F.slice("children", start, n), "")
    return F.struct(side(F.lit(1), at).alias("left"), side(at + 2, F.lit(fanout)).alias("right"))


WAY = "array<struct<left:string,right:string>>"


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``idx`` from 0 and ``n``, in and of the group that ``order`` begins with, of rows in that order."""
    group, by = order[0], [F.col(c).asc_nulls_first() for c in order]
    placed = durable(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    counted = placed.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = durable(counted.select(group, "_range", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n")), "shifts")
    return placed.join(small_side(shifts), [group, "_range"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def tree(nodes: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """Of (grp, idx, n, digest): each level's runs (grp, run, n, children), and (grp, digest) of the roots."""
    levels, held, roots = [], nodes.select("grp", "idx", "n", "digest"), []
    most = held.agg(F.max("n")).first()[0] or 0
    run = Window.partitionBy("grp", "run").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    while True:
        roots.append(held.where("n = 1").select("grp", "digest"))
        if most <= 1:
            return levels, reduce(DataFrame.unionByName, roots)
        members = held.where("n > 1").withColumn("run", F.expr(f"idx div {fanout}"))
        runs = members.withColumn("children", F.collect_list("digest").over(run)).where(f"idx % {fanout} = 0").select("grp", "run", "n", "children")
        levels.append(durable(runs, "runs"))
        held = levels[-1].select("grp", F.col("run").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), digest(F.array_join("children", "")).alias("digest"))
        most = -(-most // fanout)


def ways(nodes: DataFrame, levels: list[DataFrame], above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``nodes`` beside their ``path``, leaf to root; ``above`` has (grp, path, ...): the way on from each group's root."""
    more = [c for c in above.columns if c not in ("grp", "path")]

    def placed(rows: DataFrame, at: str, held: DataFrame | None, last: Column) -> DataFrame:
        """Rows of groups that end here go on with ``above``, others with their run on the level above."""
        out = rows.where(last).join(above, "grp")
        if held is None:
            return out
        inner = rows.where(~last).withColumn("_run", F.expr(f"{at} div {fanout}")).join(held, (F.col("grp") == F.col("_grp")) & (F.col("_run") == F.col("_parent")))
        step = F.concat(F.array(_step(F.expr(f"int({at} % {fanout})"), fanout)), F.col("upper"))
        return out.unionByName(inner.withColumn("path", step.cast(WAY)).select(*rows.columns, "path", *more))

    upper = None
    for runs in reversed(levels):
        found = placed(runs.withColumnRenamed("children", "own"), "run", upper, F.col("n") <= fanout)
        upper = found.select(F.col("grp").alias("_grp"), F.col("run").alias("_parent"), F.col("own").alias("children"), F.col("path").alias("upper"), *more)
    return placed(nodes, "idx", upper, F.col("n") == 1)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", fanout: int = FANOUT, **carried: Column) -> DataFrame:
    """(key, group, leaf, idx, n, path, subroot, root, and ``carried``) of every row of ``docs``.

    ``path`` is an array of (left, right): the digests beside the way from the leaf over
    its group's root to the root of all.  ``carried`` are columns made of the row itself.
    """
    if fanout < 2:
        raise ValueError("a node has two children at least")
    # No text is empty here, so the null group comes first and is equal to itself in joins.
    grp = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), grp.alias("grp"), leaf([F.col(f"`{f}`") for f in fields]).alias("digest"), *(c.alias(f"own_{k}") for k, c in carried.items()))
    nodes = ranked(durable(rows, "leaves"), ["grp", "key", "digest"])
    levels, subroots = tree(nodes, fanout)
    tops = ranked(durable(subroots, "subroots").select(F.lit("").alias("all"), "grp", "digest"), ["all", "grp"])
    tops = tops.select(F.col("grp").alias("of"), F.col("all").alias("grp"), "idx", "n", "digest")
    higher, root = tree(tops, fanout)
    above = ways(tops, higher, root.select("grp", F.array().cast(WAY).alias("path"), F.col("digest").alias("root")), fanout)
    above = durable(above.select(F.col("of").alias("grp"), "path", F.col("digest").alias("subroot"), "root"), "above")
    out = ways(nodes, levels, above, fanout)
    named = F.when(F.col("grp") != "", F.expr("substring(grp, 2)"))
    return out.select("key", named.alias("group"), F.col("digest").alias("leaf"), "idx", "n", "path", "subroot", "root", *(F.col(f"own_{k}").alias(k) for k in carried))


def lowered(text: str = "text") -> Column:
    """A-Z in lower case; nulls stay."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.col(text).cast("string"), letters, letters.lower())


def proven(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The manifest of documents, and whether it tells rows that were tampered with: those whose id's crc32 5 divides, in lower case."""
    changed = leaf([lowered() if f == "text" else F.col(f) for f in FIELDS])
    held = manifest(docs, fanout=fanout, changed=F.when(crc32_of("doc_id") % 5 == 0, changed))
    folded = held.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    return folded.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of a text, bit by bit."""
    bits = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda d, e: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"CASE WHEN {text} = '' THEN 0 ELSE xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: {bits}), 4294967295) END"


def sql() -> str:
    """``proven`` in SQL: one recursion up the groups' trees, one up the tree of their roots, and one along each row's way."""
    field = lambda f: f"coalesce(CAST(octet_length(encode(CAST({f} AS VARCHAR))) AS VARCHAR) || ':' || CAST({f} AS VARCHAR), '-')"
    code = lambda text: "sha256(" + " || ".join(field(text if f == "text" else f) for f in FIELDS) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    up = lambda base: f"SELECT 0 AS lvl, g, i, d, n FROM {base} UNION ALL SELECT lvl + 1, g, i // {FANOUT}, sha256(string_agg(d, '' ORDER BY i)), (n + {FANOUT - 1}) // {FANOUT} FROM tree WHERE n > 1 GROUP BY lvl, g, i // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}"
    # One digest in another's place changes the run's digest; the rest of the run is its siblings.
    way = lambda tree: f"""SELECT w.row, w.lvl + 1, w.g, w.i // {FANOUT}, sha256(string_agg(CASE WHEN t.i = w.i THEN w.h ELSE t.d END, '' ORDER BY t.i)),
    w.p || coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i <> w.i), '') FROM w JOIN {tree} t ON t.lvl = w.lvl AND t.g = w.g AND t.i // {FANOUT} = w.i // {FANOUT}
    WHERE t.n > 1 GROUP BY w.row, w.lvl, w.g, w.i, w.h, w.p"""  # noqa: E731
    return f"""
WITH RECURSIVE l AS (SELECT doc_id, source, {code("text")} AS d, CASE WHEN crc % 5 = 0 THEN {code("low")} END AS c
  FROM (SELECT *, {low} AS low, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} AS crc FROM documents)),
a AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, d) AS row, coalesce('=' || source, '') AS g FROM l),
b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY row) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM a),
s AS (WITH RECURSIVE tree AS ({up("b")}) SELECT * FROM tree),
q AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, d, g AS of FROM s WHERE n = 1),
t AS (WITH RECURSIVE tree AS ({up("q")}) SELECT * FROM tree),
x AS (WITH RECURSIVE w AS (SELECT row, 0 AS lvl, g, i, coalesce(c, d) AS h, '' AS p FROM b UNION ALL {way("s")}) SELECT row, g, arg_max(h, lvl) AS h, arg_max(p, lvl) AS p FROM w GROUP BY row, g),
y AS (WITH RECURSIVE w AS (SELECT x.row, 0 AS lvl, q.g, q.i, x.h, x.p FROM x JOIN q ON q.of = x.g UNION ALL {way("t")}) SELECT row, arg_max(h, lvl) AS h, arg_max(p, lvl) AS p FROM w GROUP BY row),
r AS (SELECT d AS root FROM t WHERE n = 1)
SELECT b.doc_id, b.d AS leaf, q.d AS subroot, root, sha256(y.p) AS proof_sha256, y.h AS folded_root, y.h = root AS verified FROM b JOIN q ON q.of = b.g JOIN y USING (row), r
"""
