"""Mixing sources to target weights by a low-discrepancy schedule.

Slots of equal numbers of words are dealt to sources by van der Corput points
mapped through cumulative weights, so that every stretch of the schedule is
close to the wanted mix.  A slot's rank within its source picks a block: the
source's documents, in a seeded order, form a stream of words that repeats,
and block r holds its words r * B to (r + 1) * B.  Blocks join the documents
they overlap.

Targets: sources weigh 1, 2, 3, 1, ... in code-point order, nulls last, and
share all words; a target stops at ``most`` times its source's words, and what
is left over goes to the others by weight until none is above.

Defined cases: a null text has no words, and a document without words is never
taken; a null source is a source of its own; equal rows count as often as they
stand; a null id is a key like any other, with the text's digest beside it, so
reruns agree however rows arrive; texts of any length count whole, and blocks
cut them where they fall; an empty table gives an empty result; other columns
travel untouched, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, durable, small_side, unwrapped, wrapped

SEED = 7
#: Words of a block, and slots of a stretch of the schedule, which one task ranks.
BLOCK_WORDS, STRETCH = 1024, 1 << 16
#: Documents whose words one window adds up.
STREAM_ROWS = 4096
#: Parts of the cumulative weights that the points are matched in.
CELLS = 1024


#: The columns that place a row; rows equal in all of them are told apart by their number among these.
PLACE = ["key", "doc_id", "source", "size", "sha"]


def described(seed: int = SEED) -> dict[str, Column]:
    """A document's words, the digest of its text, and its key in the seeded order, which doesn't depend on how rows arrive."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size, sha = F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long"), F.sha2(text, 256)
    return {"size": size, "sha": sha, "key": F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), sha)}


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(row, doc_id, source, size, sha, key): the words of each document and its place in the seeded order."""
    told = described(seed)
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *(c.alias(n) for n, c in told.items()))
    return durable(plain, "sized")


def targets(docs: DataFrame, most: int = 3) -> DataFrame:
    """(source, source_size, weight, target) of each source of ``sized`` rows.

    Sources whose limit lies below their share at the common level are full; with
    sources in the order of limit by weight, the level follows from running sums.
    """
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = sums.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double"))
    limit = (F.lit(most) * F.col("source_size")).cast("double")
    order = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = named.select("*", F.row_number().over(order).alias("n"), (left / share).alias("level"), limit.alias("limit"))
    levels = levels.withColumn("full", F.col("limit") < F.col("weight") * F.col("level"))
    common = F.min(F.when(~F.col("full"), F.struct("n", "level"))).over(whole)["level"]
    return levels.select("source", "source_size", "weight", F.when(F.col("full"), F.col("limit")).otherwise(F.least("limit", F.col("weight") * common)).alias("target"))


def schedule(goals: DataFrame, block: int) -> DataFrame:
    """(slot, source, rank, first, last): each slot takes words first to last of its source's repeating stream.

    There are at least twice as many points as wanted slots, a power of two, so every
    source's interval holds enough of them; those beyond a source's need are passed over.
    """
    named = goals.withColumn("words", F.round("target").cast("long")).where("words > 0").withColumn("need", F.ceil(F.col("words") / block).cast("long"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    spans = named.withColumn("to", F.sum("need").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("from", F.col("to") - F.col("need"))
    spans = durable(spans, "spans")
    total = spans.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    bits = max(1, (2 * total - 1).bit_length()) if total else 1
    width = max(1.0, total / CELLS)
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / width).cast("long"), F.floor((F.col("to") - 1e-9) / width).cast("long"))))
    points = goals.sparkSession.range(1 << bits if total else 0).withColumnRenamed("id", "slot")
    turned = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("double")
    points = points.withColumn("x", turned * total / (1 << bits)).withColumn("cell", F.floor(F.col("x") / width).cast("long"))
    dealt = points.join(small_side(cells), "cell").where("x >= `from` and x < `to`")
    # A source's slots are ranked within stretches of the schedule, and the stretches' numbers added up.
    dealt = dealt.withColumn("stretch", F.floor(F.col("slot") / STRETCH))
    counts = dealt.groupBy("source", "stretch").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    before = before.select(F.col("source").alias("_source"), F.col("stretch").alias("_stretch"), "before")
    local = dealt.withColumn("inner", F.row_number().over(Window.partitionBy("source", "stretch").orderBy("slot")) - 1)
    ranked = local.join(before, (F.col("stretch") == F.col("_stretch")) & F.col("source").eqNullSafe(F.col("_source"))).withColumn("rank", F.col("before") + F.col("inner")).where("rank < need")
    return ranked.select("slot", "source", "source_size", "rank", (F.col("rank") * block).alias("first"), F.least((F.col("rank") + 1) * block, F.col("words")).alias("last"))


def streams(docs: DataFrame) -> DataFrame:
    """``sized`` rows with ``start``: where each document begins in its source's stream.

    Sums run within parts of a source and over the parts, so a source of any size is split.
    """
    parts = max(1, docs.count() // STREAM_ROWS)
    split = docs.withColumn("part", F.pmod("key", F.lit(parts)))
    inner = Window.partitionBy("source", "part").orderBy("key", "doc_id", "sha", "row")
    local = split.withColumn("inner", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    sums = split.groupBy("source", "part").agg(F.sum("size").alias("words"))
    outer = Window.partitionBy("source").orderBy("part")
    offsets = sums.select("source", "part", (F.sum("words").over(outer.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).alias("offset"))
    offsets = offsets.withColumnsRenamed({"source": "_source", "part": "_part"})
    joined = local.join(offsets, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    return joined.withColumn("start", F.col("offset") + F.col("inner")).drop("offset", "inner", "_source", "_part")


def taken(docs: DataFrame, goals: DataFrame, block: int) -> DataFrame:
    """(row, taken, copies) of the documents that the schedule takes: their words, and how often their first word is among them."""
    slots = schedule(goals, block)
    turn = F.explode(F.sequence(F.floor(F.col("first") / F.col("source_size")), F.floor((F.col("last") - 1) / F.col("source_size"))))
    pieces = slots.withColumn("turn", turn).select("source", F.greatest(F.col("first") - F.col("turn") * F.col("source_size"), F.lit(0)).alias("lo"), F.least(F.col("last") - F.col("turn") * F.col("source_size"), F.col("source_size")).alias("hi"))
    cut = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / block), F.floor((F.col(hi) - 1) / block)))
    pieces = pieces.select(F.xxhash64("source").alias("of"), F.col("source").alias("_source"), cut("lo", "hi").alias("block"), "lo", "hi")
    pieces = pieces.select("of", "_source", "block", F.greatest("lo", F.col("block") * block).alias("lo"), F.least("hi", (F.col("block") + 1) * block).alias("hi"))
    held = streams(docs).where("size > 0").withColumn("end", F.col("start") + F.col("size"))
    held = held.select("row", "source", F.xxhash64("source").alias("of"), cut("start", "end").alias("block"), "start", "end")
    met = held.join(pieces, ["of", "block"]).where(F.col("source").eqNullSafe(F.col("_source")))
    overlap = F.greatest(F.lit(0), F.least("end", "hi") - F.greatest("start", "lo"))
    begins = ((F.col("start") >= F.col("lo")) & (F.col("start") < F.col("hi"))).cast("long")
    return met.groupBy("row").agg(F.sum(overlap).cast("long").alias("taken"), F.sum(begins).alias("copies"))


def mix(docs: DataFrame, most: int = 3, seed: int = SEED) -> DataFrame:
    """(row, doc_id, size, source, source_size, target, taken, copies) of every row of ``docs`` (doc_id, text, source)."""
    rows = sized(docs, seed)
    goals = durable(targets(rows, most), "targets")
    used = taken(rows, goals, BLOCK_WORDS)
    named = goals.select(F.col("source").alias("_source"), "source_size", "target")
    out = rows.join(small_side(named), F.col("source").eqNullSafe(F.col("_source"))).join(used, "row", "left")
    return out.select("row", "doc_id", "size", "sha", "source", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("copies", F.lit(0).cast("long")).alias("copies"))


def mixed(docs: DataFrame, most: int = 3, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs``, with all its columns, as often as the schedule takes its first word.

    Of rows equal in id, source and text the first ones take what falls to all of them, so the mix neither
    gains nor loses words by them.
    """
    same = ["doc_id", "source", "sha"]
    uses = mix(docs, most, seed).groupBy(*same).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    uses = durable(uses.where("copies > 0 or rows > 1"), "uses").withColumnsRenamed({"doc_id": "use_id", "source": "use_source", "sha": "use_sha"})
    rows = wrapped(docs, F.col("source").cast("string").alias("source"), described(seed)["sha"].alias("sha")).drop("text")
    met = rows.join(small_side(uses), F.col("doc_id").eqNullSafe(F.col("use_id")) & F.col("source").eqNullSafe(F.col("use_source")) & (F.col("sha") == F.col("use_sha")))
    if uses.where("rows > 1").take(1):
        # Equal rows share their copies: each has the whole part of the mean, and the first of them one more.
        nth = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))
        met = met.where("rows = 1").withColumn("nth", F.lit(1)).unionByName(met.where("rows > 1").withColumn("nth", nth))
    else:
        met = met.withColumn("nth", F.lit(1))
    times = F.floor(F.col("copies") / F.col("rows")) + (F.col("nth") <= F.col("copies") % F.col("rows")).cast("int")
    met = met.withColumn("times", times.cast("int")).where("times > 0")
    return unwrapped(met.withColumn("use", F.explode(F.sequence(F.lit(1), "times"))), docs.columns)
