"""Near-copies by word shingles: SimHash proposes, whole shingle sets decide.

Two texts are alike if their sets of word shingles share ``similarity`` of what
either has.  Groups are the components of all pairs alike, and one row of each
group stays.

Candidates.  SimHash components (BK-trees, see ``simhash``) give the first
ones: each member beside the component's first row.  The others come from a
prefix filter, which is exact: with the shingles of every text in one order,
rare ones first, texts alike share one of the first 1 - ``similarity`` of them.
Round one compares the texts of a shingle, in order of how many prefix shingles
no other text has, each with the one before it and with the first, which joins
most of a large group to what it was copied from; round two compares the rows of
one shingle whose classes still differ, so a group of any size makes no pairs of
its own then.  Shingles with the same first row are gone through in one task, so
texts that share many of them make one pair.  Unlike texts of one origin would: three exact bounds keep most
of their pairs from being built, by sizes, by the shingles that no other text
has, and by sketches (parities of shingles, classed by hash).

Every link is a comparison of whole sets.  ``radius``, the sample that tells
common shingles and the bounds below change the work, never the result.
Shingles are 64-bit hashes.  What is held in memory is bounded: a shingle with
more than its share of rows is cut into blocks, and every pair of blocks is a
piece of work.

Defined cases: null and wordless texts are alike; fewer words than a shingle
make one shingle of all words; of a group the row with the smallest id stays
(nulls last, then the smallest hash of the text; of rows equal in both, one);
rows without an id, and rows that share one, are rows like any other; texts of
any length are read whole, one batch at a time; an empty table gives an empty
result; other columns travel untouched, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, few_at_a_time, give_back, release, small_side, spread_join, unwrapped, worker_cache, wrapped
from .katz import _ODD, _mix, _power_tables, word_hashes
from .simhash import components, grouped

#: Rows, on either side of the pairs that one task compares, whose shingles it holds.
GROUP_ROWS = 1500
#: Rows whose shingles are counted to tell common ones, and the most of them that are told.
SAMPLE_ROWS, COMMON_ROWS = 10_000, 50_000
#: Rows of one shingle in one block; more only where that is less than 4 / BUCKETS of all.
BLOCK_ROWS, BUCKETS = 20_000, 1 << 16
#: Prefix rows that one task of round two holds, and pairs built at once.
TASK_ROWS, STEP = 125_000, 1 << 18
#: Prefix rows of shingles with the same first row that go to one task together.
HEAD_ROWS = 50_000
#: Bits of a text's sketch, a power of two.
SKETCH_BITS = 4096
#: Stands where a text has fewer words than a shingle.
_NONE = np.uint64(1)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, as longs."""
    data = (text or "").encode()
    room = 1 << max(16, len(data).bit_length())
    found = word_hashes(data, worker_cache(("powers", room), lambda: _power_tables(room)) if room <= 1 << 20 else None)
    if len(found) < words:
        found = np.concatenate([found, np.full(words - len(found), _NONE)])
    n = len(found) - words + 1
    out = np.zeros(n, np.uint64)
    for i in range(words):
        out += found[i : i + n] * np.uint64(pow(_ODD, 2 * i + 1, 1 << 64))
    return np.unique(_mix(out)).view(np.int64)


def _fingerprint(held: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(held), STEP):
        ones += np.unpackbits(held[i : i + STEP].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(held)).view(np.int64)[0])


def _sketch(held: np.ndarray) -> bytes:
    """Of each class of shingles by hash, whether their number is odd: two texts differ in as many shingles as in these bits at least."""
    return np.packbits(np.bincount(held & (SKETCH_BITS - 1), minlength=SKETCH_BITS) & 1).tobytes()


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that several rows of a sample have, and in how many they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_at_a_time(batches):
            held = [shingles(x, words) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *held]))], ["token"])

    every = max(1, texts.count() // SAMPLE_ROWS)
    sample = texts.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(every)) == 0)
    seen = sample.select("text").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n"))
    held = seen.where("n > 2").orderBy(F.desc("n"), "token").limit(COMMON_ROWS).toArrow()
    token, n = held.column("token").to_numpy(), held.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def _marks(words: int, similarity: float, common: np.ndarray, times: np.ndarray):
    """Of each text: its SimHash, the number of its shingles, the first of them, rare ones first, and a sketch of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_at_a_time(batches):
            prints, sizes, firsts, sketches = [], [], [], []
            for text in batch.column("text").to_pylist():
                held = shingles(text, words)
                rank = np.zeros(len(held), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, held), len(common) - 1)
                    rank = np.where(common[at] == held, times[at], 0)
                keep = len(held) - math.ceil(similarity * len(held) - 1e-9) + 1
                firsts.append(held[np.lexsort((held, rank))[:keep]])
                prints.append(_fingerprint(held))
                sizes.append(len(held))
                sketches.append(_sketch(held))
            ends = np.cumsum([0, *map(len, firsts)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *firsts])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sha"), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), lists, pa.array(sketches, pa.binary())], ["doc_id", "sha", "fingerprint", "size", "tokens", "sketch"])

    return run


def _frequent(tokens: DataFrame) -> DataFrame:
    """(token, parts): shingles with more rows than a block, in a list that stays under BUCKETS / 4."""
    buckets = tokens.groupBy(F.pmod("token", F.lit(BUCKETS)).alias("bucket")).count()
    total = buckets.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    most = max(BLOCK_ROWS, -(-4 * total // BUCKETS))
    full = [x.bucket for x in buckets.where(F.col("count") > most).collect()]
    counts = tokens.where(F.pmod("token", F.lit(BUCKETS)).isin(full)).groupBy("token").count()
    return durable(counts.where(F.col("count") > most).select("token", F.ceil(F.col("count") / most).cast("int").alias("parts")), "frequent")


def _prefix(similarity: float, size: str):
    """First shingles of a text, of which texts alike share some."""
    return F.col(size) - F.ceil(similarity * F.col(size) - 1e-9) + 1


def _overlap(similarity: float, x: Column, y: Column) -> Column:
    """Shingles that texts alike of these sizes share at least."""
    return similarity / (1 + similarity) * (x + y)


def _bytes_of(values: pa.BinaryArray) -> np.ndarray:
    """The bytes of all values, one after the other; none is null."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[ends[0] : ends[-1]]


def _across(similarity: float):
    """(a, b, n, need): the pairs of rows that share pieces, whose classes differ, and whose sizes, sketches and shingles of their own allow them to be alike.

    A piece is a shingle of both prefixes.  A row's sketch stands in one of its entries in the task at least, else null.  ``n``: pieces of this task that the two share; ``need``:
    shingles of both prefixes that they share at least; what two texts share lies in both prefixes,
    or behind the prefix that ends first.  Pieces of the same rows are gone through once, and a task
    tells a pair once, unless it has more than STEP of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        piece, kind, size, most, row, side = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("piece", "kind", "size", "most", "row", "side"))
        order = np.lexsort((row, size, kind, piece))
        # Row by row from here: ``place`` tells which of the distinct rows an entry is.
        row, index, place = np.unique(row, return_index=True, return_inverse=True)
        sketch = rows.column("sketch")
        known, first = np.unique(rows.column("row").to_numpy()[sketch.is_valid().to_numpy()], return_index=True)
        bits = np.concatenate([_bytes_of(x) for x in sketch.drop_null().chunks]).reshape(-1, SKETCH_BITS // 8)[first[np.searchsorted(known, row)]].view(np.uint64)
        kind, size, most = kind[index], size[index], most[index]
        place, side, piece = place[order], side[order].astype(np.int64), piece[order]
        del held, rows, sketch, known, first
        turns = np.append(np.flatnonzero(piece[1:] != piece[:-1]) + 1, len(piece))
        times, seen, members = np.zeros(len(turns), np.int64), {}, place * 3 + side
        for i, (start, end) in enumerate(zip([0, *turns[:-1].tolist()], turns.tolist(), strict=True)):
            times[seen.setdefault(members[start:end].tobytes(), i)] += 1
        del seen, members
        many = np.diff(turns, prepend=0)
        kept = np.repeat(times > 0, many)
        place, side, many, times = place[kept], side[kept], many[times > 0], times[times > 0]
        n = len(place)
        piece, times, piece_end = np.repeat(np.arange(len(many)), many), np.repeat(times, many), np.repeat(np.cumsum(many), many)
        turns = np.append(np.flatnonzero((piece[1:] != piece[:-1]) | (kind[place[1:]] != kind[place[:-1]])) + 1, n)
        class_end = np.repeat(turns, np.diff(turns, prepend=0))
        many = piece_end - class_end
        ends = np.cumsum(many)

        def summed(pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pair, which = np.unique(pair, return_inverse=True)
            return pair, np.bincount(which, n, len(pair)).astype(np.int64)

        def told(pair: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            one, two = pair // len(row), pair % len(row)
            low, high = np.minimum(size[one], size[two]), np.maximum(size[one], size[two])
            need = similarity / (1 + similarity) * (low + high) - np.ceil(similarity * high - 1e-9) + 1 - 1e-6
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(row[one], row[two])), pa.array(np.maximum(row[one], row[two])), pa.array(n), pa.array(need)], ["a", "b", "n", "need"])

        at, found = 0, (np.empty(0, np.int64), np.empty(0, np.int64))
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, side="right")))
            one = np.repeat(np.arange(at, to), many[at:to])
            begin = ends[at:to] - many[at:to] - (ends[at - 1] if at else 0)
            two = np.arange(len(one)) - np.repeat(begin, many[at:to]) + class_end[one]
            at = to
            fit = (side[one] != side[two]) | (side[one] == 2)
            one, two, count = place[one[fit]], place[two[fit]], times[one[fit]]
            low, high = np.minimum(size[one], size[two]), np.maximum(size[one], size[two])
            fit = (low >= similarity * high - 1e-9) & (np.minimum(most[one], most[two]) >= similarity / (1 + similarity) * (low + high) - 1e-6)
            # Entries of a piece lie by class, size and row, so a pair has one order in all pieces.
            pair, count = summed(one[fit] * len(row) + two[fit], count[fit])
            one, two = pair // len(row), pair % len(row)
            apart = np.zeros(len(pair), np.int64)
            for i in range(0, len(pair), STEP // 16):
                apart[i : i + STEP // 16] = np.bitwise_count(bits[one[i : i + STEP // 16]] ^ bits[two[i : i + STEP // 16]]).sum(axis=1, dtype=np.int64)
            both = size[one] + size[two]
            fit = (both - apart) / 2 >= similarity / (1 + similarity) * both - 1e-6
            found = summed(np.concatenate([found[0], pair[fit]]), np.concatenate([found[1], count[fit]]))
            if len(found[0]) > STEP:
                yield told(*found)
                found = found[0][:0], found[1][:0]
        yield told(*found)
        del place, side, piece, kind, size, most, row, order, bits
        give_back()

    return run


def _alike(similarity: float):
    """Of the pairs of two blocks: a spanning forest of those alike by their shingle sets."""
    shape = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(pairs: pa.Table, held: pa.Table) -> pa.Table:
        sets = {i: np.frombuffer(x, np.int64) for i, x in zip(held.column("row").to_pylist(), held.column("shingles").to_pylist(), strict=True)}

        def alike(x: np.ndarray, y: np.ndarray) -> bool:
            if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
                return False
            same = len(np.intersect1d(x, y, assume_unique=True))
            return same >= similarity * (len(x) + len(y) - same) - 1e-9

        above: dict[int, int] = {}

        def top(i: int) -> int:
            while (j := above.get(i, i)) != i:
                above[i] = i = above.get(j, j)
            return i

        out = []
        for a, b in sorted(zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True)):
            # What is already one class needs no comparison.
            if (x := top(a)) != (y := top(b)) and alike(sets[a], sets[b]):
                above[max(x, y)] = min(x, y)
                out.append((a, b))
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], schema=shape)

    return run


def _verified(texts: DataFrame, marks: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges (a, b) whose components are those of all ``pairs`` of rows that are alike.

    Rows are dealt over blocks, and each pair goes to the task of its two blocks with the shingles of both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_at_a_time(batches):
            held = [shingles(x, words).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(held, pa.binary())], ["row", "shingles"])

    pairs = durable(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    # A text is fetched by its id and digest, so rows equal in both share one.
    paired = durable(marks.select("row", "doc_id", "sha").join(ids, "row"), "paired")
    n = paired.count()
    wanted = paired.groupBy("doc_id", "sha").agg(F.min("row").alias("row"))
    fetched = texts.join(small_side(wanted, n), texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["sha"] == wanted["sha"])).select("row", "text")
    sets = durable(fetched.mapInArrow(run, "row long, shingles binary").dropDuplicates(["row"]), "shingles")
    named = paired.select("row", F.min("row").over(Window.partitionBy("doc_id", "sha")).alias("like"))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(max(1, -(-n // GROUP_ROWS)))).alias("i" if c == "a" else "j")
    dealt = pairs.select("a", "b", block("a"), block("b"))
    needs = dealt.select("i", "j", F.explode(F.array("a", "b")).alias("row")).distinct()
    needs = needs.join(small_side(named, n), "row").withColumnsRenamed({"row": "of", "like": "row"})
    held = needs.join(sets, "row").select(F.col("i").alias("p"), F.col("j").alias("q"), F.col("of").alias("row"), "shingles")
    return durable(dealt.groupBy("i", "j").cogroup(held.groupBy("p", "q")).applyInArrow(_alike(similarity), "a long, b long"), "verified")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """(row, doc_id, sha, first_id, first_sha, first): the rows of ``docs`` (doc_id, text) that are in a group with others.

    ``row`` numbers the rows; ``first`` tells the one that stays, which ``first_id`` and ``first_sha`` name.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("sha", F.sha2("text", 256))
    found = texts.mapInArrow(_marks(words, similarity, *_common(texts, words)), "doc_id long, sha string, fingerprint long, size long, tokens array<long>, sketch binary")
    marks = durable(found.withColumn("row", F.monotonically_increasing_id()), "marks")
    tokens = marks.select("row", F.explode("tokens").alias("token"))
    frequent, keys, others = _frequent(tokens), ["token"], F.lit(False)
    if frequent.take(1):  # rows of a very frequent shingle are compared with neighbours in several chains; one alone in its chain has others still
        tokens, keys = tokens.join(F.broadcast(frequent), "token", "left").withColumn("salt", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1)))), ["token", "salt"]
        others = F.col("parts").isNotNull()
    order = Window.partitionBy(*keys).orderBy("row")
    beside = tokens.withColumns({"before": F.lag("row").over(order), "after": F.lead("row").over(order)})
    met = durable(beside.where(F.col("before").isNotNull() | F.col("after").isNotNull() | others).select(*keys, "row"), "met")
    # Only shingle and row are moved; sizes join what is left.  A prefix shingle that no other row has can't be shared.
    sizes = marks.select("row", "size").join(met.groupBy("row").agg(F.count("*").alias("n")), "row")
    alone = F.least(F.col("size"), _prefix(similarity, "size")) - F.col("n")
    sizes = durable(sizes.select("row", "size", (F.col("size") - alone).alias("most")), "sizes")
    shared = durable(met.join(small_side(sizes), "row"), "shared")
    release(met)

    # Fewest shingles of its own first: what most rows of a shingle were copied from is at the head.
    order = Window.partitionBy(*keys).orderBy(F.col("size") - F.col("most"), "row")
    one = F.struct("row", "size", "most")
    beside = shared.select(one.alias("x"), F.array(F.first(one).over(order), F.lag(one).over(order)).alias("ys")).select("x", F.explode("ys").alias("y"))
    low, high = F.least("x.size", "y.size"), F.greatest("x.size", "y.size")
    fit = (low >= similarity * high - 1e-9) & (F.least("x.most", "y.most") >= _overlap(similarity, low, high) - 1e-6)
    beside = beside.where("x.row <> y.row").where(fit).groupBy(F.col("x.row").alias("a"), F.col("y.row").alias("b"))
    beside = beside.agg(F.count("*").alias("n"), F.min(_overlap(similarity, low, high) - F.ceil(similarity * high - 1e-9)).alias("need"))
    near = grouped(marks.select("row", "doc_id", "fingerprint"), radius).select(F.col("row").alias("a"), F.col("first_row").alias("b"))
    first = _verified(texts, marks, near.unionByName(beside.where(F.col("n") >= 0.25 * F.col("need")).select("a", "b")), words, similarity)

    kinds = durable(components(first).select(F.col("node").alias("row"), F.col("root").alias("kind")), "classes")
    told = shared.select("token", "row", "size", "most").join(small_side(kinds), "row", "left").withColumn("kind", F.coalesce("kind", "row"))
    mixed = told.groupBy("token").agg(F.min("kind").alias("low"), F.max("kind").alias("high"), F.min("size").alias("least"), F.min("row").alias("head"), F.count("*").alias("n")).where("low <> high").select("token", "least", "head", "n")
    mixed = durable(mixed.join(F.broadcast(frequent), "token", "left").select("token", "least", "head", "n", F.coalesce("parts", F.lit(1)).alias("parts")), "mixed")
    work = mixed.agg(F.coalesce(F.sum(F.col("n") * F.col("parts")), F.lit(0))).first()[0]
    # Shingles with the same first row go to one task, where a pair that shares many of them is one row; a task's worth of them is dealt over several.
    crowded = mixed.groupBy("head").agg(F.sum("n").alias("rows")).where(F.col("rows") > HEAD_ROWS).select("head", F.ceil(F.col("rows") / HEAD_ROWS).cast("int").alias("cuts"))
    homed = mixed.join(F.broadcast(crowded), "head", "left").select("token", "least", "n", "parts", F.xxhash64("head", F.pmod(F.xxhash64("token"), F.coalesce("cuts", F.lit(1)))).alias("home"))
    # Rows that could share enough with none of the shingle's rows, not even with the smallest, have no pair there.
    held = spread_join(told, homed, ["token"], "n", "row").where(F.col("most") >= _overlap(similarity, F.col("size"), F.greatest("least", similarity * F.col("size"))) - 1e-6)
    held = held.withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    side = F.when(low == high, 2).when(F.col("part") == low, 0).otherwise(1).alias("side")
    piece = F.xxhash64("token", low, high)
    held = held.select(F.when(F.col("parts") > 1, piece).otherwise(F.col("home")).alias("home"), "row", "size", "most", "kind", F.struct(piece.alias("piece"), side).alias("entry"))
    # A sketch travels once for each row and home.
    held = held.repartition("row").groupBy("row", "home", "size", "most", "kind").agg(F.collect_list("entry").alias("entries")).join(marks.select("row", "sketch"), "row")
    held = held.select("home", "row", "size", "most", "kind", "sketch", F.posexplode("entries").alias("at", "entry"))
    held = held.select("home", "entry.piece", "row", "size", "most", "kind", F.when(F.col("at") == 0, F.col("sketch")).alias("sketch"), "entry.side")
    held = held.repartition(max(12, work // TASK_ROWS), "home").drop("home")
    found = held.mapInArrow(_across(similarity), "a long, b long, n long, need double").groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need"))
    second = _verified(texts, marks, found.where("n >= need").select("a", "b"), words, similarity)

    nodes = durable(components(first.unionByName(second)), "groups")
    named = marks.select("row", "doc_id", "sha").join(small_side(nodes.withColumnRenamed("node", "row")), "row")
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha", "row")).alias("lowest")
    firsts = durable(named.groupBy("root").agg(lowest, F.count("*").alias("n")), "firsts")
    out = spread_join(named, firsts, ["root"], "n", "row")
    return out.select("row", "doc_id", "sha", F.col("lowest.doc_id").alias("first_id"), F.col("lowest.sha").alias("first_sha"), (F.col("row") == F.col("lowest.row")).alias("first"))


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` of which no smaller row is a near copy, with all their columns."""
    gone = durable(similar_groups(docs, words, similarity, radius).where("not first"), "near")
    again = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("sha") == F.col("first_sha"))
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("sha")
    rows = wrapped(docs, sha).drop("text")
    dropped = small_side(gone.where(~again).select(F.col("doc_id").alias("gone_id"), F.col("sha").alias("gone_sha")).distinct())
    kept = rows.join(dropped, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("sha") == F.col("gone_sha")), "left_anti")
    if gone.where(again).take(1):  # rows equal in id and text to one that stays
        kept = kept.dropDuplicates(["doc_id", "sha"])
    return unwrapped(kept, docs.columns)
