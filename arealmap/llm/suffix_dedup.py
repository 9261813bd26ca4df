"""Removal of long repeated strings with a Burrows-Wheeler transform.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier:
in a document of a smaller id, or earlier in its own.  Strings never cross
documents and are judged on the input.

How the work is cut.  Equal documents are found by digest; only the first of
each needs a search.  Winnowing then picks anchors: the least hash among the
``GRAM``-byte strings of each window of ``LENGTH`` bytes.  Equal strings have
equal anchors at equal places, so every repeated string lies around an anchor
whose hash repeats, and all its occurrences meet where that hash is sent.  Of
anchors of one chunk of documents whose whole surroundings are equal only the
earliest goes there: what is around the others starts earlier for certain.

What happens there.  The surroundings of a shard's repeated anchors, each
distinct one once, become one text with separators, and its Burrows-Wheeler
transform.  From the longest prefixes known from sorting, all intervals of
suffixes that share a prefix are extended to the left by every character that
precedes them, breadth first, so prefixes come in order of length; intervals
of one suffix are dropped, separators are never prepended, and the expansion
stops at LENGTH characters.  The intervals that are left are the repeated strings.

An anchor that stands in more than ``HOT`` places even so does not go to one
shard: the strings around it are rows of their own, by 128 bits of hash, and
their first places are minima by string, combined within each task.

Defined cases: a null text counts as empty; texts under LENGTH bytes keep all;
null ids come after all others; of equal rows with one id one is the first, and
rows with one id and different texts are ordered by a hash of the text; a text
of any length is searched whole, by one task, with some forty bytes of memory
for each of its own; an empty table gives an empty result; other columns are
ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, durable, spread_join
from .katz import _mix, _narrow, _pack, _power_tables, _unpack

LENGTH, GRAM = 100, 48
#: Places in a window of LENGTH bytes at which a gram can start.
WINDOW = LENGTH - GRAM + 1
#: Places of an anchor, after equal surroundings of a chunk are one, beyond which its strings are rows of their own.
HOT = 65_536
#: Bytes of text in a chunk.
CHUNK_BYTES = 32 << 20
#: Anchors of a hash partition, bytes of a shard of surroundings, characters of one transform.
PARTITION_ANCHORS, SHARD_BYTES, TRANSFORM = 1_500_000, 16 << 20, 1 << 20
#: Bytes of text in a bucket of the table of texts, and the least and the most such buckets.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 32 << 20, 12, 100_000
NONE = (1 << 63) - 1
_VALUES = np.random.default_rng(17).integers(1, 2**63, (3, 256), dtype=np.uint64) | np.uint64(1)


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every window, by doubling."""
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def _hashes(data: np.ndarray, powers: tuple[np.ndarray, np.ndarray], width: int, table: int = 0) -> np.ndarray:
    """64-bit hashes of all strings of a width; tables are independent of each other."""
    up, down = powers
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[table][data] * up[: len(data)], dtype=np.uint64)])
    return _mix((sums[width:] - sums[:-width]) * down[: len(data) - width + 1])


def anchors(data: np.ndarray, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are least in some window of LENGTH bytes; equals all count."""
    if len(data) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = _hashes(data, powers, GRAM)
    least = _slide(hashes, WINDOW, np.minimum)
    edge = np.zeros(WINDOW - 1, np.uint64)
    places = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), WINDOW, np.maximum) == hashes)
    return places, hashes[places]


def repeated_strings(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places in the texts, laid end to end with one separator after each, where a string of ``length``
    starts that starts elsewhere too, and the number of its class.

    Suffixes are sorted by doubling prefixes, a little past ``length``.  The last depth on the way gives the
    first intervals; the transform's steps to the left then carry them from each prefix to those longer by one.
    """
    sizes = np.array([len(x) + 1 for x in texts])
    ends = np.cumsum(sizes)
    text = np.zeros(int(ends[-1]) if len(texts) else 0, np.uint16)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    n, step, depth, ranks = len(text), min(7, length), 0, np.zeros(len(text), np.int32)
    padded = np.concatenate([text, np.zeros(step, np.uint16)])
    key = np.zeros(n, np.int64)
    for i in range(step):
        key = key << 9 | padded[i : i + n]
    while n:
        order = np.argsort(key).astype(np.int32)
        if step > length:
            break
        key = key[order]
        depth = step
        ranks[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]), dtype=np.int32)
        if ranks[order[-1]] == n - 1:
            n = 0
            break
        key = ranks.astype(np.int64)
        key *= n + 1
        if step < n:
            key[:-step] += ranks[step:]
            key[:-step] += 1
        step *= 2
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    before = text[order - 1]  # the transform
    turn = np.argsort(before, kind="stable").astype(np.int32)
    to_left = np.empty(n, np.int32)
    to_left[turn] = np.arange(n, dtype=np.int32)
    heads = before[turn]

    def repeats(at: np.ndarray, old: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbouring places of one origin and one first character are one interval; those of one suffix go."""
        begins = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (old[1:] != old[:-1]) | (head[1:] != head[:-1])])
        sizes = np.diff(np.append(np.flatnonzero(begins), len(at)))
        stay = sizes > 1
        return at[np.repeat(stay, sizes)], np.repeat(np.arange(stay.sum(), dtype=np.int32), sizes[stay])

    # Prefixes that reach a separator are none.
    room = np.repeat(ends, sizes) - 1 - np.arange(n)
    at = np.flatnonzero(room[order] >= depth)
    if len(at):
        at, group = repeats(at, ranks[order[at]], np.zeros(len(at), np.uint16))
    flag, names = np.zeros(n, bool), np.empty(n, np.int32)
    for _ in range(length - depth):
        if not len(at):
            break
        more = before[at] != 0
        moved = to_left[at[more]]
        flag[moved], names[moved] = True, group[more]
        at = np.flatnonzero(flag)
        flag[at] = False
        if len(at):
            at, group = repeats(at, names[at], heads[at])
    return (order[at].astype(np.int64), group) if len(at) else (np.empty(0, np.int64), np.empty(0, np.int64))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts of up to ``CHUNK_BYTES`` together, or one larger text, in order of id and key."""
    held, size = [], 0
    for batch in batches:
        for d, key, text in zip(*(batch.column(c).to_pylist() for c in ("d", "key", "text")), strict=True):
            data = text.encode()
            if held and size + len(data) > CHUNK_BYTES:
                yield sorted(held, key=lambda x: x[:2])
                held, size = [], 0
            held.append((d, key, data))
            size += len(data)
    if held:
        yield sorted(held, key=lambda x: x[:2])


def _around(place: np.ndarray, size) -> tuple[np.ndarray, np.ndarray]:
    """Where the bytes begin and end that a repeated string with an anchor at ``place`` can take."""
    return np.maximum(place - WINDOW + 1, 0), np.minimum(place + LENGTH, size)


def _chunk_anchors(held: list[tuple[int, int, bytes]]):
    """(document, place, hash) of a chunk's anchors, each in its first surroundings only; and (document, lo, hi), starts of strings of the
    other anchors: the very same bytes stand earlier in this chunk, so these strings start earlier too."""
    powers = _power_tables(max(len(x[2]) for x in held) + 1)
    docs, places, values, contexts, begins, ends = [], [], [], [], [], []
    for k, (_, _, text) in enumerate(held):
        data = np.frombuffer(text, np.uint8)
        place, value = anchors(data, powers)
        begin, end = _around(place, len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[1][data] * powers[0][: len(data)], dtype=np.uint64)])
        shape = ((place - begin) << 32 | (end - begin)).astype(np.uint64)
        contexts.append(_mix((sums[end] - sums[begin]) * powers[1][begin] ^ _mix(shape ^ value)))
        docs.append(np.full(len(place), k))
        places.append(place)
        values.append(value)
        begins.append(begin)
        ends.append(end)
    doc, place, value, context, begin, end = map(np.concatenate, (docs, places, values, contexts, begins, ends))
    order = np.argsort(context, kind="stable")  # documents are in order, so the first of equal ones is the earliest
    fresh = np.concatenate([[True], context[order][1:] != context[order][:-1]])[: len(order)]
    first = np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    lead = first == np.arange(len(order))
    for i in np.flatnonzero(~lead).tolist():
        j = first[i]
        # Equal hashes of other bytes would be leads of their own.
        lead[i] = held[doc[i]][2][begin[i] : end[i]] != held[doc[j]][2][begin[j] : end[j]]
    rest = np.flatnonzero(~lead & (end - begin >= LENGTH))
    return (doc[lead], place[lead], value[lead]), (doc[rest], begin[rest], end[rest] - LENGTH)


_PLACES = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("docs", pa.binary()), ("body", pa.binary())])
PLACES = "part int, chunk long, docs binary, body binary"


def _send(parts: int):
    """Anchors of each chunk of documents, one block for each hash partition, and one block with the chunk's documents and what is decided already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, held in enumerate(_chunks(batches)):
            chunk = task << 32 | number
            (doc, place, value), spans = _chunk_anchors(held)
            part = (value >> np.uint64(40)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
            docs = _pack(np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64), *map(_narrow, spans))
            yield pa.RecordBatch.from_pylist([{"part": chunk % parts, "chunk": chunk, "docs": docs, "body": None}], _PLACES)
            for p, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if lo < hi:
                    mine = order[lo:hi]
                    yield pa.RecordBatch.from_pylist([{"part": p, "chunk": chunk, "docs": None, "body": _pack(value[mine], _narrow(doc[mine]), _narrow(place[mine]))}], _PLACES)

    return run


def _repeated(hot: int):
    """Of one hash partition, the anchors that stand in more than one place, back to their chunks; whether these are more than ``hot``."""

    def run(rows: pa.Table) -> pa.Table:
        out = [x for x in rows.to_pylist() if x["docs"] is not None]
        sent = rows.filter(pc.is_valid(rows.column("body")))
        if not sent.num_rows:
            return pa.Table.from_pylist(out, _PLACES)
        blocks = [_unpack(x) for x in sent.column("body").to_pylist()]
        values = np.concatenate([x[0] for x in blocks])
        order = np.argsort(values, kind="stable")
        fresh = np.concatenate([[True], values[order][1:] != values[order][:-1]])
        sizes = np.diff(np.append(np.flatnonzero(fresh), len(values)))
        count = np.empty(len(values), np.int64)
        count[order] = np.repeat(sizes, sizes)
        at = 0
        for chunk, (own, doc, place) in zip(sent.column("chunk").to_pylist(), blocks, strict=True):
            n = count[at : at + len(own)]
            at += len(own)
            if len(x := np.flatnonzero(n > 1)):
                out.append({"part": 0, "chunk": chunk, "docs": None, "body": _pack(doc[x], place[x], (n[x] > hot).astype(np.uint8))})
        return pa.Table.from_pylist(out, _PLACES)

    return run


_FOUND = pa.schema([("d", pa.int64()), ("key", pa.int64()), ("places", pa.binary()), ("n", pa.int64()), ("hot", pa.int64()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32()))])
FOUND = "d long, key long, places binary, n long, hot long, lo array<int>, hi array<int>"


def _by_document(rows: pa.Table) -> pa.Table:
    """The repeated anchors of a chunk, and what is decided already, one row per document that has any."""
    ids, keys, *spans = _unpack(next(x for x in rows.column("docs").to_pylist() if x is not None))
    blocks = [_unpack(x) for x in rows.column("body").to_pylist() if x is not None]
    wide = lambda parts: np.concatenate([np.empty(0, np.int64), *(np.asarray(x, np.int64) for x in parts)])
    doc, place, hot = (wide(x[i] for x in blocks) for i in range(3))
    order = np.lexsort((place, doc))
    doc, place, hot = doc[order], place[order], hot[order]
    of, lo, hi = (wide([x]) for x in spans)
    order = np.lexsort((lo, of))
    of, lo, hi = of[order], lo[order], hi[order]
    out = []
    for k in np.union1d(doc, of).tolist():
        a, b = np.searchsorted(doc, [k, k + 1])
        p, q = np.searchsorted(of, [k, k + 1])
        # Stretches of starts that touch are one.
        x, y = lo[p:q], np.maximum.accumulate(hi[p:q])
        cut = np.flatnonzero(np.concatenate([[True], x[1:] > y[:-1] + 1])[: len(x)])
        ends = y[np.append(cut[1:], len(x)) - 1] if len(x) else y
        out.append({"d": ids[k], "key": keys[k], "places": _pack(_narrow(np.diff(place[a:b], prepend=0)), hot[a:b].astype(np.uint8)), "n": b - a, "hot": int(hot[a:b].sum()), "lo": x[cut].tolist(), "hi": ends.tolist()})
    return pa.Table.from_pylist(out, _FOUND)


def _surroundings(shards: int):
    """(shard, d, key, start, anchor, around): the bytes that a repeated string with this anchor can take."""

    names = ["shard", "d", "key", "start", "anchor", "around"]
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for d, key, text, places in zip(*(batch.column(c).to_pylist() for c in ("d", "key", "text", "places")), strict=True):
                data = text.encode()
                delta, hot = _unpack(places)
                at = np.cumsum(delta.astype(np.int64))[hot == 0]
                for a, s in zip(at.tolist(), np.maximum(at - WINDOW + 1, 0).tolist(), strict=True):
                    gram = int.from_bytes(hashlib.blake2b(data[a : a + GRAM], digest_size=8).digest(), "little", signed=True)
                    out.append((gram % shards, d, key, s, gram, data[s : a + LENGTH]))
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, d, key, start): every string around an anchor with very many places, by 128 bits of hash."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("d", "key", "text", "places")]
        powers = _power_tables(max(map(len, columns[2]), default=0) * 4 + 1)
        for d, key, text, places in zip(*columns, strict=True):
            data = np.frombuffer(text.encode(), np.uint8)
            delta, hot = _unpack(places)
            at = np.cumsum(delta.astype(np.int64))[hot == 1]
            if not len(at):
                continue
            starts = np.unique((at[:, None] - np.arange(WINDOW)).ravel())
            starts = starts[(starts >= 0) & (starts <= len(data) - LENGTH)]
            first, second = (_hashes(data, powers, LENGTH, k)[starts].view(np.int64) for k in (1, 2))
            n = len(starts)
            yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), pa.array(np.full(n, d)), pa.array(np.full(n, key)), pa.array(starts, pa.int32())], ["h1", "h2", "d", "key", "start"])


_SPANS = pa.schema([("d", pa.int64()), ("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _later(rows: pa.Table) -> pa.Table:
    """(d, key, lo, hi): starts, from lo to hi, of strings of this shard that start earlier too."""
    d, key, start, anchor = (rows.column(c).to_numpy() for c in ("d", "key", "start", "anchor"))
    around = rows.column("around").to_pylist()
    order = np.lexsort((start, key, d)).tolist()
    first: dict[tuple[int, bytes], int] = {}
    out = []
    for i in order:
        if len(around[i]) < LENGTH:
            continue
        if first.setdefault((int(anchor[i]), around[i]), i) != i:
            out.append((d[i], key[i], start[i], start[i] + len(around[i]) - LENGTH))
    kinds = Counter(x for x, _ in first)
    groups: dict[int, list[int]] = {}
    for (value, _), i in first.items():
        if kinds[value] > 1:
            groups.setdefault(value, []).append(i)
    batch: list[int] = []

    def compare() -> None:
        texts = [around[i] for i in batch]
        place, group = repeated_strings(texts)
        if not len(place):
            return
        begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
        which = np.searchsorted(begins, place, side="right") - 1
        of = np.array(batch)[which]
        at = start[of] + place - begins[which]
        by = np.lexsort((at, key[of], d[of], group))
        of, at, group = of[by], at[by], group[by]
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        head = np.repeat(head, np.diff(np.append(head, len(group))))
        late = (d[of] != d[of[head]]) | (key[of] != key[of[head]]) | (at != at[head])
        # Neighbouring starts of one document are one row.
        of, at = of[late], at[late]
        by = np.lexsort((at, key[of], d[of]))
        dd, kk, at = d[of][by], key[of][by], at[by]
        if not len(at):
            return
        cut = np.flatnonzero(np.concatenate([[True], (dd[1:] != dd[:-1]) | (kk[1:] != kk[:-1]) | (at[1:] > at[:-1] + 1)]))
        out.extend(zip(dd[cut], kk[cut], at[cut], at[np.append(cut[1:], len(at)) - 1], strict=True))

    size = 0
    for members in groups.values():
        batch += members
        size += sum(len(around[i]) + 1 for i in members)
        if size >= TRANSFORM:
            compare()
            batch, size = [], 0
    if batch:
        compare()
    return pa.table([pa.array(np.array(c), t) for c, t in zip(zip(*out, strict=True), _SPANS.types, strict=True)], schema=_SPANS) if out else _SPANS.empty_table()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, n_bytes, spans, kept, sha): what is left of each text; the bytes may break characters."""
    kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
    for batch in batches:
        spans, kept, sizes = [], [], []
        for text, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("text", "lo", "hi")), strict=True):
            data = np.frombuffer(text.encode(), np.uint8)
            edges = np.zeros(len(data) + 1, np.int32)
            np.add.at(edges, lo, 1)
            np.add.at(edges, np.array(hi) + LENGTH, -1)
            gone = np.cumsum(edges[:-1]) > 0
            turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            spans.append([{"from": a, "to": b} for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)])
            kept.append(data[~gone].tobytes())
            sizes.append(len(data))
        yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), batch.column("sha")], ["d", "n_bytes", "spans", "kept", "sha"])


def cuts(docs: DataFrame, hot: int = HOT, partition_anchors: int = PARTITION_ANCHORS) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): for every row of ``docs`` (doc_id, text) the removed runs of bytes and what is left.

    ``kept`` is null where nothing goes and the text stays as it is; ``whole_sha256`` is the digest of the whole text.
    The texts to search are moved once, into a table dealt by their names; all later joins with them are local.
    """
    name = ["d", "key"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("d"), text.alias("text")).withColumn("key", F.xxhash64("text"))
    named = texts.select("d", "key", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))
    rows = durable(named.groupBy("d", "key", "sha", "n_bytes").agg(F.count("*").alias("copies")), "texts")
    firsts = durable(rows.groupBy("sha").agg(F.min("d").alias("first"), F.count("*").alias("kinds")), "firsts")
    rows = durable(spread_join(rows, firsts, ["sha"], "kinds", "d"), "rows")
    total = rows.where("d = first").agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]

    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-total // BUCKET_BYTES)))
    # Texts to leave out are marked in the same movement; of equal rows of one id, one is searched.
    longer = texts.where(F.octet_length("text") >= LENGTH).select(*name, "text", F.lit(0).alias("out"))
    later = rows.where((F.col("d") > F.col("first")) & (F.col("n_bytes") >= LENGTH)).select(*name, F.lit(None).cast("string").alias("text"), F.lit(1).alias("out"))
    place = F.row_number().over(Window.partitionBy(*name).orderBy(F.desc("out")))
    dealt = longer.unionByName(later).repartition(buckets, *name).withColumn("place", place)
    alone = bucketed(dealt.where("place = 1 and out = 0").select("d", "key", "text"), buckets, *name)

    parts = max(1, -(-total * 2 // ((WINDOW + 1) * partition_anchors)))
    places = alone.mapInArrow(_send(parts), PLACES).repartitionById(parts, F.col("part")).groupBy("part").applyInArrow(_repeated(hot), PLACES)
    found = durable(places.groupBy("chunk").applyInArrow(_by_document, FOUND), "anchors")
    many, hots = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("hot"), F.lit(0))).first()

    def beside(wanted: DataFrame) -> DataFrame:
        return alone.join(wanted.hint("shuffle_hash"), name)

    spans = "d long, key long, lo int, hi int"
    shards = max(1, -(-many * (LENGTH + WINDOW) // SHARD_BYTES))
    around = beside(found.where("n > hot").select("d", "key", "places")).select("d", "key", "text", "places").mapInArrow(_surroundings(shards), "shard int, d long, key long, start int, anchor long, around binary")
    starts = around.repartitionById(shards, F.col("shard")).groupBy("shard").applyInArrow(_later, spans)
    if hots:
        strings = beside(found.where("hot > 0").select("d", "key", "places")).select("d", "key", "text", "places").mapInArrow(_strings, "h1 long, h2 long, d long, key long, start int")
        where = F.struct("d", "key", "start")
        early = durable(strings.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.count("*").alias("n")).where("n > 1"), "early")
        again = spread_join(strings, early, ["h1", "h2"], "n", where).where(where != F.col("first"))
        starts = starts.unionByName(again.select("d", "key", F.col("start").alias("lo"), F.col("start").alias("hi")))
    told = found.where("size(lo) > 0").select("d", "key", F.explode(F.arrays_zip("lo", "hi")).alias("s")).select("d", "key", "s.lo", "s.hi")
    runs = durable(starts.unionByName(told).groupBy(*name).agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")), "runs")
    cut = beside(runs).select("d", "text", "lo", "hi", F.sha2("text", 256).alias("sha")).mapInArrow(_cut, "d long, n_bytes long, spans array<struct<from:int,to:int>>, kept binary, sha string")

    # The other rows don't need their texts: of equal rows the first stays whole if nothing was found, the others go whole.
    every = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    every = every.join(runs.select(*name, F.lit(True).alias("cut")), name, "left").where("cut is null or copy > 1 or d > first")
    late = ((F.col("d") > F.col("first")) | (F.col("copy") > 1)) & (F.col("n_bytes") >= LENGTH)
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("n_bytes").cast("int").alias("to")))
    none = F.array().cast("array<struct<from:int,to:int>>")
    rest = every.select("d", "n_bytes", F.when(late, whole).otherwise(none).alias("spans"), F.when(late, F.lit(b"")).alias("kept"), "sha")
    out = cut.unionByName(rest)
    return out.select(F.when(F.col("d") != NONE, F.col("d")).alias("doc_id"), "n_bytes", "spans", "kept", F.col("sha").alias("whole_sha256"))
