"""Katz backoff scoring with bigrams.

P(w | h) is the Good-Turing discounted relative count of the bigram (h, w)
where training saw it, and otherwise falls back, recursively, to
alpha(h) * P(w).  P(w) is the discounted relative count of a word, and the
mass that discounting frees goes to one class of unknown words.  alpha(h) is
normalised exactly: what the seen successors of h leave, over what they leave
of P.  Unknown histories fall back with weight one.

How it is stored and evaluated.  A task tokenises a chunk of documents and
sends to each partition of the bigram table one compressed block: the distinct
bigrams of that partition in the chunk, and the numbers of the documents in
which they stand; ids travel once for each chunk.  The table is partitioned by the bigram's second word, so a
partition holds all of that word's counts.  It adds up its blocks, answers
every token for which the bigram was seen, and leaves three kinds of blocks:
sums per document, summaries per history (for alpha), and the tokens that must
back off.  The last two are partitioned by history and meet there.  Discount
factors are known only once all counts of counts are in, so everything before
that is kept linear in them: numbers of tokens by class.  The driver sees those
counts of counts and a bounded list of frequent words, nothing else.

Frequent words (a bounded list, from a sample of documents; their counts are
exact, over all training documents) are spread: their bigrams are dealt by both
words, their backing-off tokens by chunk.  The list decides where work is
done, never a result.

Counts up to K are discounted by Good-Turing, larger ones by the constant
BIG: a history seen only with large counts must leave something too, or unseen
words after it would have no probability.  Where the counts of counts give no
usable factors (few data), K's are replaced by absolute discounting.

Words are known by 64-bit hashes of their bytes.

Defined cases: a null text counts as empty; an empty text has one token, its
end; a null id belongs to the rows that crc32 of the empty text puts it with;
rows with one id are scored apart; without training rows every word is unknown
and all scores are those of an empty model (log10 of one for each token); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, durable

#: Counts up to this many have Good-Turing discounts; what is taken from each larger one.
K, BIG = 5, 0.5
#: Frequent words at most, and the share of the documents they are found in.
HOT_WORDS, HOT_SAMPLE = 1024, 16
#: Bytes of text in a chunk and, about, tokens in a partition of the table.
CHUNK_BYTES, PARTITION_TOKENS = 8 << 20, 3_000_000
#: Bytes of text a token takes, for the number of partitions only.
TOKEN_BYTES = 6
#: Add-constant of the baseline.
BASE = 0.1
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LETTERS = np.random.default_rng(99).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_ODD, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
START, END = np.uint64(1), np.uint64(2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    out = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def word_hashes(text: bytes, powers: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """One 64-bit hash per word of the lower-cased text, in order."""
    data = np.frombuffer(text.lower(), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    up, down = powers if powers is not None and len(powers[0]) > len(data) else _power_tables(len(data) + 1)
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[data] * up[: len(data)], dtype=np.uint64)])
    out = _mix((sums[ends] - sums[starts]) * down[starts] ^ _mix((ends - starts).astype(np.uint64)))
    return np.where(out <= END, out + np.uint64(3), out)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays, each as its number of items, bytes and type, then its bytes; narrow types are transposed and compressed."""
    out = []
    for x in arrays:
        raw = np.ascontiguousarray(x)
        data = pa.compress(raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes(), codec="zstd", asbytes=True) if len(raw) else b""
        out.append(len(raw).to_bytes(4, "little") + len(data).to_bytes(4, "little") + raw.dtype.str.encode().ljust(4) + data)
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, size = int.from_bytes(data[at : at + 4], "little"), int.from_bytes(data[at + 4 : at + 8], "little")
        kind, at = np.dtype(data[at + 8 : at + 12].decode().strip()), at + 12
        raw = pa.decompress(data[at : at + size], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True) if n else b""
        out.append(np.frombuffer(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T.tobytes(), kind))
        at += size
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def _deal(word: np.ndarray, n: int) -> np.ndarray:
    return (word >> np.uint64(20)) % np.uint64(n)


def _in(words: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Where each word is in the sorted list, or -1."""
    if not len(listed):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(listed, words), len(listed) - 1)
    return np.where(listed[at] == words, at, -1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, bool, bytes]]]:
    held, size = [], 0
    for batch in batches:
        for row in zip(batch.column("doc_id").to_pylist(), batch.column("train").to_pylist(), batch.column("text").to_pylist(), strict=True):
            data = (row[2] or "").encode()
            held.append((row[0], row[1], data))
            size += len(data)
            if size >= CHUNK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _tokens(held: list[tuple[int | None, bool, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Second word, first word and document number of every token of a chunk."""
    powers = _power_tables(max(len(x[2]) for x in held) + 1)
    words = [word_hashes(x[2], powers) for x in held]
    sizes = np.array([len(x) + 1 for x in words])
    ends = np.cumsum(sizes) - 1
    second = np.empty(int(sizes.sum()), np.uint64)
    inside = np.ones(len(second), bool)
    inside[ends] = False
    second[inside], second[ends] = np.concatenate(words), END
    first = np.concatenate([[START], second[:-1]])
    first[ends[:-1] + 1] = START
    return second, first, np.repeat(np.arange(len(words)), sizes)


def _count_words(listed: np.ndarray | None):
    """(word, n): counts of the listed words in training documents, or of the 2000 most frequent of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _chunks(batches):
            second, _, _ = _tokens(held)
            if listed is None:
                words, counts = np.unique(second, return_counts=True)
                top = np.argsort(-counts, kind="stable")[:2000]
                words, counts = words[top], counts[top]
            else:
                at = _in(second, listed)
                words, counts = listed, np.bincount(at[at >= 0], minlength=len(listed))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts, pa.int64())], ["word", "n"])

    return run


def _send(parts: int, hot: np.ndarray):
    """Chunks of documents to blocks (part, chunk, docs, body): one of the chunk's ids, without a body, and one for each partition that it has tokens for."""

    def block(part: int, key: int, docs: bytes, body: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([key], pa.int64()), pa.array([docs], pa.binary()), pa.array([body], pa.binary())], ["part", "chunk", "docs", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, held in enumerate(_chunks(batches)):
            second, first, doc = _tokens(held)
            part = _deal(second, parts)
            spread = (second == END) | (_in(second, hot) >= 0)
            part = np.where(spread, _deal(_mix(first ^ second * np.uint64(3)), parts), part)
            order = np.lexsort((doc, first, second, part))
            part, second, first, doc = part[order], second[order], first[order], doc[order]
            fresh = np.concatenate([[True], (second[1:] != second[:-1]) | (first[1:] != first[:-1]) | (part[1:] != part[:-1])])
            names = np.array([0 if x[0] is None else x[0] for x in held], np.int64)
            flags = np.array([x[1] + 2 * (x[0] is None) for x in held], np.uint8)
            key = task << 32 | number
            # The documents' ids go once for each chunk, past the table; a block has the numbers of those in it.
            yield block((task + number) % parts, key, _pack(np.diff(names, prepend=0), flags), b"")
            train = flags & 1
            edges = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            for p, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if lo == hi:
                    continue
                begins = np.flatnonzero(fresh[lo:hi])
                w2, w1 = second[lo:hi][begins], first[lo:hi][begins]
                heads = np.flatnonzero(np.concatenate([[True], w2[1:] != w2[:-1]]))
                present, where = np.unique(doc[lo:hi], return_inverse=True)
                yield block(p, key, b"", _pack(w2[heads], _narrow(np.diff(np.append(heads, len(w2)))), w1, _narrow(np.diff(np.append(begins, hi - lo))), _narrow(np.diff(present, prepend=0)), train[present], _narrow(where)))

    return run


#: What is summed per document: logarithms, the baseline's, tokens, known tokens, seen bigrams by
#: count 1 to K, tokens that back off by count 0 to K of their word, and those with larger counts.
SUMS = 4 + K + (K + 1) + 1
#: What is summed per history: types by count 1 to K and larger, tokens; successors by count 1 to K of the word, and the others' discounted counts.
PER_HISTORY = K + 2 + K + 1
_BLOCKS = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("docs", pa.binary()), ("body", pa.binary()), ("numbers", pa.list_(pa.float64()))])
BLOCKS = "kind string, key long, docs binary, body binary, numbers array<double>"


def _row(kind: str, key: int, docs: bytes = b"", body: bytes = b"", numbers: list[float] | None = None) -> dict:
    return {"kind": kind, "key": key, "docs": docs, "body": body, "numbers": numbers or []}


def _doc_sums(key: int, present: np.ndarray, sums: np.ndarray) -> dict:
    """One block of the sums (some documents of a chunk by SUMS), without documents that have none."""
    there = np.flatnonzero(sums.any(axis=1))
    return _row("sum", key, body=_pack(_narrow(present[there]), *(sums[there, i] if i < 2 else _narrow(sums[there, i].astype(np.int64)) for i in range(SUMS))))


def _by_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(counts, K + 1).astype(np.int64)


def _reduce(parts: int, hot: np.ndarray, hot_counts: np.ndarray, train_docs: int):
    """One partition of the bigram table: count it, answer it, summarise it."""

    def run(rows: pa.Table) -> pa.Table:
        out, w1s, w2s, sizes, doc, flags, places, offset = [], [], [], [], [], [], [], 0
        for chunk, docs, body in zip(rows.column("chunk").to_pylist(), rows.column("docs").to_pylist(), rows.column("body").to_pylist(), strict=True):
            if not body:
                out.append(_row("sum", chunk, docs))
                continue
            heads, runs, w1, counts, present, told, where = _unpack(body)
            w2s.append(np.repeat(heads, runs))
            w1s.append(w1)
            sizes.append(counts.astype(np.int64))
            doc.append(where.astype(np.int64) + offset)
            flags.append(told)
            places.append((chunk, np.cumsum(present.astype(np.int64)), offset, offset + len(told)))
            offset += len(told)
        if not places:
            return pa.Table.from_pylist(out, _BLOCKS)
        w1, w2, sizes, doc, train = map(np.concatenate, (w1s, w2s, sizes, doc, flags))
        del w1s, w2s, flags
        order = np.lexsort((w1, w2))
        fresh = np.concatenate([[True], (w2[order][1:] != w2[order][:-1]) | (w1[order][1:] != w1[order][:-1])])
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(fresh) - 1
        w1, w2 = w1[order][fresh], w2[order][fresh]
        pair = np.repeat(pair, sizes)  # of each token
        count = np.bincount(pair, weights=train[doc], minlength=len(w1)).astype(np.int64)
        # Counts of the second words: this partition has all of them but for those spread.
        heads = np.flatnonzero(np.concatenate([[True], w2[1:] != w2[:-1]]))
        word = np.cumsum(np.concatenate([[True], w2[1:] != w2[:-1]])) - 1
        total, words = np.add.reduceat(count, heads), w2[heads]
        listed = _in(words, hot)
        spread = (listed >= 0) | (words == END)
        own = total[~spread]
        if len(hot):
            total = np.where(listed >= 0, hot_counts[listed], total)
        total = np.where(words == END, train_docs, total)
        of_word = total[word]
        # Sums per document, one class after the other.
        n_docs, sums = len(train), np.zeros((len(train), SUMS))
        c, c1 = count[pair], of_word[pair]
        seen, end = c > 0, (w2 == END)[pair]
        logs = np.where(c > K, np.log10(np.maximum(c - BIG, BIG)), 0.0)
        logs -= np.where(end | (c1 == 0), 0.0, np.log10(np.maximum(c1, 1)))
        logs += np.where(~seen & (c1 > K), np.log10(np.maximum(c1 - BIG, BIG)), 0.0)
        add = lambda which, weights=None: np.bincount(doc if which is None else doc[which], weights=weights, minlength=n_docs)
        sums[:, 0], sums[:, 1] = add(None, logs), add(None, np.log10(c1 + BASE))
        sums[:, 2], sums[:, 3] = add(None), add(c1 > 0)
        for r in range(1, K + 1):
            sums[:, 3 + r] = add(c == r)
        unseen, kind = np.flatnonzero(~seen), _by_class(c1)
        if len(unseen):
            sums[:, 4 + K :] = np.bincount(doc[unseen] * (K + 2) + kind[unseen], minlength=n_docs * (K + 2)).reshape(n_docs, K + 2)
        out += [_doc_sums(chunk, present, sums[lo:hi]) for chunk, present, lo, hi in places]
        del sums, logs, c, c1, seen, end
        # Tokens that back off, to their history; those of frequent histories by chunk.
        if len(unseen):
            history, at = w1[pair[unseen]], doc[unseen]
            chunks, numbers = np.array([x[0] for x in places], np.int64), np.concatenate([x[1] for x in places])
            of_chunk = np.searchsorted([x[3] for x in places], at, side="right")
            to = np.where(_in(history, hot) >= 0, chunks[of_chunk].astype(np.uint64) % np.uint64(parts), _deal(history, parts))
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(parts + 1, dtype=np.uint64))
            for q, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if lo < hi:  # one block for each partition of histories, whatever the number of chunks
                    x = order[lo:hi]
                    out.append(_row("backoff", q, chunks.tobytes(), _pack(history[x], _narrow(of_chunk[x]), _narrow(numbers[at[x]]))))
        # Summaries of histories.
        held = np.flatnonzero(count)
        if len(held):
            order = held[np.argsort(w1[held], kind="stable")]
            names, where = np.unique(w1[order], return_inverse=True)
            by, sub = _by_class(count[order]), _by_class(of_word[order])
            columns = np.zeros((len(names), PER_HISTORY))
            columns[:, : K + 1] = np.bincount(where * (K + 1) + by - 1, minlength=len(names) * (K + 1)).reshape(-1, K + 1)
            columns[:, K + 1] = np.bincount(where, weights=count[order], minlength=len(names))
            lower = sub <= K
            columns[:, K + 2 : -1] = np.bincount(where[lower] * K + sub[lower] - 1, minlength=len(names) * K).reshape(-1, K)
            columns[:, -1] = np.bincount(where, weights=np.where(lower, 0, of_word[order] - BIG), minlength=len(names))
            # Histories that every partition may ask for go to each of them, the others to their own.
            common, to = _in(names, hot) >= 0, _deal(names, parts)
            pack = lambda x: _pack(names[x], *(_narrow(columns[x, i].astype(np.int64)) for i in range(PER_HISTORY - 1)), columns[x, -1])
            for q in range(parts):
                if len(x := np.flatnonzero(common | (to == q))):
                    out.append(_row("history", q, body=pack(x)))
        by_pair, by_word = (np.bincount(_by_class(x[x > 0]), minlength=K + 3)[1 : K + 3] for x in (count, own))
        by_pair[K + 1] = (count == K + 1).sum()
        by_word[K + 1] = (own == K + 1).sum()
        out.append(_row("const", 0, numbers=[float(x) for x in (count.sum(), *by_pair, *by_word)]))
        return pa.Table.from_pylist(out, _BLOCKS)

    return run


def discounts(counts: list[float], next_count: float) -> np.ndarray:
    """Factors for counts 1 to K from the numbers of types with counts 1 to K and with K + 1."""
    n = np.array([*counts, next_count])
    r = np.arange(1, K + 1)
    with np.errstate(all="ignore"):
        share = (K + 1) * n[K] / n[0]
        out = ((r + 1) * n[1:] / (r * n[:-1]) - share) / (1 - share)
    if np.all(np.isfinite(out)) and np.all(out > 0.05) and np.all(out < 1):
        return out
    taken = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return (r - min(max(taken, 0.1), 0.9)) / r


class Model:
    """The numbers that all documents share."""

    def __init__(self, numbers: list[float], hot_counts: np.ndarray, train_docs: int):
        self.tokens, pairs, words = numbers[0], numbers[1 : K + 3], numbers[K + 3 : 2 * K + 5]
        extra = [x for x in [*hot_counts.tolist(), train_docs] if x > 0]
        by = np.bincount([min(int(x), K + 1) for x in extra], minlength=K + 2)[1:]
        types = np.array(words[: K + 1]) + by
        self.vocabulary = float(types.sum())
        self.pair = discounts(pairs[:K], pairs[K + 1])
        self.word = discounts(types[:K], words[K + 1] + sum(x == K + 1 for x in extra))
        r = np.arange(1, K + 1)
        self.unknown = float((types[:K] * r * (1 - self.word)).sum() + BIG * types[K]) / self.tokens if self.tokens else 1.0

    def weights(self) -> np.ndarray:
        """What each of the sums is worth, in log10."""
        r, out = np.arange(1, K + 1), np.zeros(SUMS)
        if not self.tokens:
            return out
        out[0] = 1
        out[4 : 4 + K] = np.log10(r * self.pair)
        out[4 + K] = math.log10(self.unknown)
        out[5 + K : 5 + 2 * K] = np.log10(r * self.word / self.tokens)
        out[-1] = -math.log10(self.tokens)
        return out

    def alpha(self, columns: np.ndarray) -> np.ndarray:
        """Normalised backoff weights of histories from their summaries."""
        r = np.arange(1, K + 1)
        left = (columns[:, :K] @ (r * (1 - self.pair)) + BIG * columns[:, K]) / columns[:, K + 1]
        below = 1 - (columns[:, K + 2 : -1] @ (r * self.word) + columns[:, -1]) / self.tokens
        return left / below


def _back_off(model: Model):
    """One partition of the histories: weights for the tokens that back off."""

    def run(rows: pa.Table) -> pa.Table:
        names, columns, asked = [], [], []
        for kind, docs, body in zip(rows.column("kind").to_pylist(), rows.column("docs").to_pylist(), rows.column("body").to_pylist(), strict=True):
            found = _unpack(body)
            if kind == "history":
                names.append(found[0])
                columns.append(np.stack([x.astype(np.float64) for x in found[1:]], axis=1))
            else:
                asked.append((docs, *found))
        if not asked or not names:
            return _BLOCKS.empty_table()
        names, columns = np.concatenate(names), np.concatenate(columns)
        known, where = np.unique(names, return_inverse=True)
        total = np.stack([np.bincount(where, weights=columns[:, i], minlength=len(known)) for i in range(PER_HISTORY)], axis=1)
        # Each token already had the history's count taken off as if its bigram were seen.
        worth = np.log10(model.alpha(total) * total[:, K + 1])
        chunk = np.concatenate([np.frombuffer(docs, np.int64)[of] for docs, _, of, _ in asked])
        doc = np.concatenate([x[3].astype(np.int64) for x in asked])
        at = _in(np.concatenate([x[1] for x in asked]), known)
        chunk, doc, gain = chunk[at >= 0], doc[at >= 0], worth[at[at >= 0]]
        # In a fixed order, so that sums of floats agree from run to run.
        order = np.lexsort((gain, doc, chunk))
        chunk, doc, gain = chunk[order], doc[order], gain[order]
        out, turns = [], np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]])) if len(chunk) else []
        for lo, hi in zip(turns[:-1], turns[1:], strict=True):
            present, where = np.unique(doc[lo:hi], return_inverse=True)
            sums = np.zeros((len(present), SUMS))
            sums[:, 0] = np.bincount(where, weights=gain[lo:hi], minlength=len(present))
            out.append(_doc_sums(int(chunk[lo]), present, sums))
        return pa.Table.from_pylist(out, _BLOCKS)

    return run


def _finish(model: Model, train_docs: int):
    """One chunk: add up its blocks and score its documents."""
    worth = model.weights()
    shape = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(rows: pa.Table) -> pa.Table:
        names, flags = _unpack(next(x for x in rows.column("docs").to_pylist() if x))
        sums = np.zeros((len(names), SUMS))
        # In a fixed order, so that sums of floats agree from run to run.
        for body in sorted(x for x in rows.column("body").to_pylist() if x):
            there, *columns = _unpack(body)
            sums[there] += np.stack(columns, axis=1)
        score = sums @ worth - (math.log10(train_docs) if train_docs else 0.0)
        base = sums[:, 1] - sums[:, 2] * math.log10(model.tokens + BASE * (model.vocabulary + 1))
        ids = pa.array(np.cumsum(names), pa.int64(), mask=flags >= 2)
        return pa.table([ids, pa.array(flags & 1 == 0), pa.array(sums[:, 2].astype(np.int64)), pa.array(sums[:, 3].astype(np.int64)), pa.array(base), pa.array(score)], schema=shape)

    return run


def held_out():
    """Rows whose crc32 of the id, as text, is divisible by 10 are kept from training."""
    return crc32_of("doc_id") % 10 == 0


def scores(docs: DataFrame, partition_tokens: int = PARTITION_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~held_out()).alias("train"), F.col("text").cast("string").alias("text"))
    train_docs, size = rows.agg(F.count_if("train"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-size // (TOKEN_BYTES * partition_tokens)))
    hot, hot_counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    if parts > 1:
        some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 0).mapInArrow(_count_words(None), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        least = size / HOT_SAMPLE / TOKEN_BYTES / (4 * parts)
        found = some.where(F.col("n") > least).orderBy(F.desc("n"), "word").limit(HOT_WORDS).toPandas()
        hot = np.sort(found["word"].to_numpy(np.int64).view(np.uint64))
        hot = hot[hot > END]
    if len(hot):
        exact = rows.where("train").mapInArrow(_count_words(hot), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
        by = dict(zip(exact["word"].to_numpy(np.int64).view(np.uint64).tolist(), exact["n"].tolist(), strict=True))
        hot_counts = np.array([by.get(x, 0) for x in hot.tolist()], np.int64)
    sent = rows.mapInArrow(_send(parts, hot), "part int, chunk long, docs binary, body binary")
    tables = durable(sent.repartition(parts, "part").groupBy("part").applyInArrow(_reduce(parts, hot, hot_counts, train_docs), BLOCKS), "katz", by=["kind"])
    n = 2 * K + 5
    told = tables.where("kind = 'const'").agg(*(F.coalesce(F.sum(F.element_at("numbers", i + 1)), F.lit(0.0)) for i in range(n))).first()
    model = Model([float(x) for x in told], hot_counts, train_docs)
    back = tables.where("kind in ('history', 'backoff')").groupBy("key").applyInArrow(_back_off(model), BLOCKS)
    every = tables.where("kind = 'sum'").select("key", "docs", "body").unionByName(back.select("key", "docs", "body"))
    done = every.groupBy("key").applyInArrow(_finish(model, train_docs), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.withColumn("train_tokens", F.lit(int(model.tokens)).cast("long"))
