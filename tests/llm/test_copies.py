"""Exact and near copies, and long repeated strings, against brute force."""

import functools
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from arealmap.llm import exact_dedup, near_copies, simhash, suffix_dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_polynomials_combine():
    whole = bytes(range(256)) * 9
    hasher = exact_dedup.Polynomial(chunk=100)
    plain = exact_dedup.Polynomial(chunk=1 << 13)
    assert hasher.of(whole) == plain.of(whole)
    for cut in (0, 1, 99, 1000, len(whole)):
        left, right = plain.of(whole[:cut]), plain.of(whole[cut:])
        assert plain.combine(left, right) == plain.of(whole)


weak = functools.partial(exact_dedup.Polynomial, primes=(3, 2))


@pytest.mark.parametrize("make, huge, group", [(exact_dedup.Polynomial, 1 << 24, 4096), (weak, 300, 3)])
def test_exact_groups(odd, make, huge, group, monkeypatch):
    """Also with fingerprints that collide all the time, texts hashed in pieces and groups that are split."""
    monkeypatch.setattr(exact_dedup, "GROUP_ROWS", group)
    rows = odd.select("doc_id", "text").collect()
    by = defaultdict(list)
    for x in rows:
        by[normal(x.text)].append(x.doc_id)
    found = exact_dedup.equal_groups(odd, make, huge).collect()
    assert Counter(x.doc_id for x in found) == Counter(x.doc_id for x in rows)
    texts = {x.doc_id: normal(x.text) for x in rows}
    for x in found:
        members = by[texts[x.doc_id]]
        keep = min((i for i in members if i is not None), default=None)
        assert (x.keep_id, x.group_size, x.text_sha256) == (keep, len(members), hashlib.sha256(texts[x.doc_id].encode()).hexdigest())
    assert sum(x.kept for x in found) == len(by) and all(x.doc_id == x.keep_id for x in found if x.kept)


def test_drop_copies(odd, empty):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    texts = [normal(x.text) for x in kept.collect()]
    assert sorted(texts) == sorted({normal(x.text) for x in odd.collect()})
    assert exact_dedup.drop_copies(empty).count() == 0 == exact_dedup.equal_groups(empty).count()


def fingerprint(text, n):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(found[i : i + n]) for i in range(len(found) - n + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, linked):
    label = {i: i for i in ids}
    while True:
        moved = False
        for a, b in linked:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
        if not moved:
            return label


@pytest.mark.parametrize("radius, tree_rows", [(2, 16384), (9, 5)])
def test_simhash_groups(odd, radius, tree_rows):
    rows = [x for x in odd.select("doc_id", "text").collect() if x.doc_id is not None]
    marks = {x.doc_id: fingerprint(x.text, 3) for x in rows}
    pairs = [(a, b) for a in marks for b in marks if a < b and bin(marks[a] ^ marks[b]).count("1") <= radius]
    label = classes(marks, pairs)
    found = simhash.near_groups(odd.where("doc_id is not null"), 3, radius, tree_rows).collect()
    assert len(found) == len(rows)
    for x in found:
        assert (x.fingerprint % (1 << 64), x.component_id) == (marks[x.doc_id], label[x.doc_id])


def test_simhash_on_documents_matches_spark_hash(spark):
    text = "Spark hashes strings by XXH64 with seed 42"
    assert spark.sql(f"select xxhash64('{text}')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), seed=42)


def test_tree_finds_all_within():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 60, 12)]))
    shards = np.arange(len(values)) % 3
    forest = simhash.Forest(values, shards)
    roots = np.array([forest.root_of[s] for s in shards.tolist()])
    got = {(int(q), int(n)) for a, b in forest.within(values, roots, 4) for q, n in zip(a, b, strict=True)}
    assert got == {(i, j) for i in range(len(values)) for j in range(len(values)) if shards[i] == shards[j] and bin(int(values[i] ^ values[j])).count("1") <= 4}


def order_of(row):
    return (row.doc_id is None, row.doc_id or 0, hashlib.sha256((row.text or "").encode()).hexdigest())


def near_by_hand(rows, words=5, similarity=0.8):
    """The rows that stay, by all pairs: the first of each component."""
    rows = sorted(rows, key=order_of)
    label = alike_by_hand([(i, x.text) for i, x in enumerate(rows)], words, similarity)
    return [x for i, x in enumerate(rows) if label[i] == i]


@pytest.mark.parametrize("block, group", [(20_000, 1500), (1, 2)])
def test_drop_near_copies(odd, empty, block, group, monkeypatch):
    """Row by row, with rows that have no id or share one; also with every shingle cut into blocks."""
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", block)
    monkeypatch.setattr(near_copies, "BUCKETS", 1 << 30 if block == 1 else 1 << 16)
    monkeypatch.setattr(near_copies, "GROUP_ROWS", group)
    more = odd.where("doc_id in (12, 13, 40)").withColumn("doc_id", F.lit(None).cast("long")).unionByName(odd.where("doc_id = 20").withColumn("doc_id", F.lit(21).cast("long")))
    docs = odd.unionByName(more)
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns
    shown = lambda rows: sorted(map(str, rows))
    assert shown(kept.collect()) == shown(near_by_hand(docs.collect()))
    assert near_copies.drop_near_copies(empty).count() == 0 == simhash.near_groups(empty).count()


def test_repeated_strings():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.choice(list(b"ab\x00"), rng.integers(0, 50)).astype(np.uint8)) for _ in range(40)]
    places, offset = defaultdict(list), 0
    for t in texts:
        for i in range(len(t) - 5):
            places[t[i : i + 6]].append(offset + i)
        offset += len(t) + 1
    found = defaultdict(set)
    for place, group in zip(*suffix_dedup.repeated_strings(texts, 6), strict=True):
        found[int(group)].add(int(place))
    assert sorted(map(sorted, found.values())) == sorted(x for x in places.values() if len(x) > 1)


def cut_by_hand(rows):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(data[p : p + 100])
        turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out.append((i, len(data), turns.reshape(-1, 2).tolist(), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_cuts(odd, hot):
    """Also with every repeated anchor treated as frequent."""
    found = suffix_dedup.cuts(odd, hot, 20_000).collect()
    got = [(x.doc_id, x.n_bytes, [[a, b] for a, b in x.spans], hashlib.sha256(x.kept).hexdigest() if x.kept is not None else x.whole_sha256) for x in found]
    assert sorted(got, key=str) == cut_by_hand([(x.doc_id, x.text) for x in odd.collect()])


def test_suffix_cuts_of_nothing(empty):
    assert suffix_dedup.cuts(empty).count() == 0


def alike_by_hand(rows, words=5, similarity=0.8):
    """Smallest id of each id's component, over all pairs."""
    shingles = {i: {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} for i, t in rows for w in [(t or "").lower().split()]}
    same = lambda a, b: len(shingles[a] & shingles[b]) >= similarity * len(shingles[a] | shingles[b])
    return classes(list(shingles), [(a, b) for a in shingles for b in shingles if a < b and same(a, b)])


def test_similar_groups_beyond_a_block(spark, monkeypatch):
    """Families in which each text is alike only to its neighbours, spread over many blocks."""
    monkeypatch.setattr(near_copies, "GROUP_ROWS", 3)
    rng, rows = np.random.default_rng(8), []
    for family in range(4):
        text = [f"f{family}w{i}" for i in range(120)]
        for step in range(15):
            rows.append((len(rows), " ".join(text)))
            at = int(rng.integers(0, 100))
            text = [*text[:at], f"f{family}s{step}", *text[at + 1 :]]
            text = [*text[:at + 10], f"f{family}r{step}", *text[at + 11 :]]
    rows = [(int(i), t) for i, (_, t) in zip(rng.permutation(len(rows)), rows, strict=True)]
    want = alike_by_hand(rows)
    assert len(set(want.values())) < 30 < len(want)
    found = near_copies.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.first_id for x in found} == {i: g for i, g in want.items() if list(want.values()).count(g) > 1}


def test_similar_groups_at_the_threshold(spark):
    """Pairs alike in 0.80 to 0.85, far apart as fingerprints; and texts that repeat a line hundreds of times."""
    rng, rows = np.random.default_rng(9), []
    for k in range(60):
        text = [f"p{k}w{i}" for i in range(200)]
        other = list(text)
        for at in np.linspace(8, 190, 4).astype(int):
            other[at + int(rng.integers(0, 3))] = f"p{k}c{at}"
        rows += [" ".join(text), " ".join(other)]
    for k in range(10):
        line = " ".join(f"l{k}w{i}" for i in range(30))
        rest = " ".join(f"r{k}w{i}" for i in range(100))
        rows += [f"{line} {line} {rest}", " ".join([line] * 400 + [rest])]
    rows = list(enumerate(rows))
    want = alike_by_hand(rows)
    assert len(set(want.values())) == 70
    found = near_copies.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.first_id for x in found} == want


def test_unlike_copies_of_one_text_make_few_pairs(spark, monkeypatch):
    """Most copies differ too much from each other: neither pairs of a shingle's rows nor comparisons grow with their square."""
    rng, rows = np.random.default_rng(10), []
    base = [f"b{i}" for i in range(150)]
    for k in range(160):
        text = list(base)
        for at in rng.choice(25, k % 7, replace=False) * 6:
            text[at] = f"c{k}x{at}"
        rows.append((k, " ".join(text)))
    held = [near_copies.shingles(x, 5) for _, x in rows]
    n = len(rows)
    columns = {"piece": [1] * n, "kind": range(n), "size": [len(x) for x in held], "most": [len(x) for x in held], "row": range(n), "side": [2] * n, "sketch": [near_copies._sketch(x) for x in held]}
    batch = pa.RecordBatch.from_pydict({c: list(v) for c, v in columns.items()})
    made = {(a, b) for x in near_copies._across(0.8)(iter([batch.slice(0, 70), batch.slice(70)])) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True)}
    share = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    alike = {(a, b) for a in range(n) for b in range(a + 1, n) if share(held[a], held[b]) >= 0.8}
    assert alike <= made and len(made - alike) < 0.1 * (n * (n - 1) / 2 - len(alike))

    compared, verified = [], near_copies._verified

    def counted(texts, marks, pairs, *more):
        compared.append(pairs.count())
        return verified(texts, marks, pairs, *more)

    monkeypatch.setattr(near_copies, "_verified", counted)
    want = alike_by_hand(rows)
    found = near_copies.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.first_id for x in found} == {i: g for i, g in want.items() if list(want.values()).count(g) > 1}
    assert max(compared) < 4 * n


def family(n, words, changed, name, seed=11):
    """Texts of one origin, each with so many of its words changed."""
    rng, base = np.random.default_rng(seed), [f"{name}{i}" for i in range(words)]
    texts = []
    for k in range(n):
        text = list(base)
        for at in rng.choice(words // 6, changed, replace=False) * 6:
            text[at] = f"{name}c{k}x{at}"
        texts.append(" ".join(text))
    return texts


def test_texts_that_share_many_shingles_make_one_pair(spark, monkeypatch):
    """Once in a task, however many pieces they share; and long unlike texts none."""
    held = [near_copies.shingles(x, 5) for name in "ab" for x in family(6, 150, 1, name)]
    pieces = [(p, r) for p in range(40) for r in range(12) if r // 6 == p % 2 and (r + p) % 7]
    batch = pa.RecordBatch.from_pylist([{"piece": p, "kind": r, "size": len(held[r]), "most": len(held[r]), "row": r, "side": 2, "sketch": near_copies._sketch(held[r])} for p, r in pieces])
    made = [(x["a"], x["b"], x["n"]) for out in near_copies._across(0.8)(iter([batch.slice(0, 99), batch.slice(99)])) for x in out.to_pylist()]
    both = Counter((a, b) for p, a in pieces for q, b in pieces if p == q and a < b)
    assert sorted(made) == sorted((a, b, n) for (a, b), n in both.items())

    docs = list(enumerate([*family(40, 1800, 90, "l"), *family(30, 300, 5, "s")]))
    made, across = spark.sparkContext.accumulator(0), near_copies._across

    def counted(similarity):
        run = across(similarity)

        def more(batches):
            for out in run(batches):
                made.add(out.num_rows)
                yield out

        return more

    monkeypatch.setattr(near_copies, "_across", counted)
    want = alike_by_hand(docs)
    found = near_copies.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: x.first_id for x in found} == {i: g for i, g in want.items() if list(want.values()).count(g) > 1}
    assert made.value < len(docs)


@pytest.mark.parametrize("step", [16, 1 << 18])
def test_shingles_of_one_first_row_over_many_tasks(spark, step, monkeypatch):
    """Also when a task tells its pairs in many parts."""
    monkeypatch.setattr(near_copies, "HEAD_ROWS", 2)
    monkeypatch.setattr(near_copies, "STEP", step)
    docs = list(enumerate([x for k in range(6) for x in family(12, 150, 3, f"f{k}", k)]))
    want = alike_by_hand(docs)
    found = near_copies.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: x.first_id for x in found} == {i: g for i, g in want.items() if list(want.values()).count(g) > 1}
