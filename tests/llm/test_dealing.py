"""Sharding and mixing against brute force, and the pipeline's stages."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arealmap.llm import mixing, quality, queries, sharding

from test_copies import cut_by_hand, fingerprint, near_by_hand, normal


@pytest.mark.parametrize("bucket, hot", [(8 << 20, 10_000), (3000, 3), (100, 10_000)])
def test_shards(odd, bucket, hot):
    docs = odd.unionByName(odd.where("doc_id is null")).unionByName(odd.where("doc_id is null")).unionByName(odd.where("doc_id is null"))
    found = sharding.shuffled(docs, shards=7, bucket_bytes=bucket, hot_rows=hot).collect()
    assert Counter((x.record.doc_id, x.record.text, x.record.shard) for x in found) == Counter((x.doc_id, x.text, x.shard) for x in docs.collect())
    by = defaultdict(list)
    for x in found:
        by[x.shard].append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_rerun_and_write(documents, empty, tmp_path, spark):
    one, two = (sorted((x.record.doc_id, x.shard, x.slot) for x in sharding.shuffled(documents.repartition(n), bucket_bytes=20_000).collect()) for n in (2, 5))
    assert one == two and one != sorted((i, k * 40 // 200, k % 5) for k, (i, _, _) in enumerate(one))
    sharding.write_shards(sharding.shuffled(documents), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == documents.count() and back.select("shard").distinct().count() == 40
    assert sharding.shuffled(empty).count() == 0


def test_shard_digest(spark, sf_dir, documents):
    found = {x.doc_id: x for x in queries.op2_sharding(spark, sf_dir).collect()}
    for x in documents.collect():
        data = (x.text or "").encode()
        assert (found[x.doc_id].size, found[x.doc_id].text_crc32) == (len(data) + 16, zlib.crc32(data))


def targets(sizes, most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, total, full = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(sizes.values()), set()
    while len(full) < len(names):
        level = (total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        above = {s for s in names if s not in full and level * weight[s] > most * sizes[s]}
        if not above:
            break
        full |= above
    return {s: most * sizes[s] if s in full else level * weight[s] for s in names}


def test_mix(spark, odd, documents, empty):
    tiny = spark.createDataFrame([(i, "a b c " * (i % 7), "big" if i < 400 else f"s{i}") for i in range(420)], "doc_id long, text string, source string")
    for docs in (documents, odd, tiny):
        rows, found = docs.collect(), mixing.mix(docs).collect()
        assert Counter((x.doc_id, x.size) for x in found) == Counter((x.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", x.text or ""))) for x in rows)
        sizes, taken = Counter(), Counter()
        for x in found:
            sizes[x.source] += x.size
            taken[x.source] += x.taken
            assert 0 <= x.taken <= 3 * x.size
        wanted = targets(sizes)
        for x in found:
            assert x.source_size == sizes[x.source] and x.target == pytest.approx(wanted[x.source])
        assert all(abs(taken[s] - wanted[s]) <= 0.5 + 1e-6 for s in wanted)
        assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs).collect()))
        assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0 == mixing.mixed(empty).count()


def test_schedule_is_even(spark):
    goals = spark.createDataFrame([("a", 10_000, 10_000.0), ("b", 900, 2700.0), ("c", 50, 20.0), (None, 5000, 3000.0)], "source string, source_size long, target double")
    slots = mixing.schedule(goals, 10).orderBy("slot").collect()
    need = {"a": 1000, "b": 270, "c": 2, None: 300}
    assert Counter(x.source for x in slots) == need
    for cut in (200, 600, 1000):
        share = Counter(x.source for x in slots[:cut])
        assert all(abs(share[s] - cut * need[s] / len(slots)) <= 12 for s in need)


def test_mix_does_not_depend_on_arrival(spark, odd):
    """Also rows without an id, and rows that are equal in all that is looked at."""
    docs = odd.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id"))).unionByName(odd.where("doc_id in (20, 21)")).unionByName(odd.where("doc_id in (20, 21)"))
    one, two = (sorted((str(x.doc_id), x.sha, str(x.source), x.size, x.taken) for x in mixing.mix(docs.repartition(n)).collect()) for n in (2, 7))
    by = lambda rows: Counter({k: sum(r[4] for r in rows if r[:3] == k) for k in {r[:3] for r in rows}})
    assert by(one) == by(two)


def test_mixed_rows(odd, documents):
    """Each row as often as the schedule takes its first word, with all its columns."""
    for docs in (odd, documents):
        wanted = Counter()
        for x in mixing.mix(docs).collect():
            wanted[x.doc_id, x.source, x.sha] += x.copies
        sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
        rows = mixing.mixed(docs).collect()
        assert Counter((x.doc_id, x.source, sha(x.text)) for x in rows) == +wanted
        assert set(map(str, rows)) <= set(map(str, docs.collect()))


def test_every_query_runs(spark, sf_dir, documents):
    """All ten, as registered: one row per document where the contract says so."""
    for name, query in queries.QUERIES.items():
        found = query(spark, sf_dir)
        rows = found.collect()
        assert rows and found.count() == len(rows), name
        if "doc_id" in found.columns:
            assert Counter(x.doc_id for x in rows) == Counter(x.doc_id for x in documents.select("doc_id").collect()), name


def test_registered_digests(spark, sf_dir, documents):
    """What the thin queries put out, against plain Python."""
    texts = {x.doc_id: x.text or "" for x in documents.collect()}
    for x in queries.op9_simhash_near_dedup(spark, sf_dir).collect():
        assert x.fingerprint == f"{fingerprint(texts[x.doc_id], 3):016x}"
    for x in queries.op8_exact_dedup(spark, sf_dir).collect():
        assert x.text_sha256 == hashlib.sha256(normal(texts[x.doc_id]).encode()).hexdigest()
    cut = {i: (n, sum(b - a for a, b in spans), len(spans), sha) for i, n, spans, sha in cut_by_hand(list(texts.items()))}
    for x in queries.op6_suffix_array_dedup(spark, sf_dir).collect():
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == cut[x.doc_id]
    dealt = sorted(queries.op2_sharding(spark, sf_dir).collect(), key=lambda x: (x.shard, x.slot))
    assert [x.slot for x in dealt] == [k for s in range(40) for k in range(sum(x.shard == s for x in dealt))]


def test_pipeline(spark, sf_dir, documents):
    """The whole run, row by row: what the classifier accepts, one of equal texts, one of near copies, the mix, and its tokens."""
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "source mixing", "bpe"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {x.doc_id for x in quality.classify(documents, labels).collect() if x.predicted}
    first = {}
    for x in sorted((x for x in documents.collect() if x.doc_id in good), key=lambda x: x.doc_id):
        first.setdefault(normal(x.text), x)
    left = near_by_hand(list(first.values()))
    mix = mixing.mixed(spark.createDataFrame(left, documents.schema)).collect()
    library = Tokenizer.from_file(queries.tokenizer_path())
    wanted = Counter((x.doc_id, tuple(library.encode(x.text or "", add_special_tokens=False).ids)) for x in mix)
    assert Counter((x.doc_id, tuple(x.ids)) for x in pipeline.run(spark, sf_dir).collect()) == wanted
