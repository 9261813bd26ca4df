"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, exponion, katz, merkle, mixing, quality, quality_rules, sharding, simhash, suffix_dedup, url_filter
from .common import table

#: The public tokenizer file that op7 reads; a parameter of the operator.
TOKENIZER = "word_bpe_49k.json"

ORACLES: dict[str, str] = {}


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shuffled(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    text = F.col("record.text")
    return dealt.select(
        F.col("record.doc_id").alias("doc_id"), sharding.record_size("record.text").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = katz.scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cuts(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    return cut.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.coalesce(F.sha2("kept", 256), "whole_sha256").alias("kept_sha256"))


ORACLES["op6_suffix_array_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)),
s AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY m ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM s),
r AS (SELECT doc_id, min(p) AS lo, max(p) + 100 AS hi FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g) GROUP BY doc_id, run),
k AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM r UNION ALL SELECT doc_id, max(hi), max(n) FROM r JOIN d USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, sha256(unhex(string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a))) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS gone, count(*) AS runs FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(runs, 0) AS n_spans, coalesce(kept, sha256(unhex(h))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.equal_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op8_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op10_url_filter"] = url_filter.sql()


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proven(table(spark, sf_dir, "documents"))


ORACLES["op11_merkle_manifest"] = merkle.sql()


def op12_exponion_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exponion.clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10, size=64, scale=1024.0, seed=3)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("center", ","), 256).alias("centroid_sha256"))


ORACLES["op12_exponion_clustering"] = exponion.sql()


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.clean(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op13_quality_rules"] = quality_rules.sql()

QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_sharding, op3_multi_index_hashing, op4_source_mixing, op5_katz_backoff, op6_suffix_array_dedup, op7_bpe, op8_exact_dedup, op9_simhash_near_dedup, op10_url_filter, op11_merkle_manifest, op12_exponion_clustering, op13_quality_rules)}
