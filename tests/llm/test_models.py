"""Quality, Katz scores, tokenizer, URL filter and neighbours."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealmap.llm import ann, bpe, katz, quality, url_filter


def test_quality_held_out(spark, sf_dir):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = {x.doc_id: x for x in quality.classify(docs, labels).collect()}
    assert len(found) == 1000
    truth = {x.doc_id: x.quality for x in labels.collect()}
    for i, x in found.items():
        assert x.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.7)
    held = [i for i in truth if found[i].held_out]
    assert np.mean([found[i].predicted == truth[i] for i in held]) > 0.95


def test_quality_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {x.score for x in quality.classify(odd, none).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(None, 1, 0), (3, None, 0), (5, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, labels).count() == odd.count()
    assert quality.classify(empty, labels).count() == 0
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= odd.count()


def katz_by_hand(rows):
    tokens = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None], zlib.crc32(str("" if i is None else i).encode()) % 10 == 0) for i, t in rows]
    words, pairs, histories, after = Counter(), Counter(), Counter(), defaultdict(set)
    for _, w, held in tokens:
        if not held:
            words.update(w)
            histories.update(["", *w[:-1]])
            pairs.update(zip(["", *w[:-1]], w, strict=True))
    for h, w in pairs:
        after[h].add(w)
    n, kinds, k = sum(words.values()), len(words), katz.K

    def factors(counts):
        by = Counter(counts.values())
        return katz.discounts([by[r] for r in range(1, k + 1)], by[k + 1])

    of_word, of_pair = factors(words), factors(pairs)
    less = lambda c, d: c * d[c - 1] if c <= k else c - katz.BIG
    unknown = 1 - sum(less(c, of_word) for c in words.values()) / n
    one = lambda w: less(words[w], of_word) / n if words[w] else unknown
    alpha = {}

    def chance(h, w):
        if not histories[h]:
            return one(w)
        if pairs[h, w]:
            return less(pairs[h, w], of_pair) / histories[h]
        if h not in alpha:
            alpha[h] = (1 - sum(less(pairs[h, x], of_pair) for x in after[h]) / histories[h]) / (1 - sum(map(one, after[h])))
        return alpha[h] * one(w)

    for h in ["", *list(histories)[:5]]:
        assert sum(chance(h, w) for w in words) + chance(h, "never seen") == pytest.approx(1)
    for i, w, held in tokens:
        score = sum(math.log10(chance(h, x)) for h, x in zip(["", *w[:-1]], w, strict=True))
        base = sum(math.log10((words[x] + 0.1) / (n + 0.1 * (kinds + 1))) for x in w)
        yield i, held, len(w), sum(words[x] > 0 for x in w), n, base, score


@pytest.mark.parametrize("tokens", [4_000_000, 3000])
def test_katz(documents, odd, tokens, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK_BYTES", 20_000)
    for docs in (documents, odd):
        found = sorted(map(tuple, katz.scores(docs, tokens).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=str)
        wanted = sorted(katz_by_hand([(x.doc_id, x.text) for x in docs.collect()]), key=str)
        assert [x[:5] for x in found] == [x[:5] for x in wanted]
        assert np.allclose([x[5:] for x in found], [x[5:] for x in wanted], rtol=1e-9)


def test_katz_without_training(spark, empty):
    assert katz.scores(empty).count() == 0
    alone = spark.createDataFrame([(i, "a b c") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    assert {(x.n_known, x.train_tokens, x.score) for x in katz.scores(alone).collect()} == {(0, 0, 0.0)}


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


ODD_TEXTS = ["", "  ", "Σίσυφος ΣΑΣ", "İstanbul don't WE'LL <|endoftext|>x<|startoftext|> <|nope|>", "a b\x1cc\x85d\x00", "é é ﬁ Ǆ 𝔘𝔫𝔦 日本語 123 ４５ ½²", "🙂👩‍👩‍👧" * 3, "a" * 3000, "ab" * 2000 + "!" * 500, "aaaaaabababaabbbabaabab" * 9]


def test_bpe_matches_library(documents, odd, tokenizer):
    path, library = tokenizer
    coder = bpe.Tokenizer(open(path, encoding="utf-8").read())
    for text in ODD_TEXTS:
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text).tolist() == ids
        assert coder.decode(coder.encode(text)).decode() == library.decode(ids, skip_special_tokens=False)
    for docs in (documents, odd):
        texts = Counter((x.doc_id, x.text) for x in docs.collect())
        found = Counter((x.doc_id, tuple(x.ids), x.decoded) for x in bpe.encode(docs, path).collect())
        wanted = Counter()
        for (i, text), n in texts.items():
            ids = library.encode(text or "", add_special_tokens=False).ids
            wanted[i, tuple(ids), library.decode(ids, skip_special_tokens=False)] += n
        assert found == wanted


def test_bpe_refuses_unknown_ids(tokenizer, empty):
    coder = bpe.Tokenizer(open(tokenizer[0], encoding="utf-8").read())
    with pytest.raises(ValueError):
        coder.decode(np.array([10**6]))
    assert bpe.encode(empty, tokenizer[0]).count() == 0


URLS = ["http://a.Example.COM/en/7x?q", "https://example.com/en/8", "ftp://x.net/de/1#f", "http://example.net/de/81", "no scheme", None, "", "http://org/es/", "http://host.only", "http://q.org?x=/es/", "http://éa.net/fr/" + "long/" * 300]


def test_url_rules_and_ratio(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 3)], "page_id long, url string, host string")
    found = {x.page_id: x for x in url_filter.judge(pages).collect()}
    assert [(found[i].host, found[i].path, found[i].rule) for i in range(len(URLS))] == [
        ("a.example.com", "/en/7x", "example.com/en/7"), ("example.com", "/en/8", "com/en/"), ("x.net", "/de/1", "net/de/"), ("example.net", "/de/81", "example.net/de/8"),
        ("", "", None), ("", "", None), ("", "", None), ("org", "/es/", "org/es/"), ("host.only", "", None), ("q.org", "", None), ("éa.net", "/fr/" + "long/" * 300, None),
    ]
    counts = {c: [Counter() for _ in range(6)] for c in ("allow", "block")}
    for x in found.values():
        if x.ruled:
            padded = "\x02" * 4 + x.url + "\x03"
            for i in range(4, len(padded)):
                for k in range(1, 6):
                    counts[x.ruled][k][padded[i - k + 1 : i + 1]] += 1

    def chance(c, g):
        p = 1 / url_filter.ALPHABET
        for k in range(1, 6):
            s = g[5 - k :]
            after = [n for t, n in counts[c][k].items() if t[:-1] == s[:-1]]
            if after:
                p = (counts[c][k][s] + len(after) * p) / (sum(after) + len(after))
        return p

    for i in range(6):
        padded = "\x02" * 4 + (URLS[i] or "") + "\x03"
        logs = [math.log(chance("allow", padded[j - 4 : j + 1]) / chance("block", padded[j - 4 : j + 1])) for j in range(4, len(padded))]
        assert found[i].ratio == pytest.approx(np.mean(logs))
    assert all(x.verdict == (x.ruled or ("block" if x.ratio < x.threshold else "allow")) for x in found.values())


def test_url_filter_without_classes(spark):
    pages = spark.createDataFrame([(1, "http://x.fr/a"), (2, None)], "page_id long, url string")
    assert {x.verdict for x in url_filter.judge(pages).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0)).count() == 0


def neighbours(rows, query, k):
    d = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(rows[query], v, strict=True))), i) for i, v in rows.items() if i != query)
    return [i for _, i in d[:k]]


def test_neighbours_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {x.vec_id: x.embedding for x in vectors.collect()}
    found = defaultdict(list)
    for x in ann.nearest(vectors, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        found[x.query_id].append(x.vec_id)
        assert x.rank == len(found[x.query_id]) and x.score == pytest.approx(math.dist(rows[x.query_id], rows[x.vec_id]))
    assert set(found) == {i for i in rows if i % 100 == 0}
    assert np.mean([len(set(found[q]) & set(neighbours(rows, q, 10))) / 10 for q in found]) >= 0.9


@pytest.mark.parametrize("bits, substring", [(40, 16), (64, 16), (24, 7)])
def test_index_finds_every_code_within(bits, substring):
    codes = np.random.default_rng(2).integers(0, 1 << bits, 3000, dtype=np.uint64)
    index = ann.Index(codes, bits, substring)
    for k, margin in ((1, 0), (5, 3), (40, 0), (3000, 0), (4000, 2)):
        apart = np.bitwise_count(codes ^ codes[5]).astype(int)
        within = np.sort(apart)[min(k, 3000) - 1] + margin
        found, _ = index.search(codes[5], k, margin)
        assert set(found) == set(np.flatnonzero(apart <= within))


def test_probes_touch_few_rows_of_clustered_data():
    """What the tables' probes touch stays far below the shard, and the neighbours are among the found."""
    rng = np.random.default_rng(3)
    rows = rng.standard_normal((400, 48))[rng.integers(0, 400, 16_000)] + 0.08 * rng.standard_normal((16_000, 48))
    coder = ann.learn(rows[:8000])
    index = ann.Index(coder.codes(rows), coder.bits)
    touched, hits = [], []
    for i in range(0, 16_000, 160):
        found, n = index.search(coder.codes(rows[i : i + 1])[0], 11, coder.margin)
        d = ann.distances(rows[i], rows)
        touched.append(n / len(rows))
        hits.append(np.isin(np.argsort(d)[1:11], found).mean())
    assert np.mean(touched) < 0.1 and np.mean(hits) >= 0.9


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [1.0, 0.0]), (6, [0.0, 2.0]), (7, [float("inf"), 0.0]), (8, []), (9, [1.0, 2.0, 3.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame([(*x, 1, 2.0, 3, 4) for x in rows], "vec_id long, embedding array<float>, row int, score double, shard int, query_id int")
    found = sorted(map(tuple, ann.nearest(vectors, F.col("vec_id") % 100 == 0).collect()))
    # Each of the two rows of id 100 is a query, and the other's candidate.
    wanted = [(0, 1, 5), (0, 2, 100), (0, 3, 100), (0, 4, 6)] + 2 * [(100, 1, 0), (100, 2, 5), (100, 3, 100), (100, 4, 6)]
    assert [x[:3] for x in found] == sorted(wanted)
    assert ann.nearest(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_quality_without_both_labels_rejects_nothing(spark, odd):
    for rows in ([], [(i, 1, 0) for i in range(40)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        assert sorted(map(str, quality.keep_good(odd, labels).collect())) == sorted(map(str, odd.collect()))


def test_scores_do_not_depend_on_arrival(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    one, two = ({x.doc_id: x.score for x in quality.classify(docs.repartition(n), labels).collect()} for n in (2, 7))
    assert one == two
