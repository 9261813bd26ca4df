"""Merkle manifest, exact clusters and quality rules against plain programs and their SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from arealmap.llm import exponion, merkle, quality_rules
from arealmap.llm import queries as Q

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_exponion_clustering", "op13_quality_rules"])
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    told = con.execute(Q.ORACLES[name])
    columns = [c[0] for c in told.description]
    got = Q.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(told.fetchall())


def tree(leaves, fanout):
    """(root, ways): each leaf's (left, right) by level."""
    ways, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // fanout * fanout : (i // fanout + 1) * fanout]
            ways[k].append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], ways


def by_hand(rows, fanout):
    code = lambda r: "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r)
    held = {}
    for doc_id, source, lang, n, text in rows:
        low = (doc_id, source, lang, n, None if text is None else text.translate(LOW))
        one = H(code((doc_id, source, lang, n, text)))
        bad = H(code(low)) if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0 else one
        held.setdefault(source, []).append((doc_id is not None, doc_id or 0, one, bad, doc_id))
    order = sorted(held, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(held[s])], fanout) for s in order}
    root, tops = tree([trees[s][0] for s in order], fanout)
    out = []
    for k, s in enumerate(order):
        for (_, _, one, bad, doc_id), way in zip(sorted(held[s]), trees[s][1], strict=True):
            way, h = way + tops[k], bad
            for left, right in way:
                h = H(left, h, right)
            out.append((doc_id, one, trees[s][0], root, H(*(x for step in way for x in step)), h, h == root))
    return sorted(out, key=str)


FIVE = ["doc_id", "source", "lang", "n_chars", "text"]


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest(odd, fanout):
    odd = odd.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.initcap("text")).otherwise(F.col("text")))
    got = sorted(map(tuple, merkle.proven(odd, fanout).collect()), key=str)
    assert got == by_hand([tuple(r) for r in odd.select(*FIVE).collect()], fanout)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_source_of_one_row_and_of_none(spark, empty):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    many = [(i % 70, "Text" * (i % 3), None, "only", 3) for i in range(100)] + [(5, None, "en", "only", None)] * 20
    one = spark.createDataFrame(many, shape).repartition(5)
    assert sorted(map(tuple, merkle.proven(one).collect()), key=str) == by_hand([tuple(r) for r in one.select(*FIVE).collect()], 16)
    lone = merkle.proven(spark.createDataFrame([(3, "x" * 6_000_000, None, None, None)], shape)).first()
    assert lone.leaf == lone.subroot == lone.root == lone.folded_root and lone.verified and lone.proof_sha256 == H("")
    assert merkle.proven(empty).collect() == []


def test_manifest_of_other_tables(spark):
    """Any key, group and fields; values of one text are not those of another split."""
    rows = spark.createDataFrame([("a", "bc", 1.5), ("ab", "c", 1.5), (None, "c", None)], "name string, team string, score double")
    held = merkle.manifest(rows, ("name", "team", "score"), key="name", group="team", fanout=2)
    assert held.columns == ["key", "group", "leaf", "idx", "n", "path", "subroot", "root"] and held.select("leaf").distinct().count() == 3
    assert held.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(rows, ("name",), key="name", group="team", fanout=1)


def plain(x, ids, k, rounds, seed):
    """A full scan of all centroids each round, in Python's integers."""
    mark = sorted(range(len(x)), key=lambda i: (H(f"{seed}:{'' if ids[i] is None else ids[i]}"), x[i]))
    centers = [list(x[i]) for i in mark[:k]]
    for i in range(rounds + 1):
        far = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))  # noqa: B023, E731
        at = [far(v) for v in x]
        for j in range(len(centers)) if i < rounds else ():
            own = [v for v, (_, c) in zip(x, at, strict=True) if c == j]
            if own:
                centers[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return at, centers


@pytest.mark.parametrize("k,rounds", [(1, 2), (5, 8), (30, 6)])
def test_clusters_by_hand(spark, k, rounds):
    """On a small lattice, so that ties abound; with repeated rows and ids and vectors that take no part."""
    rng = random.Random(k)
    rows = [(rng.choice([i, i, 7, None]), [rng.randint(-3, 3) / 2 for _ in range(3)]) for i in range(300)]
    rows += rows[:40]
    bad = [(1, None), (2, [1.0, 2.0]), (3, [1.0, None, 2.0]), (4, [1.0, float("nan"), 0.0]), (5, [float("inf"), 0.0, 0.0]), (6, [])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, cluster int, kind string").repartition(4)
    found = exponion.clusters(table, k=k, rounds=rounds, size=3, scale=2.0, seed=9)
    x = [[int(np.floor(2 * a)) for a in v] for _, v in rows]
    at, centers = plain(x, [i for i, _ in rows], k, rounds, 9)
    inertia = {j: sum(d for d, c in at if c == j) for j in range(len(centers))}
    want = [(i, c, d, inertia[c], sum(inertia.values()), centers[c]) for (i, _), (d, c) in zip(rows, at, strict=True)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_clusters_of_few_large_and_no_vectors(spark):
    shape = "vec_id long, embedding array<float>"
    few = exponion.clusters(spark.createDataFrame([(1, [1e30, -3e38]), (2, [0.0, 0.0])], shape), size=2).collect()
    assert sorted((r.vec_id, r.distance, r.center) for r in few) == [(1, 0, [exponion.LARGEST, -exponion.LARGEST]), (2, 0, [0, 0])]
    assert exponion.clusters(spark.createDataFrame([], shape)).collect() == []
    with pytest.raises(ValueError):
        exponion.clusters(spark.createDataFrame([], shape), k=0)


def test_search_sees_few_centroids_of_clustered_vectors():
    """The ball leaves most centroids out, and the result is that of a scan."""
    rng = np.random.default_rng(2)
    homes = rng.integers(-10_000, 10_000, (60, 16))
    x = homes[rng.integers(0, 60, 4000)] + rng.integers(-40, 41, (4000, 16))
    centers = homes + rng.integers(-300, 301, homes.shape)
    first = exponion.Search(centers, None)
    at, upper, lower = first.fresh(x)
    for _ in range(5):
        before, centers = centers, np.array([x[at == c].sum(0) // max(1, (at == c).sum()) if (at == c).any() else centers[c] for c in range(60)])
        search = exponion.Search(centers, before)
        at, upper, lower = search.again(x, at, upper, lower)
        full = np.array([exponion.squared(x, c) for c in centers])
        assert (at == full.argmin(0)).all() and search.scanned < 0.2 * full.size
        assert (upper**2 >= full[at, np.arange(len(x))]).all()
        assert (lower**2 <= np.where(np.arange(60)[:, None] == at, np.inf, full).min(0)).all()


def test_rule_counts_by_hand(odd):
    """Counts of every text, also with stretches of a few characters."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    found = quality_rules.clean(odd).collect()
    assert len(found) == odd.count()
    for row in found:
        text = row.record.text
        ws, lines = word.findall(text or ""), [x for x in (text or "").split("\n") if word.search(x)]
        grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        twice = {g for g in set(grams) if grams.count(g) > 1} if len(grams) < 3000 else {g for g in grams if ws.count(g[0]) > 1 and grams.count(g) > 1}
        again = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
        assert (row.n_words, row.word_chars, row.n_symbols) == (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""))
        assert (row.n_dup_lines, row.n_repeat_words) == (len(lines) - len(set(lines)), len(again))
        assert row.base_failed == (len(ws) < 50 or 100 * len(again) > 50 * len(ws)) and not (row.kept and row.base_failed)


def test_rules_in_stretches(monkeypatch):
    rng, rules = random.Random(5), quality_rules.Rules()
    words = lambda rng, n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n))
    texts = ["", " ", "a", "\n\n", "x y. " * 40, "a a a. b b b\n | x | y |.\n"] + [words(rng, 80) + ".\n" + words(rng, 30) + " | " + words(rng, 9) for _ in range(10)]
    whole = [quality_rules.judged(t, rules) for t in texts]
    monkeypatch.setattr(quality_rules.stretches, "__defaults__", (5,))
    assert whole == [quality_rules.judged(t, rules) for t in texts]


GOOD = "The river was high that day and nobody wanted to cross it before the evening came."


@pytest.mark.parametrize(
    "line,rule",
    [
        (GOOD, None), ("Yes.", None), ("Done!)", None), ("»Ja.«", "punctuation"), ("no end here", "punctuation"), ("Home | News | Sport | Weather.", "navigation"), ("a > b.", None),
        ("Click here.", "navigation"), ("Homes were built.", None), ("They went home and then they read more books until late in the night.", None),
        ("© 2020 Some People.", "boilerplate"), ("All Rights Reserved.", "boilerplate"), ("one### two*** three.", "boilerplate"), ("He paid $5 and left.", None), ("no no no no no.", "boilerplate"), ("That that is, is.", None),
    ],
)
def test_line_rules(line, rule):
    lost, failed, left = quality_rules.judged(line, quality_rules.Rules())[5:]
    assert failed == ({rule: 1} if rule else {}) and left == ("" if rule else line) and (lost > 0) == bool(rule)


def test_lines_go_before_documents(spark, empty):
    body = "\n".join(GOOD.replace("river", f"river{i}").replace("nobody", f"nobody{i}").replace("evening", f"evening{i}").replace("high", f"high{i}").replace("day", f"day{i}") for i in range(6))
    menu = "Home | News | Sport | Weather"
    rows = [(1, f"{menu}\n{body}\n\n© 2020.", "kept"), (2, "\n".join(f"Home{i} | News{i} | Sport{i * i}" for i in range(40)) + "\n" + body, "lost"), (3, None, "null"), (4, "", "empty"), (5, "One two.", "short")]
    docs = spark.createDataFrame([(*r, 3, True) for r in rows], "doc_id long, text string, clean_text string, n_words int, kept boolean")
    left = quality_rules.keep_clean(docs).collect()
    assert [tuple(r) for r in left] == [(1, body + "\n", "kept", 3, True)]
    found = {r.doc_id: r for r in quality_rules.clean(docs).collect()}
    assert found[1].failed_lines == {"navigation": 1, "boilerplate": 1} or found[1].failed_lines == {"punctuation": 1, "boilerplate": 1}
    assert found[3].clean_text is None and found[4].clean_text == "" and not found[2].kept and not found[2].base_failed
    assert quality_rules.clean(empty).collect() == []
    assert quality_rules.keep_clean(empty).columns == empty.columns


def test_share_at_the_threshold_passes():
    rules = quality_rules.Rules(fewest_words=0, most_repeated=100, most_lost=0.5)
    n, chars, *_, lost, _, _ = quality_rules.judged("abcd.\nabcde", rules)
    assert n == 2 and (lost, chars) == (5, 10) and lost <= rules.most_lost * chars


def test_rules_on_labels(spark, sf_dir):
    """Nearly all good documents stay and all that the labels call bad go."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = quality_rules.clean(docs.select("doc_id", "text"), texts=False).where("n_words >= 50").join(labels, "doc_id").select("kept", "quality").collect()
    good, bad = [r.kept for r in held if r.quality], [r.kept for r in held if not r.quality]
    assert sum(good) > 0.95 * len(good) and sum(bad) < 0.1 * len(bad)


def test_a_long_text(spark):
    text = "\n".join(f"line {i} of a text that goes on and on." for i in range(170_000))
    docs = spark.createDataFrame([(1, text), (2, text.replace("\n", " "))], "doc_id long, text string")
    assert len(text) > 5_000_000
    for row in quality_rules.clean(docs, texts=False).collect():
        assert row.n_words == 170_000 * 10 and row.n_dup_lines == 0 and row.lost_chars == 0
