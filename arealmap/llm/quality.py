"""Quality classifier by Bradley-Terry pairwise ranking.

Every text gets one latent score, linear in features of its characters, words
and lines.  Weights come from preference pairs (a good text beside a bad one)
by the logistic loss on feature differences, so only differences matter.  The
decision threshold is a quantile of the scores of the training rows: the one
that separates their labels best.  A logistic map with that quantile at the
wanted probability turns scores into numbers from 0 to 1.

The fit uses a bounded sample of labelled ids (``max_rows``, smallest seeded
hash first), and of the rows that have them twice as many at most, in order of
id and digest; scoring reads every row whole, a few at a time, whatever its length.

Defined cases: a null text counts as empty, and empty texts get a score like
any other; a null id is never labelled; ids labelled twice take the mean of
their labels, ties are left out; without both labels every score is 0.5; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import crc32_of, few_at_a_time, unwrapped, wrapped

#: Labelled rows of a fit at most, and preference pairs drawn from them.
MAX_ROWS = 12_000
MAX_PAIRS = 60_000
SEED = 20240229
#: ASCII signs and control characters have a feature each; letters, digits and other bytes have one together.
_SIGNS = [b for b in range(128) if not chr(b).isalnum()]
_LOWER, _UPPER, _DIGIT = range(97, 123), range(65, 91), range(48, 58)
FEATURES = len(_SIGNS) + 24


def features(text: bytes) -> np.ndarray:
    out = np.zeros(FEATURES)
    n = len(text)
    if not n:
        out[-1] = 1
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out[: len(_SIGNS)] = np.sqrt(counts[_SIGNS] / n)
    lower, upper, digit, high = counts[97:123].sum(), counts[65:91].sum(), counts[48:58].sum(), counts[128:].sum()
    words, lines = text.split(), text.split(b"\n")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    w, kinds = max(1, len(words)), len(set(words))
    full = [x for x in lines if x]
    letters = max(1, lower + upper + high)
    shares = counts / n
    out[len(_SIGNS) : -1] = [
        upper / letters, math.sqrt(digit / n), high / letters, (n - letters - digit - counts[32]) / n,
        math.log1p(n), math.log1p(w), sizes.mean() if len(sizes) else 0, sizes.std() if len(sizes) else 0,
        math.log1p(sizes.max()) if len(sizes) else 0, (sizes == 1).sum() / w, (sizes > 14).sum() / w,
        kinds / w, kinds / math.sqrt(w), math.log1p(w / max(1, kinds)),
        len(set(full)) / max(1, len(full)), math.log1p(len(lines)), math.log1p(n / len(lines)), (len(lines) - len(full)) / len(lines),
        -(shares[shares > 0] * np.log(shares[shares > 0])).sum(), sum(map(bytes.isupper, words)) / w,
        sum(map(bytes.isalpha, words)) / w, sum(map(bytes.isdigit, words)) / w, shares.max(),
    ]
    return out


@dataclass(frozen=True)
class Ranker:
    """Latent score ``(features - mean) / scale @ weights``; ``cut`` is the score that maps to ``level``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    level: float

    def latent(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        raised = self.slope * (self.latent(rows) - self.cut) + math.log(self.level / (1 - self.level))
        return 1 / (1 + np.exp(-np.clip(raised, -35, 35)))


def fit(rows: np.ndarray, good: np.ndarray, level: float = 0.7, max_pairs: int = MAX_PAIRS, penalty: float = 1e-3, seed: int = SEED) -> Ranker:
    """Bradley-Terry weights by Newton steps on the mean logistic loss of pair differences."""
    mean, scale = (rows.mean(0), rows.std(0)) if len(rows) else (np.zeros(FEATURES), np.ones(FEATURES))
    scale = np.where(scale > 1e-9, scale, 1.0)
    weights = np.zeros(FEATURES)
    won, lost = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(won) or not len(lost):
        # No preferences: every score is one half.
        return Ranker(mean, scale, weights, 0.0, 0.0, 0.5)
    z = np.clip((rows - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    pairs = min(max_pairs, 8 * len(rows))
    apart = z[rng.choice(won, pairs)] - z[rng.choice(lost, pairs)]
    for _ in range(30):
        chance = 1 / (1 + np.exp(np.clip(apart @ weights, -35, 35)))
        slope = -(apart.T @ chance) / pairs + penalty * weights
        curve = (apart * (chance * (1 - chance))[:, None]).T @ apart / pairs + penalty * np.eye(FEATURES)
        step = np.linalg.solve(curve, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    latent = z @ weights
    order = np.argsort(latent, kind="stable")
    ranked = good[order]
    # Rows below a quantile are called bad: errors = good ones below it and bad ones from it on.
    errors = np.concatenate([[0], np.cumsum(ranked)]) + np.concatenate([np.cumsum((~ranked)[::-1])[::-1], [0]])
    best = np.flatnonzero(errors == errors.min())
    share = best[len(best) // 2] / len(rows)
    cut = float(np.quantile(latent, share))
    calibrated = np.linspace(0.05, 4, 80)
    side = np.where(good, 1.0, -1.0)
    base = math.log(level / (1 - level))
    loss = [np.logaddexp(0, -side * (k * (latent - cut) + base)).mean() for k in calibrated]
    return Ranker(mean, scale, weights, cut, float(calibrated[int(np.argmin(loss))]), level)


def _featured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_at_a_time(batches):
            rows = [features((x or "").encode()) for x in batch.column("text").to_pylist()]
            values = pa.array(np.concatenate(rows) if rows else np.empty(0), pa.float64())
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * FEATURES, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column("good"), batch.column("id"), batch.column("sha"), listed], ["good", "id", "sha", "x"])

    return docs.mapInArrow(run, "good boolean, id long, sha string, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, level: float = 0.7) -> Ranker:
    """Fit on the labelled rows of ``docs`` (doc_id, text); ``labels`` (doc_id, label) holds the rows to learn from."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_labelled")).agg(F.avg(F.col(label).cast("double")).alias("m")).where("m <> 0.5")
    # The bound keeps the driver's part, and what is broadcast, the same at every size.
    chosen = told.orderBy(F.xxhash64("_labelled"), "_labelled").limit(max_rows)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled"))
    told = found.select(F.col("doc_id").alias("id"), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), (F.col("m") > 0.5).alias("good"))
    # In an order that doesn't depend on how rows arrive, so a fit can be repeated; rows that share an id stay under the bound too.
    rows = _featured(told).orderBy("id", "sha").limit(2 * max_rows).toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES) if rows.num_rows else np.empty((0, FEATURES))
    return fit(x, np.array(rows.column("good").to_pylist(), bool), level)


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """All columns of ``docs`` that the caller selected, with ``score`` after them."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_at_a_time(batches):
            texts = batch.column("text").to_pylist()
            values = ranker.score(np.array([features((x or "").encode()) for x in texts]).reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def held_out():
    """Rows whose crc32 of the id, as text, leaves 2 when divided by 4 are kept from the fit."""
    return crc32_of("doc_id") % 4 == 2


def classify(docs: DataFrame, labels: DataFrame, level: float = 0.7, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    ranker = train(docs, labels.where(~held_out()), max_rows=max_rows, level=level)
    # Only the score leaves the worker; the text ends there.
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(plain, ranker).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= level).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, level: float = 0.7, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns; without both labels to learn from, all rows."""
    ranker = train(docs, labels.where(~held_out()), max_rows=max_rows, level=level)
    if not ranker.slope:
        return docs
    inner = wrapped(docs).drop("doc_id")
    return unwrapped(score(inner, ranker).where(F.col("score") >= level), docs.columns)
