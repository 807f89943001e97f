"""Quality classifier with hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from knowloom.functions.skew import hot_join, is_small
from knowloom.llm.shared import materialize

SAMPLE_ROWS = 8000
SMOOTHING = 60.0
_BYTES = 129
_STEP = 1 << 20


def _counts(text: bytes | None) -> np.ndarray:
    """Occurrences of each ASCII byte and of all others, words and different words of the whole text."""
    out = np.zeros(_BYTES + 2)
    text = text or b""
    for a in range(0, len(text), _STEP):
        c = np.bincount(np.frombuffer(text, np.uint8, min(_STEP, len(text) - a), a), minlength=256)
        out[:128] += c[:128]
        out[128] += c[128:].sum()
    words = text.split()
    out[_BYTES], out[_BYTES + 1] = len(words), len(set(words))
    return out


@F.pandas_udf(ArrayType(FloatType()))
def text_counts(texts: pd.Series) -> pd.Series:
    return pd.Series([_counts(t).astype(np.float32) for t in texts])


def _features(counts: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """Square roots of byte shares, shrunk towards the usual text (short texts say little), and the share of new words."""
    n = counts[:, :_BYTES].sum(axis=1, keepdims=True)
    shares = (counts[:, :_BYTES] + SMOOTHING * usual) / (n + SMOOTHING)
    words = counts[:, _BYTES]
    fresh = (counts[:, _BYTES + 1] + 20.0) / (words + 20.0)
    return np.column_stack([np.sqrt(shares), fresh, np.log1p(words) * (1.0 - fresh)])


@dataclass
class Model:
    """Logistic regression on standardised features; ``weights[0]`` is the intercept."""

    usual: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self, counts: np.ndarray) -> np.ndarray:
        z = (_features(counts, self.usual) - self.mean) / self.scale
        z = self.weights[0] + np.clip(z, -8, 8) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(counts: np.ndarray, labels: np.ndarray, ridge: float = 2.0, rounds: int = 30) -> Model:
    """Newton steps with a ridge. Without rows of both classes the model only knows their share (one half for no rows)."""
    usual = counts[:, :_BYTES].sum(axis=0) + 1e-3
    usual = usual / usual.sum()
    width = _BYTES + 2
    share = (labels.sum() + 1.0) / (len(labels) + 2.0)
    weights = np.zeros(width + 1)
    weights[0] = np.log(share / (1 - share))
    if not 0 < labels.sum() < len(labels):
        return Model(usual, np.zeros(width), np.ones(width), weights)
    x = _features(counts, usual)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.column_stack([np.ones(len(x)), np.clip((x - mean) / scale, -8, 8)])
    penalty = ridge * np.eye(width + 1)
    penalty[0, 0] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + penalty + 1e-9 * np.eye(width + 1), z.T @ (p - labels) + penalty @ weights)
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    return Model(usual, mean, scale, weights)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled documents (doc_id, quality), those with the smallest id hashes.

    The bound is what may be broadcast and sent to the driver. An id with several labels has their mean, rounded.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.round(F.avg("quality")).alias("_quality"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(sample), "_id")
    rows = rows.select("_quality", text_counts(F.col("text").cast("binary")).alias("_counts")).limit(2 * sample_rows).collect()
    counts = np.array([r["_counts"] for r in rows], dtype=np.float64).reshape(len(rows), _BYTES + 2)
    return fit(counts, np.array([r["_quality"] for r in rows], dtype=np.float64))


def evidence(model: Model):
    """Column function: probability of good quality by the text alone; null and empty texts get that of an empty text."""

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        step = 512
        parts = [model.probability(np.array([_counts(t) for t in texts.iloc[a:a + step]])) for a in range(0, len(texts), step)]
        return pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return lambda text: probability(text.cast("binary"))


def _strength(groups: DataFrame, mean: float) -> float:
    """Prior strength by moments: how many documents the prior weighs, from the spread of group means around ``mean``."""
    row = groups.filter("n > 1").agg(
        F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.lit(mean), F.lit(2.0))).alias("between"),
        F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within")).first()
    if not row["g"] or row["n"] <= row["g"]:
        return 10.0
    noise = max(1e-9, row["within"] / (row["n"] - row["g"]))
    spread = (row["between"] - row["g"] * noise) / row["n"]
    return float(np.clip(noise / max(spread, 1e-12), 1.0, 10_000.0))


def site_sums(scored: DataFrame) -> DataFrame:
    """host, path, n, s, q: documents, sum and sum of squares of their evidence. Combines map-side, so a hot host costs one row per task."""
    return scored.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))


def site_rates(sums: DataFrame) -> tuple[DataFrame, float, float, float]:
    """(host, path, n, s, host_n, host_s), global mean, strength of the global prior on hosts, of the host on its paths."""
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s")).first()
    mean = (total["s"] + 0.5) / (total["n"] + 1.0)
    hosts = sums.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    k_host, k_path = _strength(hosts, mean), _strength(sums, mean)
    named = hosts.select(F.col("host").alias("_h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    rates = sums.join(named, F.col("host").eqNullSafe(F.col("_h"))).select("host", "path", "n", "s", "host_n", "host_s")
    return rates, mean, k_host, k_path


def _logit(p: Column) -> Column:
    safe = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(safe / (1 - safe))


def with_posterior(scored: DataFrame, sums: DataFrame) -> DataFrame:
    """``scored`` (host, path, p, ...) plus host_rate, path_rate and posterior.

    Rates leave the document's own evidence out: the host's mean is shrunk towards the global mean, the path's towards
    the host's rate, each by its strength. The posterior adds the path's log-odds over the global ones to the evidence.
    """
    rates, mean, k_host, k_path = site_rates(sums)
    small = is_small(rates)
    joined = hot_join(scored, F.broadcast(rates) if small else rates, ["host", "path"])
    host = (F.col("host_s") - F.col("p") + F.lit(k_host * mean)) / (F.col("host_n") - 1 + F.lit(k_host))
    joined = joined.withColumn("host_rate", host)
    joined = joined.withColumn("path_rate", (F.col("s") - F.col("p") + F.lit(k_path) * F.col("host_rate")) / (F.col("n") - 1 + F.lit(k_path)))
    odds = _logit(F.col("p")) + _logit(F.col("path_rate")) - _logit(F.lit(mean))
    return joined.withColumn("posterior", 1 / (1 + F.exp(-odds))).drop("n", "s", "host_n", "host_s")


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5,
             sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, host, path, evidence, host_rate, path_rate, posterior, keep.

    ``host`` and ``path`` name the columns of the two site levels. Null or empty texts, null ids and null sites (a site
    of their own) are scored like others, repeated rows each return a row, an empty table returns none. Scores, not
    texts, are written once and joined with the site sums.
    """
    probability = evidence(train(docs, labels, sample_rows))
    scored = docs.select(F.col("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), probability(F.col("text")).alias("p"))
    scored = materialize(scored, "quality-scores")
    out = with_posterior(scored, materialize(site_sums(scored), "quality-sites"))
    return out.select("doc_id", "host", "path", F.col("p").alias("evidence"), "host_rate", "path_rate", "posterior",
                      (F.col("posterior") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5,
              sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows and columns of ``docs`` whose posterior reaches ``threshold``: texts are scored where they are read, twice, and never shuffled."""
    probability = evidence(train(docs, labels, sample_rows))
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    scored = docs.select(row, F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), probability(F.col("text")).alias("p"))
    sums = materialize(site_sums(scored), "quality-sites")
    return with_posterior(scored, sums).filter(F.col("posterior") >= threshold).select("_row.*")
