"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

A document's own evidence is the log-odds of two logistic models (quality, toxicity)
over words and over shapes of the text.  They are fitted on at most MAX_FIT labelled
rows, those with the smallest digest of their id.  Over all documents, the expected
numbers of good and of toxic ones are then summed by host and by path of a host.  A
host's rate is shrunk toward the global one and a path's toward its host's, each with
a strength taken from the spread between groups (method of moments), so that sparse
sites stay near the prior.  Either posterior of a document joins its evidence with its
path's rate.

Defined cases: null text is empty text; null host or path are groups of their own;
labels that are null or without a document don't count, of repeated ones the least
does, and of documents under one labelled id the least text; without any usable labels
all evidence is 0, priors are UNKNOWN and every document is kept; repeated rows are
scored alike; columns of any name pass through kept_documents.
"""

from __future__ import annotations

import re
import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import cut, documents, map_texts, packed, slices, stored, text_of

#: Most labelled rows that the models are fitted on.
MAX_FIT = 6000
#: Words are numbered by so many bits of their checksum; a word becomes a feature if it is in LEAST rows and this many deviations from independent of a label.
BITS, LEAST, DEVIATIONS = 20, 12, 4.0
MAX_WORDS = 4000
HEADS = ("quality", "toxic")
#: Prior log-odds of a head without labels of both kinds: documents are taken to be good.
UNKNOWN = {"quality": 4.0, "toxic": -4.0}
#: A document is kept if it is more likely good than not, and not likely to be toxic.
KEEP_QUALITY, KEEP_TOXIC = 0.5, 0.3
#: Paths up to which their rates are broadcast (a row has some 100 bytes); more are joined by a shuffle.
BROADCAST_PATHS = 100_000
#: Bounds of a group's prior strength, in documents.
STRENGTH = (5.0, 5000.0)

_WORD = re.compile(r"\w+")
_MASK = (1 << BITS) - 1


def word_ids(text: str) -> np.ndarray:
    """Distinct words of a text as numbers."""
    return np.unique(np.fromiter((zlib.crc32(w.encode()) & _MASK for w in set(_WORD.findall(text.lower()))), np.int64))


#: ASCII capitals, symbols that prose has few of, and digits (fixed sets).
_CAPITALS, _SYMBOLS, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!#$%&*+<=>@[\\]^_`{|}~", b"0123456789"


def shapes(text: str) -> list[float]:
    """Shares that don't depend on the words: capitals, symbols, digits, lone signs, repeats, repeats at once, lines repeated, length."""
    raw = text.encode()
    n = len(raw) or 1
    words = text.split()
    k = len(words) or 1
    lines = [x for x in text.split("\n") if x]
    share = lambda signs: (len(raw) - len(raw.translate(None, signs))) / n
    return [
        share(_CAPITALS),
        share(_SYMBOLS),
        share(_DIGITS),
        sum(len(w) == 1 and not w.isalnum() for w in words) / k,
        1 - len(set(words)) / k,
        sum(map(eq, words, words[1:])) / k,
        1 - len(set(lines)) / (len(lines) or 1),
        min(np.log10(n), 6.0) / 6,
    ]


N_SHAPES = 8
#: Knots: a shape enters linearly and as what it has above each of these.
KNOTS = (0.02, 0.05, 0.1, 0.2, 0.4)


def shape_row(text: str) -> np.ndarray:
    s = np.array(shapes(text))
    return np.concatenate([s, *[np.maximum(0, s - k) for k in KNOTS]])


def fit_logistic(words: list[np.ndarray], dense: np.ndarray, y: np.ndarray, chosen: np.ndarray, steps: int = 250, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the chosen words, of the dense columns, and the intercept (Adam on the whole batch)."""
    cols = [np.searchsorted(chosen, w[np.isin(w, chosen, assume_unique=True)]) for w in words]
    rows = np.repeat(np.arange(len(y)), [len(c) for c in cols])
    flat = np.concatenate(cols) if cols else np.empty(0, np.int64)
    middle, spread = dense.mean(0), dense.std(0) + 1e-6
    x = (dense - middle) / spread
    theta = np.zeros(len(chosen) + x.shape[1] + 1)
    theta[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, d = theta[: len(chosen)], theta[len(chosen) : -1]
        z = np.bincount(rows, weights=w[flat], minlength=len(y)) + x @ d + theta[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.concatenate([np.bincount(flat, weights=err[rows], minlength=len(chosen)), x.T @ err, [err.sum()]])
        g[:-1] += ridge * theta[:-1] / 10
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    d = theta[len(chosen) : -1] / spread
    return theta[: len(chosen)], d, float(theta[-1] - d @ middle)


class Model:
    """Log-odds of each head from words and shapes."""

    def __init__(self, heads: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, float]], priors: dict[str, float]):
        self.heads, self.priors = heads, priors

    def evidence(self, text: str) -> list[float]:
        """Log-odds beyond the prior's, by head."""
        ids, dense, out = word_ids(text), shape_row(text), []
        for h in HEADS:
            if h not in self.heads:
                out.append(0.0)
                continue
            chosen, w, d, b = self.heads[h]
            at = np.searchsorted(chosen, ids)
            at[at == len(chosen)] = 0
            z = b + float(dense @ d) + (float(w[at[chosen[at] == ids]].sum()) if len(chosen) and len(ids) else 0.0)
            out.append(float(np.clip(z, -25, 25)) - self.priors[h])
        return out


def logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_fit: int = MAX_FIT) -> Model:
    """Fits both heads on at most max_fit labelled documents."""
    y = labels.select(F.col("doc_id").alias("__id"), *[F.col(h).cast("double").alias(h) for h in HEADS]).filter(" AND ".join(f"{h} IN (0, 1)" for h in HEADS)).dropna()
    y = y.groupBy("__id").agg(*[F.min(h).alias(h) for h in HEADS]).orderBy(F.md5(F.col("__id").cast("string")), "__id").limit(max_fit)
    d = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text")).join(F.broadcast(y), "__id")
    d = d.groupBy("__id", *HEADS).agg(F.min("__text").alias("__text")).drop("__id")  # a labelled id that many rows have comes once

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = part.column("__text").to_pylist()
                yield pa.RecordBatch.from_arrays([*[part.column(h) for h in HEADS], pa.array([word_ids(t).tolist() for t in texts], pa.list_(pa.int32())), pa.array([shape_row(t).tolist() for t in texts], pa.list_(pa.float64()))], names=[*HEADS, "words", "dense"])

    got = d.mapInArrow(run, "quality double, toxic double, words array<int>, dense array<double>").toArrow().to_pydict()
    words = [np.array(w, np.int64) for w in got["words"]]
    heads, priors = {}, dict(UNKNOWN)
    if words:
        dense = np.array(got["dense"])
        ids, n = np.unique(np.concatenate(words), return_counts=True)
        for h in HEADS:
            t = np.array(got[h])
            rate = t.mean()
            if not 0 < rate < 1:
                continue
            here = np.bincount(np.searchsorted(ids, np.concatenate(words)), weights=np.repeat(t, [len(w) for w in words]), minlength=len(ids))
            z = np.abs(here - n * rate) / np.sqrt(n * rate * (1 - rate) + 1e-9)
            z[n < LEAST] = 0
            top = np.argsort(-z, kind="stable")[:MAX_WORDS]
            chosen = np.sort(ids[top[z[top] >= DEVIATIONS]])
            heads[h] = (chosen, *fit_logistic(words, dense, t, chosen))
            priors[h] = logit(rate)
    return Model(heads, priors)


def scored(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df plus __quality and __toxic: evidence of either."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def fn(texts):
        e = [held.value.evidence(t) for t in texts]
        return {f"__{h}": pa.array([x[k] for x in e], pa.float64()) for k, h in enumerate(HEADS)}

    return map_texts(df.withColumn("__text", text_of(text_col)), fn, ", ".join(f"__{h} double" for h in HEADS))


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, head: str) -> float:
    """Prior strength by the method of moments: rate (1 - rate) / variance between groups - 1, with sampling noise taken off."""
    rate = F.col(head) / F.col("n")
    r = groups.agg(F.sum("n").alias("n"), F.sum(head).alias("held"), F.count("*").alias("k"), F.sum(F.col("n") * rate * rate).alias("square")).first()
    return strength(r["n"], r["held"], r["k"], r["square"])


def strength(n: int | None, held: float | None, groups: int, square: float | None) -> float:
    """From the numbers of documents, of expected hits and of groups, and the sum of n x rate^2 over groups."""
    if not n or groups < 2:
        return STRENGTH[1]
    mu = held / n
    between = max(square / n - mu * mu - mu * (1 - mu) * groups / n, 1e-9)
    return float(min(max(mu * (1 - mu) / between - 1, STRENGTH[0]), STRENGTH[1]))


def path_rates(scores: DataFrame, priors: dict[str, float], host: str, path: str) -> DataFrame:
    """(__host, __path, n_path, n_host) and each head's shrunk rates, host_<head> and path_<head>.

    scores: rows with __quality and __toxic (evidence), host and path.  Counts are combined
    before they are shuffled; what is kept has a row for each path.
    """
    held = [F.sum(_sigmoid(F.col(f"__{h}") + priors[h])).alias(h) for h in HEADS]
    paths = cut(scores.groupBy(F.col(host).alias("__host"), F.col(path).alias("__path")).agg(F.count("*").alias("n"), *held))
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("n"), *[F.sum(h).alias(h) for h in HEADS])
    total = hosts.agg(F.sum("n").alias("n"), *[F.sum(h).alias(h) for h in HEADS]).first()
    n, by_host, by_path = F.col("n"), [], []
    for h in HEADS:
        mu = (total[h] + 1.0) / (total["n"] + 2.0) if total["n"] else 0.5
        k_host, k_path = _strength(hosts, h), _strength(paths, h)
        by_host.append(((F.col(h) + k_host * mu) / (n + k_host)).alias(f"host_{h}"))
        by_path.append(((F.col(h) + k_path * F.col(f"host_{h}")) / (n + k_path)).alias(f"path_{h}"))
    hosts = hosts.select(F.col("__host").alias("__h"), n.alias("n_host"), *by_host)
    joined = paths.join(hosts, F.col("__host").eqNullSafe(F.col("__h")))
    return joined.select("__host", "__path", n.alias("n_path"), "n_host", *[f"host_{h}" for h in HEADS], *by_path)


def with_posteriors(scores: DataFrame, rates: DataFrame, host: str, path: str) -> DataFrame:
    """scores plus each head's rates and posterior (p_<head>) and keep."""
    rates = stored(rates)
    if rates.count() <= BROADCAST_PATHS:
        rates = F.broadcast(rates)
    d = scores.join(rates, F.col(host).eqNullSafe(F.col("__host")) & F.col(path).eqNullSafe(F.col("__path")), "left")
    d = d.withColumns({f"p_{h}": _sigmoid(F.col(f"__{h}") + _logit(F.col(f"path_{h}"))) for h in HEADS})
    return d.withColumn("keep", (F.col("p_quality") >= KEEP_QUALITY) & (F.col("p_toxic") < KEEP_TOXIC)).drop("__host", "__path")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """One row per document: doc_id, evidence, rates, posteriors and keep."""
    model = fit(docs, labels, id_col, text_col)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), F.col(path).alias("path"), F.col(text_col).alias("text"))
    scores = cut(scored(d, model).drop("text"))
    rates = path_rates(scores, model.priors, "host", "path")
    return with_posteriors(scores, rates, "host", "path").select("doc_id", "host", "path", F.col("__quality").alias("evidence"), F.col("__toxic").alias("evidence_toxic"), "n_host", "n_path", *[f"{x}_{h}" for h in HEADS for x in ("host", "path")], "p_quality", "p_toxic", "keep")


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """The documents that are kept, with their columns.  Texts are scored twice rather than shuffled."""
    model = fit(docs, labels, id_col, text_col)
    first = scored(docs.select(F.col(host).alias("host"), F.col(path).alias("path"), F.col(text_col).alias("text")), model).drop("text")
    rates = path_rates(first, model.priors, "host", "path")
    again = scored(packed(docs, host=F.col(host), path=F.col(path), text=F.col(text_col)), model).drop("text")
    return with_posteriors(again, rates, "host", "path").filter("keep").select("__row.*")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
