"""Quality classifier: document evidence joined with host and path posteriors by hierarchical empirical Bayes.

A logistic regression over shape statistics of the whole text gives each document a log likelihood ratio. Its soft counts over
*all* documents are summed by host and path; the path's rate is shrunk toward its host's, and the host's toward the global
rate, with strengths estimated from the spread between groups. The posterior adds the ratio to the log odds of the path's rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import attach, logit, plain, sample_ids, text_slices
from evidentia.plans.runtime import staged

FEATURES = ("words", "word_length", "upper", "digits", "symbols", "shouts", "bars", "repeated_words", "same_as_before", "repeated_lines", "bare_words")
_LETTER, _UPPER, _DIGIT, _SPACE, _SHOUT, _BAR, _MARK, _OTHER = range(8)


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, dtype=np.uint8)
    for chars, kind in (("abcdefghijklmnopqrstuvwxyz", _LETTER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), ("0123456789", _DIGIT), (" \t\n\r\v\f", _SPACE), ("!", _SHOUT), ("|", _BAR), (".,;:?'\"-()", _MARK)):
        out[list(chars.encode())] = kind
    out[128:] = _LETTER  # bytes of letters beyond ASCII, mostly
    return out


_CLASS = _classes()


def text_features(texts: list[str]) -> np.ndarray:
    """Texts x FEATURES, of whole texts; zeros for a text without words."""
    raws = [t.encode() for t in texts]
    b = _CLASS[np.frombuffer(b"".join(raws), dtype=np.uint8)]
    sizes = np.array([len(r) for r in raws])
    owner = np.repeat(np.arange(len(raws)) * 8, sizes)
    count = np.bincount(owner + b, minlength=8 * len(raws)).reshape(-1, 8).astype(float)
    out = np.zeros((len(texts), len(FEATURES)))
    letters = np.maximum(1, count[:, _LETTER] + count[:, _UPPER])
    solid = np.maximum(1, sizes - count[:, _SPACE])
    for k, x in ((2, count[:, _UPPER] / letters), (3, count[:, _DIGIT] / solid), (4, count[:, _OTHER] / solid), (5, count[:, _SHOUT] / solid), (6, count[:, _BAR] / solid)):
        out[:, k] = np.sqrt(x)
    for i, t in enumerate(texts):
        w = t.split()
        if not w:
            out[i] = 0
            continue
        lines = t.split("\n")
        out[i, 0] = np.log(len(w))
        out[i, 1] = solid[i] / len(w)
        out[i, 7] = (1 - len(set(w)) / len(w)) ** 2
        out[i, 8] = np.sqrt(sum(map(str.__eq__, w, w[1:])) / len(w))
        out[i, 9] = 1 - len(set(lines)) / len(lines)
        out[i, 10] = np.sqrt(sum(len(x) == 1 and not x.isalnum() for x in w) / len(w))
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    rate: float  # share of label 1 among all labels

    def ratio(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of good against bad, kept within 12 either way."""
        z = (x - self.mean) / self.scale
        z = np.clip(z, -8, 8)
        return np.clip(np.concatenate([z, z * z], axis=1) @ self.weight + self.bias, -12, 12)


def train(x: np.ndarray, y: np.ndarray, rate: float, pull: float = 1.0) -> Model:
    """Ridge logistic regression on features and their squares by Newton's steps; classes weigh the same, so its log odds are a likelihood ratio."""
    k = len(FEATURES)
    if not len(x) or len(set(y.tolist())) < 2:  # no evidence either way
        return Model(np.zeros(k), np.ones(k), np.zeros(2 * k), 0.0, min(max(rate, 0.05), 0.95))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    z = np.concatenate([z, z * z, np.ones((len(z), 1))], axis=1)
    weight, w = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())), np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], pull)
    ridge[-1] = 1e-3
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (p - y)) + ridge * w)
        w -= step * min(1, 2 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, w[:-1], float(w[-1]), min(max(rate, 0.05), 0.95))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> Model:
    """Fit on at most per_class labelled documents of each label, those with the least hash of doc_id; only their features come to the driver."""
    usable = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    rate = usable.agg(F.avg("quality")).first()[0]
    picks = [sample_ids(usable.where(F.col("quality") == y), per_class) for y in (0, 1)]
    chosen = picks[0].union(picks[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(list(text_features(texts)), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    got = sorted(rows.mapInArrow(run, "doc_id long, quality int, x array<double>").collect(), key=lambda r: (r.doc_id, r.x))
    return train(np.array([r.x for r in got]).reshape(-1, len(FEATURES)), np.array([r.quality for r in got]), 0.5 if rate is None else rate)


def with_ratio(docs: DataFrame, model: Model, column: str = "text_ratio") -> DataFrame:
    """The same rows and columns, and the log likelihood ratio of each whole text."""
    names = [*docs.columns, column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(model.ratio(text_features(texts)))], names=names)

    return docs.mapInArrow(run, docs.selectExpr("*", f"cast(null as double) {column}").schema)


def site_rates(scored: DataFrame, rate: float) -> DataFrame:
    """(host, path, host_rate, path_rate) by grouped sums of the soft counts in `scored` (host, path, ratio).

    A group's rate is (its soft count of good ones + strength x the rate above it) / (its size + strength). The strength, for
    hosts and for paths, is that of a beta distribution whose variance is the spread between groups beyond sampling, within
    [2, 1000]; it is computed from a few sums over all groups.
    """
    good = 1 / (1 + F.exp(-(F.col("ratio") + float(np.log(rate / (1 - rate))))))
    paths = staged(scored.groupBy("host", "path").agg(F.sum(good).alias("g"), F.count("*").cast("double").alias("n")), "sites")
    hosts = paths.groupBy("host").agg(F.sum("g").alias("hg"), F.sum("n").alias("hn"))
    top = hosts.agg(F.sum("hg").alias("g"), F.sum("hn").alias("n")).first()
    whole = (top.g + rate) / (top.n + 1) if top.n else rate

    def strength(groups: DataFrame, g: str, n: str) -> float:
        m = F.lit(whole)
        r = groups.agg(F.sum(F.col(n) * (F.col(g) / F.col(n) - m) ** 2).alias("ss"), F.sum(n).alias("n"), F.count("*").alias("k")).first()
        if not r.n or r.k < 2:
            return 50.0
        within = whole * (1 - whole)
        between = r.ss / r.n - within * (r.k - 1) / r.n
        return float(np.clip(within / between - 1, 2, 1000)) if between > 1e-9 else 1000.0

    a, b = strength(hosts, "hg", "hn"), strength(paths, "g", "n")
    hosts = hosts.select("host", ((F.col("hg") + a * whole) / (F.col("hn") + a)).alias("host_rate"))
    return paths.join(hosts, "host").select("host", "path", "host_rate", ((F.col("g") + b * F.col("host_rate")) / (F.col("n") + b)).alias("path_rate"))


def _placed(docs: DataFrame, host: str, path: str) -> DataFrame:
    return docs.withColumn("_host", F.coalesce(F.col(host).cast("string"), F.lit(""))).withColumn("_path", F.coalesce(F.col(path).cast("string"), F.lit("")))


def posterior(scored: DataFrame, rates: DataFrame) -> DataFrame:
    """scored (text_ratio, _host, _path and others) with host_rate, path_rate and quality, the posterior that the document is good."""
    sites = rates.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "host_rate", "path_rate")
    joined = attach(scored, sites, ["_host", "_path"], spread=["doc_id", "text_ratio"])
    return joined.withColumn("quality", 1 / (1 + F.exp(-(F.col("text_ratio") + logit(F.col("path_rate")))))).drop("_host", "_path")


def classify(docs: DataFrame, model: Model, host: str = "source", path: str = "lang", keep_from: float = 0.5) -> DataFrame:
    """Per document: doc_id, text_ratio, host_rate, path_rate, quality, keep (1 if quality >= keep_from).

    One row per input row, repeats too. A null host or path is a group of its own; null texts count as empty ones, whose
    features are zeros. A null doc_id stays null. Other columns are ignored. The path level is host and path together.
    """
    rows = _placed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(host).alias("_h"), F.col(path).alias("_p")), "_h", "_p").drop("_h", "_p")
    scored = staged(with_ratio(rows, model).drop("text"), "quality")
    rates = site_rates(scored.selectExpr("_host host", "_path path", "text_ratio ratio"), model.rate)
    return posterior(scored, rates).withColumn("keep", (F.col("quality") >= keep_from).cast("int")).select("doc_id", "text_ratio", "host_rate", "path_rate", "quality", "keep")


def keep_good(docs: DataFrame, model: Model, host: str = "source", path: str = "lang", keep_from: float = 0.5) -> DataFrame:
    """The documents, all columns whatever their names, that classify() keeps. Two passes over the texts: rates first, then the decision, so texts are never shuffled."""
    docs, names = plain(docs, {"doc_id", "text"})
    at = dict(zip(names, docs.columns, strict=True))
    rows = _placed(docs, at[host], at[path])
    rates = site_rates(with_ratio(rows.select("text", "_host", "_path"), model).selectExpr("_host host", "_path path", "text_ratio ratio"), model.rate)
    kept = posterior(with_ratio(rows, model), rates)
    return kept.where(F.col("quality") >= keep_from).select(*docs.columns).toDF(*names)
