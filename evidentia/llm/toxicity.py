"""Toxicity: a convolutional text classifier with hashed word embeddings, trained in numpy.

A word's vector is the sum of three rows of one hashed table: the word's (case folded, without outer punctuation) and those
of its first three and first four letters, so that unseen forms of a known stem score too. Filters of one, two and three words
slide over the vectors; each filter's maximum over the whole text goes through a rectifier into a logistic unit, which is
then calibrated (slope and intercept) on a part of the sample that training does not see, weighted to the labels' true rate.
Thresholds by language come from the same part: they decide `flagged`, never the score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import text_slices

WIDTHS = (1, 2, 3)
#: Words in a worker's table before it starts anew. Bounds memory only.
TABLE_ROWS = 150_000
_OUTER = " .,;:!?*$%&#|\"'()[]{}<>-_=+/\\~`^@"


#: Characters of a text that are taken at a time. Bounds memory only.
LONG = 1 << 20
_BLANK = re.compile(r"\s")


def pieces(text: str, most: int | None = None) -> Iterator[tuple[list[str], bool]]:
    """(words, whether they are the last) of pieces of about `most` characters; each starts with the last words of the one before, as many as a window reaches back."""
    at, carry, most = 0, [], most or LONG
    while at < len(text):
        cut = _BLANK.search(text, at + most)
        end = cut.start() if cut else len(text)
        words = carry + text[at:end].split()
        yield words, end == len(text)
        at, carry = end, words[1 - max(WIDTHS) :]


@dataclass
class Model:
    table: np.ndarray  # buckets x dim
    filters: list[np.ndarray]  # by width: width x dim x filters
    bias: np.ndarray  # of all filters
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    intercept: float = 0.0
    thresholds: dict[str, float] | None = None
    threshold: float = 0.3


def buckets(words: list[str], size: int) -> np.ndarray:
    """Three rows of the hashed table for each word."""
    out = np.empty((len(words), 3), dtype=np.int64)
    for i, raw in enumerate(words):
        w = raw.lower().strip(_OUTER) or raw
        out[i] = zlib.crc32(w.encode()) % size, zlib.crc32(b"3" + w[:3].encode()) % size, zlib.crc32(b"4" + w[:4].encode()) % size
    return out


class Scorer:
    """Scores texts with a model; keeps the products of the words' vectors with all filters."""

    def __init__(self, model: Model):
        self.m = model
        self.wide = np.concatenate([w.reshape(-1, w.shape[2])[k * w.shape[1] : (k + 1) * w.shape[1]] for w in model.filters for k in range(w.shape[0])], axis=1)
        self._fresh()

    def _fresh(self) -> None:
        self.rows: dict[str, int] = {}
        self.made = np.zeros((1024, self.wide.shape[1]), dtype=np.float32)  # row 0: no word

    def ids(self, words: list[str]) -> list[int]:
        got = list(map(self.rows.get, words))
        if None in got:
            if len(self.rows) > TABLE_ROWS:
                self._fresh()
                got = [None] * len(words)
            new = list({w for w, i in zip(words, got, strict=True) if i is None})
            at = len(self.rows) + 1
            self.rows.update(zip(new, range(at, at + len(new)), strict=True))
            if at + len(new) > len(self.made):
                self.made = np.concatenate([self.made, np.zeros((at + len(new), self.made.shape[1]), dtype=np.float32)])
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                self.made[at + i : at + i + len(part)] = self.m.table[buckets(part, len(self.m.table))].sum(axis=1) @ self.wide
            got = list(map(self.rows.__getitem__, words))
        return got

    def pooled(self, texts: list[str]) -> np.ndarray:
        """Texts x filters: each filter's maximum over the whole text, rectified. Texts beyond LONG characters are taken piece by piece."""
        out = np.empty((len(texts), len(self.m.bias)), dtype=np.float32)
        short = [i for i, t in enumerate(texts) if len(t) <= LONG]
        if short:
            out[short] = self._peaks([texts[i].split() for i in short])
        for i in (i for i, t in enumerate(texts) if len(t) > LONG):
            out[i] = np.maximum.reduce([self._peaks([w], last)[0] for w, last in pieces(texts[i])])
        return np.maximum(out + self.m.bias, 0)

    def _peaks(self, texts: list[list[str]], last: bool = True) -> np.ndarray:
        """Each filter's maximum over texts of words; if they are not the last pieces of theirs, only where a window ends within."""
        words = [x for w in texts for x in w]
        n = np.array([len(w) for w in texts])
        starts = np.concatenate([[0], np.cumsum(n + 2)])[:-1]  # two empty places after each text
        ids = np.zeros(int(n.sum()) + 2 * len(n), dtype=np.int64)
        place = np.arange(n.sum()) + np.repeat(2 * np.arange(len(n)), n)
        ids[place] = self.ids(words)
        h = self.made[ids]
        gap = np.ones(len(ids), dtype=bool)
        gap[place] = False
        outs, at = [], 0
        for w in self.m.filters:
            width, f = w.shape[0], w.shape[2]
            z = h[:, at : at + f].copy()
            for k in range(1, width):
                z[: len(z) - k] += h[k:, at + k * f : at + (k + 1) * f]
            z[gap] = -np.inf
            if not last:
                for s, e in zip(starts, starts + n, strict=True):
                    z[max(s, e - width + 1) : e] = -np.inf
            outs.append(np.maximum.reduceat(z, starts, axis=0))
            at += width * f
        return np.concatenate(outs, axis=1)

    def __call__(self, texts: list[str]) -> np.ndarray:
        logit = self.pooled(texts).astype(np.float64) @ self.m.out + self.m.out_bias
        return 1 / (1 + np.exp(-np.clip(self.m.slope * logit + self.m.intercept, -40, 40)))


def train(texts: list[str], y: list[int], langs: list[str], rate: float, dim: int = 8, filters: int = 8, size: int = 1 << 15, epochs: int = 5, batch: int = 48, seed: int = 7) -> Model:
    """Fit by Adam on four fifths of the sample, keep the rest for calibration. `rate`: the share of label 1 among all labels."""
    rng = np.random.default_rng(seed)
    m = Model(rng.normal(0, 0.1, (size, dim)).astype(np.float32), [rng.normal(0, 0.5 / np.sqrt(w * dim), (w, dim, filters)).astype(np.float32) for w in WIDTHS], np.zeros(filters * len(WIDTHS), np.float32), rng.normal(0.3, 0.1, filters * len(WIDTHS)).astype(np.float32), 0.0)
    y = np.asarray(y, dtype=np.float64)
    if len(set(y.tolist())) < 2:  # nothing to tell apart
        m.out[:] = 0
        m.out_bias = -4.0 if not y.any() else 4.0
        return m
    known: dict[str, int] = {}
    docs = [np.fromiter((known.setdefault(w, len(known)) for w in t.split()), dtype=np.int32) for t in texts]
    rows = np.concatenate([buckets(list(known), size), np.full((1, 3), size, np.int64)])  # the last: no word, an empty row of the table
    none, calib = len(known), np.arange(len(docs)) % 5 == 4
    table = np.concatenate([m.table, np.zeros((1, dim), np.float32)])
    params = [table, *m.filters, m.bias, m.out, np.zeros(1, np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    order = np.flatnonzero(~calib)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in range(0, len(order), batch):
            take = order[i : i + batch]
            n = np.asarray([len(docs[j]) for j in take])
            ids = np.full(int(n.sum()) + 2 * len(n), none)
            place = np.arange(n.sum()) + np.repeat(2 * np.arange(len(n)), n)
            ids[place] = np.concatenate([docs[j] for j in take])
            starts = np.concatenate([[0], np.cumsum(n + 2)])[:-1]
            v = table[rows[ids]].sum(axis=1)
            gap = np.ones(len(ids), dtype=bool)
            gap[place] = False
            pooled, arg = [], []
            for w in params[1 : 1 + len(WIDTHS)]:
                z = v @ w[0]
                for k in range(1, len(w)):
                    z[: len(z) - k] += v[k:] @ w[k]
                z[gap] = -1e9
                best = np.maximum.reduceat(z, starts, axis=0)
                at = np.empty(best.shape, dtype=np.int64)
                for d, (a, b) in enumerate(zip(starts, starts + n + 2, strict=True)):
                    at[d] = a + z[a:b].argmax(axis=0)
                pooled.append(best), arg.append(at)
            z = np.concatenate(pooled, axis=1) + params[-3]
            h = np.maximum(z, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ params[-2] + params[-1], -30, 30)))
            d = ((p - y[take]) / len(take)).astype(np.float32)
            grads = [np.zeros_like(x) for x in params]
            grads[-2], grads[-1] = h.T @ d, d.sum(keepdims=True)
            dz = np.outer(d, params[-2]) * (z > 0)
            grads[-3] = dz.sum(axis=0)
            for q, (w, at) in enumerate(zip(params[1 : 1 + len(WIDTHS)], arg, strict=True)):
                own = dz[:, q * filters : (q + 1) * filters]
                for k in range(len(w)):
                    where = np.minimum(at + k, len(ids) - 1)  # docs x filters
                    vk = v[where]
                    grads[1 + q][k] += np.einsum("df,dfe->ef", own, vk)
                    back = np.einsum("df,ef->dfe", own, w[k]).reshape(-1, dim)
                    hit = np.repeat(back, 3, axis=0)
                    np.add.at(grads[0], rows[ids[where]].reshape(-1), hit)
            grads[0][size] = 0
            step += 1
            for k, (x, g) in enumerate(zip(params, grads, strict=True)):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                x -= 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    m.table, m.out_bias = table[:size], float(params[-1][0])
    _calibrate(m, [texts[i] for i in np.flatnonzero(calib)], y[calib], [langs[i] for i in np.flatnonzero(calib)], rate)
    return m


def _calibrate(m: Model, texts: list[str], y: np.ndarray, langs: list[str], rate: float) -> None:
    if len(set(y.tolist())) < 2:
        return
    score = Scorer(m)
    p = np.concatenate([score(texts[i : i + 200]) for i in range(0, len(texts), 200)])
    x = np.log(p / (1 - p + 1e-12) + 1e-12)
    weight = np.where(y > 0, rate / y.mean(), (1 - rate) / (1 - y.mean()))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's steps with a small pull to slope 1
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (q - y) * x).sum() + 0.1 * (a - 1), (weight * (q - y)).sum() + 0.01 * b])
        s = weight * q * (1 - q)
        hess = np.array([[(s * x * x).sum() + 0.1, (s * x).sum()], [(s * x).sum(), s.sum() + 0.01]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(hess, g), -1, 1)
    m.slope, m.intercept = float(a), float(b)
    p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))

    def best(mask: np.ndarray) -> float:
        grid = np.linspace(0.05, 0.95, 19)
        f1 = [2 * (weight * y * (p >= t) * mask).sum() / max(1e-9, (weight * mask * (y + (p >= t))).sum()) for t in grid]
        return float(np.median(grid[np.asarray(f1) >= max(f1) - 1e-9]))

    m.threshold = best(np.ones(len(y), bool))
    lang = np.asarray([x or "" for x in langs])
    m.thresholds = {str(k): best(lang == k) for k in set(lang.tolist()) if y[lang == k].sum() >= 5 and (1 - y[lang == k]).sum() >= 5}


def held_out(doc_id: str = "doc_id"):
    """Rows whose crc32(doc_id as text) mod 4 is 2: never learnt from. A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = (2000, 3000)) -> Model:
    """Fit on a bounded sample of labelled rows: at most per_class[1] of label 1 ... of label 0 that aren't held out.

    per_class bounds (label 1, label 0). Which rows: those with the least hash of doc_id, so the sample doesn't depend on
    partitions. Labels that are null are left out; of repeated labels the largest counts.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rate = usable.agg(F.avg("toxic")).first()[0] or 0.0
    picks = [r for y, most in ((1, per_class[0]), (0, per_class[1])) for r in usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r.doc_id, r.toxic) for r in picks], "doc_id long, toxic int")
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "cast(lang as string) lang")
    # bounded by per_class
    got = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "lang", "toxic").toArrow().to_pylist()
    got = sorted(got, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"] or ""))
    return train([r["text"] or "" for r in got], [r["toxic"] for r in got], [r["lang"] for r in got], rate)


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Score every text whole: doc_id, held_out, score, predicted (score >= threshold), lang_threshold, flagged (score >= that).

    One row per input row, repeats too. Null texts count as empty and get the score of no evidence. lang only picks the
    calibrated threshold; an unknown or null lang gets the common one. A null doc_id stays null. Other columns are ignored.
    """
    bc = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: the hashed table and the filters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bc.value
        score, by = Scorer(m), m.thresholds or {}
        for batch in batches:
            for a, b, texts in text_slices(batch, "text"):
                s = score(texts)
                lang = [by.get(x, m.threshold) for x in batch.column(3).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(lang), pa.array((s >= np.asarray(lang)).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted", "lang_threshold", "flagged"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, lang_threshold double, flagged int")
