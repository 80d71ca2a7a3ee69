"""Language identification by Bayesian evidence fusion.

log P(language | all) = log P(language | host) + log P(text | language) + log P(declared | language) + log P(suffix | language).
Text: hashed byte trigrams with smoothed frequencies by language, counted on a bounded sample of labelled texts. A long text
would drown everything else, so its sum is scaled to that of at most TEXT_WEIGHT trigrams. Declared: the lang attribute of
markup; suffix: the last label of the host's name. Their tables, and the host's priors, come from grouped sums of the text
posteriors over all rows: hosts shrink toward their domain, domains toward the whole, and a row's own share is taken out of its
host's sums. Evidence that is missing counts as none.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import attach, plain, text_slices
from evidentia.plans.runtime import staged

BUCKETS = 1 << 16
TEXT_WEIGHT = 60
#: Strengths of the priors toward the level above: host to domain, domain to the whole, suffix and declared language to the whole.
HOST_PULL, DOMAIN_PULL, TABLE_PULL = 8.0, 8.0, 4.0
#: Bytes of a text whose trigrams are looked up at a time. Bounds memory only.
LONG = 1 << 18
_DROPPED = re.compile(r"<(script|style|nav|footer|noscript)\b|<!--", re.I)
_MAIN = re.compile(r"<(article|main)\b", re.I)
_CLOSED = re.compile(r"</(script|style|nav|footer|noscript|article|main)\s*>", re.I)
_TAG = re.compile(r"<[^>]*>")
_HTML = re.compile(r"<html\b", re.I)
_LANG = re.compile(r"""\blang\s*=\s*["']?([A-Za-z]+)""", re.I)


def _closers(html: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {}
    for m in _CLOSED.finditer(html):
        out.setdefault(m[1].lower(), []).append(m.span())
    return out


def _first(spans: list[tuple[int, int]], at: int) -> tuple[int, int] | None:
    i = bisect_left(spans, (at, 0))
    return spans[i] if i < len(spans) else None


def visible_text(html: str) -> str:
    """The text of the article or main element, or else of the whole page, without scripts, styles, navigation and footers.

    An element ends at its name's first closing tag; one that is not closed is no element, only a tag. Every step is linear in the page.
    """
    closed, out, at, comments = _closers(html), [], 0, True
    for m in _DROPPED.finditer(html):
        if m.start() < at:
            continue
        if m[1]:
            end = (_first(closed.get(m[1].lower(), []), m.end()) or (0, 0))[1]
        else:
            end = html.find("-->", m.end()) + 3 if comments else 2
            comments = end > 2
        if end > m.end():
            out += [html[at : m.start()], " "]
            at = end
    html = "".join([*out, html[at:]])
    closed, main, at = _closers(html), [], 0
    for m in _MAIN.finditer(html):
        if m.start() >= at:
            start = html.find(">", m.end()) + 1
            if not start:
                break
            if end := _first(closed.get(m[1].lower(), []), start):
                main.append(html[start : end[0]])
                at = end[1]
    html = " ".join(main) or html
    tags = html.rfind(">") + 1  # before it, each < finds an end
    return " ".join(unescape(_TAG.sub(" ", html[:tags]) + html[tags:]).split())


def declared_language(html: str) -> str | None:
    """The lang attribute of the first html tag, in lower case."""
    if not (m := _HTML.search(html)):
        return None
    end = html.find(">", m.end())
    found = _LANG.search(html, m.end(), end if end >= 0 else len(html))
    return found[1].lower() if found else None


def _codes(raw: np.ndarray) -> np.ndarray:
    """A bucket for the trigram that starts at each byte but the last two."""
    r = raw.astype(np.uint32)
    return (r[:-2] * np.uint32(961) ^ r[1:-1] * np.uint32(31_337) ^ r[2:] * np.uint32(7_919) * np.uint32(3)) & np.uint32(BUCKETS - 1)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages, log frequency

    def log_likelihood(self, texts: list[str]) -> np.ndarray:
        """Texts x languages, each sum scaled to at most TEXT_WEIGHT trigrams; zeros for texts of fewer than three bytes."""
        raws = [b" " + t.encode() + b" " for t in texts]
        sizes = np.array([len(r) for r in raws])
        total = np.zeros((len(texts), len(self.languages)))
        long = sizes > LONG
        for i in np.flatnonzero(long).tolist():
            for at in range(0, len(raws[i]) - 2, LONG):
                total[i] += self.table[_codes(_FOLD[np.frombuffer(raws[i][at : at + LONG + 2], dtype=np.uint8)])].sum(axis=0, dtype=np.float64)
        if (short := np.flatnonzero(~long)).size:
            raw = _FOLD[np.frombuffer(b"".join([raws[i] for i in short.tolist()]), dtype=np.uint8)]
            ends = np.cumsum(sizes[short])
            each = np.concatenate([self.table[_codes(raw)], np.zeros((2, len(self.languages)), np.float32)])
            for k in (1, 2):  # trigrams that run over an end
                each[ends - k] = 0
            total[short] = np.add.reduceat(each, ends - sizes[short], axis=0, dtype=np.float64)
        n = np.maximum(1, sizes - 2)
        total[sizes < 5] = 0
        return total * (np.minimum(n, TEXT_WEIGHT) / n)[:, None]


def fit(docs: DataFrame, per_language: int = 1000) -> Model:
    """Count trigrams of every language that a row names, each over at most `per_language` rows (those with the least hash of doc_id).

    The table holds BUCKETS numbers of four bytes for each language. Rows without doc_id, lang or text are not learnt from.
    """
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.trim(F.col("lang").cast("string"))).alias("lang"), F.col("text").cast("string").alias("text")).where("doc_id is not null and lang != '' and text is not null")
    # of each language, rows whose hash is within about twice the sample's share; the least of these are the least of all, and few
    ids = usable.select("doc_id", "lang", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("_h"))
    sized = attach(ids, usable.groupBy("lang").agg(F.count("*").alias("_n")), ["lang"], spread=["doc_id"])
    few = sized.where(F.col("_h") < F.least(F.lit(1.0), 2.0 * per_language / F.col("_n")) * float(1 << 63)).select("doc_id", "lang", "_h").distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))
    chosen = few.withColumn("_r", first).where(F.col("_r") <= per_language).select("doc_id", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for a, b, texts in text_slices(batch, "text"):
                for lang, t in zip(batch.column(0).slice(a, b - a).to_pylist(), texts, strict=True):
                    raw = b" " + t.encode() + b" "
                    if len(raw) > 4:
                        sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                        for at in range(0, len(raw) - 2, LONG):
                            sums[lang] += np.bincount(_codes(_FOLD[np.frombuffer(raw[at : at + LONG + 2], dtype=np.uint8)]), minlength=BUCKETS)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(s[at])], names=["lang", "bucket", "n"])

    counted = usable.join(staged(chosen, "langid_sample"), ["doc_id", "lang"]).select("lang", "text").mapInArrow(run, "lang string, bucket int, n long")
    # bounded by languages x buckets
    got = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    codes = got["lang"].combine_chunks().dictionary_encode()
    found, lang, at, n = codes.dictionary.to_pylist(), codes.indices.to_numpy(), got["bucket"].to_numpy(), got["n"].to_numpy()
    names = sorted(found)
    count = np.full((BUCKETS, len(names)), 0.1)
    count[at, np.array([names.index(x) for x in found], dtype=np.int64)[lang]] += n
    return Model(names, np.log(count / count.sum(axis=0)).astype(np.float32))


def _log_sum(cols: list[Column]) -> Column:
    top = F.greatest(*cols) if len(cols) > 1 else cols[0]
    return top + F.log(reduce(lambda a, b: a + b, [F.exp(c - top) for c in cols]))


def identify(rows: DataFrame, model: Model) -> DataFrame:
    """Fuse the evidence on rows (key columns..., html, text, url, site); html counts before text, url's host before site.

    Returns the key columns (all others), declared, suffix, host, lang, confidence and one probability p_<language> each. A key column
    with one of these names comes back as input_<name>. Rows with neither text nor markup have no text evidence; a null or odd url has no host, domain or suffix. Ties go to the language
    that comes first by name. One row per input row, repeats too. With no languages learnt, lang is null.
    """
    rows, before = plain(rows, {"html", "text", "url", "site"})
    keys = [c for c in rows.columns if c not in ("html", "text", "url", "site")]
    names = model.languages
    shares = [f"p_{re.sub(r'[^a-z0-9]', '_', n)}" for n in names]
    for i, n in enumerate(shares):  # names that differ in other characters only
        shares[i] = n if n not in shares[:i] else f"{n}_{i}"
    own = {"declared", "suffix", "host", "lang", "confidence", *shares}
    named = [c if c.lower() not in own else f"input_{c}" for c in before if c not in ("html", "text", "url", "site")]
    if not names:
        return rows.select(*keys, *(F.lit(None).cast("string").alias(c) for c in ("declared", "suffix", "host", "lang")), F.lit(None).cast("double").alias("confidence")).toDF(*named, "declared", "suffix", "host", "lang", "confidence")
    spread = [*(f.name for f in rows.schema if f.name in keys and not any(t in f.dataType.simpleString() for t in ("map<", "variant"))), "t_0"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = {n: batch.schema.get_field_index(n) for n in batch.schema.names}
            for a, b, bodies in text_slices(batch, "body"):
                part = batch.slice(a, b - a)
                markup = part.column(where["is_html"]).to_pylist()
                declared = [declared_language(t) if h else None for h, t in zip(markup, bodies, strict=True)]
                ll = model.log_likelihood([visible_text(t) if h else t for h, t in zip(markup, bodies, strict=True)])
                keep = [part.column(where[k]) for k in [*keys, "host"]]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(declared, pa.string()), *(pa.array(ll[:, k]) for k in range(len(names)))], names=[*keys, "host", "declared", *(f"t_{k}" for k in range(len(names)))])

    host = F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    shaped = rows.select(*keys, F.coalesce(F.col("html"), F.col("text")).cast("string").alias("body"), F.col("html").isNotNull().alias("is_html"), F.coalesce(F.when(host != "", host), F.col("site").cast("string")).alias("host"))
    none = F.lit(None)
    schema = shaped.select(*keys, "host", none.cast("string").alias("declared"), *(none.cast("double").alias(f"t_{k}") for k in range(len(names)))).schema
    seen = staged(shaped.mapInArrow(run, schema), "langid")
    t = [F.col(f"t_{k}") for k in range(len(names))]
    norm = _log_sum(t)
    labels = F.split("host", r"\.")
    seen = seen.select(*keys, "host", "declared", *(f"t_{k}" for k in range(len(names))), F.when(F.col("host").contains("."), F.element_at(labels, -1)).alias("suffix"), F.when(F.col("host").contains("."), F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2))).otherwise(F.col("host")).alias("domain"), *(F.exp(x - norm).alias(f"s_{k}") for k, x in enumerate(t)))
    soft = [f"s_{k}" for k in range(len(names))]

    def sums(key: str, prefix: str) -> DataFrame:
        return seen.where(F.col(key).isNotNull()).groupBy(key, *(["domain"] if key == "host" else [])).agg(*(F.sum(s).alias(f"{prefix}_{k}") for k, s in enumerate(soft)))

    top = seen.agg(*(F.sum(s).alias(s) for s in soft)).first()
    whole = np.array([x or 0.0 for x in top]) + 1.0
    size, whole = whole.sum(), whole / whole.sum()
    domains = sums("domain", "d")
    d_total = reduce(lambda a, b: a + b, [F.col(f"d_{k}") for k in range(len(names))])
    domains = domains.select("domain", *(((F.col(f"d_{k}") + DOMAIN_PULL * float(whole[k])) / (d_total + DOMAIN_PULL)).alias(f"d_{k}") for k in range(len(names))))
    hosts = sums("host", "h").join(domains, "domain").drop("domain")
    out = attach(seen, hosts, ["host"], spread=spread)
    for key, prefix in (("declared", "m"), ("suffix", "x")):
        total = reduce(lambda a, b: a + b, [F.col(f"{prefix}_{k}") for k in range(len(names))])
        # P(value | language), smoothed toward the value's own share
        table = sums(key, prefix)
        table = table.select(key, *(F.log((F.col(f"{prefix}_{k}") + TABLE_PULL * total / float(size)) / (float(whole[k] * size) + TABLE_PULL)).alias(f"{prefix}_{k}") for k in range(len(names))))
        out = attach(out, table, [key], spread=spread)
    h_total = reduce(lambda a, b: a + b, [F.col(f"h_{k}") for k in range(len(names))])
    post = []
    for k in range(len(names)):
        prior = (F.greatest(F.col(f"h_{k}") - F.col(f"s_{k}"), F.lit(0.0)) + HOST_PULL * F.col(f"d_{k}")) / (F.greatest(h_total - 1, F.lit(0.0)) + HOST_PULL)
        post.append(F.log(F.coalesce(prior, F.lit(float(whole[k])))) + F.col(f"t_{k}") + F.coalesce(F.col(f"m_{k}"), F.lit(0.0)) + F.coalesce(F.col(f"x_{k}"), F.lit(0.0)))
    out = out.select(*keys, "declared", "suffix", "host", *(p.alias(f"q_{k}") for k, p in enumerate(post)))
    z = _log_sum([F.col(f"q_{k}") for k in range(len(names))])
    probs = [F.exp(F.col(f"q_{k}") - z).alias(n) for k, n in enumerate(shares)]
    best = F.greatest(*(F.col(f"q_{k}") for k in range(len(names)))) if len(names) > 1 else F.col("q_0")
    lang = F.coalesce(*(F.when(F.col(f"q_{k}") == best, F.lit(n)) for k, n in enumerate(names)))
    return out.select(*keys, "declared", "suffix", "host", lang.alias("lang"), F.exp(best - z).alias("confidence"), *probs).toDF(*named, "declared", "suffix", "host", "lang", "confidence", *shares)
