import re

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from evidentia.llm import linedup, linking, quality, secrets

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    k = min(corpus_pipeline.NEAR_WORDS, len(w))
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "secrets", "packing"]
    tables = [docs.collect()]
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, SF).toArrow(), at.schema)
        assert at.columns == names
        tables.append(at.collect())
    start, good, lines, near, safe = ({r.doc_id: r for r in t} for t in tables)
    # quality: the plain formula over all documents
    m = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    ratio = dict(zip(start, m.ratio(quality.text_features([r.text or "" for r in start.values()])), strict=True))
    rates = {(r.host, r.path): r.path_rate for r in quality.site_rates(spark.createDataFrame([(r.source, r.lang, float(ratio[d])) for d, r in start.items()], "host string, path string, ratio double"), m.rate).collect()}
    odds = {d: ratio[d] + np.log(rates[r.source, r.lang] / (1 - rates[r.source, r.lang])) for d, r in start.items()}
    assert set(good) == {d for d, x in odds.items() if x >= 0}
    assert np.mean([(d in good) == (q == 1) for d, q in labels.items()]) > 0.97
    # line dedup: every class keeps its first line only
    place = {(d, i): s for d in sorted(good) for i, s in linedup.lines_of(good[d].text or "", 1)}
    texts = sorted(set(place.values()), key=len)
    f = linking.Forest()
    by_size = {}
    for s in texts:
        f.find(s)
        for n in range(len(s) - 2, len(s) + 1) if len(s) >= linedup.LEAST_CHARS else ():
            for other in by_size.get(n, ()):
                if n >= linedup.LEAST_CHARS and linedup.within(other, s, 2):
                    f.join(other, s)
        by_size.setdefault(len(s), []).append(s)
    seen, want = set(), {}
    for d in sorted(good):
        out = []
        for i, x in enumerate((good[d].text or "").split("\n")):
            s = place.get((d, i))
            if s is None or f.find(s) not in seen:
                out.append(x)
            if s is not None:
                seen.add(f.find(s))
        want[d] = "\n".join(out)
    assert {d: r.text for d, r in lines.items()} == want
    # near copies: one of each component of pairs whose sets of five words are alike stays
    sets = {d: shingles(r.text) for d, r in lines.items()}
    ids = sorted(lines)
    g = linking.Forest()
    for i, d in enumerate(ids):
        g.find(d)
        for e in ids[:i]:
            a, b = sets[d], sets[e]
            if a == b or min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                g.join(d, e)
    assert set(near) == {g.find(d) for d in ids}
    # secrets: none of the fixed patterns is left, and other text is untouched
    assert set(safe) == set(near)
    for d, r in safe.items():
        assert not secrets.base_spans(r.text)
        if not secrets.base_spans(near[d].text) and "[SECRET]" not in r.text:
            assert r.text == near[d].text
    # packing: every id once
    rows = corpus_pipeline.packed(spark, at, SF).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    count = {}
    for r in rows:
        count[r.doc_id] = count.get(r.doc_id, 0) + r.length
    assert count == {d: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for d, r in safe.items()}


def test_odd_documents(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, "fine words here and there", None, "s", 25), (3, "fine words here and there", None, "s", 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            d = stage(spark, d, SF)
            assert d.columns == docs.columns
        assert corpus_pipeline.packed(spark, d, SF).count() >= 0
