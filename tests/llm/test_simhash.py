import re

import numpy as np
import xxhash

from evidentia.llm import linking, simhash
from evidentia.plans.components import connected_components


def brute_fingerprint(t, words=4):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    """{position: least doc_id of its component}"""
    fp = [brute_fingerprint(t) for _, t in rows]
    f = linking.Forest()
    for i in range(len(rows)):
        f.find(i)
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                f.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = f.find(i)
            least[r] = min(least.get(r, d), d)
    return [(d, f"{fp[i]:016x}", least.get(f.find(i))) for i, (d, _) in enumerate(rows)]


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t ", "One", "one", "two words", "\x1cone ÄB", "É É É É É"]
    for _ in range(25):
        base = rng.choice(vocab, int(rng.integers(5, 300))).tolist()
        for _ in range(int(rng.integers(1, 12))):
            w = list(base)
            for _ in range(int(rng.integers(0, 3))):
                w[rng.integers(0, len(w))] = "new"
            texts.append(" ".join(w))
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)] + [(None, texts[-1]), (None, "alone here now then again")]
    rows += [r for r in rows if r[1] == "one"] * 2
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    got = sorted(map(tuple, simhash.near_dedup(df).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    kept = simhash.keep_one(df).collect()
    want = {c for _, _, c in brute(rows)} - {None}
    assert {r.doc_id for r in kept} - {None} == want and simhash.keep_one(df).columns == df.columns
    assert simhash.near_dedup(df.limit(0)).count() == 0


def test_tiles_keep_every_pair_once(spark):
    df = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 1), (3, 1), (3, 2)], "key long, id long")
    rows = linking.in_tiles(df, "key", "id", tile=7).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.key, r._a, r._b), []).append((r.id, r._t))
    pairs = [(k[0], *sorted((x, y))) for k, v in groups.items() for i, (x, s) in enumerate(v) for y, t in v[:i] if (s != t) or k[1] == k[2]]
    assert len(pairs) == len(set(pairs)) and sorted(pairs) == sorted([(1, i, j) for j in range(50) for i in range(j)] + [(3, 1, 2)])
    assert max(map(len, groups.values())) < 50


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7), (7, 7)] + [(1000, 1001 + i) for i in range(50)]
    f = linking.Forest()
    for a, b in pairs:
        f.join(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*pairs, (None, 5)], "src long, dst long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: min(y for y in linked if f.find(y) == f.find(x)) for x in linked}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_bk_tree_is_exact():
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    xs = list({b ^ (1 << int(i)) ^ (1 << int(j)) ^ (1 << int(k)) for b in base for i, j, k in rng.integers(0, 64, (10, 3))})
    tree, f = simhash.BKTree(4), linking.Forest()
    for i, x in enumerate(xs):
        tree.add(x)
        f.find(x)
        for y in xs[:i]:
            if (x ^ y).bit_count() <= 4:
                f.join(x, y)
    assert all((tree.forest.find(x) == tree.forest.find(y)) == (f.find(x) == f.find(y)) for x in xs for y in xs[:50])


def test_bulk_search_connects_the_same():
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 60)]
    xs = list({b ^ sum(1 << int(i) for i in set(rng.integers(0, 64, int(rng.integers(0, 9))).tolist())) for b in base for _ in range(12)})
    for radius in (4, 6):
        f, g = linking.Forest(), linking.Forest()
        for i, x in enumerate(xs):
            f.find(x), g.find(x)
            for y in xs[:i]:
                if (x ^ y).bit_count() <= radius:
                    f.join(x, y)
        links = simhash.bulk_links(np.array(xs, dtype=np.uint64), radius)
        for i, j in links:
            assert (xs[i] ^ xs[j]).bit_count() <= radius and g.join(xs[i], xs[j])  # a forest
        assert all((f.find(x) == f.find(y)) == (g.find(x) == g.find(y)) for x in xs for y in xs)


def test_keep_one_alike_against_brute_force(spark):
    """Pairs of similarity about 0.8, which SimHash alone parts badly."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(40):
        w = [f"w{x}" for x in rng.integers(0, 5000, 100)]
        texts.append(w)
        for n in (1, 2, 3, 4):
            v = list(w)
            for at in rng.choice(np.arange(5, 95), n, replace=False):
                v[at] = "changed"
            texts.append(v)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(900, None), (901, ""), (None, "a b"), (902, "a b")]
    sets = {}
    for d, t in rows:
        w = (t or "").split()
        k = min(5, len(w))
        if d is not None:
            sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    f, ids = linking.Forest(), sorted(sets)
    for i, a in enumerate(ids):
        f.find(a)
        for b in ids[:i]:
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                f.join(a, b)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one_alike(df, 6, 5, 8).collect()}
    assert kept == {f.find(d) for d in ids} | {None}
    assert kept != {r.doc_id for r in simhash.keep_one(df, 6, 5, 8).collect()}
