import numpy as np
from pyspark.sql import functions as F

from evidentia.llm import neighbours, queries


def brute(rows, k=10):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in good if i != q and len(y) == len(x))[:k]
            out[q] = near
    return out


def test_exact_on_small_and_odd_tables(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(0, 24)] + [(100, rng.normal(size=8).tolist()), (200, [0.0] * 8), (300, None), (400, []), (500, [1.0, None] + [1.0] * 6), (600, [float("nan")] * 8), (700, [1.0, 2.0]), (701, [1.0, 2.5]), (None, [1.0] * 8), (30, [2.0] * 8), (31, [2.0] * 8), (31, [2.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    want = brute(rows)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert {q: [(s, i) for _, s, i in sorted(v)] for q, v in got.items()} == {q: v for q, v in want.items() if v}
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_recall_over_blocks(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    rows = neighbours.nearest(df, F.col("vec_id") % 100 == 0, block=700).collect()
    assert len(rows) == 10 * len(want)
    hit = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in rows)
    assert hit / len(rows) >= 0.9
    assert all(any(r.score == s for s, i in want[r.query_id] if i == r.vec_id) or r.vec_id not in {i for _, i in want[r.query_id]} for r in rows)


def test_hot_vector_ties_go_to_small_ids(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0] * 16) for i in range(1, 400)] + [(1000 + i, rng.normal(size=16).tolist()) for i in range(1, 800)] + [(0, [1.0] * 15 + [1.5])]
    got = queries.neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 11))


def test_ends_on_huge_components(spark):
    """Components up to the largest double: the search ends, and distances stay finite where they are."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 60)] + [(0, rng.normal(size=8).tolist()), (100, [1e308] + [0.0] * 7), (200, [1e150] * 8), (201, [1.1e150] * 8), (300, [-1e308] + [1e-308] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300} and all(len(v) == 10 for v in got.values())
    assert sorted(got[0]) == [(n + 1, i, s) for n, (s, i) in enumerate(brute([x for x in rows if x[0] not in (100, 200, 300)])[0])]
    assert sorted(got[100])[0][1:] == (201, 1e308) or np.isclose(sorted(got[100])[0][2], 1e308)
    assert sorted(got[200])[0][1] == 201 and np.isclose(sorted(got[200])[0][2], np.sqrt(8) * 1e149)


def test_all_in_one_place(spark):
    """Equal vectors, some queries among them: windows reach all of them at once."""
    rows = [(i, [2.0, 3.0]) for i in range(300)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(q, n + 1, i) for q in (0, 100, 200) for n, i in enumerate([x for x in range(12) if x != q][:10])]
