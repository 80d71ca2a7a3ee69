import numpy as np

from evidentia.llm import linedup, linking, queries


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = int(rng.integers(0, 3))
        at = int(rng.integers(0, len(s) + 1))
        s[at : at + (k != 0)] = [] if k == 1 else [str(rng.choice(list("abcé")))]
    return "".join(s)


def test_within_against_distance():
    rng = np.random.default_rng(0)
    for _ in range(3000):
        a = "".join(rng.choice(list("ab"), int(rng.integers(0, 12))))
        b = edited(rng, a, int(rng.integers(0, 5))) if a and rng.random() < 0.7 else "".join(rng.choice(list("ab"), int(rng.integers(0, 12))))
        for most in (1, 2, 3):
            assert linedup.within(a, b, most) == (distance(a, b) <= most), (a, b, most)


def test_probes_find_every_near_line():
    rng = np.random.default_rng(1)
    for _ in range(800):
        a = "".join(rng.choice(list("abcd"), int(rng.integers(9, 40))))
        b = edited(rng, a, 2)
        if distance(a, b) <= 2:
            short, long = sorted((a, b), key=len)
            assert set(linedup.index_keys(short, 2)) & linedup.probe_keys(long, 2)
            assert linedup._first_key(short, long, 2) is not None


def test_classes_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = ["".join(rng.choice(list("abcdefgh "), int(rng.integers(45, 90)))).strip() for _ in range(12)] + ["é" * 60]
    rows = []
    for d in range(60):
        lines = [edited(rng, str(rng.choice(base)), int(rng.integers(0, 3))) if rng.random() < 0.8 else "short" for _ in range(int(rng.integers(1, 6)))]
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n \n"), (None, base[0]), (103, base[1] * 400), (104, base[1] * 400 + "x"), rows[5]]
    df = spark.createDataFrame([(d, t, "x", 5) for d, t in rows], "doc_id long, text string, id string, n_chars long")
    got = {(r.doc_id, r.line_no): r for r in linedup.line_classes(df, least=20).collect()}
    occ = sorted({(d, i): s for d, t in rows if d is not None for i, s in linedup.lines_of(t or "", 20)}.items())
    texts = sorted({s for _, s in occ})
    f, links = linking.Forest(), dict.fromkeys(texts, 0)
    for i, a in enumerate(texts):
        f.find(a)
        for b in texts[:i]:
            if abs(len(a) - len(b)) <= 2 and (len(a) > 1000 or distance(a, b) <= 2) and linedup.within(a, b, 2):
                f.join(a, b)
                links[a] += 1
                links[b] += 1
    first = {}
    for place, s in occ:
        first.setdefault(f.find(s), place)
    assert len(got) == len(occ)
    for place, s in occ:
        r = got[place]
        assert ((r.class_doc_id, r.class_line_no), r.n_links, r.kept) == (first[f.find(s)], links[s], place == first[f.find(s)]), (place, s)
    out = linedup.drop_repeated_lines(df, least=20).collect()
    assert len(out) == len(rows) and [r.text for r in out if r.doc_id is None] == [base[0]]
    by = {r.doc_id: r for r in out}
    for d, t in dict(rows).items():
        if d is not None and t is not None:
            want = [x for i, x in enumerate(t.split("\n")) if (d, i) not in got or got[d, i].kept]
            assert by[d].text == "\n".join(want) and by[d].n_chars == len(by[d].text)
    assert linedup.line_classes(df.limit(0)).count() == 0 and linedup.drop_repeated_lines(df.limit(0)).count() == 0


def test_short_lines(spark, tmp_path):
    """Exact copies of any length; near copies from LEAST_CHARS on."""
    rows = [(1, "All rights reserved.\nYes.\n\n  \nNo."), (2, " Yes. \nAll rights reserved!\nNo!")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.n_links, r.kept) for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {(1, 0): (1, 0, 1, True), (1, 1): (1, 1, 0, True), (1, 4): (1, 4, 0, True), (2, 0): (1, 1, 0, False), (2, 1): (1, 0, 1, False), (2, 2): (2, 2, 0, True)}
    out = {r.doc_id: r.text for r in linedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[2] == " Yes. \nNo!"


def test_within_many_against_distance():
    rng = np.random.default_rng(3)
    for n in (1, 4, 9, 17):
        for m in range(max(0, n - 3), n + 4):
            a = rng.integers(97, 99, (60, n)).astype(np.uint32)
            b = np.array([(list(map(ord, edited(rng, "".join(map(chr, r)), 2))) + rng.integers(97, 99, 20).tolist())[:m] for r in a], dtype=np.uint32).reshape(60, m)
            for most in (1, 2, 3):
                want = [distance(x.tolist(), y.tolist()) <= most for x, y in zip(a, b, strict=True)]
                assert linedup.within_many(a, b, most).tolist() == want


def template_docs():
    """Variants of one template, so that all share a segment, among other lines and copies."""
    rng = np.random.default_rng(4)
    codes = rng.choice(100_000, 700, replace=False).tolist()
    lines = [f"This passage is item {c:05d} of the common archive" for c in codes] + [f"Another line that nothing is like {c * 7919 % 99991:x}-{c:x}" for c in codes[:50]]
    return lines, [(i // 3, x + ("\n" + lines[int(rng.integers(0, len(lines)))] if i % 5 == 0 else "")) for i, x in enumerate(lines)]


def test_hot_segment_against_brute_force(spark):
    """Production parameters over one template; hot keys are dealt out, tiles are small, groups are checked in bulk. Counts and classes are exact."""
    lines, rows = template_docs()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    distinct = sorted({s for _, t in rows for s in t.split("\n")})
    short = [s[21:26] if s.startswith("This") else s for s in distinct]
    f, links = linking.Forest(), dict.fromkeys(distinct, 0)
    for i, a in enumerate(distinct):
        f.find(a)
        for j in range(i):
            b = distinct[j]
            if abs(len(a) - len(b)) <= 2 and (a[:4] == b[:4]) and distance(short[i], short[j]) <= 2:
                f.join(a, b)
                links[a] += 1
                links[b] += 1
    for hot, tile in ((linedup.HOT, linking.TILE), (4, 150)):
        edges, degrees = linedup.edit_links(df, linedup.EDITS, linedup.LEAST_CHARS, hot=hot, tile=tile)
        by = {linedup.xxhash.xxh3_128_digest(s.encode()): s for s in distinct}
        assert {by[bytes(r.h)]: r.n_links for r in degrees.collect()} == {s: n for s, n in links.items() if n}
        quick, none = linedup.edit_links(df, linedup.EDITS, linedup.LEAST_CHARS, counts=False, hot=hot, tile=tile)
        assert none.count() == 0 and quick.count() <= edges.count()
        for made in (edges, quick):
            g = linking.Forest()
            for r in made.collect():
                g.join(by[bytes(r.src)], by[bytes(r.dst)])
            assert [g.find(s) for s in distinct] == [f.find(s) for s in distinct]
    entries = linedup.key_rows(df, 2, 20, hot=4)
    assert entries.where("mark >= 4").count() > 1000


def test_groups_in_bulk_and_one_by_one_agree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abc"), 24)) for _ in range(6)]
    rows = [(h.encode(), 3, i % 2, s) for i, (h, s) in enumerate(sorted({(f"{i:04d}", edited(rng, base[i % 6], 2)) for i in range(90)}))]
    for key in sorted({k for r in rows for k in linedup.index_keys(r[3], 2)})[::9]:
        key = linedup._signed(key)
        for same in (True, False):
            want = {(p[0], q[0]) for p in rows for q in rows if p[0] != q[0] and (p[2] == q[2]) == same and 0 <= len(p[3]) - len(q[3]) <= 2 and not (len(p[3]) == len(q[3]) and q[0] > p[0]) and linedup._first_key(q[3], p[3], 2) == key}
            got = [(rows[i][0], rows[j][0]) for p, q, *_ in linedup.bulk_pairs(key, rows, same, 2, 500) for i, j in zip(p, q, strict=True)]
            assert sorted(got) == sorted(want)
            for _, _, x, i, y, j in linedup.bulk_pairs(key, rows, same, 2, 500):
                assert linedup.within_pairs(x, i, y, j, 2, 100).tolist() == linedup.within_many(x[i], y[j], 2).tolist()


def test_lines_of_rows_that_share_an_id_and_clashing_columns(spark):
    rows = [(1, "first of all the lines\nonly here is this one"), (2, "first of all the lines\nx"), (2, "nothing like it anywhere\nx"), (2, None)]
    df = spark.createDataFrame([(d, t, "a", "b", "c", 9) for d, t in rows], "doc_id long, text string, _gone string, `line.no` string, h string, _id int")
    out = linedup.drop_repeated_lines(df, exact=1)
    assert out.columns == df.columns
    got = sorted(map(tuple, out.collect()), key=repr)
    assert [r[1] for r in got] == ["first of all the lines\nonly here is this one", "nothing like it anywhere\nx", "x", None] and all(r[2:] == ("a", "b", "c", 9) for r in got)
