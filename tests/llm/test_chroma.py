import numpy as np

from evidentia.llm import chroma, linking


def sound(words):
    return b"".join((8000 * np.sin(2 * np.pi * 300 * (1 + w % 17 / 5) * np.arange(chroma.FRAME) / chroma.RATE)).astype("<i2").tobytes() for w in words)


def test_pitch_class_and_integral_image():
    t = np.arange(chroma.FRAME * 30) / chroma.RATE
    c = chroma.chroma((10000 * np.sin(2 * np.pi * 880 * t)).astype("<i2").tobytes())
    assert c.shape == (30, 12) and c[:-1].argmax(axis=1).tolist() == [0] * 29
    words = np.random.default_rng(0).integers(0, 100, 40)
    ints, image = chroma.fingerprint(sound(words)), chroma.chroma(sound(words))
    assert len(ints) == 40 - chroma.SPAN + 1
    for at in (0, 7):  # brute force over rectangles
        packed = 0
        for kind, p, h, w in chroma.FILTERS:
            x = image[at : at + w, p : p + h]
            sel = np.zeros(x.shape, bool)
            if kind == 0:
                sel[: w // 2] = True
            elif kind == 1:
                sel[:, : h // 2] = True
            elif kind == 2:
                sel[w // 4 : 3 * w // 4] = True
            else:
                sel[: w // 2, : h // 2] = sel[w // 2 :, h // 2 :] = True
            v = np.log((x[sel].sum() + 1e-3) / (x[~sel].sum() + 1e-3))
            packed = packed << 2 | [0, 1, 3, 2][int(np.searchsorted(chroma.STEPS, v))]
        assert packed == ints[at]


def test_align_finds_the_shift():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 100, 120)
    a, b = chroma.fingerprint(sound(words)), chroma.fingerprint(sound(words[9:]))
    offset, same, error = chroma.align(a, b)
    assert offset == -9 and same >= len(b) - 2 - chroma.RUN and error < 0.01 and chroma.linked(a, b)
    assert not chroma.linked(a, chroma.fingerprint(sound(rng.integers(0, 100, 120))))
    assert chroma.align(a, np.zeros(0, np.uint32)) == (0, 0, 1.0)


def test_classes_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for size in [int(x) for x in rng.integers(5, 90, 12)] + [16, 17, 18, 19, 21, 24, 30, 41]:
        base = rng.integers(0, 100, size)
        for _ in range(int(rng.integers(1, 7))):
            w = base.copy()
            if rng.random() < 0.7:
                w[rng.integers(0, len(w))] = rng.integers(0, 100)
            rows.append(sound(w[int(rng.integers(0, 3)) :]))
    rows += [None, b"", b"\x01", rows[0], rows[0]]
    df = spark.createDataFrame([(i // 4, i % 4, r, "x") for i, r in enumerate(rows)], "conv_id long, turn int, audio binary, ints string")
    got = {(r.conv_id, r.turn): (r.class_conv_id, r.class_turn) for r in chroma.recording_classes(df, ["conv_id", "turn"]).collect()}
    f, ints = linking.Forest(), [chroma.fingerprint(r or b"") for r in rows]
    for i in range(len(rows)):
        f.find(i)
        for j in range(i):
            if (rows[i] or b"") == (rows[j] or b"") or chroma.linked(ints[i], ints[j]):
                f.join(i, j)
    assert got == {(i // 4, i % 4): divmod(f.find(i), 4) for i in range(len(rows))}
    assert chroma.recording_classes(df.limit(0), ["conv_id", "turn"]).count() == 0
    spoken = chroma.render(spark.createDataFrame([(1, None), (2, ""), (3, "a b a"), (None, "a")], "k long, text string"), ["k"]).collect()
    assert [None if r.audio is None else len(r.audio) for r in spoken] == [None, 0, 6 * chroma.FRAME, 2 * chroma.FRAME]


def test_short_and_changed_recordings_are_linked(spark):
    """One changed frame in 60, at either end or within; a dozen integers that are all equal but the last; the same sound at another level."""
    rng = np.random.default_rng(3)
    w = rng.integers(0, 100, 60)
    for at in (0, 20, 30, 59):
        v = w.copy()
        v[at] += 1
        assert chroma.linked(chroma.fingerprint(sound(w)), chroma.fingerprint(sound(v)))
    short = rng.integers(0, 100, 28)
    last = short.copy()
    last[-1] += 1
    a, b = chroma.fingerprint(sound(short)), chroma.fingerprint(sound(last))
    assert len(a) == 13 and chroma.linked(a, b) and set(chroma.prefix(a)) & set(chroma.prefix(b))
    quiet = (np.frombuffer(sound(short[:18]), "<i2") // 2).astype("<i2").tobytes()
    rows = [(1, 1, sound(short)), (1, 2, sound(last)), (2, 1, sound(short[:18])), (2, 2, quiet), (3, 1, sound(short[:9])), (3, 2, sound(last[-9:])), (4, 4, sound(short[:9]))]
    df = spark.createDataFrame(rows, "digest long, least int, audio binary")
    got = {(r.digest, r.least): (r.class_digest, r.class_least) for r in chroma.recording_classes(df, ["digest", "least"]).collect()}
    assert got[1, 2] == (1, 1) and got[2, 2] == (2, 1) and got[3, 2] == (3, 2) and got[4, 4] == (3, 1)


def test_one_recording_in_most_rows(spark):
    """99 of 100 rows are one recording, and its neighbours share its tokens."""
    rng = np.random.default_rng(4)
    w = rng.integers(0, 100, 40)
    near = w.copy()
    near[-1] += 1
    rows = [(i, sound(w)) for i in range(990)] + [(990 + i, sound(near)) for i in range(5)] + [(995 + i, sound(rng.integers(0, 100, 40))) for i in range(5)]
    got = {r.k: r.class_k for r in chroma.recording_classes(spark.createDataFrame(rows, "k int, audio binary"), ["k"]).collect()}
    assert got == {i: 0 if i < 995 else i for i in range(1000)}
