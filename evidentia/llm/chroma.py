"""Chroma audio fingerprints of a media column, and the recordings they align.

Audio (16-bit mono PCM) is cut in frames; each frame's spectrum is folded to twelve pitch classes. An integral image over frames and
classes makes any rectangle's sum four look-ups; filters compare rectangles within a window of frames, and each filter's log ratio is
quantised to two bits in Gray code, so a window becomes one packed 32-bit integer. Two recordings are aligned by the histogram of
offsets at which runs of RUN integers are equal, and linked if at the best offset half of the integers are equal, a quarter of the runs too, and few bits differ.

Candidates: a link has at least RUNS of the shorter one's runs equal at one offset. Runs (repeats numbered) are ordered by a
hash; a recording that lacks so many of its first ones in another's cannot be linked to it, so only a prefix of them is indexed
(prefix filtering, which loses no link). Single integers repeat across unrelated recordings; runs of them hardly do. A changed frame
alters up to SPAN + 1 integers and RUN - 1 runs more, so of recordings with half of their integers equal more than a quarter of the runs are.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import join_labels, text_slices
from evidentia.llm.linking import Forest, in_tiles
from evidentia.plans.components import connected_components
from evidentia.plans.groups import map_groups
from evidentia.plans.runtime import staged

RATE, FRAME, SPAN = 4000, 128, 16
#: Integers in a run.
RUN = 4
#: A link: these shares of the shorter one's integers and runs equal at one offset, lengths in this ratio at least, and this share of bits that differ at most.
EQUAL, RUNS, RATIO, ERROR = 0.5, 0.25, 0.8, 0.2


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, classes, frames) of the sixteen filters, by rule."""
    out = []
    for k in range(16):
        height = 4 + 2 * (k % 3)
        out.append((k % 4, 5 * k % (13 - height), height, (SPAN, SPAN // 2)[k // 8]))
    return out


FILTERS = _filters()
STEPS = (-0.35, 0.0, 0.35)
_GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)


def _fold() -> np.ndarray:
    """Spectrum bin of a double frame -> pitch class; bins outside 200 to 1900 Hz go nowhere."""
    hz = np.fft.rfftfreq(2 * FRAME, 1 / RATE)
    out = np.zeros((len(hz), 12))
    for i, f in enumerate(hz):
        if 200 <= f <= 1900:
            out[i, round(12 * np.log2(f / 440)) % 12] = 1
    return out


_FOLD = _fold().astype(np.float32)
_HANN = np.hanning(2 * FRAME).astype(np.float32)
#: Chroma are multiples of one part in so many, so that their sums are exact, in whatever order; frames are transformed so many at a time.
PARTS, AT_ONCE = 1 << 20, 4096


def _chroma(sounds: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(frames of all recordings in turn x 12 pitch classes, how many frames each has)."""
    n = np.array([len(s) // (2 * FRAME) for s in sounds], dtype=np.int64)
    x = np.frombuffer(b"".join([s[: 2 * FRAME * k] + bytes(2 * FRAME) for s, k in zip(sounds, n.tolist(), strict=True)] or [b""]), dtype="<i2")
    frames = np.lib.stride_tricks.sliding_window_view(x, 2 * FRAME)[::FRAME] if len(x) >= 2 * FRAME else np.zeros((0, 2 * FRAME), "<i2")
    own = np.ones(int((n + 1).sum()), dtype=bool)
    own[np.cumsum(n + 1) - 1] = False  # a frame of silence ends each recording
    rows = np.flatnonzero(own)
    out = np.empty((len(rows), 12))
    for a in range(0, len(rows), AT_ONCE):
        f = np.fft.rfft(frames[rows[a : a + AT_ONCE]].astype(np.float32) * _HANN, axis=1)
        c = (f.real**2 + f.imag**2) @ _FOLD + np.float32(1e-6)
        out[a : a + AT_ONCE] = np.rint(c / c.sum(axis=1, keepdims=True) * PARTS) / PARTS
    return out, n


def chroma(audio: bytes) -> np.ndarray:
    """Frames x 12 pitch classes, each frame scaled to sum 1; silent frames are even. A last part of less than a frame is left off."""
    return _chroma([audio])[0]


def fingerprint_many(sounds: list[bytes]) -> list[np.ndarray]:
    """For each recording, one packed integer for each window of SPAN frames; none for shorter audio."""
    c, n = _chroma(sounds)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    size = np.maximum(0, n - SPAN + 1)
    at = np.arange(size.sum()) + np.repeat(np.cumsum(n) - n - (np.cumsum(size) - size), size)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return columns[p1][at + t1] - columns[p1][at + t0] - columns[p0][at + t1] + columns[p0][at + t0]

    columns = np.ascontiguousarray(image.T)
    out = np.zeros(len(at), dtype=np.uint32)
    for kind, p, h, w in FILTERS:
        whole = area(0, w, p, p + h)
        if kind == 0:  # earlier against later
            a = area(0, w // 2, p, p + h)
        elif kind == 1:  # lower against higher
            a = area(0, w, p, p + h // 2)
        elif kind == 2:  # middle against both ends
            a = area(w // 4, 3 * w // 4, p, p + h)
        else:  # two corners against the other two
            a = area(0, w // 2, p, p + h // 2) + area(w // 2, w, p + h // 2, p + h)
        a, rest = a + 1e-3, whole - a + 1e-3
        level = sum((a > rest * np.exp(s)).astype(np.uint32) for s in STEPS)  # steps that the log ratio is over
        out = out << np.uint32(2) | _GRAY[level]
    return np.split(out, np.cumsum(size)[:-1]) if len(size) else []


def fingerprint(audio: bytes) -> np.ndarray:
    return fingerprint_many([audio])[0]


def runs(ints: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each RUN integers in a row; of fewer than RUN integers, one of each integer and their number."""
    k = RUN if len(ints) >= RUN else 1
    n = max(0, len(ints) - k + 1)
    out = np.full(n, 0 if k == RUN else len(ints), dtype=np.uint64)
    for i in range(k):
        out = (out ^ ints[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """(offset of b's integer that meets a's first, how many runs are equal there, share of bits that differ there) at the offset with most equal runs; ties: the least error, then the least offset."""
    x, y = runs(a), runs(b)
    order = np.argsort(y, kind="stable")
    s = y[order]
    lo, hi = np.searchsorted(s, x, "left"), np.searchsorted(s, x, "right")
    n = hi - lo
    if not n.sum():
        return 0, 0, 1.0
    i = np.repeat(np.arange(len(x)), n)
    j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    offsets, counts = np.unique(j - i, return_counts=True)
    best = min((bit_error(a, b, int(o)), int(o)) for o in offsets[counts == counts.max()])
    return best[1], int(counts.max()), best[0]


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    """Share of bits that differ where the two overlap."""
    start, end = max(0, -offset), min(len(a), len(b) - offset)
    if end <= start:
        return 1.0
    return float(np.bitwise_count(a[start:end] ^ b[start + offset : end + offset]).sum()) / (32 * (end - start))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two recordings of at least one integer each align well enough; those of fewer than RUN integers only with as many."""
    n, m = sorted((len(a), len(b)))
    if not n or n < RATIO * m or n < RUN and n != m:
        return False
    offset, same, error = align(a, b)
    if not same or same < RUNS * _run_count(n) or error > ERROR:
        return False
    start, end = max(0, -offset), min(len(a), len(b) - offset)
    return int((a[start:end] == b[start + offset : end + offset]).sum()) >= EQUAL * n


def _run_count(n: int) -> int:
    return n - RUN + 1 if n >= RUN else n


def prefix(ints: np.ndarray) -> np.ndarray:
    """Hashes of the runs, repeats numbered, that a recording is found by: those first in hash order."""
    own = np.sort(runs(ints))
    first = np.flatnonzero(np.concatenate([[len(own) > 0], own[1:] != own[:-1]])[: len(own)])
    nth = np.arange(len(own)) - np.repeat(first, np.diff(np.concatenate([first, [len(own)]])))
    tokens = (own + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
    tokens ^= tokens >> np.uint64(31)
    shortest = max(ceil(RATIO * len(ints)), min(len(ints), RUN)) if len(ints) >= RUN else len(ints)  # of those it can be linked to
    need = max(1, ceil(RUNS * _run_count(shortest)))
    return np.sort(tokens.view(np.int64))[: max(0, len(own) - need + 1)]


def render(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """A media column made from a text column by rule, where a table holds no recordings: keys, audio (PCM).

    Each word sounds for one frame as a chord of two notes that its hash picks. Null texts give null audio, blank ones empty audio.
    """
    t = np.arange(FRAME) / RATE
    tones = np.stack([np.sin(2 * np.pi * 440 * 2 ** ((n - 9) / 12) * t) for n in range(24)])
    chords = np.stack([(6000 * (tones[a] + tones[b])).astype("<i2") for a in range(24) for b in range(24)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            k = len(keys)
            for a, b, rows in text_slices(batch, "text", 1 << 16):
                nulls = batch.column(k).slice(a, b - a).is_null().to_pylist()
                out = []
                for words in (r.split() for r in rows):
                    if len(known) > 200_000:
                        known.clear()
                    for w in words:
                        if w not in known:
                            known[w] = xxhash.xxh32_intdigest(w.encode(), 1) % 576
                    out.append(chords[[known[w] for w in words]].tobytes() if words else b"")
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(k)), pa.array([None if n else o for o, n in zip(out, nulls, strict=True)], pa.binary())], names=[*keys, "audio"])

    rows = texts.select(*keys, F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, rows.select(*keys, F.lit(None).cast("binary").alias("audio")).schema)


def fingerprints(media: DataFrame, keys: list[str], audio: str = "audio") -> DataFrame:
    """k0, k1 ... (the keys), digest, n (integers), ints (little-endian unsigned 32-bit). Null audio counts as empty. digest: 128 bits of the integers, or of the audio if it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(keys)
        for batch in batches:
            for a, b, found in text_slices(batch, "audio"):
                part = batch.slice(a, b - a)
                sound = [x or b"" for x in found]
                ints = [x.astype("<u4").tobytes() for x in fingerprint_many(sound)]
                digest = [xxhash.xxh3_128_digest(i or x, len(i) > 0) for i, x in zip(ints, sound, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(digest, pa.binary()), pa.array([len(i) // 4 for i in ints], pa.int32()), pa.array(ints, pa.binary())], names=[*names, "digest", "n", "ints"])

    names = [f"k{i}" for i in range(len(keys))]
    rows = media.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(audio).alias("audio"))
    none = F.lit(None)
    return rows.mapInArrow(run, rows.select(*names, none.cast("binary").alias("digest"), none.cast("int").alias("n"), none.cast("binary").alias("ints")).schema)


def recording_classes(media: DataFrame, keys: list[str], audio: str = "audio") -> DataFrame:
    """Per recording: keys, n_ints, ints_xxh64 and class_<key>...: the least keys of the recordings that links and exact copies connect.

    One row per input row, repeats too. Keys, whatever their names, are ordered as a struct, nulls first. Null audio counts as empty; all
    empty recordings are copies of each other. A recording of less than SPAN frames has no integer and is linked to exact copies only; any
    other, however short, to those it aligns with. Other columns are ignored. An empty table gives an empty result.
    """
    rows = staged(fingerprints(media, keys, audio), "recordings")
    once = rows.groupBy("digest").agg(F.min(F.struct(*(f"k{i}" for i in range(len(keys))))).alias("least"), F.first("n").alias("n"), F.first("ints").alias("ints"), F.count("*").alias("_n"))
    once = staged(once.withColumn("id", F.xxhash64("digest")), "distinct_recordings")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                found = [prefix(np.frombuffer(x, dtype="<u4")) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), part.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))], names=["token", "id"])

    entries = staged(once.where("n > 0").select("id", "ints").mapInArrow(tokens, "token long, id long"), "tokens")
    bucket = in_tiles(entries, "token", "id").join(once.select("id", "digest", "ints"), "id")

    def check(group: tuple, members: list[tuple]) -> Iterator[tuple]:
        _, a, b = group
        forest = Forest()
        seen: list[tuple[bytes, int, np.ndarray]] = []
        for i, t, raw in members:
            x = np.frombuffer(raw, dtype="<u4")
            for j, u, y in seen:
                if (t == u) == (a == b) and forest.find(i) != forest.find(j) and linked(x, y):
                    forest.join(i, j)
                    yield i, j
            seen.append((i, t, x))

    edges = map_groups(bucket, ["token", "_a", "_b"], ["digest", "_t", "ints"], check, "src binary, dst binary")
    comps = connected_components(edges).withColumnRenamed("node", "digest")
    near = once.select("digest", "least").join(comps, "digest")
    label = near.join(near.groupBy("component").agg(F.min("least").alias("class")), "component").select("digest", "class")
    labels = staged(once.select("digest", "least", "_n").join(label, "digest", "left").select("digest", F.coalesce("class", "least").alias("class"), "_n"), "recording_labels")
    out = join_labels(rows, labels, "digest")
    return out.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), F.col("n").alias("n_ints"), F.xxhash64("ints").alias("ints_xxh64"), *(F.col(f"class.k{i}").alias(f"class_{k}") for i, k in enumerate(keys)))
