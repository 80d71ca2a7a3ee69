"""Line dedup by a segment-partition edit join.

A line is the text between newlines, outer blanks off. Equal lines of every length are found by a 128-bit hash. For lines within `most` edits:
a line of length l is cut in most + 1 even segments, one of which any line within `most` edits holds unchanged. Each distinct
line is indexed by (l, number, text) of its segments and probes with those of its substrings whose place and length the
edits before and after the segment allow (for lengths l - most ... l). Only hashes of those keys are shuffled; keys that some line
indexes and another probes are few, and only their lines are fetched for the check by a banded bit-parallel edit distance.

A task that meets a key in more than HOT different lines deals its further rows of that key out by the lines' ids. Such rows are matches
without another look, and so are the HOT rows before, wherever they meet others of the key; no task holds more than HELD rows of a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import join_labels, plain, text_slices
from evidentia.llm.linking import TILE, Forest, in_tiles
from evidentia.plans.components import connected_components
from evidentia.plans.groups import map_groups
from evidentia.plans.runtime import staged

#: Two edits are at most a tenth of a line of LEAST_CHARS; shorter lines are linked to exact copies only.
EDITS, LEAST_CHARS = 2, 20
#: Ids of lines to fetch that are broadcast as an array; beyond it, lines are joined.
BROADCAST_IDS = 1_000_000
#: Different lines of a task with one key before its further rows are dealt out, among how many salts, and rows of a key that are held for a look.
HOT, SALTS, HELD = 16, 4096, 10_000
#: Groups of more lines are checked for many pairs at once, in numpy; smaller ones pair by pair. The links are the same.
BULK = 32
#: Pairs that are dealt with at a time, and characters of either side's lines that are checked at once: bounds memory where lines are long.
BULK_PAIRS, BULK_CHARS = 20_000, 1 << 20
INDEX, PROBE = 1, 2


def segments(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the most + 1 segments of a line of n characters; the last ones take what doesn't divide evenly."""
    k = most + 1
    q, r = divmod(n, k)
    out, at = [], 0
    for i in range(k):
        size = q + (i >= k - r)
        out.append((at, size))
        at += size
    return out


def windows(n: int, most: int) -> Iterator[tuple[int, int, int, range]]:
    """(indexed length, segment, size, starts): where a probing line of n characters looks for each segment."""
    for length in range(max(most + 1, n - most), n + 1):
        shift = n - length
        for i, (p, size) in enumerate(segments(length, most)):
            left, right = i, most - i  # edits before segment i that earlier segments leave, and after it
            lo, hi = max(p - left, p + shift - right, 0), min(p + left, p + shift + right, n - size)
            if lo <= hi:
                yield length, i, size, range(lo, hi + 1)


@lru_cache(maxsize=5000)
def _plan(n: int, most: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(start, end, seed) of every key that a line of n characters probes with, and its sides: its own segments are indexed too."""
    own = set(segments(n, most))
    places = [(a, a + size, length * 16 + i, INDEX | PROBE if length == n and (a, size) in own and segments(n, most)[i] == (a, size) else PROBE) for length, i, size, starts in windows(n, most) for a in starts]
    return [p[:3] for p in places], np.array([p[3] for p in places], dtype=np.int64)


def keys_of(line: str, most: int) -> tuple[list[int], np.ndarray]:
    """(keys, their sides) of a line of more than `most` characters."""
    plan, sides = _plan(len(line), most)
    h = xxhash.xxh3_64_intdigest
    if line.isascii():
        raw = line.encode()
        return [h(raw[a:b], seed) for a, b, seed in plan], sides
    return [h(line[a:b].encode(), seed) for a, b, seed in plan], sides


def index_keys(line: str, most: int) -> list[int]:
    keys, sides = keys_of(line, most)
    return [k for k, s in zip(keys, sides.tolist(), strict=True) if s & INDEX]


def probe_keys(line: str, most: int) -> set[int]:
    return set(keys_of(line, most)[0])


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`: bit vectors over the 2 * most + 1 diagonals of the band, one per number of edits."""
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    p = 0
    while p < n and a[p] == b[p]:
        p += 1
    q = 0
    while q < n - p and a[-1 - q] == b[-1 - q]:
        q += 1
    a, b = a[p : len(a) - q], b[p : len(b) - q]
    if not a or not b:
        return True
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << (2 * most + 1)) - 1
    # bit o of row d after j characters of b: a's first j + o - most characters are reached with d edits
    rows = [sum(1 << (most + k) for k in range(d + 1)) for d in range(most + 1)]
    for j, c in enumerate(b):
        # a step to place j + 1 + o - most matches a's character j + o - most
        m = places.get(c, 0)
        m = m >> (j - most) if j >= most else m << (most - j)
        new, low = [], most - j - 1  # places before a's start don't exist
        keep = full & ~((1 << low) - 1) if low > 0 else full
        for d in range(most + 1):
            r = rows[d] & m
            if d:
                r |= rows[d - 1] | rows[d - 1] >> 1 | new[d - 1] << 1  # substitute, skip a character of b, skip one of a
            new.append(r & keep)
        if not new[most]:
            return False
        rows = new
    end = len(a) - len(b) + most
    return bool(rows[most] >> end & 1)


def within_many(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """within() for each row of a and b, matrices of characters: the same bit vectors, one step for all pairs that may still hold."""
    out, left = np.zeros(len(a), dtype=bool), np.arange(len(a))
    if abs(a.shape[1] - b.shape[1]) > most:
        return out
    full = (1 << (2 * most + 1)) - 1
    rows = [np.full(len(a), sum(1 << (most + k) for k in range(d + 1)), dtype=np.int64) for d in range(most + 1)]
    for j in range(b.shape[1]):
        m = np.zeros(len(left), dtype=np.int64)
        for o in range(2 * most + 1):
            if 0 <= (i := j + o - most) < a.shape[1]:
                m |= (a[:, i] == b[:, j]).astype(np.int64) << o
        new, low = [], most - j - 1
        keep = full & ~((1 << low) - 1) if low > 0 else full
        for d in range(most + 1):
            r = rows[d] & m
            if d:
                r |= rows[d - 1] | rows[d - 1] >> 1 | new[d - 1] << 1
            new.append(r & keep)
        rows = new
        if j % 8 == 7 and not rows[most].all():
            alive = rows[most] != 0
            left, a, b, rows = left[alive], a[alive], b[alive], [r[alive] for r in rows]
    out[left] = rows[most] >> (a.shape[1] - b.shape[1] + most) & 1
    return out


def within_pairs(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, most: int, chars: int = BULK_CHARS) -> np.ndarray:
    """within_many() of the rows i of x and j of y, of so many characters at a time."""
    run = max(1, chars // max(1, x.shape[1]))
    return np.concatenate([np.zeros(0, dtype=bool), *(within_many(x[i[k : k + run]], y[j[k : k + run]], most) for k in range(0, len(i), run))])


def lines_of(text: str, least: int) -> list[tuple[int, str]]:
    return [(i, s) for i, x in enumerate(text.split("\n")) if len(s := x.strip()) >= least]


def _id(h: bytes) -> int:
    """64 bits of a line's 128-bit hash: enough to find candidates by, as lines that share them are told apart later."""
    return int.from_bytes(h[:8], "big", signed=True)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")


def line_rows(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, line_no, h (128-bit hash): each line of at least `least` characters, of rows that have a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for a, b, texts in text_slices(batch, "text"):
                found = [lines_of(t, least) for t in texts]
                doc = batch.column(0).slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), [len(x) for x in found])))
                yield pa.RecordBatch.from_arrays([doc, pa.array([i for x in found for i, _ in x], pa.int32()), pa.array([digest(s.encode()) for x in found for _, s in x], pa.binary())], names=["doc_id", "line_no", "h"])

    return _texts(docs).mapInArrow(run, "doc_id long, line_no int, h binary")


class _Dealer:
    """Salts for a task's rows (key, id): 0 for a key's rows of HOT different lines, then one by the id."""

    def __init__(self, hot: int, buckets: int = 1 << 20):
        self.hot, self.count, self.exact = hot, np.zeros(buckets, dtype=np.int32), {}

    def __call__(self, key: np.ndarray, id_: np.ndarray) -> np.ndarray:
        salt = np.zeros(len(key), dtype=np.int64)
        bucket = key & (len(self.count) - 1)
        self.count += np.bincount(bucket, minlength=len(self.count)).astype(np.int32)
        for i in np.flatnonzero(self.count[bucket] > self.hot).tolist():  # only these may be hot; they are counted one by one from now on
            k, x = int(key[i]), int(id_[i])
            n, last = self.exact.get(k, (0, None))
            if n >= self.hot:
                salt[i] = 1 + x % SALTS
            elif x != last:
                self.exact[k] = n + 1, x
        return salt


def key_rows(docs: DataFrame, most: int, least: int, hot: int = HOT) -> DataFrame:
    """key, id, mark (salt * 4 + sides): the keys of each line; a task's copies of a line are keyed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, deal, digest = set(), _Dealer(hot), xxhash.xxh3_128_digest
        for batch in batches:
            for _, _, texts in text_slices(batch, "text"):
                keys, sides, ids, counts = [], [], [], []
                for t in texts:
                    for _, s in lines_of(t, least):
                        x = _id(digest(s.encode()))
                        if x not in seen:
                            seen.add(x)
                            own, own_sides = keys_of(s, most)
                            keys += own
                            sides.append(own_sides), ids.append(x), counts.append(len(own))
                if keys:
                    key, id_ = np.array(keys, dtype=np.uint64).view(np.int64), np.repeat(np.array(ids, dtype=np.int64), counts)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(id_), pa.array(deal(key, id_) * 4 + np.concatenate(sides))], names=["key", "id", "mark"])

    return _texts(docs).select("text").mapInArrow(run, "key long, id long, mark long")


def matched(entries: DataFrame, hot: int = HOT) -> DataFrame:
    """(key, id, sides): rows of keys where one id indexes and another probes; of hot keys all rows, some perhaps repeated."""

    def close(key: np.ndarray, id_: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
        salt, sides = mark >> 2, mark & 3
        order = np.lexsort((id_, salt, key))
        key, id_, salt, sides = key[order], id_[order], salt[order], sides[order]
        at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (id_[1:] != id_[:-1])]))
        k, s, i, both = key[at], salt[at], id_[at], np.bitwise_or.reduceat(sides, at)
        start = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])]))
        size = np.diff(np.concatenate([start, [len(k)]]))
        keep = np.repeat((size > 1) & (np.bitwise_or.reduceat(both, start) == 3) | (size >= hot) | (s[start] > 0), size)
        return _rows(k[keep], i[keep], both[keep])

    def _rows(k: np.ndarray, i: np.ndarray, sides: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(i), pa.array(sides.astype(np.int32))], names=["key", "id", "sides"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the rows of the last key so far
        open_: int | None = None  # a key of which HELD rows have gone through
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if open_ is not None:
                n = int(np.searchsorted(cols[0], open_, side="right"))
                if n:
                    yield _rows(cols[0][:n], cols[1][:n], cols[2][:n] & 3)
                    cols = [c[n:] for c in cols]
            if not len(cols[0]):
                continue
            open_ = None
            if held:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # sorted by key
            if last:
                yield close(*(c[:last] for c in cols))
            held = [c[last:] for c in cols]
            if len(held[0]) > HELD:
                open_ = int(held[0][0])
                yield _rows(held[0], held[1], held[2] & 3)
                held = []
        if held:
            yield close(*held)

    dealt = entries.repartition("key", F.shiftright("mark", 2)).sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key long, id long, sides int")


def _first_key(line: str, other: str, most: int) -> int | None:
    """The key of the first segment of `line` that `other` probes for."""
    own = segments(len(line), most)
    for length, i, size, starts in windows(len(other), most):
        if length == len(line):
            p = own[i][0]
            if any(other.startswith(line[p : p + size], s) for s in starts):
                return _signed(xxhash.xxh3_64_intdigest(line[p : p + size].encode(), length * 16 + i))
    return None


def _signed(k: int) -> int:
    return k - (1 << 64) if k >> 63 else k


def _codes(lines: list[str]) -> np.ndarray:
    """Lines of one length as a matrix of characters."""
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(lines), -1)


def bulk_pairs(key: int, rows: list[tuple], same_tile: bool, most: int, most_pairs: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """(probes, indexes, codes of lines, row of them for each probe, codes, row for each index): runs of pairs of rows (h, sides, tile, line) that meet first under `key`, as numbers of rows."""
    by: dict[int, list[int]] = {}
    for n, r in enumerate(rows):
        by.setdefault(len(r[3]), []).append(n)
    tile, sides = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    place = np.argsort(sorted(range(len(rows)), key=lambda n: rows[n][0]))
    codes = {size: _codes([rows[n][3] for n in ns]) for size, ns in by.items()}
    keyed = {size: np.array([keys_of(rows[n][3], most)[0] for n in ns], dtype=np.uint64).view(np.int64) for size, ns in by.items()}
    for size, probes in by.items():
        plan, _ = _plan(size, most)
        for length in range(max(most + 1, size - most), size + 1):
            if length not in by:
                continue
            own, index = _plan(length, most), np.array(by[length])
            idx = np.flatnonzero(sides[index] & INDEX)
            step = max(1, most_pairs // max(1, len(idx)))
            for at in range(0, len(probes), step):
                prb = np.arange(at, min(at + step, len(probes)))
                found = np.zeros((len(prb), len(idx)), dtype=bool)
                ours = found.copy()
                for i in range(most + 1):
                    seed = length * 16 + i
                    col = next(c for c, p in enumerate(own[0]) if p[2] == seed and own[1][c] & INDEX)
                    segment = keyed[length][idx, col]
                    hit = np.zeros_like(found)
                    for c in (c for c, p in enumerate(plan) if p[2] == seed):
                        hit |= keyed[size][prb, c][:, None] == segment[None, :]
                    ours |= hit & ~found & (segment == key)[None, :]
                    found |= hit
                p, q = np.array(probes)[prb], index[idx]
                ours &= (tile[p][:, None] == tile[q][None, :]) == same_tile
                if size == length:
                    ours &= place[p][:, None] > place[q][None, :]
                i, j = np.nonzero(ours)
                for k in range(0, len(i), BULK_PAIRS):
                    u, v = i[k : k + BULK_PAIRS], j[k : k + BULK_PAIRS]
                    yield p[u], q[v], codes[size], prb[u], codes[length], idx[v]


def edit_links(docs: DataFrame, most: int, least: int, counts: bool = True, hot: int = HOT, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(edges, degrees) among distinct lines by hash: edges(src, dst) connect what links connect; degrees(h, n_links) count each link once for each end.

    Without `counts`, pairs that are known to be connected are not checked, and degrees are empty.
    """
    least = max(least, most + 1)
    hits = staged(matched(key_rows(docs, most, least, hot), hot), "line_keys")
    lines = _fetch(docs, hits.select("id").distinct(), least)
    bucket = in_tiles(hits, "key", "id", tile).join(lines, "id")

    def check(group: tuple, rows: list[tuple]) -> Iterator[tuple]:
        key, a, b = group
        own: dict[bytes, tuple] = {}
        for h, sides, t, line in rows:  # hot keys' rows may repeat
            own[h] = (h, sides | (own[h][1] if h in own else 0), t, line)
        rows = list(own.values())
        forest, count, edges = Forest(), {}, []

        def link(x: bytes, y: bytes) -> None:
            if counts:
                count[x], count[y] = count.get(x, 0) + 1, count.get(y, 0) + 1
            if forest.join(x, y):
                edges.append((x, y))

        if len(rows) > BULK:
            for p, q, x, i, y, j in bulk_pairs(key, rows, a == b, most):
                if not counts:
                    number: dict[bytes, int] = {}
                    root = np.array([number.setdefault(forest.find(r[0]), len(number)) for r in rows])
                    apart = root[p] != root[q]
                    p, q, i, j = p[apart], q[apart], i[apart], j[apart]
                near = within_pairs(x, i, y, j, most)
                for i, j in zip(p[near].tolist(), q[near].tolist(), strict=True):
                    link(rows[i][0], rows[j][0])
        else:
            for ph, ps, pt, ptext in rows:
                for ih, is_, it, itext in rows if ps & PROBE else ():
                    if not is_ & INDEX or ih == ph or (pt == it) != (a == b) or not 0 <= len(ptext) - len(itext) <= most or len(ptext) == len(itext) and ih > ph:
                        continue
                    if not counts and forest.find(ih) == forest.find(ph):
                        continue
                    # count the pair under the first segment that finds it
                    if _first_key(itext, ptext, most) == key and within(itext, ptext, most):
                        link(ih, ph)
        yield from ((x, y, None, None) for x, y in edges)
        yield from ((None, None, x, n) for x, n in count.items())

    made = staged(map_groups(bucket, ["key", "_a", "_b"], ["h", "sides", "_t", "line"], check, "src binary, dst binary, h binary, n long"), "line_links")
    return made.where("src is not null").select("src", "dst"), made.where("h is not null").groupBy("h").agg(F.sum("n").alias("n_links"))


def _fetch(docs: DataFrame, ids: DataFrame, least: int) -> DataFrame:
    """(h, id, line) of the lines with these ids, one row for each different line."""
    ids = staged(ids, "line_ids")
    few, bc = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS, None
    if few:
        bc = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow()["id"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, seen = set(bc.value.tolist()) if bc else None, set()
        for batch in batches:
            for _, _, texts in text_slices(batch, "text"):
                out = []
                for t in texts:
                    for _, s in lines_of(t, least):
                        h = xxhash.xxh3_128_digest(s.encode())
                        if h not in seen and (want is None or _id(h) in want):
                            if want is not None:
                                seen.add(h)
                            out.append((h, _id(h), s))
                h, x, s = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(x, pa.int64()), pa.array(s, pa.string())], names=["h", "id", "line"])

    found = _texts(docs).select("text").mapInArrow(run, "h binary, id long, line string")
    found = found if few else found.join(ids, "id", "left_semi")
    return staged(found.groupBy("h").agg(F.first("id").alias("id"), F.min("line").alias("line")), "lines")


def line_classes(docs: DataFrame, most: int = EDITS, least: int = LEAST_CHARS, exact: int | None = None, counts: bool = True) -> DataFrame:
    """Per line of at least `exact` characters (`least`, if not given): doc_id, line_no, class_doc_id, class_line_no, n_links, kept, h.

    A class is what links of at most `most` edits connect, copies included; its first line by (doc_id, line_no) names it and is the
    one that is kept. Lines under `least` characters have no links, so their classes are their exact copies. n_links counts the other
    texts within `most` edits of the line's (0 throughout without `counts`). h is the line's 128-bit hash. Rows with a null doc_id or text, shorter
    lines and blank ones take no part; rows that repeat a doc_id are taken for the same document, so its equal lines are kept or go together.
    Other columns are ignored.
    """
    lines = staged(line_rows(docs, least if exact is None else max(exact, 1)), "line_rows")
    place = F.struct("doc_id", "line_no")
    firsts = lines.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("_n"))
    edges, degrees = edit_links(docs, most, least, counts)
    comps = connected_components(edges).select(F.col("node").alias("h"), "component")
    near = staged(firsts.join(comps, "h").select("h", "component", "first"), "near_lines")
    classes = near.groupBy("component").agg(F.min("first").alias("class"))
    near = near.join(classes, "component").join(degrees, "h", "left").select("h", "class", "n_links")
    label = firsts.join(near, "h", "left").select("h", F.coalesce("class", "first").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "_n")
    out = join_labels(lines.select("doc_id", "line_no", "h"), staged(label, "line_labels"), "h")
    return out.select("doc_id", "line_no", F.col("class.doc_id").alias("class_doc_id"), F.col("class.line_no").alias("class_line_no"), "n_links", (place == F.col("class")).alias("kept"), "h")


def drop_repeated_lines(docs: DataFrame, most: int = EDITS, least: int = LEAST_CHARS, exact: int | None = None) -> DataFrame:
    """The same rows and columns, whatever their names, without the lines that line_classes() doesn't keep; n_chars, where there is one, counts the new text.

    A line goes by its number and its hash: of rows that repeat a doc_id with other texts, each loses only its own repeated lines.
    """
    docs, before = plain(docs, {"doc_id", "text", "n_chars"})
    gone = line_classes(docs, most, least, exact, counts=False).where("not kept").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("line_no", "h")).alias("_gone"))
    names = docs.columns
    joined = docs.withColumn("_id", F.col("doc_id").cast("long")).join(gone, "_id", "left").select(*names, "_gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            for a, b, texts in text_slices(batch, "text"):
                part = batch.slice(a, b - a)
                cols = list(part.columns)
                new = []
                for t, gone, null in zip(texts, cols[-1].to_pylist(), cols[k].is_null().to_pylist(), strict=True):
                    if gone:
                        drop = {(g["line_no"], g["h"]) for g in gone}
                        at = {n for n, _ in drop}
                        t = "\n".join([s for i, s in enumerate(t.split("\n")) if i not in at or (i, xxhash.xxh3_128_digest(s.strip().encode())) not in drop])
                    new.append(None if null else t)
                cols[k] = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays(cols[:-1], names=names)

    out = joined.mapInArrow(run, docs.schema)
    out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
    return out.toDF(*before)
