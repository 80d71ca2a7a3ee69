"""SimHash near-dedup with BK-trees.

Fingerprints within `radius` bits are linked. With the 64 bits in `blocks` blocks, such a pair differs in at most `radius`
blocks, so it agrees in `blocks - radius` of them (blocks must exceed radius); for every choice of that many blocks the fingerprints that agree there
form a shard. In each shard a BK-tree (children keyed by their whole Hamming distance to the parent) is searched and filled,
following only the edges within the radius. A broadcast of all shards' trees would grow with the corpus, so trees are built in
the tasks that search them. Only connections matter: a search leaves out subtrees that are known to be one component with the
fingerprint searched for, so a dense group of near copies costs little, and a shard gives at most one edge per fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import join_labels, plain, text_slices
from evidentia.llm.linking import Forest, in_tiles
from evidentia.plans.components import connected_components
from evidentia.plans.groups import map_groups
from evidentia.plans.runtime import staged

RADIUS, BLOCKS, WORDS, SEED = 4, 6, 4, 42
#: Shards of more fingerprints are searched for all of them at once, in numpy; smaller ones one by one. The links are the same.
BULK = 100


def shingle_hashes(texts: list[str], words: int = WORDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of the word shingles of all texts in turn, repeats included; how many each text has)."""
    hashes: list[int] = []
    sizes = np.zeros(len(texts), dtype=np.int64)
    xxh = xxhash.xxh64_intdigest
    for i, t in enumerate(texts):
        w = t.encode().lower().split()  # bytes: folds A-Z only, splits at ASCII blanks only
        if not w:
            continue
        line = b" ".join(w)
        ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        k = min(words, len(w))
        hashes += [xxh(line[a:b], seed) for a, b in zip(starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
        sizes[i] = len(w) - k + 1
    return np.array(hashes, dtype=np.uint64), sizes


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per run of `sizes` hashes, the bits set in over half of them; zero for an empty run."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
        first = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        ones = np.empty((len(full), 64), dtype=np.int64)
        for b in range(8):  # a byte at a time keeps the unpacked bits small
            ones[:, 8 * b : 8 * b + 8] = np.add.reduceat(np.unpackbits(raw[:, b : b + 1], axis=1), first, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > sizes[full, None], axis=1).view(">u8").astype(np.uint64).ravel()
    return out


def fingerprints(texts: list[str], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """64-bit SimHash of each whole text: majority bits of the XXH64 of its word shingles, repeats included; zero without words."""
    return majority(*shingle_hashes(texts, words, seed))


class BKTree:
    """Hamming BK-tree over ints that keeps the components of the links found so far."""

    def __init__(self, radius: int):
        self.radius, self.root, self.forest = radius, None, Forest()

    def add(self, x: int) -> list[int]:
        """Insert x; return one fingerprint within the radius for each component that x joins."""
        if self.root is None:
            self.root = [x, {}, True]  # value, children by distance, whether the subtree is one component
            self.forest.find(x)
            return []
        radius, find, join = self.radius, self.forest.find, self.forest.join
        links, stack = [], [self.root]
        own = find(x)
        while stack:
            node = stack.pop()
            if node[2] and find(node[0]) == own:
                continue
            d = (node[0] ^ x).bit_count()
            if d <= radius and join(node[0], x):
                links.append(node[0])
                own = find(x)
            for e, child in node[1].items():
                if d - radius <= e <= d + radius:
                    stack.append(child)
        node = self.root
        while True:  # the way down; a subtree stays one component if x is in it
            node[2] = node[2] and find(node[0]) == own
            d = (node[0] ^ x).bit_count()
            if not d:
                break
            if d not in node[1]:
                node[1][d] = [x, {}, True]
                break
            node = node[1][d]
        return links


def bulk_links(x: np.ndarray, radius: int, leaf: int = 64) -> list[tuple[int, int]]:
    """Index pairs that connect what links within the radius connect: a BK-tree over all of x that is searched for all of x at once.

    Each node splits its items by their distance to its first one, and takes along to a child only the queries whose own distance is
    within the radius of the child's. Branches of up to `leaf` items are compared outright. Links found hook components together.
    """
    label, out = np.arange(len(x)), []

    def join(a: np.ndarray, b: np.ndarray) -> None:
        while True:
            la, lb = label[a], label[b]
            open_ = np.flatnonzero(la != lb)
            if not len(open_):
                return
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            lo, hi = np.minimum(la, lb), np.maximum(la, lb)
            order = np.lexsort((lo, hi))
            first = order[np.concatenate([[True], hi[order][1:] != hi[order][:-1]])]  # each label hooks to the least it meets
            out.extend(zip(a[first].tolist(), b[first].tolist(), strict=True))
            to = np.arange(len(x))
            to[hi[first]] = lo[first]
            while (again := to[to]).tobytes() != to.tobytes():
                to = again
            label[:] = to[label]

    every = np.arange(len(x))
    stack = [(every, every)]
    while stack:
        items, queries = stack.pop()
        if len(items) <= leaf:
            near = np.bitwise_count(x[queries][:, None] ^ x[items][None, :]) <= radius
            q, i = np.nonzero(near)
            join(queries[q], items[i])
            continue
        dq = np.bitwise_count(x[queries] ^ x[items[0]]).astype(np.int16)
        hit = queries[dq <= radius]
        join(hit, np.full(len(hit), items[0]))
        rest = items[1:]
        di = np.bitwise_count(x[rest] ^ x[items[0]]).astype(np.int16)
        for e in np.unique(di):
            near = queries[np.abs(dq - e) <= radius]
            if len(near):
                stack.append((rest[di == e], near))
    return out


def shard_edges(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(src, dst) edges that connect what links within the radius connect, over distinct fingerprints fps(fp long)."""
    width = [64 * (i + 1) // blocks - 64 * i // blocks for i in range(blocks)]
    at = [64 * i // blocks for i in range(blocks)]
    masks = [sum(((1 << width[i]) - 1) << at[i] for i in c) for c in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = F.array(*(F.xxhash64(F.col("fp").bitwiseAND(F.lit(m)), F.lit(i)) for i, m in enumerate(signed)))
    entries = fps.select("fp", F.explode(keys).alias("key"))
    full = (1 << 64) - 1

    def search(_, rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) > BULK:
            x = np.array([r[0] for r in rows], dtype=np.int64)
            yield from ((int(x[i]), int(x[j])) for i, j in bulk_links(x.view(np.uint64), radius))
            return
        tree = BKTree(radius)
        for (x,) in rows:
            for y in tree.add(x & full):
                yield x, y - (1 << 64) if y >> 63 else y

    return map_groups(in_tiles(entries, "key", "fp"), ["key", "_a", "_b"], ["fp"], search, "src long, dst long")


def near_dedup(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, blocks: int = BLOCKS) -> DataFrame:
    """Fingerprint every whole text, and the components of links: doc_id, fingerprint (16 hex digits), component_id.

    One row per input row, repeats too. Null texts count as empty: no words, fingerprint zero, linked like any other.
    component_id is the smallest doc_id that is reached, itself included; a row whose doc_id is null takes part in links and gets
    its component's smallest doc_id, or null. Other columns are ignored. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fingerprints(texts, words).view(np.int64))], names=["doc_id", "fp"])

    rows = staged(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, fp long"), "simhash")
    fps = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("_n")), "simhash_distinct")
    comps = connected_components(shard_edges(fps.select("fp"), radius, blocks))
    linked = fps.join(comps.withColumnRenamed("node", "fp"), "fp")
    label = linked.join(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    labels = staged(fps.join(label, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "_n"), "simhash_labels")
    return join_labels(rows, labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """docs, all columns whatever their names, without those whose component (doc_id, component_id) is named by another. Rows without doc_id stay."""
    gone = classes.where("doc_id != component_id").select("doc_id").distinct()
    rows, names = plain(docs, {"doc_id"})
    return rows.join(gone, "doc_id", "left_anti").select(*rows.columns).toDF(*names)


def keep_one(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, blocks: int = BLOCKS) -> DataFrame:
    """One document of each component, the one with the smallest doc_id (all rows that have it), all columns. Rows without doc_id stay."""
    return without(docs, near_dedup(docs, radius, words, blocks))


#: Near copies by exact similarity: the least Jaccard similarity of shingle sets, and the MinHash bands (of so many rows) that find candidates.
LEAST_ALIKE, BANDS, ROWS = 0.8, 16, 4
_DRAWS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.int64).astype(np.uint64)
#: Shingle sets that a task compares with each other; whole texts may be long.
ALIKE_TILE = 250


def shingle_sets(hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of each text."""
    return [np.unique(x) for x in np.split(hashes, np.cumsum(sizes)[:-1])] if len(sizes) else []


def band_keys(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Texts x BANDS: a key for each band of MinHashes; rows of texts without shingles mean nothing."""
    out, full = np.zeros((len(sizes), BANDS), dtype=np.int64), np.flatnonzero(sizes)
    if len(full):
        first = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        least = np.stack([np.minimum.reduceat((hashes ^ x) * (y | np.uint64(1)), first) for x, y in zip(*_DRAWS, strict=True)], axis=1)
        least = np.ascontiguousarray(least).reshape(len(full), BANDS, ROWS)
        out[full] = np.array([[xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(r)] for r in least], dtype=np.uint64).view(np.int64)
    return out


def alike(a: np.ndarray, b: np.ndarray, least: float = LEAST_ALIKE) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least `least`; an empty set is like nothing but itself."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def alike_classes(docs: DataFrame, radius: int, words: int, blocks: int, tile: int = ALIKE_TILE) -> DataFrame:
    """doc_id, component_id per row: components of pairs whose shingle sets have similarity LEAST_ALIKE or more.

    Candidates are what SimHash links within the radius or shared MinHash bands connect (by calculation a pair of similarity 0.8 shares
    one of 16 bands of 4 with probability 0.9998); every link is checked on the whole sets, which are made again for candidates only.
    Ids and nulls are as in near_dedup(). Sets are told apart by 128 bits; where 64 bits name candidates, a clash only adds one.
    """
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "xxhash64(cast(text as string)) source")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, t in text_slices(batch, "text"):
                hashes, sizes = shingle_hashes(t, words)
                part, bands = batch.slice(a, b - a), band_keys(hashes, sizes)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in shingle_sets(hashes, sizes)]
                cols = [part.column(0), part.column(2), pa.array(majority(hashes, sizes).view(np.int64)), pa.array(digests, pa.binary()), pa.array([r if n else [] for r, n in zip(bands.tolist(), sizes.tolist(), strict=True)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "source", "fp", "digest", "bands"])

    rows = staged(texts.mapInArrow(signed, "doc_id long, source long, fp long, digest binary, bands array<long>"), "shingles")
    firsts = F.min_by(F.struct("source", "fp", "bands"), F.struct("source", "fp"))
    once = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("_n"), firsts.alias("f")).select("digest", "least", "_n", "f.*", F.xxhash64("digest").alias("id"))
    once = staged(once, "shingle_sets")

    def stars(entries: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        heads = staged(entries.groupBy(key).agg(F.min("id").alias("head"), F.count("*").alias("_n")), f"heads_{key}")
        return join_labels(entries, heads.where("_n > 1"), key).where("id != head").selectExpr("id src", "head dst"), heads

    by_fp, heads = stars(once.select("id", "fp"), "fp")
    by_band, _ = stars(once.select("id", F.explode("bands").alias("band")), "band")
    near = shard_edges(heads.select("fp"), radius, blocks)
    near = near.join(heads.selectExpr("fp src", "head a"), "src").join(heads.selectExpr("fp dst", "head b"), "dst").selectExpr("a src", "b dst")
    comps = staged(connected_components(by_fp.unionByName(by_band).unionByName(near)).selectExpr("node id", "component"), "alike_candidates")
    wanted = staged(once.join(comps, "id").select("source", "digest").distinct(), "alike_texts")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, t in text_slices(batch, "text"):
                raw = [s.tobytes() for s in shingle_sets(*shingle_hashes(t, words))]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())], names=["digest", "shingles"])

    again = texts.select("text", "source").join(wanted.select("source").distinct(), "source", "left_semi").dropDuplicates(["source", "text"]).select("text")
    sets = again.mapInArrow(whole, "digest binary, shingles binary").join(wanted.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("shingles").alias("shingles"))
    full = in_tiles(comps, "component", "id", tile).join(once.select("id", "digest", "fp", "bands"), "id").join(sets, "digest")

    def check(group: tuple, members: list[tuple]) -> Iterator[tuple]:
        _, a, b = group
        forest = Forest()
        tiles = np.array([m[1] for m in members])
        fp = np.array([m[2] for m in members], dtype=np.int64).view(np.uint64)
        bands = np.array([m[3] or [0] * BANDS for m in members], dtype=np.int64)
        held = [np.frombuffer(m[4], dtype=np.uint64) for m in members]
        for i, (x, t, *_) in enumerate(members):
            found = (bands[:i] == bands[i]).any(axis=1) | (np.bitwise_count(fp[:i] ^ fp[i]) <= radius)
            for j in np.flatnonzero(found & ((tiles[:i] == t) == (a == b))).tolist():
                y = members[j][0]
                if forest.find(x) != forest.find(y) and alike(held[i], held[j]):
                    forest.join(x, y)
                    yield x, y

    links = map_groups(full, ["component", "_a", "_b"], ["digest", "_t", "fp", "bands", "shingles"], check, "src binary, dst binary")
    linked = once.select("digest", "least").join(connected_components(links).selectExpr("node digest", "component"), "digest")
    label = linked.join(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("digest", "component_id")
    labels = staged(once.join(label, "digest", "left").select("digest", F.coalesce("component_id", "least").alias("component_id"), "_n"), "alike_labels")
    return join_labels(rows.select("doc_id", "digest"), labels, "digest").select("doc_id", "component_id")


def keep_one_alike(docs: DataFrame, radius: int, words: int, blocks: int) -> DataFrame:
    """keep_one() over alike_classes()."""
    return without(docs, alike_classes(docs, radius, words, blocks))
