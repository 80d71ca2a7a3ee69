"""Packing token sequences by minimum bin slack.

Texts are encoded, ended with an end id and cut into windows of `capacity`; what is left of a text is shorter than a window.
Those remainders are packed by a plan over their *lengths*: the counts of each length (at most `capacity` numbers, whatever
the corpus) come to the driver, and for the longest remaining length a bitset subset-sum dynamic program finds the multiset of
remaining lengths that fills the window closest to capacity; backtracking gives how many of each length it takes. A multiset
is used as often as the counts allow, so each step uses up a length and the plan stays small too (a few thousand rows).

Pieces are numbered without a window function: the task that cuts them counts them by length, and the counts of earlier tasks
are added afterwards. So no length, however common, meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.bpe import json_encoder
from evidentia.llm.common import text_slices
from evidentia.plans.runtime import staged

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, local_rank long"


def cut_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece: whole windows of a document's ids, then the remainder; part and local_rank number it among its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = json_encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for a, b, texts in text_slices(batch, "text"):
                docs_, start, length, crc, total, blobs, rank = [], [], [], [], [], [], []
                for doc, ids in zip(batch.column(0).slice(a, b - a).to_pylist(), encode(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for at in range(0, n, capacity):
                        blob = ids[4 * at : 4 * (at + capacity)]
                        size = len(blob) // 4
                        docs_.append(doc), start.append(at), length.append(size), crc.append(zlib.crc32(blob)), total.append(n), rank.append(int(seen[size]))
                        seen[size] += 1
                        if keep_ids:
                            blobs.append(blob)
                cols = {"doc_id": pa.array(docs_, pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total, pa.int64()), "part": pa.array([part] * len(rank), pa.int32()), "local_rank": pa.array(rank, pa.int64())}
                if keep_ids:
                    cols["ids"] = pa.array(blobs, pa.binary())
                yield pa.RecordBatch.from_pydict(cols)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, PIECES + ", ids binary" * keep_ids)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most counts[length] of each, whose sum comes closest to room from below: {length: how many}.

    Bit s of the bitset says that sum s can be reached; the bitset before each length is kept for the way back. Longer
    lengths come first, and the search stops as soon as room itself is reached.
    """
    mask, reach, before = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        before.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left:  # doubling: 1, 2, 4 ... and the rest make every count up to `left`
            take = min(step, left)
            reach |= (reach << (length * take)) & mask
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, was in reversed(before):
        n = 0
        while not was >> at & 1:
            at, n = at - length, n + 1
        if n:
            out[length] = n
    return out


def minimum_slack_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(times, {length: how many in each window})]: each length's counts are used up exactly."""
    left, plan = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        window = fullest(left, capacity - longest)
        left[longest] += 1
        window[longest] = window.get(longest, 0) + 1
        times = min(left[k] // n for k, n in window.items())
        plan.append((times, window))
        for k, n in window.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def _lookup(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """The plan as sorted runs: pieces of a length whose rank is from `rank` on go `per` at a time to sequences from `first` on, at `offset`."""
    used, runs, sequence = {}, [], 0
    for times, window in plan:
        offset = 0
        for length in sorted(window, reverse=True):
            n, rank = window[length], used.get(length, 0)
            runs.append((length, rank, sequence, n, offset))
            used[length], offset = rank + n * times, offset + n * length
        sequence += times
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "first", "per", "offset"), table.T, strict=True))


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Pack every text whole into sequences of at most `capacity` tokens, with little padding.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids with keep_ids).
    Null texts count as empty: one piece with the end id alone. A null doc_id stays null; rows that repeat are packed each;
    pieces of equal length are interchangeable and go by their place in the input. Other columns are ignored; an empty table
    gives an empty result. The cut pieces are written once to the shared folder: their numbers must not change on a retry.
    """
    pieces = staged(cut_pieces(docs, path, capacity, end_id, keep_ids), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # bounded: a row per length, at most `capacity`
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    lookup = _lookup(minimum_slack_plan(counts, capacity))
    # a window over tasks, not over pieces: a row per task for each length
    before = by_part.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("local_rank")).drop("part", "local_rank", "before")
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = lookup["length"] << 44 | lookup["rank"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = np.searchsorted(key, length << 44 | rank, side="right") - 1
            nth = rank - lookup["rank"][run]
            per = lookup["per"][run]
            out = [batch.column(batch.schema.get_field_index(c)) for c in cols]
            out += [pa.array(lookup["first"][run] + nth // per), pa.array(lookup["offset"][run] + nth % per * length)]
            yield pa.RecordBatch.from_arrays(out, names=[*cols, "sequence_id", "offset"])

    return ranked.select(*cols, "rank").mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids + ", sequence_id long, offset long")
