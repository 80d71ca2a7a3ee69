"""Linking rows that share a bucket key, in bounded tasks, and the classes that the links make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import join_labels
from evidentia.plans.runtime import staged

#: Rows of a bucket that one task takes; larger buckets are cut in tiles, and tasks take pairs of tiles.
TILE = 1000


class Forest:
    """Union-find over hashable items, by path halving."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def in_tiles(entries: DataFrame, key: str, id_: str, tile: int = TILE) -> DataFrame:
    """Rows of keys that have more than one row, with _a, _b, _t: rows of equal (key, _a, _b) belong in one task.

    A key of up to `tile` rows is one group (0, 0). A larger one is cut by the hash of id into tiles _t, and each pair of tiles
    _a <= _b, each tile with itself too, is a group; so every two rows of a key meet in exactly one group if one counts pairs
    across tiles where _a < _b, and pairs within a tile where _a = _b. The keys' sizes come from a partial aggregation, and those of
    hot keys are broadcast, so that their rows don't meet before they are dealt to tiles.
    """
    n = staged(entries.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_k", F.ceil(F.col("_n") / tile).cast("int")), "tiles")
    rows = join_labels(entries, n, key).withColumn("_t", F.pmod(F.xxhash64(F.col(id_), F.lit(7)), F.col("_k")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return rows.withColumn("_a", F.least("_t", "_o")).withColumn("_b", F.greatest("_t", "_o")).drop("_k", "_o")
