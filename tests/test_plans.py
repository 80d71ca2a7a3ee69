import numpy as np
import pytest

from evidentia.plans import components, runtime
from evidentia.plans.components import connected_components
from evidentia.plans.runtime import scratch, staged, unstage


def brute(edges):
    label = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


@pytest.mark.parametrize("broadcast_edges", [50_000, 0])
def test_components_against_brute_force(spark, broadcast_edges):
    """A star with nearly all edges, a long chain, random edges, repeats, loops and nulls; with minima broadcast and with hot nodes' only."""
    rng = np.random.default_rng(0)
    edges = [(5000, i) for i in range(5001, 8000)] + [(9000 + i, 9001 + i) for i in range(40)] + [tuple(map(int, rng.integers(0, 60, 2))) for _ in range(40)]
    edges += [(1, 1), (None, 3), (3, None), (5000, 5001)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r.node: r.component for r in connected_components(df, broadcast_edges=broadcast_edges).collect()} == brute(edges)
    assert connected_components(df.limit(0), broadcast_edges=broadcast_edges).count() == 0


def test_staged_tables_go(spark):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir")) / "evidentia"
    before = len(list(folder.iterdir())) if folder.exists() else 0
    with scratch(spark) as keep:
        one, two = staged(spark.range(3)), staged(spark.range(4))
        keep.append(two)
        assert len(list(folder.iterdir())) == before + 2
    assert len(list(folder.iterdir())) == before + 1 and two.count() == 4
    unstage(two, one, spark.range(1))
    assert len(list(folder.iterdir())) == before


def test_stars_need_no_round(spark, monkeypatch):
    """What is already a forest of stars is written once; every round costs the driver a dozen exchanges."""
    written = []
    monkeypatch.setattr(components, "staged", lambda df, name: written.append(name) or staged(df, name))
    stars = [(1, 2), (1, 3), (4, 5)]
    assert {r.node: r.component for r in connected_components(spark.createDataFrame(stars, "src long, dst long")).collect()} == brute(stars)
    assert len(written) == 1
    chain = [(1, 2), (2, 3)]
    assert {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()} == brute(chain)
    assert len(written) == 3


def test_driver_gives_memory_back(spark, monkeypatch):
    """A heap beyond its share is collected when a table is staged, a small one isn't; native memory goes back at most every TRIM_SECONDS."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName() and "Concurrent" not in b.getName())
    trims = []
    monkeypatch.setattr(runtime, "trim_native", trims.append)
    for share, more in ((0.0, 1), (1.0, 0)):
        monkeypatch.setattr(runtime, "HEAP_SHARE", share)
        before = full()
        unstage(staged(spark.range(3)))
        assert full() - before == more
    monkeypatch.setattr(runtime, "_trimmed", [float("-inf")])
    unstage(staged(spark.range(3)), staged(spark.range(3)))
    assert trims[-1] is spark and len(trims) <= 2
    monkeypatch.undo()
    assert runtime.trim_native(spark) in (True, False)
