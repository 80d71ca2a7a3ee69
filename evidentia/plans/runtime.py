"""Session helpers: where to cut lineage, and how executors get this package."""

from __future__ import annotations

import os
import re
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()
_staged: list[str] = []
#: Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = 8 << 20
#: Share of its greatest heap that the driver's JVM may have taken when a table was staged; beyond it, garbage is collected and heap given back.
HEAP_SHARE = 0.5
#: Seconds from one return of native memory to the next, at least.
TRIM_SECONDS = 5
_trimmed = [0.0]


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only where it is unset and the master is local."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if given:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(given)
        return given
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    given = tempfile.mkdtemp(prefix="evidentia-checkpoint-")
    sc.setCheckpointDir(given)
    return given


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small: each is in memory several times over, in the JVM and in Python. Results don't depend on it."""
    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES
    given = re.fullmatch(r"(\d+)b?", spark.conf.get(key, None) or "")
    if given is None or not 0 < int(given[1]) <= most:
        spark.conf.set(key, f"{most}b")


def staged(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df once as Parquet under the shared folder and read it back: cuts lineage and survives lost executors. It goes with unstage(), or when the driver ends."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/evidentia/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place = _place(spark, path)
    files.deleteOnExit(place)
    _staged.append(path)
    give_back(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def give_back(spark: SparkSession) -> None:
    """Let the driver's JVM return memory that it no longer uses: garbage if its heap has grown beyond HEAP_SHARE, and freed native memory every TRIM_SECONDS.

    Each of many short jobs leaves plans, broadcast tables and compiled code there, and the JVM would rather take more than clear them.
    """
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        jvm.java.lang.System.gc()
    if time.monotonic() - _trimmed[-1] >= TRIM_SECONDS:
        trim_native(spark)
        _trimmed[:] = [time.monotonic()]


def trim_native(spark: SparkSession) -> bool:
    """Whether the driver's JVM has a command that returns freed native memory to the system (JDK 17.0.9 and later, Linux), which is then done."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    of = jvm.java.lang.Class.forName
    kinds, args = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = of(kind)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        of("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:  # no such command
        return False
    return True


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no plan reads any more."""
    for t in tables:
        path = getattr(t, "_staged_at", None)
        if path in _staged:
            files, place = _place(t.sparkSession, path)
            files.delete(place, True)
            _staged.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables staged inside go at the end, but for those put in the list. Nothing that is still to be read may depend on the others."""
    before, keep = set(_staged), []
    yield keep
    for path in [p for p in _staged if p not in before and p not in {getattr(t, "_staged_at", None) for t in keep}]:
        files, place = _place(spark, path)
        files.delete(place, True)
        _staged.remove(path)


def ship(spark: SparkSession) -> None:
    """Give executors this package, unless PYTHONPATH already does."""
    sc = spark.sparkContext
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p}
    if str(ROOT) in on_path or sc.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="evidentia-")) / "evidentia.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((ROOT / "evidentia").rglob("*.py")):
            z.write(f, f.relative_to(ROOT).as_posix())
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
