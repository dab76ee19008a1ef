"""Makes the package importable in Python workers, wherever they run."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_WRITTEN: dict[str, list[str]] = {}  # tables written in between, by application


#: Bytes of an Arrow batch: a task holds a few of them, in the JVM and in Python.
BATCH_KEY, BATCH_DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application; bound Arrow batches unless the session does."""
    if spark.conf.get(BATCH_KEY) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="curaspark-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` whose workers can import this package, however the session was made."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; one of our own only in local mode, where it may be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="curaspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def spill(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage and survives lost executors, and the work above it is
    done once even if several consumers follow.
    """
    path = f"{_own_folder(df.sparkSession)}/{uuid.uuid4().hex}-{label}"
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    relieve(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Share of the largest heap that the driver's JVM may hold before its garbage is collected.
HEAP_SHARE = 0.5


def _command(spark: SparkSession, name: str) -> str | None:
    """Output of a diagnostic command of the driver's JVM; None where it has no such command."""
    jvm, args = spark._jvm, spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, 4)
    try:
        # by the interface's method: the server's own class is closed to py4j
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), name
        return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return None


def relieve(spark: SparkSession) -> None:
    """Give back memory that the driver holds and does not use.

    A written table leaves the plans, broadcasts and shuffles that made it as garbage, for which the JVM grows its heap,
    and what its compilers have freed stays with the C library.  Limits on the driver's process count both.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        gc.collect()  # Python's references keep objects of the JVM
        spark._jvm.java.lang.System.gc()
    _command(spark, "systemTrimNativeHeap")


def written(spark: SparkSession) -> list[str]:
    """Paths of the tables that this application has written in between and not deleted, in order."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, ()))


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of ``written``, whose readers are done."""
    own = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
        own.remove(path)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/curaspark/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Delete what this application has written in between; results that were not stored elsewhere go with it."""
    _delete(spark, _own_folder(spark))
    _WRITTEN.pop(spark.sparkContext.applicationId, None)
