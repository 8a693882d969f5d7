"""What the operators of this package share: the folder that all executors see, and cut points in a plan."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder serves a session whose driver and tasks are one process (``local``,
    ``local[n]``); any other master needs the setting.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="downfield-")
    return _OWN[sc.applicationId]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: The share of the driver's heap in use from which a cut lets go of finished executions, before the heap grows to its most.
FULL = 0.4
#: Spark's own setting by which a finished execution removes its shuffle files.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor costs only tasks after it.

    The shuffle files of the execution that wrote it go with its end, as nothing will read them again.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() - heap.freeMemory() > FULL * heap.maxMemory():
        tidy(spark)
    return out


#: Bytes of an Arrow batch that goes to a Python worker, about: memory must not follow the length of the texts.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches be small from now on; Spark ends one by its bytes or its rows, whichever come first."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def tidy(spark: SparkSession) -> None:
    """Let the driver collect what finished executions left in its memory: broadcasts and plans.

    Operators of many small executions would grow the driver's heap with them otherwise.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*cuts: DataFrame) -> None:
    """Remove the files of cuts that nothing will read again."""
    for df in cuts:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
