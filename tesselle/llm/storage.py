"""Shared storage of a run: everything that one task writes and another reads goes through here.

Executors have no common local disk, so intermediate tables and binary shards live under the
folder named by ``spark.checkpoint.dir``. Only where that setting is absent and the master is local
(tests, a laptop) is a temporary folder made and configured; on a cluster its absence is an error.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from tesselle.llm.memory import release


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder as a URI, without a trailing slash."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.get("dir") or _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="tesselle-"))
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_own: dict[str, str] = {}


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tesselle/{tag}-{uuid.uuid4().hex}"


#: Rows of whole texts that go to a Python worker at once, where the session leaves Spark's default of 10,000.
TEXT_ROWS = 1000


def text_rows(df: DataFrame) -> DataFrame:
    """``df``, whose texts go to Python workers a few at a time: batches of the default size hold tens of megabytes
    on both sides of every task. A session's own setting stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(TEXT_ROWS))
    return df


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to shared storage and return the table read back.

    Cuts the lineage: later stages survive the loss of any executor without recomputing ``df``.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    give_back(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._tesselle_path = path
    return out


def held_by(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, which reads a materialized table of its own; discarding ``df`` deletes that table."""
    df._tesselle_path = table._tesselle_path
    return df


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no returned plan reads any more."""
    for t in tables:
        path = getattr(t, "_tesselle_path", None)
        if path:
            delete(t.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Have Spark delete now the shuffle files of steps whose results are written; else they stay on the executors'
    disks until the driver happens to collect its garbage. The first round lets go of what Python held, the second
    finds what the JVM's listeners held meanwhile."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def give_back(spark: SparkSession) -> None:
    """Have the driver return freed memory to the system. The C library else keeps what a step's plans and compilations
    took, apart for each of the JVM's many threads. JVMs without this command keep it still."""
    release()
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    lang = jvm.java.lang
    kinds, args = new(lang.Class, 4), new(lang.Object, 4)
    try:
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = lang.Class.forName(kind)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = lang.management.ManagementFactory.getPlatformMBeanServer()
        lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, args)
    except Py4JError:
        pass


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; works on the driver and on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
