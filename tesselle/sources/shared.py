"""The folder that the driver and all executors share, for what a plan writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder, as a URI."""
    shared_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{tag}-{uuid.uuid4().hex}"


def shared_checkpoints(spark: SparkSession) -> None:
    """Have checkpoints go to the folder of ``spark.checkpoint.dir``.

    Where it is unset, a folder set before stays; with a local master a temporary one is made, on a
    cluster, where executors share no local folder, it is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tesselle-")
    sc.setCheckpointDir(base)
