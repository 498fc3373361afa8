"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder takes its place in local mode; on a
    cluster it is an error, as a machine's own folder would be lost data there.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows that a task of ``spread`` gets about.
ROWS_A_TASK = 1 << 18


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of about so many rows dealt by ``keys`` to tasks of bounded size, so that a larger table is more tasks and not larger ones."""
    return df.repartition(max(1, -(-rows // ROWS_A_TASK)), *keys)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
