"""Shared storage for intermediate tables.

Lineage is cut by writing a table below the folder that the cluster names in
``spark.checkpoint.dir``.  A written table survives the loss of an executor and
carries its real size, which the planner uses to pick join strategies.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
_KNOWN: set[str] = set()


def workspace(spark: SparkSession) -> str:
    """The folder of this application below the shared one; it is deleted when the application ends.

    Without ``spark.checkpoint.dir`` a temporary folder will do for a session whose
    executors are on this machine; on a cluster that is an error."""
    context = spark.sparkContext
    base = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        base = context.getCheckpointDir()
    folder = f"{base.rstrip('/')}/quire-{context.applicationId}"
    if folder not in _KNOWN:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _KNOWN.add(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c):
    """A-Z lower-cased and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))
