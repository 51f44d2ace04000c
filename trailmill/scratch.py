"""Intermediate tables in the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """This application's part of the shared folder of ``spark.checkpoint.dir``. Only where none is set
    and the session runs on one machine (tests), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not root:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="trailmill-"))
        root = sc._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/trailmill-{sc.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Removes all that this application has written there. What was returned before can't be read then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: the lineage ends there,
    so a lost executor costs a re-read and no recomputation."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
