"""Tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local one is made only for a local master, whose executors are this
    machine; a cluster without the setting is an error."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not have:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        have = "file://" + os.path.join(tempfile.gettempdir(), "lodestra-checkpoints")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(have)
    return have


def settled(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that all its readers see the same rows and its lineage
    ends at replicated files. The files go when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
