"""What the operators share: reading tables, cutting lineage, free names, null ids and even buckets."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The id that stands for a null doc_id inside an operator: it sorts before all others.
NULL_ID = -(2**63)
#: Texts of one bucket, in bytes; a bucket is held by one Python worker.
BUCKET_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds the rows of the Arrow batches that Python workers hold: a text can be very long. The setting is
    the session's and stays, as a lazy result may run at any later time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. A local one is made only for a local master, whose
    executors are this machine; a cluster without the setting is an error."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not have:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        have = "file://" + os.path.join(tempfile.gettempdir(), "lodestra-checkpoints")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(have)
    return have


class Scratch:
    """Tables written to the shared folder and read back, so that their lineage ends at replicated files.

    done() writes a last table and removes all others; the last one goes when the driver's JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def settled(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark).rstrip('/')}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        files, place = self._files(path)
        files.deleteOnExit(place)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            files, place = self._files(path)
            files.delete(place, True)
        self.paths = []

    def done(self, df: DataFrame) -> DataFrame:
        before, self.paths = self.paths, []
        last = self.settled(df)
        keep, self.paths = self.paths, before
        self.clear()
        self.paths = keep
        return last


def settled(spark: SparkSession, df: DataFrame) -> DataFrame:
    """One table of that kind."""
    return Scratch(spark).settled(df)


def free_name(taken: list[str], name: str) -> str:
    """`name`, longer by underscores until no column of `taken` has it (Spark ignores case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def inner_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def outer_id(name: str) -> Column:
    return F.when(F.col(name) != F.lit(NULL_ID), F.col(name))


def bucket_count(docs: DataFrame, text: str = "text", bytes_per_bucket: int = BUCKET_BYTES) -> int:
    """How many buckets keep each near bytes_per_bucket: the texts' bytes are summed, 32 a row added."""
    size = docs.agg(F.sum(F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 32).alias("n")).first()["n"] or 0
    return max(partitions(docs.sparkSession), -(-int(size) // bytes_per_bucket))
