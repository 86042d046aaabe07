"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where no folder is named, a temporary one serves a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='labelloom')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def written(df: DataFrame, label: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: it is worked out once, and a lost executor costs no rerun. The job runs at once.

    No marker of success is left, as nobody looks for it: for every file and folder that Hadoop makes on a local disk without native libraries
    it starts a process, which for a moment counts the driver's memory twice.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
