"""Object files as a stream: new images are evaluated once, in batches that write what is not there yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from labelloom.sources.documents import not_done


def stream_images(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Pixel tables that arrive as Parquet in `source` go through work() by micro-batch; image_ids that target has are passed over."""

    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def write(batch: DataFrame, _: int) -> None:
        if files.exists(at):
            batch = not_done(batch, batch.sparkSession.read.parquet(target).select("image_id").distinct())
        work(batch).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
