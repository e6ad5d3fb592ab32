"""Incremental ingest of newly arrived shard files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def incremental_ingest(spark: SparkSession, landing: str, target: str, state: str, schema, key: str = "slide_id", max_files: int = 1000) -> None:
    """Publish the rows of all files that arrived under ``landing`` since the last call, then stop.

    The unit is the file: ``state`` (a shared folder) remembers the files already read, and the rows
    of a file go to the folder ``key / source``, ``source`` being a hash of the file's path. A batch
    that is run again after a crash replaces those same folders, so every row is there once, however
    the files of a key are spread over batches and calls. Late files of a key add to it.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(landing)
    stream = stream.select("*", F.sha2(F.col("_metadata.file_path"), 256).alias("source"))

    def publish(batch, _):
        rows = batch.hint("rebalance", key)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key, "source").parquet(target)

    query = stream.writeStream.foreachBatch(publish).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
