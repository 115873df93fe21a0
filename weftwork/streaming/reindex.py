"""Incremental re-indexing: new source files arrive in a folder and their chunks replace the older ones of the same path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_texts(spark: SparkSession, folder: str, pattern: str = "*", files_a_batch: int = 1000) -> DataFrame:
    """(path, modified, text) of the files that appear below a folder, as a stream."""
    files = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def index_stream(texts: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write (path, modified, pos, chunk) of all files there are, a folder for each batch, then stop. A batch that is run
    again after a failure overwrites its own folder, so chunks are neither lost nor doubled."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("path", "modified", F.posexplode(F.split("text", "\n", -1)).alias("pos", "chunk")).where(F.trim("chunk") != "")
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of each path's last version: of the latest modification time, then of the latest batch."""
    rows = spark.read.option("basePath", target).parquet(target)
    last = rows.groupBy("path").agg(F.max(F.struct("modified", "batch")).alias("last"))
    return rows.join(last, "path").where(F.struct("modified", "batch") == F.col("last")).drop("last", "batch")
