"""Checkpointed embedding of windows: a stream over window files that stops and resumes where it was."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from echoloom.functions.vectors import hash_embedding
from echoloom.sources.store import JobStore

WINDOWS = "job_id string, window_index int, page int, char_start int, char_end int, doc_char_start int, text string"


def embed_stream(spark: SparkSession, source: str, store: JobStore, checkpoint: str, embedder=hash_embedding, files_per_batch: int = 4) -> StreamingQuery:
    """Embeds windows from parquet files as they come and appends them to the store, then ends.

    The checkpoint folder holds how far it came; a batch that is run again after a failure writes no window twice.
    ``query.stop()`` cancels after the current batch.
    """
    stream = spark.readStream.schema(WINDOWS).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def commit(batch: DataFrame, _: int) -> None:
        fresh = store.uncommitted(batch.dropDuplicates(["job_id", "window_index"]))
        ready = fresh.withColumn("window_id", F.sha2(F.concat_ws("/", "job_id", "window_index"), 256)).withColumn("embedding", embedder(F.col("text")))
        store.append("windows", ready)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
