"""Search queries as they arrive.

The reference searches query lists in batches; here each micro-batch of newly arrived query files
is one batch, searched with the same DataFrame plan against a stored index. Output is written per
micro-batch into its own ``epoch=`` partition with dynamic overwrite, so a retried batch replaces
its own output (exactly-once files) and the stream's progress lives in the checkpoint location.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import QUERIES_FILE_SCHEMA
from ..session import ensure_checkpoint_dir


def query_stream(spark: SparkSession, queries_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming ``(query_id, text)`` from JSON-lines files ``{"_id", "text"}`` landing in a folder."""
    r = spark.readStream.schema(QUERIES_FILE_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(queries_dir).withColumnRenamed("_id", "query_id")


def search_stream(
    queries: DataFrame,
    search: Callable[[DataFrame], DataFrame],
    out_dir: str,
    checkpoint_location: str | None = None,
    available_now: bool = False,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Run ``search(batch_queries) -> runs`` on every micro-batch and append the runs to ``out_dir``.

    ``checkpoint_location`` defaults to a folder under the session's shared checkpoint directory.
    """
    spark = queries.sparkSession
    if checkpoint_location is None:
        checkpoint_location = os.path.join(ensure_checkpoint_dir(spark), f"query-stream-{uuid.uuid4().hex}")

    def run_batch(batch: DataFrame, epoch_id: int) -> None:
        (
            search(batch)
            .withColumn("epoch", F.lit(epoch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("epoch")
            .parquet(out_dir)
        )

    w = queries.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_location)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
