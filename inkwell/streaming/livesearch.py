"""A stream of as-you-type search strings against the stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkwell.plans.index import ArchiveIndex
from inkwell.plans.search import search_batch

LOG_SCHEMA = "query_id long, raw string"


def stream_search(
    spark: SparkSession, index: ArchiveIndex, in_dir: str, out_dir: str, checkpoint: str, limit: int | None = None
) -> StreamingQuery:
    """Every landed JSON row is one keystroke state; its last open word counts as a prefix."""
    log = spark.readStream.schema(LOG_SCHEMA).json(in_dir).withColumn("prefix_last", F.lit(True))

    def answer(batch: DataFrame, batch_id: int) -> None:
        search_batch(index, batch, limit).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    return (
        log.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
