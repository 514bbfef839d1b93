"""Incremental curation: a stream of items through the rules, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossmill.operators.curate import cycle_trigger
from glossmill.sources.sinks import append_batch, snapshot


def curate_stream(items: DataFrame, rules: Callable[[DataFrame], DataFrame], accepted: str, rejected: str, checkpoint: str, dataset: str | None = None, rows: int = 10_000, days: int = 7, last_reset: str = "1970-01-01") -> StreamingQuery:
    """Each micro-batch is decided and stored under its number, so a retried batch replaces itself.
    With a dataset path, accepted rows are copied there once there are ``rows`` or ``days`` passed."""

    def store(batch: DataFrame, batch_id: int) -> None:
        decided = rules(batch).persist()
        try:
            append_batch(decided.where("decision = 'accept'"), accepted, batch_id)
            append_batch(decided.where("decision = 'reject'"), rejected, batch_id)
        finally:
            decided.unpersist()
        spark = batch.sparkSession
        if dataset:
            due = spark.read.parquet(accepted).agg(F.count("*").alias("n")).select(cycle_trigger(F.col("n"), F.to_timestamp(F.lit(last_reset)), F.current_timestamp(), rows, days)).first()[0]
            if due:
                snapshot(spark, accepted, dataset, "parquet")

    return items.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
