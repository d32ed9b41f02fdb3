"""Metrics of sentences that arrive as files: the state is a streaming aggregate, so it outlives the query that keeps it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.metrics import finalised, state


def stream_states(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, bins: int = 15, top_k: int = 5) -> StreamingQuery:
    """Keep the metric state (``operators.metrics.state``) of all sentences (logits, targets) that are in Parquet files of ``source``, then stop.

    After each batch the whole state is written below ``sink``, a folder for each batch; a batch that runs again after
    a failure writes its folder again.  Started again with the same ``checkpoint`` it goes on with new files.
    """
    rows = state(spark.readStream.schema(schema).parquet(source), "logits", "targets", bins=bins, top_k=top_k)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number:012}")

    return rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()


def latest_state(spark: SparkSession, sink: str) -> DataFrame:
    """The state after the last batch; a state of a rank or run like any other, so it merges with those."""
    rows = spark.read.parquet(sink)
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), "batch", "left_semi").drop("batch")  # one row


def latest_metrics(spark: SparkSession, sink: str) -> DataFrame:
    return finalised(latest_state(spark, sink))
