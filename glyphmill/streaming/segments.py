"""Segmentation of a corpus that arrives as files: the batch operators on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.profile import LATIN, Profile
from ..operators.segment import eligible, segments


def segment_rows(docs: DataFrame, p: Profile = LATIN) -> DataFrame:
    """doc_id, pos, text, label; stateless, so it is the same on a stream and needs no watermark."""
    return eligible(docs, p).select("doc_id", F.posexplode(segments(F.col("text"), p))).select("doc_id", "pos", "col.text", "col.label")


def stream_segments(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, p: Profile = LATIN) -> StreamingQuery:
    """Read what Parquet files are in ``source``, append their segments to ``sink``, stop."""
    docs = spark.readStream.schema(schema).parquet(source)
    return segment_rows(docs, p).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_label_counts(spark: SparkSession, source: str, schema: str, name: str, p: Profile = LATIN) -> StreamingQuery:
    """Counts of segments by label, complete after each batch of files, as a table in memory (three rows)."""
    docs = spark.readStream.schema(schema).parquet(source)
    return segment_rows(docs, p).groupBy("label").count().writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
