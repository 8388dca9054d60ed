"""Streams: documents chunked as they arrive and laid into a store, and events counted in windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.functions.text import document_id, text_hash
from tessella.operators.chunking import chunk_chars
from tessella.sources.store import GraphStore


def documents(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def ingest(stream: DataFrame, store: GraphStore, graph: str, checkpoint: str, size: int = 1000, overlap: int = 200) -> StreamingQuery:
    """Lays the documents (text) and chunks of each batch into the store; a batch that is repeated changes nothing."""

    def lay(batch: DataFrame, _: int) -> None:
        docs = batch.filter("text is not null").withColumn("document_id", document_id(F.col("text")))
        g = F.lit(graph)
        store.write({
            "documents": docs.select(g.alias("graph_name"), F.col("document_id").alias("id"), text_hash(F.col("text")).alias("text_hash")),
            "chunks": chunk_chars(docs.select("document_id", "text"), size, overlap).select(g.alias("graph_name"), F.col("chunk_id").alias("id"), "document_id", "text", "index"),
        })

    return stream.writeStream.foreachBatch(lay).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """window_start, the kind, n, total by tumbling windows; for streams with a watermark, and for tables."""
    x = events.withWatermark(time, late) if events.isStreaming else events
    return x.groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")
