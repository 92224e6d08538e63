"""An extension: postings kept up to date from a stream of document files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokens


def document_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def stream_postings(docs: DataFrame, text: str = "content", field: str = "c") -> DataFrame:
    """Postings of arriving documents; stateless, so it appends."""
    return docs.select("doc_index", F.explode(tokens(text, 3, 180)).alias("term")).select("term", F.lit(field).alias("field"), "doc_index")


def upsert_postings(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's postings to a folder of its own, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        stream_postings(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
