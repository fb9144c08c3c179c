"""Incremental ingestion with Structured Streaming: files that arrive are read once, repeated deliveries change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdigris.operators.index_segments import SegmentedIndex
from verdigris.sources.bucketed import BucketedTable
from verdigris.sources.sinks import upsert_table


def ingest(spark: SparkSession, folder: str, schema: str, table: str, checkpoint: str, key: list[str], order: str) -> StreamingQuery:
    """Upsert the JSON lines of new files into a table, then stop; the checkpoint remembers what was read.

    Of several rows with a key in one delivery the last by ``order`` counts.
    """

    def merge(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy(*key).agg(F.max_by(F.struct(*batch.columns), order).alias("row")).select("row.*")
        upsert_table(latest, table, key)

    lines = spark.readStream.schema(schema).json(folder)
    return lines.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_buckets(spark: SparkSession, folder: str, schema: str, table: BucketedTable, checkpoint: str, order: str) -> StreamingQuery:
    """The same into a bucketed table: a delivery rewrites the buckets of its keys alone, and one that the table has already changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy(*table.key).agg(F.max_by(F.struct(*batch.columns), order).alias("row")).select("row.*")
        table.upsert(latest, stream=checkpoint, batch=number)

    lines = spark.readStream.schema(schema).json(folder)
    return lines.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_arrivals(spark: SparkSession, folder: str, schema: str, index: SegmentedIndex, checkpoint: str, id_col: str, text_col: str, order: str, gone: str = "false") -> StreamingQuery:
    """Take the JSON lines of new files into an index, then stop. Rows that satisfy ``gone`` delete their id; of several rows with an id in
    one delivery the last by ``order`` counts. The index knows which deliveries it has, so a repeated one changes nothing.
    """

    def take(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy(id_col).agg(F.max_by(F.struct(*batch.columns), order).alias("row")).select("row.*")
        index.apply(latest.where(f"NOT ({gone})"), latest.where(gone), id_col, text_col, checkpoint, number)

    lines = spark.readStream.schema(schema).json(folder)
    return lines.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str, late: str) -> DataFrame:
    """Counts by kind and tumbling window; rows later than the watermark are left out (streams only)."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    counted = marked.groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), kind, "n")
