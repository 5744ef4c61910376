"""Files that keep growing in number, read as a stream: at least once in, exactly once out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.common import ident
from tidelog.operators.late_events import PeriodStore


def tail_lines(spark: SparkSession, folder: str, *, files_per_trigger: int = 100) -> DataFrame:
    """Lines of the files in a folder as a stream, new files as they come: ``value`` and ``source``. What has been
    read is kept in the query's checkpoint, so nothing is skipped and a restart may repeat at most one batch."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(folder).withColumn("source", F.col("_metadata.file_path"))


def tail_table(spark: SparkSession, folder: str, schema, *, files_per_trigger: int = 100) -> DataFrame:
    """Rows of the parquet files in a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once_within(stream: DataFrame, identity: Sequence[str], time: str, delay: str = "24 hours") -> DataFrame:
    """Redeliveries of an identity within a delay dropped; the state for older ones is let go."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(identity))


def running_counts(stream: DataFrame, keys: Sequence[str], time: str, *, span: str = "1 hour", delay: str = "24 hours") -> DataFrame:
    """Counts per keys and slot of event time, final when the watermark has passed the slot."""
    return stream.withWatermark(time, delay).groupBy(*[ident(k) for k in keys], F.window(time, span)).agg(F.count(F.lit(1)).alias("n")).select(*[ident(k) for k in keys], F.col("window.start").alias("slot_start"), "n")


def into_batches(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, str], None], *, once: bool = True) -> StreamingQuery:
    """Every micro-batch given to ``write`` with its number as a token, which makes a repeated batch replace itself."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: write(df, f"{n:012d}"))
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime="10 seconds")).start()


def into_periods(stream: DataFrame, checkpoint: str, store: PeriodStore, *, once: bool = True) -> StreamingQuery:
    """A stream merged into a store of per-period partials, late records included."""
    return into_batches(stream, checkpoint, store.merge, once=once)


