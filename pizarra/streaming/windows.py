"""Event-time windows and sessions over a stream, with late rows cut by a watermark.

The same functions take a batch or a streaming frame. On a stream the state is one
entry per open window (or session) and key; it is written out once the watermark,
the largest time seen less ``delay``, passes its end, and dropped from the state.
Rows whose window has been written already are late and change nothing. A batch
has no late rows; ``closed`` keeps the part of its result that a stream has
written.

Nulls: a row without a time belongs to no window. Null keys are a key. Spark's
watermarks need times of a zone; a stream's times without one are read, and given
back, in the session's zone, so keep that free of clock changes (UTC).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .ingest import own_checkpoint


def landed(spark: SparkSession, landing: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """Rows of the Parquet files in a folder, as they land."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(landing)


def _marked(df: DataFrame, time: str, delay: str | None) -> DataFrame:
    rows = df.where(F.col(time).isNotNull())
    if not df.isStreaming or delay is None:
        return rows
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def windowed(df: DataFrame, time: str, by: Sequence[str], aggregates: dict[str, Column], width: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """``by``, window_start, window_end, n and ``aggregates`` per tumbling window of
    ``width``, or per sliding one that begins every ``slide``."""
    rows = _marked(df, time, delay)
    grouped = rows.groupBy(*by, F.window(time, width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"), *(a.alias(n) for n, a in aggregates.items()))
    kind = df.schema[time].dataType
    return grouped.select(*by, F.col("w.start").cast(kind).alias("window_start"), F.col("w.end").cast(kind).alias("window_end"), "n", *aggregates)


def session_windows(df: DataFrame, time: str, by: Sequence[str], aggregates: dict[str, Column], gap: float, delay: str | None = None, longest: float | None = None) -> DataFrame:
    """Sessions as ``operators.temporal.sessions`` defines them, merged in a stream's
    state. ``longest`` bounds a key's state: sessions end at the borders of slots of
    that many seconds, and a closed slot leaves the state.

    session_closes is the time up to which a row would still have joined."""
    rows = _marked(df, time, delay)
    keys = list(by)
    if longest is not None:
        rows = rows.withColumn("_slot", F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(int(longest * 1_000_000))))
        keys.append("_slot")
    window = F.session_window(time, f"{int(gap * 1_000_000)} microseconds").alias("w")
    grouped = rows.groupBy(*keys, window).agg(
        F.min(time).alias("session_start"), F.max(time).alias("session_end"), F.count(F.lit(1)).alias("n"), *(a.alias(n) for n, a in aggregates.items())
    )
    kind = df.schema[time].dataType
    ends = (F.col(c).cast(kind).alias(name) for c, name in (("session_start", "session_start"), ("session_end", "session_end"), ("w.end", "session_closes")))
    return grouped.select(*by, *ends, "n", *aggregates)


def closed(batch: DataFrame, end: str, mark: Column) -> DataFrame:
    """The rows of a batch result that a stream whose watermark is ``mark`` has
    written: windows that end at it or before."""
    return batch.where(F.col(end) <= mark)


def start_windows(result: DataFrame, table: str, checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Append closed windows (or sessions) to a Parquet table, exactly once. The
    checkpoint lies in the table's own folder unless another is named."""
    checkpoint = checkpoint or own_checkpoint(result.sparkSession, table)
    writer = result.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
