"""The ingest as an incremental Structured Streaming job.

Department files dropped into a landing folder are picked up as they arrive,
stamped with their department (from the file name), decoded with the same
single projection as the batch, and appended to the processed table
(partitioned by department). Unless the caller names another, the checkpoint
lies in the output table's own folder (hidden from readers by its leading
underscore), whatever the application, so the job resumes exactly once after a
driver or executor failure or on the next scheduled run and never re-reads a
file it has committed.

``availableNow`` processes everything present and stops (scheduled runs);
a processing-time trigger keeps it running. The outcome cube can be kept in
the same way: its state is bounded by the code domains, not by rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dictionary import DEPARTMENT_FILES
from ..operators import indicators as ind
from ..operators.decode import decode_all
from ..sources.files import PART_COL, RAW_SCHEMA, _fs, bound, csv_header, first_data_file, path_exists, stamp_department
from ..sources.fixture import RAW_COLUMNS
from ..sources.xlsx import HEADERS


def department_stream(
    spark: SparkSession, landing: str, catalogue: Mapping[int, str] = DEPARTMENT_FILES, max_files: int = 64, header: Sequence[str] | None = None
) -> DataFrame:
    """Raw rows of CSV department exports as they land (``<dept>.csv/part-*.csv``
    or ``<dept>.csv``); rows of files outside the catalogue get a null department.

    Columns are bound by name. ``header`` names them as the files do, published or
    snake_case, in the files' order, and may leave some out: these are null. Without it
    all columns are expected in published order, under the names of a file that has
    landed, or the published ones. A file with another header ends the query with an
    error, it never swaps data."""
    if header is None:
        first = first_data_file(spark, landing, ".csv", recursive=True) if path_exists(spark, landing) else None
        header = RAW_COLUMNS if first and set(csv_header(spark, first)) & set(RAW_COLUMNS) else tuple(HEADERS)
    schema, columns = bound(header, landing)
    stream = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("maxFilesPerTrigger", max_files)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(landing)
    )
    rows = stream.select(*columns, F.col("_metadata.file_path").alias("_file"))
    missing = [F.lit(None).cast(RAW_SCHEMA[c].dataType).alias(c) for c in RAW_COLUMNS if c not in rows.columns]
    return stamp_department(rows.select("*", *missing), catalogue, F.col("_file")).select(*RAW_COLUMNS)


def own_checkpoint(spark: SparkSession, table: str) -> str:
    """The default checkpoint of a stream into ``table``. A table that a stream
    wrote under another checkpoint is an error: with a new one, batch ids would
    begin at 0 again and clash with those the table already has."""
    table = table.rstrip("/")
    checkpoint = f"{table}/_checkpoint"
    # the stream writes its metadata file before anything else, the table after it
    if not path_exists(spark, f"{checkpoint}/metadata") and path_exists(spark, table):
        fs, p = _fs(spark, table)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        if any(n == "_spark_metadata" or n.startswith("version=") for n in names):
            raise ValueError(f"{table} was written by a stream with another checkpoint; pass that as checkpoint=")
    return checkpoint


def start_ingest(
    spark: SparkSession,
    landing: str,
    processed: str,
    catalogue: Mapping[int, str] = DEPARTMENT_FILES,
    checkpoint: str | None = None,
    available_now: bool = True,
    header: Sequence[str] | None = None,
) -> StreamingQuery:
    """Append decoded rows to the processed table (exactly once)."""
    checkpoint = checkpoint or own_checkpoint(spark, processed)
    writer = (
        decode_all(department_stream(spark, landing, catalogue, header=header))
        .writeStream.format("parquet")
        .option("path", processed)
        .option("checkpointLocation", checkpoint)
        .partitionBy(PART_COL)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def start_cube(
    spark: SparkSession,
    landing: str,
    table: str,
    catalogue: Mapping[int, str] = DEPARTMENT_FILES,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Keep the outcome cube current: a streaming aggregate whose state has at
    most one entry per cube cell; each micro-batch rewrites the (small) table."""
    checkpoint = checkpoint or own_checkpoint(spark, table)
    cube = ind.outcome_cube(decode_all(department_stream(spark, landing, catalogue)))

    def publish(batch: DataFrame, epoch: int) -> None:
        # repartition, not coalesce: the stateful aggregate keeps its
        # parallelism and only the bounded cube moves to the writer task.
        # A version is complete once its folder has Spark's _SUCCESS mark;
        # readers take the newest complete one, so they never see a gap.
        batch.repartition(1).write.mode("overwrite").parquet(f"{table}/version={epoch:012d}")
        # two older versions stay for readers that have begun
        fs, old = _fs(spark, f"{table}/version={epoch - 3:012d}")
        if epoch >= 3:
            fs.delete(old, True)

    return (
        cube.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(publish)
        .trigger(availableNow=True)
        .start()
    )


def read_cube(spark: SparkSession, table: str) -> DataFrame:
    """The newest complete version of the cube table."""
    fs, p = _fs(spark, table)
    versions = sorted(str(s.getPath().toString()) for s in fs.listStatus(p) if s.getPath().getName().startswith("version="))
    complete = [v for v in versions if path_exists(spark, f"{v}/_SUCCESS")]
    if not complete:
        raise FileNotFoundError(f"no complete version of the cube in {table}")
    return spark.read.parquet(complete[-1])


__all__ = ["department_stream", "start_ingest", "start_cube", "read_cube"]
