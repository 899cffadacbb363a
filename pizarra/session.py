"""Session construction and the shared scratch location.

On a cluster the shared folder is whatever ``spark.checkpoint.dir`` names;
it is only set here when the session has none (local runs and tests).
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "pizarra") -> SparkSession:
    """The active session, left as it is, or a new one.

    Settings made in code win over those of ``spark-submit``, so a new session
    gets none beyond what the caller names: no master and no shuffle partition
    count of its own. A ``local`` master (tests, bench, tools) also gets the
    settings that make sense on one machine."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        builder = SparkSession.builder.appName(app)
        if master is not None:
            builder = builder.master(master)
        if shuffle_partitions is not None:
            builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        if master is not None and master.startswith("local"):
            builder = (
                builder.config("spark.ui.enabled", "false")
                .config("spark.ui.showConsoleProgress", "false")
                # files of cut tables go when nothing refers to them any more
                .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
                .config("spark.sql.session.timeZone", "UTC")
                # call-site capture for error messages costs several driver-to-JVM
                # calls per Column built
                .config("spark.python.sql.dataFrameDebugging.enabled", "false")
                .config("spark.driver.memory", os.environ.get("PIZARRA_DRIVER_MEMORY", "16g"))
            )
        spark = builder.getOrCreate()
        if master is not None and master.startswith("local"):
            spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared lineage-cutting folder: ``spark.checkpoint.dir`` if the session
    names one, otherwise a fresh local folder -- for ``local[...]`` masters
    only (local runs and tests). On a cluster a machine-local folder would be
    invisible to the other executors, so an unset setting is an error there."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster (e.g. on HDFS or object storage)")
    local = tempfile.mkdtemp(prefix="pizarra-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: computed once, no lineage behind
    it, survives the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scan_only(df: DataFrame) -> bool:
    """Whether the optimised plan is a file scan with projections and filters that
    give the same rows every time."""

    def only(plan) -> bool:
        if plan.nodeName() not in ("LogicalRelation", "Project", "Filter") or not plan.deterministic():
            return False
        children = plan.children()
        return all(only(children.apply(i)) for i in range(children.size()))

    return only(df._jdf.queryExecution().optimizedPlan())


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffles and cut tables that nothing refers to any
    more. It learns of them when the JVM collects garbage, which a driver with little
    to do puts off while the files pile up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stage_dir(spark: SparkSession, *parts: str) -> str:
    """Folder for tables this library writes itself (exports, round trips); each
    application has its own."""
    base = spark.conf.get("pizarra.stage.dir", None) or (checkpoint_dir(spark) + "/pizarra-stage")
    return "/".join([base.rstrip("/"), spark.sparkContext.applicationId, *parts])


def clear_stage(spark: SparkSession) -> None:
    """Remove what this application has staged. Results are read lazily from
    there, so call it when the last of them has been consumed."""
    remove(spark, stage_dir(spark))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new stage folder: nothing that an earlier call left is ever read."""
    return stage_dir(spark, f"{name}-{uuid.uuid4().hex}")
