"""Helpers shared by the operators of this subpackage (``cut``, ``release`` and
``scan_only`` are the library's)."""

from __future__ import annotations

import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pizarra.session import cut, release, scan_only  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes Spark's byte-wise ``lower``;
    other text goes through ``translate``, which leaves all else alone."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Number the rows, so that repeated or null document ids stay apart.

    Branches that are joined on the number have to agree on it. In a frame read from
    files it depends on the file split and the place within it, which every branch
    and every retried task sees again, whatever columns it reads. The rows of any
    other frame (after a shuffle, a join, a union) may come in another order in each
    branch: these are numbered and written once, and every branch reads that."""
    numbered = df.withColumn(name, F.monotonically_increasing_id())
    return numbered if scan_only(df) else cut(numbered)


_LEFT: list[Callable[[], None]] = []


def on_handover(drop: Callable[[], None]) -> None:
    """Register what drops an operator's tables from a Python worker."""
    _LEFT.append(drop)


def handed_on() -> None:
    """To be called by a task of an operator that keeps no tables. Spark reuses Python
    workers: what tasks of other operators have left in this one would stay beside
    what this task takes, and Arrow keeps memory it has freed."""
    for drop in _LEFT:
        drop()
    pa.default_memory_pool().release_unused()


def bitmap(df: DataFrame, place: Callable[[int], Column], most: int, per_row: int = 16, least: int = 1 << 16) -> tuple[bytes, int]:
    """Bits set at ``place(bits)`` of every row, and how many bits there are:
    ``per_row`` for each row, rounded up to a power of two, from ``least`` to
    ``most``. Bit k is bit k % 8 of byte k // 8. Beyond ``most`` the map fills up: it
    lets more through and loses nothing."""
    bits, wanted = least, per_row * df.count()
    while bits < min(wanted, most):
        bits *= 2
    at = place(bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    words = df.select(F.shiftright(at, 6).cast("int").alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    found = words.toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, "<i8")
    out[found["word"].to_numpy()] = found["bit"].to_numpy()
    return out.tobytes(), bits
