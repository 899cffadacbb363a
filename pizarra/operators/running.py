"""Running totals and ranks over a whole ordered table, without one big window.

A window without ``PARTITION BY`` sends every row to one task. Here rows are
range-partitioned by the order columns, each partition sums its own rows, and the
totals of the partitions before it are carried in: one row per partition is all
that meets in one place.

Two frames:

* ``running_sums``: row by row in a total order (``ROWS``). Give enough order
  columns to make it total; rows that tie in all of them come in any order.
* ``running_peers``: peers share one value (``RANGE``), as do the ranks of
  ``ranked_by``. Rows are first counted per distinct key, map-side, and only the
  distinct keys are ordered, so a key that a third of all rows holds is one row.

Nulls: a null value adds nothing; null keys come first, as in Spark's ascending
order. Empty tables give no rows. Sums keep Spark's type of ``sum``: decimals and
integers are exact, doubles depend on the order of addition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pizarra.session import cut


def running_sums(df: DataFrame, order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of its column over all rows
    up to and including this one."""
    names = df.columns
    held = df.select(
        *(F.col(c).alias(f"c{i}") for i, c in enumerate(names)),
        *((F.col(c) if isinstance(c, str) else c).alias(f"_o{i}") for i, c in enumerate(order)),
        *(c.alias(f"_v{i}") for i, c in enumerate(sums.values())),
    )
    by = [f"_o{i}" for i in range(len(order))]
    placed = cut(held.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(*(F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(sums)))).orderBy("_part")
    carried, so_far = [], [None] * len(sums)
    for row in totals.collect():  # one row per partition
        carried.append((row["_part"], *so_far))
        so_far = [t if s is None else s if t is None else s + t for s, t in zip(so_far, row[1:])]
    before = df.sparkSession.createDataFrame(carried, totals.schema)
    own = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.select("*", *(F.sum(f"_v{i}").over(own).alias(f"_l{i}") for i in range(len(sums))))
    kinds = {f"_t{i}": totals.schema[f"_t{i}"].dataType for i in range(len(sums))}
    zero = {name: F.lit(0).cast(kind) for name, kind in kinds.items()}
    return local.join(before, "_part").select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(names)),
        *((F.coalesce(f"_t{i}", zero[f"_t{i}"]) + F.coalesce(f"_l{i}", zero[f"_t{i}"])).cast(kinds[f"_t{i}"]).alias(n) for i, n in enumerate(sums)),
    )


def running_peers(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of its column over all rows
    whose keys are not larger: rows of equal keys share it."""
    per_key = df.groupBy(*keys).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    running = running_sums(per_key, list(keys), {f"_r_{n}": F.col(n) for n in sums})
    # cut, so that Spark can split the rows of a hot key in the join
    running = cut(running.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(f"_r_{n}") for n in sums)))
    same = reduce(Column.__and__, (df[k].eqNullSafe(running[f"_k{i}"]) for i, k in enumerate(keys)))
    return df.join(running, same).select(*(df[c] for c in df.columns), *(F.col(f"_r_{n}").alias(n) for n in sums))


def ranked_by(df: DataFrame, keys: list[str], rank: str = "rank", dense: str = "dense_rank") -> DataFrame:
    """``df`` with its rank (1 + rows of smaller keys) and dense rank (1 + smaller
    distinct keys) over the whole table, ascending."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    running = running_sums(per_key, list(keys), {"_upto": F.col("_n"), "_dense": F.lit(1)})
    running = cut(
        running.select(
            *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), (F.col("_upto") - F.col("_n") + 1).alias("_rank"), "_dense"
        )
    )
    same = reduce(Column.__and__, (df[k].eqNullSafe(running[f"_k{i}"]) for i, k in enumerate(keys)))
    return df.join(running, same).select(*(df[c] for c in df.columns), F.col("_rank").alias(rank), F.col("_dense").alias(dense))
