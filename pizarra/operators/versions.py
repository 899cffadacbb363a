"""Comparing two versions of a table, row by row, with repeats counted.

Most rows of two ingests are the same, so whole rows are not what is compared
first. Each row becomes a hash and a sign (+1 in the new version, -1 in the old);
signs and a second, independent hash are summed per hash, map-side first. Only rows
whose hash does not cancel out go on as whole rows and are counted exactly; a hash
whose signs cancel while the second sum does not held different rows that collide,
and goes on as well.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pizarra.session import cut


def _row_hash(df: DataFrame, salt: int) -> Column:
    """Of all columns and which of them are null (Spark's hashes skip nulls)."""
    return F.xxhash64(F.lit(salt), *(F.col(c) for c in df.columns), *(F.col(c).isNull() for c in df.columns))


def multiset_diff(old: DataFrame, new: DataFrame, row_hash=_row_hash) -> DataFrame:
    """Distinct rows that the versions hold a different number of times: the
    columns, n_old, n_new and change (``added``: not in the old version,
    ``removed``: not in the new one, ``changed``: another number of times). Equal to
    ``new EXCEPT ALL old`` and ``old EXCEPT ALL new`` taken together.

    Columns are matched by name and must be the same; nulls are equal to each
    other. Rows that repeat cost one row per task, however often they do. Columns
    of map type can't be compared. Two empty tables have no differences."""
    if sorted(old.columns) != sorted(new.columns):
        raise ValueError(f"different columns: {sorted(set(old.columns) ^ set(new.columns))}")
    mapped = [f.name for f in old.schema if isinstance(f.dataType, T.MapType)]
    if mapped:
        raise ValueError(f"columns of map type: {mapped}")
    names = old.columns
    inner = [f"c{i}" for i in range(len(names))]
    both = [(df.select(*(F.col(c).alias(i) for c, i in zip(names, inner))), sign) for df, sign in ((old, -1), (new, 1))]

    def hashed(df):
        return df.withColumn("_h", row_hash(df.select(*inner), 1))

    signed = reduce(DataFrame.unionAll, (hashed(df).select("_h", (F.lit(sign) * row_hash(df, 2).cast("decimal(20,0)")).alias("check"), F.lit(sign).alias("sign")) for df, sign in both))
    sums = signed.groupBy("_h").agg(F.sum("sign").alias("net"), F.sum("check").alias("check"))
    # cut, so that Spark can split the rows of a row that repeats very often
    open_ = cut(sums.where("net <> 0 or check <> 0").select("_h"))
    rows = [hashed(df).join(open_, "_h", "left_semi").groupBy(*inner).agg(F.count("*").alias("n")).withColumn("new", F.lit(sign > 0)) for df, sign in both]
    n = lambda new: F.coalesce(F.sum(F.when(F.col("new") == new, F.col("n"))), F.lit(0)).cast("long")
    counted = rows[0].unionAll(rows[1]).groupBy(*inner).agg(n(False).alias("n_old"), n(True).alias("n_new")).where("n_old <> n_new")
    change = F.when(F.col("n_old") == 0, "added").when(F.col("n_new") == 0, "removed").otherwise("changed")
    return counted.select(*(F.col(i).alias(c) for c, i in zip(names, inner)), "n_old", "n_new", change.alias("change"))


def diff_summary(diff: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows added and removed per group of a ``multiset_diff``, repeats counted."""
    more = F.sum(F.greatest(F.col("n_new") - F.col("n_old"), F.lit(0))).cast("long")
    less = F.sum(F.greatest(F.col("n_old") - F.col("n_new"), F.lit(0))).cast("long")
    return diff.groupBy(*by).agg(more.alias("added"), less.alias("removed"))
