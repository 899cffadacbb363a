"""Joins and groupings along time: as-of join, interval join, sessions.

None of them holds a key's rows in one task. Rows are range-partitioned by key and
time, so a key that a third of all rows share becomes many time ranges; what a
range needs from those before it (the last value of the key it begins with) is
carried in, one row per partition. Ties at the end of the order are dealt out by
row, so that many rows of one key and one time can be split as well.

Keys and times may be null: a null time or key matches nothing in a join. Empty
tables give empty results; repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pizarra.session import cut


# ------------------------------------------------- last value, carried over
def _placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows in time ranges (``_part``): ordered by keys and ``order`` across
    partitions, written once so that every later step sees the same ranges."""
    spread = df.withColumn("_spread", F.monotonically_increasing_id())
    return cut(spread.repartitionByRange(*keys, *order, "_spread").withColumn("_part", F.spark_partition_id()))


def _last(placed: DataFrame, keys: list[str], order: list[str], value: Column, name: str, current: bool = True) -> DataFrame:
    """``placed`` with the last non-null ``value`` of the same key up to each row
    (``current``: itself included)."""
    by = [*order, "_spread"]
    own = Window.partitionBy("_part", *keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow if current else -1)
    given = placed.withColumn("_value", value)
    ranked = F.when(F.col("_value").isNotNull(), F.struct(*by))
    per_key = given.groupBy("_part", *keys).agg(F.max_by("_value", ranked).alias("_value"))
    ends = cut(per_key.groupBy("_part").agg(F.max_by(F.struct(*keys, "_value"), F.struct(*keys)).alias("_end")))
    # which earlier partition, if any, leaves a value to this one's first key
    source, carried, key = [], None, None
    plain = ends.select("_part", F.struct(*(F.col(f"_end.{k}") for k in keys)).alias("key"), F.col("_end._value").isNotNull().alias("has"))
    for row in plain.orderBy("_part").collect():  # one row per partition
        if carried is not None:
            source.append((row["_part"], carried))
        if row["has"]:
            carried, key = row["_part"], row["key"]
        elif key != row["key"]:
            carried = key = None
    links = placed.sparkSession.createDataFrame(source, "_to int, _part int")
    carry = links.join(ends, "_part").select("_to", *(F.col(f"_end.{k}").alias(f"_c{i}") for i, k in enumerate(keys)), F.col("_end._value").alias("_carry"))
    same = reduce(Column.__and__, (given[k].eqNullSafe(carry[f"_c{i}"]) for i, k in enumerate(keys)), given["_part"] == carry["_to"])
    found = given.withColumn("_own", F.last("_value", ignorenulls=True).over(own)).join(carry, same, "left")
    return found.select(*placed.columns, F.coalesce("_own", "_carry").alias(name))


# ------------------------------------------------------------- as-of join
def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_time: str,
    right_time: str,
    take: Sequence[str],
    ties: Sequence[str] = (),
    within: str | None = None,
    prefix: str = "",
) -> DataFrame:
    """Each row of ``left`` with the columns ``take`` (names prefixed) of the last
    row of ``right`` that has the same ``by`` and a time not later than its own;
    null where there is none, or none within the interval ``within`` (such as
    ``"2 HOURS"``). Of right rows at one time the one largest in ``ties`` counts,
    then any."""
    clash = {f"{prefix}{c}" for c in take} & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides, give a prefix: {sorted(clash)}")
    keys = [f"_k{i}" for i in range(len(by))] or ["_k0"]
    own_keys = [F.col(c) for c in by] or [F.lit(0)]
    names = left.columns
    l = left.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), *(k.alias(n) for k, n in zip(own_keys, keys)), F.col(left_time).alias("_t"))
    known = reduce(Column.__and__, (F.col(c).isNotNull() for c in (*by, right_time)))
    tie = F.struct(*(F.col(c) for c in ties)) if ties else F.lit(0)
    value = F.struct(F.col(right_time).alias("_at"), *(F.col(c).alias(f"v{i}") for i, c in enumerate(take)))
    r = right.where(known).select(*(k.alias(n) for k, n in zip(own_keys, keys)), F.col(right_time).alias("_t"), tie.alias("_tie"), value.alias("_right"))
    both = l.withColumn("_side", F.lit(1)).unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    order = ["_t", "_side", "_tie"]
    found = _last(_placed(both, keys, order), keys, order, F.col("_right"), "_found").where("_side = 1")
    if within is not None:
        found = found.withColumn("_found", F.when(F.col("_found._at") >= F.col("_t") - F.expr(f"INTERVAL {within}"), F.col("_found")))
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), *(F.col(f"_found.v{i}").alias(f"{prefix}{c}") for i, c in enumerate(take)))


# ---------------------------------------------------------- interval join
#: Each level's buckets are this many times as wide as those of the one below.
WIDER, LEVELS = 4, 24


def _axis(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(c).cast("timestamp"))
    return F.col(c)


def _bucket(x: Column, width: Column) -> Column:
    return F.floor(x / width)


def interval_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], bucket: float
) -> DataFrame:
    """All pairs with the same ``by`` whose closed intervals (start, end) meet: all
    columns of both, ``by`` once. A point is an interval that ends where it starts;
    one that ends before it starts is empty and meets nothing.

    ``bucket`` is the width of the finest time buckets, in seconds for times and
    dates, else in the columns' unit. An interval belongs to the first of the levels
    (each ``WIDER`` times as wide) at which it covers at most two buckets, so a long
    one is a few wide buckets and not thousands of narrow ones. A pair meets at the
    wider of its two levels, by equality of bucket; of the buckets they share there,
    the one that holds the later of the two starts owns the pair, so it comes once."""
    clash = (set(left.columns) & set(right.columns)) - set(by)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    timed = isinstance(left.schema[left_span[0]].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    base = float(bucket) * (1_000_000 if timed else 1)

    def leveled(df, span, side):
        s, e = (_axis(df, c) for c in span)
        ratio = F.greatest((e - s) / F.lit(base), F.lit(1.0))
        level = F.least(F.ceil(F.log(ratio) / F.log(F.lit(float(WIDER))) - 1e-9), F.lit(LEVELS)).cast("int")
        known = reduce(Column.__and__, (F.col(c).isNotNull() for c in by), s <= e)
        return df.where(known).select(F.struct(*df.columns).alias(side), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), s.alias(f"{side}_s"), e.alias(f"{side}_e"), level.alias("_level"))

    def dealt(df, side, levels, guest):
        """Rows at their own level, or at all coarser ones of ``levels``."""
        at = F.col("_level") if not guest else F.explode(F.filter(F.array(*map(F.lit, levels)), lambda j: j > F.col("_level")))
        rows = df.select("*", at.alias("_at")).drop("_level").withColumn("_width", F.lit(base) * F.pow(F.lit(float(WIDER)), F.col("_at")))
        ends = (_bucket(F.col(f"{side}_{x}"), F.col("_width")) for x in "se")
        return rows.withColumn("_bucket", F.explode(F.sequence(*ends)))

    l, r = leveled(left, left_span, "_l"), leveled(right, right_span, "_r")
    # at most LEVELS + 1 of either
    in_l, in_r = (sorted(row[0] for row in x.select("_level").distinct().collect()) for x in (l, r))
    keys = [f"_k{i}" for i in range(len(by))] + ["_at", "_bucket"]
    # written once, so that both sides are plain exchanges that Spark can split at hot buckets
    own_l, own_r = cut(dealt(l, "_l", in_l, False)), cut(dealt(r, "_r", in_r, False))
    guest_l, guest_r = cut(dealt(l, "_l", in_r, True)), cut(dealt(r, "_r", in_l, True))

    def met(a, b):
        pairs = a.join(b.drop("_width"), keys)
        owner = _bucket(F.greatest("_l_s", "_r_s"), F.col("_width")) == F.col("_bucket")
        return pairs.where((F.col("_l_s") <= F.col("_r_e")) & (F.col("_r_s") <= F.col("_l_e")) & owner).select("_l", "_r")

    pairs = met(own_l, own_r).unionByName(met(own_l, guest_r)).unionByName(met(guest_l, own_r))
    return pairs.select("_l.*", *(F.col(f"_r.{c}").alias(c) for c in right.columns if c not in by))


# --------------------------------------------------------------- sessions
def sessions(df: DataFrame, by: Sequence[str], time: str, gap: float, aggregates: dict[str, Column], longest: float | None = None) -> DataFrame:
    """One row per session of each key: ``by``, session_start, session_end (the last
    row's time), n, and ``aggregates`` over its rows. A session goes on while a row
    follows within ``gap`` seconds of the one before.

    ``longest`` cuts time into slots of that many seconds and ends sessions at their
    borders: a key that never pauses then gives many rows, as it must where a stream
    keeps sessions as state. Even without it no task holds a whole session: rows
    find their session's start by a carried value, and its aggregate is partial on
    the map side. Rows without a time belong to no session; null keys are a key."""
    names = [f"_k{i}" for i in range(len(by))]
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    slot = F.floor(micros / F.lit(int(longest * 1_000_000))) if longest else F.lit(0)
    keyed = df.where(F.col(time).isNotNull()).select("*", micros.alias("_t"), *(F.col(c).alias(n) for c, n in zip(by, names)), slot.alias("_slot"))
    keys = [*names, "_slot"]
    placed = _placed(keyed, keys, ["_t"])
    before = _last(placed, keys, ["_t"], F.col("_t"), "_before", current=False)
    begins = F.col("_before").isNull() | (F.col("_t") - F.col("_before") > F.lit(int(gap * 1_000_000)))
    flagged = cut(before.withColumn("_begins", begins))
    started = _last(flagged, keys, ["_t"], F.when(F.col("_begins"), F.col("_t")), "_start")
    out = started.groupBy(*by, "_slot", "_start").agg(F.min(time).alias("session_start"), F.max(time).alias("session_end"), F.count("*").alias("n"), *(a.alias(n) for n, a in aggregates.items()))
    return out.drop("_slot", "_start")
