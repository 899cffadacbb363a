"""As-of joins, interval joins, sessions and running totals against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pizarra.operators import running, temporal

T0 = datetime(2024, 1, 1)


def at(hours):
    return None if hours is None else T0 + timedelta(hours=hours)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def two_tables(spark):
    r = random.Random(1)
    # one key has half of all rows; times tie often
    key = lambda: r.choice(["hot"] * 5 + ["a", "b", "c", None])
    left = [(i, key(), at(r.choice([None, *range(40)]))) for i in range(300)]
    right = [(i, key(), at(r.choice([None, *range(0, 40, 3)])), r.choice([None, 1.5, 2.5])) for i in range(200)]
    left += [left[5]] * 4
    return left, right


def asof_by_hand(left, right, hours=None):
    out = []
    for i, k, t in left:
        found = [x for x in right if None not in (k, t, x[1], x[2]) and x[1] == k and x[2] <= t]
        best = max(found, key=lambda x: (x[2], x[0]), default=None)
        if best and hours is not None and best[2] < t - timedelta(hours=hours):
            best = None
        out.append((i, k, t, *(best[0::3] if best else (None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("within,hours", [(None, None), ("2 HOURS", 2)])
def test_asof_join(spark, two_tables, within, hours):
    left, right = two_tables
    l = spark.createDataFrame(left, "id long, k string, t timestamp")
    r = spark.createDataFrame(right, "rid long, k string, rt timestamp, v double")
    got = temporal.asof_join(l, r, ["k"], "t", "rt", ["rid", "v"], ties=["rid"], within=within)
    assert rows_of(got) == asof_by_hand(left, right, hours)


def test_asof_join_shapes(spark, two_tables):
    left, right = two_tables
    l = spark.createDataFrame(left, "id long, k string, t timestamp")
    r = spark.createDataFrame(right, "id long, k string, t timestamp, v double")
    with pytest.raises(ValueError):
        temporal.asof_join(l, r, ["k"], "t", "t", ["id"])
    got = temporal.asof_join(l, r, ["k"], "t", "t", ["id", "t"], ties=["id"], prefix="last_")
    assert got.columns == ["id", "k", "t", "last_id", "last_t"]
    # without keys: the last row of all
    every = temporal.asof_join(l.where("t is not null"), r.withColumnRenamed("id", "rid"), [], "t", "t", ["rid"], ties=["rid"])
    want = asof_by_hand([(i, 0, t) for i, _, t in left if t], [(i, 0, t, v) for i, _, t, v in right])
    assert sorted((x["id"], x["t"], x["rid"]) for x in every.collect()) == sorted((i, t, x) for i, _, t, x, _ in want)
    empty = l.where("id < 0")
    assert temporal.asof_join(empty, r.withColumnRenamed("id", "rid"), ["k"], "t", "t", ["rid"]).count() == 0
    none = temporal.asof_join(l, r.where("id < 0").withColumnRenamed("id", "rid"), ["k"], "t", "t", ["rid"])
    assert none.count() == len(left) and none.where("rid is not null").count() == 0


def test_asof_splits_a_hot_key(spark):
    """The rows of one key lie in many time ranges, and no join is a cross or range join."""
    l = spark.range(20_000).selectExpr("id", "'hot' as k", "timestamp_seconds(id * 10) as t")
    r = spark.range(500).selectExpr("id as rid", "'hot' as k", "timestamp_seconds(id * 400 + 5) as rt")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = temporal._placed(l.withColumn("_t", F.col("t")), ["k"], ["_t"])
        sizes = [x["count"] for x in placed.groupBy("_part").count().collect()]
        got = temporal.asof_join(l, r, ["k"], "t", "rt", ["rid"])
        assert got.where("rid <> least(floor((id * 10 - 5) / 400), 499)").count() == 0 and got.where("rid is null").count() == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 4 and max(sizes) < 0.5 * sum(sizes)
    text = plan_of(got)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "SinglePartition" not in text


def interval_rows(r, n, key):
    out = []
    for i in range(n):
        s = r.uniform(0, 1000)
        length = r.choice([0, 0, 1, 5, 30, 400, 5000, -3])
        out.append((i, key(), r.choice([None, s]) if r.random() < 0.05 else s, s + length))
    return out


def test_interval_join(spark):
    r = random.Random(2)
    key = lambda: r.choice(["hot"] * 4 + ["a", "b", None])
    left, right = interval_rows(r, 200, key), interval_rows(r, 180, key)
    left += [(500, "a", 10.0, 20.0), (500, "a", 10.0, 20.0), (501, "a", 20.0, 20.0)]
    right += [(600, "a", 20.0, 20.0), (601, "a", 0.0, 10.0)]
    l = spark.createDataFrame(left, "i long, k string, s double, e double")
    q = spark.createDataFrame(right, "j long, k string, rs double, re double")
    want = sorted((i, k, s, e, j, rs, re) for i, k, s, e in left for j, k2, rs, re in right
                  if None not in (k, k2, s, rs) and k == k2 and s <= e and rs <= re and s <= re and rs <= e)
    for bucket in (3, 50, 100_000):
        got = temporal.interval_join(l, q, ["k"], ("s", "e"), ("rs", "re"), bucket)
        assert got.columns == ["i", "k", "s", "e", "j", "rs", "re"]
        assert sorted(map(tuple, got.collect())) == want
    assert temporal.interval_join(l.where("i < 0"), q, ["k"], ("s", "e"), ("rs", "re"), 5).count() == 0
    with pytest.raises(ValueError):
        temporal.interval_join(l, l, ["k"], ("s", "e"), ("s", "e"), 5)


def test_interval_join_of_times_and_plan(spark):
    l = spark.createDataFrame([(1, at(0), at(5)), (2, at(3), at(3)), (3, at(9), at(900))], "i long, s timestamp, e timestamp")
    q = spark.createDataFrame([(7, at(5), at(9)), (8, at(3), at(4)), (9, at(-900), at(10_000))], "j long, rs timestamp, re timestamp")
    got = temporal.interval_join(l, q, [], ("s", "e"), ("rs", "re"), 3600)
    assert sorted((x["i"], x["j"]) for x in got.collect()) == [(1, 7), (1, 8), (1, 9), (2, 8), (2, 9), (3, 7), (3, 9)]
    text = plan_of(got)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_a_long_interval_is_few_buckets(spark, monkeypatch):
    """An interval a million times as long as the bucket costs a few rows per level."""
    made = []
    plain = temporal.cut
    monkeypatch.setattr(temporal, "cut", lambda df: made.append(plain(df)) or made[-1])
    l = spark.createDataFrame([(1, 0.0, 1_000_000.0)], "i long, s double, e double")
    q = spark.createDataFrame([(k, float(k), float(k)) for k in range(50)], "j long, rs double, re double")
    assert temporal.interval_join(l, q, [], ("s", "e"), ("rs", "re"), 1).count() == 50
    assert sum(df.count() for df in made) < 4 * 51


def sessions_by_hand(rows, gap, longest=None):
    out, groups = [], {}
    for k, t, v in rows:
        if t is not None:
            slot = None if longest is None else (t - datetime(1970, 1, 1)) // timedelta(seconds=longest)
            groups.setdefault((k, slot), []).append((t, v))
    for (k, _), found in groups.items():
        found.sort()
        runs = [[found[0]]]
        for x in found[1:]:
            if x[0] - runs[-1][-1][0] > timedelta(seconds=gap):
                runs.append([])
            runs[-1].append(x)
        out += [(k, run[0][0], run[-1][0], len(run), sum(v for _, v in run)) for run in runs]
    return sorted(out, key=repr)


@pytest.mark.parametrize("longest", [None, 86_400])
def test_sessions(spark, longest):
    r = random.Random(5)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None]), at(r.choice([None, *range(0, 400)])), r.randint(0, 9)) for _ in range(500)]
    rows += [("gap", at(0), 1), ("gap", at(2), 1), ("gap", at(4.001), 1), ("one", at(3), 2)] + [("endless", at(k), 1) for k in range(200)]
    df = spark.createDataFrame(rows, "k string, t timestamp, v long")
    got = temporal.sessions(df, ["k"], "t", 7200, {"total": F.sum("v")}, longest)
    assert got.columns == ["k", "session_start", "session_end", "n", "total"]
    assert rows_of(got) == sessions_by_hand(rows, 7200, longest)
    assert temporal.sessions(df.where("v > 99"), ["k"], "t", 60, {}).count() == 0


def test_running_sums_and_ranks(spark):
    r = random.Random(7)
    rows = [(i, r.choice([None, 5, 5, 5, *range(30)]), r.choice([None, 1, -4, 10**6])) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, k int, v long").repartition(5)
    got = {x["id"]: (x["total"], x["place"]) for x in running.running_sums(df, ["k", "id"], {"total": F.col("v"), "place": F.lit(1)}).collect()}
    total, want = 0, {}
    for place, (i, _, v) in enumerate(sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[0])), 1):
        total += v or 0
        want[i] = total, place
    assert got == want
    order = sorted({k for _, k, _ in rows}, key=lambda k: (k is not None, k or 0))
    smaller = {k: sum(order.index(x[1]) < order.index(k) for x in rows) for k in order}
    ranks = running.ranked_by(df, ["k"])
    assert {x["id"]: (x["rank"], x["dense_rank"]) for x in ranks.collect()} == {i: (smaller[k] + 1, order.index(k) + 1) for i, k, _ in rows}
    peers = running.running_peers(df, ["k"], {"upto": F.lit(1)})
    assert {x["id"]: x["upto"] for x in peers.collect()} == {i: sum(order.index(x[1]) <= order.index(k) for x in rows) for i, k, _ in rows}
    for x in (ranks, peers, running.running_sums(df, ["k"], {"s": F.col("v")})):
        assert "SinglePartition" not in plan_of(x)
    assert running.running_sums(df.where("id < 0"), ["k"], {"s": F.col("v")}).count() == 0 and running.ranked_by(df.where("id < 0"), ["k"]).count() == 0


def test_running_sums_split_equal_keys(spark):
    """Ties on one key: distinct keys are ordered, so the hot key is one row."""
    df = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 7, id) as k")
    got = running.ranked_by(df, ["k"]).where("k = 7").select("rank", "dense_rank").distinct().collect()
    assert [tuple(x) for x in got] == [(1 + len([i for i in range(7) if i % 3]), 1 + len([i for i in range(7) if i % 3]))]
