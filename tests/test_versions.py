"""Versions: multiset difference, the cube that changed files correct, sketches, streamed windows."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pizarra.operators import indicators as ind
from pizarra.operators import sketches, versions
from pizarra.operators.decode import decode_all
from pizarra.plans import cube_store
from pizarra.plans.versions import CSV_CATALOGUE
from pizarra.sources import files
from pizarra.sources.fixture import enrolments
from pizarra.streaming import windows as win


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- multiset difference


def diff_rows():
    r = random.Random(3)
    pool = [(r.choice([None, 1, 2]), r.choice([None, "a", "b", ""]), r.choice([None, 0.5, float("nan")])) for _ in range(40)]
    old = r.choices(pool, k=300) + [(9, "same", 1.0)] * 50
    new = r.choices(pool, k=280) + [(9, "same", 1.0)] * 50 + [(None, None, None)] * 3 + [(8, "new", 0.0)]
    return old, new


def diff_by_hand(old, new):
    a, b = Counter(map(repr, old)), Counter(map(repr, new))
    return {k: (a[k], b[k]) for k in a | b if a[k] != b[k]}


@pytest.mark.parametrize("hashing", ["full", "colliding"])
def test_multiset_diff(spark, hashing):
    old, new = diff_rows()
    schema = "i int, s string, d double"
    a, b = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    # first hashes that collide are told apart by the second one
    hash_ = versions._row_hash if hashing == "full" else lambda df, salt: F.lit(1).cast("long") if salt == 1 else versions._row_hash(df, 2)
    got = versions.multiset_diff(a, b.select("d", "i", "s"), hash_)
    assert got.columns == ["i", "s", "d", "n_old", "n_new", "change"]
    rows = got.collect()
    assert {repr(tuple(r)[:3]): (r["n_old"], r["n_new"]) for r in rows} == diff_by_hand(old, new)
    assert all(r["change"] == ("added" if not r["n_old"] else "removed" if not r["n_new"] else "changed") for r in rows)
    more = b.exceptAll(a).count()
    assert sum(max(r["n_new"] - r["n_old"], 0) for r in rows) == more
    assert sum(max(r["n_old"] - r["n_new"], 0) for r in rows) == a.exceptAll(b).count()
    totals = versions.diff_summary(got, ["i"]).agg(F.sum("added"), F.sum("removed")).first()
    assert totals[0] == more


def test_multiset_diff_edges(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    assert versions.multiset_diff(a, a).count() == 0
    assert versions.multiset_diff(a.where("i > 5"), a.where("i > 5")).count() == 0
    assert rows_of(versions.multiset_diff(a.where("i > 5"), a)) == [(1, "x", 0, 1, "added")]
    with pytest.raises(ValueError):
        versions.multiset_diff(a, a.select("i"))
    with pytest.raises(ValueError):
        versions.multiset_diff(a.withColumn("m", F.create_map("s", "i")), a.withColumn("m", F.create_map("s", "i")))


# --- cube store


def test_cube_store(spark, sf_small, tmp_path):
    raw = enrolments(spark, sf_small)
    first = files.export_departments(raw, str(tmp_path / "one"))
    changed = raw.where("departamento_f in (2, 5) and (departamento_f = 2 or sexo = 1)")
    second = files.export_departments(changed, str(tmp_path / "two"))
    store = str(tmp_path / "store")
    fresh = lambda df: rows_of(ind.outcome_cube(decode_all(df)))
    most = [k for k in CSV_CATALOGUE if k != 2]

    with pytest.raises(FileNotFoundError):
        cube_store.cube(spark, store)
    assert cube_store.apply(spark, store, "b1", first, catalogue=CSV_CATALOGUE, only=most) == 1
    assert rows_of(cube_store.cube(spark, store)) == fresh(raw.where("departamento_f <> 2"))
    # one file new, one replaced, one deleted
    assert cube_store.apply(spark, store, "b2", second, deleted=[7], catalogue=CSV_CATALOGUE, only=[2, 5]) == 2
    want = fresh(raw.where("departamento_f <> 7 and (departamento_f <> 5 or sexo = 1)"))
    assert rows_of(cube_store.cube(spark, store)) == want
    # a replay, also of an older batch, changes nothing
    for batch in ("b2", "b1"):
        assert cube_store.apply(spark, store, batch, first, catalogue=CSV_CATALOGUE, only=[5]) == 2
    assert rows_of(cube_store.cube(spark, store)) == want and len(cube_store._commits(spark, store)) == 2
    assert rows_of(cube_store.cube(spark, store, 1)) == fresh(raw.where("departamento_f <> 2"))
    with pytest.raises(ValueError):
        cube_store.apply(spark, store, "b3", deleted=[7], catalogue=CSV_CATALOGUE)
    # what an interrupted commit left is never read
    cube_store.cube(spark, store).limit(3).write.parquet(f"{store}/cube/000000000003-left")
    cube_store.cube(spark, store).limit(3).withColumn("file", F.lit("x")).write.parquet(f"{store}/parts/000000000003-left")
    assert rows_of(cube_store.cube(spark, store)) == want
    # a file that comes back as it was, and one whose rows have all gone
    none = files.export_departments(raw.where("departamento_f = 7"), str(tmp_path / "three"))
    assert cube_store.apply(spark, store, "b3", none, catalogue=CSV_CATALOGUE, only=[7]) == 3
    assert rows_of(cube_store.cube(spark, store)) == fresh(raw.where("departamento_f <> 5 or sexo = 1"))
    gone = list(cube_store.latest(spark, store)["files"])
    assert cube_store.apply(spark, store, "b4", deleted=[k for k, v in CSV_CATALOGUE.items() if files.stem_of(v) in gone], catalogue=CSV_CATALOGUE) == 4
    assert cube_store.cube(spark, store).count() == 0 and cube_store.latest(spark, store)["files"] == {}


# --- sketches


def test_sketches(spark):
    df = spark.range(60_000).selectExpr("id % 5 as g", "id % 7 as h", "if(id % 11 = 0, null, id % 20000) as v")
    cube = sketches.sketch_cube(df, ["g", "h"], {"v": F.col("v")})
    rolled = sketches.estimates(sketches.roll_up(cube, ["g"], ["v"]), ["v"]).collect()
    exact = {r["g"]: (r["n"], r["d"]) for r in df.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("v").alias("d")).collect()}
    for r in rolled:
        n, distinct = exact[r["g"]]
        assert r["n"] == n and abs(r["v"] - distinct) <= sketches.error_bound() * distinct
    # step by step or at once: the same registers, so the same estimate
    one = F.hll_sketch_estimate(F.hll_union("v", "v")).alias("v")
    twice = sketches.roll_up(sketches.roll_up(cube, ["h"], ["v"]), [], ["v"]).select(one).first()[0]
    direct = sketches.sketch_cube(df, [], {"v": F.col("v")}).select(one).first()[0]
    assert twice == direct and abs(direct - 20_000) <= sketches.error_bound() * 20_000
    small = sketches.estimates(sketches.sketch_cube(df.where("v < 50"), [], {"v": F.col("v")}), ["v"]).first()["v"]
    assert small == 50
    assert sketches.error_bound(14) == pytest.approx(sketches.error_bound(12) / 2)
    assert sketches.sketch_cube(df.where("g > 9"), ["g"], {"v": F.col("v")}).count() == 0


# --- streamed windows

EVENTS = T.StructType([T.StructField("k", T.StringType()), T.StructField("t", T.TimestampType()), T.StructField("v", T.LongType())])
T0 = datetime(2024, 3, 1)


def streamed(spark, landings, tmp_path, make):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, rows in enumerate(landings):
        spark.createDataFrame([(a, None if h is None else T0 + timedelta(hours=h), v) for a, h, v in rows], EVENTS).write.parquet(f"{folder}/{k}")
        win.start_windows(make(win.landed(spark, folder, EVENTS)), out).awaitTermination()
    return spark.read.parquet(out)


@pytest.mark.parametrize("slide,delay,late", [(None, "2 hours", False), ("1 hour", "2 hours", False), (None, "30 hours", True)])
def test_late_rows_and_open_windows(spark, tmp_path, slide, delay, late):
    """A late row counts if the mark has not passed its window; open windows are not written."""
    landings = [[("a", 0.5, 1), ("b", 1.0, 1), (None, 1.2, 1), ("a", 10.0, 1), ("a", None, 9)], [("a", 0.6, 100), ("a", 9.5, 1), ("b", 40.0, 1)], [("a", 90.0, 1)]]
    sums = {"total": F.sum("v")}
    got = streamed(spark, landings, tmp_path, lambda df: win.windowed(df, "t", ["k"], sums, "2 hours", slide, delay))
    flat = [x for rows in landings for x in rows]
    kept = [x for x in flat if late or x[2] != 100]
    batch = spark.createDataFrame([(a, None if h is None else T0 + timedelta(hours=h), v) for a, h, v in kept], EVENTS)
    whole = win.windowed(batch, "t", ["k"], sums, "2 hours", slide)
    mark = F.lit(T0 + timedelta(hours=90)) - F.expr(f"INTERVAL {delay}")
    assert rows_of(got) == rows_of(win.closed(whole, "window_end", mark)) and got.count() > 0
    assert whole.count() > got.count()


def test_streamed_sessions(spark, tmp_path):
    """Sessions grow over landings; an endless one is cut at the slots and leaves the state."""
    landings = [[("a", h / 2, 1) for h in range(40)], [("a", 20 + h / 2, 1) for h in range(40)] + [("b", 10.0, 5)], [("a", 300.0, 1)]]
    sums = {"total": F.sum("v")}
    got = streamed(spark, landings, tmp_path, lambda df: win.session_windows(df, "t", ["k"], sums, 3600, "35 hours", 86_400))
    flat = [x for rows in landings for x in rows]
    batch = spark.createDataFrame([(a, T0 + timedelta(hours=h), v) for a, h, v in flat], EVENTS)
    from pizarra.operators import temporal

    plain = win.session_windows(batch, "t", ["k"], sums, 3600, longest=86_400)
    assert rows_of(plain.drop("session_closes")) == rows_of(temporal.sessions(batch, ["k"], "t", 3600, sums, 86_400))
    mark = F.lit(T0 + timedelta(hours=300 - 35))
    assert rows_of(got) == rows_of(win.closed(plain, "session_closes", mark))
    assert [(r["n"], r["total"]) for r in got.orderBy("k", "session_start").collect()] == [(48, 48), (32, 32), (1, 5)]


def test_a_batch_keeps_every_row(spark):
    df = spark.createDataFrame([("a", T0, 1), ("a", T0 + timedelta(minutes=59), 1), ("a", T0 + timedelta(hours=1), 1), ("a", None, 1)], EVENTS)
    got = win.windowed(df, "t", ["k"], {}, "1 hour", delay="1 minute")
    assert [(r["window_start"], r["n"]) for r in got.orderBy("window_start").collect()] == [(T0, 2), (T0 + timedelta(hours=1), 1)]
    assert win.windowed(df.where("v > 5"), "t", ["k"], {}, "1 hour").count() == 0


# --- watched deliveries


def landed_rows():
    h = lambda x: T0 + timedelta(hours=x)
    rows = [("a", d, h(d), h(10)) for d in (1, 2, 3)]  # complete
    rows += [("b", 1, h(1), h(10)), ("b", 2, h(12), h(10)), ("b", 2, h(13), h(10)), ("b", 9, h(2), h(10))]  # one missing, one late
    rows += [("c", 1, h(11), h(20)), ("c", 2, h(20), h(20)), ("c", 3, h(20), h(20))]  # in time to the hour
    rows += [("d", 1, h(30), h(99)), (None, 1, h(1), h(2)), ("d", None, h(1), h(99)), ("d", 2, None, h(99)), ("z", 9, h(40), h(41))]
    return rows


def test_deliveries_batch(spark):
    from pizarra.streaming import arrivals

    df = spark.createDataFrame(landed_rows(), "delivery string, department int, at timestamp, due timestamp")
    h = lambda x: T0 + timedelta(hours=x)
    said = rows_of(arrivals.report(df, [1, 2, 3], h(50)))
    assert said == sorted([("a", "complete", None, h(3)), ("b", "missing", 2, h(10)), ("b", "missing", 3, h(10)), ("b", "late", 2, h(12)), ("c", "complete", None, h(20))], key=repr)
    assert ("d", "missing", 3, h(99)) in rows_of(arrivals.report(df, [1, 2, 3]))
    assert arrivals.report(df.where("department > 50"), [1]).count() == 0


def test_deliveries_streamed_equal_the_batch(spark, tmp_path):
    """Timers raise the alarm; replayed files and landings in any number of runs change nothing."""
    from pizarra.streaming import arrivals

    schema = "delivery string, department int, at timestamp, due timestamp"
    rows = landed_rows()
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    ends = [(-1, 5), (5, 15), (15, 60)]
    for k, (low, high) in enumerate(ends):
        part = [r for r in rows if r[2] is None or low < (r[2] - T0) / timedelta(hours=1) <= high]
        if k == 1:
            part += [("b", 1, T0 + timedelta(hours=6), T0 + timedelta(hours=10))]  # landed before: nothing new
        spark.createDataFrame(part, schema).write.parquet(f"{folder}/{k}")
        stream = win.landed(spark, folder, spark.createDataFrame([], schema).schema)
        arrivals.start_watch(spark, stream, out, [1, 2, 3], "0 seconds").awaitTermination()
    whole = spark.createDataFrame(rows, schema)
    assert rows_of(spark.read.parquet(out)) == rows_of(arrivals.report(whole, [1, 2, 3], T0 + timedelta(hours=40)))
