"""Registered queries along time and between versions, over events, orders and
lineitem. Money is summed as decimals, so sums are exact whatever their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import running, temporal
from ..session import cut, fresh_dir
from ..sources.fixture import table
from ..streaming import arrivals as deliveries
from ..streaming import windows as win
from .registry import register

def cents() -> dict[str, Column]:
    """Summed exactly, then a double."""
    return {"total": F.sum(F.col("value").cast("decimal(18,2)")).cast("double")}


CENTS_SQL = "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


# ------------------------------------------------------------- as-of join
@register(
    "asof_events",
    "SELECT event_id, user_id, ts, view_id, view_ts FROM (SELECT l.event_id, l.user_id, l.ts, r.event_id AS view_id, r.ts AS view_ts, "
    "row_number() OVER (PARTITION BY l.event_id ORDER BY r.ts DESC NULLS LAST, r.event_id DESC) AS k "
    "FROM (SELECT * FROM events WHERE event_type = 'purchase') l LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r "
    "ON l.user_id = r.user_id AND r.ts <= l.ts) WHERE k = 1",
)
def q_asof_events(spark, sf_dir):
    """For each purchase, the user's last view before it."""
    e = events(spark, sf_dir)
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    return temporal.asof_join(bought, seen, ["user_id"], "ts", "view_ts", ["view_id", "view_ts"], ties=["view_id"])


@register(
    "asof_orders",
    "SELECT l_orderkey, l_linenumber, l_shipdate, o_custkey, last_orderkey, last_total FROM (SELECT s.*, r.o_orderkey AS last_orderkey, "
    "r.o_totalprice AS last_total, row_number() OVER (PARTITION BY s.rid ORDER BY r.o_orderdate DESC NULLS LAST, r.o_orderkey DESC) AS k "
    "FROM (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, l_shipdate, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) s "
    "LEFT JOIN orders r ON r.o_custkey = s.o_custkey AND r.o_orderdate <= s.l_shipdate AND r.o_orderdate >= s.l_shipdate - INTERVAL 90 DAY) WHERE k = 1",
)
def q_asof_orders(spark, sf_dir):
    """For each shipment, the customer's newest order of the 90 days up to it."""
    orders = table(spark, sf_dir, "orders")
    shipped = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_shipdate", "o_custkey")
    last = orders.select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("last_orderkey"), F.col("o_totalprice").alias("last_total"))
    return temporal.asof_join(shipped, last, ["o_custkey"], "l_shipdate", "o_orderdate", ["last_orderkey", "last_total"], ties=["last_orderkey"], within="90 DAYS")


# ---------------------------------------------------------- interval join
OPEN_SQL = "SELECT o_custkey, o_orderkey, o_orderdate AS opened, max(l_shipdate) AS done FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"


@register(
    "overlapping_orders",
    f"WITH i AS (SELECT * FROM ({OPEN_SQL}) WHERE done >= opened) SELECT a.o_custkey, a.o_orderkey, b.o_orderkey AS other_orderkey, "
    "greatest(a.opened, b.opened) AS both_from, least(a.done, b.done) AS both_to "
    "FROM i a JOIN i b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.opened <= b.done AND b.opened <= a.done",
)
def q_overlapping_orders(spark, sf_dir):
    """Pairs of a customer's orders that were open at one time."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    shipped = items.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("done"))
    spans = cut(shipped.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("opened"), "done"))
    other = spans.select("o_custkey", F.col("o_orderkey").alias("other_orderkey"), F.col("opened").alias("other_opened"), F.col("done").alias("other_done"))
    pairs = temporal.interval_join(spans, other, ["o_custkey"], ("opened", "done"), ("other_opened", "other_done"), bucket=30 * 86400)
    both = F.greatest("opened", "other_opened").alias("both_from"), F.least("done", "other_done").alias("both_to")
    return pairs.where("o_orderkey < other_orderkey").select("o_custkey", "o_orderkey", "other_orderkey", *both)


@register(
    "events_after_signup",
    "SELECT s.event_id AS signup_id, e.event_id, e.event_type, e.ts FROM (SELECT * FROM events WHERE event_type = 'signup') s "
    "JOIN (SELECT * FROM events WHERE event_type <> 'signup') e ON s.user_id = e.user_id AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 12 HOUR",
)
def q_events_after_signup(spark, sf_dir):
    """Events in the twelve hours after each signup of the user (points in intervals)."""
    e = events(spark, sf_dir)
    starts = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"), F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("until"))
    points = e.where("event_type <> 'signup'").select("user_id", "event_id", "event_type", "ts")
    return temporal.interval_join(starts, points, ["user_id"], ("s", "until"), ("ts", "ts"), bucket=12 * 3600).select("signup_id", "event_id", "event_type", "ts")


# --------------------------------------------------- windows and sessions
@register(
    "event_windows",
    f"SELECT event_type, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n, {CENTS_SQL} AS total "
    "FROM events WHERE ts IS NOT NULL GROUP BY ALL",
)
def q_event_windows(spark, sf_dir):
    return win.windowed(events(spark, sf_dir), "ts", ["event_type"], cents(), "1 hour")


SLIDING_SQL = (
    "SELECT event_type, w AS window_start, w + INTERVAL 6 HOUR AS window_end, count(*) AS n, {total} AS total FROM "
    "(SELECT *, unnest([time_bucket(INTERVAL 2 HOUR, ts), time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 2 HOUR, time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 4 HOUR]) AS w "
    "FROM {rows} WHERE ts IS NOT NULL) GROUP BY ALL"
)


@register("event_windows_sliding", SLIDING_SQL.format(total=CENTS_SQL, rows="events"))
def q_event_windows_sliding(spark, sf_dir):
    return win.windowed(events(spark, sf_dir), "ts", ["event_type"], cents(), "6 hours", "2 hours")


#: Rows arrive in this many landings, ordered by id; each 40th comes ``LATE`` landings late.
LANDINGS, LATE = 3, 1
ARRIVAL_SQL = (
    f"SELECT *, least(least(event_id * {LANDINGS} // (SELECT max(event_id) + 1 FROM events), {LANDINGS - 1}) "
    f"+ CASE WHEN event_id % 40 = 0 THEN {LATE} ELSE 0 END, {LANDINGS - 1}) AS landing FROM events"
)
#: Per landing, the watermark that the rows of it meet, and the last one.
MARKS_SQL = (
    "SELECT landing, date_trunc('milliseconds', max(max(ts)) OVER (ORDER BY landing ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) - INTERVAL 6 HOUR AS mark, "
    "date_trunc('milliseconds', max(max(ts)) OVER ()) - INTERVAL 6 HOUR AS last_mark FROM a GROUP BY landing"
)


def arrivals(spark: SparkSession, sf_dir: str):
    """The events in the landings they arrive in, written as files one landing at a
    time; ``run`` is called after each."""
    e = cut(events(spark, sf_dir))
    n = e.agg(F.max("event_id") + 1).first()[0] or 1
    due = F.least(F.floor(F.col("event_id") * LANDINGS / n), F.lit(LANDINGS - 1)) + F.when(F.col("event_id") % 40 == 0, LATE).otherwise(0)
    e = e.withColumn("landing", F.least(due, F.lit(LANDINGS - 1)))
    folder = fresh_dir(spark, "events")
    for k in range(LANDINGS):
        e.where(F.col("landing") == k).drop("landing").write.parquet(f"{folder}/landing-{k}")
        yield folder, e.drop("landing").schema


def streamed(spark: SparkSession, sf_dir: str, result) -> DataFrame:
    """A stream over the landings, run after each of them as a scheduled job would."""
    out = fresh_dir(spark, "windows")
    for folder, schema in arrivals(spark, sf_dir):
        win.start_windows(result(win.landed(spark, folder, schema)), out).awaitTermination()
    return spark.read.parquet(out)


@register(
    "stream_windows",
    f"WITH a AS ({ARRIVAL_SQL}), m AS ({MARKS_SQL}), w AS (SELECT event_type, date_trunc('hour', ts) AS window_start, "
    "date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, value, mark, last_mark FROM a JOIN m USING (landing)) "
    f"SELECT event_type, window_start, window_end, count(*) AS n, {CENTS_SQL} AS total FROM w "
    "WHERE (mark IS NULL OR window_end > mark) AND window_end <= last_mark GROUP BY event_type, window_start, window_end",
)
def q_stream_windows(spark, sf_dir):
    """Hourly windows of the stream: late rows dropped by the watermark, windows that
    are still open at its end not yet written."""
    return streamed(spark, sf_dir, lambda df: win.windowed(df, "ts", ["event_type"], cents(), "1 hour", delay="6 hours"))


GAP_HOURS, SLOT_DAYS = 8, 7
SESSIONS_SQL = (
    f"SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n, {CENTS_SQL} AS total FROM (SELECT *, "
    "sum(begins) OVER (PARTITION BY user_id, slot ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, "
    f"CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, slot ORDER BY ts, event_id) <= INTERVAL {GAP_HOURS} HOUR THEN 0 ELSE 1 END AS begins "
    f"FROM (SELECT *, epoch_us(ts) // ({SLOT_DAYS} * 86400000000) AS slot FROM events WHERE ts IS NOT NULL))) GROUP BY user_id, slot, s"
)


@register("sessions", SESSIONS_SQL)
def q_sessions(spark, sf_dir):
    return temporal.sessions(events(spark, sf_dir), ["user_id"], "ts", GAP_HOURS * 3600, cents(), longest=SLOT_DAYS * 86400)


@register(
    "stream_sessions",
    f"SELECT * FROM ({SESSIONS_SQL}) WHERE session_end + INTERVAL {GAP_HOURS} HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 11 DAY FROM events)",
)
def q_stream_sessions(spark, sf_dir):
    """Sessions of the stream that its watermark has closed; the delay covers the
    rows that come late, so none is dropped."""
    make = lambda df: win.session_windows(df, "ts", ["user_id"], cents(), GAP_HOURS * 3600, "11 days", SLOT_DAYS * 86400)
    return streamed(spark, sf_dir, make).drop("session_closes")


# --------------------------------------------------------- running totals
@register(
    "running_total",
    "SELECT event_id, ts, value, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (ORDER BY ts NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total, "
    "count(*) OVER (ORDER BY ts NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING) AS place FROM events",
)
def q_running_total(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "ts", "value")
    out = running.running_sums(e, ["ts", "event_id"], {"total": F.col("value").cast("decimal(18,2)"), "place": F.lit(1)})
    return out.withColumn("total", F.col("total").cast("double"))


@register("value_ranks", "SELECT event_id, value, rank() OVER (ORDER BY value NULLS FIRST) AS rank, dense_rank() OVER (ORDER BY value NULLS FIRST) AS dense_rank FROM events")
def q_value_ranks(spark, sf_dir):
    return running.ranked_by(events(spark, sf_dir).select("event_id", "value"), ["value"])


# ------------------------------------------------------ watched deliveries
DEPARTMENTS = tuple(range(1, 23))
MANIFEST_SQL = (
    "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS delivery, CAST(c_nationkey % 22 + 1 AS INT) AS department, min(l_shipdate) AS seen, "
    "date_trunc('month', min(o_orderdate)) + INTERVAL 120 DAY AS due FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
    "WHERE l_shipdate >= date_trunc('month', o_orderdate) GROUP BY 1, 2"
)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the first shipment of each department came for each month of orders."""
    orders, items, customers = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer"))
    month = F.date_trunc("month", F.col("o_orderdate"))
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).where(F.col("l_shipdate") >= month)
    grouped = rows.groupBy(F.date_format(month, "yyyy-MM").alias("delivery"), (F.col("c_nationkey") % 22 + 1).cast("int").alias("department"))
    return grouped.agg(F.min("l_shipdate").cast("timestamp").alias("at"), (F.min(month) + F.expr("INTERVAL 120 DAYS")).cast("timestamp").alias("due"))


REPORT_SQL = (
    f"WITH f AS ({MANIFEST_SQL}), d AS (SELECT delivery, min(due) AS due, count(CASE WHEN seen <= due THEN 1 END) AS n, max(CASE WHEN seen <= due THEN seen END) AS last FROM f GROUP BY delivery) "
    "SELECT delivery, 'complete' AS status, CAST(NULL AS INT) AS department, last AS \"at\" FROM d WHERE n = 22 "
    "UNION ALL SELECT d.delivery, 'missing', CAST(w.department AS INT), d.due FROM d CROSS JOIN (SELECT unnest(range(1, 23)) AS department) w "
    "LEFT JOIN f ON f.delivery = d.delivery AND f.department = w.department AND f.seen <= f.due WHERE d.n < 22 AND f.seen IS NULL{until} "
    "UNION ALL SELECT delivery, 'late', department, seen FROM f WHERE seen > due"
)


@register("delivery_report", REPORT_SQL.format(until=""))
def q_delivery_report(spark, sf_dir):
    return deliveries.report(manifest(spark, sf_dir), DEPARTMENTS).withColumn("at", F.col("at").cast("timestamp_ntz"))


@register("stream_deliveries", REPORT_SQL.format(until=" AND d.due <= (SELECT max(seen) FROM f)"))
def q_stream_deliveries(spark, sf_dir):
    """The deliveries watched while they land, in four runs of the stream."""
    rows = cut(manifest(spark, sf_dir))
    folder, out = fresh_dir(spark, "manifest"), fresh_dir(spark, "deliveries")
    marks = rows.agg(F.percentile_approx(F.unix_micros("at"), [0.25, 0.5, 0.75])).first()[0]
    ends = [-(1 << 62), *marks, 1 << 62]
    for k, (low, high) in enumerate(zip(ends, ends[1:])):
        rows.where((F.unix_micros("at") > low) & (F.unix_micros("at") <= high)).write.parquet(f"{folder}/{k}")
        deliveries.start_watch(spark, win.landed(spark, folder, rows.schema), out, DEPARTMENTS, "0 seconds").awaitTermination()
    return spark.read.parquet(out).withColumn("at", F.col("at").cast("timestamp_ntz"))
