"""Telemetry, fold and event-time queries over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming
from ..operators import folds, telemetry
from ..session import table

QUERIES, SQL = {}, {}
BOUNDS = (0.005, 0.025, 0.1, 0.25)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _requests(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, d, "events")
    return e.select("event_id", "ts", "user_id", telemetry.method_of(F.when(k % 2 == 0, "get").otherwise("brew")).alias("method"), telemetry.route_of(F.concat(F.lit("/"), "event_type")).alias("route"), (100 + 6 * k).alias("status"), telemetry.duration_of(F.col("value") / 1000).alias("duration"), "value")


_REQ = """r AS (SELECT event_id, ts, user_id, CASE WHEN k % 2 = 0 THEN 'GET' ELSE 'OTHER' END AS method, '/' || event_type AS route, 100 + 6 * k AS status, CASE WHEN value < 0 THEN 0.0 ELSE value / 1000 END AS duration, value
  FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events))"""
_HIST = f"""{_REQ}, h AS (SELECT method, route, count(*) AS requests, round(sum(duration), 6) AS duration_sum, max(duration) AS duration_max, {", ".join(f"count(*) FILTER (duration <= {b}) AS b{i}" for i, b in enumerate(BOUNDS))} FROM r GROUP BY method, route)"""


@query(f"WITH {_HIST} SELECT method, route, requests, duration_sum, duration_max, concat_ws(',', {', '.join(f'b{i}' for i in range(len(BOUNDS)))}) AS buckets FROM h")
def route_histogram(spark, d):
    h = telemetry.histogram(_requests(spark, d), ["method", "route"], bounds=BOUNDS)
    return h.select("method", "route", "requests", "duration_sum", "duration_max", F.array_join(F.transform("buckets", lambda b: b.cast("string")), ",").alias("buckets"))


@query(f"WITH {_REQ} SELECT route, CASE WHEN status BETWEEN 100 AND 599 THEN (status // 100) || 'xx' ELSE 'other' END AS status_class, count(*) AS n FROM r GROUP BY ALL")
def status_classes(spark, d):
    return _requests(spark, d).groupBy("route", telemetry.status_class(F.col("status")).alias("status_class")).agg(F.count(F.lit(1)).alias("n"))


_SUMMARY = f"""{_REQ}, s AS (SELECT route AS scenario, count(*) AS n, count(*) FILTER (status >= 500) AS errors, min(value) FILTER (status < 500) AS min_ms, round(avg(value) FILTER (status < 500), 6) AS mean_ms,
  quantile_disc(value, 0.5) FILTER (status < 500) AS p50_ms, quantile_disc(value, 0.95) FILTER (status < 500) AS p95_ms, max(value) FILTER (status < 500) AS max_ms FROM r GROUP BY route)"""


def _summary(spark, d):
    s = _requests(spark, d).select(F.col("route").alias("scenario"), F.col("value").alias("duration_ms"), (F.col("status") < 500).alias("succeeded"))
    return telemetry.scenario_summary(s)


@query(f"WITH {_SUMMARY} SELECT *, round(errors / n, 6) AS error_rate FROM s")
def nearest_rank_percentiles(spark, d):
    return _summary(spark, d)


@query(f"WITH {_SUMMARY} SELECT scenario, p95_ms, CAST(row_number() OVER (ORDER BY p95_ms DESC, scenario) AS INTEGER) AS rank, CASE WHEN max(p95_ms) OVER () > 0 THEN round(p95_ms / max(p95_ms) OVER (), 6) ELSE 0.0 END AS share FROM s")
def bottleneck_rank(spark, d):
    return telemetry.bottlenecks(_summary(spark, d))


@query("""WITH i AS (SELECT ts AS a, ts + to_microseconds(CAST(round(greatest(value, 0) * 1000000) AS BIGINT)) AS b FROM events),
s AS (SELECT t, sum(x) AS x FROM (SELECT a AS t, 1 AS x FROM i UNION ALL SELECT b, -1 FROM i) GROUP BY t)
SELECT CAST(max(run) AS BIGINT) AS peak FROM (SELECT sum(x) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM s)""")
def peak_in_flight(spark, d):
    us = F.round(F.greatest(F.col("value"), F.lit(0.0)) * 1_000_000).cast("bigint")
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("a"), us.alias("us"))
    i = e.select("a", F.timestamp_micros(F.unix_micros("a") + F.col("us")).alias("b"))
    return telemetry.peak_in_flight(i, "a", "b").select(F.col("peak").cast("bigint").alias("peak"))


@query("""WITH c AS (SELECT event_type AS scenario, user_id AS request_key, value > 50 AS upstream FROM events)
SELECT scenario, count(*) AS requests, count(DISTINCT request_key) AS unique_keys, count(*) FILTER (upstream) AS upstream_calls,
  round(count(*) FILTER (upstream) / count(*), 6) AS upstream_ratio, round(count(*) FILTER (upstream) / count(DISTINCT request_key), 6) AS amplification FROM c GROUP BY scenario""")
def load_amplification(spark, d):
    c = table(spark, d, "events").select(F.col("event_type").alias("scenario"), F.col("user_id").alias("request_key"), (F.col("value") > 50).alias("upstream"))
    return telemetry.load_summary(c, ["scenario"])


@query(f"""WITH {_REQ}, k AS (SELECT method, route, row_number() OVER (ORDER BY min(ts), method, route) AS n FROM r GROUP BY method, route)
SELECT r.method, CASE WHEN n <= 3 THEN r.route ELSE '__overflow__' END AS route, count(*) AS requests FROM r JOIN k USING (method, route) GROUP BY 1, 2""")
def route_overflow(spark, d):
    return telemetry.admit(_requests(spark, d), 3).groupBy("method", "route").agg(F.count(F.lit(1)).alias("requests"))


#: A number in plain form with up to twelve decimals.
_PLAIN = "regexp_replace(printf('%.12f', duration_sum), '\\.?0+$', '')"


@query(
    f"WITH {_HIST} "
    + " UNION ALL ".join(
        [f"""SELECT method, route, {i} AS position, 'app_http_request_duration_seconds_bucket{{method="' || method || '",route="' || route || '",le="{b:g}"}} ' || b{i} AS line FROM h""" for i, b in enumerate(BOUNDS)]
        + [f"""SELECT method, route, {len(BOUNDS)}, 'app_http_request_duration_seconds_bucket{{method="' || method || '",route="' || route || '",le="+Inf"}} ' || requests FROM h"""]
        + [f"""SELECT method, route, {len(BOUNDS) + 1}, 'app_http_request_duration_seconds_sum{{method="' || method || '",route="' || route || '"}} ' || {_PLAIN} FROM h"""]
        + [f"""SELECT method, route, {len(BOUNDS) + 2}, 'app_http_request_duration_seconds_count{{method="' || method || '",route="' || route || '"}} ' || requests FROM h"""]
    )
)
def prometheus_lines(spark, d):
    return telemetry.exposition(telemetry.histogram(_requests(spark, d), ["method", "route"], bounds=BOUNDS), "app", BOUNDS)


def _page_sql() -> str:
    rows = []

    def head(block: int, series: tuple[str, str, str], n: int) -> None:
        for i, line in enumerate((f"# HELP app_{series[0]} {series[2]}", f"# TYPE app_{series[0]} {series[1]}")):
            rows.append(f"SELECT {block} AS block, {n} AS series, '!{i}' AS item, '{line}' AS line")

    def one(block: int, series: tuple[str, str, str], n: int, value: str, source: str, labels: str = "''") -> None:
        head(block, series, n)
        rows.append(f"SELECT {block}, {n}, 'a', 'app_{series[0]}' || {labels} || ' ' || {value} FROM {source}")

    http, provider, guard = telemetry.HTTP_SERIES, telemetry.PROVIDER_SERIES, telemetry.GUARD_SERIES
    for n, c in enumerate(("0", "(SELECT count(DISTINCT user_id) FROM r)", "(SELECT count(*) FROM r WHERE method = 'OTHER')", "0")):
        one(0, http[n], n, c, "(SELECT 1)")
    head(0, http[4], 4)
    rows.append("""SELECT 0, 4, 'a' || method || chr(1) || route || chr(1) || class, 'app_http_requests_total{method="' || method || '",route="' || route || '",status_class="' || class || '"} ' || n FROM c""")
    head(0, http[5], 5)
    name = 'app_http_request_duration_seconds'
    label = """'{method="' || method || '",route="' || route || '\"'"""
    for i, b in enumerate(BOUNDS):
        rows.append(f"""SELECT 0, 5, 'a' || method || chr(1) || route || chr(1) || '{i:04d}', '{name}_bucket' || {label} || ',le="{b:g}"}} ' || b{i} FROM h""")
    for i, (suffix, extra, value) in enumerate((("_bucket", ',le="+Inf"', "requests"), ("_sum", "", _PLAIN), ("_count", "", "requests")), len(BOUNDS)):
        rows.append(f"""SELECT 0, 5, 'a' || method || chr(1) || route || chr(1) || '{i:04d}', '{name}{suffix}' || {label} || '{extra}}} ' || {value} FROM h""")
    one(1, provider[0], 0, "1", "(SELECT 1)")
    one(1, provider[1], 1, "1", "(SELECT 1)")
    one(1, provider[2], 2, "1", "(SELECT 1)", "'{state=\"available\"}'")
    for n, c in enumerate(("0", "0", "4", "16"), 3):
        one(1, provider[n], n, c, "(SELECT 1)")
    head(1, provider[7], 7)
    for event in telemetry.LIMITER_EVENTS:
        count = {"received": "count(*)", "accepted": "count(*) FILTER (value <= 100)", "rejected": "count(*) FILTER (value > 100)"}.get(event, "0")
        rows.append(f"""SELECT 1, 7, 'a{event}', 'app_{provider[7][0]}{{event="{event}"}} ' || {count} FROM {'(SELECT 1)' if count == '0' else 'events'}""")
    one(2, guard[0], 0, "1", "(SELECT 1)")
    for n, (part, whole) in enumerate((("blocked", "value > 50"), ("quarantined", "value < 5")), 1):
        head(2, guard[n], n)
        for outcome, where in (("allowed", f"NOT ({whole})"), (part, whole)):
            rows.append(f"""SELECT 2, {n}, 'a{outcome}', 'app_{guard[n][0]}{{outcome="{outcome}"}} ' || count(*) FILTER ({where}) FROM events""")
    one(2, guard[3], 3, "count(*) FILTER (value > 50)", "events")
    status = "CASE WHEN status BETWEEN 100 AND 599 THEN (status // 100) || 'xx' ELSE 'other' END"
    return f"WITH {_HIST}, c AS (SELECT method, route, {status} AS class, count(*) AS n FROM r GROUP BY ALL) " + " UNION ALL ".join(rows)


@query(_page_sql())
def prometheus_page(spark, d):
    """The whole exposition, with figures of the events for limiter and guard."""
    r, e = _requests(spark, d), table(spark, d, "events")
    http = r.agg(F.lit(0).alias("in_flight"), F.countDistinct("user_id").alias("peak"), F.count_if(F.col("method") == "OTHER").alias("overflow"), F.lit(0).alias("errors"))
    statuses = r.groupBy("method", "route", telemetry.status_class(F.col("status")).alias("status_class")).agg(F.count(F.lit(1)).alias("n"))
    busy = F.col("value") > 100
    counts = {"received": F.count(F.lit(1)), "accepted": F.count_if(~busy), "rejected": F.count_if(busy)}
    provider = e.agg(F.lit(True).alias("enabled"), F.lit("available").alias("state"), *[F.lit(n).alias(c) for c, n in (("in_flight", 0), ("queued", 0), ("max_concurrency", 4), ("max_queue", 16))], *[counts.get(x, F.lit(0)).alias(x) for x in telemetry.LIMITER_EVENTS])
    guard = e.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("value") > 50).alias("blocked"), F.count(F.lit(1)).alias("evidence"), F.count_if(F.col("value") < 5).alias("quarantined"), F.count_if(F.col("value") > 50).alias("avoided"))
    return telemetry.metrics_page("app", http, statuses, telemetry.histogram(r, ["method", "route"], bounds=BOUNDS), provider, guard, BOUNDS)


@query("""WITH p AS (SELECT event_type AS file, user_id % 7 AS line, event_type || '_' || (user_id % 7) AS function, value FROM events)
SELECT file, line, function, count(*) AS calls, count(*) FILTER (value > 10) AS primitive_calls, CAST(round(sum(CAST(value AS DECIMAL(18, 4))), 4) AS DOUBLE) AS total_seconds FROM p GROUP BY ALL ORDER BY total_seconds DESC, file, line LIMIT 10""")
def profile_hot_spots(spark, d):
    value = F.col("value").cast("decimal(18,4)")
    p = table(spark, d, "events").select(F.col("event_type").alias("file"), (F.col("user_id") % 7).alias("line"), F.concat_ws("_", "event_type", (F.col("user_id") % 7).cast("string")).alias("function"), F.lit(1).alias("calls"), (F.col("value") > 10).cast("int").alias("primitive_calls"), F.lit(0).cast("decimal(18,4)").alias("own_seconds"), value.alias("total_seconds"))
    r = telemetry.profile_report(p, 10)
    return r.select("file", "line", "function", "calls", "primitive_calls", F.col("total_seconds").cast("double").alias("total_seconds"))


@query("""SELECT event_type AS tool, count(*) AS n, bool_or(value > 100) AS any_failed, bool_or(value > 100 AND props->>'$.k' > '5') AS any_recovered FROM events GROUP BY 1""")
def resilience_summary(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("tool"), (F.col("value") > 100).alias("failed"), ((F.col("value") > 100) & (F.get_json_object("props", "$.k") > "5")).alias("recovered"))
    n = e.groupBy("tool").agg(F.count(F.lit(1)).alias("n"))
    return n.join(telemetry.resilience(e, ["tool"]), "tool")


# --- folds: a recursive query jumps from one change of state to the next --------------------------

_TTL = 3600
_CALLS = """c AS (SELECT event_id, user_id, epoch_us(ts) AS us, value > 200 AS bypass, value < 2 AS lost, event_id % 23 = 5 AS broken FROM events),
asked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM c WHERE NOT bypass AND NOT broken)"""


@query(f"""WITH RECURSIVE {_CALLS}, miss AS (
  SELECT user_id, n, us, lost FROM asked WHERE n = 1
  UNION ALL
  SELECT * FROM (SELECT m.user_id, min(a.n) AS n, arg_min(a.us, a.n) AS us, arg_min(a.lost, a.n) AS lost FROM miss m JOIN asked a ON a.user_id = m.user_id AND a.n > m.n AND (m.lost OR a.us >= m.us + {_TTL}000000) GROUP BY m.user_id, m.n))
SELECT c.user_id, c.event_id, CASE WHEN c.bypass THEN 'bypass' WHEN c.broken THEN 'error' WHEN miss.n IS NOT NULL THEN 'miss' ELSE 'hit' END AS outcome
FROM c LEFT JOIN asked USING (event_id) LEFT JOIN miss ON miss.user_id = asked.user_id AND miss.n = asked.n""")
def ttl_cache_outcomes(spark, d):
    v = F.col("value")
    return folds.ttl_cache(table(spark, d, "events"), float(_TTL), key="user_id", bypass=v > 200, write_error=v < 2, read_error=F.col("event_id") % 23 == 5)


_FLIGHTS = """f AS (SELECT event_id, user_id, epoch_us(ts) AS us, epoch_us(ts) + CAST(floor(greatest(value, 0) * 60 * 1000000) AS BIGINT) AS until,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"""


@query(f"""WITH RECURSIVE {_FLIGHTS}, leader AS (
  SELECT user_id, n, until FROM f WHERE n = 1
  UNION ALL
  SELECT * FROM (SELECT l.user_id, min(f.n) AS n, arg_min(f.until, f.n) AS until FROM leader l JOIN f ON f.user_id = l.user_id AND f.n > l.n AND f.us >= l.until GROUP BY l.user_id, l.n))
SELECT f.user_id, event_id, CASE WHEN leader.n IS NOT NULL THEN 'leader' ELSE 'follower' END AS role FROM f LEFT JOIN leader ON leader.user_id = f.user_id AND leader.n = f.n""")
def single_flight_roles(spark, d):
    e = table(spark, d, "events").withColumn("seconds", F.greatest(F.col("value"), F.lit(0.0)) * 60)
    return folds.single_flight(e, key="user_id", start="ts", seconds="seconds")


_PROCESS = """f AS (SELECT event_id, user_id AS key, event_type AS process, epoch_us(ts) AS us, epoch_us(ts) + CAST(floor(greatest(value, 0) * 600 * 1000000) AS BIGINT) AS until,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events)"""


@query(f"""WITH RECURSIVE {_PROCESS}, step AS (
  SELECT process, n, event_id, key, 'leader' AS role, CASE WHEN until > us THEN [{{'key': key, 'until': until}}] ELSE [] END AS open FROM f WHERE n = 1
  UNION ALL
  SELECT f.process, f.n, f.event_id, f.key, x.role, CASE WHEN x.role = 'leader' THEN list_append(x.live, {{'key': f.key, 'until': f.until}}) ELSE x.live END
  FROM step s JOIN f ON f.process = s.process AND f.n = s.n + 1,
    LATERAL (SELECT list_filter(s.open, lambda o: o.until > f.us) AS live) w,
    LATERAL (SELECT live, CASE WHEN len(list_filter(live, lambda o: o.key = f.key)) > 0 THEN 'follower' WHEN len(live) >= 3 THEN 'overflow' ELSE 'leader' END AS role) x)
SELECT key AS user_id, event_id, role FROM step""")
def single_flight_overflow(spark, d):
    """Processes with at most three keys in flight."""
    e = table(spark, d, "events").withColumn("seconds", F.greatest(F.col("value"), F.lit(0.0)) * 600)
    return folds.single_flight(e, key="user_id", start="ts", seconds="seconds", process="event_type", max_keys=3)


@query(None)
def fifo_limiter(spark, d):
    e = table(spark, d, "events").withColumn("seconds", F.greatest(F.col("value"), F.lit(0.0)))
    return folds.fifo_limiter(e, 2, 2, 30.0, key="user_id", start="ts", seconds="seconds")


# --- event time ----------------------------------------------------------------------------------


def _naive(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    return _naive(streaming.windowed(streaming.event_time(table(spark, d, "events")), "1 hour"), "window_start", "window_end")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - o * INTERVAL 30 MINUTE AS window_start, event_type, value FROM events, (SELECT unnest([0, 1]) AS o))
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def events_sliding(spark, d):
    return _naive(streaming.windowed(streaming.event_time(table(spark, d, "events")), "1 hour", "30 minutes"), "window_start", "window_end")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, s.n""")
def events_session(spark, d):
    return _naive(streaming.sessions(streaming.event_time(table(spark, d, "events")), "6 hours"), "session_start", "session_end")


@query("SELECT DISTINCT user_id, event_type FROM events")
def events_dedup(spark, d):
    return streaming.deduplicated(table(spark, d, "events").select("user_id", "event_type"), ["user_id", "event_type"])
