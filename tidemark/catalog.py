"""The registered queries of the engine and, beside each, its SQL.

The driver's tables stand in for the engine's: events for metrics, incidents, quotas and sessions; conversations for
documents of cues; documents and pages for texts. Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import checks as K
from tidemark.functions import clock
from tidemark.functions import text as T
from tidemark.operators import cues as C
from tidemark.operators import incidents as I
from tidemark.operators import status as S
from tidemark.operators import terms as M

FLAGSHIP = "hourly_status"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


CODES = (1001, 1004, 2001, 2003, 3001, 5002)


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("event_id") % len(CODES) + 1).cast("int"))
    metric = F.when(F.col("event_type") == "error", F.concat(F.lit("error_"), code.cast("string"))).otherwise("job")
    return events(spark, sf_dir).select("event_id", "user_id", "ts", metric.alias("metric"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.metrics_from_events(metric_rows(spark, sf_dir))


METRIC_ROWS = "raw AS (SELECT event_id, user_id, ts, (epoch_us(ts) // 1000) AS ms, CASE WHEN event_type = 'error' THEN 'error_' || [1001, 1004, 2001, 2003, 3001, 5002][event_id % 6 + 1] ELSE 'job' END AS metric FROM events)"
METRICS = f"{METRIC_ROWS}, metrics AS (SELECT (ms // 60000)::BIGINT AS bucket_minute, metric, count(*) AS count FROM raw GROUP BY ALL)"
CATEGORY = "CASE WHEN code = 1004 THEN 'client_fault' WHEN code IN (2001, 2002) THEN 'storage_blocking' WHEN code IN (2003, 2004) THEN 'storage_degrading' WHEN code BETWEEN 1000 AND 2999 THEN 'gateway' WHEN code BETWEEN 3000 AND 5999 THEN 'upstream' END"
CODED = f"{METRICS}, coded AS (SELECT *, try_cast(nullif(regexp_extract(metric, '^error_([0-9]+)$', 1), '') AS INTEGER) AS code FROM metrics), named AS (SELECT *, {CATEGORY} AS category FROM coded)"
SINCE = 28_416_000  # 2024-01-11, in minutes
#: Two states of one counter table, for upserts.
HALVES = f"{METRICS}, old AS (SELECT metric AS k, sum(count) AS n FROM metrics WHERE bucket_minute < {SINCE} AND metric <> 'error_5002' GROUP BY 1), new AS (SELECT metric AS k, sum(count) AS n FROM metrics WHERE bucket_minute >= {SINCE} AND metric <> 'error_1001' GROUP BY 1)"


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = metrics(spark, sf_dir)
    old = m.where((F.col("bucket_minute") < SINCE) & (F.col("metric") != "error_5002"))
    new = m.where((F.col("bucket_minute") >= SINCE) & (F.col("metric") != "error_1001"))
    return tuple(x.groupBy(F.col("metric").alias("k")).agg(F.sum("count").alias("n")) for x in (old, new))


# Metric windows and counters.


@query(f"WITH {CODED} SELECT bucket_minute // 60 AS hour, coalesce(sum(count) FILTER (metric = 'job'), 0)::BIGINT AS jobs, coalesce(sum(count) FILTER (code IS NOT NULL), 0)::BIGINT AS errors, coalesce(sum(count) FILTER (category = 'client_fault'), 0)::BIGINT AS client_faults, coalesce(sum(count) FILTER (category IN ('gateway', 'storage_blocking')), 0)::BIGINT AS failures, jobs + errors - client_faults AS served, CASE WHEN served > 0 THEN round(100 * (1 - failures / served), 2) ELSE 100.0 END AS availability FROM named GROUP BY 1")
def hourly_status(spark, sf_dir):
    m = metrics(spark, sf_dir).withColumn("hour", F.floor(F.col("bucket_minute") / 60))
    return S.served_and_failed(m, ["hour"])


@query(f"WITH {METRICS} SELECT coalesce(sum(count), 0)::BIGINT AS total FROM metrics WHERE metric = 'job' AND bucket_minute >= {SINCE}")
def metric_sum_window(spark, sf_dir):
    return S.window_sum(metrics(spark, sf_dir), "job", SINCE)


@query(f"WITH {METRICS} SELECT metric, sum(count)::BIGINT AS total FROM metrics WHERE bucket_minute >= {SINCE} GROUP BY 1")
def metric_group_sum(spark, sf_dir):
    return S.sums_by_metric(metrics(spark, sf_dir), SINCE)


@query(f"WITH {METRICS} SELECT DISTINCT metric FROM metrics")
def metric_distinct(spark, sf_dir):
    return metrics(spark, sf_dir).select("metric").distinct()


@query(f"WITH {METRICS} SELECT metric, sum(count)::BIGINT AS total FROM metrics WHERE metric LIKE 'error!_%' ESCAPE '!' GROUP BY 1")
def like_escape(spark, sf_dir):
    return S.sums_by_metric(S.error_metrics(metrics(spark, sf_dir)))


@query(f"WITH {METRICS} SELECT count(*) AS n, sum(count)::BIGINT AS total FROM metrics WHERE metric NOT IN ('error_1004', 'error_2001')")
def in_list(spark, sf_dir):
    return metrics(spark, sf_dir).where(~F.col("metric").isin("error_1004", "error_2001")).agg(F.count("*").alias("n"), F.sum("count").alias("total"))


@query(f"WITH {METRICS} SELECT bucket_minute, metric, count FROM metrics WHERE bucket_minute >= {SINCE}")
def retention_delete(spark, sf_dir):
    return metrics(spark, sf_dir).where(F.col("bucket_minute") >= SINCE)


@query(f"WITH {METRICS} SELECT sum(count)::BIGINT AS total, coalesce(sum(count) FILTER (bucket_minute >= {SINCE}), 0)::BIGINT AS last_days FROM metrics")
def scalar_counters(spark, sf_dir):
    return metrics(spark, sf_dir).agg(F.sum("count").alias("total"), F.coalesce(F.sum(F.when(F.col("bucket_minute") >= SINCE, F.col("count"))), F.lit(0)).alias("last_days"))


@query(f"WITH {METRICS}, daily AS (SELECT strftime(make_timestamp(bucket_minute * 60000000), '%Y-%m-%d') AS day, sum(count) AS n FROM metrics GROUP BY 1), periods AS (SELECT unnest([day, day[:7], day[:4]]) AS period, n FROM daily) SELECT period, sum(n)::BIGINT AS total FROM periods GROUP BY 1")
def calendar_rollup(spark, sf_dir):
    return S.calendar_rollup(metrics(spark, sf_dir))


@query(f"WITH {CODED} SELECT category, sum(count)::BIGINT AS total FROM named WHERE category IS NOT NULL GROUP BY 1")
def category_counts(spark, sf_dir):
    m = metrics(spark, sf_dir).withColumn("category", S.error_category(S.error_code(F.col("metric"))))
    return m.where("category IS NOT NULL").groupBy("category").agg(F.sum("count").alias("total"))


@query(f"WITH {METRICS} SELECT coalesce(sum(count), 0)::BIGINT AS total FROM metrics WHERE metric IN ('error_5002', 'error_5003')")
def quota_error_sum(spark, sf_dir):
    code = S.error_code(F.col("metric"))
    return metrics(spark, sf_dir).where(code.isin(5002, 5003)).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))


# Failure statistics.

WILSON = "CASE WHEN f <= 0 OR t <= 0 THEN 0.0 ELSE greatest(0.0, (f / greatest(t, f) + 3.8416 / (2 * greatest(t, f)) - 1.96 * sqrt((f / greatest(t, f) * (1 - f / greatest(t, f)) + 3.8416 / (4 * greatest(t, f))) / greatest(t, f))) / (1 + 3.8416 / greatest(t, f))) END"
FAILED = f"{METRIC_ROWS}, failed AS (SELECT user_id, count(*) FILTER (metric IN ('error_1001', 'error_2001')) AS f, count(*) AS t FROM raw GROUP BY 1)"


def failures_by_user(spark, sf_dir):
    return metric_rows(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("metric").isin("error_1001", "error_2001")).alias("f"), F.count("*").alias("t"))


@query(f"WITH {FAILED} SELECT user_id, round({WILSON}, 9) AS bound FROM failed")
def wilson_bound(spark, sf_dir):
    return failures_by_user(spark, sf_dir).select("user_id", F.round(S.wilson_lower_bound(F.col("f"), F.col("t")), 9).alias("bound"))


@query(f"WITH {FAILED}, bounded AS (SELECT *, {WILSON} AS bound FROM failed) SELECT user_id, CASE WHEN f >= 5 AND bound >= 0.5 THEN 'major_outage' WHEN f >= 3 AND bound >= 0.1 THEN 'degraded_performance' ELSE 'operational' END AS status FROM bounded")
def failure_status(spark, sf_dir):
    return failures_by_user(spark, sf_dir).select("user_id", S.failure_status(F.col("f"), F.col("t")).alias("status"))


STATES = "states AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'error' THEN 'major_outage' WHEN 'click' THEN 'degraded_performance' WHEN 'view' THEN 'maintenance' ELSE 'operational' END AS status FROM events)"


def states(spark, sf_dir):
    e = events(spark, sf_dir)
    kind = F.col("event_type")
    return e.withColumn("status", F.when(kind == "error", "major_outage").when(kind == "click", "degraded_performance").when(kind == "view", "maintenance").otherwise("operational"))


@query(f"WITH {STATES} SELECT user_id, ['operational', 'maintenance', 'degraded_performance', 'partial_outage', 'major_outage'][max(list_position(['operational', 'maintenance', 'degraded_performance', 'partial_outage', 'major_outage'], status))] AS worst FROM states GROUP BY 1")
def worst_of(spark, sf_dir):
    return S.worst_of(states(spark, sf_dir), ["user_id"])


@query(f"WITH {STATES} SELECT user_id, count(*) FILTER (status = 'major_outage') AS crashed, count(*) AS suppliers, CASE WHEN crashed = suppliers THEN 'major_outage' WHEN crashed > 0 THEN 'degraded_performance' ELSE 'operational' END AS state FROM states GROUP BY 1")
def crashed_suppliers(spark, sf_dir):
    return S.crashed_suppliers(states(spark, sf_dir), ["user_id"])


@query(f"WITH {STATES} SELECT user_id, arg_max(status, (ts, -event_id)) AS status FROM states GROUP BY 1")
def latest_per_key(spark, sf_dir):
    return S.latest_per_key(states(spark, sf_dir), ["user_id"], "ts", "event_id").select("user_id", "status")


@query(f"WITH {STATES}, changed AS (SELECT user_id, event_id, status, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM states) SELECT user_id, event_id, status FROM changed WHERE last IS DISTINCT FROM status")
def update_changes(spark, sf_dir):
    u = states(spark, sf_dir).withColumn("update_id", F.col("event_id"))
    return S.update_changes(u, ["user_id"]).select("user_id", "event_id", "status")


@query(f"WITH {STATES}, n AS (SELECT user_id, status, count(*) AS n, min(event_id) AS first FROM states GROUP BY ALL) SELECT user_id, arg_max(status, (n, -first)) AS majority FROM n GROUP BY 1")
def majority_first_wins(spark, sf_dir):
    return S.majority_first_wins(states(spark, sf_dir), ["user_id"], "status", "event_id")


@query("WITH n AS (SELECT source, lang, count(*) AS votes FROM documents GROUP BY ALL), t AS (SELECT source, max(votes) AS votes, arg_max(lang, (votes, lang)) AS leader, sum(votes)::BIGINT AS total FROM n GROUP BY 1) SELECT source, leader, votes, total FROM t WHERE votes >= 0.6 * total")
def agreement_vote(spark, sf_dir):
    return S.agreement(table(spark, sf_dir, "documents"), ["source"], "lang", 0.6)


# Incidents and uptime.

SPANS = "spans AS (SELECT user_id, event_type, (epoch_us(ts) // 1000) AS a, (epoch_us(ts) // 1000) + floor(value * 60000)::BIGINT AS b FROM events)"
DAYS = f"{SPANS}, days AS (SELECT user_id, event_type, unnest(generate_series(a // 86400000, greatest(a, b) // 86400000)) AS day, a, b FROM spans), clipped AS (SELECT user_id, event_type, day, greatest(a, day * 86400000) AS a, least(b, (day + 1) * 86400000) AS b FROM days WHERE least(b, (day + 1) * 86400000) > greatest(a, day * 86400000)), marked AS (SELECT *, CASE WHEN a > coalesce(max(b) OVER (PARTITION BY user_id, day ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fresh FROM clipped), islands AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, day ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM marked), unions AS (SELECT user_id, day, island, max(b) - min(a) AS down FROM islands GROUP BY ALL)"


def spans(spark, sf_dir):
    end = F.timestamp_millis(F.unix_millis("ts") + F.floor(F.col("value") * 60000))
    return events(spark, sf_dir).select("event_id", "user_id", "event_type", F.timestamp_millis(F.unix_millis("ts")).alias("a"), end.alias("b"))


@query(f"WITH {DAYS} SELECT user_id, strftime(make_timestamp(day * 86400000000), '%Y-%m-%d') AS day, sum(down)::BIGINT AS down_ms, round(sum(down) / 86400000, 9) AS ratio FROM unions GROUP BY 1, 2")
def downtime_union(spark, sf_dir):
    d = S.downtime_by_day(spans(spark, sf_dir), ["user_id"], "a", "b")
    return d.select("user_id", F.col("day").cast("string").alias("day"), "down_ms", F.round("ratio", 9).alias("ratio"))


@query(f"WITH {SPANS}, days AS (SELECT user_id, unnest(generate_series(a // 86400000, greatest(a, b) // 86400000)) AS day FROM spans) SELECT strftime(make_timestamp(day * 86400000000), '%Y-%m-%d') AS day, count(*) AS incidents, count(DISTINCT user_id) AS users FROM days GROUP BY 1")
def incident_day_join(spark, sf_dir):
    d = S.by_day(spans(spark, sf_dir), "a", "b")
    return d.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("incidents"), F.countDistinct("user_id").alias("users"))


UPTIME = f"{DAYS}, ratios AS (SELECT user_id, day, sum(down) / 86400000 AS ratio FROM unions GROUP BY 1, 2), majors AS (SELECT user_id, day, bool_or(event_type = 'error') AS major FROM clipped GROUP BY 1, 2), users AS (SELECT user_id, (min(epoch_us(ts)) // 1000) // 86400000 AS first FROM events GROUP BY 1), spine AS (SELECT user_id, first, unnest(generate_series(19723, 19753)) AS day FROM users), cells AS (SELECT spine.user_id, strftime(make_timestamp(spine.day * 86400000000), '%Y-%m-%d') AS date, CASE WHEN spine.day < first THEN 'nodata' WHEN ratio IS NULL THEN 'operational' WHEN major THEN 'outage' ELSE 'degraded' END AS status, CASE WHEN spine.day < first THEN NULL WHEN ratio IS NULL THEN 100.0 WHEN major THEN least(90.0, round(greatest(0.0, 100 * (1 - ratio)), 2)) WHEN round(greatest(90.0, 100 - 20 * ratio), 2) >= 100 THEN 99.0 ELSE round(greatest(90.0, 100 - 20 * ratio), 2) END AS uptime FROM spine LEFT JOIN ratios ON spine.user_id = ratios.user_id AND spine.day = ratios.day LEFT JOIN majors ON spine.user_id = majors.user_id AND spine.day = majors.day)"


def cells(spark, sf_dir):
    s = spans(spark, sf_dir)
    down = S.downtime_by_day(s, ["user_id"], "a", "b")
    major = S.by_day(s, "a", "b").where(F.col("b") > F.col("a"))
    day_start = F.col("day").cast("timestamp")
    major = major.where(F.greatest("a", day_start) < F.least("b", day_start + F.expr("INTERVAL 1 DAY"))).groupBy("user_id", "day").agg(F.bool_or(F.col("event_type") == "error").alias("has_major"))
    found = down.join(major, ["user_id", "day"]).withColumnRenamed("user_id", "component_id")
    users = events(spark, sf_dir).groupBy(F.col("user_id").alias("component_id")).agg(F.to_date(F.min("ts")).alias("first_seen"))
    return S.history_cells(users, found, "2024-01-01", "2024-01-31")


@query(f"WITH {UPTIME} SELECT user_id AS component_id, date, status, uptime::DOUBLE AS uptime FROM cells")
def date_spine_uptime(spark, sf_dir):
    return cells(spark, sf_dir).withColumn("date", F.col("date").cast("string"))


@query(f"WITH {UPTIME} SELECT user_id AS component_id, coalesce(round(avg(CASE WHEN status <> 'nodata' THEN uptime END), 2), 100.0)::DOUBLE AS average FROM cells GROUP BY 1")
def tracked_average(spark, sf_dir):
    return S.tracked_average(cells(spark, sf_dir), ["component_id"])


@query(f"WITH {UPTIME}, o AS (SELECT DISTINCT user_id, '2024-01-' || lpad((user_id % 28 + 1)::VARCHAR, 2, '0') AS date, CASE WHEN user_id % 3 = 0 THEN 'nodata' ELSE 'degraded' END AS status, 95.5 AS uptime FROM events) SELECT cells.user_id AS component_id, cells.date, coalesce(o.status, cells.status) AS status, (CASE WHEN o.status IS NULL THEN cells.uptime WHEN o.status = 'nodata' THEN NULL ELSE o.uptime END)::DOUBLE AS uptime FROM cells LEFT JOIN o ON cells.user_id = o.user_id AND cells.date = o.date")
def override_lookup(spark, sf_dir):
    u = events(spark, sf_dir).select(F.col("user_id").alias("component_id")).distinct()
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("component_id") % 28 + 1).cast("string"), 2, "0")).cast("date")
    over = u.select("component_id", day.alias("date"), F.when(F.col("component_id") % 3 == 0, "nodata").otherwise("degraded").alias("status"), F.lit(95.5).alias("uptime"))
    return S.with_overrides(cells(spark, sf_dir), over).withColumn("date", F.col("date").cast("string"))


@query(f"WITH {STATES}, folded AS (SELECT user_id, ts, event_id, status = 'operational' AS closing FROM states), changes AS (SELECT *, lag(closing) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM folded), kept AS (SELECT * FROM changes WHERE last IS NULL OR last <> closing), paired AS (SELECT user_id, closing, (epoch_us(ts) // 1000) AS opened, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000 AS closed FROM kept) SELECT user_id, count(*) AS incidents, sum(coalesce(closed, 1706745600000) - opened)::BIGINT AS open_ms FROM paired WHERE NOT closing GROUP BY 1")
def state_interval_fold(spark, sf_dir):
    s = states(spark, sf_dir).withColumn("update_status", F.when(F.col("status") == "operational", "resolved").otherwise("investigating"))
    first = s.groupBy("user_id").agg(F.min_by("update_status", F.struct("ts", "event_id")).alias("s"), F.min("ts").alias("t"))
    # An incident is created with the first update that is not a resolution.
    created = s.where("update_status <> 'resolved'").groupBy("user_id").agg(F.min("ts").alias("created_at"))
    incidents = created.join(first, "user_id").select(F.col("user_id").alias("incident_id"), "created_at", F.lit("investigating").alias("status"), F.lit(None).cast("timestamp").alias("resolved_at"))
    updates = s.join(created, "user_id").where("ts >= created_at").select(F.col("user_id").alias("incident_id"), "ts", F.col("update_status").alias("status"))
    out = S.incident_intervals(incidents, updates, F.lit("2024-02-01").cast("timestamp"))
    ms = F.unix_millis("closed_at") - F.unix_millis("opened_at")
    return out.groupBy(F.col("incident_id").alias("user_id")).agg(F.count("*").alias("incidents"), F.sum(ms).alias("open_ms"))


@query("SELECT event_id, CASE WHEN TIMESTAMP '2024-01-16' >= ts AND TIMESTAMP '2024-01-16' < ts + INTERVAL 6 HOUR THEN 'active' WHEN TIMESTAMP '2024-01-16' < ts AND TIMESTAMP '2024-01-16' >= ts - INTERVAL 24 HOUR THEN 'upcoming' WHEN TIMESTAMP '2024-01-16' >= ts + INTERVAL 6 HOUR AND TIMESTAMP '2024-01-16' < ts + INTERVAL 30 HOUR THEN 'completed' END AS phase FROM events")
def maintenance_phase(spark, sf_dir):
    at = F.lit("2024-01-16 00:00:00").cast("timestamp")
    return events(spark, sf_dir).select("event_id", S.maintenance_phase(F.col("ts"), F.col("ts") + F.expr("INTERVAL 6 HOURS"), at).alias("phase"))


@query("SELECT user_id, least(20, greatest(1, date_diff('day', min(ts)::DATE, DATE '2024-01-10') + 1))::INTEGER AS days FROM events GROUP BY 1")
def tracked_days(spark, sf_dir):
    first = events(spark, sf_dir).groupBy("user_id").agg(F.min("ts").alias("first"))
    return first.select("user_id", S.tracked_days(F.col("first"), F.lit("2024-01-10").cast("timestamp"), 20).alias("days"))


@query("SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 72 HOUR")
def stale_items(spark, sf_dir):
    return S.recent(events(spark, sf_dir), "ts", F.lit("2024-01-31").cast("timestamp"), 72).agg(F.count("*").alias("n"))


# Upserts.


@query(f"WITH {HALVES} SELECT k, sum(n)::BIGINT AS n FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY 1")
def upsert_sum(spark, sf_dir):
    return S.upsert_sum(*halves(spark, sf_dir), ["k"], "n")


@query(f"WITH {HALVES} SELECT k, n::BIGINT AS n FROM new UNION ALL SELECT k, n::BIGINT FROM old WHERE k NOT IN (SELECT k FROM new)")
def upsert_replace(spark, sf_dir):
    return S.upsert_replace(*halves(spark, sf_dir), ["k"])


@query(f"WITH {HALVES} SELECT k, n::BIGINT AS n FROM old UNION ALL SELECT k, n::BIGINT FROM new WHERE k NOT IN (SELECT k FROM old)")
def insert_ignore(spark, sf_dir):
    return S.insert_ignore(*halves(spark, sf_dir), ["k"])


@query(f"WITH {HALVES} SELECT coalesce(old.k, new.k) AS k, CASE WHEN old.n >= new.n OR new.n IS NULL THEN old.n ELSE new.n END::BIGINT AS n FROM old FULL JOIN new ON old.k = new.k")
def newest_wins(spark, sf_dir):
    return S.newest_wins(*halves(spark, sf_dir), ["k"], "n")


@query(f"WITH {HALVES} SELECT k, n::BIGINT AS n FROM old WHERE k NOT IN (SELECT k FROM new)")
def anti_join_unclaimed(spark, sf_dir):
    old, new = halves(spark, sf_dir)
    return S.unclaimed(old, new.select("k"), ["k"])


# Quotas, budgets, sessions.


@query("WITH h AS (SELECT user_id AS key, date_trunc('hour', ts) AS hour, count(*) AS hour_requests, sum(length(props))::BIGINT AS hour_chars FROM events GROUP BY 1, 2) SELECT key, strftime(hour, '%Y-%m-%d %H') AS hour, hour_requests, hour_chars, (sum(hour_requests) OVER w)::BIGINT AS day_requests, (sum(hour_chars) OVER w)::BIGINT AS day_chars FROM h WINDOW w AS (PARTITION BY key, hour::DATE ORDER BY hour)")
def quota_hour_day(spark, sf_dir):
    r = events(spark, sf_dir).select(F.col("user_id").alias("key"), "ts", F.length("props").alias("chars"))
    return S.quota_windows(r).select("key", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "hour_requests", "hour_chars", "day_requests", "day_chars")


@query("WITH h AS (SELECT user_id AS key, date_trunc('hour', ts) AS hour, count(*) AS n, sum(length(props)) AS c FROM events GROUP BY 1, 2), d AS (SELECT *, sum(n) OVER (PARTITION BY key, hour::DATE ORDER BY hour) AS day, sum(c) OVER (PARTITION BY key, hour::DATE ORDER BY hour) AS dc FROM h) SELECT key, strftime(hour, '%Y-%m-%d %H') AS hour, CASE WHEN n > 3 OR c > 90 OR day > 4 OR dc > 150 THEN 'block' WHEN (n > 1 OR c > 40 OR day > 2 OR dc > 80) AND key % 2 = 1 THEN 'verify' ELSE 'ok' END AS decision FROM d")
def quota_decisions(spark, sf_dir):
    r = events(spark, sf_dir).select(F.col("user_id").alias("key"), "ts", F.length("props").alias("chars"))
    decision = S.quota_decision((F.col("hour_requests"), F.col("hour_chars")), (F.col("day_requests"), F.col("day_chars")), F.col("key") % 2 == 0, ((1, 40), (2, 80)), ((3, 90), (4, 150)))
    return S.quota_windows(r).select("key", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), decision.alias("decision"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, (epoch_us(ts) // 1000) // 86400000 ORDER BY ts, event_id)::INTEGER AS in_bucket FROM events WHERE event_type = 'error'")
def malformed_threshold(spark, sf_dir):
    return S.tumbling_counter(events(spark, sf_dir).where("event_type = 'error'"), ["user_id"], 86_400_000).select("event_id", "in_bucket")


@query("SELECT event_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) <= 200 AS admitted FROM events")
def daily_budget(spark, sf_dir):
    return S.daily_budget(events(spark, sf_dir), 200).select("event_id", "admitted")


@query("WITH g AS (SELECT user_id, event_id, ts, CASE WHEN (epoch_us(ts) // 1000) - (epoch_us(lag(ts) OVER w) // 1000) > 3600000 * 6 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS events FROM s GROUP BY 1, 2")
def sessions(spark, sf_dir):
    return S.sessions(events(spark, sf_dir), ["user_id"], 6 * 3600).groupBy("user_id", "session").agg(F.count("*").alias("events"))


# Cues.

CUES = "cues AS (SELECT conv_id AS doc_id, turn AS pos, turn * 4000 AS start_ms, turn * 4000 + 50 * length(text) AS end_ms, text, role AS kind FROM conversations)"


def cue_rows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), (F.col("turn") * 4000).alias("start_ms"), (F.col("turn") * 4000 + 50 * F.length("text")).alias("end_ms"), "text", F.col("role").alias("kind"))


SCENES = f"{CUES}, o AS (SELECT *, CASE WHEN coalesce(start_ms - lag(end_ms) OVER (PARTITION BY doc_id, kind ORDER BY pos) > 2000, true) THEN 1 ELSE 0 END AS fresh FROM cues), n AS (SELECT *, CASE WHEN fresh = 1 THEN sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) - 1 END AS id FROM o), scened AS (SELECT doc_id, pos, text, kind, start_ms, end_ms, (last_value(id IGNORE NULLS) OVER (PARTITION BY doc_id, kind ORDER BY pos))::BIGINT AS scene FROM n)"


@query(f"WITH {SCENES} SELECT doc_id, pos, scene FROM scened")
def scene_index(spark, sf_dir):
    return C.scenes(cue_rows(spark, sf_dir), 2).select("doc_id", "pos", "scene")


@query(f"WITH {SCENES} SELECT doc_id, max(scene) + 1 AS scenes FROM scened GROUP BY 1")
def scene_count(spark, sf_dir):
    return C.scene_counts(cue_rows(spark, sf_dir), 2)


@query(f"WITH {SCENES} SELECT doc_id, pos, coalesce(max(scene) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < min(scene) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), true) AS safe FROM scened")
def suffix_min_cut(spark, sf_dir):
    return C.scene_safe_cuts(C.scenes(cue_rows(spark, sf_dir), 2)).select("doc_id", "pos", "safe")


@query(f"WITH {CUES}, e AS (SELECT kind AS doc_id, 'x' AS style, doc_id % 10 AS text, pos, start_ms, end_ms FROM cues), m AS (SELECT *, CASE WHEN coalesce(start_ms - max(end_ms) OVER (PARTITION BY doc_id, text ORDER BY start_ms, pos, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 120, true) THEN 1 ELSE 0 END AS fresh FROM e), g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, text ORDER BY start_ms, pos, end_ms ROWS UNBOUNDED PRECEDING) AS event FROM m) SELECT doc_id, text::VARCHAR AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS cues FROM g GROUP BY doc_id, text, event")
def event_merge(spark, sf_dir):
    e = cue_rows(spark, sf_dir).select(F.col("kind").alias("doc_id"), F.lit("x").alias("style"), (F.col("doc_id") % 10).cast("string").alias("text"), "pos", "start_ms", "end_ms")
    return C.merge_timeline(e).select("doc_id", "text", "start_ms", "end_ms", F.size("cues").cast("long").alias("cues"))


@query(f"WITH {CUES}, p AS (SELECT a.doc_id, a.pos AS a, b.pos AS b, CASE WHEN greatest(a.end_ms, b.end_ms) > least(a.start_ms, b.start_ms) THEN (least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) / (greatest(a.end_ms, b.end_ms) - least(a.start_ms, b.start_ms)) ELSE 0 END AS ratio FROM cues a JOIN cues b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.pos <= a.pos + 12 AND b.start_ms < a.end_ms AND a.text <> b.text) SELECT doc_id, a, b, round(ratio, 9) AS ratio FROM p WHERE ratio >= 0.6")
def overlap_pairs_candidates(spark, sf_dir):
    return C.overlap_candidates(cue_rows(spark, sf_dir)).withColumn("ratio", F.round("ratio", 9))


@query(f"WITH {CUES}, s AS (SELECT doc_id, pos, length(text) > 900 AS suspect FROM cues), n AS (SELECT *, coalesce(lag(suspect) OVER w, false) OR coalesce(lead(suspect) OVER w, false) AS near FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, pos, suspect FROM n WHERE suspect OR near")
def suspect_neighbours(spark, sf_dir):
    s = cue_rows(spark, sf_dir).withColumn("suspect", F.length("text") > 900)
    return C.neighbours(s).select("doc_id", "pos", "suspect")


@query(f"WITH {CUES} SELECT doc_id, pos, (SELECT sum(length(c.text))::BIGINT FROM cues c WHERE c.doc_id = cues.doc_id AND c.pos BETWEEN cues.pos - 3 AND cues.pos + 3) AS chars FROM cues")
def neighbour_window(spark, sf_dir):
    w = C.context_windows(cue_rows(spark, sf_dir), 3)
    return w.select("doc_id", "pos", F.aggregate("context", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query("WITH d AS (SELECT DISTINCT source, doc_id FROM documents WHERE lang <> 'en'), i AS (SELECT source, doc_id, doc_id - row_number() OVER (PARTITION BY source ORDER BY doc_id) AS island FROM d), r AS (SELECT source, min(doc_id) AS a, max(doc_id) AS b FROM i GROUP BY source, island) SELECT source, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS runs FROM r GROUP BY 1")
def id_runs(spark, sf_dir):
    return C.id_runs(table(spark, sf_dir, "documents").where("lang <> 'en'"), ["source"], "doc_id")


@query(f"WITH {CUES} SELECT doc_id, pos, (sum(length(text)) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS upto FROM cues")
def prefix_cost(spark, sf_dir):
    return C.prefix_sums(cue_rows(spark, sf_dir).withColumn("cost", F.length("text")), "cost").select("doc_id", "pos", "upto")


@query(f"WITH RECURSIVE {CUES}, r AS (SELECT doc_id, pos, length(text)::BIGINT AS c, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM cues), p AS (SELECT doc_id, pos, i, 0 AS bin, c AS used, 1 AS n FROM r WHERE i = 1 UNION ALL SELECT r.doc_id, r.pos, r.i, CASE WHEN p.used + r.c > 1500 OR p.n >= 3 THEN p.bin + 1 ELSE p.bin END, CASE WHEN p.used + r.c > 1500 OR p.n >= 3 THEN r.c ELSE p.used + r.c END, CASE WHEN p.used + r.c > 1500 OR p.n >= 3 THEN 1 ELSE p.n + 1 END FROM p JOIN r ON r.doc_id = p.doc_id AND r.i = p.i + 1) SELECT doc_id, pos, bin FROM p")
def greedy_pack(spark, sf_dir):
    return C.greedy_pack(cue_rows(spark, sf_dir).withColumn("cost", F.length("text")), "cost", 1500, 3)


@query("SELECT lang, min(doc_id) AS slot, text, count(*) AS n FROM documents GROUP BY lang, text HAVING count(*) > 1")
def dedupe_alias_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("pos", F.col("doc_id"))
    _, joined = C.dedupe(d, ["lang", "text"])
    return joined.groupBy("lang", "slot", "text").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT count(*) AS n FROM documents WHERE text IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def semi_join_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.join(d.where("doc_id % 2 = 0").select("text"), "text", "left_semi").agg(F.count("*").alias("n"))


@query(f"WITH {CUES}, s AS (SELECT doc_id, kind, avg(CASE WHEN text LIKE '%,%' THEN 1.0 ELSE 0.0 END) AS share FROM cues GROUP BY 1, 2) SELECT doc_id, kind, share >= 0.06 AND share >= 2.5 * min(share) OVER (PARTITION BY doc_id) + 0.02 AS marked FROM s")
def sibling_contrast(spark, sf_dir):
    s = cue_rows(spark, sf_dir).groupBy("doc_id", "kind").agg(F.avg(F.col("text").contains(",").cast("double")).alias("share"))
    return C.sibling_contrast(s, "doc_id", "share").select("doc_id", "kind", "marked")


@query(f"WITH {CUES} SELECT doc_id, kind, pos, row_number() OVER (PARTITION BY doc_id, kind ORDER BY length(text) DESC, pos)::INTEGER AS ordinal FROM cues")
def variant_ordinal(spark, sf_dir):
    from pyspark.sql import Window as W

    order = W.partitionBy("doc_id", "kind").orderBy(F.desc(F.length("text")), "pos")
    return cue_rows(spark, sf_dir).select("doc_id", "kind", "pos", F.row_number().over(order).alias("ordinal"))


@query(f"WITH {CUES}, n AS (SELECT doc_id, pos, CASE WHEN pos % 3 <> 1 THEN text END AS translation FROM cues) SELECT doc_id, count(*) FILTER (translation IS NULL) AS missing, coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (translation IS NULL), '') AS positions FROM n GROUP BY 1")
def missing_summary(spark, sf_dir):
    c = cue_rows(spark, sf_dir).withColumn("translation", F.when(F.col("pos") % 3 != 1, F.col("text")))
    return C.missing_summary(c).select("doc_id", "missing", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(f"WITH {CUES} SELECT doc_id, sum(length(text))::BIGINT AS chars, count(*) AS cues FROM cues GROUP BY 1")
def total_characters(spark, sf_dir):
    return cue_rows(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("cues"))


@query(f"WITH {CUES}, d AS (SELECT doc_id, pos, 'new ' || pos AS t FROM cues WHERE pos % 2 = 0) SELECT cues.doc_id, cues.pos, coalesce(d.t, cues.text) AS text FROM cues LEFT JOIN d ON cues.doc_id = d.doc_id AND cues.pos = d.pos")
def delta_merge(spark, sf_dir):
    c = cue_rows(spark, sf_dir)
    delta = c.where("pos % 2 = 0").select("doc_id", "pos", F.concat(F.lit("new "), F.col("pos").cast("string")).alias("text"))
    return C.apply_deltas(c.select("doc_id", "pos", "text"), delta, ["doc_id", "pos"], "text")


# Text and clock functions.


@query("SELECT event_id, lpad((ms // 3600000)::VARCHAR, 2, '0') || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((ms % 1000)::VARCHAR, 3, '0') AS clock FROM (SELECT event_id, (event_id * 7919 % 86400000)::BIGINT AS ms FROM events)")
def clock_format(spark, sf_dir):
    ms = F.col("event_id") * 7919 % 86_400_000
    return events(spark, sf_dir).select("event_id", clock.srt_time(ms).alias("clock"))


@query("SELECT event_id, (event_id * 7919 % 86400000)::BIGINT AS ms FROM events")
def clock_parse(spark, sf_dir):
    ms = F.col("event_id") * 7919 % 86_400_000
    return events(spark, sf_dir).select("event_id", clock.to_ms(clock.vtt_time(ms)).alias("ms"))


@query("SELECT event_id, cs // 360000 || ':' || lpad((cs // 6000 % 60)::VARCHAR, 2, '0') || ':' || lpad((cs // 100 % 60)::VARCHAR, 2, '0') || '.' || lpad((cs % 100)::VARCHAR, 2, '0') AS clock FROM (SELECT event_id, ((event_id * 7919 % 86400000) + 5) // 10 AS cs FROM events)")
def clock_ass(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", clock.ass_time(F.col("event_id") * 7919 % 86_400_000).alias("clock"))


@query(r"SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS breaks, CASE WHEN length(text) - length(replace(text, chr(13), '')) > length(text) - length(replace(text, chr(10), '')) THEN 'cr' ELSE 'lf' END AS style FROM documents")
def newline_style(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.regexp_count("text", F.lit("\n")).cast("long").alias("breaks"), T.newline_style(F.col("text")).alias("style"))


@query(r"SELECT doc_id, length(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\v]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS chars FROM documents")
def tidy_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(T.tidy_lines(F.col("text"))).cast("long").alias("chars"))


@query(r"SELECT doc_id, length(regexp_replace(text, '[^\p{L}\p{N}_]', '', 'g')) AS chars FROM documents")
def content_chars(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_chars(F.col("text")).alias("chars"))


@query(r"SELECT page_id, length(regexp_replace(html, '[^\p{Latin}]', '', 'g')) AS latin, length(regexp_replace(html, '[^\p{Cyrillic}]', '', 'g')) AS cyrillic, length(regexp_replace(html, '[^\p{Han}]', '', 'g')) AS han FROM pages")
def script_share(spark, sf_dir):
    n = T.script_counts(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", n["Latin"].cast("long").alias("latin"), n["Cyrillic"].cast("long").alias("cyrillic"), n["Han"].cast("long").alias("han"))


@query(r"SELECT doc_id, CASE WHEN w > 0 THEN w ELSE length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) END AS weight FROM (SELECT doc_id, text, 2.5 * len(regexp_extract_all(text, '[A-Za-z](?:[''’]?[A-Za-z])*')) + 0.5 * len(regexp_extract_all(text, '[0-9]')) + len(regexp_extract_all(regexp_replace(text, '[\x00-\x7F]', '', 'g'), '[\p{L}\p{N}]')) AS w FROM documents)")
def weighted_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.weighted_length(F.col("text")).cast("double").alias("weight"))


@query(f"WITH {CUES}, l AS (SELECT doc_id, pos, end_ms - start_ms AS d, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS lines FROM cues) SELECT doc_id, pos, round((coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) + greatest(len(lines) - 1, 0)) / greatest(d / 1000, 0.001), 6) AS cps FROM l")
def reading_speed(spark, sf_dir):
    return cue_rows(spark, sf_dir).select("doc_id", "pos", F.round(T.reading_speed(F.col("text"), F.col("end_ms") - F.col("start_ms")), 6).alias("cps"))


@query(r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\p{L}[\p{L}\p{N}''’-]*')) AS t FROM documents) SELECT lower(t) AS key, count(*) AS frequency, count(DISTINCT doc_id) AS docs, count(*) FILTER (regexp_matches(t, '^\p{Lu}')) AS capitals, count(*) FILTER (NOT regexp_matches(t, '^\p{Lu}')) AS lowers FROM t GROUP BY 1")
def token_ledger(spark, sf_dir):
    return C.token_ledger(table(spark, sf_dir, "documents"))


@query(r"WITH t AS (SELECT unnest(regexp_extract_all(text, '\p{L}[\p{L}\p{N}''’-]*')) AS t FROM documents) SELECT lower(t) AS key, count(*) AS frequency FROM t GROUP BY 1 ORDER BY frequency DESC, key LIMIT 300")
def top_terms(spark, sf_dir):
    ledger = C.token_ledger(table(spark, sf_dir, "documents"))
    return ledger.select("key", "frequency").orderBy(F.desc("frequency"), "key").limit(300)


@query(r"WITH r AS (SELECT unnest(regexp_extract_all(text, '\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+')) AS run FROM documents) SELECT run, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 2")
def name_runs(spark, sf_dir):
    return C.name_runs(table(spark, sf_dir, "documents"))


@query(r"WITH terms AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS term FROM part), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}'']+')) AS term FROM documents) SELECT doc_id, w.term, count(*) AS n FROM w JOIN terms ON w.term = terms.term GROUP BY 1, 2")
def glossary_hits(spark, sf_dir):
    terms = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("term")).select(F.lower("term").alias("term")).distinct()
    return C.glossary_hits(table(spark, sf_dir, "documents"), terms, 1)


@query("SELECT page_id, length(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS chars FROM pages")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(T.html_escape(F.col("html"))).cast("long").alias("chars"))


@query(r"SELECT page_id, length(regexp_replace(regexp_replace(html, '\{[^}]*\}', '', 'g'), '</?[A-Za-z][^>]*>', '', 'g')) AS chars FROM pages")
def strip_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(T.strip_markup(F.col("html"))).cast("long").alias("chars"))


@query("SELECT user_id, sha256(string_agg(event_id::VARCHAR, ',' ORDER BY event_id)) AS digest FROM events GROUP BY 1")
def digests(spark, sf_dir):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    return events(spark, sf_dir).groupBy("user_id").agg(F.sha2(ids, 256).alias("digest"))


@query("SELECT list_sort(list_filter(a, lambda x: NOT list_contains(b, x)))::VARCHAR AS difference, list_sort(list_intersect(a, b))::VARCHAR AS common FROM (SELECT list(DISTINCT user_id) FILTER (event_type = 'click' AND event_id < 150) AS a, list(DISTINCT user_id) FILTER (event_type = 'view' AND event_id < 150) AS b FROM events)")
def set_difference_ids(spark, sf_dir):
    e = events(spark, sf_dir).where("event_id < 150")
    sets = e.agg(F.collect_set(F.when(F.col("event_type") == "click", F.col("user_id"))).alias("a"), F.collect_set(F.when(F.col("event_type") == "view", F.col("user_id"))).alias("b"))
    shown = lambda x: F.concat(F.lit("["), F.array_join(F.array_sort(x).cast("array<string>"), ", "), F.lit("]"))
    return sets.select(shown(F.array_except("a", "b")).alias("difference"), shown(F.array_intersect("a", "b")).alias("common"))


@query("WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view') SELECT a.user_id, CASE WHEN b.user_id IS NULL THEN 'difference' ELSE 'common' END AS part FROM a LEFT JOIN b ON a.user_id = b.user_id")
def set_difference_users(spark, sf_dir):
    """set_difference_ids over all events, as rows; that one reads event_id < 150, as its SQL does."""
    users = lambda kind: events(spark, sf_dir).where(F.col("event_type") == kind).select("user_id").distinct()
    a, b = users("click"), users("view")
    parts = (a.join(b, "user_id", how).withColumn("part", F.lit(part)) for how, part in (("left_anti", "difference"), ("left_semi", "common")))
    return next(parts).union(next(parts))


@query("SELECT count(*) AS n FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(DISTINCT source) > 1)")
def semi_join_sources(spark, sf_dir):
    """semi_join_text with every document among the keys: documents whose text stands in several sources."""
    d = table(spark, sf_dir, "documents")
    shared = d.select("text", "source").where("source IS NOT NULL").distinct().groupBy("text").agg(F.count("*").alias("sources")).where("sources > 1")
    return d.join(shared, "text", "left_semi").agg(F.count("*").alias("n"))


# Queries without SQL: tests hold them against brute force or a round trip.


@query()
def subtitle_round_trip(spark, sf_dir):
    """Conversations written as SRT, VTT and ASS and read again: cues by document and format."""
    from tidemark.sources.sinks import RENDERERS
    from tidemark.sources.subtitles import PARSERS

    c = cue_rows(spark, sf_dir).select("doc_id", "pos", "start_ms", "end_ms", "text", F.lit(None).cast("string").alias("translation"), F.lit(None).cast("int").alias("top_align"))
    out = None
    for name, render in RENDERERS.items():
        texts = render(c).withColumnRenamed("content", "text")
        cues = PARSERS[name](texts).groupBy("doc_id").agg(F.count("*").alias("cues"), F.sum(F.length("text")).alias("chars")).withColumn("format", F.lit(name))
        out = cues if out is None else out.union(cues)
    return out


@query()
def sentence_groups(spark, sf_dir):
    return C.sentence_groups(cue_rows(spark, sf_dir), most_gap_ms=100_000).select("doc_id", "pos", "sentence")


@query()
def timeline_pairs(spark, sf_dir):
    return C.pair_timeline(cue_rows(spark, sf_dir))


@query()
def wrapped_lines(spark, sf_dir):
    return C.wrap_lines(cue_rows(spark, sf_dir).select("doc_id", "pos", "text"), "text")


@query()
def chapter_packs(spark, sf_dir):
    c = C.scenes(cue_rows(spark, sf_dir), 2).withColumnRenamed("scene", "chapter").withColumn("cost", F.length("text"))
    return C.chapter_pack(c, 1500)


@query()
def scene_chunks(spark, sf_dir):
    return C.scene_chunks(C.scenes(cue_rows(spark, sf_dir), 2), 4)


@query()
def spread_samples(spark, sf_dir):
    return C.spread_sample(cue_rows(spark, sf_dir), 3).select("doc_id", "pos")


# Incident records, endpoints and checks.


@query("SELECT event_id, CASE WHEN s IS NULL THEN 'network_error' WHEN s BETWEEN 200 AND 399 THEN 'ok' WHEN s = 429 THEN 'rate_limited' WHEN s IN (401, 403) THEN 'auth_error' ELSE 'http_error' END AS error FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE [200, 204, 301, 404, 429, 500, 503][event_id % 7 + 1] END AS s FROM events)")
def probe_classification(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, (200, 204, 301, 404, 429, 500, 503))), (F.col("event_id") % 7 + 1).cast("int"))
    return events(spark, sf_dir).select("event_id", I.probe_error(F.when(F.col("event_id") % 7 != 0, code)).alias("error"))


@query("WITH e AS (SELECT DISTINCT user_id, event_type AS endpoint, length(event_type) * 10 + ascii(event_type) AS priority, CASE WHEN user_id % 5 = 0 THEN 'major_outage' WHEN event_type IN ('click', 'view') THEN 'major_outage' ELSE 'operational' END AS status FROM events) SELECT user_id, coalesce(arg_min(endpoint, priority) FILTER (status IN ('operational', 'degraded_performance')), arg_min(endpoint, priority)) AS endpoint FROM e GROUP BY 1")
def endpoint_choice(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", F.col("event_type").alias("endpoint")).distinct()
    e = e.withColumn("priority", F.length("endpoint") * 10 + F.ascii("endpoint"))
    down = (F.col("user_id") % 5 == 0) | F.col("endpoint").isin("click", "view")
    return S.endpoint_choice(e.withColumn("status", F.when(down, "major_outage").otherwise("operational")), ["user_id"])


@query(f"WITH {STATES}, w AS (SELECT user_id, ['operational', 'maintenance', 'degraded_performance', 'partial_outage', 'major_outage'][max(list_position(['operational', 'maintenance', 'degraded_performance', 'partial_outage', 'major_outage'], status))] AS status FROM states WHERE event_id % 3 = 0 GROUP BY 1), n AS (SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' AND event_id % 2 = 0 GROUP BY 1) SELECT w.user_id, CASE WHEN w.status = 'operational' OR coalesce(errors, 0) >= 2 THEN w.status ELSE 'operational' END AS effective FROM w LEFT JOIN n ON w.user_id = n.user_id")
def corroborated_impact(spark, sf_dir):
    reports = S.worst_of(states(spark, sf_dir).where("event_id % 3 = 0"), ["user_id"]).withColumnRenamed("worst", "status")
    errors = events(spark, sf_dir).where("event_type = 'error' AND event_id % 2 = 0").groupBy("user_id").agg(F.count("*").alias("errors"))
    return S.corroborated(reports, errors, ["user_id"]).select("user_id", "effective")


@query(f"WITH {STATES}, w AS (SELECT user_id, ['operational', 'maintenance', 'degraded_performance', 'partial_outage', 'major_outage'][max(list_position(['operational', 'maintenance', 'degraded_performance', 'partial_outage', 'major_outage'], status))] AS status FROM states GROUP BY 1), n AS (SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1) SELECT w.user_id, CASE WHEN w.status = 'operational' OR coalesce(errors, 0) >= 2 THEN w.status ELSE 'operational' END AS effective FROM w LEFT JOIN n ON w.user_id = n.user_id")
def corroborated_states(spark, sf_dir):
    """corroborated_impact over all states and all errors."""
    reports = S.worst_of(states(spark, sf_dir), ["user_id"]).withColumnRenamed("worst", "status")
    errors = events(spark, sf_dir).where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("errors"))
    return S.corroborated(reports, errors, ["user_id"]).select("user_id", "effective")


@query("WITH u AS (SELECT user_id, event_type, event_id FROM events), l AS (SELECT user_id, arg_max(event_type, event_id) AS last, max(event_id) AS id FROM u GROUP BY 1) SELECT user_id, last = 'signup' AND id % 2 = 0 AS human FROM l")
def human_resolved(spark, sf_dir):
    u = events(spark, sf_dir).select(F.col("user_id").alias("incident_id"), F.lit(0).alias("ts"), F.col("event_id").alias("update_id"), F.when(F.col("event_type") == "signup", "resolved").otherwise("monitoring").alias("status"), F.when(F.col("event_id") % 2 == 0, "human").otherwise("system").alias("author"))
    return I.human_resolved(u).withColumnRenamed("incident_id", "user_id")


@query("WITH t AS (SELECT o_orderkey, o_orderkey * 25 AS n, CASE WHEN o_orderkey * 25 < 1000000 THEN 1000 ELSE 1000000 END AS size FROM orders) SELECT o_orderkey, CASE WHEN n < 1000 THEN n::VARCHAR ELSE CASE WHEN n >= 10 * size THEN ((n + size // 2) // size)::VARCHAR WHEN n * 1000 // size % 1000 IN (250, 750) AND n % (size // 1000) = 0 THEN (n // size) || CASE WHEN n * 1000 // size % 1000 = 250 THEN '.3' ELSE '.8' END ELSE regexp_replace(printf('%.1f', n / size), '[.]0$', '') END || CASE WHEN size = 1000 THEN 'k' ELSE 'M' END END AS shown FROM t")
def compact_numbers(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.compact_number(F.col("o_orderkey") * 25).alias("shown"))


@query("SELECT event_id, least(60000, 5000 * power(2, least(event_id % 12, 30)))::BIGINT AS delay_ms, greatest(1, ceil(value * 10 / greatest(100, ceil(value * 10 / 20), 1)))::INTEGER AS units FROM events")
def retry_and_rate(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", K.retry_delay(F.col("event_id") % 12).alias("delay_ms"), K.rate_units(F.col("value") * 10, 100).alias("units"))


@query(f"WITH {CUES} SELECT doc_id, pos, CASE WHEN regexp_matches(text, '[.!?。！？][\"''”’»)\\]]*\\s*$') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '[,，、;；:：—–-]\\s*$') THEN 2 ELSE 0 END AS flags FROM cues")
def edge_flags(spark, sf_dir):
    return cue_rows(spark, sf_dir).select("doc_id", "pos", K.edge_flags(F.col("text")).bitwiseAND(3).alias("flags"))


@query(f"WITH {CUES} SELECT doc_id, pos, length(regexp_replace(text, '[^\\[\\](){{}}]', '', 'g')) AS brackets FROM cues")
def bracket_counts(spark, sf_dir):
    return cue_rows(spark, sf_dir).select("doc_id", "pos", K.bracket_count(F.col("text")).cast("long").alias("brackets"))


@query("SELECT a.p_name AS inner_name, b.p_name AS outer_name FROM (SELECT DISTINCT string_split(p_name, ' ')[1] AS p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON a.p_name <> b.p_name AND list_contains(string_split(lower(b.p_name), ' '), lower(a.p_name))")
def containing_terms(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    terms = p.select(F.col("p_name").alias("term")).union(p.select(F.get(F.split("p_name", " "), F.lit(0)).alias("term"))).distinct()
    heads = p.select(F.get(F.split("p_name", " "), F.lit(0)).alias("inner")).distinct()
    return M.containing_pairs(terms).join(heads, "inner", "left_semi").select(F.col("inner").alias("inner_name"), F.col("outer").alias("outer_name"))


@query("SELECT event_id, (1 + event_id % 3) || '.' || (event_id % 12) AS version, (1 + event_id % 3) * 100 + event_id % 12 >= 105 AND (1 + event_id % 3) * 100 + event_id % 12 < 302 AS fits FROM events")
def version_ranges(spark, sf_dir):
    v = F.concat((1 + F.col("event_id") % 3).cast("string"), F.lit("."), (F.col("event_id") % 12).cast("string"))
    return events(spark, sf_dir).select("event_id", v.alias("version"), K.version_in_range(v, "1.5", "3.2").alias("fits"))


@query()
def longest_matches(spark, sf_dir):
    keys = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("key"))
    return M.longest_matches(table(spark, sf_dir, "documents"), keys.union(spark.createDataFrame([("of the",), ("de la",), ("in der",)], "key string")))


@query()
def text_hashes(spark, sf_dir):
    return M.text_hash(cue_rows(spark, sf_dir).select("doc_id", "pos", "text")).select("doc_id", "pos", "hash")
