"""Status analytics: metric windows, failure statistics, incident intervals, uptime.

Metrics are rows (bucket_minute, metric, count); metric is `job` or `error_<code>`. All times are UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Error codes by category, severity order, failure thresholds.
CLIENT_FAULT = (1004,)
STORAGE_BLOCKING = (2001, 2002)
STORAGE_DEGRADING = (2003, 2004)
STATUS_RANK = ("operational", "maintenance", "degraded_performance", "partial_outage", "major_outage")
WILSON_Z = 1.96
MAJOR_FAILURES, MAJOR_BOUND = 5, 0.5
DEGRADED_FAILURES, DEGRADED_BOUND = 3, 0.1


def minute_bucket(ts: Column, size_ms: int = 60_000) -> Column:
    return F.floor(F.unix_millis(ts) / size_ms)


def metrics_from_events(events: DataFrame) -> DataFrame:
    """Bucketed counters from rows (ts, metric): one row for each minute and metric."""
    return events.groupBy(minute_bucket(F.col("ts")).alias("bucket_minute"), "metric").agg(F.count("*").alias("count"))


def window_sum(metrics: DataFrame, metric: str, since_minute: int) -> DataFrame:
    return metrics.where((F.col("metric") == metric) & (F.col("bucket_minute") >= since_minute)).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))


def sums_by_metric(metrics: DataFrame, since_minute: int | None = None) -> DataFrame:
    rows = metrics if since_minute is None else metrics.where(F.col("bucket_minute") >= since_minute)
    return rows.groupBy("metric").agg(F.sum("count").alias("total"))


def error_metrics(metrics: DataFrame) -> DataFrame:
    r"""Rows whose metric is LIKE 'error\_%'."""
    return metrics.where(F.expr(r"metric LIKE 'error!_%' ESCAPE '!'"))


def error_code(metric: Column) -> Column:
    return F.regexp_extract(metric, r"^error_([0-9]+)$", 1).try_cast("int")


def error_category(code: Column) -> Column:
    return (
        F.when(code.isin(*CLIENT_FAULT), "client_fault")
        .when(code.isin(*STORAGE_BLOCKING), "storage_blocking")
        .when(code.isin(*STORAGE_DEGRADING), "storage_degrading")
        .when(code.between(1000, 2999), "gateway")
        .when(code.between(3000, 5999), "upstream")
    )


def served_and_failed(metrics: DataFrame, by: list[str]) -> DataFrame:
    """by, jobs, errors, client_faults, served, failures, availability (two decimals, 100 where nothing was served)."""
    code = error_code(F.col("metric"))
    category = error_category(code)
    counted = metrics.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("metric") == "job", F.col("count"))), F.lit(0)).alias("jobs"),
        F.coalesce(F.sum(F.when(code.isNotNull(), F.col("count"))), F.lit(0)).alias("errors"),
        F.coalesce(F.sum(F.when(category == "client_fault", F.col("count"))), F.lit(0)).alias("client_faults"),
        F.coalesce(F.sum(F.when(category.isin("gateway", "storage_blocking"), F.col("count"))), F.lit(0)).alias("failures"),
    )
    served = F.col("jobs") + F.col("errors") - F.col("client_faults")
    return counted.withColumn("served", served).withColumn("availability", availability(F.col("failures"), F.col("served")))


def availability(failures: Column, served: Column) -> Column:
    return F.when(served > 0, F.round(100 * (1 - failures / served), 2)).otherwise(100.0)


def wilson_lower_bound(failures: Column, total: Column) -> Column:
    n = F.greatest(total, failures).cast("double")
    rate, z2 = failures / n, WILSON_Z * WILSON_Z
    margin = WILSON_Z * F.sqrt((rate * (1 - rate) + z2 / (4 * n)) / n)
    bound = F.greatest(F.lit(0.0), (rate + z2 / (2 * n) - margin) / (1 + z2 / n))
    return F.when((failures <= 0) | (total <= 0), 0.0).otherwise(bound)


def failure_status(failures: Column, total: Column) -> Column:
    bound = wilson_lower_bound(failures, total)
    return (
        F.when((failures >= MAJOR_FAILURES) & (bound >= MAJOR_BOUND), "major_outage")
        .when((failures >= DEGRADED_FAILURES) & (bound >= DEGRADED_BOUND), "degraded_performance")
        .otherwise("operational")
    )


def status_rank(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATUS_RANK)), status)


def worst_of(rows: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """The status of greatest severity of each group."""
    return rows.groupBy(*by).agg(F.max(F.struct(status_rank(F.col(status)).alias("rank"), F.col(status).alias("name")))["name"].alias("worst"))


def crashed_suppliers(rows: DataFrame, by: list[str]) -> DataFrame:
    """How many are in major outage, and what follows: all -> major_outage, some -> degraded_performance."""
    crashed = F.count_if(F.col("status") == "major_outage")
    state = F.when(crashed == F.count("*"), "major_outage").when(crashed > 0, "degraded_performance").otherwise("operational")
    return rows.groupBy(*by).agg(crashed.alias("crashed"), F.count("*").alias("suppliers"), state.alias("state"))


def tracked_average(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean uptime of the cells that have one and are not nodata, two decimals, 100 where none."""
    tracked = F.when((F.col("status") != "nodata") & F.col("uptime").isNotNull(), F.col("uptime"))
    return rows.groupBy(*by).agg(F.coalesce(F.round(F.avg(tracked), 2), F.lit(100.0)).alias("average"))


def calendar_rollup(metrics: DataFrame) -> DataFrame:
    """(period, total) for every day, month and year, from one aggregation to days."""
    daily = metrics.groupBy(F.date_format(F.timestamp_seconds(F.col("bucket_minute") * 60), "yyyy-MM-dd").alias("day")).agg(F.sum("count").alias("total"))
    periods = F.explode(F.array(F.col("day"), F.substring("day", 1, 7), F.substring("day", 1, 4)))
    return daily.select(periods.alias("period"), "total").groupBy("period").agg(F.sum("total").alias("total"))


def incident_intervals(incidents: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    """incident_id, opened_at, closed_at: chronological updates folded to intervals.

    incidents: incident_id, created_at, status, resolved_at. updates: incident_id, ts, status. A resolved update closes
    the open interval and any other opens one where none is open; the last open interval ends at resolved_at, or as_of.
    """
    steps = incidents.select("incident_id", F.col("created_at").alias("ts"), F.lit(False).alias("closing"), F.lit(0).alias("step")).union(
        updates.select("incident_id", "ts", F.col("status") == "resolved", F.lit(1))
    )
    order = W.partitionBy("incident_id").orderBy("step", "ts", "closing")
    # A step counts only where it changes the state.
    changes = steps.withColumn("last", F.lag("closing").over(order)).where(F.col("last").isNull() | (F.col("last") != F.col("closing")))
    paired = changes.withColumn("next", F.lead("ts").over(order)).where(~F.col("closing"))
    end = F.when(F.col("status") == "resolved", F.coalesce("resolved_at", as_of)).otherwise(as_of)
    return paired.join(incidents.select("incident_id", "status", "resolved_at"), "incident_id").select(
        "incident_id", F.col("ts").alias("opened_at"), F.greatest("ts", F.coalesce("next", end)).alias("closed_at")
    )


def by_day(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """intervals with day, once for each UTC day they touch: an equi-join key instead of a range join."""
    day = F.explode(F.sequence(F.to_date(start), F.greatest(F.to_date(end), F.to_date(start))))
    return intervals.withColumn("day", day)


def downtime_by_day(intervals: DataFrame, by: list[str], start: str, end: str, as_of: Column | None = None) -> DataFrame:
    """by, day, down_ms, ratio: the union of overlapping intervals, clipped to the day (today ends at as_of)."""
    day_start = F.unix_millis(F.col("day").cast("timestamp"))
    day_end = day_start + 86_400_000
    stop = day_end if as_of is None else F.least(day_end, F.greatest(F.unix_millis(as_of), day_start + 1))
    clipped = by_day(intervals, start, end).withColumns({"__a": F.greatest(F.unix_millis(F.col(start)), day_start), "__b": F.least(F.unix_millis(F.col(end)), stop), "__w": stop - day_start})
    clipped = clipped.where("__b > __a")
    key = [*by, "day"]
    order = W.partitionBy(*key).orderBy("__a", "__b")
    reach = F.max("__b").over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = clipped.withColumn("__new", F.when(reach.isNull() | (F.col("__a") > reach), 1).otherwise(0)).withColumn("__island", F.sum("__new").over(order))
    merged = islands.groupBy(*key, "__island").agg((F.max("__b") - F.min("__a")).alias("down"), F.first("__w").alias("w"))
    return merged.groupBy(*key).agg(F.sum("down").alias("down_ms"), (F.sum("down") / F.first("w")).alias("ratio"))


def painted_uptime(has_major: Column, ratio: Column) -> Column:
    major = F.least(F.lit(90.0), F.round(F.greatest(F.lit(0.0), 100 * (1 - ratio)), 2))
    minor = F.round(F.greatest(F.lit(90.0), 100 - 20 * ratio), 2)
    return F.when(has_major, major).otherwise(F.when(minor >= 100, 99.0).otherwise(minor))


def date_spine(components: DataFrame, first: str, last: str) -> DataFrame:
    """components with date, a row for each day from first to last."""
    return components.withColumn("date", F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))))


def history_cells(components: DataFrame, downtime: DataFrame, first: str, last: str) -> DataFrame:
    """component_id, date, status, uptime for every day. downtime: component_id, day, has_major, ratio."""
    cells = date_spine(components.select("component_id", "first_seen"), first, last)
    found = cells.join(downtime, (cells["component_id"] == downtime["component_id"]) & (cells["date"] == downtime["day"]), "left").drop(downtime["component_id"])
    unseen = F.col("date") < F.col("first_seen")
    status = F.when(unseen, "nodata").when(F.col("ratio").isNull(), "operational").when(F.col("has_major"), "outage").otherwise("degraded")
    uptime = F.when(unseen, None).when(F.col("ratio").isNull(), 100.0).otherwise(painted_uptime(F.col("has_major"), F.col("ratio")))
    return found.select("component_id", "date", status.alias("status"), uptime.alias("uptime"))


def with_overrides(cells: DataFrame, overrides: DataFrame) -> DataFrame:
    """Cells where an override (component_id, date, status, uptime) wins; a nodata override has no uptime."""
    o = overrides.select("component_id", "date", F.col("status").alias("__status"), F.col("uptime").alias("__uptime"))
    joined = cells.join(o, ["component_id", "date"], "left")
    over = F.col("__status").isNotNull()
    uptime = F.when(over, F.when(F.col("__status") == "nodata", None).otherwise(F.col("__uptime"))).otherwise(F.col("uptime"))
    return joined.select("component_id", "date", F.coalesce("__status", "status").alias("status"), uptime.alias("uptime"))


def latest_per_key(rows: DataFrame, key: list[str], ts: str, tie: str) -> DataFrame:
    """The newest row of each key; on ties the one that comes first by tie."""
    order = W.partitionBy(*key).orderBy(F.desc(ts), tie)
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def agreement(votes: DataFrame, key: list[str], value: str, share: float = 0.75) -> DataFrame:
    """key, leader, votes, total where the leader holds at least the share."""
    counted = votes.groupBy(*key, value).agg(F.count("*").alias("votes"))
    best = counted.groupBy(*key).agg(F.max(F.struct("votes", F.col(value).alias("leader"))).alias("m"), F.sum("votes").alias("total"))
    return best.select(*key, "m.leader", "m.votes", "total").where(F.col("votes") >= share * F.col("total"))


def majority_first_wins(rows: DataFrame, key: list[str], value: str, pos: str) -> DataFrame:
    """The most frequent value of each key; of equals the one seen first."""
    counted = rows.groupBy(*key, value).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return counted.groupBy(*key).agg(F.max(F.struct("n", -F.col("first"), value))[value].alias("majority"))


def maintenance_phase(start: Column, end: Column, as_of: Column, lead_hours: int = 24, retention_hours: int = 24) -> Column:
    hours = lambda n: F.expr(f"INTERVAL {n} HOURS")
    return (
        F.when((as_of >= start) & (as_of < end), "active")
        .when((as_of < start) & (as_of >= start - hours(lead_hours)), "upcoming")
        .when((as_of >= end) & (as_of < end + hours(retention_hours)), "completed")
    )


def tracked_days(first_seen: Column, as_of: Column, most: int) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(1), F.datediff(F.to_date(as_of), F.to_date(first_seen)) + 1))


def upsert_sum(stored: DataFrame, delta: DataFrame, key: list[str], value: str) -> DataFrame:
    """stored with delta's counts added: on a conflict the counts add up."""
    return stored.select(*key, value).union(delta.select(*key, value)).groupBy(*key).agg(F.sum(value).alias(value))


def upsert_replace(stored: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """On a conflict delta's row wins."""
    return stored.join(delta.select(*key), key, "left_anti").select(stored.columns).union(delta.select(stored.columns))


def insert_ignore(stored: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """On a conflict the stored row stays."""
    return stored.union(delta.join(stored.select(*key), key, "left_anti").select(stored.columns))


def newest_wins(stored: DataFrame, delta: DataFrame, key: list[str], version: str) -> DataFrame:
    """Of a stored row and a delta's the newer; of equal ones the stored row."""
    both = stored.withColumn("__new", F.lit(0)).union(delta.select(stored.columns).withColumn("__new", F.lit(1)))
    order = W.partitionBy(*key).orderBy(F.desc(version), "__new")
    return both.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__new")


def endpoint_choice(endpoints: DataFrame, by: list[str]) -> DataFrame:
    """The serving endpoint of best (least) priority; where none serves, the best of all."""
    serving = F.col("status").isin("operational", "degraded_performance")
    return endpoints.groupBy(*by).agg(F.coalesce(F.min_by("endpoint", F.when(serving, F.col("priority"))), F.min_by("endpoint", "priority")).alias("endpoint"))


def corroborated(reports: DataFrame, own_errors: DataFrame, key: list[str], least: int = 2) -> DataFrame:
    """Reported outages count only where at least `least` own errors back them."""
    joined = reports.join(own_errors, key, "left")
    backed = (F.col("status") == "operational") | (F.coalesce("errors", F.lit(0)) >= least)
    return joined.select(*reports.columns, F.when(backed, F.col("status")).otherwise("operational").alias("effective"))


def unclaimed(stored: DataFrame, claimed: DataFrame, key: list[str]) -> DataFrame:
    return stored.join(claimed, key, "left_anti")


def update_changes(updates: DataFrame, key: list[str]) -> DataFrame:
    """Updates whose status differs from the one before."""
    last = F.lag("status").over(W.partitionBy(*key).orderBy("ts", "update_id"))
    return updates.withColumn("__last", last).where(F.col("__last").isNull() | (F.col("__last") != F.col("status"))).drop("__last")


def quota_windows(requests: DataFrame) -> DataFrame:
    """key, hour, day, requests and characters of each hour and of the day so far."""
    hourly = requests.groupBy("key", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("hour_requests"), F.sum("chars").alias("hour_chars"))
    hourly = hourly.withColumn("day", F.to_date("hour"))
    day = W.partitionBy("key", "day").orderBy("hour")
    return hourly.withColumns({"day_requests": F.sum("hour_requests").over(day), "day_chars": F.sum("hour_chars").over(day)})


# Requests and characters of an hour and of a day, beyond which clearance is asked for or nothing helps.
QUOTA_SOFT = ((120, 24_000_000), (600, 120_000_000))
QUOTA_HARD = ((300, 60_000_000), (1_500, 300_000_000))


def quota_decision(hour: tuple[Column, Column], day: tuple[Column, Column], cleared: Column, soft=QUOTA_SOFT, hard=QUOTA_HARD) -> Column:
    """hour and day: requests and characters of the window with this request. Beyond any hard limit block; beyond any
    soft one verify those without clearance; else ok."""

    def over(limits) -> Column:
        (a, b), (c, d) = limits
        return (hour[0] > a) | (hour[1] > b) | (day[0] > c) | (day[1] > d)

    return F.when(over(hard), "block").when(over(soft) & ~cleared, "verify").otherwise("ok")


def tumbling_counter(events: DataFrame, key: list[str], size_ms: int) -> DataFrame:
    """Each event's count within its bucket so far: the counter begins again at 1 in a new bucket."""
    rows = events.withColumn("bucket", F.floor(F.unix_millis("ts") / size_ms))
    return rows.withColumn("in_bucket", F.row_number().over(W.partitionBy(*key, "bucket").orderBy("ts", "event_id")))


def daily_budget(requests: DataFrame, cap: int) -> DataFrame:
    """requests with used (before) and admitted: a request that would pass the day's cap is denied.

    A day is counted by minutes first; only a minute's requests are put in order by one task."""
    rows = requests.withColumns({"day": F.to_date("ts"), "__minute": F.date_trunc("minute", "ts")})
    minutes = rows.groupBy("day", "__minute").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy("day").orderBy("__minute").rowsBetween(W.unboundedPreceding, -1))
    minutes = minutes.select("day", "__minute", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(W.partitionBy("day", "__minute").orderBy("ts", "event_id")) - 1
    ranked = rows.withColumn("__within", within).join(minutes, ["day", "__minute"])
    used = (F.col("__before") + F.col("__within")).alias("used")
    return ranked.select(*requests.columns, "day", used).withColumn("admitted", F.col("used") < cap)


def recent(rows: DataFrame, ts: str, as_of: Column, hours: int) -> DataFrame:
    """Rows not older than so many hours; rows without a time stay."""
    return rows.where(F.col(ts).isNull() | (F.col(ts) >= as_of - F.expr(f"INTERVAL {hours} HOURS")))


def sessions(events: DataFrame, key: list[str], gap_seconds: float, ts: str = "ts") -> DataFrame:
    """events with session: a new one after a pause of more than gap_seconds."""
    order = W.partitionBy(*key).orderBy(ts, "event_id")
    pause = F.unix_millis(ts) - F.unix_millis(F.lag(ts).over(order))
    return events.withColumn("__new", F.when(pause > gap_seconds * 1000, 1).otherwise(0)).withColumn("session", F.sum("__new").over(order)).drop("__new")
