"""Incident records: counting, projecting, matching and adopting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STAGES = ("investigating", "identified", "monitoring", "resolved")
SEVERITY_STATE = {"minor": "degraded_performance", "major": "major_outage", "critical": "major_outage"}


def active_count(incidents: DataFrame, overall_operational: Column) -> DataFrame:
    """Open incidents that are no maintenance; those with upstream ids only where the whole is not operational."""
    own = F.size("upstream_ids") == 0
    return incidents.agg(F.count_if((F.col("status") != "resolved") & (F.coalesce("kind", F.lit("")) != "maintenance") & (own | ~overall_operational)).alias("active"))


def vendor_state(reports: DataFrame) -> DataFrame:
    """provider, incidents, state from rows (provider, incidents array<struct<id,status,severity>>): the worst of what
    is not resolved."""
    rows = reports.select("provider", F.explode_outer("incidents").alias("i"))
    open_ = F.col("i").isNotNull() & (F.col("i.status") != "resolved")
    rank = F.when(open_, F.when(F.col("i.severity") == "minor", 1).when(F.col("i.severity").isin("major", "critical"), 2).otherwise(1)).otherwise(0)
    worst = F.max(rank)
    return rows.groupBy("provider").agg(F.count_if(open_).alias("incidents"), F.when(worst == 2, "major_outage").when(worst == 1, "degraded_performance").otherwise("operational").alias("state"))


def probe_error(status: Column, aborted: Column | None = None) -> Column:
    """ok (200 to 399), rate_limited, auth_error or http_error by the answer's status; without an answer timeout where
    the call was aborted, else network_error."""
    silent = status.isNull() | (status == 0)
    gone = F.lit("network_error") if aborted is None else F.when(aborted, "timeout").otherwise("network_error")
    return F.when(silent, gone).when(status.between(200, 399), "ok").when(status == 429, "rate_limited").when(status.isin(401, 403), "auth_error").otherwise("http_error")


def probe_state(error: Column) -> Column:
    return F.when(error == "ok", "operational").when(error.isin("rate_limited", "auth_error"), "degraded_performance").otherwise("major_outage")


def best_match(signals: DataFrame, open_incidents: DataFrame, debounce_minutes: int = 150) -> DataFrame:
    """signal_id, incident_id: the open incident of a signal by upstream id, else by component, else the most recently
    settled one within the debounce. Three equi-joins, ranked; no cross product."""
    s = signals.select("signal_id", "upstream_id", "component_id", "ts")
    i = open_incidents
    by_upstream = s.join(i.select("incident_id", F.explode("upstream_ids").alias("upstream_id"), "settled_at"), "upstream_id").select("signal_id", "incident_id", F.lit(0).alias("rank"), "settled_at")
    parts = i.select("incident_id", F.explode("component_ids").alias("component_id"), "settled_at")
    joined = s.join(parts, "component_id")
    by_component = joined.where("settled_at IS NULL").select("signal_id", "incident_id", F.lit(1).alias("rank"), "settled_at")
    since = F.unix_millis("ts") - F.unix_millis("settled_at")
    recent = joined.where(since.between(0, debounce_minutes * 60_000)).select("signal_id", "incident_id", F.lit(2).alias("rank"), "settled_at")
    order = W.partitionBy("signal_id").orderBy("rank", F.desc_nulls_last("settled_at"), "incident_id")
    every = by_upstream.union(by_component).union(recent)
    return every.withColumn("__n", F.row_number().over(order)).where("__n = 1").select("signal_id", "incident_id")


def backfilled(updates: DataFrame) -> DataFrame:
    """incident_id, status of every stage up to the one reported (rows incident_id, status)."""
    k = F.array_position(F.array(*map(F.lit, STAGES)), F.col("status")).cast("int")
    return updates.select("incident_id", F.explode(F.slice(F.array(*map(F.lit, STAGES)), F.lit(1), k)).alias("status")).distinct()


def human_resolved(updates: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("status", "author"), F.struct("ts", "update_id"))
    return updates.groupBy("incident_id").agg(last.alias("l")).select("incident_id", ((F.col("l.status") == "resolved") & (F.col("l.author") == "human")).alias("human"))


def adopt_legacy(incidents: DataFrame, updates: DataFrame, into: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Several legacy incidents as one (into: incident_id, new_id): the earliest is the base, the latest status counts,
    and equal updates (ts, body) are kept once."""
    i = incidents.join(into, "incident_id")
    merged = i.groupBy("new_id").agg(F.min_by("title", "created_at").alias("title"), F.min("created_at").alias("created_at"), F.max_by("status", "updated_at").alias("status"), F.max("updated_at").alias("updated_at"))
    u = updates.join(into, "incident_id").dropDuplicates(["new_id", "ts", "body"])
    return merged.withColumnRenamed("new_id", "incident_id"), u.drop("incident_id").withColumnRenamed("new_id", "incident_id")


def withdrawn(stored: DataFrame, schedule: DataFrame, readable: bool) -> DataFrame:
    """Open maintenance that the schedule no longer has; none where the schedule could not be read."""
    open_ = stored.where((F.col("kind") == "maintenance") & (F.col("status") != "resolved"))
    return open_.join(schedule.select("id"), open_["incident_id"] == schedule["id"], "left_anti") if readable else open_.limit(0)


def silenced(incidents: DataFrame, silenced_ids: DataFrame) -> DataFrame:
    """incident_id, remaining (upstream ids that are not silenced), all_silenced, by joins on the ids."""
    ids = incidents.select("incident_id", F.explode_outer("upstream_ids").alias("id"))
    marked = ids.join(silenced_ids.select("id").distinct().withColumn("__s", F.lit(True)), "id", "left")
    quiet = F.coalesce("__s", F.lit(False))
    rest = F.sort_array(F.collect_set(F.when(~quiet, F.col("id"))))
    return marked.groupBy("incident_id").agg(rest.alias("remaining"), (F.bool_and(quiet) & (F.count("id") > 0)).alias("all_silenced"))
