"""Stored jobs, settings, reputation and admission: lookups, joins and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The share of the calls that the first pass may use.
FIRST_PASS_SHARE = 0.8


def settings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """key, value of the settings asked for."""
    return rows.where(F.col("key").isin(*keys)).select("key", "value")


def list_heads(heads: DataFrame, newest: str = "created_at", key: str = "id") -> DataFrame:
    """heads with place: 1 for the newest. Ranks come from counts by day, so no task orders more than a day."""
    rows = heads.withColumn("__day", F.to_date(newest))
    days = rows.groupBy("__day").agg(F.count("*").alias("__n"))
    later = F.sum("__n").over(W.orderBy(F.desc("__day")).rowsBetween(W.unboundedPreceding, -1))  # one row a day
    days = days.select("__day", F.coalesce(later, F.lit(0)).alias("__before"))
    within = F.row_number().over(W.partitionBy("__day").orderBy(F.desc(newest), key))
    placed = rows.withColumn("__within", within).join(F.broadcast(days), "__day")
    return placed.select(*heads.columns, (F.col("__before") + F.col("__within")).alias("place"))


def job(heads: DataFrame, bodies: DataFrame, key: str = "id", ids: DataFrame | None = None) -> DataFrame:
    """Heads with their bodies; without ids all of them. A head or body alone gives none."""
    wanted = heads if ids is None else heads.join(ids, key, "left_semi")
    return wanted.join(bodies, key)


def reputation_gate(now: Column, day_ms: int, window_ms: int, cleared_multiplier: int, malformed_threshold: int) -> Column:
    """The gate of a row with blocked_until, quarantine_until, day_bucket, captcha_count, window_bucket and
    malformed_count (nulls where nothing is known): blocked, quarantined, require_clearance, clearance_multiplier."""
    known = lambda name: F.coalesce(F.col(name), F.lit(0))
    today = F.when(known("day_bucket") == F.floor(now / day_ms), known("captcha_count")).otherwise(0)
    malformed = F.when(known("window_bucket") == F.floor(now / window_ms), known("malformed_count")).otherwise(0)
    blocked, quarantined = known("blocked_until") > now, known("quarantine_until") > now
    return F.struct(
        blocked.alias("blocked"), (blocked | quarantined).alias("quarantined"), (blocked | quarantined | (malformed > malformed_threshold)).alias("require_clearance"),
        F.greatest(F.lit(1), F.floor(cleared_multiplier / F.greatest(F.lit(1), today))).cast("int").alias("clearance_multiplier"),
    )


def escalation_days(previous: Column, base: int, most: int) -> Column:
    return F.when(previous > 0, F.least(previous * 2, F.lit(most))).otherwise(base)


def first_pass(units: DataFrame, by: list[str], order: list[str], limit: int) -> DataFrame:
    """The units that the first pass of each job may send: a share of its calls, one at least."""
    cap = max(1, int(limit * FIRST_PASS_SHARE))
    return units.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= cap).drop("__n")


def throughput(samples: DataFrame, key: list[str], seconds: int, every_ms: int) -> DataFrame:
    """Bytes (column n) a second in windows of so many seconds, one beginning every so many milliseconds."""
    at = F.window("ts", f"{seconds} seconds", f"{every_ms} milliseconds").alias("w")
    return samples.groupBy(*key, at).agg((F.sum("n") / seconds).alias("rate")).select(*key, F.col("w.start").alias("start"), "rate")


def first_pairs(entries: DataFrame, by: list[str], order: str) -> DataFrame:
    """source, target: of entries with the same trimmed source the first counts; empty sources go."""
    rows = entries.withColumns({"source": F.btrim("source"), "target": F.btrim("target")}).where("source <> ''")
    return rows.groupBy(*by, "source").agg(F.min_by("target", order).alias("target"))


def key_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, side: keys that b lacks (missing) and keys that only b has (extra)."""
    a, b = a.select("key").distinct(), b.select("key").distinct()
    return a.join(b, "key", "left_anti").withColumn("side", F.lit("missing")).union(b.join(a, "key", "left_anti").withColumn("side", F.lit("extra")))


def request_cues(cues: DataFrame, translatable: Column, terminal: Column) -> DataFrame:
    """Cues worth sending: those that can be translated, and others that stand between two of these inside a sentence that
    the earlier one leaves open."""
    back = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy("doc_id").orderBy("pos").rowsBetween(1, W.unboundedFollowing)
    rows = cues.withColumns({"__can": translatable, "__open": F.when(translatable, ~terminal)})
    rows = rows.withColumns({"__before": F.last("__open", ignorenulls=True).over(back), "__after": F.max("__can").over(ahead)})
    return rows.where(F.col("__can") | (F.coalesce("__before", F.lit(False)) & F.coalesce("__after", F.lit(False)))).select(*cues.columns)


def covered_tokens(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, at, label: tokens (start, end) that a span of the same document overlaps."""
    t, s = tokens.alias("t"), spans.alias("s")
    meet = (F.col("t.doc_id") == F.col("s.doc_id")) & (F.col("t.start") < F.col("s.end")) & (F.col("s.start") < F.col("t.end"))
    return t.join(s, meet).select("t.doc_id", "t.at", "s.label").distinct()
