"""Further registered queries, each beside its SQL: stored jobs, gates, numeric rules, terms and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import CUES, SCENES, cue_rows, events, query, table
from tidemark.functions import checks as K
from tidemark.functions import clock as D
from tidemark.functions import numbers as N
from tidemark.functions import text as T
from tidemark.operators import cues as C
from tidemark.operators import history as H
from tidemark.operators import incidents as I
from tidemark.operators import terms as M


@query("SELECT n_name AS key, n_regionkey::VARCHAR AS value FROM nation WHERE n_name IN ('FRANCE', 'CHINA', 'NATION_3', 'NATION_7')")
def settings_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    return H.settings(rows, ["FRANCE", "CHINA", "NATION_3", "NATION_7"])


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def job_list(spark, sf_dir):
    heads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return H.list_heads(heads).select("id", "place")


@query("SELECT o_orderkey AS id, o_orderstatus AS status, l_linenumber AS part, l_quantity AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def head_body_join(spark, sf_dir):
    heads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    bodies = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("part"), F.col("l_quantity").alias("n"))
    return H.job(heads, bodies)


@query("SELECT l_orderkey AS id, l_linenumber AS part FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def point_lookups(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    bodies = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("part"))
    return bodies.join(ids, "id", "left_semi")


GATE = "SELECT user_id, max(epoch_ms(ts)) AS now, max(CASE WHEN event_type = 'error' THEN epoch_ms(ts) + 86400000 END) AS blocked_until, max(CASE WHEN event_type = 'signup' THEN epoch_ms(ts) + 3600000 END) AS quarantine_until, max(epoch_ms(ts)) // 86400000 AS day_bucket, count(*) AS captcha_count, max(epoch_ms(ts)) // 600000 AS window_bucket, count(*) FILTER (event_type = 'click') AS malformed_count FROM events GROUP BY 1"


@query(
    f"SELECT user_id, coalesce(blocked_until, 0) > now AS blocked, coalesce(blocked_until, 0) > now OR coalesce(quarantine_until, 0) > now AS quarantined, coalesce(blocked_until, 0) > now OR coalesce(quarantine_until, 0) > now OR malformed_count > 2 AS require_clearance, greatest(1, 30 // greatest(1, captcha_count))::INTEGER AS clearance_multiplier FROM ({GATE})"
)
def reputation_gate(spark, sf_dir):
    ms = F.unix_millis("ts")
    rows = events(spark, sf_dir).groupBy("user_id").agg(
        F.max(ms).alias("now"), F.max(F.when(F.col("event_type") == "error", ms + 86_400_000)).alias("blocked_until"), F.max(F.when(F.col("event_type") == "signup", ms + 3_600_000)).alias("quarantine_until"),
        F.floor(F.max(ms) / 86_400_000).alias("day_bucket"), F.count("*").alias("captcha_count"), F.floor(F.max(ms) / 600_000).alias("window_bucket"), F.count_if(F.col("event_type") == "click").alias("malformed_count"),
    )
    return rows.select("user_id", H.reputation_gate(F.col("now"), 86_400_000, 600_000, 30, 2).alias("g")).select("user_id", "g.*")


@query(f"WITH {CUES} SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM cues) WHERE n <= 2")
def dispatch_cap(spark, sf_dir):
    return H.first_pass(cue_rows(spark, sf_dir), ["doc_id"], ["pos"], 3).select("doc_id", "pos")


def step_rates(rows):
    samples = rows.select("event_type", "ts", F.length("props").alias("n"))
    return H.throughput(samples, ["event_type"], 120, 30_000).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "rate")


@query("SELECT event_type, epoch_ms((epoch_ms(ts) // 30000 - i) * 30000) AS start, sum(length(props)) / 120 AS rate FROM events, (SELECT unnest(range(4)) AS i) GROUP BY ALL")
def sliding_throughput(spark, sf_dir):
    """Times are whole milliseconds here, rounded as epoch_ms of its SQL does."""
    return step_rates(events(spark, sf_dir).withColumn("ts", D.to_whole_ms(F.col("ts"))))


@query("SELECT event_type, make_timestamp((epoch_us(ts) // 30000000 - i) * 30000000) AS start, sum(length(props)) / 120 AS rate FROM events, (SELECT unnest(range(4)) AS i) GROUP BY ALL")
def throughput_steps(spark, sf_dir):
    """sliding_throughput of times in microseconds: an event within half a millisecond before a step counts into it there,
    and into the one before here."""
    return step_rates(events(spark, sf_dir))


@query("SELECT p_brand AS brand, trim(p_type) AS source, arg_min(trim(p_name), p_partkey) AS target FROM part WHERE trim(p_type) <> '' GROUP BY 1, 2")
def glossary_pairs(spark, sf_dir):
    entries = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("source"), F.col("p_name").alias("target"), "p_partkey")
    return H.first_pairs(entries, ["brand"], "p_partkey")


@query("WITH a AS (SELECT DISTINCT user_id AS key FROM events WHERE event_type = 'purchase' OR event_type = 'signup'), b AS (SELECT DISTINCT user_id AS key FROM events WHERE event_type = 'error') SELECT key, 'missing' AS side FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT key, 'extra' FROM b WHERE key NOT IN (SELECT key FROM a)")
def key_differences(spark, sf_dir):
    users = lambda *kinds: events(spark, sf_dir).where(F.col("event_type").isin(*kinds)).select(F.col("user_id").alias("key"))
    return H.key_difference(users("purchase", "signup"), users("error"))


@query("SELECT user_id FROM (SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type = 'error')")
def union_distinct(spark, sf_dir):
    users = lambda kind: events(spark, sf_dir).where(F.col("event_type") == kind).select("user_id")
    return users("click").union(users("error")).distinct()


@query("SELECT user_id, bool_and(event_type IN ('click', 'view', 'signup')) AS silenced FROM events GROUP BY 1")
def subset_test(spark, sf_dir):
    kinds = events(spark, sf_dir).groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return kinds.select("user_id", N.contains_all(F.array(*map(F.lit, ("click", "view", "signup"))), F.col("kinds")).alias("silenced"))


@query("SELECT event_id, round_even(event_id / 4, 0)::BIGINT AS even FROM events")
def half_even(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", N.round_half_even(F.col("event_id") / 4).alias("even"))


@query("SELECT event_id, len(list_filter([10, 20, 20, 50, 90], lambda x: x < event_id % 100))::INTEGER AS low, len(list_filter([10, 20, 20, 50, 90], lambda x: x <= event_id % 100))::INTEGER AS after, list_sort(list_transform([10, 20, 20, 50, 90], lambda x, i: {'d': abs(x - event_id % 100), 'i': i, 'x': x}))[1].x::INTEGER AS near FROM events")
def cut_search(spark, sf_dir):
    cuts, target = F.array(*map(F.lit, (10, 20, 20, 50, 90))), (F.col("event_id") % 100).cast("int")
    return events(spark, sf_dir).select("event_id", N.lower_bound(cuts, target).alias("low"), N.first_after(cuts, target).alias("after"), N.nearest(cuts, target).alias("near"))


@query("SELECT vec_id, (list_position(v, list_max(v)) - 1)::INTEGER AS label, round(1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 9) AS probability FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")
def softmax_labels(spark, sf_dir):
    best = N.softmax_max(F.col("embedding").cast("array<double>"))
    return table(spark, sf_dir, "embeddings").select("vec_id", best.alias("b")).select("vec_id", "b.label", F.round("b.probability", 9).alias("probability"))


@query(f"WITH {CUES}, m AS (SELECT doc_id, pos, (pos % 12) || CASE WHEN pos % 3 = 0 THEN '' ELSE '.' || (pos % 3) END AS marker FROM cues) SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY string_split(marker, '.')[1]::INTEGER, coalesce(string_split(marker, '.')[2]::INTEGER, 0), pos) AS place FROM m")
def marker_order(spark, sf_dir):
    from pyspark.sql import Window as W

    marker = F.concat((F.col("pos") % 12).cast("string"), F.when(F.col("pos") % 3 == 0, "").otherwise(F.concat(F.lit("."), (F.col("pos") % 3).cast("string"))))
    rows = cue_rows(spark, sf_dir).withColumn("key", N.marker_key(marker))
    return rows.select("doc_id", "pos", F.row_number().over(W.partitionBy("doc_id").orderBy("key", "pos")).cast("long").alias("place"))


@query(r"SELECT doc_id, CASE WHEN length(text) <= 80 THEN text WHEN regexp_matches(substring(text, 80, 1), '[A-Za-z]') AND regexp_matches(substring(text, 81, 1), '[A-Za-z]') THEN regexp_replace(regexp_replace(substring(text, 1, 80), '(?s)^(.+) [^ ]*$', '\1'), '\s+$', '') ELSE regexp_replace(substring(text, 1, 80), '\s+$', '') END AS context FROM documents")
def context_cut(spark, sf_dir):
    """The context that goes with a request is at most so long; the cut is the feature."""
    return table(spark, sf_dir, "documents").select("doc_id", N.truncate_words(F.col("text"), 80).alias("context"))


@query(r"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}'']+') AS w FROM documents), g AS (SELECT doc_id, unnest(w) AS key FROM t UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM t) SELECT doc_id, key AS term, count(*) AS n FROM g WHERE key IN ('the', 'of the', 'in der', 'de la', 'one of the') GROUP BY 1, 2")
def glossary_phrases(spark, sf_dir):
    """glossary_hits with terms of several words, which the documents have."""
    terms = spark.createDataFrame([(x,) for x in ("the", "of the", "in der", "de la", "one of the")], "term string")
    return C.glossary_hits(table(spark, sf_dir, "documents"), terms)


@query(r"SELECT page_id, length(b)::INTEGER AS count, NOT (regexp_matches(b, '^[(\[{]*[)\]}]*$') AND length(regexp_replace(b, '[(\[{]', '', 'g')) * 2 = length(b)) AND d AS crossing FROM (SELECT page_id, b, list_sum(list_transform(string_split(b, ''), lambda c: CASE WHEN c IN ('(', '[', '{') THEN 1 ELSE -1 END)) <> 0 OR list_min(list_transform(range(1, length(b) + 1), lambda i: list_sum(list_transform(string_split(b[1:i], ''), lambda c: CASE WHEN c IN ('(', '[', '{') THEN 1 ELSE -1 END)))) < 0 AS d FROM (SELECT page_id, regexp_replace(html, '[^(){}\[\]]', '', 'g') AS b FROM pages) WHERE b <> '')")
def bracket_profiles(spark, sf_dir):
    plain = F.regexp_replace("html", r"[（）［］｛｝〔〕〖〗〘〙〚〛〈〉《》【】⟨⟩⟪⟫]", "")
    return table(spark, sf_dir, "pages").select("page_id", K.bracket_profile(plain).alias("b")).select("page_id", "b.count", "b.crossing").where(F.col("count") > 0)


@query(f"WITH {CUES}, f AS (SELECT doc_id, pos, text, regexp_matches(text, '[A-Za-z]') AND length(text) % 4 <> 0 AS can, regexp_matches(text, '[.!?]\\s*$') AS done FROM cues), g AS (SELECT *, last_value(CASE WHEN can THEN NOT done END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, bool_or(can) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM f) SELECT doc_id, pos FROM g WHERE can OR (coalesce(before, false) AND coalesce(after, false))")
def request_cues(spark, sf_dir):
    can = F.col("text").rlike("[A-Za-z]") & (F.length("text") % 4 != 0)
    return H.request_cues(cue_rows(spark, sf_dir), can, F.col("text").rlike(r"[.!?]\s*$")).select("doc_id", "pos")


# Texts, incidents and terms.


def translations(spark, sf_dir):
    """Cues with translations: some as the source, some blank, some missing."""
    n = F.col("pos") % 3
    return cue_rows(spark, sf_dir).withColumn("translation", F.when(n == 0, F.col("text")).when(n == 1, " "))


NOISE = r"[\s\p{P}\p{N}\p{S}\p{Cf}]"


@query(rf"WITH {CUES} SELECT doc_id, pos FROM cues WHERE regexp_matches(text, '[^\s\p{{P}}\p{{N}}\p{{S}}\p{{Cf}}]') AND pos % 3 <> 0")
def outstanding_cues(spark, sf_dir):
    return C.outstanding(translations(spark, sf_dir)).select("doc_id", "pos")


@query(rf"WITH {CUES}, p AS (SELECT doc_id, pos, length(regexp_replace(text, '[^\p{{L}}\p{{N}}_]', '', 'g')) AS n, length(regexp_replace(coalesce(lag(text) OVER (PARTITION BY doc_id ORDER BY pos), ''), '[^\p{{L}}\p{{N}}_]', '', 'g')) AS before FROM cues) SELECT doc_id, pos, before = 0 OR n / before BETWEEN 0.15 AND 6 AS plausible FROM p")
def plausible_lengths(spark, sf_dir):
    before = F.coalesce(F.lag("text").over(C.doc_order()), F.lit(""))
    return cue_rows(spark, sf_dir).select("doc_id", "pos", T.plausible_length(before, F.col("text")).alias("plausible"))


@query(rf"SELECT p_partkey, regexp_replace(p_name, '{NOISE}', '', 'g') = regexp_replace(p_type || ' 1!', '{NOISE}', '', 'g') OR p_partkey % 2 = 0 AND len(regexp_extract_all(p_name, '[\p{{L}}\p{{N}}_]+')) >= 2 AS same FROM part")
def same_but_noise(spark, sf_dir):
    other = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("- "), F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit("! 7"))).otherwise(F.concat("p_type", F.lit(" 1!")))
    return table(spark, sf_dir, "part").select("p_partkey", T.equal_but_noise(F.col("p_name"), other).alias("same"))


@query(f"WITH {CUES} SELECT doc_id, pos, pos % 5 = 0 OR regexp_matches(text, '[♩♪♫♬]') AS music FROM cues")
def music_flags(spark, sf_dir):
    text = F.when(F.col("pos") % 5 == 0, F.concat(F.lit("♪ "), F.col("text"))).otherwise(F.col("text"))
    return cue_rows(spark, sf_dir).select("doc_id", "pos", T.is_music(text).alias("music"))


ENDINGS = ("srt", "VTT", "ass", "zip", "mkv", "rar", "mp4", "xyz")


@query(f"SELECT p_partkey, CASE p_partkey % 8 WHEN 1 THEN 'vtt' WHEN 2 THEN 'ass' ELSE 'srt' END AS format, CASE WHEN p_partkey % 8 < 3 THEN 'subtitle' WHEN p_partkey % 8 = 3 THEN 'zip' WHEN p_partkey % 8 = 4 THEN 'matroska' WHEN p_partkey % 8 = 5 THEN 'archive' WHEN p_partkey % 8 = 6 THEN 'media' ELSE 'other' END AS kind, CASE WHEN p_partkey % 8 < 3 THEN p_name ELSE p_name || '.' || {list(ENDINGS)}[p_partkey % 8 + 1] END || '.de.srt' AS shown FROM part")
def file_kinds(spark, sf_dir):
    path = F.concat("p_name", F.lit("."), F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("p_partkey") % 8 + 1).cast("int")))
    name = T.output_name(path, F.lit("srt"), F.lit("en"), F.lit("de"))
    return table(spark, sf_dir, "part").select("p_partkey", T.file_format(path).alias("format"), T.file_kind(path).alias("kind"), name.alias("shown"))


@query("SELECT count(*) FILTER (event_type <> 'click' AND event_id % 4 <> 0 AND event_id % 3 = 0) AS active FROM events")
def active_incidents(spark, sf_dir):
    e = events(spark, sf_dir).select(
        F.when(F.col("event_type") == "click", "resolved").otherwise("monitoring").alias("status"), F.when(F.col("event_id") % 4 == 0, "maintenance").alias("kind"),
        F.when(F.col("event_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("u"))).alias("upstream_ids"),
    )
    return I.active_count(e, F.lit(True))


@query("SELECT p_brand AS provider, count(*) FILTER (p_size % 3 <> 0) AS incidents, CASE max(CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size > 30 THEN 2 ELSE 1 END) WHEN 2 THEN 'major_outage' WHEN 1 THEN 'degraded_performance' ELSE 'operational' END AS state FROM part GROUP BY 1")
def vendor_states(spark, sf_dir):
    i = F.struct(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_size") % 3 == 0, "resolved").otherwise("open").alias("status"), F.when(F.col("p_size") > 30, "major").otherwise("minor").alias("severity"))
    reports = table(spark, sf_dir, "part").select(F.col("p_brand").alias("provider"), F.array(i).alias("incidents"))
    return I.vendor_state(reports).select("provider", "incidents", "state")


@query("WITH k AS (SELECT DISTINCT user_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS k FROM events) SELECT DISTINCT user_id, ['investigating', 'identified', 'monitoring', 'resolved'][i] AS status FROM k, (SELECT unnest(range(1, 5)) AS i) WHERE i <= k")
def update_append(spark, sf_dir):
    status = F.when(F.col("event_type") == "click", "investigating").when(F.col("event_type") == "view", "identified").when(F.col("event_type") == "error", "monitoring").otherwise("resolved")
    return I.backfilled(events(spark, sf_dir).select(F.col("user_id").alias("incident_id"), status.alias("status"))).withColumnRenamed("incident_id", "user_id")


@query("SELECT user_id // 10 AS incident_id, count(*) AS updates, max(ts) AS updated_at, arg_max(event_type, ts) AS status FROM (SELECT DISTINCT ON (user_id // 10, ts, event_type) * FROM events) GROUP BY 1")
def legacy_adoption(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("title", F.col("user_id").cast("string"))
    i = e.groupBy(F.col("user_id").alias("incident_id"), "title").agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.max_by("event_type", "ts").alias("status"))
    u = e.select(F.col("user_id").alias("incident_id"), "ts", F.col("event_type").alias("body"))
    into = e.select(F.col("user_id").alias("incident_id"), F.floor(F.col("user_id") / 10).alias("new_id")).distinct()
    merged, updates = I.adopt_legacy(i, u, into)
    counts = updates.groupBy("incident_id").agg(F.count("*").alias("updates"))
    return merged.join(counts, "incident_id").select("incident_id", "updates", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "status")


@query("SELECT p_partkey FROM part WHERE p_size > 10 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48)")
def withdrawn_schedules(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    stored = p.select("p_partkey", F.col("p_brand").alias("incident_id"), F.lit("maintenance").alias("kind"), F.when(F.col("p_size") > 10, "monitoring").otherwise("resolved").alias("status"))
    return I.withdrawn(stored, p.where("p_size > 48").select(F.col("p_brand").alias("id")).distinct(), True).select("p_partkey")


@query("SELECT lower(p_name) AS key, p_brand AS type, count(*) AS n, max(p_size / 50) AS best FROM part WHERE p_size / 50 >= 0.5 GROUP BY 1, 2")
def candidate_tallies(spark, sf_dir):
    entities = table(spark, sf_dir, "part").select(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \t"))).alias("text"), F.col("p_brand").alias("type"), (F.col("p_size") / 50).alias("score"))
    return M.candidate_tally(entities).select("key", "type", "n", "best")


@query("SELECT p_type AS key, count(*) AS probes, count(*) FILTER (p_size > 25) AS entity_hits, count(*) FILTER (p_size <= 25) AS plain_hits FROM part GROUP BY 1")
def evidence_tallies(spark, sf_dir):
    return M.evidence(table(spark, sf_dir, "part").select(F.col("p_type").alias("key"), (F.col("p_size") > 25).alias("is_entity")))


@query("WITH t AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, CASE event_type WHEN 'click' THEN 'O' WHEN 'view' THEN 'PER' ELSE 'LOC' END AS label, value FROM events), r AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, label ORDER BY place) AS island FROM t) SELECT doc_id, label, min(place) AS first, max(place) AS last, round(avg(value), 6) AS score FROM r WHERE label <> 'O' GROUP BY doc_id, label, island")
def label_runs(spark, sf_dir):
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long").alias("at")
    label = F.when(F.col("event_type") == "click", "O").when(F.col("event_type") == "view", "PER").otherwise("LOC").alias("label")
    runs = M.label_runs(events(spark, sf_dir).select(F.col("user_id").alias("doc_id"), at, label, F.col("value").alias("prob")))
    return runs.select("doc_id", "label", "first", "last", F.round("score", 6).alias("score"))


@query(r"SELECT source, round(avg(regexp_matches(regexp_extract(text, '\p{L}'), '\p{Lu}')::INTEGER), 9) AS share, avg((upper(text) = text)::INTEGER) > 0.5 AS shouted FROM documents WHERE regexp_matches(text, '\p{L}') GROUP BY 1")
def capitalised_shares(spark, sf_dir):
    return M.capitalised_share(table(spark, sf_dir, "documents")).select("source", F.round("share", 9).alias("share"), "shouted")


@query(f"WITH {CUES}, b AS (SELECT doc_id, pos, start_ms - (pos % 2) * 9000 AS s, CASE WHEN pos % 3 <> 0 THEN 50 * length(text) END AS d FROM cues), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, pos) - 1 AS place, lead(s) OVER (PARTITION BY doc_id ORDER BY s, pos) AS next FROM b) SELECT doc_id, place AS pos, s AS start_ms, greatest(s + 1, coalesce(s + d, least(s + 2000, coalesce(next, s + 2000)))) AS end_ms FROM o")
def track_documents(spark, sf_dir):
    blocks = cue_rows(spark, sf_dir).select("doc_id", "pos", (F.col("start_ms") - F.col("pos") % 2 * 9000).alias("start_ms"), F.when(F.col("pos") % 3 != 0, 50 * F.length("text")).alias("duration_ms"), "text")
    return C.track_document(blocks).select("doc_id", F.col("pos").cast("long").alias("pos"), "start_ms", "end_ms")


@query("SELECT page_id, length(replace(html, chr(10), chr(10) || 'x')) AS chars FROM pages")
def normalised_newlines(spark, sf_dir):
    mixed = F.concat(F.lit("﻿"), F.replace("html", F.lit("\n"), F.lit("\r\n")))
    return table(spark, sf_dir, "pages").select("page_id", F.length(F.replace(T.normalise_newlines(mixed), F.lit("\n"), F.lit("\nx"))).cast("long").alias("chars"))


@query(f"WITH {CUES} SELECT doc_id, pos, 8 AS corner, text FROM cues")
def alignment_tags(spark, sf_dir):
    tagged = F.concat(F.lit("{\\an8}"), "text")
    return cue_rows(spark, sf_dir).select("doc_id", "pos", T.alignment(tagged).alias("corner"), T.strip_alignment(tagged).alias("text"))


@query(r"SELECT DISTINCT lang || '-' || upper(source) AS tag, lower(regexp_extract(lang, '^([A-Za-z]{2,3})', 1)) AS base FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def language_tags(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    tag = F.concat("lang", F.lit("-"), F.upper("source"))
    return d.select(tag.alias("tag"), T.base_language(tag).alias("base")).distinct()


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 1 WHEN p_size % 5 <= 2 THEN p_size % 5 END AS version FROM part")
def schema_gate(spark, sf_dir):
    from tidemark.sources.records import readable_version

    return table(spark, sf_dir, "part").select("p_partkey", readable_version(F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 5)).alias("version"))


@query("SELECT page_id, sha256(html) AS digest FROM pages")
def html_round_trip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.html_unescape(T.html_escape(F.col("html"))), 256).alias("digest"))


@query(rf"WITH {CUES} SELECT doc_id, pos, CASE WHEN pos % 2 = 0 THEN upper(kind) ELSE nullif(regexp_extract(text, '^\s*[-–—]?\s*(\p{{Lu}}[\p{{Lu}}\d.''’-]*(?: \p{{Lu}}[\p{{Lu}}\d.''’-]*){{0,2}}):', 1), '') END AS label FROM cues")
def speaker_labels(spark, sf_dir):
    text = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("- "), F.upper("kind"), F.lit(": "), F.col("text"))).otherwise(F.col("text"))
    return cue_rows(spark, sf_dir).select("doc_id", "pos", T.speaker_label(text).alias("label"))


@query(f"WITH {CUES}, n AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM cues) SELECT doc_id, pos FROM n WHERE n <= 3 OR i = 0 OR i * 3 // n <> (i - 1) * 3 // n")
def spread_rows(spark, sf_dir):
    """spread_samples with SQL."""
    return C.spread_sample(cue_rows(spark, sf_dir), 3).select("doc_id", "pos")


@query(f"WITH {SCENES} SELECT a.doc_id, a.pos FROM scened a JOIN scened b ON a.doc_id = b.doc_id AND b.pos = 3 AND a.scene = b.scene AND a.pos < 3")
def resume_rows(spark, sf_dir):
    scened = C.scenes(cue_rows(spark, sf_dir), 2)
    return C.resume_context(scened, scened.where("pos = 3").select("doc_id", "pos")).select("doc_id", "pos")


@query(f"WITH {CUES} SELECT doc_id, pos, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM cues")
def marker_strip(spark, sf_dir):
    marked = F.concat(F.lit("⟦c1⟧ "), "text", F.lit("⟦/c1⟧"))
    return cue_rows(spark, sf_dir).select("doc_id", "pos", K.strip_markers(marked).alias("text"))
