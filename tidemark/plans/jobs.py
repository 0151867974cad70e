"""Registered queries on jobs that are taken up again, and on streams with state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import SCENES, cue_rows, query, table
from tidemark.operators import cues as C
from tidemark.operators import related
from tidemark.operators import resuming as R
from tidemark.sources.files import shared_folder
from tidemark.streaming import jobs

# Conversations are short, so two rows of a scene and three of a sentence stand for two hundred and eight. Done is what
# comes first, and texts of every third length; an odd length stands for a sentence that goes on.
OPEN = r"regexp_matches(text, '[^\s\p{P}\p{N}\p{S}\p{Cf}]') AND NOT (pos < 3 OR length(text) % 3 = 0)"
RESUME = f"{SCENES}, placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, coalesce({OPEN}, false) AS is_open, length(text) % 2 = 1 AS goes_on FROM scened), begun AS (SELECT *, min(CASE WHEN is_open THEN n END) OVER (PARTITION BY doc_id) AS first_n FROM placed), headed AS (SELECT *, max(CASE WHEN n = first_n THEN scene END) OVER (PARTITION BY doc_id) AS first_scene FROM begun), back AS (SELECT *, count(*) FILTER (n < first_n AND scene = first_scene) OVER (PARTITION BY doc_id) AS earlier, greatest(first_n - 3, max(CASE WHEN n <= first_n AND (n = 1 OR NOT coalesce(goes_on, false)) THEN n END) OVER (PARTITION BY doc_id)) AS start_n FROM headed)"


def scened(spark, sf_dir):
    return C.scenes(cue_rows(spark, sf_dir), 2)


def done(cues):
    return cues.where((F.col("pos") < 3) | (F.length("text") % 3 == 0)).select("doc_id", "pos", F.lit("done").alias("translation"))


@query(f"WITH {RESUME} SELECT doc_id, pos, CASE WHEN n < first_n THEN 'context' ELSE 'open' END AS role FROM back WHERE n >= first_n AND is_open OR n < first_n AND CASE WHEN earlier < 2 THEN scene = first_scene ELSE n >= start_n END")
def resume_rows(spark, sf_dir):
    cues = scened(spark, sf_dir)
    return R.resume_rows(cues, done(cues), F.length("text") % 2 == 1, most_scene=2, most_sentence=3).select("doc_id", "pos", "role")


@query()
def retry_chunks(spark, sf_dir):
    """Chunks of a second round; tests hold their cuts against every place."""
    cues = scened(spark, sf_dir)
    return R.retry_round(cues, done(cues), 2).select("doc_id", "pos", "chunk")


@query("SELECT conv_id::VARCHAR AS doc_id, turn AS cue, left(coalesce(text, ''), length(coalesce(text, '')) // 2) || chr(10) || substr(coalesce(text, ''), length(coalesce(text, '')) // 2 + 1) AS text, true AS complete FROM conversations")
def streamed_cues(spark, sf_dir):
    """Halves of turns, the second ones first and all of them twice, as a stream: each cue comes once."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    parts = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("long").alias("cue"), F.posexplode(F.array(F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text)))).alias("part", "text"),
        F.lit(2).alias("parts"), F.timestamp_seconds(1_704_067_200 + F.col("turn")).alias("ts"),
    )
    folder = shared_folder(spark)
    for kept in ("part = 1", "part = 0", "true"):
        parts.where(kept).write.mode("append").parquet(f"{folder}/in")
    stream = jobs.merged_cues(spark.readStream.schema(parts.schema).parquet(f"{folder}/in"), late="1 day")
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("doc_id string, cue long, text string, complete boolean").parquet(f"{folder}/out")


RELATED = "t AS (SELECT lower(p_name) AS k FROM part UNION SELECT lower(split_part(p_name, ' ', 1)) FROM part), p AS (SELECT a.k AS i, b.k AS o FROM t a JOIN t b ON a.k <> b.k AND contains(' ' || b.k || ' ', ' ' || a.k || ' ')), e AS (SELECT i AS x, o AS y FROM p UNION SELECT o, i FROM p), r AS (SELECT k AS x, k AS y FROM t UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), c AS (SELECT x AS key, min(y) AS root FROM r GROUP BY 1)"


@query(f"WITH RECURSIVE {RELATED} SELECT key, first_value(key) OVER (PARTITION BY root ORDER BY length(key) DESC, key) AS cluster FROM c")
def related_terms(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("term"))
    heads = names.select(F.get(F.split("term", " "), F.lit(0)).alias("term"))
    return related.related_terms(names.union(heads).distinct()).select("key", "cluster").distinct()
