"""Records that services send or keep: event lines, requests, feeds, schedules, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = "type string, message string, code int, data struct<cues:array<struct<id:int,translation:string,is_music:boolean>>,resolved_source_lang:string,provider:string>"
REQUEST = (
    "cues array<struct<id:double,start_ms:double,end_ms:double,text:string>>, glossary map<string,string>, source string, target string, provider string, "
    "sceneChangeSeconds double, caseSensitiveTerms boolean, contextText string, contextNeedsTranslation boolean"
)
MOST_CUES, MOST_TERMS, MOST_TERM_CHARS = 20_000, 500, 200
SCHEMA_VERSION = 2


def parse_events(lines: DataFrame) -> DataFrame:
    """Event lines (value) as structs; lines that are no JSON, or have no type, are left out."""
    return lines.select(F.from_json("value", EVENT).alias("e")).where("e.type IS NOT NULL").select("e.*")


def parse_requests(lines: DataFrame) -> DataFrame:
    """Requests with `problem`: null where the request is valid. A glossary beyond its bounds counts as empty."""
    r = lines.select("request_id", F.from_json("value", REQUEST).alias("r")).select("request_id", "r.*")
    bad_cue = F.exists("cues", lambda c: c["id"].isNull() | c["start_ms"].isNull() | c["end_ms"].isNull() | c["text"].isNull())
    long_term = F.exists(F.map_entries("glossary"), lambda x: (F.length(x["key"]) > MOST_TERM_CHARS) | (F.length(x["value"]) > MOST_TERM_CHARS))
    problem = (
        F.when(F.col("cues").isNull() | (F.size("cues") == 0), "no cues")
        .when(F.size("cues") > MOST_CUES, "too many cues")
        .when(bad_cue, "bad cue")
        .when(F.coalesce(F.nullif("source", F.lit("")), F.nullif("target", F.lit(""))).isNull() | F.nullif("target", F.lit("")).isNull() | F.nullif("source", F.lit("")).isNull(), "no language")
    )
    empty = F.create_map().cast("map<string,string>")
    kept = F.when(F.col("glossary").isNull() | (F.size("glossary") > MOST_TERMS) | long_term, empty).otherwise(F.col("glossary"))
    return r.withColumn("glossary", kept).withColumn("problem", problem)


def parse_schedule(lines: DataFrame) -> DataFrame:
    """Maintenance rows of a Markdown table; headings, rules, short rows and rows without good dates are left out."""
    cells = F.transform(F.split(F.regexp_replace(F.btrim("value"), r"^\||\|$", ""), r"\|"), lambda x: F.btrim(x))
    c = lambda i: F.get("cells", F.lit(i))
    rows = lines.withColumn("cells", cells).where(F.btrim("value").startswith("|") & (F.size("cells") >= 7))
    rows = rows.select(
        c(0).alias("id"), c(1).alias("component_id"), c(2).alias("title"), F.try_to_timestamp(c(3)).alias("start_utc"), F.try_to_timestamp(c(4)).alias("end_utc"),
        F.when(c(5).isin("minor", "major", "critical"), c(5)).otherwise("minor").alias("severity"), c(6).alias("description"),
    )
    return rows.where("start_utc IS NOT NULL AND end_utc IS NOT NULL")


def parse_feed(documents: DataFrame) -> DataFrame:
    """doc_id, title, link, published, summary of each item or entry of RSS and Atom texts."""
    items = documents.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), 1)).alias("pos", "item"))
    tag = lambda *names: F.coalesce(*(F.nullif(F.btrim(F.regexp_replace(F.regexp_extract("item", rf"(?is)<{n}\b[^>]*>(.*?)</{n}>", 1), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")), F.lit("")) for n in names))
    from tidemark.functions.text import html_unescape

    when = tag("pubDate", "published", "updated")
    time = F.coalesce(F.try_to_timestamp(when), F.try_to_timestamp(F.regexp_replace(when, r"^\w{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss z")))
    return items.select("doc_id", "pos", html_unescape(tag("title")).alias("title"), tag("link", "id").alias("link"), time.alias("published"), html_unescape(tag("description", "summary", "content")).alias("summary"))


def head_and_body(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A history job (id, created_at, updated_at, schema, title, subtitles array<struct<name, cues array>>) as two tables."""
    cues = F.aggregate("subtitles", F.lit(0), lambda a, s: a + F.size(s["cues"]))
    head = jobs.select("id", "created_at", "updated_at", "schema", "title", cues.alias("cue_count"), F.transform("subtitles", lambda s: s["name"]).alias("files"))
    return head, jobs.select("id", "subtitles")


def readable_version(schema: Column) -> Column:
    """Absent means 1; a version beyond the current one cannot be read."""
    version = F.coalesce(schema, F.lit(1))
    return F.when(version <= SCHEMA_VERSION, version)
