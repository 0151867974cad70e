"""Cue rows from subtitle texts (SRT, VTT, ASS), in DataFrame functions.

Input: doc_id, text. Output: doc_id, pos (from 0), id (1..n), start_ms, end_ms, text, and layout columns. Blocks are
exploded, so a document is read by many expressions but in one task; rows carry pos, as order is part of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.clock import ass_to_ms, to_ms

SRT_TIME = r"(\d{2}:\d{2}:\d{2}[,.]\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}[,.]\d{3})"
VTT_TIME = r"((?:\d{2}:)?\d{2}:\d{2}\.\d{3})\s*-->\s*((?:\d{2}:)?\d{2}:\d{2}\.\d{3})[ \t]*([^\n]*)"
#: What content must have for a format's parser to run.
CONTENT = {
    "srt": r"\d{2}:\d{2}:\d{2}[,. ]\d{3}\s*-->\s*\d{2}:\d{2}:\d{2}",
    "vtt": r"(?i)^WEBVTT|\d{2}:\d{2}:\d{2}[,. ]\d{3}\s*-->\s*\d{2}:\d{2}:\d{2}",
    "ass": r"(?i)\[Script Info\]|\[Events\]|Dialogue:",
}
LAYOUT = ["top_align", "cue_settings", "identifier", "header", "leading_blocks", "trailing_blocks"]


def valid_content(text: Column, fmt: str) -> Column:
    return F.btrim(T.normalise_newlines(text)).rlike(CONTENT[fmt])


def _blocks(docs: DataFrame) -> DataFrame:
    text = F.btrim(T.normalise_newlines(F.col("text")), F.lit(" \n\t"))
    return docs.select("doc_id", F.posexplode(F.split(text, r"\n\s*\n")).alias("block_no", "block"))


def _numbered(cues: DataFrame, order: str) -> DataFrame:
    id_ = F.row_number().over(W.partitionBy("doc_id").orderBy(order))
    return cues.withColumn("id", id_).withColumn("pos", F.col("id") - 1)


def parse_srt(docs: DataFrame) -> DataFrame:
    """The time line is the first or second line of a block; cues without text are dropped and ids close up."""
    lines = F.split(F.regexp_replace("block", r"^\n+|\n+$", ""), "\n")
    rows = _blocks(docs).withColumn("lines", lines)
    first, second = F.get("lines", F.lit(0)), F.get("lines", F.lit(1))
    at = F.when(first.rlike(SRT_TIME), 0).when(second.rlike(SRT_TIME), 1)
    rows = rows.withColumn("at", at).where("at IS NOT NULL").withColumn("time", F.get("lines", F.col("at")))
    raw = F.array_join(F.slice("lines", F.col("at") + 2, F.greatest(F.lit(0), F.size("lines") - F.col("at") - 1)), "\n")
    rows = rows.withColumn("raw", raw).withColumn("text", T.tidy_lines(T.strip_alignment(F.col("raw")))).where("text <> ''")
    return _numbered(rows, "block_no").select(
        "doc_id", "pos", "id", to_ms(F.regexp_extract("time", SRT_TIME, 1)).alias("start_ms"), to_ms(F.regexp_extract("time", SRT_TIME, 2)).alias("end_ms"), "text", T.alignment(F.col("raw")).alias("top_align")
    )


def _carry(rows: DataFrame, is_cue: str, block: str, order: str) -> DataFrame:
    """Cue rows with what stands between cues: leading_blocks before each, trailing_blocks after the last."""
    doc = W.partitionBy("doc_id")
    upto = doc.orderBy(order)
    rows = rows.withColumn("__group", F.coalesce(F.sum(F.col(is_cue).cast("int")).over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("__cues", F.sum(F.col(is_cue).cast("int")).over(doc))
    between = F.collect_list(F.when(~F.col(is_cue), F.col(block)))
    group = W.partitionBy("doc_id", "__group").orderBy(order)
    rows = rows.withColumn("leading_blocks", between.over(group.rowsBetween(W.unboundedPreceding, -1)))
    last = rows.where(F.col("__group") == F.col("__cues")).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(order, block))), lambda x: x[block]).alias("__tail"))
    cues = rows.where(F.col(is_cue)).join(last, "doc_id", "left")
    ending = F.col("__group") + 1 == F.col("__cues")
    return cues.withColumn("trailing_blocks", F.when(ending, F.coalesce("__tail", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))).drop("__group", "__cues", "__tail")


def parse_vtt(docs: DataFrame) -> DataFrame:
    """Header, identifiers and settings are kept; NOTE and STYLE blocks go with the cue that follows."""
    rows = _blocks(docs)
    first = F.col("block_no") == 0
    headed = first & F.ltrim("block").startswith("WEBVTT")
    head = F.regexp_extract("block", r"(?s)^(WEBVTT.*?)(?:\n(?=[^\n]*-->)|$)", 1)
    rows = rows.withColumn("header", F.when(headed, head)).withColumn("block", F.when(headed, F.expr("substring(block, length(header) + 2)")).otherwise(F.col("block")))
    rows = rows.withColumn("header", F.max("header").over(W.partitionBy("doc_id"))).where(F.btrim("block") != "")
    rows = rows.withColumn("timed", F.col("block").rlike(VTT_TIME))
    raw = F.regexp_extract("block", rf"(?s)^(.*?)(?:[^\n]*){VTT_TIME}\n?(.*)$", 5)
    rows = rows.withColumn("raw", F.when(F.col("timed"), raw)).withColumn("text2", T.tidy_lines(T.strip_alignment(F.col("raw"))))
    rows = rows.where(~F.col("timed") | (F.col("text2") != "")).withColumn("block", F.btrim("block"))
    cues = _carry(rows, "timed", "block", "block_no")
    part = lambda i: F.regexp_extract("block", VTT_TIME, i)
    before = F.btrim(F.regexp_extract("block", rf"(?s)^(.*?)\n?[^\n]*?{VTT_TIME}", 1))
    numbered = _numbered(cues, "block_no")
    return numbered.select(
        "doc_id", "pos", "id", to_ms(part(1)).alias("start_ms"), to_ms(part(2)).alias("end_ms"), F.col("text2").alias("text"), T.alignment(F.col("raw")).alias("top_align"),
        F.nullif(F.btrim(part(3)), F.lit("")).alias("cue_settings"), F.nullif(before, F.lit("")).alias("identifier"), F.when(F.col("pos") == 0, F.coalesce("header", F.lit("WEBVTT"))).alias("header"), "leading_blocks", "trailing_blocks",
    )


def parse_ass(docs: DataFrame) -> DataFrame:
    """Ten fields of Dialogue lines, the text with its commas; other lines, and drawings, are carried along."""
    lines = docs.select("doc_id", F.posexplode(F.split(T.normalise_newlines(F.col("text")), "\n")).alias("line_no", "line"))
    fields = F.split(F.btrim(F.expr("substring(line, 10)")), ",", 10)
    rows = lines.withColumn("dialogue", F.col("line").startswith("Dialogue:")).withColumn("f", F.when(F.col("dialogue"), fields))
    raw = F.coalesce(F.get("f", F.lit(9)), F.lit(""))
    plain = F.replace(F.regexp_replace(F.regexp_replace(raw, T.OVERRIDE, ""), r"\\[Nn]", "\n"), F.lit("\\h"), F.lit(" "))
    rows = rows.withColumn("text", T.tidy_lines(plain)).withColumn("raw", raw)
    rows = rows.withColumn("is_cue", F.coalesce(F.col("dialogue") & (F.col("text") != "") & ~F.col("raw").rlike(r"\{[^}]*\\p[1-9]"), F.lit(False)))
    begun = F.max(F.col("dialogue").cast("int")).over(W.partitionBy("doc_id").orderBy("line_no")) == 1
    rows = rows.withColumn("begun", begun)
    heads = rows.where(~F.col("begun")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("h"))
    heads = heads.select("doc_id", F.rtrim(F.array_join(F.transform("h", lambda x: x["line"]), "\n")).alias("head"))
    cues = _numbered(_carry(rows.where("begun"), "is_cue", "line", "line_no"), "line_no").join(heads, "doc_id", "left")
    settings = F.array_join(F.transform(F.array(*(F.get("f", F.lit(i)) for i in (0, 3, 4, 5, 6, 7, 8))), lambda x: F.btrim(x)), "|")
    corner = T.alignment(F.col("raw"))
    tags = F.regexp_extract_all("raw", F.lit(r"\{([^}]*)\}"), 1)
    return cues.select(
        "doc_id", "pos", "id", ass_to_ms(F.get("f", F.lit(1))).alias("start_ms"), ass_to_ms(F.get("f", F.lit(2))).alias("end_ms"), "text", corner.alias("top_align"),
        settings.alias("cue_settings"), tags.alias("ass_tags"), F.when(F.col("pos") == 0, F.nullif("head", F.lit(""))).alias("header"), "leading_blocks", "trailing_blocks",
    )


PARSERS = {"srt": parse_srt, "vtt": parse_vtt, "ass": parse_ass}


def parse(docs: DataFrame) -> DataFrame:
    """docs (doc_id, format, text) by their formats; texts without the marks of their format give no cues."""
    out = None
    for fmt, parser in PARSERS.items():
        own = docs.where((F.col("format") == fmt) & valid_content(F.col("text"), fmt))
        cues = parser(own).withColumn("format", F.lit(fmt))
        out = cues if out is None else out.unionByName(cues, allowMissingColumns=True)
    return out
