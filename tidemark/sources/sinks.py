"""Subtitle texts, event lines and archives from cue rows."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clock import ass_time, srt_time, vtt_time

SECRET = r"(?i)(?:bearer\s+[a-z0-9._-]{16,}|(?:api[_-]?key|token|secret)[\"'=:\s]+[a-z0-9._-]{16,})"


def shown_text(mode: str, stacking: str = "translation_top") -> Column:
    """The text of a cue: its translation if there is one, or both in a bilingual file."""
    translation = F.nullif(F.btrim(F.coalesce("translation", F.lit(""))), F.lit(""))
    source = F.col("text")
    if mode != "bilingual":
        return F.coalesce(translation, source)
    flat = F.regexp_replace(source, r"\s*\n\s*", " ")
    both = F.concat_ws("\n", flat, translation) if stacking == "original_top" else F.concat_ws("\n", translation, flat)
    return F.when(translation.isNull(), source).otherwise(both)


def _joined(rows: DataFrame, block: Column, separator: str) -> DataFrame:
    """doc_id, body: a document's blocks in order. A document is gathered in one row, as a file is."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", block.alias("block"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), separator).alias("body"))


def render_srt(cues: DataFrame, mode: str = "monolingual", stacking: str = "translation_top") -> DataFrame:
    """doc_id, content from doc_id, pos, start_ms, end_ms, text, translation, top_align; cues are numbered 1..n."""
    from pyspark.sql import Window as W

    tag = F.when(F.col("top_align").isNotNull(), F.concat(F.lit("{\\an"), F.col("top_align").cast("string"), F.lit("}"))).otherwise("")
    rows = cues.withColumn("__n", F.row_number().over(W.partitionBy("doc_id").orderBy("pos")))
    block = F.concat(F.col("__n").cast("string"), F.lit("\n"), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms")), F.lit("\n"), tag, shown_text(mode, stacking))
    return _joined(rows, block, "\n\n").select("doc_id", F.concat("body", F.lit("\n")).alias("content"))


def render_vtt(cues: DataFrame, mode: str = "monolingual", stacking: str = "translation_top") -> DataFrame:
    """Also with header, identifier, cue_settings, leading_blocks and trailing_blocks, where there are such columns."""
    have = set(cues.columns)
    get = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    rows = cues.select("doc_id", "pos", "start_ms", "end_ms", "text", get("translation", "string").alias("translation"), *(get(n, k).alias(n) for n, k in (("header", "string"), ("identifier", "string"), ("cue_settings", "string"), ("leading_blocks", "array<string>"), ("trailing_blocks", "array<string>"))))
    settings = F.when(F.col("cue_settings").isNotNull() & ~F.col("cue_settings").contains("|"), F.concat(F.lit(" "), F.btrim("cue_settings"))).otherwise("")
    cue = F.concat(F.coalesce(F.concat("identifier", F.lit("\n")), F.lit("")), vtt_time(F.col("start_ms")), F.lit(" --> "), vtt_time(F.col("end_ms")), settings, F.lit("\n"), shown_text(mode, stacking))
    lead = F.when(F.size("leading_blocks") > 0, F.array_join("leading_blocks", "\n\n"))
    tail = F.when(F.size("trailing_blocks") > 0, F.array_join("trailing_blocks", "\n\n"))
    body = _joined(rows, F.concat_ws("\n\n", lead, cue, tail), "\n\n")
    head = rows.groupBy("doc_id").agg(F.coalesce(F.max("header"), F.lit("WEBVTT")).alias("head"))
    return body.join(head, "doc_id").select("doc_id", F.concat("head", F.lit("\n\n"), "body", F.lit("\n")).alias("content"))


def render_ass(cues: DataFrame, mode: str = "monolingual", stacking: str = "translation_top", header: str | None = None) -> DataFrame:
    """Dialogue lines after the document's own header, or after a plain one."""
    plain = header or "[Script Info]\nScriptType: v4.00+\nPlayResX: 384\nPlayResY: 288\n\n[V4+ Styles]\nFormat: Name, Fontname, Fontsize\nStyle: Default,Arial,16\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"
    have = set(cues.columns)
    own = F.col("header") if "header" in have else F.lit(None).cast("string")
    given = F.split("cue_settings", r"\|") if "cue_settings" in have else F.lit(None).cast("array<string>")
    field = lambda i, usual: F.coalesce(F.get(given, F.lit(i)), F.lit(usual))
    tag = F.when(F.col("top_align").isNotNull(), F.concat(F.lit("{\\an"), F.col("top_align").cast("string"), F.lit("}"))).otherwise("") if "top_align" in have else F.lit("")
    text = F.replace(shown_text(mode, stacking), F.lit("\n"), F.lit("\\N"))
    line = F.concat(F.lit("Dialogue: "), F.concat_ws(",", field(0, "0"), ass_time(F.col("start_ms")), ass_time(F.col("end_ms")), field(1, "Default"), field(2, ""), field(3, "0"), field(4, "0"), field(5, "0"), field(6, ""), F.concat(tag, text)))
    body = _joined(cues, line, "\n")
    heads = cues.groupBy("doc_id").agg(F.coalesce(F.max(own), F.lit(plain)).alias("head"))
    return body.join(heads, "doc_id").select("doc_id", F.concat("head", F.lit("\n"), "body", F.lit("\n")).alias("content"))


RENDERERS = {"srt": render_srt, "vtt": render_vtt, "ass": render_ass}


def encode(texts: DataFrame) -> DataFrame:
    """content as bytes in the source's newline style, mark and encoding; other encodings become UTF-8 with LF."""
    utf = F.col("encoding").isin("utf-8", "utf-16-le", "utf-16-be")
    lines = F.when(utf & (F.col("newline") == "crlf"), F.replace("content", F.lit("\n"), F.lit("\r\n"))).when(utf & (F.col("newline") == "cr"), F.replace("content", F.lit("\n"), F.lit("\r"))).otherwise(F.col("content"))
    marked = F.when(utf & F.col("bom"), F.concat(F.lit("﻿"), lines)).otherwise(lines)
    out = F.when(F.col("encoding") == "utf-16-le", F.encode(marked, "UTF-16LE")).when(F.col("encoding") == "utf-16-be", F.encode(marked, "UTF-16BE")).otherwise(F.encode(marked, "UTF-8"))
    return texts.withColumn("content", out)


def event_lines(events: DataFrame) -> DataFrame:
    """One JSON line for each row of events; a line that shows a secret is replaced."""
    line = F.to_json(F.struct(*events.columns))
    return events.select(F.when(line.rlike(SECRET), F.lit('{"type":"error","code":1500}')).otherwise(line).alias("value"))


def zip_files(files: DataFrame) -> DataFrame:
    """archive, content: the files (archive, name, content) of each archive, deflated."""

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as archive:
            for name, content in sorted(zip(group["name"], group["content"], strict=True)):
                archive.writestr(zipfile.ZipInfo(name), bytes(content), zipfile.ZIP_DEFLATED, 9)
        return pd.DataFrame({"archive": [key[0]], "content": [out.getvalue()]})

    return files.select("archive", "name", "content").groupBy("archive").applyInPandas(pack, "archive string, content binary")
