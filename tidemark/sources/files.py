"""Files as rows: directories and zip archives of subtitles, with their text decoded.

Bytes arrive by Spark's binaryFile source. Spark decodes only ASCII, Latin-1 and UTF, so legacy encodings and zip
archives are read by pandas UDFs on batches; everything else is columns.
"""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import file_format, file_kind, newline_style

MOST_DEPTH = 10
#: Legacy encodings, in the order in which they are tried, and what their texts commonly have.
MULTIBYTE = ("gb18030", "big5", "shift_jis", "euc_kr")
SINGLE_BYTE = ("cp1252", "cp1251", "cp1250", "cp1253", "cp1254", "cp1255", "cp1256")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; in local mode one of its own if that is
    unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{found.rstrip('/')}/files/{uuid.uuid4().hex}"


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, kind, depth, content of the files below a directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", name.alias("name"), file_kind(name).alias("kind"), F.col("content"))


def unzip(files: DataFrame) -> DataFrame:
    """path, name, content of the subtitles in zip files; folders, other files and entries deeper than ten are left out."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for item in archive.infolist():
                    if not item.is_dir() and item.filename.count("/") <= MOST_DEPTH and item.filename.lower().rsplit(".", 1)[-1] in ("srt", "vtt", "ass", "ssa"):
                        out.append((path, item.filename, archive.read(item)))
            yield pd.DataFrame(out, columns=["path", "name", "content"])

    return files.where("kind = 'zip'").select("path", "content").mapInPandas(entries, "path string, name string, content binary")


def decode_bytes(content: bytes) -> tuple[str, str, bool]:
    """(text, encoding, byte order mark): by mark, zero bytes, strict UTF-8, then the likeliest legacy encoding."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace"), name, True
    head = content[:4096]
    if head:
        even, odd = head[0::2].count(0) * 2 / len(head), head[1::2].count(0) * 2 / len(head)
        if max(even, odd) > 0.3:
            name = "utf-16-le" if odd > even else "utf-16-be"
            return content.decode(name, "replace"), name, False
    try:
        return content.decode("utf-8"), "utf-8", False
    except UnicodeDecodeError:
        pass
    best, text = max(((_likely(content, name), name) for name in MULTIBYTE), key=lambda x: x[0]), None
    name = best[1] if best[0] >= 0.1 else max(SINGLE_BYTE, key=lambda x: _plain(content, x))
    text = content.decode(name, "replace")
    return text, name, False


#: Lead bytes of each encoding's common characters (the frequent half of its table, and kana).
COMMON_LEADS = {"gb18030": ((0xB0, 0xD7),), "big5": ((0xA4, 0xC6),), "shift_jis": ((0x82, 0x83), (0x88, 0x97)), "euc_kr": ((0xB0, 0xC8),)}


def _likely(content: bytes, name: str) -> float:
    """Share of the encoding's common characters, less five times that of implausible ones."""
    try:
        text = content.decode(name)
    except UnicodeDecodeError:
        return -1.0
    wide = [c for c in text if ord(c) > 127]
    if not wide:
        return 0.0
    encoded = [c.encode(name) for c in wide]
    good = sum(any(low <= x[0] <= high for low, high in COMMON_LEADS[name]) and (name != "gb18030" or x[1] >= 0xA1) for x in encoded)
    bad = sum("\ue000" <= c <= "\uf8ff" or "\uff61" <= c <= "\uff9f" for c in wide)
    return (good - 5 * bad) / len(wide)


def _plain(content: bytes, name: str) -> float:
    """Share of letters among the characters beyond ASCII, whole words of one script counting double."""
    text = content.decode(name, "replace")
    wide = [c for c in text if ord(c) > 127]
    return sum(c.isalpha() for c in wide) / max(1, len(wide)) - (0.01 * SINGLE_BYTE.index(name))


def decode(files: DataFrame) -> DataFrame:
    """files with text, encoding, bom, newline and format; binary content (control bytes at the beginning) is left out."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([decode_bytes(bytes(x)) for x in batch], columns=["text", "encoding", "bom"])

    marked = F.hex(F.substring("content", 1, 2)).isin("FFFE", "FEFF")
    control = F.hex(F.substring("content", 1, 4096)).rlike(r"^(?:..)*?(?:0[0-8BEF]|1[0-9A-F])")
    wide = F.hex(F.substring("content", 1, 64)).rlike(r"^(?:00..|..00){4}")
    rows = files.where(marked | wide | ~control).withColumn("__d", F.pandas_udf(run, "text string, encoding string, bom boolean")(F.col("content")))
    return rows.select(*[c for c in files.columns if c != "content"], "__d.*").withColumns({"newline": newline_style(F.col("text")), "format": file_format(F.col("name"))})
