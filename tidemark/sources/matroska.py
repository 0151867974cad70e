"""Subtitle tracks of Matroska and WebM files: a data source for Spark, and the documents of its tracks.

    spark.dataSource.register(matroska.Matroska)
    blocks = spark.read.format("matroska").load(folder)
    tracks = spark.read.format("matroska").option("rows", "tracks").load(folder)
    matroska.documents(blocks, tracks)

The driver lists files and cuts large ones into byte ranges by their sizes alone; it opens none. Each task reads the head
of its files, moves both ends of its range to starts of clusters and reads what begins between them. The end of one range
and the start of the next are moved by the same rule from the same number, so every cluster is read once. Blocks of tracks
that are not wanted are passed over by their sizes. File systems are those that Arrow knows: local and mounted folders,
HDFS and the object stores.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType

from tidemark.functions.clock import ass_time, srt_time, vtt_time
from tidemark.functions.text import normalise_newlines
from tidemark.sources import ebml
from tidemark.sources.ebml import Element, Window, element, number, unsigned

# Ids of elements, as in RFC 9559.
EBML, SEGMENT = 0x1A45DFA3, 0x18538067
SEEK_HEAD, SEEK, SEEK_ID, SEEK_POSITION = 0x114D9B74, 0x4DBB, 0x53AB, 0x53AC
INFO, TICK_NANOSECONDS = 0x1549A966, 0x2AD7B1
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83
FLAG_DEFAULT, FLAG_FORCED, FLAG_HEARING = 0x88, 0x55AA, 0x55AB
CODEC, CODEC_PRIVATE, NAME, LANGUAGE, LANGUAGE_TAG = 0x86, 0x63A2, 0x536E, 0x22B59C, 0x22B59D
ENCODINGS, ENCODING, ENCODING_SCOPE, ENCODING_TYPE = 0x6D80, 0x6240, 0x5032, 0x5033
COMPRESSION, COMPRESSION_KIND, COMPRESSION_SETTINGS = 0x5034, 0x4254, 0x4255
CLUSTER, CLUSTER_TICKS, CLUSTER_POSITION, CLUSTER_BEFORE = 0x1F43B675, 0xE7, 0xA7, 0xAB
CLUSTER_SILENT, CLUSTER_ENCRYPTED = 0x5854, 0xAF
SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
TAGS, TAG, TARGETS, TARGET_UID, SIMPLE_TAG, TAG_NAME, TAG_STRING = 0x1254C367, 0x7373, 0x63C0, 0x63C5, 0x67C8, 0x45A3, 0x4487
ATTACHMENTS, CHAPTERS, VOID, CRC32 = 0x1941A469, 0x1043A770, 0xEC, 0xBF
# Types of tracks, text codecs by the kind of their blocks, defaults, limits.
TYPES = {0x02: "audio", 0x11: "subtitle"}
KINDS = {
    "S_TEXT/UTF8": "plain",
    "S_TEXT/UTF-8": "plain",
    "S_TEXT/ASCII": "plain",
    "S_TEXT/SSA": "ass",
    "S_TEXT/ASS": "ass",
    "S_SSA": "ass",
    "S_ASS": "ass",
    "S_TEXT/WEBVTT": "webvtt",
    "D_WEBVTT/SUBTITLES": "webm",
    "D_WEBVTT/CAPTIONS": "webm",
}
CAPTIONS = "D_WEBVTT/CAPTIONS"
USUAL_TICK = 1_000_000
HEADER_STRIPPING = 3
FRAMES_TAG = "NUMBER_OF_FRAMES"
USUAL_MS, LEAST_MS = 2000, 1
ASS_HEAD = "[Script Info]\nScriptType: v4.00+\n\n"
ASS_EVENTS = "[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"
MIB = 1 << 20
SPLIT_OVER, RANGE_BYTES = 192 * MIB, 48 * MIB
MOST_METADATA, MOST_CUES, MOST_TAGS = 32 * MIB, 64 * MIB, 8 * MIB
CHECKED_CLUSTERS, SEEK_HOPS, TICKS_WITHIN = 24, 4, 4
IN_CLUSTER = {CLUSTER_TICKS, SIMPLE_BLOCK, BLOCK_GROUP, CLUSTER_POSITION, CLUSTER_BEFORE, CLUSTER_SILENT, CLUSTER_ENCRYPTED, VOID, CRC32}
AFTER_CLUSTER = {CLUSTER, CUES, TAGS, ATTACHMENTS, CHAPTERS, SEEK_HEAD, VOID, CRC32}
# A cluster of unknown size ends at one of these; padding and check sums may stand within it.
TOP_LEVEL = AFTER_CLUSTER - {VOID, CRC32} | {INFO, TRACKS}

EXTENSIONS = re.compile(r"\.(mkv|mks|mka|webm)$", re.IGNORECASE)
PACK_BYTES, OPEN_BYTES, BATCH_BYTES = 128 * MIB, 4 * MIB, 4 * MIB

BLOCK_ROWS = "path string, track long, pos long, start_ms long, duration_ms long, data binary"
TRACK_ROWS = (
    "path string, track long, uid decimal(20,0), type string, codec string, kind string, language string, language_tag string, name string,"
    " is_default boolean, is_forced boolean, is_hearing_impaired boolean, compression string, prefix binary, private binary, frames long"
)
BLOCK_ARROW = pa.schema([("path", pa.string()), ("track", pa.int64()), ("pos", pa.int64()), ("start_ms", pa.int64()), ("duration_ms", pa.int64()), ("data", pa.binary())])
TRACK_ARROW = pa.schema(
    [("path", pa.string()), ("track", pa.int64()), ("uid", pa.decimal128(20, 0))]
    + [(n, pa.string()) for n in ("type", "codec", "kind", "language", "language_tag", "name")]
    + [(n, pa.bool_()) for n in ("is_default", "is_forced", "is_hearing_impaired")]
    + [("compression", pa.string()), ("prefix", pa.binary()), ("private", pa.binary()), ("frames", pa.int64())]
)


@dataclass
class Layout:
    """What the head of a file says: its tracks, the length of a tick, where clusters begin and end, where tables lie."""

    segment: int
    end: int
    first: int
    sized: bool = True
    tick: int = USUAL_TICK
    tracks: list[dict] = field(default_factory=list)
    cues: int | None = None
    tags: int | None = None


def compression_of(body: bytes) -> tuple[str | None, bytes | None]:
    """('zlib', None), ('header', prefix) or (None, None): the first encoding that compresses blocks."""
    for id_, encoding in ebml.fields(body):
        if id_ != ENCODING:
            continue
        own = dict(ebml.fields(encoding))
        detail = dict(ebml.fields(own.get(COMPRESSION, b"")))
        if number(own.get(ENCODING_TYPE, b"")) == 0 and number(own.get(ENCODING_SCOPE, b"\1")) & 1:
            stripped = number(detail.get(COMPRESSION_KIND, b"")) == HEADER_STRIPPING
            return ("header", detail.get(COMPRESSION_SETTINGS, b"")) if stripped else ("zlib", None)
    return None, None


def track_of(body: bytes) -> dict:
    own = dict(ebml.fields(body))
    named = lambda id_: ebml.text(own.get(id_, b"")) or None
    flag = lambda id_, usual: number(own[id_]) != 0 if id_ in own else usual
    codec = named(CODEC) or ""
    compression, prefix = compression_of(own.get(ENCODINGS, b""))
    return {
        "track": number(own.get(TRACK_NUMBER, b"")),
        "uid": number(own[TRACK_UID]) if TRACK_UID in own else None,
        "type": TYPES.get(number(own.get(TRACK_TYPE, b""))),
        "codec": codec,
        "kind": KINDS.get(codec),
        "language": named(LANGUAGE),
        "language_tag": named(LANGUAGE_TAG),
        "name": (named(NAME) or "").strip() or None,
        "is_default": flag(FLAG_DEFAULT, True),
        "is_forced": flag(FLAG_FORCED, False),
        "is_hearing_impaired": flag(FLAG_HEARING, False) or codec == CAPTIONS,
        "compression": compression,
        "prefix": prefix,
        "private": own.get(CODEC_PRIVATE),
    }


def table_at(window: Window, at: int | None, id_: int, most: int = MOST_METADATA) -> bytes | None:
    """The body of the element at a place, if it is the one looked for and no larger than most."""
    found = None if at is None else ebml.element_at(window, at)
    if found is None or found.id != id_ or found.size is None or found.size > most:
        return None
    return window.read(found.body, found.size)


def layout_of(window: Window) -> Layout | None:
    """The layout; None for a file that is no Matroska file or has no list of tracks."""
    head = ebml.element_at(window, 0)
    segment = ebml.element_at(window, head.end) if head and head.id == EBML and head.end is not None else None
    if segment is None or segment.id != SEGMENT:
        return None
    end = window.size if segment.end is None else min(window.size, segment.end)
    found = Layout(segment.body, end, end)
    places: dict[int, int] = {}
    heads: list[int] = []
    for part in ebml.elements(window, segment.body, end):
        if part.id == CLUSTER:
            found.first, found.sized = part.at, part.size is not None
            break
        if part.id == SEEK_HEAD:
            heads.append(part.at)
        elif part.size is not None:
            places.setdefault(part.id, part.at)
    seen: set[int] = set()
    for _ in range(SEEK_HOPS + len(heads)):
        at = next((x for x in heads if x not in seen), None)
        if at is None:
            break
        seen.add(at)
        for id_, entry in ebml.fields(table_at(window, at, SEEK_HEAD) or b""):
            own = dict(ebml.fields(entry))
            if id_ != SEEK or SEEK_POSITION not in own:
                continue
            target, place = number(own.get(SEEK_ID, b"")), segment.body + number(own[SEEK_POSITION])
            if target == SEEK_HEAD:
                heads.append(place)
            else:
                places.setdefault(target, place)
    tracks = table_at(window, places.get(TRACKS), TRACKS)
    if tracks is None:
        return None
    info = dict(ebml.fields(table_at(window, places.get(INFO), INFO) or b""))
    found.tick = number(info.get(TICK_NANOSECONDS, b"")) or USUAL_TICK
    found.tracks = [t for id_, body in ebml.fields(tracks) if id_ == TRACK and (t := track_of(body))["type"] and t["track"]]
    found.cues, found.tags = places.get(CUES), places.get(TAGS)
    return found


def frames_by_uid(tags: bytes) -> dict[int, int]:
    """Declared numbers of blocks by track uid; of several for one track the last."""
    out = {}
    for id_, tag in ebml.fields(tags):
        if id_ != TAG:
            continue
        uids, frames = [], None
        for kind, body in ebml.fields(tag):
            if kind == TARGETS:
                uids += [number(v) for k, v in ebml.fields(body) if k == TARGET_UID]
            elif kind == SIMPLE_TAG and frames is None:
                own = dict(ebml.fields(body))
                value = ebml.text(own.get(TAG_STRING, b"")).strip()
                if ebml.text(own.get(TAG_NAME, b"")).strip().upper().startswith(FRAMES_TAG) and re.fullmatch("[0-9]+", value):
                    frames = int(value)
        if frames is not None:
            out |= dict.fromkeys(uids, frames)
    return out


def is_cluster(window: Window, at: int, end: int) -> bool:
    """Is there a whole cluster, with a child that belongs into one, and with one that may follow, or the end, after it?"""
    found = ebml.element_at(window, at)
    if found is None or found.id != CLUSTER or found.end is None or found.end > end:
        return False
    child = ebml.element_at(window, found.body)
    if child is None or child.id not in IN_CLUSTER or child.end is None or child.end > found.end:
        return False
    after = ebml.element_at(window, found.end) if found.end < end else None
    return found.end == end or (after is not None and after.id in AFTER_CLUSTER)


class Clusters:
    """A file's clusters: where ranges begin and end, and the blocks between."""

    def __init__(self, window: Window, layout: Layout, wanted: set[int], index: bool = True):
        self.window, self.layout, self.wanted, self.index = window, layout, wanted, index
        self.cued: list[int] = []
        self.references: dict[int, dict[int, int]] = {}
        self.whole_index = self._read_cues() if wanted else False

    def _read_cues(self) -> bool:
        """Reads the index. True if it gives a place within its cluster for each mention of a wanted track."""
        body = table_at(self.window, self.layout.cues, CUES, MOST_CUES)
        placed = True
        for id_, point in ebml.fields(body or b""):
            for kind, places in ebml.fields(point) if id_ == CUE_POINT else ():
                own = dict(ebml.fields(places))
                if kind != CUE_PLACES or CUE_CLUSTER not in own:
                    continue
                at, track = self.layout.segment + number(own[CUE_CLUSTER]), number(own.get(CUE_TRACK, b""))
                within = self.references.setdefault(at, {})
                if track in self.wanted:
                    placed &= CUE_RELATIVE in own
                    within[number(own.get(CUE_RELATIVE, b""))] = track
        self.cued = sorted(self.references)
        return placed and any(self.references.values())

    def boundary(self, at: int) -> int:
        """The first cluster from a place on that the index names. Without an index, or with one that is wrong there,
        the first one met by going from cluster to cluster from the first on, which reads their heads only."""
        first, end = self.layout.first, self.layout.end
        if at <= first or at >= end:
            return first if at <= first else end
        place = bisect_left(self.cued, at)
        if self.cued and place == len(self.cued):
            return end
        if self.cued and is_cluster(self.window, self.cued[place], end):
            return self.cued[place]
        return next((x.at for x in ebml.elements(self.window, first, end) if x.at >= at and x.id == CLUSTER), end)

    def ms(self, ticks: int) -> int:
        return (2 * ticks * self.layout.tick + 1_000_000) // 2_000_000

    def block(self, found: Element, at: int, ticks: int) -> list | None:
        """[track, pos, start_ms, duration_ms, data] of a block of a wanted track; None for others, for laced and empty
        ones."""
        head = self.window.read(found.body, min(found.size, ebml.HEAD_BYTES))
        track = ebml.vint(head)
        if track is None or track[0] not in self.wanted or track[1] + 2 >= len(head) or head[track[1] + 2] & 6:
            return None
        length = track[1] + 3
        if found.size <= length:
            return None
        relative = int.from_bytes(head[track[1] : track[1] + 2], "big", signed=True)
        return [track[0], at, self.ms(ticks + relative), None, self.window.read(found.body + length, found.size - length)]

    def blocks_of(self, found: Element, ticks: int, limit: int) -> Iterator[list]:
        """The blocks of a simple block or of a group, whose duration belongs to the block before it."""
        if found.id == SIMPLE_BLOCK and found.size is not None:
            one = self.block(found, found.at, ticks)
            if one:
                yield one
        elif found.id == BLOCK_GROUP and found.size is not None:
            last, out = None, []
            for part in ebml.elements(self.window, found.body, min(found.end, limit)):
                if part.size is None:
                    break
                if part.id == BLOCK:
                    last = self.block(part, found.at, ticks)
                    out += [last] if last else []
                elif part.id == BLOCK_DURATION and last:
                    last[3] = self.ms(number(self.window.read(part.body, part.size)))
            yield from out

    def scan(self, start: int, end: int) -> Iterator[list]:
        """Blocks of the clusters that begin from start on and before end."""
        at = start
        while at < end and (found := ebml.element_at(self.window, at)) is not None:
            if found.id != CLUSTER:
                if found.end is None:
                    return
                at = found.end
                continue
            limit, ticks = min(found.end or self.window.size, self.window.size), 0
            at = limit
            for part in ebml.elements(self.window, found.body, limit):
                if found.size is None and part.id in TOP_LEVEL:
                    at = part.at
                    break
                if part.id == CLUSTER_TICKS and part.size is not None:
                    ticks = number(self.window.read(part.body, part.size))
                else:
                    yield from self.blocks_of(part, ticks, limit)

    def complete(self, start: int, end: int) -> bool:
        """Does the index name all blocks of the wanted tracks? The declared numbers of blocks decide, where each track
        has one; else clusters spread over this range are read and compared with it."""
        if not (self.index and self.whole_index):
            return False
        declared = frames_by_uid(table_at(self.window, self.layout.tags, TAGS, MOST_TAGS) or b"")
        expected = {t["track"]: declared.get(t["uid"]) for t in self.layout.tracks if t["track"] in self.wanted}
        if None not in expected.values():
            named = dict.fromkeys(self.wanted, 0)
            for within in self.references.values():
                for track in within.values():
                    named[track] += 1
            return named == expected
        own = [x for x in self.cued if start <= x < end]
        picks = own if len(own) <= CHECKED_CLUSTERS else [own[i * (len(own) - 1) // (CHECKED_CLUSTERS - 1)] for i in range(CHECKED_CLUSTERS)]
        return all(sum(1 for _ in self.scan(x, x + 1)) == len(self.references[x]) for x in picks)

    def indexed(self, start: int, end: int) -> list[list] | None:
        """The blocks that the index names in a range; None if it is wrong about one of them."""
        out = []
        for at in self.cued[bisect_left(self.cued, start) : bisect_left(self.cued, end)]:
            if not self.references[at]:
                continue
            found = ebml.element_at(self.window, at)
            if found is None or found.id != CLUSTER:
                return None
            parts = [x for _, x in zip(range(TICKS_WITHIN), ebml.elements(self.window, found.body, found.end or self.window.size), strict=False)]
            clock = next((x for x in parts if x.id == CLUSTER_TICKS and x.size is not None), None)
            if clock is None:
                return None
            ticks = number(self.window.read(clock.body, clock.size))
            for relative, track in sorted(self.references[at].items()):
                part = ebml.element_at(self.window, found.body + relative)
                read = list(self.blocks_of(part, ticks, part.end)) if part and part.end is not None else []
                if len(read) != 1 or read[0][0] != track:
                    return None
                out += read
        return out

    def read(self, start: int, end: int) -> Iterator[list]:
        """All blocks between two places of the file, by the index where it is complete, else by a scan."""
        if not self.layout.sized:
            start, end = (self.layout.first, self.layout.end) if start == 0 else (0, 0)
        else:
            start, end = self.boundary(start), self.boundary(end)
        named = self.indexed(start, end) if start < end and self.complete(start, end) else None
        yield from named if named is not None else self.scan(start, end)


@dataclass
class Ranges(InputPartition):
    """Parts of files (path, size, start, end) for one task."""

    parts: list[tuple[str, int, int, int]]


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def cut_files(files: list[tuple[str, int]], split_over: int, range_bytes: int) -> list[Ranges]:
    """Files of split_over bytes and more are cut into ranges of range_bytes or somewhat more; small files share a task."""
    out, parts, weight = [], [], 0
    for path, size in sorted(files):
        n = max(1, size // range_bytes) if size >= split_over else 1
        for i in range(n):
            start, end = size * i // n, size * (i + 1) // n
            if parts and weight + end - start + OPEN_BYTES > PACK_BYTES:
                out.append(Ranges(parts))
                parts, weight = [], 0
            parts.append((path, size, start, end))
            weight += end - start + OPEN_BYTES
            if n > 1:
                out.append(Ranges(parts))
                parts, weight = [], 0
    return out + ([Ranges(parts)] if parts else [])


class MatroskaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tracks = options["path"], options.get("rows", "blocks") == "tracks"
        self.split_over, self.range_bytes = int(options.get("splitOver", SPLIT_OVER)), int(options.get("rangeBytes", RANGE_BYTES))
        self.index, self.skip = options.get("index", "true") == "true", options.get("badFiles", "fail") == "skip"
        self.only = {int(x) for x in options["tracks"].split(",")} if options.get("tracks") else None
        if self.range_bytes < 1:
            raise ValueError("rangeBytes is at least 1")

    def partitions(self) -> list[Ranges]:
        system, root = file_system(self.path)
        found = system.get_file_info(root)
        if found.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        below = [found] if found.is_file else system.get_file_info(arrow_fs.FileSelector(root, recursive=True))
        hidden = lambda x: any(p[:1] in ("_", ".") for p in x.path[len(root) :].split("/"))
        files = [(x.path, x.size) for x in below if x.is_file and (found.is_file or (EXTENSIONS.search(x.path) and not hidden(x)))]
        return cut_files(files, self.split_over if not self.tracks else 2**63, self.range_bytes) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        rows, held = [], 0
        schema = TRACK_ARROW if self.tracks else BLOCK_ARROW
        for path, size, start, end in partition.parts:
            with system.open_input_file(path) as file:
                window = Window(file, size)
                layout = layout_of(window)
                if layout is None:
                    if self.skip:
                        continue
                    raise ValueError(f"not a readable Matroska file: {path}")
                for row in self._tracks(window, layout) if self.tracks else self._blocks(window, layout, start, end):
                    rows.append([path, *row])
                    held += 64 + (len(row[-1]) if not self.tracks else 0)
                    if held >= BATCH_BYTES:
                        yield batch(rows, schema)
                        rows, held = [], 0
        if rows:
            yield batch(rows, schema)

    def _blocks(self, window: Window, layout: Layout, start: int, end: int) -> Iterator[list]:
        wanted = {t["track"] for t in layout.tracks if t["type"] == "subtitle" and t["kind"]}
        wanted = wanted if self.only is None else wanted & self.only
        if wanted:
            yield from Clusters(window, layout, wanted, self.index).read(start, end)

    def _tracks(self, window: Window, layout: Layout) -> Iterator[list]:
        frames = frames_by_uid(table_at(window, layout.tags, TAGS, MOST_TAGS) or b"")
        for track in layout.tracks:
            yield [*track.values(), frames.get(track["uid"])]


def batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class MatroskaWriter(DataSourceArrowWriter):
    """Rows (track, start_ms, duration_ms, text) as files of about fileBytes. Tasks write below _temporary; the commit
    moves their files to the folder, so that a task that was lost or ran twice leaves nothing behind. Rows without text, or
    with an empty one, are passed over."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.tracks = {int(t["number"]): t for t in json.loads(options["tracks"])}
        self.file_bytes, self.cluster_bytes = int(options.get("fileBytes", 64 * MIB)), int(options.get("clusterBytes", MIB))
        self.aside = f"_temporary/{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        system.create_dir(f"{root}/{self.aside}", recursive=True)
        stem, names = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", []

        def close(file: FileBuilder) -> None:
            names.append(f"{stem}-{len(names):03d}.mkv")
            with system.open_output_stream(f"{root}/{self.aside}/{names[-1]}") as out:
                for part in file.parts():
                    out.write(part)

        file = FileBuilder(self.tracks, self.cluster_bytes)
        for rows in batches:
            for row in rows.select(["track", "start_ms", "duration_ms", "text"]).to_pylist():
                file.add(**row)
                if file.bytes >= self.file_bytes:
                    close(file)
                    file = FileBuilder(self.tracks, self.cluster_bytes)
        if file.bytes:
            close(file)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(arrow_fs.FileSelector(root)):
                if old.is_file and EXTENSIONS.search(old.path):
                    system.delete_file(old.path)
        for message in messages:
            for name in message.names if message else ():
                system.move(f"{root}/{self.aside}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        if system.get_file_info(f"{root}/{self.aside}").type == arrow_fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.aside}")


class FileBuilder:
    """One file, held until it is written: an index and counts of blocks come before its clusters."""

    def __init__(self, tracks: dict[int, dict], cluster_bytes: int):
        self.tracks, self.cluster_bytes = tracks, cluster_bytes
        self.clusters: list[bytes] = []
        self.cues: list[tuple[int, int, int, int]] = []
        self.counts = dict.fromkeys(tracks, 0)
        self.bytes, self.ticks, self.open = 0, None, bytearray()

    def add(self, track: int, start_ms: int, duration_ms: int | None, text: str | None) -> None:
        if not text:
            return
        if track not in self.tracks or start_ms is None or start_ms < 0:
            raise ValueError(f"no such track, or no time from 0 on: {track}, {start_ms}")
        if self.ticks is None or not 0 <= start_ms - self.ticks < 1 << 15 or len(self.open) >= self.cluster_bytes:
            self.close()
            self.ticks, self.open = start_ms, bytearray(element(CLUSTER_TICKS, unsigned(start_ms)))
        data = text.encode()
        kind = self.tracks[track].get("compression")
        prefix = self.tracks[track].get("prefix", "").encode()
        if kind == "zlib":
            data = zlib.compress(data)
        elif kind == "header":
            if not data.startswith(prefix):
                raise ValueError(f"a text of track {track} does not begin with its prefix")
            data = data[len(prefix) :]
        body = ebml.size_bytes(track) + (start_ms - self.ticks).to_bytes(2, "big", signed=True) + (b"\x80" if duration_ms is None else b"\0") + data
        part = element(SIMPLE_BLOCK, body) if duration_ms is None else element(BLOCK_GROUP, element(BLOCK, body), element(BLOCK_DURATION, unsigned(duration_ms)))
        self.cues.append((start_ms, track, len(self.clusters), len(self.open)))
        self.open += part
        self.bytes += len(part)
        self.counts[track] += 1

    def close(self) -> None:
        if self.open:
            self.clusters.append(element(CLUSTER, bytes(self.open)))
        self.open = bytearray()

    def parts(self) -> Iterator[bytes]:
        self.close()
        info = element(INFO, element(TICK_NANOSECONDS, unsigned(USUAL_TICK)))
        tracks = element(TRACKS, *(self._track(t) for t in self.tracks.values()))
        tags = element(TAGS, *(self._count(n, frames) for n, frames in self.counts.items()))
        # Positions have eight bytes each, so that the index is as long with any of them.
        size = len(self._index(0))
        fixed = info + tracks + tags
        index = self._index(len(fixed) + size)
        yield element(EBML, element(0x4282, b"matroska"))
        yield unsigned(SEGMENT) + ebml.size_bytes(len(fixed) + size + sum(map(len, self.clusters)), 8)
        yield fixed + index
        yield from self.clusters

    def _index(self, before: int) -> bytes:
        starts = [before]
        for cluster in self.clusters:
            starts.append(starts[-1] + len(cluster))
        point = lambda ms, track, cluster, at: element(CUE_POINT, element(CUE_TIME, unsigned(ms)), element(CUE_PLACES, element(CUE_TRACK, unsigned(track)), element(CUE_CLUSTER, unsigned(starts[cluster], 8)), element(CUE_RELATIVE, unsigned(at))))
        return element(CUES, *(point(*cue) for cue in self.cues), length=8)

    def _track(self, track: dict) -> bytes:
        out = [element(TRACK_NUMBER, unsigned(int(track["number"]))), element(TRACK_UID, unsigned(int(track["number"]))), element(TRACK_TYPE, b"\x11"), element(CODEC, track.get("codec", "S_TEXT/UTF8").encode())]
        for key, id_ in (("language", LANGUAGE), ("name", NAME), ("private", CODEC_PRIVATE)):
            if track.get(key):
                out.append(element(id_, track[key].encode()))
        if track.get("compression"):
            settings = [element(COMPRESSION_SETTINGS, track.get("prefix", "").encode())] if track["compression"] == "header" else []
            kind = unsigned(HEADER_STRIPPING if settings else 0)
            out.append(element(ENCODINGS, element(ENCODING, element(COMPRESSION, element(COMPRESSION_KIND, kind), *settings))))
        return element(TRACK, *out)

    def _count(self, track: int, frames: int) -> bytes:
        return element(TAG, element(TARGETS, element(TARGET_UID, unsigned(track))), element(SIMPLE_TAG, element(TAG_NAME, FRAMES_TAG.encode()), element(TAG_STRING, str(frames).encode())))


class Matroska(DataSource):
    """Options for reading: path (a folder or file), rows (blocks or tracks), tracks (numbers; all text tracks if there are
    none), splitOver and rangeBytes (see cut_files), index (false: always scan), badFiles (fail or skip). For writing: path,
    tracks (JSON: number, codec, language, name, compression of zlib or header, prefix), fileBytes, clusterBytes."""

    @classmethod
    def name(cls) -> str:
        return "matroska"

    def schema(self) -> str:
        return TRACK_ROWS if self.options.get("rows", "blocks") == "tracks" else BLOCK_ROWS

    def reader(self, schema) -> MatroskaReader:
        return MatroskaReader(self.options)

    def writer(self, schema, overwrite: bool) -> MatroskaWriter:
        return MatroskaWriter(self.options, overwrite)


def read(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """(blocks, tracks) of the files in a folder."""
    spark.dataSource.register(Matroska)
    reader = lambda rows: spark.read.format("matroska").options(rows=rows, **options).load(path)
    return reader("blocks"), reader("tracks")


@F.pandas_udf(BinaryType())
def inflate(data: pd.Series) -> pd.Series:
    """Whole zlib streams; null for null and for what is none."""

    def one(x):
        if x is None:
            return None
        stream = zlib.decompressobj()
        try:
            out = stream.decompress(x)
        except zlib.error:
            return None
        return out if stream.eof and not stream.unused_data else None

    return data.map(one)


def valid_text(data: Column) -> Column:
    """Bytes as text: what is no UTF-8 becomes U+FFFD, a byte order mark goes."""
    return F.regexp_replace(F.make_valid_utf8(data.cast("string")), "^﻿", "")


def decode(blocks: DataFrame, tracks: DataFrame) -> DataFrame:
    """path, track, kind, pos, start_ms, duration_ms, text: blocks restored; those that can't be are left out."""
    own = tracks.where("kind IS NOT NULL").select("path", "track", "kind", "compression", "prefix")
    zipped = F.col("compression") == "zlib"
    data = F.when(zipped, inflate(F.when(zipped, F.col("data")))).when(F.col("compression") == "header", F.concat("prefix", "data")).otherwise(F.col("data"))
    rows = blocks.join(own, ["path", "track"]).withColumn("data", data).where("data IS NOT NULL")
    return rows.select("path", "track", "kind", "pos", "start_ms", "duration_ms", valid_text(F.col("data")).alias("text"))


def cues(decoded: DataFrame) -> DataFrame:
    """path, track, pos, start_ms, end_ms, text of plain and WebVTT tracks, in order of start, then of place. A missing
    duration ends at the next later start, at most 2 s on; a cue lasts 1 ms at least. Blank cues go, once they have ended
    the one before. Blocks of WebM begin with two lines that are no text."""
    text = normalise_newlines(F.col("text"))
    body = F.when(F.col("kind") == "webm", F.array_join(F.slice(F.split(text, "\n"), 3, 2**31 - 1), "\n")).otherwise(text)
    order = W.partitionBy("path", "track").orderBy("start_ms", "pos")
    following, usual = F.lead("start_ms").over(order), F.col("start_ms") + USUAL_MS
    fallback = F.when(following > F.col("start_ms"), F.least(usual, following)).otherwise(usual)
    end = F.greatest(F.col("start_ms") + LEAST_MS, F.coalesce(F.col("start_ms") + F.col("duration_ms"), fallback))
    trimmed = F.regexp_replace(body, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")
    rows = decoded.where("kind <> 'ass'").select("path", "track", "kind", "pos", "start_ms", end.alias("end_ms"), trimmed.alias("text"))
    return rows.where("text <> ''")


def documents(blocks: DataFrame, tracks: DataFrame) -> DataFrame:
    """path, track, format, text: the subtitle file of each track with a block that can be read. A track is gathered in one
    row, as a file is."""
    decoded = decode(blocks, tracks)
    span = lambda time: F.concat(time(F.col("start_ms")), F.lit(" --> "), time(F.col("end_ms")), F.lit("\n"), F.col("text"))
    timed = cues(decoded).select("path", "track", "start_ms", "pos", F.when(F.col("kind") == "plain", span(srt_time)).otherwise(span(vtt_time)).alias("block"))
    part = F.split("text", ",", 3)
    end = ass_time(F.col("start_ms") + F.coalesce("duration_ms", F.lit(USUAL_MS)))
    line = F.concat(F.lit("Dialogue: "), F.concat_ws(",", F.get(part, F.lit(1)), ass_time(F.col("start_ms")), end, F.regexp_replace(F.get(part, F.lit(2)), r"\r?\n", r"\\N")))
    spoken = decoded.where((F.col("kind") == "ass") & (F.size(part) == 3)).select("path", "track", "start_ms", "pos", line.alias("block"))
    ordered = F.array_sort(F.collect_list(F.struct("start_ms", "pos", "block")))
    bodies = timed.unionByName(spoken).groupBy("path", "track").agg(F.transform(ordered, lambda x: x["block"]).alias("blocks"))
    known = decoded.select("path", "track").distinct().join(bodies, ["path", "track"], "left").withColumn("blocks", F.coalesce("blocks", F.array().cast("array<string>")))
    private = F.rtrim(normalise_newlines(valid_text(F.coalesce("private", F.lit(b"")))), F.lit(" \n\t"))
    start = F.when(private == "", F.lit(ASS_HEAD)).otherwise(F.concat(private, F.lit("\n\n")))
    head = F.when(private.rlike(r"(?i)\[Events\]"), private).otherwise(F.concat(start, F.lit(ASS_EVENTS)))
    numbered = F.transform("blocks", lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x))
    body = F.when(F.col("kind") == "ass", F.concat(head, F.lit("\n"), F.array_join("blocks", "\n"))).when(F.col("kind") == "plain", F.array_join(numbered, "\n\n")).otherwise(F.concat(F.lit("WEBVTT\n\n"), F.array_join("blocks", "\n\n")))
    form = F.when(F.col("kind") == "ass", "ass").when(F.col("kind") == "plain", "srt").otherwise("vtt")
    rows = known.join(tracks.select("path", "track", "kind", "private"), ["path", "track"])
    return rows.select("path", "track", form.alias("format"), F.concat(body, F.lit("\n")).alias("text"))


def write(rows: DataFrame, path: str, tracks: list[dict], **options) -> None:
    """Rows (track, start_ms, duration_ms, text) as Matroska files, by ranges of start so that clusters are in order."""
    rows.sparkSession.dataSource.register(Matroska)
    typed = rows.select(F.col("track").cast("long"), F.col("start_ms").cast("long"), F.col("duration_ms").cast("long"), F.col("text").cast("string"))
    ranged = typed.repartitionByRange("start_ms").sortWithinPartitions("start_ms", "track")
    ranged.write.format("matroska").options(tracks=json.dumps(tracks), **options).mode("append").save(path)
