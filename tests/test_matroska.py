"""Matroska: files built here byte by byte, read whole and by ranges, with and without an index; written and read again."""

import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.sources import ebml, matroska
from tidemark.sources.matroska import Clusters, Window, cut_files, layout_of

UNKNOWN = b"\x01" + b"\xff" * 7


def el(id_hex, *parts, size=None):
    body = b"".join(parts)
    return bytes.fromhex(id_hex) + (size or (len(body) | 1 << 56).to_bytes(8, "big")) + body


def uint(n):
    return n.to_bytes(4, "big")


def track(n, codec=b"S_TEXT/UTF8", kind=b"\x11", *more):
    return el("ae", el("d7", uint(n)), el("73c5", uint(100 + n)), el("83", kind), el("86", codec), *more)


def compressed(algorithm, settings=b""):
    return el("6d80", el("6240", el("5032", b"\1"), el("5034", el("4254", bytes([algorithm])), el("4255", settings))))


def body(track_, relative, data, flags=0):
    return bytes([0x80 | track_]) + relative.to_bytes(2, "big", signed=True) + bytes([flags]) + data


def simple(track_, relative, data, flags=0x80):
    return el("a3", body(track_, relative, data, flags))


def group(track_, relative, data, duration=None, flags=0):
    return el("a0", el("a1", body(track_, relative, data, flags)), *([el("9b", uint(duration))] if duration is not None else []))


def cluster(ticks, *parts, size=None):
    return el("1f43b675", el("e7", uint(ticks)), *parts, size=size)


def whole_file(tracks, clusters, cues=None, tags=b"", scale=None, size=None):
    """cues: None, or (track, cluster number, offset in its body) of blocks; the index lies after the clusters, found by a
    list of places."""
    head = el("1549a966", el("2ad7b1", uint(scale))) if scale else b""
    tracks = el("1654ae6b", *tracks)
    place = len(el("114d9b74", el("4dbb", el("53ab", bytes.fromhex("1c53bb6b")), el("53ac", uint(0))), el("4dbb", el("53ab", bytes.fromhex("1254c367")), el("53ac", uint(0)))))
    starts, at = [], place + len(head) + len(tracks)
    for c in clusters:
        starts.append(at)
        at += len(c)
    index = b"" if cues is None else el("1c53bb6b", *(el("bb", el("b3", uint(0)), el("b7", el("f7", uint(t)), el("f1", uint(starts[c])), *([] if o is None else [el("f0", uint(o))]))) for t, c, o in cues))
    seek = el("114d9b74", el("4dbb", el("53ab", bytes.fromhex("1c53bb6b")), el("53ac", uint(at))), el("4dbb", el("53ab", bytes.fromhex("1254c367")), el("53ac", uint(at + len(index)))))
    return el("1a45dfa3", el("4282", b"matroska")) + el("18538067", seek, head, tracks, *clusters, index, tags, size=size)


class Held:
    def __init__(self, data):
        self.data, self.read_bytes = data, 0

    def read_at(self, n, at):
        self.read_bytes += n
        return self.data[at : at + n]


def scan(data, start=0, end=None, index=True, stretch=64):
    window = Window(Held(data), len(data), stretch)
    layout = layout_of(window)
    wanted = {t["track"] for t in layout.tracks if t["kind"] and t["type"] == "subtitle"}
    return [x[:1] + x[2:] for x in Clusters(window, layout, wanted, index).read(start, len(data) if end is None else end)]


VIDEO = track(2, b"V_MPEG4", b"\1")
#: Inside a picture lies what looks like a whole cluster, followed by another.
FALSE = cluster(7, simple(1, 0, b"no text")) + cluster(8, simple(1, 0, b"neither"))


def many(n=40):
    """Clusters with video between the texts, and the blocks that are to be found."""
    clusters, wanted, cues = [], [], []
    for i in range(n):
        parts = [simple(2, 0, FALSE + bytes(50)), group(1, -5 if i else 0, f"text {i}".encode(), 100 + i), el("ec", bytes(30)), simple(1, 20, f"more {i}".encode())]
        offset = len(el("e7", uint(0)))
        for j, part in enumerate(parts):
            if j in (1, 3):
                cues.append((1, i, offset))
            offset += len(part)
        clusters.append(cluster(1000 * i, *parts))
        wanted += [[1, 1000 * i - (5 if i else 0), 100 + i, f"text {i}".encode()], [1, 1000 * i + 20, None, f"more {i}".encode()]]
    return clusters, wanted, cues


def test_numbers_of_variable_length():
    assert ebml.vint(b"\x81") == (1, 1) and ebml.vint(b"\x40\x02") == (2, 2) and ebml.vint(b"\xff") == (-1, 1)
    assert ebml.vint(b"\x01" + b"\xff" * 7) == (-1, 8)
    assert ebml.vint(b"\x00\x01") is None and ebml.vint(b"\x40") is None and ebml.vint(b"") is None
    for n in [0, 1, 126, 127, 128, 16382, 16383, 2**40]:
        assert ebml.vint(ebml.size_bytes(n)) == (n, len(ebml.size_bytes(n)))
    assert ebml.element_in(b"\x0f\x81", 0) is None
    assert ebml.element_in(bytes.fromhex("1f43b675") + UNKNOWN, 0).size is None


@pytest.mark.parametrize("with_cues", [False, True])
@pytest.mark.parametrize("index", [False, True])
def test_ranges_give_the_same_blocks_as_the_whole(with_cues, index):
    clusters, wanted, cues = many()
    data = whole_file([track(1), VIDEO], clusters, cues if with_cues else None)
    assert scan(data, index=index) == wanted
    for step in (37, 300, 1001, len(data) // 2):
        cuts = [*range(0, len(data), step), len(data)]
        assert [x for a, b in zip(cuts, cuts[1:], strict=False) for x in scan(data, a, b, index)] == wanted


def test_an_index_that_lacks_blocks_or_places_is_not_used():
    clusters, wanted, cues = many(10)
    missing = [c for i, c in enumerate(cues) if i != 3]
    for bad in (missing, [(1, 0, None), *cues[1:]], [(1, 0, 3), *cues[1:]], [(2, 0, cues[0][2]), *cues[1:]]):
        assert scan(whole_file([track(1), VIDEO], clusters, bad)) == wanted
    count = lambda n: el("1254c367", el("7373", el("63c0", el("63c5", uint(101))), el("67c8", el("45a3", b"number_of_frames-eng"), el("4487", n))))
    assert scan(whole_file([track(1), VIDEO], clusters, cues, count(b"20"))) == wanted
    assert scan(whole_file([track(1), VIDEO], clusters, missing, count(b"20"))) == wanted


def test_an_index_spares_the_other_tracks():
    clusters = [cluster(i, simple(2, 0, bytes(5000)), simple(1, 0, b"x")) for i in range(50)]
    cues = [(1, i, len(el("e7", uint(0))) + len(simple(2, 0, bytes(5000)))) for i in range(50)]
    tags = el("1254c367", el("7373", el("63c0", el("63c5", uint(101))), el("67c8", el("45a3", b"NUMBER_OF_FRAMES"), el("4487", b"50"))))
    data = whole_file([track(1), VIDEO], clusters, cues, tags)
    held = Held(data)
    window = Window(held, len(data), 64)
    assert len(list(Clusters(window, layout_of(window), {1}).read(0, len(data)))) == 50
    assert held.read_bytes < len(data) / 10


def test_laced_empty_and_unwanted_blocks_and_lonely_durations():
    parts = [simple(1, 0, b"laced", 0x82), simple(1, 0, b""), simple(3, 0, b"unknown track"), group(1, 4, b"laced", 9, 4), simple(1, 30000, b"kept")]
    parts.append(el("a0", el("9b", uint(7)), el("a1", body(1, 5, b"before"))))
    assert scan(whole_file([track(1), VIDEO], [cluster(10, *parts)])) == [[1, 30010, None, b"kept"], [1, 15, None, b"before"]]


def test_ticks_are_rounded_to_milliseconds():
    data = whole_file([track(1)], [cluster(3, simple(1, 0, b"a"), group(1, 2, b"b", 1))], scale=500_000)
    assert scan(data) == [[1, 2, None, b"a"], [1, 3, 1, b"b"]]


def test_clusters_and_segments_of_unknown_size():
    clusters = [cluster(1000 * i, el("ec", bytes(3)), simple(1, 1, b"t%d" % i), size=UNKNOWN) for i in range(4)]
    data = whole_file([track(1)], clusters, size=UNKNOWN)
    wanted = [[1, 1000 * i + 1, None, b"t%d" % i] for i in range(4)]
    assert scan(data) == wanted
    assert scan(data, 0, 200) + scan(data, 200, len(data)) == wanted


def test_cut_off_files_and_other_files():
    clusters, wanted, _ = many(5)
    data = whole_file([track(1), VIDEO], clusters)
    assert scan(data[: len(data) - 10]) == wanted[:-1]
    assert scan(data[: len(data) - 3]) == [*wanted[:-1], [1, 4020, None, b"mor"]]
    for other in (b"", b"\x1a\x45\xdf\xa3", b"no such file" * 20, el("1a45dfa3") + el("18538067", cluster(0))):
        assert layout_of(Window(Held(other), len(other))) is None


def test_tracks_and_their_traits():
    lang = [el("22b59c", b"ger\0"), el("22b59d", b"de-AT"), el("536e", b" Forced "), el("88", b"\0"), el("55aa", b"\1")]
    found = layout_of(w := Window(Held(d := whole_file([track(1, b"S_TEXT/UTF8", b"\x11", *lang, compressed(3, b"ab")), track(4, b"D_WEBVTT/CAPTIONS"), VIDEO, track(5, b"A_AAC", b"\2"), track(6, b"S_HDMV/PGS")], []), ), len(d))).tracks
    assert w.size == len(d)
    assert [(t["track"], t["type"], t["kind"]) for t in found] == [(1, "subtitle", "plain"), (4, "subtitle", "webm"), (5, "audio", None), (6, "subtitle", None)]
    one = found[0]
    assert (one["uid"], one["language"], one["language_tag"], one["name"], one["is_default"], one["is_forced"], one["is_hearing_impaired"]) == (101, "ger", "de-AT", "Forced", False, True, False)
    assert (one["compression"], one["prefix"]) == ("header", b"ab")
    assert found[1]["is_hearing_impaired"] and found[1]["is_default"]


def test_large_files_are_cut_and_small_ones_share_a_task():
    parts = cut_files([("b", 1000), ("a", 10), ("c", 20)], split_over=500, range_bytes=300)
    assert [p.parts for p in parts] == [[("a", 10, 0, 10), ("b", 1000, 0, 333)], [("b", 1000, 333, 666)], [("b", 1000, 666, 1000)], [("c", 20, 0, 20)]]
    assert [p.parts for p in cut_files([("a", 499)], 500, 300)] == [[("a", 499, 0, 499)]]
    assert cut_files([], 500, 300) == []


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("films")
    clusters, _, cues = many(30)
    (out / "a.mkv").write_bytes(whole_file([track(1), VIDEO], clusters, cues))
    (out / "sub").mkdir()
    tracks = [track(1, b"S_TEXT/UTF8", b"\x11", compressed(0)), track(2, b"S_TEXT/UTF8", b"\x11", compressed(3, b"- ")), track(3, b"S_TEXT/ASS", b"\x11", el("63a2", b"\xef\xbb\xbf[Script Info]\r\nTitle: x\r\n")), track(4, b"D_WEBVTT/SUBTITLES"), track(5, b"S_TEXT/WEBVTT")]
    zipped = zlib.compress(b"whole")
    parts = [simple(1, 5000, zlib.compress(b"late\r\nline ")), simple(1, 0, zlib.compress(b"early")), simple(1, 0, zipped[:-2]), simple(1, 1, zipped + b"junk"), simple(1, 500, zlib.compress(b" \n"))]
    parts += [group(2, 0, b"one", 0), simple(2, 0, b"two"), simple(2, 700, b"thr\xffee")]
    parts += [simple(3, 10, b"0,1,Default,,0,0,0,,Hi, you\r\nthere"), group(3, 20, b"1,2,Top,,0,0,0,,End", 1000), simple(3, 30, b"no fields")]
    parts += [group(4, 0, b"id\nline:0\nshown\nnext", 40), group(5, 3_000, b"\xef\xbb\xbfvtt", 10)]
    (out / "sub" / "b.MKV").write_bytes(whole_file(tracks, [cluster(0, *parts)]))
    (out / "_hidden.mkv").write_bytes(b"x")
    (out / "notes.txt").write_bytes(b"x")
    return out


def test_files_of_a_folder_by_ranges(spark, folder):
    wanted = sorted((x[1], x[2] or -1, x[3]) for x in many(30)[1])
    for options in ({}, {"splitOver": 1, "rangeBytes": 700}, {"splitOver": 1, "rangeBytes": 700, "index": "false"}):
        blocks, tracks = matroska.read(spark, str(folder), **options)
        rows = blocks.where("path LIKE '%a.mkv'").collect()
        assert sorted((r.start_ms, r.duration_ms or -1, bytes(r.data)) for r in rows) == wanted
        assert blocks.count() == len(wanted) + 13 and tracks.count() == 6
    assert blocks.rdd.getNumPartitions() > 4
    only, _ = matroska.read(spark, str(folder), tracks="2,3")
    assert sorted({r.track for r in only.collect()}) == [2, 3]


def test_documents_of_tracks(spark, folder):
    blocks, tracks = matroska.read(spark, str(folder / "sub" / "b.MKV"))
    found = {r.track: (r.format, r.text) for r in matroska.documents(blocks, tracks).collect()}
    assert found[1] == ("srt", "1\n00:00:00,000 --> 00:00:00,500\nearly\n\n2\n00:00:05,000 --> 00:00:07,000\nlate\nline\n")
    # Equal starts do not end each other; a duration of nothing lasts a millisecond.
    assert found[2] == ("srt", "1\n00:00:00,000 --> 00:00:00,001\n- one\n\n2\n00:00:00,000 --> 00:00:00,700\n- two\n\n3\n00:00:00,700 --> 00:00:02,700\n- thr�ee\n")
    head = "[Script Info]\nTitle: x\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
    assert found[3] == ("ass", head + "Dialogue: 1,0:00:00.01,0:00:02.01,Default,,0,0,0,,Hi, you\\Nthere\nDialogue: 2,0:00:00.02,0:00:01.02,Top,,0,0,0,,End\n")
    assert found[4] == ("vtt", "WEBVTT\n\n00:00:00.000 --> 00:00:00.040\nshown\nnext\n")
    assert found[5] == ("vtt", "WEBVTT\n\n00:00:03.000 --> 00:00:03.010\nvtt\n")


def test_unreadable_files_fail_or_are_skipped(spark, tmp_path):
    (tmp_path / "bad.mkv").write_bytes(b"not one")
    (tmp_path / "empty.mkv").write_bytes(b"")
    with pytest.raises(Exception, match="not a readable Matroska file"):
        matroska.read(spark, str(tmp_path))[0].collect()
    blocks, tracks = matroska.read(spark, str(tmp_path), badFiles="skip")
    assert blocks.count() == 0 and tracks.count() == 0 and matroska.documents(blocks, tracks).count() == 0


def test_written_files_are_read_again(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    tracks = [{"number": 1, "language": "eng", "name": "One"}, {"number": 2, "compression": "zlib"}, {"number": 200, "compression": "header", "prefix": "- "}]
    n = F.col("id")
    track_ = F.element_at(F.array(*map(F.lit, (1, 2, 200))), (n % 3 + 1).cast("int"))
    rows = spark.range(3000).select(track_.alias("track"), (n * 97 % 3001 * 400).alias("start_ms"), F.when(n % 4 > 0, n % 50).alias("duration_ms"), F.concat(F.lit("- zeile ü "), n.cast("string")).alias("text"))
    matroska.write(rows, path, tracks, fileBytes=20_000, clusterBytes=3000)
    assert not (tmp_path / "out" / "_temporary").exists() or not any((tmp_path / "out" / "_temporary").rglob("*.mkv"))
    assert len(list((tmp_path / "out").glob("*.mkv"))) > 3
    for options in ({}, {"splitOver": 1, "rangeBytes": 5000}, {"splitOver": 1, "rangeBytes": 5000, "index": "false"}):
        blocks, found = matroska.read(spark, path, **options)
        got = matroska.decode(blocks, found).select("track", "start_ms", "duration_ms", "text")
        assert got.exceptAll(rows).count() == 0 and rows.select(*got.columns).exceptAll(got).count() == 0
    counts = {r.track: r.n for r in found.groupBy("track").agg(F.sum("frames").alias("n")).collect()}
    assert counts == {1: 1000, 2: 1000, 200: 1000}
    empty = rows.where("false")
    matroska.write(empty, f"{path}-none", tracks)
    assert matroska.read(spark, f"{path}-none")[0].count() == 0


def test_texts_that_cannot_be_written_are_errors(spark, tmp_path):
    one = lambda *row: spark.createDataFrame([row], "track long, start_ms long, duration_ms long, text string")
    for row, message in (((9, 0, 1, "x"), "no such track"), ((1, -1, 1, "x"), "no time from 0 on"), ((2, 0, 1, "x"), "prefix")):
        with pytest.raises(Exception, match=message):
            matroska.write(one(*row), str(tmp_path / "out"), [{"number": 1}, {"number": 2, "compression": "header", "prefix": "- "}])
    assert not list((tmp_path / "out").glob("*.mkv"))
