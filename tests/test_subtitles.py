import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.functions import text as T
from tidemark.operators import cues as C
from tidemark.sources import files, records, sinks, subtitles

SRT = """﻿1\r
00:00:01,000 --> 00:00:03,500\r
{\\an8}<i>Hello,</i>\r
world.\r
\r
00:00:03,600 --> 00:00:05,000\r
- You there?\r
- Yes.\r
\r
3\r
00:00:06,000 --> 00:00:07,000\r
   \r
\r
4\r
00:00:08.000 --> 00:00:09.000 X\r
last"""

VTT = """WEBVTT - title
Kind: captions

NOTE first

one
00:01.000 --> 00:02.500 line:0 align:start
Hi <b>you</b>

STYLE
::cue {}

01:00:00.000 --> 01:00:01.000
there

NOTE end"""

ASS = """[Script Info]
Title: x

[Events]
Format: Layer, Start
Dialogue: 0,0:00:01.50,0:00:02.00,Default,,0,0,0,,{\\an8}One, two\\Nthree
Comment: kept
Dialogue: 1,0:00:03.00,0:00:04.00,Alt,Bob,1,2,3,fx,{\\p1}m 0 0
Dialogue: 0,1:00:03.00,1:00:04.00,Default,,0,0,0,,plain\\hText"""


def frame(spark, text, fmt):
    return spark.createDataFrame([("d", fmt, text), ("none", fmt, "nothing")], "doc_id string, format string, text string")


def test_srt(spark):
    got = [tuple(r) for r in subtitles.parse_srt(frame(spark, SRT, "srt")).orderBy("pos").collect()]
    assert got == [
        ("d", 0, 1, 1000, 3500, "<i>Hello,</i>\nworld.", 8),
        ("d", 1, 2, 3600, 5000, "- You there?\n- Yes.", None),
        ("d", 2, 3, 8000, 9000, "last", None),
    ]


def test_vtt(spark):
    a, b = subtitles.parse_vtt(frame(spark, VTT, "vtt")).orderBy("pos").collect()
    assert (a.start_ms, a.end_ms, a.text, a.cue_settings, a.identifier) == (1000, 2500, "Hi <b>you</b>", "line:0 align:start", "one")
    assert a.header == "WEBVTT - title\nKind: captions" and a.leading_blocks == ["NOTE first"] and a.trailing_blocks == []
    assert (b.start_ms, b.text, b.header, b.leading_blocks, b.trailing_blocks) == (3_600_000, "there", None, ["STYLE\n::cue {}"], ["NOTE end"])


def test_ass(spark):
    a, b = subtitles.parse_ass(frame(spark, ASS, "ass")).orderBy("pos").collect()
    assert (a.start_ms, a.end_ms, a.text, a.top_align, a.cue_settings) == (1500, 2000, "One, two\nthree", 8, "0|Default||0|0|0|")
    assert a.header.startswith("[Script Info]") and a.header.endswith("Format: Layer, Start")
    assert (b.start_ms, b.text) == (3_603_000, "plain Text")
    assert [x.split(":")[0] for x in b.leading_blocks] == ["Comment", "Dialogue"]


@pytest.mark.parametrize("fmt", ["srt", "vtt", "ass"])
def test_round_trip(spark, fmt):
    rows = [("d", i, i * 1000, i * 1000 + 990, f"line {i}\nmore, of it", None, 8 if i == 2 else None) for i in range(12)]
    cues = spark.createDataFrame(rows, "doc_id string, pos int, start_ms long, end_ms long, text string, translation string, top_align int")
    text = sinks.RENDERERS[fmt](cues).withColumnRenamed("content", "text").withColumn("format", F.lit(fmt))
    got = [(r.pos, r.start_ms, r.end_ms, r.text) for r in subtitles.parse(text).orderBy("pos").collect()]
    assert got == [(i, a, b, t) for _, i, a, b, t, *_ in rows]


def test_bilingual_text(spark):
    cue = spark.createDataFrame([("d", 0, 0, 1000, "a\nb", "x", None), ("d", 1, 2000, 3000, "c", " ", None)], "doc_id string, pos int, start_ms long, end_ms long, text string, translation string, top_align int")
    assert sinks.render_srt(cue).first().content == "1\n00:00:00,000 --> 00:00:01,000\nx\n\n2\n00:00:02,000 --> 00:00:03,000\nc\n"
    assert "\nx\na b\n" in sinks.render_srt(cue, "bilingual").first().content
    assert "\na b\nx\n" in sinks.render_srt(cue, "bilingual", "original_top").first().content


def test_scene_example(spark):
    rows = [(1, "dialogue", 0, 1000), (2, "music", 500, 2000), (3, "dialogue", 20000, 21000), (4, "music", 60000, 61000), (5, "dialogue", 60000, 60500), (6, "dialogue", 61000, 62000), (7, "music", 62000, 63000)]
    cues = spark.createDataFrame([("d", *r) for r in rows], "doc_id string, pos int, kind string, start_ms long, end_ms long")
    assert [r.scene for r in C.scenes(cues).orderBy("pos").collect()] == [0, 1, 0, 2, 3, 3, 2]


def test_clock(spark):
    df = spark.createDataFrame([(-5,), (3_661_001,), (360_000_000,), (9_996,)], "ms long")
    got = [tuple(r) for r in df.select(clock.srt_time(F.col("ms")), clock.vtt_time(F.col("ms")), clock.ass_time(F.col("ms"))).collect()]
    assert got[0] == ("00:00:00,000", "00:00:00.000", "0:00:00.00")
    assert got[1] == ("01:01:01,001", "01:01:01.001", "1:01:01.00")
    assert got[2][0] == "100:00:00,000" and got[3][2] == "0:00:10.00"
    assert spark.range(1).select(clock.to_ms(F.lit("x")), clock.to_ms(F.lit("1:02:03.004"))).first()[:] == (None, 3_723_004)


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.newline_style(F.lit("a\r\nb\r\nc\n"))) == "crlf"
    assert one(T.translatable(F.lit("♪ 12 - !"))) is False and one(T.translatable(F.lit("♪ la"))) is True
    assert one(T.stutter_strip(F.lit("I-I am, b-but"))) == "I am, but"
    assert one(T.html_unescape(T.html_escape(F.lit("<a href='x'>&</a>")))) == "<a href='x'>&</a>"
    assert one(T.main_script(F.lit("привет abc"))) == "Cyrillic"
    assert one(T.compact_number(F.lit(1234))) == "1.2k" and one(T.compact_number(F.lit(3_400_000))) == "3.4M"
    assert one(T.collapse_style_wraps(F.lit("<i>a</i> <i>b</i>"))) == "<i>a b</i>"
    assert one(T.dash_segments(F.lit("- You?\n- Yes,\nme."))) == ["You?", "Yes,\nme."]
    assert one(T.strip_captions(F.lit("[door (loud) slams] Hi"))) == "Hi"
    assert one(T.strip_speaker(F.lit("JOHN SMITH: hello"))) == "hello"
    assert one(T.fold_accents(F.lit("Ñandú Žižek"))) == "nandu zizek"
    assert one(T.output_name(F.lit("a.srt"), F.lit("vtt"), F.lit("auto"), F.lit("de"), True)) == "a.de.en.vtt"
    assert one(T.equal_but_noise(F.lit("Hello, world!"), F.lit("Hello world"))) is True


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.SRT").write_bytes("﻿x\r\ny".encode())
    (tmp_path / "b.vtt").write_bytes("日本語のテキストです\n".encode("shift_jis"))
    (tmp_path / "u.ass").write_bytes("plain text in utf".encode("utf-16-le"))
    (tmp_path / "bin.srt").write_bytes(b"\x01\x02\x03")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("in/c.srt", "zipped")
        z.writestr("skip.exe", "no")
    (tmp_path / "z.zip").write_bytes(buffer.getvalue())
    found = files.read_files(spark, str(tmp_path))
    assert {r.name: r.kind for r in found.collect()} == {"a.SRT": "subtitle", "b.vtt": "subtitle", "u.ass": "subtitle", "bin.srt": "subtitle", "z.zip": "zip"}
    plain = {r.name: r for r in files.decode(found.where("kind = 'subtitle'")).collect()}
    assert set(plain) == {"a.SRT", "b.vtt", "u.ass"}
    assert (plain["a.SRT"].text, plain["a.SRT"].bom, plain["a.SRT"].newline, plain["a.SRT"].format) == ("x\r\ny", True, "crlf", "srt")
    assert (plain["b.vtt"].encoding, plain["b.vtt"].text) == ("shift_jis", "日本語のテキストです\n")
    assert plain["u.ass"].encoding == "utf-16-le"
    assert [(r.name, r.text) for r in files.decode(files.unzip(found)).collect()] == [("in/c.srt", "zipped")]
    back = sinks.encode(files.decode(found.where("name = 'a.SRT'")).withColumn("content", F.lit("p\nq"))).first().content
    assert bytes(back) == "﻿p\r\nq".encode()
    zipped = sinks.zip_files(spark.createDataFrame([("o.zip", "b.txt", b"2"), ("o.zip", "a.txt", b"1")], "archive string, name string, content binary")).first()
    assert zipfile.ZipFile(io.BytesIO(zipped.content)).namelist() == ["a.txt", "b.txt"]


def test_records(spark):
    lines = spark.createDataFrame([(x,) for x in ('{"type":"init"}', '{"type":"result_chunk","data":{"cues":[{"id":1,"translation":"a","is_music":false}]}}', "no json", "{}")], "value string")
    assert [r.type for r in records.parse_events(lines).collect()] == ["init", "result_chunk"]
    good = '{"cues":[{"id":1,"start_ms":0,"end_ms":1,"text":"a"}],"source":"en","target":"de","glossary":{"a":"b"}}'
    requests = spark.createDataFrame([(1, good), (2, good.replace('"en"', '""')), (3, '{"cues":[]}'), (4, good.replace('"a":"b"', f'"a":"{"x" * 201}"'))], "request_id int, value string")
    got = {r.request_id: r for r in records.parse_requests(requests).collect()}
    assert [got[i].problem for i in (1, 2, 3, 4)] == [None, "no language", "no cues", None]
    assert got[1].glossary == {"a": "b"} and got[4].glossary == {}
    table = "| id | component_id | title | start_utc | end_utc | severity | description |\n|---|---|---|---|---|---|---|\n| m1 | api | Up | 2024-01-01T00:00:00Z | 2024-01-01T02:00:00Z | odd | text |\n| m2 | api | Up | soon | later | minor | x |\n| short |"
    got = records.parse_schedule(spark.createDataFrame([(x,) for x in table.split("\n")], "value string")).collect()
    assert [(r.id, r.severity) for r in got] == [("m1", "minor")]
    feed = "<rss><item><title><![CDATA[A &amp; B]]></title><link>u</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item><entry><title>C</title><updated>2024-01-03T00:00:00Z</updated></entry></rss>"
    got = records.parse_feed(spark.createDataFrame([("f", feed)], "doc_id string, text string")).orderBy("pos").collect()
    assert [(r.title, r.published.strftime("%Y-%m-%d %H")) for r in got] == [("A & B", "2024-01-02 10"), ("C", "2024-01-03 00")]


def test_event_lines_hide_secrets(spark):
    df = spark.createDataFrame([("log", "ok"), ("log", "token=abcdefghijklmnopqrstu")], "type string, message string")
    assert [r.value for r in sinks.event_lines(df).collect()] == ['{"type":"log","message":"ok"}', '{"type":"error","code":1500}']


def test_pairs_and_bilingual(spark):
    rows = []
    for i in range(8):
        rows += [("d", 2 * i, i * 3000, i * 3000 + 2000, f"hello number {i}"), ("d", 2 * i + 1, i * 3000 + 50, i * 3000 + 2000, f"привет {i}")]
    events = spark.createDataFrame(rows, "doc_id string, pos int, start_ms long, end_ms long, text string")
    pairs = C.pair_timeline(events)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(2 * i, 2 * i + 1) for i in range(8)]
    assert [(r.doc_id, r.pairs, r.share) for r in C.bilingual_documents(events, pairs).collect()] == [("d", 8, 1.0)]


def test_markers_and_cover(spark):
    df = spark.createDataFrame([("d", "⟦c1⟧ one ⟦c2⟧two⟦c2⟧again")], "doc_id string, text string")
    assert [(r.marker, r.part) for r in C.marker_parts(df).collect()] == [(1, "one")]
    groups = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (2, "d"), (3, "a")], "group_id int, key string")
    assert C.greedy_cover(groups, 5) == [2, 1]


def test_wrap(spark):
    df = spark.createDataFrame([("word " * 12,), ("short",), (None,)], "text string")
    got = [r.text for r in C.wrap_lines(df, "text").collect()]
    assert got[0].count("\n") == 1 and got[1:] == ["short", None]
