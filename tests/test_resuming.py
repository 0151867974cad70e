"""Jobs taken up again: context rows, chunks and rounds; streams with state that ends."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import resuming as R
from tidemark.streaming import jobs

CUES = "doc_id string, pos int, text string, start_ms long, end_ms long, scene long"
DONE = "doc_id string, pos int, translation string"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def cue_table(spark, docs):
    """docs: doc_id -> [(text, scene)]"""
    rows = [(d, i, text, i * 1000, i * 1000 + 900, scene) for d, cues in docs.items() for i, (text, scene) in enumerate(cues)]
    return spark.createDataFrame(rows, CUES)


def sent(df):
    return sorted((r.doc_id, r.pos, r.role) for r in df.collect())


def test_context_is_the_scene_before_the_breakpoint(spark):
    cues = cue_table(spark, {"a": [("one", 0), ("two", 1), ("three", 0), ("four", 0), ("five", 1), ("12 !", 0)], "b": [("done", 0)], "c": [("!?", 0)]})
    done = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("a", 1, "y"), ("a", 2, "z"), ("a", 3, " "), ("b", 0, "x"), ("a", 99, "q")], DONE)
    assert sent(R.resume_rows(cues, done)) == [("a", 0, "context"), ("a", 2, "context"), ("a", 3, "open"), ("a", 4, "open")]
    assert sent(R.resume_rows(cues, done.where("false"))) == [("a", i, "open") for i in range(5)] + [("b", 0, "open")]
    assert R.resume_rows(cues.where("false"), done).count() == 0
    # Too many cues of the scene: the sentence instead, or nothing.
    assert sent(R.resume_rows(cues, done, F.col("pos") > 2, most_scene=2)) == [("a", 2, "context"), ("a", 3, "open"), ("a", 4, "open")]
    assert sent(R.resume_rows(cues, done, F.col("pos") > 0, most_scene=2, most_sentence=2)) == [("a", 1, "context"), ("a", 2, "context"), ("a", 3, "open"), ("a", 4, "open")]
    assert sent(R.resume_rows(cues, done, F.lit(None).cast("boolean"), most_scene=2)) == [("a", 3, "open"), ("a", 4, "open")]
    assert sent(R.resume_rows(cues, done, F.col("pos") > 0, latin=False, most_scene=2)) == [("a", 3, "open"), ("a", 4, "open")]


def test_sentences_by_the_rules_for_latin_scripts(spark):
    cues = cue_table(spark, {"a": [("It is over.", 0), ("We went,", 0), ("and then we", 0), ("came back", 0)]})
    done = spark.createDataFrame([("a", i, "x") for i in range(3)], DONE)
    assert sent(R.resume_rows(cues, done, most_scene=1)) == [("a", 1, "context"), ("a", 2, "context"), ("a", 3, "open")]


def plain_chunks(scenes, most):
    """Tries every end of each chunk."""
    out, start = [], 0
    while len(scenes) - start > most:
        ends = [e for e in range(start + (most + 1) // 2, start + most + 1) if max(scenes[start:e]) < min(scenes[e:])]
        end = max(ends, default=start + most)
        out.append(end - start)
        start = end
    return out + [len(scenes) - start]


def test_chunks_against_every_place():
    rng = np.random.default_rng(3)
    for _ in range(400):
        n, most = int(rng.integers(1, 40)), int(rng.integers(1, 9))
        scenes = np.cumsum(rng.integers(0, 2, n)) - rng.integers(0, 2, n) * rng.integers(0, 3)
        later = np.minimum.accumulate(scenes[::-1])[::-1]
        got = R.cut_at_scenes(scenes, later, most)
        assert list(np.bincount(got)) == plain_chunks(list(scenes), most), (scenes, most)


def test_rounds_send_what_is_outstanding_in_smaller_chunks(spark, tmp_path):
    cues = cue_table(spark, {"a": [(f"line {i}", 0) for i in range(2500)], "b": [("only", 0)]}).drop("scene")
    none = spark.createDataFrame([], DONE)
    calls = []

    def attempt(rows):
        sizes = sorted(r.n for r in rows.groupBy("doc_id", "chunk").agg(F.count("*").alias("n")).collect())
        calls.append((rows.count(), max(sizes, default=0)))
        answered = F.when(F.col("chunk") == 0, F.concat(F.lit("t:"), "text")).otherwise("")
        return rows.select("doc_id", "pos", answered.alias("translation"), F.lit(False).alias("cut"))

    ready, rest = R.complete(cues, none, attempt, str(tmp_path / "one"))
    assert calls == [(2501, 1000), (1500, 300)]
    assert ready.count() == 1301 and rest.count() == 1200
    # Stopped and begun again: the rounds that were written are not sent again, a further one goes on by scenes.
    again, _ = R.complete(cues, none, attempt, str(tmp_path / "one"))
    assert len(calls) == 2 and again.exceptAll(ready).count() == 0
    more, rest = R.complete(cues, none, attempt, str(tmp_path / "one"), rounds=3)
    assert calls[2:] == [(1200, 150)] and more.count() == 1451 and rest.count() == 1050


def test_chunks_that_break_off_lead_to_scenes_and_then_to_an_end(spark, tmp_path):
    cues = cue_table(spark, {"a": [(f"line {i}", 0) for i in range(400)]}).drop("scene")
    sizes = []

    def attempt(rows):
        sizes.append(rows.groupBy("chunk").count().agg(F.max("count")).first()[0])
        return rows.select("doc_id", "pos", F.when(F.col("pos") == len(sizes), "x").alias("translation"), F.lit(True).alias("cut"))

    ready, rest = R.complete(cues, spark.createDataFrame([], DONE), attempt, str(tmp_path / "cut"), rounds=5)
    assert sizes == [400, 150] and ready.count() == 2 and rest.count() == 398


def run(spark, df, name, checkpoint):
    q = df.writeStream.format("parquet").option("path", f"{checkpoint}-out").option("checkpointLocation", str(checkpoint)).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(f"{checkpoint}-out")


def held(spark, checkpoint, name):
    return spark.read.format("statestore").option("stateVarName", name).load(str(checkpoint)).count()


@pytest.fixture
def few(spark):
    """One partition of state a query: each is a store of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_parts_give_each_cue_once(spark, tmp_path, few):
    kind = "doc_id string, cue long, part int, parts int, text string, ts timestamp"
    add = lambda *rows: spark.createDataFrame(list(rows), kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    step = lambda: run(spark, jobs.merged_cues(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))), "m", tmp_path / "c")
    shown = lambda df: sorted((r.doc_id, r.cue, r.text, r.complete) for r in df.collect())
    add(("a", 1, 1, 2, "two", at(0)), ("a", 2, 0, 1, "whole", at(0)), ("b", 1, 0, 3, "never", at(0)), ("b", 1, 2, 3, "whole", at(0)))
    first = [("a", 2, "whole", True)]
    assert shown(step()) == first
    # Out of order, repeated, and in a new run of the stream.
    add(("a", 1, 0, 2, "one", at(1)), ("a", 1, 1, 2, "two", at(1)), ("a", 2, 0, 1, "whole", at(1)))
    second = sorted(first + [("a", 1, "one\ntwo", True)])
    assert shown(step()) == second
    add(("a", 1, 0, 2, "old", at(0)), ("a", 1, 1, 2, "TWO", at(2)))
    third = sorted(second + [("a", 1, "one\nTWO", True)])
    assert shown(step()) == third
    assert held(spark, tmp_path / "c", "head") == 3
    # Hours later: what is whole goes quietly, the rest comes as it is; nothing but the new key is held.
    add(("z", 1, 0, 1, "late", at(600)))
    assert shown(step()) == sorted(third + [("b", 1, "never\nwhole", False), ("z", 1, "late", True)])
    assert held(spark, tmp_path / "c", "head") == 1


def test_jobs_are_taken_up_again_and_end_after_days(spark, tmp_path, few):
    kind = "job string, fingerprint string, cue long, translation string, ts timestamp"
    add = lambda *rows: spark.createDataFrame(list(rows), kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    step = lambda: run(spark, jobs.job_progress(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))), "j", tmp_path / "c")
    seen = set()

    def new(df):
        rows = {(r.job, r.fingerprint, r.cue, r.translation, r.expired) for r in df.collect()}
        out = sorted(rows - seen, key=str)
        seen.update(rows)
        return out

    add(("j", "f1", 1, "eins", at(0)), ("j", "f1", 2, " ", at(0)), ("k", "g", 7, "sieben", at(0)))
    assert new(step()) == [("j", "f1", 1, "eins", False), ("k", "g", 7, "sieben", False)]
    # Stopped midway, begun again: what was there is not shown again.
    add(("j", "f1", 1, "eins", at(5)), ("j", "f1", 2, "zwei", at(5)))
    assert new(step()) == [("j", "f1", 2, "zwei", False)]
    # The text has changed: the job begins anew, and answers for the old text no longer count.
    add(("j", "f2", 1, "one", at(10)), ("j", "f1", 3, "drei", at(9)))
    assert new(step()) == [("j", "f2", 1, "one", False)]
    assert held(spark, tmp_path / "c", "head") == 2
    add(("m", "h", 1, "x", at(60 * 24 * 9)))
    assert new(step()) == [("j", "f2", None, None, True), ("k", "g", None, None, True), ("m", "h", 1, "x", False)]
    assert held(spark, tmp_path / "c", "head") == 1
