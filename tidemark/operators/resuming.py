"""Jobs that stopped midway: what is outstanding, where to go on and with which context, and rounds of retries.

Cues are rows (doc_id, pos, text, start_ms, end_ms, ...); done holds (doc_id, pos, translation). A blank or missing
translation is none. A row of done that has no cue is passed over, and repeated rows of done count once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import edges as E
from tidemark.functions import text as T
from tidemark.operators.cues import doc_order, scenes

# Context rows, sizes of chunks by round, and rounds.
MOST_SCENE_CONTEXT, MOST_SENTENCE_CONTEXT = 200, 8
ROUND_CHUNKS = [1000, 300]
SCENE_CHUNK = 150
ROUNDS = 2
SCENE_GAP_SECONDS = 30


def marked(cues: DataFrame, done: DataFrame) -> DataFrame:
    """cues with outstanding: there is something to translate, and no translation yet."""
    ready = done.where(F.btrim("translation") != "").select("doc_id", "pos").distinct().withColumn("__ready", F.lit(True))
    return cues.join(ready, ["doc_id", "pos"], "left").withColumn("outstanding", F.coalesce(T.translatable(F.col("text")), F.lit(False)) & F.col("__ready").isNull()).drop("__ready")


def sentence_goes_on() -> Column:
    """Does a cue go on from the one before, by the rules for Latin scripts?"""
    last = lambda x: F.lag(x).over(doc_order())
    text = F.col("text")
    return E.goes_on_latin(last(text), last(E.tail_flags(text)), text, E.head_flags(text), F.col("start_ms") - last(F.col("end_ms")))


def resume_rows(cues: DataFrame, done: DataFrame, goes_on: Column | None = None, latin: bool = True, most_scene: int = MOST_SCENE_CONTEXT, most_sentence: int = MOST_SENTENCE_CONTEXT) -> DataFrame:
    """cues (with scene) to send again, with role: those outstanding (open), and context before the first of them.

    Context are the earlier cues of its scene. With most_scene of them or more, it is only its own sentence, at most
    most_sentence cues back, where goes_on says that a cue continues the one before; and nothing in scripts other than
    Latin. Documents with nothing outstanding give no rows.
    """
    whole = W.partitionBy("doc_id")
    n, first, scene = F.col("__n"), F.col("__first"), F.col("__scene")
    rows = marked(cues, done).withColumns({"__n": F.row_number().over(doc_order()), "__on": F.coalesce(goes_on if goes_on is not None else sentence_goes_on(), F.lit(False))})
    rows = rows.withColumn("__first", F.min(F.when(F.col("outstanding"), n)).over(whole)).where(first.isNotNull())
    rows = rows.withColumn("__scene", F.max(F.when(n == first, F.col("scene"))).over(whole))
    begun = F.max(F.when((n <= first) & (~F.col("__on") | (n == 1)), n)).over(whole)
    rows = rows.withColumns({"__back": F.count_if((n < first) & (F.col("scene") == scene)).over(whole), "__start": F.greatest(first - most_sentence, begun)})
    context = F.when(F.col("__back") < most_scene, F.col("scene") == scene).otherwise(F.lit(latin) & (n >= F.col("__start")))
    kept = rows.where(F.when(n < first, context).otherwise(F.col("outstanding")))
    return kept.withColumn("role", F.when(n < first, "context").otherwise("open")).drop("__n", "__on", "__first", "__scene", "__back", "__start", "outstanding")


def cut_at_scenes(scene: np.ndarray, later: np.ndarray, most: int) -> np.ndarray:
    """Chunk numbers of cues in order, from their scenes and the least scene from each on. A chunk ends at the last place
    in its second half where no scene goes on, else after most cues; a rest of at most `most` is one chunk."""
    chunk, start, number, least = np.zeros(len(scene), int), 0, 0, -(-most // 2)
    while len(scene) - start > most:
        before = np.maximum.accumulate(scene[start : start + most])[least - 1 :]
        free = np.flatnonzero(before < later[start + least : start + most + 1])
        end = start + (least + int(free[-1]) if len(free) else most)
        chunk[start:end] = number
        start, number = end, number + 1
    chunk[start:] = number
    return chunk


def request_chunks(rows: DataFrame, most: int) -> DataFrame:
    """doc_id, pos, chunk (from 0 in a document) of rows with scene, at most `most` in each. Only numbers go to the tasks."""
    kind = dict(rows.dtypes)

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        return pd.DataFrame({"doc_id": group["doc_id"], "pos": group["pos"], "chunk": cut_at_scenes(group["scene"].to_numpy(), group["later"].to_numpy(), most)})

    if most < 1:
        raise ValueError("a chunk holds one cue at least")
    scene = F.coalesce(F.col("scene"), F.lit(0)).cast("long")
    later = F.min(scene).over(doc_order().rowsBetween(0, W.unboundedFollowing))
    return rows.select("doc_id", "pos", scene.alias("scene"), later.alias("later")).groupBy("doc_id").applyInPandas(cut, f"doc_id {kind['doc_id']}, pos {kind['pos']}, chunk long")


def chunk_size(round_: int, scene_level: bool) -> int:
    return SCENE_CHUNK if scene_level or round_ > len(ROUND_CHUNKS) else ROUND_CHUNKS[round_ - 1]


def retry_round(cues: DataFrame, done: DataFrame, round_: int, scene_level: bool = False) -> DataFrame:
    """cues (with scene) that are outstanding, with the chunk in which a round of retries sends them."""
    rest = marked(cues, done).where("outstanding").drop("outstanding")
    return rest.join(request_chunks(rest, chunk_size(round_, scene_level)), ["doc_id", "pos"])


def complete(cues: DataFrame, done: DataFrame, attempt: Callable[[DataFrame], DataFrame], folder: str, rounds: int = ROUNDS, gap_seconds: float = SCENE_GAP_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(translations, outstanding cues) after some rounds of retries.

    attempt gets cues with chunk and returns doc_id, pos, translation, cut, where cut says that a chunk's answer broke off.
    After a round in which one did, what remains is sent by scenes; if one does again then, the rounds end. Each round is
    a table in folder, which all executors share: a run that was stopped begins after the last round that was written
    whole. The folder belongs to one set of cues.
    """
    spark, scened = cues.sparkSession, scenes(cues.withColumn("__kind", F.lit(0)), gap_seconds, "__kind").drop("__kind")
    known, scene_level = done.select("doc_id", "pos", "translation"), False
    for round_ in range(1, rounds + 1):
        path = f"{folder}/round={round_}"
        if not _written(spark, path):
            attempt(retry_round(scened, known, round_, scene_level)).select("doc_id", "pos", "translation", "cut").write.mode("overwrite").parquet(path)
        answers = spark.read.parquet(path)
        if answers.isEmpty():
            break
        known = known.unionByName(answers.where(F.btrim("translation") != "").drop("cut"))
        if not answers.where("cut").isEmpty():
            if scene_level or chunk_size(round_, scene_level) <= SCENE_CHUNK:
                break
            scene_level = True
    ready = known.where(F.btrim("translation") != "").groupBy("doc_id", "pos").agg(F.max("translation").alias("translation"))
    return ready, marked(cues, ready).where("outstanding").drop("outstanding")


def _written(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
