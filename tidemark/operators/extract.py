"""From cues to units of translation: segments, sides, reasons to merge, groups, chapters, units; lyrics set aside; plans of
requests.

Rows are (doc_id, pos, cue_id, text, start_ms, end_ms, resolved), resolved being a text that needs no translation. What
looks at neighbours is a window; the two rules that carry a state (an open quote, the size of a group) are folds of one
document over columns of flags that the JVM has computed. A document is the unit that one task sorts and folds.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import edges as E
from tidemark.functions import text as T
from tidemark.operators.cues import doc_order, scenes

# Bounds of groups and quotes, sizes of request frames.
MOST_SEGMENTS, MOST_QUOTED = 16, 10
CUE_FRAME, INDEX_REPEATS, GROUP_FRAME, CONTEXT_FRAME, AMPERSAND_GROWTH = 23, 2, 11, 26, 4
PLANNING, CUT_WINDOW, MOST_PARTS = 0.8, 0.15, 12


def segments(cues: DataFrame) -> DataFrame:
    """One row per dialogue turn of a cue: doc_id, pos, cue_id, turn, text, times, resolved (texts without any letter or
    digit), music, tail, head."""
    rows = cues.select("doc_id", F.col("pos").alias("cue_id"), "start_ms", "end_ms", F.posexplode(E.turns(F.coalesce("text", F.lit(""))))).withColumnsRenamed({"pos": "turn", "col": "text"})
    rows = rows.withColumn("resolved", F.when(~F.col("text").rlike(r"[\p{L}\p{N}_]"), F.col("text")))
    rows = rows.withColumn("pos", F.row_number().over(W.partitionBy("doc_id").orderBy("cue_id", "turn")))
    return flagged(rows)


def flagged(rows: DataFrame) -> DataFrame:
    text = F.col("text")
    return rows.withColumns({"music": T.is_music(text), "tail": E.tail_flags(text), "head": E.head_flags(text)})


def merge_sides(rows: DataFrame, most_words: int = 2) -> DataFrame:
    """segments with merge_side: a short line that stands alone goes to the next one, else to the one before, if that is
    near and no music."""
    near = lambda gap, music: F.coalesce((gap <= E.ADJACENT_MS) & ~music, F.lit(False))
    alone = F.col("resolved").isNull() & ~F.col("music") & E.isolated_short(F.col("text"), most_words)
    ahead = near(F.lead("start_ms").over(doc_order()) - F.col("end_ms"), F.lead("music").over(doc_order()))
    back = near(F.col("start_ms") - F.lag("end_ms").over(doc_order()), F.lag("music").over(doc_order()))
    return rows.withColumn("merge_side", F.when(alone & ahead, "next").when(alone & back, "prev"))


def merge_reasons(rows: DataFrame, latin: bool = True) -> DataFrame:
    """segments (with merge_side) with gap_ms and reason: why a segment joins the one before (dash, music, marker, gap), or
    null."""
    last = lambda name: F.lag(name).over(doc_order())
    c = F.col
    gap = c("start_ms") - last("end_ms")
    rule = E.goes_on_latin if latin else E.goes_on
    goes_on = rule(last("text"), last("tail"), c("text"), c("head"), gap)
    reason = (
        F.when(last("cue_id").isNull() | (last("music") != c("music")), None)
        .when(last("cue_id") == c("cue_id"), F.when(E.short_reply(c("text")), "dash"))
        .when(c("music"), F.when(E.music_goes_on(c("text")), "music"))
        .when(F.coalesce(last("merge_side") == "next", F.lit(False)) | F.coalesce(c("merge_side") == "prev", F.lit(False)), "marker")
        .when(gap < -E.OVERLAP_MS, None)
        .when(E.has(c("head"), E.HEAD_CLOSER) | E.has(last("tail"), E.TAIL_OPENER), F.when(gap <= E.ADJACENT_MS, "gap"))
        .when(goes_on, "gap")
    )
    return rows.withColumns({"gap_ms": gap, "reason": reason})


def number_groups(rows: pd.DataFrame) -> pd.DataFrame:
    """group and marked of one document's segments: open quotes join what is near, reasons join the rest; chains stop at
    MOST_SEGMENTS but for dashes and markers, a resolved segment stands alone."""
    rows = rows.sort_values("pos", kind="stable")
    numbers, marks = [], []
    group = size = quoted = 0
    pending = False
    for alone, reason, gap, fresh, still in zip(rows.resolved.notna(), rows.reason, rows.gap_ms, rows.fresh, rows.still, strict=True):
        full = size >= MOST_SEGMENTS
        in_quote = bool(size) and not full and pending and gap <= E.ADJACENT_MS
        by_reason = bool(size) and not in_quote and isinstance(reason, str) and not (full and reason in ("gap", "music"))
        joins = not alone and (in_quote or by_reason)
        if not joins:
            group, size, quoted, pending = group + 1, 0, 0, False
        numbers.append(group)
        marks.append(joins and by_reason and reason in ("dash", "marker"))
        if alone:
            continue
        size += 1
        pending = still if pending else fresh
        quoted = quoted + 1 if pending else 0
        pending = pending and quoted < MOST_QUOTED
    return rows.assign(group=np.array(numbers, dtype="int64"), marked=np.array(marks, dtype=bool)).drop(columns=["fresh", "still"])


def groups(rows: DataFrame) -> DataFrame:
    """segments (with reasons) with group, counted from 1 in a document, and marked."""
    ready = rows.withColumns({"fresh": E.open_after(F.col("text"), False), "still": E.open_after(F.col("text"), True)})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", group long, marked boolean"
    return ready.groupBy("doc_id").applyInPandas(number_groups, schema)


def number_units(rows: pd.DataFrame) -> pd.DataFrame:
    """unit of one document's groups, chapter by chapter: in music, groups are put together while they fit."""
    rows = rows.sort_values(["scene", "pos"], kind="stable")
    numbers = []
    unit, size, chapter = 0, 0, -1
    for scene, kind, alone, n in zip(rows.scene, rows.kind, rows.alone, rows.n, strict=True):
        fits = kind == "music" and scene == chapter and size > 0 and not alone and size + n <= MOST_SEGMENTS
        unit, size, chapter = (unit, size + n, scene) if fits else (unit + 1, 0 if alone else n, scene)
        numbers.append(unit)
    return pd.DataFrame({"doc_id": rows.doc_id, "group": rows.pos, "chapter": rows.scene + 1, "kind": rows.kind, "unit": np.array(numbers, dtype="int64")})


def units(rows: DataFrame, scene_seconds: float = 30) -> DataFrame:
    """doc_id, chapter, kind, unit, first_pos, n (segments), text, resolved of segments (with group). Groups with music open
    chapters of their own."""
    found = rows.groupBy("doc_id", F.col("group").alias("pos")).agg(
        F.min_by("start_ms", "pos").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"), F.count("*").alias("n"), F.max("music").alias("music"), F.max(F.col("resolved").isNotNull()).alias("alone")
    )
    found = scenes(found.withColumn("kind", F.when(F.col("music"), "music").otherwise("dialogue")), scene_seconds).withColumn("scene", F.col("scene").cast("long"))
    doc_type = rows.schema["doc_id"].dataType.simpleString()
    numbered = found.select("doc_id", "pos", "scene", "kind", "alone", "n").groupBy("doc_id").applyInPandas(number_units, f"doc_id {doc_type}, group long, chapter long, kind string, unit long")
    said = F.when(F.col("kind") == "music", F.regexp_replace("text", rf"^[{T.MUSIC}\s]+|[{T.MUSIC}\s]+$", "")).otherwise(F.col("text"))
    parts = rows.join(numbered, ["doc_id", "group"]).withColumn("said", said).groupBy("doc_id", "chapter", "kind", "unit")
    out = parts.agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "said"))).alias("said"), F.max("resolved").alias("resolved"))
    text = F.when(F.col("resolved").isNotNull(), "").otherwise(F.btrim(F.array_join("said.said", " ")))
    return out.select("doc_id", "chapter", "kind", "unit", "first_pos", "n", text.alias("text"), "resolved")


def extract_units(cues: DataFrame, scene_seconds: float = 30, most_words: int = 2, latin: bool = True) -> DataFrame:
    """Cues (doc_id, pos, text, start_ms, end_ms) to units: the whole way."""
    return units(groups(merge_reasons(merge_sides(segments(cues), most_words), latin)), scene_seconds)


def mask_lyrics(cues: DataFrame) -> DataFrame:
    """cues with turns, lyric (nothing but lyrics: set aside), mixed (lyrics beside dialogue), ask (the text to translate)
    and anchor (the last cue before it that is not set aside)."""
    c = F.col
    wrap = r"(?is)^<([ibu])>(.*)</\1>$"
    rows = cues.withColumn("turns", E.turns(F.when(c("text").rlike(wrap), F.regexp_extract("text", wrap, 2)).otherwise(c("text"))))
    rows = rows.withColumn("lyric", F.coalesce(F.forall("turns", T.is_music), F.lit(False)))
    rows = rows.withColumn("mixed", F.coalesce(~c("lyric") & ~c("text").rlike(wrap) & F.exists("turns", T.is_music), F.lit(False)))
    said = F.filter("turns", lambda x: ~T.is_music(x))
    joined = F.when(F.size(said) > 1, F.array_join(F.transform(said, lambda x: F.concat(F.lit("- "), x)), " ")).otherwise(F.try_element_at(said, F.lit(1)))
    rows = rows.withColumn("ask", F.when(c("lyric"), None).when(c("mixed"), joined).otherwise(c("text")))
    before = doc_order().rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("anchor", F.last(F.when(~c("lyric"), c("pos")), ignorenulls=True).over(before))


def restore_lyrics(masked: DataFrame, translated: DataFrame) -> DataFrame:
    """doc_id, pos, text, translation, verbatim: translations (doc_id, pos, translation) with lyrics back in their places.
    Lyrics follow their anchor and go where it is missing."""
    c = F.col
    found = masked.join(translated.select("doc_id", "pos", "translation", F.lit(True).alias("__kept")), ["doc_id", "pos"], "left")
    rows = found.withColumn("__kept", F.coalesce("__kept", F.lit(False)))
    anchors = rows.where(~c("lyric") & c("__kept")).select("doc_id", c("pos").alias("anchor"))
    lyrics = rows.where("lyric")
    lyrics = lyrics.where("anchor is null").select(*rows.columns).union(lyrics.join(anchors, ["doc_id", "anchor"], "left_semi").select(*rows.columns))
    given = E.turns(c("translation"))
    slots = F.size(F.filter("turns", lambda x: ~T.is_music(x)))
    pieces = F.when(F.size(given) == slots, given).otherwise(F.array(F.regexp_replace("translation", r"^[-\s]+", "")))
    dash = F.when(c("text").rlike(r"(?:^|\s)-\s"), "- ").otherwise("-")

    def piece(turn: Column, i: Column) -> Column:
        place = F.size(F.filter(F.slice("turns", 1, i), lambda x: ~T.is_music(x)))
        return F.when(T.is_music(turn), turn).otherwise(F.coalesce(F.try_element_at(pieces, place + 1), F.lit("")))

    filled = F.filter(F.transform("turns", piece), lambda x: x != "")
    composed = F.array_join(F.transform(filled, lambda x: F.concat(dash, x)), " ")
    said = F.when(c("mixed") & (c("translation") != ""), composed).otherwise(c("translation"))
    kept = rows.where(~c("lyric") & c("__kept")).select("doc_id", "pos", "text", said.alias("translation"), F.lit(False).alias("verbatim"))
    return kept.union(lyrics.select("doc_id", "pos", "text", F.lit(None).cast("string"), F.lit(True)))


def fill(sizes: list[float], limit: float) -> int:
    """Boxes that sizes need when each goes into the open box or, if it doesn't fit, opens the next."""
    boxes, room = 0, -1.0
    for size in sizes:
        boxes, room = (boxes, room - size) if size <= room else (boxes + 1, limit - size)
    return boxes


def count_batches(scene: list[int], cost: list[int], frame: int, limit: int) -> int:
    """Batches of some cues: whole scenes share a batch while they fit; one too large is cut by cues, and cues too large
    even then are left out."""
    sizes: dict[int, list[int]] = {}
    for s, c in zip(scene, cost, strict=True):
        sizes.setdefault(s, []).append(c)
    batches, run = 0, []
    for costs in sizes.values():
        if frame + sum(costs) <= limit:
            run.append(frame + sum(costs))
            continue
        batches += fill(run, limit) + fill([c for c in costs if frame + c <= limit], limit - frame)
        run = []
    return batches + fill(run, limit)


def choose_cut(start, end, scene, prefix, first: int, target: float, window: float, low: int, high: int) -> int:
    """A cut after first near target: where no scene goes on, else in the widest pause, else the nearest that is feasible."""
    at = np.arange(first + 1, len(scene))
    away = np.abs(prefix[at] - target)
    feasible = (at >= low) & (at <= high)
    safe = np.minimum.accumulate(scene[::-1])[::-1][at] > np.maximum.accumulate(scene[first:])[:-1]
    pause = start[at] - end[at - 1]
    if (feasible & safe).any():
        return int(at[np.argmin(np.where(feasible & safe, away, np.inf))])
    wide = feasible & (away <= window) & (pause >= 0)
    if wide.any():
        return int(at[np.argmax(np.where(wide, pause, -1))])
    return int(at[np.argmin(np.where(feasible, away, np.inf) if feasible.any() else away)])


def plan_document(rows: pd.DataFrame, limit: int, capacity: int, context: int) -> pd.DataFrame:
    rows = rows.sort_values("pos", kind="stable")
    scene, start, end = rows.scene.to_numpy(), rows.start_ms.to_numpy(), rows.end_ms.to_numpy()
    n = len(rows)
    cost = rows.size_.to_numpy() + CUE_FRAME + INDEX_REPEATS * len(str(n))
    prefix = np.concatenate([[0], np.cumsum(cost)])
    frame = GROUP_FRAME + (CONTEXT_FRAME + context if context else 0)
    batches = lambda a, b: count_batches(scene[a:b].tolist(), cost[a:b].tolist(), frame, limit)
    least = max(1, math.ceil(batches(0, n) / capacity))
    for parts in range(least, max(least, MOST_PARTS) + 1):
        cuts = [0]
        for part in range(1, parts):
            first = cuts[-1]
            if first >= n - 1:
                break
            low = bisect_left(range(n - 1), True, key=lambda a: batches(a, n) <= capacity * (parts - part))  # noqa: B023
            high = first + 1 + bisect_right(range(first + 2, n + 1), capacity, key=lambda b: batches(first, b))  # noqa: B023
            cuts.append(choose_cut(start, end, scene, prefix, first, prefix[n] * part / parts, prefix[n] / parts * CUT_WINDOW, low, high))
        cuts.append(n)
        found = [batches(a, b) for a, b in zip(cuts, cuts[1:])]
        if max(found) <= capacity:
            break
    pos = rows.pos.to_numpy()
    return pd.DataFrame({"doc_id": rows.doc_id.iloc[0], "part": range(1, len(found) + 1), "first_pos": pos[cuts[:-1]], "last_pos": pos[np.array(cuts[1:]) - 1], "batches": found})


def request_plan(cues: DataFrame, scene_seconds: float, limit: int, calls: int, most_batches: int, context: int = 0, context_calls: int = 0) -> DataFrame:
    """doc_id, part, first_pos, last_pos, batches: the fewest parts (12 at most, unless more are needed) whose batches of at
    most limit characters all stay within four fifths of the calls."""
    capacity = max(1, min(most_batches, math.floor(calls * PLANNING) - context_calls))
    text = F.coalesce("text", F.lit(""))
    size = F.length(text) + AMPERSAND_GROWTH * F.regexp_count(text, F.lit("&"))
    rows = scenes(cues, scene_seconds).select("doc_id", F.col("pos").cast("long").alias("pos"), "start_ms", "end_ms", F.col("scene").cast("long").alias("scene"), size.cast("long").alias("size_"))
    schema = f"doc_id {cues.schema['doc_id'].dataType.simpleString()}, part long, first_pos long, last_pos long, batches long"
    return rows.groupBy("doc_id").applyInPandas(lambda r: plan_document(r, limit, capacity, context), schema)
