"""Registered queries on the way from cues to units: edges, continuation, sides, reasons, groups, units, lyrics, plans.

Conversations stand in for documents of cues. The two folds with a state, and what is built on them, have no SQL; tests
hold them against literal values.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.catalog import CUES, cue_rows, query
from tidemark.functions import edges as E
from tidemark.functions import text as T
from tidemark.operators import extract as X
from tidemark.operators import merging as G
from tidemark.operators import restoring as R


def sql_class(chars: str) -> str:
    return E.char_class(chars).replace("'", "''")


BLANKS = sql_class(E.BLANK + E.NOTES)
AFTER = sql_class(E.BLANK + E.NOTES + E.CLOSERS + E.STRAIGHT)
EDGES = f"""{CUES}, e0 AS (SELECT *, regexp_replace(text, '(?:{AFTER}|{E.STYLE})+$', '') AS body, regexp_replace(regexp_replace(text, '^(?:{BLANKS}|{E.STYLE})+', ''), '^["'']+', '') AS lead,
 regexp_extract(regexp_replace(text, '{E.STYLE}', '', 'g'), '\\p{{L}}') AS letter FROM cues),
 e1 AS (SELECT *, right(body, 1) AS z, right(body, 2) AS zz, substr(text, length(body) + 1) AS ending FROM e0),
 edged AS (SELECT *, (CASE WHEN z IN ('…', '⋯') OR zz = '..' THEN 2 WHEN zz = '--' OR regexp_matches(z, '{sql_class(E.TERMINAL)}') THEN 1 WHEN regexp_matches(z, '{sql_class(E.GOES_ON)}') THEN 4 WHEN z = '-' THEN 8 ELSE 0 END
 + CASE WHEN regexp_matches(ending, '{sql_class(E.CLOSERS + E.STRAIGHT)}') THEN 16 ELSE 0 END + CASE WHEN regexp_matches(z, '{sql_class(E.OPENERS)}') THEN 32 ELSE 0 END)::INTEGER AS tail,
 (CASE WHEN regexp_matches(lead, '^(?:…|\\.\\.)') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(letter, '\\p{{Ll}}') THEN 2 WHEN regexp_matches(letter, '[\\p{{Lu}}\\p{{Lt}}]') THEN 4 ELSE 0 END
 + CASE WHEN regexp_matches(lead, '^{sql_class(E.BRACKETS_CLOSE + E.BOUND)}') THEN 8 ELSE 0 END)::INTEGER AS head FROM e1)"""
PAIRS = f"{EDGES}, pairs AS (SELECT *, regexp_matches(text, '[{T.MUSIC}]') AS music, lag(text) OVER o AS t0, lag(tail) OVER o AS f0, start_ms - lag(end_ms) OVER o AS gap FROM edged WINDOW o AS (PARTITION BY doc_id ORDER BY pos))"
GOES = f"""CASE WHEN f0 & 1 <> 0 THEN gap <= 200 AND head & 2 <> 0 AND regexp_matches(t0, '[\\p{{L}}\\p{{N}}-]\\.\\s*$') AND regexp_matches(text, '^\\s*(?:{E.DOMAINS})(?:[^\\p{{L}}\\p{{N}}]|$)')
 WHEN f0 & 8 <> 0 THEN gap <= 200 AND head & 2 <> 0 WHEN f0 & 2 <> 0 AND head & 1 <> 0 THEN gap <= 1500 WHEN f0 & 2 <> 0 AND head & 4 <> 0 THEN false
 WHEN f0 & 4 <> 0 AND gap <= 1500 THEN true ELSE gap <= 200 OR head & 2 <> 0 END"""


def as_segments(spark, sf_dir):
    """Cues as segments, one each."""
    rows = cue_rows(spark, sf_dir).drop("kind").withColumns({"cue_id": F.col("pos"), "resolved": F.lit(None).cast("string")})
    return X.flagged(rows)


@query(f"WITH {EDGES} SELECT doc_id, pos, tail, head FROM edged")
def cue_edges(spark, sf_dir):
    return as_segments(spark, sf_dir).select("doc_id", "pos", "tail", "head")


@query(f"WITH {PAIRS} SELECT doc_id, pos, {GOES} AS goes_on FROM pairs WHERE f0 IS NOT NULL")
def punctuation_continuation(spark, sf_dir):
    c, last = F.col, lambda name: F.lag(name).over(X.doc_order())
    gap = c("start_ms") - last("end_ms")
    rows = as_segments(spark, sf_dir).select("doc_id", "pos", last("tail").alias("f0"), E.goes_on(last("text"), last("tail"), c("text"), c("head"), gap).alias("goes_on"))
    return rows.where("f0 is not null").drop("f0")


# Conversations have no short lines, so twenty words stand for two.
SIDES = f"""{PAIRS}, sided AS (SELECT *, len(regexp_extract_all(text, '\\p{{Latin}}+(?:[''’]\\p{{Latin}}+)*')) <= 20 AND NOT music AS alone,
 coalesce(lead(start_ms) OVER o - end_ms <= 1500 AND NOT lead(music) OVER o, false) AS ahead, coalesce(gap <= 1500 AND NOT lag(music) OVER o, false) AS back FROM pairs WINDOW o AS (PARTITION BY doc_id ORDER BY pos))"""


@query(f"WITH {SIDES} SELECT doc_id, pos, CASE WHEN alone AND ahead THEN 'next' WHEN alone AND back THEN 'prev' END AS merge_side FROM sided")
def merge_sides(spark, sf_dir):
    return X.merge_sides(as_segments(spark, sf_dir), 20).select("doc_id", "pos", "merge_side")


@query(
    f"WITH {PAIRS} SELECT doc_id, pos, CASE WHEN f0 IS NULL OR gap < -1000 THEN NULL WHEN head & 8 <> 0 OR f0 & 32 <> 0 THEN CASE WHEN gap <= 1500 THEN 'gap' END WHEN {GOES} THEN 'gap' END AS reason FROM pairs"
)
def merge_reasons(spark, sf_dir):
    rows = as_segments(spark, sf_dir).withColumn("merge_side", F.lit(None).cast("string"))
    return X.merge_reasons(rows, latin=False).select("doc_id", "pos", "reason")


@query(None)
def extract_groups(spark, sf_dir):
    rows = X.groups(X.merge_reasons(X.merge_sides(X.segments(cue_rows(spark, sf_dir)))))
    return rows.groupBy("doc_id", "group").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"), F.count_if("marked").alias("marked"))


@query(None)
def extract_units(spark, sf_dir):
    return X.extract_units(cue_rows(spark, sf_dir))


@query(f"WITH {CUES}, m AS (SELECT *, regexp_matches(text, '[{T.MUSIC}]') AS lyric FROM (SELECT doc_id, pos, start_ms, end_ms, kind, CASE WHEN kind = 'user' THEN '♪ ' || replace(text, '-', '~') ELSE replace(text, '-', '~') END AS text FROM cues)) SELECT doc_id, pos, lyric, last_value(CASE WHEN NOT lyric THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM m")
def lyric_mask(spark, sf_dir):
    plain = F.regexp_replace("text", "-", "~")
    rows = cue_rows(spark, sf_dir).withColumn("text", F.when(F.col("kind") == "user", F.concat(F.lit("♪ "), plain)).otherwise(plain))
    return X.mask_lyrics(rows).select("doc_id", "pos", "lyric", "anchor")


@query(None)
def request_plans(spark, sf_dir):
    return X.request_plan(cue_rows(spark, sf_dir), 2, 600, 10, 4)


@query(f"WITH {CUES}, t AS (SELECT doc_id, pos, regexp_replace(text, '\\s+$', '') AS s FROM cues) SELECT doc_id, pos, CASE WHEN regexp_matches(s, '(?:—|…|\\.\\.|--)$') THEN 'trail_off' WHEN regexp_matches(s, '[,，、]$') THEN 'comma' WHEN regexp_matches(s, '[.。!?！？][''\"”’)\\]」』]*$') THEN 'period' WHEN regexp_matches(s, '[:：]$') THEN 'colon' END AS kind FROM t")
def boundary_kinds(spark, sf_dir):
    return cue_rows(spark, sf_dir).select("doc_id", "pos", G.boundary(F.col("text")).alias("kind"))


@query(None)
def translation_cuts(spark, sf_dir):
    quarters = F.array(*(F.length("text") * q / 4 for q in (1, 2, 3)))
    kinds = F.array(F.lit("comma"), F.lit(None).cast("string"), F.lit("period"))
    return G.cut_translations(cue_rows(spark, sf_dir).select("doc_id", "pos", "text", kinds.alias("kinds"), quarters.alias("expected")), ["doc_id", "pos"])


SPLIT = "regexp_split_to_array(regexp_replace(text, '({})', chr(1) || '\\1' || chr(2), 'g'), '[' || chr(1) || chr(2) || ']')"


def sql_pattern(pattern: str) -> str:
    """A pattern of Java's as DuckDB writes it, inside quotes."""
    return re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", pattern).replace("'", "''")


@query(f"WITH {CUES}, cut AS (SELECT doc_id, pos, {SPLIT.format(sql_pattern(R.UNITS))} AS p FROM cues), each AS (SELECT doc_id, pos, p, unnest(range(1, len(p) + 1)) AS i FROM cut), placed AS (SELECT doc_id, pos, i, length(p[i]) AS n, sum(length(p[i])) OVER (PARTITION BY doc_id, pos ORDER BY i) AS upto FROM each) SELECT doc_id, pos, (upto - n)::INTEGER AS start_at, upto::INTEGER AS end_at FROM placed WHERE i % 2 = 0")
def protected_units(spark, sf_dir):
    """Words in Latin letters, numbers with their units, dates and the like: what no cut divides."""
    spans = cue_rows(spark, sf_dir).select("doc_id", "pos", F.explode(R.match_spans(F.col("text"), R.UNITS)).alias("s"))
    return spans.select("doc_id", "pos", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


@query(f"WITH {CUES} SELECT doc_id, pos, 2.5 * len(regexp_extract_all(text, '[A-Za-z]+(?:[''’][A-Za-z]+)*')) + 0.5 * len(regexp_extract_all(text, '[0-9，,、；;。.!?！？：:…]')) + len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]')) - len(regexp_extract_all(text, '[A-Za-z0-9]')) AS weight FROM cues")
def place_weights(spark, sf_dir):
    """The weight that shares out a translation's places."""
    return cue_rows(spark, sf_dir).select("doc_id", "pos", F.round(R.total(R.weights(F.col("text"))), 6).alias("weight"))


def turn_units(spark, sf_dir):
    """Conversations in units of three turns; the turns' own texts, with a marker before some, stand for a translation."""
    rows = cue_rows(spark, sf_dir).withColumnsRenamed({"pos": "cue_id"}).withColumns({"pos": F.col("cue_id"), "turn": F.lit(0), "group": F.floor(F.col("cue_id") / 3), "music": F.lit(False), "marked": F.col("cue_id") % 5 == 2})
    units = R.marked_units(rows)
    return units.withColumn("text", F.lower("ask")).drop("ask", "music")


@query(None)
def translation_parts(spark, sf_dir):
    return R.split_units(turn_units(spark, sf_dir)).select("doc_id", "unit", "method", F.posexplode("parts").alias("part", "text"))


@query(None)
def restored_cues(spark, sf_dir):
    return R.restored_cues(cue_rows(spark, sf_dir), R.split_units(turn_units(spark, sf_dir))).select("doc_id", "pos", "translation")
