"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document has four measures per thousand words or lines. For every language and source a mergeable quantile
sketch of each measure is kept as counts by bucket (buckets whose width is at most 1/128 of their value, so counts of
parts simply add up). From its quartiles follow fences, median + reach * spread; a source with few documents takes
its language's merged sketch, and a language with few the whole corpus's. Documents are joined with the fences of
their language and source and filtered.

Defined results: text that is null or has no word fails the base rule; a null language or source is a group of its
own; equal rows are judged alike, each by itself; doc_id is only carried along; an empty table gives an empty one;
further columns are ignored by `judge` and kept by `keep_good`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import stash

BLANK = r"[ \t\n\x0B\f\r]"
WORD = r"[^ \t\n\x0B\f\r]"
#: Fences are broadcast up to so many groups (about 100 bytes each), else joined by salted keys.
BROADCAST_GROUPS, SALTS = 50_000, 32


@dataclass(frozen=True)
class Rules:
    """spread: the least interquartile range that a measure is given, in thousandths."""

    least_words: int = 50
    most_repeat_percent: int = 50
    reach: int = 8
    least_group: int = 50
    spread: dict[str, int] = field(default_factory=lambda: {"symbols": 13, "length": 125, "lines": 50, "repeats": 40})


MEASURES = ("symbols", "length", "lines", "repeats")


def let(value: Column, use) -> Column:
    """use(value) with value computed once, also where use refers to it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK + "+"), "")


def _covered(places: Column) -> Column:
    """Words in the 3-word windows that start at the places, an ascending array."""
    width = lambda x, i: F.when(i == F.size(places) - 1, 3).otherwise(F.least(F.lit(3), F.get(places, i + 1) - x))
    return F.aggregate(F.transform(places, width), F.lit(0), lambda a, b: a + b)


def _repeat_places(windows: Column) -> Column:
    """Ascending indexes of values that stand in the array twice or more."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(s: Column) -> Column:
        same = lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"]))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    return let(placed, again)


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more; windows are compared by 64-bit hashes."""
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    count = lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), 0).otherwise(let(_repeat_places(t), _covered))
    return F.when(F.size(words) < 4, 0).otherwise(let(hashes(words), count))


def measured(docs: DataFrame, rules: Rules) -> DataFrame:
    """docs with the struct column __m: the counts of the base rules, base_failed, and the four measures."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    counts = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    lined = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))

    def measures(c: Column, x: Column) -> Column:
        n = F.greatest(c["n_words"], F.lit(1))
        per = lambda a, b: F.floor(a * 1000 / b)
        failed = (c["n_words"] < rules.least_words) | (100 * c["n_repeat_words"] > rules.most_repeat_percent * c["n_words"])
        return F.struct(
            c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"), x["n_dup_lines"].alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"),
            per(c["n_symbols"], n).alias("symbols"), per(c["word_chars"], n).alias("length"), per(x["n_dup_lines"], F.greatest(x["n_lines"], F.lit(1))).alias("lines"), per(c["n_repeat_words"], n).alias("repeats"),
        )

    group = {f"__{c}": F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("lang", "source")}
    return docs.withColumns(group | {"__m": let(counts, lambda c: let(lined, lambda x: measures(c, x)))})


def bucket(value: Column) -> Column:
    """The lower edge of a value's bucket: the value without what lies below its eight leading bits."""
    low = F.greatest(F.length(F.bin(value)) - 8, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(m: DataFrame) -> DataFrame:
    """__lang, __source, measure, edge, n: the quantile sketches of the documents that pass the base rule."""
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("measure"), bucket(F.col("__m")[x]).alias("edge")) for x in MEASURES))).alias("x")
    return m.where(~F.col("__m")["base_failed"]).select("__lang", "__source", each).groupBy("__lang", "__source", "x.measure", "x.edge").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, by: list[str], rules: Rules) -> DataFrame:
    """by, docs, and for each measure its low and high fence, from sketches merged by the columns."""
    merged = sketch.groupBy(*by, "measure", "edge").agg(F.sum("n").alias("n"))
    ordered = W.partitionBy(*by, "measure").orderBy("edge")  # a sketch has a bounded number of buckets
    ranked = merged.withColumns({"upto": F.sum("n").over(ordered), "docs": F.sum("n").over(W.partitionBy(*by, "measure"))})
    at = lambda quarter: F.min(F.when(4 * F.col("upto") >= quarter * F.col("docs"), F.col("edge")))
    spread = F.create_map(*(F.lit(x) for pair in rules.spread.items() for x in pair))[F.col("measure")]
    found = ranked.groupBy(*by, "measure").agg(F.first("docs").alias("docs"), at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"))
    reach = rules.reach * F.greatest(F.col("q3") - F.col("q1"), spread)
    wide = found.withColumns({"low": F.col("q2") - reach, "high": F.col("q2") + reach})
    pick = [F.max(F.when(F.col("measure") == x, F.col(side))).alias(f"{side}_{x}") for x in MEASURES for side in ("low", "high")]
    return wide.groupBy(*by).agg(F.first("docs").alias("docs"), *pick)


def thresholds(sketch: DataFrame, rules: Rules) -> DataFrame:
    """__lang, __source and the fences in force there; sketch: a stored result of sketches."""
    names = [f"{side}_{x}" for x in MEASURES for side in ("low", "high")]
    own, by_lang = (_fences(sketch, by, rules) for by in (["__lang", "__source"], ["__lang"]))
    by_lang = by_lang.select("__lang", *(F.col(c).alias(f"{c}_1") for c in ["docs", *names]))
    corpus = _fences(sketch, [], rules).first()  # one row of few numbers

    def pick(c: str) -> Column:
        last = F.lit(None if corpus is None else corpus[c]).cast("long")
        return F.when(F.col("docs") >= rules.least_group, F.col(c)).when(F.col("docs_1") >= rules.least_group, F.col(f"{c}_1")).otherwise(last)

    return own.join(by_lang, "__lang").select("__lang", "__source", *(pick(c).alias(c) for c in names))


def with_verdict(m: DataFrame, fences: DataFrame) -> DataFrame:
    """m with the boolean column __kept; fences: a stored result of thresholds."""
    value = lambda x: F.col("__m")[x]
    on = ["__lang", "__source"]
    fences = fences.select(*on, *(F.col(c).alias(f"__{c}") for c in fences.columns if c not in on))  # m may have columns of those names
    inside = (value("symbols") <= F.col("__high_symbols")) & value("length").between(F.col("__low_length"), F.col("__high_length")) & (value("lines") <= F.col("__high_lines")) & (value("repeats") <= F.col("__high_repeats"))
    kept = F.when(value("base_failed"), False).otherwise(F.coalesce(inside, F.lit(True))).alias("__kept")
    if fences.count() <= BROADCAST_GROUPS:
        return m.join(F.broadcast(fences), on, "left").select(*m.columns, kept)
    salted = fences.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return m.withColumn("__salt", F.pmod(F.xxhash64("doc_id", F.col("__m").cast("string")), F.lit(SALTS)).cast("int")).join(salted, [*on, "__salt"], "left").select(*m.columns, kept)


def judge(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    rules = rules or Rules()
    m = stash(measured(docs.select("doc_id", "text", "lang", "source"), rules).drop("text", "lang", "source"))
    fences = stash(thresholds(stash(sketches(m)), rules))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return with_verdict(m, fences).select("doc_id", *(F.col("__m")[c].alias(c) for c in base), F.col("__kept").alias("kept"))


def keep_good(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The rows of docs that judge keeps. Measures are taken twice rather than texts shuffled."""
    rules = rules or Rules()
    m = measured(docs, rules)
    fences = stash(thresholds(stash(sketches(m)), rules))
    return with_verdict(m, fences).where("__kept").select(docs.columns)


BLANKS_SQL = r"[ \t\n\x0b\x0c\r]+"
ORACLE_SQL = r"""
WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\x0c\r]+'), lambda w: w <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \t\n\x0b\x0c\r]')) AS lines FROM texts),
windows AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM split WHERE len(words) > 2)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT i + j) AS n FROM again, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
counted AS (SELECT split.r, doc_id, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source, len(words) AS n_words,
  length(array_to_string(words, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
  FROM split LEFT JOIN repeats ON split.r = repeats.r),
measured AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols * 1000 // greatest(n_words, 1) AS symbols,
  word_chars * 1000 // greatest(n_words, 1) AS length, n_dup_lines * 1000 // greatest(n_lines, 1) AS lines, n_repeat_words * 1000 // greatest(n_words, 1) AS repeats FROM counted),
long AS (UNPIVOT (SELECT r, lang, source, symbols, length, lines, repeats FROM measured WHERE NOT base_failed) ON symbols, length, lines, repeats INTO NAME measure VALUE v),
edges AS (SELECT *, (v >> greatest(length(bin(v)) - 8, 0)) << greatest(length(bin(v)) - 8, 0) AS edge FROM long),
grouped AS (SELECT lang, source, measure, quantile_disc(edge, [0.25, 0.5, 0.75]) AS q, count(*) AS n FROM edges GROUP BY ALL),
by_lang AS (SELECT lang, measure, quantile_disc(edge, [0.25, 0.5, 0.75]) AS q, count(*) AS n FROM edges GROUP BY ALL),
of_all AS (SELECT measure, quantile_disc(edge, [0.25, 0.5, 0.75]) AS q, count(*) AS n FROM edges GROUP BY ALL),
quartiles AS (SELECT g.lang, g.source, g.measure, CASE WHEN g.n >= 50 THEN g.q WHEN l.n >= 50 THEN l.q ELSE a.q END AS q
  FROM grouped g JOIN by_lang l ON g.lang = l.lang AND g.measure = l.measure JOIN of_all a ON g.measure = a.measure),
fences AS (SELECT lang, source, measure, q[2] - 8 * greatest(q[3] - q[1], CASE measure WHEN 'symbols' THEN 13 WHEN 'length' THEN 125 WHEN 'lines' THEN 50 ELSE 40 END) AS low,
  q[2] + 8 * greatest(q[3] - q[1], CASE measure WHEN 'symbols' THEN 13 WHEN 'length' THEN 125 WHEN 'lines' THEN 50 ELSE 40 END) AS high FROM quartiles),
broken AS (SELECT DISTINCT r FROM long JOIN fences ON long.lang = fences.lang AND long.source = fences.source AND long.measure = fences.measure
  WHERE v > high OR (long.measure = 'length' AND v < low))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM broken) AS kept FROM measured
"""
