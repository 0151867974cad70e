"""Registered queries that cut texts into pieces and words, and that carry sentences on by lists of words.

The vocabulary comes from the names of parts, which are built from a fixed stock of words: heads are their first letters,
inner pieces any letters from the second on.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import CUES, query, table
from tidemark.functions import edges as E
from tidemark.functions import lexical
from tidemark.operators import extract as X
from tidemark.operators import pieces as P
from tidemark.plans.extracting import AFTER, BLANKS, PAIRS

STOCK = "stock AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w)"
VOCABULARY = f"""{STOCK}, cuts AS (SELECT w, i, k FROM stock, range(1, 65) a(i), range(1, 4) b(k) WHERE i + k - 1 <= length(w)),
 vocabulary AS (SELECT piece, row_number() OVER (ORDER BY piece) - 1 AS id FROM (SELECT CASE WHEN i > 1 THEN '##' ELSE '' END || substr(w, i, k) AS piece FROM cuts UNION SELECT unnest(['[UNK]', '[CLS]', '[SEP]'])))"""


def stock(spark, sf_dir):
    """word, count of the names of parts."""
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


def cuts(spark, sf_dir, inner: str):
    """Pieces of up to three letters: as they are at the beginning of a word, after `inner` elsewhere."""
    n = F.length("word")
    places = stock(spark, sf_dir).where("word <> ''").select("word", "count", F.explode(F.sequence(F.lit(1), n)).alias("i")).select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.length("word") - F.col("i") + 1))).alias("k"))
    return places.select(F.concat(F.when(F.col("i") > 1, inner).otherwise(""), F.expr("substr(word, i, k)")).alias("piece"), "i", "count")


def numbered(rows, special: list[str]):
    """Pieces with ids in the order of their code points. They number a few hundred, whatever the size of the tables."""
    spark = rows.sparkSession
    found = rows.union(spark.createDataFrame([(p, 0.0) for p in special], "piece string, score double"))
    return found.groupBy("piece").agg(F.max("score").alias("score"), F.count("*").alias("n")).select("piece", "score", F.expr("row_number() over (order by piece) - 1").alias("id"))


MARKS = "!-/:-@\\[-`{-~\\p{P}\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}\\x{20000}-\\x{2a6df}\\x{2a700}-\\x{2ceaf}\\x{f900}-\\x{faff}\\x{2f800}-\\x{2fa1f}"
SPLIT = f"[{MARKS}]|[^{MARKS}\\p{{Z}}\\p{{Cc}}\\p{{Cf}}\\x{{fffd}}]+"


@query(f"""WITH RECURSIVE {VOCABULARY}, spread AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPLIT}') AS w FROM documents)),
 walk AS (SELECT word, 0 AS done, []::BIGINT[] AS ids FROM (SELECT DISTINCT word FROM spread)
 UNION ALL SELECT s.word, s.done + coalesce(CASE WHEN c.id IS NOT NULL THEN 3 WHEN b.id IS NOT NULL THEN 2 WHEN a.id IS NOT NULL THEN 1 END, 1000000), list_append(s.ids, coalesce(c.id, b.id, a.id))
 FROM (SELECT *, CASE WHEN done > 0 THEN '##' ELSE '' END AS mark, substr(word, done + 1) AS rest FROM walk WHERE done < length(word)) s
 LEFT JOIN vocabulary c ON length(rest) >= 3 AND c.piece = mark || left(rest, 3) LEFT JOIN vocabulary b ON length(rest) >= 2 AND b.piece = mark || left(rest, 2) LEFT JOIN vocabulary a ON a.piece = mark || left(rest, 1)),
 ended AS (SELECT word, CASE WHEN done > length(word) OR length(word) > 100 THEN [(SELECT id FROM vocabulary WHERE piece = '[UNK]')] ELSE ids END AS ids FROM walk WHERE done >= length(word)),
 found AS (SELECT doc_id, count(*) AS n_words, sum(len(ids))::BIGINT AS n_pieces, count(*) FILTER (ids[1] = (SELECT id FROM vocabulary WHERE piece = '[UNK]')) AS n_unknown, md5(string_agg(array_to_string(ids, ','), ' ' ORDER BY place)) AS digest FROM spread JOIN ended USING (word) GROUP BY doc_id)
 SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_pieces, 0) AS n_pieces, coalesce(n_unknown, 0) AS n_unknown, coalesce(digest, md5('')) AS digest FROM documents LEFT JOIN found USING (doc_id)""")
def word_pieces(spark, sf_dir):
    vocabulary = numbered(cuts(spark, sf_dir, P.INNER).select("piece", F.lit(0.0).alias("score")), P.WORDPIECE_SPECIAL)
    unknown = F.lit(vocabulary.where("piece = '[UNK]'").first()["id"])
    cut = P.word_pieces(spark, vocabulary)
    rows = table(spark, sf_dir, "documents").select("doc_id", cut(F.coalesce("text", F.lit(""))).alias("words"))
    ids = F.transform("words", lambda w: w["pieces"])
    return rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size(F.flatten(ids)).cast("long").alias("n_pieces"), F.size(F.filter(ids, lambda x: x[0] == unknown)).cast("long").alias("n_unknown"),
        F.md5(F.array_join(F.transform(ids, lambda x: F.array_join(x.cast("array<string>"), ",")), " ")).alias("digest"),
    )


@query()
def unigram_pieces(spark, sf_dir):
    """Scores are logarithms of shares, so sums are not whole numbers; tests hold paths against all ways to cut."""
    counted = cuts(spark, sf_dir, "").select(F.concat(F.when(F.col("i") == 1, P.BOUNDARY).otherwise(""), F.col("piece")).alias("piece"), "count").groupBy("piece").agg(F.sum("count").alias("count"))
    total = counted.agg(F.sum("count")).first()[0] or 1
    vocabulary = numbered(counted.select("piece", F.log(F.col("count") / total).alias("score")), [*P.UNIGRAM_SPECIAL, "<unk>", P.BOUNDARY])
    unknown = vocabulary.where("piece = '<unk>'").first()["id"]
    cut = P.unigram_pieces(spark, vocabulary, unknown)
    rows = table(spark, sf_dir, "documents").select("doc_id", cut(F.coalesce("text", F.lit(""))).alias("words"))
    ids = F.transform("words", lambda w: w["pieces"][0])
    return rows.select("doc_id", F.size("words").cast("long").alias("n_pieces"), F.size(F.filter(ids, lambda x: x == unknown)).cast("long").alias("n_unknown"), F.md5(F.array_join(ids.cast("array<string>"), ",")).alias("digest"))


@query("SELECT p_partkey, string_split(p_name, ' ') AS words FROM part")
def joined_names(spark, sf_dir):
    """Names of parts without their blanks come apart again by the best path over the words of all names."""
    cut = P.word_tokens(spark, P.lexicon(stock(spark, sf_dir)), r"\p{L}")
    names = table(spark, sf_dir, "part").select("p_partkey", cut(F.replace("p_name", F.lit(" "), F.lit(""))).alias("tokens"))
    return names.select("p_partkey", F.transform("tokens", lambda t: t["text"]).alias("words"))


TOKEN = r"[\p{L}\p{M}\p{N}_]+(?:[''’.·][\p{L}\p{N}][\p{L}\p{M}\p{N}_]*)*|\r\n|[ \x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{205f}\x{3000}]+|[\s\S]"


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_filter(t, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')))::BIGINT AS n_words, md5(array_to_string(t, chr(1))) AS digest FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS t FROM documents)")
def text_tokens(spark, sf_dir):
    """Tokens of whole texts; the documents hold no script without blanks, so no lexicon is asked."""
    cut = P.word_tokens(spark, {})
    rows = table(spark, sf_dir, "documents").select("doc_id", cut(F.coalesce("text", F.lit(""))).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.filter("t", lambda x: x["is_word"])).cast("long").alias("n_words"), F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\u0001")).alias("digest"))


# The conversations are in scripts with blanks: five words stand in for a cue, and short words for particles, which bind
# only as whole tokens.
PARTICLES = lexical.Lexicon(no_start=("de", "la", "an", "er"), no_end=("de", "la", "en", "er"), no_end_phrases=("tion", "lich"), complete=("la de",), begins=("et", "der"), continues=("qu", "sch"), turns="-[(")
FIVES = """cues AS (SELECT doc_id, turn * 10000 + i AS pos, (turn * 10000 + i) * 1500 AS start_ms, (turn * 10000 + i) * 1500 + 50 * length(text) AS end_ms, text, kind FROM
 (SELECT conv_id AS doc_id, turn, role AS kind, i, array_to_string(w[i * 5 + 1 : i * 5 + 5], ' ') AS text FROM (SELECT *, regexp_split_to_array(coalesce(text, ''), '[ \\n]+') AS w FROM conversations), LATERAL (SELECT unnest(range((len(w) + 4) // 5)) AS i)))"""
LEFT, RIGHT = f"regexp_replace(t0, '(?:{AFTER}|</[ibuIBU]>)+$', '')", f"regexp_replace(text, '^(?:{BLANKS}|{E.STYLE})+', '')"


@query(f"""WITH {PAIRS.replace(CUES, FIVES, 1)}, cut AS (SELECT *, {LEFT} AS l, {RIGHT} AS r FROM pairs WHERE f0 IS NOT NULL),
 tokens AS (SELECT *, regexp_extract_all(right(l, 8), '{TOKEN}')[-1] AS z1, regexp_extract_all(left(r, 8), '{TOKEN}')[1] AS a1 FROM cut)
 SELECT doc_id, pos, CASE WHEN f0 & 27 <> 0 OR gap > 1500 THEN false WHEN f0 & 4 <> 0 OR regexp_matches(l, '(?:tion|lich)$') OR (regexp_matches(l, '(?:de|la|en|er)$') AND NOT regexp_matches(l, 'la de$') AND coalesce(z1, '') IN ('de', 'la', 'en', 'er'))
 THEN NOT regexp_matches(r, '^(?:[-\\[(]|et|der)') ELSE (regexp_matches(r, '^(?:de|la|an|er)') AND coalesce(a1, '') IN ('de', 'la', 'an', 'er')) OR regexp_matches(r, '^(?:qu|sch)') END AS goes_on FROM tokens""")
def lexical_continuation(spark, sf_dir):
    words = F.split(F.coalesce("text", F.lit("")), "[ \n]+")
    fives = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 5)), lambda i: F.array_join(F.slice("w", (i * 5 + 1).cast("int"), F.lit(5)), " "))
    rows = table(spark, sf_dir, "conversations").withColumn("w", words).select(F.col("conv_id").alias("doc_id"), "turn", F.posexplode(fives).alias("i", "text"))
    rows = rows.withColumn("pos", F.col("turn") * 10000 + F.col("i")).withColumn("start_ms", F.col("pos") * 1500)
    rows = rows.withColumns({"end_ms": F.col("start_ms") + 50 * F.length("text"), "tail": E.tail_flags(F.col("text"))})
    last = lambda name: F.lag(name).over(X.doc_order())
    rows = rows.select("doc_id", "pos", "text", last("text").alias("t0"), last("tail").alias("f0"), (F.col("start_ms") - last("end_ms")).alias("gap")).where("f0 is not null")
    cut = P.word_tokens(spark, {})
    return rows.select("doc_id", "pos", lexical.goes_on(F.col("t0"), F.col("f0"), F.col("text"), F.col("gap"), PARTICLES, cut).alias("goes_on"))
