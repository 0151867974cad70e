"""Names and terms: matching, tallying, replacing, clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}][\p{L}\p{N}'’-]*"


def term_key(text: Column, case_sensitive: bool = False) -> Column:
    """Trimmed, white space squeezed, in lower case unless the case counts. (Spark has no Unicode normalisation.)"""
    plain = F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))
    return plain if case_sensitive else F.lower(plain)


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, at, token, key: words with their place."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)).alias("at", "token")).withColumn("key", F.lower("token"))


def longest_matches(docs: DataFrame, keys: DataFrame, most_words: int | None = None) -> DataFrame:
    """doc_id, at, words, key: at each place the longest key that begins there and that no earlier match covers. Grams of
    up to as many words as the longest key has meet the keys in an equi-join; overlaps are settled per document."""
    most_words = most_words or most_words_of(keys, "key")
    t = tokens(docs)
    order = W.partitionBy("doc_id").orderBy("at")
    ahead = F.collect_list("key").over(order.rowsBetween(0, most_words - 1))
    grams = t.withColumn("__next", ahead).select("doc_id", "at", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("__next")), lambda n: F.array_join(F.slice("__next", F.lit(1), n), " "))).alias("n", "key"))
    known = keys.select(F.lower("key").alias("key")).distinct()
    found = grams.join(known, "key").select("doc_id", "at", (F.col("n") + 1).alias("words"), "key")
    longest = found.groupBy("doc_id", "at").agg(F.max_by("key", "words").alias("key"), F.max("words").alias("words"))
    # A match stands if it begins at or after the end of the last one that stands: a fold over the document's matches.
    ordered = F.array_sort(F.collect_list(F.struct("at", "words", "key")))
    empty = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,words:int,key:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        free = x["at"] >= s["end"]
        return F.struct(F.when(free, x["at"] + x["words"]).otherwise(s["end"]).alias("end"), F.when(free, F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"))

    kept = longest.groupBy("doc_id").agg(F.aggregate(ordered, empty, step)["out"].alias("m"))
    return kept.select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*")


def replace_terms(docs: DataFrame, glossary: dict[str, str]) -> DataFrame:
    """docs with the glossary's terms (a bounded list, at most 500) replaced between word edges, the longest first."""
    if len(glossary) > 500:
        raise ValueError("a glossary has at most 500 terms")
    out = F.col("text")
    for source, target in sorted(glossary.items(), key=lambda x: -len(x[0])):
        quoted = "".join("\\" + c if not c.isalnum() and c != " " else c for c in source)
        out = F.regexp_replace(out, rf"(?i)(?<![\p{{L}}\p{{N}}]){quoted}(?![\p{{L}}\p{{N}}])", target.replace("\\", "\\\\").replace("$", "\\$"))
    return docs.withColumn("text", out)


def candidate_tally(entities: DataFrame, least_score: float = 0.5) -> DataFrame:
    """key, type, n, best, surface of entities (text, type, score)."""
    good = entities.where(F.col("score") >= least_score).withColumn("key", term_key(F.col("text")))
    return good.groupBy("key", "type").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.max_by("text", "score").alias("surface"))


def evidence(probes: DataFrame) -> DataFrame:
    """key, probes, entity_hits, plain_hits of rows (key, is_entity)."""
    return probes.groupBy("key").agg(F.count("*").alias("probes"), F.count_if("is_entity").alias("entity_hits"), F.count_if(~F.col("is_entity")).alias("plain_hits"))


def label_runs(rows: DataFrame) -> DataFrame:
    """doc_id, label, first, last, score: runs of tokens with one label (not O), with their mean probability."""
    order = W.partitionBy("doc_id").orderBy("at")
    new = F.lag("label").over(order).isNull() | (F.lag("label").over(order) != F.col("label")) | (F.lag("at").over(order) + 1 != F.col("at"))
    runs = rows.withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(order))
    return runs.where("label <> 'O'").groupBy("doc_id", "label", "__run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.avg("prob").alias("score")).drop("__run")


def capitalised_share(units: DataFrame) -> DataFrame:
    """source, share, shouted of units (source, text): of texts with letters, how many begin in upper case."""
    first = F.regexp_extract("text", r"\p{L}", 0)
    return units.where(first != "").groupBy("source").agg(F.avg(first.rlike(r"\p{Lu}").cast("double")).alias("share"), (F.avg((F.upper("text") == F.col("text")).cast("double")) > 0.5).alias("shouted"))


def most_words_of(keys: DataFrame, column: str) -> int:
    """Words of the longest key."""
    return keys.agg(F.max(F.size(F.split(column, " ")))).first()[0] or 1


def containing_pairs(terms: DataFrame, most_words: int | None = None) -> DataFrame:
    """inner, outer: terms that stand word by word inside another, found by the outer terms' grams."""
    most_words = most_words or most_words_of(terms, "term")
    words = F.split(F.lower("term"), " ")
    outer = terms.select(F.col("term").alias("outer"), words.alias("w")).where(F.size("w") > 1)
    n = F.size("w")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most_words))), lambda k: F.transform(F.sequence(F.lit(0), n - k), lambda i: F.array_join(F.slice("w", i + 1, k), " "))))
    grams = outer.select("outer", F.explode(F.array_distinct(spans)).alias("key"))
    return grams.join(terms.select(F.lower("term").alias("key"), F.col("term").alias("inner")), "key").where("inner <> outer").select("inner", "outer")


def _fold_units(text: Column, seed: int, prime: int) -> Column:
    """The 32-bit hash that takes in one UTF-16 unit after the other: exclusive or, then the product modulo 2**32."""
    units = F.hex(F.encode(text, "UTF-16BE"))
    values = F.transform(F.sequence(F.lit(1), F.length(units) - 3, F.lit(4)), lambda i: F.conv(F.substring(units, i, F.lit(4)), 16, 10).cast("long"))
    half = lambda h, p: (((h.bitwiseXOR(p)) * (prime & 0xFFFF)) + ((h.bitwiseXOR(p) * (prime >> 16)).bitwiseAND(0xFFFF) * 65536)).bitwiseAND(0xFFFFFFFF)
    return F.when(F.length(text) == 0, F.lit(seed).cast("long")).otherwise(F.aggregate(values, F.lit(seed).cast("long"), half))


def units_hash(texts: Column) -> Column:
    """The 32-bit FNV-1a hash over the UTF-16 units of an array of texts, with a line feed after each, in base 36."""
    joined = F.array_join(F.transform(texts, lambda t: F.concat(F.coalesce(t, F.lit("")), F.lit("\n"))), "")
    return F.lower(F.conv(_fold_units(joined, 0x811C9DC5, 0x01000193).cast("string"), 10, 36))


def text_hash(rows: DataFrame, column: str = "text") -> DataFrame:
    """rows with hash: units_hash of the row's one text."""
    return rows.withColumn("hash", units_hash(F.array(column)))


def bloom_bits(text: Column) -> Column:
    """The three of 65,536 bits that a text sets in a Bloom filter, from two 32-bit hashes of its UTF-16 units."""
    one, two = _fold_units(text, 0x811C9DC5, 0x01000193), _fold_units(text, 0x9E3779B9, 0x85EBCA6B)
    return F.array(*((one + two * i).bitwiseAND(0xFFFF).cast("int") for i in range(3)))


def bloom_semi_join(rows: DataFrame, known: DataFrame, column: str = "text") -> DataFrame:
    """rows whose text's bits are all set by known's texts: all that are known, and few others while known is small. The
    filter has 65,536 bits, whatever the tables."""
    bits = known.select(F.explode(bloom_bits(F.col(column))).alias("bit")).distinct()
    packed = bits.agg(F.collect_set("bit").alias("__bits"))  # at most 65,536 numbers
    return rows.join(F.broadcast(packed), how="cross").where(F.size(F.array_except(bloom_bits(F.col(column)), F.col("__bits"))) == 0).drop("__bits")
