"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis).

Sources, in code point order with null last, get the weights in turn and share a multiple of all words; a target stops
at `most` times its source, and what exceeds is shared again by weight (water-filling). A source is taken in complete
epochs first; the rest of its target is filled in ascending order of exponential keys, -ln(u) / w, where u is drawn
from a hash of the document and w is its quality weight, so reruns agree. The last document is taken in part: its
first words only.

A source's order is cut into buckets of the key, whose sums are added up first; so one task adds up prefix sums within
a bucket only, also where one source holds a third of all rows. Only the table with a row for each source goes
through one task.

Defined results: null text has size 0 and is taken 0 times; a null source is a source of its own, the last; equal rows
have equal keys, and which of them is taken makes no difference; an empty table gives an empty one; further columns
are ignored by `digest` and kept by `mix`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quality import let, words_of
from .session import stash


#: Buckets (about 100 bytes each) that are broadcast; beyond that rows are shuffled to them.
BROADCAST_BUCKETS = 200_000


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    buckets: int = 256  # to an octave of the key
    seed: int = 20


def targets(sums: DataFrame, rule: Mix) -> DataFrame:
    """src, source_size, target, from src (struct of `none` and `name`) and source_size, a row for each source."""
    one = W.partitionBy()
    place = F.row_number().over(one.orderBy("src")) - 1
    weighed = sums.withColumn("w", F.element_at(F.array(*map(F.lit, rule.weights)), (place % len(rule.weights) + 1).cast("int")).cast("double"))
    weighed = weighed.withColumns({"cap": (rule.most * F.col("source_size")).cast("double"), "total": rule.share * F.sum("source_size").over(one)})
    weighed = weighed.withColumn("ratio", F.col("cap") / F.col("w"))
    # In ascending order of cap / weight the sources that reach their cap come first; the others share the rest.
    order = one.orderBy("ratio", "src")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    level = weighed.withColumn("level", (F.col("total") - before) / after)
    water = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(one)["level"]
    target = F.when(F.col("level") > F.col("ratio"), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("w")))
    return level.withColumn("water", water).select("src", "source_size", target.alias("target"))


def weighed(docs: DataFrame, rule: Mix) -> DataFrame:
    """docs with the struct __d: src, size, th, key and its bucket.

    Buckets are even on the logarithm of the key, 256 to an octave: most keys of a source, whatever its weights, lie
    within few octaves, so no bucket holds more than about one row in three hundred.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    th = F.xxhash64(F.lit(rule.seed), F.col("doc_id"), text, F.col("source"))
    u = (F.call_function("shiftrightunsigned", th, F.lit(12)) + 0.5) / float(1 << 52)

    def facts(words):
        n = F.greatest(F.size(words), F.lit(1))
        # Half as many different words as words is as good as any; symbols count against a text.
        varied = F.least(F.lit(1.0), 2 * F.size(F.array_distinct(words)) / n)
        w = F.greatest(F.lit(0.05), varied) * F.greatest(F.lit(0.05), 1 - symbols / n)
        src = F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source"), F.lit("")).alias("name"))
        return F.struct(src.alias("src"), F.size(words).cast("long").alias("size"), th.alias("th"), (-F.ln(u) / w).alias("key"))

    placed = lambda d: F.struct(d["src"].alias("src"), d["size"].alias("size"), d["th"].alias("th"), d["key"].alias("key"), F.floor(F.log2(d["key"]) * rule.buckets).cast("int").alias("bucket"))
    return docs.withColumn("__d", let(let(words_of(text), facts), placed))


def decided(rows: DataFrame, rule: Mix) -> DataFrame:
    """rows (stashed, with __d) with the struct __t: source_size, target, epochs (complete copies), part (further words).

    Only in the bucket in which a source's budget ends are documents put in order; all other buckets are taken whole or
    not at all, so their rows are not shuffled while the table of buckets is small enough to be broadcast.
    """
    sums = stash(rows.groupBy("__d.src", "__d.bucket").agg(F.sum("__d.size").alias("size")))
    goals = targets(sums.groupBy("src").agg(F.sum("size").alias("source_size")), rule)
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(rule.most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    goals = goals.withColumn("epochs", epochs).withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    before = F.sum("size").over(W.partitionBy("src").orderBy("bucket")) - F.col("size")
    facts = F.struct("before", F.col("size").alias("bucket_size"), "source_size", "target", "epochs", "budget").alias("__b")
    buckets = stash(sums.withColumn("before", before).join(goals, "src").select(F.col("src").alias("__src"), F.col("bucket").alias("__bucket"), facts))
    small = buckets.count() <= BROADCAST_BUCKETS
    joined = rows.join(F.broadcast(buckets) if small else buckets, (F.col("__d.src") == F.col("__src")) & (F.col("__d.bucket") == F.col("__bucket")))
    ends = (F.col("__b.before") < F.col("__b.budget")) & (F.col("__b.before") + F.col("__b.bucket_size") > F.col("__b.budget"))
    whole = F.when(F.col("__b.before") < F.col("__b.budget"), F.col("__d.size")).otherwise(0)
    order = W.partitionBy("__src", "__bucket").orderBy("__d.key", "__d.th").rowsBetween(W.unboundedPreceding, 0)
    upto = F.sum("__d.size").over(order) - F.col("__d.size") + F.col("__b.before")
    part = F.greatest(F.lit(0), F.least(F.col("__d.size"), F.col("__b.budget") - upto))
    told = lambda df, p: df.withColumn("__t", F.struct("__b.source_size", "__b.target", "__b.epochs", p.cast("long").alias("part"))).drop("__src", "__bucket", "__b")
    return told(joined.where(~ends), whole).union(told(joined.where(ends), part))


def digest(docs: DataFrame, rule: Mix | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each row of docs."""
    rule = rule or Mix()
    rows = stash(weighed(docs.select("doc_id", "text", "source"), rule).select("doc_id", "__d"))
    return decided(rows, rule).select("doc_id", F.col("__d.size").alias("size"), "__t.source_size", "__t.target", (F.col("__t.epochs") * F.col("__d.size") + F.col("__t.part")).alias("taken"))


def mix(docs: DataFrame, rule: Mix | None = None) -> DataFrame:
    """The mixture as rows of docs: each document as often as it is taken.

    A document that is taken in part has its first words, joined by one space, in a row of its own, with n_chars, where
    there is one, counted anew. Documents without words are never taken.
    """
    rule = rule or Mix()
    rows = decided(stash(weighed(docs, rule)), rule)
    size, part = F.col("__d.size"), F.col("__t.part")
    whole = F.col("__t.epochs") + F.when(part == size, 1).otherwise(0)
    copies = F.when(size > 0, whole + F.when((part > 0) & (part < size), 1).otherwise(0)).otherwise(0).cast("int")
    taken = rows.where(copies > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), copies)))
    cut = F.col("__copy") > whole
    text = F.when(cut, F.array_join(F.slice(words_of(F.col("text")), F.lit(1), part.cast("int")), " ")).otherwise(F.col("text"))
    out = taken.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
