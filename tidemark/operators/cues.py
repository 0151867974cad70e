"""Order-dependent operators on cues: scenes, sentences, windows, packing, pairing, wrapping.

Cues are rows (doc_id, pos, start_ms, end_ms, text, ...). Windows are partitioned by document, so a document, not a
corpus, is what one task sorts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T

SENTENCE_END = r"[.!?。！？…♪]['\"”’»)\]]*\s*$"
OPEN_END = r"[,，、;；:：—–-]\s*$"
#: Bytes of a glossary that is broadcast, what a row has besides its strings, and bits of the bitmap of a larger one.
BROADCAST_BYTES, ROW_BYTES, BITS = 8 << 20, 64, 1 << 27


def doc_order() -> W:
    return W.partitionBy("doc_id").orderBy("pos")


def scenes(cues: DataFrame, gap_seconds: float = 30, kind: str = "kind") -> DataFrame:
    """cues with scene: per kind, a pause of more than gap_seconds opens a scene; ids follow the order of opening over
    all kinds."""
    thread = W.partitionBy("doc_id", kind).orderBy("pos")
    pause = F.col("start_ms") - F.lag("end_ms").over(thread)
    opened = cues.withColumn("__new", F.when(pause.isNull() | (pause > gap_seconds * 1000), 1).otherwise(0))
    opened = opened.withColumn("__id", F.when(F.col("__new") == 1, F.sum("__new").over(doc_order()) - 1))
    return opened.withColumn("scene", F.last("__id", ignorenulls=True).over(thread)).drop("__new", "__id")


def scene_counts(cues: DataFrame, gap_seconds: float = 30) -> DataFrame:
    return scenes(cues, gap_seconds).groupBy("doc_id").agg((F.max("scene") + 1).alias("scenes"))


def scene_safe_cuts(cues: DataFrame) -> DataFrame:
    """cues (with scene) with safe: nothing before this row belongs to a scene that goes on from here."""
    before = F.max("scene").over(doc_order().rowsBetween(W.unboundedPreceding, -1))
    after = F.min("scene").over(doc_order().rowsBetween(0, W.unboundedFollowing))
    return cues.withColumn("safe", F.coalesce(before < after, F.lit(True)))


def sentence_groups(cues: DataFrame, most_gap_ms: int = 1500, most_cues: int = 16) -> DataFrame:
    """cues with sentence: a cue goes on where the one before ends open, or this one begins in lower case, after at
    most most_gap_ms; chains are cut at most_cues."""
    last, gap = F.lag("text").over(doc_order()), F.col("start_ms") - F.lag("end_ms").over(doc_order())
    lower = F.regexp_extract(F.col("text"), r"\p{L}", 0).rlike(r"\p{Ll}")
    joins = (gap <= most_gap_ms) & ~T.is_music(F.col("text")) & ~T.is_music(last) & (last.rlike(OPEN_END) | (~last.rlike(SENTENCE_END) & lower))
    rows = cues.withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("__chain", F.sum("__new").over(doc_order()))
    within = F.row_number().over(W.partitionBy("doc_id", "__chain").orderBy("pos")) - 1
    rows = rows.withColumn("__part", F.floor(within / most_cues))
    first = F.min("pos").over(W.partitionBy("doc_id", "__chain", "__part"))
    return rows.withColumn("sentence", first).drop("__new", "__chain", "__part")


def merge_timeline(cues: DataFrame, gap_ms: int = 120) -> DataFrame:
    """doc_id, style, text, start_ms, end_ms, cues: equal texts of one style that follow within gap_ms are one event."""
    order = W.partitionBy("doc_id", "style", "text").orderBy("start_ms", "pos")
    reach = F.max("end_ms").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = cues.withColumn("__new", F.when(reach.isNull() | (F.col("start_ms") - reach > gap_ms), 1).otherwise(0)).withColumn("__event", F.sum("__new").over(order))
    return rows.groupBy("doc_id", "style", "text", "__event").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sort_array(F.collect_list("pos")).alias("cues")).drop("__event")


def overlap_ratio(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    span = F.greatest(a2, b2) - F.least(a1, b1)
    return F.when(span > 0, (F.least(a2, b2) - F.greatest(a1, b1)) / span).otherwise(0.0)


def overlap_candidates(events: DataFrame, least: float = 0.6, ahead: int = 12) -> DataFrame:
    """doc_id, a, b, ratio of events (doc_id, pos, start_ms, end_ms, text): each with the later ones, at most `ahead` on,
    that begin before it ends, overlap enough and differ in text. A lookahead of fixed size needs no range join."""
    rows = events
    following = F.collect_list(F.struct("pos", "start_ms", "end_ms", "text")).over(doc_order().rowsBetween(1, ahead))
    pairs = rows.withColumn("__next", following).withColumn("__b", F.explode("__next"))
    ratio = overlap_ratio(F.col("start_ms"), F.col("end_ms"), F.col("__b.start_ms"), F.col("__b.end_ms"))
    found = pairs.where((F.col("__b.start_ms") < F.col("end_ms")) & (F.col("__b.text") != F.col("text")))
    return found.select("doc_id", F.col("pos").alias("a"), F.col("__b.pos").alias("b"), ratio.alias("ratio")).where(F.col("ratio") >= least)


def pair_timeline(events: DataFrame, least: float = 0.6, ahead: int = 12) -> DataFrame:
    """doc_id, a, b: greedy pairs in order, each event used once, with the candidate that overlaps most."""

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for a, rows in group.sort_values(["a", "b"]).groupby("a", sort=True):
            if a in used:
                continue
            free = rows[~rows["b"].isin(used)]
            if len(free):
                b = free.loc[free["ratio"].idxmax(), "b"]
                used |= {a, b}
                out.append((a, b))
        return pd.DataFrame({"doc_id": [group["doc_id"].iloc[0]] * len(out), "a": [a for a, _ in out], "b": [b for _, b in out]})

    candidates = overlap_candidates(events, least, ahead)
    kind = dict(candidates.dtypes)
    return candidates.groupBy("doc_id").applyInPandas(greedy, f"doc_id {kind['doc_id']}, a {kind['a']}, b {kind['b']}")


def bilingual_documents(events: DataFrame, pairs: DataFrame, least_pairs: int = 6, least_share: float = 0.35) -> DataFrame:
    """doc_id, pairs, events, share of the documents whose pairs differ in script and cover enough."""
    script = events.select("doc_id", "pos", T.main_script(F.col("text")).alias("script"))
    a, b = (script.select("doc_id", F.col("pos").alias(side), F.col("script").alias(f"script_{side}")) for side in ("a", "b"))
    good = pairs.join(a, ["doc_id", "a"]).join(b, ["doc_id", "b"]).where("script_a <> script_b").groupBy("doc_id").agg(F.count("*").alias("pairs"))
    sizes = events.groupBy("doc_id").agg(F.count("*").alias("events"))
    found = good.join(sizes, "doc_id").withColumn("share", 2 * F.col("pairs") / F.col("events"))
    return found.where((F.col("pairs") >= least_pairs) & (F.col("share") >= least_share))


def neighbours(rows: DataFrame, suspect: str = "suspect") -> DataFrame:
    """Suspects and the rows right beside them, with resolved kept only for the neighbours that are no suspects."""
    near = F.lag(suspect, 1, False).over(doc_order()) | F.lead(suspect, 1, False).over(doc_order())
    return rows.withColumn("__near", near).where(F.col(suspect) | F.col("__near")).drop("__near")


def context_windows(rows: DataFrame, radius: int) -> DataFrame:
    return rows.withColumn("context", F.collect_list("text").over(doc_order().rowsBetween(-radius, radius)))


def id_runs(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, runs: the different values as `a-b` ranges, in order."""
    ranked = rows.select(*key, value).distinct().withColumn("__island", F.col(value) - F.row_number().over(W.partitionBy(*key).orderBy(value)))
    spans = ranked.groupBy(*key, "__island").agg(F.min(value).alias("a"), F.max(value).alias("b"))
    shown = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")))
    ordered = F.array_sort(F.collect_list(F.struct("a", shown.alias("s"))))
    return spans.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda x: x["s"]), ",").alias("runs"))


def prefix_sums(rows: DataFrame, cost: str) -> DataFrame:
    return rows.withColumn("upto", F.sum(cost).over(doc_order()))


def greedy_pack(rows: DataFrame, cost: str, most_cost: int, most_items: int = 50) -> DataFrame:
    """doc_id, pos, bin: items in order, a new bin where the cost or the number of items would pass its limit."""
    items = F.array_sort(F.collect_list(F.struct("pos", F.col(cost).cast("long").alias("c"))))
    start = F.struct(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("cost"), F.lit(0).alias("n"), F.array().cast("array<struct<pos:bigint,bin:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        full = (s["n"] > 0) & ((s["cost"] + x["c"] > most_cost) | (s["n"] >= most_items))
        bin_ = F.when(full, s["bin"] + 1).otherwise(s["bin"])
        return F.struct(bin_.alias("bin"), F.when(full, x["c"]).otherwise(s["cost"] + x["c"]).alias("cost"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"), F.concat(s["out"], F.array(F.struct(x["pos"].cast("long").alias("pos"), bin_.alias("bin")))).alias("out"))

    packed = rows.groupBy("doc_id").agg(F.aggregate(items, start, step)["out"].alias("out"))
    return packed.select("doc_id", F.explode("out").alias("x")).select("doc_id", "x.pos", "x.bin")


def chapter_pack(items: DataFrame, limit: int) -> DataFrame:
    """doc_id, pos, batch, oversized: whole chapters to a batch as long as they fit; a chapter beyond the limit is split
    by items; an item beyond it is reported."""
    kind = dict(items.dtypes)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        batch, used, out = 0, 0, []
        for _, chapter in group.groupby("chapter", sort=False):
            total = int(chapter["cost"].sum())
            if used and used + total > limit:
                batch, used = batch + 1, 0
            for cost in chapter["cost"]:
                if used and used + cost > limit:
                    batch, used = batch + 1, 0
                used += int(cost)
                out.append((batch, bool(cost > limit)))
        return pd.DataFrame({"doc_id": group["doc_id"], "pos": group["pos"], "batch": [b for b, _ in out], "oversized": [o for _, o in out]})

    return items.select("doc_id", "pos", "chapter", "cost").groupBy("doc_id").applyInPandas(pack, f"doc_id {kind['doc_id']}, pos {kind['pos']}, batch int, oversized boolean")


def scene_chunks(cues: DataFrame, most: int) -> DataFrame:
    """doc_id, pos, chunk: at most `most` cues, cut at the last scene-safe point past half, else at the limit."""
    kind = dict(cues.dtypes)

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos").reset_index(drop=True)
        chunk, at, n = [0] * len(group), 0, 0
        while at < len(group):
            end = min(len(group), at + most)
            if end < len(group):
                end = next((j for j in range(end, at + most // 2, -1) if group["safe"][j]), end)
            chunk[at:end] = [n] * (end - at)
            at, n = end, n + 1
        return pd.DataFrame({"doc_id": group["doc_id"], "pos": group["pos"], "chunk": chunk})

    return scene_safe_cuts(cues).select("doc_id", "pos", "safe").groupBy("doc_id").applyInPandas(cut, f"doc_id {kind['doc_id']}, pos {kind['pos']}, chunk int")


def dedupe(rows: DataFrame, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """(slot, payload) of the different payloads and rows with their slot, for work that is done once and joined back."""
    slots = rows.groupBy(*payload).agg(F.min("pos").alias("slot"))
    return slots, rows.join(slots, payload)


def propagate(rows: DataFrame, results: DataFrame, payload: list[str]) -> DataFrame:
    return rows.join(results, payload, "left")


def apply_deltas(base: DataFrame, delta: DataFrame, key: list[str], value: str) -> DataFrame:
    """base with delta's values where there are any; unknown keys are left out."""
    d = delta.select(*key, F.col(value).alias("__value"))
    return base.join(d, key, "left").withColumn(value, F.coalesce("__value", value)).drop("__value")


def marker_parts(rows: DataFrame) -> DataFrame:
    """doc_id, marker, part of texts with ⟦cN⟧ markers; a marker that stands twice is void."""
    parts = rows.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"⟦c(\d+)⟧([^⟦]*)"), 0)).alias("i", "p"))
    keyed = parts.select("doc_id", F.regexp_extract("p", r"⟦c(\d+)⟧", 1).cast("int").alias("marker"), F.btrim(F.regexp_replace("p", r"⟦c\d+⟧", "")).alias("part"))
    return keyed.groupBy("doc_id", "marker").agg(F.first("part").alias("part"), F.count("*").alias("n")).where("n = 1").drop("n")


def token_ledger(docs: DataFrame, pattern: str = r"\p{L}[\p{L}\p{N}'’-]*") -> DataFrame:
    """key, frequency, docs, capitals, lowers: tokens by their lower-case form."""
    tokens = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({pattern})"), 1)).alias("t"))
    upper = F.col("t").rlike(r"^\p{Lu}")
    return tokens.groupBy(F.lower("t").alias("key")).agg(F.count("*").alias("frequency"), F.countDistinct("doc_id").alias("docs"), F.count_if(upper).alias("capitals"), F.count_if(~upper).alias("lowers"))


def name_runs(docs: DataFrame, least: int = 2) -> DataFrame:
    """run, n: two or more capitalised words that follow one another, and how often they do, at least `least` times."""
    runs = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+)"), 1)).alias("run"))
    return runs.groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def glossary_hits(docs: DataFrame, terms: DataFrame, most_words: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, term, n: the terms (term) that stand in a text between word edges. Texts' n-grams, of up to as many words
    as the longest term has, meet the terms in an equi-join. Terms of up to broadcast_bytes, which are counted first, go to
    the texts; of a larger glossary a bitmap of hashes does, and only grams that it has are shuffled."""
    most_words = most_words or terms.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}']+)"), 1)
    # Each word with those that follow it, null beyond the end.
    names = [f"w{i}" for i in range(most_words)]
    rows = docs.select("doc_id", words.alias("w0")).withColumns({name: F.slice("w0", i + 1, F.greatest(F.size("w0") - i, F.lit(0))) for i, name in enumerate(names)})
    rows = rows.select("doc_id", F.explode(F.arrays_zip(*names)).alias("w")).select("doc_id", "w.*")
    keyed = terms.select(F.lower("term").alias("key"), "term").dropDuplicates(["key"])
    grams = F.array(*(F.concat(*(part for name in names[: n + 1] for part in (F.lit(" "), F.col(name)))) for n in range(most_words)))
    keys = lambda found: found.select("doc_id", F.explode(F.transform(grams, lambda g: F.substr(g, F.lit(2)))).alias("key")).where("key is not null")
    if (keyed.agg(F.sum(F.octet_length("key") + F.octet_length("term") + ROW_BYTES)).first()[0] or 0) <= broadcast_bytes:
        starts = keyed.select(F.element_at(F.split("key", " "), 1).alias("w0")).distinct()
        hits = keys(rows.join(F.broadcast(starts), "w0", "left_semi")).join(F.broadcast(keyed), "key")
    else:
        hits = in_bitmap(keys(rows), keyed, "key").join(keyed.hint("merge"), "key")
    return hits.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def in_bitmap(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows but for most whose key is none of keys: those whose hash has no bit in a bitmap of the hashes of keys, which is
    broadcast and has a fixed size, however many keys there are."""
    slot = F.pmod(F.xxhash64(key), F.lit(BITS))
    maps = keys.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("__bits"))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("__bits", (at / 8 + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("__bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(maps), "__bucket")
    return found.where(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0).drop("__bucket", "__bits")


def sibling_contrast(rows: DataFrame, key: str, share: str) -> DataFrame:
    """rows with marked: a share of at least 0.06 and of 2.5 times the least of its siblings and 0.02 more."""
    least = F.min(share).over(W.partitionBy(key))
    return rows.withColumn("marked", (F.col(share) >= 0.06) & (F.col(share) >= 2.5 * least + 0.02))


def outstanding(cues: DataFrame) -> DataFrame:
    return cues.where(T.translatable(F.col("text")) & (F.btrim(F.coalesce("translation", F.lit(""))) == ""))


def missing_summary(cues: DataFrame) -> DataFrame:
    missing = F.col("translation").isNull()
    return cues.groupBy("doc_id").agg(F.count_if(missing).alias("missing"), F.sort_array(F.collect_list(F.when(missing, F.col("pos")))).alias("positions"))


def spread_sample(rows: DataFrame, n: int) -> DataFrame:
    """n rows of each document, evenly apart."""
    rows = rows.withColumns({"__i": F.row_number().over(doc_order()) - 1, "__n": F.count("*").over(W.partitionBy("doc_id"))})
    # Row i is taken where floor(i * n / size) changes.
    at = lambda i: F.floor(i * n / F.col("__n"))
    return rows.where((F.col("__n") <= n) | (F.col("__i") == 0) | (at(F.col("__i")) != at(F.col("__i") - 1))).drop("__i", "__n")


def greedy_cover(groups: DataFrame, limit: int) -> list:
    """Ids of at most limit groups (group_id, key) chosen one by one by how many uncovered keys they add, ties to the
    lesser id. Each round is one distributed aggregation; only the chosen id comes to the driver."""
    rest, chosen = groups.select("group_id", "key").distinct(), []
    for _ in range(limit):
        best = rest.groupBy("group_id").agg(F.count("*").alias("gain")).orderBy(F.desc("gain"), "group_id").first()
        if best is None:
            break
        chosen.append(best["group_id"])
        covered = groups.where(F.col("group_id").isin(chosen)).select("key").distinct()
        rest = groups.select("group_id", "key").distinct().join(covered, "key", "left_anti")
    return chosen


def wrap_lines(cues: DataFrame, column: str, most: int = 42) -> DataFrame:
    """cues with the column wrapped to two lines where it is longer than most: at the space that scores best by balance,
    punctuation before it, and length."""

    def best(text: str) -> str:
        flat = " ".join(text.split())
        if len(flat) <= most:
            return flat
        options = [i for i, c in enumerate(flat) if c == " "]
        if not options:
            return flat
        score = lambda i: abs(len(flat) - 1 - 2 * i) - (12 if flat[i - 1] in ".!?;:" else 8 if flat[i - 1] == "," else 0) + 4 * max(0, i - most, len(flat) - i - 1 - most)
        cut = min(options, key=score)
        return f"{flat[:cut]}\n{flat[cut + 1 :]}"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: t if t is None else best(t))

    return cues.withColumn(column, F.pandas_udf(run, "string")(F.col(column)))


def resume_context(cues: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """The rows of the breakpoint's scene that come before it (breakpoints: doc_id, pos)."""
    at = cues.join(breakpoints.select("doc_id", F.col("pos").alias("at")), "doc_id")
    scene = at.where("pos = at").select("doc_id", F.col("scene").alias("s"), "at")
    return cues.join(scene, "doc_id").where("scene = s AND pos < at").drop("s", "at")


def track_document(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, start_ms, end_ms, text of media blocks (doc_id, start_ms, duration_ms, text): stable by start; a
    missing duration ends at the next start, at most 2 s on, and after 1 ms at least."""
    order = W.partitionBy("doc_id").orderBy("start_ms", "pos")
    following = F.lead("start_ms").over(order)
    end = F.coalesce(F.col("start_ms") + F.col("duration_ms"), F.least(F.col("start_ms") + 2000, F.coalesce(following, F.col("start_ms") + 2000)))
    return blocks.select("doc_id", (F.row_number().over(order) - 1).alias("pos"), "start_ms", F.greatest(F.col("start_ms") + 1, end).alias("end_ms"), "text")
