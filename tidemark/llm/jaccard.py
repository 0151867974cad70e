"""Exact Jaccard join of documents on word n-grams, by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes. Cut into ranges of that order, a set falls into
fragments, and two linked sets of nearly equal size (a size class and the one below) differ in few of them.

1. Evidence: the hashes of all fragments, half as many again as linked sets can differ in, are dealt out by ranges.
   Each range counts the sets that have each fragment and gives every set its partial number of fragments that another
   set has too; these are summed per set. A set with fewer than a partner must share links with none and is settled.
   So a set that merely quotes others goes no further, and the work follows the sets that have a near copy.
2. Candidates: the other sets are cut into fragments anew, the fewest that must have an equal one in each linked set.
   Sets that hang together by equal fragments form a cluster.
   A cluster of more than one block may be a chain of sets that have one fragment each in common. It is cut apart by
   what linked sets have in common at least: of fragments that few sets have, enough in one pair; of frequent ones, the
   rarest that the others leave open.
3. Verification: within a cluster overlaps are counted fragment by fragment and summed for each pair, in blocks of
   bounded size, inside the tasks. No pair is emitted: a block sends the stars of its links and each set's number of
   links. So a large group of near copies costs rows in proportion to its size.

Nothing is broadcast but what was counted first; every shuffle is by hashes, and grows in proportion to the input.
Equal sets are one class with one 64-bit id; two different sets would share an id once in 2**64 pairs.

Defined results: null text and text without words have an empty set and link with nothing; equal rows are linked like
any copies; component_id is the least doc_id of the class that is not null, or null; a text of any length is one set,
held by one task; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import sketch
from .components import components
from .session import NO_ID, bytes_estimate, doc_id_of, join_unique, keyed, n_partitions, release, stash
from .textwords import U64, Hasher, by_range, mix, slices, stream, word_hashes

#: A block has at most about so many sets and so many n-grams.
BLOCK_SETS, BLOCK_GRAMS = 1024, 1 << 20
#: Candidate sets (about 100 bytes each) whose facts are broadcast; beyond that they are shuffled.
BROADCAST_SETS = 300_000
#: Signatures whose first set a task remembers, and sets that it remembers to have sent.
LEADS, SENT = 1 << 18, 1 << 18
#: Fragments that a task gathers before it sends them, and about so many are counted at a time.
FLUSH, RANGE = 1 << 19, 1 << 22
#: So many parts of a range are counted one after the other, and fewer ranges than these do for a small input.
PARTS, LEAST_RANGES = 4, 128
#: Sets that may have a fragment while their pairs are counted; more hang together by it.
FEW_SETS = 32
#: Ranges of the global order whose partial overlaps are counted one after the other.
VERTICAL = 16
EVIDENCE = "part int, did long, th long, n long, sid long, meta long, shared long, sids binary, metas binary, counts binary, digests binary"
WIDE = "sig long, sid long, up long, need long"
COUNTED = "did long, th long, n long, sid long, meta long, shared long"


@dataclass(frozen=True)
class Rule:
    """Sets of k-word n-grams link when 100 * intersection >= percent * union."""

    k: int = 4
    percent: int = 85

    def differing(self, size: int) -> int:
        """The most n-grams in which two linked sets of at most this size differ."""
        return (100 - self.percent) * 2 * size // (100 + self.percent)


def size_classes(rule: Rule, most: int) -> list[tuple[int, int]]:
    """(least, greatest size) of each class; a set's linked partners are in its class or one beside it."""
    out, low = [(0, low - 1)] if (low := next(n for n in range(1, 10**6) if rule.differing(n) > 0)) else [], low
    while low <= most:
        high = -(-low * 100 // rule.percent)
        out.append((low, high - 1))
        low = high
    return out


class Shingler:
    """Sets of n-gram hashes of the documents of a slice."""

    def __init__(self, k: int):
        self.k, self.words, self.grams = k, Hasher(41), Hasher(42)

    def sets(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        words, h = word_hashes(batch.column(batch.schema.get_field_index("text")), self.words, fold=True)
        grams = self.grams.windows(h, self.k)
        counts = np.diff(words.first)
        short = np.flatnonzero((counts > 0) & (counts < self.k))
        whole = dict(zip(short.tolist(), self.grams.ranges(h, words.first[short], words.first[short + 1]), strict=True))
        for d, (a, n) in enumerate(zip(words.first[:-1].tolist(), counts.tolist(), strict=True)):
            yield np.unique(grams[a : a + n - self.k + 1]) if n >= self.k else np.array([whole[d]] if n else [], dtype=U64)


def set_id(grams: np.ndarray) -> int:
    """The id of a set; it depends on the n-grams alone."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.sum(mix(grams ^ U64(0x5E7))) + U64(len(grams))], dtype=U64)).view(np.int64)[0])


@dataclass
class Cut:
    """Fragments of sets: hashes and, in order, the entry of each. An entry is a set (by index) as a member of its own
    class (up 0) or the next (up 1); need: so many of its fragments at least must a linked set share."""

    sigs: np.ndarray
    entry: np.ndarray
    owner: np.ndarray
    up: np.ndarray
    need: np.ndarray


class Fragments:
    """Cuts sets into fragments."""

    def __init__(self, rule: Rule):
        self.rule, self.salt = rule, stream(77, 2)
        self._grow(64)

    def _grow(self, most: int) -> None:
        classes = size_classes(self.rule, most)
        self.low, self.high = (np.array([c[i] for c in classes], dtype=np.int64) for i in (0, 1))

    def cut(self, sets: list[np.ndarray], wide: bool, empty_too: bool | None = None) -> Cut:
        """The fewest fragments that suffice, or half as many again (wide). Sets too small to differ have none.

        Linked sets differ in at most k n-grams, each of which spoils one fragment: of e fragments that are not empty,
        e - k are equal in both. With the fewest (k + 1 and some more, as some are empty) a set that has k or fewer also
        gives its empty ones, so of two linked sets either both do or one has an equal fragment that is not empty. With
        half as many again it does so if empty_too is set.
        """
        empty_too = not wide if empty_too is None else empty_too
        size = np.array([len(s) for s in sets], dtype=np.int64)
        if len(size) and self.high[-2] < (most := int(size.max())):
            self._grow(4 * most)
        own = np.searchsorted(self.low, size, side="right") - 1
        grams = np.concatenate(sets) if sets else np.zeros(0, dtype=U64)
        content, first = mix(grams ^ self.salt[0]), np.append(0, np.cumsum(size))
        out: list[tuple[np.ndarray, ...]] = []
        for up in (0, 1):
            c = own + up
            low, high = self.low[c], self.high[c]
            k = self.rule.differing(high)
            total = k + 1
            if wide:
                total = total * 3 // 2
            else:
                empty = total * np.exp(-self.rule.percent * low / 100 / total)
                total = total + np.ceil(empty + 4 * np.sqrt(empty)).astype(np.int64)
            at = np.flatnonzero((c > 0) & (100 * size >= self.rule.percent * low))
            lengths = size[at]
            doc = np.repeat(np.arange(len(at)), lengths)
            take = np.arange(len(doc)) + np.repeat(first[:-1][at] - (np.cumsum(lengths) - lengths), lengths)
            place = ((grams[take] >> U64(32)) * total[at].astype(U64)[doc]) >> U64(32)
            begins = np.flatnonzero((np.diff(place, prepend=U64(0)) != 0) | (np.diff(doc, prepend=-1) != 0))
            owner, place = doc[begins], place[begins]
            full = np.bincount(owner, minlength=len(at))
            name = c[at].astype(U64) << U64(32)
            with np.errstate(over="ignore"):
                sums = np.add.reduceat(content[take], begins) if len(begins) else content[:0]
                sigs = mix(sums + mix(place + name[owner] + self.salt[1]))
                if empty_too:
                    gaps = [(d, np.setdiff1d(np.arange(total[at[d]], dtype=U64), place[owner == d])) for d in np.flatnonzero(full <= k[at]).tolist()]
                    sigs = np.concatenate([sigs, *(mix(mix(empty + name[d] + self.salt[1]) ^ U64(0xE)) for d, empty in gaps)])
                    owner = np.concatenate([owner, *(np.full(len(empty), d) for d, empty in gaps)])
            out.append((sigs, owner, at, np.full(len(at), up), full - k[at]))
        n = len(out[0][2])
        return Cut(np.concatenate([x[0] for x in out]), np.concatenate([out[0][1], out[1][1] + n]), *(np.concatenate([x[i] for x in out]) for i in (2, 3, 4)))

    def signatures(self, grams: np.ndarray) -> np.ndarray:
        """Two different linked sets have a signature in common. (Sets too small to differ have none.)"""
        return self.cut([grams], wide=False).sigs


def _names(kind: str) -> list[str]:
    return [part.split()[0] for part in kind.split(", ")]


def _record(columns: list, kind: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], _names(kind))


def _none(n: int) -> pa.Array:
    return pa.nulls(n, pa.int64())


def _planes(x: np.ndarray) -> bytes:
    """Numbers of 32 bits, first all their lowest bytes: the higher ones are mostly zero, and packed well by that."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _entries(sids: pa.Buffer, metas: pa.Buffer, counts: pa.Buffer, digests: pa.Buffer) -> list:
    """What _sent has packed, with each entry's set, meta and count by itself."""
    meta, n = (np.ascontiguousarray(np.frombuffer(x, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel() for x in (metas, counts))
    there = np.flatnonzero(n)
    return [np.frombuffer(sids, dtype=np.int64)[there >> 1], meta[there], n[there], digests]


def _sent(cuts: list[tuple[Cut, np.ndarray]], ranges: int) -> pa.RecordBatch:
    """The fragments of some sets, a row for each range of hashes: the sets that have any there, of both entries of each
    need * 2 + up and how many, and 32 further bits of each hash."""
    offset, places = 0, []
    meta = np.zeros(2 * sum(len(names) for _, names in cuts), dtype=np.uint32)
    for cut, names in cuts:
        at = (cut.owner + offset) * 2 + cut.up
        meta[at] = np.maximum(cut.need, 0) * 2 + cut.up
        places.append(at[cut.entry])
        offset += len(names)
    sigs, place = np.concatenate([c.sigs for c, _ in cuts]), np.concatenate(places)
    sid = np.concatenate([names for _, names in cuts])
    wide = (sigs >> U64(32)) * U64(ranges)
    part = (wide >> U64(32)).astype(np.int64)
    order = np.lexsort((place, part))
    part, place, digest = part[order], place[order], (mix(sigs[order]) >> U64(32)).astype(np.uint32)
    owner = place >> 1
    heads = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    both = np.diff(np.append(heads, len(part)))
    up = np.add.reduceat(place & 1, heads) if len(heads) else both
    counts = np.stack([both - up, up], axis=1)
    cuts_ = np.flatnonzero(np.diff(part, prepend=-1) != 0)
    rows = []
    for a, b in zip(cuts_.tolist(), [*cuts_[1:].tolist(), len(part)], strict=True):
        i, j = np.searchsorted(heads, [a, b])
        who = owner[heads[i:j]]
        rows.append((int(part[a]), sid[who].tobytes(), _planes(meta.reshape(-1, 2)[who].ravel()), _planes(counts[i:j].ravel()), digest[a:b].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[_none(len(rows))] * 6, *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3, 4))], _names(EVIDENCE))


def _evidence(rule: Rule, ranges: int):
    """Of each document a row with its set; of each set of the task the fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, fragments, seen = Shingler(rule.k), Fragments(rule), set()
        held, n = [], 0
        for batch in slices(batches):
            names, sizes, new, fresh = [], [], [], []
            for grams in shingler.sets(batch):
                names.append(set_id(grams))
                sizes.append(len(grams))
                if len(grams) and names[-1] not in seen:
                    seen.add(names[-1])
                    new.append(grams)
                    fresh.append(names[-1])
            did, th = (batch.column(batch.schema.get_field_index(c)) for c in ("did", "th"))
            names, none = np.array(names, dtype=np.int64), pa.nulls(len(names), pa.binary())
            # Copies of one text have different ids, so they are dealt out evenly.
            part = pa.array((mix(did.to_numpy().view(U64) + mix(np.arange(len(names), dtype=U64))) % U64(ranges)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part, did, th, pa.array(sizes, pa.int64()), pa.array(names), *[_none(len(names))] * 2, none, none, none, none], _names(EVIDENCE))
            if new:
                cut = fragments.cut(new, wide=True)
                held.append((cut, np.array(fresh, dtype=np.int64)))
                n += len(cut.sigs)
            if n >= FLUSH:
                yield _sent(held, ranges)
                held, n = [], 0
            if len(seen) > SENT:
                seen.clear()
        if n:
            yield _sent(held, ranges)

    return run


def _shared(digest: np.ndarray, sid: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """True for each place whose fragment two sets have or more; sid[owner] is a place's set."""
    out = np.zeros(len(digest), dtype=bool)
    for low in range(PARTS):
        at = np.flatnonzero(digest % PARTS == low)
        d, s = digest[at], sid[owner[at]]
        order = np.argsort((d.astype(U64) << U64(32)) | (s.view(U64) & U64(0xFFFFFFFF)))
        d, s = d[order], s[order]
        first = np.diff(d.astype(np.int64), prepend=-1) != 0
        fresh = first | np.append(False, s[1:] != s[:-1])[: len(s)]
        group = np.cumsum(first) - 1
        out[at[order]] = np.bincount(group, weights=fresh)[group] > 1
    return out


def _counted(held: list[list[pa.Buffer]]) -> pa.RecordBatch:
    """Of a range the sets with fragments that others share, and how many.

    A set that several tasks have sent counts as sent once. Fragments of one set whose digests are equal count each: a
    count may be too high for that, which costs a comparison, but never too low, which would lose a link.
    """
    sid, meta, counts, digest = (np.concatenate([np.frombuffer(x[i], dtype=kind) for x in held]) for i, kind in enumerate((np.int64, np.uint32, np.uint32, np.uint32)))
    order = np.lexsort((meta, sid))
    once = np.zeros(len(sid), dtype=bool)
    once[order] = np.append(True, (np.diff(sid[order]) != 0) | (np.diff(meta[order].astype(np.int64)) != 0))[: len(sid)]
    owner = np.repeat(np.arange(len(sid), dtype=np.int32), counts)
    shared = np.bincount(owner[_shared(digest, sid, owner) & once[owner]], minlength=len(sid)).astype(np.int64)
    keep = (shared > 0) | (meta < 2)  # who needs none is never ruled out
    n = int(keep.sum())
    return _record([_none(n), _none(n), _none(n), sid[keep], meta[keep].astype(np.int64), shared[keep]], COUNTED)


def evidence(rows: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(did, th, n, sid) of each row, and (sid) of the sets that may have a linked one."""
    # A set of n n-grams has about (100 - percent) / 30 * n fragments, and a word has about 6 bytes.
    # Each range that a set has fragments in costs its id once more, so there are no more ranges than memory asks for.
    ranges = max(min(n_partitions(rows.sparkSession), LEAST_RANGES), int(bytes_estimate(rows) / 180 * (100 - rule.percent)) // RANGE)
    sent = rows.mapInArrow(_evidence(rule, ranges), EVIDENCE)
    counted = stash(sent.repartition("part").sortWithinPartitions("part").mapInArrow(lambda batches: by_range(batches, COUNTED, lambda held: _counted([_entries(*x) for x in held])), COUNTED))
    members = counted.where("did IS NOT NULL").select("did", "th", "n", "sid")
    found = counted.where("did IS NULL").groupBy("sid", "meta").agg(F.sum("shared").alias("shared"))
    return members, found.where(F.col("shared") >= F.shiftright("meta", 1)).select("sid").distinct()


def texts_of(rows: DataFrame, wanted: DataFrame, make, schema: str) -> DataFrame:
    """make (an Arrow function) over the rows (did, th, text) whose (did, th) is wanted, and over some others.

    While the wanted are few a bitmap of them rules out the others where they are read; beyond that they are joined.
    """
    if (n := wanted.count()) > sketch.MOST_CELLS // 8:
        return rows.join(wanted.select("did", "th").distinct(), ["did", "th"], "left_semi").mapInArrow(make, schema)
    known = sketch.build(wanted.select(F.xxhash64("did", "th").alias("__k")), sketch.counted("__k"), sketch.cells_for(n, per_key=8), least=1)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = lambda b: b.column(b.schema.get_field_index("__k")).to_numpy().view(U64)
        return make(b.filter(pa.array(known.value.repeated(at(b)))) for b in batches)

    return rows.withColumn("__k", F.xxhash64("did", "th")).mapInArrow(needed, schema)


def jaccard_join(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """One row for each row of docs: did, th (see session.keyed), n_shingles, set_id, class_id (the same for
    documents that links connect), n_links (different texts or copies that it links with)."""
    rule = Rule(k, percent)
    rows = keyed(docs)
    members, hopeful = evidence(rows, rule)
    facts = members.where("n > 0").groupBy("sid").agg(F.min(F.struct("did", "th")).alias("key"), F.count("*").alias("copies"), F.first("n").alias("n"))
    facts = stash(facts.select("sid", "key.did", "key.th", "copies", "n"))
    # One document stands for each set.
    standing = stash(facts.join(hopeful, "sid", "left_semi"))

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for part in slices(batches):
            sets = list(shingler.sets(part))
            names = pa.array([set_id(g) for g in sets], pa.int64())
            grams = pa.array([g.tobytes() for g in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in ("did", "th")] + [names, grams], ["did", "th", "sid", "grams"])

    held = texts_of(rows, standing, shingle, "did long, th long, sid long, grams binary")
    few = standing.count() <= BROADCAST_SETS
    if few:
        held = held.join(F.broadcast(standing.select("sid", "did", "th")), ["sid", "did", "th"], "left_semi")
    # Beyond that the few others that a bitmap lets pass stay: a set that stands twice is compared once, and one that is
    # not hopeful has no place below. So no set travels for them.
    held = stash(held.select("sid", "grams"))
    near = _near(held, rule)
    clusters = components(near).select(F.col("node").alias("sid"), F.col("component").alias("cluster"))
    placed = stash(standing.join(clusters, "sid").select("sid", "cluster", "copies", "n"))
    sizes = _sizes(placed)
    over = sizes.where("blocks > 1").select("cluster")
    if not over.isEmpty():
        chained = stash(placed.join(F.broadcast(over), "cluster", "left_semi"))
        told = held.join(F.broadcast(chained.select("sid")) if few else chained.select("sid"), "sid", "left_semi")
        apart = components(_nearer(told, rule)).select(F.col("node").alias("sid"), F.col("component").alias("cluster"))
        placed = stash(placed.join(F.broadcast(over), "cluster", "left_anti").unionByName(chained.drop("cluster").join(apart, "sid")))
        sizes = _sizes(placed)
    # The sets are the bulk: while the facts beside them are few they are broadcast, so the sets travel only once.
    placed = join_unique(placed, sizes, "cluster", "sets").drop("n", "sets")
    blocked = (
        held.join(F.broadcast(placed) if few else placed, "sid")
        .withColumn("own", F.pmod(F.col("sid"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cluster", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "sid", "own", "copies", "grams")
    )
    found = stash(blocked.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b", "sid").mapInArrow(_compare(rule), "sid long, root long, links long"))
    release(held)
    classes = components(found.select("sid", "root"))
    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    told = facts.join(classes.select(F.col("node").alias("sid"), "component"), "sid", "left").join(links, "sid", "left")
    told = stash(told.select("sid", "copies", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    return join_unique(members, told, "sid", "copies").select(
        "did", "th", F.col("n").alias("n_shingles"), F.col("sid").alias("set_id"), F.coalesce("component", "sid").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links")
    )


def _sizes(placed: DataFrame) -> DataFrame:
    """(cluster, blocks, sets): the number of blocks that each cluster is compared in, and of its sets."""
    return stash(placed.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks"), F.count("*").alias("sets")))


def _nearer(held: DataFrame, rule: Rule) -> DataFrame:
    """(sid, lead): linked sets hang together by these, and by more evidence than one common fragment.

    Of its fragments (half as many again as linked sets can differ in) a set has `need` or more in common with each
    linked one. At most `many` of them are among its frequent ones, so need - many are rare and counted for each pair.
    Put in one order, rare ones first, two linked sets have one in common among all but the last need - 1 of each; if it
    is frequent, it is among the many - need + 1 rarest of its kind, and the sets that have it hang together.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fragments = Fragments(rule)
        for batch in slices(batches, text="grams"):
            names = batch.column(0).to_numpy()
            found = fragments.cut([np.frombuffer(x.as_buffer(), dtype=U64) for x in batch.column(1)], wide=True, empty_too=True)
            yield _record([found.sigs.view(np.int64), *(x[found.entry] for x in (names[found.owner], found.up, np.maximum(found.need, 0)))], WIDE)

    told = stash(held.mapInArrow(cut, WIDE).distinct())
    counts = stash(told.groupBy("sig").agg(F.count("*").alias("sets"), F.min("sid").alias("lead")).where("sets > 1"))
    shared = join_unique(told, counts, "sig", "sets").where("sets IS NOT NULL")
    entry = W.partitionBy("sid", "up")
    many = F.count(F.when(F.col("sets") > FEW_SETS, 1)).over(entry)
    placed = shared.withColumn("many", many).withColumn("last", F.count("*").over(entry) - F.row_number().over(entry.orderBy("sets", "sig")))
    placed = stash(placed)
    # The frequent ones are the last of an entry: all of them but need - 1.
    stars = placed.where(F.col("sets") > FEW_SETS).where("last >= need - 1 AND sid != lead").select("sid", "lead")
    rare = placed.where(F.col("sets") <= FEW_SETS).select("sig", "sid", "up", (F.col("need") - F.col("many")).alias("short"))
    # Sets of one class meet as such, so they need not meet as members of the next class too.
    a, b = (rare.select("sig", *(F.col(c).alias(c + x) for c in ("sid", "up", "short"))) for x in "ab")
    pairs = a.join(b, "sig").where("sida < sidb AND upa + upb < 2").groupBy("sida", "sidb", "upa", "upb").agg(F.count("*").alias("n"), F.max(F.greatest("shorta", "shortb")).alias("short"))
    return pairs.where("n >= short").select(F.col("sida").alias("sid"), F.col("sidb").alias("lead")).union(stars).distinct()


def _near(held: DataFrame, rule: Rule) -> DataFrame:
    """(sid, lead): sets with a common signature hang together by these.

    Of each signature a task sends the first set that has it; its further sets are put down as near that one, so a
    frequent signature costs a task one row.
    """
    kind = "sig long, sid long, lead long"

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fragments, leads = Fragments(rule), {}
        for batch in slices(batches, text="grams"):
            names = batch.column(0).to_numpy()
            cut = fragments.cut([np.frombuffer(x.as_buffer(), dtype=U64) for x in batch.column(1)], wide=False)
            firsts, near = ([], []), set()
            for sig, name in zip(cut.sigs.view(np.int64).tolist(), names[cut.owner[cut.entry]].tolist(), strict=True):
                if (first := leads.setdefault(sig, name)) == name:
                    firsts[0].append(sig)
                    firsts[1].append(name)
                else:
                    near.add((name, first))
            yield _record([*firsts, _none(len(firsts[0]))], kind)
            yield _record([_none(len(near)), [x for x, _ in near], [x for _, x in near]], kind)
            if len(leads) > LEADS:
                leads.clear()

    told = stash(held.mapInArrow(lead, kind))
    first = F.min("sid").over(W.partitionBy("sig"))
    shared = told.where("sig IS NOT NULL").select("sid", first.alias("lead")).where("sid != lead")
    return shared.union(told.where("lead IS NOT NULL").select("sid", "lead")).distinct()


def _compare(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for cluster, a, b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cluster, a, b) != key:
                    yield from _links(rule, key, rows)
                    key, rows = (cluster, a, b), []
                rows.append(row)
        yield from _links(rule, key, rows)

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs: partial overlaps by range of the global order, summed."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    shared = np.flatnonzero(counts > 1)
    column = np.full(len(values), -1)
    column[shared] = np.arange(len(shared))
    keep = column[place] >= 0
    owner, column = owner[keep], column[place[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    cuts = np.searchsorted(values[shared], np.arange(VERTICAL + 1, dtype=np.float64) * 2.0 ** (64 - 4))
    for low, high in zip(cuts[:-1].tolist(), [*cuts[1:-1].tolist(), len(shared)], strict=True):
        for at in range(low, high, 4096):
            a, b = np.searchsorted(column, [at, min(high, at + 4096)])
            part = np.zeros((len(sets), min(high, at + 4096) - at), dtype=np.float32)
            part[owner[a:b], column[a:b] - at] = 1
            total += part @ part.T
    return total


def _links(rule: Rule, key, rows: list) -> Iterator[pa.RecordBatch]:
    """Stars of the linked sets of a block, or of a pair of blocks (then only links from one to the other)."""
    rows = list({row[0]: row for row in rows}.values())
    if len(rows) < 2:
        return
    sid = np.array([r[0] for r in rows], dtype=np.int64)
    own = np.array([r[1] for r in rows])
    copies = np.array([r[2] for r in rows], dtype=np.float64)
    sets = [np.frombuffer(r[3], dtype=U64) for r in rows]
    size = np.array([len(s) for s in sets], dtype=np.float64)
    common = overlaps(sets).astype(np.float64)
    linked = 100 * common >= rule.percent * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(linked, False)
    if key[1] != key[2]:
        linked &= own[:, None] != own[None, :]
    links = (linked @ copies).astype(np.int64)
    root = np.full(len(sid), -1)
    for start in np.argsort(sid):
        if root[start] < 0 and links[start]:
            root[start], edge = start, np.array([start])
            while len(edge):
                edge = np.flatnonzero(linked[edge].any(axis=0) & (root < 0))
                root[edge] = start
    at = np.flatnonzero(links)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(sid[at]), pa.array(sid[root[at]]), pa.array(links[at])], ["sid", "root", "links"])


def linked_documents(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: one row for each row of docs."""
    found = stash(jaccard_join(docs, k, percent))
    least = stash(found.groupBy("class_id").agg(F.min(doc_id_of("did")).alias("least"), F.count("*").alias("size")))
    return join_unique(found, least, "class_id", "size").select(
        doc_id_of("did").alias("doc_id"), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(doc_id_of("did")).alias("component_id"), "n_links"
    )


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are the first (by doc_id, null first) of their class; equal rows leave one."""
    found = stash(jaccard_join(docs, k, percent).select("did", "th", "n_shingles", "class_id"))
    best = stash(found.groupBy("class_id").agg(F.min(F.struct("did", "th")).alias("best"), F.count("*").alias("size")))
    placed = join_unique(found, best, "class_id", "size").withColumn("__stays", (F.col("n_shingles") == 0) | (F.struct("did", "th") == F.col("best")))
    once = placed.groupBy("did", "th").agg(F.count("*").alias("n"), F.bool_and("__stays").alias("__stays"))
    # Only texts that may have to go are shuffled: those of documents that do not stay, or that stand more than once.
    doubtful = stash(once.where("n > 1 OR NOT __stays"))
    key = {"__did": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__th": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))}
    rows = docs.withColumns(key).withColumn("__k", F.xxhash64("__did", "__th"))
    sure, maybe = sketch.parted(rows, doubtful.select(F.xxhash64("did", "th").alias("__k")))
    judged = maybe.join(doubtful.select(F.col("did").alias("__did"), F.col("th").alias("__th"), "__stays"), ["__did", "__th"], "left")
    kept = judged.where(F.coalesce("__stays", F.lit(True))).dropDuplicates(["__did", "__th"])
    return sure.select(docs.columns).union(kept.select(docs.columns))
