import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import bestfit
from tidemark.llm.bestfit import BestFit, Sizes, WordEncoder, assign, pack, sweep
from tidemark.llm.session import stash

P = pytest.importorskip("public_tokenizers")
SIGNS = "aaabbee'strdlmvLS '’“—  .,!?12½²éÉßŒñİΣσςŤ́ẞȺ中あ́\t\n\x1c\x85\xa0　_-~\x00\x7f"


def encode(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [np.array(e.ids, dtype="<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


def texts(n, seed=1):
    rnd = random.Random(seed)
    parts = [*SIGNS, "<|endoftext|>", "<|startoftext|>", "<|", "don't", "'tis", "OF THE", "a" * 50, "=" * 41, "naïveté"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.choice([0, 1, 5, 40]))) for _ in range(n)]


def test_ids_are_the_tokenizers(monkeypatch):
    given = texts(3000)
    wanted = [x.tobytes() for x in encode(given)]
    assert WordEncoder().ids(given) == wanted
    monkeypatch.setattr(bestfit, "REMEMBERED", 20)  # forgets all the time
    encoder = WordEncoder()
    assert [x for i in range(0, 3000, 50) for x in encoder.ids(given[i : i + 50])] == wanted
    assert all(len(run) <= bestfit.LONGEST for run in encoder)


def test_runs_of_one_character():
    encoder = WordEncoder()
    given = [chr(c) * n for c in range(33, 0x180) for n in (1, 2, 3, 7, 64, 130)]
    assert encoder.ids(given) == [x.tobytes() for x in encode(given)]


def check(rows, whole, window):
    """Each id of each row is in one piece, sequences have no gaps, and only long rows are cut."""
    wanted = Counter()
    for doc_id, ids in whole:
        for k, at in enumerate(range(0, len(ids), window)):
            part = ids[at : at + window]
            wanted[doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return len(sequences)


def best_fit(lengths, window):
    """Sequences that best fit takes, the longest first, one by one."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(window - n)
    return len(gaps)


def test_pack_awkward_rows(spark):
    """Nulls, empty and very long texts, repeated rows, clashing columns."""
    given = [(None, None), (5, ""), (7, "x y z"), (7, "x y z"), (7, "x y z"), (8, "long " * 30_000), (9, None), (None, "a"), (10, " ".join(["word"] * 4095)), (11, " ".join(["word"] * 4096))]
    given += [(100 + i, t) for i, t in enumerate(texts(60, 4))]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in given], "doc_id long, text string, length int, sequence_id int, kind int").repartition(3)
    rows = pack(df).collect()
    assert [f.dataType.simpleString() for f in pack(df.limit(0)).schema] == ["bigint", "int", "bigint", "bigint", "bigint", "bigint", "bigint"]
    ids = [(i, np.array([*x, 1], dtype="<u4")) for (i, _), x in zip(given, encode([t or "" for _, t in given]), strict=True)]
    sequences = check(rows, ids, 4096)
    assert sequences <= best_fit([len(x[a : a + 4096]) for _, x in ids for a in range(0, len(x), 4096)], 4096) + 1
    assert pack(df.limit(0)).count() == 0


def frame(spark, lengths):
    rows = [(i, 0, 0, n, i) for i, n in enumerate(lengths)]
    return stash(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(5))


@pytest.mark.parametrize("kind", ["even", "small", "large", "thirds", "one", "pairs", "odd"])
def test_assign_is_nearly_as_good_as_best_fit_one_by_one(spark, kind):
    rnd = random.Random(3)
    window = 256
    lengths = {
        "even": [rnd.randint(1, window) for _ in range(900)],
        "small": [rnd.choice([1, 1, 2, 3]) for _ in range(3000)] + [250] * 20,
        "large": [rnd.randint(120, window) for _ in range(400)],
        "thirds": [85] * 500 + [86] * 300,
        "one": [40] * 1500,
        "pairs": [n for _ in range(300) for n in (lambda x: (x, window - x))(rnd.randint(1, window - 1))],
        "odd": [129] * 100 + [64] * 90 + [63] * 90 + [1] * 5,
    }[kind]
    rows = assign(frame(spark, lengths), BestFit(window=window)).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= window
    assert len(used) <= 1.03 * best_fit(lengths, window) + 1


def test_sweep_matches_brackets(spark, monkeypatch):
    """Each slot takes the longest piece before it that no shorter slot has taken; hot sizes are salted."""
    monkeypatch.setattr(bestfit, "GROUP_ROWS", 7)
    rnd = random.Random(5)
    for trial in range(4):
        lengths = [rnd.choice([3, 10, 10, 10, 20, 31, 50]) for _ in range(120)]
        sizes = [rnd.choice([2, 9, 10, 25, 31, 49, 50, 55, 99]) for _ in range(80 + 40 * trial)]
        left = frame(spark, lengths)
        gaps = spark.createDataFrame(list(enumerate(sizes)), "sequence_id long, gap long").repartition(3)
        rows = sweep(left, gaps, Sizes.of(left, gaps)).collect()
        got = Counter((r.length, sizes[r.mate]) for r in rows if r.kind == 0 and r.mate is not None)
        assert Counter((r.mate, r.size) for r in rows if r.kind == 1 and r.mate is not None) == got
        assert len({r.mate for r in rows if r.kind == 0 and r.mate is not None}) == sum(got.values())
        stack, wanted = [], Counter()
        for size, kind in sorted([(n, 0) for n in lengths] + [(g, 1) for g in sizes]):
            if kind == 0:
                stack.append(size)
            elif stack:
                wanted[stack.pop(), size] += 1
        assert got == wanted
