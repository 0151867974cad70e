import random
import zlib

import numpy as np
import pytest

from tidemark.llm.packing import ChunkEncoder, Packing, combinations, nnls, pack, plan

P = pytest.importorskip("public_tokenizers")


def encode(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def corpus(seed, n=120):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        words = [rnd.choice(["the", "Straße", "don't", "año", "x" * 40, "日本語", "…", "12345", "<|endoftext|>", "a.b,c"]) for _ in range(rnd.choice([0, 1, 9, 200, 700, 2500]))]
        out.append((i, "".join(w + rnd.choice([" ", "  ", "\n", "\n\n ", "\t", "　", "\x1c", "\xa0"]) for w in words)))
    return out + [(None, None), (5000, ""), (7, out[7][1]), (7, out[7][1])]


def test_ids_are_the_tokenizers():
    texts = [t or "" for _, t in corpus(1)]
    encoder = ChunkEncoder(None)
    assert [encoder.ids(t) for t in texts] == encode(texts)


def test_pieces_and_sequences(spark):
    rows = corpus(2)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, bin int").repartition(3)
    got = pack(df).collect()
    ids = {}
    for (doc_id, _), found in zip(rows, encode([t or "" for _, t in rows]), strict=True):
        ids.setdefault(doc_id, np.array([*found, 1], dtype="<u4"))
    copies = {i: sum(x == i for x, _ in rows) for i, _ in rows}
    covered = dict.fromkeys(ids, 0)
    sequences = {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered == {i: len(x) * copies[i] for i, x in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert total / (2048 * len(sequences)) > 0.9


def test_plan_uses_each_piece_once_and_fills_windows():
    rnd = np.random.default_rng(1)
    rule = Packing()
    histogram = {int(b): int(n) for b, n in zip(range(1, 257), rnd.integers(0, 3000, 256), strict=True) if n}
    used, sequences = dict.fromkeys(histogram, 0), 0
    for bins, n in plan(histogram, rule):
        assert sum(bins) <= 256
        sequences += n
        for b in bins:
            used[b] += n
    assert used == histogram
    assert sum(b * n for b, n in histogram.items()) / (256 * sequences) > 0.95


def test_combinations_and_nnls():
    assert combinations(5, 2).tolist() == [[3, 2], [4, 1], [5, 0]]
    rnd = np.random.default_rng(2)
    a = rnd.random((30, 20))
    x = np.maximum(0, rnd.normal(size=20))
    assert np.allclose(nnls(a, a @ x), x, atol=1e-5)
    found = nnls(a, rnd.normal(size=30))
    assert (found >= 0).all()


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_queries_give_added_tokens_their_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    from tidemark.llm.queries import QUERIES

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n\ny", "<|endoftext|", *(t or "" for _, t in corpus(3, 30))]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    wanted = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert wanted[0] == [64, 220, 50256, 275]
    encoder = ChunkEncoder(None, added=True)
    assert [encoder.ids(x) for x in texts] == wanted
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.start): (r.length, r.ids_crc32, r.doc_tokens) for r in QUERIES["op8_packing"](spark, str(tmp_path)).collect()}
    whole = [np.array([*ids, 1], dtype="<u4") for ids in wanted]
    assert got == {(i, s): (len(x[s : s + 2048]), zlib.crc32(x[s : s + 2048].tobytes()), len(x)) for i, x in enumerate(whole) for s in range(0, len(x), 2048)}
