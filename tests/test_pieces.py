"""Pieces and words of texts against all ways to cut, a public library, and values worked out by hand."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import edges as E
from tidemark.functions import lexical
from tidemark.operators import pieces as P


def ways(text):
    for marks in itertools.product([0, 1], repeat=max(len(text) - 1, 0)):
        cuts = [0, *[i + 1 for i, m in enumerate(marks) if m], len(text)]
        yield list(zip(cuts, cuts[1:], strict=False)) if text else []


def test_best_path_against_all_ways():
    rng = random.Random(3)
    for _ in range(300):
        scores = {"".join(rng.choices("abc", k=rng.randint(1, 4))): -rng.randint(1, 9) for _ in range(12)}
        text, longest = "".join(rng.choices("abcd", k=rng.randint(0, 8))), rng.randint(1, 4)
        fits = [w for w in ways(text) if all(b - a == 1 or b - a <= longest and text[a:b] in scores for a, b in w)]
        value = lambda w: sum(scores.get(text[a:b], -19) for a, b in w)
        path = P.best_path(text, scores, longest, -19)
        assert path in fits and value(path) == max(map(value, fits))
    assert P.best_path("abc", {"a": 0, "b": 0, "c": 0, "bc": 0, "ab": 0}, 3, -1) == [(0, 1), (1, 3)]  # of equal ones the longer last piece


def test_words_of_wordpiece_as_the_library_cuts_them():
    from tokenizers.models import WordPiece

    rng = random.Random(5)
    vocab = {p: i for i, p in enumerate(["[UNK]", "[CLS]", "[SEP]", *"abcd", "##a", "##b", "##c", "ab", "##bc", "abca", "##cab"])}
    model = WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=100)
    for word in ["".join(rng.choices("abcd", k=rng.randint(1, 9))) for _ in range(300)] + ["a" * 100, "a" * 101]:
        assert P.cut_word(word, vocab, 0, 5) == [t.id for t in model.tokenize(word)]


def test_wordpiece_texts(spark, tmp_path):
    lines = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "he", "##llo", ",", "京", "x", "", "he"]
    (tmp_path / "vocab.txt").write_bytes("\r\n".join(lines).encode())
    table = P.wordpiece_file(spark, str(tmp_path / "vocab.txt"))
    texts = ["hello, 京x", "x​x\u0000x", "😀x  hello　he", "", None, "zz" * 60, " \n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.w for r in df.select("i", P.word_pieces(spark, table)(F.col("t")).alias("w")).collect()}
    plain = lambda w: [(x["start"], x["end"], list(x["pieces"])) for x in w]
    assert plain(got[0]) == [(0, 5, [10, 5]), (5, 6, [6]), (7, 8, [7]), (8, 9, [8])]  # the greater id of a piece that comes twice
    assert plain(got[1]) == [(0, 1, [8]), (2, 3, [8]), (4, 5, [8])]
    assert plain(got[2]) == [(0, 3, [1]), (5, 10, [10, 5]), (11, 13, [10])]  # a character beyond the plane has two units
    assert got[3] == [] and got[4] is None and got[6] == []
    assert plain(got[5]) == [(0, 120, [1])]
    with pytest.raises(ValueError, match="SEP"):
        P.word_pieces(spark, table.where("piece <> '[SEP]'"))


def unigram_slowly(text, table, unknown):
    """The rule over a whole text at once, by all ways to cut."""
    import unicodedata

    chars, pending = [], False
    for n, c in enumerate(text):
        f = unicodedata.normalize("NFKC", c)
        if f in " \n\t":
            pending = True
        elif unicodedata.category(c) not in ("Cc", "Cf"):
            if pending and chars:
                chars.append(("▁", n, n))
            pending = False
            chars += [(x, n, n + 1) for x in f]
    if not chars:
        return []
    plain = "▁" + "".join(c for c, _, _ in chars)
    worst = min(0, *(s for _, s in table.values())) - 10
    fits = [w for w in ways(plain) if all(b - a == 1 or plain[a:b] in table for a, b in w)]
    value = lambda w: sum(table[plain[a:b]][1] if plain[a:b] in table else worst for a, b in w)
    best = max(fits, key=lambda w: (value(w), [-a for a, _ in reversed(w)]))
    joined = []
    for a, b in best:
        i = table[plain[a:b]][0] if plain[a:b] in table else unknown
        if joined and i == unknown == joined[-1][2]:
            joined[-1][1] = b
        else:
            joined.append([a, b, i])
    return [(chars[max(a, 1) - 1][1], chars[b - 2][2], [i]) for a, b, i in joined if b >= 2]


@pytest.mark.parametrize("extra", [[], ["b▁a"]])
def test_unigram_texts(spark, tmp_path, extra):
    rng = random.Random(11)
    names = ["<s>", "</s>", "<pad>", "<unk>", "▁a", "▁", "a", "b", "ab", "▁ab", "ba", "fi", "▁ba", *extra]
    vocab = [[p, -float(2 ** (i % 5)) if i > 3 else 0.0] for i, p in enumerate(names)]
    (tmp_path / "u.json").write_text(json.dumps({"model": {"type": "Unigram", "unk_id": 3, "vocab": vocab}}))
    table, unknown = P.unigram_file(spark, str(tmp_path / "u.json"))
    assert unknown == 3
    texts = ["".join(rng.choices("aabb cﬁ\n​", k=rng.randint(1, 9))) for _ in range(120)] + ["cc cc", " a", "a ", "​"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None])], "i int, t string")
    got = {r.i: r.w for r in df.select("i", P.unigram_pieces(spark, table, unknown)(F.col("t")).alias("w")).collect()}
    for i, text in enumerate(texts):
        want = unigram_slowly(text, {p: (n, s) for n, (p, s) in enumerate(vocab)}, 3)
        assert [(x["start"], x["end"], list(x["pieces"])) for x in got[i]] == want, text
    assert got[len(texts)] == [] and got[len(texts) + 1] is None
    with pytest.raises(ValueError, match="unigram"):
        (tmp_path / "w.json").write_text(json.dumps({"model": {"type": "BPE"}}))
        P.unigram_file(spark, str(tmp_path / "w.json"))


def test_tokens_are_the_text(spark):
    counts = spark.createDataFrame([("東京", 9), ("京都", 5), ("都", 3), ("東", 2), ("に", 8), ("住む", 4), ("", 7), (None, 1)], "word string, count long")
    cut = P.word_tokens(spark, P.lexicon(counts))
    texts = ["東京都に住む", "京都東", "I'm in 東京,ok  \r\n\n3.5", "漢字", "", None, "😀" * 3, "x" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.w for r in df.select("i", cut(F.col("t")).alias("w")).collect()}
    parts = {i: None if w is None else [x["text"] for x in w] for i, w in got.items()}
    assert parts[0] == ["東京", "都", "に", "住む"] and parts[1] == ["京都", "東"]
    assert parts[2] == ["I'm", " ", "in", " ", "東京", ",", "ok", "  ", "\r\n", "\n", "3.5"]
    assert [x["is_word"] for x in got[2]] == [True, False, True, False, True, False, True, False, False, False, True]
    assert parts[3] == ["漢", "字"] and parts[4] == [] and parts[5] is None
    assert all("".join(parts[i]) == t for i, t in enumerate(texts) if t is not None)


CASES = [
    (lexical.JAPANESE, "私は", "行く", 100, True),  # a particle that may not end a cue
    (lexical.JAPANESE, "こんにちは", "元気", 100, False),  # complete all the same
    (lexical.JAPANESE, "私は", "はい", 100, False),  # a sentence begins
    (lexical.JAPANESE, "私は", "（笑）", 100, False),  # a turn begins
    (lexical.JAPANESE, "私は", "行く", 1501, False),  # too far
    (lexical.JAPANESE, "私は。", "行く", 100, False),  # a full stop
    (lexical.JAPANESE, "私は」", "行く", 100, False),  # closed
    (lexical.JAPANESE, "行く、", "そこ", 100, True),  # a comma
    (lexical.JAPANESE, "行く", "ので帰る", 100, True),  # bound to what is before
    (lexical.JAPANESE, "行くために", "帰る", 100, True),  # a phrase
    (lexical.JAPANESE, "行く", "帰る", 0, False),
    (lexical.SIMPLIFIED, "我在", "家", 100, True),
    (lexical.SIMPLIFIED, "我走", "但是他", 100, True),
    (lexical.SIMPLIFIED, "现在", "走", 100, False),  # the word ends so, not a particle
    (lexical.SIMPLIFIED, "走", "<i> 了吗", 100, True),
    (lexical.SIMPLIFIED, "我在 ♪", "谢谢", 100, False),
    (lexical.CANTONESE, "佢喺", "屋企", 100, True),
    (lexical.TRADITIONAL, None, None, 100, False),
    (lexical.TRADITIONAL, "家", "家", None, None),
]


def test_sentences_that_go_on_by_words(spark):
    words = [(w, 5) for x in (lexical.JAPANESE, lexical.SIMPLIFIED, lexical.TRADITIONAL, lexical.CANTONESE) for w in (*x.no_start, *x.no_end, *x.complete)]
    counts = spark.createDataFrame([*words, ("现在", 9), ("行く", 9), ("私", 9), ("帰る", 9), ("我", 9)], "word string, count long").dropDuplicates(["word"])
    cut = P.word_tokens(spark, P.lexicon(counts))
    for words in {id(c[0]): c[0] for c in CASES}.values():
        cases = [(i, *c[1:]) for i, c in enumerate(CASES) if c[0] is words]
        df = spark.createDataFrame(cases, "i int, a string, b string, gap long, want boolean")
        got = df.withColumn("got", lexical.goes_on(F.col("a"), E.tail_flags(F.col("a")), F.col("b"), F.col("gap"), words, cut)).collect()
        assert [(r.i, r.a, r.b, r.got) for r in got] == [(r.i, r.a, r.b, r.want) for r in got]
