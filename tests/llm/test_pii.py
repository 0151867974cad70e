import hashlib
import random
import re

from tidemark.llm.pii import KINDS, Scoring, digest, emails, find, find_base, luhn, mask, mask_documents, mod97


def plain_base(text):
    found = [(*m.span(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(*m.span(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((*m.span(), 2))
    found += [(*m.span(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def test_base_against_plain_patterns():
    rnd = random.Random(1)
    pieces = ["a", "b.c", "@", "é", " ", "-", ".", "+", "%", "7", "255", "256", "0001", "4804645368948982", "4804 6453-6894 8982", "+1 (516) 555-2642", "x@y.z", "(", "\n", "1.2.3.4", "٣"]
    for _ in range(4000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(12)))
        assert find_base(text) == plain_base(text), text


def test_checksums():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("GB82WEST12345698765432") and not mod97("GB82WEST12345698765433")


def test_context_moves_the_score():
    assert [KINDS[k] for *_, k, _ in find("my iban is GB82 WEST 1234 5698 7654 32 at the bank", Scoring())] == ["iban"]
    assert find("number 078-05-1120 here", Scoring()) == []
    assert [KINDS[k] for *_, k, _ in find("social security 078-05-1120 here", Scoring())] == ["ssn"]


def test_linear_on_long_runs():
    for text in ("9" * 300_000, "a" * 300_000, "a@" * 100_000, "+1" + " " * 300_000, "1." * 200_000, "a." * 100_000 + "@"):
        find(text, Scoring())
    assert list(emails("a" * 100_000 + "@b.c")) == [(0, 100_004)]


def test_digest(spark):
    rows = [(2**60 + 1, "mail a.b@c.de or 1.2.3.4"), (None, None), (3, ""), (3, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in digest(df).collect()}
    assert len(got) == 3
    r = got[2**60 + 1]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) == (1, 1, 0, 0, "email:5:13,ip:17:24")
    assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert got[None].base_sha256 == hashlib.sha256(b"").hexdigest() and got[None].spans == ""
    assert digest(df.limit(0)).count() == 0


def test_mask(spark):
    df = spark.createDataFrame([(1, "to a.b@c.de, 1.2.3.4!", 21), (2, None, None)], "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, mask_documents(df).collect())) == [(1, "to <email>, <ip>!", 17), (2, None, None)]


def test_secrets_of_any_length_are_masked_whole():
    scoring = Scoring()
    for value in ("a1B2c3D4e5" * 40, "9f8e7d6c5b4a39281706" * 500):
        assert mask(f"password={value} end", scoring) == "password=<secret> end"
    for token in ("ghp_" + "aB3" * 120, "github_pat_" + "x_Y1" * 200, "xoxb-" + "1-a" * 400, "sk_live_" + "Z9" * 300, ".".join(["eyJ" + "a-_B" * 1000] * 2 + ["c" * 5000])):
        assert mask(f"so {token}, then", scoring) == "so <secret>, then"
    assert find("ghp_" + "aB3" * 20 + "_", scoring) == [] and find("xoxb-" + "1-a" * 20 + "_", scoring) == [] and find("eyJ" + "a" * 20 + ".eyJabc.def", scoring) == []
    assert mask("x.y.eyJaaaaaaaaaa.eyJbbbbbbbbbb.cccccccccc.d", scoring) == "x.y.<secret>.d"


def test_many_spans_and_long_runs_take_linear_time():
    import time

    scoring = Scoring()

    def seconds(text):
        began = time.process_time()
        found = find(text, scoring)
        return time.process_time() - began, len(found)

    kinds = ["token=a1b2c3d4e5f6 ", "DE89370400440532013000 iban a.b@c.de ", "password: q9w8e7r6t5 call +1 202 555 0100 "]
    for unit in kinds:
        (small, n), (large, m) = seconds(unit * 2500), seconds(unit * 20_000)
        assert m == 8 * n and large < 24 * small + 1
    for text in ("xoxb-" * 100_000 + "_", "eyJ-" * 100_000, "eyJa." * 100_000, "-----BEGIN PRIVATE KEY-----" * 20_000, "ghp_" * 100_000, "key=" * 100_000):
        assert seconds(text)[0] < 10


def test_overlaps_against_all_pairs():
    import random

    from tidemark.llm.pii import Overlaps

    rnd = random.Random(7)
    for _ in range(200):
        spans = sorted((a, a + rnd.randrange(1, 9)) for a in (rnd.randrange(40) for _ in range(rnd.randrange(6))))
        known = Overlaps(spans)
        for a in range(45):
            for b in range(a + 1, 46):
                assert known.any(a, b) == any(x < b and a < y for x, y in spans)
