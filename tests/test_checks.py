import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import checks as K
from tidemark.functions import numbers as N
from tidemark.functions import text as T
from tidemark.operators import cues as C
from tidemark.operators import history as H
from tidemark.operators import incidents as I
from tidemark.operators import status as S
from tidemark.operators import terms as M


def one(spark, *columns):
    return spark.range(1).select(*columns).first()[:]


def test_checks(spark):
    lit = F.lit
    assert one(spark, K.strip_markers(lit("⟦c1⟧ a ⟦/b⟧b")), K.corrupt_markers(lit("⟦c1⟧ ⟦x y")), K.corrupt_markers(lit("⟦c1⟧ ok"))) == ("a b", True, False)
    assert one(spark, K.normalise_markers(lit("⟦ c1 ⟧x")), K.marker_leak(lit("a (b)"), lit("a b")), K.marker_leak(lit("(a)"), lit("[b]"))) == ("⟦c1⟧x", True, False)
    assert one(spark, K.unbalanced_brackets(lit("(a [b])")), K.unbalanced_brackets(lit("(a [b)]"))) == (False, True)
    assert one(spark, K.untranslated(lit("да нет вот это"), "Cyrillic"), K.untranslated(lit("yes да"), "Cyrillic")) == (True, False)
    assert one(spark, K.full_width(lit("你好, 吗?")), K.half_width(lit("你好，")), K.drop_terminators(lit("好。\n等...\nx."))) == ("你好，吗？", "你好,", "好\n等...\nx")
    assert one(spark, K.balance_quotes(lit("“a"), lit("“b”")), K.balance_quotes(lit("“a”"), lit("b")), K.quote_open(lit('say "x'))) == ("“a”", "a", True)
    assert one(spark, K.edge_flags(lit("- he said,"))) == (2 + 8 + 16,)
    assert one(spark, K.format_tags(K.format_tokens(lit("<b> x </b>"))), K.traditional_votes(lit("這來说"))) == ("<b>x</b>", 1)
    assert one(spark, K.retry_delay(lit(0)), K.retry_delay(lit(3)), K.retry_delay(lit(99)), K.rate_units(lit(2500), 1000)) == (5000, 40000, 60000, 3)
    assert one(spark, K.version_in_range(lit("1.2.10"), "1.2.9", "2"), K.version_in_range(lit("2.0"), "1", "2"), K.two_decimals(lit(2.675))) == (True, False, 2.67)
    assert one(spark, K.presentable(lit("guten Tag"), lit("добрый день"), "Cyrillic"), K.presentable(lit("добрый день мой друг"), lit("добрый день"), "Cyrillic")) == (True, False)


def test_status_values(spark):
    rows = [("j", "job", 90), ("a", "error_1001", 5), ("b", "error_1004", 10), ("c", "error_3001", 5)]
    m = spark.createDataFrame([(0, metric, n) for _, metric, n in rows], "bucket_minute long, metric string, count long").withColumn("all", F.lit(1))
    r = S.served_and_failed(m, ["all"]).first()
    assert (r.served, r.failures, r.availability) == (100, 5, 95.0)
    low, high, ok, bad = one(spark, S.wilson_lower_bound(F.lit(5), F.lit(100)), S.wilson_lower_bound(F.lit(5), F.lit(5)), S.failure_status(F.lit(5), F.lit(100)), S.failure_status(F.lit(5), F.lit(5)))
    assert abs(low - 0.0215) < 1e-4 and abs(high - 0.5655) < 1e-4 and (ok, bad) == ("operational", "major_outage")


def test_incident_intervals(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    incidents = spark.createDataFrame([("a", at(0), "investigating", None), ("b", at(0), "resolved", at(9))], "incident_id string, created_at timestamp, status string, resolved_at timestamp")
    updates = spark.createDataFrame([("a", at(2), "resolved"), ("a", at(3), "resolved"), ("a", at(5), "investigating"), ("a", at(6), "monitoring")], "incident_id string, ts timestamp, status string")
    got = sorted((r.incident_id, r.opened_at, r.closed_at) for r in S.incident_intervals(incidents, updates, F.lit("2024-01-02").cast("timestamp")).collect())
    assert got == [("a", at(0), at(2)), ("a", at(5), at(24)), ("b", at(0), at(9))]


def test_downtime_is_a_union(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [("x", at(1), at(3)), ("x", at(2), at(4)), ("x", at(22), at(26))]
    got = S.downtime_by_day(spark.createDataFrame(rows, "k string, a timestamp, b timestamp"), ["k"], "a", "b", F.lit("2024-01-02 04:00:00").cast("timestamp")).orderBy("day").collect()
    assert [(r.down_ms, round(r.ratio, 6)) for r in got] == [(5 * 3_600_000, round(5 / 24, 6)), (2 * 3_600_000, 0.5)]


def test_incidents(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    open_ = spark.createDataFrame([("i1", ["u1"], ["api"], None), ("i2", [], ["web"], at(0)), ("i3", [], ["db"], at(-500))], "incident_id string, upstream_ids array<string>, component_ids array<string>, settled_at timestamp")
    signals = spark.createDataFrame([(1, "u1", "zzz", at(10)), (2, None, "api", at(10)), (3, None, "web", at(10)), (4, None, "db", at(10))], "signal_id int, upstream_id string, component_id string, ts timestamp")
    assert sorted((r.signal_id, r.incident_id) for r in I.best_match(signals, open_).collect()) == [(1, "i1"), (2, "i1"), (3, "i2")]
    assert sorted(r.status for r in I.backfilled(spark.createDataFrame([("i", "monitoring")], "incident_id string, status string")).collect()) == ["identified", "investigating", "monitoring"]
    ids = spark.createDataFrame([("u1",)], "id string")
    got = {r.incident_id: (r.remaining, r.all_silenced) for r in I.silenced(open_, ids).collect()}
    assert got == {"i1": ([], True), "i2": ([], False), "i3": ([], False)}
    assert one(spark, I.probe_state(I.probe_error(F.lit(503))), I.probe_error(F.lit(429)), I.probe_state(I.probe_error(F.lit(204)))) == ("major_outage", "rate_limited", "operational")


def test_terms(spark):
    docs = spark.createDataFrame([("d", "New York City is New York, not Old York.")], "doc_id string, text string")
    keys = spark.createDataFrame([("new york",), ("New York City",), ("york",)], "key string")
    assert sorted((r.at, r.words, r.key) for r in M.longest_matches(docs, keys).collect()) == [(0, 3, "new york city"), (4, 2, "new york"), (8, 1, "york")]
    assert M.replace_terms(docs, {"York": "$Y", "New York": "NY"}).first().text == "NY City is NY, not Old $Y."
    pairs = M.containing_pairs(spark.createDataFrame([("York",), ("New York",), ("Yorkshire",)], "term string"))
    assert [(r.inner, r.outer) for r in pairs.collect()] == [("York", "New York")]
    runs = spark.createDataFrame([("d", 0, "PER", 0.5), ("d", 1, "PER", 1.0), ("d", 2, "O", 1.0), ("d", 3, "PER", 0.8)], "doc_id string, at int, label string, prob double")
    assert sorted((r.first, r.last, r.score) for r in M.label_runs(runs).collect()) == [(0, 1, 0.75), (3, 3, 0.8)]
    assert [r.hash for r in M.text_hash(spark.createDataFrame([("a",), ("",)], "text string")).collect()] == ["ab0mvm", "46bd25"]
    assert one(spark, M.units_hash(F.array(F.lit("a"), F.lit("b")))) == ("xw31f2",)
    assert one(spark, M.units_hash(F.array().cast("array<string>"))) == ("ztntfp",)  # of nothing: the first value


def test_packs(spark):
    rows = [("d", i, i // 3, c) for i, c in enumerate([5, 5, 5, 9, 1, 1, 30, 1])]
    items = spark.createDataFrame(rows, "doc_id string, pos int, chapter int, cost int")
    got = [(r.batch, r.oversized) for r in C.chapter_pack(items, 16).orderBy("pos").collect()]
    assert got == [(0, False), (0, False), (0, False), (1, False), (1, False), (1, False), (2, True), (3, False)]
    bins = C.greedy_pack(items, "cost", 12, 2).orderBy("pos").collect()
    assert [r.bin for r in bins] == [0, 0, 1, 2, 2, 3, 4, 5]
    spread = C.spread_sample(items, 3).orderBy("pos").collect()
    assert len(spread) == 3 and spread[0].pos == 0


def test_values_of_the_surveyed_rules(spark):
    """Expected values were worked out by hand from the rules that the survey cites."""
    shown = [0, -3, 999, 1000, 1049, 1050, 1150, 1250, 9949, 9950, 9960, 12_499, 12_500, 999_499, 999_500, 1_000_000, 3_450_000, 12_500_000, 2_000_000_000]
    found = spark.createDataFrame([(n,) for n in shown], "n long").select(T.compact_number(F.col("n"))).collect()
    assert [r[0] for r in found] == ["0", "0", "999", "1k", "1k", "1.1k", "1.1k", "1.3k", "9.9k", "9.9k", "10k", "12k", "13k", "999k", "1000k", "1M", "3.5M", "13M", "2000M"]
    states = [(None, False), (None, True), (0, False), (204, False), (302, False), (429, False), (401, False), (403, False), (404, False), (503, False)]
    found = spark.createDataFrame(states, "s int, a boolean").select(I.probe_error(F.col("s"), F.col("a"))).collect()
    assert [r[0] for r in found] == ["network_error", "timeout", "network_error", "ok", "ok", "rate_limited", "auth_error", "auth_error", "http_error", "http_error"]
    use = [(1, 1, 1, 1, False), (121, 0, 121, 0, False), (121, 0, 121, 0, True), (1, 24_000_001, 1, 24_000_001, False), (301, 0, 301, 0, True), (1, 1, 1501, 0, True), (1, 1, 1500, 0, True), (1, 1, 1, 300_000_001, True)]
    decision = S.quota_decision((F.col("h"), F.col("hc")), (F.col("d"), F.col("dc")), F.col("cleared"))
    found = spark.createDataFrame(use, "h long, hc long, d long, dc long, cleared boolean").select(decision).collect()
    assert [r[0] for r in found] == ["ok", "verify", "ok", "verify", "block", "block", "ok", "block"]
    assert one(spark, *(K.rate_units(F.lit(n), 1000) for n in (0, 1, 1000, 1001, 19_999, 50_000))) == (1, 1, 1, 2, 20, 20)
    version = lambda v, e: K.version_matches(F.lit(v), e)
    assert one(spark, version("1.2.0-beta.2", "<1.2.0"), version("1.2.0-beta.10", ">1.2.0-beta.9"), version("1.2", "=1.2.0"), version("2.0.1", ">=1.5, <=2"), version("oops", "<0.1"), version("1.0+build", "1.0")) == (True, True, True, False, True, True)
    assert one(spark, T.weighted_length(F.lit("?!…")), T.weighted_length(F.lit("a7é"))) == (3.0, 4.0)
    profile = lambda x: F.struct(K.bracket_profile(F.lit(x)))
    assert [tuple(r[0]) for r in one(spark, profile("a"), profile("(《b》)"), profile(")("), profile("[["))] == [(0, False), (4, False), (2, True), (2, True)]


def test_bloom_filter(spark):
    known = spark.createDataFrame([("one",), ("two",), ("",), ("\U0001f600",)], "text string")
    rows = spark.createDataFrame([("one",), ("\U0001f600",), ("",), ("four",), ("five",)], "text string")
    assert sorted(r.text for r in M.bloom_semi_join(rows, known).collect()) == sorted(["one", "\U0001f600", ""])

    def bits(text):
        h1, h2 = 0x811C9DC5, 0x9E3779B9
        data = text.encode("utf-16-le")
        for i in range(0, len(data), 2):
            unit = data[i] | data[i + 1] << 8
            h1, h2 = ((h1 ^ unit) * 0x01000193) & 0xFFFFFFFF, ((h2 ^ unit) * 0x85EBCA6B) & 0xFFFFFFFF
        return [(h1 + i * h2) & 0xFFFF for i in range(3)]

    for text in ("", "one", "été", "\U0001f600 x" * 40):
        assert one(spark, M.bloom_bits(F.lit(text))) == (bits(text),)


def test_numbers(spark):
    lit = F.lit
    assert one(spark, *(N.round_half_even(lit(x)) for x in (0.5, 1.5, 2.5, -0.5, -1.5, 2.6, -2.4))) == (0, 2, 2, 0, -2, 3, -2)
    spans = F.array(F.struct(lit(100).alias("start"), lit(200).alias("end")), F.struct(lit(0).alias("start"), lit(90).alias("end")))
    assert one(spark, N.free_start(lit(10), spans, 50, 5), N.free_start(lit(300), spans, 50, 5)) == (205, 300)
    assert one(spark, N.truncate_words(lit("abc def"), 5), N.truncate_words(lit("abcdef"), 5), N.truncate_words(lit("abc, d"), 4)) == ("abc", "abcde", "abc,")
    assert one(spark, N.attach_dangling(lit("<i>\na\n</i>")), N.join_open_brackets(F.array(lit("(a"), lit("b)"), lit("c")))) == ("<i>a</i>", ["(a b)", "c"])
    assert one(spark, N.contains_all(F.array(lit(1), lit(2)), F.array(lit(2))), N.contains_all(F.array(lit(1)), F.array().cast("array<int>"))) == (True, False)


def test_stored_jobs(spark):
    tokens = spark.createDataFrame([("d", 0, 0, 3), ("d", 1, 4, 9), ("e", 0, 0, 3)], "doc_id string, at int, start int, end int")
    spans = spark.createDataFrame([("d", "PER", 5, 7)], "doc_id string, label string, start int, end int")
    assert [tuple(r) for r in H.covered_tokens(tokens, spans).collect()] == [("d", 1, "PER")]
    assert one(spark, H.escalation_days(F.lit(0), 1, 30), H.escalation_days(F.lit(8), 1, 30), H.escalation_days(F.lit(20), 1, 30)) == (1, 16, 30)


def test_daily_budget_counts_across_minutes(spark):
    rows = [(i, f"2024-01-0{1 + i // 6} 00:0{i % 6 // 2}:0{i % 2}") for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r.event_id, r.used, r.admitted) for r in S.daily_budget(df, 4).collect())
    assert got == [(i, i % 6, i % 6 < 4) for i in range(12)]
