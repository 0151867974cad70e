"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import clock
from tidemark.plans import containers, extracting, further, jobs  # noqa: F401

SMOKE = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: tuple(str(x) for x in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SMOKE).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SMOKE)
    found = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    got, wanted = rows(df.columns, df.collect()), rows(found.columns, found.fetchall())
    assert len(got) == len(wanted)
    assert got == wanted


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMOKE).count() > 0


def test_set_difference_users_covers_later_events(spark, tmp_path):
    rows = [(1, 1, "click"), (200, 2, "click"), (10**6, 3, "click"), (10**6 + 1, 3, "view"), (10**6 + 2, 4, "view"), (10**6 + 3, 3, "click")]
    found = [(i, u, kind, "2024-01-01 00:00:00") for i, u, kind in rows]
    spark.createDataFrame(found, "event_id long, user_id long, event_type string, ts string").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, catalog.QUERIES["set_difference_users"](spark, str(tmp_path)).collect()))
    assert got == [(1, "difference"), (2, "difference"), (3, "common")]


def test_semi_join_and_corroboration_cover_all_ids(spark, tmp_path):
    docs = [(1, "x", "a"), (3, "x", "b"), (5, "y", "a"), (7, "y", "a"), (8, "z", None), (9, None, "a")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r.n for r in catalog.QUERIES["semi_join_sources"](spark, str(tmp_path)).collect()] == [2]
    rows = [(1, 1, "error"), (5, 1, "error"), (7, 2, "click"), (11, 3, "error"), (13, 4, "signup")]
    found = [(i, u, kind, "2024-01-01 00:00:00") for i, u, kind in rows]
    spark.createDataFrame(found, "event_id long, user_id long, event_type string, ts string").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, catalog.QUERIES["corroborated_states"](spark, str(tmp_path)).collect()))
    assert got == [(1, "major_outage"), (2, "operational"), (3, "operational"), (4, "operational")]


@pytest.mark.parametrize("name", ["sliding_throughput", "throughput_steps"])
def test_events_within_half_a_millisecond_before_a_step(spark, tmp_path, name):
    c = duckdb.connect()
    at = [30_000_000 * i + j for i in (0, 1, 57_000_000) for j in (0, 1, 499, 500, 29_999_499, 29_999_500, 29_999_600, 29_999_999)]
    c.execute(f"CREATE TABLE events AS SELECT 'type' || t % 2 AS event_type, make_timestamp(t) AS ts, repeat('x', i::INTEGER) AS props FROM (SELECT unnest({at}) AS t, unnest(range({len(at)})) AS i) UNION ALL SELECT 'type0', NULL, 'x'")
    c.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    found = c.sql(catalog.ORACLE_SQL[name])
    kept = [r for r in found.fetchall() if r[found.columns.index("start")] is not None]
    assert rows(df.columns, df.collect()) == rows(found.columns, kept)


def test_whole_milliseconds_as_epoch_ms(spark):
    us = [0, 1, 499, 500, 501, 1499, 1500, -1, -499, -500, -501, -1500, -1501, 1_704_067_229_999_600, 32_503_680_000_000_500, -32_503_680_000_000_500]
    want = duckdb.sql(f"SELECT u, epoch_ms(make_timestamp(u)) FROM (SELECT unnest({us}::BIGINT[]) AS u) ORDER BY u").fetchall()
    found = spark.createDataFrame([(u,) for u in us], "u long").select("u", F.unix_micros(clock.to_whole_ms(F.timestamp_micros("u"))).alias("t"))
    assert sorted((r.u, r.t) for r in found.collect()) == [(u, ms * 1000) for u, ms in want]
