"""Anchored windows in blocks against one pass over each key."""

import random
import time
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from folium.plans.registry import ORACLE_SQL, QUERIES
from folium.streaming import quota


@pytest.mark.parametrize("block", [1, 5, 40, 1 << 18])
@pytest.mark.parametrize("spread", [50, 3000, 100_000])
def test_blocks_against_one_pass(spark, block, spread):
    rng = random.Random(block + spread)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.choice([None, *[rng.randrange(spread)] * 9])) for i in range(400)]
    said = {}
    for key in {k for k, _, _ in rows}:
        own = sorted((t, i) for k, i, t in rows if k == key and t is not None)
        said |= {i: ok for (_, i), ok in zip(own, quota.judge([t for t, _ in own], None, 0, 4, 1000)[0], strict=True)}
    df = spark.createDataFrame(rows, "key string, id long, ts_ms long").repartition(3)
    got = quota.quota_flags(df, 4, 1000, block_requests=block).collect()
    assert sorted((str(r.key), r.id, str(r.ts_ms), r.allowed) for r in got) == sorted((str(k), i, str(t), said.get(i, False)) for k, i, t in rows)
    assert quota.quota_flags(df.limit(0)).count() == 0


def test_one_key_of_a_million_requests(spark):
    df = spark.range(1_000_000, numPartitions=8).select(F.lit("k").alias("key"), "id", (F.col("id") * 7).alias("ts_ms"))
    began = time.time()
    out = quota.quota_flags(df, block_requests=100_000)
    assert len(out.groupBy(F.spark_partition_id()).count().collect()) > 2
    # a request each 7 ms: a window opens with each 8,572nd
    assert out.where(F.col("allowed") != (F.col("id") % 8572 < 20)).count() == 0
    assert time.time() - began < 60


def test_query_matches_sql_where_times_lie_just_before_a_unit(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=100 * (i + 1), microseconds=-1 - i), 7) for i in range(5)]
    # equal times without an id, of users that are null, and rows without a time
    rows += [(None if i < 15 else i, start, 8) for i in range(30)] + [(i, start + timedelta(days=40 * (i % 2)), None) for i in range(60)] + [(99, None, 7)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["t1_quota_flags"](spark, str(tmp_path)).select("key", "id", "ts_ms", "allowed").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    said = con.sql(f"SELECT key, id, ts_ms, allowed FROM ({ORACLE_SQL['t1_quota_flags']})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, said))
