"""Packing in blocks against one pass over a run, whatever the blocks cut through."""

import random

import pytest
from pyspark.sql import functions as F

from folium.operators import chunks


def packed(spark, runs_, block_tokens, target=395, overlap=80):
    rows = [(s, r, i, t, p) for s, r, units in runs_ for i, (t, p) in enumerate(units)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(s, r, i, n, t, p) for n, (s, r, i, t, p) in enumerate(rows)], "source string, run long, i int, uid long, tokens int, split boolean")
    at = {n: i for n, (_, _, i, _, _) in enumerate(rows)}
    found = {}
    for x in chunks.pack_units(df, ["i"], target=target, overlap=overlap, block_tokens=block_tokens).collect():
        found.setdefault((x.source, x.run), {}).setdefault(x.chunk, []).append((x.place, at[x.uid]))
    return {k: [[i for _, i in sorted(c[n])] for n in sorted(c)] for k, c in found.items()}


@pytest.mark.parametrize("sizes", [(1, 5, 40, 79, 80, 81, 120, 300, 395), (0, 0, 3, 80), (1, 30, 2000), (0, 5000, 60)])
def test_blocks_pack_as_one_pass(spark, sizes):
    rng = random.Random(sum(sizes))
    runs_ = [(s, r, [(rng.choice(sizes), rng.random() < 0.2) for _ in range(n)]) for s, r, n in (("a", 0, 700), ("a", 1, 3), ("b", 0, 300), (None, 0, 400), ("c", 0, 1))]
    said = {(s, r): chunks.greedy([t for t, _ in units], [p for _, p in units]) for s, r, units in runs_}
    for block_tokens in (395, 1000, 1 << 20):
        assert packed(spark, runs_, block_tokens) == said


def test_random_runs_with_small_limits(spark):
    rng = random.Random(9)
    runs_ = [("s", r, [(rng.choice([0, 1, 2, 3, 5, 9, 40]), rng.random() < 0.3) for _ in range(rng.randrange(1, 60))]) for r in range(60)]
    for target, overlap in ((10, 4), (7, 7), (12, 0)):
        said = {(s, r): chunks.greedy([t for t, _ in u], [p for _, p in u], target, overlap) for s, r, u in runs_}
        assert packed(spark, runs_, 12, target, overlap) == said


def test_one_run_of_a_million_units(spark):
    units = spark.range(1_000_000, numPartitions=8).select(F.lit("s").alias("source"), F.lit(0).cast("long").alias("run"), F.col("id").alias("uid"), F.col("id").alias("i"), (F.pmod(F.xxhash64("id"), F.lit(120)) + 1).cast("int").alias("tokens"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9)) == 0).alias("split"))
    out = chunks.pack_units(units, ["i"], block_tokens=1 << 21)
    by_task = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) > 4
    rows = sorted((r.uid, r.tokens, r.split) for r in units.select("uid", "tokens", "split").toPandas().itertuples())
    prefix_chunks = chunks.greedy([t for _, t, _ in rows], [p for _, _, p in rows])
    told = out.groupBy("chunk").agg(F.min("uid").alias("a"), F.max("uid").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("chunk").toPandas()
    assert [(c[0], c[-1], len(c)) for c in prefix_chunks] == list(zip(told.a, told.b, told.n, strict=True))


def test_overlong_texts_are_counted_once(spark):
    from time import time

    text = " ".join(f"a{i} b, c." for i in range(60_000))
    df = spark.createDataFrame([("s", text)], "source string, text string").withColumn("tokens", chunks.count_tokens("text"))
    began = time()
    parts = chunks.split_overlong(df, 20_000).select("part", "tokens").collect()
    assert time() - began < 20
    assert sum(r.tokens for r in parts) == 300_000
    assert max(r.tokens for r in parts) <= 19_998
    assert len(parts) == 16
