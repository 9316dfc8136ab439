"""Ordered scans in blocks against plain windows, and as-of joins against a plain loop."""

import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folium.operators import scans, sections


def columns():
    return {k: (k, F.col("v")) for k in scans.KINDS}


def rows(n, seed, keys="aab"):
    rng = random.Random(seed)
    return [(rng.choice([*keys, None]), rng.choice([None, *range(0, n, 3)]), i, rng.choice([None, rng.randrange(100)])) for i in range(n)]


@pytest.mark.parametrize("block", [1, 7, 50])
@pytest.mark.parametrize("kind", ["int", "double", "date", "timestamp"])
def test_blocks_give_the_windows_results(spark, block, kind):
    df = spark.createDataFrame(rows(400, block), "k string, o int, id int, v int").withColumn("o", F.date_add(F.lit("2020-01-01").cast("date"), F.col("o")).cast(kind) if kind in ("date", "timestamp") else F.col("o").cast(kind))
    plain = df.withColumns({n: scans._field(k, scans._scanned(k, v, ["o", "id"], ["k"])) for n, (k, v) in columns().items()})
    cut = scans.scan(df, ["k"], ["o", "id"], columns(), key_rows=10, block_rows=block)
    assert cut.columns == plain.columns
    assert sorted(map(tuple, cut.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert scans.block_cuts(df, ["k"], "o", 10, block) is not None


def test_blocks_are_even_and_deep(spark):
    df = spark.range(100_000).select(F.lit("one").alias("k"), "id")
    cuts = scans.block_cuts(df, ["k"], "id", 1000, 50)
    sizes = [r["count"] for r in scans.with_blocks(df, ["k"], "id", cuts).groupBy(scans._BLOCK).count().collect()]
    assert len(sizes) > scans.FAN_OUT and sum(sizes) == 100_000 and max(sizes) < 500


def test_replaced_columns_strings_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "z", None)], "k string, o string, v int")
    out = scans.scan(df, ["k"], ["o"], {"v": ("last", F.col("v")), "n": ("number", F.lit(1))}, key_rows=1, block_rows=1)
    assert out.columns == ["k", "o", "v", "n"] and sorted(map(tuple, out.collect())) == [("a", "x", 1, 1), ("a", "y", 2, 2), ("a", "z", 2, 3)]
    assert scans.scan(df.limit(0), ["k"], ["v"], columns()).count() == 0


@pytest.mark.parametrize("few", [0, 64])
def test_as_of_against_plain_version(spark, few):
    rng = random.Random(few)
    pages = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-2, 60)]), i) for i in range(300)]
    starts = [(rng.choice(["a", "a", "b", "c", None]), rng.choice([None, *range(0, 60, 4)]), rng.choice([None, "x", "y", f"l{i}"])) for i in range(40)]

    def label(key, page):
        fit = [(s, v is not None, v or "") for k, s, v in starts if k is not None and k == key and s is not None and page is not None and s <= page]
        return max(fit)[2] if fit and max(fit)[1] else None

    p = spark.createDataFrame(pages, "source string, page int, id int")
    s = spark.createDataFrame(starts, "source string, start long, label string")
    out = scans.as_of(p, s, ["source"], "page", "start", "label", "section", few=few, key_rows=20, block_rows=9)
    assert out.columns == ["source", "page", "id", "section"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((k, x, i, label(k, x)) for k, x, i in pages), key=str)
    assert scans.as_of(p, s.limit(0), ["source"], "page", "start", "label", "section", few=few).where("section is not null").count() == 0


def test_one_source_of_a_million_pages(spark):
    pages = spark.range(1_000_000, numPartitions=8).select(F.lit("s").alias("source"), F.col("id").alias("page"))
    ranges = spark.range(100_000).select(F.lit("s").alias("source"), (F.col("id") * 10 + 3).alias("start"), F.col("id").cast("string").alias("label"))
    began = time.time()
    found = scans.as_of(pages, ranges, ["source"], "page", "start", "label", "section", key_rows=200_000, block_rows=50_000)
    said = F.when(F.col("page") >= 3, F.floor((F.col("page") - 3) / 10).cast("string"))
    assert found.where(~F.col("section").eqNullSafe(said)).count() == 0
    assert time.time() - began < 60
    sectioned = sections.section_by_range(pages, ranges)
    assert sectioned.where(~F.col("section").eqNullSafe(said)).count() == 0


def test_large_source_uses_many_tasks(spark):
    df = spark.range(200_000, numPartitions=4).select(F.lit("s").alias("source"), F.col("id").alias("page"), F.when(F.col("id") % 10 == 0, F.col("id")).alias("v"))
    out = scans.scan(df, ["source"], ["page"], {"x": ("last", F.col("v")), "n": ("number", F.lit(1))}, key_rows=10_000, block_rows=10_000)
    spread = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) >= 4 and max(r["count"] for r in spread) < 150_000
    w = Window.partitionBy("source").orderBy("page")
    assert out.where((F.col("n") != F.col("page") + 1) | (F.col("x") != F.col("page") - F.col("page") % 10)).count() == 0
    assert df.select(F.last("v", True).over(w)).count() == 200_000
