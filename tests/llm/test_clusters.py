"""Centroid clustering against a plain version and its SQL, and the intervals of the approximation file."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from folium.llm import clusters

DATA = "/root/testdata/sf0.001"


def by_definition(rows, dims=64, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, sha(f"3:{r[0]}"), r[1]))[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda: [min((away(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        to = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, to, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    to = assign()
    per = {j: sum(d for d, c in to if c == j) for _, j in to}
    return sorted(((i, c, d, per[c], sum(per.values()), sha(",".join(map(str, centroids[c])))) for (i, _), (d, c) in zip(kept, to, strict=True)), key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("spread", [0.01, 1.0, 50.0])
def test_clusters_against_plain_version(spark, spread):
    rng = random.Random(3)
    centres = [[rng.gauss(0, spread) for _ in range(64)] for _ in range(5)]
    rows = [(i % 150, [c + rng.gauss(0, 0.1) for c in centres[i % 5]]) for i in range(200)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (900, None), (901, [1.0] * 63), (902, [None] + [1.0] * 63), (903, [float("nan")] * 64), (904, [float("inf")] * 64), (905, []), (906, [1e5] * 64)]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, cluster int, v int, cells int")
    assert found(clusters.cluster_digest(df)) == by_definition(rows)


@pytest.mark.parametrize("n", [1, 3])
def test_few_and_equal_vectors(spark, n):
    rows = [(i, [0.5] * 64) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(clusters.cluster_digest(df)) == by_definition(rows)
    assert clusters.cluster_digest(df.limit(0)).count() == 0


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e300] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="not below"):
        clusters.cluster_digest(df)


def test_clusters_match_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    assert found(clusters.cluster_digest(spark.read.parquet(f"{DATA}/embeddings.parquet"))) == sorted(con.sql(clusters.CLUSTER_SQL).fetchall(), key=str)


def test_intervals_hold_and_spare_vectors():
    rng = np.random.default_rng(5)
    centroids = rng.integers(-400, 400, (8, 64))
    v = (centroids[rng.integers(0, 8, 3000)] + rng.normal(0, 20, (3000, 64))).astype(np.int32)
    v[0, 0] = 1 << 20
    bounds = np.stack([np.r_[v[:, d].min(), np.linspace(np.quantile(v[:, d], 0.001), np.quantile(v[:, d], 0.999), 255).astype(int), v[:, d].max() + 1] for d in range(64)])
    cells, tables = clusters.approximate(v, bounds), clusters.distance_tables(centroids, bounds)
    low, high = clusters.intervals(cells, tables)
    exact = ((v[:, None, :].astype(np.int64) - centroids) ** 2).sum(axis=2)
    assert (low <= exact).all() and (exact <= high).all()
    to, fetched = clusters.nearest(cells, v, centroids, tables)
    assert (to == exact.argmin(axis=1)).all() and fetched < 300
