"""Centroid clustering of integer vectors over a vector-approximation file.

Components become integers, floor(1024 * x). Each vector is kept beside its
approximation: a cell of a few bits a dimension. A round makes tables of the least
and greatest squared difference between each centroid and each cell, so that
summing lookups gives an interval of the distance to every centroid. Only where
intervals overlap is the full vector fetched, and compared with those centroids
alone whose interval begins before the least of the greatest distances. Sums follow the assignments: after the first round
only vectors whose centroid changes are fetched to be taken from one sum and added
to another. All of it is exact in 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import bounded_batches, materialize

SCALE, DIMS, CLUSTERS, ROUNDS, SEED = 1024, 64, 8, 10, 3
#: Bits of a cell, 8 at most; share of components left to the outermost cells on either side; rows whose intervals are worked out at a time.
BITS, TAIL, ROWS_AT_ONCE = 8, 0.001, 8192
#: Components beyond this have distances that leave 64 bits.
LARGEST = 1 << 27


def quantized(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v array<int>) of the vectors kept: `dims` components, none null or non-finite. One beyond LARGEST is an error."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") == dims) & sound)
    small = lambda x: F.abs(x) < F.lit(LARGEST)
    scaled = F.transform("v", lambda x: F.when(small(x * scale), F.floor(x * scale)).otherwise(F.raise_error(F.lit(f"a component times {scale} is not below {LARGEST}"))).cast("int"))
    return kept.select("vec_id", scaled.alias("v"))


def cell_bounds(kept: DataFrame, dims: int, bits: int = BITS) -> np.ndarray:
    """dims x (cells + 1): where the cells of each dimension begin. They are equally wide but for the outermost, which reach to the true least and greatest, so outliers don't widen the rest."""
    at = [F.get("v", F.lit(d)) for d in range(dims)]
    told = kept.agg(*(F.array_append(F.array_prepend(F.percentile_approx(x, [TAIL, 1 - TAIL]), F.min(x)), F.max(x)) for x in at)).first()
    inner = (1 << bits) - 2
    return np.array([[least, *(low + (high + 1 - low) * np.arange(inner + 1) // inner), greatest + 1] for least, low, high, greatest in told], np.int64)


def approximate(v: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The cell of each component, a byte each."""
    return np.stack([np.searchsorted(b[1:-1], v[:, d], "right") for d, b in enumerate(bounds)], axis=1).astype(np.uint8)


def distance_tables(centroids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest): for each dimension and cell, the bounds of its squared difference to each centroid."""
    low, high = bounds[:, :-1, None], np.maximum(bounds[:, 1:, None] - 1, bounds[:, :-1, None])
    c = centroids.T[:, None, :]
    return np.maximum(np.maximum(low - c, c - high), 0) ** 2, np.maximum(np.abs(c - low), np.abs(high - c)) ** 2


def intervals(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance of each row's vector to each centroid, by lookups."""
    low, high = np.zeros((2, len(cells), tables[0].shape[2]), np.int64)
    for d, (a, b) in enumerate(zip(*tables, strict=True)):
        low += a[cells[:, d]]
        high += b[cells[:, d]]
    return low, high


def nearest(cells: np.ndarray, vectors: np.ndarray, centroids: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """(centroid of each row, rows fetched): the nearest one, ties to the smaller number. Vectors are read only where intervals overlap."""
    out, fetched = np.empty(len(cells), np.int64), 0
    for at in range(0, len(cells), ROWS_AT_ONCE):
        low, high = intervals(cells[at : at + ROWS_AT_ONCE], tables)
        rival = low <= high.min(axis=1, keepdims=True)
        best = np.argmax(rival, axis=1)
        row, centroid = np.nonzero(rival & (rival.sum(axis=1) > 1)[:, None])
        if len(row):
            where, of = np.unique(row, return_inverse=True)
            full = vectors[at + where].astype(np.int64)
            exact = np.full((len(where), len(centroids)), np.iinfo(np.int64).max)
            for k in range(len(centroids)):  # one centroid after another bounds memory
                mine = of[centroid == k]
                exact[mine, k] = ((full[mine] - centroids[k]) ** 2).sum(axis=1)
            best[where] = np.argmin(exact, axis=1)
            fetched += len(where)
        out[at : at + ROWS_AT_ONCE] = best
    return out, fetched


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A column of equally long binaries as a matrix, without a copy."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), -1).view(kind)


def vector_file(kept: DataFrame, bounds: np.ndarray) -> DataFrame:
    """(vec_id, cells binary, vector binary): approximations beside full vectors of 32-bit components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(-1, len(bounds)).astype(np.int32)
            rows = [pa.array(map(bytes, m), pa.binary()) for m in (approximate(v, bounds), v.view(np.uint8))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rows], ["vec_id", "cells", "vector"])

    return kept.mapInArrow(run, "vec_id long, cells binary, vector binary")


def _changes(batches: Iterator[pa.RecordBatch], new: np.ndarray, old: np.ndarray | None, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One task's (cluster, n, fetched, sums) of the vectors that join less those that leave each cluster; all join where there is no old assignment."""
    k, dims = new.shape
    n, sums, fetched = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), 0
    now = distance_tables(new, bounds)
    then = distance_tables(old, bounds) if old is not None else None
    for batch in batches:
        cells, vectors = _matrix(batch.column(0), np.uint8), _matrix(batch.column(1), np.int32)
        to, seen = nearest(cells, vectors, new, now)
        fetched += seen
        moved = np.arange(len(to))
        if then is not None:
            source, seen = nearest(cells, vectors, old, then)
            fetched += seen
            moved = np.flatnonzero(source != to)
        for c in range(k):
            joins = moved[to[moved] == c]
            n[c] += len(joins)
            sums[c] += vectors[joins].sum(axis=0, dtype=np.int64)
            if then is not None:
                leaves = moved[source[moved] == c]
                n[c] -= len(leaves)
                sums[c] -= vectors[leaves].sum(axis=0, dtype=np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array([fetched] + [0] * (k - 1), pa.int64()), *(pa.array(sums[:, d]) for d in range(dims))], ["cluster", "n", "fetched", *(f"s{d}" for d in range(dims))])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    tables = distance_tables(centroids, bounds)
    for batch in batches:
        cells, vectors = _matrix(batch.column(1), np.uint8), _matrix(batch.column(2), np.int32)
        to, _ = nearest(cells, vectors, centroids, tables)
        away = np.concatenate([np.empty(0, np.int64), *(((vectors[a : a + ROWS_AT_ONCE] - centroids[to[a : a + ROWS_AT_ONCE]]) ** 2).sum(axis=1) for a in range(0, len(to), ROWS_AT_ONCE))])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to.astype(np.int32)), pa.array(away)], ["vec_id", "cluster", "distance"])


def first_centroids(kept: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors of the smallest sha256 of "seed:vec_id"; rows of one vec_id go by their components, rows without one last."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(rank.alias("rank"), "v").orderBy(F.asc_nulls_last("rank"), "v").limit(clusters).collect()  # at most `clusters`
    return np.array([r["v"] for r in rows], np.int64)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, dims: int = DIMS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray, list[int]]:
    """((vec_id, cluster, distance), centroids, full vectors fetched to decide each round).

    Kept are vectors of `dims` components, none null or non-finite; others take no part. Centroids begin as the vectors of the smallest
    hashes, fewer where there are fewer vectors. Each round assigns all vectors and
    moves every centroid that has some to the floor of their mean. Rows without an
    id and repeated rows are vectors of their own. An empty table gives no rows.
    """
    bounded_batches(vectors.sparkSession)
    kept = materialize(quantized(vectors, id_col, vector_col, dims, scale), "clusters-vectors")
    centroids = first_centroids(kept, clusters, seed)
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids.reshape(0, dims), []
    bounds = cell_bounds(kept, dims)
    table = materialize(vector_file(kept, bounds), "clusters-file")
    schema = ", ".join(["cluster int, n long, fetched long", *(f"s{d} long" for d in range(dims))])
    totals = [F.sum(c).alias(c) for c in ["n", "fetched", *(f"s{d}" for d in range(dims))]]
    n, sums, old, fetched = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64), None, []
    for _ in range(rounds):
        step = table.select("cells", "vector").mapInArrow(partial(_changes, new=centroids, old=old, bounds=bounds), schema)
        told = step.groupBy("cluster").agg(*totals).orderBy("cluster").collect()  # one row a centroid
        n = n + np.array([r["n"] for r in told])
        sums = sums + np.array([r[3:] for r in told], np.int64)
        fetched.append(sum(r["fetched"] for r in told))
        moved = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], centroids)
        old, centroids = centroids, moved
    return table.mapInArrow(partial(_assigned, centroids=centroids, bounds=bounds), "vec_id long, cluster int, distance long"), centroids, fetched


def cluster_digest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): cluster() with the sums of distances and the hash of each centroid."""
    assigned, centroids, _ = cluster(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    assigned = materialize(assigned, "clusters-assigned")
    named = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centroids.tolist())], "cluster int, components string")
    per = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    told = per.join(F.broadcast(named), "cluster")  # a row a centroid on either side
    total = per.agg(F.sum("cluster_inertia").alias("inertia"))
    full = told.join(F.broadcast(total)).select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
    return assigned.join(F.broadcast(full), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(i: int) -> str:
    return f"""a{i} AS MATERIALIZED (
  SELECT r, k FROM (SELECT v.r, c.k, list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v CROSS JOIN c{i} c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1
), m{i} AS MATERIALIZED (
  SELECT k, list(floored ORDER BY i) AS v FROM (
    SELECT k, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS floored FROM (
      SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.k, unnest(v.v) AS x, generate_subscripts(v.v, 1) AS i FROM v JOIN a{i} a USING (r)) GROUP BY k, i)
  ) GROUP BY k
), c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (k)), """


CLUSTER_SQL = (
    f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS k, v FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM v) QUALIFY k < {CLUSTERS}
), """
    + "".join(map(_round_sql, range(ROUNDS)))
    + f"""final AS MATERIALIZED (
  SELECT vec_id, k, d FROM (SELECT v.r, v.vec_id, c.k, list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v CROSS JOIN c{ROUNDS} c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1
)
SELECT vec_id, k::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM final JOIN c{ROUNDS} c USING (k)
"""
)
