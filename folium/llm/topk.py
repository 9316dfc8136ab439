"""Exact top-k by inner product: columnar branch-and-bound.

Components become integers, floor(256 * x). Queries and vectors are dealt to a
grid of cells of bounded size, so each cell holds some queries and some
candidates. In a cell candidates lie in vertical layout (one array a dimension
block); for a query the blocks are added up in the order of the query's own
mass. After a block each survivor has an upper bound (partial product plus the
norm of the query's rest times the norm of its own rest) and a lower one; those
whose upper bound is under the k-th best lower bound are compacted away. A cell
gives k candidates a query, of which the best k are kept at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.llm.common import materialize

#: A query is copied once for each CELL_VECTORS vectors, a vector once for each CELL_QUERIES queries; small tables have smaller cells.
SCALE, BLOCK, CELL_QUERIES, CELL_VECTORS, LEAST_VECTORS = 256, 8, 4096, 32_768, 4096


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part: none that are null or hold null or non-finite components."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    # NaN and the infinities fail the comparison or exceed every finite double
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ready = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return ready.where(F.col("v").isNotNull() & sound).select("vec_id", F.transform("v", lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


def search_cell(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector, score): per query its k best of the cell, ties to the smaller id; -1 or the vector that is the query's own row stands in `own`."""
    dims = vectors.shape[1]
    cuts = list(range(0, dims, block))
    columns = [np.ascontiguousarray(vectors[:, c : c + block]) for c in cuts]
    mass = np.stack([(x.astype(np.float64) ** 2).sum(axis=1) for x in columns]) if cuts else np.zeros((0, len(ids)))
    total = mass.sum(axis=0)
    rows, found, scores = [], [], []
    for r, (q, itself) in enumerate(zip(queries, own.tolist(), strict=True)):
        parts = [q[c : c + block] for c in cuts]
        q_mass = np.array([(p.astype(np.float64) ** 2).sum() for p in parts])
        alive = np.delete(np.arange(len(ids)), itself) if itself >= 0 else np.arange(len(ids))
        partial, rest, q_rest = np.zeros(len(alive), np.int64), total[alive], float(q_mass.sum())
        for at in np.argsort(-q_mass, kind="stable"):
            partial += columns[at][alive] @ parts[at]
            rest, q_rest = rest - mass[at][alive], max(0.0, q_rest - q_mass[at])
            if len(alive) > k:
                reach = np.sqrt(np.maximum(rest, 0) * q_rest) + 0.5
                floor = np.partition(partial - reach, -k)[-k]
                keep = partial + reach >= floor
                if not keep.all():
                    alive, partial, rest = alive[keep], partial[keep], rest[keep]
        best = np.lexsort((ids[alive], -partial))[:k]
        rows.append(np.full(len(best), r))
        found.append(alive[best])
        scores.append(partial[best])
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, found, scores))


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 5, every: int = 50, cell_queries: int = CELL_QUERIES, cell_vectors: int = CELL_VECTORS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each query, ties to the smaller vec_id.

    Queries are the rows whose id is divisible by `every`. Vectors that are null,
    or hold null or non-finite components, or have no id, take no part; vectors are
    compared with those of their own length. Rows of repeated ids are rows of their
    own: each that asks gets its own ranks, and all but itself are its candidates.
    Fewer than k others give all of them; an empty table gives none.
    """
    spark = vectors.sparkSession
    sound = quantized(vectors, id_col, vector_col).where("vec_id is not null").withColumns({"row": F.monotonically_increasing_id(), "dims": F.size("v")})
    sound = materialize(sound, "topk-vectors")  # rows keep their keys
    counts = sound.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    cell_vectors = min(cell_vectors, max(LEAST_VECTORS, -(-counts["n"] // (2 * spark.sparkContext.defaultParallelism))))
    a, b = max(1, -(-counts["q"] // cell_queries)), max(1, -(-counts["n"] // cell_vectors))
    steps = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    dealt = lambda salt, n: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    queries = sound.where(F.col("vec_id") % every == 0).select(dealt(1, a).alias("i"), F.explode(steps(b)).alias("j"), F.lit(True).alias("asks"), "row", "vec_id", "dims", "v")
    candidates = sound.select(F.explode(steps(a)).alias("i"), dealt(2, b).alias("j"), F.lit(False).alias("asks"), "row", "vec_id", "dims", "v")

    def run(group: pa.Table) -> pa.Table:
        asks, rows, ids = (group[c].to_numpy() for c in ("asks", "row", "vec_id"))
        flat = group["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), group["dims"][0].as_py())
        there = rows[~asks]
        order = np.argsort(there)
        at = order[np.minimum(np.searchsorted(there, rows[asks], sorter=order), max(0, len(there) - 1))] if len(there) else np.zeros(asks.sum(), np.int64)
        own = np.where(there[at] == rows[asks], at, -1) if len(there) else at - 1
        query, found, score = search_cell(flat[asks], own, flat[~asks], ids[~asks], k)
        return pa.table({"row": rows[asks][query], "query_id": ids[asks][query], "vec_id": ids[~asks][found], "score": pa.array(score, pa.int64())})

    best = queries.unionByName(candidates).groupBy("i", "j", "dims").applyInArrow(run, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.r <> q.r AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
