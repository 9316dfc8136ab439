"""Embeddings, vector search and answer assembly."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.text import cut_with_mark
from folium.sources.shared import bounded_batches, written

Encoder = Callable[[list[str]], np.ndarray]
PREFIX = {"index": "passage: ", "search": "query: "}


def hashed_encoder(dims: int = 384) -> Encoder:
    """A deterministic stand-in for a model: hashed word counts. It holds no meaning; plumbing and tests use it."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, t in zip(out, texts, strict=True):
            for w in t.lower().split():
                row[zlib.crc32(w.encode()) % dims] += 1
        return out

    return encode


def embed(df: DataFrame, role: str = "index", make_encoder: Callable[[], Encoder] = hashed_encoder, text: str = "text", batch: int = 64) -> DataFrame:
    """df with `embedding`: unit-length vectors of the prefixed text; the encoder is made once a task."""
    schema = df.schema.simpleString()[7:-1] + ",embedding:array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        norm = lambda v: (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield part.assign(embedding=[norm(np.asarray(v, float)) for v in encode([PREFIX[role] + (t or "") for t in part[text]])])

    bounded_batches(df.sparkSession)
    return df.mapInPandas(run, f"struct<{schema}>")


#: Vectors and queries that meet in one task; vectors a cluster should hold; most clusters.
CELL_VECTORS, CELL_QUERIES, CLUSTER_VECTORS, MOST_CLUSTERS = 16_384, 2048, 512, 1024
#: Angles are compared with this much to spare.
SLACK = 1e-7


@dataclass(frozen=True)
class VectorIndex:
    """Unit vectors by cluster: table(cluster, chunk_id, v), and each cluster's centre, greatest angle of a member to it, and number of members.

    The table is written to the shared folder, so one index serves any number of searches.
    """

    table: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    members: np.ndarray

    def reached(self, units: np.ndarray, threshold: float) -> np.ndarray:
        """units x clusters: which clusters may hold a vector with a cosine of at least the threshold. By the triangle inequality of angles the others hold none."""
        away = np.arccos(np.clip(units @ self.centres.T, -1, 1))
        return (away - self.radius <= np.arccos(np.clip(threshold, -1, 1)) + SLACK) & (self.members > 0)


def _units(vectors: DataFrame, key: str) -> DataFrame:
    """(key, v array<double> of length 1) of the vectors that have a length: none that are null or zero, or hold null or NaN."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sized = vectors.select(key, v.alias("v")).withColumn("length", length).where((F.col("length") > 0) & (F.col("length") < F.lit(float("inf"))))
    return sized.select(F.col(key).cast("long").alias(key), F.transform("v", lambda x: x / F.col("length")).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def vector_index(chunks: DataFrame, cluster_vectors: int = CLUSTER_VECTORS) -> VectorIndex:
    """The index of chunks(chunk_id, embedding), vectors of one length. Centres are vectors chosen by hash, at most MOST_CLUSTERS, and each vector joins the nearest."""
    units = written(_units(chunks, "chunk_id"), "search-units")
    n = units.count()
    wanted = min(MOST_CLUSTERS, -(-n // cluster_vectors))
    chosen = units.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(wanted).toArrow() if n else None  # at most MOST_CLUSTERS
    centres = _matrix(chosen["v"]) if n else np.empty((0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _matrix(batch.column(1)) @ centres.T
            best = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(best)), best], -1, 1))
            yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32)), pa.array(angle), *batch.columns], ["cluster", "angle", "chunk_id", "v"])

    placed = written(units.mapInArrow(run, "cluster int, angle double, chunk_id long, v array<double>"), "search-index")
    radius, members = np.zeros(wanted), np.zeros(wanted, np.int64)
    for r in placed.groupBy("cluster").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # one row a cluster
        radius[r["cluster"]], members[r["cluster"]] = r["radius"], r["n"]
    return VectorIndex(placed.drop("angle"), centres, radius, members)


def _asked(queries: DataFrame, index: VectorIndex, threshold: float) -> DataFrame:
    """(cluster, query_id, v): each query at the clusters it may find something in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(index.centres):
                row, cluster = np.nonzero(index.reached(_matrix(batch.column(1)), threshold))
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), *taken.columns], ["cluster", "query_id", "v"])

    return _units(queries, "query_id").mapInArrow(run, "cluster int, query_id long, v array<double>")


def pairs_scored(queries: DataFrame, index: VectorIndex, threshold: float = 0.82) -> float:
    """Share of all pairs of a query and a chunk that a search compares."""
    per = _asked(queries, replace(index, table=None), threshold).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a cluster
    whole = _units(queries, "query_id").count() * int(index.members.sum())
    return sum(r["n"] * int(index.members[r["cluster"]]) for r in per) / whole if whole else 0.0


def search(queries: DataFrame, chunks: DataFrame | VectorIndex, threshold: float = 0.82, k: int = 8, *, cell_queries: int = CELL_QUERIES, cell_vectors: int = CELL_VECTORS) -> DataFrame:
    """(query_id, chunk_id, similarity, rank): at most k chunks a query with cosine similarity of at least the threshold.

    Queries go to the clusters of the index that the threshold leaves, and meet
    their vectors in cells of bounded size; a cell multiplies its matrices and keeps
    k a query. Clusters that no query reaches aren't read further. Null and zero
    vectors, and those with null or NaN components, find nothing and aren't found.
    Ties go to the smaller chunk_id; repeated ids are told apart by nothing, so each
    of their rows is found. An empty table on either side gives no rows.
    """
    index = chunks if isinstance(chunks, VectorIndex) else vector_index(chunks)
    asked = written(_asked(queries, replace(index, table=None), threshold), "search-asked")
    per = {r["cluster"]: r["n"] for r in asked.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a cluster
    sizes = [(c, -(-n // cell_queries), -(-int(index.members[c]) // cell_vectors)) for c, n in per.items()]
    cells = F.broadcast(queries.sparkSession.createDataFrame(sizes, "cluster int, a int, b int"))  # at most MOST_CLUSTERS
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = asked.join(cells, "cluster").select("cluster", dealt("query_id", "a").alias("i"), steps("b").alias("j"), F.lit(True).alias("asks"), F.col("query_id").alias("id"), "v")
    c = index.table.join(cells, "cluster").select("cluster", steps("a").alias("i"), dealt("chunk_id", "b").alias("j"), F.lit(False).alias("asks"), F.col("chunk_id").alias("id"), "v")

    def run(group: pa.Table) -> pa.Table:
        asks, ids, v = group["asks"].to_numpy(), group["id"].to_numpy(), _matrix(group["v"])
        queries_, own, found = ids[asks], ids[~asks], []
        scores = v[asks] @ v[~asks].T
        for row, of in enumerate(scores):
            hit = np.flatnonzero(of >= threshold)
            best = hit[np.lexsort((own[hit], -of[hit]))[:k]]
            found.append((np.full(len(best), queries_[row]), own[best], of[best]))
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table(dict(zip(("query_id", "chunk_id", "similarity"), parts, strict=True)))

    best = q.unionByName(c).groupBy("cluster", "i", "j").applyInArrow(run, "query_id long, chunk_id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_source(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Source fields for each hit; the chunk's own note goes before the source's."""
    s = sources.withColumnRenamed("note", "source_note")
    return hits.join(s, "source").withColumn("note", F.coalesce("note", "source_note")).drop("source_note")


def threshold_report(best: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each candidate threshold how many queries find something, and the top score. best: (query_id, similarity), any number a query."""
    top = best.groupBy("query_id").agg(F.max("similarity").alias("top"))
    each = top.select("query_id", "top", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return each.groupBy("threshold").agg(F.count_if(F.col("top") >= F.col("threshold")).alias("queries_with_hits"), F.max("top").alias("top_score"))


def unanswered(queries: DataFrame, hits: DataFrame) -> DataFrame:
    return queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")


def citations(hits: DataFrame, n: int = 400) -> DataFrame:
    """hits with `number` by rank, `excerpt` cut to n characters, and `citation` as JSON without its null fields."""
    numbered = hits.withColumns({"number": F.row_number().over(Window.partitionBy("query_id").orderBy("rank")), "excerpt": cut_with_mark(F.col("text"), n, "…")})
    fields = [c for c in ("number", "chunk_id", "title", "author", "kind", "reliability", "date", "url", "pages", "section", "note", "excerpt") if c in numbered.columns]
    return numbered.withColumn("citation", F.to_json(F.struct(*fields)))


def context_block(hits: DataFrame) -> DataFrame:
    """(query_id, context): the hits' texts under their labels, in rank order."""
    label = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string")))
    names = [(n, c) for n, c in (("Source", "title"), ("Pages", "pages"), ("Section", "section"), ("Type", "kind"), ("Reliability", "reliability"), ("Note", "note")) if c in hits.columns]
    block = F.concat_ws("\n", F.concat(F.lit("["), F.col("rank"), F.lit("]")), *(label(n, c) for n, c in names), F.col("text"))
    per = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("b"))
    return per.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"))


def recent_history(turns: DataFrame, n: int = 6) -> DataFrame:
    """turns with `history`: the up to n turns before each, in order. turns: (conv_id, turn, role, text)."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    return turns.withColumn("history", F.collect_list(F.struct("turn", "role", "text")).over(w))


def preview(hits: DataFrame, n: int = 300) -> DataFrame:
    return hits.select(
        "query_id", "rank", F.round("similarity", 3).alias("score"), "pages", F.coalesce("section", F.lit("(no section)")).alias("section"),
        (F.col("kind") == "footnote").alias("footnote"), F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, n).alias("start"),
    )
