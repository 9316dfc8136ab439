"""Search by a clustered index against all pairs, and how few pairs it compares."""

import numpy as np
import pytest

from folium.operators import search


def tables(spark, queries, chunks):
    frame = lambda rows, key: spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{key} long, embedding array<double>")
    return frame(queries, "query_id"), frame(chunks, "chunk_id")


def by_definition(queries, chunks, threshold, k):
    unit = lambda v: np.asarray(v, float) / np.linalg.norm(v)
    out = []
    for q, v in queries:
        hits = sorted((-float(unit(v) @ unit(c)), i) for i, c in chunks)
        out += [(q, i, n) for n, (s, i) in enumerate([h for h in hits if -h[0] >= threshold][:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("cells", [(3, 7), (2048, 16_384)])
@pytest.mark.parametrize("threshold", [0.82, 0.3, -1.0])
def test_search_against_all_pairs(spark, cells, threshold):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    chunks = [(i, centres[i % 6] + rng.normal(size=12) * 0.3) for i in range(240)]
    queries = [(i, centres[i % 6] + rng.normal(size=12) * 0.4) for i in range(20)]
    q, c = tables(spark, [*queries, (90, None), (91, [0.0] * 12), (92, [float("nan")] * 12)], [*chunks, (900, None), (901, [0.0] * 12)])
    index = search.vector_index(c, 20)
    assert len(index.centres) == 12 and index.members.sum() == 240
    found = search.search(q, index, threshold, 5, cell_queries=cells[0], cell_vectors=cells[1])
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in found.collect()) == by_definition(queries, chunks, threshold, 5)


def test_few_pairs_are_scored(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64))
    chunks = [(i, centres[i % 40] + rng.normal(size=64) * 0.1) for i in range(2000)]
    q, c = tables(spark, chunks[:50], chunks)
    index = search.vector_index(c, 20)
    assert search.pairs_scored(q, index) < 0.1
    assert search.search(q, index).count() == 400


def test_empty_sides(spark):
    q, c = tables(spark, [(1, [1.0, 0.0])], [(1, [1.0, 0.0])])
    assert search.search(q.limit(0), c).count() == search.search(q, c.limit(0)).count() == 0
    assert search.pairs_scored(q, search.vector_index(c.limit(0))) == 0
