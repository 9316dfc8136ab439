"""Quality classifier: parts against plain versions, held-out rows, awkward tables."""

import zlib

import numpy as np
import pytest

from folium.llm import text_quality as q

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, quality int, score double, bucket long, x string"


def test_words():
    assert q.words_of("The END!! of-A tale_x 12% É ÉÉ") == ["the", "END", "!", "!", "of", "-", "a", "tale", "x", "12", "%", "é", "ÉÉ"]
    assert q.words_of(None) == q.words_of(" \n") == []


def test_context_sums_against_plain_version(spark):
    texts = ["a b c a b", "b", "", None, "A b! C", "a b c a b", "x " * 50]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    places, signs = q.index_vectors()
    index = np.zeros((q.BUCKETS, q.DIMS))
    np.put_along_axis(index, places, signs, axis=1)
    assert (np.abs(index).sum(axis=1) == q.ENTRIES).all()
    n, sums = np.zeros(q.BUCKETS), np.zeros((q.BUCKETS, q.DIMS))
    for t in texts:
        b = q.buckets_of([t])[0].tolist()
        for i, w in enumerate(b):
            n[w] += 1
            for j in range(max(0, i - q.REACH), min(len(b), i + q.REACH + 1)):
                if j != i:
                    sums[w] += index[b[j]]
    found = {r[0]: r[1:] for r in q.context_sums(docs).collect()}
    assert {b: tuple(x) for b, x in found.items()} == {b: (n[b], *sums[b]) for b in np.flatnonzero(n)}


def test_pooling_of_long_texts(monkeypatch):
    vectors = np.random.default_rng(1).normal(size=(q.BUCKETS, q.DIMS)).astype(np.float32)
    texts = ["one two three four five six seven", None, "one", "eight nine ten eleven"]
    whole = q.pool(texts, vectors)
    monkeypatch.setattr(q, "WORDS_AT_ONCE", 3)
    assert np.allclose(whole, q.pool(texts, vectors), atol=1e-6)
    v = vectors[q.buckets_of(texts[:1])[0]]
    assert np.allclose(whole[0], np.r_[v.mean(axis=0), (v * v).mean(axis=0), (v[:-1] * v[1:]).sum(axis=0) / 7], atol=1e-5)
    assert not whole[1].any()


def test_slopes_and_temperature():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 6))
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0] + x[:, 1]))).astype(float)
    network = q.fit(x, y, np.arange(3000) % 4 == 0)
    p = network.scores(x)
    for low in (0.0, 0.25, 0.5, 0.75):
        part = (p >= low) & (p < low + 0.25)
        assert abs(p[part].mean() - y[part].mean()) < 0.06  # probabilities are frequencies


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in q.quality(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    unseen = [(rows[r.doc_id].score, r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    good, bad = ([s for s, y in unseen if y == k] for k in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.97


@pytest.mark.parametrize("labelled", [True, False])
def test_awkward_rows(spark, labelled):
    long = " ".join(f"w{i % 700}" for i in range(60_000))
    texts = [(1, "plain words stand here"), (1, "plain words stand here"), (2, None), (3, ""), (4, " \n\t "), (None, "no id here"), (6, long), (7, "ünïcode ▁ \0 日本")]
    texts += [(i, "good calm prose of words" if i % 2 else "$$$ %%% ### !!!") for i in range(10, 90)]
    docs = spark.createDataFrame([(i, t, 5, 0.1, 2, "x") for i, t in texts], SCHEMA)
    known = [(i, i % 2) for i in range(10, 90)] + [(11, 0), (11, None), (None, 1)] if labelled else []
    labels = spark.createDataFrame(known, "doc_id long, quality int")
    rows = q.quality(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in texts)
    assert all(r.held_out is False for r in rows if r.doc_id is None)
    same = [r.score for r in rows if r.doc_id == 1]
    assert same[0] == same[1]
    if labelled:
        assert np.mean([(r.score > 0.5) == bool(r.doc_id % 2) for r in rows if r.doc_id and r.doc_id >= 10]) > 0.95
    else:
        assert {r.score for r in rows} == {0.5}
    assert q.quality(docs.limit(0), labels).count() == 0
