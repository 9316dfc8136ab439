"""Periodic runs and their Lyndon arrays against brute force, and on awkward tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from folium.llm import runs

DATA = "/root/testdata/sf0.001"


def lyndon_by_definition(s):
    out = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] > s[i:]:
            j += 1
        out.append(j - i)
    return out


def runs_by_definition(w, least):
    found = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            part = w[i : i + length]
            if j > i and length >= max(least, 2 * q) and not any(part[r:] == part[: length - r] for r in range(1, q)):
                found.add((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_lyndon_array():
    rng = random.Random(1)
    for _ in range(600):
        s = rng.choices(range(rng.randint(1, 4)), k=rng.randint(0, 24))
        assert runs.lyndon_array(np.array(s, np.int64)).tolist() == lyndon_by_definition(s)


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_against_brute_force(least):
    rng = random.Random(least)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, kinds = rng.randint(0, 60), rng.choice([1, 2, 3, 50])
            words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 3))
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(words)
        found = runs.batch_runs(texts, least)
        assert [[tuple(r) for r in x.tolist()] for x in found] == [runs_by_definition(t, least) for t in texts]


def test_long_periodic_texts():
    for words in ([b"a"] * 200_000, [b"%d" % i for i in range(50_000)] * 2):
        assert [x.tolist() for x in runs.batch_runs([words])] == [[[0, len(words), len(set(words))]]]


def digest_by_definition(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs_by_definition(words, 12)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(found), s, length, q, None if s is None else 1000 * length // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()), sha(kept))


def key(row):
    return tuple("" if x is None else f"{x!s:>30}" for x in row)


def test_digest_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 3000")
    found = sorted(map(tuple, runs.run_digest(docs).collect()), key=key)
    said = sorted((digest_by_definition(r.doc_id, r.text) for r in docs.collect()), key=key)
    assert found == said
    assert sum(r[1] > 0 for r in said) > 10


def test_digest_on_awkward_rows(spark):
    planted = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    texts = [(1, "a b " * 12), (1, "a b " * 12), (2, None), (3, ""), (4, " \n\t "), (None, "x " * 12), (planted, "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 3), (planted, None), (planted, "  "), (planted, "one"), (5, "é é " * 6 + "é é\x0bé é " * 4)]
    docs = spark.createDataFrame([(i, t, [7], "g", 1, 2, 3, 4) for i, t in texts], "doc_id long, text string, runs array<int>, words string, n int, a int, h long, collapsed long")
    assert sorted(map(tuple, runs.run_digest(docs).collect()), key=key) == sorted((digest_by_definition(i, t) for i, t in texts), key=key)
    assert runs.run_digest(docs.limit(0)).count() == 0
    whole = {tuple(x) for x in runs.periodic_runs(docs.where("doc_id = 1")).selectExpr("runs[0].start", "runs[0].length", "runs[0].period", "collapsed").collect()}
    assert whole == {(0, 24, 2, "a b")}
