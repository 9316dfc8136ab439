"""Quality of texts: random-indexing word vectors, pooled, and a small network with calibrated probabilities.

Random indexing: each word has a fixed sparse index vector of a few +1 and -1; its
context vector is the sum of the index vectors of its neighbours in the whole
corpus. Words are hashed to a fixed number of buckets, so the vectors are one
matrix of a known size however large the vocabulary is; partial sums are made a
task and added up by bucket. A text is the mean of its words' vectors, of their
squares, and of the products of each word's vector with the next one's. A
two-layer network learns from a bounded labelled sample; one temperature, fitted
on rows of the sample that it has not seen, makes its outputs probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import bounded_batches, materialize

#: Buckets of words, components of a vector, entries of an index vector that aren't zero, neighbours on either side.
BUCKETS, DIMS, ENTRIES, REACH = 1 << 15, 64, 4, 2
#: Most labelled rows the network is fitted on.
SAMPLE_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED, THRESHOLD = 32, 60, 128, 2e-3, 1e-4, 42, 0.3
#: Words seen this often stand half for themselves, half for the mean word.
SHRINK = 5
#: Words pooled at a time.
WORDS_AT_ONCE = 1 << 15

_WORD = re.compile(r"[^\W_]+|[^\w\s]")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, and single marks; lower case but for words in capitals."""
    return [w if len(w) > 1 and w.isupper() else w.lower() for w in _WORD.findall(text or "")]


def buckets_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word, where each text begins and the last one ends)."""
    found = [words_of(t) for t in texts]
    number: dict[str, int] = {}
    for words in found:
        for w in dict.fromkeys(words):
            if w not in number:
                number[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % BUCKETS
    ends = np.cumsum([0, *map(len, found)])
    return np.fromiter((number[w] for words in found for w in words), np.int64, int(ends[-1])), ends


def index_vectors(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the entries that aren't zero, ENTRIES a bucket."""
    rng = np.random.default_rng(seed)
    places = rng.permuted(np.tile(np.arange(DIMS), (BUCKETS, 1)), axis=1)[:, :ENTRIES]
    return places, rng.choice([-1.0, 1.0], (BUCKETS, ENTRIES))


def add_contexts(sums: np.ndarray, buckets: np.ndarray, ends: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> None:
    """Add to sums[bucket] the index vectors of the neighbours of each word."""
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    flat, (places, signs) = sums.reshape(-1), index
    for step in range(1, min(REACH, len(buckets) - 1) + 1):
        same = text[step:] == text[:-step]
        a, b = buckets[:-step][same], buckets[step:][same]
        for word, neighbour in ((a, b), (b, a)):
            for e in range(ENTRIES):
                flat += np.bincount(word * DIMS + places[neighbour, e], signs[neighbour, e], len(flat))


def context_sums(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n, s0, s1, ...): words in each bucket and the sum of their neighbours' index vectors, over all rows."""
    columns = ["bucket", "n", *(f"s{d}" for d in range(DIMS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, n, sums = index_vectors(), np.zeros(BUCKETS, np.int64), np.zeros((BUCKETS, DIMS))
        for batch in batches:
            buckets, ends = buckets_of(batch.column(0).to_pylist())
            n += np.bincount(buckets, minlength=BUCKETS)
            add_contexts(sums, buckets, ends, index)
        seen = np.flatnonzero(n)
        for at in range(0, len(seen), 4096):
            part = seen[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part]), *(pa.array(sums[part, d].astype(np.int64)) for d in range(DIMS))], columns)

    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, ", ".join(f"{c} long" for c in columns))
    return parts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns[1:]))


def word_vectors(sums: DataFrame) -> np.ndarray:
    """BUCKETS x DIMS unit vectors (rare words' are shorter): mean contexts less the mean of all words. At most BUCKETS rows reach the driver."""
    told = materialize(sums, "quality-contexts").toArrow()
    n, total = np.zeros((BUCKETS, 1)), np.zeros((BUCKETS, DIMS))
    at = told["bucket"].to_numpy()
    n[at, 0] = told["n"].to_numpy()
    for d in range(DIMS):
        total[at, d] = told[f"s{d}"].to_numpy()
    centred = total - n * (total.sum(axis=0) / max(1.0, n.sum()))
    mean = centred / np.maximum(n, 1)
    unit = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)
    return (unit * (n / (n + SHRINK))).astype(np.float32)


def pool(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """A row a text: means of its words' vectors, of their squares, and of products of neighbours; zeros without words."""
    buckets, ends = buckets_of(texts)
    out = np.zeros((len(texts), 3 * DIMS))
    for row, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        for at in range(a, b, WORDS_AT_ONCE):  # parts overlap by a word, for its product
            v = vectors[buckets[at : min(b, at + WORDS_AT_ONCE + 1)]]
            own = v[:WORDS_AT_ONCE]
            out[row, :DIMS] += own.sum(axis=0)
            out[row, DIMS : 2 * DIMS] += (own * own).sum(axis=0)
            out[row, 2 * DIMS :] += (v[:-1] * v[1:]).sum(axis=0)
        out[row] /= max(1, b - a)
    return out


class Network:
    """Standardised input, one hidden layer, one logit divided by the temperature."""

    def __init__(self, *arrays: np.ndarray) -> None:
        self.arrays = arrays

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2, _ = self.arrays
        return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.arrays[-1], -500, 500)))


def _entropy(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits)) if len(y) else 0.0


def fit(x: np.ndarray, y: np.ndarray, unseen: np.ndarray, seed: int = SEED) -> Network:
    """Adam on the rows that aren't `unseen`; these choose the epoch that is kept, then the temperature."""
    rng = np.random.default_rng(seed)
    seen = ~unseen
    mean, scale = x[seen].mean(axis=0), x[seen].std(axis=0) + 1e-6
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    z, t = (x[seen] - mean) / scale, y[seen]
    best, least, step = None, np.inf, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            hidden = np.tanh(z[rows] @ w[0] + w[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -500, 500))) - t[rows]) / len(rows)
            back = error[:, None] * w[2] * (1 - hidden * hidden)
            slopes = [z[rows].T @ back + DECAY * w[0], back.sum(axis=0), hidden.T @ error + DECAY * w[2], np.array([error.sum()])]
            step += 1
            for p, g, mean_g, square_g in zip(w, slopes, m, v, strict=True):
                mean_g += 0.1 * (g - mean_g)
                square_g += 0.001 * (g * g - square_g)
                p -= RATE * (mean_g / (1 - 0.9**step)) / (np.sqrt(square_g / (1 - 0.999**step)) + 1e-8)
        network = Network(mean, scale, *(p.copy() for p in w), np.ones(1))
        loss = _entropy(network.logits(x[unseen]), y[unseen]) if unseen.any() else -step
        if loss < least:
            best, least = network, loss
    if unseen.any():
        logits = best.logits(x[unseen])
        temperatures = np.exp(np.linspace(np.log(0.25), np.log(8), 200))
        best.arrays[-1][:] = temperatures[int(np.argmin([_entropy(logits / c, y[unseen]) for c in temperatures]))]
    return best


def _remainder(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, quality) of at most `rows` labelled ids of docs, none held out, drawn by hash. Of several labels of an id the least counts."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("double")).alias("quality"))
    known = known.where(_remainder("doc_id") != 0).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "quality-sample")


def trained(docs: DataFrame, sample: DataFrame, vectors: np.ndarray) -> Network | None:
    """The network fitted in one task on the pooled vectors of the sample's texts, which other tasks have made; None unless both classes are there."""
    spark = docs.sparkSession
    if sample.select(F.col("quality") > 0).distinct().count() < 2:
        return None
    shared = spark.sparkContext.broadcast(vectors)
    drawn = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # sample: at most SAMPLE_ROWS rows

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pool(batch.column(2).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    def learn(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        x = np.stack([np.frombuffer(r) for r in group["x"].to_pylist()])
        network = fit(x, (group["quality"].to_numpy() > 0).astype(float), group["doc_id"].to_numpy() * 2654435761 % 1000 < 200)
        return pa.table({"part": list(range(len(network.arrays))), "shape": [list(a.shape) for a in network.arrays], "data": [a.tobytes() for a in network.arrays]}, pa.schema([("part", pa.int32()), ("shape", pa.list_(pa.int32())), ("data", pa.binary())]))

    rows = materialize(drawn.select("doc_id", "quality", "text").mapInArrow(pooled, "doc_id long, quality double, x binary"), "quality-training")
    parts = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(learn, "part int, shape array<int>, data binary").orderBy("part").collect()  # one network
    return Network(*(np.frombuffer(r["data"]).reshape(r["shape"]) for r in parts))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of docs.

    Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0, at
    most sample_rows of them; word vectors come from all texts. Of a doc_id with
    several labels the least counts, of several texts the smallest is learned from;
    null labels teach nothing. Null, empty and blank texts pool to zeros and are
    scored. Rows without a doc_id are scored and not held out; repeated rows get
    equal scores. Without both classes among the labels every score is 0.5. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    vectors = word_vectors(context_sums(docs))
    network = trained(docs, labelled_sample(docs, labels, sample_rows), vectors)
    shared = spark.sparkContext.broadcast((vectors, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = shared.value
        for batch in batches:
            x = pool(batch.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x) if model else np.full(len(x), 0.5))], ["doc_id", "score"])

    held_out = F.coalesce(_remainder("doc_id") == 0, F.lit(False)).alias("held_out")
    return docs.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
