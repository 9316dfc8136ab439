"""Toxicity: gradient-boosted trees over dense features with isotonic calibration.

Features of a text are densities and rates, none its length: hits of a short
fixed lexicon and of one learned from labelled rows (words, and beginnings of
words, since insults inflect), how near a hit stands to a
second-person word, capitals, punctuation, symbols, digits, and words with
characters swapped for look-alikes. The labelled sample (bounded by a parameter,
drawn by hash) is split in three: one part teaches the lexicon, two the trees,
which are calibrated on the half they have not seen. Everything is scored in Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from folium.llm.common import bounded_batches, materialize

#: Most labelled rows the model is fitted on, and words the learned lexicon holds.
SAMPLE_ROWS, LEARNED_WORDS = 20_000, 400
TREES, DEPTH, SEED, THRESHOLD = 12, 3, 42, 0.7

#: A starting lexicon and second-person words in the languages at hand.
LEXICON = frozenset(
    "idiot moron stupid loser pathetic scum worthless trash clown disgusting dumb fool jerk creep filth vermin garbage imbecile cretin "
    "dummkopf trottel abschaum versager ekelhaft blödmann wertlos "
    "imbécile crétin abruti ordure minable débile dégoûtant "
    "estúpido imbécil basura asqueroso inútil escoria tonto".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Look-alikes of letters.
LOOKALIKES = str.maketrans("013457@$!*", "oleastasi ")

FEATURES = ("lexicon", "learned", "disguised", "near_second_person", "second_person", "capitals", "exclamation", "punctuation", "symbols", "digits", "obfuscated")

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[a-z]+[0-9@$!*]+[a-z][a-z0-9@$!*]*")
_CAPITALS = re.compile("[A-ZÀ-ÖØ-Þ]+")
_NEAR = 6
#: Lengths of the word beginnings that the learned lexicon may hold, and how few texts an entry must be seen in.
STEMS, LEAST_SEEN = (4, 5, 6), 5


def _learned_hits(words: list[str], learned: frozenset[str]) -> int:
    gate = {w[: STEMS[0]] for w in learned}
    return sum(1 for w in words if w[: STEMS[0]] in gate and (w in learned or any(w[:k] in learned for k in STEMS if len(w) > k)))


def features(text: str | None, learned: frozenset[str]) -> list[float]:
    """FEATURES of a text; null and empty texts have zeros."""
    lower = (text or "").lower()
    words = _WORD.findall(lower)
    if not lower:
        return [0.0] * len(FEATURES)
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if w in LEXICON]
    found = _learned_hits(words, learned)
    spoken = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    mixed = _MIXED.findall(lower)
    disguised = sum(bool({m.translate(LOOKALIKES), m.translate(LOOKALIKES).replace(" ", "")} & LEXICON) for m in mixed)
    near = 0
    if hits and spoken:
        at = np.searchsorted(spoken, hits)
        s = np.array(spoken)
        gap = np.minimum(np.abs(s[np.minimum(at, len(s) - 1)] - hits), np.abs(s[np.maximum(at - 1, 0)] - hits))
        near = int((gap <= _NEAR).sum())
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = max(1, int(counts.sum()))
    letters = max(1, len("".join(words)))
    capitals = sum(map(len, _CAPITALS.findall(text)))
    return [
        len(hits) / n, found / n, disguised / n, near / n, len(spoken) / n, capitals / letters, counts[33] / size,
        counts[[34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum() / size, counts[[35, 36, 37, 38, 42, 43, 47, 61, 64, 94, 95, 124, 126]].sum() / size,
        counts[48:58].sum() / size, len(mixed) / n,
    ]


def _remainder(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))


def learned_lexicon(docs: DataFrame, sample: DataFrame, words: int = LEARNED_WORDS) -> frozenset[str]:
    """Words and beginnings of words that labelled-toxic texts use far more than others, equal texts counted once."""
    text = docs.join(F.broadcast(sample), "doc_id")  # sample: at most SAMPLE_ROWS rows
    seen = text.select("toxic", F.xxhash64("text").alias("content"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{3,})"), 1))).alias("whole"))
    entries = F.array(F.col("whole"), *(F.when(F.length("whole") > k, F.substring("whole", 1, k)) for k in STEMS))
    seen = seen.select("toxic", "content", F.explode(F.array_compact(entries)).alias("word"))
    per = seen.groupBy("word", "content").agg(F.max("toxic").alias("toxic")).groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    totals = sample.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    bad, good = (totals["bad"] or 0) + 1, (totals["good"] or 0) + 1
    odds = F.log((F.col("bad") + 0.5) / bad) - F.log((F.col("good") + 0.5) / good)
    kept = per.where(F.col("bad") >= LEAST_SEEN).withColumn("odds", odds).where("odds >= 4").orderBy(F.desc("odds"), F.desc("bad"), "word").limit(words)
    return frozenset(x["word"] for x in kept.select("word").collect())


def with_features(docs: DataFrame, learned: frozenset[str], text_col: str = "text") -> DataFrame:
    """docs with a column f array<double>."""
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField("f", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = pa.array([features(t, learned) for t in batch.column(at).cast(pa.string()).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, f], [*batch.schema.names, "f"])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of docs.

    Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1;
    a doc_id with several labels counts as toxic if one of them says so, null
    labels teach nothing. Null and empty texts have features of zero and are
    scored. Rows without a doc_id are scored and not held out. Without both
    classes among the labels the score is the fixed lexicon's density times 50,
    at most 1. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held_out = F.coalesce(_remainder("doc_id") == 1, F.lit(False)).alias("held_out")
    return score_rows(docs, labels, sample_rows=sample_rows, threshold=threshold).select("doc_id", held_out, "toxicity.score", "toxicity.predicted")


def score_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """docs, whose columns may not be called f or toxicity, with a column `toxicity` (score, predicted); learned as in toxicity(), scored without a shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("double")).alias("toxic"))
    known = known.where(_remainder("doc_id") != 1).join(named.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(3))), "toxicity-sample")
    parts = {(x["part"], x["toxic"] > 0) for x in sample.select("part", "toxic").distinct().collect()}  # at most sample_rows
    trainable = all((p, y) in parts for p in (1, 2) for y in (False, True))
    words = learned_lexicon(named, sample.where("part = 0").select("doc_id", "toxic")) if trainable else frozenset()
    featured = with_features(docs, words, text_col)
    if not trainable:
        score = F.least(F.lit(1.0), F.get("f", F.lit(0)) * 50)
        return featured.withColumn("toxicity", F.struct(score.alias("score"), (score >= threshold).cast("int").alias("predicted"))).drop("f")
    drawn = named.join(F.broadcast(sample.where("part > 0")), "doc_id").groupBy("doc_id", "part", "toxic").agg(F.min("text").alias("text"))  # at most sample_rows
    rows = materialize(with_features(drawn, words).select("doc_id", "part", "toxic", "f"), "toxicity-sampled")
    rows = rows.select("doc_id", "part", "toxic", array_to_vector("f").alias("features")).coalesce(1).sortWithinPartitions("doc_id")
    rows = materialize(rows, "toxicity-training")  # numbers alone, in a fixed order
    fit = lambda df: GBTClassifier(featuresCol="features", labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=3).fit(df)
    raw = lambda trees, df: trees.transform(df).withColumn("raw", vector_to_array("probability")[1])
    one, two = rows.where("part = 1"), rows.where("part = 2")
    # each half is scored by the trees of the other, so the curve sees no row its trees have seen
    unseen = raw(fit(one), two).unionByName(raw(fit(two), one)).select("raw", "toxic")
    curve = IsotonicRegression(featuresCol="raw", labelCol="toxic", predictionCol="calibrated").fit(unseen)
    # docs' own columns travel as one, so that none clashes with the model's
    ready = featured.select(F.struct(*docs.columns).alias("row"), array_to_vector("f").alias("features"))
    full = curve.transform(raw(fit(rows), ready).select("row", "raw"))
    # isotonic steps leave ties: the trees' own order breaks them by at most a hundredth
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * F.col("calibrated") + 0.01 * F.col("raw")))
    scored = full.select("row", score.alias("score"))
    return scored.select("row.*", F.struct("score", (F.col("score") >= threshold).cast("int").alias("predicted")).alias("toxicity"))
