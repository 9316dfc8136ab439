"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Every id is replaced by its rank by frequency over the whole corpus, so common
ids need one byte. Ranks take 1 to 4 bytes; the lengths stand apart, four to a
control byte, so numpy decodes a block by one table lookup and one scatter. A
file holds blocks of whole documents in ascending doc_id order as rows of a
Parquet table (Spark's writer commits them on any store), beside a table of ranks.

Tokens are produced once into the shared folder; the order comes from a range
partitioning of the compressed ids; only the ranks (at most one row an id of the
vocabulary) and one total a partition reach the driver.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import batch_columns, bounded_batches, materialize, shared_dir
from folium.llm.tokens import default_tokenizer, encoder

#: Ids after which a block of whole documents is closed.
BLOCK_IDS = 1 << 16

_TOKENS = ["doc_id", "n", "blob", "counts"]

_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)
_BYTE = np.arange(4, dtype=np.uint8)


def pack_ids(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    values = values.astype("<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    padded[: len(code)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[_BYTE <= code[:, None]].tobytes()


def unpack_ids(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[_BYTE < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def _tokenized(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, n, blob, counts): ids of each document with the end id, zstandard over their two- or four-byte form.

    The last row of a task has no document but the task's counts of each id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, squeeze, counts = encoder(tokenizer).encode_batch, zstandard.ZstdCompressor(level=1).compress, np.zeros(1, np.int64)
        for batch in batches:
            ids, offsets = encode(batch.column(1), end_id)
            seen = np.bincount(ids)
            counts = np.pad(counts, (0, max(0, len(seen) - len(counts))))
            counts[: len(seen)] += seen
            wide = len(seen) > 1 << 16
            mark, raw = (b"\4", ids) if wide else (b"\2", ids.astype("<u2"))
            blobs = [squeeze(mark + raw[a:b].tobytes()) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets).astype(np.int32)), pa.array(blobs, pa.binary()), pa.nulls(len(blobs), pa.binary())], _TOKENS)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], _TOKENS)

    ready = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return ready.mapInArrow(run, "doc_id long, n int, blob binary, counts binary")


def _widen(raw: bytes) -> np.ndarray:
    """Ids of two or four bytes, as the first byte tells."""
    return np.frombuffer(raw, "<u4" if raw[0] == 4 else "<u2", offset=1).astype(np.uint32)


def frequencies(tokens: DataFrame) -> DataFrame:
    """(id, count) over all documents: the tasks' counts, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                counts = np.frombuffer(raw, np.int64)
                ids = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(counts[ids])], ["id", "count"])

    held = tokens.where("counts is not null").select("counts")
    return held.mapInArrow(run, "id int, count long").groupBy("id").agg(F.sum("count").alias("count"))


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, end_id: int = 2, partitions: int | None = None) -> None:
    """Write path/blocks and path/ranks for every row of docs, in ascending doc_id order (null first).

    Null texts are empty ones and hold the end id alone. Rows of equal doc_id are
    all kept, in an order fixed by their ids. An empty table gives empty tables.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    tokens = materialize(_tokenized(docs, id_col, text_col, tokenizer or default_tokenizer(), end_id), "token-ids", compression="none")
    ranked = frequencies(tokens).orderBy(F.desc("count"), "id").select("id", "count").collect()  # at most the vocabulary
    spark.createDataFrame([(r, x["id"], x["count"]) for r, x in enumerate(ranked)], "rank int, id int, count long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max((x["id"] for x in ranked), default=0) + 1, np.uint32)
    rank_of[[x["id"] for x in ranked]] = np.arange(len(ranked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, expand = TaskContext.get().partitionId(), zstandard.ZstdDecompressor().decompress
        block = start = 0
        ids: list[int | None] = []
        values: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal block, start
            flat = np.concatenate(values)
            control, data = pack_ids(rank_of[flat])
            row = {"part": part, "block": block, "start": start, "n_ids": len(flat), "doc_ids": list(ids), "counts": [len(v) for v in values], "control": control, "data": data}
            block, start = block + 1, start + len(flat)
            ids.clear(), values.clear()
            return pa.RecordBatch.from_pylist([row], _BLOCKS)

        held = 0
        for batch in batches:
            for doc_id, blob in zip(*batch_columns(batch, "doc_id", "blob"), strict=True):
                ids.append(doc_id)
                values.append(_widen(expand(blob)))
                held += len(values[-1])
                if held >= BLOCK_IDS:
                    yield close()
                    held = 0
        if ids:
            yield close()

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.where("counts is null").withColumn("h", F.xxhash64("blob")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "blob")
    ordered.mapInArrow(run, _BLOCKS_DDL).write.option("compression", "zstd").parquet(f"{path}/blocks")


_BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("control", pa.binary()), ("data", pa.binary())])
_BLOCKS_DDL = "part int, block int, start long, n_ids long, doc_ids array<long>, counts array<int>, control binary, data binary"


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary): documents of the files with their ids as little-endian unsigned 32-bit integers."""
    return _decoded(spark, path, "ids binary", lambda ids: pa.array([x.tobytes() for x in ids], pa.binary()))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): as read_token_files, with the ids' checksum in their place."""
    return _decoded(spark, path, "ids_crc32 long", lambda ids: pa.array([zlib.crc32(x) for x in ids], pa.int64()))


def _decoded(spark: SparkSession, path: str, column: str, of) -> DataFrame:
    bounded_batches(spark)
    ranks = spark.read.schema("rank int, id int").parquet(f"{path}/ranks").orderBy("rank").collect()
    id_of = np.array([x["id"] for x in ranks], np.uint32)
    blocks = spark.read.schema(_BLOCKS_DDL).parquet(f"{path}/blocks")
    totals = {x["part"]: x["n"] for x in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one a partition
    base, before = {}, 0
    for part in sorted(totals):
        base[part], before = before, before + totals[part]
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ids = id_of[unpack_ids(x["control"], x["data"], x["n_ids"])].astype("<u4")
                counts = np.array(x["counts"], np.int64)
                ends = np.cumsum(counts)
                starts = ends - counts
                each = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x["doc_ids"], pa.int64()), pa.array(starts + base[x["part"]] + x["start"]), pa.array(counts), of(each)], ["doc_id", "start", "n_tokens", name])

    return blocks.select("part", "start", "n_ids", "doc_ids", "counts", "control", "data").mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def token_file_digest(docs: DataFrame, **options) -> DataFrame:
    """Write the files of docs to the shared folder and read them back: (doc_id, start, n_tokens, ids_crc32)."""
    path = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, **options)
    return read_checksums(docs.sparkSession, path)
