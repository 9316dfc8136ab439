"""Best-fit packing of documents into sequences, mended by swap-based local search.

Only lengths are packed. Documents are tokenized once into pieces; a full piece
is a sequence by itself. The shorter ones are dealt to buckets of bounded size
and each bucket is packed by best fit in descending order, then improved: items
of the emptiest bin are moved to, or exchanged one-for-one and two-for-one with,
other underfull bins so that the sum of squared fills grows, until bins empty.
The items of bins that stay open meet again, in buckets of the same size, in a
second round. Bins are found by room and by the lengths they hold, so a step costs
the same however many there are.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import bounded_batches, materialize
from folium.llm.tokens import default_tokenizer, encoder

CAPACITY, BUCKET_PIECES, OPEN_BELOW = 1024, 16_384, 0.97


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: longest first, each to the open bin with the least room that takes it."""
    bins = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = n = 0  # rooms: bit r is set while a bin has room r
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[item] = b
        by_room[room - length].append(b)
        rooms |= 1 << (room - length)
    return bins


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound: items above half need bins of their own, and what doesn't fit beside those of at most capacity - k needs more, if it is at least k long."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    weight = count * np.arange(capacity + 1)
    n, w = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(weight)]
    half = capacity // 2
    k = np.arange(half + 1)
    beside = n[capacity - k + 1] - n[half + 1]  # above half, at most capacity - k
    room = beside * capacity - (w[capacity - k + 1] - w[half + 1])
    small = w[half + 1] - w[k]
    return int((n[-1] - n[half + 1] + np.maximum(0, -(-(small - room) // capacity))).max())


class _Bins:
    """Open bins, found by their room and by the lengths of their items."""

    def __init__(self, lengths: list[int], bins: list[int], capacity: int) -> None:
        self.capacity, self.lengths = capacity, lengths
        self.items: list[list[int]] = [[] for _ in range(max(bins, default=-1) + 1)]
        for item, b in enumerate(bins):
            self.items[b].append(item)
        self.fill = [sum(lengths[i] for i in x) for x in self.items]
        self.by_room: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.rooms = 0  # bit r: an open bin has room r
        self.holders: dict[tuple[int, int], set[int]] = {}
        self.rooms_of = [0] * (capacity + 1)  # bit r at length L: an open bin with room r holds an L
        self.top = np.full(capacity + 1, -1, np.int64)  # greatest such room
        for b in range(len(self.items)):
            self.enter(b)

    def _note(self, length: int) -> None:
        self.top[length] = self.rooms_of[length].bit_length() - 1

    def enter(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        if room and self.items[b]:
            self.by_room[room].add(b)
            self.rooms |= 1 << room
            for length in {self.lengths[i] for i in self.items[b]}:
                self.holders.setdefault((length, room), set()).add(b)
                self.rooms_of[length] |= 1 << room
                self._note(length)

    def leave(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        if room and self.items[b]:
            self.by_room[room].discard(b)
            if not self.by_room[room]:
                self.rooms &= ~(1 << room)
            for length in {self.lengths[i] for i in self.items[b]}:
                held = self.holders[length, room]
                held.discard(b)
                if not held:
                    self.rooms_of[length] &= ~(1 << room)
                    self._note(length)

    def step(self, victim: int) -> tuple[list[int], list[int], int] | None:
        """(items that leave the victim, items that come back, the other bin) of the step that moves the most, or None; the victim itself isn't entered."""
        alike: dict[int, list[int]] = {}
        for i in self.items[victim]:
            alike.setdefault(self.lengths[i], []).append(i)
        groups: dict[tuple[int, int], list[int]] = {}
        for a, x in alike.items():
            groups.setdefault((1, a), x[:1])
            for b, y in alike.items():
                if a < b or a == b and len(x) > 1:
                    groups.setdefault((2, a + b), [x[0], y[-1]])
        best: tuple[int, list[int], list[int], int] = (0, [], [], -1)
        for (n, size), group in groups.items():
            if size <= best[0]:
                continue
            fitting = self.rooms >> size
            if n == 1 and fitting:  # move
                best = (size, group, [], next(iter(self.by_room[size + (fitting & -fitting).bit_length() - 1])))
                continue
            # one for one, two for one: the shorter what comes back, the more is moved
            for length in (np.flatnonzero(self.top[1:size] >= np.arange(size - 1, 0, -1)) + 1).tolist():
                delta = size - length
                if delta <= best[0]:
                    break
                wide = self.rooms_of[length] >> delta
                room = delta + (wide & -wide).bit_length() - 1
                # squared fill grows when the other bin ends fuller than the victim was
                if self.capacity - room + delta > self.fill[victim]:
                    other = next(iter(self.holders[length, room]))
                    best = (delta, group, [next(i for i in self.items[other] if self.lengths[i] == length)], other)
                    break
        return best[1:] if best[0] else None

    def apply(self, victim: int, out: list[int], back: list[int], other: int) -> None:
        self.leave(other)
        for items, a, b in ((out, victim, other), (back, other, victim)):
            for i in items:
                self.items[a].remove(i)
                self.items[b].append(i)
                self.fill[a] -= self.lengths[i]
                self.fill[b] += self.lengths[i]
        self.enter(other)


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Empty bins while that is possible: each step raises the sum of squared fills; the number of bins never grows."""
    spare = len(np.unique(bins)) - least_bins(lengths, capacity)
    if spare <= 0:
        return bins
    state = _Bins(lengths.tolist(), bins.tolist(), capacity)
    queue = [(f, b) for b, f in enumerate(state.fill) if 0 < f < capacity]
    heapq.heapify(queue)
    tried: set[int] = set()
    while spare > 0 and queue:
        f, victim = heapq.heappop(queue)
        if victim in tried or state.fill[victim] != f:
            continue
        tried.add(victim)
        state.leave(victim)
        while state.fill[victim] and (step := state.step(victim)):
            state.apply(victim, *step)
            if step[2] not in tried and state.fill[step[2]] < capacity:
                heapq.heappush(queue, (state.fill[step[2]], step[2]))
        state.enter(victim)
        spare -= state.fill[victim] == 0
    out = np.empty(len(lengths), np.int64)
    for b, items in enumerate(state.items):
        out[items] = b
    return out


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each item of 1 to capacity."""
    return local_search(lengths, best_fit(lengths, capacity), capacity)


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents with their end id; the first piece takes the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_batch
        for batch in batches:
            ids, offsets = encode(batch.column(1), end_id)
            size = np.diff(offsets)
            count = -(-size // capacity)
            first = size - (count - 1) * capacity
            row = np.repeat(np.arange(len(size)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[row])
            at = offsets[row] + start
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        encoder(tokenizer).release()

    ready = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return ready.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _packed(short: DataFrame, capacity: int) -> DataFrame:
    """(uid, length, bucket) packed bucket by bucket: (uid, length, bucket, bin, place, fill)."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("uid", ignore_index=True)
        lengths = group["length"].to_numpy(np.int64)
        bins = pack_lengths(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        by_bin, size = bins[order], lengths[order]
        before = np.cumsum(size) - size
        starts = np.flatnonzero(np.r_[True, by_bin[1:] != by_bin[:-1]])
        place = np.empty(len(group), np.int64)
        place[order] = before - np.repeat(before[starts], np.diff(np.r_[starts, len(group)]))
        return group[["uid", "length", "bucket"]].assign(bin=bins, place=place, fill=np.bincount(bins, lengths).astype(np.int64)[bins])

    return short.groupBy("bucket").applyInPandas(run, "uid long, length long, bucket long, bin long, place long, fill long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, end_id: int = 2, capacity: int = CAPACITY, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every token of docs in sequences of at most `capacity`.

    Null texts are empty ones: their piece is the end id. Rows without a doc_id and
    repeated rows are packed like any other. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    cut = pieces(docs, id_col, text_col, tokenizer or default_tokenizer(), end_id, capacity)
    cut = materialize(cut.withColumn("uid", F.monotonically_increasing_id()), "packing-pieces")
    short = cut.where(F.col("length") < capacity).select("uid", "length")
    n_buckets = max(1, -(-short.count() // bucket_pieces))
    first = materialize(_packed(short.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(n_buckets))), capacity), "packing-first")
    closed = first.where(F.col("fill") >= OPEN_BELOW * capacity)
    again = first.where(F.col("fill") < OPEN_BELOW * capacity).select("uid", "length")
    n_again = max(1, -(-again.count() // bucket_pieces))
    again = again.withColumn("bucket", F.pmod(F.xxhash64("uid", F.lit(n_buckets)), F.lit(n_again)))
    second = _packed(again, capacity)
    sequence = lambda round_: (F.shiftleft(F.col("bucket"), 32) + F.col("bin")) * 4 + round_
    placed = closed.select("uid", sequence(1).alias("sequence_id"), F.col("place").alias("offset")).unionByName(
        second.select("uid", sequence(2).alias("sequence_id"), F.col("place").alias("offset"))
    )
    joined = cut.join(placed, "uid", "left")
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", F.col("uid") * 4).alias("sequence_id"), F.coalesce("offset", F.lit(0).cast("long")).alias("offset"))
