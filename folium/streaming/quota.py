"""Request quotas with windows anchored at each key's first request."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folium.operators.scans import scan
from folium.sources.shared import written

LIMIT, WINDOW_MS = 20, 60_000
_STATE = "start long, count int"


def judge(times: list[int], start: int | None, count: int, limit: int = LIMIT, window: int = WINDOW_MS) -> tuple[list[bool], int | None, int]:
    """(allowed per request, window start, count): a request at or after the window's end opens a new one; refused ones aren't counted."""
    allowed = []
    for t in times:
        if start is None or t - start >= window:
            start, count = t, 0
        ok = count < limit
        count += ok
        allowed.append(ok)
    return allowed, start, count


#: Requests of a key that one task judges, at least; most blocks of a key; requests of a task that judges many keys.
BLOCK_REQUESTS, MOST_BLOCKS, CELL_REQUESTS = 1 << 18, 256, 1 << 17


def _followers(ts: np.ndarray, window: int) -> np.ndarray:
    """For each request the first one that is a window's length later, their number if none is."""
    return np.searchsorted(ts, ts + window)


def window_starts(ts: np.ndarray, window: int, opens: int | None) -> np.ndarray:
    """Requests that open a window, the first at or after `opens` (None: the first of all) and each the first after the one before it ends."""
    at = 0 if opens is None else int(np.searchsorted(ts, opens))
    follower, starts = _followers(ts, window).tolist(), []
    while at < len(ts):
        starts.append(at)
        at = follower[at]
    return np.array(starts, np.int64)


def last_starts(ts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(request, last start): for each request that may be the first to open a window here, the last one of the windows that follow, found by doubling."""
    n = len(ts)
    step = _followers(ts, window)
    step = np.where(step < n, step, np.arange(n))
    while not np.array_equal(further := step[step], step):
        step = further
    first = np.flatnonzero(np.r_[True, ts[1:] != ts[:-1]])
    first = first[: int(np.searchsorted(ts[first], ts[0] + window)) + 1]
    return first, step[first]


def _parts(group: pa.Table) -> tuple[pa.Table, list[tuple[int, int]]]:
    """A cell's rows in order, and where each of its blocks of a key begins and ends."""
    group = group.sort_by([("key", "ascending"), ("no", "ascending")])
    key, block = group["key"].combine_chunks().dictionary_encode(), group["block"].to_numpy()
    code = pc.fill_null(key.indices, -1).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])])
    return group, list(zip(cuts.tolist(), [*cuts[1:].tolist(), group.num_rows], strict=True))


def quota_flags(requests: DataFrame, limit: int = LIMIT, window_ms: int = WINDOW_MS, *, block_requests: int = BLOCK_REQUESTS) -> DataFrame:
    """(key, id, ts_ms, allowed) of requests(key, id, ts_ms), in the order of time, then id.

    A key's requests are numbered and cut into blocks. A window that is open where
    a block begins is known by its first request alone; each block tells, for the
    requests that may open the first window in it, the last window they lead to,
    and a key's few blocks are followed from its first request. Then all blocks are
    judged side by side: a request is allowed if it is among the first `limit` of
    its window. Rows without a time are refused; those without a key are one key.
    """
    numbered = scan(requests.select("key", "id", "ts_ms").where("ts_ms is not null"), ["key"], ["ts_ms", "id"], {"no": ("number", F.lit(1))})
    numbered = written(numbered.select(F.col("key").cast("string"), F.col("id").cast("long"), F.col("ts_ms").cast("long"), "no"), "quota-requests")
    size = numbered.agg(F.max("no").alias("most"), F.count(F.lit(1)).alias("all")).first()
    per = max(block_requests, -(-(size["most"] or 0) // MOST_BLOCKS))
    cells = max(1, -(-size["all"] // CELL_REQUESTS))
    blocked = numbered.withColumn("block", F.floor((F.col("no") - 1) / per).cast("long"))
    blocked = blocked.withColumn("cell", F.pmod(F.xxhash64("key", "block"), F.lit(cells)))
    entered = blocked.withColumns({"open_ts": F.lit(None).cast("long"), "open_no": F.lit(None).cast("long")})
    if (size["most"] or 0) > per:
        k = F.col("entry_key").eqNullSafe(F.col("key")) & (F.col("entry_block") == F.col("block"))
        entered = blocked.join(_entries(blocked, window_ms), k, "left").drop("entry_key", "entry_block")

    def run(group: pa.Table) -> pa.Table:
        group, parts = _parts(group)
        ts, no, open_ts, open_no = (group[c].to_numpy() for c in ("ts_ms", "no", "open_ts", "open_no"))
        began = np.empty(len(ts), np.int64)
        for a, b in parts:
            crossing = None if np.isnan(open_ts[a]) else int(open_ts[a]) + window_ms
            starts = window_starts(ts[a:b], window_ms, crossing)
            which = np.searchsorted(starts, np.arange(b - a), "right") - 1
            own = no[a:b][starts[np.maximum(which, 0)]] if len(starts) else np.zeros(b - a, np.int64)
            began[a:b] = np.where(which >= 0, own, 0 if crossing is None else int(open_no[a]))
        return group.select(["key", "id", "ts_ms"]).append_column("allowed", pa.array(no - began < limit))

    judged = entered.groupBy("cell").applyInArrow(run, "key string, id long, ts_ms long, allowed boolean")
    return judged.unionByName(requests.where("ts_ms is null").select("key", F.col("id").cast("long").alias("id"), F.col("ts_ms").cast("long").alias("ts_ms"), F.lit(False).alias("allowed")))


def _entries(blocked: DataFrame, window: int) -> DataFrame:
    """(entry_key, entry_block, open_ts, open_no): the first request of the window that is open where a block begins."""

    def tell(group: pa.Table) -> pa.Table:
        group, parts = _parts(group)
        ts, no = group["ts_ms"].to_numpy(), group["no"].to_numpy()
        at, to, ends = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b in parts:
            first, last = last_starts(ts[a:b], window)
            at.append(a + first)
            to.append(a + last)
            ends.append(np.full(len(first), ts[b - 1]))
        at, to = np.concatenate(at), np.concatenate(to)
        rows = group.select(["key", "block", "ts_ms"]).take(pa.array(at))
        return rows.append_column("last_ts", pa.array(ts[to])).append_column("last_no", pa.array(no[to])).append_column("ends", pa.array(np.concatenate(ends)))

    def follow(group: pa.Table) -> pa.Table:
        group = group.sort_by([("block", "ascending"), ("ts_ms", "ascending")])
        block, ts, last_ts, last_no, ends = (group[c].to_numpy() for c in ("block", "ts_ms", "last_ts", "last_no", "ends"))
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist()
        state, out = None, []
        for a, b in zip(cuts, [*cuts[1:], len(block)], strict=True):
            if state:
                out.append((a, *state))
            if state is None or state[0] + window <= ends[a]:
                i = a + (0 if state is None else int(np.searchsorted(ts[a:b], state[0] + window)))
                state = (int(last_ts[i]), int(last_no[i]))
        rows = group.select(["key", "block"]).take(pa.array([a for a, _, _ in out], pa.int64()))
        return rows.append_column("open_ts", pa.array([t for _, t, _ in out], pa.int64())).append_column("open_no", pa.array([n for _, _, n in out], pa.int64())).rename_columns(["entry_key", "entry_block", "open_ts", "open_no"])

    told = blocked.groupBy("cell").applyInArrow(tell, "key string, block long, ts_ms long, last_ts long, last_no long, ends long")
    return told.groupBy("key").applyInArrow(follow, "entry_key string, entry_block long, open_ts long, open_no long")


def quota_stream(requests: DataFrame, limit: int = LIMIT, window_ms: int = WINDOW_MS) -> DataFrame:
    """The same over a stream of requests(key, id, ts timestamp) with a watermark on ts.

    State is a start and a count a key; it goes once the watermark has passed the
    window. Requests before the state's start came too late and are refused.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"], ignore_index=True)
        ms = (rows["ts"].astype("datetime64[ms]").astype("int64")).tolist()
        late = [start is not None and t < start for t in ms]
        flags, start, count = judge([t for t, x in zip(ms, late, strict=True) if not x], start, count, limit, window_ms)
        given = iter(flags)
        if start is not None:
            state.update((start, count))
            state.setTimeoutTimestamp(max(start + window_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "id": rows["id"], "ts_ms": ms, "allowed": [False if x else next(given) for x in late]})

    return requests.groupBy("key").applyInPandasWithState(run, "key string, id long, ts_ms long, allowed boolean", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
