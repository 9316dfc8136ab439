"""Periodic runs of words: Lyndon arrays from a suffix sorter's first phase, extended to runs.

A run is a stretch of words with smallest period q, at least twice as long as q,
that keeps its period in neither direction. Every run holds a Lyndon root: a
factor of one period that is the longest Lyndon word at its start, in the order
of words or in the reversed one. Baier's grouping, the first phase of a linear
suffix sorter, puts suffixes into groups of equal longest Lyndon words, highest
first, so that a group's context length is an entry of the Lyndon array. Each
entry under either order is a candidate root; how far its period holds to the
right and to the left are two longest common extensions, answered for all
candidates at once by names of words in stretches of doubling length.

Every word of a run of 12 or more lies in a stretch of six words that stands
elsewhere in the text too (a period's distance away). Only such stretches are
sorted, the texts of a batch side by side between separators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import bounded_batches

#: Fewest words of a run.
LEAST_WORDS = 12
#: Greatest exponent of a doubling table: longer extensions repeat its step, so tables stay at 13 numbers a word.
TOP_LEVEL = 12


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words as equal numbers, in the order of first appearance."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def repeated_stretches(numbers: np.ndarray, words: int) -> np.ndarray:
    """(start, end) rows of the stretches covered by sequences of `words` words that occur twice or more."""
    n = len(numbers) - words + 1
    if n < 2:
        return np.empty((0, 2), np.int64)
    name = numbers
    size = 1
    while size < words:  # names of equal sequences, of doubling length as far as they overlap in `words`
        step = min(size, words - size)
        left, right = name[: len(name) - step], name[step:]
        name = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]
        size += step
    again = np.bincount(name)[name] > 1
    edge = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + words, -1)
    covered = np.r_[False, np.cumsum(edge[:-1]) > 0, False]
    change = np.flatnonzero(covered[1:] != covered[:-1])
    return change.reshape(-1, 2)


def lyndon_array(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place, by Baier's grouping.

    Suffixes start in groups by their first symbol. Groups are taken from the
    highest down. Each suffix of the group in hand is a word that the nearest
    suffix before it, of a lower group, extends its own by; those that extend by
    more copies go to a higher new group right above the one they leave.
    """
    n = len(symbols)
    _, first = np.unique(symbols, return_inverse=True)
    order = np.argsort(first, kind="stable")
    bounds = np.searchsorted(first[order], np.arange(int(first.max(initial=-1)) + 2))
    listed = order.tolist()
    members = [listed[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    group = first.tolist()
    length = [1] * len(members)  # context of each group
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    before = [-2] * n  # nearest suffix to the left in a lower group, -2 while unknown
    g = len(members) - 1
    while g >= 0:
        size = length[g]
        moved: dict[tuple[int, int], list[int]] = {}
        last, copies = -1, 0
        for i in members[g]:
            if group[i] != g:
                continue
            j = i - 1
            while j >= 0 and before[j] != -2:
                j = before[j]
            before[i] = j
            if j < 0:
                continue
            if j == last:
                copies += 1
                continue
            if copies:
                moved.setdefault((group[last], copies), []).append(last)
            last, copies = j, 1
        if copies:
            moved.setdefault((group[last], copies), []).append(last)
        # more copies first: each new group lies right above the old one, below those made before it
        for (old, times), suffixes in sorted(moved.items(), reverse=True) if len(moved) > 1 else moved.items():
            new = len(members)
            members.append(suffixes)
            length.append(length[old] + times * size)
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = new
            if up >= 0:
                below[up] = new
            for i in suffixes:
                group[i] = new
        g = below[g]
    return np.array(length, np.int64)[group] if n else np.empty(0, np.int64)


class Extensions:
    """Longest common extensions of many pairs of places at once, by names of stretches of doubling length."""

    def __init__(self, symbols: np.ndarray) -> None:
        names = np.unique(symbols, return_inverse=True)[1].astype(np.int32)
        self.n, self.levels = len(symbols), [names]
        while len(self.levels) <= TOP_LEVEL and len(names) > (step := 1 << (len(self.levels) - 1)):
            left, right = names[:-step].astype(np.int64), names[step:]
            names = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1].astype(np.int32)
            if int(names.max()) + 1 == len(names):  # no stretch of this length stands twice
                break
            self.levels.append(names)

    def __call__(self, a: np.ndarray, b: np.ndarray, backward: bool = False) -> np.ndarray:
        """How many symbols from places a and b on (or before them) are equal; a < b."""
        total = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step, names = 1 << k, self.levels[k]
            todo = np.arange(len(a))
            while len(todo):
                x, y = (c[todo] - total[todo] - step if backward else c[todo] + total[todo] for c in (a, b))
                inside = (x >= 0) & (y + step <= self.n)
                equal = np.zeros(len(todo), bool)
                equal[inside] = names[x[inside]] == names[y[inside]]
                todo = todo[equal]
                total[todo] += step
                if k < len(self.levels) - 1:  # below the top a step fits once at most
                    break
        return total


def find_runs(symbols: np.ndarray, least: int = LEAST_WORDS) -> np.ndarray:
    """(start, length, period) rows of all runs of at least `least` symbols; negative symbols are separators, each unlike all others."""
    n = len(symbols)
    if not n:
        return np.empty((0, 3), np.int64)
    places = np.arange(n)
    extend = Extensions(symbols)
    found = []
    # separators are the least in both orders, so no Lyndon word of a text crosses one
    for ordered in (symbols, np.where(symbols < 0, -1, int(symbols.max()) + 1 - symbols)):
        period = lyndon_array(np.where(symbols < 0, -1, ordered))
        end = np.minimum(places + period, n)
        goes_on = (places + period < n) & (symbols == symbols[np.minimum(end, n - 1)]) | (places > 0) & (symbols[places - 1] == symbols[end - 1])
        at = np.flatnonzero(goes_on & (symbols >= 0))
        p = period[at]
        right, left = extend(at, at + p), extend(at, at + p, backward=True)
        run = (left + right >= p) & (left + right + p >= least)
        found.append(np.stack([at[run] - left[run], (left + right + p)[run], p[run]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def batch_runs(texts: list[list[bytes]], least: int = LEAST_WORDS) -> list[np.ndarray]:
    """The runs of each text's words: rows (start, length, period), ascending by start, then period."""
    parts, owner, shift, at = [], [], [], 0
    for t, words in enumerate(texts):
        if len(words) < least:
            continue
        numbers = word_numbers(words)
        for a, b in repeated_stretches(numbers, max(1, least // 2)).tolist():
            if b - a >= least:
                parts += [numbers[a:b], np.array([-1 - len(owner)])]
                owner.append(t)
                shift.append(a - at)
                at += b - a + 1
    runs = find_runs(np.concatenate(parts), least) if parts else np.empty((0, 3), np.int64)
    starts = np.cumsum([0, *(len(p) for p in parts)])[::2][: len(owner)]
    of = np.searchsorted(starts, runs[:, 0], "right") - 1
    runs[:, 0] += np.array(shift, np.int64)[of] if len(of) else 0
    texts_of = np.array(owner, np.int64)[of] if len(of) else of
    order = np.lexsort((runs[:, 2], runs[:, 0], texts_of))
    runs, texts_of = runs[order], texts_of[order]
    cuts = np.searchsorted(texts_of, np.arange(len(texts) + 1))
    return [runs[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, of each run the first period alone, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, runs array<struct<start, length, period>>, collapsed string): one row per row of docs.

    Words are what ASCII white space parts, numbered from 0; a run has at least
    `least_words` of them and twice its period. Runs lie by start, then period.
    `collapsed` keeps of each run its first period only. Null and empty texts have
    no runs and an empty `collapsed`; rows without a doc_id and repeated rows are
    worked on like any other; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or b"").split() for t in batch.column(1).to_pylist()]
            runs = batch_runs(texts, least_words)
            flat = np.concatenate([np.empty((0, 3), np.int64), *runs])
            structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), structs)
            kept = pa.array([collapsed(w, r) for w, r in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, kept], ["doc_id", "runs", "collapsed"])

    ready = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return ready.mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): a tenth of the texts, by crc32 of the doc_id, made periodic from a word on; the others and those without a doc_id as they are."""
    number = F.col(id_col).cast("long")
    hashed = docs.select(number.alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.crc32(number.cast("string").cast("binary")).alias("h"))
    chosen = F.coalesce(F.col("h") % 10 == 0, F.lit(False))
    words = F.when(chosen, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0))
    split = hashed.select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"), words.alias("words"))
    sized = split.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    period = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    planned = sized.withColumn("p", period).withColumn("times", F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))
    repeated = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.col("times")))
    made = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), repeated), F.lit(1), F.col("n")), " ")
    return planned.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def run_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): periodic_runs of docs with planted periods, as numbers and hashes.

    The run shown is the longest, then of the smallest start, then period; without a run its four columns are null.
    """
    found = periodic_runs(with_planted_periods(docs, id_col, text_col))
    one = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(F.transform("runs", one), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("best.less")
    return told.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
