"""Chunking: paragraphs, oversized pieces, greedy packing with overlap, safety splits.

A run is a stretch that no chunk crosses. Only token counts and row numbers travel
to the packer, in blocks of a bounded number of tokens; the texts are joined back
by row number.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from functools import reduce
from itertools import accumulate
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from folium.functions.text import page_label, strip_ws
from folium.operators.scans import scan
from folium.sources.shared import written

TARGET, OVERLAP, LIMIT, SPECIAL = 395, 80, 512, 2
#: One rule for both counters: runs of letters, digits and marks, and single other visible characters.
_RULE = r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\t-\r ]"
_TOKEN, _ASCII_TOKEN = regex.compile(_RULE), re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\t-\r ]")


def count_words(text: str) -> int:
    """The default counter: runs of letters and digits, and single marks. Texts joined by white space have the sum of their counts."""
    return len((_ASCII_TOKEN if text.isascii() else _TOKEN).findall(text))


def count_tokens(c: Column | str, counter: Callable[[str], int] | None = None) -> Column:
    """Tokens of a text by a pluggable counter, of many texts at once if it has a method `many`; the default one stays in the JVM. Null texts have none."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    many = getattr(counter, "many", None)
    if counter is None:
        return F.size(F.regexp_extract_all(c, F.lit(_RULE), 0))

    @pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(many(texts.tolist()), dtype="int32") if many else texts.map(counter)

    return run(c)


def paragraphs(pages: DataFrame, sep: str = r"\n\s*\n") -> DataFrame:
    """pages with one row for each paragraph: para_no and its trimmed text, empty ones left out."""
    trimmed = F.filter(F.transform(F.split("text", sep), strip_ws), lambda p: p != "")
    rest = [c for c in pages.columns if c != "text"]
    return pages.select(*rest, F.posexplode(trimmed).alias("para_no", "text"))


def split_oversized(units: DataFrame, target: int = TARGET, limit: int = LIMIT, counter: Callable[[str], int] | None = None) -> DataFrame:
    """Paragraphs above the target as sentences, sentences above the limit as lines; `piece` keeps their order, `split` marks them."""
    count = lambda: count_tokens("text", counter)
    rest = [c for c in units.columns if c != "text"]
    # a text is counted where it is new alone
    counted = units.withColumn("n", count()).withColumn("split", F.col("n") > target)
    parts = counted.select(*rest, "split", "n", F.posexplode(F.when(F.col("split"), F.split("text", r"(?<=[.!?])\s+")).otherwise(F.array("text"))).alias("sentence", "text"))
    recounted = parts.withColumn("n", F.when(F.col("split"), count()).otherwise(F.col("n"))).withColumn("longer", F.col("split") & (F.col("n") > limit - SPECIAL))
    again = recounted.select(*rest, "split", "sentence", "n", "longer", F.col("text").alias("uncut"), F.posexplode(F.when(F.col("longer"), F.split("text", "\n")).otherwise(F.array("text"))).alias("line", "text"))
    kept = again.withColumn("text", strip_ws("text")).where("text <> ''")
    tokens = F.when(~F.col("longer") & (F.col("text") == F.col("uncut")), F.col("n")).otherwise(count())
    return kept.withColumn("tokens", tokens).select(*rest, "split", "sentence", "line", "text", "tokens")


def runs(units: DataFrame, order: list[str], section: str = "section", kind: str | None = None) -> DataFrame:
    """units with `run`: a change closes a chunk only where the section before was not null, so a null stretch joins the next one."""
    marks = [section, *([kind] if kind else [])]
    seen = scan(units, ["source"], order, {f"{c} before": ("previous", F.col(c)) for c in marks})
    changed = reduce(or_, (F.col(f"{c} before").isNotNull() & ~F.col(f"{c} before").eqNullSafe(F.col(c)) for c in marks))
    return scan(seen, ["source"], order, {"run": ("sum", changed.cast("int"))}).drop(*(f"{c} before" for c in marks))


def closing(prefix: list[int], first: int, tested: int, target: int) -> int:
    """The unit that closes the chunk of units from `first` on: the first from `tested` on with which it would pass the target."""
    return max(tested, bisect_right(prefix, prefix[first] + target) - 1)


def reopening(prefix: list[int], split: list[bool], first: int, at: int, overlap: int) -> int:
    """First unit of the chunk after the one from `first` to before `at`.

    A close before a whole paragraph seeds the next chunk with as many units as
    reach the overlap, none if the last one alone is larger; pieces of split
    paragraphs close without overlap.
    """
    if split[at] or prefix[at] - prefix[at - 1] > overlap:
        return at
    return max(first, bisect_right(prefix, prefix[at] - overlap, hi=at) - 1)


def greedy(tokens: list[int], split: list[bool], target: int = TARGET, overlap: int = OVERLAP) -> list[list[int]]:
    """Chunks as lists of unit numbers, in order.

    A chunk closes when the next unit would pass the target. That unit then joins
    the next chunk untested, so even a seed of the whole chunk makes progress.
    """
    prefix = [0, *accumulate(tokens)]
    return [list(range(a, b)) for a, b in _walk(prefix, split, 0, 1, target, overlap)] if tokens else []


def _walk(prefix: list[int], split: list[bool], first: int, tested: int, target: int, overlap: int) -> list[tuple[int, int]]:
    """(first unit, after the last) of the chunks from `first` on, the one that is open at the end last."""
    out = []
    while (at := closing(prefix, first, tested, target)) < len(split):
        out.append((first, at))
        first, tested = reopening(prefix, split, first, at, overlap), at + 1
    return [*out, (first, len(split))]


#: Tokens of a block of units that one task packs; a larger run is packed block by block.
BLOCK_TOKENS = 1 << 20


def _crossings(prefix: list[int], split: list[bool], entries: list[int], start: int, end: int, target: int, overlap: int) -> list[tuple[int, int]]:
    """For each entry, the first unit of the chunk that is open at `start`: (first unit of the chunk open at `end`, chunks closed between).

    Packings soon meet at the same close, so each state is followed once.
    """
    known: dict[tuple[int, int], tuple[int, int]] = {}
    out = []
    for entry in entries:
        state, path = (entry, max(start, entry + 1)), []
        while state not in known:
            at = closing(prefix, *state, target)
            if at >= end:
                known[state] = (state[0], 0)
                break
            path.append(state)
            state = (reopening(prefix, split, state[0], at, overlap), at + 1)
        first, closed = known[state]
        for i, passed in enumerate(reversed(path), 1):
            known[passed] = (first, closed + i)
        out.append((first, closed + len(path)))
    return out


def _in_order(group: pa.Table) -> tuple[list[int], list[bool], np.ndarray, int]:
    """(prefix sums of tokens, split marks, unit numbers, how many units come from blocks before) of a block's rows, `group` being sorted by unit."""
    tokens = group["tokens"].to_numpy()
    return [0, *np.cumsum(tokens).tolist()], group["split"].to_pylist(), group["unit"].to_numpy(), int(np.count_nonzero(group["halo"].to_numpy(zero_copy_only=False)))


def pack_units(units: DataFrame, order: list[str], *, target: int = TARGET, overlap: int = OVERLAP, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(source, run, chunk, place, uid): units(source, run, uid, tokens, split, and the order's columns) packed within each run in order.

    A run is cut into blocks of tokens. What crosses into a block is the first unit
    of the open chunk, one of the few whose tokens up to there fit a chunk; these
    come along from the blocks before. For each of them a block's task tells the
    one that crosses into the next block; a run's few crossings are followed from
    its start; then the blocks are packed, each from its true crossing. So a run
    of any length is packed by many tasks, as greedy() would.
    """
    if block_tokens < target or overlap > target:
        raise ValueError("a block holds at least a chunk, and a chunk its overlap")
    numbered = scan(units, ["source", "run"], order, {"unit": ("number", F.lit(1)), "after": ("sum", F.col("tokens"))})
    n = F.col("tokens").cast("long")
    numbered = numbered.select("source", "run", "uid", (F.col("unit") - 1).alias("unit"), n.alias("tokens"), "split", F.col("after").cast("long").alias("after"), F.floor((F.col("after") - n) / block_tokens).cast("long").alias("block"))
    numbered = written(numbered, "chunk-units")
    entered = numbered.withColumns({"halo": F.lit(False), "entry": F.lit(0).cast("long"), "chunks_before": F.lit(0).cast("long"), "last": F.lit(True)})
    if (numbered.agg(F.max("block").alias("most")).first()["most"] or 0) > 0:
        entered = _entered(numbered, target, overlap)

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by("unit")
        prefix, split, number, halo = _in_order(group)
        first = int(np.searchsorted(number, group["entry"][0].as_py()))
        chunks = _walk(prefix, split, first, max(halo, first + 1), target, overlap)
        if not group["last"][0].as_py():
            chunks = chunks[:-1]  # it goes on in the next block
        sizes = np.array([b - a for a, b in chunks], np.int64)
        chunk = np.repeat(np.arange(len(chunks)), sizes)
        spot = np.arange(len(chunk)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.repeat(np.array([a for a, _ in chunks], np.int64), sizes) + spot
        rows = group.select(["source", "run", "uid"]).take(pa.array(at))
        return rows.append_column("chunk", pa.array(chunk + group["chunks_before"][0].as_py(), pa.int64())).append_column("place", pa.array(spot, pa.int64())).select(["source", "run", "chunk", "place", "uid"])

    types = {f.name: f.dataType.simpleString() for f in numbered.schema}
    return entered.groupBy("source", "run", "block").applyInArrow(place, f"source {types['source']}, run {types['run']}, chunk long, place long, uid {types['uid']}")


def _entered(numbered: DataFrame, target: int, overlap: int) -> DataFrame:
    """numbered with the units that each block needs of those before it (`halo`), the unit that its open chunk begins with, and the chunks closed before it."""
    ends = numbered.groupBy("source", "run", "block").agg(F.max(F.col("after") - F.col("tokens")).alias("edge"))
    w = Window.partitionBy("source", "run").orderBy("block")
    # a chunk that is open where a block begins has at most its first and its last unit beyond the target: it began at most three blocks before
    later = F.array(*(F.struct(F.lead("block", i + 1).over(w).alias("block"), (F.lead("edge", i).over(w) if i else F.col("edge")).alias("edge")) for i in range(3)))
    ends = ends.withColumn("later", F.filter(later, lambda x: x["block"].isNotNull())).select(F.col("source").alias("s"), F.col("run").alias("r"), F.col("block").alias("b"), "later")
    joined = numbered.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r")) & (F.col("block") == F.col("b")))
    reached = F.transform(F.filter("later", lambda x: x["edge"] - F.col("after") <= target), lambda x: F.struct(x["block"].alias("block"), F.lit(True).alias("halo")))
    places = F.explode(F.concat(F.array(F.struct(F.col("block"), F.lit(False).alias("halo"))), reached)).alias("at")
    spread = joined.select("source", "run", "uid", "unit", "tokens", "split", places).select("source", "run", "uid", "unit", "tokens", "split", "at.block", "at.halo")

    def cross(group: pa.Table) -> pa.Table:
        group = group.sort_by("unit")
        prefix, split, number, halo = _in_order(group)
        entries = list(range(halo)) or [0]
        exits = _crossings(prefix, split, entries, halo, len(number), target, overlap)
        key = group.select(["source", "run", "block"]).take(pa.array([0] * len(entries)))
        return key.append_column("entry", pa.array(number[entries])).append_column("exit", pa.array(number[[x for x, _ in exits]])).append_column("closed", pa.array([n for _, n in exits], pa.int64()))

    types = {f.name: f.dataType.simpleString() for f in numbered.schema}
    key = f"source {types['source']}, run {types['run']}, block long"

    def follow(group: pa.Table) -> pa.Table:
        group = group.sort_by([("block", "ascending"), ("entry", "ascending")])
        blocks, entries, exits, closed = (group[c].to_numpy() for c in ("block", "entry", "exit", "closed"))
        starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
        entry, before, out = 0, 0, []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(blocks)], strict=True):
            out.append((a, entry, before))
            i = a + int(np.searchsorted(entries[a:b], entry))
            entry, before = int(exits[i]), before + int(closed[i])
        at, entry_of, before_of = zip(*out, strict=True)
        rows = group.select(["source", "run", "block"]).take(pa.array(at))
        return rows.append_column("entry", pa.array(entry_of, pa.int64())).append_column("chunks_before", pa.array(before_of, pa.int64())).append_column("last", pa.array([i == len(at) - 1 for i in range(len(at))]))

    crossed = spread.groupBy("source", "run", "block").applyInArrow(cross, f"{key}, entry long, exit long, closed long")
    told = crossed.groupBy("source", "run").applyInArrow(follow, f"{key}, entry long, chunks_before long, last boolean")
    told = told.select(F.col("source").alias("s"), F.col("run").alias("r"), F.col("block").alias("b"), "entry", "chunks_before", "last")
    return spread.join(told, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r")) & (F.col("block") == F.col("b"))).drop("s", "r", "b")


def _chunks_of(placed: DataFrame, units: DataFrame) -> DataFrame:
    """Texts and labels of pack_units()'s chunks from units(uid, page, section, tokens, text)."""
    full = placed.join(units.select("uid", "page", "section", "tokens", "text"), "uid")
    per = full.groupBy("source", "run", "chunk").agg(F.array_sort(F.collect_list(F.struct("place", "page", "section", "tokens", "text"))).alias("u"))
    return per.select(
        "source", "run", "chunk",
        F.array_join(F.transform("u", lambda x: x["text"]), "\n\n").alias("text"),
        page_label(F.transform("u", lambda x: x["page"])).alias("pages"),
        F.array_min(F.transform("u", lambda x: x["page"])).alias("page_first"),
        F.array_max(F.transform("u", lambda x: x["page"])).alias("page_last"),
        F.element_at("u", -1)["section"].alias("section"),
        F.aggregate("u", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"),
    )


def pack_chunks(units: DataFrame, order: list[str], *, target: int = TARGET, overlap: int = OVERLAP, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(source, run, chunk, text, pages, page_first, page_last, section, tokens): units(source, run, page, section, split, tokens, text) packed.

    The section is the one in force when the chunk closes. An empty table gives no chunks.
    """
    keyed = written(units.withColumn("uid", F.monotonically_increasing_id()), "chunk-texts")
    return _chunks_of(pack_units(keyed.drop("text"), order, target=target, overlap=overlap, block_tokens=block_tokens), keyed)


def split_overlong(chunks: DataFrame, limit: int = LIMIT, counter: Callable[[str], int] | None = None, commas: bool = True) -> DataFrame:
    """Chunks above the limit as groups of sentences, sentences above it cut after commas, what is above it still between words; labels are inherited, `part` keeps the order."""
    count = counter or count_words
    most = limit - SPECIAL
    adds = counter is None

    def halved(text: str, n: int) -> list[tuple[str, int]]:
        words = text.split()
        if len(words) < 2 or n <= most:
            return [(text, n)]
        upto = [0, *accumulate(map(count, words))] if adds else []

        def between(a: int, b: int) -> list[tuple[str, int]]:
            joined = " ".join(words[a:b])
            size = upto[b] - upto[a] if adds else count(joined)
            if b - a < 2 or size <= most:
                return [(joined, size)]
            middle = a + (b - a) // 2
            return between(a, middle) + between(middle, b)

        middle = len(words) // 2
        return between(0, middle) + between(middle, len(words))

    def cut(text: str) -> list[str]:
        if count(text) <= most:
            return [text]
        sentences = [(s, count(s)) for s in re.split(r"(?<=[.!?])\s+", text)]
        pieces = [x for s, n in sentences for x in ([(p, count(p)) for p in re.split(r"(?<=,)\s+", s)] if commas and n > most else [(s, n)])]
        out: list[list[str]] = []
        size = 0
        for p, n in (h for x in pieces for h in halved(*x)):
            # a counter of one's own may see a joined text in another way
            joined = size + n if adds else count(" ".join([*out[-1], p])) if out else n
            if out and joined <= most:
                out[-1].append(p)
                size = joined
            else:
                out.append([p])
                size = n
        return [" ".join(x) for x in out]

    @pandas_udf("array<string>")
    def parts(texts: pd.Series) -> pd.Series:
        return texts.map(cut, na_action="ignore")

    rest = [c for c in chunks.columns if c not in ("text", "tokens")]
    # only texts above the limit travel to Python
    long = F.when(count_tokens("text", counter) > most, F.col("text"))
    cut_up = F.coalesce(parts(long), F.array("text"))
    return chunks.where("text is not null").select(*rest, F.posexplode(cut_up).alias("part", "text")).withColumn("tokens", count_tokens("text", counter).cast("long"))


def renumber(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Ordinals from 0 per source, without gaps."""
    return scan(chunks, ["source"], order, {"ordinal": ("number", F.lit(1))}).withColumn("ordinal", (F.col("ordinal") - 1).cast("int"))


def chunk_stats(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    return chunks.groupBy("source").agg(
        F.count(F.lit(1)).alias("chunks"), F.min("tokens").alias("min_tokens"), F.median("tokens").alias("median_tokens"), F.max("tokens").alias("max_tokens"),
        F.count_if(F.col("tokens") > limit).alias("over_limit"), F.avg(F.col("section").isNotNull().cast("int")).alias("with_section"),
    )


def build_chunks(pages: DataFrame, *, sep: str = r"\n\s*\n", target: int = TARGET, overlap: int = OVERLAP, limit: int = LIMIT, counter: Callable[[str], int] | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """pages(source, page, text, section) to numbered chunks, none above the limit unless a single word is.

    Units of text are written once; all that orders and packs them works on their numbers.
    """
    order = ["page", "para_no", "sentence", "line"]
    units = written(split_oversized(paragraphs(pages, sep), target, limit, counter).withColumn("uid", F.monotonically_increasing_id()), "chunk-texts")
    placed = pack_units(runs(units.drop("text"), order), order, target=target, overlap=overlap, block_tokens=block_tokens)
    # the keys are counted before rows are numbered, so the chunks are worked out once
    return renumber(written(split_overlong(_chunks_of(placed, units), limit, counter), "chunk-parts"), ["run", "chunk", "part"])
