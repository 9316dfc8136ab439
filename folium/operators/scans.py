"""Ordered scans within a key, and as-of joins by them, where one key may be larger than a task.

A window by key alone puts a whole key into one task. Here keys of more than
KEY_ROWS rows are cut by quantiles of their first order column into blocks; rows
are scanned within (key, block), each block is summed up in one row, the few
summaries are scanned by key and broadcast, and what comes before a block is
applied to its rows. Results are those of the window. Cut points are computed
once, on the driver as numbers: at most two for each BLOCK_ROWS rows, and no more
than MOST_BLOCKS in all, since blocks grow with larger tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, NumericType, StructField, StructType, TimestampNTZType, TimestampType

#: Rows of a key that stay in one task, and of a block of a larger one.
KEY_ROWS = BLOCK_ROWS = 1 << 20
#: Most blocks of a table, and of a key: a root of it is compared with twice a row.
MOST_BLOCKS, KEY_BLOCKS, FAN_OUT = 1 << 16, 4096, 64
#: Names of columns that a scan adds and takes away again.
_BLOCK, _CUTS = "scan block", "scan cuts"

#: What a scan gives a row: the latest non-null value with or before it, the sum or greatest value so far, the row before's or after's value, the rows so far.
KINDS = ("last", "before", "sum", "max", "previous", "next", "number")


def block_cuts(df: DataFrame, by: Sequence[str], order: str, key_rows: int = KEY_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame | None:
    """(by.., cuts array<array>): where the blocks of each large key begin, in groups of FAN_OUT; None if no key is large or `order` can't be cut."""
    kind = df.schema[order].dataType
    if not isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType)):
        return None
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if (found["most"] or 0) <= key_rows:
        return None
    block_rows = max(block_rows, -(-2 * found["all"] // MOST_BLOCKS))
    large = sizes.where(F.col("n") > max(key_rows, block_rows)).select(*(F.col(c).alias(f"{c} of key") for c in by), "n")
    steps = min(KEY_BLOCKS, -(-found["most"] // block_rows))
    same = [df[c].eqNullSafe(F.col(f"{c} of key")) for c in by]
    shares = [i / steps for i in range(1, steps)]
    # at most MOST_BLOCKS / 2 keys are larger than a block
    told = df.select(*by, order).join(F.broadcast(large), same).groupBy(*by).agg(F.first("n").alias("n"), F.percentile_approx(order, shares).alias("q")).collect() if shares else []
    rows = []
    for r in told:
        wanted = min(steps, -(-r["n"] // block_rows))
        quantiles = r["q"] or []
        cuts = sorted({quantiles[i * steps // wanted - 1] for i in range(1, wanted)}) if quantiles else []
        if cuts:
            rows.append((*(r[c] for c in by), [cuts[i : i + FAN_OUT] for i in range(0, len(cuts), FAN_OUT)]))
    schema = StructType([*(StructField(c, df.schema[c].dataType) for c in by), StructField(_CUTS, ArrayType(ArrayType(kind)))])
    return df.sparkSession.createDataFrame(rows, schema) if rows else None


def with_blocks(df: DataFrame, by: Sequence[str], order: str, cuts: DataFrame) -> DataFrame:
    """df with its block: how many cuts of its key aren't above the row. Null order values lie in block 0, and so do keys without cuts."""
    named = cuts.select(*(F.col(c).alias(f"{c} of key") for c in by), _CUTS)
    joined = df.join(F.broadcast(named), [F.col(c).eqNullSafe(F.col(f"{c} of key")) for c in by], "left").drop(*(f"{c} of key" for c in by))
    below = lambda a: F.size(F.filter(a, lambda x: x <= F.col(order)))
    groups = below(F.transform(_CUTS, lambda a: a[0]))
    inside = (groups - 1) * FAN_OUT + below(F.get(_CUTS, groups - 1))
    return joined.withColumn(_BLOCK, F.when(F.col(_CUTS).isNull() | (groups <= 0), 0).otherwise(inside)).drop(_CUTS)


def _scanned(kind: str, value: Column, order: Sequence[str], within: Sequence[str]) -> Column:
    w = Window.partitionBy(*within).orderBy(*order)
    so_far, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    return {
        "last": lambda: F.last(value, ignorenulls=True).over(so_far),
        "before": lambda: F.last(value, ignorenulls=True).over(earlier),
        "sum": lambda: F.sum(value).over(so_far),
        "max": lambda: F.max(value).over(so_far),
        "previous": lambda: F.lag(F.struct(value.alias("v"))).over(w),
        "next": lambda: F.lead(F.struct(value.alias("v"))).over(w),
        "number": lambda: F.row_number().over(w).cast("long"),
    }[kind]()


def _summary(kind: str, value: Column, order: Sequence[str]) -> Column:
    at = F.struct(*order)
    return {
        "last": lambda: F.max_by(value, F.when(value.isNotNull(), at)),
        "before": lambda: F.max_by(value, F.when(value.isNotNull(), at)),
        "sum": lambda: F.sum(value),
        "max": lambda: F.max(value),
        "previous": lambda: F.max_by(F.struct(value.alias("v")), at),
        "next": lambda: F.min_by(F.struct(value.alias("v")), at),
        "number": lambda: F.count(F.lit(1)),
    }[kind]()


def _joined(kind: str, own: Column, earlier: Column) -> Column:
    return {
        "last": lambda: F.coalesce(own, earlier),
        "before": lambda: F.coalesce(own, earlier),
        "sum": lambda: F.coalesce(own + earlier, own, earlier),
        "max": lambda: F.coalesce(F.greatest(own, earlier), own, earlier),
        "previous": lambda: F.coalesce(own, earlier),
        "next": lambda: F.coalesce(own, earlier),
        "number": lambda: own + F.coalesce(earlier, F.lit(0)),
    }[kind]()


def scan(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: dict[str, tuple[str, Column]], *, key_rows: int = KEY_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with a column for each name: (kind, value) scanned in ascending `order` within `by`.

    Kinds are those of KINDS; nulls come first in the order, rows without a key are
    a key of their own, rows of equal order lie in any order. The keys of df are
    counted before it is scanned, so write it first if they are dear to work out. df's own column of a
    name is replaced. An empty table gives no rows. Names of df may not be those of
    _BLOCK and _CUTS.
    """
    cuts = block_cuts(df, by, order[0], key_rows, block_rows)
    if cuts is None:
        return df.withColumns({name: _field(kind, _scanned(kind, value, order, by)) for name, (kind, value) in columns.items()})
    blocked = with_blocks(df, by, order[0], cuts)
    numbered = list(enumerate(columns.items()))
    own = blocked.withColumns({f"scan own {i}": _scanned(kind, value, order, [*by, _BLOCK]) for i, (_, (kind, value)) in numbered})
    large = cuts.select(*(F.col(c).alias(f"{c} of key") for c in by))
    of_large = blocked.join(F.broadcast(large), [F.col(c).eqNullSafe(F.col(f"{c} of key")) for c in by], "left_semi")
    sums = of_large.groupBy(*by, _BLOCK).agg(*(_summary(kind, value, order).alias(f"scan sum {i}") for i, (_, (kind, value)) in numbered))
    blocks = Window.partitionBy(*by).orderBy(_BLOCK)
    earlier, later = blocks.rowsBetween(Window.unboundedPreceding, -1), blocks.rowsBetween(1, Window.unboundedFollowing)

    def before(i: int, kind: str) -> Column:
        c = F.col(f"scan sum {i}")
        if kind == "next":
            return F.first(c).over(later).alias(f"scan before {i}")
        return (F.sum(c) if kind in ("sum", "number") else F.max(c) if kind == "max" else F.last(c, ignorenulls=True)).over(earlier).alias(f"scan before {i}")

    carried = sums.select(*(F.col(c).alias(f"{c} of key") for c in by), F.col(_BLOCK).alias("scan block of key"), *(before(i, kind) for i, (_, (kind, _)) in numbered))
    same = [F.col(c).eqNullSafe(F.col(f"{c} of key")) for c in by]
    # a row a block of a large key: at most MOST_BLOCKS
    full = own.join(F.broadcast(carried), [*same, F.col(_BLOCK) == F.col("scan block of key")], "left")
    made = {name: _field(kind, _joined(kind, F.col(f"scan own {i}"), F.col(f"scan before {i}"))) for i, (name, (kind, _)) in numbered}
    return full.select(*(made.pop(c).alias(c) if c in made else F.col(c) for c in df.columns), *(x.alias(n) for n, x in made.items()))


def _field(kind: str, c: Column) -> Column:
    return c["v"] if kind in ("previous", "next") else c


#: Ranges that stay with each page's task in a broadcast: of all keys, and of one.
FEW_RANGES, FEW_OF_A_KEY = 1 << 16, 64


def as_of(rows: DataFrame, starts: DataFrame, by: Sequence[str], at: str, start: str, label: str, column: str, *, few: int = FEW_OF_A_KEY, key_rows: int = KEY_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with `column`: the label of the greatest start of the same key that isn't after `at`; null before the first, without a key or without `at`.

    Starts that are null or have a null key count for nothing; of equal starts the
    greatest label does. Few starts a key travel to the rows as sorted arrays of a
    bounded broadcast. Else rows and starts are put into one order and the last
    start is carried forward, linear in both, whatever a key holds.
    """
    kept = starts.where(F.col(start).isNotNull()).dropna(subset=list(by)).groupBy(*by, start).agg(F.max(F.struct(F.col(label).isNotNull(), F.col(label).alias("label")))["label"].alias(label))
    size = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if (size["most"] or 0) <= few and (size["all"] or 0) <= FEW_RANGES:
        lists = kept.groupBy(*(F.col(c).alias(f"{c} of key") for c in by)).agg(F.sort_array(F.collect_list(F.struct(F.col(start).alias("s"), F.col(label).alias("v")))).alias("as of"))
        joined = rows.join(F.broadcast(lists), [F.col(c) == F.col(f"{c} of key") for c in by], "left")  # at most FEW_RANGES starts
        fit = F.filter("as of", lambda x: x["s"] <= F.col(at))
        found = F.get(fit, F.size(fit) - 1)["v"]
        return joined.withColumn(column, found).drop("as of", *(f"{c} of key" for c in by))
    key = [F.col(c).alias(c) for c in by]
    marks = kept.select(*key, F.col(start).alias("as of"), F.lit(0).alias("as of rank"), F.struct(F.col(label).alias("v")).alias("as of label"))
    asked = rows.withColumns({"as of": F.col(at), "as of rank": F.lit(1), "as of label": F.lit(None).cast(marks.schema["as of label"].dataType)})
    merged = asked.unionByName(marks, allowMissingColumns=True)
    carried = scan(merged, by, ["as of", "as of rank"], {"as of label": ("last", F.col("as of label"))}, key_rows=key_rows, block_rows=block_rows)
    return carried.where(F.col("as of rank") == 1).withColumn(column, F.col("as of label")["v"]).drop("as of", "as of rank", "as of label")
