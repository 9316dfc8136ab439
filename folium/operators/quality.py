"""Page filters and quality reports. Pages are (source, page, text) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions.text import alpha_ratio, letters, visible

MIN_ALPHA, MIN_RATIO = 60, 0.5


def alpha_stats(pages: DataFrame, text: str = "text") -> DataFrame:
    c = F.coalesce(F.col(text), F.lit(""))
    return pages.withColumns({"alpha": letters(c), "visible": visible(c), "ratio": alpha_ratio(c)})


def passes(text: Column, min_alpha: int = MIN_ALPHA, min_ratio: float | None = MIN_RATIO) -> Column:
    """The gate's criterion, shared with the log so that both agree; a null text does not pass."""
    c = F.coalesce(text, F.lit(""))
    enough = letters(c) >= min_alpha
    return enough if min_ratio is None else enough & (alpha_ratio(c) >= min_ratio)


def quality_gate(pages: DataFrame, min_alpha: int = MIN_ALPHA, min_ratio: float | None = MIN_RATIO) -> DataFrame:
    return pages.where(passes(F.col("text"), min_alpha, min_ratio))


def length_gate(pages: DataFrame, min_length: int = 50) -> DataFrame:
    return pages.where(F.length("text") >= min_length)


def discard_log(pages: DataFrame, min_alpha: int = MIN_ALPHA, min_ratio: float = MIN_RATIO) -> DataFrame:
    """(source, page, reason, alpha, ratio) of each page that the gate rejects."""
    c = F.coalesce(F.col("text"), F.lit(""))
    reason = F.when(visible(c) == 0, "em_branco").otherwise("baixa_qualidade")
    return pages.where(~passes(F.col("text"), min_alpha, min_ratio)).select("source", "page", reason.alias("reason"), letters(c).alias("alpha"), F.round(alpha_ratio(c), 4).alias("ratio"))


def discard_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))


def skip_toc(pages: DataFrame, min_leaders: int = 3) -> DataFrame:
    """Without the pages that hold several runs of five or more dots."""
    leaders = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\.{5,})"), 1))
    return pages.where(leaders < min_leaders)


def exclude_pages(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Without the pages of ranges(source, first, last)."""
    r = ranges.select(F.col("source").alias("r_source"), "first", "last")
    return pages.join(r, (F.col("source") == F.col("r_source")) & F.col("page").between(F.col("first"), F.col("last")), "left_anti")


def effective_page(pages: DataFrame, source: str, first_n: int = 14) -> DataFrame:
    """The first pages of one source take their stored line number."""
    return pages.withColumn("page", F.when((F.col("source") == source) & (F.col("line_no") <= first_n), F.col("line_no")).otherwise(F.col("page")))


def text_coverage(pages: DataFrame, scanned_share: float = 0.5) -> DataFrame:
    """Per source: pages, pages with text, their share, characters; at most half with text means a scan."""
    has = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    per = pages.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.count_if(has).alias("with_text"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"))
    share = F.col("with_text") / F.col("pages")
    return per.withColumns({"percent": F.round(100 * share, 2), "scanned": share <= scanned_share})


def patch_pages(base: DataFrame, patch: DataFrame, first: int, last: int) -> DataFrame:
    """Newer texts of the pages in a range replace the old, missing pages come in, all others stay."""
    new = patch.where(F.col("page").between(first, last)).select("source", "page", F.col("text").alias("new_text"))
    return base.join(new, ["source", "page"], "full_outer").select("source", "page", F.coalesce("new_text", "text").alias("text"))


def pending_pages(pages: DataFrame, done: DataFrame) -> DataFrame:
    return pages.join(done.select("source", "page"), ["source", "page"], "left_anti")
