"""Section labels: as-of joins, carry-forward scans, relabelling. A source may be larger than a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions.text import chapter_opening, fold_text, lines, page_first, session_date, session_number, strip_ws
from folium.operators.scans import as_of, scan


def running_section(pages: DataFrame, max_n: int, chapter_word: str = "capítulo", cue: str = r"(?i)\b(?:p\.|pp\.|v\.|ed\.|cit\.|ibid)") -> DataFrame:
    """pages with `detected` and the heading line taken out of the text.

    A chapter opening wins; else the first, then the last content line `N – title`
    with N up to max_n and no bibliographic cue.
    """
    content = F.filter(F.transform(lines(F.coalesce("text", F.lit(""))), strip_ws), lambda x: (x != "") & ~x.rlike(r"^\d+$"))
    number = lambda x: F.regexp_extract(x, r"^(\d{1,3})\s*[–-]\s+\S", 1)
    ok = lambda x: F.coalesce((number(x) != "") & (number(x).try_cast("int") <= max_n) & ~x.rlike(cue), F.lit(False))
    # in steps: a page's lines are gone through once, not once for each line
    told = pages.withColumns({"page lines": content, "page opening": chapter_opening(F.coalesce("text", F.lit("")), chapter_word)})
    ends = told.withColumns({"first line": F.get("page lines", F.lit(0)), "last line": F.element_at(F.concat(F.array(F.lit("")), "page lines"), -1)}).drop("page lines")
    found = ends.withColumn("page line", F.when(ok(F.col("first line")), F.col("first line")).when(ok(F.col("last line")), F.col("last line"))).drop("first line", "last line")
    marked = found.withColumns({"detected": F.coalesce("page opening", "page line"), "taken line": F.when(F.col("page opening").isNull(), F.col("page line"))})
    cleaned = F.array_join(F.filter(lines("text"), lambda x: ~strip_ws(x).eqNullSafe(F.col("taken line"))), "\n")
    return marked.withColumn("text", F.when(F.col("taken line").isNotNull(), cleaned).otherwise(F.col("text"))).select(*pages.columns, *(["detected"] if "detected" not in pages.columns else []))


def section_by_range(pages: DataFrame, ranges: DataFrame, column: str = "section") -> DataFrame:
    """As-of join: the label of the greatest start not after the page, null before the first. ranges: (source, start, label)."""
    return as_of(pages, ranges, ["source"], "page", "start", "label", column)


def subsection_coherent(pages: DataFrame, sections: DataFrame, subsections: DataFrame) -> DataFrame:
    """Both labels; the subsection is null where its number before the first dot isn't the section's."""
    both = section_by_range(section_by_range(pages, sections, "section"), subsections, "subsection")
    number = lambda c: F.regexp_extract(F.split_part(F.col(c), F.lit("."), F.lit(1)), r"(\d+)", 1)
    return both.withColumn("subsection", F.when(number("section") == number("subsection"), F.col("subsection")))


def toc_index(pages: DataFrame, first: int, last: int, errata: DataFrame | None = None) -> DataFrame:
    """(source, number, page, label) of the entries `N.` newline `name....page` on the index pages; errata(number, page, label) override."""
    entry = r"(?m)^(\d+)\.\s*\n?\s*([^\n]+?)\.{3,}\s*(\d+)\s*$"
    on = pages.where(F.col("page").between(first, last)).select("source", "text")
    each = on.select("source", F.explode(F.regexp_extract_all("text", F.lit(entry), F.lit(0))).alias("e"))
    part = lambda i: F.regexp_extract("e", entry, i)
    found = each.select("source", part(1).cast("int").alias("number"), part(3).cast("int").alias("page"), strip_ws(part(2)).alias("label"))
    if errata is not None:
        e = errata.select("number", F.col("page").alias("e_page"), F.col("label").alias("e_label"))
        found = found.join(e, "number", "left").select("source", "number", F.coalesce("e_page", "page").alias("page"), F.coalesce("e_label", "label").alias("label"))
    return found


def toc_numbers(chunks: DataFrame) -> DataFrame:
    """(source, number, name): a number on a line of its own and the nearest text line before it, leaders taken off. chunks: (source, ordinal, text)."""
    each = chunks.select("source", "ordinal", F.posexplode(lines("text")).alias("line_no", "line")).withColumn("line", strip_ws("line"))
    is_number = F.col("line").rlike(r"^\d{1,4}$")
    name = F.when(~is_number & (F.col("line") != ""), F.regexp_replace("line", r"[.\s]{3,}$", ""))
    named = scan(each, ["source"], ["ordinal", "line_no"], {"name": ("before", name)})
    return named.where(is_number & F.col("name").isNotNull()).select("source", F.col("line").cast("int").alias("number"), "name")


def carry_section(pages: DataFrame, detected: str = "detected") -> DataFrame:
    """The last detected section holds until the next. Call it before rejected pages are filtered out."""
    return scan(pages, ["source"], ["page"], {"section": ("last", F.col(detected))})


def section_per_paragraph(paragraphs: DataFrame, opens: str, closes: str, heading: Column) -> DataFrame:
    """Paragraphs carry the latest heading while the gate between an opening and a closing mark is on. paragraphs: (source, page, para_no, text)."""
    by, order = ["source"], ["page", "para_no"]
    mark = F.when(F.col("text").rlike(opens), True).when(F.col("text").rlike(closes), False)
    gated = scan(paragraphs, by, order, {"gate": ("last", mark)}).withColumn("gate", F.coalesce("gate", F.lit(False)))
    found = F.when(F.col("gate") & heading, F.split_part("text", F.lit("\n"), F.lit(1)))
    carried = scan(gated, by, order, {"section": ("last", found)})
    return carried.withColumn("section", F.when(F.col("gate"), F.col("section"))).drop("gate")


def session_detect(pages: DataFrame) -> DataFrame:
    """(source, page, number, date): at most one session a page."""
    return pages.select("source", "page", session_number(F.col("text")).alias("number"), session_date(F.col("text")).alias("date")).where("number is not null")


def sessions_to_ranges(sessions: DataFrame) -> DataFrame:
    """(source, start, label) without detections that repeat the number before them."""
    label = F.concat(F.col("number"), F.lit("ª audiência pública"), F.coalesce(F.date_format("date", " – dd/MM/yyyy"), F.lit("")))
    return scan(sessions, ["source"], ["page"], {"before": ("previous", F.col("number"))}).where(~F.col("number").eqNullSafe(F.col("before"))).select("source", F.col("page").alias("start"), label.alias("label"))


def relabel_chunks(chunks: DataFrame, ranges: DataFrame, keep_below_first: bool = False, pages: Sequence[int] | None = None) -> DataFrame:
    """A new section by the chunk's first page; optionally only on given pages, or the old one before the first range."""
    old = chunks.withColumnRenamed("section", "old_section").withColumn("page", page_first(F.col("pages")))
    new = section_by_range(old, ranges)
    if keep_below_first:
        new = new.withColumn("section", F.coalesce("section", "old_section"))
    if pages is not None:
        new = new.withColumn("section", F.when(F.col("page").isin(list(pages)), F.col("section")).otherwise(F.col("old_section")))
    return new.drop("old_section", "page")


def label_diff(stored: DataFrame, fresh: DataFrame, key: Sequence[str] = ("source", "ordinal")) -> DataFrame:
    """Rows whose section differs, null-safe; a fresh row that is missing counts as null."""
    f = fresh.select(*key, F.col("section").alias("new_section"))
    return stored.join(f, list(key), "left").where(~F.col("section").eqNullSafe(F.col("new_section"))).select(*key, "section", "new_section")


def rename_labels(chunks: DataFrame, mapping: DataFrame) -> DataFrame:
    """(source, old) to new labels."""
    m = mapping.select(F.col("source").alias("m_source"), F.col("old").alias("m_old"), F.col("new").alias("m_new"))
    joined = chunks.join(m, (F.col("source") == F.col("m_source")) & (F.col("section") == F.col("m_old")), "left")
    return joined.withColumn("section", F.coalesce("m_new", "section")).drop("m_source", "m_old", "m_new")


def stamp_from_marker(chunks: DataFrame, section: str, marker: str, note: str) -> DataFrame:
    """Inside a section, from the first chunk that holds the marker to the end, set the note."""
    marked = scan(chunks, ["source", "section"], ["ordinal"], {"seen marker": ("max", F.col("text").contains(marker))})
    return marked.withColumn("note", F.when((F.col("section") == section) & F.col("seen marker"), F.lit(note)).otherwise(F.col("note"))).drop("seen marker")


def patch_source_fields(sources: DataFrame, patches: DataFrame, key: str = "source") -> DataFrame:
    """Fields of a patch that aren't null replace the old ones; applying it twice changes nothing more."""
    fields = [c for c in patches.columns if c != key]
    joined = sources.join(patches.select(key, *(F.col(c).alias(f"p_{c}") for c in fields)), key, "left")
    return joined.select(*(F.coalesce(f"p_{c}", c).alias(c) if c in fields else F.col(c) for c in sources.columns))


def toc_audit(index: DataFrame, pages: DataFrame, connectives: Sequence[str] = ("de", "da", "do", "das", "dos", "e")) -> DataFrame:
    """Index entries with a name word that neither their page nor the next one holds, accents and case aside."""
    at = index.select("source", "number", "page", "label", F.explode(F.array(F.col("page"), F.col("page") + 1)).alias("near"))
    text = pages.select("source", F.col("page").alias("near"), fold_text("text").alias("folded"))
    words = F.filter(F.split(fold_text("label"), " "), lambda w: ~w.isin(*connectives) & (w != ""))
    joined = at.join(text, ["source", "near"], "left").groupBy("source", "number", "page", "label").agg(F.concat_ws("\n", F.collect_list("folded")).alias("folded"))
    missing = F.filter(words, lambda w: ~F.col("folded").contains(w))
    return joined.withColumn("missing", missing).where(F.size("missing") > 0).drop("folded")
