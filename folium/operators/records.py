"""Structured records from page and chunk text."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from folium.functions.text import lines, slugify, strip_ws
from folium.operators.scans import scan

_LABEL = re.compile(r"^([A-ZÀ-Þ][\wÀ-ÿ /-]{2,40}):\s*(.*)$")


def field_blocks(pages: DataFrame, opens: str = "Filiação", needs: str = "morte", span: int = 600) -> DataFrame:
    """(source, page, name, fields map): a name line, then `label: value` lines with wrapped values.

    A blank line ends a value; an unknown line before any label ends the block; blocks without a field that names `needs` are left out.
    """

    @pandas_udf("array<struct<name:string,fields:map<string,string>>>")
    def run(texts: pd.Series) -> pd.Series:
        def of(text: str) -> list[dict]:
            out, at = [], 0
            for m in re.finditer(rf"(?m)^(.+)\n(?={re.escape(opens)}\s*:)", text):
                if m.start() < at:
                    continue
                fields: dict[str, str] = {}
                label = None
                for line in text[m.end() : m.end() + span].split("\n"):
                    found = _LABEL.match(line.strip())
                    if found:
                        label = found[1]
                        fields[label] = found[2]
                    elif not line.strip():
                        label = None
                    elif label:
                        fields[label] = f"{fields[label]} {line.strip()}".strip()
                    else:
                        break
                if any(needs in k.lower() for k in fields):
                    out.append({"name": m[1].strip(), "fields": fields})
                    at = m.end()
            return out

        return texts.map(of, na_action="ignore")

    each = pages.where(F.col("text").contains(f"{opens}:")).withColumn("x", F.explode(run("text")))
    return each.select("source", "page", "x.*")


def first_wins(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def profile_parts(chunks: DataFrame, prefix: str = "Perfil – ") -> DataFrame:
    """chunks under a profile's section with its slug and name, a row each: what profile_chunks() joins, for profiles of any size."""
    on = chunks.where(F.col("section").startswith(prefix)).withColumn("name", F.substr("section", F.lit(len(prefix) + 1)))
    return on.withColumn("slug", slugify(F.col("name")))


def profile_chunks(chunks: DataFrame, prefix: str = "Perfil – ") -> DataFrame:
    """(slug, name, text) of the chunks under a profile's section, in order; a profile's text is one value."""
    per = profile_parts(chunks, prefix).groupBy("slug").agg(F.min("name").alias("name"), F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("t"))
    return per.select("slug", "name", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))


def header_or_fallback(headers: DataFrame, fallback: DataFrame, key: str = "slug") -> DataFrame:
    """The fields of the page header, else those read from the first chunk."""
    other = fallback.select(key, F.col("fields").alias("fallback"))
    return headers.join(other, key, "full_outer").select(key, F.coalesce("fields", "fallback").alias("fields"))


_ORDER = ["page_first", "ordinal", "line_no"]


def _lines(chunks: DataFrame) -> DataFrame:
    """Trimmed lines of ordered chunks."""
    return chunks.select("source", "page_first", "ordinal", F.posexplode(lines("text")).alias("line_no", "line")).withColumn("line", strip_ws("line"))


def _segments(chunks: DataFrame, starts: Column) -> DataFrame:
    """Lines of ordered chunks with `segment`, which counts the starts so far."""
    return scan(_lines(chunks), ["source"], _ORDER, {"segment": ("sum", F.when(starts, 1).otherwise(0))})


def numbered_items(chunks: DataFrame, item: str = r"^(\d{2,3})\)\s+(.+)$", reference: str = r"^\(\d{2,3}\)\s+\S") -> DataFrame:
    """(source, number, name, page, text): items run to the next item or cross reference; a repeated number keeps the last."""
    is_item = F.col("line").rlike(item)
    seg = _segments(chunks, is_item | F.col("line").rlike(reference))
    place = F.struct("page_first", "ordinal", "line_no")
    per = seg.groupBy("source", "segment").agg(F.min_by("line", place).alias("head"), F.min("page_first").alias("page"), F.array_sort(F.collect_list(F.struct("page_first", "ordinal", "line_no", "line"))).alias("l"))
    found = per.where(F.col("head").rlike(item)).select("source", F.regexp_extract("head", item, 1).cast("int").alias("number"), F.regexp_extract("head", item, 2).alias("name"), "page", "segment", F.array_join(F.transform(F.slice("l", F.lit(2), F.size("l")), lambda x: x["line"]), "\n").alias("text"))
    w = Window.partitionBy("source", "number").orderBy(F.desc("segment"))
    return found.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "segment")


def spreadsheet_records(chunks: DataFrame, least: int = 10) -> DataFrame:
    """(source, number, name, birth, state, sex, year): records of a table dump, fields picked by their shape.

    A record starts at a number of at most three digits (four are a year) before a capitalised line.
    """
    each = scan(_lines(chunks).where("line <> ''"), ["source"], _ORDER, {"next": ("next", F.col("line"))})
    start = F.col("line").rlike(r"^\d{1,3}$") & F.col("next").rlike(r"^\p{Lu}\p{L}")
    marked = scan(each, ["source"], _ORDER, {"record": ("sum", F.coalesce(start, F.lit(False)).cast("int"))}).where("record > 0")
    per = marked.groupBy("source", "record").agg(F.array_sort(F.collect_list(F.struct("page_first", "ordinal", "line_no", "line"))).alias("l")).withColumn("f", F.transform("l", lambda x: x["line"])).where(F.size("f") >= least)
    pick = lambda p: F.get(F.filter("f", lambda x: x.rlike(p)), F.lit(0))
    return per.select("source", F.col("f")[0].cast("int").alias("number"), F.col("f")[1].alias("name"), pick(r"^\d{1,2}/\d{1,2}/\d{2,4}$").alias("birth"), F.regexp_extract(pick(r"\(\p{Lu}{2}\)"), r"\((\p{Lu}{2})\)", 1).alias("state"), pick("^[MF]$").alias("sex"), pick(r"^(19|20)\d{2}$").cast("int").alias("year"))


def triple_blocks(chunks: DataFrame, header: str) -> DataFrame:
    """(source, name, sources, count): after the header line, name / sources / integer triples; other lines are passed over one by one."""
    each = _segments(chunks, F.col("line").rlike(header)).where("segment > 0 and line <> ''")
    two = scan(scan(each, ["source"], _ORDER, {"b": ("next", F.col("line"))}), ["source"], _ORDER, {"c": ("next", F.col("b"))})
    upper = F.length(F.regexp_replace("line", r"[^\p{Lu}]", "")) * 2 > F.length(F.regexp_replace("line", r"[^\p{L}]", ""))
    return two.where(F.col("c").rlike(r"^\d+$") & upper & ~F.col("line").rlike(header)).select("source", F.col("line").alias("name"), F.col("b").alias("sources"), F.col("c").cast("int").alias("count"))


def place_pairs(chunks: DataFrame, institution: str, neighbourhoods: dict[str, str], capital_state: str) -> DataFrame:
    """(source, name, city): an institution line and the city line below it; neighbourhoods stand for their capital; later pairs win."""
    each = scan(_lines(chunks).where("line <> ''"), ["source"], _ORDER, {"city": ("next", F.col("line")), "seq": ("number", F.lit(1))})
    table = F.create_map(*(F.lit(x) for pair in neighbourhoods.items() for x in pair)) if neighbourhoods else F.create_map().cast("map<string,string>")
    found = each.where(F.col("line").rlike(institution) & F.col("city").isNotNull()).select("source", F.col("line").alias("name"), F.coalesce(F.element_at(table, F.col("city")), "city").alias("city"), "seq")
    last = Window.partitionBy("source", "name").orderBy(F.desc("seq"))
    return found.withColumn("n", F.row_number().over(last)).where("n = 1").select("source", "name", "city", F.lit(capital_state).alias("default_state"))


def labelled_profiles(pages: DataFrame) -> DataFrame:
    """(source, page, name, date, place): an all-caps name line and the birth line below it."""
    pattern = r"(?m)^([\p{Lu}][\p{Lu} '.-]{4,})\n(?:Data e local de nascimento):\s*([^,\n]+),\s*([^\n]+)$"
    each = pages.select("source", "page", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("e"))
    part = lambda i: strip_ws(F.regexp_extract("e", pattern, i))
    return each.select("source", "page", part(1).alias("name"), part(2).alias("date"), part(3).alias("place"))


def build_profile(df: DataFrame, kind: str) -> DataFrame:
    """(slug, profile): one nested record from (name, text, source, pages, city, state, tags); absent fields stay null."""
    summary = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 197), F.lit("..."))).otherwise(F.col("text"))
    citation = F.struct("source", "pages", F.substring("text", 1, 500).alias("excerpt"))
    profile = F.struct("name", F.lit(kind).alias("kind"), summary.alias("summary"), "text", "city", "state", F.array(citation).alias("sources"), F.transform("tags", lambda t: F.struct(t.alias("tag"), citation.alias("citation"))).alias("tags"))
    return df.select(slugify(F.col("name")).alias("slug"), profile.alias("profile"))


def build_event(df: DataFrame) -> DataFrame:
    """(slug, event) for the rows whose city and state are known."""
    citation = F.struct("source", "pages", F.substring("text", 1, 500).alias("excerpt"))
    known = df.where("city is not null and state is not null")
    event = F.struct("title", "date", "city", "state", "crimes", F.array(citation).alias("sources"), F.array(slugify(F.col("name"))).alias("victims"))
    return known.select(slugify(F.col("title")).alias("slug"), event.alias("event"))


def new_only(df: DataFrame, existing: DataFrame, key: str = "slug") -> DataFrame:
    return df.join(existing.select(key), key, "left_anti")


def creation_summary(df: DataFrame, existing: DataFrame, key: str = "slug") -> DataFrame:
    """Counts of created, skipped and placeless records and of those without text. df: (key, city, text)."""
    known = existing.select(key).distinct().withColumn("exists", F.lit(True))
    return df.join(known, key, "left").agg(
        F.count_if(F.col("exists").isNull()).alias("created"), F.count_if("exists").alias("skipped"),
        F.count_if(F.col("city").isNull()).alias("without_place"), F.count_if(F.col("text").isNull()).alias("without_text"),
    )


def classify_source(items: DataFrame, rules: Sequence[tuple[Column, str, str, str | None]], default: tuple[str, str, str | None]) -> DataFrame:
    """items with kind, reliability and note_key of the first rule (condition, kind, reliability, note key) that holds. Dates compare as text."""
    values = [F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(("kind", "reliability", "note_key"), r, strict=True))) for r in [*(r[1:] for r in rules), default]]
    out = values[-1]
    for (condition, *_), value in zip(reversed(rules), reversed(values[:-1]), strict=True):
        out = F.when(condition, value).otherwise(out)
    return items.withColumn("c", out).select(*items.columns, "c.*")


def period_bucket(date: Column) -> Column:
    """Before 1964, to 1985, after; a bad year counts as 1985."""
    year = F.coalesce(F.substring(date, 1, 4).try_cast("int"), F.lit(1985))
    return F.when(year < 1964, "pre_1964").when(year <= 1985, "1964_1985").otherwise("pos_1985")


def skip_report(items: DataFrame, listed: Sequence[int], existing: DataFrame) -> DataFrame:
    """items(key, file, slug) with `reason`: the first that applies, null for those kept."""
    known = existing.select("slug").distinct().withColumn("exists", F.lit(True))
    reason = F.when(F.col("key").isin(list(listed)), "listed").when(F.col("file").isNull() | (F.col("file") == ""), "no file").when(F.col("exists"), "slug exists")
    return items.join(known, "slug", "left").withColumn("reason", reason).drop("exists")


def override_fields(df: DataFrame, corrections: DataFrame, invalid: Sequence[str], default_state: str) -> DataFrame:
    """df(name, city, state, birth_city) with corrections(raw_name, new_name, new_city) first; words that are no places fall back to the birth city."""
    c = corrections.select(F.col("raw_name").alias("name"), "new_name", "new_city")
    joined = df.join(c, "name", "left")
    city = F.when(F.lower("city").isin(*invalid), F.col("birth_city")).otherwise(F.col("city"))
    return joined.select(F.coalesce("new_name", "name").alias("name"), F.coalesce(F.col("new_city"), city).alias("city"), F.coalesce("state", F.lit(default_state)).alias("state"))


def source_url(base: str, key: Column, file: Column) -> Column:
    """base/key/file with spaces escaped; null without a file."""
    return F.when(file.isNotNull() & (file != ""), F.concat(F.lit(f"{base}/"), key.cast("string"), F.lit("/"), F.replace(file, F.lit(" "), F.lit("%20"))))


def note_for_type(key: Column, notes: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in notes.items() for x in pair)), key)


