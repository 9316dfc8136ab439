"""Column functions on text: white space, cleaning, dates, names, labels."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Months of long-form dates.
MONTHS = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
#: Ordinal words and what they add.
ORDINALS = {
    "primeira": 1, "segunda": 2, "terceira": 3, "quarta": 4, "quinta": 5, "sexta": 6, "sétima": 7, "setima": 7, "oitava": 8, "nona": 9,
    "décima": 10, "decima": 10, "vigésima": 20, "vigesima": 20, "trigésima": 30, "trigesima": 30, "quadragésima": 40, "quadragesima": 40,
    "quinquagésima": 50, "quinquagesima": 50, "sexagésima": 60, "sexagesima": 60, "septuagésima": 70, "septuagesima": 70,
    "octogésima": 80, "octogesima": 80, "nonagésima": 90, "nonagesima": 90, "centésima": 100, "centesima": 100,
}
#: Words that join the parts of a name.
CONNECTIVES = ("de", "da", "do", "das", "dos", "e")
#: Words that stay in lower case within a name.
PARTICLES = (*CONNECTIVES, "em", "no", "na", "nos", "nas")


def strip_ws(c: Column) -> Column:
    """Trim all white space, newlines included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


# ------------------------------------------------------------------ cleaning (C1-C14)


def normalize_space(c: Column) -> Column:
    """Runs of spaces and tabs to one space, three or more newlines to two, trimmed."""
    return strip_ws(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def strip_running_lines(c: Column, patterns: Column | Sequence[str]) -> Column:
    """Remove running headers and footers in the order of their patterns (a list, or an array column of a rule table)."""
    if isinstance(patterns, Column):
        # a pattern per row can't be a literal: the fold keeps it in the expression
        return strip_ws(F.aggregate(F.coalesce(patterns, F.array().cast("array<string>")), c, lambda text, p: F.regexp_replace(text, p, F.lit(""))))
    for p in patterns:
        c = F.regexp_replace(c, f"(?m){p}", "")
    return strip_ws(c)


def strip_page_number_lines(c: Column, style: str = "bare") -> Column:
    """Empty the lines that hold a page number alone: bare, or between bars."""
    number = r"\d{1,4}" if style == "bare" else r"\|[ \t]*\d{1,4}[ \t]*\|"
    return F.regexp_replace(c, rf"(?m)^[ \t]*{number}[ \t]*$", "")


def strip_header_block(c: Column, patterns: Sequence[str]) -> Column:
    """Remove the lines at the top that match the patterns one after another, up to the first miss."""
    nested = ""
    for p in reversed(patterns):
        nested = rf"(?:(?:{p})(?:\n|\z){nested})?"
    return F.regexp_replace(c, rf"\A{nested}", "")


def dehyphenate(c: Column) -> Column:
    return F.regexp_replace(c, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")


def repair_control_chars(c: Column, mapping: dict[str, str]) -> Column:
    """Map mis-decoded characters, delete soft hyphens and zero-width characters, fold the spaces left over."""
    for bad, good in mapping.items():
        c = F.replace(c, F.lit(bad), F.lit(good))
    c = F.regexp_replace(c, "[­​‌‍﻿]|[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")
    return F.regexp_replace(c, " {2,}", " ")


def drop_glyph_lines(c: Column, max_ratio: float = 0.3) -> Column:
    """Drop lines in which private-use characters exceed a share of the line."""
    private = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"\p{Co}", ""))
    return F.array_join(F.filter(lines(c), lambda x: private(x) <= F.length(x) * max_ratio), "\n")


def repair_lines(c: Column, drop: Sequence[str], replacements: Sequence[tuple[str, str]]) -> Column:
    """Drop lines matching any pattern, then replace literally."""
    kept = lines(c)
    if drop:
        kept = F.filter(kept, lambda x: ~x.rlike("|".join(f"(?:{p})" for p in drop)))
    c = F.array_join(kept, "\n")
    for a, b in replacements:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def join_spaced_years(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^([12]) (\d) (\d) (\d)$", "$1$2$3$4")


def collapse_blank(c: Column) -> Column:
    return strip_ws(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def isolate_headings(c: Column, heading: str) -> Column:
    """Blank lines round the lines that match the heading rule."""
    return collapse_blank(F.array_join(F.transform(lines(c), lambda x: F.when(x.rlike(heading), F.concat(F.lit("\n"), x, F.lit("\n"))).otherwise(x)), "\n"))


def merge_broken_heading(c: Column, heading: str, subtitles: Sequence[str] = ()) -> Column:
    """As isolate_headings; an all-caps line before a heading that is no known subtitle belongs to it."""
    caps = r"^[\p{Lu}][\p{Lu} '.-]+$"

    def step(state: Column, line: Column) -> Column:
        joins = state["caps"] & line.rlike(heading)
        held = F.when(state["caps"] & ~line.rlike(heading), F.concat(state["out"], F.array(state["held"]))).otherwise(state["out"])
        is_caps = line.rlike(caps) & ~line.rlike(heading) & ~F.coalesce(line.isin(list(subtitles)), F.lit(False)) if subtitles else line.rlike(caps) & ~line.rlike(heading)
        full = F.when(joins, F.concat_ws(" ", state["held"], line)).otherwise(line)
        boxed = F.when(line.rlike(heading), F.concat(F.lit("\n"), full, F.lit("\n"))).otherwise(full)
        return F.struct(
            F.when(is_caps, held).otherwise(F.concat(held, F.array(boxed))).alias("out"),
            F.when(is_caps, line).otherwise(F.lit("")).alias("held"),
            is_caps.alias("caps"),
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"), F.lit(False).alias("caps"))
    end = lambda s: F.array_join(F.when(s["caps"], F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"]), "\n")
    return collapse_blank(F.aggregate(lines(c), start, step, end))


def join_wrapped_lines(c: Column) -> Column:
    """Append the next line unless the current one ends a sentence; blank lines close the paragraph."""
    trimmed = F.array_join(F.transform(lines(c), strip_ws), "\n")
    return F.regexp_replace(trimmed, r"(?<![.!?:\n])\n(?!\n)", " ")


def strip_field_labels(c: Column, labels: Sequence[str]) -> Column:
    """Remove the lines that begin with a label and a colon."""
    return collapse_blank(F.regexp_replace(c, rf"(?im)^\s*(?:{'|'.join(labels)})\s*:.*$", ""))


# ------------------------------------------------------------------ letters (Q1)


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def visible(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"(?U)\s", ""))


def alpha_ratio(c: Column) -> Column:
    return F.coalesce(F.try_divide(letters(c).cast("double"), visible(c).cast("double")), F.lit(0.0))


# ------------------------------------------------------------------ labels (S1, S8-S10, S12, S13, S18)


def first_match(c: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern that matches."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(c.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def chapter_opening(c: Column, word: str) -> Column:
    """`N – title` of a page that starts with a number line and the chapter word; the title is the lines up to the first blank one, at most four."""
    number = F.regexp_extract(c, rf"\A\s*(\d+)\s*\n\s*(?iu:{word})\s*\n", 1)
    rest = F.regexp_replace(c, rf"\A\s*\d+\s*\n\s*(?iu:{word})\s*\n\s*", "")
    title = F.array_join(F.slice(lines(F.split(rest, r"\n\s*\n")[0]), 1, 4), " ")
    return F.when(number != "", F.concat_ws(" – ", number, strip_ws(title)))


def caps_heading(c: Column) -> Column:
    """The first line where it is an annex number, or longer than 15 letters and all upper case."""
    first = strip_ws(F.split_part(c, F.lit("\n"), F.lit(1)))
    return F.when(first.rlike(r"^ANEXO [IVXLCDM]+\b") | ((letters(first) > 15) & (F.upper(first) == first)), first)


def person_heading(line: Column, style: str = "title", stop: Sequence[str] = ()) -> Column:
    """Whether a line is the heading of a person: caps with years, a sigla with a name, or a title-case name."""
    if style == "caps":
        return line.rlike(r"^[\p{Lu}][\p{Lu} '.-]+\s*\(\d{4}\s*[-–]\s*\d{4}\)$")
    if style == "sigla":
        return line.rlike(r"^\p{Lu}{2,}\s+-\s+\p{Lu}")
    name = strip_ws(F.regexp_replace(line, r"\s*\([^)]*\)\s*$", ""))
    words = F.split(name, " +")
    proper = F.forall(words, lambda w: w.rlike(r"^\p{Lu}[\p{L}'-]*$") | w.isin(*CONNECTIVES))
    allowed = ~line.isin(*stop) if stop else F.lit(True)
    return F.size(words).between(2, 6) & proper & ~name.rlike(r"[.,;:!?]") & words[0].rlike(r"^\p{Lu}") & allowed


def spelled_ordinal(c: Column) -> Column:
    """Sum of the ordinal words of a text; null without one."""
    table = F.create_map(*(F.lit(x) for pair in ORDINALS.items() for x in pair))
    found = F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+)"), 1), lambda w: F.map_contains_key(table, w))
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0), lambda a, w: a + F.element_at(table, w)))


#: The accented letters of the documents and their plain ones.
_ACCENTED, _PLAIN = "áàâãäéèêëíìîïóòôõöúùûüç", "aaaaaeeeeiiiiooooouuuuc"
#: Marks that follow the digits of an ordinal.
_ORDINAL_MARKS = "ºª°*"


def plain_lower(c: Column) -> Column:
    """Lower case without the accents of _ACCENTED, in the JVM."""
    return F.translate(F.lower(c), _ACCENTED, _PLAIN)


def session_number(c: Column) -> Column:
    """Number of the public session that the first fitting line (at most 250 characters) opens: the marked digits before its title, else ordinal words."""
    title = r"audiencia\s+publica"

    def number(line: Column) -> Column:
        found = F.regexp_extract(plain_lower(line), rf"(?<!\d)(\d{{1,3}})\s*[{_ORDINAL_MARKS}]\s*{title}", 1)
        return F.coalesce(F.when(found != "", found).cast("int"), spelled_ordinal(line))

    def opens(line: Column) -> Column:
        return (F.length(line) <= 250) & plain_lower(line).rlike(title) & plain_lower(line).rlike("instala(?:d[ao]|cao)")

    numbers = F.transform(F.filter(F.transform(lines(c), strip_ws), opens), number)
    return F.get(F.filter(numbers, lambda n: n.isNotNull()), F.lit(0))


def session_date(c: Column, first: int = 2012, last: int = 2015) -> Column:
    """The first numeric date if its year fits, else the first long-form one (day, month in words, year, with or without "de" between) under the same test."""
    text, months = plain_lower(c), F.array(*(plain_lower(F.lit(m)) for m in MONTHS))
    joint = r"(?:\s+de\s+|\s+)"

    def date(pattern: str, month: Callable[[Column], Column]) -> Column:
        day, middle, year = (F.regexp_extract(text, rf"(?<!\d){pattern}(?!\d)", i) for i in (1, 2, 3))
        found = F.try_to_date(F.concat_ws("-", year, F.lpad(month(middle), 2, "0"), F.lpad(day, 2, "0")))
        return F.when(F.year(found).between(first, last), found)

    return F.coalesce(
        date(r"(\d{1,2})[-/](\d{1,2})[-/](\d{4})", lambda m: m),
        date(rf"(\d{{1,2}}){joint}(\p{{L}}{{3,}}){joint}(\d{{4}})", lambda m: F.array_position(months, m).cast("string")),
    )


def footnote_class(c: Column) -> Column:
    return F.when(F.split_part(c, F.lit("\n"), F.lit(1)).rlike(r"^\d{1,3}\s*[–-]\s+\S"), "footnote").otherwise("body")


def page_first(label: Column) -> Column:
    """First page of an "N" or "N-M" label."""
    return F.split_part(label, F.lit("-"), F.lit(1)).try_cast("int")


def page_label(pages: Column) -> Column:
    low, high = F.array_min(pages), F.array_max(pages)
    return F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low.cast("string"), high.cast("string")))


# ------------------------------------------------------------------ records (P2-P8, P13)


def _iso(day: Column, month: Column, year: Column) -> Column:
    full = F.when(F.length(year) == 4, year.cast("int")).otherwise(F.when(year.cast("int") < 60, 2000 + year.cast("int")).otherwise(1900 + year.cast("int")))
    return F.date_format(F.try_make_date(full, month.cast("int"), day.cast("int")) if hasattr(F, "try_make_date") else F.try_to_date(F.concat_ws("-", full.cast("string"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))), "yyyy-MM-dd")


_DMY = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})"


def parse_dmy(c: Column) -> Column:
    """d/m/y or d-m-y to ISO; two-digit years under 60 are of this century; null where it is no date."""
    g = [F.nullif(F.regexp_extract(c, _DMY, i), F.lit("")) for i in (1, 2, 3)]
    return _iso(g[0], g[1], g[2])


def parse_ambiguous_date(c: Column) -> Column:
    """As parse_dmy where a part above 12 tells the day; month first where both could be either."""
    a, b, y = (F.nullif(F.regexp_extract(c, _DMY, i), F.lit("")) for i in (1, 2, 3))
    day_first = a.cast("int") > 12
    return _iso(F.when(day_first, a).otherwise(b), F.when(day_first, b).otherwise(a), y)


#: Words that stand for nothing known.
UNKNOWN = ("não se aplica", "nao se aplica", "não identificado", "nao identificado", "não identificada", "nao identificada", "não consta", "ignorado", "desconhecido", "")
#: Words that stand for no place.
NO_PLACE = (*UNKNOWN, "exterior")


def null_words(c: Column, words: Iterable[str] = UNKNOWN) -> Column:
    return F.when(~F.lower(strip_ws(c)).isin(*words), c)


def parse_place(c: Column) -> Column:
    """struct(city, state): a date in front goes, unknown words are null; `City (UF)` gives both."""
    place = null_words(F.regexp_replace(strip_ws(F.regexp_replace(c, rf"^\s*{_DMY}\s*,?", "")), r"\s*,$", ""), NO_PLACE)
    pair = r"^(.*?)\s*\(([A-Za-z]{2})\)\s*\.?$"
    state = F.nullif(F.upper(F.regexp_extract(place, pair, 2)), F.lit(""))
    return F.struct(F.when(state.isNotNull(), F.regexp_replace(F.regexp_extract(place, pair, 1), r"\s*,$", "")).otherwise(place).alias("city"), state.alias("state"))


def title_case_name(c: Column) -> Column:
    """Names in capitals, or that begin in lower case, to title case, particles lower but at the start; all others are trimmed alone."""
    words = F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != "")
    cased = F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*PARTICLES), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))))
    mixed = c.rlike(r"^\p{Lu}") & c.rlike(r"\p{Ll}")
    return F.when(mixed, strip_ws(c)).otherwise(F.array_join(cased, " "))


@pandas_udf(StringType())
def fold_text(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without marks, lower case, single spaces; null stays null."""
    return s.map(lambda t: " ".join("".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch)).lower().split()), na_action="ignore")


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold_text(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def source_slug(prefix: str, key: Column, title: Column) -> Column:
    """prefix, key and the first four words of the title longer than two letters."""
    words = F.filter(F.split(F.regexp_replace(fold_text(title), "[^a-z0-9 ]", ""), " +"), lambda w: F.length(w) > 2)
    return F.concat_ws("-", F.lit(prefix), key.cast("string"), F.array_join(F.slice(words, 1, 4), "-"))


def year_span(c: Column, first: int = 1960, last: int = 1985) -> Column:
    """struct(start, end): first and last day of the years in the range that a text names."""
    years = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"\b(\d{4})\b"), 1), lambda y: y.cast("int")), lambda y: y.between(first, last))
    return F.struct(F.make_date(F.array_min(years), F.lit(1), F.lit(1)).alias("start"), F.make_date(F.array_max(years), F.lit(12), F.lit(31)).alias("end"))


def keyword_tags(c: Column, rules: Sequence[tuple[str, str]], vocabulary: Sequence[str] | None = None, default: str | None = None) -> Column:
    """Distinct labels of all patterns that match, of a vocabulary where one is given; the default where none does."""
    found = F.array_distinct(F.array_compact(F.array(*(F.when(c.rlike(p), F.lit(label)) for p, label in rules if vocabulary is None or label in vocabulary))))
    return F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found) if default is not None else found


def cut_with_mark(c: Column, n: int, mark: str) -> Column:
    """At most n characters, right-trimmed and marked where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.regexp_replace(F.substring(c, 1, n), r"(?U)\s+$", ""), F.lit(mark))).otherwise(c)


def split_summary(c: Column) -> Column:
    """struct(summary, answer): divided at the first line of three or more dashes; labels at the start of either side go, all is the answer if a side is empty.

    A label is the side's name, with or without its part's number before it and a colon after it.
    """
    label = lambda part, name: rf"(?iU)\A\s*(?:parte\s*{part}\s*[—-]?\s*)?{name}\s*:?\s*"
    at = F.regexp_instr(c, F.lit(r"(?m)^[ \t]*-{3,}[ \t]*$"))
    head = strip_ws(F.regexp_replace(F.substring(c, F.lit(1), F.greatest(at - 1, F.lit(0))), label(1, "resumo"), ""))
    tail = strip_ws(F.regexp_replace(F.regexp_replace(F.substr(c, at), r"\A[ \t]*-{3,}[ \t]*", ""), r"\A\s+", ""))
    tail = strip_ws(F.regexp_replace(tail, label(3, r"resposta(?:\s+completa)?"), ""))
    divided = (at > 0) & (head != "") & (tail != "")
    return F.struct(F.when(divided, head).otherwise(F.lit("")).alias("summary"), F.when(divided, tail).otherwise(strip_ws(c)).alias("answer"))
