"""Queries on page texts: cleaning, quality, sections, chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import text as t
from folium.operators import chunks as k
from folium.operators import quality as q
from folium.operators import sections as s
from folium.sources.shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages: the id is the page number."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.col("doc_id").alias("page"), "text")


_PAGES = "WITH p AS (SELECT source, doc_id AS page, text FROM documents) "


def _register(name: str, sql: str | None = None):
    def keep(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(pages(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql if sql.startswith("WITH ") else _PAGES + sql
        return f

    return keep


# ------------------------------------------------------------------ cleaners: a column function and its SQL

_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_BLANK = _STRIP.format("regexp_replace({}, '\\n{{3,}}', chr(10) || chr(10), 'g')")
_WORD_LINE = r"^[\p{Lu}]\p{L}*\.$"
CLEANERS: dict[str, tuple[Callable[[Column], Column], str | None]] = {
    "c1_normalize_space": (t.normalize_space, _BLANK.format("regexp_replace(text, '[ \\t]+', ' ', 'g')")),
    "c2_strip_running_lines": (lambda c: t.strip_running_lines(c, [_WORD_LINE, "^The$"]), _STRIP.format(f"regexp_replace(regexp_replace(text, '(?m){_WORD_LINE}', '', 'g'), '(?m)^The$', '', 'g')")),
    "c3_strip_page_number_lines": (t.strip_page_number_lines, r"regexp_replace(text, '(?m)^[ \t]*\d{1,4}[ \t]*$', '', 'g')"),
    "c4_strip_header_block": (lambda c: t.strip_header_block(c, [r"\p{Lu}[^\n]*", r"[^\n]*\."]), r"regexp_replace(text, '\A(?:(?:\p{Lu}[^\n]*)(?:\n|\z)(?:(?:[^\n]*\.)(?:\n|\z))?)?', '')"),
    "c5_dehyphenate": (t.dehyphenate, r"regexp_replace(text, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g')"),
    "c6_repair_control_chars": (lambda c: t.repair_control_chars(c, {"|": "—"}), r"regexp_replace(regexp_replace(replace(text, '|', '—'), '[\x{AD}\x{200B}-\x{200D}\x{FEFF}]|[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), ' {2,}', ' ', 'g')"),
    "c7_drop_glyph_lines": (t.drop_glyph_lines, r"array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(x) - length(regexp_replace(x, '\p{Co}', '', 'g')) <= length(x) * 0.3), chr(10))"),
    "c9_join_spaced_years": (t.join_spaced_years, r"regexp_replace(text, '(?m)^([12]) (\d) (\d) (\d)$', '\1\2\3\4', 'g')"),
    "c10_isolate_headings": (lambda c: t.isolate_headings(c, _WORD_LINE), _BLANK.format(f"array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(x, '{_WORD_LINE}') THEN chr(10) || x || chr(10) ELSE x END), chr(10))")),
    "c11_merge_broken_heading": (lambda c: t.merge_broken_heading(c, r"\(\d{4}"), None),
    "c12_join_wrapped_lines": (t.join_wrapped_lines, None),
    "c13_strip_field_labels": (lambda c: t.strip_field_labels(c, ["token", "contact"]), _BLANK.format(r"regexp_replace(text, '(?im)^\s*(?:token|contact)\s*:.*$', '', 'g')")),
    "c14_collapse_blank": (t.collapse_blank, _BLANK.format("text")),
}
#: What two of three pages are given first, so that a cleaner has something to do: a piece of text and what stands in its place.
PLANTED = {
    "c1_normalize_space": ((" ", " \t "), ("\n", "\n\n\n\n")),
    "c3_strip_page_number_lines": (("\n", "\n 12\t\n"),),
    "c5_dehyphenate": (("th", "t-\nh"), ("en", "e-\nn")),
    "c7_drop_glyph_lines": (("\n", "\n\ue000\ue001ab\n\ue000 one private mark\n"),),
    "c9_join_spaced_years": (("\n", "\n1 9 6 4\n"),),
    "c13_strip_field_labels": (("\n", "\nContact : x y\n"),),
    "c14_collapse_blank": (("\n", "\n\n\n\n"),),
}


def _planted(name: str) -> Column:
    """The text of a page with what is planted for a query."""
    text = F.col("text")
    for old, new in PLANTED.get(name, ()):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.when(F.col("page") % 3 > 0, text).otherwise(F.col("text"))


def _cleaned_sql(name: str, cleaner: str) -> str:
    text = "text"
    for old, new in PLANTED.get(name, ()):
        text = f"replace({text}, {_quoted(old)}, {_quoted(new)})"
    return f"SELECT page, length(x) AS n, md5(x) AS digest FROM (SELECT page, {cleaner} AS x FROM (SELECT page, CASE WHEN page % 3 > 0 THEN {text} ELSE text END AS text FROM p))"


def _quoted(text: str) -> str:
    return "'" + text.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


for _name, (_column, _sql) in CLEANERS.items():
    def _clean(p: DataFrame, f: Callable[[Column], Column] = _column, name: str = _name) -> DataFrame:
        return p.select("page", _planted(name).alias("text")).select("page", f(F.col("text")).alias("x")).select("page", F.length("x").cast("long").alias("n"), F.md5("x").alias("digest"))

    _register(_name, _sql and _cleaned_sql(_name, _sql))(_clean)


@_register("c8_repair_ocr_range", r"""SELECT page, md5(CASE WHEN page BETWEEN 100 AND 400 THEN replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\p{Lu}\p{L}*\.$')), chr(10)), '***', '') ELSE text END) AS digest FROM p""")
def _c8(p: DataFrame) -> DataFrame:
    fixed = t.repair_lines(F.col("text"), [_WORD_LINE], [("***", "")])
    return p.select("page", F.md5(F.when(F.col("page").between(100, 400), fixed).otherwise(F.col("text"))).alias("digest"))


# ------------------------------------------------------------------ quality

_ALPHA = r"length(regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g'))"
_VISIBLE = r"length(regexp_replace(coalesce(text, ''), '\s', '', 'g'))"
_RATIO = f"CASE WHEN {_VISIBLE} = 0 THEN 0.0 ELSE {_ALPHA}::DOUBLE / {_VISIBLE} END"
_LOG = f"SELECT source, page, CASE WHEN {_VISIBLE} = 0 THEN 'em_branco' ELSE 'baixa_qualidade' END AS reason, {_ALPHA} AS alpha, round({_RATIO}, 4) AS ratio FROM p WHERE NOT ({_ALPHA} >= 300 AND {_RATIO} >= 0.75)"
_gate = {"min_alpha": 300, "min_ratio": 0.75}

_register("q1_alpha_stats", f"SELECT page, {_ALPHA} AS alpha, {_VISIBLE} AS visible, round({_RATIO}, 9) AS ratio FROM p")(lambda p: q.alpha_stats(p).select("page", "alpha", "visible", F.round("ratio", 9).alias("ratio")))
_register("q2_quality_gate", f"SELECT source, page FROM p WHERE {_ALPHA} >= 300 AND {_RATIO} >= 0.75")(lambda p: q.quality_gate(p, **_gate).select("source", "page"))
_register("q3_discard_log", _LOG)(lambda p: q.discard_log(p, **_gate))
_register("q4_discard_summary", f"SELECT source, reason, count(*) AS n FROM ({_LOG}) GROUP BY ALL")(lambda p: q.discard_summary(q.discard_log(p, **_gate)))
_register("q5_skip_toc", r"SELECT source, page FROM p WHERE len(regexp_extract_all(coalesce(text, ''), '\.{5,}')) < 3")(lambda p: q.skip_toc(p).select("source", "page"))
_register("q6_exclude_pages", "SELECT source, page FROM p WHERE NOT EXISTS (SELECT 1 FROM (SELECT source AS s, min(page) AS a, min(page) + 200 AS b FROM p GROUP BY source) WHERE s = source AND page BETWEEN a AND b)")(
    lambda p: q.exclude_pages(p, p.groupBy("source").agg(F.min("page").alias("first"), (F.min("page") + 200).alias("last"))).select("source", "page")
)
_register("q7_effective_page", "SELECT source, CASE WHEN source = 'src1' AND page // 20 <= 14 THEN page // 20 ELSE page END AS page FROM p")(
    lambda p: q.effective_page(p.withColumn("line_no", F.floor(F.col("page") / 20).cast("long")), "src1").select("source", "page")
)
_register("q8_text_coverage", "WITH p AS (SELECT source, page, CASE WHEN source < 'src12' AND page % 3 > 0 THEN NULL WHEN page % 5 = 0 THEN ' ' ELSE text END AS text FROM documents_as_pages) SELECT source, count(*) AS pages, count(*) FILTER (length(trim(coalesce(text, ''))) > 0) AS with_text, coalesce(sum(length(text)), 0)::BIGINT AS characters, round(100.0 * count(*) FILTER (length(trim(coalesce(text, ''))) > 0) / count(*), 2)::DOUBLE AS percent, count(*) FILTER (length(trim(coalesce(text, ''))) > 0) <= 0.5 * count(*) AS scanned FROM p GROUP BY source".replace("documents_as_pages", "(SELECT source, doc_id AS page, text FROM documents)"))(
    lambda p: q.text_coverage(p.withColumn("text", F.when((F.col("source") < "src12") & (F.col("page") % 3 > 0), None).when(F.col("page") % 5 == 0, " ").otherwise(F.col("text"))))
)
_register("q9_patch_pages", "SELECT source, page, md5(CASE WHEN page % 3 = 0 AND page BETWEEN 50 AND 500 THEN text || '!' ELSE text END) AS digest FROM p")(
    lambda p: q.patch_pages(p, p.where("page % 3 = 0").withColumn("text", F.concat("text", F.lit("!"))), 50, 500).select("source", "page", F.md5("text").alias("digest"))
)
_register("q10_pending_pages", "SELECT source, page FROM p WHERE page % 4 <> 0")(lambda p: q.pending_pages(p, p.where("page % 4 = 0")).select("source", "page"))

# ------------------------------------------------------------------ sections

_RULES = [(r"(?i)licensed|license", "license"), (r"[%*$&#]{3}", "junk"), (r"(?i)token\s*=", "secret"), (r"\|", "table")]


def _ranges(p: DataFrame, step: int, prefix: str = "") -> DataFrame:
    """Every step-th page starts a range of its source."""
    return p.where(F.col("page") % step == 0).select("source", F.col("page").alias("start"), F.concat(F.lit(prefix), (F.floor(F.col("page") / 100)).cast("string"), F.lit("."), F.col("page").cast("string")).alias("label"))


_ASOF = "(SELECT source, page AS start, lead(page) OVER (PARTITION BY source ORDER BY page) AS stop, (page // 100)::VARCHAR || '.' || page AS label FROM p WHERE page % {step} = 0)"
_register("s1_chapter_opening")(lambda p: p.select("page", t.chapter_opening(F.concat(F.col("page").cast("string"), F.lit("\nCapítulo\n"), F.col("text")), "capítulo").alias("section")))
_register("s2_running_section")(lambda p: s.running_section(p.withColumn("text", F.concat_ws("\n", F.concat((F.col("page") % 30).cast("string"), F.lit(" – "), F.substring("text", 1, 20)), "text")), 20).select("page", "detected", F.md5("text").alias("digest")))
_register("s3_section_by_range", f"SELECT p.source, p.page, r.label AS section FROM p LEFT JOIN {_ASOF.format(step=7)} r ON r.source = p.source AND p.page >= r.start AND (r.stop IS NULL OR p.page < r.stop)")(lambda p: s.section_by_range(p, _ranges(p, 7)).select("source", "page", "section"))
_register("s4_subsection_coherent", f"SELECT p.source, p.page, a.label AS section, CASE WHEN split_part(a.label, '.', 1) = split_part(b.label, '.', 1) THEN b.label END AS subsection FROM p LEFT JOIN {_ASOF.format(step=7)} a ON a.source = p.source AND p.page >= a.start AND (a.stop IS NULL OR p.page < a.stop) LEFT JOIN {_ASOF.format(step=3)} b ON b.source = p.source AND p.page >= b.start AND (b.stop IS NULL OR p.page < b.stop)")(
    lambda p: s.subsection_coherent(p, _ranges(p, 7), _ranges(p, 3)).select("source", "page", "section", "subsection")
)
_register("s7_carry_section", "SELECT source, page, last_value(CASE WHEN page % 5 = 0 THEN 'S' || page END IGNORE NULLS) OVER (PARTITION BY source ORDER BY page ROWS UNBOUNDED PRECEDING) AS section FROM p")(
    lambda p: s.carry_section(p.select("source", "page", F.when(F.col("page") % 5 == 0, F.concat(F.lit("S"), F.col("page"))).alias("detected"))).select("source", "page", "section")
)
_CASE = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{label}'" for p, label in _RULES) + " ELSE 'other' END"
_register("s8_classify_by_rules", f"SELECT page, {_CASE} AS label FROM p")(lambda p: p.select("page", t.first_match(F.col("text"), _RULES, "other").alias("label")))
_register("s9_caps_heading", r"SELECT page, CASE WHEN regexp_matches(x, '^ANEXO [IVXLCDM]+\b') OR (length(regexp_replace(x, '[^\p{L}]', '', 'g')) > 15 AND upper(x) = x) THEN x END AS heading FROM (SELECT page, regexp_replace(split_part(CASE WHEN page % 2 = 0 THEN upper(replace(text, 'ß', 'ss')) ELSE text END, chr(10), 1), '^\s+|\s+$', '', 'g') AS x FROM p)")(
    lambda p: p.select("page", t.caps_heading(F.when(F.col("page") % 2 == 0, F.upper(F.replace("text", F.lit("ß"), F.lit("ss")))).otherwise(F.col("text"))).alias("heading"))
)
_HEADS = ("'ABC - Maria de Souza'", "'JOÃO D''ÁVILA (1940-1970)'", "'Maria de Souza (Lia)'", "text", "'Comissão Nacional da Verdade e da'", "'A B C D E F G'", "'Maria, de Souza'")
_FIRST_LINE = f"split_part(CASE page % {len(_HEADS)} " + " ".join(f"WHEN {i} THEN {h}" for i, h in enumerate(_HEADS)) + " END, chr(10), 1)"
_TITLE = r"regexp_replace(line, '\s*\([^)]*\)\s*$', '')"
_register("s10_profile_heading", rf"""SELECT page, regexp_matches(line, '^\p{{Lu}}{{2,}}\s+-\s+\p{{Lu}}') AS sigla, regexp_matches(line, '^[\p{{Lu}}][\p{{Lu}} ''.-]+\s*\(\d{{4}}\s*[-–]\s*\d{{4}}\)$') AS caps,
len(w) BETWEEN 2 AND 6 AND len(list_filter(w, lambda x: NOT (regexp_matches(x, '^\p{{Lu}}[\p{{L}}''-]*$') OR x IN {t.CONNECTIVES}))) = 0 AND NOT regexp_matches(name, '[.,;:!?]') AND regexp_matches(w[1], '^\p{{Lu}}') AND line NOT IN ('Comissão Nacional da Verdade e da') AS title
FROM (SELECT *, regexp_split_to_array(name, ' +') AS w FROM (SELECT *, {_STRIP.format(_TITLE)} AS name FROM (SELECT page, {_FIRST_LINE} AS line FROM p)))""")(
    lambda p: p.select("page", F.split_part(F.when(F.col("page") % len(_HEADS) == 3, F.col("text")).otherwise(F.get(F.array(*(F.lit(h.strip("'").replace("''", "'")) for h in _HEADS)), (F.col("page") % len(_HEADS)).cast("int"))), F.lit("\n"), F.lit(1)).alias("line")).select(
        "page", *(t.person_heading(F.col("line"), style, ["Comissão Nacional da Verdade e da"]).alias(style) for style in ("sigla", "caps", "title"))
    )
)
_register("s11_section_per_paragraph")(lambda p: s.section_per_paragraph(k.paragraphs(p, "\n"), "^[A-D]", "^Z", F.col("text").rlike(_WORD_LINE)).select("source", "page", "para_no", "section"))
_register("s13_session_detect", """SELECT source, page, CASE WHEN page % 5 = 4 THEN 70 ELSE 1 + page % 90 END::INT AS number, make_date(2011 + page % 6, 3, 1 + page % 28) AS date FROM p WHERE page % 3 > 0 AND page % 6 BETWEEN 1 AND 4
UNION ALL SELECT source, page, CASE WHEN page % 5 = 4 THEN 70 ELSE 1 + page % 90 END::INT, NULL FROM p WHERE page % 3 > 0 AND page % 6 NOT BETWEEN 1 AND 4""")(
    lambda p: s.session_detect(p.withColumn("text", F.concat(
        F.lit("Há 10 anos foi "), F.get(F.array(*map(F.lit, ("aberta", "instalada", "Instalação"))), (F.col("page") % 3).cast("int")), F.lit(" a "),
        F.when(F.col("page") % 5 == 4, "septuagésima").otherwise(F.concat((1 + F.col("page") % 90).cast("string"), F.get(F.array(*map(F.lit, "ªº°*")), (F.col("page") % 5).cast("int")))),
        F.lit(" audiência pública\n"), (1 + F.col("page") % 28).cast("string"), F.lit("-3-"), (2011 + F.col("page") % 6).cast("string"), F.lit("\n"), F.col("text"))))
)
_register("s14_sessions_to_ranges", "SELECT source, page AS start, (page // 50)::VARCHAR || 'ª audiência pública' AS label FROM (SELECT *, lag(page // 50) OVER (PARTITION BY source ORDER BY page) AS b FROM p) WHERE b IS DISTINCT FROM page // 50")(
    lambda p: s.sessions_to_ranges(p.select("source", "page", F.floor(F.col("page") / 50).alias("number"), F.lit(None).cast("date").alias("date")))
)
_register("s15_relabel_chunks", f"SELECT p.source, p.page AS ordinal, coalesce(r.label, 'old') AS section FROM p LEFT JOIN {_ASOF.format(step=7)} r ON r.source = p.source AND p.page >= r.start AND (r.stop IS NULL OR p.page < r.stop)")(
    lambda p: s.relabel_chunks(p.select("source", F.col("page").alias("ordinal"), F.concat_ws("-", "page", F.col("page") + 1).alias("pages"), F.lit("old").alias("section")), _ranges(p, 7), keep_below_first=True).select("source", "ordinal", "section")
)
_register("s16_label_diff", "SELECT source, page AS ordinal, CASE WHEN page % 3 > 0 THEN 'a' END AS section, CASE WHEN page % 2 > 0 AND page % 7 > 0 THEN 'a' END AS new_section FROM p WHERE (CASE WHEN page % 3 > 0 THEN 'a' END) IS DISTINCT FROM (CASE WHEN page % 2 > 0 AND page % 7 > 0 THEN 'a' END)")(
    lambda p: s.label_diff(p.select("source", F.col("page").alias("ordinal"), F.when(F.col("page") % 3 > 0, "a").alias("section")), p.where("page % 7 > 0").select("source", F.col("page").alias("ordinal"), F.when(F.col("page") % 2 > 0, "a").alias("section")))
)
_register("s17_rename_labels", "SELECT source, page, CASE WHEN page % 4 = 1 THEN 'new1' || source ELSE 'l' || (page % 4) END AS section FROM p")(
    lambda p: s.rename_labels(p.select("source", "page", F.concat(F.lit("l"), F.col("page") % 4).alias("section")), p.select("source").distinct().select("source", F.lit("l1").alias("old"), F.concat(F.lit("new1"), "source").alias("new"))).select("source", "page", "section")
)
_register("s18_footnote_class", r"SELECT page, CASE WHEN regexp_matches(split_part((page % 1500)::VARCHAR || ' – ' || text, chr(10), 1), '^\d{1,3}\s*[–-]\s+\S') THEN 'footnote' ELSE 'body' END AS kind FROM p")(
    lambda p: p.select("page", t.footnote_class(F.concat((F.col("page") % 1500).cast("string"), F.lit(" – "), "text")).alias("kind"))
)
_register("s19_stamp_from_marker", "SELECT source, page AS ordinal, CASE WHEN sec = 's1' AND bool_or(contains(text, 'token')) OVER (PARTITION BY source, sec ORDER BY page ROWS UNBOUNDED PRECEDING) THEN 'note' END AS note FROM (SELECT *, 's' || (page // 300) AS sec FROM p)")(
    lambda p: s.stamp_from_marker(p.select("source", F.col("page").alias("ordinal"), "text", F.concat(F.lit("s"), F.floor(F.col("page") / 300)).alias("section"), F.lit(None).cast("string").alias("note")), "s1", "token", "note").select("source", "ordinal", "note")
)
_register("s20_patch_source_fields", "SELECT source, CASE WHEN source = 'src1' THEN 'patched' ELSE 'n' || count(*) END AS note FROM p GROUP BY source")(
    lambda p: s.patch_source_fields(p.groupBy("source").agg(F.concat(F.lit("n"), F.count(F.lit(1))).alias("note")), p.select("source").distinct().where("source in ('src1', 'src2')").withColumn("note", F.when(F.col("source") == "src1", "patched")))
)

# ------------------------------------------------------------------ chunks

_TOKENS = r"len(regexp_extract_all(coalesce({}, ''), '[\p{{L}}\p{{N}}\p{{M}}_]+|[^\p{{L}}\p{{N}}\p{{M}}_\s]'))"
_register("k1_paragraphs", r"SELECT page, (row_number() OVER (PARTITION BY page ORDER BY i) - 1) AS para_no, md5(x) AS digest FROM (SELECT page, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS x FROM p) WHERE x <> ''")(
    lambda p: k.paragraphs(p, "\n").select("page", F.col("para_no").cast("long").alias("para_no"), F.md5("text").alias("digest"))
)
_register("k2_split_oversized")(lambda p: k.split_oversized(k.paragraphs(p, "\n")).groupBy("page").agg(F.count(F.lit(1)).alias("units"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest")))
_register("k9_count_tokens", f"SELECT page, {_TOKENS.format('text')} AS tokens FROM p")(lambda p: p.select("page", k.count_tokens("text").cast("long").alias("tokens")))


def _sectioned(p: DataFrame) -> DataFrame:
    return s.section_by_range(p, _ranges(p, 7))


def _chunks(p: DataFrame) -> DataFrame:
    """A run of pages is a section here, so packing spreads beyond the sources."""
    return k.build_chunks(_sectioned(p), sep="\n")


_register("k3_pack_chunks")(lambda p: _chunks(p).select("source", "ordinal", "pages", "section", "tokens", F.md5("text").alias("digest")))
_register("k7_split_overlong")(lambda p: k.split_overlong(p.withColumn("tokens", k.count_tokens("text"))).select("page", "part", "tokens"))
_register("k8_renumber", "SELECT source, page, row_number() OVER (PARTITION BY source ORDER BY page) - 1 AS ordinal FROM p")(lambda p: k.renumber(p, ["page"]).select("source", "page", F.col("ordinal").cast("long").alias("ordinal")))


def _cleaned(p: DataFrame) -> DataFrame:
    """Cleaned pages that pass the gate, written once: labels and chunks read them several times."""
    return written(q.quality_gate(p.withColumn("text", t.collapse_blank(t.normalize_space(F.col("text"))))), "pages-cleaned")


_register("chunk_stats")(lambda p: k.chunk_stats(_chunks(_cleaned(p))))
_register("k10_chunk_stats", f"SELECT source, count(*) AS chunks, min(n) AS min_tokens, median(n) AS median_tokens, max(n) AS max_tokens, count(*) FILTER (n > 512) AS over_limit, avg((page % 3 > 0)::INT) AS with_section FROM (SELECT *, {_TOKENS.format('text')} AS n FROM p) GROUP BY source")(
    lambda p: k.chunk_stats(p.withColumns({"tokens": k.count_tokens("text").cast("long"), "section": F.when(F.col("page") % 3 > 0, "s")}))
)
