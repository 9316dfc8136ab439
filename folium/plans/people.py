"""Queries on entity mining, record extraction and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import text as t
from folium.operators import mining as m
from folium.operators import records as p
from folium.operators import validate as v
from folium.sources import files
from folium.streaming.quota import quota_flags

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("source", F.col("doc_id").alias("ordinal"), "text", F.concat(F.lit("title "), "source").alias("title"))


# ------------------------------------------------------------------ mining

_TERM = "token|licensed|idiot"


@_register("m1_prefilter", f"SELECT source, doc_id AS ordinal FROM documents WHERE regexp_matches(text, '(?i){_TERM}')")
def _m1(spark, d):
    return m.prefilter(_chunks(spark, d), _TERM).select("source", "ordinal")


@_register("m2_term_windows", r"""WITH s AS (SELECT doc_id, text, string_split(lower(text), 'the') AS parts FROM documents WHERE contains(lower(text), 'the')),
u AS (SELECT doc_id, text, unnest(range(1, len(parts))) AS i, parts FROM s),
w AS (SELECT doc_id, text, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + 3 * (i - 1))::BIGINT AS pos FROM u),
x AS (SELECT doc_id, pos, substr(text, greatest(pos - 130, 0) + 1, least(pos, 130) + 133) AS span FROM w)
SELECT doc_id AS ordinal, pos AS start, md5(span) AS digest, least(pos, 130) AS place FROM x WHERE NOT regexp_matches(span, '(?i)licensed|token')""")
def _m2(spark, d):
    w = m.term_windows(_chunks(spark, d), "the", ["licensed", "token"])
    return w.select("ordinal", F.col("start").cast("long").alias("start"), F.md5("window").alias("digest"), F.col("at").cast("long").alias("place"))


def _mined(spark: SparkSession, d: str) -> DataFrame:
    """Two capitalised words next to a sentence end stand for names."""
    joined = _chunks(spark, d).withColumn("text", F.regexp_replace("text", r"\. (\p{Lu}\p{Ll}+) (\p{Ll})(\p{Ll}+)", ". $1 de $1 $2$3"))
    return m.mine(joined, _TERM, explicit="token|licensed", person=r"\bthe\b")


@_register("m4_nearest_name")
def _m4(spark, d):
    return _mined(spark, d).select("name", "confidence", "excerpt")


@_register("m9_group_candidates")
def _m9(spark, d):
    return m.group_candidates(_mined(spark, d)).select("key", "name", "confidence", "evidence", F.size("excerpts").alias("excerpts"))


@_register("m10_known_entities", """WITH c AS (SELECT c_custkey, lower(c_name) || ' ' || lower(c_mktsegment) AS n FROM customer),
k AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN n || ' extra' WHEN 1 THEN n WHEN 2 THEN substr(n, 5, 16) ELSE 'x' || substr(n, 3) || 'y' END AS key FROM c),
p AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN substr(n, 4, 17) ELSE n END AS p FROM c WHERE c_custkey % 2 = 0 UNION ALL SELECT 'auto')
SELECT key, EXISTS (SELECT 1 FROM p WHERE contains(key, p) OR contains(p, key)) AS known FROM k""")
def _m10(spark, d):
    """Names that hold each other whole, at a word's border, inside words, or not at all; a short name that a fifth of all holds."""
    c = _table(spark, d, "customer").select("c_custkey", F.lower(F.concat("c_name", F.lit(" "), "c_mktsegment")).alias("n"))
    i, n = F.col("c_custkey") % 4, F.col("n")
    cands = c.select(F.when(i == 0, F.concat(n, F.lit(" extra"))).when(i == 1, n).when(i == 2, F.substring(n, 5, 16)).otherwise(F.concat(F.lit("x"), F.substring(n, 3, 1000), F.lit("y"))).alias("key")).distinct()
    profiles = c.where("c_custkey % 2 = 0").select(F.when(F.col("c_custkey") % 3 == 0, F.substring(n, 4, 17)).otherwise(n).alias("name"))
    return m.known_entities(cands, profiles.unionByName(spark.createDataFrame([("Auto",)], "name string")))


_CAND = "WITH c AS (SELECT c_name AS name, 'n' || c_nationkey AS city, CASE c_custkey % 3 WHEN 0 THEN 'alta' WHEN 1 THEN 'media' ELSE 'baixa' END AS confidence, c_mktsegment AS seg, c_custkey AS seq, c_custkey % 2 = 0 AS known FROM customer) "


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return _table(spark, d, "customer").select(F.col("c_name").alias("name"), F.concat(F.lit("n"), "c_nationkey").alias("city"), F.when(k % 3 == 0, "alta").when(k % 3 == 1, "media").otherwise("baixa").alias("confidence"), F.col("c_mktsegment").alias("seg"), k.alias("seq"), (k % 2 == 0).alias("known"))


@_register("m11_candidate_summary", _CAND + "SELECT confidence, count(*) FILTER (known) AS known, count(*) FILTER (NOT known) AS new FROM c GROUP BY 1")
def _m11(spark, d):
    return m.candidate_summary(_candidates(spark, d))


@_register("m12_birth_headers")
def _m12(spark, d):
    c = _table(spark, d, "customer").select(F.lit("s").alias("source"), F.col("c_custkey").alias("page"), F.concat(F.lit("Maria de Souza\nFiliação: x\nData e local de nascimento: 1/2/1950, "), "c_mktsegment", F.lit(" (PR)\n")).alias("text"))
    return m.birth_headers(c)


@_register("m15_dedup_best", _CAND + "SELECT seg AS name, city, confidence, seq FROM (SELECT *, row_number() OVER (PARTITION BY lower(seg), city ORDER BY CASE confidence WHEN 'alta' THEN 1 WHEN 'media' THEN 2 ELSE 3 END, seq) AS n FROM c) WHERE n = 1")
def _m15(spark, d):
    return m.dedup_best(_candidates(spark, d).select(F.col("seg").alias("name"), "city", "confidence", "seq"))


_GAZ = "SELECT c_custkey, c_nationkey % 2 = 0 AS in_gazetteer, CASE WHEN c_custkey % 3 = 0 THEN 'alta' ELSE 'media' END AS confidence FROM customer"


def _located(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "customer").join(_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select("c_custkey", F.col("n_name").alias("city"), F.lit("PR").alias("state"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, "alta").otherwise("media").alias("confidence"))
    return m.in_gazetteer(c, _table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.upper("n_name").alias("name"), F.lit("PR").alias("state")))


@_register("m16_in_gazetteer", f"SELECT c_custkey, in_gazetteer FROM ({_GAZ})")
def _m16(spark, d):
    return _located(spark, d).select("c_custkey", "in_gazetteer")


@_register("m17_rank_candidates", "SELECT c_custkey FROM customer")
def _m17(spark, d):
    return m.rank_candidates(_located(spark, d)).select("c_custkey")


@_register("m18_review_queue", f"SELECT c_custkey FROM ({_GAZ}) WHERE NOT in_gazetteer OR confidence <> 'alta'")
def _m18(spark, d):
    return m.review_queue(_located(spark, d)).select("c_custkey")


@_register("m19_mentions", "WITH b AS (SELECT DISTINCT array_to_string(string_split(text, ' ')[1:3], ' ') AS name FROM benchmark), h AS (SELECT name, doc_id AS ordinal FROM b JOIN documents ON contains(lower(text), lower(name))) SELECT name, ordinal, false AS by_tail FROM h UNION ALL SELECT name, doc_id, true FROM b JOIN documents ON contains(lower(text), lower(array_to_string(list_slice(string_split(name, ' '), -2, -1), ' '))) WHERE name NOT IN (SELECT name FROM h)")
def _m19(spark, d):
    names = _table(spark, d, "benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("name"))
    return m.mentions(names, _chunks(spark, d)).select("name", "ordinal", "by_tail")


# ------------------------------------------------------------------ records

#: Labels of the documents' forms, here and in the queries below.
_BLOCK = "Filiação: Ana e José\nData e local de nascimento: 1/2/50, Curitiba (PR)\nData e local de morte: 3/4/1970\n"


@_register("p1_field_blocks", "SELECT c_custkey AS page, c_name AS name, '3/4/1970' AS death FROM customer")
def _p1(spark, d):
    c = _table(spark, d, "customer").select(F.lit("s").alias("source"), F.col("c_custkey").alias("page"), F.concat("c_name", F.lit(f"\n{_BLOCK}")).alias("text"))
    return p.field_blocks(c).select("page", "name", F.col("fields")["Data e local de morte"].alias("death"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.date_format("o_orderdate", "d/M/yyyy").alias("dmy"), F.date_format("o_orderdate", "d-M-yy").alias("short"))


@_register("p2_parse_dmy", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS long_form, strftime(o_orderdate, '%Y-%m-%d') AS short_form FROM orders")
def _p2(spark, d):
    return _orders(spark, d).select("o_orderkey", t.parse_dmy(F.col("dmy")).alias("long_form"), t.parse_dmy(F.col("short")).alias("short_form"))


@_register("p3_parse_ambiguous_date", "SELECT o_orderkey, CASE WHEN day(o_orderdate) > 12 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-') || lpad(day(o_orderdate)::VARCHAR, 2, '0') || '-' || lpad(month(o_orderdate)::VARCHAR, 2, '0') END AS parsed FROM orders")
def _p3(spark, d):
    return _orders(spark, d).select("o_orderkey", t.parse_ambiguous_date(F.col("dmy")).alias("parsed"))


@_register("p4_parse_place", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN NULL ELSE n_name END AS city, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 2 = 0 THEN 'PR' END AS state FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _p4(spark, d):
    c = _table(spark, d, "customer").join(_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    raw = F.when(F.col("c_custkey") % 5 == 0, "Não identificada").when(F.col("c_custkey") % 7 == 0, "3/4/1970, Exterior").when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("1/2/50, "), "n_name", F.lit(" (pr)"))).otherwise(F.col("n_name"))
    return c.select("c_custkey", t.parse_place(raw).alias("x")).select("c_custkey", "x.city", "x.state")


@_register("p5_null_words", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS value FROM customer")
def _p5(spark, d):
    return _table(spark, d, "customer").select("c_custkey", t.null_words(F.when(F.col("c_custkey") % 8 == 0, "Não identificada").when(F.col("c_custkey") % 4 == 0, " Não se aplica ").otherwise(F.col("c_name"))).alias("value"))


@_register("p6_slugify", "SELECT p_partkey, regexp_replace(regexp_replace(lower(strip_accents(p_name || ' São é')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def _p6(spark, d):
    return _table(spark, d, "part").select("p_partkey", t.slugify(F.concat("p_name", F.lit(" São é"))).alias("slug"))


@_register("p7_title_case_name", "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'Na Maria da Serra e no ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' nas em' ELSE 'Na Maria Da ' || lower(c_mktsegment) END AS name FROM customer")
def _p7(spark, d):
    raw = F.concat(F.lit("Na Maria da Serra  e no "), F.lower("c_mktsegment"), F.lit(" nas em"))
    cased = F.when(F.col("c_custkey") % 3 == 1, F.upper(raw)).when(F.col("c_custkey") % 3 == 2, F.lower(raw)).otherwise(F.concat(F.lit("Na Maria Da "), F.lower("c_mktsegment")))
    return _table(spark, d, "customer").select("c_custkey", t.title_case_name(cased).alias("name"))


@_register("p8_source_slug", "SELECT p_partkey, concat_ws('-', 'doc', p_partkey::VARCHAR, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(p_name), '[^a-z0-9 ]', '', 'g'), ' +'), lambda w: length(w) > 2)[1:4], '-')) AS slug FROM part")
def _p8(spark, d):
    return _table(spark, d, "part").select("p_partkey", t.source_slug("doc", F.col("p_partkey"), F.col("p_name")).alias("slug"))


@_register("p9_first_wins", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def _p9(spark, d):
    return p.first_wins(_table(spark, d, "documents").select("source", "doc_id"), "source", ["doc_id"])


@_register("p10_profile_chunks", "SELECT 'source-' || source AS slug, count(*) AS n, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS digest FROM documents WHERE doc_id % 2 = 0 GROUP BY source")
def _p10(spark, d):
    c = _chunks(spark, d).withColumns({"section": F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("Perfil – Source "), "source")).otherwise("Other")})
    n = c.where("ordinal % 2 = 0").groupBy(F.concat(F.lit("source-"), "source").alias("slug")).agg(F.count(F.lit(1)).alias("n"))
    return p.profile_chunks(c).join(n, "slug").select("slug", "n", F.md5("text").alias("digest"))


@_register("p10_profile_parts", "SELECT 'source-' || source AS slug, 'Source ' || source AS name, doc_id AS ordinal, md5(text) AS digest FROM documents WHERE doc_id % 2 = 0")
def _p10_parts(spark, d):
    c = _chunks(spark, d).withColumns({"section": F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("Perfil – Source "), "source")).otherwise("Other")})
    return p.profile_parts(c).select("slug", "name", "ordinal", F.md5("text").alias("digest"))


@_register("p11_header_or_fallback", "SELECT c_custkey::VARCHAR AS slug, CASE WHEN c_custkey % 2 = 0 THEN 'header' WHEN c_custkey % 3 = 0 THEN 'chunk' END AS fields FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def _p11(spark, d):
    c = _table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("slug"), "c_custkey")
    return p.header_or_fallback(c.where("c_custkey % 2 = 0").select("slug", F.lit("header").alias("fields")), c.where("c_custkey % 3 = 0").select("slug", F.lit("chunk").alias("fields")))


def _lines(spark: SparkSession, d: str, text) -> DataFrame:
    """One chunk an order, its customer the source."""
    return _table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("source"), F.col("o_orderkey").alias("page_first"), F.col("o_orderkey").alias("ordinal"), text.alias("text"))


@_register("p12_numbered_items", "SELECT o_custkey::VARCHAR AS source, (100 + o_orderkey % 50)::INT AS number, arg_max(o_orderpriority, o_orderkey) AS name, max(o_orderkey) AS page, arg_max('line ' || o_orderkey, o_orderkey) AS text FROM orders GROUP BY 1, 2")
def _p12(spark, d):
    head = F.concat((100 + F.col("o_orderkey") % 50).cast("string"), F.lit(") "), "o_orderpriority", F.lit("\nline "), F.col("o_orderkey").cast("string"), F.lit("\n(77) Another\nlost"))
    return p.numbered_items(_lines(spark, d, head))


@_register("p13_year_span", "SELECT doc_id, min(y) FILTER (y BETWEEN 1960 AND 1985) AS first, max(y) FILTER (y BETWEEN 1960 AND 1985) AS last FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text || ' ' || (1950 + doc_id % 50) || ' 1975', '\\b(\\d{4})\\b', 1), lambda x: x::INT)) AS y FROM documents) GROUP BY doc_id")
def _p13(spark, d):
    x = t.year_span(F.concat_ws(" ", "text", (1950 + F.col("doc_id") % 50).cast("string"), F.lit("1975")))
    return _table(spark, d, "documents").select("doc_id", F.year(x["start"]).alias("first"), F.year(x["end"]).alias("last"))


@_register("p15_spreadsheet_records", "SELECT o_custkey::VARCHAR AS source, (o_orderkey % 1000)::INT AS number, 'Name ' || o_orderpriority AS name, CASE WHEN o_orderkey % 4 > 0 THEN strftime(o_orderdate, '%-d/%-m/%Y') END AS birth, CASE WHEN o_orderkey % 5 > 0 THEN ['PR', 'SP', 'MG'][o_orderkey % 3 + 1] END AS state, CASE WHEN o_orderkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex, (1930 + o_orderkey % 60)::INT AS year FROM orders WHERE o_orderkey % 7 > 0")
def _p15(spark, d):
    """Records of eleven lines, a date or a state left out of some, and one in seven too short to be one."""
    k = F.col("o_orderkey")
    birth = F.when(k % 4 > 0, F.date_format("o_orderdate", "d/M/yyyy")).otherwise("s.d.")
    place = F.when(k % 5 > 0, F.concat(F.lit("Vila ("), F.get(F.array(*map(F.lit, ("PR", "SP", "MG"))), (k % 3).cast("int")), F.lit(")"))).otherwise("Vila")
    fields = [F.concat(F.lit("Name "), "o_orderpriority"), F.lit("org"), F.lit("S"), F.lit("N"), birth, F.lit("Curitiba"), F.when(k % 2 == 0, "M").otherwise("F"), F.lit("worker"), (1930 + k % 60).cast("string"), place]
    body = F.concat_ws("\n", (k % 1000).cast("string"), fields[0], F.when(k % 7 > 0, F.concat_ws("\n", *fields[1:])))
    return p.spreadsheet_records(_lines(spark, d, body))


@_register("p16_triple_blocks", "SELECT o_custkey::VARCHAR AS source, 'NAME ' || upper(o_orderpriority) AS name, 'a; b' AS sources, (o_orderkey % 7)::INT AS count FROM orders")
def _p16(spark, d):
    body = F.concat(F.lit("Header\nstray\nNAME "), F.upper("o_orderpriority"), F.lit("\na; b\n"), (F.col("o_orderkey") % 7).cast("string"))
    return p.triple_blocks(_lines(spark, d, body), "^Header$")


@_register("p17_place_pairs", "SELECT o_custkey::VARCHAR AS source, 'Hospital ' || o_orderstatus AS name, arg_max(CASE WHEN o_orderkey % 2 = 0 THEN 'Capital' ELSE 'Town' END, o_orderkey) AS city, 'MG' AS default_state FROM orders GROUP BY 1, 2")
def _p17(spark, d):
    body = F.concat(F.lit("Hospital "), "o_orderstatus", F.lit("\n"), F.when(F.col("o_orderkey") % 2 == 0, "Suburb").otherwise("Town"))
    return p.place_pairs(_lines(spark, d, body), "^Hospital", {"Suburb": "Capital"}, "MG")


@_register("p18_labelled_profiles", "SELECT 's' AS source, c_custkey AS page, upper(c_mktsegment) || ' SILVA' AS name, '1/2/1950' AS date, 'Curitiba, PR' AS place FROM customer")
def _p18(spark, d):
    c = _table(spark, d, "customer")
    return p.labelled_profiles(c.select(F.lit("s").alias("source"), F.col("c_custkey").alias("page"), F.concat(F.upper("c_mktsegment"), F.lit(" SILVA\nData e local de nascimento: 1/2/1950, Curitiba, PR\n")).alias("text")))


_TAGS = [("(?i)licensed", "license"), ("(?i)token", "secret"), (r"\|", "table")]


@_register("p19_keyword_tags", "SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)licensed') THEN 'license' END, CASE WHEN regexp_matches(text, '(?i)token') THEN 'secret' END], lambda x: x IS NOT NULL), ',') AS tags FROM documents")
def _p19(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.array_join(t.keyword_tags(F.col("text"), _TAGS, ["license", "secret"]), ",").alias("tags"))


@_register("p20_keyword_categories", r"SELECT doc_id, CASE WHEN x = '' THEN 'other' ELSE x END AS tags FROM (SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)licensed') THEN 'license' END, CASE WHEN regexp_matches(text, '(?i)token') THEN 'secret' END, CASE WHEN contains(text, '|') THEN 'table' END], lambda x: x IS NOT NULL), ',') AS x FROM documents)")
def _p20(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.array_join(t.keyword_tags(F.col("text"), _TAGS, default="other"), ",").alias("tags"))


@_register("p21_build_profile", "SELECT 'source-' || doc_id AS slug, length(CASE WHEN length(text) > 200 THEN substr(text, 1, 197) || '...' ELSE text END) AS summary, least(length(text), 500) AS excerpt FROM documents")
def _p21(spark, d):
    rows = _table(spark, d, "documents").select(F.concat(F.lit("Source "), "doc_id").alias("name"), "text", "source", F.lit("1").alias("pages"), F.lit("c").alias("city"), F.lit("PR").alias("state"), F.array(F.lit("tag")).alias("tags"))
    return p.build_profile(rows, "vitima").select("slug", F.length("profile.summary").cast("long").alias("summary"), F.length(F.col("profile.sources")[0]["excerpt"]).cast("long").alias("excerpt"))


@_register("p22_new_only", "SELECT c_custkey AS slug FROM customer WHERE c_custkey % 5 <> 0")
def _p22(spark, d):
    c = _table(spark, d, "customer").select(F.col("c_custkey").alias("slug"))
    return p.new_only(c, c.where("slug % 5 = 0"))


@_register("p23_classify_source", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'report' WHEN strftime(o_orderdate, '%Y-%m-%d') <= '1995' THEN 'press' ELSE 'other' END AS kind, CASE WHEN o_orderpriority LIKE '1%' THEN 'high' WHEN strftime(o_orderdate, '%Y-%m-%d') <= '1995' THEN 'low' ELSE 'none' END AS reliability FROM orders")
def _p23(spark, d):
    o = _table(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    rules = [(F.col("o_orderpriority").startswith("1"), "report", "high", None), (F.col("day") <= "1995", "press", "low", "n")]
    return p.classify_source(o, rules, ("other", "none", None)).select("o_orderkey", "kind", "reliability")


@_register("p24_period_bucket", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '1964_1985' WHEN year(o_orderdate) - 30 < 1964 THEN 'pre_1964' WHEN year(o_orderdate) - 30 <= 1985 THEN '1964_1985' ELSE 'pos_1985' END AS period FROM orders")
def _p24(spark, d):
    raw = F.when(F.col("o_orderkey") % 9 == 0, "s.d.").otherwise((F.year("o_orderdate") - 30).cast("string"))
    return _table(spark, d, "orders").select("o_orderkey", p.period_bucket(raw).alias("period"))


@_register("p25_skip_report", "SELECT p_partkey AS key, CASE WHEN p_partkey IN (1, 2, 3) THEN 'listed' WHEN p_partkey % 4 = 0 THEN 'no file' WHEN p_partkey % 5 = 0 THEN 'slug exists' END AS reason FROM part")
def _p25(spark, d):
    items = _table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_name")).alias("file"), F.concat(F.lit("s"), "p_partkey").alias("slug"))
    return p.skip_report(items, [1, 2, 3], items.where("key % 5 = 0")).select("key", "reason")


@_register("p26_override_fields", "SELECT CASE WHEN c_custkey % 10 = 0 THEN 'fixed' || c_custkey ELSE c_name END AS name, CASE WHEN c_custkey % 10 = 0 THEN 'new' WHEN c_mktsegment = 'BUILDING' THEN 'birth' ELSE c_mktsegment END AS city, CASE WHEN c_custkey % 2 = 0 THEN 'PR' ELSE 'MG' END AS state FROM customer")
def _p26(spark, d):
    c = _table(spark, d, "customer")
    rows = c.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("city"), F.when(F.col("c_custkey") % 2 == 0, "PR").alias("state"), F.lit("birth").alias("birth_city"))
    fixes = c.where("c_custkey % 10 = 0").select(F.col("c_name").alias("raw_name"), F.concat(F.lit("fixed"), "c_custkey").alias("new_name"), F.lit("new").alias("new_city"))
    return p.override_fields(rows, fixes, ["building"], "MG")


@_register("p27_source_urls", "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'https://example.org/' || p_partkey || '/' || replace(p_name, ' ', '%20') END AS url, CASE WHEN p_size > 25 THEN 'large' END AS note FROM part")
def _p27(spark, d):
    file = F.when(F.col("p_partkey") % 3 > 0, F.col("p_name"))
    return _table(spark, d, "part").select("p_partkey", p.source_url("https://example.org", F.col("p_partkey"), file).alias("url"), p.note_for_type(F.when(F.col("p_size") > 25, "l").otherwise("x"), {"l": "large"}).alias("note"))


# ------------------------------------------------------------------ validation


@_register("v1_check_vocabulary", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def _v1(spark, d):
    return v.validate(_table(spark, d, "customer"), {"segment": v.in_vocabulary(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"])}).select("c_custkey")


_CITED = "WITH o AS (SELECT o_orderkey, count(*) AS n, count(*) FILTER (l_linenumber % 4 = 0) AS blank FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) "


def _cited(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their line items as citations; every fourth has a blank excerpt."""
    c = F.struct(F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").cast("string").alias("source"), F.lit("1-2").alias("pages"), F.when(F.col("l_linenumber") % 4 == 0, " ").otherwise("x").alias("excerpt"))
    return _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(c)).alias("sources"))


@_register("v2_check_citations", _CITED + "SELECT o_orderkey FROM o WHERE blank > 0")
def _v2(spark, d):
    return v.validate(_cited(spark, d), {"citations": v.citations_ok(F.col("sources"))}).select("o_orderkey")


@_register("v3_check_period_place", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'birthplace needs a state' WHEN c_custkey % 4 = 2 THEN 'state is two letters' ELSE 'start is not after end' END AS errors FROM customer WHERE c_custkey % 4 > 0")
def _v3(spark, d):
    k = F.col("c_custkey") % 4
    rows = _table(spark, d, "customer").select("c_custkey", F.lit("x").alias("birth_city"), F.when(k == 2, "pr").when(k != 1, "PR").alias("birth_state"), F.when(k == 3, "1980-01-01").alias("start"), F.lit("1970-01-01").alias("end"))
    return v.validate(rows, v.period_place_errors()).select("c_custkey", F.array_join("errors", ",").alias("errors"))


@_register("v4_check_territory", "SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 'code and point exclude each other' WHEN 2 THEN 'a radius needs a point' ELSE 'code is positive' END AS errors FROM customer WHERE c_custkey % 4 > 0")
def _v4(spark, d):
    k = F.col("c_custkey") % 4
    rows = _table(spark, d, "customer").select("c_custkey", F.when(k == 3, -1).when(k == 1, 5).alias("territory_code"), F.lit("t").alias("territory_name"), F.lit("p").alias("people"), F.when(k == 1, F.array(F.lit(1.0), F.lit(2.0))).alias("point"), F.when(k == 2, 3).alias("radius_km"))
    return v.validate(rows, v.territory_errors()).select("c_custkey", F.array_join("errors", ",").alias("errors"))


@_register("v5_check_links", "SELECT c_custkey, 'perpetrators need a note' AS errors FROM customer WHERE c_custkey % 6 = 0")
def _v5(spark, d):
    k = F.col("c_custkey")
    rows = _table(spark, d, "customer").select("c_custkey", F.lit("org").alias("slug"), F.lit("s").alias("source"), F.lit("1").alias("pages"), F.lit("e").alias("excerpt"), F.when(k % 2 == 0, "perpetrador").otherwise("vitima").alias("person_kind"), F.when(k % 3 > 0, "note").alias("note"))
    return v.validate(rows, v.link_errors()).select("c_custkey", F.array_join("errors", ",").alias("errors"))


@_register("v6_check_references", "SELECT o_orderkey AS event, o_custkey AS victim FROM orders WHERE o_custkey % 2 = 0")
def _v6(spark, d):
    events = _table(spark, d, "orders").select(F.col("o_orderkey").alias("slug"), F.array("o_custkey").alias("victims"))
    return v.missing_victims(events, _table(spark, d, "customer").where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("slug")))


@_register("v6_bad_organisations", "SELECT DISTINCT l_suppkey AS org_slug, CASE WHEN l_suppkey % 3 = 0 THEN 'missing' ELSE 'not an organisation' END AS problem FROM lineitem WHERE l_suppkey % 3 < 2")
def _v6b(spark, d):
    s = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("slug"), F.when(F.col("s_suppkey") % 3 == 1, "vitima").otherwise("organizacao").alias("kind"))
    return v.bad_organisations(_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("org_slug")), s.where("slug % 3 = 1"), s.where("slug % 3 = 2"))


@_register("v7_check_source_note", "SELECT p_partkey FROM part WHERE p_size > 25 AND p_partkey % 2 = 0")
def _v7(spark, d):
    s = _table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, "imprensa").otherwise("livro").alias("kind"), F.when(F.col("p_partkey") % 2 == 1, "note").alias("note"))
    return v.sources_without_note(s).select("p_partkey")


@_register("v9_explode_citations", "SELECT l_orderkey AS o_orderkey, l_partkey::VARCHAR AS source, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey::VARCHAR) AS ordinal FROM lineitem")
def _v9(spark, d):
    return v.explode_citations(_cited(spark, d), "o_orderkey").select("o_orderkey", "source", F.col("ordinal").cast("long").alias("ordinal"))


@_register("v10_resolve_slugs", "SELECT o_orderkey, sha256(c_name) AS profile_id FROM orders JOIN customer ON o_custkey = c_custkey")
def _v10(spark, d):
    profiles = _table(spark, d, "customer").select(F.col("c_custkey").alias("slug"), F.sha2("c_name", 256).alias("profile_id"))
    return v.resolve_slugs(_table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("slug")), profiles).select("o_orderkey", "profile_id")


@_register("v11_placed_events", "SELECT o_orderkey, (o_custkey % 180 - 90)::DOUBLE AS lat, (o_orderkey % 360 - 180)::DOUBLE AS lon FROM orders WHERE o_orderkey % 3 > 0")
def _v11(spark, d):
    at = F.when(F.col("o_orderkey") % 3 > 0, F.array((F.col("o_custkey") % 180 - 90).cast("double"), (F.col("o_orderkey") % 360 - 180).cast("double")))
    e = _table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), F.lit("pr").alias("state"), at.alias("lat_lng"))
    return v.placed_events(e).select("o_orderkey", F.col("point")[1].alias("lat"), F.col("point")[0].alias("lon"))


@_register("v12_remap_vocabulary", "SELECT doc_id, CASE toxic WHEN 1 THEN 'toxic' ELSE toxic::VARCHAR END AS toxic FROM labels")
def _v12(spark, d):
    return v.remap_vocabulary(_table(spark, d, "labels").select("doc_id", "toxic"), "toxic", {"1": "toxic"})


_EDGE = r"[^\p{L}\p{N}_]"
_REPLACED = "text"
for _old, _new in (("the", "that"), ("The", "That"), ("THE", "THAT"), ("der", "dér"), ("Der", "Dér"), ("DER", "DÉR")):
    for _ in range(2):  # words side by side share the character between them
        _REPLACED = rf"regexp_replace({_REPLACED}, '(^|{_EDGE}){_old}({_EDGE}|$)', '\1{_new}\2', 'g')"


@_register("v13_replace_term", f"SELECT doc_id, md5({_REPLACED}) AS digest FROM documents")
def _v13(spark, d):
    return v.replace_term(_table(spark, d, "documents"), ["text"], [("the", "that"), ("der", "dér")]).select("doc_id", F.md5("text").alias("digest"))


@_register("v14_territory_audit", "SELECT outcome, count(*) AS n FROM (SELECT CASE c_custkey % 6 WHEN 0 THEN 'error: both' WHEN 1 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'A' ELSE 'error: unknown code' END WHEN 2 THEN 'error: radius without point' WHEN 3 THEN 'B' ELSE 'none' END AS outcome FROM customer) GROUP BY 1")
def _v14(spark, d):
    k = F.col("c_custkey") % 6
    c = _table(spark, d, "customer").select(F.when(k < 2, F.col("c_nationkey")).alias("territory_code"), F.when(k.isin(0, 3), F.array(F.lit(1.0))).alias("point"), F.when(k == 2, 5).alias("radius_km"))
    return v.territory_audit(c, _table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("code"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@_register("v15_apply_decisions", "SELECT event_id AS feedback_id, CASE WHEN event_id % 7 = 0 THEN 'unknown id' WHEN event_id % 5 = 0 THEN 'conflict' WHEN event_id % 3 = 0 THEN 'invalid' ELSE 'applied' END AS outcome, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'refused' WHEN event_id % 3 = 0 THEN 'pending' ELSE 'accepted' END AS status FROM events")
def _v15(spark, d):
    e = _table(spark, d, "events").select(F.col("event_id").alias("feedback_id"), "ts", "user_id")
    queue = e.where("feedback_id % 7 > 0").select("feedback_id", F.when(F.col("feedback_id") % 5 == 0, "refused").otherwise("pending").alias("status"), F.lit(None).cast("string").alias("justification"), F.lit(None).cast("timestamp").alias("decided_at"), F.lit(None).cast("string").alias("decided_by"))
    decisions = e.select("feedback_id", F.lit("accepted").alias("status"), F.when(F.col("feedback_id") % 3 == 0, "short").otherwise("long enough to count").alias("justification"), F.col("ts").alias("at"), F.col("user_id").cast("string").alias("by"))
    return v.apply_decisions(queue, decisions).select("feedback_id", "outcome", "status")


@_register("v16_check_feedback", "SELECT event_id, CASE WHEN user_id % 2 = 1 THEN 'unknown interaction' WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'unknown class' END AS error FROM events")
def _v16(spark, d):
    e = _table(spark, d, "events").select("event_id", F.col("user_id").alias("interaction_id"), F.col("event_type").alias("class"))
    return v.check_feedback(e, e.where("interaction_id % 2 = 0"), ["click", "view", "purchase"]).select("event_id", "error")


@_register("v17_count_gate", "SELECT n_nationkey FROM nation")
def _v17(spark, d):
    return v.count_gate(_table(spark, d, "nation").select("n_nationkey"), 20, 30)


# ------------------------------------------------------------------ tables and streams


@_register("io8_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM customer")
def _io8(spark, d):
    c = _table(spark, d, "customer").select("c_custkey")
    return files.upsert(c.withColumn("state", F.lit("old")), c.where("c_custkey % 3 = 0").withColumn("state", F.lit("new")), "c_custkey")


@_register("io9_replace_links", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderkey % 6 = 0")
def _io9(spark, d):
    o = _table(spark, d, "orders")
    return files.replace_links(_table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), o.where("o_orderkey % 6 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(-1).cast("long").alias("l_partkey")), o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")


@_register("io10_features", """SELECT '{"type":"Feature","geometry":{"type":"Point"},"properties":{"c_custkey":' || c_custkey || '}}' AS feature FROM customer""")
def _io10(spark, d):
    return files.features(_table(spark, d, "customer").select("c_custkey", F.lit('{"type":"Point"}').alias("geometry")))


@_register("io11_dossier", "SELECT source AS name, md5('## ' || source || chr(10) || chr(10) || string_agg('> ' || text || chr(10) || chr(10) || '— title ' || source, chr(10) || chr(10) ORDER BY doc_id) || chr(10)) AS digest FROM documents GROUP BY source")
def _io11(spark, d):
    return files.dossier(_chunks(spark, d).select(F.col("source").alias("name"), "title", "ordinal", F.col("text").alias("excerpt"))).select("name", F.md5("section").alias("digest"))


@_register("io11_dossier_parts", "SELECT source AS name, 1 AS place, 'title ' || source AS title, doc_id AS ordinal, md5('> ' || text || chr(10) || chr(10) || '— title ' || source || chr(10)) AS digest FROM documents UNION ALL SELECT DISTINCT source, 0, NULL, NULL, md5('## ' || source || chr(10)) FROM documents")
def _io11_parts(spark, d):
    parts = files.dossier_parts(_chunks(spark, d).select(F.col("source").alias("name"), "title", "ordinal", F.col("text").alias("excerpt")))
    return parts.select("name", "place", "title", "ordinal", F.md5("part").alias("digest"))


# epoch_ms rounds microseconds up, so the SQL counts in these
@_register("t1_quota_flags", """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id::VARCHAR AS key, event_id AS id, floor(epoch_us(ts) / 100000000)::BIGINT AS ts_ms FROM events),
w(key, began) AS (SELECT key, min(ts_ms) FROM e GROUP BY key UNION ALL SELECT w.key, min(e.ts_ms) FROM w JOIN e ON e.key IS NOT DISTINCT FROM w.key AND e.ts_ms >= w.began + 60000 GROUP BY w.key),
x AS (SELECT e.*, (SELECT max(began) FROM w WHERE w.key IS NOT DISTINCT FROM e.key AND w.began <= e.ts_ms) AS began FROM e)
SELECT key, id, ts_ms, ts_ms IS NOT NULL AND row_number() OVER (PARTITION BY key, began ORDER BY ts_ms, id NULLS FIRST) <= 20 AS allowed FROM x""")
def _t1(spark, d):
    """Users are keys; 100 whole seconds here are a millisecond there, so that quotas fill."""
    e = _table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.floor(F.unix_millis(F.col("ts").cast("timestamp_ltz")) / 100_000).alias("ts_ms"))
    return quota_flags(e)
