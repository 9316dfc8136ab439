"""Queries on the smaller steps that others are built of: names, terms, index pages, ordinals, page labels, dates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import text as t
from folium.operators import mining as m
from folium.operators import sections as s
from folium.operators import validate as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, table: str, sql: str):
    def keep(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        ORACLE_SQL[name] = sql
        return f

    return keep


# ------------------------------------------------------------------ index pages and labels


@_register("s5_toc_index", "documents", "SELECT source, doc_id::INT AS number, (doc_id + 3)::INT AS page, CASE WHEN doc_id % 7 = 0 THEN 'fixed' ELSE 'Name of ' || lang END AS label FROM documents")
def _s5(d):
    """Each document stands for an index page with one entry; every seventh has an erratum."""
    text = F.concat(F.col("doc_id").cast("string"), F.lit(".\nName of "), "lang", F.lit("......"), (F.col("doc_id") + 3).cast("string"))
    errata = d.where("doc_id % 7 = 0").select(F.col("doc_id").cast("int").alias("number"), F.lit(None).cast("int").alias("page"), F.lit("fixed").alias("label"))
    return s.toc_index(d.select("source", F.col("doc_id").alias("page"), text.alias("text")), 0, 1 << 62, errata)


@_register("s6_toc_numbers", "documents", "SELECT source, (doc_id % 1000)::INT AS number, 'Name ' || doc_id AS name FROM documents")
def _s6(d):
    """Names with leaders, a blank line, then the number."""
    text = F.concat(F.lit("Name "), F.col("doc_id").cast("string"), F.lit(" ......\n\n"), (F.col("doc_id") % 1000).cast("string"))
    return s.toc_numbers(d.select("source", F.col("doc_id").alias("ordinal"), text.alias("text")))


_UNITS = ("primeira", "segunda", "terceira", "quarta", "quinta", "sexta")


@_register("s12_spelled_ordinal", "documents", "SELECT doc_id, CASE WHEN doc_id % 7 < 6 THEN (70 + doc_id % 7 + 1)::INT END AS number FROM documents")
def _s12(d):
    word = F.get(F.array(*map(F.lit, _UNITS)), (F.col("doc_id") % 7).cast("int"))
    return d.select("doc_id", t.spelled_ordinal(F.coalesce(F.concat(F.lit("A Septuagésima "), word, F.lit(" audiência")), F.lit("uma audiência"))).alias("number"))


@_register("s21_toc_audit", "documents", "SELECT doc_id AS number, substr(md5(doc_id::VARCHAR), 1, 12) AS missing FROM documents WHERE doc_id % 5 = 0")
def _s21(d):
    """Entries hold the first word of their page; every fifth one a word that no page holds, too."""
    first = F.regexp_extract("text", r"(\p{L}+)", 1)
    label = F.when(F.col("doc_id") % 5 == 0, F.concat_ws(" ", first, F.substring(F.md5(F.col("doc_id").cast("string")), 1, 12))).otherwise(first)
    pages = d.select("source", F.col("doc_id").alias("page"), "text")
    found = s.toc_audit(d.select("source", F.col("doc_id").alias("number"), F.col("doc_id").alias("page"), label.alias("label")), pages)
    return found.select("number", F.array_join("missing", " ").alias("missing"))


@_register("k6_page_label", "documents", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR ELSE doc_id || '-' || (doc_id + doc_id % 3) END AS label FROM documents")
def _k6(d):
    return d.select("doc_id", t.page_label(F.array(F.col("doc_id") + F.col("doc_id") % 3, F.col("doc_id"))).alias("label"))


# ------------------------------------------------------------------ names and terms

_WORD = "[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ''’-]+"
_RUN = rf"{_WORD}(?:\s+(?:(?:{'|'.join(t.CONNECTIVES)})\s+)?{_WORD})+"
_HEAD = "lower(regexp_replace(split_part(text, chr(10), 1), '^\\s+|\\s+$', '', 'g'))"
_FOLD = r"regexp_replace(regexp_replace(lower(strip_accents({})), '\s+', ' ', 'g'), '^ | $', '', 'g')"


@_register("m3_proper_names", "documents", rf"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '{_RUN}'), lambda x: regexp_replace(x, '\s+', ' ', 'g')), '|') AS names FROM documents")
def _m3(d):
    return d.select("doc_id", F.array_join(F.transform(m.proper_names("text"), lambda x: x["name"]), "|").alias("names"))


_ODD = ("the", "of", "and", "de", "la", "der", "und")


@_register("m5_plausible_name", "documents", f"SELECT doc_id, len(w) >= 2 AND 2 * len(list_filter(w, lambda x: x IN {_ODD})) <= len(w) AS plausible FROM (SELECT doc_id, regexp_split_to_array({_HEAD}, '\\s+')[1:4] AS w FROM documents)")
def _m5(d):
    head = t.strip_ws(F.split_part("text", F.lit("\n"), F.lit(1)))
    return d.select("doc_id", m.plausible_name(F.array_join(F.slice(F.split(head, r"\s+"), 1, 4), " "), _ODD).alias("plausible"))


@_register("m6_term_in_name", "documents", f"SELECT doc_id, list_has_any(regexp_split_to_array({_HEAD}, '\\s+'), ['la', 'the']) AS inside FROM documents")
def _m6(d):
    head = t.strip_ws(F.split_part("text", F.lit("\n"), F.lit(1)))
    return d.select("doc_id", m.term_in_name(F.lit("La the"), head).alias("inside"))


@_register("m7_confidence", "documents", r"SELECT doc_id, CASE WHEN regexp_matches(x, 'token|licensed') AND regexp_matches(x, '\bthe\b') THEN 'alta' WHEN regexp_matches(x, 'token|licensed') THEN 'media' ELSE 'baixa' END AS confidence FROM (SELECT doc_id, " + _FOLD.format("text") + " AS x FROM documents)")
def _m7(d):
    return d.select("doc_id", m.confidence(t.fold_text("text"), "token|licensed", r"\bthe\b").alias("confidence"))


@_register("m8_fold_name", "part", "SELECT p_partkey, " + _FOLD.format("p_name || '  São  Ä ' || p_brand") + " AS folded FROM part")
def _m8(d):
    return d.select("p_partkey", t.fold_text(F.concat("p_name", F.lit("  São  Ä "), "p_brand")).alias("folded"))


@_register("m13_birth_narrative", "customer", """SELECT c_custkey AS page, 'Maria de Souza' AS name, 'Vila ' || lower(c_mktsegment) AS city, CASE WHEN c_custkey % 5 = 0 THEN 'alta' WHEN c_custkey % 8 < 2 THEN 'media' ELSE 'baixa' END AS confidence FROM customer WHERE c_custkey % 3 > 0""")
def _m13(d):
    """Every phrase and form of the state; every third narrative names another state as a birthplace before, the others merely mention it; every fifth page has a birth label."""
    k = F.col("c_custkey")
    start = F.when(k % 3 == 0, "irmã nascida em Santa Catarina, ").otherwise("em Santa Catarina, ")
    phrase = F.get(F.array(*map(F.lit, ("nascida em", "natural de", "nasceu em", "natural da cidade de", "oriunda de", "originária de", "nativa de", "procedência:"))), (k % 8).cast("int"))
    state = F.get(F.array(*map(F.lit, (", Paraná", " (PR)", " do estado do Paraná", ", do Paraná"))), (k % 4).cast("int"))
    label = F.when(k % 5 == 0, "\nData e local de nascimento").otherwise("")
    text = F.concat(start, F.lit("Maria de Souza, "), phrase, F.lit(" Vila "), F.lower("c_mktsegment"), state, F.lit(", e ficou."), label)
    found = m.birth_narrative(d.select(F.lit("s").alias("source"), k.alias("page"), text.alias("text")), "Paraná", ["Santa Catarina"], state_code="PR")
    return found.select("page", "name", "city", "confidence")


@_register("m14_birth_date", "orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate - INTERVAL 30 YEAR, '%d/%m/%Y') END AS born FROM orders")
def _m14(d):
    """Dates of thirty years before after every phrase and in every form, behind one that is too late; at odd keys the late one alone."""
    k, day = F.col("o_orderkey"), F.add_months("o_orderdate", -360)
    word = F.get(F.array(*map(F.lit, t.MONTHS)), F.month(day) - 1)
    month = F.when(k % 3 == 0, F.concat(F.lit("/"), F.month(day).cast("string"), F.lit("/"))).when(k % 3 == 1, F.concat(F.lit(" de "), word, F.lit(" de "))).otherwise(F.concat(F.lit("/"), F.upper(F.substring(word, 1, 3)), F.lit("/")))
    phrase = F.get(F.array(*map(F.lit, ("nascida em", "Nasceu em", "nascimento", "Data de nascimento:"))), (k % 8 / 2).cast("int"))
    early = F.when(k % 2 == 0, F.concat(F.lit(" Ela, "), phrase, F.lit(" "), F.dayofmonth(day).cast("string"), month, F.year(day).cast("string"), F.lit("."))).otherwise("")
    return d.select("o_orderkey", m.birth_date(F.concat(F.lit("A filha, nascida em 3/4/1992."), early), F.lit(1)).alias("born"))


# ------------------------------------------------------------------ rules


@_register("p14_place_by_agency", "documents", "SELECT doc_id, CASE WHEN regexp_matches(source, '^src1') THEN 'Recife' WHEN lang = 'de' THEN 'Curitiba' ELSE 'Brasília' END AS city, CASE WHEN regexp_matches(source, '^src1') THEN 'PE' WHEN lang = 'de' THEN 'PR' ELSE 'DF' END AS state FROM documents")
def _p14(d):
    place = t.parse_place(t.first_match(F.concat_ws(" ", "source", "lang"), [("^src1", "Recife (PE)"), ("de$", "Curitiba (PR)")], "Brasília (DF)"))
    return d.select("doc_id", place.alias("x")).select("doc_id", "x.city", "x.state")


@_register("v8_validate", "customer", "SELECT c_custkey, array_to_string(e, ', ') AS errors FROM (SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'segment' END], lambda x: x IS NOT NULL) AS e FROM customer) WHERE len(e) > 0")
def _v8(d):
    checks = {"balance": F.col("c_acctbal") >= 0, "segment": v.in_vocabulary(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"])}
    return v.validate(d, checks).select("c_custkey", F.array_join("errors", ", ").alias("errors"))
