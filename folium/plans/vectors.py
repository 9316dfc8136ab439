"""Queries on embeddings, conversations and manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions.text import split_summary
from folium.operators import index as x
from folium.operators import search as r

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
THRESHOLD, K, EVERY = 0.3, 8, 50


def _register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Every EVERY-th vector asks; its own row is among the chunks."""
    e = _table(spark, d, "embeddings")
    return r.search(e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("chunk_id"), "embedding"), THRESHOLD, K)


_HITS = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label, list_cosine_similarity(q.e, c.e) AS similarity FROM v q JOIN v c ON q.vec_id % {EVERY} = 0),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM s WHERE similarity >= {THRESHOLD} QUALIFY rank <= {K}) """


@_register("r1_search", _HITS + "SELECT query_id, chunk_id, rank, round(similarity, 6) AS similarity FROM hits")
def _r1(spark, d):
    return _hits(spark, d).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Hits with their chunk's label as source and a note on every third chunk."""
    c = _table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("source"))
    return _hits(spark, d).join(c, "chunk_id").withColumn("note", F.when(F.col("chunk_id") % 3 == 0, F.concat(F.lit("c"), "chunk_id")))


@_register("r2_with_source", _HITS + "SELECT query_id, chunk_id, 'source ' || label AS title, CASE WHEN chunk_id % 3 = 0 THEN 'c' || chunk_id WHEN label % 2 = 0 THEN 's' || label END AS note FROM hits")
def _r2(spark, d):
    s = _table(spark, d, "embeddings").select(F.col("label").alias("source")).distinct()
    s = s.select("source", F.concat(F.lit("source "), "source").alias("title"), F.when(F.col("source") % 2 == 0, F.concat(F.lit("s"), "source")).alias("note"))
    return r.with_source(_labelled(spark, d), s).select("query_id", "chunk_id", "title", "note")


@_register("r3_threshold_report", _HITS + f"SELECT t AS threshold, count(*) FILTER (top >= t) AS queries_with_hits, round(max(top), 6) AS top_score FROM (SELECT query_id, max(similarity) AS top FROM s WHERE query_id <> chunk_id AND similarity >= {THRESHOLD} GROUP BY 1) CROSS JOIN (SELECT unnest([0.3, 0.5, 0.7, 0.9])::DOUBLE AS t) GROUP BY t")
def _r3(spark, d):
    rep = r.threshold_report(_hits(spark, d).where("query_id <> chunk_id"), [0.3, 0.5, 0.7, 0.9])
    return rep.withColumn("top_score", F.round("top_score", 6))


@_register("r4_unanswered", _HITS + f"SELECT vec_id AS query_id FROM v WHERE vec_id % {EVERY} = 0 AND vec_id NOT IN (SELECT query_id FROM hits WHERE query_id <> chunk_id AND similarity >= 0.8)")
def _r4(spark, d):
    q = _table(spark, d, "embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"))
    return r.unanswered(q, _hits(spark, d).where("query_id <> chunk_id and similarity >= 0.8"))


def _texted(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return _labelled(spark, d).join(docs, "chunk_id").withColumns({"title": F.concat(F.lit("source "), "source"), "pages": F.col("chunk_id").cast("string")})


_TEXTED = _HITS + ", t AS (SELECT hits.*, text, 'source ' || label AS title, CASE WHEN chunk_id % 3 = 0 THEN 'c' || chunk_id END AS note FROM hits JOIN documents ON doc_id = chunk_id) "


@_register("r5_citations", _TEXTED + r"SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS number, CASE WHEN length(text) > 400 THEN regexp_replace(substr(text, 1, 400), '\s+$', '') || '…' ELSE text END AS excerpt FROM t")
def _r5(spark, d):
    return r.citations(_texted(spark, d)).select("query_id", "chunk_id", F.col("number").cast("long").alias("number"), "excerpt")


@_register("r6_context_block", _TEXTED + "SELECT query_id, md5(string_agg('[' || rank || ']' || chr(10) || 'Source: ' || title || chr(10) || 'Pages: ' || chunk_id || chr(10) || CASE WHEN note IS NULL THEN '' ELSE 'Note: ' || note || chr(10) END || text, chr(10) || chr(10) ORDER BY rank)) AS digest FROM t GROUP BY query_id")
def _r6(spark, d):
    return r.context_block(_texted(spark, d)).select("query_id", F.md5("context").alias("digest"))


@_register("r7_recent_history", "SELECT conv_id, turn, len(h) AS n, array_to_string(list_transform(h, lambda x: x::VARCHAR), ',') AS turns FROM (SELECT conv_id, turn, list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS h FROM conversations)")
def _r7(spark, d):
    h = r.recent_history(_table(spark, d, "conversations"))
    return h.select("conv_id", "turn", F.when(F.size("history") > 0, F.size("history")).cast("long").alias("n"), F.when(F.size("history") > 0, F.array_join(F.transform("history", lambda x: x["turn"].cast("string")), ",")).alias("turns"))


#: How the sides of an answer are labelled, and one side that is nothing but its label.
_SUMMARIES, _ANSWERS = ("Resumo: short", "RESUMO\nshort", "Parte 1 — Resumo: short", "parte 1 resumo short", "short", "Resumo:"), ("", "Resposta: ", "Resposta completa:\n", "PARTE 3 - Resposta completa ")


@_register("r8_split_summary", r"""SELECT conv_id, turn, CASE WHEN text <> '' AND s < 5 THEN 'short' ELSE '' END AS summary, md5(CASE WHEN text <> '' AND s < 5 THEN text ELSE regexp_replace(whole, '^\s+|\s+$', '', 'g') END) AS digest
FROM (SELECT *, regexp_replace(coalesce(raw, ''), '^\s+|\s+$', '', 'g') AS text, [{s}][s + 1] || chr(10) || ' ----' || chr(10) || [{a}][a + 1] || coalesce(raw, '') AS whole
  FROM (SELECT conv_id, turn, text AS raw, (conv_id + turn) % 6 AS s, turn % 4 AS a FROM conversations))""".format(**{k: ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in v) for k, v in (("s", _SUMMARIES), ("a", _ANSWERS))}))
def _r8(spark, d):
    pick = lambda forms, i: F.get(F.array(*map(F.lit, forms)), i.cast("int"))
    c = _table(spark, d, "conversations").select("conv_id", "turn", split_summary(F.concat(pick(_SUMMARIES, (F.col("conv_id") + F.col("turn")) % 6), F.lit("\n ----\n"), pick(_ANSWERS, F.col("turn") % 4), F.coalesce("text", F.lit("")))).alias("s"))
    return c.select("conv_id", "turn", "s.summary", F.md5("s.answer").alias("digest"))


@_register("r9_preview", _TEXTED + "SELECT query_id, rank, round(similarity, 3) AS score, substr(replace(text, chr(10), ' '), 1, 300) AS start FROM t")
def _r9(spark, d):
    h = _texted(spark, d).withColumns({"section": F.lit(None).cast("string"), "kind": F.lit("body")})
    return r.preview(h).select("query_id", F.col("rank").cast("long").alias("rank"), "score", "start")


@_register("x1_embed")
def _x1(spark, d):
    e = r.embed(_table(spark, d, "documents").select("doc_id", "text"))
    return e.select("doc_id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v), 3).alias("norm"))


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"), F.min_by("html", "page_id").alias("html"))
    return p.where("page_id % 3 > 0").select(F.col("url").alias("original_url"), F.concat(F.lit("page "), "page_id").alias("description"), F.lit("2024-05-06T07:08:09").alias("downloaded"), F.sha2("html", 256).alias("sha256"))


_PAGE = "WITH u AS (SELECT url, min(page_id) AS page_id, arg_min(html, page_id) AS html FROM pages GROUP BY url) "


@_register("x2_provenance", _PAGE + "SELECT p.url, CASE WHEN u.page_id % 3 > 0 THEN 'page ' || u.page_id || ' Downloaded 2024-05-06, SHA-256 ' || sha256(u.html) END AS provenance FROM (SELECT DISTINCT url FROM pages) p JOIN u ON u.url = p.url")
def _x2(spark, d):
    return x.provenance(_table(spark, d, "pages").select("url").distinct(), _manifest(spark, d))


@_register("x2_without_manifest", _PAGE + "SELECT url FROM u WHERE page_id % 3 = 0")
def _x2b(spark, d):
    return x.without_manifest(_table(spark, d, "pages").select("url").distinct(), _manifest(spark, d))


@_register("x3_register_manifest", _PAGE + "SELECT url, CASE WHEN page_id % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM u")
def _x3(spark, d):
    u = _table(spark, d, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))
    return x.register_manifest(u.select("url", F.lit("old").alias("state")), u.where("page_id % 2 = 0").select("url", F.lit("new").alias("state")))


@_register("x5_resolve_source_ids", _PAGE + "SELECT url, CASE WHEN page_id % 2 = 0 THEN 'id' || page_id ELSE sha256(url) END AS source_id FROM u")
def _x5(spark, d):
    u = _table(spark, d, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))
    return x.resolve_source_ids(u.select("url"), u.where("page_id % 2 = 0").select("url", F.concat(F.lit("id"), "page_id").alias("source_id"))).select("url", "source_id")


@_register("x6_default_fields", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'footnote' ELSE 'body' END AS kind, 'none' AS note FROM documents")
def _x6(spark, d):
    c = _table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "footnote").alias("kind"))
    return x.default_fields(c, {"kind": "body", "note": "none"})
