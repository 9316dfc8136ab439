"""Queries of the served tables: customers as profiles, suppliers as organisations, orders as events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import geo
from folium.operators import serve as g

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


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers; two of three are published; a period is the span of a customer's orders."""
    o = _table(spark, d, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))
    k = F.col("c_custkey")
    persons = _table(spark, d, "customer").join(o, k == F.col("o_custkey"), "left").select(
        F.concat(F.lit("c"), k).alias("slug"), F.col("c_name").alias("name"), F.when(k % 2 == 0, "vitima").otherwise("perpetrador").alias("kind"), F.col("c_mktsegment").alias("city"),
        F.when(k % 5 > 0, F.concat(F.lit("N"), "c_nationkey")).alias("birth_state"), F.when(k % 3 > 0, "publicada").otherwise("rascunho").alias("status"), "start", "end",
        (k % 360 - 180).cast("double").alias("lon"), (k % 170 - 85).cast("double").alias("lat"), F.col("c_nationkey").cast("int").alias("nation"),
    )
    s = F.col("s_suppkey")
    orgs = _table(spark, d, "supplier").select(
        F.concat(F.lit("s"), s).alias("slug"), F.col("s_name").alias("name"), F.lit("organizacao").alias("kind"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("birth_state"),
        F.when(s % 3 > 0, "publicada").otherwise("rascunho").alias("status"), F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("int").alias("nation"),
    )
    return persons.unionByName(orgs)


_PROFILES = """WITH o AS (SELECT o_custkey, min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last FROM orders GROUP BY 1),
profiles AS (SELECT 'c' || c_custkey AS slug, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'vitima' ELSE 'perpetrador' END AS kind, c_mktsegment AS city, CASE WHEN c_custkey % 5 > 0 THEN 'N' || c_nationkey END AS birth_state,
  CASE WHEN c_custkey % 3 > 0 THEN 'publicada' ELSE 'rascunho' END AS status, first, last, (c_custkey % 360 - 180)::DOUBLE AS lon, (c_custkey % 170 - 85)::DOUBLE AS lat, c_nationkey AS nation FROM customer LEFT JOIN o ON o_custkey = c_custkey
  UNION ALL SELECT 's' || s_suppkey, s_name, 'organizacao', NULL, NULL, CASE WHEN s_suppkey % 3 > 0 THEN 'publicada' ELSE 'rascunho' END, NULL, NULL, NULL, NULL, NULL FROM supplier),
live AS (SELECT * FROM profiles WHERE status = 'publicada'),
links AS (SELECT DISTINCT 'c' || o_custkey AS person_slug, 's' || l_suppkey AS org_slug FROM orders JOIN lineitem ON l_orderkey = o_orderkey) """


def _links(spark: SparkSession, d: str) -> DataFrame:
    o, li = _table(spark, d, "orders"), _table(spark, d, "lineitem")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("person_slug"), F.concat(F.lit("s"), "l_suppkey").alias("org_slug")).distinct()


@_register("g1_list_profiles", _PROFILES + ", f AS (SELECT * FROM live WHERE kind = 'vitima' AND contains(lower(name), '1') AND contains(lower(city), 'build')) SELECT slug, name, (SELECT count(*) FROM f) AS total FROM f ORDER BY name, slug LIMIT 20 OFFSET 0")
def _g1(spark, d):
    return g.list_profiles(_profiles(spark, d), 1, 20, name="1", city="BUILD", kind="vitima").select("slug", "name", "total")


@_register("g1_literal_wildcards", _PROFILES + "SELECT slug FROM live WHERE contains(CASE right(slug, 1) WHEN '7' THEN '50%0_x' WHEN '8' THEN '50x0yx' ELSE lower(name) END, '%0_')")
def _g1b(spark, d):
    """A tenth of the names hold the marks, another tenth what they would stand for in a pattern."""
    last = F.substring("slug", -1, 1)
    named = _profiles(spark, d).withColumn("name", F.when(last == "7", "50%0_X").when(last == "8", "50X0yX").otherwise(F.col("name")))
    return g.filter_profiles(named, name="%0_").select("slug")


@_register("g2_period_overlap", _PROFILES + "SELECT slug FROM profiles WHERE (last IS NULL OR last >= DATE '1994-01-01') AND (first IS NULL OR first <= DATE '1995-12-31')")
def _g2(spark, d):
    return g.period_overlap(_profiles(spark, d), "1994", "1995").select("slug")


@_register("g3_members_of", _PROFILES + "SELECT slug FROM live WHERE slug IN (SELECT person_slug FROM links WHERE org_slug = 's1') AND EXISTS (SELECT 1 FROM live WHERE slug = 's1' AND kind = 'organizacao')")
def _g3(spark, d):
    return g.members_of(_profiles(spark, d), _links(spark, d), "s1").select("slug")


@_register("g4_facets", _PROFILES + "SELECT 'type' AS facet, kind AS label, count(*) AS n, NULL::DATE AS start, NULL::DATE AS \"end\" FROM live GROUP BY kind UNION ALL SELECT 'state', birth_state, count(*), NULL, NULL FROM live WHERE kind = 'vitima' AND birth_state IS NOT NULL GROUP BY birth_state UNION ALL SELECT 'period', '', count(*), min(first), max(last) FROM live WHERE kind = 'vitima' UNION ALL SELECT 'organisation', o.name, count(DISTINCT person_slug), NULL, NULL FROM links JOIN live p ON p.slug = person_slug AND p.kind = 'vitima' JOIN live o ON o.slug = org_slug GROUP BY org_slug, o.name")
def _g4(spark, d):
    return g.facets(_profiles(spark, d), _links(spark, d), "vitima")


def _source_links(spark: SparkSession, d: str, key: str, name: str) -> DataFrame:
    o, li = _table(spark, d, "orders"), _table(spark, d, "lineitem")
    both = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    slug = F.concat(F.lit("c"), "o_custkey") if key == "o_custkey" else F.col("o_orderkey")
    return both.select(slug.alias(name), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.col("l_partkey").cast("string").alias("source"), F.lit("1").alias("pages"), F.lit("x").alias("excerpt"))


@_register("g5_profile_documents", _PROFILES + ", n AS (SELECT 'c' || o_custkey AS slug, count(*) AS sources FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), e AS (SELECT 'c' || o_custkey AS slug, count(*) AS events FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), g AS (SELECT person_slug AS slug, count(*) AS orgs FROM links JOIN live l ON l.slug = org_slug GROUP BY 1) SELECT live.slug, coalesce(sources, 0) AS sources, coalesce(events, 0) AS events, coalesce(orgs, 0) AS organisations FROM live LEFT JOIN n USING (slug) LEFT JOIN e USING (slug) LEFT JOIN g USING (slug)")
def _g5(spark, d):
    sources = _source_links(spark, d, "o_custkey", "slug")
    tags = sources.where("ordinal % 50 = 1").withColumn("tag", F.lit("t"))
    events = _table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("slug"), F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("title"), F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderkey") % 2 == 0, "publicada").otherwise("rascunho").alias("status"))
    orgs = _links(spark, d).select(F.col("person_slug").alias("slug"), "org_slug", F.lit("n").alias("note"))
    docs = g.profile_documents(_profiles(spark, d), sources, tags, events, orgs)
    return docs.select("slug", *(F.size(c).cast("long").alias(c) for c in ("sources", "events", "organisations")))


def _events(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    crimes = F.array_compact(F.array(F.col("o_orderstatus"), F.when(k % 2 == 0, F.lit("even"))))
    return _table(spark, d, "orders").select(k.alias("event_id"), F.to_date("o_orderdate").alias("date"), crimes.alias("crimes"), F.when(k % 3 > 0, "publicada").otherwise("rascunho").alias("status"), (k % 4 == 0).alias("reviewed"), F.col("o_orderpriority").alias("justice"), F.concat(F.lit("c"), "o_custkey").alias("victim"))


@_register("g6_event_documents", _PROFILES + "SELECT o_orderkey AS event_id, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS sources, CASE WHEN EXISTS (SELECT 1 FROM live WHERE slug = 'c' || o_custkey) THEN 'c' || o_custkey ELSE '' END AS victims, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS justice FROM orders WHERE o_orderkey % 3 > 0")
def _g6(spark, d):
    e = _events(spark, d)
    docs = g.event_documents(e.drop("victim"), _source_links(spark, d, "o_orderkey", "event_id"), e.select("event_id", "victim"), _profiles(spark, d))
    return docs.select("event_id", F.size("sources").cast("long").alias("sources"), F.array_join("victims", ",").alias("victims"), "justice")


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return _table(spark, d, "events").select(k.alias("feedback_id"), F.col("user_id").alias("interaction_id"), F.when(k % 3 == 0, "accepted").when(k % 3 == 1, "refused").otherwise("pending").alias("status"), F.col("ts").alias("decided_at"), F.col("ts").alias("created_at"), (F.col("user_id") % 5).alias("decided_by"))


_FEEDBACK = "WITH f AS (SELECT event_id AS feedback_id, user_id AS interaction_id, CASE event_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'refused' ELSE 'pending' END AS status, ts, user_id % 5 AS decided_by FROM events) "


@_register("g7_decided_feedback", _FEEDBACK + "SELECT feedback_id, status, CASE WHEN decided_by > 0 THEN n_name END AS curator, (SELECT count(*) FROM f WHERE status <> 'pending') AS total FROM f LEFT JOIN nation ON n_nationkey = decided_by WHERE status <> 'pending' ORDER BY ts DESC, feedback_id LIMIT 20 OFFSET 20")
def _g7(spark, d):
    f = _feedback(spark, d)
    curators = _table(spark, d, "nation").where("n_nationkey > 0").select(F.col("n_nationkey").cast("long").alias("curator_id"), F.col("n_name").alias("name"))
    inter = f.select("interaction_id").distinct().withColumn("question", F.concat(F.lit("q"), "interaction_id"))
    return g.decided_feedback(f, inter, curators, 2).select("feedback_id", "status", "curator", "total")


@_register("g8_curation_queue", _FEEDBACK + "SELECT feedback_id, 'q' || interaction_id AS question FROM f WHERE status = 'pending' ORDER BY ts DESC, feedback_id LIMIT 20")
def _g8(spark, d):
    f = _feedback(spark, d)
    inter = f.select("interaction_id").distinct().withColumn("question", F.concat(F.lit("q"), "interaction_id"))
    return g.curation_queue(f, inter).select("feedback_id", "question")


@_register("g9_catalogue", "SELECT p_partkey, p_type AS kind, count(*) OVER (PARTITION BY p_type) AS of_kind, count(*) OVER () AS total FROM part")
def _g9(spark, d):
    return g.catalogue(_table(spark, d, "part").select("p_partkey", F.col("p_type").alias("kind"), F.col("p_name").alias("title"))).select("p_partkey", "kind", "of_kind", "total")


@_register("g10_curators", "SELECT s_name AS name, 'curator' AS role FROM supplier")
def _g10(spark, d):
    return g.curators(_table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("curator").alias("role"), "s_acctbal"))


@_register("g11_events_by_category", "SELECT o_orderkey AS event_id FROM orders WHERE o_orderkey % 2 = 0")
def _g11(spark, d):
    return g.events_by_category(_events(spark, d), "even").select("event_id")


@_register("g12_events_by_period", "SELECT o_orderkey AS event_id FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'")
def _g12(spark, d):
    return g.events_by_period(_events(spark, d), "1994", "1995").select("event_id")


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    """Points and squares from keys: GeoJSON text parsed back into geometries."""
    k = F.col("c_custkey")
    x, y = (k % 360 - 180).cast("double"), (k % 170 - 85).cast("double")
    at = lambda dx, dy: F.concat(F.lit("["), (x + dx).cast("string"), F.lit(","), (y + dy).cast("string"), F.lit("]"))
    ring = F.concat(F.lit("[["), F.concat_ws(",", at(0, 0), at(30, 0), at(30, 30), at(0, 30), at(0, 0)), F.lit("]]"))
    raw = F.when(k % 3 == 0, F.concat(F.lit('{"type":"Point","coordinates":'), at(0, 0), F.lit("}"))).when(k % 3 == 1, F.concat(F.lit('{"type":"Polygon","coordinates":'), ring, F.lit("}"))).otherwise(F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), ring, F.lit("]}")))
    return _table(spark, d, "customer").select("c_custkey", geo.parse_geometry(raw).alias("geometry"))


_XY = "WITH s AS (SELECT c_custkey, c_custkey % 3 AS k, (c_custkey % 360 - 180)::DOUBLE AS x, (c_custkey % 170 - 85)::DOUBLE AS y FROM customer) SELECT c_custkey FROM s WHERE (x BETWEEN -47 AND 20 AND y BETWEEN -24 AND 10)"


@_register("g13_in_bbox", _XY + " OR (k > 0 AND (x BETWEEN -47 AND 20 OR x + 30 BETWEEN -47 AND 20) AND (y BETWEEN -24 AND 10 OR y + 30 BETWEEN -24 AND 10))")
def _g13(spark, d):
    return g.in_box(_shapes(spark, d), (-47, -24, 20, 10)).select("c_custkey")


@_register("g14_in_bbox_first_vertex", _XY)
def _g14(spark, d):
    return g.in_box(_shapes(spark, d), (-47, -24, 20, 10), first_vertex=True).select("c_custkey")


@_register("g15_birthplaces", _PROFILES + "SELECT slug, lon, lat FROM live WHERE kind = 'vitima' AND lon BETWEEN -47 AND 20 AND lat BETWEEN -24 AND 10")
def _g15(spark, d):
    return g.birthplaces(_profiles(spark, d), (-47, -24, 20, 10)).select("slug", "lon", "lat")


@_register("g16_circle", "SELECT c_custkey, 65::BIGINT AS vertices, round((c_custkey % 170 - 85) + 10 / 111.0, 6) AS north, round((c_custkey % 360 - 180) + 10 / (111 * cos(radians(c_custkey % 170 - 85))) * cos(2 * pi() * (c_custkey % 64) / 64), 6) AS lon, round((c_custkey % 170 - 85) + 10 / 111.0 * sin(2 * pi() * (c_custkey % 64) / 64), 6) AS lat, true AS closed FROM customer")
def _g16(spark, d):
    """Another vertex of each circle is shown."""
    k = F.col("c_custkey")
    at = F.element_at("ring", (k % 64 + 1).cast("int"))
    c = _table(spark, d, "customer").select("c_custkey", geo.circle((k % 360 - 180).cast("double"), (k % 170 - 85).cast("double"), F.lit(10.0)).alias("ring"))
    return c.select("c_custkey", F.size("ring").cast("long").alias("vertices"), F.round(F.col("ring")[16][1], 6).alias("north"), F.round(at[0], 6).alias("lon"), F.round(at[1], 6).alias("lat"), (F.col("ring")[0] == F.col("ring")[64]).alias("closed"))


@_register("g17_origin_territories", _PROFILES + "SELECT slug, nation % 2 = 0 AS official, CASE WHEN nation % 2 = 0 THEN 5 ELSE 65 END AS vertices FROM live WHERE kind = 'vitima'")
def _g17(spark, d):
    p = _profiles(spark, d).withColumns({"people": F.col("birth_state"), "territory_code": F.col("nation"), "radius_km": F.lit(10.0)}).withColumn("people", F.coalesce("people", F.lit("p")))
    ring = F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))))
    t = _table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("int").alias("code"), F.array(F.array(ring)).alias("polygons"))
    return g.origin_territories(p, t).select("slug", "official", F.size(F.col("polygons")[0][0]).alias("vertices"))


@_register("g18_map_layers", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'events' END AS layer, count(*) AS n FROM orders GROUP BY 1")
def _g18(spark, d):
    return g.map_layers(_events(spark, d), "even").groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@_register("g19_municipal_seats", "SELECT o_custkey AS code, coalesce(min(o_orderkey) FILTER (o_orderkey % 5 = 0), max(o_orderkey)) AS seq FROM orders WHERE o_orderstatus <> 'O' GROUP BY o_custkey")
def _g19(spark, d):
    k = F.col("o_orderkey")
    rows = _table(spark, d, "orders").select(F.col("o_custkey").alias("code"), F.when(F.col("o_orderstatus") != "O", "Cidade").otherwise("Vila").alias("category"), F.when(k % 5 == 0, "Sede municipal").otherwise("x").alias("place"), k.alias("seq"))
    return g.municipal_seats(rows).select("code", "seq")


@_register("g20_geocode", "SELECT CASE WHEN c_custkey % 5 = 0 THEN 'no state' WHEN c_nationkey % 2 = 1 THEN 'no match' WHEN c_custkey % 3 = 0 THEN 'already right' ELSE 'updated' END AS outcome, count(*) AS n FROM customer GROUP BY 1")
def _g20(spark, d):
    n = _table(spark, d, "nation")
    c = _table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    lat = F.col("n_nationkey").cast("double")
    p = c.select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, "pr").alias("birth_state"), F.concat(F.lit("São-"), F.lower("n_name")).alias("birth_city"), F.when(F.col("c_custkey") % 3 == 0, lat).alias("lat"), F.when(F.col("c_custkey") % 3 == 0, lat).alias("lon"))
    gaz = n.where("n_nationkey % 2 = 0").select(F.lit("PR").alias("state"), F.concat(F.lit("SAO "), "n_name").alias("name"), lat.alias("lat"), lat.alias("lon"))
    return g.geocode(p, gaz).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@_register("g21_merge_territory_layers", "SELECT c_custkey::INT AS code, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS layer FROM customer WHERE c_custkey % 7 > 0")
def _g21(spark, d):
    base = _table(spark, d, "customer").select(F.when(F.col("c_custkey") % 7 > 0, F.col("c_custkey").cast("string")).otherwise("x").alias("code"), F.lit("g").alias("geometry"))
    return g.merge_territory_layers([base, base.where("try_cast(code as int) % 4 = 0")]).select("code", "layer")


@_register("g22_simplify_rings", "SELECT c_custkey, 5 + (c_custkey % 3 = 0)::BIGINT + (c_custkey % 7 = 0)::BIGINT AS vertices, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS rings FROM customer")
def _g22(spark, d):
    """Squares with vertices along their sides and a bump under the tolerance, which stays where a hole reaches into it, as does a spike above the tolerance."""
    k = F.col("c_custkey")
    x, y = (k % 300 - 150).cast("double"), (k % 120 - 60).cast("double")
    at = lambda a, b: F.array(x + a, y + b)
    along = F.transform(F.sequence(F.lit(1), 1 + k % 5), lambda i: F.array(x + 4 * i / 7.0, y))
    spike = F.when(k % 7 == 0, F.array(at(4.5, 2.0))).otherwise(F.array(at(4.0, 2.0)))
    ring = F.concat(F.array(at(0.0, 0.0)), along, F.array(at(4.0, 0.0)), spike, F.array(at(4.0, 4.0), at(2.0, 4.005), at(0.0, 4.0), at(0.0, 0.0)))
    hole = F.array(at(2.0, 4.003), at(1.9, 3.9), at(2.1, 3.9), at(2.0, 4.003))
    c = _table(spark, d, "customer").select("c_custkey", F.array(F.when(k % 3 == 0, F.array(ring, hole)).otherwise(F.array(ring))).alias("polygons"))
    out = geo.simplify_rings(0.01)(F.col("polygons"))
    return c.select("c_custkey", out[0].alias("p")).select("c_custkey", F.size(F.col("p")[0]).cast("long").alias("vertices"), F.size("p").cast("long").alias("rings"))

