"""Lists, facets, nested documents and map layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.geo import circle, in_bbox, in_bbox_first_vertex
from folium.functions.text import fold_text

PUBLISHED = "publicada"


def published(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == PUBLISHED)


def contains_literal(c: Column, text: str) -> Column:
    """Case aside; percent signs and underscores mean themselves."""
    return F.contains(F.lower(c), F.lit(text.lower()))


def year_bound(year: str | None, last: bool = False) -> str | None:
    """A bare year stands for its first or its last day."""
    return f"{year}-12-31" if year and last and len(year) == 4 else f"{year}-01-01" if year and len(year) == 4 else year


def period_overlap(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows whose period meets [start, end]; ends that are null are open."""
    lo, hi = year_bound(start), year_bound(end, last=True)
    if lo:
        df = df.where(F.col("end").isNull() | (F.col("end") >= F.lit(lo).cast("date")))
    if hi:
        df = df.where(F.col("start").isNull() | (F.col("start") <= F.lit(hi).cast("date")))
    return df


def filter_profiles(profiles: DataFrame, *, name: str | None = None, city: str | None = None, kind: str | None = None, state: str | None = None) -> DataFrame:
    out = published(profiles)
    if name:
        out = out.where(contains_literal(F.col("name"), name))
    if city:
        out = out.where(contains_literal(F.col("city"), city))
    if kind:
        out = out.where(F.col("kind") == kind)
    return out.where(F.col("birth_state") == state.upper()) if state else out


def page_of(df: DataFrame, order: Sequence[str | Column], page: int = 1, size: int = 20) -> DataFrame:
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def list_profiles(profiles: DataFrame, page: int = 1, size: int = 20, **filters: str | None) -> DataFrame:
    """One page by name, then slug, with the exact total of the filtered rows."""
    found = filter_profiles(profiles, **filters)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return page_of(found, ["name", "slug"], page, size).join(F.broadcast(total))


def members_of(profiles: DataFrame, links: DataFrame, org_slug: str) -> DataFrame:
    """Published persons linked to a published organisation; none for unknown slugs."""
    org = published(profiles).where((F.col("slug") == org_slug) & (F.col("kind") == "organizacao")).select(F.col("slug").alias("org_slug"))
    persons = links.join(org, "org_slug", "left_semi").select(F.col("person_slug").alias("slug"))
    return published(profiles).join(persons, "slug", "left_semi")


def facets(profiles: DataFrame, links: DataFrame, kind: str | None = None) -> DataFrame:
    """(facet, label, n, start, end): types over all published profiles; birth states and the period under the type filter; organisations with published persons."""
    live = published(profiles)
    some = live.where(F.col("kind") == kind) if kind and kind != "local" else live if not kind else live.where(F.col("kind") == kind)
    blank = [F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end")]
    types = live.groupBy(F.col("kind").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("type").alias("facet"), "label", "n", *blank)
    states = some.where("birth_state is not null").groupBy(F.col("birth_state").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("state").alias("facet"), "label", "n", *blank)
    period = some.agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.max("end").alias("end")).select(F.lit("period").alias("facet"), F.lit("").alias("label"), "n", "start", "end")
    persons = live.where(F.col("kind") != "organizacao") if kind in (None, "organizacao") else live.where((F.col("kind") == kind) & (F.col("kind") != "local"))
    orgs = live.where(F.col("kind") == "organizacao").select(F.col("slug").alias("org_slug"), "name")
    linked = links.join(persons.select(F.col("slug").alias("person_slug")), "person_slug", "left_semi").join(orgs, "org_slug")
    by_org = linked.groupBy("org_slug", "name").agg(F.countDistinct("person_slug").alias("n")).select(F.lit("organisation").alias("facet"), F.col("name").alias("label"), "n", *blank)
    return types.unionByName(states).unionByName(period).unionByName(by_org)


def _nested(links: DataFrame, key: str, fields: Sequence[str], name: str, order: Sequence[str]) -> DataFrame:
    """Link rows gathered under their parent, before any join multiplies them."""
    rest = [f for f in fields if f not in order]
    return links.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))


def profile_documents(profiles: DataFrame, sources: DataFrame, tags: DataFrame, events: DataFrame, organisations: DataFrame) -> DataFrame:
    """Published profiles with their numbered sources, cited tags, published events and links to published organisations."""
    live = published(profiles)
    orgs = live.where(F.col("kind") == "organizacao").select(F.col("slug").alias("org_slug"), F.col("name").alias("org_name"))
    parts = [
        _nested(sources, "slug", ("ordinal", "source", "pages", "excerpt"), "sources", ["ordinal"]),
        _nested(tags.withColumn("number", F.lit(0)), "slug", ("tag", "number", "source", "pages", "excerpt"), "tags", ["tag"]),
        _nested(published(events), "slug", ("event_id", "title", "date"), "events", ["date", "event_id"]),
        _nested(organisations.join(orgs, "org_slug"), "slug", ("org_slug", "org_name", "note"), "organisations", ["org_slug"]),
    ]
    for p in parts:
        live = live.join(p, "slug", "left")
    return live.withColumns({c: F.coalesce(c, F.array().cast(live.schema[c].dataType)) for c in ("sources", "tags", "events", "organisations")})


def event_documents(events: DataFrame, sources: DataFrame, victims: DataFrame, profiles: DataFrame) -> DataFrame:
    """Published events with sources and the slugs of published victims; the justice block only where a human reviewed it."""
    live = published(profiles).select(F.col("slug").alias("victim"))
    per = victims.join(live, "victim", "left_semi").groupBy("event_id").agg(F.array_sort(F.collect_set("victim")).alias("victims"))
    docs = published(events).join(_nested(sources, "event_id", ("ordinal", "source", "pages", "excerpt"), "sources", ["ordinal"]), "event_id", "left").join(per, "event_id", "left")
    docs = docs.withColumns({c: F.coalesce(c, F.array().cast(docs.schema[c].dataType)) for c in ("sources", "victims")})
    return docs.withColumn("justice", F.when(F.col("reviewed"), F.col("justice")))


def decided_feedback(feedback: DataFrame, interactions: DataFrame, curators: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """Accepted and refused feedback with its question and who decided, newest first, with the total."""
    done = feedback.where(F.col("status").isin("accepted", "refused"))
    total = done.agg(F.count(F.lit(1)).alias("total"))
    joined = done.join(interactions.select("interaction_id", "question"), "interaction_id", "left").join(curators.select(F.col("curator_id").alias("decided_by"), F.col("name").alias("curator")), "decided_by", "left")
    return page_of(joined, [F.desc("decided_at"), "feedback_id"], page, size).join(F.broadcast(total))


def curation_queue(feedback: DataFrame, interactions: DataFrame, status: str = "pending", page: int = 1, size: int = 20) -> DataFrame:
    joined = feedback.where(F.col("status") == status).join(interactions, "interaction_id", "left")
    return page_of(joined, [F.desc("created_at"), "feedback_id"], page, size)


def catalogue(sources: DataFrame) -> DataFrame:
    """Sources by type and title with the count of their type and the total."""
    per = sources.groupBy("kind").agg(F.count(F.lit(1)).alias("of_kind"))
    total = per.agg(F.sum("of_kind").alias("total"))
    return sources.join(per, "kind").join(F.broadcast(total)).orderBy("kind", "title")


def curators(df: DataFrame, public: Sequence[str] = ("name", "role")) -> DataFrame:
    return df.select(*public).orderBy("name")


def events_by_category(events: DataFrame, category: str) -> DataFrame:
    return events.where(F.array_contains("crimes", category))


def events_by_period(events: DataFrame, start: str, end: str) -> DataFrame:
    return events.where(F.col("date").between(F.lit(year_bound(start)).cast("date"), F.lit(year_bound(end, last=True)).cast("date")))


def map_layers(events: DataFrame, category: str) -> DataFrame:
    """events with `layer`: one category has a layer of its own."""
    return events.withColumn("layer", F.when(F.coalesce(F.array_contains("crimes", category), F.lit(False)), F.lit(category)).otherwise(F.lit("events")))


Box = tuple[float, float, float, float]


def in_box(df: DataFrame, box: Box, first_vertex: bool = False) -> DataFrame:
    return df.where((in_bbox_first_vertex if first_vertex else in_bbox)(F.col("geometry"), box))


def birthplaces(profiles: DataFrame, box: Box | None = None) -> DataFrame:
    """(slug, name, lon, lat) of published victims with coordinates."""
    out = published(profiles).where((F.col("kind") == "vitima") & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("slug", "name", "lon", "lat")
    return out.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])) if box else out


def origin_territories(profiles: DataFrame, territories: DataFrame, box: Box | None = None) -> DataFrame:
    """(slug, people, polygons, official) of published victims with a people: the official polygon, else a circle round the point, else left out."""
    t = territories.select(F.col("code").alias("territory_code"), "polygons")
    some = published(profiles).where((F.col("kind") == "vitima") & F.col("people").isNotNull()).join(t, "territory_code", "left")
    ring = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull() & F.col("radius_km").isNotNull(), F.array(F.array(circle(F.col("lon"), F.col("lat"), F.col("radius_km")))))
    out = some.select("slug", "people", F.coalesce("polygons", ring).alias("polygons"), F.col("polygons").isNotNull().alias("official")).where("polygons is not null")
    if box:
        first = F.col("polygons")[0][0][0]
        out = out.where(first[0].between(box[0], box[2]) & first[1].between(box[1], box[3]))
    return out


def municipal_seats(localities: DataFrame, seat: str = "SEDE MUNICIPAL") -> DataFrame:
    """Per code the first row named as the seat, else the last city row. localities: (code, name, category, place, lat, lon, seq)."""
    is_seat = (F.upper("place") == seat).cast("int")
    w = Window.partitionBy("code").orderBy(F.desc("is_seat"), F.when(F.col("is_seat") == 1, F.col("seq")).otherwise(-F.col("seq")))
    return localities.where("category = 'Cidade'").withColumn("is_seat", is_seat).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "is_seat")


def place_key(c: Column | str) -> Column:
    """A folded name with punctuation as spaces."""
    return F.trim(F.regexp_replace(fold_text(c), "[^a-z0-9]+", " "))


def geocode(profiles: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """profiles with new_lat, new_lon and `outcome`: updated, already right, no state or no match; nothing is inferred."""
    g = gazetteer.select(F.upper("state").alias("g_state"), place_key("name").alias("g_key"), F.col("lat").alias("new_lat"), F.col("lon").alias("new_lon")).dropDuplicates(["g_state", "g_key"])
    keyed = profiles.withColumns({"g_state": F.upper("birth_state"), "g_key": place_key("birth_city")})
    joined = keyed.join(g, ["g_state", "g_key"], "left")
    same = F.col("lat").eqNullSafe(F.col("new_lat")) & F.col("lon").eqNullSafe(F.col("new_lon"))
    outcome = F.when(F.col("birth_state").isNull(), "no state").when(F.col("new_lat").isNull(), "no match").when(same, "already right").otherwise("updated")
    return joined.withColumn("outcome", outcome).drop("g_state", "g_key")


def merge_territory_layers(layers: Sequence[DataFrame]) -> DataFrame:
    """(code, name, people, geometry, layer): valid integer codes with a geometry; the last layer wins."""
    tagged = [d.withColumn("layer", F.lit(i)) for i, d in enumerate(layers)]
    all_ = tagged[0]
    for d in tagged[1:]:
        all_ = all_.unionByName(d)
    valid = all_.withColumn("code", F.expr("try_cast(code as int)")).where("code is not null and geometry is not null")
    w = Window.partitionBy("code").orderBy(F.desc("layer"))
    return valid.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def new_per_layer(layers: Sequence[DataFrame]) -> DataFrame:
    """(layer, n): codes that each layer is the first to bring."""
    first = None
    for i, d in enumerate(layers):
        some = d.withColumn("code", F.expr("try_cast(code as int)")).where("code is not null and geometry is not null").select("code", F.lit(i).alias("layer"))
        first = some if first is None else first.unionByName(some)
    return first.groupBy("code").agg(F.min("layer").alias("layer")).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
