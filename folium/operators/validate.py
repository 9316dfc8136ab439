"""Validation, link rows, decisions and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_vocabulary(c: Column, vocabulary: Sequence[str]) -> Column:
    return F.coalesce(c.isin(*vocabulary), F.lit(False))


def all_in_vocabulary(c: Column, vocabulary: Sequence[str]) -> Column:
    """A non-empty array without words from outside."""
    return F.coalesce((F.size(c) > 0) & (F.size(F.array_except(c, F.array(*map(F.lit, vocabulary)))) == 0), F.lit(False))


def _text(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def citation_ok(c: Column) -> Column:
    """A citation has a source, pages and an excerpt."""
    return c.isNotNull() & _text(c["source"]) & _text(c["pages"]) & _text(c["excerpt"])


def citations_ok(citations: Column, least: int = 1) -> Column:
    return F.coalesce((F.size(citations) >= least) & F.forall(citations, citation_ok), F.lit(False))


def tags_ok(tags: Column) -> Column:
    """Every tag has its own citation; no tags are fine."""
    return F.coalesce(F.forall(tags, lambda t: citation_ok(t["citation"])), F.lit(True))


def period_place_errors() -> dict[str, Column]:
    """On (birth_city, birth_state, start, end), dates as text."""
    iso = lambda c: F.col(c).isNull() | (F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col(c).try_cast("date").isNotNull())
    return {
        "birthplace needs a state": F.col("birth_city").isNull() | F.col("birth_state").isNotNull(),
        "state is two letters": F.col("birth_state").isNull() | F.col("birth_state").rlike("^[A-Z]{2}$"),
        "start is an ISO date": iso("start"),
        "end is an ISO date": iso("end"),
        "start is not after end": F.coalesce(F.col("start") <= F.col("end"), F.lit(True)),
    }


def territory_errors() -> dict[str, Column]:
    """On (territory_code, territory_name, people, point, radius_km)."""
    return {
        "code and point exclude each other": F.col("territory_code").isNull() | F.col("point").isNull(),
        "a radius needs a point": F.col("radius_km").isNull() | F.col("point").isNotNull(),
        "code is positive": F.coalesce(F.col("territory_code") > 0, F.lit(True)),
        "radius is positive": F.coalesce(F.col("radius_km") > 0, F.lit(True)),
        "names are not blank": F.coalesce(F.trim("territory_name") != "", F.lit(True)) & F.coalesce(F.trim("people") != "", F.lit(True)),
    }


def link_errors(person_kind: str = "person_kind") -> dict[str, Column]:
    """On (slug, source, pages, excerpt, note) of a link to an organisation."""
    return {
        "link names an organisation": _text(F.col("slug")),
        "link has a citation": _text(F.col("source")) & _text(F.col("pages")) & _text(F.col("excerpt")),
        "perpetrators need a note": (F.col(person_kind) != "perpetrador") | _text(F.col("note")),
    }


def validate(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """The rows with `errors`, all failed rules of each; rows without any are left out. A check that is null fails."""
    errors = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))
    return df.withColumn("errors", errors).where(F.size("errors") > 0)


def missing_victims(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """(event, victim): victims' slugs that no profile has. events: (slug, victims)."""
    each = events.select(F.col("slug").alias("event"), F.explode("victims").alias("victim"))
    return each.join(profiles.select(F.col("slug").alias("victim")), "victim", "left_anti")


def bad_organisations(links: DataFrame, batch: DataFrame, stored: DataFrame) -> DataFrame:
    """(org_slug, problem) of links whose organisation is missing or of another type; the batch's own profiles go first."""
    known = batch.select("slug", "kind").unionByName(stored.join(batch.select("slug"), "slug", "left_anti").select("slug", "kind"))
    joined = links.select("org_slug").distinct().join(known, F.col("org_slug") == F.col("slug"), "left")
    problem = F.when(F.col("kind").isNull(), "missing").when(F.col("kind") != "organizacao", "not an organisation")
    return joined.select("org_slug", problem.alias("problem")).where("problem is not null")


def sources_without_note(sources: DataFrame, kinds: Sequence[str] = ("imprensa", "documento_repressao")) -> DataFrame:
    return sources.where(F.col("kind").isin(*kinds) & (F.trim(F.coalesce("note", F.lit(""))) == ""))


def explode_citations(df: DataFrame, key: str, citations: str = "sources") -> DataFrame:
    """(key, source, pages, excerpt, ordinal from 1)."""
    each = df.select(key, F.posexplode(citations).alias("n", "c"))
    return each.select(key, "c.source", "c.pages", "c.excerpt", (F.col("n") + 1).alias("ordinal"))


def resolve_slugs(links: DataFrame, profiles: DataFrame) -> DataFrame:
    """Links with the id of the profile behind their slug, after the profiles are written."""
    return links.join(profiles.select("slug", "profile_id"), "slug")


def placed_events(events: DataFrame) -> DataFrame:
    """Events with a GeoJSON point and an upper-case state; drafts without a date or coordinates are dropped."""
    from folium.functions.geo import to_point

    return events.withColumns({"point": to_point(F.col("lat_lng")), "state": F.upper("state")}).where("date is not null and point is not null")


def remap_vocabulary(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return df.withColumn(column, F.coalesce(F.element_at(table, F.col(column).cast("string")), F.col(column).cast("string")))


def replace_term(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Case-aware replacement of whole words, letters of any language counted, on authored fields only; quoted excerpts are never among them."""
    out = {}
    for c in columns:
        e = F.col(c)
        for old, new in pairs:
            for a, b in ((old, new), (old.capitalize(), new.capitalize()), (old.upper(), new.upper())):
                e = F.regexp_replace(e, rf"(?<![\p{{L}}\p{{N}}_]){a}(?![\p{{L}}\p{{N}}_])", b)
        out[c] = e
    return df.withColumns(out)


def territory_audit(profiles: DataFrame, territories: DataFrame) -> DataFrame:
    """profiles with `outcome`, the first that applies: both, unknown code, radius without point, official, point, none."""
    known = territories.select(F.col("code").alias("territory_code"), F.lit(True).alias("exists"))
    joined = profiles.join(known, "territory_code", "left")
    code, point = F.col("territory_code").isNotNull(), F.col("point").isNotNull()
    outcome = (
        F.when(code & point, "error: both").when(code & F.col("exists").isNull(), "error: unknown code").when(F.col("radius_km").isNotNull() & ~point, "error: radius without point")
        .when(code, "A").when(point, "B").otherwise("none")
    )
    return joined.withColumn("outcome", outcome).drop("exists")


def apply_decisions(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """(feedback_id, outcome, status, justification, decided_at, decided_by) for each decision: applied, conflict, invalid or unknown id."""
    d = decisions.select("feedback_id", F.col("status").alias("new_status"), F.col("justification").alias("new_justification"), F.col("at").alias("new_at"), F.col("by").alias("new_by"))
    joined = d.join(queue, "feedback_id", "left")
    valid = F.col("new_status").isin("accepted", "refused") & F.length("new_justification").between(10, 2000)
    outcome = F.when(F.col("status").isNull(), "unknown id").when(F.col("status") != "pending", "conflict").when(~F.coalesce(valid, F.lit(False)), "invalid").otherwise("applied")
    pick = lambda new, old: F.when(outcome == "applied", F.col(new)).otherwise(F.col(old))
    return joined.select("feedback_id", outcome.alias("outcome"), pick("new_status", "status").alias("status"), pick("new_justification", "justification").alias("justification"), pick("new_at", "decided_at").alias("decided_at"), pick("new_by", "decided_by").alias("decided_by"))


def check_feedback(feedback: DataFrame, interactions: DataFrame, classes: Sequence[str]) -> DataFrame:
    """feedback with `status` pending, or the error that stops it."""
    known = interactions.select("interaction_id").distinct().withColumn("exists", F.lit(True))
    joined = feedback.join(known, "interaction_id", "left")
    error = F.when(F.col("exists").isNull(), "unknown interaction").when(~in_vocabulary(F.col("class"), classes), "unknown class")
    return joined.withColumns({"error": error, "status": F.when(error.isNull(), "pending")}).drop("exists")


def count_gate(df: DataFrame, low: int, high: int) -> DataFrame:
    """df itself; raises before anything is written when its rows are fewer or more than expected."""
    n = df.count()
    if not low <= n <= high:
        raise ValueError(f"{n} rows, expected {low} to {high}")
    return df
