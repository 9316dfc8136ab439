"""Sources, manifests and defaults of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.sources.files import upsert


def provenance(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """sources with `provenance`: description, day and checksum of the download; null where the manifest has none."""
    m = manifest.select(F.col("original_url").alias("url"), "description", "downloaded", "sha256")
    text = F.concat(F.col("description"), F.lit(" Downloaded "), F.substring("downloaded", 1, 10), F.lit(", SHA-256 "), F.col("sha256"))
    return sources.join(m, "url", "left").withColumn("provenance", text).drop("description", "downloaded", "sha256")


def without_manifest(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """The error report: sources that no manifest row explains."""
    return sources.join(manifest.select(F.col("original_url").alias("url")), "url", "left_anti")


def register_manifest(current: DataFrame, new: DataFrame) -> DataFrame:
    """One row a url, the new one where both have it."""
    return upsert(current, new.dropDuplicates(["url"]), "url")


def resolve_source_ids(catalogue: DataFrame, sources: DataFrame) -> DataFrame:
    """Known urls keep their id; others get one from the url, the same on every run."""
    known = sources.select("url", F.col("source_id").alias("known"))
    return catalogue.join(known, "url", "left").withColumn("source_id", F.coalesce("known", F.sha2("url", 256))).drop("known")


def default_fields(chunks: DataFrame, defaults: dict[str, str | None]) -> DataFrame:
    """Optional fields that are absent or null take their default."""
    have = set(chunks.columns)
    return chunks.withColumns({c: F.coalesce(F.col(c) if c in have else F.lit(None).cast("string"), F.lit(v).cast("string")) for c, v in defaults.items()})
