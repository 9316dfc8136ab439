"""Named queries of the library and the SQL that states what each returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folium.plans import details, people, serving, texts, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**texts.QUERIES, **vectors.QUERIES, **people.QUERIES, **serving.QUERIES, **details.QUERIES}
ORACLE_SQL: dict[str, str] = {**texts.ORACLE_SQL, **vectors.ORACLE_SQL, **people.ORACLE_SQL, **serving.ORACLE_SQL, **details.ORACLE_SQL}
