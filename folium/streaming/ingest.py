"""Incremental ingestion of page files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folium.sources.files import replace_source

PAGE_FILE = "pagina int, texto string, text string, conteudo string, qualidade_ocr string"


def ingest_pages_stream(spark: SparkSession, incoming: str, table: str, checkpoint: str) -> StreamingQuery:
    """Take page files that weren't taken before and replace their sources in the table; ends when all are in."""
    raw = spark.readStream.schema(PAGE_FILE).option("lineSep", "\n").json(incoming)
    source = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)
    pages = raw.select(source.alias("source"), F.col("pagina").alias("page"), F.coalesce("texto", "text", "conteudo").alias("text"), F.col("qualidade_ocr").alias("ocr_quality"))

    def load(batch: DataFrame, _: int) -> None:
        replace_source(batch, table)

    return pages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(load).start()
