"""The registered queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folium.llm.clusters import CLUSTER_SQL, cluster_digest
from folium.llm.common import table
from folium.llm.flac import media_digest
from folium.llm.html_text import extract_text
from folium.llm.licenses import license_notices
from folium.llm.merge_dropout import segmentation_digest
from folium.llm.packing import pack_documents
from folium.llm.runs import run_digest
from folium.llm.secrets import secrets
from folium.llm.simhash import near_duplicates
from folium.llm.text_quality import quality
from folium.llm.token_files import token_file_digest
from folium.llm.topk import TOP_K_SQL, top_k
from folium.llm.toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _documents(operator: Callable[[DataFrame], DataFrame], name: str = "documents") -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


QUERIES: dict[str, Query] = {
    "op1_html_text": _documents(extract_text, "pages"),
    "op2_secrets": _documents(secrets),
    "op3_simhash": _documents(near_duplicates),
    "op4_toxicity": lambda spark, sf_dir: toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op5_merge_dropout": _documents(segmentation_digest),
    "op6_packing": _documents(pack_documents),
    "op7_flac": _documents(media_digest),
    "op8_topk": _documents(top_k, "embeddings"),
    "op9_token_files": _documents(token_file_digest),
    "op10_licenses": _documents(license_notices),
    "op11_runs": _documents(run_digest),
    "op12_quality": lambda spark, sf_dir: quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op13_clusters": _documents(cluster_digest, "embeddings"),
}

ORACLE_SQL: dict[str, str] = {"op8_topk": TOP_K_SQL, "op13_clusters": CLUSTER_SQL}
