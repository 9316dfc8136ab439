"""Reading and writing the archive's files and tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from folium.functions.geo import FINEST, bounds, cells_of_box, in_bbox, in_bbox_first_vertex, quad_cell

ITEM_COLUMNS = ("handle", "title", "author", "date", "n_files", "main_file", "size_mb", "kind")


def _file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(source, page, text, ocr_quality) of JSON Lines; lines end at newlines only, the text stands under one of three names."""
    raw = spark.read.schema("pagina int, texto string, text string, conteudo string, qualidade_ocr string").option("lineSep", "\n").json(path)
    return raw.select(_file_stem(F.input_file_name()).alias("source"), F.col("pagina").alias("page"), F.coalesce("texto", "text", "conteudo").alias("text"), F.col("qualidade_ocr").alias("ocr_quality"))


def read_catalogue(spark: SparkSession, path: str, record: str) -> DataFrame:
    """(slug, record) of a JSON object of slugs; `record` is the DDL of one record."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"map<string,struct<{record}>>")).alias("slug", "record"))


def read_items_tsv(spark: SparkSession, path: str) -> DataFrame:
    """The items of a tab file with a header; rows with fewer than eight fields or without an integer key are left out."""
    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= len(ITEM_COLUMNS))
    f = f.withColumn("key", F.expr("try_cast(trim(f[0]) as int)")).where("key is not null")
    return f.select("key", *(F.col("f")[i].alias(c) for i, c in enumerate(ITEM_COLUMNS) if i))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One-object JSON files with the name of the file each came from."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """One row a feature of GeoJSON collections: its properties and the raw geometry."""
    raw = spark.read.text(path, wholetext=True)
    feature = raw.select(F.explode(F.from_json("value", f"struct<features:array<struct<properties:struct<{properties}>,geometry:string>>>")["features"]).alias("x"))
    return feature.select("x.properties.*", F.col("x.geometry").alias("geometry"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.partitionBy("source").mode("overwrite").json(path)


def _entries(spark: SparkSession, folder: str) -> list[str]:
    """Numbers of the finished manifests in a folder, wherever it lies."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(folder)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    return [x.getPath().getName() for x in system.listStatus(at) if x.getPath().getName().isdigit() and system.exists(hadoop.Path(x.getPath(), "_SUCCESS"))]


def _latest(spark: SparkSession, path: str) -> int:
    return max(map(int, _entries(spark, f"{path}/manifest")), default=0)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    """Give a folder a name that must be free."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = gateway.new_array(kind, 1)
    how[0] = kind.NONE
    at = jvm.org.apache.hadoop.fs.Path(old)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(at, jvm.org.apache.hadoop.fs.Path(new), how)


def live_versions(spark: SparkSession, path: str) -> DataFrame:
    """(source, version): the version that holds each source's rows, by the latest manifest; none before the first."""
    latest = _latest(spark, path)
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/{latest}") if latest else spark.createDataFrame([], _MANIFEST)


_MANIFEST = "source string, version string"


def replace_source(incoming: DataFrame, path: str, sources: DataFrame | None = None) -> None:
    """Put incoming's rows in the place of all rows of its sources, and of sources(source) where given; leave all others; twice is as once.

    Rows are written as a version of their own. Then a manifest that names the
    version of each source is written and renamed to the next number; it holds from
    that moment. Until then, and if a job fails anywhere, readers see what was there
    before. Of two writers at once the second to rename fails.
    Rows without a source are a source of their own.
    """
    spark = incoming.sparkSession
    number, version = _latest(spark, path) + 1, f"v{uuid.uuid4().hex}"
    before = live_versions(spark, path)
    incoming.sortWithinPartitions("source").write.parquet(f"{path}/data/version={version}")
    new = spark.read.schema(incoming.schema).parquet(f"{path}/data/version={version}").select(F.col("source").cast("string"))
    named = (new if sources is None else new.unionByName(sources.select(F.col("source").cast("string")))).distinct()
    kept = before.join(named.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")), "left_anti")
    kept.unionByName(named.withColumn("version", F.lit(version))).write.parquet(f"{path}/manifest/_{version}")
    _rename(spark, f"{path}/manifest/_{version}", f"{path}/manifest/{number}")


def read_sources(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """The rows that replace_source() has put into a table: of each source those of its latest version."""
    if not _latest(spark, path):
        raise FileNotFoundError(f"no source has been written to {path}")
    reader = spark.read.schema(StructType([*_fields(schema), StructField("version", StringType())])) if schema else spark.read.option("mergeSchema", True)
    rows, live = reader.parquet(f"{path}/data"), live_versions(spark, path).toDF("live source", "live version")
    same = F.col("source").cast("string").eqNullSafe(F.col("live source")) & (F.col("version") == F.col("live version"))
    return rows.join(live, same, "left_semi").drop("version")


def _fields(schema: str | StructType) -> list[StructField]:
    return (schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).fields


def drop_old_versions(spark: SparkSession, path: str) -> None:
    """Delete the versions that the latest manifest doesn't name, unfinished ones too, and older manifests. Call it while nobody reads or writes."""
    hadoop, latest = spark._jvm.org.apache.hadoop.fs, _latest(spark, path)
    live = {r["version"] for r in live_versions(spark, path).select("version").distinct().toLocalIterator()}
    for folder, stays in ((f"{path}/data", lambda name: name.removeprefix("version=") in live), (f"{path}/manifest", lambda name: name == str(latest))):
        at = hadoop.Path(folder)
        system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        for x in system.listStatus(at) if system.exists(at) else []:
            if not stays(x.getPath().getName()):
                system.delete(x.getPath(), True)


def write_geometries(df: DataFrame, path: str, geometry: str = "geometry", finest: int = FINEST) -> None:
    """A table of geometries laid out by the quadtree cells that hold them, so that a box reads few files."""
    cell = quad_cell(bounds(F.col(geometry)), finest)
    placed = df.withColumn("quad cell", cell).select("*", "quad cell.*").drop("quad cell")
    placed.repartition("level", "cx", "cy").write.partitionBy("level", "cx", "cy").mode("overwrite").parquet(path)


def read_box(spark: SparkSession, path: str, box: tuple[float, float, float, float], geometry: str = "geometry", *, first_vertex: bool = False, finest: int = FINEST) -> DataFrame:
    """The rows of write_geometries() whose geometry is in the box, by any vertex of an outer ring or by the first alone; files of other cells aren't read."""
    near = spark.read.parquet(path).where(cells_of_box(box, finest))
    inside = in_bbox_first_vertex if first_vertex else in_bbox
    return near.where(inside(F.col(geometry), box)).drop("level", "cx", "cy")


def upsert(current: DataFrame, incoming: DataFrame, key: str | list[str]) -> DataFrame:
    return current.join(incoming, key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def replace_links(links: DataFrame, incoming: DataFrame, parents: DataFrame, parent_key: str) -> DataFrame:
    """All links of the reprocessed parents go; the new ones come; a parent without new ones ends with none."""
    return links.join(parents.select(parent_key).distinct(), parent_key, "left_anti").unionByName(incoming)


def features(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """(feature): a GeoJSON feature a row; nulls are left out of the properties."""
    properties = F.to_json(F.struct(*(c for c in df.columns if c != geometry)))
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(F.col(geometry), F.lit("null")), F.lit(',"properties":'), properties, F.lit("}")).alias("feature"))


def write_features(df: DataFrame, path: str, geometry: str = "geometry") -> None:
    """One feature a line: the form that scales."""
    features(df, geometry).write.mode("overwrite").text(path)


def feature_collection(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One row with the whole collection, for the small layers a map reads."""
    return features(df, geometry).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", F.array_sort(F.collect_list("feature"))), F.lit("]}")).alias("collection"))


def dossier(mentions: DataFrame) -> DataFrame:
    """(name, section): one Markdown section per name with its quoted excerpts. mentions: (name, title, ordinal, excerpt)."""
    quoted = F.struct("title", "ordinal", F.concat(F.lit("> "), F.col("excerpt"), F.lit("\n\n— "), F.col("title")).alias("quote"))
    per = mentions.groupBy("name").agg(F.array_sort(F.collect_list(quoted)).alias("quotes"))
    body = F.concat_ws("\n\n", F.transform("quotes", lambda q: q["quote"]))
    return per.select("name", F.concat(F.lit("## "), F.col("name"), F.lit("\n\n"), body, F.lit("\n")).alias("section"))


def dossier_parts(mentions: DataFrame) -> DataFrame:
    """(name, place, title, ordinal, part): a name's heading (place 0) and each of its quoted excerpts (place 1), a row each; sorted by all but the last they read as dossier() does."""
    quotes = mentions.select("name", F.lit(1).alias("place"), "title", "ordinal", F.concat(F.lit("> "), F.col("excerpt"), F.lit("\n\n— "), F.col("title"), F.lit("\n")).alias("part"))
    none = [F.lit(None).cast(mentions.schema[c].dataType).alias(c) for c in ("title", "ordinal")]
    heads = mentions.select("name").distinct().select("name", F.lit(0).alias("place"), *none, F.concat(F.lit("## "), F.col("name"), F.lit("\n")).alias("part"))
    return heads.unionByName(quotes)


def write_dossier(mentions: DataFrame, path: str) -> None:
    """The parts in one order over all files, so that no name's excerpts have to fit a row or a task."""
    dossier_parts(mentions).where("part is not null").orderBy("name", "place", "title", "ordinal").select("part").write.mode("overwrite").text(path)


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
