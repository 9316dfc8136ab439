"""Replacement of sources when jobs fail, tables of geometries by place, sub-word counters, and rings that don't cross."""

import os
import random

import pytest
from pyspark.sql import functions as F

from folium.functions import geo
from folium.functions.subwords import SubwordCounter
from folium.operators import chunks
from folium.sources import files

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def rows(spark, path, **more):
    return sorted(((r.source, r.n) for r in files.read_sources(spark, path, **more).collect()), key=str)


def test_replaced_sources_and_failures(spark, tmp_path, monkeypatch):
    path, frame = str(tmp_path / "t"), lambda x: spark.createDataFrame(x, "source string, n int")
    with pytest.raises(FileNotFoundError):
        files.read_sources(spark, path)
    files.replace_source(frame([("01", 1), ("01", 2), ("b", 3), (None, 4)]), path)
    first = rows(spark, path)
    assert first == sorted([("01", 1), ("01", 2), ("b", 3), (None, 4)], key=str)
    # rows that can't be computed: the data's job fails half way
    bad = frame([("01", 9), ("b", 9)]).withColumn("n", F.when(F.col("source") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("n")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        files.replace_source(bad, path)
    assert rows(spark, path) == first
    # the data are written, the manifest isn't
    with monkeypatch.context() as m:
        m.setattr(files, "live_versions", lambda s, p: frame([("x", 1)]).select("source", F.raise_error(F.lit("lost")).cast("string").alias("version")))
        with pytest.raises(Exception, match="lost"):
            files.replace_source(frame([("01", 9)]), path)
    assert rows(spark, path) == first
    for _ in range(2):
        files.replace_source(frame([("01", 7), (None, 8)]), path, frame([("b", 0)]).select("source"))
        assert rows(spark, path, schema="source string, n int") == sorted([("01", 7), (None, 8)], key=str)
    files.drop_old_versions(spark, path)
    assert rows(spark, path) == sorted([("01", 7), (None, 8)], key=str)
    assert len(os.listdir(f"{path}/data")) == 1 and len([x for x in os.listdir(f"{path}/manifest") if x.isdigit()]) == 1


def test_second_of_two_writers_fails(spark, tmp_path, monkeypatch):
    path, frame = str(tmp_path / "t"), lambda x: spark.createDataFrame(x, "source string, n int")
    files.replace_source(frame([("a", 1)]), path)
    files.replace_source(frame([("a", 2)]), path)
    monkeypatch.setattr(files, "_latest", lambda s, p: 1)
    with pytest.raises(Exception, match="(?i)exist"):
        files.replace_source(frame([("a", 3)]), path)
    monkeypatch.undo()
    assert rows(spark, path) == [("a", 2)]


def test_boxes_read_few_files(spark, tmp_path):
    rng = random.Random(4)
    shapes = []
    for _ in range(400):
        x, y, w = rng.uniform(-179, 179), rng.uniform(-89, 89), rng.choice([0.1, 5, 60])
        shapes.append(f'{{"type":"Point","coordinates":[{x},{y}]}}' if rng.random() < 0.4 else f'{{"type":"Polygon","coordinates":[[[{x},{y}],[{x + w},{y}],[{x},{y + w}],[{x},{y}]]]}}')
    shapes += [None, '{"type":"Polygon","coordinates":[]}', '{"type":"Point","coordinates":[500,-500]}', '{"type":"LineString","coordinates":[[0,0],[1,1]]}']
    df = spark.createDataFrame(list(enumerate(shapes)), "k int, raw string").withColumn("geometry", geo.parse_geometry(F.col("raw")))
    path = str(tmp_path / "g")
    files.write_geometries(df, path)
    read = []
    for box in ((-180, -90, 180, 90), (-47, -24, 20, 10), (10, 40, 12, 42), (400, -600, 600, -400)):
        for first in (False, True):
            found = files.read_box(spark, path, box, first_vertex=first)
            inside = geo.in_bbox_first_vertex if first else geo.in_bbox
            assert sorted(r.k for r in found.collect()) == sorted(r.k for r in df.where(inside(F.col("geometry"), box)).collect())
            assert found.columns == df.columns
        near = spark.read.parquet(path).where(geo.cells_of_box(box))
        read.append(near.select(F.input_file_name()).distinct().count())
    assert read[2] < read[1] < read[0] and read[2] < 20


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_subword_counts_and_limits(spark, name):
    counter = SubwordCounter(f"{TOKENIZERS}/{name}")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    found = {r.doc_id: r.n for r in docs.select("doc_id", chunks.count_tokens("text", counter).alias("n")).collect()}
    if name.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=counter.path)
        said = {r.doc_id: len(own.encode(r.text or "")) for r in docs.collect()}
    else:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(counter.path)
        said = {r.doc_id: len(own.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert found == said
    pages = docs.select("source", F.col("doc_id").alias("page"), "text", F.lit("x").alias("section"))
    packed = chunks.build_chunks(pages, sep="\n", counter=counter).collect()
    longest = max(r.tokens for r in packed)
    assert longest <= 512 or all(r.tokens <= 512 or " " not in r.text for r in packed)
    assert all(r.tokens == counter(r.text) for r in packed)


def crosses(rings):
    """Whether two segments of the rings meet anywhere but at the ends they share."""
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    segments = [(a, b) for r in rings for a, b in zip(r, r[1:], strict=False)]
    for i, (a, b) in enumerate(segments):
        for c, d in segments[:i]:
            if {tuple(a), tuple(b)} & {tuple(c), tuple(d)}:
                continue
            if turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0:
                return True
    return False


def test_simplified_rings_never_cross():
    from math import cos, hypot, pi, sin

    rng = random.Random(7)
    shrunk = 0
    for _ in range(60):
        n = rng.randint(8, 60)
        star = [[r * cos(2 * pi * i / n), r * sin(2 * pi * i / n)] for i in range(n) for r in [rng.uniform(0.9, 1.3)]]
        inner = [[0.99 * x * f, 0.99 * y * f] for x, y in star for f in [rng.uniform(0.9, 1.0)]]
        rings = [[*star, star[0]], [*inner, inner[0]]]
        if crosses(rings):
            continue
        tolerance = rng.choice([0.01, 0.1, 0.5])
        (out,) = geo.simplified([rings], tolerance)
        assert not crosses(out)
        for old, new in zip(rings, out, strict=True):
            assert new[0] == new[-1] == old[0] and len(new) >= 4 and all(v in old for v in new)
            for p in old:
                gap = min(hypot(p[0] - a[0] - s * (b[0] - a[0]), p[1] - a[1] - s * (b[1] - a[1])) for a, b in zip(new, new[1:], strict=False) for s in [max(0, min(1, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2 or 1)))])
                assert gap <= tolerance + 1e-9
            shrunk += len(old) - len(new)
    assert shrunk > 300
    assert geo.simplified([[]], 1) == [[]] and geo.simplified([], 1) == []
    assert geo.simplified([[[[0, 0], [1, 0], [1, 1]]]], 9) == [[[[0, 0], [1, 0], [1, 1]]]]
