"""Golden values and invariants of the archive's operators."""

import datetime
import json
import math
import random

from pyspark.sql import functions as F

from folium.functions import geo
from folium.functions import text as t
from folium.operators import chunks, mining, quality, records, search, sections, serve, validate
from folium.sources import files
from folium.streaming import ingest, quota


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_cleaning(spark):
    assert one(spark, t.normalize_space(F.col("a")), a=" a \t b\n\n\n\nc\n") == "a b\n\nc"
    assert one(spark, t.dehyphenate(F.col("a")), a="agremia-\nção") == "agremiação"
    assert one(spark, t.join_spaced_years(F.col("a")), a="x\n1 9 6 4\ny") == "x\n1964\ny"
    assert one(spark, t.join_wrapped_lines(F.col("a")), a="one\ntwo.\nthree\n\nfour") == "one two.\nthree\n\nfour"
    assert one(spark, t.strip_page_number_lines(F.col("a"), "bar"), a="x\n| 12 |\ny") == "x\n\ny"
    assert one(spark, t.strip_header_block(F.col("a"), ["A.*", "B.*", r"\d+"]), a="A1\nB2\nbody") == "body"
    assert one(spark, t.merge_broken_heading(F.col("a"), r"\(\d{4}"), a="text\nJOÃO DA\nSILVA (1940-1970)\nmore") == "text\n\nJOÃO DA SILVA (1940-1970)\n\nmore"
    assert one(spark, t.repair_control_chars(F.col("a"), {"\x93": '"'}), a="a\x93b­c  d") == 'a"bc d'


def test_labels_and_dates(spark):
    assert one(spark, t.chapter_opening(F.col("a"), "capítulo"), a="3\nCapítulo\nThe\ntitle\n\nbody") == "3 – The title"
    assert one(spark, t.spelled_ordinal(F.col("a")), a="a septuagésima primeira audiência") == 71
    assert one(spark, t.session_number(F.col("a")), a="Foi instalada a 71ª audiência pública") == 71
    assert one(spark, t.session_number(F.col("a")), a="instalada a centésima décima audiência pública") == 110
    for line, number in (("Há 10 anos foi instalada a septuagésima audiência pública", 70), ("instalada a 71º audiência pública", 71), ("Instalação da 5ª audiência pública", 5), ("a 5ª audiência pública", None), ("instalado\nx\n instalação da 7* Audiência  Pública", 7)):
        assert one(spark, t.session_number(F.col("a")), a=line) == number
    assert one(spark, t.session_date(F.col("a")), a="em 5-6-2013") == datetime.date(2013, 6, 5)
    assert one(spark, t.session_date(F.col("a")), a="em 5 marco 2013") == datetime.date(2013, 3, 5)
    assert one(spark, t.session_date(F.col("a")), a="em 3/4/1970 e 5/6/2013, 7 de agosto de 2014") == datetime.date(2014, 8, 7)
    for raw, iso in (("31/12/59", "2059-12-31"), ("1/1/60", "1960-01-01"), ("3-4-1970", "1970-04-03"), ("1/13/1970", None)):
        assert one(spark, t.parse_dmy(F.col("a")), a=raw) == iso
    assert one(spark, t.parse_ambiguous_date(F.col("a")), a="3/4/1970") == "1970-03-04"
    assert one(spark, t.parse_ambiguous_date(F.col("a")), a="13/4/1970") == "1970-04-13"
    assert tuple(one(spark, t.parse_place(F.col("a")), a="1/2/50, Curitiba (pr)")) == ("Curitiba", "PR")
    assert one(spark, t.slugify(F.col("a")), a=" João d'Ávila ") == "joao-d-avila"
    assert one(spark, t.title_case_name(F.col("a")), a="MARIA DA SILVA") == "Maria da Silva"
    assert one(spark, t.cut_with_mark(F.col("a"), 400, "…"), a="x" * 600) == "x" * 400 + "…"


def test_split_summary(spark):
    assert tuple(one(spark, t.split_summary(F.col("a")), a="Resumo: short\n---\nResposta: long")) == ("short", "long")
    assert tuple(one(spark, t.split_summary(F.col("a")), a="no divider ")) == ("", "no divider")
    assert tuple(one(spark, t.split_summary(F.col("a")), a="---\nonly answer"))[0] == ""


def test_quality_gate_edges(spark):
    pages = spark.createDataFrame([("s", 1, "a" * 59), ("s", 2, "a" * 60), ("s", 3, "a" * 60 + "1" * 60), ("s", 4, "a" * 60 + "1" * 61), ("s", 5, None), ("s", 6, " \n")], "source string, page int, text string")
    assert {r.page for r in quality.quality_gate(pages).collect()} == {2, 3}
    assert {(r.page, r.reason) for r in quality.discard_log(pages).collect()} == {(1, "baixa_qualidade"), (4, "baixa_qualidade"), (5, "em_branco"), (6, "em_branco")}


def test_null_section_joins_the_next(spark):
    rows = [("s", i, x) for i, x in enumerate([None, "a", "a", None, "b"])]
    out = chunks.runs(spark.createDataFrame(rows, "source string, n int, section string"), ["n"]).orderBy("n")
    assert [r.run for r in out.collect()] == [0, 0, 0, 1, 1]


def brute(tokens, split, target=395, overlap=80):
    """The same rules, told step by step."""
    out, buffer = [], []
    for i in range(len(tokens)):
        if buffer and sum(tokens[j] for j in buffer) + tokens[i] > target:
            out.append(list(buffer))
            keep = []
            if not split[i] and tokens[buffer[-1]] <= overlap:
                while sum(tokens[j] for j in keep) < overlap and len(keep) < len(buffer):
                    keep = buffer[len(buffer) - len(keep) - 1 :]
            buffer = list(keep)
        buffer.append(i)
    return out + ([buffer] if buffer else [])


def test_overlap_may_be_the_whole_chunk():
    assert chunks.greedy([40, 30, 395, 100], [False] * 4) == [[0, 1], [0, 1, 2], [3]]
    assert chunks.greedy([], []) == [] and chunks.greedy([500], [False]) == [[0]]


def test_both_counters_agree(spark):
    texts = ["a b,c", "a\u00a0b", "e\u0301t\u00e9 x", "x\x0by\x1cz", "_a-b_ 12", "日本 語", ""]
    df = spark.createDataFrame([(t_,) for t_ in texts], "text string")
    assert [r.n for r in df.select(chunks.count_tokens("text").alias("n")).collect()] == [chunks.count_words(t_) for t_ in texts]


def test_mentions(spark):
    names = spark.createDataFrame([("Ana de Sá",), ("Rui Lo",), ("Zé da Vila Nova",), ("",), (None,), ("ANA DE SÁ",)], "name string")
    texts = spark.createDataFrame([("t", 1, "x ANA de sá y"), ("t", 2, "na vila nova"), ("t", 3, None), ("t", 4, "Vila Nova e Ana de Sá")], "title string, ordinal int, text string")
    got = {(r.name, r.ordinal, r.by_tail) for r in mining.mentions(names, texts).collect()}
    assert got == {("Ana de Sá", 1, False), ("Ana de Sá", 4, False), ("ANA DE SÁ", 1, False), ("ANA DE SÁ", 4, False), ("Zé da Vila Nova", 2, True), ("Zé da Vila Nova", 4, True)}
    assert mining.mentions(names.limit(0), texts).count() == 0


def test_packing_against_restatement():
    rng = random.Random(1)
    for _ in range(300):
        tokens = [rng.choice([1, 5, 40, 79, 80, 81, 120, 300, 395]) for _ in range(rng.randrange(40))]
        split = [rng.random() < 0.2 for _ in tokens]
        got = chunks.greedy(tokens, split)
        assert got == brute(tokens, split)
        assert sorted({i for c in got for i in c}) == list(range(len(tokens)))


def test_build_chunks_invariants(spark):
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice(["alpha", "beta.", "gamma,"]) for _ in range(n))
    rows = [(f"s{s}", p, "\n\n".join(words(rng.randrange(1, 600)) for _ in range(3)), rng.choice(["x", "y", None])) for s in range(3) for p in range(6)]
    out = chunks.build_chunks(spark.createDataFrame(rows, "source string, page int, text string, section string")).collect()
    for s in {r.source for r in out}:
        own = sorted((r for r in out if r.source == s), key=lambda r: r.ordinal)
        assert [r.ordinal for r in own] == list(range(len(own)))
        assert all(r.tokens <= 512 for r in own)
        assert [r.page_first for r in own] == sorted(r.page_first for r in own)


def test_facets_golden(spark):
    d = lambda x: datetime.date.fromisoformat(x) if x else None
    people = [("v1", "A", "vitima", "PE", "1964-04-01", None), ("v2", "B", "vitima", "BA", None, "1973-12-31"), ("o", "Org", "organizacao", None, None, None)]
    profiles = spark.createDataFrame([(s, n, k, u, "publicada", d(a), d(b)) for s, n, k, u, a, b in people], "slug string, name string, kind string, birth_state string, status string, start date, end date")
    links = spark.createDataFrame([("v1", "o"), ("v2", "o")], "person_slug string, org_slug string")
    got = {(r.facet, r.label): r for r in serve.facets(profiles, links).collect()}
    assert {k: r.n for k, r in got.items() if k[0] == "type"} == {("type", "vitima"): 2, ("type", "organizacao"): 1}
    assert got["state", "BA"].n == got["state", "PE"].n == 1 and got["organisation", "Org"].n == 2
    assert (got["period", ""].start, got["period", ""].end) == (d("1964-04-01"), d("1973-12-31"))


def test_bbox(spark):
    box = (-47, -24, -46, -23)
    shapes = {
        "in": '{"type":"Point","coordinates":[-46.63,-23.55]}',
        "out": '{"type":"Point","coordinates":[-60.02,-3.1]}',
        "vertex": '{"type":"Polygon","coordinates":[[[-46.6,-23.5],[-40,-23.5],[-40,-20],[-46.6,-23.5]]]}',
        "covers": '{"type":"Polygon","coordinates":[[[-50,-30],[-40,-30],[-40,-20],[-50,-20],[-50,-30]]]}',
        "second": '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[-46.5,-23.5],[-1,0],[-1,1],[-46.5,-23.5]]]]}',
        "hole": '{"type":"Polygon","coordinates":[[[-50,-30],[-40,-30],[-40,-20],[-50,-30]],[[-46.5,-23.5],[-46.4,-23.5],[-46.4,-23.4],[-46.5,-23.5]]]}',
    }
    df = spark.createDataFrame(list(shapes.items()), "k string, raw string").withColumn("geometry", geo.parse_geometry(F.col("raw")))
    assert {r.k for r in serve.in_box(df, box).collect()} == {"in", "vertex", "second"}
    assert {r.k for r in serve.in_box(df, box, first_vertex=True).collect()} == {"in", "vertex"}


def test_circle_and_simplify(spark):
    ring = one(spark, geo.circle(F.lit(10.0), F.lit(60.0), F.lit(111.0)))
    assert len(ring) == 65 and ring[0] == ring[-1] and abs(ring[0][0] - 12) < 1e-9 and abs(ring[16][1] - 61) < 1e-9
    square = [[[float(x), 0.0] for x in range(5)] + [[4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]]
    df = spark.createDataFrame([([square],)], "g array<array<array<array<double>>>>")
    assert df.select(geo.simplify_rings(0.01)("g").alias("x")).first().x[0][0] == [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]


def test_small_rings_need_no_arrays(spark, monkeypatch):
    rings = [[[0.0, 0.0], [1.0, 0.0], [2.0, 0.001], [4.0, 0.0], [4.0, 4.0], [2.0, 4.005], [0.0, 4.0], [0.0, 0.0]], [[2.0, 4.003], [1.9, 3.9], [2.1, 3.9], [2.0, 4.003]]]
    circle = [[[math.cos(x * math.pi / 100), math.sin(x * math.pi / 100)] for x in range(200)] + [[1.0, 0.0]]]
    several = geo.simplified([circle], 0.01)
    monkeypatch.setattr(geo, "FEW", 1000)
    assert geo.simplified([circle], 0.01) == several
    assert 10 < len(several[0][0]) < 50
    monkeypatch.setattr(geo, "np", None)  # a few points cost less without
    assert geo.simplified([rings], 0.01) == [[[v for i, v in enumerate(rings[0]) if i not in (1, 2)], rings[1]]]
    monkeypatch.undo()
    hole = [[[0.0, 0.0], [None, 1.0], [1.0, 1.0], [1.0, 0.0], [0.0, 0.0]]]
    df = spark.createDataFrame([(1, [hole]), (2, None), (3, []), (4, [[]])], "k int, g array<array<array<array<double>>>>")
    assert {r.k: r.x for r in df.select("k", geo.simplify_rings(0.01)("g").alias("x")).collect()} == {1: [hole], 2: None, 3: [], 4: [[]]}


def test_quota():
    flags, start, count = quota.judge([0] * 21, None, 0)
    assert flags == [True] * 20 + [False] and (start, count) == (0, 20)
    assert quota.judge([59_999], start, count)[0] == [False]
    assert quota.judge([60_000], start, count)[0] == [True]


def test_quota_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    at = sorted(rng.randrange(200_000) for _ in range(120))
    rows = [(rng.choice("ab"), i, ms) for i, ms in enumerate(at)]
    df = spark.createDataFrame(rows, "key string, id long, ts_ms long")
    stamped = df.select("key", "id", F.timestamp_millis("ts_ms").alias("ts"))
    stamped.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(stamped.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "10 seconds")
    run = quota.quota_stream(stream).writeStream.format("memory").queryName("quota_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    key = lambda r: (r.key, r.id)
    assert sorted(((r.key, r.id, r.allowed) for r in spark.table("quota_out").collect())) == sorted((r.key, r.id, r.allowed) for r in quota.quota_flags(df).collect())


def test_ingest_replaces_per_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"pagina":1,"texto":"one\\u2028x"}\n{"pagina":2,"conteudo":"two"}\n', encoding="utf-8")
    go = lambda: ingest.ingest_pages_stream(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    go()
    (tmp_path / "in/b.jsonl").write_text('{"pagina":1,"text":"b"}\n', encoding="utf-8")
    go()
    got = {(r.source, r.page, r.text) for r in files.read_sources(spark, str(tmp_path / "t")).collect()}
    assert got == {("a", 1, "one x"), ("a", 2, "two"), ("b", 1, "b")}


def test_sources(spark, tmp_path):
    (tmp_path / "i.tsv").write_text("handle\ttitle\ta\td\tn\tp\ts\tt\n12\tT\tA\tD\t1\tf.pdf\t2\tx\nbad\tT\tA\tD\t1\tf\t2\tx\n13\tshort\n")
    assert [(r.key, r.title) for r in files.read_items_tsv(spark, str(tmp_path / "i.tsv")).collect()] == [(12, "T")]
    (tmp_path / "c.json").write_text(json.dumps({"a": {"url": "u"}, "b": {"url": "v"}}))
    assert {(r.slug, r.record.url) for r in files.read_catalogue(spark, str(tmp_path / "c.json"), "url:string").collect()} == {("a", "u"), ("b", "v")}
    (tmp_path / "g.json").write_text(json.dumps({"features": [{"properties": {"code": 1}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    f = files.read_features(spark, str(tmp_path / "g.json"), "code:int").first()
    assert f.code == 1 and json.loads(f.geometry)["type"] == "Point"
    (tmp_path / "r").mkdir()
    (tmp_path / "r/x.json").write_text('{\n"slug": "x"\n}')
    assert files.read_records(spark, str(tmp_path / "r"), "slug string").first().file.endswith("x.json")
    assert files.file_fingerprints(spark, str(tmp_path / "c.json")).first().size == (tmp_path / "c.json").stat().st_size
    whole = files.feature_collection(spark.createDataFrame([(1, '{"type":"Point"}')], "k int, geometry string")).first().collection
    assert json.loads(whole)["features"][0]["properties"] == {"k": 1}
    rows = spark.createDataFrame([("a", 1, "x\u2028y"), ("b", 2, None)], "source string, ordinal int, text string")
    files.write_chunks(rows, str(tmp_path / "chunks"))
    back = spark.read.json(str(tmp_path / "chunks"), schema="ordinal int, text string, source string")
    assert {(r.source, r.ordinal, r.text) for r in back.collect()} == {("a", 1, "x\u2028y"), ("b", 2, None)}
    for _ in range(2):
        files.replace_source(spark.createDataFrame([("a", 1), ("b", 2)], "source string, n int"), str(tmp_path / "o"))
        files.replace_source(spark.createDataFrame([("a", 3)], "source string, n int"), str(tmp_path / "o"))
    assert {(r.source, r.n) for r in files.read_sources(spark, str(tmp_path / "o")).collect()} == {("a", 3), ("b", 2)}


def test_validation(spark):
    rows = spark.createDataFrame([("x", None, "2020-13-01", "2020-01-01"), ("x", "PR", "2021-01-01", "2020-01-01")], "birth_city string, birth_state string, start string, end string")
    got = [r.errors for r in validate.validate(rows, validate.period_place_errors()).collect()]
    assert got == [["birthplace needs a state", "start is an ISO date", "start is not after end"], ["start is not after end"]]


def test_sections(spark):
    pages = spark.createDataFrame([("s", 1, "3 – Title\nbody\n12"), ("s", 2, "body\nmore\n9 – Late"), ("s", 3, "5 – x, p. 3\nbody")], "source string, page int, text string")
    got = {r.page: (r.detected, r.text) for r in sections.running_section(pages, 10).collect()}
    assert got == {1: ("3 – Title", "body\n12"), 2: ("9 – Late", "body\nmore"), 3: (None, "5 – x, p. 3\nbody")}
    index = sections.toc_index(spark.createDataFrame([("s", 1, "1.\n First name......12\n2.\nSecond......30\n")], "source string, page int, text string"), 1, 1)
    assert {(r.number, r.page, r.label) for r in index.collect()} == {(1, 12, "First name"), (2, 30, "Second")}
    body = spark.createDataFrame([("s", 12, "first NAMÉ"), ("s", 31, "other")], "source string, page int, text string")
    assert [(r.number, r.missing) for r in sections.toc_audit(index, body).collect()] == [(2, ["second"])]


def test_search_cell_and_mentions(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "id long, embedding array<double>")
    hits = search.search(v.select(F.col("id").alias("query_id"), "embedding"), v.select(F.col("id").alias("chunk_id"), "embedding"), 1.0 - 1e-12, 1)
    assert {(r.query_id, r.chunk_id) for r in hits.collect()} == {(1, 1), (2, 1), (3, 3)}
    assert {r.query_id for r in search.unanswered(v.select(F.col("id").alias("query_id")), hits).collect()} == {4}


def test_item_records(spark):
    c = spark.createDataFrame([("s", 1, 1, "001) Ana\nfirst\n(07) Other\nlost"), ("s", 2, 2, "002) Rui\nx"), ("s", 3, 3, "more\n001) Ana B\nlast")], "source string, page_first int, ordinal int, text string")
    got = {r.number: (r.name, r.page, r.text) for r in records.numbered_items(c).collect()}
    assert got == {1: ("Ana B", 3, "last"), 2: ("Rui", 2, "x\nmore")}


def test_running_section_goes_through_a_page_once(spark):
    from time import time

    from folium.operators import sections

    body = "\n".join(f"line {i}" for i in range(5000))
    pages = spark.createDataFrame([(1, "7 – Title\n" + body), (2, body + "\n8 - Last"), (3, None), (4, "")], "page long, text string")
    began = time()
    out = {r.page: r for r in sections.running_section(pages, 20).collect()}
    assert time() - began < 20
    assert [out[i].detected for i in (1, 2, 3, 4)] == ["7 – Title", "8 - Last", None, None]
    assert [out[i].text for i in (1, 2, 3, 4)] == [body, body, None, ""]


def test_windows_and_vectors_are_made_in_bounded_batches(spark):
    from folium.operators import mining, search

    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    df = spark.createDataFrame([(1, "The other one"), (2, None), (3, "none")], "doc_id long, text string")
    for make in (lambda: mining.term_windows(df, "the", width=3), lambda: search.embed(df)):
        spark.conf.unset(rows)
        spark.conf.unset(size)
        out = make()
        assert (spark.conf.get(rows), spark.conf.get(size)) == ("2000", str(8 << 20))
        assert out.count() == (2 if "window" in out.columns else 3)
    found = mining.term_windows(df, "the", width=3).orderBy("start").collect()
    assert [(r.start, r.end, r.term, r.window, r["at"]) for r in found] == [(0, 3, "The", "The ot", 0), (5, 8, "the", "e other on"[:9], 3)]
