"""Operators without SQL against plain versions, on random texts."""

import random
import re
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from folium.functions import text as t
from folium.operators import chunks, mining, sections
from folium.sources import files


def rng_lines(rng, kinds, n):
    return "\n".join(rng.choice(kinds) for _ in range(rng.randrange(n)))


def column(spark, texts, make):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {r.i: r.x for r in df.select("i", make(F.col("text")).alias("x")).collect()}


def collapse(text):
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def test_merge_broken_heading(spark):
    rng = random.Random(1)
    kinds = ["JOÃO DA", "A. B'C-D", "SILVA (1940-1970)", "Rui (1950", "a text line", "", "CAUSA DA MORTE", "x", "É"]
    texts = [rng_lines(rng, kinds, 12) for _ in range(300)]

    def plain(text):
        out, held = [], None
        for line in text.split("\n"):
            heads = re.search(r"\(\d{4}", line)
            if not heads and regex.match(r"^\p{Lu}[\p{Lu} '.-]+$", line) and line != "CAUSA DA MORTE":
                if held is not None:
                    out.append(held)
                held = line
                continue
            if heads:
                line = f"\n{held + ' ' if held is not None else ''}{line}\n"
            elif held is not None:
                out.append(held)
            held = None
            out.append(line)
        return collapse("\n".join([*out, *([held] if held is not None else [])]))

    assert column(spark, texts, lambda c: t.merge_broken_heading(c, r"\(\d{4}", ["CAUSA DA MORTE"])) == {i: plain(x) for i, x in enumerate(texts)}


def test_join_wrapped_lines(spark):
    rng = random.Random(2)
    texts = [rng_lines(rng, ["  one two", "ends.", "ends:  ", "", " \t", "why?", "go on,"], 10) for _ in range(200)]

    def plain(text):
        lines, out = [x.strip() for x in text.split("\n")], ""
        for i, line in enumerate(lines):
            out += line
            if i + 1 < len(lines):
                out += " " if out and out[-1] not in ".!?:\n" and lines[i + 1] != "" and line else "\n"
        return out

    def by_characters(text):
        s = "\n".join(x.strip() for x in text.split("\n"))
        return "".join(" " if c == "\n" and not (i and s[i - 1] in ".!?:\n") and not s[i + 1 : i + 2] == "\n" else c for i, c in enumerate(s))

    assert column(spark, texts, t.join_wrapped_lines) == {i: by_characters(x) for i, x in enumerate(texts)}
    inner = [x for x in texts if not x.startswith("\n") and not x.endswith("\n") and x.strip() == x]
    assert column(spark, inner, t.join_wrapped_lines) == {i: plain(x) for i, x in enumerate(inner)}


def test_chapter_opening(spark):
    rng = random.Random(3)
    texts = [rng.choice(["", " ", "x"]) + rng.choice(["3", "12 ", "IV"]) + "\n" + rng.choice(["Capítulo", " CAPÍTULO ", "Parte"]) + "\n" + rng_lines(rng, ["The", "title of", "it", "", " "], 9) for _ in range(300)]

    def plain(text):
        rows = text.lstrip().split("\n")
        if not (rows[0].strip().isdigit() and len(rows) > 2 and rows[1].strip().lower() == "capítulo"):
            return None
        rest = "\n".join(rows[2:]).lstrip().split("\n")
        title = []
        for line in rest:
            if line.strip() == "" or len(title) == 4:
                break
            title.append(line)
        return f"{rows[0].strip()} – {' '.join(title).strip()}"

    said = {i: plain(x) for i, x in enumerate(texts)}
    found = column(spark, texts, lambda c: t.chapter_opening(c, "capítulo"))
    assert found == said and sum(x is not None for x in said.values()) > 30


def test_running_section(spark):
    rng = random.Random(4)
    kinds = ["3 – One", "7-Two", "9 - Late", "99 – Far", "2 – see p. 4", "body text", "12", "", "  5 – Padded "]
    texts = [rng_lines(rng, kinds, 7) for _ in range(300)] + ["3\nCapítulo\nTitle\n\n4 – Not this", None]

    def plain(text):
        text = text or ""
        opening = re.match(r"\s*(\d+)\s*\n\s*capítulo\s*\n\s*(.*)", text, re.I | re.S)
        content = [x.strip() for x in text.split("\n") if x.strip() and not re.fullmatch(r"\d+", x.strip())]
        fits = lambda x: (m := re.match(r"(\d{1,3})\s*[–-]\s+\S", x)) and int(m[1]) <= 20 and not re.search(r"\b(?:p\.|pp\.|v\.|ed\.|cit\.|ibid)", x, re.I)
        line = next((x for x in (content[:1] + content[-1:]) if fits(x)), None)
        if opening:
            return f"{opening[1]} – {opening[2].split(chr(10))[0]}", text
        return line, "\n".join(x for x in text.split("\n") if x.strip() != line) if line else text

    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(texts)], "source string, page int, text string")
    found = {r.page: (r.detected, r.text or "") for r in sections.running_section(df, 20).collect()}
    assert found == {i: plain(x) for i, x in enumerate(texts)}


@pytest.mark.parametrize("rows", [1 << 20, 10])
def test_section_per_paragraph(spark, monkeypatch, rows):
    monkeypatch.setattr("folium.operators.sections.scan", lambda *a, f=sections.scan, **k: f(*a, **k, key_rows=rows, block_rows=rows))
    rng = random.Random(5)
    paras = [(rng.choice("ab"), p, n, rng.choice(["OPEN", "CLOSE", "Maria\nborn", "text", "Ana Lia\nx", "more"])) for p in range(40) for n in range(3)]
    said, state = [], {}
    for source, page, n, text in sorted(paras):
        gate, section = state.get(source, (False, None))
        gate = True if text == "OPEN" else False if text == "CLOSE" else gate
        if gate and text[:3] in ("Mar", "Ana"):
            section = text.split("\n")[0]
        state[source] = (gate, section)
        said.append((source, page, n, section if gate else None))
    df = spark.createDataFrame(paras, "source string, page int, para_no int, text string").repartition(4)
    out = sections.section_per_paragraph(df, "^OPEN", "^CLOSE", F.col("text").rlike("^(Maria|Ana)"))
    assert sorted((r.source, r.page, r.para_no, r.section) for r in out.collect()) == sorted(said)


def count(text):
    return len(regex.findall(r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\t-\r ]", text))


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta.", "gamma,", "delta!", "line\nbreak", "épsilon"]) for _ in range(n))


def test_split_oversized(spark):
    rng = random.Random(6)
    units = [("s", i, 0, prose(rng, rng.choice([1, 5, 30, 80]))) for i in range(60)]
    said = []
    for s, page, para, text in units:
        split = count(text) > 20
        for a, sentence in enumerate(re.split(r"(?<=[.!?])\s+", text) if split else [text]):
            for b, line in enumerate(sentence.split("\n") if split and count(sentence) > 8 else [sentence]):
                if line.strip():
                    said.append((s, page, para, split, a, b, line.strip(), count(line.strip())))
    df = spark.createDataFrame(units, "source string, page int, para_no int, text string")
    out = chunks.split_oversized(df, 20, 10).select("source", "page", "para_no", "split", "sentence", "line", "text", "tokens")
    assert sorted(map(tuple, out.collect())) == sorted(said)


def test_split_overlong(spark):
    rng = random.Random(7)
    texts = [prose(rng, rng.choice([1, 10, 60])) for _ in range(60)] + ["word " * 50, "x" * 90, None, ""]

    def halves(text):
        words = text.split()
        return [text] if len(words) < 2 or count(text) <= 10 else halves(" ".join(words[: len(words) // 2])) + halves(" ".join(words[len(words) // 2 :]))

    def plain(text):
        if count(text) <= 10:
            return [text]
        pieces = [h for s in re.split(r"(?<=[.!?])\s+", text) for c in (re.split(r"(?<=,)\s+", s) if count(s) > 10 else [s]) for h in halves(c)]
        out = pieces[:1]
        for p in pieces[1:]:
            if count(f"{out[-1]} {p}") <= 10:
                out[-1] += f" {p}"
            else:
                out.append(p)
        return out

    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(texts)], "i int, text string, tokens int")
    found = sorted((r.i, r.part, r.text, r.tokens) for r in chunks.split_overlong(df, 12).collect())
    assert found == [(i, n, p, count(p)) for i, x in enumerate(texts) if x is not None for n, p in enumerate(plain(x))]
    assert all(n <= 10 for *_, n in found)


def test_nearest_name_and_groups(spark):
    rng = random.Random(8)
    parts = ["Ana de Sá", "ana  de SÁ".title(), "Rui Lo", "the token", "token", "of", "Universidade Federal", "x" * 60, "Lia e Zé", "fim."]
    docs = [("ab"[i % 2], i, " ".join(rng.choices(parts, k=12))) for i in range(60)] + [("a", 99, None)]
    name = re.compile(r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'’-]+(?:\s+(?:(?:de|da|do|das|dos|e)\s+)?[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'’-]+)+")
    fold = lambda x: " ".join("".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower().split())
    mined = []
    for source, ordinal, text in docs:
        for m in re.finditer("token", text or ""):
            lo = max(0, m.start() - 130)
            window, at = text[lo : m.end() + 130], m.start() - lo
            best = None
            for n in name.finditer(window):
                cost = at - n.end() if n.end() <= at else n.start() - at - 5 + 40 if n.start() >= at + 5 else 0
                if cost <= 160 and (best is None or cost < best[0]):
                    best = (cost, " ".join(n[0].split()))
            if best and sum(w in ("universidade", "federal") for w in best[1].lower().split()) * 2 <= len(best[1].split()):
                sure = "alta" if "the" in fold(window).split() else "media"
                mined.append((best[1], window, sure, (source, ordinal, m.start())))
    df = spark.createDataFrame(docs, "source string, ordinal int, text string")
    out = mining.mine(df, "token", institutional=["universidade", "federal"], explicit="token", person=r"\bthe\b")
    assert sorted((r.name, r.excerpt, r.confidence, tuple(r.seq)) for r in out.collect()) == sorted(mined)
    groups = {}
    for who, excerpt, sure, seq in sorted(mined, key=lambda r: r[3]):
        g = groups.setdefault(fold(who), {"name": who, "excerpts": [], "sure": sure})
        g["name"] = who
        g["sure"] = min(g["sure"], sure, key=mining.CONFIDENCE.index)
        if excerpt not in g["excerpts"]:
            g["excerpts"].append(excerpt)
    got = {r.key: (r.name, r.excerpts, r.confidence, r.evidence) for r in mining.group_candidates(out).collect()}
    assert got == {k: (g["name"], g["excerpts"], g["sure"], len(g["excerpts"])) for k, g in groups.items()}


def test_birth_headers(spark):
    rng = random.Random(9)
    above = ["Maria de Souza", "JOÃO DA SILVA", "Filiação: Ana e Rui", "", "abc", "x" * 290, "profissional liberal"]
    pages = [("s", i, rng_lines(rng, above, 8) + "\nData e local de nascimento: " + rng.choice(["1/2/1950, Curitiba (PR)", "3-4-60 , Foz do Iguaçu (PR)", "s.d., x (PR)"]) + "\nfim") for i in range(200)]
    name = re.compile(r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'’-]+(?:\s+(?:(?:de|da|do|das|dos|e)\s+)?[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'’-]+)+")
    said = set()
    for s, page, text in pages:
        m = re.search(r"Data e local de nascimento:\s*([\d/.-]+)\s*,\s*([^\n(]+?)\s*\(([A-Z]{2})\)", text)
        if m:
            for line in reversed(text[max(0, m.start() - 300) : m.start()].split("\n")[-6:]):
                names = [] if len(line.strip()) <= 4 or ":" in line else name.findall(line.title() if line.isupper() else line)
                if names:
                    said.add((s, page, names[-1], m[2], m[3], m[1], text[max(0, m.start() - 150) : m.end() + 100], "alta"))
                    break
    df = spark.createDataFrame(pages, "source string, page int, text string")
    assert {tuple(r) for r in mining.birth_headers(df).select("source", "page", "name", "city", "state", "date", "excerpt", "confidence").collect()} == said and len(said) > 40


def test_written_dossier_reads_as_sections(spark, tmp_path):
    rows = [("b", "t2", 2, "x"), ("a", "t1", 9, "y\nz"), ("a", "t0", 11, "w"), ("a", "t1", 3, "v"), ("b", "t2", 1, None)]
    df = spark.createDataFrame(rows, "name string, title string, ordinal int, excerpt string").repartition(3)
    files.write_dossier(df, str(tmp_path / "d"))
    written = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "d").glob("part-*")))
    sections_ = [r.section for r in files.dossier(df.where("excerpt is not null")).orderBy("name").collect()]
    assert written == "\n".join(sections_) + "\n"


def test_rank_candidates_in_order(spark):
    rng = random.Random(10)
    rows = [(i, rng.choice(["Zé", "ana", "Ánia", "Bo"]) + str(i % 7), rng.choice(mining.CONFIDENCE), rng.random() < 0.5) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, name string, confidence string, in_gazetteer boolean").repartition(5)
    fold = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower()
    key = lambda r: (mining.CONFIDENCE.index(r[2]), not r[3], fold(r[1]))
    assert [key(tuple(r)) for r in mining.rank_candidates(df).collect()] == sorted(map(key, rows))
