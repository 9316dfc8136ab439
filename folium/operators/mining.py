"""Mining people and places from chunk text, with evidence and confidence."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from folium.functions.text import CONNECTIVES, MONTHS, fold_text, strip_ws
from folium.sources.shared import bounded_batches, written

WIDTH, REACH, AFTER_COST = 130, 160, 40
#: Confidence, best first.
CONFIDENCE = ("alta", "media", "baixa")

_NAME_WORD = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'’-]+"
_NAMES = re.compile(rf"{_NAME_WORD}(?:\s+(?:(?:{'|'.join(CONNECTIVES)})\s+)?{_NAME_WORD})+")
NAME_STRUCT = ArrayType(StructType([StructField("name", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))
WINDOW_STRUCT = "array<struct<start:int,end:int,term:string,window:string,at:int>>"


def prefilter(chunks: DataFrame, regex: str) -> DataFrame:
    return chunks.where(F.col("text").rlike(f"(?i){regex}"))


def term_windows(chunks: DataFrame, term: str, noise: Sequence[str] = (), width: int = WIDTH) -> DataFrame:
    """One row per occurrence of the term: start, end, term, window, at (the term's place in the window); noisy windows are dropped."""
    found = re.compile(term, re.I)

    @arrow_udf(WINDOW_STRUCT)
    def run(texts: pa.Array) -> pa.Array:
        offsets, start, end, terms, windows = [0], [], [], [], []
        for value in texts:
            text = value.as_py() or ""
            for m in found.finditer(text):
                start.append(m.start())
                end.append(m.end())
                terms.append(m[0])
                windows.append(text[max(0, m.start() - width) : m.end() + width])
            offsets.append(len(start))
        at = [min(width, a) for a in start]
        fields = [pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(terms, pa.string()), pa.array(windows, pa.string()), pa.array(at, pa.int32())]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "end", "term", "window", "at"]))

    bounded_batches(chunks.sparkSession)
    each = prefilter(chunks, term).withColumn("w", F.explode(run("text"))).select(*chunks.columns, "w.*")
    for phrase in noise:
        each = each.where(~F.col("window").rlike(f"(?i){phrase}"))
    return each


@pandas_udf(NAME_STRUCT)
def proper_names(windows: pd.Series) -> pd.Series:
    """Runs of two or more capitalised words, connectives inside, with offsets; all-caps words are no names."""
    return windows.map(lambda t: [{"name": " ".join(m[0].split()), "start": m.start(), "end": m.end()} for m in _NAMES.finditer(t)], na_action="ignore")


def nearest_name(names: Column, start: Column, end: Column, reach: int = REACH) -> Column:
    """The name struct with the least distance; one after the term pays 40, an overlap is 0, ties keep the first, beyond reach none."""

    def cost(n: Column) -> Column:
        return F.when(n["end"] <= start, start - n["end"]).when(n["start"] >= end, n["start"] - end + AFTER_COST).otherwise(F.lit(0))

    ranked = F.array_sort(F.filter(F.transform(names, lambda n: F.struct(cost(n).alias("cost"), n["start"].alias("start"), n["name"].alias("name"))), lambda x: x["cost"] <= reach))
    return F.get(ranked, F.lit(0))["name"]


def plausible_name(name: Column, institutional: Sequence[str]) -> Column:
    """Two words at least, at most half of them institutional (counted, not distinct)."""
    words = F.split(F.lower(name), r"\s+")
    odd = F.size(F.filter(words, lambda w: w.isin(*institutional)))
    return (F.size(words) >= 2) & (odd * 2 <= F.size(words))


def term_in_name(term: Column, name: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(term), r"\s+"), F.split(F.lower(name), r"\s+"))


def confidence(window: Column, explicit: str, person: str) -> Column:
    """On folded text: an explicit term in a person's context, an explicit term, or neither."""
    return F.when(window.rlike(explicit) & window.rlike(person), "alta").when(window.rlike(explicit), "media").otherwise("baixa")


def confidence_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CONFIDENCE)), c)


def mine(chunks: DataFrame, term: str, *, noise: Sequence[str] = (), institutional: Sequence[str] = ("",), explicit: str = ".", person: str = ".") -> DataFrame:
    """(name, excerpt, confidence, seq): candidates of all windows, in the order of the table's columns source and ordinal."""
    w = term_windows(chunks, term, noise)
    named = w.withColumn("name", nearest_name(proper_names("window"), F.col("at"), F.col("at") + F.length("term")))
    kept = named.where(F.col("name").isNotNull() & plausible_name(F.col("name"), institutional) & ~term_in_name(F.col("term"), F.col("name")))
    return kept.select("name", F.col("window").alias("excerpt"), confidence(fold_text("window"), explicit, person).alias("confidence"), F.struct("source", "ordinal", "start").alias("seq"))


def group_candidates(candidates: DataFrame, examples: int | None = None) -> DataFrame:
    """By folded name: the last spelling, distinct excerpts in order, best confidence, their count.

    Excerpts are made distinct before names meet, so a common name is summed map-side.
    """
    c = candidates.withColumn("key", fold_text("name"))
    once = c.groupBy("key", "excerpt").agg(F.max_by("name", "seq").alias("name"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.min(confidence_rank(F.col("confidence"))).alias("rank"))
    per = once.groupBy("key").agg(F.max_by("name", "last").alias("name"), F.array_sort(F.collect_list(F.struct("first", "excerpt"))).alias("e"), F.min("rank").alias("rank"), F.count(F.lit(1)).alias("evidence"))
    excerpts = F.transform("e", lambda x: x["excerpt"])
    return per.select("key", "name", (F.slice(excerpts, 1, examples) if examples else excerpts).alias("excerpts"), F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.col("rank").cast("int")).alias("confidence"), "evidence")


#: Length of the first signatures; texts that may share one and still be compared; longest signature.
GRAM, MOST_AT_GRAM, LONGEST_GRAM = 5, 4096, 640


def _grams(c: str, n: int) -> Column:
    """The different stretches of n characters of a text that has as many."""
    at = F.sequence(F.lit(1), F.length(c) - n + 1)
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(at, lambda i: F.substr(F.col(c), i, F.lit(n)))))


def contained(needles: DataFrame, hays: DataFrame, give: str, *, gram: int = GRAM, most: int = MOST_AT_GRAM) -> DataFrame:
    """(needle) held by some hay, or (hay) that hold some needle, as `give` says; needles(needle) and hays(hay) are distinct and not empty.

    A needle is placed at its rarest stretch of `gram` characters, a hay at all of
    its stretches that a needle is placed at; where they meet the whole texts are
    compared. A needle no longer than a stretch is one, and meets by equality
    alone. Needles whose every stretch stands in more than `most` hays wait for
    stretches of twice the length, so no meeting of unequal texts is larger.
    """
    found = None
    while gram <= LONGEST_GRAM:
        short = needles.where(F.length("needle") <= gram).select("needle", F.length("needle").alias("n"))
        lengths = sorted(r["n"] for r in short.select("n").distinct().collect())  # at most `gram`
        pieces = hays.select("hay", F.explode(F.flatten(F.array_compact(F.array(*(_grams("hay", n) for n in lengths))))).alias("needle")) if lengths else None
        hits = [] if pieces is None else [short.join(pieces.select("needle").distinct(), "needle", "left_semi").select("needle") if give == "needle" else pieces.join(short.select("needle"), "needle", "left_semi").select("hay")]
        long = needles.where(F.length("needle") > gram)
        placed = hays.select("hay", F.explode(_grams("hay", gram)).alias("g"))
        asked = long.select("needle", F.explode(_grams("needle", gram)).alias("g"))
        often = placed.join(asked.select("g").distinct(), "g", "left_semi").groupBy("g").agg(F.count(F.lit(1)).alias("at"))
        # a stretch that no hay has rules its needle out: all others are met
        rarest = asked.join(often, "g", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("at", F.lit(0)).alias("at"), "g")).alias("r"))
        rarest = written(rarest.where("r.at > 0").select("needle", "r.at", "r.g"), "names-rarest")
        met = placed.join(rarest.where(F.col("at") <= most).select("needle", "g"), "g").where(F.contains("hay", "needle"))
        for hit in (*hits, met.select(give)):
            found = hit if found is None else found.unionByName(hit)
        needles = rarest.where(F.col("at") > most).select("needle")
        if needles.isEmpty():
            break
        gram *= 2
    return found.distinct()


def known_entities(candidates: DataFrame, profiles: DataFrame) -> DataFrame:
    """candidates(key, ..) with `known`: one folded name holds the other, be it inside a word. Empty names are known to nothing."""
    keys = written(candidates.select("key").where("key <> ''").distinct(), "names-keys")
    p = written(profiles.select(fold_text("name").alias("p")).where("p <> ''").distinct(), "names-known")
    within = contained(keys.toDF("needle"), p.toDF("hay"), "needle").toDF("key")
    around = contained(p.toDF("needle"), keys.toDF("hay"), "hay").toDF("key")
    hit = within.unionByName(around).distinct().withColumn("known", F.lit(True))
    return candidates.join(hit, "key", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def candidate_summary(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("confidence").agg(F.count_if("known").alias("known"), F.count_if(~F.col("known")).alias("new"))


_BIRTH = re.compile(r"Data e local de nascimento:\s*([\d/.-]+)\s*,\s*([^\n(]+?)\s*\(([A-Z]{2})\)")


def birth_headers(pages: DataFrame, back: int = 5, reach: int = 300, excerpt: tuple[int, int] = (150, 100)) -> DataFrame:
    """(source, page, name, city, state, date, excerpt, confidence) of birth lines; the name is the last plausible one on a line above."""

    @pandas_udf("array<struct<name:string,city:string,state:string,date:string,excerpt:string>>")
    def run(texts: pd.Series) -> pd.Series:
        def of(text: str) -> list[dict]:
            rows = []
            for m in _BIRTH.finditer(text):
                above = text[max(0, m.start() - reach) : m.start()].split("\n")[-back - 1 :]
                names = [n for line in reversed(above) if len(line.strip()) > 4 and ":" not in line for n in [_NAMES.findall(line.title() if line.isupper() else line)] if n]
                rows.append({"name": names[0][-1] if names else None, "city": m[2], "state": m[3], "date": m[1], "excerpt": text[max(0, m.start() - excerpt[0]) : m.end() + excerpt[1]]})
            return [r for r in rows if r["name"]]

        return texts.map(of, na_action="ignore")

    each = pages.where(F.col("text").contains("Data e local de nascimento")).withColumn("x", F.explode(run("text")))
    return each.select("source", "page", "x.*", F.lit("alta").alias("confidence"))


#: Phrases before a birthplace; those of the first group make a find certain enough for "media".
BORN_IN = (r"nascid[oa]\s+em", r"natural\s+de")
FROM_PLACE = (r"nasceu\s+em", r"natural\s+d[ao](?:\s+cidade\s+de)?", r"originári[oa]\s+de", r"oriund[oa]\s+de", r"nativ[oa]\s+de", r"procedência\s*:?")
#: Fixed value: the label of a page with a birth line.
BIRTH_LABEL = "Data e local de nascimento"


def birth_narrative(pages: DataFrame, state_name: str, other_states: Sequence[str], reach: int = REACH, before: int = 150, state_code: str | None = None) -> DataFrame:
    """(source, page, name, city, excerpt, confidence) of `nascido em X, state`: alta on pages with a birth label, media and baixa by the phrase.

    The state is its name, its code in brackets, or either after "do" or "do
    Estado do". A find is dropped where another state (name or code) is named as a
    birthplace shortly before it, not where one is merely mentioned. Phrases are
    cut off the end of a name.
    """
    state = "|".join([rf"(?:do\s+)?(?:estado\s+d[aeo]\s+)?{re.escape(state_name)}", *([rf"\({re.escape(state_code)}\)"] if state_code else [])])
    found = re.compile(rf"({'|'.join((*BORN_IN, *FROM_PLACE))})\s*([A-Za-zÀ-ÿ\s'-]+?)\s*[,(-]?\s*(?:{state})(?!\w)", re.I)
    certain = re.compile("|".join(BORN_IN), re.I)
    other = re.compile(rf"nascid[oa]\s+(?:no|na|em|à)\s+(?:{'|'.join(map(re.escape, other_states))})(?!\w)", re.I) if other_states else re.compile(r"\Z\A")

    @pandas_udf("array<struct<city:string,window:string,start:int,end:int,certain:boolean>>")
    def run(texts: pd.Series) -> pd.Series:
        def of(text: str) -> list[dict]:
            span = reach + 80
            return [
                {"city": " ".join(m[2].split()), "window": text[max(0, m.start() - span) : m.end() + span], "start": min(span, m.start()), "end": min(span, m.start()) + m.end() - m.start(), "certain": bool(certain.match(m[1]))}
                for m in found.finditer(text)
                if not other.search(text[max(0, m.start() - before) : m.start()])
            ]

        return texts.map(of, na_action="ignore")

    states = "|".join(re.escape(x) for x in (state_name, state_code) if x)
    each = pages.where(F.col("text").rlike(f"(?iu){states}")).withColumn("labelled", F.col("text").contains(BIRTH_LABEL)).withColumn("x", F.explode(run("text"))).select("source", "page", "labelled", "x.*")
    near = nearest_name(proper_names("window"), F.col("start"), F.col("end"), reach)
    name = strip_ws(F.regexp_replace(near, r"(?iu)\s*(?:natural\s+d[aeo]|nascid[oa]\s+em).*", ""))
    sure = F.when(F.col("labelled"), "alta").when(F.col("certain"), "media").otherwise("baixa")
    return each.select("source", "page", name.alias("name"), "city", F.col("window").alias("excerpt"), sure.alias("confidence")).where("name <> ''")


def birth_date(text: Column, position: Column, latest: int = 1980) -> Column:
    """dd/mm/yyyy of the first date up to the latest year that follows a birth phrase between 200 characters before the position and 500 after.

    Months are numbers, words or their first three letters.
    """
    near = F.substring(text, F.greatest(position - 199, F.lit(1)), F.lit(700))
    months = "|".join((*MONTHS, *(m[:3] for m in MONTHS)))
    joint = r"\s*(?:de|[/.])\s*"
    dated = rf"(?iu)(?:nascid[oa]\s+em|nasceu\s+em|nascimento\s*:?)\s*(\d{{1,2}})º?{joint}({months}|\d{{1,2}}){joint}(\d{{4}})"
    short = F.array(*(F.lit(m[:3]) for m in MONTHS))

    def date(phrase: Column) -> Column:
        day, month, year = (F.regexp_extract(phrase, dated, i) for i in (1, 2, 3))
        number = F.when(month.rlike(r"^\d"), month).otherwise(F.array_position(short, F.lower(F.substring(month, 1, 3))).cast("string"))
        return F.when(year.cast("int") <= latest, F.concat_ws("/", F.lpad(day, 2, "0"), F.lpad(number, 2, "0"), year))

    dates = F.transform(F.regexp_extract_all(near, F.lit(dated), F.lit(0)), date)
    return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))


def dedup_best(candidates: DataFrame) -> DataFrame:
    """One per folded name and city: the best confidence, then the first seen. candidates: (name, city, confidence, seq)."""
    w = Window.partitionBy(fold_text("name"), fold_text("city")).orderBy(confidence_rank(F.col("confidence")), "seq")
    return candidates.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def in_gazetteer(candidates: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """candidates with `in_gazetteer`: the folded city stands in gazetteer(name, state) under the candidate's state."""
    g = gazetteer.select(fold_text("name").alias("g_city"), F.col("state").alias("g_state")).distinct().withColumn("in_gazetteer", F.lit(True))
    keyed = candidates.withColumn("g_city", fold_text("city")).withColumn("g_state", F.col("state"))
    return keyed.join(g, ["g_city", "g_state"], "left").withColumn("in_gazetteer", F.coalesce("in_gazetteer", F.lit(False))).drop("g_city", "g_state")


def rank_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy(confidence_rank(F.col("confidence")), F.desc("in_gazetteer"), fold_text("name"))


def review_queue(candidates: DataFrame) -> DataFrame:
    return candidates.where(~F.col("in_gazetteer") | (F.col("confidence") != "alta"))


#: Names of one automaton, searched for in one pass over the texts.
NAMES_AT_ONCE = 50_000


def _holding(chunks: DataFrame, needles: DataFrame, at_once: int) -> DataFrame:
    """chunks(title, ordinal, excerpt, low) once for each of needles(needle) that low holds: (title, ordinal, excerpt, needle).

    Needles are cut into shards of about `at_once`; a shard is broadcast as one row,
    which each task finds at its first text and builds its automaton from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None
        for batch in batches:
            if automaton is None and batch.num_rows:
                automaton = ahocorasick.Automaton()
                for n in batch.column("shard")[0].as_py():
                    automaton.add_word(n, n)
                automaton.make_automaton()
            full = automaton is not None and len(automaton) > 0
            found = [sorted({n for _, n in automaton.iter(low)}) if low and full else [] for low in batch.column("low").to_pylist()]
            rows = pa.array([i for i, names in enumerate(found) for _ in names], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("title", "ordinal", "excerpt")), pa.array([n for names in found for n in names], pa.string())], ["title", "ordinal", "excerpt", "needle"])

    shards = max(1, -(-needles.count() // at_once))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    texts = chunks.select("title", "ordinal", "excerpt", "low", first.alias("first"))
    schema = StructType([*texts.schema.fields[:3], StructField("needle", StringType())])
    out = None
    for shard in range(shards):
        own = needles.where(F.pmod(F.xxhash64("needle"), F.lit(shards)) == shard).agg(F.collect_set("needle").alias("shard"))
        given = texts.crossJoin(F.broadcast(own)).select("title", "ordinal", "excerpt", "low", F.when(F.col("first"), F.col("shard")).alias("shard"))
        found = given.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def mentions(shortlist: DataFrame, chunks: DataFrame, at_once: int = NAMES_AT_ONCE) -> DataFrame:
    """(name, title, ordinal, excerpt, by_tail): chunks that hold each name, case aside; names without any are tried by their last two words.

    Names stay in tables: a pass over the texts for each `at_once` of them, and one
    for each `at_once` tails of names that weren't met. Empty names are left out.
    """
    low = chunks.select("title", "ordinal", F.col("text").alias("excerpt"), F.lower("text").alias("low"))
    names = written(shortlist.select("name", F.lower("name").alias("needle")).where("name <> ''").distinct(), "mentions-names")
    full = written(_holding(low, names.select("needle").distinct(), at_once), "mentions-full")
    words = F.split("needle", " ")
    tails = names.join(full.select("needle").distinct(), "needle", "left_anti").select("name", F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2)), " ").alias("needle"))
    tails = written(tails.where("needle <> ''"), "mentions-tails")
    by_tail = _holding(low, tails.select("needle").distinct(), at_once)
    told = lambda found, asked, tail: found.join(asked, "needle").select("name", "title", "ordinal", "excerpt", F.lit(tail).alias("by_tail"))
    return told(full, names, False).unionByName(told(by_tail, tails, True))
