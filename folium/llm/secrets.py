"""Secret scans in DataFrame functions alone: base patterns and a randomness test battery.

Texts are read once. Positions come from the lengths of what lies between the
matches, summed by a window per text. Long tokens are then tested. An encoding is
inferred from the characters used, and two hypotheses are put to each token:

* "random in that encoding": chi-squared uniformity over its alphabet, a runs test
  and lag-1 serial correlation, combined by Simes;
* "ordinary words": neighbours seldom change between lower case, upper case, digits
  and signs, and letters are as frequent as in European languages. The inverse of
  the likelihood ratio of a random string to that bounds the p-value (Markov).

Benjamini-Hochberg controls both over all tokens of the corpus, in bands of
length, from histograms of bounded size. A token counts as a secret if the first
hypothesis stands and the second is rejected. Strings of digits alone are never
found: ordinary long numbers are as uniform as random ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.llm.common import materialize

#: The patterns, in the order in which kinds are listed. Letters of keywords count in either case.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A token keeps to the signs of one encoding and has = at its end alone: key=value is two tokens.
TOKEN = r"[A-Za-z0-9+/]{20,}={0,2}|[A-Za-z0-9_-]{20,}={0,2}"
KINDS = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("random", TOKEN))
LEAST_VALUE = 6
#: False-discovery rate of both tests, change rate of ordinary words, starts of the length bands.
FDR, WORD_CHANGES, BANDS = 0.01, 0.08, (20, 32, 64, 128)
#: Letters a to z in a thousand of European languages, about; rare ones of one language are rounded up.
LETTERS = (77, 15, 28, 42, 130, 17, 20, 40, 70, 6, 13, 42, 27, 72, 66, 24, 5, 66, 68, 74, 38, 13, 15, 5, 12, 8)
#: Encodings by what they are made of, narrowest first, in the order of their alphabets.
ENCODINGS = (
    ("0123456789", r"^[0-9]+$"),
    ("0123456789abcdef", r"^[0-9a-f]+$"),
    ("0123456789ABCDEF", r"^[0-9A-F]+$"),
    ("abcdefghijklmnopqrstuvwxyz", r"^[a-z]+$"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"^[A-Z]+$"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^[A-Z2-7]+=*$"),
    ("abcdefghijklmnopqrstuvwxyz0123456789", r"^[a-z0-9]+$"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", r"^[A-Z0-9]+$"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", r"^[A-Za-z]+$"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", r"^[A-Za-z0-9]+$"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"^[A-Za-z0-9+/]+=*$"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", r"^[A-Za-z0-9_-]+=*$"),
)
_BIN, _BINS = 0.1, 3000
_CLASSES = (
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-=",
    "a" * 26 + "A" * 26 + "0" * 10 + "-" * 5,
)


def _holds(text: Column) -> Column:
    """Whether any kind of match occurs."""
    found = F.lit(False)
    for _, pattern in KINDS:
        found = found | text.rlike(pattern)
    return found


def _marked(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows with matches, under a key `uid`, with g0, f0, ..: per kind the lengths of the gaps before each match and the matches."""
    text = F.col(text_col).cast("string")
    columns = [F.monotonically_increasing_id().alias("uid"), F.struct(*docs.columns).alias("row"), text.alias("text")]
    for i, (_, pattern) in enumerate(KINDS):
        columns += [F.transform(F.split(text, pattern, -1), F.length).alias(f"g{i}"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias(f"f{i}")]
    return materialize(docs.where(_holds(text)).select(*columns), "secret-matches")


def _spans(marked: DataFrame) -> DataFrame:
    """(uid, kind, value, start, end) of every match; end exclusive, in code points."""
    kinds = F.array(*(F.struct(F.lit(i).alias("kind"), F.col(f"g{i}").alias("gaps"), F.col(f"f{i}").alias("found")) for i in range(len(KINDS))))
    each = marked.select("uid", F.explode(F.filter(kinds, lambda k: F.size(k["found"]) > 0)).alias("k"))
    pairs = F.arrays_zip(F.slice("k.gaps", F.lit(1), F.size("k.found")).alias("gap"), F.col("k.found").alias("value"))
    each = each.select("uid", F.col("k.kind").alias("kind"), F.posexplode(pairs).alias("pos", "x")).select("uid", "kind", "pos", F.col("x.gap").alias("gap"), F.col("x.value").alias("value"))
    so_far = Window.partitionBy("uid", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(so_far)
    return each.withColumn("end", end).withColumn("start", F.col("end") - F.length("value")).select("uid", "kind", "value", "start", "end")


def _two_sided(z: Column) -> Column:
    """2(1 - Phi(|z|)) by the logistic form of the normal distribution."""
    a = F.least(F.abs(z), F.lit(20.0))
    return F.lit(2.0) / (F.lit(1.0) + F.exp(1.5976 * a + 0.07056 * a * a * a))


def _change_rate(alphabet: str) -> float:
    """How often neighbours of a random string are of different classes of characters."""
    classes = Counter(alphabet.translate(str.maketrans(*_CLASSES)))
    return min(max(1 - sum((n / len(alphabet)) ** 2 for n in classes.values()), 1e-9), 1 - 1e-9)


def _cuts(tested: DataFrame, bin_col: str, cut: str) -> DataFrame:
    """(band, cut): Benjamini-Hochberg's least bin that is rejected, bins being -log10 p by their lower edges; a band without one has no row."""
    bins = tested.groupBy("band", bin_col).agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("band").orderBy(F.desc(bin_col)).rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.withColumn("above", F.sum("n").over(down)).withColumn("all", F.sum("n").over(Window.partitionBy("band")))
    passed = F.pow(F.lit(10.0), -F.col(bin_col) * _BIN) * F.col("all") <= FDR * F.col("above")
    return ranked.where(passed).groupBy("band").agg(F.min(bin_col).alias(cut))


def battery(tokens: DataFrame) -> DataFrame:
    """tokens(value) with p_random (small: not random) and strength (-log10 of the chance as ordinary words).

    Steps stand in columns of their own, so that each is computed once a token.
    """
    total = lambda array: F.aggregate(array, F.lit(0.0), lambda a, x: a + x)
    tail = lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))
    front = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    split = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    alphabet = F.coalesce(*(F.when(F.col("value").rlike(p), F.lit(a)) for a, p in ENCODINGS))
    t = tokens.withColumns({"core": F.regexp_replace("value", "=+$", ""), "alphabet": alphabet})
    of_alphabet = lambda f: F.coalesce(*(F.when(F.col("alphabet") == a, F.lit(float(f(a)))) for a, _ in ENCODINGS))
    rarity = F.array(*(F.lit(math.log(sum(LETTERS) / x)) for x in LETTERS))
    t = t.withColumns({"k": F.length("alphabet").cast("double"), "n": F.greatest(F.length("core"), F.lit(2)).cast("double"), "chars": split(F.col("core")), "classes": split(F.translate("core", *_CLASSES))})
    core, k, n = F.col("core"), F.col("k"), F.col("n")
    t = t.withColumns({
        "counts": F.transform(F.array_distinct("chars"), lambda c: (F.length(core) - F.length(F.replace(core, c, F.lit("")))).cast("double")),
        "codes": F.transform("chars", lambda c: F.position(c, F.col("alphabet")).cast("double") - 1),
        "letters": split(F.regexp_replace(F.lower("core"), "[^a-z]", "")),
        "rate": of_alphabet(_change_rate),
        "n_letters": of_alphabet(lambda a: len(set(re.sub("[^a-z]", "", a.lower()))) or 1),
        "changes": total(F.zip_with(front(F.col("classes")), tail(F.col("classes")), lambda a, b: F.when(a != b, 1.0).otherwise(0.0))),
    })
    t = t.withColumns({"chi": k / n * total(F.transform("counts", lambda c: c * c)) - n, "mean": total(F.col("codes")) / n, "high": F.transform("codes", lambda c: F.when(c * 2 >= k, 1.0).otherwise(0.0))})
    t = t.withColumns({"off": F.transform("codes", lambda c: c - F.col("mean")), "n1": total(F.col("high")), "runs": 1 + total(F.zip_with(front(F.col("high")), tail(F.col("high")), lambda a, b: F.abs(a - b)))})
    df, n1 = k - 1, F.col("n1")
    power = total(F.transform("off", lambda x: x * x))
    serial = total(F.zip_with(front(F.col("off")), tail(F.col("off")), lambda a, b: a * b)) / F.greatest(power, F.lit(1e-9))
    mu = 2 * n1 * (n - n1) / n + 1
    t = t.withColumns({
        "z_chi": (F.pow(F.greatest(F.col("chi"), F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)),
        "z_runs": (F.col("runs") - mu) / F.sqrt(F.greatest((mu - 1) * (mu - 2) / (n - 1), F.lit(1e-9))),
        "z_serial": serial * F.sqrt(n),
    })
    upper = _two_sided(F.col("z_chi")) / 2
    t = t.withColumn("ps", F.array_sort(F.array(F.when(F.col("z_chi") > 0, upper).otherwise(1 - upper), _two_sided(F.col("z_runs")), _two_sided(F.col("z_serial")))))
    ps = F.col("ps")
    p_random = F.least(ps[0] * 3, ps[1] * 1.5, ps[2])
    # ln of the likelihood ratio, averaged over the encodings of which the token's is one
    rate, changes = F.col("rate"), F.col("changes")
    by_changes = changes * F.log(rate / WORD_CHANGES) + (n - 1 - changes) * F.log((1 - rate) / (1 - WORD_CHANGES))
    by_letters = total(F.transform("letters", lambda c: F.element_at(rarity, F.ascii(c) - 96) - F.log("n_letters")))
    strength = F.greatest((by_changes + by_letters - math.log(len(ENCODINGS))) / math.log(10), F.lit(0.0))
    return t.select(*tokens.columns, p_random.alias("p_random"), strength.alias("strength"))


def _random(tokens: DataFrame) -> DataFrame:
    """The tokens that are kept as random strings: (uid, kind, value, start, end)."""
    band = sum((F.when(F.length("value") >= b, 1).otherwise(0) for b in BANDS), F.lit(0))
    # equal tokens are tested once, dealt out by value
    dealt = tokens.select("value").distinct().repartition(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    binned = lambda x: F.least(F.floor(x / _BIN), F.lit(_BINS)).cast("int")
    scored = battery(dealt).withColumns({"band": band, "word_bin": binned(F.col("strength")), "random_bin": binned(-F.log10(F.greatest(F.col("p_random"), F.lit(1e-300))))})
    scored = scored.withColumn("random_bin", F.greatest("random_bin", F.lit(0)))
    tested = materialize(tokens.join(scored.select("value", "band", "word_bin", "random_bin"), "value"), "secret-tokens")
    cuts = _cuts(tested, "word_bin", "word_cut").join(_cuts(tested, "random_bin", "random_cut"), "band", "left")
    stands = F.col("random_cut").isNull() | (F.col("random_bin") < F.col("random_cut"))
    kept = tested.join(F.broadcast(cuts), "band").where(stands & (F.col("word_bin") >= F.col("word_cut")))
    return kept.select("uid", "kind", "value", "start", "end")


def _found(marked: DataFrame) -> DataFrame:
    """(uid, kind, value, start, end): base spans that hold and the tokens kept as random."""
    spans = materialize(_spans(marked), "secret-spans")
    base = spans.where("kind < 3").where((F.col("kind") > 0) | (F.length(F.regexp_extract("value", ASSIGN, 2)) >= LEAST_VALUE))
    return base.unionByName(_random(spans.where("kind = 3")))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random): one row per row of docs.

    Spans are kind:start:end in code points, end exclusive, by start, then kind as
    listed (assign, access, hex, random). Null texts are empty; texts without finds
    have zeros, the checksum of the empty string and no spans. Rows of equal or
    null doc_id keep their own finds.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = _marked(docs, "text")
    names = F.element_at(F.array(*(F.lit(n) for n, _ in KINDS)), F.col("kind") + 1)
    label = F.concat_ws(":", names, "start", "end").alias("label")
    gathered = _found(marked).groupBy("uid").agg(
        *(F.count_if(F.col("kind") == i).alias(f"n_{n}") for i, (n, _) in enumerate(KINDS)),
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", label))).alias("all"),
    )
    joined = lambda array: F.concat_ws(",", F.transform(array, lambda x: x["label"]))
    per = gathered.withColumns({"spans": joined(F.col("all")), "base": joined(F.filter("all", lambda x: x["kind"] < 3))}).drop("all")
    clean = docs.where(~F.coalesce(_holds(F.col("text")), F.lit(False))).select(F.lit(None).cast("long").alias("uid"), "doc_id")
    hit = marked.select("uid", "row.doc_id").join(per, "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = clean.unionByName(hit, allowMissingColumns=True)
    return out.select("doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(empty("base"), 256).alias("base_sha256"), empty("spans").alias("spans"), zero("n_random"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every found span, overlapping ones as one, replaced by the mark; other columns and rows stay, null texts stay null."""
    marked = _marked(docs, text_col)
    spans = _found(marked).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    text = F.col("text")
    cut = lambda a, b: F.substr(text, (a + 1).cast("int"), (b - a).cast("int"))

    def step(state: Column, span: Column) -> Column:
        new = span["start"] >= state["at"]
        out = F.when(new, F.concat(state["out"], cut(state["at"], span["start"]), F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), out.alias("out"))

    folded = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"))))
    changed = marked.join(spans, "uid", "left").withColumn("new", F.when(F.col("spans").isNotNull(), folded).otherwise(text))
    hit = changed.select(*(F.col("new").alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in docs.columns))
    return docs.where(~F.coalesce(_holds(F.col(text_col).cast("string")), F.lit(False))).unionByName(hit)
