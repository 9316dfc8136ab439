"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its elements, told apart by path (tags with class or id).
Over the pages of a host, tokens with the same occurrence vector form an
equivalence class; the vector is never gathered, only a commutative sum of
hashes of (page, count), so a hot host is summed map-side like any other. Classes
that are large and frequent enough are valid and nest by their paths into the
host's template; its slots are the template paths that hold text. Slots that hold
the same text on every page belong to the template, in articles too; so do those
that are mostly links outside an article. Chrome by element or name goes; the rest
is extracted, from the article alone where it holds most of the text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import batch_columns, bounded_batches, materialize

#: Pages and tokens a valid class needs, share of the host's pages, share of a slot's text that may stand in links.
LEAST_PAGES, LEAST_TOKENS, LEAST_SHARE, MOST_LINKED = 3, 2, 0.5, 0.5

#: Share of the unlinked text outside chrome that an article must hold, against the rest, to be the page's text.
LEAST_SHARE_INSIDE = 0.5

#: Elements by role.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CHROME = frozenset("nav footer aside form script style noscript template button select option textarea input iframe svg canvas object audio video head title dialog menu noembed noframes xmp".split())
BREAKING = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus respond reply replies form search widget toolbar pagination pager hidden".split()
)
#: Words of the names of regions that readers write in.
READER_WORDS = frozenset("comment comments commentlist commenter commenters disqus discussion discussions reply replies respond".split())
#: Share of the text outside chrome that a region so named may hold; one that holds more is the page's text.
MOST_READERS = 0.5
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
#: Characters of slots that are broadcast; places of a host beyond that.
BROADCAST_CHARS, PLACES = 1 << 24, 64
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_READ = frozenset("class id role style hidden aria-hidden".split())
#: Words that say where or in what form a thing stands, beside the word for what it is.
_FORM_WORDS = frozenset("site page main post article global top bottom left right header inner outer wrap wrapper container box block area bar list item items links buttons button icons section panel col column row slot unit group entry text content primary secondary js is".split())
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _names_chrome(value: str) -> bool:
    """Whether a class or id names chrome: all words of one of its names do, but for words of form."""
    for name in value.split():
        words = {w.lower() for w in _NAMES.findall(name)}
        if words & CHROME_NAMES and words <= CHROME_NAMES | _FORM_WORDS:
            return True
    return False


def _names_readers(value: str) -> bool:
    """Whether a word of a class or id names a region of readers' comments."""
    return any(w.lower() in READER_WORDS for w in _NAMES.findall(value))


class _Element:
    __slots__ = ("tag", "path", "chrome", "article", "link", "readers")

    def __init__(self, tag: str, path: str, chrome: bool, article: bool, link: bool, readers: bool):
        self.tag, self.path, self.chrome, self.article, self.link, self.readers = tag, path, chrome, article, link, readers


def _open(tag: str, attributes: str, parent: _Element) -> _Element:
    label, chrome, article, readers = tag, parent.chrome or tag in CHROME, parent.article, parent.readers
    if attributes and not attributes.isspace():
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next((v for v in values if v), "")
            if name not in _READ:
                continue
            if name in ("class", "id"):
                label += "." + re.sub(r"\d+", "", value)
                if tag not in ("html", "body", "main", "article"):
                    chrome = chrome or _names_chrome(value)
                    readers = readers or _names_readers(value)
            elif name == "role":
                chrome = chrome or value.lower() in CHROME_ROLES
                article = article or value.lower() == "main"
            elif name == "style":
                chrome = chrome or "display:none" in value.replace(" ", "").lower()
            elif name == "hidden":
                chrome = True
            elif value.lower() == "true":
                chrome = True
    article = article or tag in ("article", "main")
    # a page's header is chrome; one inside the article is, but for its headings
    if tag == "header":
        chrome = True
    elif tag in _HEADINGS and parent.tag == "header" and parent.article and not parent.path.count("/header") > 1:
        chrome = False
    return _Element(tag, f"{parent.path}/{label}", chrome, article, parent.link or tag == "a", readers)


def parse(page: str) -> tuple[dict[str, int], list[tuple[str, bool, bool, int, str, bool]]]:
    """(how often each path opens, blocks in page order); a block is (path, chrome, in the article, linked characters, text, of readers)."""
    root = _Element("", "", False, False, False, False)
    stack, opened, found = [root], {}, []
    pieces: list[str] = []
    linked, holder = 0, root

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                found.append((holder.path, holder.chrome, holder.article, linked, text, holder.readers))
            pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked, holder
        top = stack[-1]
        text = entities.unescape(raw) if "&" in raw else raw
        if pieces and top.chrome != holder.chrome and not text.isspace():
            flush()
        if not pieces:
            if text.isspace():
                return
            holder = top
        pieces.append(text)
        if top.link:
            linked += len(text)

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:]) if at < len(page) else None
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag in BREAKING:
                flush()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if stack[depth].tag in ("article", "main", "body", "table") and tag not in ("html", "body", "article", "main", "table", "div", "section"):
                    break
            continue
        if tag == "br":
            if pieces:
                pieces.append(" ")
            continue
        if tag in BREAKING:
            flush()
            if tag == "li":
                _close(stack, "li", ("ul", "ol", "menu"))
            elif tag in ("dd", "dt"):
                _close(stack, "dd", ("dl",)), _close(stack, "dt", ("dl",))
            elif tag in ("td", "th", "tr"):
                _close(stack, "td", ("tr", "table")), _close(stack, "th", ("tr", "table"))
                if tag == "tr":
                    _close(stack, "tr", ("table",))
            _close(stack, "p", ("div", "section", "article", "main", "body", "li", "td", "blockquote", "nav", "aside", "footer", "header"))
        element = _open(tag, attributes, stack[-1])
        opened[element.path] = opened.get(element.path, 0) + 1
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
            stack.append(element)
            if not end:
                break
            continue
        if not attributes.endswith("/") or tag in BREAKING:
            stack.append(element)
    flush()
    return opened, found


def _close(stack: list[_Element], tag: str, within: tuple[str, ...]) -> None:
    """An end tag that HTML lets out."""
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag == tag:
            del stack[depth:]
            return
        if stack[depth].tag in within:
            return


def main_text(page: str | None, template: frozenset[str] = frozenset()) -> str:
    """The blocks outside chrome and the template's slots, joined by blank lines: those of the article, if it holds most of their text.

    Regions of readers go too, unless the page has no article outside them and they hold most of the text outside chrome.
    A template that would take all text of an article is not that page's: its text stays.
    """
    _, found = parse(page or "")
    open_ = [b for b in found if not b[1]]
    readers = [b for b in open_ if b[5]]
    told = any(b[2] and not b[5] for b in open_)  # an article outside: readers may well write more than its author
    if told or sum(len(b[4]) for b in readers) <= MOST_READERS * sum(len(b[4]) for b in open_):
        open_ = [b for b in open_ if not b[5]]
    free = [b for b in open_ if b[0] not in template]
    inside = [b for b in free if b[2]] or [b for b in open_ if b[2]]
    outside = [b for b in free if not b[2]]
    size = lambda blocks: sum(len(b[4]) - b[3] for b in blocks)
    if inside and (LEAST_SHARE_INSIDE * size(outside) <= size(inside)):
        return "\n\n".join(b[4] for b in inside)
    return "\n\n".join(b[4] for b in free)


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _observed(pages: DataFrame) -> DataFrame:
    """What the host's statistics need of each page: (host, path, opened, page, chars, linked, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for host, page in zip(*batch_columns(batch, "host", "html"), strict=True):
                opened, found = parse(page or "")
                slots: dict[str, list] = {}
                for path, chrome, article, linked, text, readers in found:
                    if not chrome and not readers:
                        s = slots.setdefault(path, [0, 0, xxhash.xxh64()])
                        # links are no sign of the template in an article
                        s[0], s[1] = s[0] + len(text), s[1] + (0 if article else linked)
                        s[2].update(text)
                body = xxhash.xxh64_intdigest(page or "") - (1 << 63)
                for path, n in opened.items():
                    chars, linked, text = slots.get(path, (0, 0, None))
                    rows.append({"host": host, "path": path, "opened": n, "page": body, "chars": chars, "linked": linked, "text": text.intdigest() - (1 << 63) if text else None})
            yield pa.RecordBatch.from_pylist(rows, _OBSERVED)

    return pages.select("host", "html").mapInArrow(run, "host string, path string, opened long, page long, chars long, linked long, text long")


_OBSERVED = pa.schema([("host", pa.string()), ("path", pa.string()), *((n, pa.int64()) for n in ("opened", "page", "chars", "linked", "text"))])


def template_slots(pages: DataFrame) -> DataFrame:
    """(host, paths): per host the slots that its template fills. pages: (host, html)."""
    seen = _observed(pages)
    tokens = seen.groupBy("host", "path").agg(
        F.sum(F.xxhash64("page", "opened") % F.lit(1 << 40)).alias("vector"),  # a commutative digest of the occurrence vector
        F.count(F.lit(1)).alias("pages"),
        F.sum("chars").alias("chars"),
        F.sum("linked").alias("linked"),
        F.min("text").alias("first_text"),
        F.max("text").alias("last_text"),
        F.min("page").alias("first_page"),
        F.max("page").alias("last_page"),
    )
    tokens = materialize(tokens, "html-tokens")
    hosts = tokens.groupBy("host").agg(F.max("pages").alias("host_pages"))
    classes = tokens.groupBy("host", "vector", "pages").agg(F.count(F.lit(1)).alias("tokens"))
    valid = classes.join(hosts, "host").where((F.col("tokens") >= LEAST_TOKENS) & (F.col("pages") >= F.greatest(F.lit(LEAST_PAGES), F.col("host_pages") * LEAST_SHARE)))
    slots = tokens.join(valid.select("host", "vector", "pages"), ["host", "vector", "pages"]).where("chars > 0")
    constant = (F.col("first_text") == F.col("last_text")) & (F.col("first_page") != F.col("last_page"))
    filled = slots.where(constant | (F.col("linked") > F.col("chars") * MOST_LINKED))
    return filled.groupBy("host").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every row of pages.

    Null and empty pages, and pages without main text, have the empty string.
    Rows without a url share one host. Repeated rows repeat; they count once each
    in occurrence vectors, but a text that only equal pages share is not taken for
    the template's. An empty table gives no rows.
    """
    bounded_batches(pages.sparkSession)
    ready = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host_of(F.coalesce("url", F.lit(""))))
    slots = materialize(template_slots(ready), "html-slots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, frozenset(s or ())) for p, s in zip(*batch_columns(batch, "html", "paths"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    size = slots.agg(F.sum(F.aggregate("paths", F.lit(0).cast("long"), lambda n, p: n + F.length(p)))).first()[0] or 0
    if size <= BROADCAST_CHARS:
        with_paths = ready.join(F.broadcast(slots), "host", "left")
    else:  # a host's pages are dealt to several places, its slots copied to each
        with_paths = ready.withColumn("place", F.pmod(F.xxhash64("html"), F.lit(PLACES)).cast("int")).join(slots.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1)))).hint("merge"), ["host", "place"], "left")
    return with_paths.select("page_id", "url", "html", "paths").mapInArrow(run, "page_id long, url string, text string, n_chars long")
