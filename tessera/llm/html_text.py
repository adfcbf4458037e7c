"""Main text of web pages by removal of site templates.

Every page is read as a tree of elements. An element has two hashes: of its content, the tags and texts below it, and of its
form, where it stands by tags, classes and ids and which forms are below it, runs of equal ones counted once. Spark counts
both over the distinct pages of a host and of the host's section. A subtree whose content recurs on many pages is template.
So is one whose form recurs, whatever its words, unless it stands where these pages have their text. What a page's own
marks say (article, nav, class words) helps, and decides alone where a site has too few pages to count.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import BROADCAST_ROWS, materialize, small, text_batches, tidied
from tessera.llm.jaccard import shingle_sets

_NEXT = re.compile(r"<(?:!--|[A-Za-z/!?])")
#: A tag without signs that could end it early; others go the slow way.
_PLAIN = re.compile(r"""<(/?)([A-Za-z][^\s/<>]*)((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+)>""")
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_SIGN = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_DIGITS = re.compile(r"[0-9]+")

# Element kinds of the HTML standard and the words that sites give to page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
NO_TEXT = frozenset("head script style noscript template iframe object svg math canvas audio video button select textarea dialog form".split())
MENUS = frozenset("nav footer aside menu search".split())
_RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsored promo sidebar nav navbar navigation menu breadcrumb breadcrumbs cookie cookies consent "
    "banner notice popup modal newsletter subscribe signup share sharing social related comment comments respond disqus footer header masthead".split()
)
IN_ARTICLE = FURNITURE - {"header", "banner"}  # an article's own header holds its title
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "legend", "summary", "figcaption"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table select article section div main body html".split())
_SPLIT = re.compile(r"[\s_-]+")

#: Bits of an element: furniture by its class, in an article, in a main element, holds a first-level heading.
MARKED, ARTICLE, MAIN, HEADING = 1, 2, 4, 8


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\x01".join(map(str, parts))) - 2**63


def tags(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of each tag in order; comments and declarations have no name. In one pass: a quote
    that never closes is an ordinary sign, and a tag that never closes ends the page. What a script or the like holds isn't read."""
    here, closed = 0, {'"': True, "'": True}
    while m := _NEXT.search(source, here):
        start = m.start()
        if tag := _PLAIN.match(source, start):
            here, kind = tag.end(), tag[2].lower()
            yield start, here, tag[1], kind, tag[3]
            if kind in RAW and not tag[1]:
                if not (end := _RAW_ENDS[kind].search(source, here)):
                    return
                here = end.start()
            continue
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4) + 3
            here = end if end > 2 else len(source)
            yield start, here, "", "", ""
            continue
        name = _NAME.match(source, start)
        at = name.end() if name else start + 1
        while sign := _SIGN.search(source, at):
            at = sign.end()
            if sign[0] == ">":
                break
            if name and closed[sign[0]]:
                end = source.find(sign[0], at)
                closed[sign[0]] = end >= 0
                at = end + 1 if end >= 0 else at
        if sign is None:
            yield start, len(source), "", "", ""
            return
        here, kind = at, name[2].lower() if name else ""
        yield start, here, name[1] if name else "", kind, source[name.end() : at - 1] if name else ""
        if kind in RAW and not name[1]:
            if not (end := _RAW_ENDS[kind].search(source, here)):
                return
            here = end.start()


class Page:
    """The tree of a page: its text blocks with the element around each, and for each element its parent (-1: none), content
    and form (0 without text), where it stands, its words and its bits."""

    def __init__(self, source: str, marks: bool = True):
        self.blocks, self.owner = [], []
        self.parent, self.content, self.form, self.path, self.words, self.bits = [], [], [], [], [], []
        self._marks, self._text, self._parts, self._forms, self._labels = marks, [], [], [], []
        #: (tag, element or -1, whether text is dropped); places of each tag in the stack, and of those that close no p outside.
        self._stack: list[tuple[str, int, bool]] = []
        self._open: dict[str, list[int]] = {}
        self._scopes: list[int] = []
        self._nth: dict[str, int] = {}
        self._read(source)

    def _read(self, source: str) -> None:
        here, raw = 0, None
        for start, end, slash, tag, attrs in tags(source):
            if raw is not None:  # until its own end tag
                if slash and tag == raw:
                    raw, here = None, end
                continue
            if start > here:
                self._text.append(html_lib.unescape(source[here:start]))
            here = end
            if not tag:
                continue
            if tag in BLOCK or tag in NO_TEXT or tag in RAW:
                self._flush()
            elif tag == "br":
                self._text.append(" ")
            if slash:
                self._end(tag)
            elif tag in RAW:
                raw = tag
            elif tag not in VOID:
                self._start(tag, attrs)
        if raw is None and here < len(source):
            self._text.append(html_lib.unescape(source[here:]))
        self._flush()
        while self._stack:
            self._close()

    def _flush(self) -> None:
        block = " ".join("".join(self._text).split())
        self._text.clear()
        if not block or self._stack and self._stack[-1][2]:
            return
        e = self._stack[-1][1] if self._stack else -1
        self.blocks.append(block)
        self.owner.append(e)
        if e >= 0:
            self._parts[e].append(block)
            self._add_form(e, 1)
            self.words[e] += block.count(" ") + 1

    def _add_form(self, e: int, form: int) -> None:
        if not self._forms[e] or self._forms[e][-1] != form:
            self._forms[e].append(form)

    def _labels_of(self, tag: str, attrs: str, inside: bool) -> tuple[str, bool, bool]:
        """(classes and id without their digits, whether they are furniture's, whether the element is hidden)"""
        if not attrs:
            return "", False, False
        found = {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(attrs)}
        label = _DIGITS.sub("0", f"{' '.join(sorted(found.get('class', '').split()))}#{found.get('id', '')}")
        if not self._marks or tag in ("html", "body", "main"):
            return label, False, False
        if tag == "article":
            return label, "comment" in label, "hidden" in found
        words = set(_SPLIT.split(label.replace("#", " ")))
        return label, bool(words & (IN_ARTICLE if inside else FURNITURE)) or found.get("role") in ROLES, "hidden" in found

    def _start(self, tag: str, attrs: str) -> None:
        if tag in CLOSES_P and (at := self._open.get("p")) and (not self._scopes or self._scopes[-1] < at[-1]):
            self._end("p")
        if tag in SIBLINGS:
            ends = SIBLINGS[tag]
            while self._stack and self._stack[-1][0] in ends | {"p"} and any(t in ends for t, _, _ in self._stack[-2:]):
                self._close()
        if tag == "body" and self._stack and self._stack[-1][0] == "head":
            self._close()
        up = self._stack[-1] if self._stack else ("", -1, False)
        bits = self.bits[up[1]] & (ARTICLE | MAIN) if up[1] >= 0 else 0
        label, furniture, hidden = self._labels_of(tag, attrs, bool(bits))
        if tag not in BLOCK and tag not in NO_TEXT:
            if not furniture and not hidden:
                return
            self._flush()
        dropped = up[2] or hidden or tag in NO_TEXT or self._marks and (tag in MENUS or tag == "header" and not bits)
        e = up[1]
        if not dropped and tag not in ("html", "body"):
            e = len(self.parent)
            if self._marks and not furniture:
                bits |= ARTICLE * (tag == "article") | MAIN * (tag == "main")
            if up[1] < 0 and not label:  # parts of a page without names are told apart by their order
                self._nth[tag] = self._nth.get(tag, 0) + 1
                label = str(min(9, self._nth[tag])) if tag == "div" else ""
            self.parent.append(up[1])
            self.path.append(_hash(self.path[up[1]] if up[1] >= 0 else 0, tag, label))
            self.bits.append(bits | MARKED * furniture | HEADING * (tag == "h1"))
            self.words.append(0)
            self.content.append(0)
            self.form.append(0)
            self._parts.append([tag])
            self._forms.append([])
        place = len(self._stack)
        self._stack.append((tag, e, dropped))
        self._open.setdefault(tag, []).append(place)
        if tag in _SCOPE:
            self._scopes.append(place)

    def _close(self) -> None:
        tag, e, dropped = self._stack.pop()
        self._open[tag].pop()
        if tag in _SCOPE:
            self._scopes.pop()
        up = self._stack[-1][1] if self._stack else -1
        if dropped or e < 0 or e == up or not self.words[e]:
            return
        self.content[e] = _hash(*self._parts[e])
        self.form[e] = _hash(self.path[e], *self._forms[e])
        self._parts[e] = self._forms[e] = None
        if up >= 0:
            self._parts[up].append(self.content[e])
            self._add_form(up, self.form[e])
            self.words[up] += self.words[e]
            self.bits[up] |= self.bits[e] & HEADING

    def _end(self, tag: str) -> None:
        if at := self._open.get(tag):
            place = at[-1]
            while len(self._stack) > place:
                self._close()

    def own_text(self) -> str:
        """What isn't marked as furniture."""
        return " ".join(b for b, e in zip(self.blocks, self.owner, strict=True) if e < 0 or not self.bits[e] & MARKED)

    def seen(self) -> tuple[list[int], list[tuple], list[tuple]]:
        """(contents, (form, path, bits), (path, words that stand right in such elements or in paragraphs of theirs)), each once."""
        contents, forms, places = set(), {}, {}
        for e, n in enumerate(self.words):
            if n:
                contents.add(self.content[e])
                f = self.form[e]
                forms[f] = (f, self.path[e], forms[f][2] | self.bits[e] if f in forms else self.bits[e])
        for block, e in zip(self.blocks, self.owner, strict=True):
            up = self.parent[e] if e >= 0 else -1
            at = self.path[up] if up >= 0 else 0
            places[at] = places.get(at, 0) + block.count(" ") + 1
        return sorted(contents), list(forms.values()), list(places.items())


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_SEEN = "copy long, contents array<long>, forms array<struct<form:long,path:long,bits:int>>, places array<struct<path:long,words:long>>"
_TREE = "blocks array<string>, owner array<int>, parent array<int>, content array<long>, form array<long>, path array<long>, bits array<int>"
_SECTION = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)/"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)"


#: Shingles of three words that a page has at least to be told by the least of them, which near copies mostly share.
TELLING = 12


def copy_keys(texts: list[str]) -> list[int]:
    """A number for each page that copies of it have too, near ones mostly."""
    sets = shingle_sets(pa.array(texts, pa.string()), 3)
    return [int(s[0].astype("i8")) if len(s) >= TELLING else _hash(t) for s, t in zip(sets, texts, strict=True)]


def _parse(marks: bool):
    form_type = pa.list_(pa.struct([("form", pa.int64()), ("path", pa.int64()), ("bits", pa.int32())]))
    place_type = pa.list_(pa.struct([("path", pa.int64()), ("words", pa.int64())]))
    fields = [("copy", pa.int64()), ("contents", _LONGS), ("forms", form_type), ("places", place_type), ("blocks", pa.list_(pa.string())), ("owner", _INTS),
              ("parent", _INTS), ("content", _LONGS), ("form", _LONGS), ("path", _LONGS), ("bits", _INTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):  # pages are held as trees for as long as their batch
                own = batch.slice(k, 200)
                trees, rows = [Page(source or "", marks) for source in own.column(3).to_pylist()], []
                for p, copy in zip(trees, copy_keys([p.own_text() for p in trees]), strict=True):
                    contents, forms, places = p.seen()
                    rows.append((copy, contents, [dict(zip(("form", "path", "bits"), f)) for f in forms], [{"path": a, "words": n} for a, n in places],
                                 p.blocks, p.owner, p.parent, p.content, p.form, p.path, p.bits))
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.record_batch([*(own.column(i) for i in range(3)), *columns], ["page_id", "url", "host", *(n for n, _ in fields)])

    return run


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, text, n_template) of pages with the lists of their sites and whether these are counted."""
    for batch in batches:
        texts, removed = [], []
        for r in batch.select(batch.schema.names[2:]).to_pylist():
            sites = [x for x in (r["whole"], r["part"]) if x]
            text, n = page_text(r, *(set().union(*(x[k] for x in sites)) for k in ("contents", "anywhere", "forms", "text")), bool(r["counted"]))
            texts.append(text)
            removed.append(n)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], ["page_id", "url", "text", "n_template"])


def page_text(tree: dict, contents: set[int], anywhere: set[int], forms: set[int], text: set[int], counted: bool) -> tuple[str, int]:
    """(main text, blocks taken out as template) of a page's tree. contents and forms go, in the text only contents that are in
    `anywhere`; text: paths that hold the site's text."""
    same, alike, marked, inside = [], [], [], []
    for up, content, form, path, bits in zip(tree["parent"], tree["content"], tree["form"], tree["path"], tree["bits"], strict=True):
        within = up >= 0 and inside[up] or bits & (ARTICLE | MAIN) > 0
        recurs = content in (anywhere if within else contents)
        # In the text itself a form says little; there only furniture that recurs goes.
        formed = form in forms and (not within or bits & MARKED > 0)
        same.append(up >= 0 and same[up] or recurs)
        alike.append(up >= 0 and alike[up] or formed)
        marked.append(up >= 0 and marked[up] or bits & MARKED > 0 and not (counted and within))
        inside.append(within or path in text)
    at = list(zip(tree["blocks"], tree["owner"], strict=True))
    template = {k for k, (_, e) in enumerate(at) if e >= 0 and (same[e] or alike[e])}
    kept = [k for k, (_, e) in enumerate(at) if k not in template and (e < 0 or not marked[e])]
    # A marked article is the page's text on a site too small to count.
    has = lambda k, bit: at[k][1] >= 0 and tree["bits"][at[k][1]] & bit > 0
    for bit in () if counted else (ARTICLE, MAIN):
        if any(has(k, bit) for k in range(len(at))):
            kept = [k for k in kept if has(k, bit)]
            break
    if not kept:  # an article of nothing but template is no template
        kept = [k for k, (_, e) in enumerate(at) if (has(k, ARTICLE) or has(k, MAIN)) and not marked[e] and not alike[e]]
        template -= set(kept)
    return "\n".join(at[k][0] for k in kept), len(template)


def site_lists(pages: DataFrame, min_pages: int, min_share: float, in_text_share: float, text_share: float) -> DataFrame:
    """(site, n_pages, contents, anywhere, forms, text) of pages (copy, site, contents, forms, places): what recurs on each site,
    the contents that do so even in its text, and where its text stands. Copies of a page count once. All counts are partial sums, so a site of a third of all pages takes no single task."""
    seen = pages.dropDuplicates(["site", "copy"])
    seen = materialize(seen.select("site", "contents", "forms", "places"), "seen", "zstd")
    sizes = seen.groupBy("site").agg(F.count(F.lit(1)).alias("n_pages"))
    sizes = materialize(sizes, "sizes")
    often = (F.col("n") >= min_pages) & (F.col("n") >= min_share * F.col("n_pages"))
    mostly = F.col("n") >= in_text_share * F.col("n_pages")
    contents = seen.select("site", F.explode("contents").alias("content")).groupBy("site", "content").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    contents = contents.join(small(sizes), "site").where(often)
    contents = contents.groupBy("site").agg(F.collect_set("content").alias("contents"), F.collect_set(F.when(mostly, F.col("content"))).alias("anywhere"))
    places = seen.select("site", F.explode("places").alias("p")).groupBy("site", "p.path").agg(F.sum("p.words").alias("words"))
    total = places.groupBy("site").agg(F.sum("words").alias("total"))
    text = places.join(total, "site").where(F.col("words") >= text_share * F.col("total")).select("site", "path")
    text = text.groupBy("site").agg(F.collect_set("path").alias("text"))
    forms = seen.select("site", F.explode("forms").alias("f")).groupBy("site", "f.form").agg(F.count(F.lit(1)).alias("n"), F.max("f.path").alias("path"), F.bit_or("f.bits").alias("bits"))
    marked = (F.col("bits").bitwiseAND(MARKED) > 0) & (F.col("n") >= 2)
    forms = forms.where("n >= 2").join(small(sizes), "site").where((F.col("n_pages") >= min_pages) & (F.col("bits").bitwiseAND(HEADING) == 0) & (often | marked))
    forms = forms.join(text, "site", "left").where(~F.coalesce(F.array_contains("text", F.col("path")), F.lit(False)))
    forms = forms.groupBy("site").agg(F.collect_set("form").alias("forms"))
    none = lambda c: F.coalesce(c, F.array().cast("array<bigint>")).alias(c)
    whole = sizes.join(contents, "site", "left").join(forms, "site", "left").join(text, "site", "left")
    return whole.select("site", "n_pages", none("contents"), none("anywhere"), none("forms"), none("text"))


def main_text(pages: DataFrame, min_pages: int = 5, min_share: float = 0.3, in_text_share: float = 0.8, text_share: float = 0.4, marks: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars, n_template), a row per row of pages; n_template: blocks taken out as template.

    A subtree is template where at least min_pages distinct pages of its host, or of the section of the host that the first
    folder of the url names, and min_share of them (in the text itself in_text_share), hold its content; or its form, if it holds no main heading and stands
    outside of the elements that have text_share of the host's words right below them and outside of marked articles. For
    furniture by its class two pages are enough, inside an article too. Copies of a page, near ones mostly, count once. Hosts of fewer than
    min_pages distinct pages go by their marks alone: a marked article, else main, else all, without furniture. Menus,
    forms and elements that show no text always go, unless marks is False, which reads elements by counts alone. An article
    of nothing but template keeps its text. A null or empty html gives an empty text; a null url or one without a host
    counts under the empty host; null ids stay null, repeated rows are repeated, other columns aren't read. Pages are read
    in time linear in their length, whatever their nesting or unclosed tags.
    """
    text_batches(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", _HOST, 1)), F.lit(""))
    own = pages.select(F.col("page_id").cast("long"), "url", host.alias("host"), "html")
    parsed = materialize(own.mapInArrow(tidied(_parse(marks)), f"page_id long, url string, host string, {_SEEN}, {_TREE}"), "pages", "zstd")
    section = F.regexp_extract("url", _SECTION, 1)
    sites = F.when(section != "", F.array("host", F.concat("host", F.lit("/"), section))).otherwise(F.array("host"))
    placed = parsed.withColumn("sites", F.coalesce(sites, F.array("host")))
    lists = site_lists(placed.select("copy", F.explode("sites").alias("site"), "contents", "forms", "places"), min_pages, min_share, in_text_share, text_share)
    lists = materialize(lists, "template")
    total = lists.agg(F.sum(F.size("contents") + F.size("anywhere") + F.size("forms") + F.size("text") + 4)).first()[0] or 0
    lists = F.broadcast(lists) if total <= BROADCAST_ROWS else lists
    tree = [c.split()[0] for c in _TREE.split(", ")]
    cut = placed.select("page_id", "url", *tree, F.get("sites", F.lit(0)).alias("whole_site"), F.get("sites", F.lit(1)).alias("part_site"))
    for side in ("whole", "part"):
        what = F.struct("contents", "anywhere", "forms", "text").alias(side)
        cut = cut.join(lists.select(F.col("site").alias(f"{side}_site"), what, *([(F.col("n_pages") >= min_pages).alias("counted")] if side == "whole" else [])), f"{side}_site", "left")
    out = cut.select("page_id", "url", *tree, "whole", "part", "counted").mapInArrow(_clean, "page_id long, url string, text string, n_template long")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_template")
