"""Operator 1: main text of web pages by a site style tree.

The pages of a host are merged into one style tree: an element's place is the
chain of tags and class names (digits dropped) from the root.  A place's
presentation importance is the entropy, to the base of the number of pages
that have it, of the styles (sequences of child tags) it takes; its content
importance is 1 less the mean entropy of its features, where a feature (the
text of a block) that is on k of the m pages has entropy log k / log m.  The
composite importance is (1 - `DAMPING`) times the first plus `DAMPING` times
the second.  A place on one page of its host only has importance 1.  The text
of places with less than `LEAST` is taken out of each page, and so are blocks
whose text is on at least `COMMON` of a place's pages (with `ENOUGH` or more
pages).  A branch is noise when it and all below it have less than `LEAST`, so
its text is that of such places: elements without text of their own decide
nothing more and get no importance.

Tags and class names that say what a part is (menu, header, footer, sidebar,
notice, advert, form, comments, ...) are taken out before.  Where a page marks
its article, blocks outside it are out; those in it are judged by the tree like
all others.  Pages of a host that hold the same text by these marks count as
one page: copies of an article on one host do not make it a template.

Text: character references are decoded, white space inside a block becomes one
space, ends are trimmed, blocks are joined by one space in page order.  A null
or empty page has the empty text; a null url is a host of its own kind without
a style tree.  Unclosed tags are closed as browsers do, roughly; a page cut
off in the middle gives what it holds.  Repeated rows count as one page.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_IDS, stored

DAMPING = 0.9
LEAST = 0.3
COMMON = 0.5
ENOUGH = 4

#: HTML tags by what they are.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
                     "span strike strong sub sup time tt u var wbr").split())
_NOT_TEXT = frozenset(("nav aside form footer button input select option dialog menu figcaption object canvas map audio video head title "
                       "frameset noframes").split())
_CLOSED_BY = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
              "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}
_MARKED = re.compile(
    r"(?:^|[\s_-])(?:nav(?:bar|igation)?|menu|masthead|site-?header|page-?header|top-?bar|header|footer|foot|sidebar|side|aside|widgets?|"
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|notice|cookies?|consent|gdpr|popup|modal|overlay|comments?|comment-?list|replies|reply|"
    r"disqus|breadcrumbs?|pagination|pager|share|sharing|social|related|recommend\w*|newsletter|subscribe|login|search|copyright|legal|"
    r"disclaimer|skip|hidden|toolbar|tags|author-?box)(?:$|[\s_-]|\d)", re.I)
_ROLE = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|iframe|textarea|svg|math|select)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>|<[a-zA-Z/][^>]*\Z", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_DIGITS = re.compile(r"\d+")


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class _Element:
    __slots__ = ("tag", "place", "out", "article", "children")

    def __init__(self, tag, place, out, article):
        self.tag, self.place, self.out, self.article, self.children = tag, place, out, article, []


class Parser:
    """Blocks and styles of pages; keeps the hashes of places it has seen."""

    def __init__(self):
        self.places: dict = {}

    def _place(self, parent: int, sign: str) -> int:
        key = (parent, sign)
        if key not in self.places:
            if len(self.places) > 200_000:
                self.places.clear()
            self.places[key] = _hash(parent, sign)
        return self.places[key]

    def parse(self, page: str | None) -> tuple[list, dict]:
        """Blocks (place, text, taken out by marks, in an article) in page
        order, and the style of each place."""
        blocks: list = []
        styles: dict[int, set] = {}
        root = _Element("", 0, False, False)
        stack = [root]
        text: list[str] = []
        block = root  # innermost element that is not inline

        def flush():
            if text:
                t = " ".join(htmllib.unescape("".join(text)).split())
                if t:
                    blocks.append((block.place, t, block.out, block.article))
                text.clear()

        def pop():
            e = stack.pop()
            if e.children:
                styles.setdefault(e.place, set()).add(_hash(*e.children))

        def innermost():
            return next(e for e in reversed(stack) if e.tag not in _INLINE)

        at = 0
        for m in _TOKEN.finditer(page or ""):
            s = m.start()
            if s > at:
                text.append(page[at:s])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                if m["raw"]:
                    text.append(" ")
                continue
            tag = tag.lower()
            inline = tag in _INLINE
            if tag == "br":
                text.append("\n")
                continue
            if not inline:
                flush()
            if m["close"]:
                if any(e.tag == tag for e in stack[1:]):
                    while stack[-1].tag != tag:
                        pop()
                    pop()
                if not inline:
                    block = innermost()
                continue
            if not inline:  # a new block ends open paragraphs and what it cannot be inside
                ends = _CLOSED_BY.get(tag, ())
                for i in range(len(stack) - 1, 0, -1):
                    e = stack[i]
                    if e.tag in ends or e.tag == "p":
                        while len(stack) > i:
                            pop()
                        break
                    if e.tag not in _INLINE and e.tag not in ("td", "th", "dd", "dt"):
                        break
                while stack[-1].tag in _INLINE:  # formatting left open
                    pop()
            up = stack[-1]
            attrs = {k.lower(): (a or b or c or "") for k, a, b, c in _ATTR.findall(m["attrs"])} if len(m["attrs"]) > 3 else {}
            names = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
            sign = f"{tag}.{_DIGITS.sub('', names)}" if names else tag
            out = up.out or tag in _NOT_TEXT or (tag == "header" and not up.article) or attrs.get("role", "").lower() in _ROLE \
                or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "") \
                or (tag not in ("html", "body", "article", "main") and bool(names) and bool(_MARKED.search(names)))
            if not up.children or up.children[-1] != sign:
                up.children.append(sign)
            if tag in _VOID or m["attrs"].endswith("/"):
                continue
            if inline and out and not up.out:  # a marked inline element is a block of its own
                flush()
                inline = False
            e = _Element(tag, up.place if inline else self._place(up.place, sign), out,
                         up.article or tag in ("article", "main") or attrs.get("role", "").lower() == "main")
            stack.append(e)
            if not inline:
                block = e
        if page and at < len(page):
            text.append(page[at:])
        flush()
        while len(stack) > 1:
            pop()
        return blocks, styles


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def _open(blocks: list) -> list:
    """(place, text) of the blocks that no mark takes out."""
    return [(p, t) for p, t, out, _ in blocks if not out]


def _marked_text(blocks: list) -> list:
    """(place, text) of the blocks left by the marks: those of the article, if
    the page has one."""
    article = any(a and not out for _, _, out, a in blocks)
    return [(p, t) for p, t, out, a in blocks if not out and (a or not article)]


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, place, feature) to take out, from (row, host, html): feature 0
    for a whole place, else a block's hash."""
    def features(it):
        parser = Parser()
        for b in it:
            rows: list[tuple] = []
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                blocks, styles = parser.parse(page)
                content = _hash(*[t for _, t in _marked_text(blocks)])
                seen = set()
                for place, text in _open(blocks):
                    seen |= {(host, place, 0, 0, content), (host, place, 1, _hash(text), content)}
                seen |= {(host, p, 2, s, content) for p, ss in styles.items() for s in ss if (host, p, 0, 0, content) in seen}
                rows += seen
            cols = list(zip(*rows)) or [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                                              pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                                             names=["host", "place", "kind", "feature", "content"])

    known = pages.where("host <> ''").select("host", "html")
    rows = known.mapInArrow(features, "host string, place long, kind int, feature long, content long")
    counts = rows.distinct().groupBy("host", "place", "kind", "feature").agg(F.count(F.lit(1)).alias("k"))
    # Features of one page only, most of them, are told apart no longer: n of them.
    counts = stored(counts.groupBy("host", "place", "kind", F.when(F.col("k") > 1, F.col("feature")).alias("feature"), "k").agg(
        F.count(F.lit(1)).alias("n")))
    m = counts.where("kind = 0").select("host", "place", F.col("k").alias("m")).where("m > 1")
    each = counts.where("kind > 0").join(m, ["host", "place"])
    text, styled = (F.when(F.col("kind") == kind, F.col("n")) for kind in (1, 2))
    content = F.sum(text * F.log("k") / F.log("m")) / F.sum(text)
    share = F.col("k") / F.col("m")
    style = F.sum(styled * -share * F.log(share) / F.log("m"))
    importance = (1 - DAMPING) * F.coalesce(style, F.lit(0.0)) + DAMPING * (1 - F.coalesce(content, F.lit(0.0)))
    places = each.groupBy("host", "place").agg(importance.alias("importance")).where(F.col("importance") < LEAST)
    texts = each.where((F.col("kind") == 1) & (F.col("m") >= ENOUGH) & (F.col("k") >= COMMON * F.col("m")))
    return stored(places.select("host", "place", F.lit(0).cast("long").alias("feature")).union(texts.select("host", "place", "feature")))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of `pages`: the id, url, text and n_chars (code points)."""
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(_host(F.col(url_col)), F.lit("")).alias("host"),
                          F.col(html_col).alias("html"))
    out = style_tree(source)
    id_type = pages.schema[id_col].dataType.simpleString()

    def places(it):  # the pages that the tree decides on, with their places and blocks
        parser = Parser()
        for b in it:
            ids, hosts, ps, fs = [], [], [], []
            for i, host, page in zip(*[b.column(k).to_pylist() for k in range(3)]):
                for p, f in {(p, x) for p, t in _open(parser.parse(page)[0]) for x in (0, _hash(t))}:
                    ids.append(i)
                    hosts.append(host)
                    ps.append(p)
                    fs.append(f)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(hosts, pa.string()), pa.array(ps, pa.int64()),
                                              pa.array(fs, pa.int64())], names=["id", "host", "place", "feature"])

    hosts = out.select("host").distinct()
    held = source.where("host <> ''").select("id", "host", "html").join(hosts, "host", "left_semi").select("id", "host", "html").mapInArrow(
        places, f"id {id_type}, host string, place long, feature long")
    gone = stored(held.join(out, ["host", "place", "feature"]).groupBy(F.col("id").alias("of"), F.col("host").alias("on")).agg(
        F.collect_set(F.struct("place", "feature")).alias("gone")))  # of one page
    size = gone.agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("parts")).first()
    small = size.pages <= BROADCAST_IDS // 10 and size.parts <= BROADCAST_IDS
    joined = source.join(F.broadcast(gone) if small else gone, F.col("id").eqNullSafe(F.col("of")) & (F.col("host") == F.col("on")), "left").select(
        "id", "url", "html", "gone")

    def extract(it):
        parser = Parser()
        for b in it:
            texts = []
            for page, drop in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                blocks = parser.parse(page)[0]
                gone = {(x["place"], x["feature"]) for x in drop or ()}
                texts.append(" ".join(t for p, t in _marked_text(blocks) if (p, 0) not in gone and (not gone or (p, _hash(t)) not in gone)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["id", "url", "text", "n_chars"])

    return joined.mapInArrow(extract, f"id {id_type}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
