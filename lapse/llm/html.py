"""Main text of web pages by equivalence-class template deduction.

Per host, over all its pages:

1. Tokens.  A page is a sequence of tokens: tags, told apart by their path of open elements, and
   the runs of text between tags, told apart by path and wording.
2. Equivalence classes.  A token's occurrence vector is its number of occurrences on each page of
   the host.  Tokens with the same vector form a class; the vector is kept as its
   support and a 64-bit xor of hashes of (page, count), which partial aggregation can build.  Classes on at
   least ``support`` of the host's pages (of MIN_PAGES or more) are kept.
3. Template.  On a page, a class is valid if its tokens come in the order that the host's
   pages give them on average.  Valid classes are nested by position: the gap behind a
   template tag, up to the next one, is a slot of the template.
4. Slots.  Blocks (text up to the next element that is not inline) of template text only are dropped; so are slots below elements that are no content by
   their tag (nav, footer, aside, form, ..), role or class name (adverts, notices, comments, ..; a
   name does not drop what holds the article or most of the page's text).
   If the page marks its article (article, main, role=main), the slots in there are the text: blocks whose text is on every
   page of the host go, names drop only elements that are named so in one word; else all slots below the
   article's container, in page order.  The container is found from the root by going down while
   one container element holds SHARE of the text and all first headings.

Pages are parsed twice, so that what moves between the passes are token hashes, never
pages; the host table goes to the pages by broadcast after it was counted, or salted by page.

Defined cases: null html is empty; null url is a host of its own; broken mark-up is read as far as it
goes (unclosed elements end with their parent, stray ends are ignored, a lone "<" is text);
repeated rows are pages of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import stage

MIN_PAGES = 3
#: Inside a marked article text counts as template if it is on every page of a host of so many pages.
ARTICLE_PAGES = 10
#: Host tables with so many template tokens in all are broadcast (16 bytes each).
BROADCAST_TOKENS = 1_000_000

TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attr2>[^>]*)>|<[!?/][^>]*>|(?P<text>[^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s\"'>/=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
NO_CONTENT = frozenset("nav footer aside form script style noscript template iframe svg button select textarea input option "
                       "menu dialog object canvas head title audio video applet frameset datalist".split())
NO_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar "
                     "advertisement".split())
NO_NAMES = frozenset("ad ads adv advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion "
                     "cookie cookies consent gdpr notice notices notification notifications popup modal overlay newsletter subscribe "
                     "subscription signup sidebar sidebars menu menus nav navbar navigation navi breadcrumb breadcrumbs footer footers header headers masthead "
                     "topbar comment comments respond reply replies discussion disqus related recommended recommendations share sharing social widget widgets "
                     "toolbar login search pager pagination skip disclaimer copyright alert".split())
#: Of these, names that rule out an element inside a marked article, and only if the whole class or id is that word:
#: there "share-price" or "cookies-recipe" may well be the article's own.
IN_ARTICLE = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion cookie cookies "
                       "consent newsletter subscribe signup sidebar breadcrumb breadcrumbs comment comments respond replies disqus share "
                       "sharing toolbar pager pagination login popup modal overlay".split())
#: Of these, names of talk below an article, which may be longer than it; and words that make a name say something of the page.
TALK = frozenset("comment comments respond reply replies discussion disqus".split())
STATES = frozenset("has no with without".split())
#: Elements that the article's container may be, and the share of the text that one must hold.
CONTAINERS = frozenset("html body div section center".split())
SHARE = 0.8
KEEP_NAMED = frozenset("html body article main".split())


class _Element:
    """``no``: no content by tag, role or being hidden; ``named``: by its names (2: talk); ``dropped`` is set by ``_resolve``."""

    __slots__ = ("tag", "path", "parent", "no", "named", "main", "content", "dropped", "size", "best", "heads", "inside")

    def __init__(self, tag: str, path: int, parent: _Element | None, no: bool = False, named: int = 0, main: bool = False):
        self.tag, self.path, self.parent, self.no, self.named, self.main = tag, path, parent, no, named, main
        self.content = main or (parent is not None and parent.content)
        self.dropped, self.size, self.best = False, 0, None
        self.heads, self.inside = 0, False


def _named(attr: str, article: bool) -> tuple[str, int, bool, bool, bool]:
    """From the attributes: a short name for the path, whether names rule content out (2: as talk; ``article``: inside a
    marked article), whether the role does, whether it is hidden, whether they mark the article."""
    name, named, role, hidden, main = "", 0, False, False, False
    seen = set()
    for key, value in ATTRIBUTE.findall(attr):
        key, value = key.lower(), value.strip("\"'")
        if key in seen:
            continue                                      # the first one counts
        seen.add(key)
        if key in ("class", "id", "aria-label"):
            if key == "class":
                name = "." + value
            for one in [value] if key == "aria-label" else value.split():
                words = [w.lower() for w in NAME.findall(one)]
                if article and one.lower() not in IN_ARTICLE:
                    continue
                if words and words[0] in STATES:
                    continue
                if any(w in NO_NAMES for w in words) or "side bar" in " ".join(words):
                    named = max(named, 2 if any(w in TALK for w in words) else 1)
        elif key == "role":
            role = value.lower() in NO_ROLES
            main = main or value.lower() in ("main", "article")
        elif key == "itemprop":
            main = main or value.lower() == "articlebody"
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif key == "style":
            hidden = hidden or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return name, named, role, hidden, main


def _hash(s: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), seed) - (1 << 63)


def parse(page: str) -> Iterator[tuple[str, int, str, _Element]]:
    """Tokens of a page: (kind, hash, text, innermost element); kind is tag, end, text, break or join."""
    stack = [_Element("", 0, None)]
    at, n = 0, len(page)
    while at < n:
        m = TOKENS.match(page, at)
        at = m.end()
        top = stack[-1]
        text = m["text"]
        if text is not None:
            yield "text", 0, text, top
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue                                      # comment, doctype
        tag = tag.lower()
        ends = bool(m["end"] or m["end2"])
        attr = m["attr"] or m["attr2"] or ""
        if tag not in INLINE:
            yield "break", 0, "", top
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            yield "end", _hash(f"</{tag}", stack[-1].path & 0xFFFFFFFF), "", stack[-1]
            continue
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and top.tag == tag:
            stack.pop()
            top = stack[-1]
        name, named, role, hidden, main = _named(attr, top.content)
        main = main or tag in ("article", "main")
        no = hidden or role or tag in NO_CONTENT or (tag == "header" and not (top.content or main))
        e = _Element(tag, _hash(f"{top.path}>{tag}{name}"), top, no, 0 if tag in KEEP_NAMED else named, main)
        yield "tag", e.path, "", e
        if tag in VOID or attr.endswith("/"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else n
            continue
        stack.append(e)


def _text_hash(path: int, text: str) -> int:
    return _hash(f"{path}|{text}", 1)


def _tokens(page: str) -> list[int]:
    out = []
    for kind, h, text, e in parse(page):
        if kind in ("tag", "end"):
            out.append(h)
        elif kind == "text" and (t := " ".join(entities.unescape(text).split())):
            out.append(_text_hash(e.path, t))
    return out


def _page_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            ids, counts, places = [], [], []
            for h in part.column("html"):
                seq = _tokens(h.as_py() or "")
                count = Counter(seq)
                first: dict = {}
                for k, x in enumerate(seq):
                    first.setdefault(x, k)
                ids.append(list(count))
                counts.append(list(count.values()))
                places.append([first[x] / len(seq) for x in count])
            yield pa.RecordBatch.from_arrays(
                [part.column("host"), part.column("page"), pa.array(ids, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32())),
                 pa.array(places, pa.list_(pa.float64()))], ["host", "page", "ids", "counts", "places"])


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame, support: float = 0.6) -> DataFrame:
    """Of every host with a template: host, tokens in the order of their mean relative place, classes (a number for each token's
    class) and every (whether it is on all pages of a host of ARTICLE_PAGES or more)."""
    p = pages.select(_host(F.col("url")).alias("host"), F.xxhash64("page_id", "url", F.monotonically_increasing_id()).alias("page"),
                     F.col("html").cast("string").alias("html"))
    t = stage(p.mapInArrow(_page_tokens, "host string, page long, ids array<long>, counts array<int>, places array<double>"),
              "html-tokens")
    pages_of = t.groupBy("host").agg(F.count("*").alias("pages"))
    # what is on every page of a host may be left out of marked articles too
    each = t.select("host", "page", F.explode(F.arrays_zip("ids", "counts", "places")).alias("x"))
    token = each.groupBy("host", F.col("x.ids").alias("token")).agg(
        F.count("*").alias("on"), F.bit_xor(F.xxhash64("page", "x.counts")).alias("vector"), F.avg("x.places").alias("place"))
    frequent = token.join(pages_of, "host").where((F.col("on") >= F.lit(support) * F.col("pages")) & (F.col("pages") >= MIN_PAGES))
    every = (F.col("on") == F.col("pages")) & (F.col("pages") >= ARTICLE_PAGES)
    classed = frequent.select("host", "token", F.xxhash64("on", "vector").alias("cls"), F.round("place", 9).alias("place"), every.alias("every"))
    rows = F.collect_list(F.struct("place", "token", "cls", "every"))
    return stage(classed.groupBy("host").agg(F.array_sort(rows).alias("t")).select(
        "host", F.col("t.token").alias("tokens"), F.col("t.cls").alias("classes"), F.col("t.every").alias("every")), "html-templates")


def _valid(seq: list[int], cls: dict, order: dict) -> set:
    """Template tokens of the page: those of classes whose tokens keep the host's order here."""
    last, bad = {}, set()
    seen = set()
    for x in seq:
        if x in cls and x not in seen:
            seen.add(x)
            c = cls[x]
            if last.get(c, -1) > order[x]:
                bad.add(c)
            last[c] = order[x]
    return {x for x in seen if cls[x] not in bad}


def _resolve(tokens: list) -> list[_Element]:
    """Decide which elements are dropped; returns all of them, parents first.  A name does not drop an element that holds
    the article (if none stands free of such names, the one with most text) or most of the page's text (talk: all of it)."""
    every = [e for kind, _, _, e in tokens if kind == "tag"]
    roots = {id(e): e for _, _, _, e in tokens if e.parent is None}
    every = [*roots.values(), *every]
    for kind, _, text, e in tokens:
        if kind == "text":
            e.size += len("".join(text.split()))
    for e in reversed(every):
        if e.main and e.size and (e.best is None or e.size >= e.best.size):
            e.best = e
        p = e.parent
        if p is not None and not e.no:
            p.size += e.size
            if e.best is not None and (p.best is None or e.best.size >= p.best.size):
                p.best = e.best
    total = sum(r.size for r in roots.values())
    keep, free = set(), False
    for e in every:
        e.dropped = e.no or bool(e.named) or (e.parent is not None and e.parent.dropped)
        free = free or (e.main and e.size > 0 and not e.dropped)
    if not free:
        for r in roots.values():
            e = r.best
            while e is not None:
                keep.add(id(e))
                e = e.parent
    for e in every:
        large = e.size == total if e.named == 2 else 2 * e.size > total
        by_name = e.named and id(e) not in keep and not (e.size and large)
        e.dropped = bool(e.no or by_name or (e.parent is not None and e.parent.dropped))
    return every


def _container(every: list[_Element], pieces: list[tuple[_Element, str]]) -> None:
    """Sets ``inside`` for the container of the article and all below it; ``pieces`` are the texts that may belong to it."""
    for e in every:
        e.size = e.heads = 0
    for e, t in pieces:
        n = len("".join(t.split()))
        e.size += n
        e.heads += n if e.tag == "h1" else 0
    below: dict = {}
    for e in reversed(every):
        p = e.parent
        if p is not None:
            p.size += e.size
            p.heads += e.heads
            if e.tag in CONTAINERS or "-" in e.tag:
                below.setdefault(id(p), []).append(e)
    roots = [e for e in every if e.parent is None]
    at = roots[0] if roots else None
    while at is not None:
        down = [e for e in below.get(id(at), []) if e.size and e.size >= SHARE * at.size and e.heads == at.heads]
        if not down:
            break
        at = down[0]
    for e in every:
        e.inside = e is at or (e.parent is not None and e.parent.inside)


def main_text(page: str, cls: dict, order: dict, every_page: frozenset = frozenset()) -> str:
    """The main text of one page, given its host's template; ``every_page``: its tokens that are on every page.

    Blocks of template text only are dropped.  In a marked article that takes text of every page, and
    the article keeps all of it if its own wording would be less than half (a host of copies)."""
    tokens = list(parse(page))
    every = _resolve(tokens)
    hashes = []
    for kind, h, text, e in tokens:
        if kind == "text":
            t = " ".join(entities.unescape(text).split())
            hashes.append(_text_hash(e.path, t) if t else 0)
        else:
            hashes.append(h if kind in ("tag", "end") else 0)
    template = _valid([h for h in hashes if h], cls, order) if cls else set()
    marked = any(kind == "tag" and e.content and not e.dropped for kind, _, _, e in tokens)
    if marked:
        template &= every_page
    pieces: list[tuple[_Element, str]] = []
    left_out: list[tuple[int, int]] = []  # blocks of template text only
    start, own = 0, False                 # of the block at hand: its first piece, whether it has wording of this page
    for (kind, _, text, e), x in zip(tokens, hashes):
        if kind == "break":
            if not own:
                left_out.append((start, len(pieces)))
            pieces.append((e, " "))
            start, own = len(pieces), False
        elif kind == "text" and not e.dropped and (e.content or not marked):
            pieces.append((e, entities.unescape(text)))
            own = own or (x != 0 and x not in template)
    if not own:
        left_out.append((start, len(pieces)))
    size = [len("".join(t.split())) for _, t in pieces]
    if not marked or 2 * sum(sum(size[a:b]) for a, b in left_out) < sum(size):
        for a, b in reversed(left_out):
            del pieces[a:b]
    if not marked and template:
        _container(every, pieces)
        pieces = [(e, t) if e.inside else (e, " ") for e, t in pieces]
    return " ".join("".join(t for _, t in pieces).split())


def extract(pages: DataFrame, support: float = 0.6) -> DataFrame:
    """One row per page: page_id, url, text (main text, empty if none), n_chars (its code points)."""
    t = templates(pages, support)
    n_tokens, hosts = t.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)), F.count("*")).first()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = []
                for host, h, tok, c, every in zip(part.column("host"), part.column("html"), part.column("tokens"), part.column("classes"), part.column("every")):
                    key = host.as_py()
                    if key not in known:
                        if len(known) > 1000:
                            known.clear()
                        ids = tok.as_py() or []
                        known[key] = (dict(zip(ids, c.as_py() or [])), {x: k for k, x in enumerate(ids)},
                                      frozenset(x for x, k in zip(ids, every.as_py() or []) if k))
                    texts.append(main_text(h.as_py() or "", *known[key]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    p = pages.select("page_id", F.col("url").cast("string").alias("url"), _host(F.col("url")).alias("host"),
                     F.col("html").cast("string").alias("html"))
    if n_tokens <= BROADCAST_TOKENS:
        joined = p.join(F.broadcast(t), "host", "left")
    else:
        salt = t.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
        joined = p.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(32)).cast("int")).join(salt, ["host", "_salt"], "left")
    kind = dict(pages.dtypes)["page_id"]
    return joined.select("page_id", "url", "host", "html", "tokens", "classes", "every").mapInArrow(
        read, f"page_id {kind}, url string, text string, n_chars long")
