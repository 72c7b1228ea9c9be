r"""Main text of web pages by tag-path ratios.

A page's text is cut into blocks, each under the path of block elements (with their classes and ids) that leads to it.
Per path the length of its text outside links, its punctuation and its blocks are summed; a path's ratio is text a block
times punctuation a block times the share outside links. Ratios are smoothed along the tree of paths: what flows in
a container (headings, paragraphs, lists, tables) takes most of its ratio from the container, a container of its own little,
and one inside an article much. The fused ratio is held against a threshold relative to the mean over the page's text;
blocks of the paths above it are the main text, in page order.

Elements that hold no text of an article by their meaning (scripts, styles, menus, page headers, footers, asides, controls)
weigh nothing, nor do those whose class, id or role says so (adverts, notices, comments, sidebars, ...), unless the page's main
heading or its `main` element stands in them. If a page marks an article, what stands outside it weighs nothing, unless the
article holds under a twentieth of the text. A section under a heading such as "Comments" weighs nothing.

Nulls and extremes: a null or empty page, and one of menus only, gives an empty text; ids and urls may be null and stay;
pages of any length are read whole, however deep or broken their markup, in one pass each; repeated rows are all returned;
an empty table gives an empty result; extra columns are ignored. White space is any Unicode white space.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of elements (fixed values of the HTML standard, grouped by what they mean for an article).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption hgroup address details summary header".split())
CONTAINERS = frozenset("html body div section article main center fieldset td th".split())
NO_TEXT = frozenset("head script style noscript template svg iframe object embed canvas audio video map select datalist button textarea input option optgroup title".split())
#: Elements whose content is read as text up to their own end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
NO_ARTICLE = frozenset("nav aside footer menu dialog search".split())
BLOCKS = FLOW | CONTAINERS | NO_TEXT | NO_ARTICLE | {"form", "hr"}
CLOSES_P = BLOCKS - NO_TEXT - frozenset("li dt dd caption thead tbody tfoot tr td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an element of the first kind ends, and those beyond which it doesn't look.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "caption"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: Words in a class, id or role that tell what isn't the article, and longer ones that may be part of such a word.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login menu nav navbar navigation breadcrumb breadcrumbs topbar sidebar rail widget widgets related recommended recommendations share sharing social comment comments disqus respond reply replies "
    "masthead contentinfo complementary footer copyright disclaimer pagination pager toolbar search skip toc feedback teaser teasers trending".split()
)
STEMS = re.compile("comments|cookie|sidebar|advert|sponsor|navbar|breadcrumb|newsletter|popup")
REMARKS = frozenset("comment comments reader readers leave responses kommentare kommentar leserkommentare commentaires commentaire comentarios comentario".split())
TOKEN = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
MARKS = re.compile(r"[.,;:!?…。、，；：！？]")
#: Comments, declarations, end tags, start tags. Every alternative takes what it has begun, to the end of the page if need be, so
#: broken markup is read once. Quotes count after an equals sign only.
MARKUP = re.compile(
    r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|/(?:([a-zA-Z][^\s/>]*+)[^>]*+|[^a-zA-Z>][^>]*+|)(?:>|\Z)"""
    r"""|([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|))*+)(?:>|(\Z)))""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
#: Shares that a path takes from its container's ratio: flowing content, containers inside an article, other containers.
SHARES = (0.75, 0.75, 0.125)
#: Of the mean ratio a path must reach; of the text an article must hold to stand for the page; share of links that makes a menu.
THRESHOLD, ARTICLE, LINKS = 0.25, 0.05, 0.8
#: Bytes of pages that are worked on at once.
AT_ONCE = 4_000_000


class Mark:
    """An element that isn't the article's. firm: whatever it holds."""

    __slots__ = ("firm", "off", "outer")

    def __init__(self, outer: Mark | None, firm: bool):
        self.outer, self.firm, self.off = outer, firm, False


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(double or single or bare))
    return out


class Page:
    """Blocks of a page: text, path, letters in links, mark, whether inside an article."""

    def __init__(self, html: str):
        self.stack: list[tuple] = []  # tag, path, mark, inside an article
        self.open: Counter = Counter()
        self.paths: dict[tuple[int, str], int] = {}
        self.parents, self.flows, self.inside = [-1], [False], [False]
        self.blocks: list[tuple] = []
        self.buffer: list[str] = []
        self.linked = 0
        self.top = ("", 0, None, False)
        at, size = 0, len(html)
        while at < size:
            m = MARKUP.search(html, at)
            if m is None:
                self.data(html[at:])
                break
            if m.start() > at:
                self.data(html[at : m.start()])
            at = m.end()
            if m[1]:
                self.end_tag(m[1].lower())
            elif m[2] and m[4] is None:
                tag = m[2].lower()
                self.start_tag(tag, m[3])
                if tag in RAW:
                    stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                    at = stop.start() if stop else size
        self.flush()

    def step(self, parent: int, tag: str, words: str, flow: bool, inside: bool) -> int:
        key = (parent, f"{tag}.{words}" if words else tag)
        at = self.paths.get(key)
        if at is None:
            at = self.paths[key] = len(self.parents)
            self.parents.append(parent)
            self.flows.append(flow)
            self.inside.append(inside)
        return at

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            self.buffer.clear()
            if text:
                tag, path, mark, inside = self.top
                self.blocks.append((text, path, min(self.linked, len(text)), mark, inside))
                if tag in HEADINGS and len(text) < 60 and REMARKS & {w.lower() for w in re.findall(r"\w+", text)[:3]}:
                    self.remarks()
            self.linked = 0

    def remarks(self) -> None:
        """From a heading over readers' remarks on, its container isn't the article's."""
        for i in range(len(self.stack) - 1, -1, -1):
            tag, path, mark, inside = self.stack[i]
            if tag in CONTAINERS:
                if tag in ("div", "section"):
                    new = Mark(mark, True)
                    self.stack[i] = (tag, path, new, inside)
                    text, at, linked, _, within = self.blocks[-1]
                    self.blocks[-1] = (text, at, linked, new, within)
                    for j in range(i + 1, len(self.stack)):
                        self.stack[j] = (*self.stack[j][:2], Mark(new, False), self.stack[j][3])
                    self.top = self.stack[-1]
                return

    def pop(self, n: int) -> None:
        """Close elements down to n open ones."""
        while len(self.stack) > n:
            self.open[self.stack.pop()[0]] -= 1
        self.top = self.stack[-1] if self.stack else ("", 0, None, False)

    def end(self, tags: frozenset | set, until: frozenset | set) -> None:
        """Close the innermost open element of these tags, if it stands before the given ones."""
        if any(self.open[t] > 0 for t in tags):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in tags:
                    self.flush()
                    return self.pop(i)
                if self.stack[i][0] in until:
                    return None
        return None

    def start_tag(self, tag: str, given: str) -> None:
        if tag in VOID:
            if tag == "hr":
                self.flush()
                self.end({"p"}, CONTAINERS)
            elif tag == "br":
                self.buffer.append(" ")
            return
        if tag in CLOSES_P:
            self.end({"p"}, CONTAINERS)
        if tag in ENDS:
            self.end(*ENDS[tag])
        _, path, mark, inside = self.top
        if tag in BLOCKS:
            self.flush()
            _, path, mark, inside = self.top
            given = attributes(given) if given else {}
            names = " ".join(given.get(x, "") for x in ("class", "id", "role"))
            words = sorted({w.lower() for w in TOKEN.findall(names)})
            role = given.get("role", "").lower()
            main = tag == "main" or role == "main"
            hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", given.get("style", ""), re.I) is not None
            if tag in NO_TEXT or tag in NO_ARTICLE or hidden or role in ("navigation", "search", "complementary", "contentinfo", "dialog") or tag == "header" and not inside:
                mark = Mark(mark, True)
            elif tag not in ("html", "body") and not main and (tag == "form" or any(w in WORDS for w in words) or STEMS.search(names.lower())):
                mark = Mark(mark, False)
            if main or tag == "h1":
                outer = mark
                while outer is not None:
                    outer.off = outer.off or not outer.firm
                    outer = outer.outer
            inside = inside or main or tag == "article"
            path = self.step(path, tag, ".".join(words), tag in FLOW, inside)
        self.stack.append((tag, path, mark, inside))
        self.open[tag] += 1
        self.top = self.stack[-1]

    def end_tag(self, tag: str) -> None:
        if tag == "p" and not self.open["p"] or tag == "br":
            self.flush() if tag == "p" else self.buffer.append(" ")
        elif tag in BLOCKS:
            group = HEADINGS if tag in HEADINGS else {tag}
            self.end(group, frozenset() if tag in CONTAINERS | NO_ARTICLE else {"article", "main", "body"})
        elif self.open[tag] > 0:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    return self.pop(i)
                if self.stack[i][0] in BLOCKS:
                    #: An inline element closed from inside a block stays open outside it.
                    return None
        return None

    def data(self, text: str) -> None:
        self.buffer.append(unescape(text) if "&" in text else text)
        if self.open["a"] > 0:
            self.linked += len(self.buffer[-1].strip())


def off(mark: Mark | None) -> bool:
    """Whether an element that isn't the article's holds a block."""
    while mark is not None:
        if not mark.off:
            return True
        mark = mark.outer
    return False


def chosen(page: Page) -> list[str]:
    """The blocks of the paths whose smoothed ratio reaches the threshold."""
    n = len(page.parents)
    rows = [(text, path, linked, inside) for text, path, linked, mark, inside in page.blocks if not off(mark)]
    within = sum(len(t) - linked for t, _, linked, inside in rows if inside)
    if within and within >= ARTICLE * sum(len(t) - linked for t, _, linked, _ in rows):
        rows = [r for r in rows if r[3]]
    free, marks, count, links = [0] * n, [0] * n, [0] * n, [0] * n
    for text, path, linked, _ in rows:
        free[path] += len(text) - linked
        links[path] += linked
        count[path] += 1
        marks[path] += len(MARKS.findall(text)) if linked < len(text) else 0
    own = list(free)
    #: A path's number is above its container's, so one walk down adds up what stands below each.
    below = [list(x) for x in (free, marks, count, links)]
    for i in range(n - 1, 0, -1):
        for x in below:
            x[page.parents[i]] += x[i]

    def ratio(chars: int, punctuation: int, blocks: int, linked: int) -> float:
        return chars / blocks * (1 + punctuation / blocks) * chars / (chars + linked) if chars and blocks else 0.0

    container = [0.0] * n
    score = [0.0] * n
    for i in range(n):
        parent = page.parents[i]
        whole = ratio(below[0][i], below[1][i], below[2][i], below[3][i])
        if parent < 0:
            container[i] = score[i] = whole
            continue
        menu = below[3][i] > LINKS * (below[0][i] + below[3][i]) and not page.inside[i]
        share = 0.0 if menu else SHARES[0] if page.flows[i] else SHARES[1] if page.inside[i] and page.inside[parent] else SHARES[2]
        container[i] = (1 - share) * whole + share * container[parent]
        direct = ratio(free[i], marks[i], count[i], links[i])
        score[i] = container[i] if not page.flows[i] else (1 - share) * direct + share * container[parent]
    total = sum(own)
    if not total:
        return []
    least = THRESHOLD * sum(s * c for s, c in zip(score, own, strict=True)) / total
    return [text for text, path, _, _ in rows if score[path] >= least]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    return "\n".join(chosen(Page(html)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page, empty if it has none, and its code points."""
    kinds = [pages.schema[c].dataType for c in (id_col, url_col)]
    schema = f"page_id {kinds[0].simpleString()}, url {kinds[1].simpleString()}, text string, n_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

        for batch in batches:
            start, size, texts = 0, 0, []
            for i in range(batch.num_rows):
                html = batch.column(2)[i].as_py()
                texts.append(main_text(html))
                size += len(html or "")
                if size > AT_ONCE:
                    yield out(batch.slice(start, len(texts)), texts)
                    start, size, texts = i + 1, 0, []
            yield out(batch.slice(start, len(texts)), texts)

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, schema)
