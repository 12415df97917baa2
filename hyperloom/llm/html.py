"""Main text of web pages by consensus of each host's paths.

One site renders its articles by one template, so its pages agree on where the
article is even where a single page misleads. Every page weighs the text below
its containers and votes for the smallest one that holds nearly all of it, under
a generalised path of tag and class names (numbers folded). The votes are summed
per host, and every page is extracted again at its host's winning path, or at its
own choice where that path is missing or empty.

Elements that can't hold an article (navigation, scripts, ...) are dropped as
they are read. A class, id or role that sounds like a menu, notice or the like is
only a mark: text below it weighs less, and it is dropped only below the chosen
container, and not if it holds most of that container's text. So wrappers such
as ``layout with-sidebar`` lose nothing.

Defined cases: a null or empty page gives an empty text; pages without a host
vote together; ties go to the smaller path; repeated rows vote and are extracted
one by one; broken markup is read as far as it goes (open elements end with the
page, stray end tags and quotes are skipped) in time linear in its length; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, slices, table

#: Hosts up to this many travel as one broadcast table of winners (two numbers and a name each).
MOST_BROADCAST_HOSTS = 50_000
#: A container is chosen if it holds this share of the weighted text; below a ``main`` it must hold more.
SHARE, SHARE_OF_MAIN = 0.95, 0.99
#: Articles are chosen if they hold this share of the text.
ARTICLE_SHARE = 0.25
#: Weights of marked text, of reader comments and of links; of paragraphs and the like against bare text.
MARKED_WEIGHT, COMMENT_WEIGHT, LINK_WEIGHT, PROSE_WEIGHT = 1 / 8, 1 / 512, 1 / 16, 4.0
#: The first top heading weighs this share of all text at least: its container is the article's.
HEADING_SHARE = 0.1
#: A marked element with this share of itself and all unmarked text isn't marked.
RESCUED_SHARE, MOST_RESCUED = 0.9, 16
#: Tags that end nowhere before only the next ">" is looked for.
MOST_BROKEN = 8

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BOILERPLATE = frozenset(
    "nav footer aside script style noscript template iframe svg math button select option textarea input dialog menu head title object embed canvas audio video map label fieldset xmp noembed noframes datalist".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul br".split()
)
CONTAINERS = frozenset("body div section article main td center".split())
ENDS_P = BLOCKS - {"br", "body", "html", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OWN_KIND = {"li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
# Name parts of classes, ids and roles that mark what is no article.
NOT_ARTICLE = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer foot header masthead topbar ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup social share sharing related recommended recommendations comment comments disqus respond replies reply login search searchbox widget widgets toolbar pagination pager skip complementary contentinfo dialog".split()
)
COMMENTARY = frozenset("comment comments disqus respond replies reply".split())
CHECKED = frozenset("div section ul ol p table dl span figure header article center td a form".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split())
#: Parts of a class name that say something is absent, or an option of the whole page.
OPTIONS = frozenset("has with without no not non is free open closed enabled disabled on off ready count layout".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRS = re.compile(r"""[^>"'<]*""")
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
PARTS = re.compile(r"[a-z]+|\d+")
HUGE_REFERENCE = re.compile(r"&#(?:\d{8,}|[xX][0-9a-fA-F]{8,});?")

NORMAL, DROPPED, HEADED = 0, 1, 2


def _parse_marks(tag: str, attrs: str) -> tuple[str, frozenset[str]]:
    """The element's label in a path, and those name parts of its class, id and role that mark no article."""
    label, found = tag, set()
    for m in NAMES.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        for token in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
            parts = set(PARTS.findall(token))
            if not parts & OPTIONS:
                found |= parts & NOT_ARTICLE
        if m[1].lower() == "class":
            label += "".join("." + re.sub(r"\d+", "#", c) for c in sorted(set(value.lower().split())))
    return label, frozenset(found)


_short_marks = lru_cache(4096)(_parse_marks)


def _marks(tag: str, attrs: str) -> tuple[str, frozenset[str]]:
    return _short_marks(tag, attrs) if len(attrs) < 500 else _parse_marks(tag, attrs)


def _decode(s: str) -> str:
    try:
        return unescape(s)
    except ValueError:  # a number of thousands of digits
        return unescape(HUGE_REFERENCE.sub("\ufffd", s))


class Open:
    """The open elements: a stack with the places of every name, so that each step takes constant time."""

    def __init__(self):
        self.names, self.ids, self.blocks = ["#"], [0], []
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, k: int) -> None:
        self.places.setdefault(tag, []).append(len(self.names))
        if tag in BLOCKS:
            self.blocks.append(len(self.names))
        self.names.append(tag)
        self.ids.append(k)

    def last(self, tag: str) -> int:
        at = self.places.get(tag)
        return at[-1] if at else 0

    def cut(self, at: int) -> None:
        while len(self.names) > at:
            tag = self.names.pop()
            self.ids.pop()
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def close(self, tag: str) -> None:
        """An end tag; that of no block ends nothing beyond a block."""
        at = self.last(tag)
        if at and (tag in BLOCKS or not self.blocks or self.blocks[-1] < at):
            self.cut(at)

    def end(self, tag: str, stops: tuple[str, ...]) -> None:
        """An implied end of ``tag``, unless one of ``stops`` is nearer."""
        at = self.last(tag)
        if at and not any(self.last(x) > at for x in stops):
            self.cut(at)


P_STOPS = tuple("article section div td th li body main button object table".split())


class Page:
    """The nodes and text pieces of a page. Piece (node, None) is a block boundary."""

    def __init__(self, html: str):
        self.tag, self.path, self.label, self.holder, self.article = ["#"], [0], [""], [0], [-1]
        self.parent, self.mode, self.linked, self.headed = [0], [NORMAL], [False], [False]
        #: Of each node: whether it is marked itself; the weight of text in it; whether it is prose or below a main.
        self.marked, self.weight, self.prose, self.in_main = [False], [1.0], [False], [False]
        self.comment = [False]
        self.pieces: list[tuple[int, str | None]] = []
        self._read(html)
        self.sizes = [0 if s is None else len(s) - s.count(" ") if s.strip() else 0 for _, s in self.pieces]
        if any(self.marked):
            for _ in range(MOST_RESCUED):
                if not self._rescue():
                    break

    def _open(self, tag: str, attrs: str, up: int) -> int:
        k = len(self.path)
        mode = self.mode[up]
        inside = self.article[up]
        label, path, holder = "", self.path[up], self.holder[up]
        parts: frozenset[str] = frozenset()
        marked = comment = False
        if tag in CHECKED or tag in CONTAINERS:
            label, parts = _marks(tag, attrs) if "=" in attrs else (tag, parts)
        if tag in BOILERPLATE:
            mode = DROPPED
        elif tag == "header":
            mode = DROPPED if mode == DROPPED or inside < 0 else HEADED
        elif tag == "form":
            marked = True
        elif tag not in ("body", "main") and parts:
            comment = bool(parts & COMMENTARY)
            if tag in ("article", "span", "a"):
                marked = comment or tag != "article" and bool(parts & {"ad", "ads", "advert"})
            elif parts == {"header"} and inside >= 0 and mode != DROPPED:
                mode = HEADED
            else:
                marked = True
        if tag in CONTAINERS or tag == "form":
            path = xxhash.xxh3_64_intdigest(f"{path}>{label}") >> 1
            holder = k
        self.tag.append(tag)
        self.path.append(path)
        self.label.append(label)
        self.holder.append(holder)
        self.article.append(k if tag == "article" and inside < 0 and mode != DROPPED and not comment else inside)
        self.parent.append(up)
        self.mode.append(mode)
        self.linked.append(self.linked[up] or tag == "a")
        self.headed.append(self.headed[up] or tag in HEADINGS)
        self.marked.append(marked)
        self.comment.append(comment)
        self.weight.append(self._weight(up, marked, comment))
        self.prose.append(self.prose[up] or tag in PROSE)
        self.in_main.append(self.in_main[up] or tag == "main")
        return k

    def _tag_end(self, html: str, at: int, last: dict[str, int]) -> int:
        """Where the ">" of a tag is whose attributes begin at ``at``, outside of quotes; -1 if it ends nowhere."""
        n = len(html)
        while True:
            at = ATTRS.match(html, at).end()
            if at == n:
                return -1
            c = html[at]
            if c == ">":
                return at
            if c == "<" or at >= last[c]:
                return -1
            at = html.find(c, at + 1) + 1

    def _read(self, html: str) -> None:
        stack = Open()
        pieces, mode = self.pieces, self.mode
        at, n, text_from, broken = 0, len(html), 0, 0
        last = {q: html.rfind(q) for q in ('"', "'")}
        last_gt = html.rfind(">")

        def text(stop: int) -> None:
            top = stack.ids[-1]
            if stop > text_from and (mode[top] == NORMAL or mode[top] == HEADED and self.headed[top]):
                pieces.append((top, html[text_from:stop]))

        while True:
            here = html.find("<", at)
            if here < 0 or here + 1 >= n:
                text(n)
                return
            c = html[here + 1]
            if c == "!" or c == "?":
                if html.startswith("<!--", here):
                    if html.startswith(("<!-->", "<!--->"), here):
                        end = html.find(">", here)
                    else:
                        ends = [html.find(x, here + 4) for x in ("-->", "--!>")] if html.find("--!>", here + 4, here + 4096) >= 0 else [html.find("-->", here + 4)]
                        ends = [e for e in ends if e >= 0]
                        end = html.find(">", min(ends)) if ends else n
                else:
                    end = html.find(">", here) if last_gt > here else n
                text(here)
                at = text_from = end + 1
                if at > n:
                    return
                continue
            closing = c == "/"
            m = NAME.match(html, here + 1 + closing)
            if not m:
                at = here + 1
                continue
            end = self._tag_end(html, m.end(), last) if broken < MOST_BROKEN else -1
            if end < 0:
                broken += 1
                if last_gt < m.end():  # nothing ends any more
                    text(here)
                    return
                end = html.find(">", m.end())
                following = html.find("<", m.end(), end)
                if following >= 0:  # the tag breaks off where the next one begins
                    end = following - 1
            text(here)
            at = text_from = end + 1
            tag = m[0].lower()
            if tag in BLOCKS:
                pieces.append((stack.ids[-1], None))
            if closing:
                stack.close(tag)
                continue
            attrs = html[m.end() : end]
            if tag in RAW:
                found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                at = n
                if found:
                    close = html.find(">", found.start())
                    at = close + 1 if close >= 0 else n
                text_from = at
                continue
            if tag in VOID:
                continue
            if tag in ENDS_P:
                stack.end("p", P_STOPS)
            if tag in OWN_KIND:
                kind, stop = OWN_KIND[tag]
                for x in kind.split():
                    stack.end(x, tuple(stop.split()))
            if attrs.endswith("/") and tag in ("svg", "path"):
                continue
            stack.push(tag, self._open(tag, attrs, stack.ids[-1]))

    def _below(self, amount: list[float]) -> list[float]:
        """Amounts by node, summed up into every ancestor."""
        out = list(amount)
        for k in range(len(out) - 1, 0, -1):
            out[self.parent[k]] += out[k]
        return out

    def _weight(self, up: int, marked: bool, comment: bool) -> float:
        return min(self.weight[up], COMMENT_WEIGHT if comment else MARKED_WEIGHT if marked else 1.0)

    def _rescue(self) -> bool:
        """Void the mark of an outermost marked element beside which there is hardly any text, if it
        holds or is in an article or main, or has paragraphs where the page has neither."""
        n = len(self.path)
        bodies = [float(t == "main" or t == "article" and self.article[k] == k) for k, t in enumerate(self.tag)]
        prose, unmarked = [0.0] * n, 0.0
        top, inside = [0] * n, [False] * n
        for k in range(1, n):
            up = self.parent[k]
            top[k] = top[up] or (k if self.marked[k] else 0)
            inside[k] = inside[up] or bodies[k] > 0
        for (k, _), size in zip(self.pieces, self.sizes, strict=True):
            if size and not self.linked[k]:
                w = size * (PROSE_WEIGHT if self.prose[k] else 1.0)
                if top[k]:
                    prose[k] += w if self.prose[k] else 0.0
                else:
                    unmarked += w
        prose, holds = self._below(prose), self._below(bodies)
        found = [k for k in range(1, n) if top[k] == k and prose[k] and (holds[k] if self.comment[k] else not holds[0] or holds[k] or inside[k])]
        k = max(found, key=lambda k: (not self.comment[k], prose[k], -k), default=0)
        if not k or prose[k] < RESCUED_SHARE * (unmarked + prose[k]):
            return False
        self.marked[k] = self.comment[k] = False
        for j in range(k, n):
            self.weight[j] = self._weight(self.parent[j], self.marked[j], self.comment[j])
        return True

    def weights(self) -> tuple[list[float], bool]:
        """The weight of the text in each node itself, and whether articles hold it."""
        out, in_articles, total = [0.0] * len(self.path), 0.0, 0.0
        heading = None
        for (k, _), size in zip(self.pieces, self.sizes, strict=True):
            if size:
                w = size * self.weight[k] * (PROSE_WEIGHT if self.prose[k] else 1.0) * (LINK_WEIGHT if self.linked[k] else 1.0)
                out[k] += w
                total += w
                if self.article[k] >= 0:
                    in_articles += w
                if heading is None and self.headed[k] and not self.linked[k] and self.weight[k] == 1.0 and self._under(k, "h1"):
                    heading = k
        if total and in_articles >= ARTICLE_SHARE * total:
            return [w if self.article[k] >= 0 else 0.0 for k, w in enumerate(out)], True
        if heading is not None:
            out[heading] += HEADING_SHARE * total
        return out, False

    def _under(self, k: int, tag: str) -> bool:
        while k and self.tag[k] not in CONTAINERS:
            if self.tag[k] == tag:
                return True
            k = self.parent[k]
        return False

    def choice(self) -> tuple[int, str] | None:
        """(path, label) of the smallest container that holds nearly all of the page's weighted text."""
        own, articles = self.weights()
        total = sum(own)
        if not total:
            return None
        below = self._below(own)
        by_path: dict[int, list] = {}
        for k, w in enumerate(below):
            if w and self.weight[k] == 1.0 and self.holder[k] == k and (not articles or self.article[k] == k or self.article[k] < 0):
                e = by_path.setdefault(self.path[k], [0.0, k])
                e[0] += w
        enough = [(w, p, k) for p, (w, k) in by_path.items() if w >= total * (SHARE_OF_MAIN if self.in_main[k] else SHARE)]
        # Of nested ones the innermost: the latest to open among those with the least text.
        w, p, k = min(enough, key=lambda x: (-x[2], x[0]))
        return p, self.label[k]

    def text(self, path: int | None) -> str:
        """The text below the containers with this path, or below the page's own choice."""
        found = self._text(path) if path is not None else ""
        if not found and (mine := self.choice()) is not None and mine[0] != path:
            found = self._text(mine[0])
        return found

    def _text(self, path: int) -> str:
        below = [False] * len(self.path)
        for k in range(len(below)):
            chosen = self.path[k] == path and self.holder[k] == k
            below[k] = chosen or k > 0 and below[self.parent[k]] and not self.marked[k]
        out = []
        for k, s in self.pieces:
            if below[k]:
                out.append(" " if s is None else _decode(s) if "&" in s else s)
        return " ".join("".join(out).split())


def host_of(url: Column) -> Column:
    at = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(at)


def host_paths(pages: DataFrame) -> DataFrame:
    """From (host, html): the winning path per host as (host, path, label, votes)."""

    def run(batches):
        for batch in slices(batches):
            rows = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chosen = Page(html).choice() if html else None
                if chosen:
                    rows.append((host, *chosen, 1))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["host", "path", "label", "share"]
                )

    votes = pages.select("host", "html").mapInArrow(run, "host string, path long, label string, share long")
    sums = votes.groupBy("host", "path").agg(F.max("label").alias("label"), F.sum("share").alias("votes"))
    best = F.max(F.struct("votes", (-F.col("path")).alias("neg"), "label"))
    return sums.groupBy("host").agg(best.alias("b")).select("host", (-F.col("b.neg")).alias("path"), F.col("b.label").alias("label"), F.col("b.votes").alias("votes"))


def extract(pages: DataFrame, page_id="page_id", url="url", html="html") -> DataFrame:
    """Rows (page_id, url, text, host_path): the main text of every page."""
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html"))
    # Written first: a join of two shuffles can split a host of very many pages.
    winners = durable(host_paths(rows).select(F.col("host").alias("w_host"), "path", "label"))
    few = winners.limit(MOST_BROADCAST_HOSTS + 1).count() <= MOST_BROADCAST_HOSTS
    both = rows.join(F.broadcast(winners) if few else winners, F.col("host") == F.col("w_host"), "left").select("page_id", "url", "label", "path", "html")

    def run(batches):
        for batch in slices(batches):
            texts = [Page(h).text(p) if h else "" for p, h in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], ["page_id", "url", "host_path", "text"])

    kind = both.schema["page_id"].dataType.simpleString()
    return both.mapInArrow(run, f"page_id {kind}, url string, host_path string, text string")


def op8_html_extract(spark, sf_dir: str) -> DataFrame:
    df = extract(table(spark, sf_dir, "pages"))
    return df.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "host_path")
