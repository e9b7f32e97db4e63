"""Main-text extraction by consensus host paths.

Each page scores its containers (div, section, article, main, td, body) by the text of the blocks that stand in
them, less their link text, and takes the best. As that may be the body of an article beside its heading, the
article or main element around it stands for it, or else the nearest container with text of its own. It is named
by its generalised path: tags with their classes, digits generalised. The pages of a host vote in Spark; a page is
then read again through the winning path of its host, or through its own best container where it has none on that
path.

Left out: scripts, styles, markup and comments of the source; menus, page headers, footers, sidebars, notices,
adverts, forms and reader comments, known by tag, role or the words in class and id. A header inside an article
stays, as it holds the title. Words that also name kinds of text (search, share, related, ...) decide inside an article
only together with what the element holds: short texts or links. Everything else in the container is kept, in page order.

Votes combine on the map side, so a host with a third of all pages is one number a task; the winners, one row a
host, are broadcast when few and joined otherwise.

Reading a page takes time and memory in proportion to its length, however deep its elements lie.

Defined cases: a null or empty html, or one without text, gives an empty text; very long pages are read whole;
unclosed, stray and misnested tags are tolerated; repeated rows are pages of their own; a null url votes with
the other null urls; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut

# fixed values: HTML element names and words of class names
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg canvas object select".split())
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CONTAINER = set("article body div main section td".split())
BREAKS = BLOCK | CONTAINER
DROPPED = set("aside button dialog footer form head input menu nav option".split()) | RAW
BAD_WORDS = set("ad ads breadcrumb breadcrumbs consent gdpr legal login masthead menu modal nav navbar navigation notice pager pagination popup reactions replies reply respond signup subscribe toolbar".split())
BAD_WORDS |= set("advert adverts advertisement advertising advertorial comment comments commentlist commenter commentform cookie cookies cookiebar newsletter newsletters sidebar sidebars sponsor sponsored sponsors".split())
#: Words that name a part beside the text, but also kinds of text: inside an article they need evidence.
WEAK_WORDS = set("alert banner label promo recommended related search share sharing skip social tags widget".split())
BAD_STARTS = ("disqus",)
#: Names of text itself, which no class word turns into something else.
PROSE = set("figcaption h1 h2 h3 h4 h5 h6 label blockquote pre dt dd".split())
BAD_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
GOOD_WORDS = set("article content entry main post story text body".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("article aside body div dl fieldset footer form header html main nav ol section table td th ul".split())

#: Characters from which on text in a doubted element is prose.
PROSE_CHARS = 200

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[^a-z]+")
#: Of what an element has beside it or lacks, its class speaks too: has-sidebar, with_ads, no-comments.
_BESIDE = re.compile(r"\b(?:has|with|without|no)[-_][\w-]*")


def _attributes(source: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(source)} if "=" in source else {}


class Node:
    """An open element."""

    __slots__ = ("tag", "label", "bad", "doubted", "container", "path", "since")

    def __init__(self, tag: str, source: str, inside: bool):
        at = _attributes(source)
        named = f"{at.get('class', '')} {at.get('id', '')}".lower()
        words = set(_WORDS.split(_BESIDE.sub(" ", named)))
        classes = sorted(_DIGITS.sub("0", x).replace("/", "_") for x in at.get("class", "").lower().split())
        self.tag, self.label = tag, ".".join([tag, *classes])
        bad = tag in DROPPED or at.get("role", "").lower() in BAD_ROLES or at.get("aria-hidden") == "true"
        told = bool(words & BAD_WORDS) or any(w.startswith(BAD_STARTS) for w in words)
        bad = bad or (told and not (inside and tag in PROSE))
        weak = bool(words & WEAK_WORDS)
        bad = bad or (weak and (not inside or tag in ("a", "span")))
        self.doubted = weak and not bad and tag in BREAKS and tag not in PROSE
        bad = bad or "hidden" in _DIGITS.sub("", source.replace("=", " ")).lower().split() or "display:none" in at.get("style", "").replace(" ", "").lower()
        # a header or footer is the page's own unless it belongs to an article; so is what is named one
        bad = bad or (tag == "header" and not inside) or bool(words & {"header", "footer"}) and not (inside or words & GOOD_WORDS)
        self.bad = bad and tag not in ("html", "body", "main")
        self.container = self.path = -1
        self.since = 0  # blocks that came before it


class Page:
    """The blocks of a page in order, and its containers.

    What is kept grows with the page alone: a step of a path is its label and the step above, a block knows its
    innermost container, and what is open is counted as it opens and closes, so no tag looks through the others.
    """

    def __init__(self, source: str | None):
        self.steps: list[tuple[int, str]] = []  # steps of paths: the one above, label
        self.hashes: list[int] = []  # of the path that ends in a step
        self.ends: list[int] = []  # containers: the step that their path ends in
        self.parents: list[int] = []
        self.score: list[float] = []
        self.own: list[float] = []  # scores without those of inner containers
        self.blocks: list[tuple[int, str]] = []  # innermost container or -1, text
        self._worth: list[tuple[int, int]] = []  # of each block the length of its links, and what it adds to the score
        self._stack: list[Node] = []
        self._at: dict[str, list[int]] = {}  # places in the stack by tag
        self._scopes: list[int] = []  # places of elements that end the search for an open one
        self._containers: list[int] = []  # numbers of the open ones
        self._paths: list[int] = []  # steps of the open elements that make paths
        self._n_bad = 0
        self._unclosed: set[str] = set()  # raw elements whose end the rest of the page doesn't hold
        self._text: list[str] = []
        self._linked = 0
        self._read(source or "")

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text = []
        linked, self._linked = self._linked, 0
        if not text:
            return
        inside = self._containers[-1] if self._containers else -1
        self.blocks.append((inside, text))
        self._worth.append((linked, max(0, len(text) - 2 * linked) + 20 * text.count(",")))
        if inside >= 0:
            self.score[inside] += self._worth[-1][1]

    def _judge(self, node: Node) -> None:
        """Takes back the blocks of an element that its name casts doubt on, unless they are prose: long, and mostly not links."""
        held = self.blocks[node.since :]
        size, linked = sum(len(t) for _, t in held), sum(n for n, _ in self._worth[node.since :])
        if size >= PROSE_CHARS and 4 * linked <= size:
            return
        for (inside, _), (_, worth) in zip(held, self._worth[node.since :]):
            if inside >= 0:
                self.score[inside] -= worth
        del self.blocks[node.since :], self._worth[node.since :]

    def _last(self, tag: str) -> int:
        """Place of the innermost open element of a tag, or -1."""
        return places[-1] if (places := self._at.get(tag)) else -1

    def _push(self, node: Node) -> None:
        if node.doubted:
            self._flush()  # what came before is not its own
        place = len(self._stack)
        node.since = len(self.blocks)
        self._stack.append(node)
        self._at.setdefault(node.tag, []).append(place)
        if node.tag in SCOPES:
            self._scopes.append(place)
        self._n_bad += node.bad
        if node.tag in BREAKS:
            above = self._paths[-1] if self._paths else -1
            node.path = len(self.steps)
            self.steps.append((above, node.label))
            self.hashes.append(hash((self.hashes[above] if above >= 0 else 0, node.label)))
            self._paths.append(node.path)
        if node.tag in CONTAINER:
            node.container = len(self.ends)
            self.ends.append(node.path)
            self.parents.append(self._containers[-1] if self._containers else -1)
            self.score.append(0.0)
            self._containers.append(node.container)

    def _pop(self, to: int) -> None:
        """Close all elements from place `to` of the stack on."""
        closed = self._stack[to:]
        if any(n.tag in BREAKS or n.doubted for n in closed):
            self._flush()
        for n in reversed(closed):
            if n.doubted:
                self._judge(n)
            self._at[n.tag].pop()
            if n.tag in SCOPES:
                self._scopes.pop()
            self._n_bad -= n.bad
            if n.path >= 0:
                self._paths.pop()
            if n.container >= 0:
                self._containers.pop()
        del self._stack[to:]

    def _open(self, tag: str, source: str) -> None:
        if tag in BREAKS:
            self._flush()
            if (k := self._last("p")) > (self._scopes[-1] if self._scopes else -1):
                self._pop(k)
        if tag in CLOSED_BY:
            also = CLOSED_BY[tag]
            n = len(self._scopes)
            while n and self._stack[self._scopes[n - 1]].tag in also:
                n -= 1
            scope = self._scopes[n - 1] if n else -1
            found = [places[k] for t in also if (places := self._at.get(t)) and (k := bisect_right(places, scope)) < len(places)]
            if found:
                self._pop(min(found))
        self._push(Node(tag, source, bool(self._at.get("article") or self._at.get("main"))))

    def _close(self, tag: str) -> None:
        k = self._last(tag)
        if k >= 0 and (tag in BLOCK or not self._scopes or k >= self._scopes[-1]):
            self._pop(k)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while m := _TOKEN.search(source, at):
            if m.start() > at and not self._n_bad:
                self._add(source[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag, closing, rest = tag.lower(), m[1] or m[4], m[3] if m[2] else m[6]
            if closing:
                self._close(tag)
            elif tag in VOID:
                if tag == "br" and not self._n_bad:
                    self._text.append(" ")
                elif tag == "hr":
                    self._flush()
            elif tag in RAW:
                shut = None if tag in self._unclosed else re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                if shut:
                    at = shut.end()
                elif tag in ("script", "style"):
                    at = end
                else:
                    self._unclosed.add(tag)
            elif not rest.endswith("/") or tag in BLOCK:
                self._open(tag, rest)
                if tag in ("td", "th"):
                    self._text.append(" ")
        if at < end and not self._n_bad:
            self._add(source[at:])
        self._pop(0)  # what the page left open
        self._flush()
        self.own = list(self.score)
        for k in range(len(self.score) - 1, 0, -1):
            if self.parents[k] >= 0:
                self.score[self.parents[k]] += self.score[k] / 2

    def _add(self, raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self._text.append(text)
        if self._at.get("a"):
            self._linked += len(text.strip())

    def _label(self, k: int) -> str:
        return self.steps[self.ends[k]][1]

    def path(self, k: int) -> str:
        """The generalised path of a container."""
        step, labels = self.ends[k], []
        while step >= 0:
            step, label = self.steps[step]
            labels.append(label)
        return "/".join(reversed(labels))

    def best(self) -> int | None:
        """The container of the greatest score, of equal ones the first, or what holds it as a part."""
        k = max(range(len(self.score)), key=lambda k: (self.score[k] * (1.5 if self._named(k) else 1), -k), default=None)
        return self._whole(k) if k is not None and self.score[k] > 0 else None

    def best_path(self) -> str | None:
        k = self.best()
        return None if k is None else self.path(k)

    def _whole(self, k: int) -> int:
        """The outermost article around a container, else its main; else the nearest with text of its own beside it."""
        above = [k]
        while (up := self.parents[above[-1]]) >= 0:
            above.append(up)
        tags = [self._label(a).split(".")[0] for a in above]
        for tag in ("article", "main"):
            if tag in tags:
                return above[len(tags) - 1 - tags[::-1].index(tag)]
        return next((a for a in above[1:] if self.own[a] > 0), k)

    def _named(self, k: int) -> bool:
        label = self._label(k)
        return label.startswith(("article", "main")) or bool(set(_WORDS.split(label)) & GOOD_WORDS)

    def _inside(self, chosen: set[int]) -> list[str]:
        """The blocks in some chosen container; a container comes after the one that holds it."""
        held = [False] * len(self.ends)
        for k, up in enumerate(self.parents):
            held[k] = k in chosen or (up >= 0 and held[up])
        return [t for k, t in self.blocks if k >= 0 and held[k]]

    def text(self, path: str | None) -> str:
        """The blocks in the containers of that path; else in the best container; else all."""
        found: list[str] = []
        if path is not None:
            want = 0
            for label in path.split("/"):
                want = hash((want, label))
            found = self._inside({k for k, step in enumerate(self.ends) if self.hashes[step] == want})
        if not found and (k := self.best()) is not None:
            found = self._inside({k})
        return "\n\n".join(found or [t for _, t in self.blocks])


def _rows(column):
    for at in range(0, len(column), 128):
        yield from column.slice(at, 128).to_pylist()


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, path) for each row of pages."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    hosted = pages.select("page_id", "url", host.alias("host"), "html")

    def vote(batches):
        for b in batches:
            best = []
            for source in _rows(b.column(1)):
                best.append(Page(source).best_path())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string())], ["host", "path"])

    votes = hosted.select("host", "html").mapInArrow(vote, "host string, path string").where(F.col("path").isNotNull())
    counts = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    winners = cut(counts.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("n"), "path")).alias("x")).select(F.col("host").alias("_host"), F.col("x.path").alias("path")))

    def read(batches):
        for b in batches:
            paths, texts = b.column(3).to_pylist(), []
            for source, path in zip(_rows(b.column(2)), paths):
                texts.append(Page(source).text(path))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), b.column(3)], ["page_id", "url", "text", "path"])

    joined = hosted.join(broadcast_if_small(winners), F.col("host") == F.col("_host"), "left").select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", "path")
    return joined.mapInArrow(read, "page_id long, url string, text string, path string")


def op8(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")
