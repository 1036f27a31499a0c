"""HTML extraction by consensus host paths.

A page is cut into blocks of text, each with its path of generalised containers:
`tag.class` steps in which digits are folded and only block-level tags count. Every
page scores its containers (text outside links, punctuation and paragraphs speak for
one, links and short blocks against it) and gives one vote to its best path; Spark adds
the votes of each host, and the path with the most votes is used to extract all pages of
that host. A page that lacks the winning path is extracted with its own best path.

Votes are added up within tasks first, so a host with a third of all pages costs one
row per task and path. The winning paths, one short row per host, are counted: as long
as they are few they go to all executors and no page is moved; beyond that they are
joined by host and salt, so that a large host's pages are spread over many tasks.

Elements named like what is not the article, and forms, are left out. A name counts if the
whole class, id or role says so (`comments`, `cookie-notice`, `sidebar-2`, not
`search-algorithm`); outside article and main elements one plain word of it (`ad`,
`newsletter`) is enough. Inside them words with other meanings (`warning`, `tags`, `legal`)
drop an element only if most of its text is linked. An element that holds more than half of
the page's text outside links is the page's frame, whatever its name, and stays, while
others inside it still go; but where the page has text in an article or main element outside
all of them, only one inside such an element can be a frame.

Containers of any depth count, with all their classes: a page's paths are a tree, in which
scores are added up from the leaves, so deep pages are read in linear time too.

A null or empty page gives an empty text; a page without host forms the host "".
Ties between paths go to the longer vote score and then to the smaller path. Repeated
rows vote again and each is extracted. Other columns are ignored; an empty table gives
an empty result. Unclosed tags end with their parent; very long pages are read in
linear time.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_TAG = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|([!?][^>]*)>)", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_RAW_END = {t: re.compile(rf"</{t}\s*>|</{t}\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes")}

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content of these is never text of the page's body.
_DROPPED = frozenset("script style head title noscript template iframe svg math canvas object audio video select option button textarea input form nav header footer aside menu dialog label fieldset datalist map".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul br".split())
_CONTAINER = frozenset("article main section div body td blockquote center".split())
#: A new one of these ends an open one of the second group.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = _BLOCK - {"br"}
_STOPS = frozenset("table ul ol dl div article section body html main blockquote td th".split())
#: Words in class, id or role that name what is not the article; outside of one, a single word of a longer name is enough.
_PLAIN = frozenset(
    "ad ads adbox adslot adunit adsense adsbygoogle advert adverts advertisement advertisements advertising advertorial banner banners promo promos sponsor sponsored sponsors "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars masthead topbar cookie cookies consent gdpr popup popups modal modals newsletter "
    "subscribe subscription signup login sharebar comment comments commenting commentlist disqus pagination pager toolbar footer footers contentinfo complementary alertdialog outbrain taboola paywall".split()
)
#: The same, but the whole name must say so.
_WHOLE = frozenset("notice notices notification notifications announcement announcements alert alerts related recommended recommendations share sharing social promotion promoted widget widgets copyright teaser teasers dialog respond replies".split())
#: Words that name such parts too, but have other meanings in an article.
_DOUBTFUL = frozenset("rail foot warning disclaimer disclaimers overlay recommend reply response responses discussion skip tag tags tagcloud search form forms hidden legal toc".split())
#: Words of a name that say nothing of the content.
_LAYOUT = frozenset(
    "area bar block body bottom box btn button buttons card cards cell center cloud col column component container content desktop element fixed float frame global grid group head heading holder icon icons inline inner item items label large "
    "layer left line link links list main mini mobile module outer page panel placeholder position post posts primary reader readers region right row secondary section side single site slot small space sticky strip tab tabs text thread title top unit user users view wide wrap wrapper zone by for in of on the to".split()
)
#: Words that say how an element stands to a sidebar, header or the like which it is not.
_STATE = frozenset("no not non has have with without hide hides".split())
_HEADERS = frozenset(("header", "headers"))
#: A header that these words name is the article's.
_ARTICLE = frozenset("article content entry post story text body".split())
_PARTS = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_MAIN_WORD = re.compile(r"(?:^|[^a-z])(?:article|content|main|post|story|entry|text|body|prose)(?:$|[^a-z])")
_SPACE = re.compile(r"[ \t\n\r\f\v\x1c-\x1f\x85   -     　]+")
_DIGITS = re.compile(r"[0-9]+")


class Tree:
    """The container paths of a page: numbered nodes, parents before children; 0 is the root, outside any container."""

    __slots__ = ("parent", "step", "children")

    def __init__(self):
        self.parent, self.step = [0], [""]
        self.children: dict[tuple[int, str], int] = {}

    def below(self, node: int, step: str) -> int:
        """The child of a node by its step; equal paths are one node."""
        at = self.children.setdefault((node, step), len(self.parent))
        if at == len(self.parent):
            self.parent.append(node)
            self.step.append(step)
        return at

    def path(self, node: int) -> str:
        out = []
        while node:
            out.append(self.step[node])
            node = self.parent[node]
        return "/".join(reversed(out))

    def find(self, path: str) -> int | None:
        node = 0
        for step in path.split("/"):
            if (node := self.children.get((node, step))) is None:
                return None
        return node

    def inside(self, top: int) -> list[bool]:
        """For each node whether it is top or below it."""
        out = []
        for node, up in enumerate(self.parent):
            out.append(node == top or node > 0 and out[up])
        return out


class Block:
    __slots__ = ("tree", "node", "text", "linked", "tag")

    def __init__(self, tree: Tree, node: int, text: str, linked: int, tag: str):
        self.tree, self.node, self.text, self.linked, self.tag = tree, node, text, linked, tag


def _step(tag: str, attrs: dict[str, str]) -> str:
    """tag.class of a container with digits folded and classes in order of name."""
    names = sorted({_DIGITS.sub("#", x) for x in attrs.get("class", "").lower().split()})
    if not names and attrs.get("id"):
        names = [_DIGITS.sub("#", attrs["id"].lower())]
    return ".".join([tag, *names]).replace("/", "|")


def _attributes(s: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTR.finditer(s)))} if "=" in s or "hidden" in s else {}


def _named(name: str, within: bool) -> int:
    """What one class, id or role says: 0 nothing, 2 that the element is no part of the article, 3 that it may not be."""
    parts = [x for x in _PARTS.findall(_CAMEL.sub("-", name).lower()) if not x.isdigit()]
    if not parts or not _STATE.isdisjoint(parts):
        return 0
    whole = all(x in _PLAIN or x in _WHOLE or x in _DOUBTFUL or x in _HEADERS or x in _LAYOUT or len(x) == 1 for x in parts)
    if not _PLAIN.isdisjoint(parts) and (whole or not within) or whole and not _WHOLE.isdisjoint(parts):
        return 2
    if whole and not _HEADERS.isdisjoint(parts) and not within and _ARTICLE.isdisjoint(parts):
        return 2
    if whole and not _DOUBTFUL.isdisjoint(parts):
        return 3 if within else 2
    return 0


def _unwanted(tag: str, attrs: dict[str, str], within: int) -> int:
    """0 for a wanted element, 1 for one that always goes, 2 for one that goes unless it holds most of the page, 3 for one that goes if most of it is linked.

    within: open article or main elements, whose own headers hold the title.
    """
    if tag in _DROPPED and tag != "form" and not (tag == "header" and within):
        return 1
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return 1
    if tag == "form":
        return 2
    if not attrs or tag in ("body", "html", "article", "main"):
        return 0
    names = " ".join([attrs.get("class", ""), attrs.get("id", ""), attrs.get("role", ""), attrs.get("itemprop", "")]).split()
    said = {_named(x, within > 0) for x in names}
    return 2 if 2 in said else 3 if 3 in said else 0


def blocks(page: str) -> list[Block]:
    """Blocks of text of a page in page order, without dropped parts; each has the path of its containers."""
    # Found blocks: container, pieces of text (text, whether it is linked, innermost doubtful element or -1), tag.
    raw: list[tuple[int, list[tuple[str, bool, int]], str]] = []
    # An open element: tag, whether it is a container, whether it is dropped (2, 3: doubtful), whether it is a link.
    stack: list[tuple[str, bool, int, bool]] = []
    # Doubtful elements: the one around each, whether it is in an article and goes if it is linked, the unlinked and linked text of each; those that are open.
    around: list[int] = []
    in_article: list[bool] = []
    if_linked: list[bool] = []
    held: list[int] = []
    tied: list[int] = []
    doubtful: list[int] = [-1]
    open_tags: dict[str, int] = defaultdict(int)
    dropped = links = 0
    tree = Tree()
    nodes = [0]
    in_blocks: list[str] = []
    parts: list[tuple[str, bool, int]] = []
    free = 0
    has_article = False

    def flush() -> None:
        if parts:
            raw.append((nodes[-1], parts.copy(), in_blocks[-1] if in_blocks else ""))
            parts.clear()

    def pop() -> None:
        nonlocal dropped, links
        tag, container, drop, link = stack.pop()
        if container:
            nodes.pop()
        if tag in _BLOCK:
            in_blocks.pop()
        open_tags[tag] -= 1
        dropped -= drop == 1
        if drop > 1:
            doubtful.pop()
        links -= link

    def close(tag: str) -> None:
        while stack:
            top = stack[-1][0]
            if top in _BLOCK:
                flush()
            pop()
            if top == tag:
                return

    def close_within(tags: tuple[str, ...]) -> None:
        """Ends the nearest open one of tags, unless a table, list or container stands between."""
        for t, _, _, _ in reversed(stack):
            if t in tags:
                close(t)
                return
            if t in _STOPS:
                return

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not dropped:
            parts.append((page[at:lt], links > 0, doubtful[-1]))
            n_free = len(page[at:lt].strip())
            if links:
                if doubtful[-1] >= 0:
                    tied[doubtful[-1]] += n_free
            else:
                free += n_free
                if doubtful[-1] >= 0:
                    held[doubtful[-1]] += n_free
                elif n_free and open_tags["article"] + open_tags["main"]:
                    has_article = True
        if lt == n:
            break
        m = _TAG.match(page, lt) if page.find(">", lt) >= 0 else None
        if not m:
            nxt = page[lt + 1 : lt + 2]
            if nxt.isalpha() or nxt in ("/", "!", "?"):
                # A tag that the page's end cuts off is not text.
                end = page.find(">", lt)
                if end < 0:
                    break
                at = end + 1
                continue
            if not dropped:
                parts.append(("<", False, doubtful[-1]))
            at = lt + 1
            continue
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "br" or tag == "p" and not open_tags["p"]:
                flush()
            elif open_tags[tag]:
                if tag in _BLOCK:
                    flush()
                close(tag)
            continue
        if tag in _BLOCK:
            flush()
            if tag in _ENDS_P and open_tags["p"]:
                close_within(("p",))
            if tag in _CLOSES:
                close_within(_CLOSES[tag])
        if tag in _VOID:
            continue
        attrs = _attributes(m[4])
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
            if end and not page[end.start() : end.end()].endswith(">"):
                at = n
            continue
        if tag in ("html", "body") and open_tags[tag]:
            continue
        if tag == "body" and open_tags["head"]:
            close("head")
        if m[4].endswith("/") and tag in ("svg", "math", "path", "use"):
            continue
        drop = _unwanted(tag, attrs, open_tags["article"] + open_tags["main"])
        container = tag in _CONTAINER
        stack.append((tag, container, drop, tag == "a"))
        if container:
            nodes.append(tree.below(nodes[-1], _step(tag, attrs)))
        if tag in _BLOCK:
            in_blocks.append(tag)
        open_tags[tag] += 1
        dropped += drop == 1
        if drop > 1:
            around.append(doubtful[-1])
            in_article.append(open_tags["article"] + open_tags["main"] > 0)
            if_linked.append(drop == 3)
            held.append(0)
            tied.append(0)
            doubtful.append(len(held) - 1)
        links += tag == "a"
    flush()

    for i in range(len(held) - 1, -1, -1):
        if around[i] >= 0:
            held[around[i]] += held[i]
            tied[around[i]] += tied[i]
    stays: list[bool] = []
    for i, x in enumerate(held):
        own = tied[i] <= x if if_linked[i] else 2 * x > free and (in_article[i] or not has_article)
        stays.append(own and (around[i] < 0 or stays[around[i]]))
    out = []
    for node, pieces, tag in raw:
        pieces = [x for x in pieces if x[2] < 0 or stays[x[2]]]
        text = _SPACE.sub(" ", html.unescape("".join([x[0] for x in pieces]))).strip(" ")
        if text:
            out.append(Block(tree, node, text, min(sum(len(x[0]) for x in pieces if x[1]), len(text)), tag))
    return out


def container_scores(found: list[Block]) -> list[float]:
    """Score of each container of a page by number (the root's is not a container's); one shares in the score of what is inside it."""
    if not found:
        return []
    tree = found[0].tree
    scores = [0.0] * len(tree.parent)
    for b in found:
        free = len(b.text) - b.linked
        scores[b.node] += free * (1.0 if b.tag in ("p", "pre", "blockquote", "li", "td", "h1", "h2", "h3", "h4") else 0.6) - 2.0 * b.linked + 10.0 * (b.text.count(",") + b.text.count("."))
    for node in range(len(scores) - 1, 0, -1):
        # Wrappers further out get less, so the tightest container of most text wins.
        scores[tree.parent[node]] += 0.9 * scores[node]
    for node in range(1, len(scores)):
        step = tree.step[node]
        if step.startswith(("article", "main")):
            scores[node] *= 1.6
        elif _MAIN_WORD.search(step.partition(".")[2]):
            scores[node] *= 1.3
    return scores


def best_container(found: list[Block], scores: list[float]) -> int:
    """The container with the highest score, of those with text in them; 0 if no text is in one."""
    if not found:
        return 0
    tree = found[0].tree
    used = [False] * len(tree.parent)
    for b in found:
        used[b.node] = True
    for node in range(len(used) - 1, 0, -1):
        used[tree.parent[node]] |= used[node]
    most = max((scores[n] for n in range(1, len(used)) if used[n]), default=None)
    if most is None:
        return 0
    # Of those that share the highest score the one with the smallest path: down from the root by the smallest step.
    holds = [n > 0 and used[n] and scores[n] == most for n in range(len(used))]
    tied, least = holds.copy(), {}
    for node in range(len(used) - 1, 0, -1):
        if holds[node]:
            up = tree.parent[node]
            holds[up] = True
            if up not in least or tree.step[node] < tree.step[least[up]]:
                least[up] = node
    node = 0
    while not tied[node]:
        node = least[node]
    return node


def extract(found: list[Block], path: str | None) -> str:
    """Blocks below path, joined by a space; without path, or if nothing is below it, by the page's own best path."""
    if not found:
        return ""
    tree = found[0].tree
    top = tree.find(path) if path else None
    held = tree.inside(top) if top is not None else []
    if top is None or not any(held[b.node] for b in found):
        held = tree.inside(best_container(found, container_scores(found)))
    return " ".join([b.text for b in found if held[b.node]])


def host_column(url: str = "url"):
    """Host of a URL in lower case, without port; "" for none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url: str = "url", text: str = "html") -> DataFrame:
    """(host, path): the path with the most votes of each host."""

    def run(batches):
        for batch in batches:
            votes: dict[tuple[str, str], list] = defaultdict(lambda: [0, 0.0])
            for host, page in zip(*(c.to_pylist() for c in batch.columns)):
                found = blocks(page)
                scores = container_scores(found)
                if node := best_container(found, scores):
                    v = votes[host, found[0].tree.path(node)]
                    v[0] += 1
                    v[1] += scores[node]
            yield pa.RecordBatch.from_pydict({"host": [h for h, _ in votes], "path": [p for _, p in votes], "votes": pa.array([v[0] for v in votes.values()], pa.int64()), "score": pa.array([v[1] for v in votes.values()], pa.float64())})

    given = pages.select(host_column(url).alias("host"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("html"))
    votes = C.map_batches(given, run, "host string, path string, votes long, score double").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.round(F.sum("score")).alias("score"))
    # The first in (most votes, highest score, smallest path).
    return votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), -F.col("score"), F.col("path"))).alias("path"))


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", work: str | None = None) -> DataFrame:
    """page_id, url, text and path (the consensus path used) for every row of pages."""
    paths = C.stored(host_paths(pages, url, text), f"{work or C.shared_dir(pages.sparkSession)}/paths")
    given = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("html"), host_column(url).alias("host"))

    def run(batches):
        for batch in batches:
            path = batch.column(3).to_pylist()
            out = [extract(blocks(page), p) for page, p in zip(batch.column(2).to_pylist(), path)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), batch.column(3)], ["page_id", "url", "text", "path"])

    joined = C.join_lookup(given, paths, "host", ["page_id", "url"]).select("page_id", "url", "html", "path")
    return C.map_batches(joined, run, "page_id long, url string, text string, path string")
