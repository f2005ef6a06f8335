"""Main text of web pages by composite text density (operator 4).

A page becomes a DOM by one scan over its tags.  Every node has the characters C and tags T of its
subtree and those of its links (LC, LT); its composite density is

    C / T * log(C / not-link chars * LC + LC_body / C_body * C + e) (C / LC * T / LT)

with the logarithm to that base, so that link-heavy nodes fall.  Each node's density sum is that of
its children's densities; the subtree of the largest sum is the core of the article, and the least
density on the path from the body down to it is the threshold.  The article is the highest node on that
path that adds siblings of at least the threshold and a ``LEAST`` share of its text, or of tags that hold
text only (headings, paragraphs, lists), none of them mostly links; beyond an ``article`` or ``main``
only others of these and sections are added.  What else the way up adds goes if it is a plain container or mostly links.

Tags, classes and ids that name furniture are weights: such a node does not count for what is around it
and its own density is cut to a share (``FIRM``, ``FAINT``).  Where the densest subtree is inside such a
node none the less, the node is the article's wrapper and its name is ignored.  Inside the article,
furniture goes; what only an ambiguous name calls furniture stays if it is a heading or dense text.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from quarrytext.llm.base import only, schema_of

# The element kinds of HTML that matter here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot option optgroup legend summary".split())
FURNITURE = frozenset("nav aside footer header form script style noscript iframe head title template svg button select option textarea input dialog menu object embed canvas audio video label fieldset".split())
NAMED = re.compile(
    r"(?i)(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adbox|adsense|banner|promo|promotion|promoted|sponsor|sponsored|"
    r"nav|navbar|navigation|menu|breadcrumb|breadcrumbs|pagination|pager|sidebar|side|aside|rail|widget|widgets|"
    r"header|masthead|topbar|footer|foot|bottombar|copyright|legal|disclaimer|"
    r"notice|notices|cookie|cookies|consent|gdpr|privacy|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|paywall|"
    r"comment|comments|comment-list|commentlist|disqus|discussion|replies|reply|respond|feedback|"
    r"share|sharing|social|related|recommended|recommendations|trending|popular|more-stories|outbrain|taboola|"
    r"form|search|searchbox|skip|skip-link|toolbar|tags|tag-list|hidden|sr-only)(?:$|[\s_-]|\d)"
)
#: Names that parts of an article bear too: evidence only.
AMBIGUOUS = re.compile(
    r"(?i)(?:^|[\s_-])(?:discussion|respond|feedback|related|recommended|recommendations|popular|trending|privacy|consent|search|legal|disclaimer|copyright|"
    r"notice|notices|alert|header|foot|side|rail|tags|form|skip|promotion|navigation|subscription|social|sharing)(?=$|[\s_-]|\d)"
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
#: Tags that an opening tag of the same group closes.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select", "datalist"}, "tbody": {"table"}, "tfoot": {"table"}}

TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)|(?P<other>[!?/][^>]*)>)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
BLANKS = " \t\n\x0c\r"
FIRM, FAINT = 0.1, 0.5  # shares of its density that a node keeps that is furniture by name, or only perhaps
LEAST = 0.05  # share of the core's text that a plain container beside it needs
#: Elements that hold text, and those that hold an article.
CONTENT = frozenset("h1 h2 h3 h4 h5 h6 hgroup p ul ol dl blockquote pre table figure hr".split())
HOLDERS = frozenset("article main section".split())
#: Containers that say nothing of what they hold: only their density speaks for them.
PLAIN = frozenset("div section span center td th tr table tbody a small".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total", "kind", "weight", "wrapper", "dropped")

    def __init__(self, tag: str, attrs: str = "", parent: "Node | None" = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.weight = 1.0
        self.kind = 0
        self.wrapper = self.dropped = False


def parse(page: str) -> Node:
    """The DOM of a page; text is kept undecoded, omitted and misplaced end tags are mended.

    ``depths`` has the places of the open elements by tag, so that no step looks through all of them.
    """
    root = Node("html")
    body = Node("body", parent=root)
    root.children.append(body)
    path = [body]
    depths: dict[str, list[int]] = {}

    def last(tags) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    def close(depth: int) -> None:
        """Leave the element at ``depth`` and all in it."""
        while len(path) > depth:
            depths[path.pop().tag].pop()

    at, n = 0, len(page)
    while at < n:
        found = TAG.search(page, at)
        stop = found.start() if found else n
        if stop > at:
            path[-1].children.append(page[at:stop])
        if not found:
            break
        at = found.end()
        name = found["name"]
        if not name:
            continue
        name, rest = name.lower(), found["rest"] or ""
        if name in ("html", "head", "body"):
            if name == "body" and not found["close"]:
                body.attrs = rest
            if name != "html" and (name == "body") != bool(found["close"]):
                close(1)
            continue
        if found["close"]:
            if depths.get(name):
                close(depths[name][-1])
            continue
        if name in CLOSES_P and depths.get("p") and depths["p"][-1] > last(("td", "th", "button", "object")):
            close(depths["p"][-1])
        while name in SIBLINGS and last(SIBLINGS[name]) > last(SCOPES[name]):
            close(last(SIBLINGS[name]))
        node = Node(name, rest, path[-1])
        path[-1].children.append(node)
        if name in RAW:
            end = RAW_END[name].search(page, at)
            if name in ("textarea", "title", "noscript"):
                node.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif name not in VOID and not rest.endswith("/"):
            depths.setdefault(name, []).append(len(path))
            path.append(node)
    return root


def _furniture(node: Node) -> int:
    """2 for furniture, 1 if only a name that an article's parts may bear says so, else 0."""
    if node.tag in FURNITURE:
        return 2
    if not node.attrs:
        return 0
    named = 0
    for found in ATTRIBUTE.finditer(node.attrs):
        key, value = found[1].lower(), found[2] or found[3] or found[4] or ""
        if key in ("class", "id") and NAMED.search(value):
            if node.tag not in HEADINGS and NAMED.search(AMBIGUOUS.sub(" ", value)):
                return 2
            named = 1
        if key == "hidden" or (key == "role" and value.lower() in ROLES) or (key == "aria-hidden" and value.lower() == "true"):
            return 2
        if key == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 2
    return named


def _order(root: Node) -> list[Node]:
    """All nodes, parents first, without recursion."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in node.children if isinstance(c, Node)]
    return out


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    if not chars:
        return 0.0
    tags, links, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    return chars / tags * math.log(max(chars / links * tags / link_tags, 1.0)) / base


def measure(nodes: list[Node]) -> None:
    """Fill in counts, densities and density sums; ``kind`` and ``wrapper`` are set.

    The counts of furniture do not go into those of what holds it.
    """
    for node in reversed(nodes):
        chars = tags = link_chars = link_tags = 0
        for child in node.children:
            if isinstance(child, str):
                chars += len(child.strip(BLANKS))
            elif child.wrapper or not child.kind:
                chars, tags = chars + child.chars, tags + child.tags + 1
                link_chars, link_tags = link_chars + child.link_chars, link_tags + child.link_tags + (child.tag == "a")
        if node.tag in RAW or node.tag == "head":
            chars = link_chars = 0
        if node.tag == "a":
            link_chars, link_tags = chars, max(tags, link_tags)
        node.chars, node.tags, node.link_chars, node.link_tags = chars, tags, link_chars, link_tags
    body = nodes[1]
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in nodes[1:]:
        own = 1.0 if node.wrapper else (1.0, FAINT, FIRM)[node.kind]
        node.weight = min(own, node.parent.weight)
        node.density = node.weight * _density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in nodes:
        node.total = sum(c.density for c in node.children if isinstance(c, Node))


def _core(nodes: list[Node]) -> Node:
    """The node of the largest density sum (the highest of equals; the body if all are 0)."""
    best = nodes[1]
    for node in nodes[2:]:
        if node.total > best.total:
            best = node
    return best


def main_node(root: Node) -> tuple[Node, float]:
    """The article's node and the threshold; what does not belong to the article inside is marked."""
    nodes = _order(root)
    body = nodes[1]
    for node in nodes[2:]:
        node.kind = _furniture(node)
    measure(nodes)
    up, wrapped = _core(nodes), False
    while up is not body and up is not root:
        if up.kind:
            up.wrapper = wrapped = True
        up = up.parent
    if wrapped:  # the names of what holds the densest text mean nothing
        measure(nodes)
    best = _core(nodes)
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(node.density for node in path)
    least, top, held = LEAST * best.chars, 0, False
    for k in range(1, len(path)):
        held = held or path[k - 1].tag in ("article", "main")
        if any(_adds(c, threshold, least, held) for c in path[k].children if c is not path[k - 1]):
            top = k
    held = False
    for k in range(1, top + 1):
        held = held or path[k - 1].tag in ("article", "main")
        for beside in path[k].children:
            if isinstance(beside, Node) and beside is not path[k - 1] and not _adds(beside, threshold, least, held):
                beside.dropped = held or beside.tag in PLAIN or _linked(beside)
    _drop_furniture(path[top], body, threshold)
    return path[top], threshold


def _linked(node: Node) -> bool:
    """Whether a subtree is mostly links."""
    return node.link_chars * 2 >= node.chars > 0


def _adds(beside, threshold: float, least: float, held: bool) -> bool:
    """Whether a sibling of what is found so far belongs to the article; ``held``: that is an article element."""
    if isinstance(beside, str) or not beside.chars or _linked(beside) or (beside.kind == 2 and not beside.wrapper):
        return False
    if held and beside.tag not in HOLDERS:
        return False
    return beside.tag in CONTENT or (beside.density >= threshold and beside.chars >= least)


def _drop_furniture(top: Node, body: Node, threshold: float) -> None:
    """Mark the furniture inside the article; an ambiguous name needs a low density or many links too."""
    share = body.link_chars / body.chars if body.chars else 0.0
    stack = [top]
    while stack:
        node = stack.pop()
        if node is not top and node.kind and not node.wrapper:
            dense = not _linked(node) and _density(node.chars, node.tags, node.link_chars, node.link_tags, share) >= threshold
            node.dropped |= node.kind == 2 or not (node.tag in HEADINGS or dense)
        if not node.dropped:
            stack += [c for c in node.children if isinstance(c, Node)]


def blocks(node: Node) -> list[str]:
    """The texts of a subtree's blocks in page order, decoded, white space folded."""
    out: list[str] = []
    held: list[str] = []

    def flush():
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(text)

    stack: list = [node]
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            held.append(item)
        elif item.tag == "br":
            held.append(" ")
        elif not item.dropped and item.tag not in RAW:
            if item.tag in BLOCK:
                flush()
                stack.append(None)
            stack += reversed(item.children)
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by an empty line; empty for a null or empty page."""
    if not page or not page.strip():
        return ""
    best, _ = main_node(parse(page))
    return "\n\n".join(blocks(best))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``(page_id, url, text, n_chars)``.

    ``text`` is the whole main text (see the module), empty if there is none or the page is null;
    ``n_chars`` its code points.  Pages of any length and broken markup are read to the end.
    Repeated rows, null ids and null urls stay; an empty table gives an empty result; other columns
    are ignored, so none can clash.
    """
    source = only(pages, page_id=id_col, url=url_col, html=html_col)

    def run(batches):
        for batch in batches:
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, schema_of(source, ["page_id", "url"], "text string, n_chars bigint"))
