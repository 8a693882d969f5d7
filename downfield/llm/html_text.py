"""Main text of web pages by composite text density.

A page is read into a tree.  Parts whose element, role or name says what they are (menus, notices, adverts, forms, comments) go
first; a name says so if all its pieces are words of such parts or of layout (``share-buttons``), and not if any other word is in
it (``share-price``).  Headings and paragraphs are never taken for such parts.  Every node left gets its characters per tag,
adjusted for links; a node's density sum is the sum of its children's densities.  The node of the highest sum is the target; the
lowest density on the path from the body to it is the threshold.  From the body down, each node at or over the threshold gives
the node of the highest sum in it; a choice within an article or main element stands for that whole element.  The blocks of the
chosen subtrees are the text.  Without such an element, what stands beside the choices on the way up to the body belongs to them
if it is loose text, headings, paragraphs, lists and the like, and not mostly links.

Defined results: a null or empty page, or one without text outside the parts dropped, has the text "" and 0 characters;
repeated rows each get their result; malformed markup is read as far as it makes sense and never fails; very long pages are read
whole; of nodes that tie for the highest sum the first in page order is the target; columns named as the new ones are replaced
and all others are handed on; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from downfield.llm.shared import bounded_batches

#: Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = "script style noscript template iframe svg title textarea annotation annotation-xml"
DROPPED = frozenset(f"{RAW} head nav footer aside form button select dialog menu input fieldset canvas audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold text of their own rather than lay out a page.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre ul ol dl table figure".split())
NAMED = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus replies respond share sharing social related newsletter subscribe subscription popup modal overlay widget paywall toolbar pagination".split())
#: Words of layout that may stand beside those in a name.
LAYOUT = frozenset("area bar block body bottom box btn button buttons center column container content desktop fixed form global group holder icons inner items item js left link links list listing main message mobile outer page panel post posts primary row secondary section signup site slot sticky text thread toggle top unit widgets wrap wrapper right articles stories js".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
#: An opening element here ends an open one of these, up to the nearest of the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW.replace(' ', '|')})(?=[\s/>])[^>]*+>.*?(?:</\1\s*+>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
KEPT = frozenset("article main body html".split())
#: Elements nested deeper than this are read as siblings, as browsers do.
DEPTH = 256


class Node:
    __slots__ = ("tag", "attrs", "parent", "depth", "kids", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, attrs: str, parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []
        self.depth = parent.depth + 1 if parent else 0


#: What keeps the words on both sides of something left out apart.
_BREAK = Node("hr", "", None)


def parse(page: str) -> Node:
    """The tree of a page; a kid is a node or a text with its references decoded."""
    root = node = Node("html", "", None)
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            node.kids.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if m[2]:
            up = node
            while up is not None and up.tag != name:
                up = up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            continue
        if name == "html":
            continue
        if name in BLOCK:
            if name in CLOSES:
                ends, until = CLOSES[name]
            else:
                ends, until = {"p"}, BLOCK - {"p"}
            up = node
            while up is not None and up.tag not in ends and up.tag not in until:
                up = up.parent
            if up is not None and up.tag in ends and up.parent is not None:
                node = up.parent
        new = Node(name, m[4], node)
        node.kids.append(new)
        if name not in VOID and (name in BLOCK or not m[4].rstrip().endswith("/")) and new.depth < DEPTH:
            node = new
    if at < len(page):
        node.kids.append(html.unescape(page[at:]))
    return root


def _named(node: Node) -> bool:
    if node.tag in HEADINGS or node.tag == "p":
        return False
    for m in _NAMES.finditer(node.attrs):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            if value.strip() in ROLES:
                return True
            continue
        for name in value.split():
            pieces = [x for x in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])", name) if x and not x.isdigit()]
            if any(x in NAMED for x in pieces) and all(x in NAMED or x in LAYOUT for x in pieces):
                return True
    return False


def prune(node: Node, within: bool = False) -> bool:
    """Drop what is surely not the article; returns whether the node holds an article or main element."""
    holds, kids = False, []
    for k in node.kids:
        if isinstance(k, str):
            kids.append(k)
            continue
        if k.tag in DROPPED or (k.tag == "header" and not within):
            if k.tag in BLOCK:
                kids.append(Node("hr", "", node))  # the words on both sides stay apart
            continue
        own = k.tag in ("article", "main")
        under = prune(k, within or own)
        dropped = k.tag not in KEPT and not under and k.attrs and _named(k)
        kids.append(Node("hr", "", node) if dropped else k)
        holds |= not dropped and (own or under)
    node.kids = kids
    return holds


def measure(node: Node, link: bool = False) -> None:
    link = link or node.tag == "a"
    node.chars = node.tags = node.link_chars = node.link_tags = 0
    for k in node.kids:
        if isinstance(k, str):
            n = len(_SPACE.sub("", k))
            node.chars += n
            node.link_chars += n * link
        else:
            measure(k, link)
            node.chars += k.chars
            node.tags += 1 + k.tags
            node.link_chars += k.link_chars
            node.link_tags += (k.tag == "a") + k.link_tags


def weigh(node: Node, body: Node) -> None:
    c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
    node.total = 0.0
    for k in node.kids:
        if not isinstance(k, str):
            weigh(k, body)
            node.total += k.density
    if not c:
        node.density = 0.0
        return
    base = math.log(c / max(c - lc, 1) * lc + body.link_chars / max(body.chars, 1) * c + math.e)
    node.density = c / t * math.log(c / max(lc, 1) * t / max(lt, 1)) / math.log(base) if base > 1 and lc else c / t * math.log(max(c * t, 2))
    node.density = max(node.density, 0.0)


def walk(node: Node) -> Iterator[Node]:
    yield node
    for k in node.kids:
        if not isinstance(k, str):
            yield from walk(k)


def choose(root: Node) -> list[Node]:
    """The subtrees of the main text, in page order."""
    body = next((n for n in walk(root) if n.tag == "body"), root)
    measure(body)
    if not body.chars:
        return []
    weigh(body, body)
    target = max(walk(body), key=lambda n: n.total)
    if target.total == 0:
        target = body
    threshold, up = body.density, target
    while up is not None and up is not body:
        threshold, up = min(threshold, up.density), up.parent
    chosen: list[Node] = []

    order = list(walk(body))
    most: dict[int, Node] = {}  # the node of the highest sum in each node, the first of equal ones
    for n in reversed(order):
        kids = [most[id(k)] for k in n.kids if not isinstance(k, str)]
        most[id(n)] = max([n, *kids], key=lambda k: k.total)
    home: dict[int, Node] = {}  # the article or main element each node is in
    for n in order:
        at = n if n.tag in ("article", "main") else home.get(id(n.parent))
        if at is not None:
            home[id(n)] = at
    taken: set[int] = set()  # nodes within choices

    def mark(node: Node) -> None:
        if id(node) in taken or node.density < threshold or not node.chars:
            return
        best = most[id(node)]
        best = best if best.total else node
        lifted = home.get(id(best), best)
        if id(lifted) not in taken:
            chosen.append(lifted)
            taken.update(id(n) for n in walk(lifted) if id(n) not in taken)
        for k in node.kids:
            if not isinstance(k, str):
                mark(k)

    mark(body)
    # nested choices are one, in page order
    picked, inside = {id(c) for c in chosen}, set()
    for n in order:
        if id(n.parent) in inside or id(n.parent) in picked:
            inside.add(id(n))
    chosen = [n for n in order if id(n) in picked and id(n) not in inside]
    return chosen


def beside(kid: "Node | str") -> bool:
    """Whether what stands beside a choice belongs to it."""
    if isinstance(kid, str):
        return True
    if kid.tag in BLOCK and kid.tag not in TEXTUAL and not _headed(kid):
        return False
    return kid.chars > 0 and 2 * kid.link_chars <= kid.chars


def _headed(node: Node) -> bool:
    """Whether all text in a node is in headings."""
    return node.tag in HEADINGS or all(not k.strip() if isinstance(k, str) else not k.chars or _headed(k) for k in node.kids)


def whole_choice(chosen: list[Node]) -> list["Node | str"]:
    """The choices and what belongs to them, in page order."""
    if not chosen or any(n.tag in ("article", "main") for n in chosen):
        return chosen
    picked = {id(n) for n in chosen}
    above: set[int] = set()
    for n in chosen:
        while n.parent is not None and n.tag != "body":
            n = n.parent
            above.add(id(n))
    top = chosen[0]
    while top.parent is not None and top.tag != "body":
        top = top.parent
    top_picked = id(top) in picked
    out: list[Node | str] = []

    def visit(node: Node) -> None:
        if id(node) in picked and node is not top:
            out.append(node)
            return
        for k in node.kids:
            if not isinstance(k, str) and (id(k) in above or id(k) in picked):
                visit(k)
            elif beside(k) or top_picked and 2 * k.link_chars <= k.chars:  # of a whole body, all but menus
                out.append(k)
            else:
                out.append(_BREAK)

    visit(top)
    return out


def blocks(nodes: list["Node | str"]) -> list[str]:
    out, now = [], []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(now)).strip()
        now.clear()
        if text:
            out.append(text)

    def visit(node: Node) -> None:
        block = node.tag in BLOCK
        if block:
            end()
        elif node.tag == "br":
            now.append(" ")
        for k in node.kids:
            if isinstance(k, str):
                now.append(k)
            else:
                visit(k)
        if block:
            end()

    for n in nodes:
        if isinstance(n, str):
            now.append(n)
        else:
            visit(n)
    end()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    prune(root)
    return "\n\n".join(blocks(whole_choice(choose(root))))


def extract(pages: DataFrame, html_column: str = "html", text_column: str = "text", chars_column: str = "n_chars") -> DataFrame:
    """The columns of ``pages`` but the html, with the main text and its code points (columns so named before are replaced)."""
    bounded_batches(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html_column, text_column, chars_column)]
    rows = pages.select(*keep, F.col(html_column).cast("string").alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sys

        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEPTH))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x.as_py()) for x in part.column(len(keep))]
                yield pa.record_batch([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, text_column, chars_column])

    return rows.mapInArrow(run, (f"{schema}, " if keep else "") + f"`{text_column}` string, `{chars_column}` long")
