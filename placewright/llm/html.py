"""Main text of HTML pages by wrapper induction.

Pages of one host share a wrapper. Each page's tree is aligned with the host's reference page (the
one with the smallest id) by simple tree matching: equal roots, and the best ordered matching of
their children, down to the leaves. Over all pages of the host, a reference node whose text is the same
on most pages (``SAME``) is template; nodes that vary are slots. Pages that are copies of each other count
once, so a group of copies doesn't turn its article into template.

The main text is what remains of a page without its template nodes and without slots that are
marked as something else: menus, headers and footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments, told by element, role, class and id. That a page names its article
(``article``, ``main`` or such a role or class) is one more sign: the page is read there, a node in it is
template only if nearly all pages have it (``SAME_INSIDE``), since texts of one host may well share passages,
and it is marked as something else only by its element, its role or a whole class or id, not by a part of one.

Text: character references are decoded, white space inside a block becomes one space, blocks are
joined in page order by one space. Nothing else is dropped.

Defined cases: null or empty html gives an empty text; unclosed, stray and misnested tags are
repaired as browsers do, near enough; a page whose url has no host forms a host of its own kind
(the empty one); a host of fewer than ``LEAST`` different pages has no template; repeated rows
are answered each. Sibling lists of any length are matched in memory linear in their length, and
trees of any depth are walked without recursion.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pieces, small

LEAST, SAME, SAME_INSIDE = 4, 0.6, 0.9
MAX_HOSTS = 2_000  # of one reference page each
_TOKEN = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))[^>\"']*)*)(?:>|\Z)|/[^>a-zA-Z][^>]*(?:>|\Z))", re.S)
_HINT = re.compile(r"""(?:^|[\s/"'])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup html legend li main menu nav noscript ol optgroup option p pre search section select summary svg math table tbody td template tfoot th thead tr ul canvas object audio video".split()
)
_ENDS_P = _BLOCK - frozenset("td th tr tbody thead tfoot caption option optgroup legend body html head button select svg math object audio video canvas noscript template".split())
#: An open element that a start tag of the key closes, up to the elements after the bar.
_IMPLIED = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"),
    "option": ("option", "select optgroup datalist"), "optgroup": ("option optgroup", "select"), "body": ("head", "html"),
}
_IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _IMPLIED.items()}
_P_SCOPE = frozenset("html body article aside section main div td th li blockquote form fieldset header footer nav button object table".split())
_DROP = frozenset("script style noscript template nav footer aside form iframe svg canvas button select textarea menu dialog head object audio video search datalist title noembed noframes".split())
_DROP_ROLE = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert form menu menubar toolbar tablist note".split())
_DROP_WORD = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner promo promotion sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share sharing social comment comments commentlist disqus respond "
    "related recommended recommendations widget toolbar pagination pager copyright disclaimer login form".split()
)
#: Whole classes and ids that tell what isn't main text even inside an article.
_DROP_WHOLE = frozenset(
    "ad ads advert adverts advertisement advertising adsense ad-slot sponsored promo banner sidebar side-bar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie-notice "
    "cookie-banner notice notices newsletter newsletter-signup share share-buttons social-share social-links comment comments comment-list comment-section commentlist comments-area disqus "
    "disqus_thread respond related related-posts related-articles recommended pagination pager".split()
)
_BESIDE_WORD = frozenset("related recommended recommendations sidebar teaser teasers".split())
_NOT_BESIDE = frozenset("has with no without".split())  # words of a class such as has-sidebar
_MAIN_WORD = frozenset("article articlebody maincontent content post entry story main".split())


class Node:
    """A block of the page; ``kids`` are nodes and strings of raw inline text, ``holds`` tells whether
    a node below it is surely main text."""

    __slots__ = ("tag", "sig", "kids", "drop", "main", "beside", "holds", "parent")

    def __init__(self, tag: str, sig: str, drop: int, main: int, beside: bool = False, parent: "Node | None" = None):
        self.tag, self.sig, self.kids, self.drop, self.main, self.beside = tag, sig, [], drop, main, beside
        self.holds, self.parent = False, parent
        if main == 2:
            while parent is not None and not parent.holds:
                parent.holds = True
                parent = parent.parent


def _hints(attrs: str) -> tuple[str, int, int, bool]:
    """(signature, drop, main, beside) of an element's attributes; drop 3 is unconditional, 2 holds
    inside an article too, 1 (a word in a class or id) outside only; beside marks teasers and what
    stands beside the article."""
    sig, drop, main, beside = "", 0, 0, False
    for m in _HINT.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            drop = 3
        elif name == "role":
            role = value.strip().lower()
            if role in _DROP_ROLE:
                drop = max(drop, 2)
                beside = beside or role in ("complementary", "navigation")
            elif role in ("main", "article"):
                main = 2
        elif name == "itemprop":
            if value.lower() == "articlebody":
                main = 2
        elif name in ("class", "id"):
            words = [w.lower() for w in _WORDS.findall(value)]
            if name == "class":
                sig = value
            beside = beside or any(not _BESIDE_WORD.isdisjoint(w) and _NOT_BESIDE.isdisjoint(w) for w in ([x.lower() for x in _WORDS.findall(name)] for name in value.split()))
            if not _DROP_WHOLE.isdisjoint(value.lower().split()):
                drop = max(drop, 2)
            elif not _DROP_WORD.isdisjoint(words):
                drop = max(drop, 1)
            elif not _MAIN_WORD.isdisjoint(words):
                main = max(main, 1)
            if "header" in words:
                drop = max(drop, -1)
    return sig, drop, main, beside


def parse(page: str) -> Node:
    """The block tree of a page."""
    root = Node("#root", "", 0, 0)
    stack: list[tuple[str, Node]] = [("#root", root)]  # inline elements are on it with the block they are in
    opened: Counter[str] = Counter()  # tags on the stack, so that it is searched for none that isn't there

    def close(i: int) -> None:
        for t, _ in stack[i:]:
            opened[t] -= 1
        del stack[i:]

    memo: dict[str, tuple[str, int, int, bool]] = {}
    at, top = 0, root
    search = _TOKEN.search
    while True:
        m = search(page, at)
        if m is None:
            if at < len(page):
                top.kids.append(page[at:])
            return root
        if m.start() > at:
            top.kids.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    close(i)
                    top = stack[-1][1]
                    break
                if tag not in _BLOCK and stack[i][0] in _BLOCK:
                    break  # an inline end tag doesn't close a block
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                top.kids.append("\n")
            continue
        attrs = m[3]
        block = tag in _BLOCK
        if block:
            if opened["p"] and tag in _ENDS_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] in _P_SCOPE:
                        break
            if tag in _IMPLIED:
                closes, scope = _IMPLIED[tag]
                cut = 0
                for i in range(len(stack) - 1, 0, -1) if any(opened[t] for t in closes) else ():
                    if stack[i][0] in scope:
                        break
                    if stack[i][0] in closes:
                        cut = i
                if cut:
                    close(cut)
            top = stack[-1][1]
        sig, drop, main, beside = memo.get(attrs) or memo.setdefault(attrs, _hints(attrs)) if attrs else ("", 0, 0, False)
        if tag in _DROP:
            drop = max(drop, 2)
        elif tag == "header":
            drop = drop or -1
        elif tag in ("article", "main"):
            main = 2
        raw = _RAW.get(tag)
        if raw is not None:
            end = raw.search(page, at)
            at = end.end() if end else len(page)
            continue
        if block or drop > 0 or main == 2:
            node = Node(tag, f"{tag}.{sig}", drop, main, beside or tag in ("aside", "nav"), top)
            top.kids.append(node)
            top = node
        if not attrs.endswith("/") or block:
            stack.append((tag, top))
            opened[tag] += 1
        elif top is not stack[-1][1]:
            top = stack[-1][1]


def _dropped(node: Node, inside: bool) -> bool:
    """Whether a node is marked as other than main text; ``inside``: in a named article."""
    if node.drop <= 0:
        return node.drop < 0 and not inside and not node.holds
    if node.drop == 3:
        return True
    return (node.drop == 2 or not inside) and node.main != 2 and (node.tag in _DROP or node.tag not in ("html", "body")) and not node.holds


def _pieces(node: Node, inside: bool, template: frozenset, out: list[str]) -> None:
    text: list[str] = []
    stack = [iter(node.kids)]
    while stack:
        for k in stack[-1]:
            if type(k) is str:
                text.append(k)
            elif id(k) not in template and not _dropped(k, inside):
                if text:
                    out.append("".join(text))
                    text = []
                stack.append(iter(k.kids))
                break
            elif k.tag in _BLOCK:
                text.append(" ")
        else:
            stack.pop()
            if text:
                out.append("".join(text))
                text = []


def _said(pieces: list[str]) -> str:
    return " ".join(" ".join(_html.unescape(p) if "&" in p else p for p in pieces).split())


def text_of(node: Node, inside: bool = False, template: frozenset = frozenset()) -> str:
    out: list[str] = []
    _pieces(node, inside, template, out)
    return _said(out)


def _named(node: Node, level: int) -> list[tuple[Node, bool]]:
    """The outermost nodes that are marked as main text at ``level``, outside dropped ones; each with
    whether it is marked as a teaser or in a block that stands beside the article."""
    out: list[tuple[Node, bool]] = []
    todo: list[tuple[Node, bool]] = [(k, False) for k in reversed(node.kids) if type(k) is Node]
    while todo:
        k, beside = todo.pop()
        if not _dropped(k, False):
            if k.main >= level:
                out.append((k, beside or k.beside))
            else:
                todo += [(x, beside or k.beside) for x in reversed(k.kids) if type(x) is Node]
    return out


def articles(root: Node) -> list[Node]:
    """The nodes that the page names as its article; of several, those marked as teasers of other
    articles, themselves or by a block they are in, are left out, unless all with text are. Size plays no part."""
    for level in (2, 1):
        found = _named(root, level)
        if len(found) == 1 and found[0][0].tag == "main":
            inner = [n for n, _ in _named(found[0][0], 2)]
            if len(inner) == 1 and 2 * len(text_of(inner[0], True)) >= len(text_of(found[0][0], True)):
                return inner
        if found:
            said = [(n, b) for n, b in found if text_of(n, True)] if len(found) > 1 else found
            return [n for n, b in said if not b] or [n for n, _ in said]
    return []


def outline(root: Node, named: list[Node]) -> list[tuple]:
    """(sig, text hash or None, places of its children, id, inside) of a page's nodes for matching, in page
    order; leaves have a hash, ``inside`` tells those in a ``named`` article. Nodes that are left out anyway don't take part."""
    whole = {id(n) for n in named}
    out: list[tuple] = []
    todo: list[tuple[Node, bool, list[int]]] = [(root, False, [])]
    while todo:
        node, inside, at = todo.pop()
        inside = inside or id(node) in whole
        at.append(len(out))
        kids = [k for k in node.kids if type(k) is Node and not _dropped(k, inside)]
        places: list[int] = []
        out.append((node.sig, None if kids else _hash(node), places, id(node), inside))
        todo += [(k, inside, places) for k in reversed(kids)]
    return out


def _hash(node: Node) -> int:
    import xxhash

    parts: list[str] = []
    stack = [iter(node.kids)]
    while stack:
        for k in stack[-1]:
            if type(k) is not str:
                stack.append(iter(k.kids))
                break
            parts.append(k)
        else:
            stack.pop()
            parts.append(" ")
    return xxhash.xxh3_64_intdigest(_said(parts).encode("utf-8", "surrogatepass")) & 0x7FFFFFFFFFFFFFFF


def _scores(rows: Iterator[np.ndarray], width: int) -> np.ndarray:
    """Weights of the heaviest ordered matchings of all ``rows`` with the first 0, 1, ... columns."""
    best = np.zeros(width + 1, np.int64)
    for row in rows:
        new = best.copy()
        np.maximum(new[1:], best[:-1] + row, out=new[1:])
        best = np.maximum.accumulate(new)
    return best


def _ordered(row, lo: int, hi: int, left: int, right: int) -> list[tuple[int, int]]:
    """A heaviest ordered matching of rows lo..hi with columns left..right; ``row(i)`` has the weights
    of row i. By halves (Hirschberg), so it holds a few rows at a time."""
    out, todo = [], [(lo, hi, left, right)]
    while todo:
        lo, hi, left, right = todo.pop()
        if lo >= hi or left >= right:
            continue
        if hi - lo == 1:
            weights = row(lo)[left:right][::-1]
            j = int(weights.argmax())
            if weights[j] > 0:
                out.append((lo, right - 1 - j))
            continue
        mid = (lo + hi) // 2
        head = _scores((row(i)[left:right] for i in range(lo, mid)), right - left)
        tail = _scores((row(i)[left:right][::-1] for i in range(hi - 1, mid - 1, -1)), right - left)
        cut = left + int((head + tail[::-1]).argmax())
        todo += [(lo, mid, left, cut), (mid, hi, cut, right)]
    return out


def match(a: list[tuple], b: list[tuple]) -> list[tuple[tuple, tuple]]:
    """Simple tree matching: the pairs of nodes of a largest ordered matching of two outlines; of
    several largest ones, among siblings one with the most equal nodes."""
    shapes: dict[tuple, int] = {}  # of a node without its texts, on which the size of a matching depends
    wholes: dict[tuple, int] = {}
    kinds: list[tuple] = []

    def learn(tree: list[tuple]) -> list[tuple[int, int]]:
        """Of each node its shape and its whole, from the last node to the first."""
        known: list[tuple[int, int]] = [(0, 0)] * len(tree)
        for i in range(len(tree) - 1, -1, -1):
            sig, text, kids = tree[i][:3]
            shape = (sig, tuple(known[k][0] for k in kids))
            if shape not in shapes:
                shapes[shape] = len(kinds)
                kinds.append(shape)
            known[i] = shapes[shape], wholes.setdefault((sig, text, tuple(known[k][1] for k in kids)), len(wholes))
        return known

    memo: dict[tuple[int, int], int] = {}

    def weigh(x: int, y: int) -> int:
        """Size of a largest matching of two shapes; the pairs it depends on are weighed first."""
        if kinds[x][0] != kinds[y][0]:
            return 0
        todo = [(x, y)]
        while (x, y) not in memo:
            u, v = todo[-1]
            xs, ys = kinds[u][1], kinds[v][1]
            open_ = [(p, q) for p in set(xs) for q in set(ys) if kinds[p][0] == kinds[q][0] and (p, q) not in memo]
            if open_ and (u, v) not in memo:
                todo += open_
                continue
            if (u, v) not in memo:
                memo[u, v] = 1 + (int(_scores(map(table(ys), xs), len(ys))[-1]) if xs and ys else 0)
            todo.pop()
        return memo[x, y]

    def table(ys: tuple[int, ...]):
        """The weights of a shape with each of ``ys``, worked out once per different shape."""
        each, at = np.unique(np.array(ys, np.int64), return_inverse=True)
        held: dict[int, np.ndarray] = {}

        def row(x: int) -> np.ndarray:
            if x not in held:
                held[x] = np.array([weigh(x, y) for y in each.tolist()], np.int64)
            return held[x][at]

        return row

    known = learn(a), learn(b)

    def kids_of(x: int, y: int) -> list[tuple[int, int]]:
        xs, ys = a[x][2], b[y][2]
        (sx, wx), (sy, wy) = ([[of[k][i] for k in kids] for i in (0, 1)] for kids, of in zip((xs, ys), known))
        n, m, head = len(xs), len(ys), 0
        while head < min(n, m) and wx[head] == wy[head]:  # equal nodes at both ends are in some best matching
            head += 1
        while min(n, m) > head and wx[n - 1] == wy[m - 1]:
            n, m = n - 1, m - 1
        pairs = [(i, i) for i in range(head)] + [(n + i, m + i) for i in range(len(xs) - n)]
        if head < min(n, m):
            weights, equal = table(tuple(sy[head:m])), np.array(wy[head:m], np.int64)
            pairs += [(i, head + j) for i, j in _ordered(lambda i: (weights(sx[i]) << 32) + (equal == wx[i]), head, n, 0, m - head)]
        return [(xs[i], ys[j]) for i, j in pairs]

    pairs, todo = [], [(0, 0)]
    while todo:
        x, y = todo.pop()
        if a[x][0] == b[y][0]:
            pairs.append((a[x], b[y]))
            todo += kids_of(x, y)
    return pairs


class Aligner:
    """Aligns pages with their host's reference page; the last few references are kept parsed."""

    def __init__(self):
        self.kept: dict[str, tuple[list[tuple], dict[int, int], Node]] = {}

    def reference(self, page: str) -> tuple[list[tuple], dict[int, int], Node]:
        if page not in self.kept:
            if len(self.kept) >= 32:
                self.kept.clear()
            root = parse(page)
            tree = outline(root, articles(root))
            self.kept[page] = (tree, {t[3]: i for i, t in enumerate(tree)}, root)  # the tree holds ids, so its nodes stay
        return self.kept[page]

    def __call__(self, root: Node, named: list[Node], reference: str) -> list[tuple[int, int, int, bool]]:
        """(slot, text hash, node id, inside) of the page's matched leaves."""
        ref, slots, _ = self.reference(reference)
        return [(slots[y[3]], x[1], x[3], x[4]) for x, y in match(outline(root, named), ref) if x[1] is not None]


def main_text(page: str | None, constants: dict[tuple[int, int], bool] | None = None, reference: str | None = None, align: Aligner | None = None) -> str:
    """The main text of a page; ``constants``: (slot, text hash) of its host's template, and whether
    that holds inside an article too."""
    if not page:
        return ""
    root = parse(page)
    found = articles(root)
    template: frozenset = frozenset()
    if constants and reference:
        template = frozenset(i for slot, h, i, inside in align(root, found, reference) if (known := constants.get((slot, h))) is not None and (known or not inside))
    if found:
        return _said([text_of(n, True, template) for n in found]) if len(found) > 1 else text_of(found[0], True, template)
    return text_of(root, False, template)


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.expr("try_parse_url(url, 'HOST')")), F.lit(""))
    return pages.select("page_id", "url", "html", host.alias("host"))


def induce(pages: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(references, templates): per host its reference page, and (host, constants) of its template.

    Every page of a host counts; what a page sends on is its matched leaves, a few numbers.
    """
    hosted = _hosted(pages.where("html is not null and html <> ''"))
    least = hosted.groupBy("host").agg(F.min("page_id").alias("ref_id"), F.count("*").alias("n")).where(f"n >= {LEAST} and ref_id is not null")
    ref = hosted.join(small(least, 100_000), "host").where("page_id = ref_id").groupBy("host").agg(F.min("html").alias("ref"))
    ref = scratch.write(ref, "references")
    aligned = hosted.select("host", "html").join(_held(ref), "host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        align = Aligner()
        for batch in pieces(batches, 256):
            hosts, copies, slots = [], [], []
            for host, page, reference in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "ref")), strict=True):
                root = parse(page)
                body: list[str] = []
                named = articles(root)
                for n in named or [root]:
                    _pieces(n, n is not root, frozenset(), body)
                hosts.append(host)
                copies.append(xxhash.xxh3_64_intdigest("".join(body).encode("utf-8", "surrogatepass")) & 0x7FFFFFFFFFFFFFFF)
                slots.append([{"slot": s, "hash": h} for s, h, _, _ in align(root, named, reference)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(copies, pa.int64()), pa.array(slots, pa.list_(pa.struct([("slot", pa.int32()), ("hash", pa.int64())])))],
                names=["host", "copy", "slots"],
            )

    seen = aligned.mapInArrow(run, "host string, copy long, slots array<struct<slot:int,hash:long>>")
    seen = scratch.write(seen.groupBy("host", "copy").agg(F.min("slots").alias("slots")), "slots")
    total = seen.groupBy("host").agg(F.count("*").alias("pages"))
    count = seen.select("host", F.explode("slots").alias("s")).groupBy("host", "s").agg(F.count("*").alias("n"))
    fixed = count.join(total, "host").where(f"pages >= {LEAST} and n >= {SAME} * pages")
    fixed = fixed.select("host", F.struct("s.slot", "s.hash", (F.col("n") >= SAME_INSIDE * F.col("pages")).alias("inside")).alias("s"))
    return ref, scratch.write(fixed.groupBy("host").agg(F.collect_set("s").alias("constants")), "templates")


def _held(ref: DataFrame) -> DataFrame:
    """Reference pages, for broadcast where their number and size are small."""
    head = ref.agg(F.count("*").alias("n"), F.sum(F.length("ref")).alias("c")).first()
    return F.broadcast(ref) if head.n <= MAX_HOSTS and (head.c or 0) <= 16_000_000 else ref


def extracted(pages: DataFrame) -> DataFrame:
    """Per page row: page_id, url, text."""
    scratch = Scratch(pages.sparkSession, "html")
    ref, templates = induce(pages, scratch)
    wrappers = ref.join(templates, "host")
    rows = _hosted(pages).join(_held(scratch.write(wrappers, "wrappers")), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner()
        for batch in pieces(batches, 256):
            texts = []
            for page, reference, constants in zip(*(batch.column(c).to_pylist() for c in ("html", "ref", "constants")), strict=True):
                texts.append(main_text(page, {(c["slot"], c["hash"]): c["inside"] for c in constants} if constants else None, reference, align))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "ref", "constants").mapInArrow(run, "page_id long, url string, text string")
