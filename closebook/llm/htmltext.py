"""Wrapper induction: same-host pages are aligned, their common template is told from their content.

1. A page becomes a tree of block elements; inline markup is part of its block's text.
2. For each host at most ``PER_HOST`` pages (a seeded choice; the bound is a parameter) are aligned one
   after another by simple tree matching: the largest order-preserving match of two trees in which only
   nodes of one label, under matched parents, pair up. Nodes without a partner join the wrapper where
   they stood. A node's text is constant (template) or varying (a slot).
3. The content region is where the varying text is: the deepest element that keeps nine tenths of it. Within
   that, article and main elements are the region if half of the varying text is theirs. Menus, headers,
   footers, asides, forms, adverts, notices and comments are no content wherever they stand, though they
   vary: told by element, by being mostly links (unless they stand between two paragraphs of one parent),
   or by name. A name does not take the half of a page's text if that is in paragraphs and no article or
   main element stands elsewhere.
4. Every page is aligned with its host's wrapper. What falls under the region is its text, but for the
   host's constants: leaf blocks of one label and text that all pages of the host are counted for. A constant
   stands in nine tenths of the host's articles and in ``EVIDENCE`` at least (a parameter). Pages count as
   different articles only by their two longest other blocks, each for itself, so near copies of one article
   are one; template lines that are themselves the longest blocks stay, as then no page is known to differ.

Matching is exact, also for long lists: equal beginnings and ends of two child lists pair up at once, the rest
by dynamic programming over the kinds of subtrees, row by row in numpy, split in halves so that memory grows
with the length. Only where two lists have over ``KINDS`` pairs of kinds of subtrees do children count as one
node each. Nothing here recurses, so trees of any depth are matched whole.

Wrappers are induced apart for each host from a bounded number of pages, so a host with a third of all
pages is no larger a task than any other; the counts behind constants are summed before the shuffle. Pages
meet their wrapper and constants by broadcast while those are counted to be few bytes, else by a join that
adaptive execution may split.

Null html gives an empty text. Null urls or such without a host share one wrapper. Pages that the wrapper
does not fit are read by step 3 on their own. Repeated rows are extracted alike; an empty table gives no
rows; extra columns are ignored; text of any length is kept whole.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small
from .urlfilter import host_of

PER_HOST, EVIDENCE, KINDS, CELLS, REMEMBERED = 8, 5, 250_000, 1 << 16, 2000

# Element names by their part in a page.
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd semantics".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title xmp iframe svg".split())
NO_CONTENT = set("nav header footer aside form button select option dialog menu head script style noscript template textarea iframe svg title object".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table td th article aside section div main body html form footer nav header".split())
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 li pre blockquote td th dt dd figcaption caption".split())
PROSE = set("p blockquote pre figure".split())
# Names of parts that are no content, what may stand beside such a name, and what turns it round.
NO_CONTENT_NAMES = set(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "login share sharing social comment comments reply replies respond discussion disqus related recommended pagination pager toolbar search skip".split()
)
PLACES = set("a area articles bar block body bottom box container content form group inner item items left links list main outer panel posts primary right row secondary section slot stories top unit wrap wrapper zone".split())
NEGATIONS = set("no non not with without has hide hidden".split())

#: A tag ends at ``>``, at the next ``<`` or with the page, so that every character is read once.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|(?=<)|\Z)|<[!?][^<>]*>?", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART, _HUMP = re.compile(r"[a-z]+"), re.compile(r"(?<=[a-z])(?=[A-Z])")


def names_no_content(names: str, whole: bool) -> bool:
    """Whether a class, id or role says so: the name itself, or (unless only whole names count) one whose last
    part is such a name, or whose first is and whose others are places."""
    for name in names.split():
        parts = _PART.findall(_HUMP.sub("-", name).lower())
        if name.lower() in NO_CONTENT_NAMES:
            return True
        if whole or not parts or parts[0] in NEGATIONS:
            continue
        if parts[-1] in NO_CONTENT_NAMES or (parts[0] in NO_CONTENT_NAMES and PLACES.issuperset(parts[1:])):
            return True
    return False


class Node:
    __slots__ = ("label", "tag", "skip", "named", "parts", "kids", "links", "chars", "all_links", "all_chars")

    def __init__(self, tag: str, names: str = ""):
        words = _PART.findall(names.lower())
        self.tag, self.label = tag, tag + ("." + words[0] if words else "")
        self.skip = tag in NO_CONTENT
        self.named = bool(names) and tag not in ("html", "body") and names_no_content(names, tag in TEXT_BLOCKS or tag in ("article", "main"))
        self.parts: list = []  # texts and child nodes in page order
        self.kids: list[Node] = []
        self.links = self.chars = self.all_links = self.all_chars = 0


def below(root) -> list:
    """All nodes, parents before their children."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += reversed(n.kids)
    return out


def parse(page: str) -> Node:
    """The page's tree of block elements, forgiving in the way browsers are."""
    root = Node("html")
    stack, open_tags = [root], ["html"]  # open_tags also holds inline elements
    places: dict[str, list[int]] = defaultdict(list)  # where each tag is open, and under "" where a scope is
    at, anchors = 0, 0

    def text(s: str) -> None:
        if s:
            node = stack[-1]
            s = html.unescape(s)
            node.parts.append(s)
            n = len(s) - s.count(" ")
            node.chars += n
            if anchors:
                node.links += n

    def close(i: int) -> None:
        nonlocal anchors
        while len(open_tags) > i:
            tag = open_tags.pop()
            places[tag].pop()
            if tag in SCOPES:
                places[""].pop()
            if tag == "a":
                anchors -= 1
            elif tag not in INLINE:
                stack.pop()

    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at, tag = m.end(), m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            if places[tag]:
                i = places[tag][-1]
                if tag not in INLINE or not places[""] or places[""][-1] < i:
                    close(i)
            continue
        if tag in ("html", "body"):
            continue
        if tag == "br" or tag == "hr":
            stack[-1].parts.append(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[^<>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in CLOSES_P or tag in CLOSED_BY:
            shut = CLOSED_BY.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            nearest = max((places[t][-1] for t in shut if places[t]), default=-1)
            if nearest >= max(1, places[""][-1] if places[""] else 0):
                close(nearest)
        if tag in INLINE:
            anchors += tag == "a"
        else:
            node = Node(tag, " ".join(a or b or c for a, b, c in _NAMES.findall(m[3])) if m[3] else "")
            stack[-1].parts.append(node)
            stack[-1].kids.append(node)
            stack.append(node)
        places[tag].append(len(open_tags))
        if tag in SCOPES:
            places[""].append(len(open_tags))
        open_tags.append(tag)
    text(page[at:])
    for n in reversed(below(root)):
        n.all_chars, n.all_links = n.chars + sum(k.all_chars for k in n.kids), n.links + sum(k.all_links for k in n.kids)
    return root


def own_text(node: Node) -> str:
    return " ".join("".join(p if isinstance(p, str) else "\n" for p in node.parts).split())


# Simple tree matching.


class Shapes:
    """Trees by label and shape alone: equal subtrees have one number."""

    def __init__(self):
        self.ids: dict = {}
        self.labels, self.kids, self.sizes, self.heights = [], [], [], []
        self.best: dict[tuple[int, int], int] = {}

    def of(self, root) -> dict[int, int]:
        """id(node) -> number for the whole tree."""
        out: dict[int, int] = {}
        for n in reversed(below(root)):
            key = (n.label, tuple([out[id(k)] for k in n.kids]))
            if key not in self.ids:
                self.ids[key] = len(self.labels)
                self.labels.append(n.label)
                self.kids.append(key[1])
                self.sizes.append(1 + sum(self.sizes[k] for k in key[1]))
                self.heights.append(1 + max((self.heights[k] for k in key[1]), default=0))
            out[id(n)] = self.ids[key]
        return out

    def size(self, a: int, b: int) -> int:
        """Pairs in the largest match of two subtrees with these roots; 0 if the roots' labels differ."""
        if a == b:
            return self.sizes[a]
        return self.best.get((a, b), 1) if self.labels[a] == self.labels[b] else 0

    def prepare(self, a: int, b: int) -> None:
        """Fill in ``size`` for the pair and all pairs below it, the lowest first."""
        todo, need = [(a, b)], []
        while todo:
            pair = todo.pop()
            if pair[0] == pair[1] or pair in self.best or self.labels[pair[0]] != self.labels[pair[1]]:
                continue
            self.best[pair] = 1
            need.append(pair)
            _, x, y = _ends(self.kids[pair[0]], self.kids[pair[1]])
            dx, dy = set(x), set(y)
            if len(dx) * len(dy) <= KINDS:
                todo += [(i, j) for i in dx for j in dy]
        for i, j in sorted(need, key=lambda p: self.heights[p[0]]):
            before, x, y = _ends(self.kids[i], self.kids[j])
            after = len(self.kids[i]) - before - len(x)
            same = sum(self.sizes[k] for k in self.kids[i][:before]) + sum(self.sizes[k] for k in self.kids[i][len(self.kids[i]) - after :])
            self.best[i, j] = 1 + same + (int(_last_row(self.weights(x, y), len(y))[-1]) if x and y else 0)

    def weights(self, x: tuple, y: tuple) -> list[np.ndarray]:
        """For each of x its match sizes with each of y; equal rows are one array."""
        kinds, at = np.unique(np.array(y), return_inverse=True)
        rows = {i: np.array([self.size(i, j) for j in kinds.tolist()])[at] for i in set(x)}
        return [rows[i] for i in x]


def _ends(x: tuple, y: tuple) -> tuple[int, tuple, tuple]:
    """How many equal subtrees begin both lists, and what is left without equal beginnings and ends.

    Some largest match pairs those up: another partner of either could give it up without loss.
    """
    n, a = min(len(x), len(y)), 0
    while a < n and x[a] == y[a]:
        a += 1
    b = 0
    while b < n - a and x[-1 - b] == y[-1 - b]:
        b += 1
    return a, x[a : len(x) - b], y[a : len(y) - b]


def _last_row(weights: list[np.ndarray], m: int) -> np.ndarray:
    """Largest matches of all rows with each beginning of the columns."""
    row = np.zeros(m + 1, np.int64)
    for w in weights:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w))
    return row


def _best_pairs(weights: list[np.ndarray], m: int) -> list[tuple[int, int]]:
    """(row, column) pairs of a largest match, in memory that grows with rows + columns."""
    out, todo = [], [(0, len(weights), 0, m)]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        n, k = i1 - i0, j1 - j0
        if not n or not k:
            continue
        part = [w[j0:j1] for w in weights[i0:i1]]
        if n > 1 and n * k > CELLS:
            half = n // 2
            front, back = _last_row(part[:half], k), _last_row([w[::-1] for w in part[:half - 1 : -1]], k)
            cut = int((front + back[::-1]).argmax())
            todo += [(i0, i0 + half, j0, j0 + cut), (i0 + half, i1, j0 + cut, j1)]
            continue
        table = np.zeros((n + 1, k + 1), np.int64)
        for i, w in enumerate(part):
            table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + w))
        i, j = n, k
        while i and j:
            if table[i, j] == table[i - 1, j]:
                i -= 1
            elif table[i, j] == table[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i0 + i, j0 + j))
    return out


def aligned(a, b) -> list[tuple]:
    """The node pairs of a largest match of two trees, roots included; ``a`` and ``b`` have labels and kids.

    A stored wrapper remembers its shapes and what they matched.
    """
    ready = a.ready if isinstance(a, Stored) else None
    shapes = ready[0] if ready else Shapes()
    sa = ready[1] if ready else shapes.of(a)
    sb = shapes.of(b)
    if isinstance(a, Stored):
        a.ready = (shapes, sa) if len(shapes.labels) + len(shapes.best) < REMEMBERED else None
    shapes.prepare(sa[id(a)], sb[id(b)])
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        if sa[id(x)] == sb[id(y)]:
            todo += zip(x.kids, y.kids, strict=True)
            continue
        kx, ky = tuple([sa[id(k)] for k in x.kids]), tuple([sb[id(k)] for k in y.kids])
        before, mx, my = _ends(kx, ky)
        after = len(kx) - before - len(mx)
        todo += zip(x.kids[:before], y.kids[:before], strict=True)
        todo += zip(x.kids[len(kx) - after :], y.kids[len(ky) - after :], strict=True)
        if mx and my:
            todo += [(x.kids[before + i], y.kids[before + j]) for i, j in _best_pairs(shapes.weights(mx, my), len(my))]
    return out


# Wrappers.


class Slot:
    """A wrapper's node. ``text``: its constant's checksum, None once it varies; ``mark``: t template, c region, k kept in spite of its name."""

    __slots__ = ("label", "tag", "skip", "named", "seen", "text", "chars", "links", "kids", "mark", "slot", "all_chars", "all_links")

    def __init__(self, node: Node):
        self.label, self.tag, self.skip, self.named, self.seen = node.label, node.tag, node.skip, node.named, 1
        self.text, self.chars, self.links = zlib.crc32(own_text(node).encode(errors="surrogatepass")), node.chars, node.links
        self.kids: list[Slot] = []
        self.mark, self.slot, self.all_chars, self.all_links = "", 0, 0, 0


def as_wrapper(root: Node) -> Slot:
    made: dict[int, Slot] = {}
    for n in reversed(below(root)):
        made[id(n)] = Slot(n)
        made[id(n)].kids = [made[id(k)] for k in n.kids]
    return made[id(root)]


def _merge(wrapper: Slot, page: Node) -> None:
    partner = {id(n): w for w, n in aligned(wrapper, page)}
    todo = [page]
    while todo:
        node = todo.pop()
        w = partner[id(node)]
        w.seen += 1
        if w.text is not None and w.text != zlib.crc32(own_text(node).encode(errors="surrogatepass")):
            w.text = None
        w.chars += node.chars
        w.links += node.links
        kids, rest = [], iter(w.kids)
        for kid in node.kids:
            if id(kid) in partner:
                for x in rest:
                    kids.append(x)
                    if x is partner[id(kid)]:
                        break
                todo.append(kid)
            else:
                kids.append(as_wrapper(kid))
        w.kids = [*kids, *rest]


def _totals(nodes: list[Slot]) -> None:
    """Varying text (of one page: all text) and what is no content, below each node; children come last."""
    for w in reversed(nodes):
        w.slot = (w.chars if w.text is None or w.seen == 1 else 0) + sum(k.slot for k in w.kids)
        w.all_chars, w.all_links = w.chars + sum(k.all_chars for k in w.kids), w.links + sum(k.all_links for k in w.kids)
        if w.skip or (w.named and w.mark != "k") or _menu(w):
            w.mark, w.slot = "t", 0


def mark_region(wrapper: Slot) -> None:
    """Mark the content region ``c``."""
    nodes = below(wrapper)
    named = [w.named for w in nodes]
    for w in nodes:
        w.named = False
    _totals(nodes)
    for w, own in zip(nodes, named, strict=True):
        w.named = own
        if own and w.mark != "t" and 2 * w.slot > wrapper.slot and any(x.tag in TEXT_BLOCKS for x in below(w)):
            w.mark = "k"
    outside = [wrapper]
    while outside:  # an article elsewhere confirms the names
        w = outside.pop()
        if w.tag in ("article", "main") and w.slot and not w.named:
            for x in nodes:
                x.mark = "" if x.mark == "k" else x.mark
            break
        outside += [k for k in w.kids if k.mark not in ("t", "k")]
    _totals(nodes)
    at = wrapper
    while inner := [k for k in at.kids if k.mark != "t" and k.tag not in TEXT_BLOCKS and k.slot >= 0.9 * max(1, at.slot)]:
        at = inner[0]
    inside, articles = [at], []
    while inside:
        w = inside.pop()
        if w.mark == "t":
            continue
        if w.tag in ("article", "main") and (w.slot or not wrapper.slot):
            articles.append(w)
        else:
            inside += w.kids
    most = max((w.slot for w in articles), default=0)
    articles = [w for w in articles if w.slot * 5 >= most]
    for region in articles if articles and 2 * sum(w.slot for w in articles) >= at.slot else [at]:
        region.mark = "c"


def induce(pages: list[str]) -> Slot:
    """The marked wrapper of one host's pages; copies of a page count once."""
    trees = [parse(p) for p in sorted(set(pages))]
    trees.sort(key=lambda t: -len(t.kids))
    wrapper = as_wrapper(trees[0])
    for t in trees[1:]:
        _merge(wrapper, t)
    mark_region(wrapper)
    return wrapper


class Stored:
    """A wrapper as pages meet it: labels, marks and kids."""

    __slots__ = ("label", "mark", "kids", "ready")

    def __init__(self, label: str, mark: str):
        self.label, self.mark, self.kids, self.ready = label, mark, [], None


def packed(wrapper: Slot) -> str:
    """[label, mark, number of kids] of each node, parents first, as JSON."""
    return json.dumps([[w.label, w.mark, len(w.kids)] for w in below(wrapper)])


def unpacked(text: str) -> Stored:
    root, todo = None, []
    for label, mark, n in json.loads(text):
        node = Stored(label, mark)
        if root is None:
            root = node
        else:
            while not todo[-1][1]:
                todo.pop()
            todo[-1][0].kids.append(node)
            todo[-1][1] -= 1
        todo.append([node, n])
    return root


# Texts.


def _key(label: str, text: str) -> int:
    """What a leaf block is counted by."""
    return int.from_bytes(hashlib.blake2b(f"{label}\n{text}".encode(errors="surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _blocks(node: Node) -> list[tuple[int | None, str]]:
    """The texts of the blocks under ``node`` in page order, those of leaves with their keys."""
    out, todo, run = [], [(node, iter(node.parts), _amid_prose(node))], []

    def flush(leaf: Node | None = None) -> None:
        s = " ".join("".join(run).split())
        if s:
            out.append((_key(leaf.label, s) if leaf is not None else None, s))
        run.clear()

    while todo:
        at, parts, amid = todo[-1]
        part = next(parts, None)
        if part is None:
            flush(None if at.kids or at is node else at)
            todo.pop()
        elif isinstance(part, str):
            run.append(part)
        else:
            flush()
            if not (part.skip or part.named or _menu(part) and id(part) not in amid):
                todo.append((part, iter(part.parts), _amid_prose(part)))
    return out


def _amid_prose(node) -> set[int]:
    """Which children (by identity) stand between two paragraphs of ``node``: links there are the text's own."""
    prose = [i for i, kid in enumerate(node.kids) if kid.tag in PROSE and not (kid.skip or kid.named) and kid.all_chars > 0 and kid.all_links <= 0.6 * kid.all_chars]
    return {id(kid) for kid in node.kids[prose[0] : prose[-1]]} if prose else set()


def _menu(node) -> bool:
    """A list or division that is nearly all links."""
    return node.tag in ("ul", "ol", "div", "table", "dl", "section") and node.all_links > 0.6 * node.all_chars > 0


def read(page: str, wrapper: Stored | None) -> list[tuple[int | None, str]]:
    """The page's content blocks by the wrapper, or by the page alone where that does not fit; keys only in the first case."""
    tree = parse(page)
    pairs = aligned(wrapper, tree) if wrapper is not None else []
    fits = any(w.mark == "c" and n.all_chars for w, n in pairs)
    if not fits:
        alone = as_wrapper(tree)
        mark_region(alone)
        pairs = list(zip(below(alone), below(tree), strict=True))
    for w, n in pairs:
        if w.mark == "k":
            n.named = False
    inside = {id(n) for w, n in pairs if w.mark == "c"}
    out, todo = [], [tree]
    while todo:  # regions in page order
        n = todo.pop()
        if id(n) in inside:
            out += _blocks(n)
        else:
            todo += reversed(n.kids)
    return out if fits else [(None, s) for _, s in out]


def extract(page: str, wrapper: Stored | None, constants: frozenset[int] = frozenset()) -> str:
    """The page's content without the host's constants."""
    return " ".join(s for key, s in read(page, wrapper) if key is None or key not in constants)


def _induce_host(key, frame):
    import pandas as pd

    return pd.DataFrame({"host": [key[0]], "wrapper": [packed(induce(list(frame["html"])))]})


def wrappers(pages: DataFrame, per_host: int = PER_HOST) -> DataFrame:
    """(host, wrapper as JSON) from at most ``per_host`` pages of each host."""
    keyed = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("page_id", F.lit(3)).alias("draw"), F.col("page_id"), "html").filter("html IS NOT NULL")
    order = Window.partitionBy("host").orderBy("draw", "page_id")
    chosen = keyed.select("host", "draw", "page_id").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_host).drop("n").distinct()
    sample = keyed.join(small(materialize(chosen, "html-sample")), ["host", "draw", "page_id"])
    return materialize(sample.groupBy("host").applyInPandas(_induce_host, "host string, wrapper string"), "html-wrappers")


_READ = "page_id long, url string, host string, keys array<long>, lengths array<int>, text string"
_KNOWN_BYTES = 8 << 20  # of wrappers that a task keeps unpacked


def _reader(batches):
    known, size = {}, 0
    for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
        keys, lengths, text = [], [], []
        for host, page, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper")), strict=True):
            if host not in known:
                if size > _KNOWN_BYTES:
                    known, size = {}, 0
                known[host] = unpacked(wrapper) if wrapper else None
                size += len(wrapper or "")
            found = read(page, known[host]) if page is not None else []
            keys.append([k for k, _ in found])
            lengths.append([len(s) for _, s in found])
            text.append(" ".join(s for _, s in found))
        columns = [batch.column("page_id").cast(pa.int64()), batch.column("url"), batch.column("host"), pa.array(keys, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int32())), pa.array(text, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "keys", "lengths", "text"])


def _constants(blocks: DataFrame, evidence: int) -> DataFrame:
    """(host, constants): keys of the blocks that nine tenths of a host's different articles have."""
    longest = F.reverse(F.array_sort(F.filter(F.arrays_zip("lengths", "keys"), lambda b: b["keys"].isNotNull())))
    pages = blocks.select("host", F.array_distinct(F.transform(longest, lambda b: b["keys"])).alias("by_length")).filter(F.size("by_length") > 1)
    # A block's page is told by the longest and the second longest of the page's other blocks.
    key, at = F.col("key"), lambda i: F.get("by_length", F.lit(i))
    first, second = F.when(key == at(0), at(1)).otherwise(at(0)), F.when((key == at(0)) | (key == at(1)), at(2)).otherwise(at(1))
    rows = pages.select("host", F.explode("by_length").alias("key"), F.slice("by_length", 1, 3).alias("by_length"))
    rows = rows.select("host", "key", first.alias("a"), F.coalesce(second, first).alias("b"))
    often = rows.groupBy("host", "key").agg(F.count_distinct("a").alias("a"), F.count_distinct("b").alias("b")).filter(F.least("a", "b") >= evidence)
    articles = pages.groupBy("host").agg(F.count_distinct(at(0)).alias("x"), F.count_distinct(at(1)).alias("y")).select("host", F.greatest("x", "y").alias("articles"))
    found = often.join(articles, "host").filter(F.greatest("a", "b") * 10 >= F.col("articles") * 9)
    return found.groupBy("host").agg(F.collect_list("key").alias("constants"))  # of nine tenths of the articles: no more than fit on a page


def _without_constants(batches):
    for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
        out = []
        for keys, lengths, text, constants in zip(*(batch.column(c).to_pylist() for c in ("keys", "lengths", "text", "constants")), strict=True):
            if constants and not (gone := set(constants)).isdisjoint(keys):
                kept, at = [], 0
                for key, n in zip(keys, lengths, strict=True):
                    if key is None or key not in gone:
                        kept.append(text[at : at + n])
                    at += n + 1
                text = " ".join(kept)
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _by_host(rows: DataFrame, made: DataFrame) -> DataFrame:
    """``rows`` with what was made for their host, which is a table."""
    made = small(made.withColumnRenamed("host", "w_host"))
    return rows.join(made, rows["host"] == made["w_host"], "left").drop("w_host")


def main_text(pages: DataFrame, per_host: int = PER_HOST, evidence: int = EVIDENCE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    blocks = materialize(_by_host(rows, wrappers(pages, per_host)).mapInArrow(_reader, _READ), "html-blocks")
    constants = materialize(_constants(blocks, evidence), "html-constants")
    return _by_host(blocks, constants).mapInArrow(_without_constants, "page_id long, url string, text string, n_chars long")
