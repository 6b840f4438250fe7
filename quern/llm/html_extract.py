"""Main-text extraction by wrapper induction over pages of the same host.

Pages are parsed into trees of block elements. On each host the pages of one layout (the same set of label paths) have
a reference; every other page of the layout is aligned with it by simple tree matching (the largest order-preserving
matching of equally labelled nodes, by dynamic programming over children). A page that at the matched nodes shares most
of its text with its reference is a copy of it and says nothing about what is constant. All others vote, over all layouts
of the host, for each label path that they have: with its texts, and with whether it is a list of links.

* A text that four in five pages with its path (four at least) have there is template, whichever page lacks it.
* A path whose nodes are lists of links (three or more, nine tenths of their text) on four in five pages (four at least)
  is a menu, even where its entries differ from page to page, unless it stands inside an article or main element.

What varies otherwise is content. The wrapper of a host is its template texts with their paths and its menus' paths;
extraction parses each page again and leaves these out. What varies on every page and still is no content (menus, headers,
footers, sidebars, notices, adverts, forms and comments with other texts each time) can't be told by alignment; it is told
by tags, roles and class names, which also serve hosts with fewer than four different pages.

Every page takes part; equal ones vote once. What travels between tasks is a page's skeleton (labels and text digests,
no text) and sums; the pages of one layout are dealt over salts, so a hot host is no task's alone. The wrapper table is
joined by host: Spark broadcasts it where its size allows, and else shuffles (and splits hot hosts).

Defined cases. Null or empty html gives an empty text. A page without a host, or on a host of fewer than four
different pages, loses only what tags and names tell. Where template and menus are more than half of a host's text, its
pages are copies or indexes and keep it all. Repeated pages are each extracted. Unclosed elements end where HTML lets
them, broken markup is text, and a page cut off in the middle is read as far as it goes. Pages may be nested or wide to
any degree. Other columns of the caller, whatever their names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, col, group_minima, map_text, materialise, spread
from .url_filter import url_parts

TAG = re.compile(
    r"""<!--(?:-?>|.*?-->|.*)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest2>[^>]*)>""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul button noscript template object svg canvas video audio iframe script style textarea title".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Start tag: what it closes, and what that closing doesn't go beyond.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
#: What is no content wherever it stands.
NOT_CONTENT = frozenset("head nav header footer aside form script style noscript iframe template button select svg dialog menu search object canvas video audio textarea title".split())
NOT_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NOT_CONTENT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion promotions nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars side aside footer header masthead topbar comment comments commentlist reply replies respond discussion disqus cookie cookies notice notices consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager skip alert".split()
)


#: Of these, words that also stand in names of content, so that all other parts of the name must be known ones.
OFTEN_CONTENT = frozenset("side social related recommended recommendations share sharing skip alert notice notices discussion promotion promotions respond reply replies subscription consent widget widgets banner banners".split())
PLAIN_PARTS = frozenset("list lists area section wrap wrapper container block box bar inner outer content main left right top bottom primary secondary first second col column row item items entry link links title heading form unit slot group panel holder site page global local user reader post posts article articles blog google module region zone stories buttons icons media bookmarks to".split())
#: Parts of names that tell how a block is shown, or what the page around has or lacks.
STATES = frozenset("no has have with without is not hide hidden show shown fixed sticky open opened closed enabled disabled none off on visible expanded collapsed".split())


def named_boiler(name: str) -> bool:
    """Whether a class name or id says that a block is no content."""
    parts = [p for p in re.split(r"[-_]+", name) if p]
    said = NOT_CONTENT_WORDS.intersection(parts)
    if not said or STATES.intersection(parts):
        return False
    return bool(said - OFTEN_CONTENT) or all(p in NOT_CONTENT_WORDS or p in PLAIN_PARTS or p.isdigit() for p in parts)


class Node:
    __slots__ = ("boiler", "children", "depth", "label", "linked", "named", "parent", "tag", "text")

    def __init__(self, tag: str, label: str, parent: Node | None, boiler: bool, named: bool = False):
        self.tag, self.label, self.parent = tag, label, parent
        #: no content by its tag or role, or (named) by its name alone
        self.boiler, self.named = boiler or named, named and not boiler
        self.depth = 0 if parent is None else parent.depth + 1
        #: pieces of text and nodes, in order; None is a break
        self.children: list[Node] = []
        self.text: list[str | Node | None] = []
        #: pieces of text that stand in links
        self.linked: list[str] = []


def _node(tag: str, rest: str, parent: Node | None) -> Node:
    names: list[str] = []
    boiler = tag in NOT_CONTENT
    if rest:
        for name, a, b, c in ATTRIBUTE.findall(rest):
            value = (a or b or c).lower()
            if name.lower() == "role":
                boiler |= value.strip() in NOT_CONTENT_ROLES
            else:
                names += value.split()
    named = tag not in ("html", "body", "main") and any(map(named_boiler, names))
    label = ".".join([tag, *sorted({re.sub(r"\d+", "", n) for n in names})])
    return Node(tag, label, parent, boiler, named)


def _keep_most(nodes: list[Node]) -> None:
    """A block that holds nearly all text of the page (19 parts in 20, what is no content by tags and roles apart) is content, whatever its name."""
    size = [0] * len(nodes)
    where = {id(x): i for i, x in enumerate(nodes)}
    for i in range(len(nodes) - 1, -1, -1):  # children come after their parents
        x = nodes[i]
        if x.boiler and not x.named:
            size[i] = 0
            continue
        size[i] += sum(len(t) - t.count(" ") for t in x.text if isinstance(t, str) and not t.isspace())
        if x.parent is not None:
            size[where[id(x.parent)]] += size[i]
    for x, n in zip(nodes, size, strict=True):
        if x.named and n >= 0.95 * size[0]:
            x.boiler = False


def parse(page: str) -> Node:
    """The tree of block elements; inline markup leaves its text in the block around it.

    Open elements are kept by tag, so that no end tag and no implied end climbs through what it doesn't close; and behind the
    last ``>`` there are no tags to search for. So the time grows with the page's length, however broken it is.
    """
    root = top = Node("#", "#", None, False)
    nodes = [root]
    at, n, last = 0, len(page), page.rfind(">")
    low = link = None  # link: the block in which a link is open
    opened: dict[str, list[Node]] = {}  # outermost first

    def close_to(node: Node) -> None:
        nonlocal top
        while top is not node:
            opened[top.tag].pop()
            top = top.parent

    def innermost(tags) -> int:
        return max((opened[t][-1].depth for t in tags if opened.get(t)), default=-1)

    def say(text: str) -> None:
        top.text.append(text)
        if link is top:
            top.linked.append(text)

    while at < n:
        m = TAG.search(page, at) if at <= last else None
        if m is None:
            begun = page.find("<!--", at)
            say(page[at:] if begun < 0 else page[at:begun])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m["name"] or m["name2"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag == "a":
                link = None
            elif tag in BLOCK and opened.get(tag):
                node = opened[tag][-1]
                if not (tag == "li" and innermost(("ul", "ol")) > node.depth) and not (tag == "p" and top.tag != "p"):
                    close_to(node.parent)
            continue
        if tag not in BLOCK:
            if tag == "br":
                top.text.append(None)
            elif tag == "a":
                link = top
            continue
        rest = m["rest"] or m["rest2"] or ""
        if tag in CLOSES_P and top.tag == "p":
            close_to(top.parent)
        if tag in IMPLIED:
            closes, within = IMPLIED[tag]
            floor = innermost(within)
            # the outermost open one inside of what holds them
            found = [stack[bisect_right(stack, floor, key=lambda x: x.depth)] for t in closes if (stack := opened.get(t)) and stack[-1].depth > floor]
            if found:
                close_to(min(found, key=lambda x: x.depth).parent)
        node = _node(tag, rest, top)
        nodes.append(node)
        top.children.append(node)
        top.text.append(node)
        if tag in VOID or (rest.endswith("/") and tag in ("svg",)):
            continue
        if tag in RAW:
            if low is None:
                low = page.lower()
            end = low.find("</" + tag, at)
            at = n if end < 0 else end
            if end >= 0:
                close = page.find(">", end)
                at = n if close < 0 else close + 1
            continue
        top = node
        opened.setdefault(tag, []).append(node)
    if any(x.named for x in nodes):
        _keep_most(nodes)
    return root


def own_text(node: Node) -> str:
    """The text of a node outside its child blocks, white space as one space."""
    return " ".join(" ".join(html.unescape("".join(run)).split()) for run in _runs(node)).strip()


def _runs(node: Node) -> Iterator[list[str]]:
    """Stretches of text between breaks and child blocks."""
    run: list[str] = []
    for x in node.text:
        if isinstance(x, str):
            run.append(x)
        elif run:
            yield run
            run = []
    if run:
        yield run


def digest(text: str) -> str:
    return xxhash.xxh3_64_hexdigest(text) if text else ""


def inner_path(outer: str, label: str) -> str:
    return digest(outer + ">" + label)


#: Places in a skeleton's node: the number of the node around it (-1: none), label, digest of its own text, its length,
#: length of its text in links.
PARENT, LABEL, TEXT, CHARS, LINKED = range(5)


def skeleton(page: str) -> list[list]:
    """The nodes of a page outside what tags and names tell to be no content, in page order."""
    out: list[list] = []
    stack = [(parse(page), -1)]
    while stack:
        node, outer = stack.pop()
        if not node.boiler:
            text = own_text(node)
            linked = len(" ".join(html.unescape(" ".join(node.linked)).split())) if node.linked else 0
            stack += [(c, len(out)) for c in reversed(node.children)]
            out.append([outer, node.label, digest(text), len(text), min(linked, len(text))])
    return out


def paths_of(nodes: list[list]) -> list[str]:
    """Digest of the label path of each node."""
    out: list[str] = []
    for x in nodes:
        out.append(inner_path(out[x[PARENT]] if x[PARENT] >= 0 else "", x[LABEL]))
    return out


def skeletons(pages: list[str]) -> dict:
    """The skeleton of each page, its layout (digest of its set of paths) and its content (digest of its texts with their paths; empty: no text)."""
    out: dict[str, list[str]] = {"skeleton": [], "layout": [], "content": []}
    for page in pages:
        nodes = skeleton(page)
        paths = paths_of(nodes)
        out["skeleton"].append(json.dumps(nodes, separators=(",", ":")))
        out["layout"].append(digest(" ".join(sorted(set(paths)))))
        out["content"].append(digest(" ".join(f"{path}:{x[TEXT]}" for path, x in zip(paths, nodes, strict=True) if x[CHARS])))
    return out


class Tree:
    """A skeleton with children, shapes (equal numbers: equal subtrees of labels) and subtree sizes."""

    def __init__(self, nodes: list[list], shapes: dict):
        self.nodes = nodes
        self.children: list[list[int]] = [[] for _ in nodes]
        for i, x in enumerate(nodes):
            if x[PARENT] >= 0:
                self.children[x[PARENT]].append(i)
        self.shape, self.size = [0] * len(nodes), [1] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            kids = self.children[i]
            self.size[i] += sum(self.size[k] for k in kids)
            self.shape[i] = shapes.setdefault((nodes[i][LABEL], *(self.shape[k] for k in kids)), len(shapes))


def _trimmed(xs: list[int], ys: list[int]) -> tuple[int, int]:
    """Equal shapes at the start and at the end of two lists: matching them with each other is always best."""
    most = min(len(xs), len(ys))
    head = next((i for i in range(most) if xs[i] != ys[i]), most)
    tail = next((i for i in range(most - head) if xs[-1 - i] != ys[-1 - i]), most - head)
    return head, tail


def match(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """Simple tree matching: the pairs (node of a, node of b) of the largest matching of two skeletons."""
    if not a or not b or a[0][LABEL] != b[0][LABEL]:
        return []
    shapes: dict = {}
    s, t = Tree(a, shapes), Tree(b, shapes)
    known: dict[tuple[int, int], int] = {}

    def weight(i: int, j: int) -> int | None:
        """Size of the largest matching of two subtrees; None where it isn't known yet."""
        if s.shape[i] == t.shape[j]:
            return s.size[i]
        if a[i][LABEL] != b[j][LABEL]:
            return 0
        if not s.children[i] or not t.children[j]:
            return 1
        return known.get((s.shape[i], t.shape[j]))

    def middle(i: int, j: int) -> tuple[int, int, list[int], list[int]]:
        xs, ys = s.children[i], t.children[j]
        head, tail = _trimmed([s.shape[x] for x in xs], [t.shape[y] for y in ys])
        return head, tail, xs[head : len(xs) - tail], ys[head : len(ys) - tail]

    def kinds(xs: list[int], shape: list[int]) -> tuple[list[int], np.ndarray]:
        """One node of each shape among ``xs``, and which of these each is."""
        first: dict[int, int] = {}
        at = [first.setdefault(shape[x], len(first)) for x in xs]
        one = {k: x for k, x in zip(at, xs, strict=True)}
        return [one[k] for k in range(len(first))], np.array(at, np.int64)

    def table(xs: list[int], ys: list[int], keep: bool) -> tuple[int, list]:
        """Largest order-preserving matching of two lists; with ``keep`` its steps, as packed rows (same as above, same as left)."""
        one, at_x = kinds(xs, s.shape)
        two, at_y = kinds(ys, t.shape)
        w = np.array([[weight(x, y) for y in two] for x in one], np.int64).reshape(len(one), len(two))[:, at_y]
        above, steps = np.zeros(len(ys) + 1, np.int64), []
        for k in at_x:
            row = np.zeros(len(ys) + 1, np.int64)
            np.maximum.accumulate(np.maximum(above[1:], above[:-1] + w[k]), out=row[1:])
            if keep:
                steps.append((np.packbits(row[1:] == above[1:]), np.packbits(row[1:] == row[:-1])))
            above = row
        return int(above[-1]), steps

    def learn(i: int, j: int) -> None:
        """Weights of all pairs below (i, j) that are needed, without recursion."""
        stack = [(i, j)]
        while stack:
            i, j = stack[-1]
            if weight(i, j) is not None:
                stack.pop()
                continue
            head, tail, xs, ys = middle(i, j)
            missing = [(x, y) for x in kinds(xs, s.shape)[0] for y in kinds(ys, t.shape)[0] if weight(x, y) is None]
            if missing:
                stack += missing
                continue
            same = s.children[i][:head] + s.children[i][len(s.children[i]) - tail :]
            known[s.shape[i], t.shape[j]] = 1 + sum(s.size[x] for x in same) + (table(xs, ys, False)[0] if xs and ys else 0)
            stack.pop()

    learn(0, 0)
    found, stack = [], [(0, 0)]
    while stack:
        i, j = stack.pop()
        found.append((i, j))
        if not s.children[i] or not t.children[j]:
            continue
        head, tail, xs, ys = middle(i, j)
        left, right = s.children[i], t.children[j]
        stack += [*zip(left[:head], right[:head], strict=True), *zip(left[len(left) - tail :], right[len(right) - tail :], strict=True)]
        if xs and ys:
            steps = table(xs, ys, True)[1]
            x, y = len(xs), len(ys)
            while x and y:
                up, back = steps[x - 1]
                bit = 128 >> ((y - 1) & 7)
                if up[(y - 1) >> 3] & bit:
                    x -= 1
                elif back[(y - 1) >> 3] & bit:
                    y -= 1
                else:
                    x, y = x - 1, y - 1
                    stack.append((xs[x], ys[y]))
    return found


def is_copy(reference: list[list], mine: list[list]) -> bool:
    """Whether most of a page's text is the same, at matched nodes, as the reference's."""
    same = sum(mine[j][CHARS] for i, j in match(reference, mine) if reference[i][TEXT] == mine[j][TEXT])
    return same > 0.5 * sum(x[CHARS] for x in mine)


def link_lists(nodes: list[list]) -> list[tuple[bool, int]]:
    """For each node whether its subtree is a list of links (three or more, nine tenths of its text), and its characters."""
    sums = [[x[CHARS], x[LINKED], int(x[LINKED] > 0)] for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        outer = sums[nodes[i][PARENT]]
        for k in range(3):
            outer[k] += sums[i][k]
    return [(links >= 3 and linked >= 0.9 * chars, chars) for chars, linked, links in sums]


VOTES = pa.schema([("host", pa.string()), ("path", pa.string()), ("text", pa.string()), ("outer", pa.string()), ("pages", pa.int64()), ("chars", pa.int64()), ("lists", pa.int64()), ("whole", pa.int64())])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host, path and text digest (empty: any): pages that have it and its characters; for a path also the path around it,
    pages where all its nodes are lists of links, and characters with what is inside. Summed over the batch."""
    for batch in batches:
        sums: dict[tuple[str, str, str, str], list[int]] = {}
        known: dict[str, list] = {}
        for host, ref, own in zip(*(batch.column(k).to_pylist() for k in ("host", "reference", "skeleton")), strict=True):
            if ref not in known:
                known = {ref: json.loads(ref)}
            mine = json.loads(own)
            if own != ref and is_copy(known[ref], mine):
                continue
            page: dict[tuple[str, str, str], list[int]] = {}
            paths = paths_of(mine)
            for x, path, (links, inside) in zip(mine, paths, link_lists(mine), strict=True):
                outer = paths[x[PARENT]] if x[PARENT] >= 0 else ""
                for text in {"", x[TEXT]}:
                    got = page.setdefault((path, text, outer), [0, 1, 0])
                    got[0] += x[CHARS]
                    got[1] &= links
                    got[2] += inside
            for (path, text, outer), (chars, links, inside) in page.items():
                total = sums.setdefault((host, path, text, outer), [0, 0, 0, 0])
                for k, v in enumerate((1, chars, links, inside)):
                    total[k] += v
        if sums:
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in sums], pa.string()) for i in range(4)), *(pa.array([v[i] for v in sums.values()], pa.int64()) for i in range(4))], schema=VOTES)


def induce(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = 4, constant: float = 0.8) -> DataFrame:
    """host, wrapper (its template texts as path:digest, and its menus as path) for each host of ``pages`` (columns id, host, html) that has any."""
    source = pages.filter("host <> ''").select("host", F.col(html_col).alias("html"))
    rows = map_text(source, "html", ["host"], skeletons, "skeleton string, layout string, content string").filter("content <> ''")
    rows = materialise(rows.groupBy("host", "layout", "content").agg(F.min("skeleton").alias("skeleton")), "skeletons")
    parts, groups = group_minima(rows, ["host", "layout"], "content")
    first = rows.join(groups.select("host", "layout", F.col("first").alias("content")), ["host", "layout", "content"]).select("host", "layout", F.col("skeleton").alias("reference"))
    first = materialise(first, "references")
    with_ref = spread(rows, parts, first, ["host", "layout"], "content").select("host", "reference", "skeleton")
    votes = with_ref.mapInArrow(_votes, "host string, path string, text string, outer string, pages long, chars long, lists long, whole long")
    votes = materialise(votes.groupBy("host", "path", "text").agg(*(F.sum(c).alias(c) for c in ("pages", "chars", "lists", "whole")), F.min("outer").alias("outer")), "votes")
    every = votes.filter("text = ''").drop("text")
    menus = every.filter((F.col("pages") >= least) & (F.col("lists") >= constant * F.col("pages"))).select("host", "path", "outer", "whole")
    around = menus.select("host", F.col("path").alias("outer"))
    outmost = menus.join(around, ["host", "outer"], "left_anti").select("host", F.col("path").alias("rule"), F.col("whole").alias("chars"))
    fixed = votes.filter((F.col("text") != "") & (F.col("pages") >= least)).join(every.select("host", "path", F.col("pages").alias("of")), ["host", "path"]).filter(F.col("pages") >= constant * F.col("of"))
    rules = fixed.select("host", F.concat_ws(":", "path", "text").alias("rule"), "chars").unionByName(outmost)
    by_host = rules.groupBy("host").agg(F.sum("chars").alias("fixed"), F.array_sort(F.collect_list("rule")).alias("wrapper"))  # five for four texts of a page at most, and its menus
    whole = every.groupBy("host").agg(F.sum("chars").alias("whole"))
    return materialise(by_host.join(whole, "host").filter("fixed <= 0.5 * whole").select("host", F.to_json("wrapper").alias("wrapper")), "wrappers")


def extract(page: str, rules: list[str] | None) -> str:
    """The main text of a page by its host's wrapper."""
    if not page:
        return ""
    drop, blocks, run = set(rules or ()), [], []

    def end_run() -> None:
        if run and (text := " ".join(html.unescape("".join(run)).split())):
            blocks.append(text)
        run.clear()

    def opened(node: Node, outer: str, inside: bool) -> tuple[Iterator, str, bool] | None:
        """What is left of a node: its pieces, or only its child nodes where its text is template; its path; and whether it is
        in the article, whose lists of links are content."""
        path = inner_path(outer, node.label) if drop else ""
        inside |= node.tag in ("article", "main")
        if node.boiler or (path in drop and not inside):
            return None
        return (iter(node.children if drop and f"{path}:{digest(own_text(node))}" in drop else node.text), path, inside)

    stack = [opened(parse(page), "", False)]
    while stack:
        if stack[-1] is None:
            stack.pop()
            continue
        pieces, path, inside = stack[-1]
        for x in pieces:
            if isinstance(x, str):
                run.append(x)
                continue
            end_run()
            if x is not None:
                stack.append(opened(x, path, inside))
                break
        else:
            end_run()
            stack.pop()
    return " ".join(blocks)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, list[str]] = {}
    for batch in batches:
        pages, wrappers = (batch.column(k).to_pylist() for k in ("html", "wrapper"))
        for at in range(0, len(pages), 256):
            texts = []
            for page, w in zip(pages[at : at + 256], wrappers[at : at + 256], strict=True):
                if w is not None and w not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[w] = json.loads(w)
                texts.append(extract(page or "", known.get(w)))
            part = batch.slice(at, 256)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars."""
    bound_batches(pages.sparkSession)
    host, _ = url_parts(col(url_col))
    rows = pages.select(col(id_col).alias("id"), col(url_col).alias("url"), host.alias("host"), col(html_col).alias("html"))
    wrappers = induce(rows, "id", "html")
    joined = rows.join(wrappers, "host", "left").select("id", "url", "html", "wrapper")
    made = joined.mapInArrow(_extract, f"id {dict(rows.dtypes)['id']}, url string, text string, n_chars long")
    return made.toDF(id_col, url_col, "text", "n_chars")
