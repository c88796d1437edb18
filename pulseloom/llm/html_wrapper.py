"""HTML extraction by wrappers inferred from pages of the same host.

A page is a stream of tag and text tokens. Streams of a host are aligned one after another into a union-free
regular expression: tags, text slots, optional groups ( )? and repeated groups ( )+. Neighbours of one tag and
shape fold into a repeated group, tags that only one side has become an optional group, texts that differ become a
slot and texts that never differ stay constant.

The wrapper then tells which part of a host's pages is the article: the element whose own paragraphs hold most of
the letters in slots, over all pages of the host. A page is aligned to the wrapper to find that element in it, and
blocks that stay constant are left out. Tag names and class names only weigh in (see WEIGHT), and the tags
that name themselves menus, forms, scripts and the like are no article. All walks are iterative, and an alignment
takes linear space, so neither deep nor wide pages are an obstacle.
"""

from __future__ import annotations

import html as entities
import base64
import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import byte_slices, small_batches, tidy, written
from pulseloom.llm.url_filter import url_parts

#: Elements whose text is never shown or never article; elements that end a block of text; empty elements;
#: elements whose content is raw text; headings.
NEVER = frozenset("head script style noscript template iframe svg math canvas object nav footer aside form button select textarea input label dialog menu".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: An element of the key closes open elements of the values, up to one of those after the bar.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead tfoot tr td th", "table")}
_CLOSES = {tag: (ends.split(), within.split()) for tag, (ends, within) in CLOSES.items()}
ENDS_P = BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "option", "summary"}
#: Words of class, id and role attributes that mark what is no article (fixed values).
_NOT_MAIN = regex.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumbs?|header|masthead|topbar|footer|foot|sidebar|side|aside|widget\w*|related|recommend\w*|share|sharing|social|comments?|commentlist|reply|replies|respond|disqus|discussion|notices?|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|subscription|signup|login|search|pagination|pager|toolbar|skip|complementary|navigation|contentinfo|banner|alert|dialog|legal|copyright)(?:$|[\s_-])", regex.IGNORECASE)
_MAIN = regex.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story|body|text)(?:$|[\s_-])", regex.IGNORECASE)
_MARKUP = regex.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>", regex.DOTALL)
_TAG = regex.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
#: The same where a quote of the page never closes: quotes mean nothing from there on.
_PLAIN_TAG = regex.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMED = regex.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", regex.IGNORECASE)
SALTS, SLICE = 32, 4 << 20
#: The share of a host's distinct pages that must agree on a constant text.
SHARE = 0.5
#: What letters weigh in an element that says it is the article (+) or whose name hints at it (~), against any other.
WEIGHT = {"+": 32, "~": 2}
#: Cells of an alignment's table; larger ones are halved.
CELLS = 4096


class Node:
    """An element of a page or of a wrapper. shape: L mostly links, H holds blocks with text and a heading among them, B blocks, T text, E none.

    plain and linked are the letters of its own text outside and inside of links, text its crc (0: none, -1: slot). Of a wrapper only:
    repeated, optional and pages, hashes of all pages that have the element (elements of the same pages share one array). They are counted for
    constants only: slots and repeated groups have none.
    """

    __slots__ = ("key", "shape", "children", "kids", "plain", "linked", "text", "repeated", "optional", "pages", "folded")

    def __init__(self, key: str):
        self.key, self.shape, self.children, self.kids = key, "E", [], []
        self.plain = self.linked = self.text = self.repeated = self.optional = 0
        self.pages, self.folded = None, False

    @property
    def tag(self) -> str:
        return self.key.rstrip("+~-")

    @property
    def barred(self) -> bool:
        return self.key.endswith("-")


def _key(tag: str, attributes: str) -> str:
    """An element's name and what its attributes say of its part in the page: - no article, + article, ~ perhaps."""
    if tag in ("html", "body"):
        return tag
    names = {m[1].lower(): (m[2] or "").strip("\"'") for m in _NAMED.finditer(attributes)} if attributes.strip() else {}
    said = " ".join(v for k, v in names.items() if k in ("class", "id", "role", "itemprop"))
    if tag in NEVER or "hidden" in names or names.get("aria-hidden") == "true":
        return tag + "-"
    if tag in ("article", "main") or names.get("role") == "main" or names.get("itemprop") == "articleBody":
        return tag + ("-" if regex.search(r"comment", said, regex.IGNORECASE) else "+")
    if said and _NOT_MAIN.search(said):
        return tag + "-"
    return tag + "~" if said and _MAIN.search(said) else tag


def parse(page: str) -> Node:
    """The tree of a page's token stream. Left-out end tags are supplied; what never closes ends with the page."""
    root = Node("")
    stack, names, open_, declared = [root], [""], {}, 0
    at, size, tags, last = 0, len(page), _TAG, page.rfind(">")

    def pop() -> None:
        nonlocal declared
        declared -= stack.pop().key.endswith("+")
        open_[names.pop()].pop()

    def close(ends, within) -> None:
        deepest = lambda some: max((open_[t][-1] for t in some if open_.get(t)), default=0)
        if (end := deepest(ends)) > deepest(within):
            while len(stack) > end:
                pop()

    while at < size:
        start = page.find("<", at)
        if start < 0 or start > last and not page.startswith("<!--", start):
            stack[-1].children.append(page[at:])
            break
        if page[start + 1 : start + 2] in ("!", "?") and (m := _MARKUP.match(page, start)):
            if start > at:
                stack[-1].children.append(page[at:start])
            at = m.end()
            continue
        m = tags.match(page, start)
        if m is None and tags is _TAG and _PLAIN_TAG.match(page, start):
            tags = _PLAIN_TAG
            m = tags.match(page, start)
        if m is None:
            stack[-1].children.append(page[at : start + 1])
            at = start + 1
            continue
        if start > at:
            stack[-1].children.append(page[at:start])
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if open_.get(tag):
                while names[-1] != tag:
                    pop()
                pop()
            continue
        if tag in ENDS_P and open_.get("p"):
            close(("p",), ("button", "td", "th"))
        if tag in _CLOSES:
            close(*_CLOSES[tag])
        if tag in HEADING and names[-1] in HEADING:
            pop()
        node = Node(_key(tag, m[3] or ""))
        if tag in ("header", "hgroup") and not declared:
            node.key = tag + "-"
        stack[-1].children.append(node)
        if tag in VOID or (m[3] or "").endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = regex.compile(rf"</{regex.escape(tag)}\s*>", regex.IGNORECASE).search(page, at)
            node.children.append(page[at : end.start() if end else size])
            at = end.end() if end else size
            continue
        open_.setdefault(tag, []).append(len(stack))
        stack.append(node)
        names.append(tag)
        declared += node.key.endswith("+")
    return root


def preorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.kids)
    return out


def _own_text(node: Node) -> str:
    return " ".join("".join(c for c in node.children if isinstance(c, str) and c and not c.isspace()).split())


def _crc(text: str) -> int:
    return zlib.crc32(text.encode(errors="replace")) or 1


def measured(root: Node) -> Node:
    """The page's elements with their letters, texts and shapes. Copies of a page have one hash: that of all texts that may be article."""
    every: list[tuple[Node, int, bool]] = []
    todo, texts = [(root, -1, False, False)], []
    while todo:
        node, above, link, barred = todo.pop()
        at = len(every)
        every.append((node, above, link))
        own = _own_text(node)
        link, barred = link or node.key == "a", barred or node.barred
        node.kids = [c for c in node.children if not isinstance(c, str)]
        if own:
            node.text = _crc(own)
            if link:
                node.linked = len(own)
            else:
                node.plain = len(own)
            if not barred:
                texts.append(own)
        todo += [(c, at, link, barred) for c in reversed(node.kids)]
    sums = [[n.plain, n.linked, "T"] for n, _, _ in every]
    for at in range(len(every) - 1, -1, -1):
        node, above, _ = every[at]
        plain, linked, inside = sums[at]
        node.shape = "L" if linked > plain else inside if plain else "E"
        if above >= 0:
            up = sums[above]
            up[0] += plain
            up[1] += linked
            if plain + linked and (inside != "T" or node.tag in BLOCK) and up[2] != "H":
                up[2] = "H" if node.tag in HEADING else "B"
    root.pages = np.frombuffer(hashlib.blake2b("\n".join(texts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.uint64)
    return root


# ---------------------------------------------------------------- alignment


def _lengths(xs: list, ys: list) -> np.ndarray:
    """Lengths of the longest common subsequences of xs with each beginning of ys; a row of the table is one long integer."""
    masks: dict = {}
    for j, y in enumerate(ys):
        masks[y] = masks.get(y, 0) | 1 << j
    full = row = (1 << len(ys)) - 1
    for x in xs:
        if hit := row & masks.get(x, 0):
            row = (row + hit | row - hit) & full
    bits = np.unpackbits(np.frombuffer((~row & full).to_bytes(len(ys) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(ys)]
    return np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])


def common(xs: list, ys: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence in both lists, in order. Space is linear: large tables are halved first."""
    out, todo = [], [(0, len(xs), 0, len(ys))]
    while todo:
        a, b, c, d = todo.pop()
        tail = []
        while a < b and c < d and xs[a] == ys[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and xs[b - 1] == ys[d - 1]:
            b, d = b - 1, d - 1
            tail.append((b, d))
        if tail:  # comes after the middle
            if a < b and c < d:
                todo.append((b, b + len(tail), d, d + len(tail)))
            else:
                out += reversed(tail)
        if a == b or c == d:
            continue
        if (b - a) * (d - c) > CELLS and b - a > 1:
            mid = (a + b) // 2
            left, right = _lengths(xs[a:mid], ys[c:d]), _lengths(xs[mid:b][::-1], ys[c:d][::-1])[::-1]
            cut = c + int((left + right).argmax())
            todo += [(mid, b, cut, d), (a, mid, c, cut)]
            continue
        if b - a == 1:
            if (at := next((j for j in range(c, d) if ys[j] == xs[a]), None)) is not None:
                out.append((a, at))
            continue
        best = [[0] * (d - c + 1) for _ in range(b - a + 1)]
        for i in range(b - 1, a - 1, -1):
            row, below = best[i - a], best[i - a + 1]
            for j in range(d - 1, c - 1, -1):
                row[j - c] = below[j - c + 1] + 1 if xs[i] == ys[j] else max(below[j - c], row[j - c + 1])
        i, j = a, c
        while i < b and j < d:
            if xs[i] == ys[j]:
                out.append((i, j))
                i, j = i + 1, j + 1
            elif best[i - a + 1][j - c] >= best[i - a][j - c + 1]:
                i += 1
            else:
                j += 1
    return out


def aligned(xs: list[tuple[str, str]], ys: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """(i, j) of pairs, (i, -1) and (-1, j) of what one side alone has, in order. Elements of one tag and shape pair first, then of one tag."""
    if xs == ys:
        return [(i, i) for i in range(len(xs))]
    pairs, i, j = [], 0, 0
    for p, q in [*common(xs, ys), (len(xs), len(ys))]:
        if i < p and j < q:
            pairs += [(i + s, j + t) for s, t in common([x[0] for x in xs[i:p]], [y[0] for y in ys[j:q]])]
        pairs.append((p, q))
        i, j = p + 1, q + 1
    out, i, j = [], 0, 0
    for p, q in pairs:
        out += [(k, -1) for k in range(i, p)] + [(-1, k) for k in range(j, q)]
        if p < len(xs):
            out.append((p, q))
        i, j = p + 1, q + 1
    return out


# ---------------------------------------------------------------- wrappers


_NONE = np.zeros(0, np.uint64)


class Column:
    """Elements of aligned pages that stand at one place of a wrapper."""

    __slots__ = ("token", "members", "repeated", "optional")

    def __init__(self, node: Node):
        self.token, self.members, self.repeated, self.optional = (node.key, node.shape), [node], node.repeated, node.optional


def _appended(columns: list[Column], column: Column) -> None:
    """At the end of the columns; a neighbour of one tag and shape makes them a repeated group."""
    if columns and columns[-1].token == column.token:
        last = columns[-1]
        last.members += column.members
        last.repeated, last.optional = 1, last.optional & column.optional
    else:
        columns.append(column)


def _columns(node: Node) -> list[Column]:
    if node.folded:
        return list(map(Column, node.kids))
    out: list[Column] = []
    for kid in node.kids:
        kid.pages = node.pages
        _appended(out, Column(kid))
    return out


def merged(group: list[Node]) -> Node:
    """The least wrapper of measured pages and wrappers: aligned elements, mismatches as optional groups, differing texts as slots."""
    root, all_of = Node(group[0].key), group  # what is merged stays, so that ids tell its arrays apart
    met: dict[tuple, np.ndarray] = {}
    todo = [(group, root)]
    while todo:
        group, out = todo.pop()
        first = group[0]
        out.shape, out.folded = first.shape, True
        out.plain, out.linked = sum(n.plain for n in group), sum(n.linked for n in group)
        out.text = first.text if all(n.text == first.text for n in group) else -1
        out.pages = _NONE
        if out is root or out.text >= 0 and not out.repeated:
            own = {id(n.pages): n.pages for n in group}
            which = tuple(own)
            if which not in met:
                met[which] = np.concatenate(list(own.values())) if len(own) > 1 else first.pages
            out.pages = met[which]
        if len(group) == 1 and first.folded:
            out.kids = first.kids
            continue
        columns = _columns(first)
        for node in group[1:]:
            more = _columns(node)
            pairs = aligned([c.token for c in columns], [c.token for c in more])
            if len(pairs) == len(columns) == len(more):
                for c, d in zip(columns, more):
                    c.members += d.members
                    c.repeated, c.optional = c.repeated | d.repeated, c.optional | d.optional
                continue
            both: list[Column] = []
            for i, j in pairs:
                column = columns[i] if i >= 0 else more[j]
                if i >= 0 and j >= 0:
                    column.members += more[j].members
                    column.repeated, column.optional = column.repeated | more[j].repeated, column.optional | more[j].optional
                else:
                    column.optional = 1
                _appended(both, column)
            columns = both
        for column in columns:
            kid = Node(column.token[0])
            kid.repeated, kid.optional = column.repeated, column.optional
            out.kids.append(kid)
            todo.append((column.members, kid))
    del all_of
    return root


def page_wrapper(page: Node) -> Node:
    """The wrapper of one parsed page."""
    return merged([measured(page)])


def packed(wrapper: Node) -> str:
    order = preorder(wrapper)
    arrays = {id(n.pages): n.pages for n in order}
    place = {k: i for i, k in enumerate(arrays)}
    sets = [base64.b64encode(np.unique(a).tobytes()).decode() for a in arrays.values()]
    return json.dumps([sets, [[n.key, n.shape, n.repeated, n.optional, place[id(n.pages)], n.plain, n.linked, n.text, len(n.kids)] for n in order]])


def unpacked(text: str) -> Node:
    root, todo = None, []
    sets, rows = json.loads(text)
    arrays = [np.frombuffer(base64.b64decode(x), np.uint64) for x in sets]
    for key, *rest, size in rows:
        node = Node(key)
        node.shape, node.repeated, node.optional, at, node.plain, node.linked, node.text = rest
        node.pages, node.folded = arrays[at], True
        if root is None:
            root = node
        else:
            todo.pop().kids.append(node)
        todo += [node] * size
    return root


def expression(wrapper: Node) -> str:
    """The wrapper as a regular expression: #PCDATA slots, ( )? optional and ( )+ repeated groups."""
    out, todo = [], [wrapper]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        name = node.key
        ends = (f"</{name}>" if name else "") + ")+" * node.repeated + ")?" * node.optional
        out.append("(" * (node.repeated + node.optional) + (f"<{name}>" if name else "") + ("" if not node.text else "#PCDATA" if node.text < 0 else "text"))
        todo += [ends, *reversed(node.kids)]
    return "".join(out)


# ---------------------------------------------------------------- the article


#: Elements that count for themselves, not as a paragraph of the element they stand in, unless they repeat (fixed values).
_CONTAINER = frozenset("div section article main td center body html".split())


def article(wrapper: Node) -> list[list]:
    """Where the article stands: the wrapper's elements in preorder as [key, shape, 1 if it holds the article, crc of a constant text or 0, children].

    The article is the element whose paragraphs (blocks without blocks in them) hold most letters in slots over all pages, weighed by
    WEIGHT; elements around it that declare themselves an article are taken whole if it holds half of their letters, and
    headings right before it belong to it. Where no text of the host varies all letters count. Blocks whose whole text is
    constant on SHARE of the host's distinct pages, two at least (three inside a declared article), are marked to be
    left out. Elements without a mark in them have no children here.
    """
    order = preorder(wrapper)
    place = {id(n): i for i, n in enumerate(order)}
    above = [-1] * len(order)
    for i, n in enumerate(order):
        for kid in n.kids:
            above[place[id(kid)]] = i
    barred, weight = [False] * len(order), [1] * len(order)
    for i, n in enumerate(order):
        up = above[i]
        barred[i] = n.barred or up >= 0 and barred[up]
        weight[i] = max(WEIGHT.get(n.key[-1:], 1), weight[up] if up >= 0 else 1)
    many = {k: len(np.unique(a)) for k, a in {id(n.pages): n.pages for n in order}.items()}
    host = many[id(wrapper.pages)]
    letters = [0 if b else n.plain for b, n in zip(barred, order)]
    slots = [x if n.text < 0 else 0 for x, n in zip(letters, order)]
    varies = host > 1 and any(slots)
    own = slots if varies else letters
    total, direct, inner = own[:], own[:], [False] * len(order)
    block = [n.tag in BLOCK for n in order]
    steady = [n.text >= 0 and not n.repeated and many[id(n.pages)] >= max(3 if w == WEIGHT["+"] else 2, SHARE * host) for n, w in zip(order, weight)]
    for i in range(len(order) - 1, 0, -1):
        n, up = order[i], above[i]
        total[up] += total[i]
        inner[up] |= block[i] and total[i] > 0 or inner[i]
        if not block[i]:
            direct[up] += direct[i]
            steady[up] &= steady[i]
        elif not inner[i] and (n.tag not in _CONTAINER or n.repeated):
            direct[up] += total[i]
    found = max((i for i, n in enumerate(order) if (block[i] or not n.key) and not barred[i]), key=lambda i: (direct[i] * weight[i], -i))
    if not total[0]:
        return []
    root, up = found, above[found]
    while up >= 0:
        if order[up].key.endswith("+") and 2 * total[found] >= total[up]:
            root = up
        up = above[up]
    roots, here = {root}, root
    while here > 0 and (up := above[here]) >= 0:
        before = [place[id(k)] for k in order[up].kids]
        before = [i for i in before[: before.index(here)] if total[i] > 0]
        while before and order[before[-1]].tag in HEADING:
            roots.add(before.pop())
        if before:
            break
        here = up
    marks, inside = [0] * len(order), [False] * len(order)
    whole = [False] * len(order)
    for i, n in enumerate(order):
        up = above[i]
        inside[i] = i in roots or up >= 0 and inside[up]
        whole[i] = varies and (steady[i] if block[i] else up >= 0 and whole[up])
        if inside[i] and whole[i] and n.text > 0:
            marks[i] = n.text
    needed = [i in roots or marks[i] > 0 for i in range(len(order))]
    for i in range(len(order) - 1, 0, -1):
        needed[above[i]] |= needed[i]
    out, todo = [], [0]
    while todo:
        i = todo.pop()
        kids = [place[id(k)] for k in order[i].kids]
        kids = kids if any(needed[k] for k in kids) else []
        out.append([order[i].key, order[i].shape, int(i in roots), marks[i], len(kids)])
        todo += reversed(kids)
    return out


class Place:
    """An element of the article's plan, with those in it."""

    __slots__ = ("token", "root", "mark", "kids")

    def __init__(self, row: list):
        self.token, self.root, self.mark, self.kids = (row[0], row[1]), row[2], row[3], []


def _plan(rows: list[list]) -> Place | None:
    top, todo = None, []
    for row in rows:
        here = Place(row)
        if top is None:
            top = here
        else:
            todo.pop().kids.append(here)
        todo += [here] * row[4]
    return top


def _places(page: Node, plan: Place) -> tuple[dict[int, Place], bool]:
    """The plan's place of each element of the page that has one, and whether one of them holds the article."""
    found, any_root, todo = {}, False, [(page, plan)]
    while todo:
        node, here = todo.pop()
        found[id(node)] = here
        any_root = any_root or here.root == 1
        if here.kids:
            runs: list[tuple[tuple[str, str], list[Node]]] = []
            for kid in node.kids:
                if runs and runs[-1][0] == (kid.key, kid.shape):
                    runs[-1][1].append(kid)
                else:
                    runs.append(((kid.key, kid.shape), [kid]))
            for i, j in aligned([r[0] for r in runs], [k.token for k in here.kids]):
                if i >= 0 and j >= 0:
                    todo += [(kid, here.kids[j]) for kid in runs[i][1]]
    return found, any_root


def main_text(page: str, plan: Place | None) -> str:
    """The blocks of a page's article, one a line. A page that has no place for its host's article is a wrapper of its own."""
    root = measured(parse(page))
    places, there = _places(root, plan) if plan else ({}, False)
    if not there:
        plan = _plan(article(merged([root])))
        places, there = _places(root, plan) if plan else ({}, False)
        if not there:
            return ""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            line = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if line:
                blocks.append(line)

    todo: list[tuple] = [(root, False, False)]
    while todo:
        item, inside, fixed = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            if inside and not fixed:
                run.append(item)
        elif not item.barred:
            here = places.get(id(item))
            inside = inside or here is not None and here.root == 1
            fixed = here is not None and here.mark > 0 and here.mark == item.text
            if item.key == "br" and inside:
                run.append(" ")
            if item.tag in BLOCK:
                flush()
                todo.append((None, False, False))
            todo += [(c, inside, fixed) for c in reversed(item.children)]
    flush()
    return "\n".join(blocks)


def infer_wrappers(pages: DataFrame, at_once: int = 16) -> DataFrame:
    """(host, wrapper as JSON) of rows (host, html): folded in each task, then in a few salted groups of a host, then by host."""

    def fold(batches):
        held: dict[str, list[Node]] = {}
        for batch in batches:
            texts = batch.column(1)
            hosts = batch.column(0).to_pylist()
            for a, b in byte_slices(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist(), SLICE):
                for host, page in zip(hosts[a:b], texts.slice(a, b - a).to_pylist()):
                    if page:
                        root = measured(parse(page))
                        for node in preorder(root):
                            node.children = []
                        own = held.setdefault(host, [])
                        own.append(root)
                        if len(own) > at_once:
                            own[:] = [merged(own)]
            if len(held) > 5_000:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([packed(merged(own)) for own in held.values()], pa.string())], ["host", "wrapper"])

    def join(table: pa.Table) -> pa.Table:
        total = None
        for w in sorted(table.column("wrapper").to_pylist()):
            total = merged([total, unpacked(w)]) if total else unpacked(w)
        return pa.table([table.column("host").slice(0, 1), pa.array([packed(total)], pa.string())], names=["host", "wrapper"])

    part = pages.mapInArrow(tidy(fold), "host string, wrapper string")
    salted = part.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))).groupBy("host", "salt").applyInArrow(join, "host string, wrapper string")
    return salted.groupBy("host").applyInArrow(join, "host string, wrapper string")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = 20_000) -> DataFrame:
    """(page_id, url, text) of each row: the article's blocks in page order, one a line, "" if there is none.

    Left out are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and reader
    comments. Character references are decoded once, white space inside a block becomes one space.

    Null and empty pages give "". Pages without a host (null URL) share one wrapper. Repeated rows and null ids each
    give a row, other columns are not read, an empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), url_parts(F.col(url_col).cast("string"))[0].alias("host"))
    wrappers = infer_wrappers(rows.select("host", "html"))

    def plans(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([json.dumps(article(unpacked(w))) for w in batch.column(1).to_pylist()], pa.string())], ["host", "plan"])

    known = written(wrappers.mapInArrow(tidy(plans), "host string, plan string"), "wrappers")
    few = known.count() <= broadcast_hosts
    joined = rows.join(F.broadcast(known) if few else known, "host", "left").select("page_id", "url", "html", "plan")

    def run(batches):
        cache: dict[str, Place | None] = {}
        for batch in batches:
            texts, said = batch.column(2), batch.column(3).to_pylist()
            for a, b in byte_slices(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist(), SLICE):
                out = []
                for page, plan in zip(texts.slice(a, b - a).to_pylist(), said[a:b]):
                    if plan is not None and plan not in cache:
                        if len(cache) > 1000:
                            cache.clear()
                        cache[plan] = _plan(json.loads(plan))
                    out.append(main_text(page, cache.get(plan)) if page else "")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(tidy(run), "page_id long, url string, text string")
