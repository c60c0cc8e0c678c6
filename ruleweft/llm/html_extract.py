"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is read into blocks (text between block-level tags) with their chain of ancestors. A linear classifier over a
block's words, closing mark, links and element, and the evidence of its ancestors, give the cost of either label; these
are the terminal capacities. The classifier's weights are fitted on all pages: blocks in marked articles against blocks
in marked menus and footers, counted by cells of their features, with the hand-set weights as the prior's mean. Edges
join successive blocks and successive children of one parent, weighted by how much of the chain of ancestors they
share. The minimum cut, by shortest augmenting paths in phases, splits content from boilerplate; blocks whose evidence
outweighs all their edges are settled first, which leaves small graphs.

An ancestor that names itself boilerplate counts against its text, but not if the page's main part lies inside it: then
it is a wrapper. Headers inside an article don't count against it, so its title and what follows belong to the text.

Null and empty pages give the empty text; pages of any size are read whole, in time that follows their size; equal
pages give equal texts; null ids and repeated rows are rows like all others; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweft.llm.common import slices, small_batches, strings

#: Elements whose text is never shown or belongs to a control, with all that is in them; and those of them that, left
#: open, hide the rest of the page.
RAW = frozenset("script style noscript template textarea select title svg math iframe object canvas audio video button".split())
OPEN_RAW = frozenset("script style".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an opening tag of the same name ends if still open; those that end an open paragraph; and the limits
#: of the search for either.
SELF_ENDING = frozenset("p li dt dd tr td th option".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul p".split())
STOP = frozenset("ul ol dl table tbody thead article section div main aside nav footer form".split()) | {""}
#: What an ancestor adds to a block's evidence for content.
TAG_SCORE = {"article": 4.0, "main": 3.0, "nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "menu": -9.0, "dialog": -9.0, "header": -5.0, "fieldset": -9.0}
BAD = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets related recommended share sharing social subscribe subscription newsletter signup login search footer masthead topbar toolbar comment comments disqus reply replies respond pagination pager skip legal copyright complementary contentinfo dialog".split()
)
WEAK = frozenset("header head top bottom meta tags tools links".split())
GOOD = frozenset("article main content post entry story articlebody prose".split())
#: Words in names that say where or how an element stands; any other word beside a bad one makes the name doubtful.
PLACE = frozenset("area bar block body bottom box button center col column container desktop group inner item items left link links list main mobile outer page panel primary right row secondary section site small text title top wide wrap wrapper".split()) | GOOD | WEAK
#: Names of what readers write, which is never a wrapper while there is any other main part.
READERS = frozenset("comment comments disqus reply replies respond".split())
#: Score of an ancestor that marks the main part, and of one that names itself boilerplate beyond doubt.
MAIN, AGAINST = 3.0, -9.0
#: How many times the text of the best main part in the open one inside boilerplate must hold to be the real one, and
#: the share of a page's text from which an unmarked wrapper holds it.
OUTWEIGH, MOST = 3, 0.6
#: Weight of the edge between successive blocks, and of the one between successive children of a parent.
ADJACENT, SIBLING = 0.6, 0.6
#: Means of the weights of a block's features: 1, words (by eighths, 2 at most), closing mark, share of links, h1, other
#: headings, list items, table cells.
PRIOR = (-0.8, 1.0, 0.4, -3.0, 1.0, 0.0, 0.0, 0.0)
#: Precision of the prior, in labelled blocks.
TRUST = 50.0

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*+>",
    re.S,
)
RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*+>", re.I) for n in RAW}
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Class names that tell of a state of the page around, not of what the element is.
STATE = re.compile(r"(?:has|with|without|no|is|js)[-_]", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(eq=False)
class Element:
    name: str
    parent: Element | None
    score: float = 0.0
    readers: bool = False
    inline: bool = False
    depth: int = 0
    #: The innermost block-level element, or an inline one that says something about its text.
    holder: Element | None = None
    #: Characters of text outside links in it, and the worst and best scores from the root to it.
    mass: int = 0
    low: float = 0.0
    high: float = 0.0


@dataclass(eq=False)
class Block:
    parent: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    #: Depth of the ancestor that it shares with the block before.
    common: int = 0


def _score(name: str, attrs: str, in_article: bool) -> tuple[float, bool]:
    """An element's score by its tag and names, and whether it holds what readers write."""
    score = 0.0 if name == "header" and in_article else TAG_SCORE.get(name, 0.0)
    readers = False
    if attrs and name not in ("html", "body") and (found := ATTR.findall(attrs)):
        good = weak = False
        for a in found:
            for word in (a[1] or a[2] or a[3]).split():
                if STATE.match(word):
                    continue
                tokens = {x.lower() for x in PART.findall(word) + re.split("[-_]", word)}
                if bad := tokens & BAD:
                    whole = word.lower() in BAD
                    score = min(score, AGAINST if whole or not {x.lower() for x in re.split("[-_]", word)} - BAD - PLACE else AGAINST / 2)
                    readers |= bool(bad & READERS)
                good |= bool(tokens & GOOD)
                weak |= bool(tokens & WEAK)
        if score > AGAINST / 2:
            score = max(score, MAIN) if good else score - 2.0 if weak else score
    return score, readers


def blocks(html: str) -> tuple[list[Block], list[Element]]:
    """The page's text blocks in order, blank ones left out, and its elements, parents first."""
    root = Element("", None)
    root.holder = top = root
    every, out = [root], []
    open_names: Counter = Counter()
    links: list[Element] = []  # open ones
    articles = 0
    dead: set[str] = set()
    now, low = Block(root), 0

    def close() -> None:
        nonlocal now, low
        if now.parts:
            now.text = " ".join("".join(now.parts).split())
            if now.text:
                now.common = min(low, now.parent.depth)
                out.append(now)
                low = now.parent.depth
        now = Block(top.holder)

    def put(text: str) -> None:
        nonlocal now
        if not now.parts:
            if text.isspace():
                return
            now = Block(top.holder)
        text = unescape(text)
        now.parts.append(text)
        if links:
            now.linked += len(text)

    def leave(last: Element) -> None:
        """Closes all elements from the innermost one to ``last``."""
        nonlocal top, low, articles
        while True:
            gone, top = top, top.parent
            open_names[gone.name] -= 1
            articles -= gone.name == "article"
            if gone.name == "a" and links and links[-1] is gone:
                links.pop()
            if gone is last:
                break
        low = min(low, top.depth)

    at = 0
    while m := TOKEN.search(html, at):
        if m.start() > at:
            put(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if not open_names[name]:
                continue
            x = top
            while x.name != name:
                x = x.parent
            if name not in INLINE:
                close()
            leave(x)
            if name not in INLINE:
                now = Block(top.holder)
            continue
        if name in RAW:
            if m["attrs"].endswith("/") and name in ("svg", "math"):
                continue
            end = None if name in dead else RAW_END[name].search(html, at)
            if end is None:  # there is none further on either
                dead.add(name)
                # an open script hides the rest of the page, an open control its text up to the next tag
                at = len(html) if name in OPEN_RAW or (cut := html.find("<", at)) < 0 else cut
                continue
            close() if name != "button" else None
            at = end.end()
            continue
        if name in VOID:
            if name in ("br", "hr"):
                now.parts.append(" ") if now.parts else None
            continue
        if name not in INLINE:
            close()
            ends = name if name in SELF_ENDING and name != "p" else "p"
            if (name in SELF_ENDING or name in ENDS_P) and open_names[ends]:
                x = top
                while x.name not in STOP and x.name != ends:
                    x = x.parent
                if x.name not in STOP:
                    leave(x)
        elif name == "a" and links:  # links don't nest
            for x in links:
                open_names["a"] -= 1
                open_names["span"] += 1
                x.name = "span"
            links.clear()
        if not m["attrs"].endswith("/") or name in INLINE or name in ENDS_P:
            score, readers = _score(name, m["attrs"], articles > 0)
            top = Element(name, top, score, readers, name in INLINE, top.depth + 1)
            top.holder = top.parent.holder if top.inline and not score else top
            every.append(top)
            open_names[name] += 1
            articles += name == "article"
            if name == "a":
                links.append(top)
            if name not in INLINE:
                now = Block(top.holder)
    if at < len(html):
        put(html[at:])
    close()
    return out, every


def weigh(found: list[Block], every: list[Element]) -> bool:
    """Gives elements their worst and best scores, wrappers of the main part aside; true if the page marks that part."""
    for b in found:
        b.parent.mass += max(0, len(b.text) - b.linked)
    for e in reversed(every):
        if e.parent is not None:
            e.parent.mass += e.mass
    bad_above: dict[Element, bool] = {}
    for e in every:
        bad_above[e] = e.score <= AGAINST / 2 or e.parent is not None and bad_above[e.parent]
    mains = [e for e in every if e.score >= MAIN and e.mass]
    free = max((e.mass for e in mains if not bad_above[e]), default=0)
    covered = [e for e in mains if bad_above[e]]
    total = every[0].mass

    def clear(e: Element | None, readers: bool) -> bool:
        """Takes the bad scores off an element's ancestors; not those of readers' parts unless asked to."""
        chain = []
        while e is not None:
            chain.append(e)
            e = e.parent
        if not readers and any(x.readers and x.score <= AGAINST / 2 for x in chain):
            return False
        for x in chain:
            x.score = max(x.score, 0.0)
        return True

    best = max(covered, key=lambda e: e.mass, default=None)
    if best is not None and best.mass > OUTWEIGH * free:
        clear(best, readers=not free)
    elif not mains and total:
        # nothing is marked: boilerplate that holds most of the page's text is a wrapper, down to where it doesn't
        for e in every:
            if e.score < 0 and not e.readers and e.mass >= MOST * total and e.name != "nav":
                e.score = 0.0
    for e in every:
        up = e.parent
        e.low, e.high = (min(e.score, up.low), max(e.score, up.high)) if up is not None else (min(e.score, 0.0), max(e.score, 0.0))
    return any(b.parent.high >= MAIN and b.parent.low > -5 for b in found)


def features(b: Block) -> tuple[int, ...]:
    """The cell of a block's features: words by eighths, closing mark, share of links by tenths, element."""
    words = b.text.count(" ") + 1
    name = b.parent.name
    kind = 1 if name == "h1" else 2 if name in ("h2", "h3", "h4", "h5", "h6") else 3 if name in ("li", "dt", "dd") else 4 if name in ("td", "th") else 0
    return min(16, words), int(b.text[-1] in ".!?…:\"'"), round(10 * min(1.0, b.linked / max(1, len(b.text)))), kind


def row(cell: tuple[int, ...]) -> list[float]:
    words, mark, linked, kind = cell
    return [1.0, words / 8, float(mark), linked / 10, *(float(kind == k) for k in (1, 2, 3, 4))]


@dataclass
class Costs:
    """Weights of a block's features."""

    weights: tuple[float, ...] = PRIOR

    def evidence(self, b: Block, marked: bool) -> float:
        """For content if above 0: the text, and the ancestors' scores (the worst counts if bad, else the best).

        ``marked``: the page marks its main part, so text outside it counts for less.
        """
        own = sum(w * x for w, x in zip(self.weights, row(features(b)), strict=True))
        low, high = b.parent.low, b.parent.high
        if marked and high < MAIN:
            own -= 3.0
        return own + (low + 0.25 * high if low <= -5 else low + high)


def fit(cells: dict[tuple, int], trust: float = TRUST) -> Costs:
    """Logistic weights by Newton's method; both labels weigh the same, and the prior's mean is ``PRIOR``.

    ``cells``: numbers of blocks by (label, features).
    """
    n = Counter()
    for (y, *_), k in cells.items():
        n[y] += k
    if not n[0] or not n[1]:
        return Costs()
    x = np.array([row(c[1:]) for c in cells])
    y = np.array([c[0] for c in cells], float)
    w = np.array([k * min(n[c[0]], 1e3) / n[c[0]] for c, k in cells.items()])
    prior = np.array(PRIOR)
    theta = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (w * (y - p)) - trust * (theta - prior)
        h = (x * (w * p * (1 - p))[:, None]).T @ x + trust * np.eye(len(prior))
        step = np.linalg.solve(h, g)
        theta = theta + step
        if np.abs(step).max() < 1e-8:
            break
    return Costs(tuple(float(v) for v in theta))


def min_cut(net: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source's side of a minimum cut.

    ``net[i]``: the source's capacity to i if positive, else i's to the sink (a node's flow straight through is
    cancelled beforehand). Edges have the same capacity either way. A node whose capacity exceeds all its edges is on
    its own side in any minimum cut, so it is settled first and its edges become capacities of its neighbours; of what
    remains each connected part has a flow of its own. Of several minimum cuts the one with the fewest on the source's
    side counts, undecided nodes being on the sink's.
    """
    n, eps = len(net), 1e-9
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in edges:
        if c > 0 and i != j:
            near[i][j] = near[i].get(j, 0.0) + c
            near[j][i] = near[j].get(i, 0.0) + c
    left = list(net)
    side: list[bool | None] = [None] * n
    weight = [sum(x.values()) for x in near]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(left[i]) > weight[i] + eps:
            side[i] = left[i] > 0
            for j, c in near[i].items():
                if side[j] is None:
                    left[j] += c if side[i] else -c
                    weight[j] -= c
                    queue.append(j)
    seen = [s is not None for s in side]
    for start in range(n):
        if seen[start]:
            continue
        part, seen[start] = [start], True
        for i in part:
            for j in near[i]:
                if not seen[j]:
                    seen[j] = True
                    part.append(j)
        if all(left[i] <= eps for i in part):
            for i in part:
                side[i] = False
        else:
            _flow(part, left, near, side)
    return [bool(s) for s in side]


def _flow(part: list[int], left: list[float], near: list[dict[int, float]], side: list[bool | None]) -> None:
    """Settles a connected part: blocking flows over shortest paths until none is left."""
    eps = 1e-9
    inside = set(part)
    room = {i: {j: c for j, c in near[i].items() if j in inside} for i in part}
    while True:
        level = {i: 0 for i in part if left[i] > eps}
        queue, reached = deque(level), False
        while queue:
            i = queue.popleft()
            for j, c in room[i].items():
                if c > eps and j not in level:
                    level[j] = level[i] + 1
                    reached |= left[j] < -eps
                    queue.append(j)
        if not reached:
            for i in part:
                side[i] = i in level
            return
        arcs = {i: iter(list(room[i])) for i in level}
        for s in [i for i in part if left[i] > eps]:
            path = [s]
            while path and left[s] > eps:
                i = path[-1]
                if left[i] < -eps:
                    flow = min(left[s], -left[i], *(room[a][b] for a, b in zip(path, path[1:], strict=False)))
                    left[s] -= flow
                    left[i] += flow
                    cut = len(path)
                    for k in range(len(path) - 2, -1, -1):
                        a, b = path[k], path[k + 1]
                        room[a][b] -= flow
                        room[b][a] += flow
                        if room[a][b] <= eps:
                            cut = k + 1
                    path = path[:cut]
                    continue
                for j in arcs[i]:
                    if room[i][j] > eps and level.get(j, -1) == level[i] + 1:
                        path.append(j)
                        break
                else:
                    path.pop()


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Between successive blocks, and successive children of one parent's parent, by the share of ancestors in common."""
    out: list[tuple[int, int, float]] = []
    last: dict[Element | None, int] = {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, ADJACENT * b.common / max(found[i - 1].parent.depth, b.parent.depth, 1)))
        key = b.parent.parent
        k = last.get(key, i - 1)
        if k < i - 1:
            other = found[k].parent
            both = b.parent.depth if other is b.parent else b.parent.depth - 1
            out.append((k, i, SIBLING * both / max(other.depth, b.parent.depth, 1)))
        last[key] = i
    return out


def main_text(html: str, costs: Costs | None = None) -> str:
    found, every = blocks(html)
    if not found:
        return ""
    marked, costs = weigh(found, every), costs or Costs()
    good = min_cut([costs.evidence(b, marked) for b in found], edges(found))
    return " ".join(b.text for b, g in zip(found, good, strict=True) if g)


def _rows(pages: DataFrame) -> DataFrame:
    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))


CELL = ("label", "words", "mark", "linked", "kind")


def train(pages: DataFrame) -> Costs:
    """Fits the weights on all pages that mark their parts; only counts by cell of features (a few thousand at most)
    come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Counter = Counter()
        for b in slices(batches, "html"):
            for html in strings(b.column(0)):
                found, every = blocks(html)
                weigh(found, every)
                for x in found:
                    e = x.parent
                    if e.low <= AGAINST or e.high >= MAIN and e.low > -5:
                        cells[int(e.low > -5), *features(x)] += 1
        if cells:
            cols = list(zip(*cells, strict=True))
            yield pa.record_batch([*(pa.array(c, pa.int32()) for c in cols), pa.array(list(cells.values()), pa.int64())], [*CELL, "n"])

    rows = _rows(pages).select("html").mapInArrow(run, f"{', '.join(f'{c} int' for c in CELL)}, n long").groupBy(*CELL).agg(F.sum("n").alias("n")).collect()
    return fit({tuple(r[c] for c in CELL): r["n"] for r in sorted(rows)})


def extract(pages: DataFrame, costs: Costs | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each page; without fitted ``costs`` by the prior's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [main_text(h, costs) for h in strings(b.column(2))]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return _rows(pages).mapInArrow(run, "page_id long, url string, text string, n_chars long")
