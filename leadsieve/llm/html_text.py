"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is read into blocks: the text between block-level tags. A linear classifier over text and link
features, learned from pages that mark their article, and fixed costs for telling elements and names
give each block a cost for either label; those are the capacities to the two terminals. Neighbours
in page order, and the next block under the same element, are joined by edges that are stronger the
closer they are in the DOM. The minimum cut separates content from boilerplate.

Blocks whose own cost outweighs all their edges have their label in every minimum cut; they are
settled first, which changes no cut's value but for a constant, and maximum flow handles the rest.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadsieve.llm.common import map_batches, small_batches, texts_of

#: Elements whose text is never shown or never prose.
RAW = frozenset("script style noscript template svg math iframe object canvas head title audio video textarea select datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the first closes an open element of the second.
CLOSES = {x: frozenset(x.split()) for x in ("li", "option", "tr")} | {"td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd"))}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

BOILERPLATE_TAGS = frozenset("nav footer aside form button menu dialog fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
#: Words of class, id and role that tell; a name counts if one of its words begins with a stem or is a word.
BOILERPLATE_WORDS = frozenset("ad ads adv tag tags nav menu share bio byline rss top skip legal cta crumb crumbs toc tools meta pager hidden".split())
BOILERPLATE_STEMS = (
    "advert sponsor promo banner sidebar footer header masthead navig breadcrumb cookie consent gdpr notice notif alert popup overlay modal "
    "newsletter subscri signup login register social sharing related recommend comment disqus respond reply replies widget paginat copyright "
    "toolbar searchbox complementary contentinfo teaser outbrain taboola"
).split()
#: Of these, words that name sections of an article too (`related-work`, `social-history`, `notice-period`, `top`).
AMBIGUOUS = "related social top notice legal tools bio meta tag tags register alert notif response".split()
CONTENT_WORDS = frozenset("article content main post entry story body text".split())

#: Costs of telling names and elements, in the classifier's units (log odds).
TAG_COST, NAME_COST, CONTENT_GAIN = 8.0, 6.0, 4.0
#: Cost of an ambiguous name inside an article, where the text decides.
AMBIGUOUS_COST = 2.0
LOGIT_LIMIT = 3.0
#: Strength of edges between neighbours in page order and under one element.
ADJACENT, SIBLING = 1.2, 0.6

#: Weights where no page of the sample marks both content and boilerplate:
#: constant, log words, link density, end of a sentence, commas, heading, list item.
DEFAULT = np.array([-1.5, 0.8, -4.0, 1.0, 0.5, 0.5, -1.0])
SAMPLE_PAGES, SAMPLE_BYTES = 300, 200_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden(?=[\s>/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("text", "links", "tag", "parent", "depth", "low", "prior", "known", "score")

    def __init__(self, text, links, tag, parent, depth, low, prior, known):
        self.text, self.links, self.tag, self.parent = text, links, tag, parent
        self.depth, self.low = depth, low  # depth in the tree; least depth since the block before
        self.prior, self.known = prior, known  # cost of names; label that the markup itself states
        self.score = 0.0


#: What an element's own tag and names say: nothing, content, boilerplate by name or as a form, boilerplate.
PLAIN, CONTENT, NAMED, HARD = range(4)


def _told(tag: str, attributes: str, inside_content: bool) -> tuple[int, float, float, int, bool]:
    """(kind, cost, gain, stated label or -1, ambiguous); gain and label hold where the cost does not."""
    if (tag in BOILERPLATE_TAGS and tag != "form") or (tag == "header" and not inside_content):
        return HARD, -TAG_COST, 0.0, 0, False
    gain, known = (CONTENT_GAIN, 1) if tag in CONTENT_TAGS else (0.0, -1)
    cost, ambiguous = -TAG_COST if tag == "form" else 0.0, False
    if attributes and tag not in ("body", "html"):
        if _HIDDEN.search(attributes):
            return HARD, -TAG_COST, 0.0, 0, False
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
        words = [w.lower() for w in _WORDS.findall(names)] if names else ()
        telling = [w for w in words if w in BOILERPLATE_WORDS or w.startswith(tuple(BOILERPLATE_STEMS))]
        if telling:
            ambiguous = not cost and all(w.startswith(tuple(AMBIGUOUS)) for w in telling)
            cost = min(cost, -NAME_COST)
        elif any(w in CONTENT_WORDS for w in words):
            gain = max(gain, CONTENT_GAIN / 2)
    return NAMED if cost else CONTENT if gain else PLAIN, cost, gain, known, ambiguous


class Mark:
    """An element that tells something, with the text found under it."""

    __slots__ = ("up", "tag", "kind", "cost", "gain", "stated", "ambiguous", "hard", "text", "top", "main", "under", "free", "worst", "best", "known")

    def __init__(self, up, tag, kind, cost, gain, stated, ambiguous, hard):
        self.up, self.tag, self.kind, self.cost, self.gain, self.stated = up, tag, kind, cost, gain, stated
        self.ambiguous, self.hard = ambiguous, hard
        self.text = self.top = self.under = 0  # characters outside links: of the element, its longest content element, its content ancestors
        self.main, self.free = False, True  # holds a <main>; stands under no name or form cost
        self.worst, self.best, self.known = 0.0, 0.0, -1


def _settle(marks: list[Mark]) -> None:
    """Inherited costs, gains and labels, once the text under every element is known.

    A name or form cost is not inherited from an element that wraps the page's content: one that holds
    a <main>, or most of the page's text, or the longest content element and that a quarter of the text.
    It is inherited all the same if a longer content element, of a tenth of the text or more, lies
    elsewhere under no such cost. Inside a content element an ambiguous name costs so little that the text
    decides, and it states no label. `text` comes with what stands directly in each element.
    """
    for m in reversed(marks[1:]):
        if not m.hard:
            marks[m.up].text += m.text
    shown = [m for m in marks if not m.hard and m.gain and m.text]
    # articles where there are any, else <main>, else elements named so
    best = next((t for t in ("article", "main") if any(m.tag == t for m in shown)), None)
    chosen = {id(m) for m in shown if best in (None, m.tag)}
    for m in reversed(marks[1:]):
        if not m.hard:
            m.top = max(m.top, m.text if id(m) in chosen else 0.0)
            m.main = m.main or m.tag == "main"
            up = marks[m.up]
            up.top, up.main = max(up.top, m.top), up.main or m.main
    page, rival = marks[0], 0
    for m in marks[1:]:
        m.free = marks[m.up].free and m.kind != NAMED
        if m.free and id(m) in chosen and 10 * m.text >= page.text:
            rival = max(rival, m.text)
    for m in marks[1:]:
        up = marks[m.up]
        m.under = max(up.under, m.text if id(m) in chosen else 0.0)
        m.worst, m.best, m.known = up.worst, up.best, up.known
        cost = m.cost
        if m.kind == NAMED:
            holds = 2 * m.text > page.text or (m.top >= page.top and 4 * m.top >= page.text > 0)
            if m.main or (holds and max(m.top, m.under) >= rival):
                cost = 0.0
        if cost and m.ambiguous and up.under:
            m.worst, m.known = min(m.worst, -AMBIGUOUS_COST), 0 if m.known == 0 else -1
        elif cost:
            m.worst, m.known = min(m.worst, cost), 0
        else:
            m.best = max(m.best, m.gain)
            m.known = 0 if m.known == 0 else max(m.known, m.stated)


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in page order, character references decoded, white space folded."""
    out: list[Block] = []
    marks = [Mark(0, "", PLAIN, 0.0, 0.0, -1, False, False)]
    # tag, element number, the nearest element that tells something, whether one tells content
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
    of_block: list[int] = []
    parts: list[str] = []
    link_parts: list[str] = []
    links = elements = 0
    low, at, size = 0, 0, len(page)

    def flush():
        nonlocal low
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            linked = len(_SPACE.sub(" ", html.unescape("".join(link_parts))).strip())
            tag, number, mark, _ = stack[-1]
            marks[mark].text += max(0, len(text) - linked)
            of_block.append(mark)
            holder = stack[-2][1] if len(stack) > 1 else number
            out.append(Block(text, min(1.0, linked / len(text)), tag, holder, len(stack), min(low, len(stack)), 0.0, -1))
            low = len(stack)
        parts.clear()
        link_parts.clear()

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            parts.append(page[at:lt])
            if links:
                link_parts.append(page[at:lt])
        if lt == size:
            break
        m = _TOKEN.match(page, lt)
        if m is None:  # a bare sign
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag, attributes = name.lower(), m[3]
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE:
                continue
            if tag == "br":
                parts.append(" ")
                continue
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    low = min(low, len(stack))
                    break
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):  # code up to the end; the others are as good as closed at once
                    at = size
            if tag not in ("svg", "math"):
                flush()
            continue
        if tag in INLINE:
            links += tag == "a"
            continue
        if tag == "br" or tag == "input":
            parts.append(" ")
            continue
        flush()
        links = 0
        if tag in VOID or attributes.endswith("/"):
            continue
        closed = CLOSES.get(tag)
        if stack[-1][0] == "p" or (closed and stack[-1][0] in closed) or (tag in HEADINGS and stack[-1][0] in HEADINGS):
            stack.pop()
            low = min(low, len(stack))
        _, _, mark, inside = stack[-1]
        kind, cost, gain, stated, ambiguous = _told(tag, attributes, inside)
        elements += 1
        if kind != PLAIN:
            marks.append(Mark(mark, tag, kind, cost, gain, stated, ambiguous, kind == HARD or marks[mark].hard))
            mark = len(marks) - 1
        stack.append((tag, elements, mark, inside or gain > 0))
    flush()
    _settle(marks)
    for b, k in zip(out, of_block, strict=True):
        m = marks[k]
        b.prior, b.known = m.worst if m.worst < 0 else m.best, m.known
    return out


def features(b: Block) -> list[float]:
    words = b.text.count(" ") + 1
    return [1.0, math.log(words), b.links, float(b.text[-1] in ".!?…»”\"')"), min(1.0, 5 * b.text.count(",") / words), float(b.tag in HEADINGS), float(b.tag == "li")]


def learn(pages: list[str]) -> np.ndarray:
    """Logistic weights from the blocks whose markup states a label; DEFAULT without both labels."""
    rows, labels = [], []
    for page in pages:
        for b in blocks_of(page):
            if b.known >= 0:
                rows.append(features(b))
                labels.append(b.known)
    y = np.array(labels, dtype=np.float64)
    if len(set(labels)) < 2:
        return DEFAULT
    x = np.array(rows)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w = DEFAULT.copy()
    for _ in range(30):  # Newton steps on a loss with a ridge towards the defaults
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - y)) + 0.01 * (w - DEFAULT)
        h = (x * (share * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in page order, weaker with DOM distance, and next under one element."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            distance = max(0, a.depth - b.low) + max(0, b.depth - b.low)
            out.append((i - 1, i, ADJACENT / (1 + distance / 2)))
        # `parent` holds the block's own element, so this joins siblings across what stands between them
        if b.parent in last and last[b.parent] != i - 1:
            out.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    return out


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the scores given up plus the edges cut; ties go to content.

    A positive score is the cost of calling a block boilerplate, a negative one that of content.
    """
    n = len(scores)
    s = list(scores)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            around[i][j] = around[i].get(j, 0.0) + w
            around[j][i] = around[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(s[i]) >= sum(around[i].values()):
            label[i] = s[i] >= 0
            for j, w in around[i].items():
                # a settled neighbour's edge is a cost of disagreeing with it
                s[j] += w if label[i] else -w
                del around[j][i]
                queue.append(j)
            around[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        inside = _reachable(rest, s, around)
        for i in rest:
            label[i] = i in inside
    return [bool(x) for x in label]


def _reachable(nodes: list[int], s: list[float], around: list[dict[int, float]]) -> set[int]:
    """Nodes on the source's side of a minimum cut, as large as it can be: shortest augmenting paths."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(around[i]) for i in nodes}
    room[source], room[sink] = {}, {}
    for i in nodes:
        if s[i] > 0:
            room[source][i], room[i][source] = s[i], 0.0
        else:
            room[i][sink], room[sink][i] = -s[i], 0.0
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > 1e-12 and v not in came:
                    came[v] = u
                    queue.append(v)
        if sink not in came:
            break
        path, v = [], sink
        while v != source:
            path.append((came[v], v))
            v = came[v]
        flow = min(room[u][v] for u, v in path)
        for u, v in path:
            room[u][v] -= flow
            room[v][u] = room[v].get(u, 0.0) + flow
    # all that cannot reach the sink any more
    reach, queue = {sink}, deque([sink])
    while queue:
        v = queue.popleft()
        for u in room[v]:
            if u not in reach and room[u].get(v, 0.0) > 1e-12:
                reach.add(u)
                queue.append(u)
    return {i for i in nodes if i not in reach}


def main_text(page: str, weights: np.ndarray) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    logits = np.clip(np.array([features(b) for b in blocks]) @ weights, -LOGIT_LIMIT, LOGIT_LIMIT)
    keep = minimum_cut([b.prior + float(x) for b, x in zip(blocks, logits, strict=True)], edges_of(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", n: int = SAMPLE_PAGES, longest: int = SAMPLE_BYTES) -> np.ndarray:
    """Weights from at most `n` pages of at most `longest` bytes, the first by a hash of id and page."""
    rows = pages.select(F.col(html_col).alias("html"), F.xxhash64(id_col, html_col).alias("k")).where(F.octet_length("html") <= longest)
    # the cut is found on the hashes alone: a limit on whole pages would send `n` pages from every task
    last = rows.select("k").orderBy("k").limit(n).agg(F.max("k")).first()[0]
    if last is None:
        return DEFAULT
    found = rows.where(F.col("k") <= last).groupBy("k").agg(F.min("html").alias("html")).collect()
    return learn(sorted(r["html"] for r in found))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row: page_id, url, text (empty if there is none), n_chars (its code points).

    NULL and empty pages have no text. Ids and addresses may be NULL or repeat; other columns are not
    read; an empty table gives an empty one. Learns when called.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(train(pages, id_col, html_col))
    fields = [T.StructField("page_id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType)]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def make():
        weights = shared.value

        def work(batch):
            texts = [main_text(x, weights) for x in texts_of(batch, html_col)]
            return [batch.column(id_col), batch.column(url_col), texts, [len(x) for x in texts]]

        return work

    return map_batches(pages.select(id_col, url_col, html_col), make, schema)
