"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text with the elements above them. A logistic classifier, fitted on the blocks of a
bounded sample of pages whose own elements say what they are, gives a cost of being called content or boilerplate from
the block's text and place (at most ``CLASSIFIER``). The innermost element above it that says what it is (article, nav,
an advert's class, a heading such as "Comments") gives another (``HINT``). These costs are the capacities to the two
terminals. Neighbours in page order and neighbours below one parent are joined by smoothness edges, strong within one
such element, weak across its bounds and the weaker the more their shares of linked text differ. The minimum cut is the
labelling of least cost: blocks on the source's side are content.

Some evidence is weak, and there the classifier and the neighbours decide: an article says little of text that is all
links (``LINKED``), unless it is a heading, and the class of a paragraph or list item by one of ``DOUBTFUL_WORDS``, which
may well be the text's topic, only adds ``DOUBT`` to the cost of calling it content. Where no element says anything, the
classifier and the edges are all there is.

Class, id and role are read by whole tokens: one of ``BOILERPLATE_WORDS``, alone or last (``site-footer``) or before a
word of ``PARTS`` (``comment-list``), but not after ``has-``, ``no-`` and the like. An article's text is content whatever
stands around the article, but for comments, and an article within boilerplate within an article. An inline element that
says boilerplate is a block of its own.

A null page is empty and gives an empty text. Rows with equal or null ids are extracted one by one. An empty table gives
no rows. Pages of any length are parsed whole, in time linear in their length; an unclosed element ends with the page.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm._common import _quoted, table

SCHEMA = "page_id long, url string, text string, n_chars long"

#: What elements and the tokens of their class, id and role say of the text in them.
BOILERPLATE_TAGS = frozenset("nav footer aside form button menu dialog select option label fieldset legend".split())
CONTENT_TAGS = frozenset("article main".split())
COMMENT_WORDS = frozenset("comment comments replies reply respond".split())
BOILERPLATE_WORDS = COMMENT_WORDS | frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs cookie cookies consent disclaimer footer header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
#: Of these, those that name topics, too, where they are the class of a text's own element.
DOUBTFUL_WORDS = frozenset("header menu related share sharing social widget".split())
PARTS = frozenset("area bar block body box buttons container content inner item links list section slot text thread unit wrap wrapper".split())
NOT_ITSELF = frozenset("has no not with without hide is show".split())
SKIPPED = frozenset("script style noscript template iframe svg canvas object textarea title head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_TAGS = HEADINGS | frozenset("p li dt dd td th blockquote pre figcaption".split())
#: Headings of what readers say, and of what leads to other pages; what follows belongs to them, up to a heading of the
#: same or a higher rank below the same parent.
REMARKS = re.compile(r"(?:\d+ )?(?:readers?'? |user )?(?:comments?|replies|responses)(?: \(?\d+\)?)?:?|(?:leave|post|write|add) a (?:comment|reply):?", re.I)
ELSEWHERE = re.compile(r"related (?:articles|links|posts|stories):?|(?:you may|see) also(?: like)?:?|share this(?: (?:article|page|post|story))?:?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

#: Weight of an edge between neighbours in page order, of which those of different parents have a share of ``APART``, and
#: between neighbours below one parent, divided by the blocks from one to the other; both within one telling element, and
#: the share of it across the bounds of one.
ADJACENT, APART, SIBLING, ACROSS = 0.4, 0.25, 0.4, 0.1
#: Most that the classifier adds to a block's cost of a label, and what a telling element adds.
CLASSIFIER, HINT = 1.2, 1.5
#: The share of an article's hint that linked text goes without, and what a doubtful class of a text's own element adds.
LINKED, DOUBT = 0.8, 1.0

#: A block: text, hint of the elements above (-1, 0, 1), the number of the element that gives it (0: none), parent's
#: number, characters in links, innermost block element, whether that has a doubtful class.
Block = tuple[str, int, int, int, int, str, bool]


def _token_says(token: str) -> str:
    """The word of ``BOILERPLATE_WORDS`` that a token of a class, id or role stands for, or nothing."""
    *before, last = (w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+", token))
    if last in BOILERPLATE_WORDS and not NOT_ITSELF & {*before}:
        return last
    return before[0] if len(before) == 1 and before[0] in BOILERPLATE_WORDS and last in PARTS else ""


def _says(tag: str, attributes: str, in_content: bool) -> int:
    """What an element says by itself: -3 boilerplate, but in doubt, -2 comments, -1 boilerplate, 1 content, 0 nothing. A
    header within content is the content's own."""
    if attributes and tag not in ("body", "html"):
        words = {_token_says(t) for value in ATTRIBUTE.findall(attributes) for t in value.strip("\"'").split() if re.search("[A-Za-z0-9]", t)}
        words -= {"", "header"} if in_content else {""}
        if words:
            return -3 if tag in TEXT_TAGS and words <= DOUBTFUL_WORDS else -2 if words & COMMENT_WORDS else -1
    if tag in BOILERPLATE_TAGS or tag == "header" and not in_content:
        return -1
    return 1 if tag in CONTENT_TAGS else 0


class _Open:
    """Open elements, innermost last: tag, hint in effect, number of the element that gives it, own number, whether an
    article is open, whether the own class is doubtful."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int, int, bool, bool]] = [("", 0, 0, 0, False, False)]
        self.count: dict[str, int] = {}  # by tag, so that an end tag without its element costs nothing
        self.sections: dict[int, tuple[str, int, int]] = {}  # by parent: rank of a telling heading, hint and scope before
        self.numbers = 0

    def enter(self, tag: str, attributes: str) -> None:
        _, hint, scope, _, inside, _ = self.stack[-1]
        says = _says(tag, attributes, hint == 1)
        doubt, says = says == -3, 0 if says == -3 else says
        self.numbers += 1
        if says and hint != -2 and not (says == 1 and hint == -1 and inside):
            hint, scope = says, self.numbers
        self.stack.append((tag, hint, scope, self.numbers, inside or hint == 1, doubt))
        self.count[tag] = self.count.get(tag, 0) + 1

    def heading(self, text: str) -> None:
        """The innermost element is a heading with this text: it may end a section below its parent, and begin one."""
        (above, *outer, number, inside, doubt), (tag, *own) = self.stack[-2:]
        inherits = own[:2] == outer
        if number in self.sections and tag <= self.sections[number][0]:
            _, *outer = self.sections.pop(number)
        if remarks := bool(REMARKS.fullmatch(text)) or ELSEWHERE.fullmatch(text):
            self.numbers += 1
            self.sections.setdefault(number, (tag, *outer))
            outer = [-2 if remarks is True or outer[0] == -2 else -1, self.numbers]
        self.stack[-2] = (above, *outer, number, inside, doubt)
        if inherits:
            self.stack[-1] = (tag, *outer, *own[2:])

    def leave(self, tag: str) -> None:
        while self.count.get(tag):
            last = self.stack.pop()[0]
            self.count[last] -= 1
            if last == tag:
                break


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order."""
    found: list[Block] = []
    elements = _Open()
    stack = elements.stack
    link_chars = at = 0
    linked = False
    parts: list[str] = []

    def flush() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                if stack[-1][0] in HEADINGS:
                    elements.heading(text)
                tag, hint, scope, number, _, doubt = stack[-1]
                found.append((text, max(hint, -1), scope, stack[-2][3] if len(stack) > 1 else number, link_chars, tag, doubt))
            parts.clear()
            link_chars = 0

    def take(raw: str) -> None:
        nonlocal link_chars
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if linked:
                link_chars += len(text)

    search, n = TOKEN.search, len(page)
    while at < n:
        m = search(page, at)
        if not m:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        close, tag, attributes = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if tag in SKIPPED:
            if not close and not attributes.endswith("/"):
                if tag == "head":
                    flush()
                    continue
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                if not end and tag in ("title", "object", "svg", "canvas"):
                    continue
                at = page.find(">", end.start()) + 1 or n if end else n
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                linked = not close
            if tag in VOID:
                continue
            if close:
                if elements.count.get(tag):
                    flush()
                    elements.leave(tag)
            elif elements.count.get(tag) or attributes and _says(tag, attributes, stack[-1][1] == 1) < 0:
                flush()
                elements.enter(tag, attributes)
            continue
        flush()
        linked = False
        if tag in VOID:
            continue
        if close:
            elements.leave(tag)
        else:
            if stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                elements.leave(stack[-1][0])
            elements.enter(tag, attributes)
    flush()
    return found


def features(blocks: Sequence[Block]) -> np.ndarray:
    """What the classifier sees of each block: nothing of what its elements say outright."""
    rows = []
    n = len(blocks)
    for k, (text, _, _, _, link_chars, tag, _) in enumerate(blocks):
        size, words = len(text), text.count(" ") + 1
        ends = sum(map(text.count, ".!?…"))
        rows.append((1.0, min(math.log1p(size), 8) / 8, min(link_chars / size, 1), min(ends / words, 1), text[-1] in ".!?…\"”", tag == "p", tag in HEADINGS, k / n, any(c in text for c in "©|»·")))
    return np.array(rows, float).reshape(n, 9)


#: Used where no page of the sample has blocks of both kinds.
PRIOR = (-1.0, 3.0, -4.0, 1.0, 1.0, 1.0, 0.5, 0.0, -2.0)


def labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of the blocks whose elements say what they are, and whether they say content."""
    blocks = blocks_of(page)
    hint = np.array([0 if b[6] else b[1] for b in blocks], int)
    return features(blocks)[hint != 0], hint[hint != 0] > 0


def fitted(x: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[float, ...]:
    """Logistic regression; both kinds weigh the same."""
    y = np.asarray(y, float)
    if not len(y) or not 0 < y.mean() < 1:
        return PRIOR
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (weight * (p - y)) + 1e-3 * w)
        if np.abs(x.T @ (weight * (p - y)) + 1e-3 * w).max() < 1e-8:
            break
    return tuple(map(float, w))


def minimum_cut(content: Sequence[float], boilerplate: Sequence[float], edges: Sequence[tuple[int, int, float]]) -> list[bool]:
    """Labels (content or not) of least cost: ``content[i]`` is what is lost where i is labelled boilerplate,
    ``boilerplate[i]`` where it is labelled content, an edge's weight where its ends differ.

    Blocks whose own preference outweighs all their edges are settled first, which is exact; shortest augmenting paths
    (Dinic) find the maximum flow among the rest.
    """
    n = len(content)
    own = [c - b for c, b in zip(content, boilerplate)]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(own[i]) >= sum(near[i].values()):
            label[i] = own[i] > 0
            for j, w in near[i].items():
                own[j] += w if label[i] else -w
                near[j].pop(i, None)
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        source, sink = n, n + 1
        room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest} | {source: {}, sink: {}}
        for i in rest:
            a, b = (source, i) if own[i] > 0 else (i, sink)
            room[a][b] = abs(own[i])
            room[b].setdefault(a, 0.0)
        while True:
            level = {source: 0}
            queue = deque([source])
            while queue:
                u = queue.popleft()
                for v, c in room[u].items():
                    if c > 1e-12 and v not in level:
                        level[v] = level[u] + 1
                        queue.append(v)
            if sink not in level:
                break
            ways = {u: iter(list(room[u])) for u in level}
            path = [source]
            while path:
                u = path[-1]
                if u == sink:
                    least = min(room[a][b] for a, b in zip(path, path[1:]))
                    for a, b in zip(path, path[1:]):
                        room[a][b] -= least
                        room[b][a] = room[b].get(a, 0.0) + least
                    path = [source]
                    continue
                for v in ways[u]:
                    if room[u][v] > 1e-12 and level.get(v) == level[u] + 1:
                        ways[u] = iter([v, *ways[u]])
                        path.append(v)
                        break
                else:
                    path.pop()
                    if path:
                        level.pop(u)
        for i in rest:
            label[i] = i in level
    return [bool(x) for x in label]


def costs(blocks: Sequence[Block], weights: Sequence[float]) -> tuple[list[float], list[float], list[tuple[int, int, float]]]:
    """Capacities to both terminals and the edges."""
    linked = [min(b[4] / len(b[0]), 1) for b in blocks]
    hints = [b[1] * (1 - LINKED * share if b[1] > 0 and b[5] not in HEADINGS else 1) for b, share in zip(blocks, linked)]
    own = (CLASSIFIER * np.tanh(features(blocks) @ np.array(weights) / 2) + HINT * np.array(hints) - DOUBT * np.array([b[6] for b in blocks])).tolist()
    edges, last = [], {}

    def edge(a: int, b: int, weight: float) -> None:
        edges.append((a, b, weight * (1 - abs(linked[a] - linked[b])) * (1 if blocks[a][2] == blocks[b][2] else ACROSS)))

    for k, block in enumerate(blocks):
        if k:
            edge(k - 1, k, ADJACENT if blocks[k - 1][3] == block[3] else ADJACENT * APART)
        if block[3] in last:
            edge(last[block[3]], k, SIBLING / (k - last[block[3]]))
        last[block[3]] = k
    return [max(x, 0.0) for x in own], [max(-x, 0.0) for x in own], edges


def main_text(page: str, weights: Sequence[float]) -> str:
    blocks = blocks_of(page)
    return "\n\n".join(b[0] for b, yes in zip(blocks, minimum_cut(*costs(blocks, weights))) if yes) if blocks else ""


def extracted(pages: DataFrame, most_sample: int = 400, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``SCHEMA`` of every page; a narrow stage without shuffle.

    The classifier is fitted on the blocks of ``most_sample`` pages, those with the smallest hashes of their ids, and of
    their texts where ids repeat. Only the blocks' features reach the driver.
    """
    docs = pages.select(_quoted(id_col).cast("long").alias("page_id"), _quoted(url_col).alias("url"), F.coalesce(_quoted(html_col), F.lit("")).alias("html"))
    hashed = docs.select("html", F.xxhash64("page_id").alias("h"))
    least = hashed.select("h").distinct().orderBy("h").limit(most_sample).agg(F.max("h")).first()[0]

    def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column(0).to_pylist():
                x, y = labelled(page)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["x", "y"])

    weights = PRIOR
    if least is not None:
        sample = hashed.filter(F.col("h") <= least).orderBy("h", F.xxhash64("html")).limit(most_sample).select("html").mapInArrow(features_of, "x binary, y binary").collect()
        weights = fitted(np.frombuffer(b"".join(r["x"] for r in sample), float).reshape(-1, len(PRIOR)), np.frombuffer(b"".join(r["y"] for r in sample), bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return docs.mapInArrow(run, SCHEMA)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
