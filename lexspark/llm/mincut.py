"""HTML extraction by minimum-cut labelling.

A page is cut into text blocks at block-level tags.  A logistic classifier over text measures of a block and hints
from its ancestors gives costs of calling it content or boilerplate; they become the capacities to the two terminals.
Neighbours in the page, and blocks near each other in the DOM, are joined by smoothness edges, whose capacity is paid
where labels differ.  A minimum cut separates content from boilerplate.  Capacities are integers, so the cut is exact;
of several minimum cuts the one with the least content is taken.

The classifier is trained here, on a bounded sample of pages in which the ancestors tell the label (``article`` or
``main`` against ``nav``, ``header``, ``footer``, ``aside`` and ads); its measures don't see those ancestors, so it also
serves pages without such elements.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most pages that training takes, those with the least hash of id.  Extraction has no bound.
TRAIN_PAGES = 2_000
SCALE = 1_000
#: Smoothness of adjacent blocks, halved for each step of DOM distance over 2, and of blocks of the same parent.
ADJACENT, SIBLING = 0.9, 0.7
HINT_GOOD, HINT_BAD = 2.0, 2.5

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:\-]*)((?>[^<>"']+|"[^"<]*"|'[^'<]*'|["'])*+)>|[^<]+|<""", re.S)
#: Elements without text of the page, and their ends; a title counts in the head only.
_SKIPPED = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "svg", "title")}
#: What may stand in a head; any other tag, and text, ends it.
_HEAD = set("head title meta link base script style noscript template".split())
_BLOCK = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_GOOD, _BAD = {"article", "main"}, {"nav", "header", "footer", "aside", "form", "select"}
_BAD_CLASS = re.compile(r"""(?:class|id|role)\s*=\s*["']?[^"'>]*\b(?:ad|ads|advert\w*|banner|sidebar|nav\w*|menu|footer|cookie\w*|promo|share|social)\b""", re.I)
_HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}


@dataclass
class Block:
    text: str
    links: int  # characters in links
    tag: str
    parent: int
    distance: int  # DOM steps from the block before
    good: bool
    bad: bool


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order.  Unclosed, stray and crossing tags are taken as they come.

    Scripts, styles and the like go up to their end tags; of one without an end tag, or closed in itself, only the tag
    goes.  A head ends with its end tag, or before the first tag or text that can't be part of it.
    """
    out: list[Block] = []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, number, good, bad
    opened: dict[str, int] = {}
    text: list[str] = []
    links = number = good = bad = 0
    low, before = 0, 0  # least depth since the last block; its depth

    def flush() -> None:
        nonlocal links, low, before
        words = " ".join("".join(text).split())
        if words:
            depth = len(stack)
            top = next((s for s in reversed(stack) if s[0] in _BLOCK), ("", 0, False, False))
            out.append(Block(words, min(links, len(words)), top[0], stack[-2][1] if len(stack) > 1 else 0, before + depth - 2 * min(low, depth), good > 0, bad > 0))
            low = before = depth
        text.clear()
        links = 0

    def pop() -> None:
        nonlocal good, bad, low
        tag, _, g, b = stack.pop()
        opened[tag] -= 1
        good, bad, low = good - g, bad - b, min(low, len(stack))

    at, head, unclosed = 0, False, set()
    while at < len(page):
        m = _TOKEN.match(page, at)
        at, tag = m.end(), m[2]
        if tag is None:
            part = m.group()
            if part[0] != "<" or part == "<":
                if head and not part.strip():
                    continue
                head = False
                part = entities.unescape(part)
                text.append(part)
                if opened.get("a"):
                    links += len(part.strip())
            continue
        tag = tag.lower()
        if tag == "head":
            head = not m[1]
            continue
        head = head and tag in _HEAD
        if not m[1] and tag in _SKIPPED and (head or tag != "title"):
            closed = m[3].endswith("/") and tag in ("svg", "template")
            end = None if closed or tag in unclosed else _SKIPPED[tag].search(page, at)
            if end:
                at = end.end()
            elif not closed:
                unclosed.add(tag)
            continue
        if head:
            continue
        if tag in _BLOCK:
            flush()
        if m[1]:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag not in _VOID and not m[3].endswith("/"):
            if tag in ("p", "li", "td", "tr") and stack and stack[-1][0] == tag:
                pop()
            number += 1
            g, b = tag in _GOOD, tag in _BAD or bool(m[3] and _BAD_CLASS.search(m[3]))
            stack.append((tag, number, g, b))
            opened[tag] = opened.get(tag, 0) + 1
            good, bad = good + g, bad + b
    flush()
    return out


def block_measures(found: list[Block]) -> np.ndarray:
    """A row for each block; no measure knows the ancestors that give labels."""
    n = len(found)
    words = np.array([b.text.count(" ") + 1 for b in found], float)
    chars = np.array([len(b.text) for b in found], float)
    around = np.convolve(np.log1p(words), [1, 0, 1], "same") / 2 if n > 1 else np.zeros(n)
    return np.stack(
        [
            np.ones(n), np.log1p(words), np.array([b.links for b in found]) / chars, np.array([sum(map(b.text.count, ".,;:!?")) for b in found]) / words,
            chars / words / 10, np.array([b.tag == "li" for b in found], float), np.array([b.tag == "p" for b in found], float), np.array([b.tag in _HEADS for b in found], float), around,
        ],
        1,
    )


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; without rows only the length of a block counts."""
    if not len(y) or y.min() == y.max():
        return np.array([-2.0, 1.0] + [0.0] * (x.shape[1] - 2))
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def min_cut(source: list[int], sink: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source side of the minimum cut with the fewest such nodes.

    ``source`` and ``sink`` are terminal capacities, ``links`` are ``node, node, capacity`` in both directions.  A
    node whose terminal capacities differ by more than all its links is settled at once and its links are folded into
    its neighbours' terminals; what remains goes through max-flow (Dinic).
    """
    n = len(source)
    net = [a - b for a, b in zip(source, sink)]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in links:
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0) + c
            near[b][a] = near[b].get(a, 0) + c
    weight = [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        v = todo.popleft()
        if label[v] is None and (net[v] > weight[v] or -net[v] >= weight[v]):
            label[v] = net[v] > weight[v]
            for u, c in near[v].items():
                if label[u] is None:
                    net[u] += c if label[v] else -c
                    weight[u] -= c
                    del near[u][v]
                    todo.append(u)
    rest = [v for v in range(n) if label[v] is None]
    if rest:
        side = _dinic({v: net[v] for v in rest}, {v: {u: c for u, c in near[v].items() if label[u] is None} for v in rest})
        for v in rest:
            label[v] = v in side
    return [bool(x) for x in label]


def _dinic(net: dict[int, int], near: dict[int, dict[int, int]]) -> set[int]:
    s, t = -1, -2
    cap: dict[int, dict[int, int]] = {v: dict(x) for v, x in near.items()} | {s: {}, t: {}}
    for v, d in net.items():
        if d > 0:
            cap[s][v], cap[v][s] = d, 0
        elif d < 0:
            cap[v][t], cap[t][v] = -d, 0
    while True:
        level, todo = {s: 0}, deque([s])
        while todo:
            v = todo.popleft()
            for u, c in cap[v].items():
                if c > 0 and u not in level:
                    level[u] = level[v] + 1
                    todo.append(u)
        if t not in level:
            return set(level) - {s}
        arcs = {v: iter(list(x)) for v, x in cap.items()}
        path = [s]
        while path:
            v = path[-1]
            if v == t:
                flow = min(cap[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    cap[a][b] -= flow
                    cap[b][a] = cap[b].get(a, 0) + flow
                at = next(i for i, (a, b) in enumerate(zip(path, path[1:])) if cap[a][b] == 0)
                for a in path[at + 1 : -1]:
                    arcs[a] = iter(list(cap[a])) if a != path[at + 1] else arcs[a]
                del path[at + 1 :]
                arcs[path[-1]] = iter(list(cap[path[-1]]))
                continue
            u = next((u for u in arcs[v] if cap[v][u] > 0 and level.get(u) == level[v] + 1), None)
            if u is None:
                level[v] = -1
                path.pop()
                if path:
                    arcs[path[-1]] = iter(list(cap[path[-1]]))
            else:
                path.append(u)


def graph(found: list[Block], weights: np.ndarray) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
    """Terminal capacities and smoothness edges of a page."""
    odds = block_measures(found) @ weights if found else np.empty(0)
    odds = odds + np.array([HINT_GOOD * b.good - HINT_BAD * b.bad for b in found])
    odds = np.clip(odds, -12, 12)
    links, last = [], {}
    for i, b in enumerate(found):
        if i:
            links.append((i - 1, i, round(SCALE * ADJACENT * 0.5 ** max(0, b.distance - 2))))
        if b.parent in last and last[b.parent] != i - 1:
            links.append((last[b.parent], i, round(SCALE * SIBLING)))
        last[b.parent] = i
    cost = lambda z: [int(c) for c in np.rint(SCALE * np.logaddexp(0, z))]
    return cost(odds), cost(-odds), links


def extract(page: str | None, weights: np.ndarray) -> tuple[int, int, str]:
    """Number of blocks, of content blocks, and the content, a line for each block."""
    found = blocks(page or "")
    labels = min_cut(*graph(found, weights))
    content = [b.text for b, good in zip(found, labels) if good]
    return len(found), len(content), "\n".join(content)


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> np.ndarray:
    """Weights fitted on at most ``train_pages`` pages (least hash of id first); only measures reach the driver."""
    some = pages.filter("page_id IS NOT NULL AND html IS NOT NULL").select("page_id", "html")
    few = some.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [], []
            for page in batch.column(0).to_pylist():
                found = blocks(page)
                if found:
                    told = [b.good != b.bad for b in found]
                    xs += block_measures(found)[told].tolist()
                    ys += [b.good for b, t in zip(found, told) if t]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.bool_())], names=["x", "y"])

    rows = some.join(F.broadcast(few), "page_id").select("html").mapInArrow(run, "x array<double>, y boolean").toPandas()  # bounded by train_pages
    x = np.array(rows["x"].to_list(), float).reshape(len(rows), 9)
    order = np.lexsort(x.T) if len(x) else []
    return fit(x[order], rows["y"].to_numpy(float)[order])


def extract_pages(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """``page_id, n_blocks, n_content, text``, one row for each row; null, empty and textless pages give 0, 0, ``''``.

    Ids may be null, repeated rows are done each, an empty table gives no rows, other columns are ignored, whatever
    their names.  Very long pages are cut as a whole; of equal cuts the one with the least content is taken.  Nothing is
    shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [extract(p, weights) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([d[i] for d in done], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.string())))], names=["page_id", "n_blocks", "n_content", "text"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id bigint, n_blocks int, n_content int, text string")
