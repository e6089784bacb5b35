"""Main-text extraction from HTML: blocks labelled content or boilerplate by a minimum cut.

What a block costs on either side is the log-likelihood of a classifier. Its weights for length, links, punctuation
and kind of element are fitted to blocks that the pages' own markup labels (inside an article, or inside menus,
footers and the like); blocks that no markup labels are judged by these weights. Neighbours in page and tree are
joined by smoothness edges, so that a block that can't be told by itself goes with those around it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import map_batches

_TEXT, _NAME = re.compile(r"[^<]+"), re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: Attributes up to the end of a tag; quotes hide a ``>``. Possessive, so that it never goes back.
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
#: Unfinished quotes that a page may have before quotes are no longer heeded in it.
_OPEN_QUOTES = 50
_ATTR = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "select", "title", "xmp", "noembed", "noframes")}
#: Elements whose content is text to the end of the page if they are left open; others are gone on with.
_TO_THE_END = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
#: Deeper elements count as part of the one they are in.
_DEPTH = 512
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag ends open elements of these kinds, up to one of the bounds.
_ENDS = {t: (frozenset(("p",)), frozenset()) for t in _BLOCK} | {
    "li": (frozenset(("li", "p")), frozenset(("ul", "ol", "menu"))),
    "dd": (frozenset(("dd", "dt", "p")), frozenset(("dl",))),
    "dt": (frozenset(("dd", "dt", "p")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th", "p")), frozenset(("table",))),
    "td": (frozenset(("td", "th", "p")), frozenset(("table",))),
    "th": (frozenset(("td", "th", "p")), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}

_AWAY_TAGS = {"nav": 6.0, "aside": 5.0, "footer": 6.0, "form": 5.0, "button": 6.0, "menu": 5.0, "head": 8.0, "dialog": 6.0, "fieldset": 4.0, "legend": 4.0, "search": 6.0, "label": 3.0, "option": 5.0}
_AWAY_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|adbox|ad-?\w*slot|banner\w*|promo\w*|sponsor\w*|cookie\w*|consent|gdpr|notice\w*|alert|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|footer\w*|header|masthead|topbar"
    r"|comment\w*|reply|replies|disqus\w*|respond|share\w*|sharing|social\w*|related\w*|recommend\w*|subscri\w*|newsletter\w*|signup|login|popup\w*|modal\w*|overlay|tag-?cloud|pagination|pager|copyright"
    r"|disclaimer|skip-?\w*|search\w*|toolbar|author-?bio)(?=$|[\s_-])",
    re.I,
)
#: Names that content has too: a hint, no more.
_PERHAPS = re.compile(r"(?:^|[\s_-])(?:side|widget\w*|tags?|legal|rating|feedback|meta|info|extra|aux|bottom|top)(?=$|[\s_-])", re.I)
_AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_HOME_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|post|entry|story|body|text|articlebody|post-?content|entry-?content)(?=$|[\s_-])", re.I)


@dataclass(eq=False)
class _Open:
    tag: str
    above: _Open | None
    depth: int
    home: bool
    away: float
    linked: bool
    block: _Open | None = None


@dataclass(eq=False)
class Block:
    """A run of text between block boundaries, or an inline part of one that markup sets apart, and what is known of its place."""

    parts: list[tuple[Block, str]] = field(default_factory=list)
    host: Block | None = None
    place: _Open | None = None
    linked: int = 0
    home: bool = False
    away: float = 0.0
    tag: str = ""
    text: str = ""


def _place(tag: str, attrs: str, above: _Open | None) -> _Open:
    home, away, linked = (above.home, above.away, above.linked) if above else (False, 0.0, False)
    named, role = "", ""
    for key, *values in _ATTR.findall(attrs) if attrs and not attrs.isspace() else ():
        value, key = next((v for v in values if v), ""), key.lower()
        if key in ("class", "id"):
            named += " " + value
        elif key in ("role", "itemprop"):
            role += " " + value.lower()
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            away = max(away, 8.0)
    if tag in _AWAY_TAGS:
        away = max(away, _AWAY_TAGS[tag])
    elif tag == "header" and not home:
        away = max(away, 5.0)
    if role and _AWAY_ROLES & set(role.split()):
        away = max(away, 6.0)
    if named and tag not in ("html", "body"):
        if _AWAY_NAMES.search(named):
            away = max(away, 5.0)
        elif _PERHAPS.search(named):
            away = max(away, 1.0)
    if tag in ("article", "main") or "main" in role.split() or "articlebody" in role or tag in ("div", "section", "td") and named and _HOME_NAMES.search(named):
        home = True
    found = _Open(tag, above, above.depth + 1 if above else 0, home, away, linked or tag == "a")
    found.block = found if tag in _BLOCK else above.block if above else None
    return found


def _clean(pieces: list[str]) -> str:
    return " ".join(html.unescape("".join(pieces)).split()) if pieces else ""


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order; scripts, styles, comments and markup are gone, references decoded.

    Time is linear in the page's length: what is read once is never read again, but for a fixed number of tags
    with unfinished quotes and of open elements.
    """
    found: list[Block] = []
    stack: list[_Open] = []
    count: Counter[str] = Counter()
    now = Block()
    at = quotes = 0
    last = page.rfind(">")
    endless: set[str] = set()  # elements whose end tag doesn't come any more

    def flush() -> None:
        nonlocal now
        if now.parts:
            pieces: dict[Block, list[str]] = {}
            for b, t in now.parts:
                pieces.setdefault(b, []).append(t)
            for b, own in pieces.items():
                b.text = _clean(own)
            told = [b for b in pieces if b is not now and b.text]
            if not now.text and told:  # nothing but parts that are set apart
                now.text = _clean([t for _, t in now.parts])
                now.away, now.home, now.tag, now.place = min(b.away for b in told), told[0].home, now.tag or told[0].tag, now.place or told[0].place
                now.linked, now.parts, told = sum(b.linked for b in told), [(now, t) for _, t in now.parts], []
            if now.text:
                found.append(now)
                found.extend(told)
            now = Block()

    def add(piece: str) -> None:
        top = stack[-1] if stack else None
        inner = top.block if top else None
        own = now
        if not piece.isspace():
            if top is not None and top.away > (inner.away if inner else 0.0) + 2:
                if now.parts and (b := now.parts[-1][0]) is not now and b.away == top.away:
                    own = b
                else:
                    own = Block(host=now, place=inner or top, home=top.home, away=top.away, tag=top.tag)
            elif top is not None and now.place is None:
                now.place, now.home, now.away, now.tag = inner or top, top.home, top.away, (inner or top).tag
            if top is not None and top.linked:
                own.linked += len(piece)
        now.parts.append((own, piece))

    def close(k: int) -> None:
        for o in stack[k:]:
            count[o.tag] -= 1
        del stack[k:]

    while at < len(page):
        if page[at] != "<":
            m = _TEXT.match(page, at)
            at = m.end()
            add(m[0])
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at) if at < last else -1
            at = len(page) if end < 0 else end + 1
            continue
        name = _NAME.match(page, at) if at < last else None
        if name is None:  # a lone sign
            add("<")
            at += 1
            continue
        rest = _REST.match(page, name.end()) if quotes < _OPEN_QUOTES else None
        if rest is None:
            quotes += 1
            end = page.find(">", name.end()) + 1
            if not end:  # the tag never ends
                break
        else:
            end = rest.end()
        attrs, tag, closing = page[name.end() : end - 1], name[1].lower(), page[at + 1] == "/"
        at = end
        if closing:
            if tag in _BLOCK:
                flush()
            if count[tag]:
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag)
                if tag in _BLOCK or not any(o.tag in _BLOCK for o in stack[k + 1 :]):
                    close(k)
                else:
                    count[tag] -= 1
                    del stack[k]
            continue
        if tag in _RAW and not attrs.rstrip().endswith("/"):
            stop = _RAW[tag].search(page, at) if at < last and tag not in endless else None
            if stop is None:
                endless.add(tag)
            if stop or tag in _TO_THE_END:
                at = stop.end() if stop else len(page)
                now.parts.append((now, " "))
                continue
        if tag in _BLOCK:
            flush()
            ends, bounds = _ENDS[tag]
            k = len(stack) - 1
            while k >= 0 and any(count[t] for t in ends) and stack[k].tag not in bounds and (stack[k].tag in ends or stack[k].tag not in _BLOCK):
                if stack[k].tag in ends:
                    close(k)
                k -= 1
        elif tag in ("br", "img", "input"):
            now.parts.append((now, " "))
        if tag not in _VOID and not attrs.endswith("/") and len(stack) < _DEPTH:
            stack.append(_place(tag, attrs, stack[-1] if stack else None))
            count[tag] += 1
    flush()
    return found


def features(block: Block) -> tuple[float, ...]:
    """What the classifier sees of a block's text, without its place in the markup."""
    n = len(block.text)
    return (
        1.0,
        math.log1p(n / 20),
        min(1.0, block.linked / max(1, n)),
        float(bool(re.search(r"[.!?…:»”\"]\W*$", block.text[-8:]))),
        float(block.tag in ("p", "blockquote", "pre")),
        float(bool(re.fullmatch("h[1-6]", block.tag))),
        min(3.0, 100 * block.text.count(",") / (n + 20)),
    )


#: Weights of the features where pages have no labelled blocks to fit them to.
DEFAULT = (-1.6, 1.2, -4.0, 0.8, 1.0, 1.0, 0.2)
#: Pages that the weights are fitted on, and blocks of each.
FIT_PAGES, FIT_BLOCKS = 2000, 64
#: Classifier scores are cut to this size, so that what neighbours say can outweigh them.
SURE = 3.0
#: What markup adds to a block's score: inside an article; outside of it on a page that has one; for each unit of ``away``.
HOME, NOT_HOME, AWAY = 3.0, -3.0, -2.0


def costs(block: Block, any_home: bool, weights: tuple[float, ...] = DEFAULT) -> tuple[float, float]:
    """What it costs to call the block boilerplate, and to call it content: minus the log of the other's likelihood."""
    score = sum(w * x for w, x in zip(weights, features(block)))
    score = max(-SURE, min(SURE, score)) + AWAY * block.away
    if any_home:
        score += HOME if block.home else NOT_HOME
    near = math.log1p(math.exp(-abs(score)))
    return near + max(score, 0.0), near + max(-score, 0.0)


def _apart(a: _Open | None, b: _Open | None) -> int:
    """Steps from one element to the other through the tree; 16 stands for more."""
    steps = 0
    while a is not b and steps < 16:
        if a is None or b is not None and b.depth >= a.depth:
            a, b = b, a
        a = a.above
        steps += 1
    return steps


def smoothness(a: Block, b: Block) -> float:
    """How much it costs to part two neighbours: more, the nearer they are in the tree."""
    apart = _apart(a.place, b.place)
    return 4.0 * 0.57**apart if a.home == b.home and abs(a.away - b.away) < 0.5 else 0.6 * 0.57**apart


def min_cut(terminals: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least total cost by maximum flow (Dinic). True: on the source's side, content.

    ``terminals`` has what a node costs on the sink's side and on the source's side; ``edges`` what it costs to part two.
    """
    n = len(terminals)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(u: int, v: int, forth: float, back: float) -> None:
        out[u].append(len(to))
        to.append(v)
        room.append(forth)
        out[v].append(len(to))
        to.append(u)
        room.append(back)

    for k, (content, boiler) in enumerate(terminals):
        common = min(content, boiler)
        if content > common:
            add(s, k, content - common, 0.0)
        if boiler > common:
            add(k, t, boiler - common, 0.0)
    for u, v, c in edges:
        add(u, v, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque((s,))
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                push = min(room[e] for e in path)
                first = 0
                for k, e in enumerate(path):
                    room[e] -= push
                    room[e ^ 1] += push
                for k, e in enumerate(path):
                    if room[e] <= 1e-12:
                        first = k
                        break
                del path[first:]
                u = to[path[-1]] if path else s
                continue
            while turn[u] < len(out[u]):
                e = out[u][turn[u]]
                if room[e] > 1e-12 and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(out[u]):
                path.append(out[u][turn[u]])
                u = to[path[-1]]
            elif u == s:
                break
            else:
                e = path.pop()
                u = to[e ^ 1]
                turn[u] += 1


def labels(found: list[Block], weights: tuple[float, ...] = DEFAULT, smooth: bool = True) -> list[bool]:
    """Content or not, block by block. Without ``smooth``, each by its own costs."""
    any_home = any(b.home and b.away < 2 for b in found)
    terminals = [costs(b, any_home, weights) for b in found]
    if not smooth:
        return [boilerplate > content for boilerplate, content in terminals]
    edges: list[tuple[int, int, float]] = []
    at = {id(b): k for k, b in enumerate(found)}
    last: dict[int, int] = {}
    before = None
    for k, b in enumerate(found):
        if b.host is not None:
            edges.append((at[id(b.host)], k, 0.3))
            continue
        if before is not None:
            edges.append((before, k, smoothness(found[before], b)))
        around = id(b.place.above) if b.place else 0
        if around in last and last[around] != before:  # the block before in the same container, if it isn't the neighbour
            edges.append((last[around], k, 0.5 * smoothness(found[last[around]], b)))
        last[around] = before = k
    return min_cut(terminals, edges)


def main_text(page: str, weights: tuple[float, ...] = DEFAULT, smooth: bool = True) -> str:
    """The article of a page: its content blocks in order, one a line."""
    found = blocks(page)
    kept = {id(b) for b, yes in zip(found, labels(found, weights, smooth)) if yes}
    lines = (_clean([t for c, t in b.parts if c is b or id(c) in kept]) for b in found if b.host is None and id(b) in kept)
    return "\n".join(x for x in lines if x)


def fit(rows: np.ndarray, content: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic regression by Newton's method, drawn towards ``DEFAULT``; both classes weigh the same.

    The kinds of element keep their weights: where markup labels blocks it also says which elements they are, and
    that tells nothing of pages without such markup.
    """
    w = np.array(DEFAULT)
    if not content.any() or content.all():
        return DEFAULT
    weight = np.where(content, 0.5 / content.sum(), 0.5 / (~content).sum()) * len(content)
    pull = np.array([0.3, 0.1, 0.1, 0.1, 1e4, 1e4, 0.1]) * len(content)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (weight * (p - content)) + pull * (w - DEFAULT)
        curve = (rows * (weight * p * (1 - p))[:, None]).T @ rows + np.diag(pull)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(x) for x in w)


def labelled(page: str) -> list[tuple[bool, tuple[float, ...]]]:
    """Features of the blocks that markup labels: content of an article, or of menus, footers, forms and the like."""
    found = [b for b in blocks(page) if b.away >= 3 or b.home and b.away < 1]
    step = max(1, -(-len(found) // FIT_BLOCKS))
    return [(b.away < 1, features(b)) for b in found[::step]]


def learn(pages: DataFrame) -> tuple[float, ...]:
    """Fit the classifier's weights on the labelled blocks of about ``FIT_PAGES`` pages, drawn by hash."""
    source = pages.select(F.col("html").cast("string").alias("html")).where("html is not null")
    n = source.count()
    if n > FIT_PAGES:
        source = source.where(F.pmod(F.xxhash64("html"), F.lit(n)) < FIT_PAGES)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [r for page in batch.column(0).to_pylist() for r in labelled(page)]
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.bool_()), pa.array([x for _, x in rows], pa.list_(pa.float64()))], ["content", "x"])

    rows = map_batches(source, run, "content boolean, x array<double>").orderBy("content", "x").collect()
    return fit(np.array([r["x"] for r in rows]).reshape(-1, len(DEFAULT)), np.array([r["content"] for r in rows], bool))


def extract(pages: DataFrame, weights: tuple[float, ...] = DEFAULT) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``page_id, url, text, n_chars``, one row per input row.

    Null and empty pages, and pages without content, give the empty text. Broken markup is read as far as it goes:
    a tag that never ends, and what is behind it, is markup. Null ids and addresses stay null, repeated rows give
    equal rows, other columns are ignored, no rows give none.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p, weights) if p else "" for p in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), run, "page_id long, url string, text string, n_chars long")
