"""HTML extraction by minimum-cut labelling.

A page is cut into text blocks (what stands between tags that end a line). A small
classifier gives every block the cost of calling it content and the cost of calling it
boilerplate; these are the capacities of its edges to the two terminals. Blocks that
follow one another, and blocks under the same container, are joined by smoothness edges.
The minimum cut (by max-flow) is the labelling of least total cost; the source side is
the article. Blocks whose own cost outweighs all their smoothness edges are settled
before the flow starts, which is exact and leaves small graphs.

Script, style and similar elements, comments and markup never become text. Character
references are decoded, white space inside a block becomes one space, and blocks of
content are joined by one newline in page order.

Defined results: null or empty html, and pages without content, give the empty text;
repeated rows are extracted alike; an empty table gives an empty result; columns other
than page_id, url and html are ignored. Pages are processed whole, each on its own.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long, n_content long"

# Element names by their role.
SILENT = frozenset("script style noscript template iframe svg math object applet canvas audio video head title textarea select option datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CHROME = frozenset("nav header footer aside form menu button dialog fieldset".split())
ARTICLE = frozenset("article main".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOISE = re.compile(r"(?:^|[\s_\-])(?:ads?|advert\w*|adverts?|banner\w*|promo\w*|sponsor\w*|cookies?\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscrib\w*|signup|sign-up|login|comments?|commentlist|comment\w*|disqus|replies|respond|reviews?|reactions?|sidebar\w*|side|aside|widget\w*|rail|related|recommend\w*|popular|trending|more-stories|read-more|share|sharing|social\w*|follow|nav\w*|menu\w*|breadcrumbs?|crumbs|pagination|pager|toc|footer\w*|header|masthead|topbar|toolbar|copyright|legal|search\w*|tags?|tagcloud|byline-links|skip\w*|print|hidden|screen-reader\w*|sr-only)(?=$|[\s_\-])", re.I)
GOOD = re.compile(r"(?:^|[\s_\-])(?:article\w*|story\w*|post|post-body|post-content|entry|entry-content|content|main|body|text|page-content|prose)(?=$|[\s_\-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?!svg(?:\s(?:[^>\"\']|\"[^\"]*\"|\'[^\']*\')*)?/>)(script|style|noscript|template|iframe|svg|textarea|title)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<", re.S | re.I)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Block:
    text: str
    linked: int  # characters inside links
    container: int  # number of the nearest element that holds blocks
    chrome: bool  # inside navigation, header, footer, aside, form
    noise: bool  # inside an element named like an advert, notice, comment list, ...
    article: bool  # inside an article or main element
    good: bool  # inside an element named like content
    name: str  # nearest block element


#: Parts of class names that say where something stands or that it is there, not what the element is.
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without|hide|show|left|right|top|bottom)[-_][\w-]+|(?:^|(?<=\s))[\w-]+[-_](?:area|page|layout|open|closed|on|off|left|right|wrapper-main)(?=$|\s)")
#: Class names that, as a whole, name content: such an element is not taken for noise by its other names.
CONTENT = frozenset("article story post entry content main body text prose main-content page-content post-content post-body entry-content article-content article-body story-body".split())


def is_noise(value: str) -> bool:
    names = value.split()
    return not any(n in CONTENT for n in names) and bool(NOISE.search(LAYOUT.sub(" ", value)))


def kind_of(name: str, tag: str) -> tuple[bool, bool, bool, bool]:
    """(chrome, noise, article, good) of an element by its name and attributes."""
    chrome, noise, article, good = name in CHROME, False, name in ARTICLE, False
    if "=" in tag or " hidden" in tag:
        for attribute, value in ATTRIBUTE.findall(tag):
            attribute, value = attribute.lower(), value.strip("\"'").lower()
            if attribute in ("class", "id"):
                noise = noise or name not in ARTICLE and is_noise(value)
                good = good or bool(GOOD.search(value))
            elif attribute == "role":
                chrome = chrome or value in ROLES
                article = article or value in ("main", "article")
            elif attribute == "hidden" or attribute == "aria-hidden" and value == "true" or attribute == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                noise = True
    if name in ("html", "body"):
        noise = False
    return chrome, noise, article, good


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    # of each open element: name, chrome, noise, article, good, container, silent
    stack: list[tuple[str, bool, bool, bool, bool, int, bool]] = [("", False, False, False, False, 0, False)]
    parts: list[str] = []
    linked, in_link, serial, at = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                name, chrome, noise, article, good, container, _ = stack[-1]
                block = next((s[0] for s in reversed(stack) if s[0] not in INLINE), "")
                out.append(Block(text, min(linked, len(text)), container, chrome, noise, article, good, block))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        """Close the elements from stack[k] on."""
        nonlocal in_link
        if any(s[0] not in INLINE for s in stack[k:]):
            flush()
        in_link -= sum(s[0] == "a" for s in stack[k:])
        del stack[k:]

    def add(text: str) -> None:
        nonlocal linked
        if text and not stack[-1][6]:
            parts.append(text)
            if in_link:
                linked += len(text)

    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m[0]
        if m[1] or tag[:2] in ("<!", "<?"):
            if m[1] and m[1].lower() in ("title", "textarea"):
                flush()
            continue
        if tag == "<":
            add("<")
            continue
        name = NAME.match(tag)[1].lower()
        if tag[1] == "/":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if stack[k][0] in ("article", "body", "table", "section", "main") and name in INLINE:
                    break
            else:
                if name == "p" or name == "br":
                    flush() if name == "p" else add(" ")
            continue
        if name == "svg" and tag.endswith("/>"):
            continue
        if name in VOID:
            if name not in INLINE:
                flush()
            else:
                add(" " if name in ("br", "img", "input") else "")
            continue
        shut = SAME_CLOSES.get(name) or ({"p"} if name in CLOSES_P else None)
        if shut:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in shut:
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        up = stack[-1]
        chrome, noise, article, good = kind_of(name, tag)
        if name == "header" and (up[3] or article):
            chrome = False  # an article's own header holds its heading
        if name not in INLINE:
            flush()
        if name not in INLINE and name not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "td", "th", "dd", "dt", "tr", "blockquote"):
            serial += 1
            container = serial
        else:
            container = up[5]
        if name == "a":
            in_link += 1
        silent = up[6] or name in SILENT
        stack.append((name, up[1] or chrome, up[2] or noise, up[3] or article, up[4] or good, container, silent))
    add(page[at:])
    flush()
    return out


#: Cost of calling a block boilerplate, less that of calling it content, by its evidence.
WEIGHTS = {"bias": -0.6, "article": 3.0, "good": 1.0, "chrome": -12.0, "noise": -12.0, "heading": 0.8, "paragraph": 0.6, "item": -0.4, "long": 1.6, "links": -4.0}
ADJACENT, SAME_CONTAINER = 0.6, 0.5


def evidence(b: Block, in_article: bool) -> float:
    """Above 0 for content. in_article: whether the page has an article element at all."""
    w, s = WEIGHTS, WEIGHTS["bias"]
    if in_article:
        s += w["article"] if b.article else -w["article"]
    s += w["good"] * b.good + w["chrome"] * b.chrome + w["noise"] * b.noise
    s += w["heading"] * (b.name in ("h1", "h2", "h3", "h4", "h5", "h6")) + w["paragraph"] * (b.name in ("p", "blockquote", "pre"))
    s += w["item"] * (b.name in ("li", "td", "th", "dt", "dd"))
    s += w["long"] * min(1.0, len(b.text) / 120) + w["links"] * b.linked / len(b.text)
    return s


def min_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source side of the minimum cut, in which node i pays
    unary[i] if it isn't (or -unary[i] if it is and unary[i] < 0) and an edge its weight if its
    ends part. Nodes without net cost fall to the sink side."""
    n = len(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    own, pull = list(unary), [sum(x.values()) for x in near]
    todo = deque(range(n))
    while todo:  # settle nodes that no labelling of their neighbours can turn
        i = todo.popleft()
        if label[i] is None and abs(own[i]) > pull[i]:
            label[i] = own[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    own[j] += w if label[i] else -w
                    pull[j] -= w
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return [bool(x) for x in label]
    at = {i: k for k, i in enumerate(rest)}
    s, t = len(rest), len(rest) + 1
    cap: list[dict[int, float]] = [{} for _ in range(len(rest) + 2)]
    for i in rest:
        k = at[i]
        if own[i] > 0:
            cap[s][k], cap[k][s] = own[i], 0.0
        else:
            cap[k][t], cap[t][k] = -own[i], 0.0
        for j, w in near[i].items():
            if label[j] is None:
                cap[k][at[j]] = w
    while True:  # shortest augmenting paths
        back, queue = {s: s}, deque([s])
        while queue and t not in back:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 1e-9 and v not in back:
                    back[v] = u
                    queue.append(v)
        if t not in back:
            for i in rest:
                label[i] = at[i] in back
            return [bool(x) for x in label]
        path, v = [], t
        while v != s:
            path.append((back[v], v))
            v = back[v]
        flow = min(cap[u][v] for u, v in path)
        for u, v in path:
            cap[u][v] -= flow
            cap[v][u] += flow


def label_blocks(blocks: list[Block]) -> list[bool]:
    in_article = any(b.article and not b.chrome and not b.noise for b in blocks)
    unary = [evidence(b, in_article) for b in blocks]
    edges, last = [], {}
    for k, b in enumerate(blocks):
        if k:
            edges.append((k - 1, k, ADJACENT))
        if b.container in last:
            edges.append((last[b.container], k, SAME_CONTAINER))
        last[b.container] = k
    return min_cut(unary, edges)


def extract(page: str | None) -> tuple[str, int, int]:
    """(text, blocks, blocks of content) of one page."""
    blocks = blocks_of(page or "")
    kept = [b.text for b, good in zip(blocks, label_blocks(blocks), strict=True) if good]
    return "\n".join(kept), len(blocks), len(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                got = [extract(h) for h in part["html"]]
                texts = [t for t, _, _ in got]
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts], "n_blocks": [b for _, b, _ in got], "n_content": [c for _, _, c in got]})

    return pages.select("page_id", "url", "html").mapInPandas(run, SCHEMA)
