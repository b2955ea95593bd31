"""Main text of HTML pages by tag-path ratios.

Text length and punctuation are summed per root-to-leaf path of block tags (with their classes); the two
ratios are fused, smoothed along the page and averaged per path. A path is content if its score reaches
a share of the best path's. What is known of tags, names and places only weighs the scores: paths through
furniture count for less, paths in the element that holds most of the content for more.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>", re.S)
_ATTR = re.compile(r"([a-zA-Z][a-zA-Z0-9:_-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f\v ]+")
_PUNCT = re.compile(r"[.,;:!?…。，]")
_DIGITS = re.compile(r"\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never read; their end is looked for as it stands.
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
UNREAD = frozenset("head select object canvas audio video".split()) | RAW
#: Tags that by their meaning hold no article text.
FURNITURE = frozenset("nav footer aside form button option dialog menu label fieldset".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Text containers below which no smaller article is looked for.
LEAF = frozenset("p li td th pre blockquote dt dd figcaption".split()) | HEADINGS
#: Class and id names (whole, or the first or last part of one) that often name furniture.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead comment comments commentlist reply replies respond disqus discussion cookie cookies consent gdpr notice notices banner popup modal overlay "
    "newsletter subscribe subscription signup share sharing social related recommended recommendations widget toolbar login search copyright "
    "disclaimer pagination pager skip alert paywall".split()
)
#: A name that begins so tells how its element is laid out, not what it is.
STATES = frozenset("with without no has is not".split())
ROLES = frozenset("complementary contentinfo navigation search banner".split())
#: What an opening tag closes if it is still open.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = frozenset("ul ol dl table body article section div main".split())


@dataclass(frozen=True)
class PathParams:
    """sigma, radius: of the Gaussian along the text nodes; cut: a path is content if its weighted score is at least
    this share of the best one.

    The weights: furniture_tag and furniture_name for each such step of a path, outside for nodes outside of the
    article (the smallest element with ``cover`` of the content, or an <article>), and inside for undoubted
    nodes in it, so that short cells and list items of an article reach the threshold. lift: how many times its own score a path may gain by smoothing.
    """

    sigma: float = 1.0
    radius: int = 2
    cut: float = 0.2
    cover: float = 0.7
    furniture_tag: float = 0.02
    furniture_name: float = 0.1
    outside: float = 0.05
    inside: float = 8.0
    lift: float = 3.0


@dataclass(slots=True)
class _Element:
    tag: str
    parent: int
    named: bool
    classes: str
    unread: bool


def _attributes(attrs: str) -> tuple[bool, str, bool]:
    """(named like furniture, classes without digits, hidden)."""
    named, classes, hidden = False, "", False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            for token in value.split():
                parts = token.replace("_", "-").split("-")
                named = named or (parts[0] not in STATES and (parts[0] in MARKS or parts[-1] in MARKS))
            if name == "class":
                classes = _DIGITS.sub("", value)
        elif name == "role":
            named = named or value in ROLES
        elif name == "style":
            hidden = hidden or "display:none" in value.replace(" ", "")
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
    return named, classes, hidden


def _parse(page: str) -> tuple[list[_Element], list[tuple[int, int, str, bool]]]:
    """Elements, and text nodes as (element, block, text, linked), in time linear in the page."""
    els = [_Element("", -1, False, "", False)]
    nodes: list[tuple[int, int, str, bool]] = []
    stack, blocks, links, at = [0], 1, 0, 0
    # open elements by tag, in all and since the last element that implied ends do not cross
    total: dict[str, int] = {}
    scopes: list[dict[str, int]] = [{}]

    def text(upto: int) -> None:
        if upto > at and not els[stack[-1]].unread:
            nodes.append((stack[-1], blocks, page[at:upto], links > 0))

    def close_to(tags: set[str]) -> None:
        """Closes the innermost open element of these tags and all within it."""
        nonlocal links, blocks
        done = False
        while not done:
            t = els[stack.pop()].tag
            total[t] -= 1
            if t in _STOPS:
                scopes.pop()
            scopes[-1][t] -= 1
            links -= t == "a"
            blocks += t not in INLINE
            done = t in tags

    pos, n = 0, len(page)
    # behind the last ">" there is no tag, and an open comment at most
    last = page.rfind(">") + 1
    last = n if "<!--" in page[last:] else last
    while m := _TOKEN.search(page, pos, last):
        text(m.start())
        pos = at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if total.get(tag):
                close_to({tag})
            continue
        if tag == "br":
            if not els[stack[-1]].unread:
                nodes.append((stack[-1], blocks, " ", links > 0))
            continue
        if tag in VOID:
            blocks += tag == "hr"
            continue
        if tag not in INLINE:
            # a block ends an open paragraph; items end the item before them
            ends = {"p"} | _CLOSES.get(tag, set())
            if any(scopes[-1].get(t) for t in ends):
                close_to(ends)
            blocks += 1
        named, classes, hidden = _attributes(m[3]) if m[3] else (False, "", False)
        els.append(_Element(tag, stack[-1], named, classes, els[stack[-1]].unread or hidden or tag in UNREAD))
        if m[3].endswith("/") and tag in ("svg", "math", "iframe"):
            continue
        stack.append(len(els) - 1)
        total[tag] = total.get(tag, 0) + 1
        scopes[-1][tag] = scopes[-1].get(tag, 0) + 1
        if tag in _STOPS:
            scopes.append({})
        links += tag == "a"
        if tag in RAW:
            e = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, pos)
            pos = at = e.start() if e else n
    text(n)
    return els, nodes


def _paths(els: list[_Element], p: PathParams) -> tuple[list[int], list[float], list[bool], list[bool]]:
    """Of each element its path; of each path its weight, whether a furniture tag is on it and whether it is a heading's."""
    # a name is not believed of an element that holds the article itself
    heads = {"article", "main"}
    if not any(e.tag in heads for e in els):
        heads = {"h1"}
    holds = [e.tag in heads for e in els]
    for i in range(len(els) - 1, 0, -1):
        holds[els[i].parent] = holds[els[i].parent] or holds[i]
    ids: dict[tuple, int] = {}
    of, weight, tagged, heading = [], [], [], []
    within: list[bool] = []
    for i, e in enumerate(els):
        up = of[e.parent] if i else -1
        within.append(i > 0 and (within[e.parent] or e.tag in ("article", "main")))
        if e.tag in INLINE:
            of.append(up)
            continue
        # a page's header is furniture, an article's own header holds its headline
        by_tag = e.tag in FURNITURE or (e.tag == "header" and not within[i])
        by_name = e.named and not holds[i] and e.tag not in ("html", "body", "article", "main")
        key = (up, e.tag, e.classes, by_name)
        if key not in ids:
            ids[key] = len(weight)
            w = weight[up] if up >= 0 else 1.0
            weight.append(w * (p.furniture_tag if by_tag else 1.0) * (p.furniture_name if by_name else 1.0))
            tagged.append(by_tag or (up >= 0 and tagged[up]))
            heading.append(e.tag in HEADINGS or (up >= 0 and heading[up]))
        of.append(ids[key])
    return of, weight, tagged, heading


def path_scores(nodes: list[tuple[int, int, int]], p: PathParams) -> dict[int, float]:
    """Score of each path, of its nodes' (path, length without links, punctuation) in page order: the ratios
    fused, smoothed by a Gaussian along the page and averaged."""
    length: dict[int, int] = {}
    punct: dict[int, int] = {}
    count: dict[int, int] = {}
    for path, n, marks in nodes:
        length[path] = length.get(path, 0) + n
        punct[path] = punct.get(path, 0) + marks
        count[path] = count.get(path, 0) + 1
    fused = {k: math.log1p(length[k] / count[k]) * (1 + math.log1p(punct[k] / count[k])) for k in count}
    line = [fused[path] for path, *_ in nodes]
    kernel = [math.exp(-(d * d) / (2 * p.sigma**2)) for d in range(-p.radius, p.radius + 1)]
    summed = dict.fromkeys(count, 0.0)
    for i, (path, *_) in enumerate(nodes):
        got = [(k, line[i + d - p.radius]) for d, k in enumerate(kernel) if 0 <= i + d - p.radius < len(line)]
        summed[path] += sum(k * x for k, x in got) / sum(k for k, _ in got)
    return {k: min(summed[k] / count[k], p.lift * fused[k]) for k in count}


def _article(els: list[_Element], weight: list[float], p: PathParams) -> tuple[int, int]:
    """The element reached by descending while one holds most of the content, and the smallest that holds all of it."""
    best: dict[int, int] = {}
    for i in range(1, len(els)):
        up = els[i].parent
        if up not in best or weight[i] > weight[best[up]]:
            best[up] = i
    root = 0
    while weight[root]:
        c = best.get(root)
        if c is None or els[c].tag in LEAF or els[c].tag in INLINE or weight[c] < p.cover * weight[root]:
            break
        root = c
        if els[root].tag == "article":
            break
    whole = 0
    while (c := best.get(whole)) is not None and 0 < weight[whole] == weight[c]:
        whole = c
    return root, whole


def extract(page: str | None, p: PathParams = PathParams()) -> str:
    """The main text of one page; empty for null and empty pages and for pages without content."""
    if not page:
        return ""
    els, raw = _parse(page)
    of, prior, tagged, heading = _paths(els, p)
    # adjacent pieces of one block and path are one text node
    pieces: list[list] = []
    for e, block, t, linked in raw:
        if pieces and pieces[-1][1] == block and of[pieces[-1][0]] == of[e]:
            pieces[-1][2].append(t)
            pieces[-1][3] += len(t) if linked else 0
        else:
            pieces.append([e, block, [t], len(t) if linked else 0])
    nodes = []
    for e, block, parts, linked in pieces:
        t = _SPACE.sub(" ", html_lib.unescape("".join(parts)) if len(parts) > 1 or "&" in parts[0] else parts[0])
        if t.strip():
            own = len(t) if of[e] >= 0 and heading[of[e]] else max(0, len(t) - linked)
            nodes.append((e, block, t, own))
    score = path_scores([(of[e], own, len(_PUNCT.findall(t))) for e, _, t, own in nodes], p)
    # text outside of all elements has the path -1
    w = lambda path: prior[path] if path >= 0 else 1.0
    score = {k: x * w(k) for k, x in score.items()}
    top = max((k for k in score if k < 0 or not tagged[k]), key=score.get, default=None)
    if top is None or not score[top]:
        return ""
    limit = p.cut * score[top]
    mass = [0.0] * len(els)
    for e, _, _, own in nodes:
        if score[of[e]] >= limit:
            mass[e] += own
    for i in range(len(els) - 1, 0, -1):
        mass[els[i].parent] += mass[i]
    if not mass[0]:
        return ""
    root, whole = _article(els, mass, p)
    beside = els[root].tag != "article"
    inside, near = [False] * len(els), [False] * len(els)
    for i, e in enumerate(els):
        inside[i] = i == root or (e.parent >= 0 and inside[e.parent])
        near[i] = beside and (i == whole or (e.parent >= 0 and near[e.parent]))
    out: list[str] = []
    last = None
    for e, block, t, _ in nodes:
        path = of[e]
        sure = w(path) >= w(top)
        place = (p.inside if sure else 1.0) if inside[e] else (p.inside if sure and path >= 0 and heading[path] else 1.0) if near[e] else p.outside
        if score[path] * place < limit:
            continue
        if block == last:
            out[-1] += t
        else:
            out.append(t)
        last = block
    return "\n".join(x for x in (_SPACE.sub(" ", t).strip() for t in out) if x)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", params: PathParams | None = None) -> DataFrame:
    """One row per page: (id, url, text, n_chars), whatever the page holds.

    Null, empty and content-free pages give an empty text; ids and urls (null too) and repeated rows
    pass through; pages of any length are read whole; other columns are not read. Broken markup is read
    as browsers would: an open paragraph ends at the next block, raw elements at their end tag only.
    """
    p = params or PathParams()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x, p) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
