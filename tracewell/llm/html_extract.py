"""Main text of web pages by tag-path ratios.

Every block of text has a root-to-leaf path of tags (each with its first class).
Per path the length of its text, its punctuation and its text in links are summed
over the page and divided by its number of text nodes. Along the page's sequence
of blocks both ratios are smoothed, neighbours in other containers weighing less,
and fused into one score per path; paths below SHARE of the best are no content.

What the content paths hold decides on containers: from the page down, the way
goes into the container that holds most of the page's content (MOST), together
with its siblings that hold a share (PART) of it at a similar score. It ends at an
`article` or `main` element, where no container holds most, or where such a share
lies beside the containers. There all that is not dropped is main text: headings,
short lines, lists, tables, links.

Elements that HTML itself sets apart (nav, footer, aside, button, hidden ones, a
header or noscript outside an article, a form's labels ...) hold no main text. A form, or
an element whose class or id speaks of advertising, comments and so on, is dropped on the
evidence of ratios too. One that is named as such is kept where it holds most of the page's text, or,
inside an article, half of it at the score of the rest; one whose longer name only holds
such a word goes if it has less than half of the text and its text is mostly links, or
scores low and has no heading.

Character references are decoded, white space in a block becomes one space, and
blocks are joined by one newline in page order. Null, empty or text-free pages
give an empty text. Markup may be cut off or unclosed; time and memory grow in
proportion to the page. Repeated rows give repeated results; only page_id, url
and html are read.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .support import extended, slices, texts_of, with_columns

SHARE = 0.2  # of the best path's score, for content paths
MOST = 0.7  # of the content's text, for the way down
PART = 0.1  # of the content's text, for siblings beside the way
SMOOTH = (1.0, 0.6, 0.14)  # Gaussian weights at 0, 1 and 2 blocks
APART = 0.3  # weight of a neighbour in another container

# HTML elements by their role.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea iframe svg object canvas select title xmp noembed noframes".split())
APART_BY_HTML = frozenset("nav footer aside menu button dialog head search option datalist".split())
APART_OUTSIDE = frozenset("header noscript".split())  # main text only inside an article
CONTENT = frozenset("article main".split())
CONTAINER = frozenset("html body article main div section center td form".split())
CLOSES_P = BLOCK - frozenset("body html head title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
CLOSED_BY = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}

# A class or id that is such a word (numbered, or with a word for a box), and such words in a longer one.
_WORDS = "ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promoted|promotion|cookie|cookies|consent|gdpr|popup|modal|newsletter|subscribe|signup|sidebar|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|pagination|pager|footer|masthead|toolbar|comment|comments|respond|disqus|notice|notices|banner|copyright"
_BOXES = "area|bar|block|body|bottom|box|container|content|form|head|header|holder|item|label|left|link|links|list|main|outer|inner|panel|right|section|slot|title|top|unit|widget|wrap|wrapper|" + _WORDS
NAMED = re.compile(rf"(?:{_WORDS})(?:[-_](?:{_BOXES}))*[-_]?\d*$", re.I)
HINTED = re.compile(r"(?:^|[-_])(?:ad|ads|advert|adverts|advertisement|sponsor|sponsored|promo|promoted|promotion|banner|cookie|cookies|consent|notice|notices|popup|modal|newsletter|subscribe|signup|sidebar|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|pagination|pager|footer|header|masthead|toolbar|share|sharing|social|related|recommended|comment|comments|respond|replies|reply|widget|copyright|skip|login)(?:$|[-_\d])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>=]|=)*+)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_MARK = re.compile(r"[.,;:!?…。，！？；：]")
_SPACE = re.compile(r"\s+")


def attributes(text: str) -> dict[str, str]:
    """Names and values of a tag's class, id, role, hidden and aria-hidden."""
    if not text or text.isspace():
        return {}
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text) if m[1].lower() in ("class", "id", "role", "hidden", "aria-hidden")}


def hint(tag: str, named: dict[str, str]) -> int:
    """2: the element is named as boilerplate; 1: its name has such a word, or it is a form; 0: neither."""
    if tag in ("body", "html"):
        return 0
    names = f"{named.get('class', '')} {named.get('id', '')}".split()
    if tag in CONTENT:
        return 2 if any(re.match(r"comments?(?:$|[-_\d])", x, re.I) for x in names) else 0
    if tag == "form":
        return 2
    return max((2 if NAMED.match(x) else 1 if HINTED.search(x) else 0 for x in names), default=0)


@dataclass
class Page:
    """Elements (by place of their start tag) and the blocks of text in them."""

    tag: list[str] = field(default_factory=lambda: [""])
    up: list[int] = field(default_factory=lambda: [-1])
    path: list[int] = field(default_factory=lambda: [0])
    hint: list[int] = field(default_factory=lambda: [0])
    at: list[int] = field(default_factory=list)  # element of each block
    text: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    nodes: list[int] = field(default_factory=list)


def parse(page: str) -> Page:
    """One pass; each tag is pushed and popped once, and looked up by its name's open places."""
    out, paths = Page(), {}
    stack: list[tuple[str, int, bool]] = []  # tag, element, muted by itself
    open_at: dict[str, list[int]] = {}
    block_at: list[int] = []
    parts: list[str] = []
    links = nodes = muted = 0
    where = -1
    unended: set[str] = set()

    def close() -> None:
        nonlocal links, nodes, where
        if where >= 0 and (text := _SPACE.sub(" ", references.unescape("".join(parts))).strip()):
            out.at.append(where), out.text.append(text), out.links.append(min(links, len(text))), out.nodes.append(nodes)
        parts.clear()
        links, nodes, where = 0, 0, -1

    def words(s: str) -> None:
        nonlocal links, nodes, where
        if not s or muted:
            return
        parts.append(s)
        if not s.isspace():
            nodes += 1
            if open_at.get("a"):
                links += len(s)
            if where < 0:
                where = stack[block_at[-1]][1] if block_at else 0

    def cut(depth: int) -> None:
        nonlocal muted
        while len(stack) > depth:
            tag, _, mute = stack.pop()
            open_at[tag].pop()
            muted -= mute
            if tag in BLOCK:
                block_at.pop()

    last = lambda tags: max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            words(page[at:])
            break
        words(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK:
                close()
            depth = last((tag,))
            if depth >= 0 and (tag in BLOCK or not block_at or block_at[-1] < depth):
                cut(depth)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        alone = m[3].endswith("/")
        if tag in RAW:
            if not alone:
                end = None if tag in unended else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if end is None:
                    unended.add(tag)
                at = end.end() if end else n
            continue
        if tag in BLOCK:
            close()
            if tag in CLOSES_P and block_at and stack[block_at[-1]][0] == "p":
                cut(block_at[-1])
            if tag in CLOSED_BY:
                same, stop = CLOSED_BY[tag]
                depth = last(same)
                if depth > last(stop):
                    cut(depth)
        if tag in VOID or alone and tag not in BLOCK:
            continue
        named = attributes(m[3])
        mute = tag in APART_BY_HTML or tag in APART_OUTSIDE and not (open_at.get("article") or open_at.get("main")) or tag == "label" and bool(open_at.get("form"))
        if tag not in ("body", "html"):
            mute = mute or "hidden" in named or named.get("aria-hidden", "").lower() == "true" or named.get("role", "").lower() in ROLES
        up = stack[-1][1] if stack else 0
        step = (out.path[up], tag, (named.get("class", "").split() or [""])[0])
        out.tag.append(tag), out.up.append(up), out.path.append(paths.setdefault(step, len(paths) + 1)), out.hint.append(hint(tag, named))
        open_at.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            block_at.append(len(stack))
        stack.append((tag, len(out.tag) - 1, mute))
        muted += mute
    close()
    return out


def path_scores(p: Page, live: list[int]) -> dict[int, float]:
    """Score of each path of the live blocks: smoothed length and punctuation ratios, fused, less for links."""
    sums: dict[int, list[float]] = {}
    for i in live:
        s = sums.setdefault(p.path[p.at[i]], [0, 0, 0, 0])
        s[0] += len(p.text[i])
        s[1] += len(_MARK.findall(p.text[i]))
        s[2] += p.links[i]
        s[3] += p.nodes[i]
    ratio = [(s[0] / s[3], s[1] / s[3]) for s in (sums[p.path[p.at[i]]] for i in live)]
    around = [p.up[p.at[i]] for i in live]
    total: dict[int, list[float]] = {}
    for i, block in enumerate(live):
        long = marks = weight = 0.0
        for j in range(max(0, i - 2), min(len(live), i + 3)):
            w = SMOOTH[abs(i - j)] * (1.0 if around[i] == around[j] else APART)
            long, marks, weight = long + w * ratio[j][0], marks + w * ratio[j][1], weight + w
        t = total.setdefault(p.path[p.at[block]], [0, 0, 0])
        t[0] += long / weight
        t[1] += marks / weight
        t[2] += 1
    return {k: (t[0] / t[2]) ** 0.5 * (1 + t[1] / t[2]) * (1 - sums[k][2] / max(sums[k][0], 1)) ** 2 for k, t in total.items()}


def upwards(p: Page, own: list[float]) -> list[float]:
    """Sums over each element and all in it; elements come after those around them."""
    out = list(own)
    for e in range(len(out) - 1, 0, -1):
        out[p.up[e]] += out[e]
    return out


def inside(p: Page, chosen: list[bool]) -> list[bool]:
    """Whether an element or one around it is chosen."""
    out = list(chosen)
    for e in range(1, len(out)):
        out[e] = out[e] or out[p.up[e]]
    return out


def _per_element(p: Page, blocks: list[int], value) -> list[float]:
    own = [0.0] * len(p.tag)
    for i in blocks:
        own[p.at[i]] += value(i)
    return own


def named_boilerplate(p: Page) -> list[bool]:
    """Elements that name and ratios together say are not main text."""
    every = range(len(p.at))
    scores = path_scores(p, list(every))
    long = upwards(p, _per_element(p, every, lambda i: len(p.text[i])))
    links = upwards(p, _per_element(p, every, lambda i: p.links[i]))
    score = upwards(p, _per_element(p, every, lambda i: len(p.text[i]) * scores[p.path[p.at[i]]]))
    heads = upwards(p, [float(t in ("h1", "h2")) for t in p.tag])
    page = score[0] / max(long[0], 1)
    within = inside(p, [t in CONTENT for t in p.tag])

    def drop(e: int) -> bool:
        if not p.hint[e] or not long[e]:
            return False
        share = long[e] / long[0]
        if p.hint[e] == 2:
            prose = score[e] / long[e] >= 0.8 * (score[0] - score[e]) / max(long[0] - long[e], 1) and links[e] < 0.3 * long[e]
            return share < (0.5 if p.tag[e] == "form" or prose and within[e] else 0.8)
        return share < 0.5 and (links[e] > 0.3 * long[e] or not heads[e] and score[e] / long[e] < SHARE * page)

    return [drop(e) for e in range(len(p.tag))]


def main_text(page: str | None) -> str:
    p = parse(page or "")
    gone = inside(p, named_boilerplate(p)) if any(p.hint) else [False] * len(p.tag)
    live = [i for i in range(len(p.at)) if not gone[p.at[i]]]
    scores = path_scores(p, live)
    best = max(scores.values(), default=0.0)
    content = [i for i in live if scores[p.path[p.at[i]]] >= SHARE * best]
    mass = upwards(p, _per_element(p, content, lambda i: len(p.text[i])))
    score = upwards(p, _per_element(p, content, lambda i: len(p.text[i]) * scores[p.path[p.at[i]]]))
    whole = upwards(p, [float(t in CONTENT and m > 0) for t, m in zip(p.tag, mass)])
    under: list[list[int]] = [[] for _ in p.tag]
    for e in range(1, len(p.tag)):
        if mass[e] and p.tag[e] in CONTAINER:
            under[p.up[e]].append(e)
    chosen = [False] * len(p.tag)
    way = 0
    while p.tag[way] not in CONTENT:
        down = max(under[way], key=mass.__getitem__, default=0)
        if not down or mass[down] < MOST * mass[0]:
            break

        def beside(m: float, s: float, down: int = down) -> bool:
            return not whole[down] and m >= PART * mass[0] and s / m >= 0.5 * score[down] / mass[down]

        if beside(mass[way] - sum(mass[e] for e in under[way]), score[way] - sum(score[e] for e in under[way])):
            break
        for e in under[way]:
            chosen[e] = e != down and beside(mass[e], score[e])
        way = down
    chosen[way] = True
    kept = inside(p, chosen)
    head = [e for e in live if not kept[p.at[e]] and p.tag[p.at[e]] in ("h1", "h2", "h3")]
    heads = {i for i in head if _leads(p, i, kept)}
    return "\n".join(p.text[i] for i in live if kept[p.at[i]] or i in heads)


def _leads(p: Page, i: int, kept: list[bool]) -> bool:
    """Whether a heading outside the content stands right before it."""
    return i + 1 < len(p.at) and kept[p.at[i + 1]]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            text = [main_text(h) for h in texts_of(b, "html")]
            yield with_columns(b.select(["page_id", "url"]), text=pa.array(text, pa.string()), n_chars=pa.array([len(t) for t in text], pa.int64()))

    return rows.mapInArrow(run, extended([rows.schema["page_id"], rows.schema["url"]], "text string, n_chars long"))
