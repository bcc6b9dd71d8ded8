"""Main text of a page by line-block distribution.

Markup is stripped to lines: a block element starts a new line. Lines inside elements that never hold the article (scripts, menus,
forms, adverts, notices, reader comments and so on, by element, role, class or id) keep their place but weigh nothing. The text lengths without link
text are summed over a sliding window of ``WINDOW`` lines; text begins at a *surge* point, a line where the sum rises over the threshold, and
ends at a *dive* point, where it falls to nothing. The threshold is a small share of the page's largest sum, so short
articles count too. Everything between surge and dive is kept; if the page marks its article (article or main element), only
what is inside weighs.

Link text is that of an anchor with a target, up to its end tag. Anchors do not nest: one that has no end tag before the next anchor
starts lost it, and its text ends with the line.

Defined results: null or empty pages, and pages without such text, give an empty text; unclosed elements end with the page, or where the
article starts; character references are decoded once; repeated rows get equal rows; other columns pass through.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from dossierspark.llm.rows import with_columns

WINDOW, SHARE, MOST = 3, 0.1, 60
RAW = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|template|noscript|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?\]\]>")
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^\"'>]|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z|<\Z")
NAMES = re.compile(r"""(?i)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
TARGET = re.compile(r"""(?i)(?:^|[\s"'/])href\s*=""")
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*\Z""")
#: Elements that start a line, that have no end tag, and that never hold the article.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav header footer aside form menu button select option iframe svg object canvas dialog head label audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
BOILER = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
                   "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted "
                   "promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())


#: Names of reader comments among these, and words that say that the next one is absent or elsewhere.
TALK = frozenset("comment comments disqus replies reply respond".split())
BESIDE = frozenset("no has with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def boiler(name: str, attributes: str) -> str:
    """``sure`` for elements and roles that never hold the article, ``talk`` or ``named`` for class or id names that seldom do, else nothing."""
    if name in DROPPED:
        return "sure"
    if not attributes or name in ("html", "body", "article", "main"):
        return ""
    found = ""
    for m in NAMES.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            if value.strip().lower() in ROLES:
                return "sure"
            continue
        for one in value.split():
            words = re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", one).lower())
            for before, word in zip(["", *words], words):
                if word in BOILER and before not in BESIDE:
                    found = "talk" if word in TALK or found == "talk" else "named"
    return found


def element_ends(tags: list[re.Match]) -> dict[int, int]:
    """Place of the end tag of each element that has one."""
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for i, m in enumerate(tags):
        name = (m[2] or m[5] or "").lower()
        if m[1] or m[4]:
            if open_.get(name):
                ends[open_[name].pop()] = i
        elif name and name not in VOID and not SELF_CLOSED.search(m[3] or m[6] or ""):
            open_.setdefault(name, []).append(i)
    return ends


def dropped_places(source: str, tags: list[re.Match], anchors: dict[int, int]) -> set[int]:
    """Start tags whose elements go. A class or id name alone does not remove what holds the first heading or, but for comments, most of the text."""
    kinds = {}
    for i, m in enumerate(tags):
        name = (m[2] or m[5] or "").lower()
        if name and not (m[1] or m[4]) and name not in VOID and (name != "a" or i in anchors):
            kind = boiler(name, m[3] or m[6] or "")
            if kind:
                kinds[i] = kind
    if not any(k != "sure" for k in kinds.values()):
        return set(kinds)
    ends = element_ends(tags)
    text, at, linked_until, sure_until, first = [0], 0, -1, -1, None
    for i, m in enumerate(tags):
        part = source[at:m.start()].strip() if i > linked_until and i > sure_until else ""
        text.append(text[-1] + len(part))
        at = m.end()
        if i in anchors:
            linked_until = max(linked_until, anchors[i])
        if kinds.get(i) == "sure":
            sure_until = max(sure_until, ends.get(i, i))
        if first is None and (m[2] or m[5] or "").lower() == "h1" and i > sure_until:
            first = i
    gone = set()
    for i, kind in kinds.items():
        stop = ends.get(i, len(tags) - 1)
        held = text[stop + 1] - text[i + 1]
        if kind == "sure" or not (first is not None and i < first < stop or kind == "named" and 2 * held > text[-1]):
            gone.add(i)
    return gone


def anchor_ends(tags: list[re.Match]) -> dict[int, int]:
    """Of each anchor that starts in ``tags`` and has an end tag before the next one starts: the places of both."""
    ends: dict[int, int] = {}
    start = None
    for i, m in enumerate(tags):
        if (m[2] or m[5] or "") not in ("a", "A"):
            continue
        if not (m[1] or m[4]):
            if not SELF_CLOSED.search(m[3] or m[6] or ""):
                start = i
        elif start is not None:
            ends[start], start = i, None
    return ends


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters outside links, inside the marked article, heading) of each line; dropped lines are empty."""
    source = RAW.sub(" ", page)
    out: list[tuple[str, int, bool, bool]] = []
    text: list[str] = []
    weight = marked = 0
    heading = False
    drop, depth = "", 0
    tags = list(TAG.finditer(source))
    ends = anchor_ends(tags)
    gone = dropped_places(source, tags, ends)
    linked, until = False, None  # in link text, up to this tag or else to the end of the line

    def close():
        nonlocal weight, linked
        linked = linked and until is not None
        line = " ".join(html.unescape("".join(text)).split())
        out.append((line, min(len(line), weight), marked > 0, heading))
        text.clear()
        weight = 0

    def take(part: str):
        nonlocal weight
        if part and not drop:
            text.append(part)
            if not linked:
                weight += len(part.strip())

    at = 0
    for i, m in enumerate(tags):
        take(source[at:m.start()])
        at = m.end()
        if until is not None and i >= until:
            linked, until = False, None
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ending = bool(m[1] or m[4])
        if drop:
            if name in ("article", "main") and not ending and not marked:
                drop = ""
            else:
                if name == drop:
                    depth += -1 if ending else 0 if (m[3] or m[6] or "").rstrip().endswith("/") else 1
                    if not depth:
                        drop = ""
                        out.append(("", 0, marked > 0, False))
                continue
        if name in BLOCKS or name in DROPPED:
            close()
            heading = name in HEADINGS and not ending
        elif name == "br":
            text.append(" ")
        if name in ("article", "main"):
            marked = max(0, marked + (-1 if ending else 1))
        elif name == "a" and not ending and not SELF_CLOSED.search(m[3] or m[6] or ""):
            linked, until = bool(TARGET.search(m[3] or m[6] or "")), ends.get(i)
        if i in gone:
            close()
            drop, depth = name, 1
    take(source[at:])
    close()
    return out


def main_text(page: str | None) -> str:
    """The text between surge and dive points. Only lines with text fill the window."""
    lines = [line for line in (lines_of(page) if page else []) if line[0]]
    inside = any(marked and w for _, w, marked, _ in lines)
    if inside:
        lines = [line for line in lines if line[2]]
    weights = [w for _, w, _, _ in lines] + [0] * WINDOW
    sums = [sum(weights[i:i + WINDOW]) for i in range(len(lines))]
    threshold = 0 if inside else min(MOST, SHARE * max(sums, default=0))
    kept: list[int] = []
    on = False
    for i in range(len(lines)):
        if not on and sums[i] > threshold:
            on = True
        elif on and not sums[i]:
            on = False
        if on:
            kept.append(i)
    if not inside:  # the window reaches the surge before the text does: short lines at either end are not the article's, but headings before it are
        short = lambda i: weights[i] <= threshold
        while kept and short(kept[-1]):
            kept.pop()
        while kept and short(kept[0]) and not lines[kept[0]][3]:
            kept.pop(0)
    return "\n\n".join(lines[i][0] for i in kept)


def extract(pages: DataFrame, page: str = "html", text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``pages`` with the main text of each page."""
    def make():
        return lambda column: [pa.array([main_text(column[i].as_py()) for i in range(len(column))], pa.string())]

    return with_columns(pages, [page], f"`{text}` string", make, drop)
