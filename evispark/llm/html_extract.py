"""HTML extraction by line-block distribution.

Markup is stripped: scripts, styles, comments, boilerplate elements (by tag, and by class, id or role) and tags; each block
element's text becomes a line. The lengths of ``window`` lines are summed at every line. Where a sum rises to the threshold is
a surge point, where more than twice ``window`` lines lie outside such windows a dive point, and the text between is kept. The
threshold comes from the page: a tenth of the sum that its characters stand in on average, ``least`` at most, so that verse and
lists have a low one. At the ends of a run, lines go that are a twentieth of the page's usual line (2 characters at least,
``least`` / 4 at most), unless they are headings or end a sentence. On pages that mark their article (``article``, ``main``)
the lines are the article's, a fiftieth is enough or two characters a line, and the ends of runs stay as they are.
A class, id or role is boilerplate by its whole words: one of the boilerplate names, alone or hyphenated with names of page
parts only (``ad-box``, but not ``share-price``). It does not count on a wrapper that holds all marked articles or, where none
is marked, most of the text.

Character references are decoded, white space in a block becomes one space, blocks are joined by a space in page order.
Defined cases: null or empty html gives empty text and 0; truncated pages are read as far as they go; null ids and urls are
kept; repeated rows each give a row; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW, LEAST = 3, 80
#: HTML's element names by role.
RAW = "script|style|noscript|template|svg|iframe|object|textarea|select|head|canvas|math"
BOILER = frozenset("nav header footer aside form menu dialog button fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names of boilerplate, and names of page parts that stand beside them in class names.
NOISE = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promotions banner banners cookie cookies consent gdpr notice notices notification notifications alert alerts sidebar aside menu menus nav navbar navigation breadcrumb breadcrumbs comment comments disqus respond reply replies share sharing social related recommended recommendations newsletter subscribe subscription popup popups modal overlay login signup search searchform searchbox footer header masthead toolbar pagination pager".split()
)
PARTS = frozenset(
    "site page main top bottom left right center box bar list item items link links block wrap wrapper container section area panel post posts article articles story stories widget widgets inner outer button buttons icon icons form field input thread body content global primary secondary mobile desktop sticky fixed side slot unit text title message messages header footer area row col column group holder region complementary".split()
)
_SPLIT = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<({RAW})\b[^>]*(?<!/)>.*?(?:</\1\s*>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|</?[a-zA-Z][^<>]*(?:>|$)""",
    re.S | re.I,
)
#: What a sentence ends with.
_ENDS = frozenset(".!?…:;\"'”’»。！？")
_EDGES = frozenset("article main section body html footer nav aside header".split())


def noise(token: str) -> bool:
    """Whether one class, id or role names boilerplate."""
    parts = [p.lower() for p in _SPLIT.split(token) if p and not p.isdigit()]
    whole = "".join(parts)
    return whole in NOISE or (any(p in NOISE for p in parts) and all(p in NOISE or p in PARTS for p in parts))


def _noisy(name: str, attributes: str) -> bool:
    if name in BOILER:
        return True
    if not attributes or name in ("html", "body", "article", "main") or name in HEADINGS or name in VOID:
        return False
    return any(noise(token) for _, v in _ATTR.findall(attributes) for token in v.strip("\"'").split())


def lines(page: str) -> list[tuple[str, bool, bool]]:
    """(text, in the marked article, is a heading) of each block of a page, boilerplate left out."""
    out, buffer, at = [], [], 0
    inside = heading = 0
    skip, depth = "", 0  # the boilerplate element that is being left out, and how deep it is nested in its own name
    tokens = list(_TOKEN.finditer(page))
    facts: list = []

    ends: dict[int, int] = {}  # the token that ends each element, where one does
    open_: dict[str, list[int]] = {}
    for n, t in enumerate(tokens):
        if t[3]:
            if not t[2]:
                open_.setdefault(t[3].lower(), []).append(n)
            elif open_.get(t[3].lower()):
                ends[open_[t[3].lower()].pop()] = n

    def wraps(k: int, last: int) -> bool:
        """Whether tokens k to last hold all marked articles or, where none is marked, most of the text."""
        if not facts:
            gaps = [len(page[p.end() if p else 0 : t.start()].strip()) for p, t in zip([None, *tokens], tokens)]
            facts.append([0, *accumulate(gaps)])
            facts.append([n for n, t in enumerate(tokens) if t[3] and not t[2] and t[3].lower() in ("article", "main")])
        text, marked = facts
        if marked:
            return k < marked[0] and marked[-1] < last
        return 2 * (text[last + 1] - text[k + 1]) > text[-1] + len(page[tokens[-1].end() :].strip())

    def flush() -> None:
        text = " ".join(htmllib.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            out.append((text, inside > 0, heading > 0))

    for k, t in enumerate(tokens):
        if not skip:
            buffer.append(page[at : t.start()])
        at = t.end()
        name, end = (t[3] or "").lower(), bool(t[2])
        if not name:
            if t[1] and not skip and t[1].lower() in ("textarea", "select", "iframe", "object"):
                buffer.append(" ")
            continue
        if skip == "p":  # a paragraph ends where the next block begins, too
            if name not in BLOCK:
                continue
            skip = ""
            if name == "p" and end:
                continue
        if skip and depth < 0:  # an element without an end: it ends with what it cannot hold
            if name in _EDGES and (end or name in ("article", "main")):
                skip = ""
            else:
                continue
        elif skip:
            if name == skip and not t[4].rstrip().endswith("/"):
                depth += -1 if end else 1
                if depth == 0:
                    skip = ""
            continue
        if name == "br":
            buffer.append(" ")
        if name in BLOCK:
            flush()
        if not end and name not in VOID and _noisy(name, t[4]) and not ((last := ends.get(k, 0)) and name != "p" and wraps(k, last)):
            flush()
            skip, depth = name, 1 if last else -1
        elif name in ("article", "main"):
            inside = max(0, inside + (-1 if end else 1))
        elif name in HEADINGS:
            heading = 0 if end else 1
        elif name in BLOCK:
            heading = 0
    if not skip:
        buffer.append(page[at:])
    flush()
    return out


def kept(blocks: list[tuple[str, bool, bool]], window: int = WINDOW, least: int = LEAST) -> list[str]:
    """The text between surge and dive points."""
    marked = any(b[1] for b in blocks)
    blocks = [b for b in blocks if b[1]] if marked else blocks
    if not blocks:
        return []
    sizes = [len(b[0]) for b in blocks]
    usual = lambda xs: sum(x * x for x in xs) / sum(xs)
    sums = [sum(sizes[i : i + window]) for i in range(max(1, len(sizes) - window + 1))]
    threshold, short = min(2 * window, usual(sums) / 50) if marked else min(least, usual(sums) / 10), max(2, min(least / 4, usual(sizes) / 20))
    runs: list[list[int]] = []
    for i, total in enumerate(sums):
        if total >= threshold:
            if runs and i - runs[-1][1] <= 2 * window:
                runs[-1][1] = min(i + window, len(sizes))
            else:
                runs.append([i, min(i + window, len(sizes))])
    edge = lambda i: sizes[i] < short and not blocks[i][2] and blocks[i][0][-1] not in _ENDS
    out = []
    for first, last in runs:
        if marked:
            out += [b[0] for b in blocks[first:last]]
            continue
        while first < last and edge(first):
            first += 1
        while first < last and (edge(last - 1) or blocks[last - 1][2]):  # a heading belongs to what follows
            last -= 1
        out += [b[0] for b in blocks[first:last]]
    return out


def main_text(page: str | None) -> str:
    return " ".join(kept(lines(page))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points)."""

    def run(batches):
        for b in batches:
            texts = [main_text(p.as_py()) for p in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
