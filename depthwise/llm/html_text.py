"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element with text, in page order. Where other elements (div, section, list, table)
begin or end between two lines there are empty lines, so that the page's layout makes gaps. The text lengths of the lines are
summed over sliding windows; where the sum surges over a threshold the text starts, where it dives below it ends, and what lies
between is kept. The threshold is a share of the page's largest window sum. Text in links doesn't count.

Tags and classes only weigh: lines in article elements are one distribution, lines of what isn't known a second, lines of menus,
footers, adverts, notices and comments a third, and the text of the distribution with the largest weighted sum is the result. So
an advert inside an article doesn't divide it, and a class that misleads can't remove what holds most of the page's text.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a sliding window.
WINDOW = 3
#: Surge threshold: this share of the largest window sum, at most so many characters; in article elements any text surges.
SURGE, SURGE_MOST = 0.15, 100
#: Runs of lines that are at most so many lines apart belong together.
APART = 8
#: Weights of the three distributions, and of headings.
ARTICLE, PLAIN, OTHER, COMMENTS = 0, 1, 2, 3
WEIGHT = {ARTICLE: 4, PLAIN: 1, OTHER: 0.02}
HEADING = 4
#: Elements whose content is no text of the page.
SKIPPED = frozenset("head title style script noscript template button select option textarea iframe object svg canvas math audio video map dialog".split())
#: Elements that are seldom part of an article; a header is if it stands in one.
AROUND = frozenset("nav header footer aside form menu".split())
#: Elements whose content isn't parsed as markup.
RAW = frozenset("script style title textarea noscript iframe template svg".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end a line but leave no gap; their end tags may be missing.
LINES = frozenset("p li td th tr dt dd h1 h2 h3 h4 h5 h6 hr pre thead tbody tfoot figcaption caption blockquote".split())
#: Words in class, id or role that name what isn't the article, alone or two in a row; and those that name readers' comments.
NAMES = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promos sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead siteheader pageheader toolbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login related recommended share sharing social widget pagination pager tags complementary contentinfo search alert dialog copyright".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Words beside them that say it is text after all.
TEXT_NAMES = frozenset("history story stories article".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_MARK = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"[\s\x1c-\x1f]+")


def named(attributes: str) -> int | None:
    """OTHER or COMMENTS if a class, id or role says so."""
    found = None
    for a, b, c in _MARK.findall(attributes) if "=" in attributes else ():
        for name in (a or b or c).split():
            words = [w.lower() for w in _WORD.findall(name)]
            if COMMENT_NAMES.intersection(words):
                return COMMENTS
            pairs = [x + y for x, y in zip(words, words[1:])]
            if NAMES.intersection(words + pairs) and not TEXT_NAMES.intersection(words):
                found = OTHER
    return found


def _inside(name: str, attributes: str, around: int) -> int:
    """What the content of an element counts as, by the element and what it stands in. Comments hold nothing else."""
    if around == COMMENTS:
        return COMMENTS
    kind = named(attributes) if name not in ("html", "body", "main") else None
    if kind is not None:
        return kind
    if name == "article":
        return ARTICLE
    if name == "main":
        return ARTICLE if around == ARTICLE else PLAIN
    if name in AROUND and not (name == "header" and around == ARTICLE):
        return OTHER
    return around


def lines(page: str) -> list[tuple[str, int, int, int]]:
    """(text, its weight in characters without links, distribution, empty lines before it) for each block with text; the empty
    lines are those since the line before of the same distribution."""
    out: list[tuple[str, int, int, int]] = []
    parts: list[str] = []
    gap = [0, 0, 0]
    linked, in_link, heading = 0, False, False
    around: list[tuple[str, int]] = []  # open elements, with what their content counts as
    skip: list[str] = []  # open elements below a skipped one
    at, end = 0, len(page)
    lower = None

    def kind() -> int:
        return min(around[-1][1], OTHER) if around else PLAIN

    def flush():
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            k = kind()
            out.append((text, (len(text) - min(linked, len(text))) * (HEADING if heading else 1), k, gap[k]))
            gap[k] = 0
        parts.clear()
        linked = 0

    def raw(name: str) -> int:
        nonlocal lower
        lower = lower or page.lower()
        close = lower.find(f"</{name}", at)
        close = end if close < 0 else page.find(">", close + len(name) + 2)
        return end if close < 0 else min(end, close + 1)

    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not skip:
            piece = page[at:stop]
            parts.append(piece)
            if in_link:
                linked += len(_SPACE.sub(" ", html.unescape(piece)).strip())
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] == "/", m[3]
        if skip:
            if closing:
                if name in skip:
                    while skip.pop() != name:
                        pass
            elif name in RAW:
                at = raw(name)
            elif name not in VOID and name not in LINES and name != "option" and not attributes.endswith("/"):
                skip.append(name)
            continue
        if not closing and name not in VOID and (name in SKIPPED or _HIDDEN.search(attributes) and name not in ("html", "body")):
            if name not in INLINE:
                flush()
            if name in RAW:
                at = raw(name)
            elif not attributes.endswith("/"):
                skip = [name]
            continue
        if name == "a":
            in_link = not closing
        if name == "br":
            parts.append(" ")
        if name in INLINE:
            continue
        flush()
        heading = not closing and name in ("h1", "h2")
        marked = not closing and name in LINES and named(attributes)
        if name in LINES and not marked and not (closing and any(x == name for x, _ in around[-1:])):
            continue
        if name in VOID:
            continue
        if closing:
            if any(x == name for x, _ in around):
                while around[-1][0] != name:
                    around.pop()
                around.pop()
                gap[kind()] += 1
        elif not attributes.endswith("/"):
            gap[kind()] += 1
            around.append((name, _inside(name, attributes, around[-1][1] if around else PLAIN)))
    flush()
    return out


def runs(size: list[float], threshold: float) -> list[tuple[int, int]]:
    """(first, end) of the lines between each surge of the window sums to the threshold and the dive after it, without lines of no
    weight on either side that only the windows' width has brought in."""
    sums = [sum(size[k : k + WINDOW]) for k in range(len(size))]
    out, start = [], None
    for k, total in enumerate([*sums, -1]):
        if total >= threshold and start is None:
            start = k
        elif total < threshold and start is not None:
            low, high = start, min(k - 1 + WINDOW, len(size))
            while low < high and not size[low]:
                low += 1
            while high > low and not size[high - 1]:
                high -= 1
            if low < high:
                out.append((low, high))
            start = None
    joined: list[tuple[int, int]] = []  # windows of two runs may overlap
    for low, high in out:
        if joined and low < joined[-1][1]:
            joined[-1] = joined[-1][0], max(high, joined[-1][1])
        else:
            joined.append((low, high))
    return joined


def _kept(part: list[tuple[str, int, int, int]], article: bool) -> tuple[float, list[str]]:
    """(weight, lines) of what one distribution gives."""
    texts: list[str | None] = []
    size: list[float] = []
    for text, weight, _, gap in part:
        texts += [None] * min(gap, WINDOW) + [text]
        size += [0] * min(gap, WINDOW) + [weight]
    top = max((sum(size[k : k + WINDOW]) for k in range(len(size))), default=0)
    threshold = 1 if article else max(1, min(SURGE_MOST, SURGE * top))
    found = []
    for low, high in runs(size, threshold):
        # groups of lines at the edges, parted by a gap, that don't reach the threshold themselves
        groups, at = [], low
        for k in range(low, high + 1):
            if k == high or texts[k] is None:
                if k > at:
                    groups.append((at, k))
                at = k + 1
        heavy = [g for g in groups if sum(size[g[0] : g[1]]) >= threshold]
        if heavy:
            found.append((heavy[0][0], heavy[-1][1]))
    if not found:
        return 0, []
    if not article:
        best = max(range(len(found)), key=lambda k: sum(size[found[k][0] : found[k][1]]))
        first = last = best
        while first and found[first][0] - found[first - 1][1] <= APART and sum(size[slice(*found[first - 1])]) >= 3 * threshold:
            first -= 1
        while last + 1 < len(found) and found[last + 1][0] - found[last][1] <= APART and sum(size[slice(*found[last + 1])]) >= 3 * threshold:
            last += 1
        found = found[first : last + 1]
    return sum(sum(size[low:high]) for low, high in found), [t for low, high in found for t in texts[low:high] if t is not None]


def main_text(page: str | None) -> str:
    """The text between surge and dive; '' without any."""
    if not page:
        return ""
    found = lines(page)
    best, text = 0.0, ""
    for kind, factor in WEIGHT.items():
        total, kept = _kept([x for x in found if x[2] == kind], kind == ARTICLE)
        if total * factor > best:
            best, text = total * factor, "\n".join(kept)
    return text


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row. Null or empty html gives an empty text; repeated rows give repeated results; other
    columns are ignored. A page that ends inside an element counts as closed there."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kind['id']}, url {kind['url']}, text string, n_chars bigint").withColumnsRenamed({"id": id_col, "url": url_col})
