"""HTML extraction by line-block distribution.

Markup is stripped into lines, one for each block of text; outside of an article, an element that holds no content (script, menu,
footer, form, advert, comments ...) leaves a gap of empty lines instead. The text lengths of lines are summed over windows of `width`
lines. A stretch begins where the sums surge from zero and ends where they dive to zero again; it is kept if one of its sums
reaches `surge`. All of a kept stretch stays, short lines too.

Article markup is a prior of that decision and no more: sums of lines in <article> or <main> count PRIOR times, and lines outside are gaps as
long as some stretch inside is kept. So a short article beside a long one goes; where the marked text never surges, the whole page is
decided by its sums. If no stretch is kept at all, the marked text is, or without any the stretch with the most text. A
<header> in an article is part of it, as it holds the title; the page's own is not.

A hint is a whole name in class, id, role, itemprop or aria-label: one of HINTS, or several joined with each other, numbers
and PLAIN words. No hint skips <main> or an outer <article>. A <main> opens in every element without content but hidden ones,
an article in a head, menu, header or form, and in a hinted element if the page has no article text elsewhere.

Defined results: null or empty html, and pages without text, give an empty text; truncated markup is read as far as it
goes; pages of any length are read whole; equal pages give equal texts; an empty table an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*)/?>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*)\Z""", re.S)
HINT = re.compile(r"""(?<![\w-])(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"(?i)(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none")
SPLIT = re.compile(r"[^a-z0-9]+")
# Elements whose content is raw text, elements without content, blocks, containers of no article text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math canvas object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
NO_TEXT = frozenset("head nav footer header aside form menu dialog button select datalist audio video map".split())
HINTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar side rail widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar share sharing social related recommended recommendations footer header masthead comment comments commentlist disqus discussion replies reply respond contentinfo complementary copyright".split())
# Words that leave a hint what it is when joined with it, as in `related-posts`; others (`has-sidebar`) do not.
PLAIN = frozenset("area bar block box button buttons column container form icons inner item items link links list panel post posts region section site slot stories unit wrap wrapper".split())
WIDTH = 3
SURGE = 86
PRIOR = 4


Lines = list[tuple[str | None, bool]]


def lines_of(page: str) -> Lines:
    """Lines of text, None for a gap, and whether each is in a marked article."""
    lines, more = read_lines(page, False)
    if more and not any(inside for _, inside in lines):
        again, _ = read_lines(page, True)
        return again if any(inside for _, inside in again) else lines
    return lines


def read_lines(page: str, in_hinted: bool) -> tuple[Lines, bool]:
    """What lines_of gives, articles in hinted elements read or not, and whether one was passed over there."""
    lines: Lines = []
    piece: list[str] = []
    skip: list[str] = []  # open elements from the outermost one without article text on
    held: Counter[str] = Counter()  # how often each of them
    why = ""  # the outermost one is skipped: its tag, `hinted` or `hidden`
    article = 0
    more = False
    section_end = 0  # of the last CDATA section, -1 if no more end

    def flush() -> None:
        text = " ".join("".join(piece).split())
        piece.clear()
        if text:
            lines.append((text, article > 0))

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if not skip:
            piece.append(html.unescape(page[at : m.start() if m else end]))
        if not m:
            break
        at = m.end()
        if page.startswith("<![CDATA[", m.start()) and section_end >= 0:
            section_end = page.find("]]>", m.start())
            at = section_end + 3 if section_end >= 0 else at
        tag = (m[2] or m[5] or m[8] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4] or m[7]), m[3] or m[6] or m[9] or ""
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                stop = re.compile(rf"</{tag}(?=[\s>/])[^>]*(?:>|\Z)|\Z", re.I).search(page, at)
                at = stop.end()
            continue
        opens = False
        if skip and tag in ("article", "main") and not closing and not hidden(attributes):
            if why in ("head", "nav", "header", "menu") and (not article or not hinted(attributes)):
                opens = True
            elif not article and why != "hidden":
                opens = tag == "main" or why == "form" or (in_hinted and why == "hinted")
                more = more or (why == "hinted" and not opens)
        if skip and not opens:
            if closing and held[tag]:
                while (last := skip.pop()) != tag:
                    held[last] -= 1
                held[tag] -= 1
            elif not closing and tag not in VOID and not attributes.endswith("/"):
                if tag != "p" and tag != "li":
                    skip.append(tag)
                    held[tag] += 1
            continue
        if skip:  # an article begins in an element that was left open
            skip.clear()
            held.clear()
        if tag == "br" or tag == "wbr":
            piece.append(" " if tag == "br" else "")
            continue
        if tag in BLOCK or tag in NO_TEXT:
            flush()
        if not closing and tag not in VOID and tag not in ("html", "body") and (reason := skipped(tag, attributes, article)):
            flush()
            if not article:
                lines.append((None, False))
            if not attributes.endswith("/"):
                skip.append(tag)
                held[tag] += 1
                why = reason
            continue
        if tag in ("article", "main"):
            article = max(0, article - 1) if closing else article + 1
            if not article or not closing and article == 1:
                lines.append((None, False))  # articles are stretches of their own
    flush()
    return lines, more


def skipped(tag: str, attributes: str, article: int) -> str:
    """Why the element holds no content, empty if it may."""
    if hidden(attributes):
        return "hidden"
    if tag in NO_TEXT and not (tag == "header" and article):
        return tag
    return "hinted" if tag != "main" and not (tag == "article" and not article) and hinted(attributes) else ""


def hidden(attributes: str) -> bool:
    return bool(attributes and HIDDEN.search(attributes))


def hinted(attributes: str) -> bool:
    if not attributes:
        return False
    for m in HINT.finditer(attributes):
        text = (m[2] or m[3] or m[4] or "").lower()
        for name in [text] if m[1].lower() == "aria-label" else text.split():
            parts = [p for p in SPLIT.split(name) if p]
            if any(p in HINTS for p in parts) and all(p in HINTS or p in PLAIN or p[0].isdigit() for p in parts):
                return True
    return False


def stretches(sizes: list[int], width: int) -> list[tuple[int, int, int]]:
    """(begin, end, largest sum) of each run of windows of `width` lines that hold any text; a run ends `width` - 1 empty lines after its last one."""
    found, total, begin, most = [], 0, -1, 0
    for i, n in enumerate([*sizes, *[0] * width]):
        total += n - (sizes[i - width] if i >= width else 0)  # lines i - width + 1 to i
        if total and begin < 0:
            begin, most = i, total
        elif total:
            most = max(most, total)
        elif begin >= 0:
            found.append((begin, min(i, len(sizes)), most))
            begin = -1
    return found


def main_text(page: str | None, width: int = WIDTH, surge: int = SURGE, prior: int = PRIOR) -> str:
    """The text between surge and dive points, blocks joined by an empty line."""
    if not page:
        return ""
    lines: Lines = []
    for line in lines_of(page):
        lines += [line] if line[0] is not None else [line] * width  # a gap is as long as a window
    size = lambda line: len(line[0] or "") * (prior if line[1] else 1)
    kept: list[tuple[int, int, int]] = []
    if any(inside for _, inside in lines):
        kept = [s for s in stretches([size(x) if x[1] else 0 for x in lines], width) if s[2] >= surge]
        if kept:
            lines = [x if x[1] else (None, False) for x in lines]
    if not kept:
        every = stretches([size(x) for x in lines], width)
        kept = [s for s in every if s[2] >= surge]
        if not kept and any(inside for _, inside in lines):
            lines, kept = [x if x[1] else (None, False) for x in lines], [(0, len(lines), 0)]
        elif not kept and every:
            kept = [max(every, key=lambda s: sum(map(size, lines[s[0] : s[1]])))]
    return "\n\n".join(line for a, b, _ in kept for line, _ in lines[a:b] if line is not None)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in text_batches(whole, 2):
                texts = [main_text(x) for x in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col)).mapInArrow(work, "page_id long, url string, text string, n_chars long")
