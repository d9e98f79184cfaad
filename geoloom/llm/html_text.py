"""Main text by line-block distribution.

Markup is stripped into lines, one for each block element, and lines of navigation, page headers, footers, adverts,
forms and reader comments, known by their tags or marks, are taken out. A line's weight is the length of its text
outside links where it reads as text: it ends a sentence, is a heading or a paragraph, or is long for this page;
lines that are mostly links weigh nothing. Weights are summed over sliding windows of `window` lines. Where the sum
surges over a threshold, taken from the lengths of the page's own lines, text begins; where it dives under it and no
line with weight follows, it ends. All lines from the first to the last line with weight in between are kept.

An article or main element that holds the peak of the distribution fixes the points: its first and its last line.
Marks in class, id or role count for elements that hold others; on single paragraphs, headings and list items only
those of adverts and notices do. They do not reach article and main elements within a marked element.

Cases: null and empty html give an empty text; pages cut off within a tag lose that tag; tags without end close with
their parents, or where HTML lets them end; very long pages and lines are read whole; equal peaks: the first; repeated
rows each get a row; an empty table gives an empty result; further columns are not carried.
"""

from __future__ import annotations

import html as entities
import re
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame

from .runtime import table

#: Fixed values of HTML.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hr", "html", "legend", "li", "main", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
ASIDE = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "title"}
#: Words that mark an element as no part of the article, where they make up a whole token of its class, id or role.
MARKS = (
    r"ads?|advert\w*|adsbygoogle|banner|breadcrumbs?|byline-share|comments?|commentlist|consent|contentinfo|cookies?|disqus|footer|gdpr|header|masthead|menu|menubar|modal|nav|navbar|navigation|newsletter|notices?|"
    r"pagination|popup|promo\w*|recommend\w*|related|replies|reply|search|share|sharing|sidebar|side|signup|skip|social|sponsor\w*|subscribe|subscription|tags?|toolbar|widget|complementary|alert|overlay|outbrain|taboola"
)
#: Words that may stand beside these in a token, as in site-footer or related-posts.
BESIDE = r"site|main|top|bottom|left|right|primary|secondary|global|bar|box|list|links?|items?|posts?|articles?|buttons?|icons?|area|block|container|wrapper|slot|unit"
_MARK = re.compile(rf"(?:(?:{BESIDE})[_-]+)*(?:{MARKS})(?:[_-]+(?:{MARKS}|{BESIDE}|[0-9]+))*", re.IGNORECASE)
_PARTS = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.IGNORECASE)
_CONTAINERS = {"article", "main"}
MARKED, GONE = 1, 2
_KEEPERS = {"html", "body", *_CONTAINERS}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements of single lines of text, in which marks of regions are mere names; and the marks that count there.
_SINGLE = {"p", "li", "dt", "dd", "blockquote", "pre", "td", "th", "figcaption", "caption", "b", "i", "em", "strong", "a", "code", *HEADINGS}
_SINGLE_MARK = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|notices?|comments?|newsletter|breadcrumbs?)(?:[_-]\w+)*", re.IGNORECASE)
_SENTENCE_END = re.compile(r"[.!?…:;。！？][\"'”’»)\]*#%&$]*\Z")
_RIGHTS = re.compile(r"\s*(?:©|\(c\)|copyright\b)|all rights reserved", re.IGNORECASE)


def _is_aside(name: str, rest: str) -> int:
    """0: no; MARKED: by a word in its class, id or role; GONE: by its name, or since it is not shown."""
    if name in ASIDE:
        return GONE
    if not rest:
        return 0
    mark, marked = (_SINGLE_MARK, 0) if name in _SINGLE else (_MARK, 0)
    for key, *values in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true") or (key == "style" and _NOT_SHOWN.search(value)):
            return GONE if name not in _KEEPERS else 0
        if (key == "class" or (key in ("id", "role") and name not in _SINGLE)) and name not in _KEEPERS and any(map(mark.fullmatch, value.split())):
            marked = MARKED
    return marked


class Line(NamedTuple):
    text: str
    linked: int  # length of its text in links
    aside: bool
    container: str  # article, main or nothing
    tag: str  # of the innermost block


def _ends_open(name: str, stack: list[tuple[str, int]]) -> int:
    """Length to which a start tag cuts the stack: a block ends an open paragraph, an item the item before it."""
    for k in range(len(stack) - 1, -1, -1):
        above = stack[k][0]
        if above == "p" or (above == name and name in ("li", "dt", "dd", "option", "tr", "td", "th")):
            return k
        if above in BLOCKS and not (name in ("dt", "dd") and above in ("dt", "dd")):
            return len(stack)
    return len(stack)


def lines_of(page: str) -> list[Line]:
    """The block lines of a page, in order."""
    lines: list[Line] = []
    text: list[tuple[str, int]] = []
    in_link = 0
    stack: list[tuple[str, int]] = []

    def close_line():
        if text:
            plain = lambda pieces: " ".join(entities.unescape("".join(pieces)).split())
            if line := plain(t for t, _ in text):
                linked = len(plain(t if link else " " for t, link in text)) if any(link for _, link in text) else 0
                names = [name for name, _ in stack]
                container = "article" if "article" in names else "main" if "main" in names else ""
                aside = bool(stack and stack[-1][1])
                tag = next((name for name in reversed(names) if name in BLOCKS), "")
                if aside and container == "article" and tag in HEADINGS and "header" in names and stack[names.index("article")][1] == 0 and not any(x in ASIDE - {"header"} for x in names):
                    aside = False  # an article's own title
                lines.append(Line(line, linked, aside, container, tag))
            text.clear()

    at = 0
    for m in _PARTS.finditer(page):
        if m.start() > at:
            text.append((page[at : m.start()], in_link))
        at = m.end()
        name = (m["name"] or "").lower()
        if m["raw"] or not name:
            continue
        if name in BLOCKS or name in ASIDE:
            close_line()
        if m["end"]:
            if name == "a":
                in_link = max(0, in_link - 1)
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None and not any(s[0] in ("article", "main", "body", "td") for s in stack[depth + 1 :]):
                if any(s[0] in BLOCKS for s in stack[depth:]) or bool(stack[-1][1]) != bool(depth and stack[depth - 1][1]):
                    close_line()
                del stack[depth:]
        elif name == "a":
            in_link = 1
        elif name not in VOID and not m["rest"].endswith("/"):
            if name in BLOCKS:
                del stack[_ends_open(name, stack) :]
            above = stack[-1][1] if stack else 0
            aside = 0 if above == MARKED and name in _CONTAINERS else max(above, _is_aside(name, m["rest"]))
            if bool(aside) != bool(above):
                close_line()
            stack.append((name, aside))
    if at < len(page):
        text.append((page[at:], in_link))
    close_line()
    return lines


def weights_of(lines: list[Line], share: float) -> tuple[list[int], float]:
    """Weight of each line, and the threshold of the windows: both from the length of the line that holds the page's
    middle character (its typical line of text), of which a line without other signs of text must have a share."""
    sizes = sorted(len(x.text) - x.linked for x in lines)
    half, seen, typical = sum(sizes) / 2, 0, 0
    for typical in sizes:
        seen += typical
        if seen >= half:
            break
    least = max(1.0, share * typical)
    weights = []
    for x in lines:
        size = len(x.text) - x.linked
        reads = x.tag in HEADINGS or x.tag in ("p", "blockquote", "pre") or size >= least or _SENTENCE_END.search(x.text)
        weights.append(size if reads and 2 * x.linked <= len(x.text) and not _RIGHTS.match(x.text) else 0)
    return weights, least


def window_sums(weights: list[int], window: int) -> list[int]:
    """Of the window around each line."""
    ahead = [0, *accumulate(weights)]
    return [ahead[min(len(weights), i + window // 2 + 1)] - ahead[max(0, i - window // 2)] for i in range(len(weights))]


def main_text(page: str | None, window: int = 3, share: float = 0.25) -> str:
    lines = [x for x in lines_of(page or "") if not x.aside]
    if not lines:
        return ""
    weights, threshold = weights_of(lines, share)
    sums = window_sums(weights, window)
    peak = lines[max(range(len(lines)), key=lambda i: (sums[i] if weights[i] else -1, -i))]
    for container in ("article", "main"):
        inside = [x.text for x in lines if x.container == container or (container == "main" and x.container)]
        if inside and (peak.container == container or (container == "main" and peak.container)):
            return "\n".join(inside)
    kept, begin, surged = [], None, False
    for i in range(len(lines) + 1):
        within = i < len(lines) and (weights[i] > 0 or sums[i] >= threshold)
        if within:
            begin, surged = (i, False) if begin is None else (begin, surged)
            surged = surged or sums[i] >= threshold
        elif begin is not None:
            heavy = [k for k in range(begin, i) if weights[k]]
            if surged and heavy:
                kept += [x.text for x in lines[heavy[0] : heavy[-1] + 1]]
            begin = None
    return "\n".join(kept)


def _extract(window, share):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            pages = batch.column(2)
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                out = [main_text(p, window, share) for p in pages.slice(first, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, window: int = 3, share: float = 0.25) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract(window, share), "page_id long, url string, text string, n_chars long")


def op9(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
