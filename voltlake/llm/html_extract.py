"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one a block element, in page order. Lines of menus, forms, adverts and the like have no
length. The length of a line block is summed over a sliding window of WINDOW lines; a block ends where the sum dives to
nothing, and is main text where the sum surges over a threshold anywhere in it, from its first line on. Without a surge the densest block is
the main text. A loose name, as search or alert, makes no aside of an element that holds three quarters of the text. Where article and main elements hold the larger part of the text, all of theirs is main text and lines outside
have no length; otherwise they count as any other.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from voltlake.llm.common import small_batches

WINDOW = 3
SURGE = 86  # characters in a window

_HOLDERS = {"html", "head", "body", "nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "ul", "ol", "dl", "table", "figure", "dialog", "menu", "fieldset", "details"}
_LINES = _HOLDERS | {"p", "br", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "caption", "figcaption", "blockquote", "pre", "address", "center", "summary", "legend"}
_REST = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
# Raw text runs to its end tag or the end of the page. Other dropped elements need their end tag, else only the tag goes; an option ends at the next one, or with its list.
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|title|noscript|textarea|iframe)\b{_REST}>.*?(?:</\1\s*>|\Z)"
    rf"|<(template|svg|select|button)\b{_REST}(?<!/)>.*?</\2\s*>"
    rf"|<option\b{_REST}>.*?(?:</option\s*>|(?=</?(?:option|optgroup|select|datalist|{'|'.join(sorted(_LINES))})\b)|\Z)"
    rf"|<(/?)([a-z][a-z0-9:-]*)({_REST})>|<[!?][^>]*>", re.I | re.S)
_ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "fieldset"}
_MAIN = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_WORD = (
    r"(?:ads?|adverts?|advertisement|advertising|banner|cookies?|consent|gdpr|notices?|alert|sidebar|menu|nav|navbar|navigation|topbar|masthead|footer|header|comments?|"
    r"replies|promo|promoted|promotion|sponsor|sponsored|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|popup|modal|overlay|breadcrumbs?|widget|disclaimer|"
    r"pagination|pager)")
# A whole class or id token: a word, or words with these before and after. has-sidebar, comments-open and page-header are none.
_NAMED = re.compile(
    rf"(?:(?:(?:site|global|top|bottom|left|right|primary|secondary|main|mobile|desktop|sticky)[-_]+)*{_WORD}|(?!(?:has|no|with|without|hide|show|allow|open)[-_])[a-z0-9]+(?:[-_]+[a-z0-9]+)*[-_]+comments)"
    rf"(?:[-_]+(?:{_WORD}|bar|box|list|links?|area|section|block|wrap|wrapper|container|inner|items?|form|buttons?|icons?|unit|slot|posts?|articles?|stories|\d+))*", re.I)
_LOOSE = {"alert", "search", "social", "share", "sharing", "related", "recommended", "widget", "header"}  # also said of what holds the text
_FIRM = re.compile(_WORD, re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}


def _kind(tag: str, attributes: str) -> str:
    """'aside' for what is not main text, 'named' if only a loose class or id says so, 'main' for a holder of main text, '' otherwise."""
    if attributes.strip(" /\t\r\n"):
        at = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        hidden = ("hidden" in at or at.get("aria-hidden", "").lower() == "true" or "display:none" in at.get("style", "").replace(" ", "").lower())
        if hidden or at.get("role", "").lower() in _ROLES:
            return "" if tag in ("body", "html") and not hidden else "aside"
        if tag in _MAIN or tag not in _ASIDE and (at.get("role", "").lower() == "main" or at.get("itemprop") == "articleBody"):
            return "main"
        found = [t.lower() for k in ("class", "id") for t in at.get(k, "").split() if _NAMED.fullmatch(t)] if tag not in ("body", "html") else []
        if found and tag in _HEADINGS and not {*at.get("class", "").lower().split(), at.get("id", "").lower()} - {"", "header", "banner", "masthead"}:
            return ""
        if found:
            return "aside" if tag in _ASIDE or any(w not in _LOOSE and _FIRM.fullmatch(w) for t in found for w in re.split("[-_]+", t)) else "named"
    return "aside" if tag in _ASIDE else "main" if tag in _MAIN else ""


def lines(page: str) -> list[tuple[str, bool, bool, tuple]]:
    """(text, is inside an aside, is inside a main element, numbers of the elements around it that are asides by their name) of every line with text."""
    out: list[tuple[str, bool, bool, tuple]] = []
    stack: list[tuple[str, str]] = []
    named: list[int] = []
    asides = mains = count = 0
    held: list[str] = []
    skip: str | None = None  # a heading or paragraph that is an aside by its name
    at = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, asides > 0, mains > 0, (*named, count) if skip else tuple(named)))

    for m in _MARKUP.finditer(page):
        held.append(page[at: m.start()])
        at = m.end()
        if m[4] is None:
            continue
        tag = m[4].lower()
        if tag not in _LINES:
            continue
        flush()
        if m[3]:
            if tag == skip:
                skip = None
            if tag in _HOLDERS and any(t == tag for t, _ in stack):
                while True:
                    t, kind = stack.pop()
                    asides -= kind == "aside"
                    mains -= kind == "main"
                    if kind == "named":
                        named.pop()
                    if t == tag:
                        break
        elif tag in _HOLDERS:
            if not m[5].endswith("/"):
                if tag == "body":  # an unclosed head ends here
                    stack, asides, mains = [], 0, 0
                    named.clear()
                kind = _kind(tag, m[5])
                if tag == "header" and mains:
                    kind = _kind("div", m[5])  # the article's own heading
                stack.append((tag, kind))
                asides += kind == "aside"
                mains += kind == "main"
                if kind == "named":
                    count += 1
                    named.append(count)
        else:
            skip = tag if tag not in ("br", "hr") and m[5].strip() and _kind(tag, m[5]) in ("aside", "named") else skip if tag == "br" else None
            count += skip == tag
    held.append(page[at:])
    flush()
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of one page; a null page has none."""
    read = lines(page or "")
    plain = sum(len(text) for text, aside, _, _ in read if not aside)
    held: dict[int, int] = {}
    for text, aside, _, names in read:
        for k in names if not aside else ():
            held[k] = held.get(k, 0) + len(text)
    # an element that holds most of the text is no aside by a loose name
    found = [(text, aside or any(4 * held[k] < 3 * plain for k in names), main) for text, aside, main, names in read]
    plain = sum(len(text) for text, aside, _ in found if not aside)
    inside = 2 * sum(len(text) for text, aside, main in found if main and not aside) > plain
    size = [0 if aside or (inside and not main) else len(text) for text, aside, main in found]
    total = [sum(size[i: i + window]) for i in range(len(size))]
    kept: list[str] = []
    densest, most = [], 0
    i = 0
    while i < len(size):
        if not size[i]:
            i += 1
            continue
        start = i  # a block, from its first line to where text dives
        while i < len(size) and total[i]:
            i += 1
        texts, peak = [found[k][0] for k in range(start, i) if size[k]], max(total[start:i])
        if inside or peak >= surge:
            kept += texts
        elif peak > most:
            densest, most = texts, peak
    return " ".join(kept or densest)


def extract(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """page_id, url, text and n_chars of every row; a null html and one without text have the empty text.

    Null ids and urls stay, repeated rows each get their text, a very long page is read whole, an empty table gives none. Other columns are ignored.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rows in batches:
            texts = [main_text(h, window, surge) for h in rows.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
