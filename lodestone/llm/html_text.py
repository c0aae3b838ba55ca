"""HTML extraction by line-block distribution.

A page is read tag by tag, in one pass, and cut into lines at block elements. A line weighs its characters outside
links; a line that is links alone weighs one within an article or main element and nothing outside. Lines of elements that are no text by their tag, role or class (scripts, styles,
menus, headers, footers, sidebars, notices, adverts, forms, reader comments, hidden ones) stay as lines without text
or weight; so do all lines outside the article and main elements of a page that has some. The weights of `WINDOW`
lines after each other are summed; where the sum surges from zero a run of main text begins, where it dives to zero it
ends, and the lines between are kept: outside articles one link between paragraphs, but no list of links. Every run
counts, however long or short, and however long the page's others are. Within an article or main element a heading is never
left out by its class, nor is an element by a class or id that has other words beside those for what isn't main text.

Defined results: null and empty pages, and pages without text, give the empty string; null urls and ids stay null;
repeated rows give a row each; an empty table gives no rows; other columns are ignored. Broken markup is read as far
as a browser would: an open quote, comment, script or style lasts to the end of the page, unclosed elements end with
their parent, and unknown character references stay as they are. Time and memory are in proportion to the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import textops as tx

WINDOW = 3
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav noscript ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = RAW | frozenset("nav footer aside form menu dialog button select option template svg math noscript object canvas audio video map head".split())
MAIN = frozenset(("article", "main"))
CONTAINERS = frozenset("div section ul ol dl table ins span header figure details center fieldset".split())
#: A start tag of one of these ends an open paragraph.
ENDS_P = BLOCK - frozenset("body button caption col colgroup dd dt head html legend optgroup option tbody td tfoot th thead title tr".split())
HOLDS_P = frozenset("table td th button caption".split())
#: A start tag ends an open element of its own kind, up to these.
ENDS_OWN = {"li": frozenset(("ul", "ol", "menu", "dir")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")), "option": frozenset(("select",))}
PAIRED = {"dt": "dd", "dd": "dt", "td": "th", "th": "td"}
#: Words for what isn't main text: as a class, or as a part of a container's class or id.
BOILER = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle banner promo sponsor sponsored sidebar widget menu nav navbar navigation breadcrumb breadcrumbs header masthead footer "
    "comment comments commentlist disqus replies cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login share sharing social pagination pager copyright toolbar".split()
)
#: The same, for a container outside the main text alone, and only as the whole class.
WEAK = frozenset("related recommended legal toc respond responses search subscription alert skip".split())
#: With one of these a class says what surrounds or adjoins, not what it is.
NEUTRAL = frozenset("has with no without open wrap wrapper layout content page body main post entry article text".split())
WHERE = frozenset("site global top bottom left right sticky box bar area slot block list section container item items links buttons inner outer".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words that name the title's place, within an article or main element.
TITLED = frozenset("header masthead banner".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*))?)?")
_GAP = re.compile(r"[\s/]*")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_NO_SHOW = re.compile(r"display\s*:\s*none", re.I)


def _parts(token: str) -> list[str]:
    return [p.lower() for p in _PART.findall(token)]


def _boiler(name: str, attributes: dict[str, str], in_main: bool) -> bool:
    """Whether an element is no main text, by its tag, role, class or id."""
    if name in SKIPPED or name == "header" and not in_main:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _NO_SHOW.search(attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in ROLES:
        return True
    if in_main and name in HEADINGS:
        return False
    container, words = name in CONTAINERS, BOILER - TITLED if in_main else BOILER
    for token in attributes.get("class", "").split():
        if token.lower() in words or container and not in_main and token.lower() in WEAK:
            return True
        parts = _parts(token) if container else []
        if in_main and _placed(parts, words) or not in_main and not NEUTRAL.intersection(parts) and words.intersection(parts):
            return True
    return container and name != "section" and _placed(_parts(attributes.get("id", "")), words)


def _placed(parts: list[str], words: frozenset) -> bool:
    """Whether a name says what isn't main text, and beside that only where it stands."""
    return not words.isdisjoint(parts) and all(p in words or p in WHERE for p in parts)


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("", text, {}), (name, "start", attributes) and (name, "end", {}), in one pass over the page."""
    at, text, n = 0, 0, len(page)
    while (at := page.find("<", at)) >= 0:
        m = _NAME.match(page, at)
        if m is None:
            if page.startswith(("<!", "<?", "</"), at):
                yield "", page[text:at], {}
                end = "-->" if page.startswith("<!--", at) else "]]>" if page.startswith("<![CDATA[", at) else ">"
                stop = page.find(end, at + 2)
                at = text = n if stop < 0 else stop + len(end)
            else:
                at += 1
            continue
        yield "", page[text:at], {}
        name, close, at, attributes = m[1].lower(), page[at + 1] == "/", m.end(), {}
        while True:
            at = _GAP.match(page, at).end()
            if at >= n or page[at] == ">":
                break
            a = _ATTR.match(page, at)
            at = a.end()
            if at < n and page[at] in "\"'" and a[0].rstrip().endswith("="):
                at = n  # a quote that never ends
                break
            attributes.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
        if at >= n:
            return  # a tag that never ends
        at = text = at + 1
        yield name, "end" if close else "start", attributes
        if not close and name in RAW:
            m = _RAW_END[name].search(page, at)
            at = text = n if m is None else m.start()
    yield "", page[text:], {}


def lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, weight, inside an article or main element) of each line; boilerplate stays as a weightless line."""
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool, bool, bool, int]] = []  # name, skipped, main, link, place of the paragraph to end
    skipped = main = link = False
    paragraph = -1
    text: list[str] = []
    linked, mute = 0, False

    def flush() -> None:
        nonlocal text, linked, mute
        line = " ".join("".join(text).split())
        if mute and not line:
            out.append(("", 0, main))
        elif line:
            out.append((line, max(len(line) - linked, 1 if main else 0), main))
        text, linked, mute = [], 0, False

    held: dict[str, int] = {}  # open elements by name, so that a stray end tag costs nothing

    def close(k: int) -> None:
        nonlocal skipped, main, link, paragraph
        for x in stack[k:]:
            held[x[0]] -= 1
        del stack[k:]
        skipped, main, link, paragraph = stack[-1][1:] if stack else (False, False, False, -1)

    def end(names: tuple[str, ...], up_to: frozenset) -> None:
        """Close the innermost open element of these names, if none of `up_to` lies in it."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                return close(k)
            if stack[k][0] in up_to:
                return None
        return None

    for name, piece, attributes in tokens(page):
        if not name:
            if piece:
                if skipped:
                    mute = mute or bool(piece.strip())
                else:
                    piece = html.unescape(piece)
                    linked += len(" ".join(piece.split())) if link else 0
                    text.append(piece)
            continue
        if name in BLOCK:
            flush()
        elif name == "br" and not skipped:
            text.append(" ")
        if piece == "end":
            if held.get(name):
                end((name,), frozenset())
        elif name not in VOID:
            if name in ENDS_P and paragraph >= 0:
                close(paragraph)
            if name in ENDS_OWN and held.get(name, 0) + held.get(PAIRED.get(name, ""), 0):
                end((name, PAIRED.get(name, name)), ENDS_OWN[name])
            skipped = skipped or _boiler(name, attributes, main)
            main, link = main or name in MAIN and not skipped, link or name == "a"
            paragraph = len(stack) if name == "p" else -1 if name in HOLDS_P else paragraph
            stack.append((name, skipped, main, link, paragraph))
            held[name] = held.get(name, 0) + 1
    flush()
    return out


def runs(weights: list[int], window: int = WINDOW) -> Iterator[tuple[int, int]]:
    """(first, last) of each stretch from a surge of the windows' sums to the dive after it, cut to lines with weight."""
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    i, n = 0, len(weights)
    while i < n:
        if not sums[i] or not weights[i]:
            i += 1
            continue
        j = i
        while j < n and sums[j]:
            j += 1
        yield i, max(k for k in range(i, j) if weights[k])
        i = j


def main_text(page: str | None, window: int = WINDOW) -> str:
    """The main text of a page: its lines joined by line feeds."""
    if not page:
        return ""
    found = lines(page)
    if any(m for _, _, m in found):
        found = [(t, w, m) if m else ("", 0, m) for t, w, m in found]
    return "\n".join(found[k][0] for i, j in runs([w for _, w, _ in found], window) for k in range(i, j + 1) if found[k][0])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(None if x is None else x.decode("utf-8", "replace")) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(tx.read_table(spark, sf_dir, "pages"))
