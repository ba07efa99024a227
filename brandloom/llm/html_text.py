"""Main text of web pages, by line-block distribution.

Markup is read once, tag by tag, and stripped: each block's text becomes a line, with white space made single and references
decoded. What the elements hold that are never main text (menus, page headers, footers, sidebars, notices, adverts, forms,
reader comments, scripts, styles) becomes lines without text. Such elements are known by their tags, or by a class, id or
role that is one of the words of HINTS as a whole, or is made of them and of words of place (NEUTRAL) only.

A line weighs the characters that it has outside links. A paragraph or heading weighs a full surge more, however short and
linked or not, as no menu is made of them; an unlinked list item weighs half of one more once text has begun, so that a list
goes on with a text but begins none. Where a page marks its main part (article or main), the mark counts in their stead: a line in it weighs
a full surge more, whatever its tag, and a line outside of it weighs an eighth of its characters (OUTSIDE). Weights are summed
in sliding windows of BLOCK lines, and the windows decide on every page. The surge that begins text is half of the page's
densest window of characters, SURGE at most: text begins at a line that has a quarter of it itself and whose window reaches
it, and ends where the window's sum dives under half of it. What lies between is kept, whole and in order, linked lines and
short ones included, but for unmarked headings at the very end, which head nothing, and unmarked stretches that have no more
characters than a surge.

Classes and roles are read of all elements, ids only of those outside a marked main part and of no heading, since sites make
ids of a heading's words.

Edge cases: a null or empty page gives an empty text. Unclosed and stray tags, unclosed comments and scripts, and tags
cut off at the end are read as browsers do, more or less; nothing raises. Very long pages take time in proportion. Repeated
rows and null ids are returned as they are; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import html
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

BLOCK = 3
SURGE = 80
#: A line outside a marked main part weighs its characters over so many.
OUTSIDE = 8

_token = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|title|textarea|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)/?>"
    r"|</?[a-zA-Z!?/][^<>]*>?",
    re.S | re.I,
)
_attribute = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

_words = lambda s: frozenset(s.split())
BLOCKS = _words("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul")
SKIPPED = _words("aside button dialog footer form head menu nav object select")
ENDS_P = BLOCKS
HEADINGS = _words("h1 h2 h3 h4 h5 h6")
FULL = HEADINGS | _words("p blockquote pre figcaption")
#: Words of a class, id or role that name what isn't main text.
HINTS = _words(
    "ad ads advert adverts advertisement adsense advertising alert banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies dialog disqus "
    "footer login menu modal nav navbar navigation newsletter notice pagination popup promo promotion related search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget"
)
#: Words that say where such a thing stands, or of what shape it is.
NEUTRAL = _words(
    "area bar block body bottom box button buttons container count desktop fixed form global group header holder icon icons inner item items layer left link links list main mobile outer overlay page panel primary "
    "reply right secondary section site slot sticky thread title top unit window wrap wrapper"
)


def _is_hint(attributes: str, ids: bool = True) -> bool:
    for named, a, b, c in _attribute.findall(attributes):
        if not ids and named.lower() == "id":
            continue
        for name in (a or b or c).lower().split():
            parts = [x for x in re.split(r"[_-]+", name) if x and not x.isdigit()]
            if not HINTS.isdisjoint(parts) and all(x in HINTS or x in NEUTRAL for x in parts):
                return True
    return False


class Lines:
    """The lines of a page: text (None for what is never main text), characters outside links, tag, and whether it lies in the main part."""

    def __init__(self, page: str):
        self.lines: list[tuple[str | None, int, str, bool]] = []
        self.block = ""
        self.parts: list[str] = []
        self.outside_links = 0
        self.links = self.main = self.depth = 0
        self.skip = ""
        at = 0
        for match in _token.finditer(page):
            if match.start() > at:
                self._text(page[at : match.start()])
            at = match.end()
            if match[3]:
                self._tag(match[3].lower(), bool(match[2]), match[4] or "")
        self._text(page[at:])
        self._end_line()

    def _text(self, raw: str) -> None:
        if self.skip:
            if raw.strip():
                self.lines.append((None, 0, "", False))
            return
        self.parts.append(raw)
        if not self.links:
            self.outside_links += len(raw.strip())

    def _end_line(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            self.lines.append((text, self.outside_links, self.block, self.main > 0))
        self.parts, self.outside_links, self.block = [], 0, ""

    def _tag(self, name: str, closes: bool, attributes: str) -> None:
        if self.skip:
            if name in ("article", "main") and not closes and not _is_hint(attributes) and self.skip not in ("article", "main", "div", "section"):
                self.skip = ""  # a menu or form that was never closed
            elif name == self.skip:
                self.depth += -1 if closes else 1
                if self.depth <= 0 or (self.skip in ("p", "li") and not closes):
                    self.skip = ""
                    if not closes:
                        self._tag(name, closes, attributes)
                return
            elif self.skip == "head" and name == "body" or self.skip == "p" and not closes and name in ENDS_P:
                self.skip = ""
            else:
                return
        if name == "br":
            self.parts.append(" ")
            return
        if name == "a":
            self.links = 0 if closes else 1
            return
        if name not in BLOCKS and name not in SKIPPED:
            if not closes and name == "span" and _is_hint(attributes, ids=not self.main):
                self.skip, self.depth = name, 1
            return
        self._end_line()
        self.links = 0
        self.block = "" if closes else name
        if closes:
            if name in ("article", "main"):
                self.main = max(0, self.main - 1)
        elif name in SKIPPED or (name == "header" and not self.main) or (name not in ("html", "body", "main") and _is_hint(attributes, ids=not self.main and name not in HEADINGS)):
            self.skip, self.depth = name, 1
        elif name in ("article", "main"):
            self.main += 1


def surge_of(plain: list[int]) -> int:
    """Half of the most characters that a window has, SURGE at most."""
    return max(1, min(SURGE, max((sum(plain[i : i + BLOCK]) for i in range(len(plain))), default=0) // 2))


def between(weights: list[int], surge: int, begins: list[int] | None = None) -> list[tuple[int, int]]:
    """(first, end) of the stretches from a surge of the windows' sums to their dive. begins: the weights that a surge is made of, if others."""
    begins = weights if begins is None else begins
    upto, rising = [0, *accumulate(weights)], [0, *accumulate(begins)]
    n, found, begin = len(weights), [], None
    for i in range(n):
        end = min(i + BLOCK, n)
        if begin is None and rising[end] - rising[i] >= surge and 4 * begins[i] >= surge:
            begin = i
        elif begin is not None and 2 * (upto[end] - upto[i]) < surge:
            found.append((begin, i))
            begin = None
    return found if begin is None else [*found, (begin, n)]


def main_text(page: str) -> str:
    lines = Lines(page).lines
    plain = [n for _, n, _, _ in lines]
    surge = surge_of(plain)
    marked = [bool(main and text) for text, _, _, main in lines]
    if any(m and n for m, n in zip(marked, plain, strict=True)) or not any(plain):
        weights = begins = [n + surge if m else n // OUTSIDE for m, n in zip(marked, plain, strict=True)]
    else:
        marked = [False] * len(lines)
        begins = [n + surge * (tag in FULL) for _, n, tag, _ in lines]
        weights = [w + (surge + 1) // 2 if tag == "li" and n else w for w, (_, n, tag, _) in zip(begins, lines, strict=True)]
    kept = []
    for first, end in between(weights, surge, begins):
        while end > first and not marked[end - 1] and (lines[end - 1][0] is None or lines[end - 1][2] in HEADINGS):
            end -= 1
        if any(marked[first:end]) or sum(plain[first:end]) >= surge:
            kept += [text for text, *_ in lines[first:end] if text]
    return "\n\n".join(kept)


def extract(pages: DataFrame, html_col="html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns keep, text and n_chars (code points) for every row."""

    def run(batches):
        for batch in batches:
            out = [main_text(p) for p in texts(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, html_col).mapInArrow(run, f"{kinds}, text string, n_chars long")
