"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element.  Lines within menus, headers,
footers, sidebars, notices, adverts, forms, scripts, comments of readers and the like, and
lines that are links alone, count no text and stand for gaps.  Over the lines' text
lengths slides a window; where its sum surges from nothing a stretch of text begins,
where it falls back to nothing it ends.  Stretches in an article or main element are the
text, if these hold a fair share of the page's; otherwise the stretches from the first to
the last that hold a fair share of the longest's text are.  A class, id or role does not
make an element junk that holds most of the page's text, or a fifth of it and an article
or main element.
Headings count as text though they be links.  Within an article only a class, id or role that
consists of names of junk makes an element junk ("comment-list", not "comment-on-policy"),
lines that are links are text, and so are the headings of the article's own header.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm.common import table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
#: Elements whose content is not markup, up to their own end tag.
_RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
_DROP = frozenset("script style noscript template head title nav header footer aside form menu dialog button select option textarea input svg math canvas iframe object embed audio video map noembed noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th pre blockquote figure figcaption address hr br center details summary fieldset legend hgroup search".split()
) | _DROP
_MAIN = frozenset(("article", "main"))
#: Parts of a class, id or role that name what is not the text.
_JUNK = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo "
    "notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription signup login share sharing social related recommended comment comments respond disqus reply replies form search "
    "searchform pagination pager toolbar widget skip copyright".split()
)
#: Words that go with those above without changing what a class, id or role names: "comment-list", but not "comment-on-policy".
_WITH = frozenset("area articles bar block body box btn button buttons container content feed footer group header icons inner item items large left link links list main outer page panel post posts right section site slot small thread top unit wrap wrapper".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _junk(attributes: str, strict: bool) -> bool:
    """Whether a class, id or role has a part that names junk; a ``strict`` one consists of such parts and words that go with them."""
    if not attributes.strip():
        return False
    for m in _NAMES.finditer(attributes):
        for token in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[1] or m[2] or m[3] or "").lower().split():
            words = set(re.split(r"[^a-z0-9]+", token)) - {""}
            if words & _JUNK and (not strict or words <= _JUNK | _WITH):
                return True
    return False


class _Named:
    """An element with a junk name, within another one or none; what it holds decides if it is dropped."""

    def __init__(self, outer: _Named | None):
        self.outer, self.plain, self.main, self.dropped = outer, 0, False, False


def _settle(named: list[_Named], total: int) -> None:
    """Sums up what the elements hold, inner ones (which come later) first, then drops them from the outermost inwards."""
    for e in reversed(named):
        if e.outer is not None:
            e.outer.plain += e.plain
            e.outer.main |= e.main
    for e in named:
        holds = 5 * e.plain >= total if e.main else 2 * e.plain > total
        e.dropped = (e.outer is not None and e.outer.dropped) or not holds


class _Open:
    """The open elements, with where each name and each block stands among them, so that no tag needs a search."""

    def __init__(self) -> None:
        self.held: list[tuple] = []  # name, dropped, in a link, in the main part, innermost named element, in a heading
        self.names: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def state(self) -> tuple:
        return self.held[-1][1:] if self.held else (0, False, False, None, False)

    def push(self, name: str, *state) -> None:
        self.names.setdefault(name, []).append(len(self.held))
        if name in _BLOCK:
            self.blocks.append(len(self.held))
        self.held.append((name, *state))

    def cut(self, depth: int) -> None:
        """Closes the elements from ``depth`` on."""
        while len(self.held) > depth:
            name = self.held.pop()[0]
            self.names[name].pop()
            if name in _BLOCK:
                self.blocks.pop()

    def depth(self, name: str) -> int | None:
        at = self.names.get(name)
        return at[-1] if at else None

    def last_block(self) -> int:
        return self.blocks[-1] if self.blocks else -1


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters outside links, within article or main) per block, in page order.

    What is not the article's text counts as one line without characters.  Of a header within
    an article the headings are text.  Each tag takes constant time on average.
    """
    blocks: list[tuple[list[tuple[str, int, _Named | None]], bool, _Named | None, _Named | None]] = []  # parts, in the main part; of a gap: the named element that ends, the one around
    stack = _Open()
    parts: list[tuple[str, int, _Named | None]] = []
    junk: list[_Named] = []
    at, end = 0, len(page)
    all_plain = 0
    state = stack.state

    def close() -> None:
        nonlocal parts
        if parts:
            blocks.append((parts, state()[2], None, None))
            parts = []

    def say(text: str) -> None:
        nonlocal all_plain
        dropped, link, _, named, heading = state()
        if not dropped and text:
            plain = 0 if link and not heading else len(text.strip())
            parts.append((text, plain, named))
            all_plain += plain
            if named is not None:
                named.plain += plain

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:  # an end tag closes up to its element, if that is open
            depth = stack.depth(name)
            if name in _BLOCK or depth is not None and stack.last_block() >= depth:
                close()
            if depth is not None and (name in _BLOCK or stack.last_block() <= depth):
                was, named = state()[0], state()[3]
                first = stack.held[depth][4]  # the named element at the one that ends
                stack.cut(depth)
                if was and not state()[0]:
                    blocks.append(([], state()[2], None, state()[3]))
                elif named is not state()[3] and first is not state()[3] and name in _BLOCK:
                    blocks.append(([], state()[2], first, state()[3]))
                elif named is not state()[3] and name in _BLOCK:
                    while named.outer is not state()[3]:
                        named = named.outer
                    blocks.append(([], state()[2], named, state()[3]))
            continue
        if name in _BLOCK and name not in _RAW:
            close()
        dropped, link, main, named, heading = state()
        if name in _RAW:
            stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            if not dropped and name not in _DROP:
                say(page[at : stop.start() if stop else end])
            at = stop.end() if stop else end
            continue
        if name in _VOID or m[3].endswith("/") and name not in _BLOCK:
            continue
        if name == "p" or name in ("li", "td", "th", "tr", "dt", "dd", "option"):  # their end tags may be left out
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
            block = stack.last_block()
            if block >= 0 and stack.held[block][0] in same:
                stack.cut(block)
            dropped, link, main, named, heading = state()
        inside = main or name in _MAIN
        hidden = name in _DROP or (name not in ("html", "body") and name not in _MAIN and _HIDDEN.search(m[3]) is not None)
        if name in _MAIN and not dropped and named is not None:
            named.main = True
        if not dropped and not hidden and name not in ("html", "body") and name not in _MAIN and _junk(m[3], main):
            named = _Named(named)
            junk.append(named)
        if dropped == 2 and name in _HEADINGS:  # the heading of the article's own header
            dropped = 0
        elif hidden and not dropped:
            dropped = 2 if name == "header" and main else 1
        stack.push(name, dropped, link or name == "a", inside, named, heading or name in _HEADINGS)
    _settle(junk, all_plain)
    close()
    lines: list[tuple[str, int, bool]] = []
    for held, main, ended, around in blocks:
        if not held:  # an element that is not text ends: a gap, unless a named one is kept or all around it is dropped
            if (ended is None or ended.dropped) and (around is None or not around.dropped):
                lines.append(("", 0, main))
            continue
        kept = [(t, n) for t, n, of in held if of is None or not of.dropped]
        text = " ".join(html.unescape("".join(t for t, _ in kept)).split())
        if text:
            lines.append((text, sum(n for _, n in kept), main))
    return lines


def main_text(page: str, window: int = 3, share: float = 0.2) -> str:
    """The blocks of a page's text, one per line; empty if there is none."""
    lines = page_lines(page)
    within = sum(n for _, n, inside in lines if inside)
    if within and within >= share * sum(n for _, n, inside in lines if not inside):
        lines = [(t, max(n, 1) if t else 0, True) if inside else ("", 0, False) for t, n, inside in lines]  # of an article, a line that is a link is text
        scoped = True
    else:
        scoped = False
    lengths = np.array([n for _, n, _ in lines], np.int64)
    if not lengths.any():
        return ""
    # Text within the window that starts at a line: it surges when the text comes into reach, and dives behind it.
    total = np.concatenate([[0], np.cumsum(lengths)])
    ahead = total[np.minimum(np.arange(len(lengths)) + window, len(lengths))] - total[:-1]
    behind = total[1:] - total[np.maximum(np.arange(len(lengths)) + 1 - window, 0)]
    # A gap is where neither window has text left; a line of text is always in a stretch.
    live = (ahead > 0) & (behind > 0) | (lengths > 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], live.astype(np.int8), [0]])))
    stretches = list(zip(edges[::2], edges[1::2], strict=True))
    weights = np.array([lengths[a:b].sum() for a, b in stretches])
    if not scoped:
        good = np.flatnonzero(weights >= share * weights.max())
        stretches = stretches[good[0] : good[-1] + 1]
    def held(i: int, a: int, b: int) -> bool:  # without an article, a link alone is text only between two lines of text
        return scoped or lengths[i] > 0 or (a < i < b - 1 and lengths[i - 1] > 0 and lengths[i + 1] > 0)

    return "\n".join(lines[i][0] for a, b in stretches for i in range(a, b) if lines[i][0] and held(i, a, b))


def extract_text(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, text and n_chars for every page; a null or empty page has no text.  There is no shuffle.

    A row is read by itself, so null or repeated ids and repeated rows do no harm; other
    columns are left out, whatever their names.  No rows in, no rows out.
    """
    kept = list(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"])

    rows = pages.select(*kept, page)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(work, f"{kinds}, text string, n_chars bigint")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html_text": op9_html_text}
ORACLE: dict[str, str] = {}
