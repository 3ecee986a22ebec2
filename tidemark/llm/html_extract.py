"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass looks at each block alone: regions that cannot be
article text (menus, forms, scripts, comments and the like) and blocks full of links are bad; blocks that are long with
enough stop words are good; the rest, short blocks and blocks of middling density, stay ambiguous. The second pass gives
those the label of their nearest decided neighbours. An article or main element is evidence only: half the length and
stop words are enough inside one, paragraphs with fewer are ambiguous, and ambiguous blocks stay unless both neighbours are
bad; beside one they stay only between good blocks. No label passes its border. On pages without one, paragraphs outside of bad regions are
taken so.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words by language, tags of HTML, and words that name parts of a page.
STOP_WORDS = {
    "en": "the of and to in a is that it for on was with as be by are this at from or not have an but which you they his her were all can had there been if more when will would who so no",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ou mais comme nous sa été cette on ses être fait tout elle leur même ces entre",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde",
}
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol"
    " optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("head nav footer aside form button select option textarea label fieldset iframe object canvas audio video map menu dialog title".split())
#: Open elements that a start tag ends, each only inside its nearest element of the second set; an end tag of a key counts only inside that too.
ENDS = (
    dict.fromkeys("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split(), (("p",), ("button", "td", "th", "caption")))
    | {"li": (("p", "li"), ("ul", "ol", "menu", "table", "td", "th", "section", "article", "blockquote"))}
    | dict.fromkeys(("dt", "dd"), (("p", "dt", "dd"), ("dl", "table", "td", "th", "section", "article", "blockquote")))
    | {"option": (("option",), ("select", "datalist", "optgroup")), "optgroup": (("option", "optgroup"), ("select",))}
    | dict.fromkeys(("td", "th"), (("td", "th", "caption"), ("table", "tr"))) | {"tr": (("tr", "caption"), ("table",))}
    | dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot", "tr", "caption"), ("table",)))
)
WITHIN = {tag: ENDS[tag][1] for tag in "p li dt dd option td th tr".split()}
PROSE = ("p", "pre", "blockquote", "li", "dd", "td")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_NAMES = (
    r"ads?|adv|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|newsletter|subscri\w*|popup|modal|overlay|sidebar|widget|related|recommend\w*|menu|nav|navbar|navigation|breadcrumbs?|masthead|footer"
    r"|comments?|commentlist|disqus|replies|share|sharing|social|login|signup|search|pagination|pager|copyright|disclaimer|toolbar|teaser"
)

STOPS = [frozenset(x.split()) for x in STOP_WORDS.values()]
RAW = re.compile(r"<(script|style|noscript|template|svg|math)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
#: A tag without further "<", by far the most frequent kind; looking for it never goes beyond the next "<".
PLAIN = re.compile(r"<(/?)(?!(?:script|style|noscript|template|svg|math)\b)([a-zA-Z][^\s/><\"']*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>", re.I)
LETTER, NAME_END, SPECIAL = re.compile(r"[a-zA-Z]"), re.compile(r"[\s/>]"), re.compile(r"[>\"']")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
BAD_NAME = re.compile(rf"(?:^|[\s_-])(?:{BAD_NAMES})(?:$|[\s_-])", re.I)
HIDDEN = re.compile(r"""\bhidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
WORDS = re.compile(r"[^\W\d_]+")

GOOD, BAD, NEAR, SHORT = 1, 0, 2, 3
#: Characters of a short and of a long block; share of link characters; shares of stop words.
SHORT_CHARS, LONG_CHARS, LINK_SHARE, STOP_LOW, STOP_HIGH = 70, 200, 0.33, 0.15, 0.28


class _Next:
    """The next match of a one-character pattern from places that only grow; no character is looked at twice."""

    def __init__(self, page: str, pattern: re.Pattern):
        self.page, self.pattern, self.lo, self.hi = page, pattern, 0, -1

    def __call__(self, at: int) -> int:
        """Its place, or the length of the page."""
        if not self.lo <= at <= self.hi:
            m = self.pattern.search(self.page, at)
            self.lo, self.hi = at, m.start() if m else len(self.page)
        return self.hi


def tokens(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Tags, comments and elements of raw text in order: start, end, name (None where it is no tag), whether it ends an element, attributes.

    A tag ends at the first ``>`` outside of quotes; where there is none, ``<`` is text. Time is linear in the page: what a failed search saw is not searched
    again. ``dead`` has the places of quotes from which no end was found.
    """
    n, at, dead = len(page), 0, set()
    name_end, special = _Next(page, NAME_END), _Next(page, SPECIAL)
    cdata, angle = True, True  # whether "]]>" and ">" were still found

    def tag_end(k: int) -> int:
        seen, p = [], special(k)
        while p < n and p not in dead:
            if page[p] == ">":
                return p
            seen.append(p)
            close = page.find(page[p], p + 1)
            if close < 0:
                break
            m = SPECIAL.search(page, close + 1)
            p = m.start() if m else n
        dead.update(seen)
        return -1

    while (lt := page.find("<", at)) >= 0:
        if plain := PLAIN.match(page, lt):
            at = plain.end()
            yield lt, at, plain[2], plain[1] == "/", plain[3]
            continue
        end, name, attributes = -1, None, ""
        after = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            end = end + 3 if end >= 0 else n
        elif cdata and page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt + 9)
            cdata, end = end >= 0, end + 3 if end >= 0 else -1
        if end < 0 and after in ("!", "?") and after and angle:
            end = page.find(">", lt + 2)
            angle, end = end >= 0, end + 1 if end >= 0 else -1
        elif end < 0 and (raw := RAW.match(page, lt)):
            end = raw.end()
        elif end < 0:
            k = lt + 1 + (after == "/")
            if LETTER.match(page, k):
                stop = name_end(k)
                close = tag_end(stop) if stop < n else -1
                if close >= 0:
                    end, name, attributes = close + 1, page[k:stop], page[stop:close]
        if end < 0:
            at = lt + 1
            continue
        yield lt, end, name, after == "/", attributes
        at = end


def blocks(page: str, by_name: bool = True) -> list[tuple[str, int, bool, bool, bool, bool]]:
    """Blocks of a page in order: text, link characters, bad region, inside article or main, heading, inside an element of PROSE.

    Without ``by_name`` neither the names of elements nor forms make a region bad.
    """
    found: list[tuple[str, int, bool, bool, bool, bool]] = []
    stack: list[tuple[str, int, bool]] = []  # tag, bad region (2: for good), inside main
    opened: dict[str, list[int]] = {}  # places of the open elements of each tag in the stack
    bad, main, links, heading = 0, False, 0, 0
    parts: list[str] = []
    linked = 0
    at = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((text, min(linked, len(text)), bad > 0, main, heading > 0, any(opened.get(t) for t in PROSE)))
            parts.clear()
        linked = 0

    def last(tags: tuple[str, ...]) -> tuple[int, ...]:
        return tuple(opened[t][-1] for t in tags if opened.get(t))

    def end(k: int) -> None:
        """Close the open elements from the k-th on."""
        nonlocal bad, main, links, heading
        _, bad, main = stack[k]
        for gone, _, _ in stack[k:]:
            opened[gone].pop()
            links -= gone == "a"
            heading -= gone in HEADINGS
        del stack[k:]

    for start, stop, tag, ends, attributes in tokens(page):
        if start > at:
            piece = page[at:start]
            parts.append(piece)
            if links:
                linked += len(piece.strip())
        at = stop
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            close()
        if ends:
            k = max(last((tag,)), default=-1)
            if k >= 0 and k > max(last(WITHIN.get(tag, ())), default=-1):
                end(k)
            continue
        if tag in ENDS:
            over, within = ENDS[tag]
            if found_open := last(over):
                border = max(last(within), default=-1)
                if (k := min((x for x in found_open if x > border), default=-1)) >= 0:
                    end(k)
        if tag in VOID_TAGS or attributes.endswith("/"):
            continue
        if tag == "a" and links:  # links do not nest: an open one ends here
            if opened["a"][-1] == len(stack) - 1:
                del stack[opened["a"].pop()]
                links -= 1
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, bad, main))
        links += tag == "a"
        heading += tag in HEADINGS
        if tag in ("article", "main") and bad < 2:
            main, bad = True, 0
        elif tag == "form":
            bad = max(bad, 1) if by_name else bad
        elif tag in BAD_TAGS and tag != "form" or tag == "header" and not main:
            bad = 2
        if attributes and tag not in ("html", "body", "main"):
            if HIDDEN.search(attributes) or by_name and any(BAD_NAME.search(x[0] or x[1] or x[2]) for x in NAMED.findall(attributes)):
                bad = 2
    if at < len(page):
        rest = page[at:]
        cut = rest.rfind("<")  # a tag that the page's end cuts off
        parts.append(rest[:cut] if cut >= 0 and ">" not in rest[cut:] and re.match(r"</?[a-zA-Z!]|</?$", rest[cut:]) else rest)
    close()
    return found


def first_pass(text: str, linked: int, bad: bool, main: bool, prose: bool = False) -> int:
    if bad or linked > LINK_SHARE * len(text):
        return BAD
    ease = 0.5 if main else 1
    if len(text) < SHORT_CHARS * ease:
        return BAD if linked and not main else SHORT
    words = [w.lower() for w in WORDS.findall(text)]
    density = max(sum(w in s for w in words) for s in STOPS) / max(len(words), 1)
    if density >= STOP_HIGH * ease:
        return GOOD if len(text) > LONG_CHARS * ease else NEAR
    if density >= STOP_LOW * ease:
        return GOOD if len(text) > 2 * LONG_CHARS * ease else NEAR
    return BAD if len(text) > LONG_CHARS and not (main and prose) else SHORT


def neighbours(labels: list[int]) -> tuple[list[int], list[int]]:
    """Place of the nearest decided block before and after each; -1 where there is none."""
    n = len(labels)
    before, after = [-1] * n, [-1] * n
    last = -1
    for i in range(n):
        before[i] = last
        last = i if labels[i] in (GOOD, BAD) else last
    last = -1
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = i if labels[i] in (GOOD, BAD) else last
    return before, after


def outside_pass(labels: list[int], heading: list[bool]) -> list[bool]:
    """The second pass beside an article or main element, whose borders count as bad: ambiguous blocks stay between good ones, headings before one."""
    before, after = neighbours(labels)
    good = lambda k: k >= 0 and labels[k] == GOOD
    return [x == GOOD or x != BAD and good(a) and (h or good(b)) for x, h, b, a in zip(labels, heading, before, after, strict=True)]


def inside_pass(labels: list[int]) -> list[bool]:
    """The second pass inside an article or main element, whose borders count as good."""
    before, after = neighbours(labels)
    return [x == GOOD if x in (GOOD, BAD) else b < 0 or a < 0 or GOOD in (labels[b], labels[a]) for x, b, a in zip(labels, before, after, strict=True)]


def open_pass(labels: list[int], heading: list[bool], prose: list[bool]) -> list[bool]:
    """The second pass over a page without an article or main element, regions left out: ambiguous blocks of prose stay unless both neighbours are bad (the page's ends count as good), others between good ones, and headings before something that stays."""
    inside, outside = inside_pass(labels), outside_pass(labels, [False] * len(labels))
    keep = [x if p or y == GOOD else o for x, o, p, y in zip(inside, outside, prose, labels, strict=True)]
    follows = False
    for i in range(len(labels) - 1, -1, -1):
        if heading[i] and labels[i] != BAD:
            keep[i] = follows
        follows = keep[i] or follows and labels[i] != BAD
    return keep


def main_text(page: str | None) -> tuple[str, int, int]:
    """Main text, and how many blocks there were and stay.

    Names of elements are evidence: where they, or a form around it all, leave nothing of a page, it is read again without them, and that stands if a block is
    good by its own length and stop words.
    """
    text, n, kept, _ = _settled(blocks(page or ""))
    if not kept and n:
        again, _, left, good = _settled(blocks(page, by_name=False))
        if good:
            return again, n, left
    return text, n, kept


def _settled(found: list[tuple[str, int, bool, bool, bool, bool]]) -> tuple[str, int, int, bool]:
    """Text of the blocks that stay, how many there were and stay, and whether a good one does.

    Runs of blocks inside and outside of article and main elements are settled each on its own. Blocks of bad regions inside an element are no
    neighbours there, nor are they on a page without such an element, where text in paragraphs is held to the same lengths as inside one. Where no
    block of a run has enough stop words, its language is not one of STOP_WORDS and few stop words say nothing.
    """
    labels = [first_pass(t, n, bad, main, prose) for t, n, bad, main, _, prose in found]
    article = any(x != BAD and b[3] for x, b in zip(labels, found, strict=True))
    keep = [False] * len(found)

    def without_stops(at: list[int], own: list[int]) -> list[int]:
        return own if GOOD in own else [SHORT if found[i][1] <= LINK_SHARE * len(found[i][0]) else x for i, x in zip(at, own, strict=True)]

    for main, run in groupby(range(len(found)), lambda i: article and found[i][3]):
        at = list(run)
        if main or not article:
            at = [i for i in at if not found[i][2]]
        if main:
            stays = inside_pass(without_stops(at, [labels[i] for i in at]))
        elif article:
            stays = outside_pass([labels[i] for i in at], [found[i][4] for i in at])
        else:
            prose = [found[i][5] for i in at]
            own = [first_pass(found[i][0], found[i][1], False, p, p) for i, p in zip(at, prose, strict=True)]
            own = [x if p else y for x, y, p in zip(without_stops(at, own), own, prose, strict=True)]
            stays = open_pass(own, [found[i][4] for i in at], prose)
        for i, x in zip(at, stays, strict=True):
            keep[i] = x
    kept = [b[0] for b, k in zip(found, keep, strict=True) if k]
    good = any(k and first_pass(b[0], b[1], False, b[3] or b[5], b[5]) == GOOD for b, k in zip(found, keep, strict=True))
    return " ".join(kept), len(found), len(kept), good


def extract(df: DataFrame, html_col: str = "html", columns: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``columns`` of each row with ``text`` (empty if there is none, or the page is null), ``n_chars``, ``n_blocks`` and ``n_kept``.

    Pages are read whole, in time linear in their length. Repeated rows give rows of their own, an empty table none; ``columns`` must not have the names of the results.
    """
    own = df.select(*columns, F.col(html_col).cast("string").alias("__html"))
    names = [*columns, "text", "n_chars", "n_blocks", "n_kept"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(x.as_py()) for x in batch.column(len(columns))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([x[0] for x in out], pa.string()), pa.array([len(x[0]) for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())],
                names=names,
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.drop("__html").schema)
    return own.mapInArrow(work, f"{schema}, text string, n_chars long, n_blocks long, n_kept long")
