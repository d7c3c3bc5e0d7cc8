"""Main-text extraction by the distribution of line blocks.

Markup is stripped so that each block element is a line, and boilerplate
elements (menus, footers, adverts, forms, scripts, comments ...) leave empty
lines.  Text lengths are summed over a sliding window of lines; a surge is
where the sum rises from nothing over a threshold's worth of text, a dive where
it falls back to nothing, and the text between them is kept.  Surges and dives choose on every page; an
article or main tag is a weight: text inside counts :data:`WEIGHT` times, a
chosen article is taken whole, and one that outweighs the text outside all of
them ends the stretches at its borders.
Each row is handled alone, so nothing is shuffled.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, unused

#: Lines in a block.
WINDOW = 3
#: Characters in a block that make a surge.
SURGE = 86
#: How often a character inside a marked article counts.
WEIGHT = 2

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|svg|iframe|select|button|object|canvas)\b(?>[^>]*)>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']+|\"[^\"<]*\"|'[^'<]*')*)|[^>]*)>",
    re.S | re.I,
)
# Elements and class words.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SPACE = frozenset(["br"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("nav footer aside form menu dialog head".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
# What such a word is combined with where it still names the element.
CARRIERS = frozenset("area bar block body bottom box btn button buttons card cards container content entry footer form group header heading holder icon icons inner item items left link links list main mobile module outer overlay page panel post posts primary right row secondary section site slot text thread title top unit wrap wrapper".split())
# Words that name the element wherever they end a class or id (`user-comments`), and words
# before them that tell of another element (`with-footer`).
HEADS = frozenset("advert adverts advertisement breadcrumb breadcrumbs comment comments disqus footer menu navbar navigation newsletter pagination replies".split())
ABOUT = frozenset("above before has hide is js no non show under with without".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# What holds articles of others: an article tag inside does not make it content.
CARDS = frozenset("comment comments disqus promo promoted related replies respond sponsor sponsored".split())
# Readers' own: an article tag so named is one of these itself.
COMMENTS = frozenset("comment comments disqus replies respond".split())
CARD_TAGS = frozenset("nav footer aside menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORDS = re.compile(r"[a-z]+")


def _named(value: str, words: frozenset[str]) -> bool:
    """Whether a class or id among ``value`` is one of ``words``, alone, with carriers or as
    the last word: ``related-posts`` and ``user-comments`` are, ``related-work`` and
    ``with-footer`` are not."""
    for token in value.split():
        found = WORDS.findall(token)
        parts = set(found)
        if parts & words and (parts <= DROP_WORDS | CARRIERS or found[-1] in words & HEADS and not parts & ABOUT):
            return True
    return False


def _boilerplate(tag: str, attributes: str, inside: bool) -> bool:
    if tag in DROP or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return _cards(tag, attributes, COMMENTS)
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id") and _named(value, DROP_WORDS):
            return True
        if name == "role" and value.strip() in DROP_ROLES or name == "hidden" and not m[2] and tag != "p":
            return True
        if name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def _cards(tag: str, attributes: str, names: frozenset[str] = CARDS) -> bool:
    """Whether an element holds articles of others: comments, teasers, links."""
    words = (m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id"))
    return tag in CARD_TAGS or any(_named(w.lower(), names) for w in words)


def _closed(html: str) -> set[int]:
    """Where the elements start whose end tag follows."""
    open_: dict[str, list[int]] = {}
    closed = set()
    for m in TOKEN.finditer(html):
        if m[3]:
            own = open_.setdefault(m[3].lower(), [])
            if not m[2]:
                if not m[4].endswith("/"):
                    own.append(m.start())
            elif own:
                closed.add(own.pop())
    return closed


# Elements that an unclosed menu ends at, and any other unclosed element.
AFTER_MENU = frozenset("p h1 h2 h3 section article main blockquote pre".split())
AFTER_ANY = frozenset("article main".split())


class _Skip:
    """What of the page a dropped element without an end tag takes: it ends where an element
    around it ends, or where one starts that can't lie in it."""

    def __init__(self, tag: str) -> None:
        self.after = AFTER_MENU if tag in ("nav", "menu") else AFTER_ANY
        self.inside: dict[str, int] = {}

    def over(self, tag: str, ends: bool, alone: bool) -> bool:
        if not ends:
            if not alone:
                self.inside[tag] = self.inside.get(tag, 0) + 1
            return tag in self.after
        left = self.inside.get(tag, 0)
        self.inside[tag] = max(0, left - 1)
        return left == 0 and tag not in INLINE and tag not in ("p", "li", "body", "html")


#: Kinds of lines: text, headings, dropped elements within and around an article, borders of an article.
TEXT, HEADING, INNER, OUTER, BORDER = range(5)


def lines(html: str, closed: set[int] | None = None) -> list[tuple[str, int, float, int]]:
    """The page's lines: text, number of the marked article around it (0: none),
    share of link text, kind.  Only lines of kind text and heading hold text.

    A page that ends within a dropped element is read once more, knowing from ``closed`` which have an end tag.
    """
    out: list[tuple[str, int, float, int]] = []
    text: list[str] = []
    linked = article = marked = anchors = depth = start = 0
    skipped, heading, cards = "", False, False
    loose: _Skip | None = None
    again = closed is not None

    def close() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            out.append((joined, marked if article else 0, 0.0 if heading else min(1.0, linked / len(joined)), HEADING if heading else TEXT))
        text.clear()
        linked = 0

    at = 0
    for m in TOKEN.finditer(html):
        if not skipped and m.start() > at:
            piece = unescape(html[at : m.start()])
            text.append(piece)
            linked += len(piece.strip()) if anchors else 0
        at = m.end()
        if not m[3]:
            continue
        ends, tag = bool(m[2]), m[3].lower()
        if skipped:
            opens = tag in ("article", "main") and not ends and skipped not in ("article", "main")
            if opens and cards and closed is None:
                closed = _closed(html)
            if loose and loose.over(tag, ends, tag in VOID or m[4].endswith("/")) or opens and not (cards and start in closed):
                skipped = ""  # never closed, or around the whole content
            else:
                if tag == skipped:
                    depth += -1 if ends else not m[4].endswith("/")
                    if depth == 0:
                        skipped = ""
                continue
        if tag in INLINE and not (not ends and tag not in VOID and m[4] and _boilerplate(tag, m[4], article > 0)):
            anchors = max(0, anchors + (-1 if ends else 1)) if tag == "a" else anchors
            continue
        if tag in SPACE:
            text.append(" ")
            continue
        close()
        anchors = 0
        heading = tag in HEADINGS and not ends
        dropped = not ends and tag not in VOID and not m[4].endswith("/") and _boilerplate(tag, m[4], article > 0)
        if tag in ("article", "main") and not dropped:
            if not ends and (article or not _cards(tag, m[4])):
                article += 1
                if article == 1:
                    marked += 1
                    out.append(("", marked, 0.0, BORDER))
            elif ends and article:
                article -= 1
                if article == 0:
                    out.append(("", marked, 0.0, BORDER))
        elif dropped:
            skipped, depth, start, cards = tag, 1, m.start(), _cards(tag, m[4])
            loose = _Skip(tag) if again and start not in closed else None
            out.extend([("", marked if article else 0, 0.0, OUTER if tag in ("nav", "header", "footer", "menu", "head") else INNER)] * WINDOW)
    if not skipped:
        text.append(unescape(html[at:]))
    elif not again:
        return lines(html, _closed(html))
    close()
    return out


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article's lines, joined by line feeds."""
    if not html:
        return ""
    return "\n".join(_chosen(lines(html), window, surge))


def _chosen(found: list[tuple[str, int, float, int]], window: int, surge: int) -> list[str]:
    # an article that outweighs what is outside all of them ends stretches at its borders
    mass: dict[int, int] = {}
    for text, inside, share, _ in found:
        mass[inside] = mass.get(inside, 0) + (0 if share > 0.5 else len(text))
    heavy = {a for a, n in mass.items() if a and n and WEIGHT * n >= mass.get(0, 0)}
    found = [row for row in found for _ in range((window if row[1] in heavy else 0) if row[3] == BORDER else 1)]
    size = np.array([0 if share > 0.5 else len(text) * (WEIGHT if inside else 1) for text, inside, share, _ in found], np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    block = total[np.minimum(np.arange(len(size)) + window, len(size))] - total[:-1]
    # a stretch runs from a surge, where text sets in, to the dive, where a whole block is empty
    stretches, i = [], 0
    while i < len(size):
        if size[i] == 0:
            i += 1
            continue
        j = i
        while j < len(size) and block[j] > 0:
            j += 1
        stretches.append((i, j))
        i = j
    if not stretches:
        return []
    surges = [bool(block[i:j].max() >= surge) for i, j in stretches]
    if not any(surges):
        best = max(range(len(stretches)), key=lambda k: (total[stretches[k][1]] - total[stretches[k][0]], -k))
        surges[best] = True
    kinds = [kind for _, _, _, kind in found]
    kept = np.zeros(len(found), bool)
    for (i, j), yes in zip(stretches, surges, strict=True):
        kept[i:j] = yes
    return [row[0] for row, keep in zip(found, _joined(found, kinds, stretches, surges, kept, window), strict=True) if keep and row[0]]


def _joined(found: list, kinds: list[int], stretches: list, surges: list[bool], kept: np.ndarray, window: int) -> np.ndarray:
    """``kept`` with what belongs to it: stretches between kept ones, those next to
    one across a dive made by an element within the text, headings before one,
    link lines among kept lines, and all lines of the articles it touches."""
    taken = list(surges)
    first, last = taken.index(True), len(taken) - 1 - taken[::-1].index(True)
    taken[first:last] = [True] * (last - first)

    def near(i: int, j: int) -> bool:
        """Whether the lines between two stretches are neither a menu nor around an article."""
        links = sum(kind in (TEXT, HEADING) for kind in kinds[i:j])
        return links < window and not {OUTER, BORDER} & set(kinds[i:j])

    for k in range(last + 1, len(taken)):
        taken[k] = taken[k - 1] and near(stretches[k - 1][1], stretches[k][0])
    for k in range(first - 1, -1, -1):
        taken[k] = taken[k + 1] and (near(stretches[k][1], stretches[k + 1][0]) or HEADING in kinds[slice(*stretches[k])])
    for (i, j), yes in zip(stretches, taken, strict=True):
        kept[i:j] = yes
    # lines of link text: runs among kept lines, and short ones beside them
    whole = kept.copy()
    i = 0
    while i < len(kept):
        j = i
        while j < len(kept) and not kept[j] and kinds[j] in (TEXT, HEADING):
            j += 1
        if j > i:
            sides = (i > 0 and kept[i - 1]) + (j < len(kept) and kept[j])
            whole[i:j] = sides == 2 or sides == 1 and j - i < window
        i = max(j, i + 1)
    own = {row[1] for row, keep in zip(found, whole, strict=True) if keep and row[1]}
    return whole | np.array([row[1] in own for row in found])


def extract_main_text(df: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all but ``html`` by default) with ``text`` and ``n_chars``.

    Null, empty and text-free pages give an empty text; repeated rows each get
    theirs; of stretches that tie, each is judged by itself; an empty table gives an empty result.
    """
    keep = [c for c in df.columns if c not in (html, "text", "n_chars")] if keep is None else keep
    if clash := {"text", "n_chars"} & set(keep):
        raise ValueError(f"columns clash with results: {sorted(clash)}")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string, n_chars long"])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    name = unused(keep, "_html")
    return map_batches(df.select(*(F.col(f"`{c}`") for c in keep), F.col(html).alias(name)), name, work, schema)
