"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read once into blocks: runs of text between the tags that break lines. A linear classifier over a block's
words, links, end mark and enclosing elements gives its cost of being called content or boilerplate; these are the
capacities to the two terminals. Blocks that follow each other, and successive blocks of the same enclosing element, are joined by
smoothness edges, the weaker the further apart they are in the document tree. The minimum cut labels all blocks at once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.mincut import label

# A comment, a declaration, a tag (quoted values may hold '>'), or the rest of a broken tag.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|aria-label)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_TOKENS_OF = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template title textarea iframe object svg select button canvas audio video head datalist annotation annotation-xml".split())
# Their content is raw text: what follows one that is never closed belongs to it. After the others the page goes on.
RAW = frozenset("script style title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img "
    "input br math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msup msub msubsup mover munder munderover mstyle mpadded mphantom menclose".split()
)
# A start tag of these ends an open element of the same kind.
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Enclosing elements and names (of class, id, role) that say what a part of a page is.
NEVER = frozenset("nav aside footer menu dialog".split())
NEVER_NAMES = frozenset(
    "comment reply discussion disqus respond sidebar aside advert advertisement ad sponsor sponsored promo promotion cookie consent gdpr notice alert "
    "newsletter subscribe subscription popup modal overlay breadcrumb pagination pager share sharing social related recommend recommended recommendation "
    "trending popular footer nav navbar navigation menu login signup register search toolbar adsense adsbygoogle navigationbar complementary contentinfo".split()
)
RATHER_NOT = frozenset("header banner masthead top meta byline tag widget copyright legal disclaimer toc link list caption credit skip author teaser form".split())
CONTENT = frozenset("article main".split())
CONTENT_NAMES = frozenset("article content main post entry story body text maintext articlebody prose".split())


# Longer names that begin like this, and the few names that count for an article or main element itself.
_NEVER_STARTS = ("comment", "advert", "sponsor", "newsletter", "cookie", "sidebar", "navbar", "breadcrumb", "subscri", "footer", "related")
# Names of a paragraph or heading say something only if all their words are known.
_OF_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_NEVER_ARTICLE = ("comment", "reply", "advert", "sponsor", "related", "sidebar", "promo")


class _Element:
    """`never`: no text of the page's own. `lifted`: what `never` would be if names of elements around an article or main element said nothing."""

    __slots__ = ("tag", "up", "depth", "never", "lifted", "hint")

    def __init__(self, tag: str, up: _Element | None, attributes: str):
        self.tag, self.up = tag, up
        self.depth = up.depth + 1 if up else 0
        names, hidden = set(), False
        if attributes and tag not in ("html", "body"):
            for key, value in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), value.strip("\"'")
                if key in ("class", "id", "role", "aria-label"):
                    for name in value.split():
                        words = {w.lower().removesuffix("s") if len(w) > 3 else w.lower() for w in _TOKENS_OF.findall(name)}
                        if tag not in _OF_TEXT or all(w in _KNOWN or w.startswith(_NEVER_STARTS) for w in words):
                            names |= words
                elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                    hidden = True
        # The innermost element that says something decides, but some things stay what they are whatever is inside.
        spoken = any(n.startswith(_SPOKEN) for n in names)
        if tag in CONTENT:
            never = hidden or any(n.startswith(_NEVER_ARTICLE) for n in names)
            inherited = bool(up and up.lifted and up.lifted != "name")
        else:
            never = hidden or tag in NEVER or bool(names & _NEVER_NAMES) or any(n.startswith(_NEVER_STARTS) for n in names)
            inherited = bool(up and up.lifted)
        self.never = never or bool(up and up.never)
        if inherited:
            self.lifted = up.lifted
        else:
            self.lifted = "" if not never else "name" if not (hidden or spoken or tag in NEVER or tag in CONTENT) else "part"
        if never:
            self.hint = -1
        elif tag in CONTENT or names & _CONTENT_NAMES:
            self.hint = 1
        elif tag == "form" or names & _RATHER_NOT or (tag == "header" and not (up and up.hint > 0)):
            self.hint = -1
        else:
            self.hint = up.hint if up else 0

    def in_content(self) -> bool:
        return self.lifted == "" and self.never and self.hint > 0


def _stems(names: frozenset[str]) -> frozenset[str]:
    return names | {n.removesuffix("s") for n in names if len(n) > 3}


_NEVER_NAMES, _RATHER_NOT, _CONTENT_NAMES = _stems(NEVER_NAMES), _stems(RATHER_NOT), _stems(CONTENT_NAMES)
_KNOWN = _NEVER_NAMES | _RATHER_NOT | _CONTENT_NAMES
# Names of what readers write, which no layout is called.
_SPOKEN = ("comment", "repl", "discussion", "disqus", "respond")


class _Block:
    __slots__ = ("text", "linked", "inside")

    def __init__(self, text: str, linked: int, inside: _Element):
        self.text, self.linked, self.inside = text, linked, inside


def blocks_of(page: str) -> list[_Block]:
    """The page's blocks in order, one pass over its tags; broken markup ends elements as browsers do, roughly."""
    root = _Element("html", None, "")
    now, links, silent, in_head = root, 0, "", False
    opened: dict[str, int] = {}  # elements open now, by tag: an end tag without one is passed over without a search
    endless: set[str] = set()  # silent elements that no end tag follows any more
    out: list[_Block] = []
    pieces: list[str] = []
    linked = 0

    def end() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(_Block(text, linked, now))
            pieces, linked = [], 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not silent:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if links:
                linked += len(text)

    at = 0
    while True:
        if silent and silent != "head":  # up to the end tag of this very element
            m = None if silent in endless else re.compile(rf"</{re.escape(silent)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if m:
                at = m.end()
            elif silent in RAW:
                break
            else:
                endless.add(silent)
            silent = "head" if in_head else ""
            continue
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in INLINE:
            pass
        elif closing:
            end()
            links = 0
            if opened.get(tag):
                while now.tag != tag:
                    opened[now.tag] -= 1
                    now = now.up
                opened[tag] -= 1
                now = now.up
            if tag == "head":
                silent, in_head = "", False
        elif tag in VOID:
            end()
        elif tag in SILENT and tag != "head":
            if not attributes.endswith("/"):
                silent = tag
        else:
            end()
            links = 0
            ends = SELF_CLOSING.get(tag, ())
            while now.up and (now.tag == "p" or now.tag in ends):
                opened[now.tag] -= 1
                now = now.up
            if tag == "body":
                silent, in_head = "", False
                now, opened = root, {}
            now = _Element(tag, now, attributes)
            opened[tag] = opened.get(tag, 0) + 1
            if tag == "head":
                silent, in_head = "head", True
    end()
    return out


def cost(b: _Block, lifted: bool = False) -> float:
    """Log-odds of content: above 0 speaks for content. With `lifted`, an article counts whatever the elements around it are called."""
    words = b.text.count(" ") + 1
    z = -0.8 + 0.35 * log2(1 + words) - 3.0 * b.linked / len(b.text)
    z += 0.4 if b.text[-1] in ".!?:;\"'»”…。" else 0.0
    z += 0.6 if b.inside.tag in ("p", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6") else 0.0
    if b.inside.never and not (lifted and b.inside.in_content()):
        return z - 14.0
    return z + (5.0 if b.inside.hint > 0 else -5.0 if b.inside.hint < 0 else 0.0)


def _distance(a: _Element, b: _Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth and a.up:
            a = a.up
        elif b.up:
            b = b.up
        else:
            break
        steps += 1
    return steps


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, 1.0 / (1 + _distance(blocks[i - 1].inside, b.inside))))
        around = id(b.inside.up or b.inside)
        if around in last and last[around] != i - 1:
            edges.append((last[around], i, 0.5))
        last[around] = i
    keep = label([cost(b) for b in blocks], edges)
    if not any(keep) and any(b.inside.in_content() for b in blocks):
        # Nothing is left, but there is an article: the names around it are those of the page's layout.
        keep = label([cost(b, lifted=True) for b in blocks], edges)
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep` columns, text, n_chars: one row per row of `pages`.

    NULL or empty pages, and pages without content, have the text '' and 0 characters. Broken markup is read as far as
    it goes; nothing raises. Blocks that repeat are kept each time. Repeated rows give repeated results. Other columns
    are dropped, whatever their names. An empty table gives an empty result.
    """
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h) for h in b.pop("_html")]
            yield b.assign(text=text, n_chars=[len(t) for t in text])

    return rows.mapInPandas(run, f"{kinds}, text string, n_chars long")
