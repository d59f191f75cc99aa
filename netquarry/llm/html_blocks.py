"""Leaf text blocks of an HTML page, each with features of its ancestors and of its text."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements that begin and end a block of text. All others are inline.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript object ol "
    "optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Raw content that may close itself; HTML gives script, style and the like no such form.
SELF_CLOSING = ("svg", "math")
RAW_TAGS = frozenset("script style template svg math".split())  # their content is no text of the page
#: What a start tag ends if it is open and nothing in the second set is open above it.
IMPLIED_END = {
    "p": (frozenset(["p"]), frozenset("article aside blockquote body div fieldset footer form header li main nav section td th".split())),
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head", "title"]), frozenset()),
}
#: Elements whose start ends an open paragraph.
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Words in class, id and role values, by what they speak for.
HINTS = {
    "ad": "ad ads adv advert adverts advertisement adsense banner promo promoted promotion sponsor sponsored sponsors affiliate".split(),
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc tabs toolbar topbar skip links".split(),
    "comment": "comment comments commentlist respond reply replies disqus discussion responses reactions feedback".split(),
    "footer": "footer foot copyright colophon legal bottom contentinfo".split(),
    "header": "header masthead branding logo banner top site-header tagline".split(),
    "side": "sidebar side aside related recommended recommendations widget widgets popular trending more teaser complementary rail".split(),
    "notice": "cookie cookies consent notice notices alert popup modal overlay gdpr newsletter subscribe subscription paywall toast message".split(),
    "form": "form login signin signup search subscribe register contact input field".split(),
    "share": "share sharing social tags tag meta byline author date print tools actions buttons button".split(),
    "content": "content article articlebody post entry story main body text page maincontent prose hentry".split(),
}
_HINT_OF = {w: k for k, words in HINTS.items() for w in words}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"(?:^|[\s\"'])(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z0-9]+(?:-[a-z]+)*|[A-Z][a-z]+")
_ENDS = re.compile(r"[.!?…:»\"”)]\W*$")


@dataclass
class Block:
    text: str
    above: frozenset  # features of its ancestors
    tag: str
    chars: int
    in_links: int  # characters inside of links


def _hints(attributes: str) -> set[str]:
    out = set()
    for found in _NAMES.findall(attributes):
        value = next((x for x in found if x), "")
        for word in re.split(r"[^A-Za-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value)):
            if hint := _HINT_OF.get(word.lower()):
                out.add("hint:" + hint)
    if _HIDDEN.search(attributes):
        out.add("hidden")
    return out


_START = frozenset()


def blocks(page: str | None) -> list[Block]:
    """The page's non-empty leaf blocks in page order, with references decoded and white space squeezed."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, frozenset]] = []  # open block elements and what they and all above them tell
    known: dict[tuple[frozenset, str, str], frozenset] = {}
    parts: list[str] = []
    links, in_link = 0, 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            tag, above = stack[-1] if stack else ("", _START)
            out.append(Block(text, above, tag, len(text), min(links, len(text))))
        parts.clear()
        links = 0

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        data = page[at : m.start() if m else len(page)]
        if data:
            data = html.unescape(data) if "&" in data else data
            parts.append(data)
            links += len(data) * (in_link > 0)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:-3])
            continue
        tag, end, attributes = tag.lower(), bool(m[1]), m[3] or ""
        if tag in RAW_TAGS:
            if not end and not (tag in SELF_CLOSING and attributes.endswith("/")):
                close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                stop = page.find(">", close.start()) if close else -1
                at = stop + 1 if stop >= 0 else len(page)
            continue
        if tag == "a":
            in_link = max(0, in_link - 1) if end else 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in BLOCK_TAGS:
            continue
        flush()
        if end:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        ended, walls = IMPLIED_END.get(tag, IMPLIED_END["p"] if tag in _ENDS_P else (_START, _START))
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in walls:
                break
            if stack[k][0] in ended:
                del stack[k:]
                break
        if tag in VOID_TAGS:
            continue
        above = stack[-1][1] if stack else _START
        key = (above, tag, attributes)
        if key not in known:
            known[key] = above | {"in:" + tag} | (_hints(attributes) if attributes else set())
        stack.append((tag, known[key]))
    flush()
    return out


def _size(n: int) -> str:
    return str(min(9, n.bit_length()))


def features(found: list[Block]) -> list[list[str]]:
    """Feature names of each block: ancestors, own tag, and what its text looks like, with the neighbours' sizes."""
    out = []
    n = len(found)
    for k, b in enumerate(found):
        words = b.text.count(" ") + 1
        share = 4 * b.in_links // max(1, b.chars)
        f = [*b.above, "tag:" + b.tag, "words:" + _size(words), f"links:{share}", f"place:{min(4, 5 * k // n)}"]
        if words > 4 and share == 0:
            f.append("running text")
        if _ENDS.search(b.text):
            f.append("ends a sentence")
        if "©" in b.text or "|" in b.text and words < 12:
            f.append("sign")
        f.append("before:" + (_size(found[k - 1].text.count(" ") + 1) if k else "none"))
        f.append("after:" + (_size(found[k + 1].text.count(" ") + 1) if k + 1 < n else "none"))
        out.append(f)
    return out
