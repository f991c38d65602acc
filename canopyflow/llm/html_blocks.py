"""HTML to the leaf blocks of its DOM, with the features that the extractor's random field reads."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

# Element names of HTML, by how they bound text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

#: Elements whose content is no text of the page.
RAW = set("script style template noscript iframe svg title object".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""[^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+>""")
_LONG_REFERENCE = re.compile(r"&#([0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*"?true|style\s*=\s*"[^"]*display\s*:\s*none)""", re.I)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


#: Names of ancestors that a block's features hold at most; those further in are left out.
MOST_NAMES = 256


@dataclass
class Block:
    """A leaf block: its text with white space folded, and the names of its features."""

    text: str
    features: list[str] = field(default_factory=list)


def _element_features(tag: str, attributes: str) -> tuple[str, ...]:
    out = [f"in:{tag}"]
    if attributes:
        for m in _NAMES.finditer(attributes):
            out += [f"name:{p.lower()}" for p in _PARTS.findall(m[1] or m[2] or m[3] or "") if len(p) > 1]
        if _HIDDEN.search(attributes):
            out.append("hidden")
    return tuple(out)


def _bucket(n: int) -> int:
    return min(n.bit_length(), 7)


def _text_features(text: str, linked: int) -> list[str]:
    words = text.count(" ") + 1
    share = 4 * linked // max(1, len(text))
    out = [f"words:{_bucket(words)}", f"linked:{min(share, 4)}", f"commas:{min(text.count(',') + text.count('、'), 3)}"]
    if text[-1] in ".!?…。\"'”)":
        out.append("ends")
    if "©" in text or "(c)" in text[:40].lower():
        out.append("copyright")
    if any(c in text for c in "|»›·•"):
        out.append("separator")
    if share >= 3 and words <= 6:
        out.append("short link")
    if sum(c.isdigit() for c in text[:80]) * 3 > min(len(text), 80):
        out.append("digits")
    return out


def _reference(m: re.Match) -> str:
    """A numeric reference of many digits: without its leading zeros, or U+FFFD where no code point is so large."""
    digits = m[1].lstrip("xX").lstrip("0") or "0"
    return "\ufffd" if len(digits) > 7 else f"&#{'x' if m[1][0] in 'xX' else ''}{digits};"


def unescape(raw: str) -> str:
    """Character references decoded."""
    return html.unescape(_LONG_REFERENCE.sub(_reference, raw) if "&#" in raw else raw) if "&" in raw else raw


def _markup(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, kind, lower-case name, attributes) of the markup of a page, in linear time.

    kind: "start", "end", "raw" (an element with its content that is no text) or "" (comments, declarations). A "<"
    that begins no markup, or after which no ">" follows, is text. A ">" in a quoted attribute does not end a tag; when
    a quote is left open up to the end of the page, quotes no longer count.
    """
    n, at, quotes = len(page), 0, True
    last = page.rfind(">")
    while (i := page.find("<", at)) >= 0:
        at = i + 1
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = end + 3 if end >= 0 else n
            yield i, at, "", "", ""
            continue
        if i > last:
            return
        if page.startswith(("<!", "<?"), i):
            at = page.index(">", i) + 1
            yield i, at, "", "", ""
            continue
        m = _NAME.match(page, i)
        if not m:
            continue
        rest = _REST.match(page, m.end()) if quotes else None
        if rest:
            at = rest.end()
        else:
            quotes = False
            at = page.find(">", m.end()) + 1
            if not at:
                return
        name, attributes = m[2].lower(), page[m.end() : at - 1]
        if m[1]:
            yield i, at, "end", name, attributes
        elif name in RAW and not (name == "svg" and attributes.endswith("/")):
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            yield i, at, "raw", name, attributes
        else:
            yield i, at, "" if name in RAW else "start", name, attributes


class _Stack:
    """Open elements with their features, and where each name is open, so that closing needs no search."""

    def __init__(self):
        self.names: list[str] = [""]
        self.known: list[frozenset[str]] = [frozenset()]
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, features: tuple[str, ...]) -> None:
        known = self.known[-1]
        if len(known) < MOST_NAMES and not known.issuperset(features):
            known = known | frozenset(features[: MOST_NAMES - len(known)])
        self.places.setdefault(tag, []).append(len(self.names))
        self.names.append(tag)
        self.known.append(known)

    def close(self, names: set[str], scope: set[str] = frozenset()) -> None:
        """Closes up to the innermost open element of names, unless one of scope lies further in."""
        inner = lambda of: max((p[-1] for t in of if (p := self.places.get(t))), default=0)
        k = inner(names)
        if k and k > inner(scope - names):
            for tag in self.names[k:]:
                self.places[tag].pop()
            del self.names[k:], self.known[k:]


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order. Null or empty: none. Text of scripts, styles, titles and the like is no block.

    Unclosed and misnested elements are handled as browsers do in the common cases: a block element ends an
    open paragraph, list items, cells and options end their like, an end tag closes up to its start tag. A start
    tag of svg that ends in /> is closed; custom elements such as title-bar are elements like any other. The time
    grows with the page's length, whatever it holds.
    """
    out: list[Block] = []
    if not page:
        return out
    stack = _Stack()
    text: list[str] = []
    linked, in_link, at = 0, 0, 0

    def end_block() -> None:
        nonlocal linked
        if text:
            clean = " ".join("".join(text).split())
            if clean:
                out.append(Block(clean, [*stack.known[-1], f"leaf:{stack.names[-1]}", *_text_features(clean, linked)]))
            text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = unescape(raw)
            text.append(raw)
            if in_link:
                linked += len(raw.strip())

    for start, end, kind, tag, attributes in _markup(page):
        add(page[at:start])
        at = end
        if kind == "raw":
            if tag != "svg":
                end_block()
        elif kind == "" or tag in ("wbr", "img"):
            pass
        elif tag in INLINE:
            if tag == "a":
                in_link = 1 if kind == "start" else 0
        elif tag == "br":
            text.append(" ")
        else:
            end_block()
            in_link = 0
            if kind == "end":
                stack.close({tag})
                continue
            if tag in ENDS_P:
                stack.close({"p"}, {"td", "th", "li", "div", "section", "article", "body", "blockquote", "form"})
            if tag in SIBLINGS:
                stack.close(SIBLINGS[tag], SCOPES.get(tag, {"body"}))
            if tag not in VOID and not attributes.rstrip().endswith("/"):
                stack.push(tag, _element_features(tag, attributes))
    add(page[at:])
    end_block()
    n = len(out)
    for k, b in enumerate(out):
        b.features += ["bias", f"place:{4 * k // n}"]
        if k == 0:
            b.features.append("first")
        if k == n - 1:
            b.features.append("last")
    return out
