"""Leaf blocks of a web page: text between block boundaries, with the path of open tags.

Only content that is no text of the page is left out by name: scripts, styles, templates, titles,
and what stands in text areas and frames. All other elements, such as formulas, drawings, fallbacks and
choices, give blocks under their path, for the labeller to judge.

Defined cases: an element that closes itself is empty; of the elements left out, a script or
style without an end tag runs to the end of the page, any other counts as empty; a choice, drawing
or formula without an end tag ends with its parent or at the next block; a comment without an end
runs to the end of the page.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_NAMED = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
#: Elements whose content isn't text of the page, and runs to their own end tag; those that need none.
_RAW = {"script", "style", "template", "textarea", "title", "iframe", "noembed", "noframes"}
_TO_THE_END = {"script", "style"}
_CLOSING = {name: re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE) for name in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hr", "html", "label", "legend", "li", "main", "menu", "nav", "noscript", "object", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "svg", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: An open element that a start tag of these ends.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Open elements that any block's start tag ends, except of those that belong in them.
_NARROW, _NARROWED = {"select", "svg", "math"}, {"option", "optgroup", "hr", "select", "svg"}
_WALLS = {"ul", "ol", "dl", "table", "div", "section", "article", "aside", "nav", "main", "body", "form", "blockquote"}

_GROUPS = {name: tuple(key for key, names in (("#block", _BLOCK), ("#narrow", _NARROW), ("#wall", _WALLS)) if name in names) for name in _BLOCK | _NARROW | _WALLS}


class Path:
    """An open element below another; paths share what is above, so that deep pages stay small."""

    __slots__ = ("element", "parent", "slots")

    def __init__(self, parent: Path | None, element: str):
        self.parent, self.element, self.slots = parent, element, None


@dataclass(slots=True)
class Block:
    leaf: Path | None
    text: str
    linked: int

    @property
    def path(self) -> tuple[str, ...]:
        out, at = [], self.leaf
        while at is not None:
            out.append(at.element)
            at = at.parent
        return tuple(reversed(out))


class _Tags:
    """Tags of a page one after the other. No part of the page is read again for each mark that leads nowhere."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.missing = {'"': len(page), "'": len(page)}  # from where a kind of quote doesn't occur any more
        self.failed: set[int] = set()  # opening quotes from which no tag ends

    def _end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose name ends at ``at``: outside quotes, or else the first."""
        first, seen = None, []
        while True:
            stop = _STOP.search(self.page, at)
            if stop is None:
                break
            at, mark = stop.start(), stop[0]
            if mark == ">":
                return at
            if first is None:
                first = self.page.find(">", at)
            seen.append(at)
            close = self.page.find(mark, at + 1) if at not in self.failed and at + 1 < self.missing[mark] else -1
            if close < 0:
                if at not in self.failed:
                    self.missing[mark] = min(self.missing[mark], at + 1)
                break
            at = close + 1
        self.failed.update(seen)
        return first if first is not None else -1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Start, end, slash, name and rest of the next tag from ``at``; comments and declarations have no name."""
        page = self.page
        while True:
            at = page.find("<", at)
            if at < 0:
                return None
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, len(page) if end < 0 else end + 3, "", "", ""
            if at > self.last:
                at = page.find("<!--", at)
                if at < 0:
                    return None
                continue
            if page.startswith(("<!", "<?"), at):
                return at, page.index(">", at) + 1, "", "", ""
            named = _NAME.match(page, at + 1)
            after = named.end() if named else -1
            end = after if after >= 0 and page.startswith(">", after) else self._end(after) if named else -1
            if end >= 0:
                return at, end + 1, named[1], named[2], page[after:end]
            at += 1


class _Open:
    """Open elements, with the places of each name and group of names among them."""

    def __init__(self):
        self.stack: list[tuple[str, Path]] = []
        self.places: dict[str, list[int]] = {}

    def push(self, name: str, element: str) -> None:
        for key in (name, *_GROUPS.get(name, ())):
            self.places.setdefault(key, []).append(len(self.stack))
        self.stack.append((name, Path(self.leaf(), element)))

    def leaf(self) -> Path | None:
        return self.stack[-1][1] if self.stack else None

    def last(self, *keys: str) -> int:
        return max((self.places[x][-1] for x in keys if self.places.get(x)), default=-1)

    def first(self, key: str) -> int:
        return self.places[key][0] if self.places.get(key) else -1

    def close(self, k: int) -> None:
        while len(self.stack) > k:
            name, _ = self.stack.pop()
            for key in (name, *_GROUPS.get(name, ())):
                self.places[key].pop()


def blocks(page: str) -> list[Block]:
    """Blocks of a whole page in order; character references decoded, white space one space. The time is in proportion to the page."""
    out: list[Block] = []
    tags, opened = _Tags(page), _Open()
    words: list[str] = []
    endless: set[str] = set()
    linked, leaf, at, n = 0, None, 0, len(page)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(words).split())
        if text:
            out.append(Block(leaf, text, linked))
        words.clear()
        linked = 0

    while at < n:
        tag = tags.next(at)
        text = page[at : tag[0] if tag else n]
        if text:
            text = html.unescape(text) if "&" in text else text
            if not words:
                leaf = opened.leaf()
            words.append(text)
            if opened.places.get("a"):
                linked += len(text)
        if not tag:
            break
        _, at, end, name, rest = tag
        if not name:
            continue
        name = name.lower()
        if name == "br":
            words.append(" ")
        elif end:
            if name in _BLOCK:
                flush()
            if (k := opened.last(name)) >= 0 and (name in _BLOCK or k > opened.last("#block")):
                opened.close(k)
        elif name in _RAW:
            closing = None if rest.endswith("/") or name in endless else _CLOSING[name].search(page, at)
            if closing:
                at = closing.end()
            elif not rest.endswith("/") and name not in _TO_THE_END:
                endless.add(name)  # no end tag from here on, so it isn't looked for again
            elif name in _TO_THE_END and not rest.endswith("/"):
                at = n
        else:
            if name in _BLOCK:
                flush()
                if name not in _NARROWED and (k := opened.first("#narrow")) >= 0:
                    opened.close(k)
                k = opened.last("p", *_ENDS.get(name, ()))
                if k > opened.last("#wall"):
                    opened.close(k)
            if name not in _VOID and not rest.endswith("/"):
                names = " ".join(v for x in _NAMED.finditer(rest) for v in x.groups()[1:] if v) if "=" in rest else ""
                opened.push(name, f"{name} {names.lower()}".rstrip())
    flush()
    return out
