"""Small element tree for work that needs nesting; used inside Arrow batches only."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "hr", "img", "input", "link", "meta", "source"}


class Node:
    __slots__ = ("tag", "attrs", "kids", "up", "joined", "named", "page", "at", "to", "first", "last")

    def __init__(self, tag, attrs=(), up=None):
        self.tag, self.attrs, self.kids, self.up, self.joined, self.named, self.page = tag, {k: v or "" for k, v in attrs} if attrs else {}, [], up, None, None, None

    def walk(self):
        stack = list(reversed(self.kids))
        while stack:
            n = stack.pop()
            yield n
            if isinstance(n, Node):
                stack.extend(reversed(n.kids))

    def lay_out(self):
        """Elements and texts of the whole page in document order, in which each element has a stretch of either; laid out at the
        first question, as the tree does not change once a page is read."""
        root = self
        while root.up is not None:
            root = root.up
        nodes, pieces = page = [], []
        stack = [root]
        while stack:
            n = stack.pop()
            kind = type(n)
            if kind is str:
                n = n.strip()
                if n:
                    pieces.append(n)
            elif kind is tuple:
                n[0].to, n[0].last = len(nodes), len(pieces)
            else:
                nodes.append(n)
                n.page, n.at, n.first = page, len(nodes), len(pieces)
                if n.kids:
                    stack.append((n,))
                    stack.extend(reversed(n.kids))
                else:
                    n.to, n.last = n.at, n.first
        return page

    def nodes(self):
        """Elements below this one in document order."""
        return (self.page or self.lay_out())[0][self.at:self.to]

    def find(self, *tags):
        return [n for n in self.nodes() if n.tag in tags]

    def text(self, sep=" "):
        """Text of the whole element; kept, as the tree does not change once a page is read."""
        if self.joined is None:
            self.joined = {}
        got = self.joined.get(sep)
        if got is None:
            pieces = (self.page or self.lay_out())[1]
            got = self.joined[sep] = " ".join(sep.join(pieces[self.first:self.last]).split())
        return got

    def classes(self):
        if self.named is None:
            self.named = self.attrs.get("class", "").lower().split()
        return self.named


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.cur = Node("root")
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
            return
        if tag == "p" and self.cur.tag == "p":
            self.cur = self.cur.up
        n = Node(tag, attrs, self.cur)
        self.cur.kids.append(n)
        if tag not in VOID:
            self.cur = n

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
            return
        n = self.cur
        while n.up is not None and n.tag != tag:
            n = n.up
        if n.up is not None:
            self.cur = n.up

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.cur.kids.append(data)


_GAP = r"[ \t\n\r\f]"
_ATTR = rf'{_GAP}+([a-zA-Z][a-zA-Z0-9_:-]*)="([^"<>&]*)"'
_SET = rf'((?:{_GAP}+[a-zA-Z][a-zA-Z0-9_:-]*="[^"<>&]*")*)'
_ATTRS = re.compile(_ATTR)
#: A plain piece of a page: start tag, end tag, text, a script or style, a title, the usual document type.
_PIECE = re.compile(
    rf"<([a-zA-Z][a-zA-Z0-9]*){_SET}{_GAP}*>|</([a-zA-Z][a-zA-Z0-9]*){_GAP}*>|([^<]+)"
    r"|(<!DOCTYPE html>)")
_SKIPPED = re.compile(r"[^<]*(?:<(?!/script|/style|!--|script|style)[^<]*)*</(script|style)>", re.IGNORECASE)
_TITLE = re.compile(r"([^<&]*)</title>")
_RAW = {"textarea", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext", "listing", "svg", "math"}


def _plain(html: str) -> Node | None:
    """Tree of a page that consists of plain pieces only, read by one pattern; None for any other page."""
    root = cur = Node("root")
    at, end, match = 0, len(html), _PIECE.match
    while at < end:
        m = match(html, at)
        if m is None:
            return None
        at, kind = m.end(), m.lastindex
        if kind == 4:
            data = m[4]
            if not data.isspace():
                data = unescape(data) if "&" in data else data
                if data.strip():
                    cur.kids.append(data)
        elif kind == 3:
            close = m[3].lower()
            if close in ("script", "style"):
                return None
            n = cur
            while n.up is not None and n.tag != close:
                n = n.up
            if n.up is not None:
                cur = n.up
        elif kind == 2:
            tag, attrs = m[1].lower(), m[2]
            if tag in ("script", "style"):
                rest = _SKIPPED.match(html, at)
                if rest is None or rest.group(1).lower() != tag:
                    return None
                at = rest.end()
                continue
            if tag in _RAW:
                return None
            if tag == "p" and cur.tag == "p":
                cur = cur.up
            n = Node(tag, [(k.lower(), v) for k, v in _ATTRS.findall(attrs)] if attrs else (), cur)
            cur.kids.append(n)
            if tag == "title":
                rest = _TITLE.match(html, at)
                if rest is None:
                    return None
                at = rest.end()
                if rest.group(1).strip():
                    n.kids.append(rest.group(1))
            elif tag not in VOID:
                cur = n
    return root


def parse(html: str) -> Node:
    """Tree of a page. Pages of plain pieces, most of those that programs write, are read by one pattern; pages with anything else
    (comments, bare or escaped attributes, raw text, broken tags) by the standard parser, with the same tree."""
    root = _plain(html or "")
    return root if root is not None else parse_any(html)


def parse_any(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root
