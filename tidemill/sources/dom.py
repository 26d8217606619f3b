"""A small element tree on the standard library's HTML parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Element:
    __slots__ = ("tag", "attributes", "parent", "children")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Element | str] = []

    def get(self, name: str) -> str:
        return self.attributes.get(name, "")

    @property
    def classes(self) -> list[str]:
        return self.get("class").split()

    def walk(self) -> Iterator[Element]:
        for child in self.children:
            if isinstance(child, Element):
                yield child
                yield from child.walk()

    def select(self, tag: str | None = None, name: str | None = None, test=None) -> Iterator[Element]:
        """Descendants by tag, class and a further test, in page order."""
        for e in self.walk():
            if (tag is None or e.tag == tag) and (name is None or name in e.classes) and (test is None or test(e)):
                yield e

    def first(self, tag: str | None = None, name: str | None = None, test=None) -> Element | None:
        return next(self.select(tag, name, test), None)

    def strings(self) -> Iterator[str]:
        for child in self.children:
            if isinstance(child, str):
                yield child
            elif child.tag not in ("script", "style"):
                yield from child.strings()

    def text(self, between: str = "") -> str:
        """Trimmed texts, empty ones left out."""
        return between.join(s for s in (x.strip() for x in self.strings()) if s)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(e)
        if tag not in VOID:
            self.now = e

    def handle_startendtag(self, tag, attrs):
        self.now.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.now))

    def handle_endtag(self, tag):
        e = self.now
        while e is not None and e.tag != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.now = e.parent

    def handle_data(self, data):
        self.now.children.append(data)


def parse(source: str) -> Element:
    builder = _Builder()
    builder.feed(source or "")
    builder.close()
    return builder.root
