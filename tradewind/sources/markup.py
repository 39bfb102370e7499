"""A small tree of an HTML page, for extractors that need nesting."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    """An element: tag, attributes, children (nodes and strings), parent."""

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def all(self, test: Callable[[Node], bool]) -> Iterator[Node]:
        """Elements below this one, in the order of the page."""
        for c in self.children:
            if isinstance(c, Node):
                if test(c):
                    yield c
                yield from c.all(test)

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next(self.all(test), None)

    def strings(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                yield c
            else:
                yield from c.strings()

    def text(self) -> str:
        """The strings below, stripped and joined by a blank."""
        return " ".join(filter(None, (s.strip() for s in self.strings())))

    def remove(self) -> None:
        if self.parent is not None and self in self.parent.children:
            self.parent.children.remove(self)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        up = self.at
        while up is not None and up.tag != tag:
            up = up.parent
        if up is not None and up.parent is not None:
            self.at = up.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def has_class(name: str) -> Callable[[Node], bool]:
    return lambda n: name in n.classes


def class_like(pattern: str) -> Callable[[Node], bool]:
    """Whether one of the classes matches somewhere."""
    found = re.compile(pattern, re.IGNORECASE).search
    return lambda n: any(found(c) for c in n.classes)
