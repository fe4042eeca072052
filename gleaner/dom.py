"""A small document tree over the standard library's HTML tokenizer.

Unclosed elements stay open, end tags without a start are ignored, void elements never nest.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "template", "noscript"))


class Node:
    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kids: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))

    def strings(self, hidden: bool = False) -> Iterator[tuple[Node, str]]:
        """Text with the element that holds it; that of hidden elements only on demand."""
        todo: list[tuple[Node, Node | str]] = [(self, k) for k in reversed(self.kids)] if hidden or self.tag not in HIDDEN else []
        while todo:
            holder, kid = todo.pop()
            if isinstance(kid, str):
                yield holder, kid
            elif hidden or kid.tag not in HIDDEN:
                todo.extend((kid, k) for k in reversed(kid.kids))

    def text(self, joint: str = " ") -> str:
        return joint.join(s for _, t in self.strings() if (s := t.strip()))

    def raw(self) -> str:
        return "".join(t for _, t in self.strings(hidden=True))

    def up(self) -> Iterator[Node]:
        """This node and what it is in, without the root."""
        node: Node | None = self
        while node is not None and node.parent is not None:
            yield node
            node = node.parent

    def next(self) -> Node | None:
        """The next element beside this one."""
        kids = self.parent.kids if self.parent else []
        after = False
        for k in kids:
            if after and isinstance(k, Node):
                return k
            after = after or k is self
        return None

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def find(self, *tags: str, where: Callable[[Node], bool] | None = None) -> Iterator[Node]:
        return (n for n in self.walk() if (not tags or n.tag in tags) and n.parent is not None and (where is None or where(n)))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        seen: dict[str, str] = {}
        for k, v in attrs:
            seen[k] = v or ""
        node = Node(tag, seen, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        node = next((n for n in self.at.up() if n.tag == tag), None)
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_STEP = re.compile(r"""([a-z0-9]*)((?:\.[\w-]+|\[[^\]]+\])*)""", re.I)
_TEST = re.compile(r"""\.([\w-]+)|\[([\w:-]+)(?:(\*?=)["']?([^"'\]]*)["']?)?\]""")


def select(node: Node, selector: str) -> Iterator[Node]:
    """Elements by one compound selector: tag, .class, [attr], [attr=v], [attr*=v]."""
    match = _STEP.fullmatch(selector.strip())
    if match is None:
        raise ValueError(f"unsupported selector: {selector}")
    tests = [m.groups() for m in _TEST.finditer(match[2])]

    def fits(n: Node) -> bool:
        for css_class, attr, how, value in tests:
            if css_class:
                if css_class not in n.classes():
                    return False
            elif attr not in n.attrs or (how == "=" and n.attrs[attr] != value) or (how == "*=" and value not in n.attrs[attr]):
                return False
        return True

    return node.find(*([match[1]] if match[1] else []), where=fits)
