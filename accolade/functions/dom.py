"""A forgiving tree of an HTML page: unclosed and stray tags do no harm."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from accolade.functions.text import squeeze

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    __slots__ = ("attrs", "inside", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.inside = tag, attrs, parent, []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node | str]:
        """Everything inside, in the page's order."""
        stack = list(reversed(self.inside))
        while stack:
            x = stack.pop()
            yield x
            if isinstance(x, Node):
                stack += reversed(x.inside)

    def nodes(self, *tags: str) -> Iterator[Node]:
        return (x for x in self.walk() if isinstance(x, Node) and (not tags or x.tag in tags))

    def raw(self) -> str:
        return "".join(x for x in self.walk() if isinstance(x, str))

    def text(self) -> str:
        return squeeze(self.raw())

    def within(self, *tags: str) -> Node | None:
        """The nearest node around with one of the tags."""
        x = self.parent
        while x is not None and x.tag not in tags:
            x = x.parent
        return x

    def outermost(self, tag: str) -> Iterator[Node]:
        """Nodes of the tag that stand in no other one inside this."""
        stack = list(reversed(self.inside))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                if x.tag == tag:
                    yield x
                else:
                    stack += reversed(x.inside)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.inside.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        x = self.at
        while x is not None and x.tag != tag:
            x = x.parent
        if x is not None and x.parent is not None:
            self.at = x.parent

    def handle_data(self, data):
        self.at.inside.append(data)


def numbered(root: Node) -> list[tuple[int, int, Node | str]]:
    """Everything on a page in order, as (place, place of the last thing inside, node or text): a lies in b if b's places enclose a's."""
    out: list[list] = []
    open_: list[tuple[int, Iterator]] = [(-1, iter(root.inside))]
    while open_:
        at, rest = open_[-1]
        x = next(rest, None)
        if x is None:
            open_.pop()
            if at >= 0:
                out[at][1] = len(out) - 1
            continue
        out.append([len(out), len(out), x])
        if isinstance(x, Node):
            open_.append((len(out) - 1, iter(x.inside)))
    return [tuple(x) for x in out]


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root
