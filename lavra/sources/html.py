"""A small tree of an HTML page, for pages whose parts are found by tag, id and class, and Markdown made from it."""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

# Elements without an end tag, and those that a page's text doesn't come from.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
QUIET = frozenset("script style noscript".split())
#: What an element's start closes when it is still open.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, **{t: {"p"} for t in ("div", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "table")}}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        """All elements below, in order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def is_(self, tag: str | None = None, id_: str | None = None, class_: str | None = None) -> bool:
        return (tag is None or self.tag == tag) and (id_ is None or self.attrs.get("id") == id_) and (class_ is None or class_ in self.attrs.get("class", "").split())

    def all(self, tag: str | None = None, id_: str | None = None, class_: str | None = None) -> list[Node]:
        return [n for n in self.walk() if n.is_(tag, id_, class_)]

    def first(self, *choices: dict) -> Node | None:
        """The first element that fits one of the choices."""
        return next((n for n in self.walk() if any(n.is_(**c) for c in choices)), None)

    def text(self) -> str:
        """The text below, white space collapsed."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in QUIET:
                todo += reversed(node.children)
        return " ".join(" ".join(out).split())

    def without(self, fits) -> Node:
        """A copy without the elements below that fit. Pages nest to any depth, so no method here calls itself."""
        out = Node(self.tag, self.attrs)
        todo = [(self, out)]
        while todo:
            old, new = todo.pop()
            for c in old.children:
                if isinstance(c, str):
                    new.children.append(c)
                elif not fits(c):
                    new.children.append(Node(c.tag, c.attrs))
                    todo.append((c, new.children[-1]))
        return out

    def html(self) -> str:
        out, todo = [], [self]
        while todo:
            part = todo.pop()
            if isinstance(part, Node):
                own = "".join(f' {k}="{escape(v)}"' for k, v in part.attrs.items())
                out.append(f"<{part.tag}{own}>")
                if part.tag not in VOID:
                    todo.append(_End(part.tag))
                    todo += reversed(part.children)
            else:
                out.append(f"</{part}>" if isinstance(part, _End) else escape(part, quote=False))
        return "".join(out)


class _End(str):
    """An element's end, among the parts that are still to be written."""


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node("")]

    def handle_starttag(self, tag, attrs):
        while len(self.open) > 1 and self.open[-1].tag in CLOSES.get(tag, ()):
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), 0)
        if at:
            del self.open[at:]

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.open[0]


def markdown(node: Node) -> str:
    """Headings, paragraphs, lists, links and emphasis of a page as Markdown; other elements by their text."""
    return "\n\n".join(x for x in _told(_blocks(node)) if x)


def _told(first: Generator):
    """What a generator returns that yields others and is sent what these return: calls without Python's stack, for pages of any depth."""
    open_, value = [first], None
    while open_:
        try:
            open_.append(open_[-1].send(value))
            value = None
        except StopIteration as done:
            open_.pop()
            value = done.value
    return value


def _blocks(node: Node) -> Generator:
    """Returns a list of blocks."""
    out, line = [], []

    def flush() -> None:
        if said := " ".join("".join(line).split()):
            out.append(said)
        line.clear()

    for c in node.children:
        if isinstance(c, str):
            line.append(c)
        elif c.tag in QUIET or c.tag in ("head", "title"):
            continue
        elif c.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            flush()
            if said := (yield _inline(c)):
                out.append(f"{'#' * int(c.tag[1])} {said}")
        elif c.tag in ("ul", "ol"):
            flush()
            items = []
            for i in c.children:
                if isinstance(i, Node) and i.tag == "li":
                    items.append((yield _inline(i)))
            out.append("\n".join(f"{f'{n}.' if c.tag == 'ol' else '-'} {i}" for n, i in enumerate(items, 1) if i))
        elif c.tag == "br":
            line.append(" ")
        elif c.tag in ("a", "b", "strong", "i", "em", "span", "u", "code", "small", "sub", "sup"):
            line.append((yield _marked(c)))
        else:
            flush()
            out += yield _blocks(c)
    flush()
    return out


def _marked(node: Node) -> Generator:
    """Returns a run of text."""
    said = yield _inline(node)
    if not said:
        return " "
    if node.tag == "a" and node.attrs.get("href"):
        return f"[{said}]({node.attrs['href']})"
    return {"b": f"**{said}**", "strong": f"**{said}**", "i": f"*{said}*", "em": f"*{said}*", "code": f"`{said}`"}.get(node.tag, said)


def _inline(node: Node) -> Generator:
    """Returns a run of text."""
    parts = []
    for c in node.children:
        if isinstance(c, str):
            parts.append(c)
        elif c.tag not in QUIET:
            parts.append(" " if c.tag == "br" else (yield _marked(c)))
    return " ".join("".join(parts).split())
