"""Pages as element trees: a lenient reader of HTML and a few ways to look into it."""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape
from itertools import pairwise
from xml.etree.ElementTree import Element, SubElement

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title"))
#: Open elements that a start tag ends.
CLOSES = {"tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: What such an end doesn't reach beyond.
SCOPES = frozenset(("table", "ul", "ol", "dl", "select", "div", "body", "root"))
#: Within a tag, what a turn takes is settled by its first letter, so that none need be taken back.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""", re.DOTALL)
CLOSING = {tag: re.compile(f"</{tag}[^>]*>", re.IGNORECASE) for tag in RAW}
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape("".join(values)))
    return found


def parse(html: str, decoded: Callable[[str], str] = unescape) -> Element:
    """The page's tree; ``decoded`` reads the entities of its texts."""
    root = Element("root")
    stack, top = [root], root
    search = TOKEN.search
    at, end = 0, len(html)
    while at < end:
        m = search(html, at)
        start = m.start() if m else end
        if start > at:
            text = html[at:start]
            if "&" in text:
                text = decoded(text)
            if len(top):
                last = top[-1]
                last.tail = last.tail + text if last.tail else text
            else:
                top.text = top.text + text if top.text else text
        if not m:
            break
        at = m.end()
        ends, tag, rest = m.groups()
        if not tag:
            continue
        tag = tag.lower()
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    top = stack[-1]
                    break
            continue
        if closes := CLOSES.get(tag):
            while len(stack) > 1 and stack[-1].tag in closes:
                stack.pop()
            for k in range(len(stack) - 1, 0, -1):  # elements within a cell or item that were left open
                here = stack[k].tag
                if here in SCOPES:
                    break
                if here in closes:
                    del stack[k:]
                    break
            top = stack[-1]
        node = SubElement(top, tag, attributes(rest) if rest else {})
        if tag == "br":
            node.tail = "\n"
        if tag in RAW:
            close = CLOSING[tag].search(html, at)
            text = html[at : close.start() if close else end]
            node.text = text if tag in ("script", "style") else decoded(text)
            at = close.end() if close else end
        elif tag not in VOID and not rest.endswith("/"):
            stack.append(node)
            top = node
    return root


def text_of(node: Element) -> str:
    """All text within, white space collapsed."""
    return " ".join("".join(node.itertext()).split())


def text_lines(node: Element) -> list[str]:
    return [line for x in "".join(node.itertext()).splitlines() if (line := " ".join(x.split()))]


def within(node: Element, *tags: str) -> list[Element]:
    return [n for n in node.iter() if n.tag in tags and n is not node]


def following(node: Element) -> dict[Element, Element]:
    """The next sibling of each element within."""
    return {a: b for parent in node.iter() if len(parent) > 1 for a, b in pairwise(parent)}


def classes(node: Element) -> str:
    return node.get("class", "").lower()


COMPOUND = re.compile(r"""(?P<tag>[a-zA-Z][\w-]*|\*)|\.(?P<class>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<name>[\w:-]+)\s*(?:(?P<how>[*^$~]?=)\s*["']?(?P<value>[^"'\]]*)["']?)?\]|:contains\(\s*["']?(?P<words>[^"')]*)["']?\s*\)|:nth-child\(\s*(?P<nth>\d+)\s*\)""")
HOW = {"=": lambda x, y: x == y, "*=": lambda x, y: y in x, "^=": lambda x, y: x.startswith(y), "$=": lambda x, y: x.endswith(y), "~=": lambda x, y: y in x.split()}


def _fits(node: Element, compound: str, places: dict[Element, int]) -> bool:
    at = 0
    for m in COMPOUND.finditer(compound):
        if m.start() != at:
            raise ValueError(f"selector {compound!r}")
        at = m.end()
        has = m["name"] and node.get(m["name"].lower())
        if not (
            (m["tag"] in ("*", node.tag) if m["tag"] else True)
            and (m["class"] in node.get("class", "").split() if m["class"] else True)
            and (node.get("id") == m["id"] if m["id"] else True)
            and (has is not None and (not m["how"] or HOW[m["how"]](has, m["value"])) if m["name"] else True)
            and (m["words"] in "".join(node.itertext()) if m["words"] else True)
            and (places.get(node) == int(m["nth"]) if m["nth"] else True)
        ):
            return False
    if at != len(compound):
        raise ValueError(f"selector {compound!r}")
    return True


def select(node: Element, selector: str) -> list[Element]:
    """Elements within that fit a CSS selector, in document order: tags, classes, ids, attributes, :contains, :nth-child, descendants, children (>), commas."""
    found = set()
    places = {child: i for parent in node.iter() for i, child in enumerate(parent, 1)} if ":nth-child" in selector else {}
    for one in re.split(r",(?![^\[(]*[\])])", selector):
        steps = re.findall(r"""(?:\[[^\]]*\]|\([^)]*\)|[^\s>\[(])+|>""", one)
        if re.sub(r"\s", "", "".join(steps)) != re.sub(r"\s", "", one):
            raise ValueError(f"selector {one!r}")
        here, direct = [node], False
        for step in steps:
            if step == ">":
                direct = True
                continue
            here = [*dict.fromkeys(n for top in here for n in (top if direct else top.iter()) if n is not top and _fits(n, step, places))]
            direct = False
        found.update(here if steps else ())
    return [n for n in node.iter() if n in found]


def selected(node: Element, selector: str) -> list[Element]:
    """Elements by CSS, or by path if the selector looks like one (of what ElementTree understands); none if it is malformed."""
    try:
        if selector.startswith(("/", ".//", "(")):
            path = selector.strip("()")
            return node.findall(path if path.startswith(".") else f".{path if path.startswith('//') else '/' + path}")
        return select(node, selector)
    except (ValueError, SyntaxError, KeyError):
        return []


