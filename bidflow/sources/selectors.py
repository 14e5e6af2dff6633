"""The element that leads to the next page, and the shortest selector that finds it and nothing else.

Seven strategies are tried in turn: labels, titles, icons, texts, class names, ``rel`` and data
attributes. The selector is made from what the element and those above it are: ids, classes, tags,
attributes. Of all selectors of one compound, of two parts of the element together, of a part of the
element below a part of an element above it, and, where these find more than the element, of a path by
places, the shortest that is unique on the page is taken, the first by its letters if several are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from xml.etree.ElementTree import Element

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidflow.sources.markup import parse, text_of

# What each strategy looks for, in this order.
LABELS = ["next page", "go to next", "next"]
TITLES = ["next page", "next"]
ICONS = [r"arrow.?forward|forward.?arrow", r"chevron.?right|right.?chevron", r"icon.?next"]
TEXTS = ["next", "next page", "›", "»", "→"]
CLASSES = [r"pagination.*next", r"next.*page", r"pager.*next"]
DATA = ["data-testid", "data-action"]
DISABLED = ["disabled", "inactive", "is-disabled"]


def _with(nodes: list[Element], attribute: str, test) -> Element | None:
    return next((n for n in nodes if test(n.get(attribute, "").lower())), None)


def next_element(root: Element) -> tuple[str | None, Element | None]:
    """The strategy that finds the next page's element, and the element."""
    nodes = list(root.iter())[1:]
    above = {child: parent for parent in root.iter() for child in parent}

    def clickable(node: Element) -> Element:
        """The link or button that an icon or a text stands in, or itself."""
        here: Element | None = node
        while here is not None:
            if here.tag in ("a", "button") or here.get("role") == "button":
                return here
            here = above.get(here)
        return node

    def icon(pattern: str) -> Element | None:
        found = re.compile(pattern)
        for n in nodes:
            own = n.text if not len(n) and n.tag not in ("script", "style") else None
            if any(found.search(x.lower()) for x in (n.get("alt"), n.get("class"), n.get("href") if n.tag == "use" else None, own) if x):
                return clickable(n)
        return None

    def worded(words: str) -> Element | None:
        hit = next((n for n in nodes if n.tag not in ("script", "style", "title") and not len(n) and text_of(n).lower() == words), None)
        return None if hit is None else clickable(hit)

    tries = [
        *(("aria", lambda w=w: _with(nodes, "aria-label", lambda x: w in " ".join(x.split()))) for w in LABELS),
        *(("title", lambda w=w: _with(nodes, "title", lambda x: w in " ".join(x.split()))) for w in TITLES),
        *(("icon", lambda p=p: icon(p)) for p in ICONS),
        *(("text", lambda w=w: worded(w)) for w in TEXTS),
        *(("class", lambda p=p: _with(nodes, "class", re.compile(p).search)) for p in CLASSES),
        ("rel", lambda: _with(nodes, "rel", lambda x: "next" in x.split())),
        *(("data", lambda a=a: _with(nodes, a, lambda x: "next" in x)) for a in DATA),
    ]
    for name, find in tries:
        if (node := find()) is not None:
            return name, node
    return None, None


def parts_of(node: Element) -> list[str]:
    """Selectors of one part that an element fits: its tag, id, classes, and attributes with and without their values."""
    word = re.compile(r"[\w-]+\Z")
    found = [node.tag] if word.match(node.tag) and node.tag[0].isalpha() else []
    for name, value in node.attrib.items():
        if not re.fullmatch(r"[\w:-]+", name):
            continue
        if name == "id" and word.match(value):
            found.append(f"#{value}")
        if name == "class":
            found += [f".{c}" for c in value.split() if word.match(c)]
        found.append(f"[{name}]")
        if value and not re.search(r"""["'\]\[()>,\\\s]""", value):
            found.append(f'[{name}="{value}"]')
    return list(dict.fromkeys(found))


def shortest_selector(root: Element, target: Element) -> str:
    """The shortest selector that finds the target alone."""
    above = {child: parent for parent in root.iter() for child in parent}
    fitting: dict[str, set[Element]] = {}
    for n in list(root.iter())[1:]:
        for p in parts_of(n):
            fitting.setdefault(p, set()).add(n)
    own = parts_of(target)

    def told() -> Iterator[str]:
        yield from (p for p in own if len(fitting[p]) == 1)
        joined = {}
        for a, b in combinations(own, 2):
            if not (a[0].isalpha() and b[0].isalpha()):
                first, second = (b, a) if b[0].isalpha() else (a, b)
                joined[first + second] = fitting[a] & fitting[b]
                if len(joined[first + second]) == 1:
                    yield first + second
        line, here = [], target
        while (here := above.get(here)) is not None and here is not root:
            line.append(here)
        for up in line:
            for p in parts_of(up):
                tops = fitting[p]
                for q, hits in [*((q, fitting[q]) for q in own), *joined.items()]:
                    below = [n for n in hits if _has_above(n, tops, above)]
                    if len(below) == 1:
                        yield f"{p} {q}"
                        if target in up:
                            yield f"{p} > {q}"
                    elif target in up and sum(above.get(n) in tops for n in hits) == 1:
                        yield f"{p} > {q}"

    return min(told(), key=lambda s: (len(s), s), default=None) or _path(root, target, above)


def _has_above(node: Element, tops: set[Element], above: dict[Element, Element]) -> bool:
    here: Element | None = node
    while (here := above.get(here)) is not None:
        if here in tops:
            return True
    return False


def _path(root: Element, target: Element, above: dict[Element, Element]) -> str:
    """A path of tags and places from the page's top, which nothing else fits."""
    steps, here = [], target
    while here is not root:
        steps.append(f"{here.tag if here.tag[0].isalpha() else '*'}:nth-child({list(above[here]).index(here) + 1})")
        here = above[here]
    return " > ".join(["> " + steps[-1], *steps[-2::-1]])


def disabled(node: Element) -> bool:
    """Whether an element says that it can't be used."""
    return "disabled" in node.attrib or node.get("aria-disabled", "").lower() == "true" or any(c in DISABLED for c in node.get("class", "").lower().split())


def next_selectors(pages: DataFrame) -> DataFrame:
    """(page_id, strategy, selector, disabled) of the pages (page_id, html); null where no strategy finds an element."""

    def told(html: str) -> tuple:
        root = parse(html)
        strategy, node = next_element(root)
        return (None, None, None) if node is None else (strategy, shortest_selector(root, node), disabled(node))

    def run(batches):
        for batch in batches:
            found = [told(h or "") for h in batch.column("html").to_pylist()]
            strategy, selector, off = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(strategy, pa.string()), pa.array(selector, pa.string()), pa.array(off, pa.bool_())], names=["page_id", "strategy", "selector", "disabled"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, strategy string, selector string, disabled boolean")
