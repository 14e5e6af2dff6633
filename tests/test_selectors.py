"""Selectors of the next page's element: each finds that element and nothing else, and none of its kind is shorter."""

import random
from itertools import combinations

import pytest

from bidflow.sources.markup import parse, selected
from bidflow.sources.selectors import disabled, next_element, parts_of, shortest_selector

CASES = [
    ('<a aria-label="Previous page" href=1>x</a><a aria-label="Next page" href=2>y</a>', "aria", None),
    ('<button title="Go to the next one">y</button>', "title", "button"),
    ('<p><button><img alt="arrow_forward"></button><button><i class="x"></i></button>', "icon", None),
    ('<ul><li><a href="/1"><svg class="chevron-right"></svg></a></ul>', "icon", "a"),
    ('<div class="pager"><a href="/p/1">1</a><a href="/p/2"><span> Next </span></a></div>', "text", '[href="/p/2"]'),
    ("<a href=1>‹</a><a href=2>›</a>", "text", "[href=\"2\"]"),
    ('<a class="pagination-prev">a</a><a class="pagination-next">b</a>', "class", ".pagination-next"),
    ('<a href=1>1</a><a rel="next" href=2>2</a>', "rel", "[rel]"),
    ('<b data-testid="pager-next-link">2</b><b data-testid="x">2</b>', "data", None),
    ('<p>nothing <a href="x">here</a></p><script>next</script>', None, None),
    ("", None, None),
]


@pytest.mark.parametrize("html,strategy,selector", CASES)
def test_strategies(html, strategy, selector):
    root = parse(html)
    found, node = next_element(root)
    assert found == strategy
    if node is not None:
        made = shortest_selector(root, node)
        assert selected(root, made) == [node]
        assert selector is None or made == selector


def page(rng):
    def one(depth):
        tag = rng.choice(["div", "ul", "li", "a", "span", "p"])
        attributes = rng.choice(["", "", ' class="x"', ' class="x y"', ' class="z"', f' id="i{rng.randrange(9)}"', ' rel="next"', f' href="/{rng.randrange(4)}"'])
        return f"<{tag}{attributes}>{''.join(one(depth - 1) for _ in range(rng.randrange(4))) if depth else 't'}</{tag}>"

    return "".join(one(4) for _ in range(3))


def test_unique_and_shortest():
    rng = random.Random(2)
    paths = 0
    for _ in range(40):
        root = parse(page(rng))
        nodes = list(root.iter())[1:]
        for node in rng.sample(nodes, min(6, len(nodes))):
            made = shortest_selector(root, node)
            assert selected(root, made) == [node], made
            paths += made.startswith(">")
            own = parts_of(node)
            plain = own + [a + b for a, b in combinations(own, 2) if not b[0].isalpha()]
            shorter = [s for s in plain if len(s) < len(made) and selected(root, s) == [node]]
            assert not shorter, (made, shorter)
    assert paths > 0  # equal elements side by side have no other selector


def test_disabled():
    for html, off in (("<a disabled>", True), ('<a aria-disabled="TRUE">', True), ('<a class="btn Disabled">', True), ('<a class="enabled">', False)):
        assert disabled(parse(html)[0]) is off
