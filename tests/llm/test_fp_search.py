"""Ranked lexical search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from bidflow.llm import fp_search
from bidflow.llm.queries import oracle_sql
from tests.compare import SF_DIR, database, rows
from tests.llm.data import frame, prose, texts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=20):
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    big_n, big_l = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if i is not None and t is not None}:
        found = []
        for doc_id, c, n in held:
            m = 75 + 25 * n * big_n // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def search(spark, docs, items, **more):
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as score", "1 as item", "2 as rank")
    return sorted((tuple(r) for r in fp_search.search(frame(spark, docs), table, **more).collect()), key=str)


def some_items(docs):
    rng = random.Random(3)
    cut = [" ".join(t.split()[:30]) for _, t in docs if t and len(t) > 200][:6]
    return list(enumerate(cut)) + [(50, prose(rng, 40)), (51, cut[0].upper() + "!"), (52, "nothing-that-occurs qqqq"), (53, ""), (54, None), (55, " \n"), (56, "a"), (57, "ZÜRICH naïve 日本 _x_"), (0, cut[0]), (1, cut[2]), (None, "a b"), (58, "a a a b " * 30)]


@pytest.mark.parametrize("tree_terms,abreast,cells,item_bytes", [(400_000, 256, 1 << 22, 2 << 20), (60, 3, 1 << 22, 2 << 20), (1, 256, 150, 900)])
def test_whole_tables(spark, monkeypatch, tree_terms, abreast, cells, item_bytes):
    for name, v in (("TREE_TERMS", tree_terms), ("ABREAST", abreast), ("CELLS", cells), ("ITEM_BYTES", item_bytes)):
        monkeypatch.setattr(fp_search, name, v)
    docs = texts()
    items = some_items(docs)
    assert search(spark, docs, items) == plain(docs, items)


def test_few_and_many_bests(spark):
    docs = texts(9)
    items = some_items(docs)
    assert search(spark, docs, items, k=1) == plain(docs, items, 1)
    assert search(spark, docs, items, k=500) == plain(docs, items, 500)


def test_items_abreast():
    many = lambda *sizes: [(np.arange(n), np.ones(n)) for n in sizes]
    groups = list(fp_search.abreast(many(*[40] * 600)))
    assert groups[0] == (0, 256) and groups[-1][1] == 600 and all(a[1] == b[0] for a, b in zip(groups, groups[1:]))
    assert list(fp_search.abreast(many(5_000_000, 3, 5_000_000))) == [(0, 1), (1, 2), (2, 3)] and list(fp_search.abreast(many(7))) == [(0, 1)]


def test_empty_tables(spark):
    assert search(spark, [], [(1, "a b")]) == search(spark, [(1, "a b")], []) == search(spark, [(1, None), (2, " ")], [(1, "a")]) == []


def test_trees_hold_their_documents():
    rng = random.Random(6)
    docs = []
    for i in range(300):
        ranks = np.flatnonzero([rng.random() < 0.3 for _ in range(12)]) if i % 3 else np.arange(rng.randrange(1, 12))
        if len(ranks):
            docs.append((i, rng.randrange(75, 900), ranks.astype(">u4").tobytes(), np.array([rng.randrange(1, 9) for _ in ranks])))
    tree = fp_search.Tree(list(docs))
    under = {}

    def walk(node):
        if node < len(tree.leaves):
            under[node] = list(tree.leaves[node][0])
        else:
            under[node] = [i for n in tree.children[node] for i in walk(n)]
        return under[node]

    assert sorted(walk(tree.root)) == sorted(d[0] for d in docs)
    by = {d[0]: (d[1], dict(zip(np.frombuffer(d[2], ">u4").tolist(), d[3].tolist()))) for d in docs}
    for node, ids in under.items():
        assert tree.least[node] == min(by[i][0] for i in ids)
        most = {}
        for i in ids:
            for t, tf in by[i][1].items():
                most[t] = max(tf, most.get(t, 0))
        assert dict(zip(tree.maxima[node][0].tolist(), tree.maxima[node][1].tolist())) == most
        if node >= len(tree.leaves) and node != tree.root:  # siblings share a path
            heads = [sorted(by[i][1]) for i in ids]
            assert len({h[0] for h in heads}) == 1


def test_subtrees_are_left_out():
    """Of documents of two kinds, those that share no term with the item are one look at their subtree."""
    docs = [(i, 100, np.array([0, 5 + i % 40] if i < 200 else [1, 60 + i % 40]).astype(">u4").tobytes(), np.array([1, 1])) for i in range(400)]
    weights = np.zeros((100, 1), np.int64)
    weights[0], weights[7] = 10, 900
    tree, bests = fp_search.Tree(docs), fp_search.Bests(1, 3)
    seen = fp_search.descend(tree, weights, np.arange(1), bests)
    assert sorted(-e[1][1] for e in bests.held[0]) == [2, 42, 82] and seen < 50 < len(tree.maxima)


def test_query_equals_sql(spark):
    assert rows(fp_search.op11_fp_search(spark, SF_DIR).toPandas()) == rows(database().sql(oracle_sql()["op11_fp_search"]).df())
