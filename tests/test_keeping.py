"""Cascades over small graphs, overlapping runs against counting, VARIANT records against the Python reader."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bidflow.operators import cascade, overlap
from bidflow.sources import html, variant


def test_two_ways_and_null_keys(spark):
    """A row that a cascade takes is gone whatever its other keys say; null keys name nothing."""
    keys = [cascade.Key("b", "a_id", "a", True), cascade.Key("c", "a_id", "a", False), cascade.Key("c", "b_id", "b", True), cascade.Key("d", "c_id", "c", True)]
    tables = {
        "a": spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, off boolean"),
        "b": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, a_id int"),
        "c": spark.createDataFrame([(20, 1, 11), (21, 2, 10), (22, 1, None), (23, None, None), (24, 3, 12)], "id int, a_id int, b_id int"),
        "d": spark.createDataFrame([(30, 21), (31, 22), (32, None)], "id int, c_id int"),
    }
    left, gone = cascade.delete(tables, "a", F.col("off"), keys)
    rows = {n: sorted((tuple(r) for r in df.collect()), key=str) for n, df in left.items()}
    assert rows == {"a": [(2, False), (3, None)], "b": [(11, 2), (12, None)], "c": [(20, None, 11), (22, None, None), (23, None, None), (24, 3, 12)], "d": [(31, 22), (32, None)]}
    assert {n: sorted(r[0] for r in df.collect()) for n, df in gone.items()} == {"a": [1], "b": [10], "c": [21], "d": [30]}


def test_order_and_cycles():
    order = cascade.order_of(cascade.KEYS)
    assert all(order.index(k.parent) < order.index(k.table) for k in cascade.KEYS)
    with pytest.raises(ValueError):
        cascade.order_of([cascade.Key("a", "x", "b", True), cascade.Key("b", "x", "a", True)])


def test_overlaps(spark):
    rng, zero = random.Random(3), datetime(2024, 1, 1)
    at = lambda m: zero + timedelta(minutes=m)
    runs = [("hot", s := rng.randrange(3000), s + rng.randrange(0, 400)) for _ in range(300)] + [("few", 0, 10), ("few", 10, 20), ("few", 21, 21), ("one", 5, 5)]
    odd = [("one", 9, 3), ("none", None, 5), ("none", 5, None)]
    frame = spark.createDataFrame([(k, a if a is None else at(a), b if b is None else at(b)) for k, a, b in runs + odd], "k string, started_at timestamp_ntz, finished_at timestamp_ntz")
    for width in (60, 7200, 10_000_000):
        got = {r["k"]: tuple(r)[1:] for r in overlap.overlapping(frame, "k", limit=1, slice_seconds=width).collect()}
        for key in ("hot", "few", "one"):
            own = [(a, b) for k, a, b in runs if k == key]
            level = {t: sum(a <= t <= b for a, b in own) for t in range(3500)}
            most = max(level.values())
            assert got[key][:2] == (most, at(min(t for t in level if level[t] == most))), key
            # between two whole minutes that both belong to a run, the run holds; each end takes a microsecond more
            ends = sorted({a * 60_000_000 for a, _ in own} | {b * 60_000_000 + 1 for _, b in own})
            over = sum(y - x for x, y in zip(ends, ends[1:]) if sum(a * 60_000_000 <= x <= b * 60_000_000 for a, b in own) > 1)
            assert got[key][2] == over, key
        assert set(got) == {"hot", "few", "one"}


def test_variant_equals_python(spark):
    items = [{"id": 5, "title": {"name": "", "value": "V"}, "buyer": "", "organization": "o", "url": "/x"}, {"number": "n", "name": [1], "budget": 1.5, "type": True, "href": "y?z"}, {"other": 1}, 7, None]
    payloads = [items, {"results": [], "items": items[:1]}, {"data": {"rows": [items[1]]}, "bids": items}, items[0], {"a": 1}, [], "text", 5, None, {"records": "no", "listings": [1]}, {"data": [{}], "results": items[:2]}]
    texts = [json.dumps(p) for p in payloads] + ["{broken", "", None, "<p>x</p>", " " + json.dumps(items)]
    pages = spark.createDataFrame([(i, "https://e.org/list/p?q=1", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    for hints in ((), ("data.rows",), ("data.rows.0", "items")):
        got = sorted((tuple(r) for r in variant.json_records(pages, hints).collect()), key=str)
        wanted = sorted((tuple(r) for r in html.extract(pages, 0.4, hints).where("method = 'raw_json'").collect()), key=str)
        assert got == wanted and len(got) > 5
