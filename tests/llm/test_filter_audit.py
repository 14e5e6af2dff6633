"""The filter audit against a plain count of every document at every step."""

import random
from itertools import permutations

from bidflow.llm import filter_audit
from bidflow.llm.queries import oracle_sql
from tests.compare import SF_DIR, database, rows
from tests.llm.data import prose


def plain(docs, labels):
    """Rows by walking every document through every order."""
    good, toxic = ({i for i, *told in labels if told[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = {}
    for i, text, part in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ") if w]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and i > least[text],
        }
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, letter in enumerate(order, 1):
                row = out.setdefault((part or "", order, step), [0] * 6)
                removed = fails[letter] and not gone
                row[0] += not fails[letter] and not gone
                row[1] += removed
                row[2] += fails[letter] and gone
                row[3] += [k for k in "ABCDE" if fails[k]] == [letter]
                row[4] += removed and i in good
                row[5] += removed and i in toxic
                gone |= fails[letter]
    shapley = {}
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + row[1]
    return {k: (*row, shapley[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def small():
    rng = random.Random(4)
    texts = [prose(rng, n) for n in (5, 199, 200, 260, 900)] + ["WORD " * 210, "a " * 400, prose(rng, 220) + " 5 % |", "", None, " \t\n", "É" * 30, prose(rng, 30_000)]
    docs = [(3 * k + j, t, part) for j, part in enumerate(("web", None, "")) for k, t in enumerate(texts)] + [(500 + k, texts[2], "copies") for k in range(40)]
    docs += [docs[7], docs[7], (None, texts[3], "web"), (None, texts[3], "web"), (None, None, None), (900, "only null ids have it once more", "x"), (None, "only null ids have it once more", "x")]
    labels = [(i, i % 2, i % 3 == 0) for i, _, _ in docs[:30] if i is not None] + [(500, 1, None), (500, 0, 1), (None, 1, 1), (77777, 1, 1)]
    return docs, [(i, q, None if t is None else int(t)) for i, q, t in labels]


def frames(spark, docs, labels):
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "'x' as part", "1 as mask", "'y' as digest", "0 as good", "'z' as firsts")
    return table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as part", "'e' as source", "9 as mask")


def test_every_order_and_step(spark, monkeypatch):
    docs, labels = small()
    monkeypatch.setattr(filter_audit, "HELD", 2)
    found = filter_audit.audit(*frames(spark, docs, labels)).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found} == plain(docs, labels)
    assert len(found) == 600 * 4


def test_fields_do_not_overflow():
    many = (1 << 62) + 12345
    total = filter_audit.packed(31 | filter_audit.GOOD | filter_audit.TOXIC) * many
    assert total.bit_length() <= 64 * filter_audit.FIELDS
    held = {total >> 64 * k & (1 << 64) - 1 for k in range(filter_audit.FIELDS)}
    assert held == {0, many}


def test_empty_tables(spark):
    docs, labels = small()
    none, few = frames(spark, [], []), frames(spark, docs[:3], labels)
    assert filter_audit.audit(none[0], few[1]).collect() == []
    assert filter_audit.audit(few[0], none[1]).count() == 600


def test_query_equals_sql(spark):
    name = "op13_filter_audit"
    assert rows(filter_audit.op13_filter_audit(spark, SF_DIR).toPandas()) == rows(database().sql(oracle_sql()[name]).df())
