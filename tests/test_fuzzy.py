"""The similarity join against all pairs."""

import random

from bidflow.operators import fuzzy


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def some(rng, n, long):
    out = []
    for _ in range(n):
        base = "".join(rng.choice("aaabcdeé x日") for _ in range(rng.randrange(1, long)))
        out += [base, "".join(x for x in base if rng.random() > 0.2), base[::-1], base + rng.choice("qz")]
    return out


def test_lcs():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc\U0001f600") for _ in range(rng.randrange(90))) for _ in range(2))
        assert fuzzy.lcs(a, b) == plain_lcs(a, b)


def test_equals_all_pairs(spark):
    rng = random.Random(5)
    left, right = some(rng, 30, 12) + ["", None, "same", "same"], some(rng, 25, 25) + ["", None, "same", "\U0001f600\U0001f600b"]
    frames = [spark.createDataFrame([(x,) for x in side], "t string") for side in (left, right)]
    for least in (60, 75, 90, 100):
        wanted = {(a, b, s) for a in set(left) if a for b in set(right) if b if (s := round(200 * plain_lcs(a, b) / (len(a) + len(b)))) >= least}
        got = fuzzy.similar(*frames, least).collect()
        assert {tuple(r) for r in got} == wanted and len(got) == len(wanted)


def test_most_pairs_never_meet(spark):
    """Of texts that are unlike, the filters leave few pairs to compare."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(400)]
    frame = spark.createDataFrame([(x,) for x in texts], "t string")
    a, b = (fuzzy.prefixes(frame.withColumnRenamed("t", "text"), 90).alias(x) for x in "ab")
    assert a.count() < 400 * 4
    assert {(r["a"], r["b"]) for r in fuzzy.similar(frame, frame, 90).collect()} == {(x, x) for x in texts}


def test_best(spark):
    left = spark.createDataFrame([("agencies",), ("zzz",)], "t string")
    right = spark.createDataFrame([("agency", 2, "x"), ("agencie", 1, "y"), ("gencies", 0, "z")], "name string, rank int, field string")
    assert [tuple(r) for r in fuzzy.best(left, right, "rank").collect()] == [("agencies", "gencies", 93, 0, "z")]
