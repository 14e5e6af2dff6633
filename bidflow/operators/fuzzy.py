"""Join of texts that are alike: by their longest common subsequence, in percent of both lengths.

Two texts of lengths n and m with a score of ``least`` or more share that many letters at least: o =
ceil((2 least - 1)(n + m) / 400). A text's letters, numbered where they repeat, are put in a fixed order,
rare ones first; if two texts share o letters they share one among the first of each, so only a
prefix of each text's letters is joined (grams of one letter: at 75, longer grams may all be broken by the
differences allowed). Lengths, and the places of the first shared letter, leave out most of the
pairs that meet; the subsequence itself is found for the rest, once a pair, 64 letters and more at a time.

Scores are rounded, halves to even. Empty and null texts are like nothing; a text that repeats is joined once.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters from the most to the least frequent; others are rarer.
FREQUENT = " etaoinsrhldcumfpgwybvkxjqz"


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence: a bit for each letter of a, all moved on together by each letter of b."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for y in b:
        hit = row & places.get(y, 0)
        row = (row + hit | row - hit) & every
    return len(a) - row.bit_count()


def similarity(a: str, b: str) -> int:
    return round(200 * lcs(a, b) / max(1, len(a) + len(b)))


def needed(n: Column, m: Column, least: int) -> Column:
    """Letters that texts of two lengths share at least."""
    return F.ceil((n + m) * (2 * least - 1) / 400)


def _letters(text: str) -> list[str]:
    """A text's letters with their numbers, rare ones first."""
    seen: Counter = Counter()
    found = []
    for x in text:
        seen[x] += 1
        rank = FREQUENT.find(x)
        found.append((-(len(FREQUENT) if rank < 0 else rank) - 6 * (seen[x] - 1), f"{x}{seen[x]}"))
    return [x for _, x in sorted(found)]


def prefixes(texts: DataFrame, least: int) -> DataFrame:
    """(text, n, letter, place) of the letters of each distinct text that have to be joined."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                n = len(text)
                most = n - -(-(2 * least - 1) * n // (401 - 2 * least)) + 1  # a partner shares so many letters at least, however short it is
                rows += [(text, n, letter, i) for i, letter in enumerate(_letters(text)[:most])]
            text, n, letter, place = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(n, pa.int32()), pa.array(letter, pa.string()), pa.array(place, pa.int32())], names=["text", "n", "letter", "place"])

    return texts.where("text <> ''").distinct().mapInArrow(run, "text string, n int, letter string, place int")


def similar(left: DataFrame, right: DataFrame, least: int = 75) -> DataFrame:
    """(a, b, score) of all texts of left and right (one column each) whose score is least or more."""

    @F.pandas_udf("int")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")

    sides = [prefixes(df.select(F.col(df.columns[0]).alias("text")), least) for df in (left, right)]
    a, b = (side.select(F.col("text").alias(name), F.col("n").alias(f"n{name}"), "letter", F.col("place").alias(f"p{name}")) for side, name in zip(sides, "ab", strict=True))
    o = needed(F.col("na"), F.col("nb"), least)
    may = (F.least("na", "nb") >= o) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= o)
    pairs = a.join(b, "letter").where(may).select("a", "b").distinct()
    return pairs.withColumn("score", score("a", "b")).where(F.col("score") >= least)


def best(left: DataFrame, right: DataFrame, rank: str, least: int = 75) -> DataFrame:
    """Of each text of left (one column) the most similar text of right (its first column): a, b, score and the other columns of right; of equals, that of least rank."""
    name, *others = right.columns
    ranked = similar(left, right.select(name), least).join(right.withColumnRenamed(name, "b"), "b")
    top = ranked.groupBy("a").agg(F.max_by(F.struct("b", "score", *others), F.struct(F.col("score"), -F.col(rank))).alias("m"))
    return top.select("a", "m.*")
