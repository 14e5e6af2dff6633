"""Small tables with what operators have to bear: nulls, empties, copies, repeated rows, hot groups, clashing columns."""

import random

WORDS = [a + b + c for a in "bdfgklmn" for b in "aeiou" for c in ("r", "st", "nd", "x9", "lt", "sh", "p", "tum", "rk", "z")] + ["Zürich", "naïve", "日本"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, many):
    words = text.split()
    for _ in range(many):
        words[rng.randrange(len(words))] = "x" + "".join(rng.choice("abcdefgh") for _ in range(8))
    return " ".join(words)


def texts(seed=1):
    """(doc_id, text): groups of copies of several sizes, edits, shared passages, odd texts."""
    rng = random.Random(seed)
    out = [prose(rng, rng.randrange(1, 160)) for _ in range(60)]
    base = prose(rng, 120)
    out += [base] * 25 + [edited(rng, base, rng.randrange(1, 9)) for _ in range(60)]
    for _ in range(6):
        one = prose(rng, 90)
        out += [one, edited(rng, one, 2), one + "\n" + prose(rng, 8)]
    passage = prose(rng, 50)
    out += [f"{prose(rng, 40)}\n{passage}\n{prose(rng, 30)}" for _ in range(20)]
    out += ["same " * 80, "a b " * 60, "", " \t\n", None, "one", "Ä", "two words", " ", passage + " " + passage, prose(rng, 6000)]
    rng.shuffle(out)
    rows = [(i * 3 + 1, t) for i, t in enumerate(out)]
    return rows + [rows[5], rows[5], (None, out[7]), (None, None)]


def frame(spark, rows, extra=True):
    """rows as documents, with columns whose names clash with those of results."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "'x' as score", "'y' as key", "1 as kept", "null as lines", "'z' as n_words") if extra else df
