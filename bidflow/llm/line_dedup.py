"""Line deduplication by a fixed-depth tree of line templates, in DataFrame functions alone.

A line goes down the tree by its number of tokens, then by its ``LEADING`` first tokens; tokens
with a digit (numbers, dates, ids) are variable fields. The leaves are templates: the tokens as
they are, and, for lines of ``GENERAL`` tokens or more, the tokens with one of three equal parts of
what follows the leading tokens generalised, so that lines that differ in one place share a
template. A template that occurs in ``min_docs`` documents or more recurs, one of ``LONG`` tokens or more
from ``LONG_DOCS`` documents on. Documents with the same set
of templates are copies and count as one document. The lines of a document
that many near copies were made of recur too; they tell by their documents, which consist of recurring
lines for the most part. So a recurring template is boilerplate, and its lines are dropped, only if
recurring lines make up at most ``most`` of the tokens of its documents on average. The decision is
the template's, hence the same in all copies, which stay copies for document deduplication.

Templates are compared by 64-bit hashes. Each distinct document counts once for a template, and counts are
aggregated before they are shuffled; texts are shuffled once, at the end.

Edge cases: a null text stays null and has no line; lines under ``min_tokens`` tokens and lines that are
variable fields for the most part (tables of numbers) are kept;
null ids are allowed; texts of any length are read whole, a document's lines in one row; copies of a document count once; an empty table gives an empty
result; other columns are ignored by :func:`recurring` and kept by :func:`drop_lines`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidflow.llm.common import read, stored

MIN_DOCS = 10
MIN_TOKENS = 3
LONG = 50
LONG_DOCS = 2
LEADING = 2
GENERAL = 8
MOST = 0.5
#: Stands for what follows a token's first digit, that digit included.
MARK = "\x01"


def templates(tokens: Column) -> Column:
    """Hashes of the templates of a line, from the hashes of its tokens: each part of the line is hashed once."""
    n = F.size(tokens)
    third = F.floor((n - LEADING) / 3).cast("int")
    part = lambda start, end: F.xxhash64(F.slice(tokens, start + 1, end - start))
    zero, lead = F.lit(0), F.lit(LEADING)
    parts = F.struct(part(zero, lead).alias("lead"), part(lead, lead + third).alias("a"), part(lead + third, lead + 2 * third).alias("b"), part(lead + 2 * third, n).alias("c"))
    general = F.transform(
        F.array(parts),
        lambda p: F.array(
            F.xxhash64(F.lit(0), n, p["lead"], p["a"], p["b"], p["c"]),
            F.xxhash64(F.lit(1), n, p["lead"], p["b"], p["c"]),
            F.xxhash64(F.lit(2), n, p["lead"], p["a"], p["c"]),
            F.xxhash64(F.lit(3), n, p["lead"], p["a"], p["b"]),
        ),
    )
    return F.when(n >= GENERAL, general[0]).otherwise(F.array(F.xxhash64(F.lit(0), n, tokens)))


def keyed(docs: DataFrame, min_tokens: int) -> DataFrame:
    """(did, th, lines, total, copy): the lines of docs (did, th, text) with their numbers, tokens and templates; all tokens; a hash of the set of templates."""
    # From its first digit on, a token becomes a mark; a token that ends in the mark is a variable field.
    text = F.regexp_replace("text", r"\d\S*+", MARK)
    for blank in "\t\x0b\f\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    field = F.lit(0).cast("long")
    hashed = lambda line: F.transform(F.array_remove(F.split(line, " "), ""), lambda t: F.when(t.endswith(MARK), field).otherwise(F.xxhash64(t)))
    n = lambda t: F.greatest(F.size(t), F.lit(1))
    fit = lambda t: (F.size(t) >= min_tokens) & (2 * F.size(F.array_remove(t, field)) >= F.size(t))
    lines = F.transform(F.transform(F.split(text, "\n", -1), hashed), lambda t, i: F.struct(i.alias("line"), n(t).alias("tokens"), F.when(fit(t), templates(t)).alias("keys")))
    every = docs.select("did", "th", lines.alias("lines"))
    some = every.select("did", "th", F.filter("lines", lambda x: x["keys"].isNotNull()).alias("lines"), F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("total"))  # a filter on lines would make Spark find them twice
    return some.withColumn("copy", F.xxhash64(F.sort_array(F.array_distinct(F.flatten(F.transform("lines", lambda x: x["keys"]))))))


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with did and th, which name a document by id and text."""
    return docs.withColumns({"did": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "th": F.xxhash64(text_col)})


def recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, most: float = MOST) -> DataFrame:
    """(did, th, lines): the boilerplate lines of each document."""
    named = identified(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    table = stored(keyed(named, min_tokens), "line-keys")
    # Copies are counted once: they neither make a template recur nor decide what becomes of it.
    distinct = stored(table.groupBy("copy").agg(F.first(F.struct("lines", "total")).alias("x")).select("copy", "x.*"), "distinct-documents")
    # A key with whether its line is long, which is the same for all lines of a template.
    long = F.transform("lines", lambda x: F.transform(x["keys"], lambda k: F.struct(k.alias("key"), (x["tokens"] >= LONG).alias("long"))))
    once = distinct.select(F.explode(F.array_distinct(F.flatten(long))).alias("x")).select("x.*")
    # Stored, so that the join reads both sides by shuffle and Spark can split a hot template.
    many = stored(once.groupBy("key", "long").agg(F.count("*").alias("docs")).where(F.col("docs") >= F.when(F.col("long"), min(LONG_DOCS, min_docs)).otherwise(min_docs)), "recurring-templates")
    # Narrow rows, line and tokens in one number; the same plan at every size, as recurring templates grow with the documents.
    each = distinct.select("copy", F.explode("lines").alias("x")).select("copy", (F.shiftleft(F.col("x.line").cast("long"), 31) + F.col("x.tokens")).alias("place"), F.explode("x.keys").alias("key"))
    found = stored(each.join(many.select("key").hint("merge"), "key"), "recurring-lines")
    tokens = F.sum(F.col("place").bitwiseAND((1 << 31) - 1)).alias("tokens")
    per_doc = found.groupBy("copy", "place").agg(F.lit(1).alias("one")).groupBy("copy").agg(tokens).join(distinct.select("copy", "total"), "copy")
    share = per_doc.select("copy", F.floor(1_000_000 * F.col("tokens") / F.col("total")).alias("share"))
    own = found.select("copy", "key").distinct().join(share, "copy")
    boilerplate = own.groupBy("key").agg(F.sum("share").alias("share"), F.count("*").alias("n")).where(F.col("share") <= int(most * 1_000_000) * F.col("n"))
    every = table.select("did", "th", F.explode("lines").alias("x")).select("did", "th", "x.line", F.explode("x.keys").alias("key"))
    lines = every.join(stored(boilerplate.select("key"), "boilerplate").hint("merge"), "key").select("did", "th", "line").distinct()
    return lines.groupBy("did", "th").agg(F.collect_list("line").alias("lines"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, most: float = MOST) -> DataFrame:
    """docs with the recurring lines gone from the text, and n_lines and n_dropped (names replaced if they occur)."""
    did, th, gone = (f"__{uuid.uuid4().hex}" for _ in range(3))  # names that no column has
    found = recurring(docs, id_col, text_col, min_docs, min_tokens, most).toDF(did, th, gone)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    key = (F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))) == F.col(did)) & (F.xxhash64(text_col) == F.col(th))
    joined = docs.select(*names).join(found.hint("merge"), key, "left")  # the same plan at every size
    text = F.col(text_col)
    kept = F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: lines[i]), "\n"))
    drops = F.col(gone).isNotNull()
    out = [F.when(drops, kept[0]).otherwise(text).alias(c) if c == text_col else F.col(c) for c in names]
    n_lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return joined.select(*out, n_lines.alias("n_lines"), F.when(drops, F.size(gone)).otherwise(0).cast("long").alias("n_dropped"))


def op8_template_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")
