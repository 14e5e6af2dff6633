"""Text columns: white space, entities, URLs, display forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entities that are decoded, in this order.
ENTITIES = [("&nbsp;?", " "), ("&amp;?", "&"), ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "'")]
#: Runs of Unicode white space that aren't one blank already.
SPACES = r"(?U)[^\S ]\s*| \s+"
URL = r"https?://[^\s<>\"'{}|\\^`\[\]]+"


def bound(value: Column, use) -> Column:
    """use(value), with value found once however often it is used.

    As the end of a fold over nothing: an element of a transformed array is read by its type, which Spark derives anew from all of use in every row.
    """
    return F.aggregate(F.array(), value, lambda x, _: x, lambda x: use(x))


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with more columns that are computed once a row, however often they are used later (Spark would inline them)."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, a few tasks each, before heavy projections, where it is read from fewer files than there are cores: a file of one row group is read by one task, however many rows it has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if len(df.inputFiles()) < cores else df


def normalize_whitespace(c: Column) -> Column:
    """Runs of any Unicode white space become one blank; null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(c, SPACES, " ")), F.lit(""))


def clean_html_text(c: Column) -> Column:
    return normalize_whitespace(F.when(F.contains(c, F.lit("&")), reduce(lambda x, e: F.regexp_replace(x, e[0], e[1]), ENTITIES, c)).otherwise(c))


def first_url(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, URL, 0), F.lit(""))


def shortened(c: Column, most: int, tail: str = "...") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - len(tail)), F.lit(tail))).otherwise(c)


# How many letters lists, samples and previews show of a text.
SHOWN = {"title": 50, "agency": 30, "preview": 40, "sample": 100}
DETAIL = 2000


def detail_text(c: Column) -> Column:
    """The first DETAIL letters of a description; the mark of what is left out comes on top."""
    return F.when(F.length(c) > DETAIL, F.concat(F.substring(c, 1, DETAIL), F.lit("..."))).otherwise(c)


def first_filled(*columns) -> Column:
    """The first that is neither null nor empty; white space counts as filled."""
    return F.coalesce(*(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns))


def host_of(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def slug_of(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"[.\-]", "_")


def absolute(url: Column, link: Column) -> Column:
    """A link against the page's address; dots in paths stay as they are."""
    part = lambda pattern: F.regexp_extract(url, pattern, 1)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(part("^([A-Za-z][A-Za-z0-9+.-]*:)"), link))
        .when(link.startswith("/"), F.concat(part("^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"), link))
        .when(link.startswith("?"), F.concat(part("^([^?#]*)"), link))
        .when(link.startswith("#"), F.concat(part("^([^#]*)"), link))
        .otherwise(F.concat(F.coalesce(F.nullif(part("^([^?#]*//[^?#]*/)"), F.lit("")), F.concat(part("^([^?#]*)"), F.lit("/"))), link))
    )
