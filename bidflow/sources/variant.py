"""Records of pages that are JSON, by Spark's VARIANT: payloads of mixed shape without a schema and without Python.

A list gives its objects; an object gives those at the first hint or known key that holds some, else
itself. Each object's fields are the first filled of their names; what is an object itself gives its name, value or
text. Numbers are told as Spark prints them; zero, false, null, empty texts and lists count as not filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidflow.functions.text import absolute, bound
from bidflow.sources.html import COLUMNS, LISTS, PROPERTIES

CONFIDENCE = 0.9


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


#: The type of an object whose parts are looked up one by one.
OBJECT = "map<string, variant>"
RECORDS = f"array<struct<{', '.join(f'{f}: string' for f in PROPERTIES)}>>"
_NAMES = [n for names in PROPERTIES.values() for n in names]


def _filled(v: Column, inner: bool = True) -> Column:
    """A text or number that is filled, as text; of an object, with inner, its first filled part."""
    text = v.try_cast("string")
    number = lambda t: F.when(t.try_cast("double") != 0, t)
    parts = F.coalesce(*(_filled(_get(v, f"$.{part}"), False) for part in ("name", "value", "text"))) if inner else F.lit(None).cast("string")
    told = lambda kind: F.when(kind == "STRING", F.nullif(text, F.lit(""))).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), bound(text, number)).when((kind == "BOOLEAN") & (text == "true"), F.lit("True")).when(kind.startswith("OBJECT"), parts)
    return bound(F.schema_of_variant(v), told)


def record_of(item: Column) -> Column:
    """Struct of the fields of an object (its parts by name); each part is read once."""
    texts = F.transform_values(F.map_filter(item, lambda name, _: name.isin(_NAMES)), lambda _, v: _filled(v))
    return bound(texts, lambda t: F.struct(*(F.coalesce(*(F.try_element_at(t, F.lit(n)) for n in names)).alias(field) for field, names in PROPERTIES.items())))


def _path(hint: str) -> str:
    """A dotted path with places in lists as Spark writes it."""
    return "$" + "".join(f"[{key}]" if key.isdigit() else f".{key}" for key in hint.split("."))


def candidates(payload: Column, hints: tuple = ()) -> Column:
    """Array of the lists of objects that a payload may tell its records by, in the order in which they are tried."""
    listed = lambda v: F.coalesce(v.try_cast("array<variant>"), F.when(v.try_cast(OBJECT).isNotNull(), F.array(v)))
    at = [*(listed(_get(payload, _path(h))) for h in hints), *(_get(payload, f"$.{key}", "array<variant>") for key in LISTS), listed(payload)]
    whole = payload.try_cast("array<variant>")
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.array_compact(F.array(*at)))


def json_records(pages: DataFrame, hints: tuple = ()) -> DataFrame:
    """One row per record of the pages (page_id, url, html) that are JSON, with the columns of html.extract."""
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.try_parse_json("html").alias("payload"))
    filled = lambda r: F.coalesce(*(r[f] for f in PROPERTIES)).isNotNull()
    objects = lambda items: F.filter(F.transform(items, lambda v: v.try_cast(OBJECT)), lambda o: o.isNotNull())
    of = lambda items: bound(F.filter(F.transform(objects(items), record_of), filled), lambda x: F.when(F.size(x) > 0, x))
    # Lists after the first that gives records aren't looked into.
    first = F.aggregate(candidates(F.col("payload"), hints), F.lit(None).cast(RECORDS), lambda found, items: F.coalesce(found, of(items)))
    found = parsed.withColumn("records", first)
    # Outer, as Spark would else test the records for being some before a shuffle below, and so read the pages there, twice.
    rows = found.select("page_id", "url", F.posexplode_outer("records").alias("row_index", "r")).where("r is not null")
    told = {f: F.col(f"r.{f}") for f in PROPERTIES} | {"detail_url": absolute(F.col("url"), F.col("r.detail_url"))}
    return rows.select("page_id", F.lit("raw_json").alias("method"), F.lit(CONFIDENCE).alias("confidence"), "row_index", *((told[c] if c in told else F.lit(None).cast("string")).alias(c) for c in COLUMNS))


def shape(payloads: DataFrame, column: str, *by: str) -> DataFrame:
    """The schema that all payloads of a column of JSON texts fit, how many there are, and how many aren't JSON."""
    v = F.try_parse_json(column)
    return payloads.groupBy(*by).agg(F.schema_of_variant_agg(v).alias("shape"), F.count(column).alias("n"), F.count_if(F.col(column).isNotNull() & v.isNull()).alias("broken"))
