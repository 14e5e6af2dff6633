"""Fingerprints and keys of opportunities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a fingerprint covers, in this order.
CONTENT = ["external_id", "title", "description", "status", "category", "agency", "closing_at", "estimated_value"]


def as_text(name: str, kind: str) -> Column:
    """A column as text: timestamps to the second, numbers with two decimals."""
    c = F.col(name)
    if kind.startswith("timestamp"):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if kind in ("double", "float") or kind.startswith("decimal"):
        return F.when(c != 0, c.cast("decimal(20,2)").cast("string"))
    return c.cast("string")


def fingerprint(df, missing: str = "") -> Column:
    """First 32 hex digits of the SHA-256 of the content; ``missing`` stands for nulls."""
    kinds = dict(df.dtypes)
    parts = [F.coalesce(as_text(c, kinds[c]), F.lit(missing)) if c in kinds else F.lit("") for c in CONTENT]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def dedupe_id(external_id: Column, *parts: Column, length: int = 16) -> Column:
    """The external id, or so many hex digits of the MD5 of some parts (16 of title, closing date and agency; rows that are saved take 12 of title and closing date)."""
    text = F.concat(*(F.coalesce(p, F.lit("")) for p in parts))
    return F.coalesce(F.nullif(external_id, F.lit("")), F.substring(F.md5(text), 1, length))


def json_text(c: Column) -> Column:
    """A JSON string of ASCII letters alone."""
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    short = F.create_map(*(F.lit(x) for x in ("\n", "\\n", "\r", "\\r", "\t", "\\t", "\b", "\\b", "\f", "\\f")))

    def one(x: Column) -> Column:
        n = F.ascii(x)
        wide = F.concat(unit(F.shiftright(n - 65536, 10) + 0xD800), unit((n - 65536).bitwiseAND(1023) + 0xDC00))
        return F.when(n.between(32, 126), x).otherwise(F.coalesce(F.try_element_at(short, x), F.when(n > 65535, wide).otherwise(unit(n))))

    odd = F.array_join(F.transform(F.split(plain, ""), one), "")
    return F.concat(F.lit('"'), F.when(plain.rlike(r"[^\x20-\x7E]"), odd).otherwise(plain), F.lit('"'))


# What the key of a stored listing covers, in this order.
STABLE = ["agency", "external_id", "posted_at", "title"]


def stable_fingerprint(df) -> Column:
    """First 16 hex digits of the SHA-256 of a JSON object of the stable fields that are filled."""
    kinds = dict(df.dtypes)
    pairs = [F.when(F.coalesce(as_text(c, kinds[c]), F.lit("")) != "", F.concat(F.lit(f'"{c}": '), json_text(as_text(c, kinds[c])))) for c in STABLE]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}")), 256), 1, 16)
