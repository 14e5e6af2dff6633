"""Money as portals print it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidflow.functions.text import bound

# Codes, and symbols of which the first that occurs decides.
CODES = ["AUD", "CAD", "CHF", "CNY", "EUR", "GBP", "INR", "JPY", "USD"]
SYMBOLS = [("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR")]
LONGEST_FIRST = [("US$", "USD"), ("CA$", "CAD"), ("AU$", "AUD"), ("C$", "CAD"), ("A$", "AUD"), *SYMBOLS]


def number_compat(v: Column) -> Column:
    """The last of comma and point is the decimal one: ``1,234`` is 1.234."""
    comma, point = F.instr(F.reverse(v), ","), F.instr(F.reverse(v), ".")
    european = (comma > 0) & ((point == 0) | (comma < point))
    text = F.when(european, F.replace(F.replace(v, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(v, F.lit(","), F.lit("")))
    return text.try_cast("double")


def number_fixed(v: Column) -> Column:
    """Separators before groups of three alone are thousands."""
    return F.when(v.rlike(r"^\d{1,3}(,\d{3})+$"), F.replace(v, F.lit(","), F.lit("")).try_cast("double")).when(v.rlike(r"^\d{1,3}(\.\d{3}){2,}$"), F.replace(v, F.lit("."), F.lit("")).try_cast("double")).otherwise(number_compat(v))


def parse_money(c: Column, compat: bool = False, default: str = "USD") -> Column:
    """Struct of amount, currency and confidence.

    compat keeps two traits of older readers: any ``$`` is USD, and a lone comma is a decimal one.
    """
    number, symbols = (number_compat, SYMBOLS) if compat else (number_fixed, LONGEST_FIRST)
    span, scaled, plain = r"([\d,.]+)\s*(?:-)\s*([\d,.]+)", r"([\d,.]+)\s*([KMB])\b", r"[\d,.]+"

    def amounts(bare: Column) -> Column:
        low, high = (bound(F.regexp_extract(bare, span, i), number) for i in (1, 2))
        unit = F.regexp_extract(bare, scaled, 2)
        times = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9)
        ranged = F.when(bare.rlike(span), (low + high) / 2)
        sized = F.when(bare.rlike(scaled), bound(F.regexp_extract(bare, scaled, 1), number) * times)
        return F.struct(ranged.alias("ranged"), F.coalesce(sized, bound(F.regexp_extract(bare, plain, 0), number)).alias("single"))

    def parsed(text: Column) -> Column:
        code = F.coalesce(*(F.when(F.contains(text, F.lit(k)), F.lit(k)) for k in CODES))
        symbol = F.coalesce(*(F.when(F.contains(text, F.lit(s)), F.lit(k)) for s, k in symbols))
        marks = "|".join(re.escape(s) for s in [*CODES, *sorted((s for s, _ in symbols), key=len, reverse=True)])
        found = F.struct(symbol.alias("symbol"), code.alias("code"), bound(F.regexp_replace(text, marks, ""), amounts).alias("of"))

        def told(x: Column) -> Column:
            sure = F.when(x["symbol"].isNotNull(), 0.9).when(x["code"].isNotNull(), 0.95).otherwise(0.8)
            ranged, amount = x["of"]["ranged"], F.coalesce(x["of"]["ranged"], x["of"]["single"])
            sure = F.when(amount.isNull(), 0.0).when(ranged.isNotNull(), sure * 0.9).otherwise(sure)
            return F.struct(amount.alias("amount"), F.coalesce(x["symbol"], x["code"], F.lit(default)).alias("currency"), sure.alias("confidence"))

        return bound(found, told)

    return bound(F.upper(F.trim(c)), parsed)


def compact(v: Column) -> Column:
    return F.when(v >= 1e6, F.format_string("$%.1fM", v / 1e6)).when(v >= 1e3, F.format_string("$%.0fK", v / 1e3)).otherwise(F.format_string("$%.0f", v))
