"""Dates as portals print them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidflow.functions.text import SPACES, bound

# Prefixes that are removed in this order, and time zones that end a date.
PREFIXES = ["due:", "closes?:", "deadline:", r"closing\s+date:", r"open\s+until:", "posted:", "published:", "date:"]
LEADS = "(?i)^" + "".join(rf"(?:{p}\s*)?" for p in PREFIXES)
ZONES = "PT|PST|PDT|MT|MST|MDT|CT|CST|CDT|ET|EST|EDT"
# Pattern and confidence of each format; the first that gives a valid date wins.
ISO, SLASHED, US = r"^(\d{4})-(\d{2})-(\d{2})", r"^\d{1,2}/\d{1,2}/\d{2}", r"^(\d{1,2})/(\d{1,2})/(\d{4})"
FORMATS = {
    "iso8601": (ISO + r"T(\d{2}):(\d{2}):(\d{2})", 1.0),
    "iso_space": (ISO + r"\s+(\d{2}):(\d{2}):(\d{2})", 0.95),
    "iso_space_no_sec": (ISO + r"\s+(\d{2}):(\d{2})", 0.95),
    "iso_date": (ISO, 0.9),
    "us_datetime": (US + r"\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(AM|PM|am|pm)?", 0.85),
    "us_date": (US, 0.85),
    "us_date_short": (r"^(\d{1,2})/(\d{1,2})/(\d{2})\b", 0.75),
}


def clean_date_text(c: Column) -> Column:
    text = F.trim(c)
    text = F.when(F.contains(text, F.lit(":")), F.regexp_replace(text, LEADS, "")).otherwise(text)
    return F.trim(F.regexp_replace(F.regexp_replace(text, SPACES, " "), rf"(?i)\s+({ZONES})\s*$", ""))


def parse_date(c: Column) -> Column:
    """Struct of value, confidence and format; null and 0 where no format gives a valid date."""

    def of(text: Column) -> Column:
        # Fields that stand at fixed places are cut out there; white space is single blanks by now.
        part = lambda start, length: F.substring(text, start, length).try_cast("int")
        clock = lambda i: F.regexp_extract(text, FORMATS["us_datetime"][0], i)
        month, day = F.substring_index(text, "/", 1), F.substring_index(F.substring_index(text, "/", 2), "/", -1)
        year = lambda digits: F.substring(text, F.length(month) + F.length(day) + 3, F.lit(digits)).try_cast("int")

        def at(name: str, year: Column, month: Column, day: Column, hour: Column = F.lit(0), minute: Column = F.lit(0), second: Column = F.lit(0)) -> Column:
            value = F.when(text.rlike(FORMATS[name][0]), F.try_make_timestamp_ntz(year, month, day, hour, minute, second.cast("decimal(16,6)")))
            return bound(value, lambda x: F.when(x.isNotNull(), F.struct(x.alias("value"), F.lit(FORMATS[name][1]).alias("confidence"), F.lit(name).alias("format"))))

        iso = (part(1, 4), part(6, 2), part(9, 2))
        timed = F.coalesce(at("iso8601", *iso, part(12, 2), part(15, 2), part(18, 2)), at("iso_space", *iso, part(12, 2), part(15, 2), part(18, 2)), at("iso_space_no_sec", *iso, part(12, 2), part(15, 2)))
        hour, half = clock(4).try_cast("int"), F.upper(clock(7))
        hour = F.when((half == "PM") & (hour < 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)
        us = (month.try_cast("int"), day.try_cast("int"))
        short = year(2) + F.when(year(2) < 50, 2000).otherwise(1900)
        none = F.struct(F.lit(None).cast("timestamp_ntz").alias("value"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("format"))
        return (
            F.when(text.rlike(ISO), F.coalesce(F.when(F.length(text) > 10, timed), at("iso_date", *iso), none))
            .when(text.rlike(SLASHED), F.coalesce(F.when(F.contains(text, F.lit(":")), at("us_datetime", year(4), *us, hour, clock(5).try_cast("int"), F.coalesce(clock(6).try_cast("int"), F.lit(0)))), at("us_date", year(4), *us), at("us_date_short", short, *us), none))
            .otherwise(none)
        )

    return bound(clean_date_text(c), of)


def closing_urgency(closing: Column, as_of: Column) -> Column:
    days = F.floor(F.timestamp_diff("SECOND", as_of, closing) / 86400)
    return F.when(days < 0, "Past").when(days <= 7, F.concat(days.cast("string"), F.lit("d"))).otherwise(F.date_format(closing, "yyyy-MM-dd"))


MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def natural_date(c: Column, as_of: Column) -> Column:
    """Struct of value and confidence of dates in words: ``Mar 5, 2024``, ``5 March 2024``, ``March 5`` (the next one), with a time of day or without; today, tomorrow, yesterday; ``in 3 days``, ``3 days ago``.

    Confidence is 0.7, 0.1 more with a year or a time each, 0.1 less for what is relative; null and 0 for all else.
    """

    def of(text: Column) -> Column:
        part = lambda pattern, i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
        month, time = rf"({'|'.join(MONTHS)})[a-z]*\.?", r"(?:,?\s+(?:at\s+)?(\d{1,2}):(\d{2})\s*([ap]m)?)?"
        first, last = rf"^{month}\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{4}}))?{time}$", rf"^(\d{{1,2}})(?:st|nd|rd|th)?\s+{month}(?:,?\s+(\d{{4}}))?{time}$"
        pick = lambda i, j: F.coalesce(part(first, i), part(last, j))
        number = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), pick(1, 2)).cast("int")
        day, year, hour, minute, half = pick(2, 1).cast("int"), pick(3, 3).cast("int"), pick(4, 4).cast("int"), pick(5, 5).cast("int"), pick(6, 6)
        hour = F.when(half == "pm", hour % 12 + 12).when(half == "am", hour % 12).otherwise(hour)
        date = lambda y: F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(number.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")
        this = date(F.year(as_of))
        found = F.when(number > 0, F.when(year.isNotNull(), date(year)).otherwise(F.when(this >= F.to_date(as_of), this).otherwise(date(F.year(as_of) + 1))))
        word = F.when(text == "today", 0).when(text == "tomorrow", 1).when(text == "yesterday", -1)
        ahead, ago = part(r"^in\s+(\d{1,5})\s+days?$", 1).cast("int"), part(r"^(\d{1,5})\s+days?\s+ago$", 1).cast("int")
        moved = F.coalesce(word, ahead, -ago)
        at = found.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.coalesce(hour, F.lit(0)), F.coalesce(minute, F.lit(0)))
        value = F.coalesce(F.when(F.coalesce(hour, F.lit(0)).between(0, 23), at), (F.date_add(F.to_date(as_of), moved)).cast("timestamp_ntz"))
        sure = F.bround(0.7 + F.when(year.isNotNull(), 0.1).otherwise(0.0) + F.when(hour.isNotNull(), 0.1).otherwise(0.0) - F.when(moved.isNotNull(), 0.1).otherwise(0.0), 3)
        return F.struct(value.alias("value"), F.when(value.isNotNull(), sure).otherwise(0.0).alias("confidence"))

    return bound(F.lower(clean_date_text(F.coalesce(c, F.lit("")))), of)


def dynamic_value(c: Column, as_of: Column, last_run: Column, env: Mapping[str, str] = {}, more: Mapping[str, Column] = {}) -> Column:
    """Text with its variables filled in: ``${TODAY}``, ``${TODAY+7d}`` and ``${TODAY-7d}``, ``${LAST_RUN_DATE}`` (30 days ago if there was none), ``${env:NAME}`` (unset: empty), and ``${name}`` of more."""
    day = lambda d: F.date_format(d, "yyyy-MM-dd")
    text = F.replace(F.replace(c, F.lit("${TODAY}"), day(as_of)), F.lit("${LAST_RUN_DATE}"), day(F.coalesce(last_run, as_of - F.make_dt_interval(F.lit(30)))))
    found = lambda pattern: F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)))
    moved = lambda t, n: F.replace(t, F.concat(F.lit("${TODAY"), n, F.lit("d}")), day(F.date_add(F.to_date(as_of), n.try_cast("int"))))
    text = F.aggregate(found(r"\$\{TODAY([+-]\d{1,5})d\}"), text, moved)
    held = F.create_map(*(F.lit(x) for pair in env.items() for x in pair)) if env else F.create_map().cast("map<string,string>")
    named = lambda t, n: F.replace(t, F.concat(F.lit("${env:"), n, F.lit("}")), F.coalesce(F.try_element_at(held, n), F.lit("")))
    text = F.aggregate(found(r"\$\{env:([^}]+)\}"), text, named)
    for name, value in more.items():
        text = F.replace(text, F.lit(f"${{{name}}}"), F.coalesce(value.cast("string"), F.lit("None")))
    return text
