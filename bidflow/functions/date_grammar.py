"""Dates in words and numbers by a small grammar: a text's tokens are classified, folded into the parts of a date, and resolved against a base.

Tokens are month and day names, numbers and ordinals, numeric dates, times of day, zones, units, and words such as
``next``, ``ago`` or ``tomorrow``; a token of another kind, or one that finds its place taken, leaves the text unread.
All of it is Spark expressions.

Dates are taken to lie ahead: a date without a year is the next one, a weekday the first after the base (``this``: or
the base, ``last``: the last before it), a time alone the next one. A month alone begins on its first day. What is
relative starts at midnight of the base, or at the base itself for hours and minutes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidflow.functions.dates import clean_date_text, parse_date
from bidflow.functions.text import bound

MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "sunday monday tuesday wednesday thursday friday saturday".split()
COUNTS = "one two three four five six seven eight nine ten eleven twelve".split()
#: Word: kind and value.
WORDS: dict[str, tuple[str, int]] = {
    **{w: ("month", i) for i, name in enumerate(MONTHS, 1) for w in (name, name[:3])}, "sept": ("month", 9),
    **{w: ("weekday", i) for i, name in enumerate(WEEKDAYS, 1) for w in (name, name[:3])}, "tues": ("weekday", 3), "thur": ("weekday", 5), "thurs": ("weekday", 5),
    **{w: ("count", i) for i, w in enumerate(COUNTS, 1)}, "a": ("count", 1), "an": ("count", 1),
    "last": ("way", -1), "previous": ("way", -1), "past": ("way", -1), "this": ("way", 0), "coming": ("way", 1), "next": ("way", 1),
    "day": ("days", 1), "days": ("days", 1), "week": ("days", 7), "weeks": ("days", 7), "fortnight": ("days", 14), "month": ("months", 1), "months": ("months", 1), "year": ("months", 12), "years": ("months", 12),
    "hour": ("seconds", 3600), "hours": ("seconds", 3600), "hr": ("seconds", 3600), "hrs": ("seconds", 3600), "minute": ("seconds", 60), "minutes": ("seconds", 60), "min": ("seconds", 60), "mins": ("seconds", 60),
    "today": ("day", 0), "tonight": ("day", 0), "tomorrow": ("day", 1), "yesterday": ("day", -1), "now": ("now", 0), "ago": ("ago", 0), "noon": ("clock", 12), "midnight": ("clock", 0), "am": ("half", 0), "pm": ("half", 12),
    "utc": ("zone", 0), "gmt": ("zone", 0), "z": ("zone", 0), "bst": ("zone", 60), "cet": ("zone", 60), "cest": ("zone", 120), "eet": ("zone", 120), "ist": ("zone", 330), "jst": ("zone", 540), "aest": ("zone", 600),
    **{w: ("zone", 60 * h) for w, h in {"est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}.items()},
    **{w: ("skip", 0) for w in "in at on of the and by from local time st nd rd th".split()},
}
TOKEN = r"\d{4}[/.-]\d{1,2}[/.-]\d{1,2}(?!\d)|\d{1,2}[/.-]\d{1,2}[/.-](?:\d{4}|\d{2})(?!\d)|\d{1,2}:\d{2}(?::\d{2})?|(?<=\d ?)[+-]\d{2}:?\d{2}(?!\d)|\d{1,9}(?:st|nd|rd|th)?|[a-z]+"
PARTS = ["year", "month", "day", "hour", "minute", "second", "weekday", "way", "count", "days", "months", "seconds", "moved", "now", "ago", "zone", "bad"]
# Words that make a date less sure.
RELATIVE = ["today", "tomorrow", "yesterday", "ago", "next", "last"]


def _struct(**values: Column) -> Column:
    return F.struct(*(values[p].cast("int").alias(p) for p in PARTS))


def _full_year(y: Column) -> Column:
    return F.when(y >= 100, y).otherwise(y + F.when(y < 50, 2000).otherwise(1900))


def _classified(token: Column, day_first: Column) -> Column:
    """Struct of kind, a, b, c of a token."""
    told = lambda kind, a, b=None, c=None: F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), (F.lit(None) if b is None else b).cast("int").alias("b"), (F.lit(None) if c is None else c).cast("int").alias("c"))
    word = F.expr("map(" + ", ".join(f"'{w}', named_struct('kind', '{kind}', 'a', {value}, 'b', cast(null as int), 'c', cast(null as int))" for w, (kind, value) in WORDS.items()) + ")")
    number = lambda pattern, i: F.regexp_extract(token, pattern, i).try_cast("int")
    iso, numeric, clock, offset = r"^(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})$", r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})$", r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$", r"^([+-])(\d{2}):?(\d{2})$"
    one, two = number(numeric, 1), number(numeric, 2)
    first = (day_first & (two <= 12)) | (one > 12)  # whether the day comes first
    date = told("date", _full_year(number(numeric, 3)), F.when(first, two).otherwise(one), F.when(first, one).otherwise(two))
    minutes = number(offset, 2) * 60 + number(offset, 3)
    value = F.regexp_extract(token, r"^(\d{1,9})", 1).try_cast("int")
    return (
        F.when(token >= "a", F.coalesce(F.try_element_at(word, token), told("unknown", F.lit(0))))  # the others begin with a digit or a sign
        .when(token.rlike(iso), told("date", number(iso, 1), number(iso, 2), number(iso, 3)))
        .when(token.rlike(numeric), date)
        .when(token.rlike(clock), told("clock", number(clock, 1), number(clock, 2), F.coalesce(number(clock, 3), F.lit(0))))
        .when(token.rlike(offset), told("zone", F.when(token.startswith("-"), -minutes).otherwise(minutes)))
        .when(token.rlike(r"^\d{4}$"), told("year", value))
        .when(token.rlike(r"^\d+$"), told("number", value))
        .when(token.rlike(r"^\d+[a-z]+$"), told("ordinal", value))
        .otherwise(told("unknown", F.lit(0)))
    )


def _folded(tokens: Column) -> Column:
    """The parts of a date that classified tokens tell; bad if a token is unknown or its place is taken."""

    def step(x: Column, t: Column) -> Column:
        kind, a, none = t["kind"], t["a"], F.lit(None).cast("int")
        is_ = lambda *kinds: kind.isin(*kinds)
        pending, dated = x["count"].isNotNull(), x["month"].isNotNull()
        unit = is_("days", "months", "seconds")
        many = F.coalesce(x["count"], x["year"], x["way"])  # in 3 weeks, in 2000 days, next week
        total = a.cast("long") * many
        far = F.abs(total) > F.when(is_("days"), 3_000_000).when(is_("months"), 100_000).otherwise(1_000_000_000)
        as_day = is_("number") & dated & x["day"].isNull()
        as_year = is_("number") & dated & x["day"].isNotNull() & x["year"].isNull() & (a < 100)
        waits = is_("count") | (is_("number") & ~as_day & ~as_year)
        hour = F.when(is_("clock"), a).when(is_("half"), F.when(F.coalesce(x["hour"], x["count"]).between(1, 12), F.coalesce(x["hour"], x["count"]) % 12 + a).otherwise(99)).otherwise(x["hour"])
        taken = (
            (is_("month", "date") & dated) | (is_("year", "date") & x["year"].isNotNull()) | (is_("ordinal", "date") & x["day"].isNotNull()) | (is_("clock") & x["hour"].isNotNull()) | (is_("weekday") & x["weekday"].isNotNull())
            | (waits & pending) | (is_("half") & x["hour"].isNull() & ~pending) | (unit & (many.isNull() | far)) | (is_("month") & pending & x["day"].isNotNull()) | is_("unknown") | (is_("zone") & x["zone"].isNotNull()) | (is_("day") & x["moved"].isNotNull())
        )
        used = unit | is_("half") & x["hour"].isNull() | is_("month")
        return _struct(
            year=F.when(is_("year", "date"), a).when(as_year, _full_year(a)).when(unit & ~pending, none).otherwise(x["year"]),
            month=F.when(is_("month"), a).when(is_("date"), t["b"]).otherwise(x["month"]),
            day=F.when(is_("date"), t["c"]).when(as_day | is_("ordinal"), a).when(is_("month") & pending & x["day"].isNull(), x["count"]).otherwise(x["day"]),
            hour=hour,
            minute=F.when(is_("clock"), F.coalesce(t["b"], F.lit(0))).when(is_("half"), F.coalesce(x["minute"], F.lit(0))).otherwise(x["minute"]),
            second=F.when(is_("clock"), F.coalesce(t["c"], F.lit(0))).otherwise(x["second"]),
            weekday=F.when(is_("weekday"), a).otherwise(x["weekday"]),
            way=F.when(is_("way"), a).when(unit & ~pending & x["year"].isNull(), none).otherwise(x["way"]),
            count=F.when(waits, a).when(used, none).otherwise(x["count"]),
            **{u: F.when(is_(u), F.coalesce(x[u], F.lit(0)) + F.when(~far, total).otherwise(0)).otherwise(x[u]) for u in ("days", "months", "seconds")},
            moved=F.when(is_("day"), a).otherwise(x["moved"]),
            now=F.when(is_("now"), 1).otherwise(x["now"]),
            ago=F.when(is_("ago"), 1).otherwise(x["ago"]),
            zone=F.when(is_("zone"), a).otherwise(x["zone"]),
            bad=F.when(taken, 1).otherwise(x["bad"]),
        )

    none = _struct(**{p: F.lit(0 if p == "bad" else None) for p in PARTS})
    return F.aggregate(tokens, none, step)


def _resolved(x: Column, base: Column) -> Column:
    """The time that the parts of a date mean."""
    today, clock = F.to_date(base), x["hour"].isNotNull()
    at = lambda date: F.try_make_timestamp_ntz(F.year(date), F.month(date), F.dayofmonth(date), F.coalesce(x["hour"], F.lit(0)), F.coalesce(x["minute"], F.lit(0)), F.coalesce(x["second"], F.lit(0)).cast("decimal(16,6)"))
    named = lambda y: F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(x["month"].cast("string"), 2, "0"), F.lpad(F.coalesce(x["day"], F.lit(1)).cast("string"), 2, "0")).try_cast("date")
    ahead = F.array_min(F.filter(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: named(F.year(today) + i)), lambda d: d >= today))  # 29 February comes again within 8 years
    date = F.when(x["year"].isNotNull(), named(x["year"])).otherwise(ahead)

    on = F.dayofweek(today)
    forth, back = F.pmod(x["weekday"] - on, F.lit(7)), F.pmod(on - x["weekday"], F.lit(7))
    weekday = F.date_add(today, F.when(x["way"] == -1, -F.when(back == 0, 7).otherwise(back)).when(x["way"] == 0, forth).otherwise(F.when(forth == 0, 7).otherwise(forth)))

    sign = F.when(x["ago"] == 1, -1).otherwise(1)
    zero = lambda c: F.coalesce(x[c], F.lit(0))
    moved_day = F.date_add(F.add_months(F.date_add(today, zero("moved")), sign * zero("months")), sign * zero("days"))
    exact = moved_day.cast("timestamp_ntz") + (base - F.date_trunc("DAY", base).cast("timestamp_ntz")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), sign * zero("seconds"))
    moves = F.coalesce(x["moved"], x["days"], x["months"], x["seconds"], x["now"]).isNotNull()

    alone = at(today)
    dated, plain = x["month"].isNotNull(), ~(x["day"].isNotNull() | x["year"].isNotNull())
    value = (
        F.when((x["bad"] == 1) | x["count"].isNotNull() | (x["way"].isNotNull() & x["weekday"].isNull()) | (x["ago"] == 1) & ~moves, None)
        .when(dated & ~moves & x["way"].isNull(), at(date))
        .when(dated | ~plain, None)
        .when(x["weekday"].isNotNull() & ~moves, at(weekday))
        .when(x["weekday"].isNotNull(), None)
        .when(moves & (x["seconds"].isNotNull() | F.coalesce(x["moved"], x["days"], x["months"]).isNull()) & ~clock, exact)
        .when(moves, at(moved_day))
        .when(clock, F.when(alone >= base, alone).otherwise(alone + F.make_dt_interval(F.lit(1))))
    )
    return value.cast("timestamp_ntz")


def parse_words(c: Column, base: Column, day_first: Column | bool = False, zone: str | Column | None = None) -> Column:
    """Struct of value and confidence. day_first: how numeric dates are read where both ways are dates. zone: that of the result, where the text names one of its own.

    Confidence is 0.7, 0.1 more with a year of four digits or a time each, 0.1 less with a word such as ``ago`` or ``next``; null and 0 where nothing is read.
    """
    day_first = F.lit(day_first) if isinstance(day_first, bool) else day_first

    def of(text: Column) -> Column:
        rest = F.regexp_replace(text, TOKEN, "").rlike(r"^[\s,.;()@-]*$")
        known = lambda tokens: F.when(~F.exists(tokens, lambda t: t["kind"] == "unknown"), _folded(tokens))
        tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: _classified(t, day_first))
        return bound(F.when(rest, bound(tokens, known)), lambda x: sure(text, x))

    def sure(text: Column, x: Column) -> Column:
        relative = F.lit(False)
        for w in RELATIVE:
            relative = relative | F.contains(text, F.lit(w))
        confidence = F.bround(0.7 + F.when(text.rlike(r"\d{4}"), 0.1).otherwise(0.0) + F.when(text.rlike(r"\d{1,2}:\d{2}"), 0.1).otherwise(0.0) - F.when(relative, 0.1).otherwise(0.0), 3)
        value = _resolved(x, base)
        if zone is not None:
            to = F.lit(zone) if isinstance(zone, str) else zone
            utc = lambda v: v - F.make_dt_interval(F.lit(0), F.lit(0), x["zone"])
            value = bound(value, lambda v: F.when(x["zone"].isNotNull() & to.isNotNull(), F.convert_timezone(F.lit("UTC"), to, utc(v))).otherwise(v))
        return bound(value, lambda v: F.struct(v.alias("value"), F.when(v.isNotNull(), confidence).otherwise(0.0).alias("confidence")))

    text = F.regexp_replace(F.lower(clean_date_text(F.coalesce(c, F.lit("")))), r"\b([ap])\.\s?m\b\.?", "$1m")
    return bound(F.regexp_replace(text, r"(\d)(am|pm)\b", "$1 $2"), of)


def parse_any(c: Column, base: Column, day_first: Column | bool = False, zone: str | Column | None = None) -> Column:
    """Struct of value, confidence and format: by the fixed formats, else by the grammar (``words``); null and 0 where neither reads the text."""
    words = bound(parse_words(c, base, day_first, zone), lambda w: F.when(w["value"].isNotNull(), F.struct(w["value"], w["confidence"], F.lit("words").alias("format"))))
    return bound(parse_date(c), lambda p: F.coalesce(F.when(p["value"].isNotNull() | (F.coalesce(c, F.lit("")) == ""), p), words, p))
