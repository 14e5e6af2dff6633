"""Dates in words: a table of forms against what they mean."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidflow.functions import date_grammar
from bidflow.plans.ctes import OPPORTUNITIES
from bidflow.sources import views as v

T = F.col


def _fmt(pattern):
    return lambda: F.date_format("x", pattern)


def _text(words):
    return lambda: F.lit(words)


def _either(day_first, month_first):
    return lambda: F.when(T("day_first"), F.date_format("x", day_first)).otherwise(F.date_format("x", month_first))


def _cat(*parts):
    return lambda: F.concat(*(p() for p in parts))


def _day():
    return F.dayofmonth("x").cast("string")


def _ordinal():
    d = F.dayofmonth("x")
    return F.concat(_day(), F.when(d.isin(1, 21, 31), "st").when(d.isin(2, 22), "nd").when(d.isin(3, 23), "rd").otherwise("th"))


#: Form (x is the date that it tells, at 17:05:09), meaning in SQL, confidence. Half of the rows read days first.
_D, _T = "cast(x as date)", "date_trunc('day', base)"
_AHEAD = "case when cast(x as date) >= cast(base as date) then cast(x as date) when month(x) = 2 and day(x) = 29 then make_date(year(x) + 4, 2, 29) else make_date(year(x) + 1, month(x), day(x)) end"
_MONTH = "case when month(x) = month(base) and day(base) > 1 or month(x) < month(base) then make_date(year(base) + 1, month(x), 1) else make_date(year(base), month(x), 1) end"
_NEXT = f"{_T} + to_days(cast((dayofweek(x) - dayofweek(base) + 6) % 7 + 1 as int))"
FORMS = [
    (_fmt("MMM d, yyyy"), _D, 0.8),
    (_fmt("d MMM yyyy"), _D, 0.8),
    (_fmt("MMMM d, yyyy"), _D, 0.8),
    (lambda: F.upper(F.date_format("x", "d MMMM yyyy")), _D, 0.8),
    (_fmt("EEEE, MMMM d, yyyy"), _D, 0.8),
    (_fmt("EEE d MMM yyyy"), _D, 0.8),
    (_cat(_fmt("MMMM "), _ordinal, _fmt(", yyyy")), _D, 0.8),
    (_cat(_text("the "), _ordinal, _fmt("' of 'MMMM yyyy")), _D, 0.8),
    (_fmt("MMM. d yyyy"), _D, 0.8),
    (_fmt("yyyy MMM d"), _D, 0.8),
    (_fmt("MMMM yyyy"), "date_trunc('month', x)", 0.8),
    (_fmt("dd-MMM-yyyy"), _D, 0.8),
    (_either("dd.MM.yyyy", "MM.dd.yyyy"), _D, 0.8),
    (_either("d-M-yyyy", "M-d-yyyy"), _D, 0.8),
    (_fmt("dd/MM/yyyy"), "case when day(x) <= 12 then make_date(year(x), day(x), month(x)) else cast(x as date) end", "case when day(x) <= 12 then 0.85 else 0.8 end"),
    (_fmt("yyyy/MM/dd"), _D, 0.8),
    (_fmt("yyyy.M.d"), _D, 0.8),
    (_either("dd.MM.yy", "MM.dd.yy"), _D, 0.7),
    (_fmt("d MMM yyyy HH:mm"), "date_trunc('minute', x)", 0.9),
    (_fmt("MMM d, yyyy h:mm a"), "date_trunc('minute', x)", 0.9),
    (_cat(_text("Closing date: "), _fmt("MMMM d, yyyy 'at' h:mm a"), _text(" ET")), "date_trunc('minute', x)", 0.9),
    (_fmt("MMM d, yyyy ha"), "date_trunc('hour', x)", 0.8),
    (_fmt("d MMM yyyy HH:mm:ss"), "x", 0.9),
    (_either("dd.MM.yyyy HH:mm", "MM.dd.yyyy HH:mm"), "date_trunc('minute', x)", 0.9),
    (_fmt("HH:mm, d MMMM yyyy"), "date_trunc('minute', x)", 0.9),
    (_fmt("MMM d, yyyy 'noon'"), f"{_D} + interval 12 hour", 0.8),
    (_fmt("d MMM yyyy 'at midnight'"), _D, 0.8),
    (_fmt("EEE, dd MMM yyyy HH:mm:ss 'GMT'"), "timezone('America/New_York', timezone('UTC', x))", 0.9),
    (_fmt("d MMM yyyy HH:mm:ss '+0530'"), "timezone('America/New_York', timezone('UTC', x - interval 330 minute))", 0.9),
    (_fmt("d MMM yyyy h:mm a 'CEST'"), "timezone('America/New_York', timezone('UTC', date_trunc('minute', x) - interval 2 hour))", 0.9),
    (_fmt("MMM d"), _AHEAD, 0.7),
    (_fmt("d MMMM"), _AHEAD, 0.7),
    (_fmt("EEEE, MMM d"), _AHEAD, 0.7),
    (_fmt("MMMM"), _MONTH, 0.7),
    (_fmt("MMM d 'at' HH:mm"), f"{_AHEAD} + interval 17 hour + interval 5 minute", 0.8),
    (_cat(_ordinal, _fmt(" MMMM")), _AHEAD, 0.7),
    (_fmt("EEEE"), _NEXT, 0.7),
    (_fmt("'next 'EEEE"), _NEXT, 0.6),
    (_fmt("'this 'EEE"), f"{_T} + to_days(cast((dayofweek(x) - dayofweek(base) + 7) % 7 as int))", 0.7),
    (_fmt("'last 'EEEE"), f"{_T} - to_days(cast((dayofweek(base) - dayofweek(x) + 6) % 7 + 1 as int))", 0.6),
    (_fmt("'on 'EEE' at 5 p.m.'"), f"{_NEXT} + interval 17 hour", 0.7),
    (_text("today"), _T, 0.6),
    (_text("Tomorrow"), f"{_T} + interval 1 day", 0.6),
    (_text("yesterday"), f"{_T} - interval 1 day", 0.6),
    (_text("tomorrow at 17:30"), f"{_T} + interval 1 day + interval 1050 minute", 0.7),
    (_text("next week"), f"{_T} + interval 7 day", 0.6),
    (_text("last month"), f"{_T} - interval 1 month", 0.6),
    (_text("next year"), f"{_T} + interval 1 year", 0.6),
    (_cat(_text("in "), _day, _text(" days")), f"{_T} + to_days(cast(day(x) as int))", 0.7),
    (_text("in three weeks"), f"{_T} + interval 21 day", 0.7),
    (_text("in 2 months"), f"{_T} + interval 2 month", 0.7),
    (_text("2 weeks ago"), f"{_T} - interval 14 day", 0.6),
    (_text("a month ago"), f"{_T} - interval 1 month", 0.6),
    (_cat(_day, _text(" days from now")), f"{_T} + to_days(cast(day(x) as int))", 0.7),
    (_text("in 1 year"), f"{_T} + interval 1 year", 0.7),
    (_text("in 5 hours"), "base + interval 5 hour", 0.7),
    (_text("90 minutes ago"), "base - interval 90 minute", 0.6),
    (_text("in 1 week and 2 days"), f"{_T} + interval 9 day", 0.7),
    (_text("14:30"), f"{_T} + interval 870 minute", 0.8),
    (_text("8:15 am"), f"{_T} + interval 1 day + interval 495 minute", 0.8),
    (_text("now"), "base", 0.7),
    (_text("whenever"), None, 0),
    (_text("Feb 30, 2024"), None, 0),
    (_text("32 March 2024"), None, 0),
    (_text("next"), None, 0),
    (_text("5"), None, 0),
    (_fmt("d MMMM yyyy 'or so'"), None, 0),
    (_fmt("d MMM d yyyy"), None, 0),
    (_text("13 pm"), None, 0),
    (_text(""), None, 0),
]


def date_forms(spark, sf):
    """Every form of a date, relative to 9:30 on some day before it or after it."""
    o = v.opportunities(spark, sf).select("id", T("posted_at").alias("at"))
    k = T("id")
    told = o.select("id", (T("at") + F.make_dt_interval(F.lit(0), F.lit(9), F.lit(30))).alias("base"), (T("at") + F.make_dt_interval((k % 90 - 40).cast("int"), F.lit(17), F.lit(5), F.lit(9))).alias("x"), (F.floor(k / len(FORMS)) % 2 == 0).alias("day_first"))
    form = F.element_at(F.array(*(f() for f, *_ in FORMS)), (k % len(FORMS) + 1).cast("int"))
    return told.select("id", date_grammar.parse_any(form, T("base"), T("day_first"), "America/New_York").alias("p")).select("id", T("p.value").alias("value"), T("p.confidence").alias("confidence"))


def _case(i):
    return " ".join(f"when {n} then {f[i] if f[i] is not None else 'null'}" for n, f in enumerate(FORMS))


SQL = {
    "date_forms": f"""with {OPPORTUNITIES}, t as (select id, id % {len(FORMS)} as form, posted_at + interval 570 minute as base, posted_at + to_days(cast(id % 90 - 40 as int)) + interval 17 hour + interval 5 minute + interval 9 second as x from opportunities)
 select id, cast(case form {_case(1)} end as timestamp) as value, cast(case form {_case(2)} end as double) as confidence from t""",
}
