"""The date grammar's edges, and canonical rows that use it."""

import datetime

import pytest
from pyspark.sql import functions as F

from bidflow.functions.date_grammar import parse_any
from bidflow.operators import runs
from bidflow.operators.canonical import canonical



def base():
    return F.lit("2024-06-12 09:30:00").cast("timestamp_ntz")  # a Wednesday


def read(spark, texts, *more):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", parse_any(F.col("t"), base(), *more).alias("p")).orderBy("i").collect()
    return [(r["p"]["value"] and f"{r['p']['value']:%Y-%m-%d %H:%M}", r["p"]["confidence"], r["p"]["format"]) for r in rows]


def test_unread_texts(spark):
    texts = [None, "", "  ", "soon", "13 pm", "25:00", "march 5 march", "5 6 march", "ago", "2 ago", "week", "friday friday", "2025", "in", "in 3", "31 june", "0 march", "99.99.2024", "in 999999999 years and 5 years", "in 4000000 days", "999999999 minutes ago and 999999999 hours ago"]
    assert read(spark, texts) == [(None, 0.0, None)] * len(texts)


def test_order_of_day_and_month(spark):
    texts = ["05.06.2024", "05/06/2024", "31/12/2024", "12.31.2024", "2024.06.05"]
    assert [r[0][:10] for r in read(spark, texts, False)] == ["2024-05-06", "2024-05-06", "2024-12-31", "2024-12-31", "2024-06-05"]
    assert [r[0][:10] for r in read(spark, texts, True)] == ["2024-06-05", "2024-05-06", "2024-12-31", "2024-12-31", "2024-06-05"]


def test_words(spark):
    texts = ["Feb 29", "wednesday", "this wednesday", "last wednesday", "9:30", "09:29", "an hour ago", "in a fortnight", "12 am", "Mar 5 49", "in 2000 days", "2 weeks and 1 day ago"]
    got = {t: r[0] for t, r in zip(texts, read(spark, texts), strict=True)}
    assert got == {
        "Feb 29": "2028-02-29 00:00", "wednesday": "2024-06-19 00:00", "this wednesday": "2024-06-12 00:00", "last wednesday": "2024-06-05 00:00", "9:30": "2024-06-12 09:30", "09:29": "2024-06-13 09:29",
        "an hour ago": "2024-06-12 08:30", "in a fortnight": "2024-06-26 00:00", "12 am": "2024-06-13 00:00", "Mar 5 49": "2049-03-05 00:00", "in 2000 days": "2029-12-03 00:00", "2 weeks and 1 day ago": "2024-05-28 00:00",
    }


def test_zones(spark):
    text = ["5 March 2024 10:00 +0200", "5 March 2024 10:00", "Jul 1, 2024 12:00 GMT"]
    assert [r[0] for r in read(spark, text, False, "America/New_York")] == ["2024-03-05 03:00", "2024-03-05 10:00", "2024-07-01 08:00"]
    assert [r[0] for r in read(spark, text)] == ["2024-03-05 10:00", "2024-03-05 10:00", "2024-07-01 12:00"]


@pytest.mark.parametrize("compat", [False, True])
def test_canonical_money_and_words(spark, compat):
    raw = spark.createDataFrame([("B-1", "$1,234", "next Friday"), ("B-2", "$1,234,567", "5 March 2030"), (None, None, None)], "bid_id string, amount string, due_date string")
    rows = canonical(raw, base(), compat=compat).orderBy("external_id").collect()
    assert [r["estimated_value"] for r in rows] == ([1.234, None, None] if compat else [1234.0, 1234567.0, None])
    assert [r["closing_at"] for r in rows] == [datetime.datetime(2024, 6, 14), datetime.datetime(2030, 3, 5), None]


def test_schedules_far_off(spark):
    tell = ["0 0 1 * *", "0 0 29 2 *", "0 0 30 2 *", "59 23 29 2 0", "* * * * *", "30 9 * * 3", "x", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tell)], "i int, t string").select("i", runs.next_cron(F.col("t"), base()).alias("n")).orderBy("i").collect()
    assert [r["n"] and f"{r['n']:%Y-%m-%d %H:%M}" for r in rows] == ["2024-07-01 00:00", "2028-02-29 00:00", None, "2032-02-29 23:59", "2024-06-12 09:31", "2024-06-19 09:30", None, None]
