import datetime as dt

import pytest
from pyspark.sql import functions as F

from bidflow.functions import dates, money, status, text
from bidflow.operators import cdc, schedule


def evaluate(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_dates(spark):
    got = evaluate(spark, dates.parse_date, ["2026-01-02T10:11:12Z", "2026-01-02T10:00", "Due: 2026-02-30", "3/5/2026 12:05 am ET", "1/2/49", "1/2/50", None, "", "soon", "13/01/2026", "Posted:  2026-01-02   08:09:10"])
    assert [(r["value"], r["format"]) for r in got] == [
        (dt.datetime(2026, 1, 2, 10, 11, 12), "iso8601"), (dt.datetime(2026, 1, 2), "iso_date"), (None, None), (dt.datetime(2026, 3, 5, 0, 5), "us_datetime"), (dt.datetime(2049, 1, 2), "us_date_short"),
        (dt.datetime(1950, 1, 2), "us_date_short"), (None, None), (None, None), (None, None), (None, None), (dt.datetime(2026, 1, 2, 8, 9, 10), "iso_space"),
    ]


@pytest.mark.parametrize("compat, wanted", [(True, [1.234, None, 1234.56, 1234.56, 1.5e6, None, None, "USD"]), (False, [1234.0, 1234567.0, 1234.56, 1234.56, 1.5e6, None, None, "CAD"])])
def test_money(spark, compat, wanted):
    got = evaluate(spark, lambda c: money.parse_money(c, compat), ["1,234", "1,234,567", "$1,234.56", "1.234,56", "$1.5M", "", None, "C$ 5"])
    assert [r["amount"] for r in got[:7]] == wanted[:7] and got[7]["currency"] == wanted[7]


def test_status(spark):
    got = evaluate(spark, status.parse_status, ["open", "Now OPEN for bids", "no longer accepting", "Pending", "winner was selected", "weird", "", None])
    assert [(r["status"], r["confidence"]) for r in got] == [("OPEN", 0.95), ("OPEN", 0.85), ("OPEN", 0.85), ("OPEN", 0.95), ("AWARDED", 0.7), ("UNKNOWN", 0.3), ("UNKNOWN", 0.0), ("UNKNOWN", 0.0)]


def test_text(spark):
    assert evaluate(spark, text.clean_html_text, ["a&nbsp;b  c&amp;lt;", None, "  "]) == ["a b c<", "", ""]
    assert evaluate(spark, text.first_url, ["x https://a.b/c?d=1) y", "none", None])[1:] == [None, None]
    assert evaluate(spark, lambda c: text.shortened(c, 5), ["abcdef", "abcde", None]) == ["ab...", "abcde", None]


def test_minutes(spark):
    assert evaluate(spark, schedule.minutes_of, ["08:30", "24:00", "7:5", "x", "", None]) == [510, None, 425, None, None, None]


def test_cdc_of_an_empty_state(spark):
    kinds = "portal_id int, external_id string, title string, status string, agency string, category string, posted_at timestamp_ntz, closing_at timestamp_ntz, estimated_value double, contact_name string"
    state = spark.createDataFrame([], kinds)
    batch = spark.createDataFrame([(1, "a", None, "OPEN", None, None, None, None, 0.0, None)], kinds)
    assert [r["event_type"] for r in cdc.events_of(cdc.classified(state, batch)).collect()] == ["NEW"]
    assert cdc.upserted(state, batch).count() == 1 and cdc.upserted(batch.drop("fingerprint"), batch).count() == 1
    assert [r["outcome"] for r in cdc.classified(batch, batch).collect()] == ["UNCHANGED"]


def test_nearest_header_by_brute_force():
    import random
    from functools import lru_cache

    from bidflow.functions import headers

    @lru_cache(None)
    def common(a, b):
        if not a or not b:
            return 0
        return common(a[1:], b[1:]) + 1 if a[0] == b[0] else max(common(a[1:], b), common(a, b[1:]))

    rng = random.Random(2)
    known = list(headers.synonyms().items())
    for _ in range(25):
        name = [*rng.choice(known)[0]]
        for _ in range(rng.randrange(4)):
            name[rng.randrange(len(name))] = rng.choice("abcdefgh ")
        text = "".join(name)
        scores = [(round(200 * common(text, other) / (len(text) + len(other))), field) for other, field in known]
        most = max(s for s, _ in scores)
        assert headers.nearest(text) == (next(f for s, f in scores if s == most) if most >= 75 else None, most)
        common.cache_clear()


def test_natural_dates(spark):
    as_of = F.lit("2024-03-05 10:00:00").cast("timestamp_ntz")
    got = evaluate(spark, lambda c: dates.natural_date(c, as_of), ["March 4", "Mar 5", "5th of March", "1st Apr 2025, 9:05 am", "Dec 31, 2023 at 12:30 am", "in 1 day", "10 days ago", None, "Feb 29", "May 1 25:00"])
    assert [r["value"] for r in got] == [dt.datetime(2025, 3, 4), dt.datetime(2024, 3, 5), None, dt.datetime(2025, 4, 1, 9, 5), dt.datetime(2023, 12, 31, 0, 30), dt.datetime(2024, 3, 6), dt.datetime(2024, 2, 24), None, None, None]
    assert [r["confidence"] for r in got] == [0.7, 0.7, 0.0, 0.9, 0.9, 0.6, 0.6, 0.0, 0.0, 0.0]
