"""Streams that wait for each other or for silence: details that follow listings, runs by gaps, sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_details(listings: DataFrame, details: DataFrame, wait: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Listings (detail_url, fetched_at: timestamp) with the details (the same two columns) that are fetched within ``wait`` of them.

    A detail's columns win, nulls included. A listing goes on with its detail as soon as that is there, and
    without one once both watermarks (``late`` behind the latest page) have passed its wait; what comes later is dropped.
    A listing without detail_url waits as well. Several details of a listing give several rows. State holds one wait's rows of both sides.
    """
    fields = [c for c in details.columns if c not in ("detail_url", "fetched_at")]
    left = listings.withWatermark("fetched_at", late).alias("l")
    renamed = [F.col("detail_url").alias("__url"), F.col("fetched_at").alias("__at"), *(F.col(c).alias(f"__{c}") for c in fields)]
    right = details.select("detail_url", "fetched_at", *fields).withWatermark("fetched_at", late).select(*renamed)
    timely = F.expr(f"__at >= fetched_at and __at <= fetched_at + interval {wait}")
    both = left.join(right, (F.col("detail_url") == F.col("__url")) & timely, "leftOuter")
    there = F.col("__url").isNotNull()
    own = [c for c in listings.columns if c not in fields]
    merged = [F.when(there, F.col(f"__{c}")).otherwise(F.col(c) if c in listings.columns else F.lit(None)).alias(c) for c in fields]
    return both.select(*own, *merged, there.alias("has_detail"))


def sessions(events: DataFrame, key: str, gap_seconds: int, late: str | None = None) -> DataFrame:
    """Runs of a key: its events (created_at, event_type, id) with no longer gap than so many whole seconds; also of a stream, where late is the watermark.

    Late events within the watermark join their run, and may join two.
    """
    timed = events.withWatermark("created_at", late) if late else events
    window = F.session_window("created_at", f"{gap_seconds + 1} seconds")
    count = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds))
    found = timed.groupBy(window.alias("run"), key).agg(F.min("id").alias("run_id"), F.min("created_at").alias("started_at"), F.max("created_at").alias("finished_at"), F.count("*").alias("pages_scraped"), count("ERROR").alias("errors_count"), count("NEW").alias("opportunities_new"), count("UPDATED", "AWARDED").alias("opportunities_updated"))
    return found.select("run_id", key, "started_at", "finished_at", "pages_scraped", "errors_count", "opportunities_new", "opportunities_updated")


def sliding(events: DataFrame, width: str, slide: str, late: str | None = None) -> DataFrame:
    """Events by type in windows that begin every ``slide``; also of a stream."""
    timed = events.withWatermark("created_at", late) if late else events
    found = timed.groupBy(F.window("created_at", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n")
