"""Counts, totals and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidflow.functions.status import ORDER


def count_by_status(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("id").alias("n"))


def status_percentages(df: DataFrame) -> DataFrame:
    """Statuses in their fixed order; others count in the total and aren't shown."""
    counts = count_by_status(df).withColumn("total", F.sum("n").over(Window.partitionBy()))
    place = F.array_position(F.array(*(F.lit(s) for s in ORDER)), F.col("status"))
    return counts.where(F.col("status").isin(ORDER)).select(place.cast("int").alias("place"), "status", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))


def run_summary(df: DataFrame) -> DataFrame:
    """Totals by portal and, in the row without a portal, over all."""
    sums = [F.sum(c).alias(c) for c in ("pages_scraped", "opportunities_new", "opportunities_updated", "errors_count")]
    return df.rollup("portal_id").agg(F.count("*").alias("runs"), *sums, F.grouping("portal_id").cast("int").alias("is_total"))


def portal_activity(opportunities: DataFrame, portals: DataFrame) -> DataFrame:
    """Each portal with its opportunities by status, their value and the next closing date.

    Opportunities are aggregated before they meet the portals, so that the join moves one row a portal.
    """
    is_ = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s.lower()}")
    per = opportunities.groupBy("portal_id").agg(
        F.count("*").alias("n"), is_("OPEN"), is_("AWARDED"), is_("PENDING"), F.sum(F.col("estimated_value").cast("decimal(18,2)")).cast("double").alias("value"), F.min(F.when(F.col("status") == "OPEN", F.col("closing_at"))).alias("first_closing")
    )
    zero = ["n", "n_open", "n_awarded", "n_pending"]
    return portals.join(per, "portal_id", "left").select("portal_id", "portal_name", "region", "enabled", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in zero), "value", "first_closing")


def quick_confidence(df: DataFrame) -> DataFrame:
    """Mean completeness of listing rows by portal: 0.4 for a title, 0.6 for five other fields."""
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0)
    fields = sum((filled(c) for c in ("external_id", "agency", "closing_text", "posted_text", "status_text")), F.lit(0))
    tenths = filled("title") * 10 + 3 * fields  # in parts of 25
    return df.groupBy("portal_id").agg(F.count("*").alias("n"), F.bround(F.least(F.lit(1.0), F.sum(tenths) / 25.0 / F.count("*")), 6).alias("confidence"))
