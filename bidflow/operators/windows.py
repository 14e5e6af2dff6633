"""Window behaviours: first and last wins, versions, bursts, gaps, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str, n: int) -> DataFrame:
    row = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("id")))
    return df.withColumn("rank", row).where(F.col("rank") <= n)


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.withColumn("__row", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__row = 1").drop("__row")


def bursts(df: DataFrame, seconds: int, most: int) -> DataFrame:
    """Requests of a key within the last seconds, and how long the next one has to wait."""
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    window = Window.partitionBy("opportunity_id").orderBy("at").rangeBetween(-seconds * 1_000_000, 0)
    told = df.withColumn("at", at).withColumns({"n": F.count("*").over(window), "oldest": F.min("at").over(window)})
    wait = F.when(F.col("n") >= most, F.col("oldest") + seconds * 1_000_000 - F.col("at")).otherwise(0)
    return told.select("id", "opportunity_id", "n", wait.cast("long").alias("wait_micros"))


def gaps(df: DataFrame, least: int) -> DataFrame:
    before = F.lag("created_at").over(Window.partitionBy("opportunity_id").orderBy("created_at", "id"))
    gap = F.timestamp_diff("MICROSECOND", before, F.col("created_at"))
    return df.select("id", "opportunity_id", gap.alias("gap_micros"), F.coalesce(gap < least * 1_000_000, F.lit(False)).alias("too_soon"))


def version_diffs(df: DataFrame) -> DataFrame:
    """Each version beside the one before it."""
    w = Window.partitionBy("opportunity_id").orderBy("created_at", "id")
    return df.select("id", "opportunity_id", F.row_number().over(w).alias("version"), F.lag("event_type").over(w).alias("before"), F.col("event_type").alias("after"), (~F.lag("event_type").over(w).eqNullSafe(F.col("event_type"))).alias("changed"))


def version_as_of(df: DataFrame, moments: DataFrame) -> DataFrame:
    """The version of each key that is current at each moment (columns moment_id, opportunity_id, moment).

    Versions and moments are united and sorted once by key and time; the last version seen is the current one.
    """
    left = df.select("opportunity_id", F.col("created_at").alias("at"), F.lit(0).alias("kind"), "id", "event_type", F.lit(None).cast("long").alias("moment_id"))
    right = moments.select("opportunity_id", F.col("moment").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("event_type"), "moment_id")
    w = Window.partitionBy("opportunity_id").orderBy("at", "kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumns({"current_id": F.last("id", True).over(w), "current_type": F.last("event_type", True).over(w)})
    return both.where("kind = 1").select("moment_id", "opportunity_id", "current_id", "current_type")


def until_stop(pages: DataFrame, key: str, order: str, stop, most: int) -> DataFrame:
    """Pages of each crawl up to the first one that meets stop (that one not), at most ``most`` of them; page_number counts from 1."""
    w = Window.partitionBy(key).orderBy(order)
    told = pages.withColumns({"page_number": F.row_number().over(w), "__stops": F.sum(F.coalesce(stop, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return told.where((F.col("__stops") == 0) & (F.col("page_number") <= most)).drop("__stops")


def first_signatures(pages: DataFrame, key: str, order: str, signature) -> DataFrame:
    """pages with ``repeats``: whether an earlier page of the crawl has the same signature."""
    seen = F.row_number().over(Window.partitionBy(key, "__signature").orderBy(order))
    return pages.withColumn("__signature", signature).withColumn("repeats", seen > 1).drop("__signature")
