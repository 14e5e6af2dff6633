"""How many runs overlap: a sweep over their ends, dealt out by slices of time.

A run holds from its start to its end, both included. Starts and ends become steps of +1 and -1, which are added up
by key and time before they are shuffled. The steps of a slice of time are one window; what a slice begins with is the sum of all
slices before it, found over one row a slice. So a key, or all keys together, is as many tasks as it has slices, not one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def steps(runs: DataFrame, *key: str) -> DataFrame:
    """(key, at, step): changes of how many runs hold, by microseconds; a run without a start or an end, or that ends before it starts, holds never."""
    held = runs.where("started_at <= finished_at")
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ends = F.array(F.struct(at("started_at").alias("at"), F.lit(1).alias("step")), F.struct((at("finished_at") + 1).alias("at"), F.lit(-1).alias("step")))
    return held.select(*key, F.inline(ends)).groupBy(*key, "at").agg(F.sum("step").alias("step"))


def levels(runs: DataFrame, *key: str, slice_seconds: int = 3600) -> DataFrame:
    """(key, at, level, micros): how many runs hold from a time on, and for how long."""
    dealt = steps(runs, *key).withColumn("slice", F.floor(F.col("at") / (slice_seconds * 1_000_000)))
    slices = dealt.groupBy(*key, "slice").agg(F.sum("step").alias("sum"), F.min("at").alias("first"))
    by = Window.partitionBy(*key).orderBy("slice")
    carried = slices.select(*key, "slice", (F.sum("sum").over(by) - F.col("sum")).alias("before"), F.lead("first").over(by).alias("next"))
    within = Window.partitionBy(*key, "slice").orderBy("at")
    told = dealt.join(carried, [*key, "slice"]).withColumns({"level": F.col("before") + F.sum("step").over(within), "until": F.coalesce(F.lead("at").over(within), F.col("next"))})
    return told.select(*key, "at", "level", F.coalesce(F.col("until") - F.col("at"), F.lit(0)).alias("micros"))


def overlapping(runs: DataFrame, *key: str, limit: int = 1, slice_seconds: int = 3600) -> DataFrame:
    """Of each key: most_at_once, when that was so first, and how long (times_over, micros_over) more than limit runs held."""
    over = F.col("level") > limit
    found = levels(runs, *key, slice_seconds=slice_seconds)
    top = found.groupBy(*key).agg(F.max(F.struct("level", -F.col("at"))).alias("top"), F.coalesce(F.sum(F.when(over, F.col("micros"))), F.lit(0)).alias("micros_over"))
    return top.select(*key, F.col("top.level").alias("most_at_once"), F.timestamp_micros(-F.col("top.col2")).cast("timestamp_ntz").alias("first_at"), "micros_over")
