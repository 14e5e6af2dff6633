"""Listing pages as a stream: extract, normalise, keep the portals' state and append events.

State and events are Parquet tables of numbered versions. A micro-batch writes the version of its
own batch number from the one before it, so a batch that is run again after a failure overwrites
what it wrote and nothing is applied twice. Each batch writes the whole state; where that is large beside a
batch, streaming.keyed keeps it in Spark's state store and writes the keys of the batch alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bidflow.operators import cdc
from bidflow.operators.canonical import canonical

PAGE = "page_id long, url string, html string, fetched_at timestamp"
#: A row of the portals' state: its key, the canonical fields, and when it was seen last.
STATE = (
    "portal_id int, external_id string, title string, description string, description_markdown string, posted_at timestamp_ntz, closing_at timestamp_ntz, awarded_at timestamp_ntz, status string, "
    "category string, commodity_codes string, agency string, department string, location string, contact_name string, contact_email string, contact_phone string, estimated_value double, "
    "estimated_value_currency string, award_amount double, awardee string, source_url string, detail_url string, extraction_confidence double, last_seen_at timestamp_ntz"
)


def normalized(records: DataFrame, portal_id: int, as_of: Column) -> DataFrame:
    """Extracted records as rows of the state."""
    return canonical(records, as_of).drop("warnings").select(F.lit(portal_id).alias("portal_id"), "*", as_of.alias("last_seen_at"))


def version(path: str, table: str, n: int) -> str:
    return f"{path}/{table}/v{n:09d}"


def _printed_state(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The state after batch n (before the first: empty), with the fingerprints that it was written with."""
    schema = f"{STATE}, fingerprint string"
    return spark.read.schema(schema).parquet(version(path, "state", n)) if n >= 0 else spark.createDataFrame([], schema)


def state_of(spark: SparkSession, path: str, n: int) -> DataFrame:
    return _printed_state(spark, path, n).drop("fingerprint")


def apply_batch(batch: DataFrame, n: int, path: str) -> None:
    """batch: rows of the state (fields that it lacks are null), of which the last of a key counts (by its other columns, if a batch has several)."""
    spark = batch.sparkSession
    state = _printed_state(spark, path, n - 1)
    seen = F.current_timestamp().cast("timestamp_ntz")
    told = {f.name: F.col(f.name) if f.name in batch.columns else F.lit(None).cast(f.dataType) for f in state.schema.fields if f.name != "fingerprint"}
    whole = batch.select(*(c.alias(name) for name, c in told.items())).withColumn("last_seen_at", F.coalesce("last_seen_at", seen))
    once = whole.groupBy(*cdc.KEY).agg(F.max(F.struct(*(c for c in whole.columns if c not in cdc.KEY))).alias("r")).select(*cdc.KEY, "r.*").select(whole.columns)
    cdc.events_of(cdc.classified(state, once)).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(version(path, "events", n))
    cdc.upserted(state, once, seen).write.mode("overwrite").parquet(version(path, "state", n))


def stream_listings(records: DataFrame, path: str) -> StreamingQuery:
    """Runs through what is there and ends; records: a streaming DataFrame of rows of the state."""
    return records.writeStream.foreachBatch(lambda df, n: apply_batch(df, n, path)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def page_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files).parquet(folder)


def first_seen(records: DataFrame, late: str = "1 hour") -> DataFrame:
    """A record of a page once, whatever page it comes on again within the watermark."""
    return records.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["url", "external_id"])


def events_per_window(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts of events (created_at: timestamp, event_type) in tumbling windows, late ones within the watermark included."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("window_start"), "event_type", "n", "value")
