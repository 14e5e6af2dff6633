"""Keyed state of the stream against merges in batch, with rows that expire."""

from pyspark.sql import functions as F

from bidflow.operators import cdc
from bidflow.sources import views as v
from bidflow.streaming import keyed
from bidflow.streaming.listings import STATE
from tests.compare import SF_DIR

FIELDS = ["portal_id", "external_id", "title", "agency", "category", "status", "posted_at", "closing_at", "estimated_value", "contact_name"]


def sighted(spark, later, at):
    return v.snapshot(spark, SF_DIR, later).where("id < 400").select(*FIELDS, F.lit(at).cast("timestamp").alias("fetched_at"))


def whole(spark, df):
    fields = spark.createDataFrame([], STATE).schema.fields
    return df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields if f.name != "last_seen_at"))


def same(a, b):
    return a.exceptAll(b.select(a.columns)).isEmpty() and a.count() == b.count()


def test_two_runs_and_an_expiry(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    first, second = sighted(spark, False, "2024-01-01 00:00:00"), sighted(spark, True, "2024-01-10 00:00:00").where("external_id not like '%3'")
    stream = lambda: spark.readStream.schema(first.schema).parquet(folder)
    first.coalesce(1).write.parquet(folder)
    keyed.keep(stream(), out).awaitTermination()
    second.coalesce(1).write.mode("append").parquet(folder)
    keyed.keep(stream(), out).awaitTermination()

    old, new = whole(spark, first), whole(spark, second)
    assert same(keyed.state(spark, out).drop("last_seen_at"), cdc.upserted(old, new).drop("fingerprint"))
    seen = {r["external_id"]: str(r["last_seen_at"]) for r in keyed.state(spark, out).collect()}
    assert {t[:10] for e, t in seen.items() if e.endswith("3")} == {"2024-01-01"}
    assert {t[:10] for e, t in seen.items() if not e.endswith("3")} == {"2024-01-10"}
    wanted = cdc.events_of(cdc.classified(whole(spark, first).limit(0), old)).unionByName(cdc.events_of(cdc.classified(old, new)))
    assert same(keyed.events(spark, out), wanted)

    # A page long after the first run, before the second one's rows are due: what that run alone had seen expires if it is open.
    later = first.limit(1).withColumns({"external_id": F.lit("other"), "fetched_at": F.lit("2024-02-05 00:00:00").cast("timestamp")})
    later.coalesce(1).write.mode("append").parquet(folder)
    keyed.keep(stream(), out).awaitTermination()
    expired = {(r["portal_id"], r["external_id"]) for r in keyed.events(spark, out).where("event_type = 'EXPIRED'").collect()}
    missed = cdc.disappeared(keyed.state(spark, out), F.lit("2024-02-04 23:00:00").cast("timestamp_ntz"), 30)
    assert expired == {(r["portal_id"], r["external_id"]) for r in missed.collect()} and len(expired) > 5
    again = keyed.events(spark, out).count()
    keyed.keep(stream(), out).awaitTermination()  # nothing new: nothing told twice
    assert keyed.events(spark, out).count() == again


def test_changed_keys_alone_are_written(spark, tmp_path):
    """A micro-batch of a few keys tells of these keys and of no other."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = sighted(spark, False, "2024-01-01 00:00:00")
    first.coalesce(1).write.parquet(folder)
    stream = lambda: spark.readStream.schema(first.schema).parquet(folder)
    keyed.keep(stream(), out).awaitTermination()
    few = first.where("external_id in ('OPP-1', 'OPP-2', 'OPP-5')").withColumn("title", F.when(F.col("external_id") == "OPP-5", F.lit("new")).otherwise(F.col("title")))
    twice = few.withColumns({"fetched_at": F.lit("2024-01-02 00:00:00").cast("timestamp"), "title": F.lit("older")}).unionByName(few.withColumn("fetched_at", F.lit("2024-01-03 00:00:00").cast("timestamp")))
    before = keyed.told(spark, out).count()
    twice.coalesce(1).write.mode("append").parquet(folder)
    keyed.keep(stream(), out).awaitTermination()
    told = keyed.told(spark, out)
    assert told.count() == before + 3
    assert {(r["external_id"], r["outcome"]) for r in told.where("last_seen_at > '2024-01-02 12:00:00'").collect()} == {("OPP-1", "UNCHANGED"), ("OPP-2", "UNCHANGED"), ("OPP-5", "UPDATED")}
    totals = keyed.counters(spark, out).agg(F.sum("new"), F.sum("updated"), F.sum("unchanged")).first()
    assert tuple(totals) == (before, 1, 2)
