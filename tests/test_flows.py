"""Streams that wait, against batch: details within their time, sessions with late events, counters on the way."""

import time

from pyspark.sql import functions as F

from bidflow.operators import cdc, progress
from bidflow.sources import views as v
from bidflow.streaming import flows, keyed
from tests.compare import SF_DIR

EVENT = "id long, opportunity_id long, event_type string, created_at timestamp"


def put(spark, folder, schema, *rows):
    spark.createDataFrame(rows, schema.replace("timestamp", "string")).select(*(F.col(x.split()[0]).cast(x.split()[1]) for x in schema.split(", "))).coalesce(1).write.mode("append").parquet(str(folder))


def run(stream, out, mode="append"):
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def test_sessions_at_the_edge(spark):
    rows = [(1, 7, "NEW", "2024-01-01 00:00:00"), (2, 7, "ERROR", "2024-01-01 00:30:00.999999"), (3, 7, "UPDATED", "2024-01-01 01:01:01.999999"), (4, 8, "NEW", "2024-01-01 00:10:00")]
    events = spark.createDataFrame(rows, EVENT.replace("timestamp", "string")).withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert sorted((r["run_id"], r["pages_scraped"], r["errors_count"]) for r in flows.sessions(events, "opportunity_id", 1800).collect()) == [(1, 2, 1), (3, 1, 0), (4, 1, 0)]


def test_session_stream_equals_runs(spark, tmp_path):
    """Events that arrive out of order, within the watermark, make the runs that batch finds; the last open ones close once time goes on."""
    events = v.events(spark, SF_DIR).withColumn("created_at", F.col("created_at").cast("timestamp"))
    part = events.withColumn("turn", (F.floor(F.unix_seconds("created_at") / 86400 / 6) + F.when(F.col("id") % 9 == 0, 1).otherwise(0)))
    turns = [r[0] for r in part.select("turn").distinct().orderBy("turn").collect()]
    folder, out = tmp_path / "in", str(tmp_path / "out")
    for turn in turns:
        part.where(F.col("turn") == turn).drop("turn").coalesce(1).write.mode("append").parquet(str(folder))
        run(flows.sessions(spark.readStream.schema(events.schema).parquet(str(folder)), "opportunity_id", 1800, late="20 days"), out)
    put(spark, folder, "id long, opportunity_id long, event_type string, diff string, value double, created_at timestamp", (10**9, -1, "NEW", None, None, "2025-01-01 00:00:00"))
    for _ in range(2):
        run(flows.sessions(spark.readStream.schema(events.schema).parquet(str(folder)), "opportunity_id", 1800, late="20 days"), out)
    got = spark.read.parquet(f"{out}/rows").where("opportunity_id >= 0").select("run_id", "started_at", "finished_at", "pages_scraped", "errors_count")
    wanted = v.runs(spark, SF_DIR).select("run_id", F.col("started_at").cast("timestamp").alias("started_at"), F.col("finished_at").cast("timestamp").alias("finished_at"), "pages_scraped", "errors_count")
    assert got.exceptAll(wanted).isEmpty() and got.count() == wanted.count()


def test_late_and_absent_details(spark, tmp_path):
    lists, pages, out = tmp_path / "l", tmp_path / "d", str(tmp_path / "out")
    listing, detail = "external_id string, detail_url string, title string, fetched_at timestamp", "detail_url string, title string, agency string, fetched_at timestamp"

    def flow():
        run(flows.with_details(spark.readStream.schema(listing).parquet(str(lists)), spark.readStream.schema(detail).parquet(str(pages)), "1 hour", "10 minutes"), out)
        return {r["external_id"]: (r["title"], r["agency"], r["has_detail"]) for r in spark.read.parquet(f"{out}/rows").collect()}

    put(spark, lists, listing, ("a", "/a", "A", "2024-01-01 10:00:00"), ("b", "/b", "B", "2024-01-01 10:00:00"), ("c", "/c", "C", "2024-01-01 10:00:00"), ("n", None, "N", "2024-01-01 10:00:00"))
    put(spark, pages, detail, ("/a", None, "agency a", "2024-01-01 10:05:00"))
    assert flow() == {"a": (None, "agency a", True)}  # the others wait
    put(spark, pages, detail, ("/b", "new B", "agency b", "2024-01-01 10:50:00"), ("/c", "x", "too late", "2024-01-01 11:00:01"))
    assert flow() == {"a": (None, "agency a", True), "b": ("new B", "agency b", True)}
    put(spark, lists, listing, ("z", "/z", "Z", "2024-01-01 15:00:00"))
    put(spark, pages, detail, ("/y", "y", "y", "2024-01-01 15:00:00"))
    flow()
    put(spark, lists, listing, ("c2", "/c", "late list", "2024-01-01 10:30:00"))  # behind the watermark
    put(spark, pages, detail, ("/y", "y", "y", "2024-01-01 15:30:00"))
    assert flow() == {"a": (None, "agency a", True), "b": ("new B", "agency b", True), "c": ("C", None, False), "n": ("N", None, False)}


def test_counters_of_a_pass(spark):
    classes = cdc.classified(v.snapshot(spark, SF_DIR, False), v.snapshot(spark, SF_DIR, True))
    written = []
    counts = progress.write_measured(classes.select("outcome"), lambda df: written.append(df.groupBy("outcome").count().collect()))
    wanted = cdc.run_counters(classes).agg(*(F.sum(c).alias(c) for c in ("found", "new", "updated", "unchanged"))).first().asDict()
    assert {k: counts[k] for k in wanted} == wanted and len(written) == 1


def test_progress_of_a_stream(spark, tmp_path):
    folder, told = str(tmp_path / "in"), []
    rows = v.snapshot(spark, SF_DIR, False).where("id < 200").select("portal_id", "external_id", "title", "status", F.lit("2024-01-01").cast("timestamp").alias("fetched_at"))
    listener = progress.Progress(lambda n, counts, total: told.append((n, counts, total)))
    spark.streams.addListener(listener)
    try:
        for again in range(2):
            rows.withColumn("title", F.when((F.lit(again) == 1) & (F.col("external_id") == "OPP-1"), F.lit("x")).otherwise(F.col("title"))).coalesce(1).write.mode("append").parquet(folder)
            keyed.keep(spark.readStream.schema(rows.schema).parquet(folder), str(tmp_path / "out")).awaitTermination()
        for _ in range(100):
            if len(told) == 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    n = rows.count()
    assert [t[1] for t in told] == [{"found": n, "new": n, "updated": 0, "unchanged": 0, "expired": 0}, {"found": n, "new": 0, "updated": 1, "unchanged": n - 1, "expired": 0}]
    assert told[-1][2] == {"found": 2 * n, "new": n, "updated": 1, "unchanged": n - 1, "expired": 0}
