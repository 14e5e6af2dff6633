from pyspark.sql import functions as F

from bidflow.operators import cdc
from bidflow.sources import views as v
from bidflow.streaming import listings as s
from tests.compare import SF_DIR


def state_rows(df):
    return df.select("portal_id", "external_id", "title", "agency", "category", "status", "posted_at", "closing_at", "estimated_value", "contact_name")


def test_stream_equals_batch(spark, tmp_path):
    """Two snapshots that arrive one after the other leave the state and events of two batch merges."""
    folder = str(tmp_path / "in")
    old, new = (state_rows(v.snapshot(spark, SF_DIR, later)) for later in (False, True))
    old.coalesce(1).write.parquet(folder)
    out = str(tmp_path / "out")
    records = spark.readStream.schema(old.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    s.stream_listings(records, out).awaitTermination()
    new.coalesce(1).write.mode("append").parquet(folder)
    s.stream_listings(records, out).awaitTermination()
    empty = spark.createDataFrame([], s.STATE)
    whole = lambda df: df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema.fields))
    first = cdc.upserted(empty, whole(old)).drop("fingerprint")
    both = cdc.upserted(first, whole(new)).drop("fingerprint", "last_seen_at")
    whole_state = s.state_of(spark, out, 1)
    got = whole_state.drop("last_seen_at")
    assert whole_state.where("last_seen_at is null").isEmpty()
    assert got.exceptAll(both.select(got.columns)).isEmpty() and got.count() == both.count()
    events = spark.read.parquet(s.version(out, "events", 1)).drop("batch")
    wanted = cdc.events_of(cdc.classified(first, whole(new)))
    assert events.exceptAll(wanted).isEmpty() and events.count() == wanted.count()


def test_a_batch_again_changes_nothing(spark, tmp_path):
    batch = state_rows(v.snapshot(spark, SF_DIR, False).where("id < 100"))
    for _ in range(2):
        s.apply_batch(batch, 0, str(tmp_path))
    assert s.state_of(spark, str(tmp_path), 0).count() == batch.count()


def test_windows(spark, tmp_path):
    v.events(spark, SF_DIR).withColumn("created_at", F.col("created_at").cast("timestamp")).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "e")).schema).parquet(str(tmp_path / "e"))
    query = s.events_per_window(stream).writeStream.outputMode("complete").format("memory").queryName("per_window").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("per_window").agg(F.sum("n")).first()[0] == v.events(spark, SF_DIR).count()


def test_pages_to_state(spark, tmp_path):
    """Pages become records, canonical rows, and a state with all their fields."""
    from bidflow.sources import html

    page = "<table><tr><th>Bid #<th>Title<th>Status<th>Closing Date<th>Estimated Value<th>Email" + "".join(f"<tr><td>B-{i}<td>Works {i}<td>Open<td>2030-01-0{i}<td>$1,500.50<td>a@b.c" for i in range(1, 5)) + "</table>"
    pages = spark.createDataFrame([(1, "https://e.org/l", page)], "page_id long, url string, html string")
    rows = s.normalized(html.extract(pages), 7, F.lit("2029-01-01").cast("timestamp_ntz"))
    s.apply_batch(rows, 0, str(tmp_path))
    s.apply_batch(rows.where("external_id > 'B-2'").withColumn("last_seen_at", F.lit("2029-02-01").cast("timestamp_ntz")), 1, str(tmp_path))
    got = {r["external_id"]: r for r in s.state_of(spark, str(tmp_path), 1).collect()}
    assert len(got) == 4 and got["B-1"]["contact_email"] == "a@b.c" and got["B-4"]["estimated_value"] == 1500.5 and got["B-4"]["status"] == "OPEN"
    assert [got[f"B-{i}"]["last_seen_at"].month for i in range(1, 5)] == [1, 1, 2, 2]
    assert spark.read.parquet(s.version(str(tmp_path), "events", 1)).count() == 0


def test_first_seen(spark, tmp_path):
    for n, rows in enumerate(([("u", "a", "2024-01-01 00:00:00"), ("u", "a", "2024-01-01 00:10:00")], [("u", "a", "2024-01-01 00:20:00"), ("u", "b", "2024-01-01 00:20:00")])):
        spark.createDataFrame(rows, "url string, external_id string, t string").selectExpr("url", "external_id", "cast(t as timestamp) as fetched_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema("url string, external_id string, fetched_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "r"))
    query = s.first_seen(stream).writeStream.format("memory").queryName("first_seen").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["external_id"] for r in spark.table("first_seen").collect()) == ["a", "b"]


def test_page_stream(spark, tmp_path):
    """Pages that arrive as files become the state, file by file."""
    from bidflow.sources import html

    page = lambda n: "<table><tr><th>Bid #<th>Title<th>Status<th>Closing Date" + "".join(f"<tr><td>B-{n}{i}<td>Works {i}<td>Open<td>2030-01-0{i}" for i in range(1, 5)) + "</table>"
    for n in range(2):
        spark.createDataFrame([(n, f"https://e.org/{n}", page(n), "2024-01-01 00:00:00")], "page_id long, url string, html string, t string").selectExpr("page_id", "url", "html", "cast(t as timestamp) as fetched_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = s.normalized(html.extract(s.page_stream(spark, str(tmp_path / "in"), files=1)), 7, F.lit("2029-01-01").cast("timestamp_ntz"))
    s.stream_listings(rows, str(tmp_path / "out")).awaitTermination()
    assert {r["external_id"] for r in s.state_of(spark, str(tmp_path / "out"), 1).collect()} == {f"B-{n}{i}" for n in range(2) for i in range(1, 5)}
    assert s.state_of(spark, str(tmp_path / "out"), 0).count() == 4
