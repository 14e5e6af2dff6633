"""The page archive as a data source: ranges of bytes, filters, and a stream that goes on from its offset."""

import datetime
import json

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from bidflow.sources import archive
from bidflow.sources import views as v
from bidflow.streaming import listings
from tests.compare import SF_DIR


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    archive.register(spark)


def fetched(spark):
    day = F.make_dt_interval((F.col("page_id") % 5).cast("int"), F.lit(0), F.col("page_id").cast("int"))
    return v.table(spark, SF_DIR, "pages").select("url", "html", F.when(F.col("page_id") % 4 == 0, 404).otherwise(200).alias("status_code"), (F.lit("2024-03-01").cast("timestamp") + day).alias("fetched_at"), F.create_map(F.lit("Server"), F.lit("x")).alias("headers"), F.lit(1.5).alias("elapsed_ms"))


def test_reads_what_was_written(spark, tmp_path):
    pages = fetched(spark)
    archive.write(pages, str(tmp_path / "a"))
    found = spark.read.format("page_archive").option("slicebytes", 2000).load(str(tmp_path / "a"))
    told = [c for c in pages.columns if c != "headers"]
    assert found.select(told).exceptAll(pages.select(told)).isEmpty() and found.count() == pages.count()
    assert found.rdd.getNumPartitions() > 50 and found.select("page_id").distinct().count() == pages.count()
    whole = spark.read.format("page_archive").load(f"file://{tmp_path}/a")
    assert sorted(r[0] for r in whole.select("url").collect()) == sorted(r[0] for r in found.select("url").collect())
    assert found.select(F.element_at("headers", "Server")).distinct().collect()[0][0] == "x"


def test_filters_leave_out_days_and_pages(spark, tmp_path):
    pages = fetched(spark)
    archive.write(pages, str(tmp_path / "a"))
    found = spark.read.format("page_archive").load(str(tmp_path / "a"))
    for test in ("fetched_at >= '2024-03-04' and status_code = 200", "fetched_at < '2024-03-02 00:20:00'", "status_code in (404, 500)", "url like 'http%' and elapsed_ms > 1", "fetched_at between '2024-03-02' and '2024-03-03'", "status_code = 1"):
        assert found.where(test).count() == pages.where(test).count(), test
    reader = archive.Reader({"path": str(tmp_path / "a")})
    every = len(reader.partitions())
    left = list(reader.pushFilters([ds.GreaterThanOrEqual(("fetched_at",), datetime.datetime(2024, 3, 4)), ds.EqualTo(("html",), "x")]))
    assert [f.attribute for f in left] == [("html",)] and 0 < len(reader.partitions()) < every
    assert {p.path.split("day=")[1][:10] for p in reader.partitions()} == {"2024-03-04", "2024-03-05"}


def test_odd_lines(spark, tmp_path):
    (tmp_path / "a").mkdir()
    long = "x" * 1500
    lines = ["{", "[1]", "", '{"url": 5, "status_code": "200", "headers": [1], "fetched_at": "then"}', json.dumps({"url": "Zürich\n", "html": long, "fetched_at": "2024-01-01T01:00:00+01:00"}), '{"url": "last", "status_code": true, "retry_count": 2}']
    (tmp_path / "a" / "1.jsonl").write_bytes("\n".join(lines).encode())
    (tmp_path / "a" / "_hidden").write_bytes(b"{}\n")
    for size in (97, 801, 1 << 20):
        rows = spark.read.format("page_archive").option("slicebytes", size).load(str(tmp_path / "a")).collect()
        assert sorted(str(r["error"]) for r in rows) == ["None"] * 3 + ["not a JSON object"] * 2
        by = {r["url"]: r for r in rows if r["error"] is None}
        assert by["Zürich\n"]["html"] == long and by["Zürich\n"]["fetched_at"] == datetime.datetime(2024, 1, 1) and by["last"]["retry_count"] == 2 and by["last"]["status_code"] is None
    (tmp_path / "empty").mkdir()
    assert spark.read.format("page_archive").load(str(tmp_path / "empty")).isEmpty()


def test_stream_goes_on_from_its_offset(spark, tmp_path):
    """Lines are read once, the half of a line when it is whole, files behind the last one when they come."""
    folder, out = tmp_path / "a", str(tmp_path / "out")
    folder.mkdir()
    line = lambda i: json.dumps({"url": f"https://e.org/{i}", "html": f"<title>{i}</title>", "fetched_at": f"2024-01-01T00:00:{i:02d}Z"}) + "\n"

    def run():
        stream = spark.readStream.format("page_archive").option("slicebytes", 150).load(str(folder))
        stream.select("page_id", "url", "html").writeStream.format("parquet").option("path", f"{out}/pages").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return sorted(int(r["url"].rsplit("/", 1)[1]) for r in spark.read.parquet(f"{out}/pages").collect())

    (folder / "1.jsonl").write_text(line(1) + line(2) + line(3)[:20])
    assert run() == [1, 2]
    with (folder / "1.jsonl").open("a") as f:
        f.write(line(3)[20:] + line(4))
    assert run() == [1, 2, 3, 4]
    (folder / "2.jsonl").write_text(line(5))
    with (folder / "1.jsonl").open("a") as f:
        f.write(line(6))
    assert run() == [1, 2, 3, 4, 5, 6]
    assert run() == [1, 2, 3, 4, 5, 6]
    assert archive.StreamReader({"path": str(folder)}).latestOffset() == {"file": str(folder / "2.jsonl"), "byte": len(line(5))}


def test_archive_to_state(spark, tmp_path):
    """Pages of an archive stream become records and the portals' state."""
    from bidflow.sources import html

    table = "<table><tr><th>Bid #<th>Title<th>Status<th>Closing Date" + "".join(f"<tr><td>B-{i}<td>Works {i}<td>Open<td>2030-01-0{i}" for i in range(1, 5)) + "</table>"
    pages = spark.createDataFrame([("https://e.org/l", table, "2024-01-01")], "url string, html string, t string").select("url", "html", F.col("t").cast("timestamp").alias("fetched_at"))
    archive.write(pages, str(tmp_path / "a"))
    records = html.extract(spark.readStream.format("page_archive").load(str(tmp_path / "a")).select("page_id", "url", "html"))
    rows = listings.normalized(records, 7, F.lit("2029-01-01").cast("timestamp_ntz"))
    listings.stream_listings(rows, str(tmp_path / "s")).awaitTermination()
    assert {r["external_id"] for r in listings.state_of(spark, str(tmp_path / "s"), 0).collect()} == {f"B-{i}" for i in range(1, 5)}
