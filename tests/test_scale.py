"""Work that is dealt over tasks, bounded in memory, and done once."""

import yaml
from pyspark.sql import functions as F

from bidflow.functions import text
from bidflow.operators import canonical, runs
from bidflow.plans import keeping, operations, records
from bidflow.sources import config, html, markup, settings, variant
from tests.compare import SF_DIR


def _below_shuffle(df) -> str:
    """The optimized plan of what a task of the scan does."""
    return df._jdf.queryExecution().optimizedPlan().toString().partition("Repartition")[2]


def test_pages_of_one_file_are_dealt_over_tasks(spark):
    """One file of one row group was one task: F1, F6, F8, F9, F14 to F16, F19, F20, F22."""
    cores = spark.sparkContext.defaultParallelism
    for query in (records.card_labels, records.table_discovery, records.card_records, records.next_page_url, records.next_selectors, records.rule_records, records.rule_columns, records.detail_fields):
        df = query(spark, SF_DIR)
        assert df.rdd.getNumPartitions() == 4 * cores
        assert "<" not in _below_shuffle(df)  # pages are written above the shuffle
    for query in (records.plugin_records, records.plugin_pagination):
        assert "Repartition" in query(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()


def test_json_is_read_above_the_shuffle(spark):
    """tests of records for being some went below the shuffle, into the one task of the scan."""
    assert "json" not in _below_shuffle(records.json_payloads_native(spark, SF_DIR))


def test_json_records_come_from_the_first_list_with_some(spark):
    pages = [(1, '{"items": [], "data": [5], "records": [{"id": 0, "number": "7", "buyer": {"name": "", "value": 3}, "title": true}], "id": "outer"}'), (2, '{"data": [{"x": 1}], "id": "outer"}'), (3, "5"), (4, "{bad"), (5, None)]
    found = variant.json_records(spark.createDataFrame([(i, "", h) for i, h in pages], "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.row_index, r.external_id, r.title, r.agency) for r in found) == [(1, 0, "7", "True", "3"), (2, 0, "outer", None, None)]


def test_configurations_are_dealt_over_tasks_and_read_once(spark, monkeypatch):
    """JSON goes to the faster reader; what both readers don't take alike goes to PyYAML's own."""
    assert keeping.config_validation(spark, SF_DIR).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    slow = []
    monkeypatch.setattr(yaml, "safe_load", lambda text, load=yaml.safe_load: slow.append(text) or load(text))
    assert config.read('{"name": "A", "n": [1, 1e3, "12:30"]}') == {"name": "A", "n": [1, "1e3", "12:30"]} and not slow
    for odd in ("- 1\t\n", '{"a":\t1}'):
        try:
            config.read(odd)
        except yaml.YAMLError:
            slow.append("refused")
    assert slow.count("refused") == 2
    assert [h[1] for h in settings._holders({"search_form": 5}, "search_form.submit.method")] == [{}] and not [*settings._holders({}, "search_form.submit.method")]


def test_outline_reads_two_entities(spark):
    """as its SQL reads them."""
    page = "<title>a&amp b&amp;c &quot;d&quot;</title><h1>x &amp;lt; y&lt;</h1>"
    row = html.outline(spark.createDataFrame([(1, page)], "page_id long, html string")).first()
    assert (row.title, row.heading) == ("a&amp b&c &quot;d&quot;", "x &lt; y<")
    assert markup.text_of(markup.parse(page)) == 'a& b&c "d"x &lt; y<'


def test_records_of_few_pages_are_held_at_a_time():
    """F5, F10, F12, F13, F18."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"page_id": list(range(2 * html.SLICE + 3))})
    assert [b.num_rows for b in html.sliced([batch, batch.slice(0, 0)])] == [html.SLICE, html.SLICE, 3]


def test_what_labels_tell_is_not_looked_for(monkeypatch):
    """F7."""
    monkeypatch.setattr(html, "card_agency", None)
    monkeypatch.setattr(html, "card_status", None)
    card = "<div class=card><h3><a href=/bids/1>Supply of goods</a></h3><dl><dt>Bid Number<dd>B1<dt>Agency<dd>A<dt>Closing Date<dd>soon<dt>Status<dd>Open</dl></div>"
    sure, found = html.of_cards(markup.parse(f"<div>{card * 3}</div>"), "https://e.org/")
    assert found[0] == {"detail_url": "https://e.org/bids/1", "title": "Supply of goods", "external_id": "B1", "agency": "A", "closing_at": "soon", "status": "Open"}


def test_best_groups_as_by_scoring_all():
    page = "<ul class=results>" + "<li class=item><a href=x>a</a>" * 4 + "</ul><div>" + "<p>b" * 9 + "</div>" + "<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>" * 5
    root = markup.parse(page)
    every = html.card_groups(root, 100)
    assert len(every) == 13 and [s for s, _ in every] == sorted((s for s, _ in every), reverse=True)
    for most in (1, 2, 5, 12):
        assert html.card_groups(root, most) == every[:most]


def test_cron_by_bits(spark):
    """fields told as text or by a column give the same; days and hours that there aren't give none."""
    now = F.lit("2024-02-29 23:59:30").cast("timestamp_ntz")
    told = {"*/20 22 * * 0": "2024-03-03 22:00:00", "0 0 29 2 0": "2032-02-29 00:00:00", "0 0 30 2 *": None, "59 23 29 2 4": "2052-02-29 23:59:00", "5,1/30 0-23/5 0/10 1,3 *": "2024-03-10 00:01:00", "99 * * * *": None, "*/0 * * * *": None, "70 1-2 * 12/3 6": None, "whenever": None, "0 0 1 1 6-6 x": "2028-01-01 00:00:00"}
    df = spark.createDataFrame([*told.items()], "e string, at string")
    assert df.select("at", runs.next_cron(F.col("e"), now).cast("string").alias("found")).where("not at <=> found").count() == 0
    for e in ("*/20 22 * * 0", "5,1/30 0-23/5 0/10 1,3 *", "whenever"):
        assert spark.range(1).select(runs.next_cron(e, now).cast("string")).first()[0] == told[e]
    for query in (operations.cron_next, operations.cron_far, operations.zoned_schedules):
        assert query(spark, SF_DIR).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_canonical_rows_are_dealt_out_before_their_texts_are_made(spark):
    """texts were made in the task of the scan, and the rest in as many tasks as the join was left with."""
    df = operations.canonical_rows(spark, SF_DIR)
    assert df.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    below = _below_shuffle(df)
    assert "Join" in below and "date_format" not in below and "format_number" not in below


def test_bound_values_are_not_elements_of_transformed_arrays(spark):
    """reading these derives the type of all that is done with the value in every row."""
    df = spark.createDataFrame([(" a ",), (None,)], "t string").select(text.bound(F.trim("t"), lambda x: F.concat(x, x, F.coalesce(F.lit("!"), x))).alias("x"))
    assert [r.x for r in df.collect()] == ["aa!", None] and "transform(" not in df._jdf.queryExecution().analyzed().toString()


def test_confidences_that_are_no_numbers(spark):
    """those without a digit, inf or nan aren't cast; the others are as before."""
    raw = spark.createDataFrame([("1", "n/a"), ("2", " 0.5 "), ("3", "-Infinity"), ("4", "1e-1"), ("5", None), ("6", "x1"), ("7", "")], "id string, confidence string")
    rows = canonical.canonical(raw, F.lit("2024-01-01").cast("timestamp_ntz"))
    assert {r.external_id: r.extraction_confidence for r in rows.collect()} == {"1": 0.0, "2": 0.5, "3": float("-inf"), "4": 0.1, "5": 0.0, "6": 0.0, "7": 0.0}
    assert "inf|nan" in rows._jdf.queryExecution().analyzed().toString()
