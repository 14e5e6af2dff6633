import hashlib

from bidflow.operators import listing, runs
from bidflow.sources import config, pages


def test_variables_and_faults():
    assert config.loaded("a: ${X}-${Y:-d}${Z}\nb: [1, '${X}']", {"X": "x"}) == {"a": "x-d", "b": [1, "x"]} and config.loaded("") == {}
    assert config.faults({"name": "n", "base_url": "u"}) == [] and config.faults([1]) == ["document: not a mapping"]
    assert config.faults({"name": "", "max_pages": 2000, "min_delay_ms": 5, "max_delay_ms": 1, "enabled": "x", "portal_type": "crawl4ai", "confidence_threshold": 2}) == [
        "name: is not within 1 and 100", "base_url: is missing", "enabled: is no bool", "max_pages: is not within 1 and 1000", "confidence_threshold: is not within 0 and 1", "portal_type: is unknown", "max_delay_ms: is less than min_delay_ms",
    ]


def test_portal_configs(spark, tmp_path):
    files = {"a.yaml": "name: a\nbase_url: ${BASE:-http://a}", "b.yml": "name: a\nbase_url: http://b", "c.yaml": "name: c", "bad.yaml": "a: [", "_skip.yaml": "name: s\nbase_url: x", "no.txt": "name: t"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = {r["portal_name"]: r for r in config.portal_configs(spark, str(tmp_path), {}).collect()}
    assert set(got) == {"a", "c", None} and got["a"]["base_url"] == "http://b" and got["a"]["faults"] == [] and got["c"]["faults"] == ["base_url: is missing"] and got[None]["faults"][0].startswith("document")
    assert got["a"]["config_hash"] == hashlib.sha256(files["b.yml"].encode()).hexdigest()[:16]
    (tmp_path / "d.yaml").write_text("name: d\nbase_url: http://d")
    old = spark.createDataFrame([("a", "http://a", "old"), ("z", "http://z", "h")], "portal_name string, base_url string, config_hash string")
    state = config.synced(old, config.portal_configs(spark, str(tmp_path), {}))
    assert {(r["portal_name"], r["outcome"]) for r in state.collect()} == {("a", "updated"), ("d", "created"), ("z", "absent")}
    again = config.synced(state.drop("outcome"), config.portal_configs(spark, str(tmp_path), {}))
    assert {(r["portal_name"], r["outcome"]) for r in again.collect()} == {("a", "unchanged"), ("d", "unchanged"), ("z", "absent")}


def test_sections():
    from bidflow.sources.settings import FIELDS, completed, section_faults

    good = {"name": "n", "base_url": "https://e.org", "seed_urls": ["https://e.org/l"]}
    assert section_faults(good) == [] and len(FIELDS) > 80
    assert section_faults({}) == ["name: is missing", "base_url: is missing", "seed_urls: is missing"]
    bad = good | {
        "base_url": "ftp://x", "seed_urls": [], "backend": {"preferred": "curl", "fallbacks": ["http", "x"], "timeout_seconds": 0}, "politeness": {"min_delay_ms": 900, "max_delay_ms": 800, "max_retries": 11, "concurrency": True}, "discovery": {"pagination": {"type": "none", "max_pages": 0, "cutoff_days": 0}},
        "extraction": {"confidence_threshold": 1.5, "listing": {"fields": {"title": {"regex": "("}, "x": 5}}}, "navigation": {"steps": [{"action": "click"}, {"timeout_ms": 5}]}, "search_form": {"fields": [{"name": "q", "type": "secret"}]}, "playwright": [],
    }
    assert sorted(section_faults(bad)) == sorted([
        "seed_urls: is not at least 1", "backend.preferred: is none of http, playwright, crawl4ai", "backend.timeout_seconds: is not within 1 and 300", "politeness.concurrency: is no int", "politeness.max_retries: is not within 0 and 10",
        "discovery.pagination.max_pages: is not within 1 and 1000", "discovery.pagination.cutoff_days: is not at least 1", "extraction.confidence_threshold: is not within 0 and 1", "extraction.listing.fields.x: is no mapping",
        "navigation.steps.1.action: is missing", "navigation.steps.1.timeout_ms: is not within 1000 and 120000", "search_form.fields.0.selector: is missing", "search_form.fields.0.type: is none of text, select, checkbox, radio, date, autocomplete",
        "playwright: is no mapping", "politeness.max_delay_ms: is less than min_delay_ms", "backend.fallbacks: x is none of http, playwright, crawl4ai", "base_url: is no URL", "extraction.listing.fields.title.regex: is no pattern",
    ])
    assert section_faults(good | {"politeness": {"max_delay_ms": 400}}) == ["politeness.max_delay_ms: is less than min_delay_ms"] and section_faults(good | {"politeness": {"min_delay_ms": 3000}}) == []
    whole = completed(good | {"navigation": {"steps": [{"action": "wait"}]}, "discovery": {"pagination": {"max_pages": 7}}})
    assert whole["display_name"] == "n" and whole["discovery"]["pagination"]["max_pages"] == 7 and whole["politeness"]["max_retries"] == 3 and whole["navigation"]["steps"][0]["timeout_ms"] == 30000


def test_chosen(spark):
    import pytest

    table = spark.createDataFrame([("a", True), ("b", False)], "portal_name string, enabled boolean")
    assert config.chosen(table, every=True).count() == 2 and config.chosen(table, "b").count() == 1
    for wrong in ({}, {"name": "a", "every": True}):
        with pytest.raises(ValueError):
            config.chosen(table, **wrong)


def test_chains_stop_at_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 7), (8, None)], "page_id long, next_id long")
    start = spark.createDataFrame([(1,), (7,), (8,), (9,)], "page_id long")
    got = sorted(tuple(r) for r in pages.page_chain(links, start, 10).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (7, 7, 1), (8, 8, 1), (9, 9, 1)]
    assert pages.page_chain(links, start, 2).where("start_id = 1").count() == 2


def test_long_chains(spark):
    """Chains of hundreds of pages, into a circle and to an end, by few rounds."""
    n = 700
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(n, n - 9), (n, n - 5), (5000, 0), (9000, 9001)], "page_id long, next_id long")
    start = spark.createDataFrame([(0,), (5000,), (9000,), (n - 3,), (0,)], "page_id long")
    for most in (1000, 300, 1):
        wanted = set()
        for s in (0, 5000, 9000, n - 3):
            seen, page = [], s
            nexts = {i: i + 1 for i in range(n)} | {n: n - 9, 5000: 0, 9000: 9001}
            while page is not None and page not in seen and len(seen) < most:
                seen.append(page)
                page = nexts.get(page)
            wanted |= {(s, p, d) for d, p in enumerate(seen, 1)}
        got = [tuple(r) for r in pages.page_chain(links, start, most).collect()]
        assert set(got) == wanted and len(got) == len(wanted)


def test_exports(spark, tmp_path):
    df = spark.sql("select 4 as id, 'x' as external_id, 't' as title, 'd' as description, 'a' as agency, 'OPEN' as status, 'c' as category, timestamp_ntz'2024-01-02 03:04:05' as posted_at, cast(null as timestamp_ntz) as closing_at, 0.0D as estimated_value, 3 as portal_id, '/d' as detail_url")
    read = lambda name: "\n".join(line for p in sorted((tmp_path / name).glob("part-*")) for line in p.read_text().splitlines())
    for name in ("e.csv", "e.json", "e.jsonl"):
        listing.write_export(df, str(tmp_path / name))
    assert read("e.csv").splitlines()[1] == '4,x,t,OPEN,a,"",2024-01-02T03:04:05,"",""'
    import json

    rows = json.loads(read("e.json"))
    assert len(rows) == 1 and list(rows[0]) == listing.JSON_COLUMNS and rows[0]["closing_at"] is None and rows[0]["description"] == "d"
    assert list(json.loads(read("e.jsonl"))) == listing.JSONL_COLUMNS


def test_jitter(spark):
    values = [r["x"] for r in spark.range(200).select(runs.jitter(100, 300, 7).alias("x")).collect()]
    assert all(0.1 <= x <= 0.3 for x in values) and len(set(values)) > 50
