from bidflow.sources import html, markup


def test_malformed_table():
    page = "<table><tr><th>Bid Number<th>Title<tr><td>A-1<td><a href=/x>One<br>two</a><tr><td><td></table>"
    assert html.extract_page(page, "https://e.org/l", 0.1) == ("table", 0.72, [{"external_id": "A-1", "title": "One two", "detail_url": "https://e.org/x"}])


def test_table_without_key_headers():
    assert html.extract_page("<table><tr><th>Foo<tr><td>1</table>", "", 0.1) == ("pipeline_failed", 0.0, [])


def test_empty_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (None, "u", "<p>x")], "page_id long, url string, html string")
    assert html.extract(pages).count() == 0
    assert html.extract(pages.limit(0)).count() == 0


def test_linked_data_with_bad_json():
    page = '<script type="application/ld+json">{bad</script><script type="application/ld+json">[{"name": ["T"], "identifier": {"value": 7}, "url": "/a"}, 3]</script>'
    assert html.of_linked(html.dom(page), "https://e.org/") == [{"external_id": "7", "title": "T", "detail_url": "https://e.org/a"}]


def test_embedded_json():
    one = '{"bid_id": 7, "name": "A; b};", "buyer": {"name": "X"}, "due_date": "2024-01-02", "state": "open", "link": "/a"}'
    record = {"external_id": "7", "title": "A; b};", "agency": "X", "closing_at": "2024-01-02", "status": "open", "detail_url": "https://e.org/a"}
    quoted = one.replace('"', '\\"')
    for script in (f'window.__DATA__ = {{"results": [{one}]}};', f"window.initialData={one};", f'var data = {{"items": [{one}, 3]}};', f"var bids = [{one}];", f"var opportunities = [{one}]\n;", f"x = JSON.parse( '[{quoted}]' )"):
        method, _, records = html.extract_page(f"<script>bad = 1; {script} var data = {{bad}};</script>", "https://e.org/l", 0.4)
        assert (method, records) == ("embedded", [record])
    deep = f'<script>var data = {{"page": {{"rows": [{one}]}}}};</script>'
    assert html.extract_page(deep, "https://e.org/l", 0.4)[0] == "pipeline_failed"
    assert html.extract_page(deep, "https://e.org/l", 0.4, ("no.such", "page.rows"))[2] == [record]


def test_markup():
    root = markup.parse("<!doctype html><div id=a class='x Y'>1 &lt; 2<!-- <b> --><br>three<p>four<p>five</div><script>if (a<b) '</p>'</script><a href=\"/q?a=1&amp;b='2'\" DATA-X>t</a>&amp;")
    (div,) = markup.select(root, "div#a.x.Y")
    assert markup.text_lines(div) == ["1 < 2", "threefourfive"] and [p.text for p in markup.select(root, "div > p, nothing")] == ["four", "five"]
    (a,) = markup.select(root, 'a[href*="a=1"][data-x]:contains("t")')
    assert a.get("href") == "/q?a=1&b='2'" and root.find("script").text == "if (a<b) '</p>'"
    assert markup.selected(root, "div[") == [] and len(markup.selected(root, "//p")) == 2
    assert markup.parse("").tag == "root" and markup.text_of(markup.parse("<td>x<table><tr><td>y</table>z")) == "xyz"


def test_nested_tables_keep_their_rows():
    page = "<table><thead><tr><th>Bid #<th>Title<th>Due Dates<tbody>" + "".join(f"<tr><td>B-{i}<td><table><tr><td>in{i}<td>x</table><td>2024-01-0{i}" for i in range(1, 6)) + "</table>"
    method, sure, records = html.extract_page(page, "https://e.org", 0.4)
    assert method == "table" and [r["external_id"] for r in records] == [f"B-{i}" for i in range(1, 6)] and records[0]["closing_at"] == "2024-01-01"
    # Two exact headers and a similar one, both required fields, one important, five rows.
    assert sure == round(0.3 * 2.7 / 3 + 0.4 + 0.2 / 4 + 0.1, 3)


def test_the_best_table_is_chosen():
    small = "<table><tr><th>Title<tr><td>x</table>"
    large = "<table><tr><th>Bid Number<th>Title<th>Status" + "".join(f"<tr><td>{i}<td>t{i}<td>Open" for i in range(9)) + "</table>"
    assert len(html.extract_page(small + large + small, "", 0.4)[2]) == 9
    assert html.table_score(["title", "status", None, "location"], 5, False) == 17 and html.table_score(["title"], 2, True) == 2.5 and html.table_score(["title"], 101, False) == 12


def test_cards():
    card = '<li class="result-card"><a href="/view/12">more</a><a class=title href="/tender/AB-1234?x">Road works in the north</a><span class="status-badge">Closing soon</span><div class="org">Town of Elm, Department of Roads</div>\n<p>Posted: Jan 5, 2024</p>\n<p>Due 2024-02-03</p></li>'
    method, sure, records = html.extract_page(f'<ul class="results">{card * 4}</ul>', "https://e.org/l", 0.4)
    assert method == "card" and len(records) == 4 and records[0] == {"detail_url": "https://e.org/tender/AB-1234?x", "title": "Road works in the north", "external_id": "AB-1234", "status": "Closing soon", "agency": "Town of Elm, Department of Roads", "posted_at": "Jan 5, 2024", "closing_at": "Jan 5, 2024"}
    assert sure == round(0.4 * 5 / 6 + 0.4 + 0.2 * 4 / 5, 3)
    assert html.group_score(40, 50, 1, 1, 5) == 30 * 4.5 + 1.6 + 5 and html.group_score(5, 5, 0, 0, 0) == (5 + 2) * 0.4
    assert html.agency_score("City of Springfield") == 6 + 4.5 + 2 and html.agency_score("Closed") == 0 - 6 + 0 and html.agency_score("due 2024-01-01") == 0
    assert html.card_id(markup.parse("<p>see RFP-2024-07 now"), "https://e.org/a?bid=9") == "9" and html.card_id(markup.parse("<p>see RFP-2024-07 now"), None) == "RFP-2024-07"


def test_labels():
    root = markup.parse('<div class="detail-row"><b class="header">Status</b><i class="value">Open</i></div><span class="label">Buyer</span><span>City</span><table><tr><th>Category<td>IT</table><dl><dt>Bid no<dd>7</dl>Deadline: soon')
    found = {html.label_of(label): value for label, value in html.label_pairs(root)}
    assert found == {"status": "Open", "agency": "City", "category": "IT", "external_id": "7", "closing_at": "soon"}
    assert [html.label_of(x) for x in ("Issue Date:", "End of term", "???", "E-mail", "Winners")] == ["posted_at", "closing_at", None, "contact_email", "awardee"]


def test_raw_json_and_attributes():
    assert html.extract_page('{"results": [{"id": 1, "title": "t", "department": "d"}]}', "", 0.9) == ("raw_json", 0.9, [{"external_id": "1", "title": "t", "department": "d"}])
    page = '<p data-id=5 data-name=n data-due=d data-other-x=o>x</p><p data-item="">'
    assert html.extract_page(page, "", 0.4) == ("data_attributes", 0.5 + 5 / 20, [{"external_id": "5", "title": "n", "closing_at": "d", "other_x": "o"}])
    assert html.nested({"a": [{"b": 3}]}, "a.0.b") == 3 and html.nested({"a": [1]}, "a.1") is None


def test_rules():
    page = "<main>" + "".join(f'<section><h4>no {i}: x</h4><a href="/d/{i}"> t  {i}</a></section>' for i in range(3)) + "<h4>no 9: y</h4></main>"
    fields = {"external_id": html.FieldRule(("h5", "h4"), regex=r"no (\d+)", required=True), "title": html.FieldRule(("a",)), "detail_url": html.FieldRule((".//a",), attribute="href")}
    root = markup.parse(page)
    inside = html.Rules(fields, "section").records(root, "https://e.org/")
    assert inside == [{"external_id": str(i), "title": f"t {i}", "detail_url": f"https://e.org/d/{i}"} for i in range(3)]
    columns = html.Rules(fields).records(root, "https://e.org/")
    assert columns == [*inside, {"external_id": "9"}]
    assert html.Rules(fields).confidence(columns) == round(0.4 * 10 / 12 + 0.4 + 0.2 * 4 / 5, 3)
    assert html.extract_page(page, "https://e.org/", 0.4, rules=html.Rules(fields))[0] in ("card", "rules")


def test_detail_pages():
    page = "<dl><dt>Bid Number:<dd>7<dt>Closing date<dd>d1<dt>Due date<dd>d2</dl><div id=about>All  of it</div>"
    assert html.of_detail(page, "u") == {"external_id": "7", "closing_at": "d2", "source_url": "u"}
    rules = html.Rules({"title": html.FieldRule(("#about",))})
    assert html.of_detail(page, "u", rules, "#about") == {"title": "All of it", "description": "All of it", "external_id": "7", "closing_at": "d2", "source_url": "u"}


def test_next_pages(spark):
    pages = [(1, '<a rel="next" href="?p=2">x</a>'), (2, '<li class=next><a href="#">'), (3, '<div class=pagination><a href=/3>Next</a></div>'), (4, None), (5, '<a href="n">Next Page</a>')]
    df = spark.createDataFrame([(i, "https://e.org/l", h) for i, h in pages], "page_id long, url string, html string")
    assert {r["page_id"]: r["next_url"] for r in html.next_pages(df).collect()} == {1: "https://e.org/l?p=2", 2: None, 3: "https://e.org/3", 4: None, 5: "https://e.org/n"}


def test_aliases_and_further_extractors(spark):
    page = "<table><tr><th>Vergabe-Nr<th>Titel der Sache<tr><td>7<td>Straße</table>"
    assert html.extract_page(page, "", 0.4, aliases={"vergabe-nr": "external_id", "titel der sache": "title"})[2] == [{"external_id": "7", "title": "Straße"}]
    df = spark.createDataFrame([(1, "u", "<p>odd")], "page_id long, url string, html string")
    own = ("paragraphs", lambda root, url: (0.9, [{"title": markup.text_of(p)} for p in root.iter("p")]))
    assert [(r["method"], r["title"]) for r in html.extract(df, extractors=(own,)).collect()] == [("paragraphs", "odd")]
    rules = html.Rules.of({"container_selector": "p", "fields": {"title": "b", "external_id": {"selectors": ["i"], "regex": r"\d+", "required": True}}})
    assert rules.container == "p" and rules.fields["external_id"].required and rules.records(markup.parse("<p><b>t</b><i>no 5</i>"), "") == [{"title": "t", "external_id": "5"}]


def test_structured_options():
    """Linked data first or last, scripts read or not, and JSON pages without a tree."""
    from bidflow.sources import html

    page = '<script type="application/ld+json">{"name": "linked", "identifier": "L"}</script><script>var data = {"items": [{"id": "E", "title": "embedded"}]};</script><p data-id="D" data-title="attribute">x</p>'
    method = lambda **more: html.extract_page(page, "https://e.org", 0.4, **more)[0]
    assert method() == "jsonld" and method(linked_first=False) == "embedded" and method(linked_first=False, embedded=False) == "data_attributes"
    assert html.extract_page(page.split("</script>")[0] + "</script>", "", 0.4, linked_first=False)[0] == "jsonld"
    assert html.extract_page('[{"id": 1, "title": "t"}]', "", 0.9)[:2] == ("raw_json", 0.9) and html.extract_page('[{"id": 1, "title": "t"}]', "", 0.95)[0] == "pipeline_failed"


def test_links_of_filtered_rows(spark):
    from bidflow.operators.listing import quick_filter

    links = ["/d/1?x=1", "d/2", "https://o.org/3", "", None, "//h.org/4"]
    rows = spark.createDataFrame([(i, "t", x) for i, x in enumerate(links)], "id int, title string, detail_url string")
    got = [r["detail_url"] for r in quick_filter(rows, base_url="https://e.org/list/page?q=1").orderBy("id").collect()]
    assert got == ["https://e.org/d/1?x=1", "https://e.org/list/d/2", "https://o.org/3", "", None, "https://h.org/4"]
