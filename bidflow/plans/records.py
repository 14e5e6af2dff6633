"""Records of each customer's page: tables, cards, structured data, rules, details, next pages.

Every page is written by Spark from its customer's row, read by the engine, and held against what
DuckDB computes from the row itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bidflow.functions import headers, text
from bidflow.sources import html, plugins, selectors, variant
from bidflow.sources import views as v

BASE = "https://bids.example.org/list/"


def _pages(spark, sf, body):
    c = text.spread(v.table(spark, sf, "customer"))
    return c.select(F.col("c_custkey").alias("page_id"), F.lit(BASE).alias("url"), body.alias("html"))


def _text(*parts):
    """Parts joined: strings as they are, columns as text."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _times(n, make):
    """make(i) for i from 1 to n, joined."""
    return F.array_join(F.transform(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), make), "")


def _k():
    return F.col("c_custkey")


def table_discovery(spark, sf):
    """Of a page's tables the surest one: a small one without ids, a large one with, one of unknown headers, one inside another."""
    k = _k()
    small = _text("<table><tr><th>Title</th><th>Location</th></tr>", _times(k % 4 + 1, lambda i: _text("<tr><td>site ", i, "</td><td>", F.col("c_mktsegment"), "</td></tr>")), "</table>")
    large = _text("<table><thead><tr><th>Bid Number<th>Project Title<th>Bid Status<th>Foo</thead><tbody>", _times(k % 6, lambda i: _text("<tr><td>B-", k, "-", i, "<td><a href='/d/", i, "'>", F.col("c_name"), "</a><td>Open<td><table><tr><td>in</table>")), "</table>")
    other = "<table><tr><th>Foo<th>Bar</tr><tr><td>1<td>2</table>"
    found = html.extract(_pages(spark, sf, _text("<html><body>", other, small, large)))
    return found.select("page_id", "method", F.round("confidence", 3).alias("confidence"), "row_index", "external_id", "title", "status", "location", "detail_url")


def table_fuzzy_headers(spark, sf):
    """Headers with slips, matched to the nearest known ones."""
    k = _k()
    slip = lambda *names: F.element_at(F.array(*(F.lit(n) for n in names)), (k % len(names) + 1).cast("int"))
    body = _text("<table><tr><th>", slip("Bid Numbr", "Bid Number", "RFP Numbers"), "<th>", slip("Closing Dat", "Zqx Wvk"), "<th>Titel<tr><td>", k, "<td>2024-01-02<td>", F.col("c_name"), "</table>")
    return html.extract(_pages(spark, sf, body)).select("page_id", F.round("confidence", 3).alias("confidence"), "external_id", "closing_at", "title")


def card_records(spark, sf):
    """Cards in the largest group of alike elements: ids, titles, statuses, agencies and dates by their signs."""
    k = _k()
    card = lambda i: _text(
        "<li class='search-result'><a href='#'>top</a><a href='/tender/", k, i, "00'>Supply of goods ", i, " to ", F.col("c_name"), "</a>\n<span class='badge'>", F.when(k % 3 == 0, "Open").otherwise("Awarded"),
        "</span>\n<div class='org'>Ministry of ", F.col("c_mktsegment"), "</div>\n<p>2024-0", i, "-15</p>\n<p>Jan ", i, ", 2024</p></li>\n",
    )
    body = _text("<ul class=nav><li><a href=/a>a</a><li><a href=/b>b</a><li><a href=/c>c</a></ul><ul class='results'>", _times(k % 4 + 3, card), "</ul>")
    return html.extract(_pages(spark, sf, body)).select("page_id", "method", F.round("confidence", 3).alias("confidence"), "row_index", "external_id", "title", "status", "agency", "closing_at", "posted_at", "detail_url")


def card_labels(spark, sf):
    """Labels and values within cards, in lists of terms, rows, parts named by class, and lines."""
    k = _k()
    card = lambda i: _text("<section class=item><h3>Works package ", i, "</h3>\n<dl><dt>Reference</dt><dd>R", k, "-", i, "</dd></dl>\n<table><tr><th>Buyer</th><td>", F.col("c_name"), "</td></tr></table>\n<div class='detail-row'><b class='header'>Type</b><i class='value'>", F.col("c_mktsegment"), "</i></div>\n<p>Deadline: in week ", i, "</p></section>\n")
    found = html.extract(_pages(spark, sf, _text("<div>", _times(F.lit(3), card), "</div>")))
    return found.select("page_id", "method", "row_index", "external_id", "title", "agency", "category", "closing_at")


def jsonld_properties(spark, sf):
    """Properties of linked data, of which a later one replaces an earlier one."""
    item = F.struct(
        _text("S-", _k()).alias("sku"), F.col("c_name").alias("name"), F.when(_k() % 2 == 0, _text("Headline ", _k())).alias("headline"), F.lit("about it").alias("abstract"), F.lit("2024-01-01").alias("datePosted"),
        F.when(_k() % 3 == 0, F.lit("2024-02-01")).alias("endDate"), F.lit("2024-03-01").alias("expires"), F.struct(F.col("c_mktsegment").alias("name")).alias("provider"), F.lit("goods").alias("category"),
        F.when(_k() % 5 == 0, F.lit("Service")).alias("@type"), F.array(F.struct(_text("Place ", F.col("c_nationkey")).alias("name"))).alias("areaServed"), _k().alias("price"), F.lit("EUR").alias("priceCurrency"),
        _text("d/", _k()).alias("url"), F.lit("a@b.c").alias("email"), F.lit("123").alias("telephone"),
    )
    body = _text("<script type='application/ld+json'>[", F.to_json(item), ", 5]</script><script type='application/ld+json'>{no json</script>")
    names = ["external_id", "title", "description", "posted_at", "closing_at", "agency", "category", "location", "estimated_value", "estimated_value_currency", "detail_url", "contact_email", "contact_phone"]
    return html.extract(_pages(spark, sf, body)).select("page_id", "method", F.round("confidence", 3).alias("confidence"), *names)


def _json_pages(spark, sf):
    k = _k()
    item = F.to_json(F.struct(F.when(k % 2 == 0, k).alias("bid_id"), _text("N", k).alias("number"), F.when(k % 3 == 0, F.lit("")).otherwise(F.col("c_name")).alias("title"), F.lit("fallback").alias("subject"), F.struct(F.col("c_mktsegment").alias("value")).alias("organization"), F.lit("dep").alias("department"), F.col("c_nationkey").alias("budget"), F.lit("2024-05-06").alias("due_date"), F.lit("x@y.z").alias("email")))
    keys = F.element_at(F.array(*(F.lit(x) for x in ("data", "results", "opportunities"))), (k % 3 + 1).cast("int"))
    body = F.when(k % 4 == 0, _text("[", item, ",", item, "]")).when(k % 4 == 1, item).when(k % 4 == 2, _text('{"', keys, '": [', item, ", 1]}")).otherwise(_text(' {"total": 1, "items": [], "records": [', item, "]}"))
    return _pages(spark, sf, body)


_PAYLOAD = ("page_id", "method", "confidence", "row_index", "external_id", "title", "agency", "department", "estimated_value", "closing_at", "contact_email")


def json_payloads(spark, sf):
    """Pages that are JSON: lists under several keys, aliases of fields in order."""
    return html.extract(_json_pages(spark, sf)).select(*_PAYLOAD)


def json_payloads_native(spark, sf):
    """The same pages, by VARIANT alone."""
    return variant.json_records(_json_pages(spark, sf)).select(*_PAYLOAD)


def mixed_payloads(spark, sf):
    """Of payloads of events, some of other shapes: the schema that fits all of a type, and their numbers."""
    e = v.table(spark, sf, "events")
    k = F.col("event_id")
    told = F.when(k % 5 == 0, F.concat(F.lit('{"k": "'), k.cast("string"), F.lit('", "more": [1, null]}'))).when(k % 7 == 0, "{broken").otherwise(F.col("props"))
    shapes = variant.shape(e.select("event_type", told.alias("props")), "props", "event_type")
    sums = e.groupBy("event_type").agg(F.sum(F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")).alias("sum_k"))
    return shapes.join(sums, "event_type").select("event_type", "shape", "n", "broken", "sum_k")


def next_selectors(spark, sf):
    """Strategy and shortest selector of each page's next-page element."""
    k = _k()
    body = F.element_at(
        F.array(
            _text("<nav><a href=/p/1>1</a><a rel=next href='/p/", k, "'>2</a></nav>"), _text("<p>", F.col("c_name"), "</p><a aria-label='Next page' href='/x'>n</a>"), _text("<a href='/a'>A</a><a title='Next' href='/", k, "' id='n", k, "'>B</a>"),
            F.lit("<ul><li class='x'><a href=1>1</a><li class='next-page'><a href=2>2</a></ul>"), _text("<div class='pager'><button>", k, "</button><button disabled>Next</button></div>"), F.lit("<p><a href='#'>on</a></p>"),
        ),
        (k % 6 + 1).cast("int"),
    )
    return selectors.next_selectors(_pages(spark, sf, body))


def _portal_pages(spark, sf):
    """A page of each customer on its nation's portal: tables, or JSON that names the next page."""
    k = _k()
    table = _text("<table><tr><th>Bid #<th>Title<th>Status<tr><td>B-", k, "<td>", F.col("c_name"), "<td>Open</table><a rel=next href='?page=", k, "'>2</a>")
    answer = _text('{"results": [{"id": "B-', k, '", "title": "', F.col("c_name"), '", "status": "Open"}], "links": {"next": "/api?page=', k, '"}}')
    c = text.spread(v.table(spark, sf, "customer"))
    found = c.select(k.alias("page_id"), F.col("c_nationkey").alias("portal_id"), F.lit(BASE).alias("url"), F.when(F.col("c_nationkey") % 3 == 0, answer).otherwise(table).alias("html"))
    kind = F.when(F.col("portal_id") % 3 == 0, "api_based").when(F.col("portal_id") == 1, "unheard_of").otherwise("generic_table")
    return found, v.portals(spark, sf).withColumn("portal_type", kind)


def plugin_records(spark, sf):
    """Records of all portals' pages, each read by its portal's plug-in."""
    return plugins.dispatched(*_portal_pages(spark, sf), "listing").select("page_id", "portal_id", "method", "external_id", "title", "status")


def plugin_pagination(spark, sf):
    """Where each page leads on to, as its portal's plug-in tells."""
    return plugins.dispatched(*_portal_pages(spark, sf), "pagination").select("page_id", "portal_id", "pagination", "strategy", "next_url")


def page_outline(spark, sf):
    """What every fetched page holds: its title, links, paragraphs, and how it would be paged."""
    return html.outline(v.table(spark, sf, "pages"))


def embedded_scripts(spark, sf):
    """JSON that scripts assign to variables or parse from strings."""
    k = _k()
    item = _text('{"id": ', k, ', "name": "', F.col("c_name"), '", "state": "open"}')
    body = F.when(k % 4 == 0, _text("window.__DATA__ = {\"items\": [", item, "]};")).when(k % 4 == 1, _text("window.initialData = ", item, ";")).when(k % 4 == 2, _text("var bids = [", item, "];")).otherwise(_text("x(JSON.parse('[", F.replace(item, F.lit('"'), F.lit('\\"')), "]'))"))
    return html.extract(_pages(spark, sf, _text("<script src=a.js>var data = {};</script><script>", body, "</script>"))).select("page_id", "method", F.round("confidence", 3).alias("confidence"), "external_id", "title", "status")


def data_attributes(spark, sf):
    k = _k()
    row = lambda i: _text("<tr data-bid-id='", k, "-", i, "' data-name=\"", F.col("c_name"), "\" data-state=open data-deadline=2024-01-0", i, "><td>x</td></tr>")
    return html.extract(_pages(spark, sf, _text("<table>", _times(k % 3 + 1, row), "</table>"))).select("page_id", "method", F.round("confidence", 3).alias("confidence"), "row_index", "external_id", "title", "status", "closing_at")


RULES = html.Rules(
    {
        "external_id": html.FieldRule(("b.no", "b"), regex=r"no (\d+)", required=True),
        "title": html.FieldRule(("i",)),
        "detail_url": html.FieldRule((".//a",), attribute="href"),
        "agency": html.FieldRule(("[data-who]",), attribute="data-who"),
    },
    "p.row",
)


def rule_records(spark, sf):
    """Declared selectors within containers, where no heuristic is sure."""
    k = _k()
    row = lambda i: _text("<p class='row r", i, "'><b>no ", k, F.lit("0"), i, "</b><i> ", F.col("c_name"), "  </i>", F.when(k % 2 == 0, _text("<a href='v/", i, "'>x</a>")).otherwise(""), "</p>")
    return html.extract(_pages(spark, sf, _text("<main>", _times(k % 2 + 1, row), "</main>")), rules=RULES).select("page_id", "method", F.round("confidence", 3).alias("confidence"), "row_index", "external_id", "title", "detail_url", "agency")


def rule_columns(spark, sf):
    """Without a container: lists of values, aligned by position."""
    k = _k()
    body = _text("<main>", _times(k % 2 + 1, lambda i: _text("<b>no ", k, i, "</b>")), _times(k % 3, lambda i: _text("<i>t", i, "</i>")), "</main>")
    return html.extract(_pages(spark, sf, body), 0.3, rules=html.Rules(RULES.fields)).select("page_id", "method", F.round("confidence", 3).alias("confidence"), "row_index", "external_id", "title")


def detail_fields(spark, sf):
    """Labels of detail pages; the last of a field's stays."""
    k = _k()
    body = _text("<h1>x</h1><dl><dt>Bid Number:</dt><dd>", k, "</dd><dt>Closing Date</dt><dd>2024-01-02</dd><dt>Foo</dt><dd>bar</dd></dl><table><tr><th>Department<td>", F.col("c_mktsegment"), "<tr><th>Due date<td>2024-02-03</table><span class='field-label'>Scope of work</span><span> all  of it </span>", F.when(k % 2 == 0, "<b class=label>Estimated value</b><i>$5</i>").otherwise(""))
    return html.details(_pages(spark, sf, body)).select("page_id", "confidence", "external_id", "closing_at", "agency", "description", "estimated_value", "source_url")


def next_page_url(spark, sf):
    k = _k()
    body = F.element_at(F.array(_text("<a href='#x' rel='next'>n</a><a class=next href='/p/", k, "'>x</a>"), _text("<li class='next'><a href='?page=", k, "'>2</a>"), _text("<div class='pagination'><a href=1>1</a><a href='q", k, "'>Next</a></div>"), _text("<a href=", k, ">Next Page</a>"), F.lit("<a href=x>prev</a>")), (k % 5 + 1).cast("int"))
    return html.next_pages(_pages(spark, sf, body))


def low_confidence_pages(spark, sf):
    """Pages of which no method is sure lose all their records."""
    k = _k()
    body = F.when(k % 3 == 0, _text("<table><tr><th>Foo<tr><td>", k, "</table>")).otherwise(_text("<table><tr><th>Title<th>Status<tr><td>", F.col("c_name"), "<td>Open</table>"))
    pages = _pages(spark, sf, body)
    found = html.extract(pages, 0.5).groupBy("page_id").agg(F.count("*").alias("n"))
    return pages.join(found, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("n_records"), F.when(F.col("n").isNull(), "failed").otherwise("ok").alias("page_status"))


def header_dictionary(spark, sf):
    """Every customer's header, exact in the dictionary of seventeen fields; the first field that has it wins."""
    h = F.element_at(F.array(*(F.lit(x) for x in _EXAMPLES)), (_k() % len(_EXAMPLES) + 1).cast("int"))
    return v.table(spark, sf, "customer").select("c_custkey", F.upper(h).alias("header"), headers.exact_field(F.upper(h)).alias("field"))


# Headers and the fields that they are to give, told one by one.
_EXAMPLES = {
    "itb #": "external_id", "notice id": "external_id", "description": "title", "short description": "title", "close date/time": "closing_at", "offer due": "closing_at", "expires": "closing_at", "advertised": "posted_at",
    "date issued": "posted_at", "state": "status", "stage": "status", "nigp code": "category", "goods/services": "category", "department": "agency", "bureau": "agency", "poc": "contact_name", "agent": "contact_name", "e-mail": "contact_email",
    "tel": "contact_phone", "award amount": "estimated_value", "funding": "estimated_value", "city": "location", "jurisdiction": "location", "awarded to": "awardee", "vendor": "awardee", "awarded": "award_date", "final value": "award_amount",
    "downloads": "documents", "rfp documents": "documents", "more info": "detail_url", "full details": "detail_url", "closing dates": None, "": None,
}


def _list(items):
    return "[" + ", ".join("null" if x is None else f"'{x}'" for x in items) + "]"


# Confidence of a table: 0.3 x mean of mapped headers + 0.4 x required / 2 + 0.2 x important / 4 + 0.1 x least(1, n / 5).
SQL = {
    "table_discovery": f"""with p as (select c_custkey as k, c_name, c_mktsegment, c_custkey % 6 as n2, c_custkey % 4 + 1 as n1 from customer),
 c as (select *, n2 > 0 as big from p)
 select k as page_id, 'table' as method, case when big then round_even(0.3::double * 3 / 4 + 0.4::double + 0.2::double / 4 + 0.1::double * least(1.0::double, n2 / 5.0::double), 3) else round_even(0.3::double + 0.2::double + 0.1::double * least(1.0::double, n1 / 5.0::double), 3) end as confidence,
 cast(i - 1 as int) as row_index, case when big then 'B-' || k || '-' || i end as external_id, case when big then c_name else 'site ' || i end as title, case when big then 'Open' end as status, case when not big then c_mktsegment end as location,
 case when big then 'https://bids.example.org/d/' || i end as detail_url from (select *, unnest(range(1, case when big then n2 else n1 end + 1)) as i from c)""",
    "table_fuzzy_headers": """select c_custkey as page_id, round_even(0.3::double * (case when c_custkey % 3 = 1 then 1.0::double else 0.7::double end + case when c_custkey % 2 = 0 then 0.7::double else 0 end + 0.7::double) / 3 + 0.4::double + case when c_custkey % 2 = 0 then 0.05::double else 0 end + 0.1::double / 5, 3) as confidence,
 cast(c_custkey as varchar) as external_id, case when c_custkey % 2 = 0 then '2024-01-02' end as closing_at, c_name as title from customer""",
    "card_records": """select c_custkey as page_id, 'card' as method, round_even(0.4::double * 5 / 6 + 0.4::double + 0.2::double * least(1.0::double, (c_custkey % 4 + 3) / 5.0::double), 3) as confidence, cast(i - 1 as int) as row_index,
 c_custkey || '' || i || '00' as external_id, 'Supply of goods ' || i || ' to ' || c_name as title, case when c_custkey % 3 = 0 then 'Open' else 'Awarded' end as status, 'Ministry of ' || c_mktsegment as agency, '2024-0' || i || '-15' as closing_at, 'Jan ' || i || ', 2024' as posted_at,
 'https://bids.example.org/tender/' || c_custkey || i || '00' as detail_url from (select *, unnest(range(1, c_custkey % 4 + 4)) as i from customer)""",
    "card_labels": """select c_custkey as page_id, 'card' as method, cast(i - 1 as int) as row_index, 'R' || c_custkey || '-' || i as external_id, 'Works package ' || i as title, c_name as agency, c_mktsegment as category, 'in week ' || i as closing_at from (select *, unnest([1, 2, 3]) as i from customer)""",
    "jsonld_properties": """select c_custkey as page_id, 'jsonld' as method, 0.95::double as confidence, 'S-' || c_custkey as external_id, case when c_custkey % 2 = 0 then 'Headline ' || c_custkey else c_name end as title, 'about it' as description, '2024-01-01' as posted_at, '2024-03-01' as closing_at,
 c_mktsegment as agency, case when c_custkey % 5 = 0 then 'Service' else 'goods' end as category, 'Place ' || c_nationkey as location, nullif(cast(c_custkey as varchar), '0') as estimated_value, 'EUR' as estimated_value_currency, 'https://bids.example.org/list/d/' || c_custkey as detail_url, 'a@b.c' as contact_email, '123' as contact_phone from customer""",
    **dict.fromkeys(("json_payloads", "json_payloads_native"), """select c_custkey as page_id, 'raw_json' as method, 0.9::double as confidence, cast(i as int) as row_index, case when c_custkey % 2 = 0 and c_custkey > 0 then cast(c_custkey as varchar) else 'N' || c_custkey end as external_id, case when c_custkey % 3 = 0 then 'fallback' else c_name end as title,
 c_mktsegment as agency, 'dep' as department, nullif(cast(c_nationkey as varchar), '0') as estimated_value, '2024-05-06' as closing_at, 'x@y.z' as contact_email from (select *, unnest(range(0, case when c_custkey % 4 = 0 then 2 else 1 end)) as i from customer)"""),
    "mixed_payloads": """with e as (select event_type, event_id, json_extract(props, '$.k')::bigint as k from events), t as (select event_type, count(*) as n, count(*) filter (event_id % 5 <> 0 and event_id % 7 = 0) as broken, bool_or(event_id % 5 = 0) as other, bool_or(event_id % 5 <> 0 and event_id % 7 <> 0) as plain, cast(sum(k) as bigint) as sum_k from e group by 1)
 select event_type, case when other and plain then 'OBJECT<k: VARIANT, more: ARRAY<BIGINT>>' when other then 'OBJECT<k: STRING, more: ARRAY<BIGINT>>' else 'OBJECT<k: BIGINT>' end as shape, n, broken, sum_k from t""",
    "next_selectors": """select c_custkey as page_id, list_extract(['rel', 'aria', 'title', 'class', 'text', null], cast(c_custkey % 6 + 1 as int)) as strategy, case c_custkey % 6 when 0 then '[rel]' when 1 then 'a' when 2 then case when c_custkey < 100 then '#n' || c_custkey else '[id]' end when 3 then '.next-page' when 4 then '[disabled]' end as selector,
 case when c_custkey % 6 < 5 then c_custkey % 6 = 4 end as disabled from customer""",
    "plugin_records": "select c_custkey as page_id, c_nationkey as portal_id, case when c_nationkey % 3 = 0 then 'raw_json' else 'table' end as method, 'B-' || c_custkey as external_id, c_name as title, 'Open' as status from customer where c_nationkey <> 1",
    "plugin_pagination": "select c_custkey as page_id, c_nationkey as portal_id, case when c_nationkey % 3 = 0 then 'next_link' else 'none' end as pagination, case when c_nationkey % 3 > 0 then 'rel' end as strategy, case when c_nationkey % 3 = 0 then 'https://bids.example.org/api?page=' || c_custkey else 'https://bids.example.org/list/?page=' || c_custkey end as next_url from customer where c_nationkey <> 1",
    "page_outline": r"""with p as (select page_id, regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs') as h from pages), q as (select page_id, regexp_replace(regexp_replace(h, '<script>.*?</script>', '', 'gs'), '<style>.*?</style>', '', 'gs') as h from p)
 select page_id, trim(regexp_replace(replace(replace(regexp_extract(h, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&amp;', '&'), '\s+', ' ', 'g')) as title, trim(regexp_replace(replace(replace(regexp_extract(h, '<h1>([^<]*)</h1>', 1), '&lt;', '<'), '&amp;', '&'), '\s+', ' ', 'g')) as heading, cast(len(regexp_extract_all(h, '<a ')) as bigint) as n_links, regexp_extract_all(h, '<a href="([^"]*)"', 1)[1] as first_link, cast(len(regexp_extract_all(h, '<p>')) as bigint) as n_paragraphs from q""",
    "embedded_scripts": """select c_custkey as page_id, 'embedded' as method, round_even(0.5::double + case when c_custkey = 0 then 3 else 4 end / 20.0::double, 3) as confidence, nullif(cast(c_custkey as varchar), '0') as external_id, c_name as title, 'open' as status from customer""",
    "data_attributes": """select c_custkey as page_id, 'data_attributes' as method, 0.75::double as confidence, cast(i - 1 as int) as row_index, c_custkey || '-' || i as external_id, c_name as title, 'open' as status, '2024-01-0' || i as closing_at from (select *, unnest(range(1, c_custkey % 3 + 2)) as i from customer)""",
    "rule_records": """select c_custkey as page_id, 'rules' as method, round_even(0.4::double * (case when c_custkey % 2 = 0 then 3 else 2 end / 4.0::double) + 0.4::double + 0.2::double * (c_custkey % 2 + 1) / 5.0::double, 3) as confidence, cast(i - 1 as int) as row_index, c_custkey || '0' || i as external_id, c_name as title,
 case when c_custkey % 2 = 0 then 'https://bids.example.org/list/v/' || i end as detail_url, cast(null as varchar) as agency from (select *, unnest(range(1, c_custkey % 2 + 2)) as i from customer)""",
    "rule_columns": """with p as (select c_custkey as k, c_custkey % 2 + 1 as n, c_custkey % 3 as m, greatest(c_custkey % 2 + 1, c_custkey % 3) as most from customer),
 r as (select *, round_even(0.4::double * ((n + m) / (most * 4.0::double)) + 0.4::double * (n / most::double) + 0.2::double * most / 5.0::double, 3) as confidence from p)
 select k as page_id, 'rules' as method, confidence, cast(i - 1 as int) as row_index, case when i <= n then k || '' || i end as external_id, case when i <= m then 't' || i end as title from (select *, unnest(range(1, most + 1)) as i from r where confidence >= 0.3)""",
    "detail_fields": f"""select c_custkey as page_id, 0.7::double as confidence, cast(c_custkey as varchar) as external_id, '2024-02-03' as closing_at, c_mktsegment as agency, 'all of it' as description, case when c_custkey % 2 = 0 then '$5' end as estimated_value, '{BASE}' as source_url from customer""",
    "next_page_url": """select c_custkey as page_id, case c_custkey % 5 when 0 then 'https://bids.example.org/p/' || c_custkey when 1 then 'https://bids.example.org/list/?page=' || c_custkey when 2 then 'https://bids.example.org/list/q' || c_custkey when 3 then 'https://bids.example.org/list/' || c_custkey end as next_url from customer""",
    "low_confidence_pages": "select c_custkey as page_id, case when c_custkey % 3 = 0 then 0 else 1 end::bigint as n_records, case when c_custkey % 3 = 0 then 'failed' else 'ok' end as page_status from customer",
    "header_dictionary": f"select c_custkey, upper(list_extract({_list(_EXAMPLES)}, c_custkey % {len(_EXAMPLES)} + 1)) as header, list_extract({_list(_EXAMPLES.values())}, c_custkey % {len(_EXAMPLES)} + 1) as field from customer",
}
