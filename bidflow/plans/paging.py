"""Pages: block signs, pagination, hosts, ids and dates in text."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidflow.functions import text
from bidflow.operators import windows
from bidflow.plans.ctes import OPPORTUNITIES
from bidflow.sources import pages as p
from bidflow.sources import views as v


def _pages(spark, sf):
    return v.table(spark, sf, "pages")


def _marked(spark, sf):
    """Pages with signs that the raw ones lack, by page id."""
    signs = ["", "<p>Please solve this CAPTCHA</p>", '<a rel="next" href="/p2">more</a>', "<button>Load More</button>", '<div class="infinite-scroll"></div>']
    sign = F.element_at(F.array(*(F.lit(s) for s in signs)), (F.col("page_id") % 5 + 1).cast("int"))
    return _pages(spark, sf).withColumn("html", F.concat(F.coalesce("html", F.lit("")), sign))


def block_detector(spark, sf):
    code = F.element_at(F.array(*(F.lit(c) for c in (200, 404, 403, 429))), (F.col("page_id") % 4 + 1).cast("int"))
    return p.fetch_result(_marked(spark, sf), code)


def pagination_type(spark, sf):
    return _marked(spark, sf).select("page_id", p.pagination_type(F.col("html")).alias("pagination"))


def url_host_stats(spark, sf):
    return _pages(spark, sf).groupBy(text.host_of(F.col("url")).alias("host"), text.slug_of(F.col("url")).alias("slug")).agg(F.count("*").alias("pages"), F.sum(F.octet_length("html").cast("long")).alias("bytes"))


def external_id_from_url(spark, sf):
    return _pages(spark, sf).select("page_id", p.external_id_of(F.col("url"), F.concat(F.lit("see RFP-2024-"), F.col("page_id").cast("string"))).alias("external_id"))


def first_url(spark, sf):
    return _pages(spark, sf).select("page_id", text.first_url(F.concat_ws(" ", F.lit("at"), "url", F.lit("<end>"))).alias("url"))


def page_links(spark, sf):
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return _pages(spark, sf).select("page_id", F.explode(hrefs).alias("href")).groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("href").alias("distinct_links"))


def page_title(spark, sf):
    return _pages(spark, sf).select("page_id", text.clean_html_text(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"))


def dates_in_documents(spark, sf):
    found = F.regexp_extract_all("text", F.lit(r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b"), 0)
    return v.table(spark, sf, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.get(found, F.lit(0)).alias("closing_text"), F.get(found, F.lit(1)).alias("posted_text"))


def contacts_in_text(spark, sf):
    mails = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), 0)
    phones = F.regexp_extract_all("text", F.lit(r"\+?\d? ?\(\d{3}\) \d{3}-\d{4}"), 0)
    return v.table(spark, sf, "documents").select("doc_id", F.size(mails).cast("long").alias("emails"), F.size(phones).cast("long").alias("phones"))


def total_records_text(spark, sf):
    o = v.opportunities(spark, sf)
    line = F.concat(F.lit("Showing "), (F.col("id") % 40 * 25 + 1).cast("string"), F.lit("-"), (F.col("id") % 40 * 25 + 25).cast("string"), F.lit(" of "), F.format_number(F.col("id") + 1000, 0))
    t = o.select("id", p.totals(F.when(F.col("id") % 9 != 0, line).otherwise("none")).alias("t"))
    return t.select("id", F.col("t.first").alias("first"), F.col("t.last").alias("last"), F.col("t.total").alias("total"), F.ceil(F.col("t.total") / (F.col("t.last") - F.col("t.first") + 1)).cast("int").alias("page_count"))


def page_chain(spark, sf):
    links = _pages(spark, sf).select("page_id", F.when(F.col("page_id") % 7 != 0, F.col("page_id") + 3).alias("next_id"))
    return p.page_chain(links, _pages(spark, sf).select("page_id"), 5)


def crawl_until_stop(spark, sf):
    """Conversations as crawls: pages up to the first short or repeated one, ten at most."""
    c = windows.first_signatures(v.table(spark, sf, "conversations"), "conv_id", "turn", F.md5(F.coalesce("text", F.lit(""))))
    short = F.length(F.coalesce("text", F.lit(""))) < 60
    return windows.until_stop(c, "conv_id", "turn", short | F.col("repeats"), 10).select("conv_id", "turn", "page_number")


def page_types(spark, sf):
    """What kind each page is, with marks of each kind written into the pages."""
    mark = F.element_at(F.array(*(F.lit(x) for x in ("", "<h1>404 Not Found</h1>", "<p>No results</p>", "<table><tr><td>1<tr><td>2<tr ><td>3</table>", "<i class='big card'></i><i class=\"card\"></i><i class='x listing-item'></i>", "<form><input type='search'></form>"))), (F.col("page_id") % 6 + 1).cast("int"))
    plain = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?i)<(tr|form)[ >]|class=|results|results?|found", "")
    return v.table(spark, sf, "pages").select("page_id", p.page_type(F.concat(plain, mark)).alias("page_type"))


def conversation_turns(spark, sf):
    """Conversations as threads of messages: turns, roles and the first line."""
    c = v.table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.sum(F.length("text").cast("long")).alias("chars"), F.md5(F.min_by("text", "turn")).alias("first_md5"))


LISTED = "list_extract(['', '<p>Please solve this CAPTCHA</p>', '<a rel=\"next\" href=\"/p2\">more</a>', '<button>Load More</button>', '<div class=\"infinite-scroll\"></div>'], cast(page_id % 5 + 1 as int))"
MARKED = f"with marked as (select page_id, coalesce(html, '') || {LISTED} as html, list_extract([200, 404, 403, 429], cast(page_id % 4 + 1 as int)) as code from pages)"
HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
PATH = "regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
_any = lambda words: "(" + " or ".join(f"contains(lower(html), '{w}')" for w in words) + ")"
O = f"with {OPPORTUNITIES}"
CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '&nbsp;?', ' ', 'g'), '&amp;?', '&', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '\"', 'g'), '\\s+', ' ', 'g'))"
SQL = {
    "block_detector": MARKED + f" select page_id, code between 200 and 299 as ok, cast(strlen(html) as bigint) as content_length, code in (403, 406, 418, 451) or (length(html) < 50000 and {_any(p.BLOCK_WORDS)}) as is_blocked, code = 429 as rate_limited from marked",
    "pagination_type": MARKED + " select page_id, case " + " ".join(f"when {_any(w)} then '{k}'" for k, w in p.PAGINATION) + " else 'none' end as pagination from marked",
    "url_host_stats": f"select {HOST} as host, regexp_replace({HOST}, '[.-]', '_', 'g') as slug, count(*) as pages, cast(sum(strlen(html)) as bigint) as bytes from pages group by 1, 2",
    "external_id_from_url": f"""select page_id, coalesce(case when length(list_extract(string_split({PATH}, '/'), -1)) >= 4 then list_extract(string_split({PATH}, '/'), -1) end,
 nullif(regexp_extract(url, '[?&](?:id|bid|posting|opportunity)=([^&#]+)', 1), ''), 'RFP-2024-' || page_id) as external_id from pages""",
    "first_url": "select page_id, regexp_extract('at ' || url || ' <end>', 'https?://[^\\s<>\"''{}|\\\\^`\\[\\]]+') as url from pages",
    "page_links": "select page_id, count(*) as links, count(distinct href) as distinct_links from (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as href from pages) group by 1",
    "page_title": f"select page_id, {CLEAN.format(c='''regexp_extract(html, '<title>([^<]*)</title>', 1)''')} as title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) as lang from pages",
    "dates_in_documents": "select doc_id, cast(len(f) as bigint) as n, list_extract(f, 1) as closing_text, list_extract(f, 2) as posted_text from (select doc_id, regexp_extract_all(text, '\\b\\d{4}-\\d{2}-\\d{2}\\b|\\b\\d{1,2}/\\d{1,2}/\\d{2,4}\\b') as f from documents)",
    "contacts_in_text": "select doc_id, cast(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) as bigint) as emails, cast(len(regexp_extract_all(text, '\\+?\\d? ?\\(\\d{3}\\) \\d{3}-\\d{4}')) as bigint) as phones from documents",
    "total_records_text": O + " select id, case when id % 9 <> 0 then cast(id % 40 * 25 + 1 as int) end as first, case when id % 9 <> 0 then cast(id % 40 * 25 + 25 as int) end as last, case when id % 9 <> 0 then cast(id + 1000 as int) end as total, case when id % 9 <> 0 then cast(ceil((id + 1000) / 25.0) as int) end as page_count from opportunities",
    "page_chain": """with recursive links as (select page_id, case when page_id % 7 <> 0 then page_id + 3 end as next_id from pages),
 chain as (select page_id as start_id, page_id, 1 as depth from pages union all select c.start_id, l.next_id, c.depth + 1 from chain c join links l on c.page_id = l.page_id where l.next_id is not null and c.depth < 5)
 select start_id, page_id, depth from chain""",
    "crawl_until_stop": """with c as (select conv_id, turn, length(coalesce(text, '')) < 60 or row_number() over (partition by conv_id, md5(coalesce(text, '')) order by turn) > 1 as stops, row_number() over (partition by conv_id order by turn) as n from conversations),
 f as (select conv_id, coalesce(min(n) filter (stops), 1000) as first_stop from c group by 1) select conv_id, turn, cast(n as int) as page_number from c join f using (conv_id) where n < first_stop and n <= 10""",
    "page_types": "select page_id, list_extract(['unknown', 'error_page', 'empty_results', 'results_table', 'results_cards', 'search_form'], cast(page_id % 6 + 1 as int)) as page_type from pages",
    "conversation_turns": "select conv_id, count(*) as turns, count(*) filter (role = 'user') as user_turns, cast(sum(length(text)) as bigint) as chars, md5(arg_min(text, turn)) as first_md5 from conversations group by 1",
}
