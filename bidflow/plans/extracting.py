"""Extraction of records from listing pages, round trips included."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidflow.functions import dates, status, text
from bidflow.plans.ctes import LISTINGS
from bidflow.sources import html
from bidflow.sources import views as v


def _listings(spark, sf):
    clean = v.raw_listings(spark, sf).withColumn("title", text.clean_html_text(F.col("title")))
    return clean.withColumn("closing_text", F.coalesce("closing_text", F.lit("")))


def _round_trip(spark, sf, kind):
    found = html.extract(html.listing_pages(_listings(spark, sf), kind))
    return found.select("page_id", "method", "external_id", "title", "agency", F.nullif("closing_at", F.lit("")).alias("closing_text"), "status", "detail_url")


def table_round_trip(spark, sf):
    return _round_trip(spark, sf, "table")


def card_round_trip(spark, sf):
    return _round_trip(spark, sf, "card")


def jsonld_round_trip(spark, sf):
    return _round_trip(spark, sf, "jsonld")


def markdown_round_trip(spark, sf):
    return _round_trip(spark, sf, "markdown")


def pages_to_opportunities(spark, sf):
    """From pages to typed rows: extract, read dates and statuses, keep what has an id or a title."""
    found = html.extract(html.listing_pages(_listings(spark, sf), "table"))
    typed = text.computed(found, {"d": dates.parse_date(F.col("closing_at")), "s": status.parse_status(F.col("status"))})
    kept = typed.where(text.first_filled("external_id", "title").isNotNull() & (F.col("confidence") > 0.3))
    return kept.select("external_id", F.col("d.value").alias("closing_at"), F.col("s.status").alias("status"), F.substring_index("detail_url", "/", -1).cast("long").alias("id"))


def rules_zip_longest(spark, sf):
    """Lists that selectors gave on each page, aligned by position up to the longest."""
    o = v.opportunities(spark, sf).withColumn("page_id", F.floor(F.col("id") / 25))
    lists = o.groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("id") % 2 == 0, F.col("id")))).alias("a"), F.sort_array(F.collect_list(F.when(F.col("id") % 3 == 0, F.struct("category", "id")))).alias("b")
    )  # as long as a page at most
    return lists.select("page_id", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "x")).select("page_id", "pos", "x.a", F.col("x.b.category").alias("b"))


def embedded_json(spark, sf):
    """Records of JSON in a script of the page."""
    o = v.opportunities(spark, sf)
    item = F.to_json(F.struct(F.col("external_id").alias("id"), F.struct(F.col("agency").alias("name")).alias("buyer"), F.col("category").alias("type")))
    pages = o.select(F.floor(F.col("id") / 25).alias("page_id"), "id", item.alias("item")).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "item"))), lambda x: x["item"]), ",").alias("items"))
    made = pages.select("page_id", F.lit("").alias("url"), F.concat(F.lit("<script>window.__DATA__ = {\"results\":["), "items", F.lit("]};</script>")).alias("html"))
    return html.extract(made, 0.2).select("page_id", "external_id", "agency", "category")


L = f"with {LISTINGS}"


def _sql(method: str) -> str:
    title = "trim(regexp_replace(replace(title, '&amp;', '&'), '\\s+', ' ', 'g'))"
    closing = "trim(regexp_replace(closing_text, '\\s+', ' ', 'g'))" if method != "jsonld" else "closing_text"
    return L + f" select cast(floor(id / 25) as bigint) as page_id, '{method}' as method, external_id, {title} as title, agency, {closing} as closing_text, status_text as status, 'https://bids.example.org/bids/' || id as detail_url from listings"


SQL = {
    "table_round_trip": _sql("table"),
    "card_round_trip": _sql("card"),
    "jsonld_round_trip": _sql("jsonld"),
    "markdown_round_trip": _sql("markdown"),
    "pages_to_opportunities": L + """ select o.external_id, case o.id % 7 when 4 then closing_at + interval 14 hour + interval 30 minute when 6 then null else closing_at end as closing_at, status, o.id from opportunities o""",
    "rules_zip_longest": L + """, p as (select *, cast(floor(id / 25) as bigint) as page_id from opportunities), a as (select page_id, row_number() over (partition by page_id order by id) - 1 as pos, id as a from p where id % 2 = 0),
 b as (select page_id, row_number() over (partition by page_id order by category, id) - 1 as pos, category as b from p where id % 3 = 0)
 select page_id, cast(pos as int) as pos, a, b from a full join b using (page_id, pos)""",
    "embedded_json": L + " select cast(floor(id / 25) as bigint) as page_id, external_id, agency, category from opportunities",
}
