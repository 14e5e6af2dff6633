"""A keyed store's own upsert, variables in texts, lists by a portal's name, details of the first rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidflow.functions import dates, text
from bidflow.operators import canonical, cdc, listing
from bidflow.plans.ctes import OPPORTUNITIES, RUNS
from bidflow.sources import views as v

T = F.col
_MORE = ["contact_name", "contact_email", "awardee", "award_amount", "description", "department", "location"]


def _snapshots(spark, sf):
    """Stored rows and a later batch: new keys, tracked fields that differ, and fields that a store doesn't track."""
    k = T("id")
    o = v.opportunities(spark, sf).select(
        "id", "portal_id", "external_id", "title", "status", "agency", "closing_at", "estimated_value", F.concat(F.lit("buyer "), (k % 100).cast("string")).alias("contact_name"), F.lit("a@b.c").alias("contact_email"), F.when(k % 4 == 0, T("agency")).alias("awardee"),
        F.lit("here").alias("location"), F.lit("raw").alias("raw_data"), F.lit("1998-01-01").cast("timestamp_ntz").alias("last_seen_at"),
    )
    rules = {
        "title": (29, F.concat(T("title"), F.lit("!"))), "closing_at": (7, T("closing_at") + v.days(F.lit(1)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(30))), "contact_email": (13, F.lit(None).cast("string")), "awardee": (23, F.lit("other")), "location": (5, F.lit("there")),
        "agency": (31, F.lit("another")), "raw_data": (2, F.lit("new raw")),
    }
    later = o.withColumns({c: F.when(k % n == 0, to).otherwise(T(c)) for c, (n, to) in rules.items()}).where("id % 11 <> 3")
    return o.where("id % 10 <> 0"), later.withColumn("unknown", F.lit(1))


def repo_upserted(spark, sf):
    """The store after the batch: tracked fields follow, others stay, raw data follows where a tracked field has changed."""
    old, new = _snapshots(spark, sf)
    return cdc.repo_upserted(old, new, v.as_of()).select("id", "title", "closing_at", "contact_email", "awardee", "agency", "location", "raw_data", "last_seen_at")


def repo_events(spark, sf):
    old, new = _snapshots(spark, sf)
    return cdc.repo_events(old, new).select("external_id", "event_type", "message")


def template_variables(spark, sf):
    """Several variables in one text: dates before and after, the environment, and names of one's own."""
    told = F.element_at(F.array(*(F.lit(x) for x in ("${TODAY-7d}..${TODAY+14d}", "${env:REGION}/${env:UNSET}|${TODAY}", "${query} since ${LAST_RUN_DATE}", "${TODAY-1d} ${TODAY-1d} ${query}", "${OTHER} ${TODAY+xd}"))), (T("id") % 5 + 1).cast("int"))
    value = dates.dynamic_value(told, T("posted_at"), F.when(T("id") % 2 == 0, T("closing_at")), {"REGION": "west"}, {"query": T("category")})
    return v.opportunities(spark, sf).select("id", value.alias("value"))


def list_by_portal_name(spark, sf):
    return listing.of_portal(v.opportunities(spark, sf), v.portals(spark, sf), "nation_7").select("id", "portal_name", "title")


def portal_view(spark, sf):
    """Enabled portals as the portal list prints them."""
    r = v.runs(spark, sf).groupBy("portal_id").agg(F.sum("opportunities_new").alias("total_opportunities"), F.max("finished_at").alias("last_scraped_at"))
    p = v.portals(spark, sf).withColumns({"display_name": F.when(T("portal_id") % 2 == 0, F.upper("portal_name")), "base_url": F.concat(F.lit("https://"), "portal_name", F.lit(".example.org"))})
    return listing.portal_view(p, r, enabled=True)


def detail_enriched(spark, sf):
    """Details of the first thousand rows that have a link: some come, some are silent on a field, some fail."""
    k = T("id")
    o = v.opportunities(spark, sf).select("id", "title", "category", F.lit("short").alias("description"), F.when(k % 3 > 0, F.concat(F.lit("/d/"), k.cast("string"))).alias("detail_url"))
    d = o.where("id % 7 <> 0 and detail_url is not null").select("detail_url", (k % 5 > 0).alias("success"), F.when(k % 2 == 0, "long text").otherwise("").alias("description"), F.concat(F.lit("x"), k.cast("string"), F.lit("@e.org")).alias("contact_email"))
    return canonical.enriched(o, d, ["description", "contact_email", "contact_phone"], 1000, "id").select("id", "description", "contact_email", "detail")


def shown_texts(spark, sf):
    """Texts as lists, previews, samples and detail views show them."""
    d = v.table(spark, sf, "documents")
    return d.select("doc_id", *(text.shortened(T("text"), n).alias(name) for name, n in text.SHOWN.items()), F.md5(F.encode(text.detail_text(T("text")), "UTF-8")).alias("detail_md5"))


O = f"with {OPPORTUNITIES}"
_CHANGED = "(id % 29 = 0 or id % 7 = 0 and closing_at is not null or id % 13 = 0 or id % 23 = 0 or id % 31 = 0)"
SQL = {
    "repo_upserted": f"""{O}, s as (select *, id % 10 <> 0 as known, id % 11 <> 3 as told from opportunities), c as (select *, told and {_CHANGED} as changed from s where known or told)
 select id, case when told and id % 29 = 0 then title || '!' else title end as title, case when told and id % 7 = 0 then closing_at + interval 1 day + interval 30 second else closing_at end as closing_at, case when not (told and id % 13 = 0) then 'a@b.c' end as contact_email,
 case when told and id % 23 = 0 then 'other' when id % 4 = 0 then agency end as awardee, case when told and id % 31 = 0 then 'another' else agency end as agency, case when not known and id % 5 = 0 then 'there' else 'here' end as location,
 case when id % 2 = 0 and (not known or changed) then 'new raw' else 'raw' end as raw_data, case when told then timestamp '{v.AS_OF}' else timestamp '1998-01-01' end as last_seen_at from c""",
    "repo_events": f"""{O}, c as (select *, cast(id % 29 = 0 as int) + cast(id % 7 = 0 and closing_at is not null as int) + cast(id % 13 = 0 as int) + cast(id % 23 = 0 as int) + cast(id % 31 = 0 as int) as n from opportunities where id % 11 <> 3)
 select external_id, case when id % 10 = 0 then 'NEW' else 'UPDATED' end as event_type, case when id % 10 = 0 then 'Opportunity discovered' else 'Updated ' || n || ' field(s)' end as message from c where id % 10 = 0 or n > 0""",
    "template_variables": O
    + """, d as (select *, strftime(posted_at, '%Y-%m-%d') as today, strftime(posted_at - interval 1 day, '%Y-%m-%d') as before from opportunities) select id, case id % 5 when 0 then strftime(posted_at - interval 7 day, '%Y-%m-%d') || '..' || strftime(posted_at + interval 14 day, '%Y-%m-%d')
 when 1 then 'west/|' || today when 2 then category || ' since ' || strftime(coalesce(case when id % 2 = 0 then closing_at end, posted_at - interval 30 day), '%Y-%m-%d') when 3 then before || ' ' || before || ' ' || category else '${OTHER} ${TODAY+xd}' end as value from d""",
    "list_by_portal_name": O + " select o.id, p.portal_name, o.title from opportunities o join portals p using (portal_id) where p.portal_name = 'nation_7'",
    "portal_view": f"""with {RUNS}, r as (select portal_id, sum(opportunities_new) as n, max(finished_at) as t from runs group by 1), p as (select n_nationkey as k, lower(n_name) as name from nation where n_nationkey % 5 <> 0)
 select name as portal_name, cast(to_json({{'name': name, 'display_name': case when k % 2 = 0 then upper(name) end, 'base_url': 'https://' || name || '.example.org', 'enabled': true, 'total_opportunities': cast(coalesce(n, 0) as bigint), 'last_scraped': strftime(t, '%Y-%m-%dT%H:%M:%S')}}) as varchar) as line from p left join r on portal_id = k""",
    "shown_texts": "select doc_id, " + ", ".join(f"case when length(text) > {n} then substring(text, 1, {n - 3}) || '...' else text end as {name}" for name, n in (("title", 50), ("agency", 30), ("preview", 40), ("sample", 100))) + ", md5(case when length(text) > 2000 then substring(text, 1, 2000) || '...' else text end) as detail_md5 from documents",
    "detail_enriched": O
    + """, a as (select id from opportunities where id % 3 > 0 order by id limit 1000), b as (select o.id, a.id is not null as asked, a.id is not null and o.id % 7 <> 0 and o.id % 5 > 0 as came from opportunities o left join a using (id))
 select id, case when came and id % 2 = 0 then 'long text' else 'short' end as description, case when came then 'x' || id || '@e.org' end as contact_email, case when came then 'scraped' when asked then 'failed' end as detail from b""",
}
