"""Read side: lists, counts, events, runs and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidflow.functions import dates, hashing, money
from bidflow.operators import aggregates, listing, windows
from bidflow.plans.ctes import EVENTS, LISTINGS, OPPORTUNITIES, RUNS
from bidflow.sources import views as v

NOW = f"timestamp '{v.AS_OF}'"
SINCE = "2024-01-20 00:00:00"


def portal_activity(spark, sf):
    return aggregates.portal_activity(v.opportunities(spark, sf), v.portals(spark, sf))


def list_open_closing_soon(spark, sf):
    return listing.list_opportunities(v.opportunities(spark, sf), status="open", closing_within_days=30, as_of=v.as_of(), limit=100)


def list_page_offset(spark, sf):
    return listing.list_opportunities(v.opportunities(spark, sf), portal_id=3, limit=20, offset=20)


def count_by_status(spark, sf):
    return aggregates.count_by_status(v.opportunities(spark, sf))


def status_percentages(spark, sf):
    return aggregates.status_percentages(v.opportunities(spark, sf))


def closing_urgency(spark, sf):
    o = v.opportunities(spark, sf)
    return o.select("id", dates.closing_urgency(F.col("closing_at"), v.as_of()).alias("urgency"))


def display_rows(spark, sf):
    o = v.opportunities(spark, sf)
    return listing.table_view(o, dates.closing_urgency(F.col("closing_at"), v.as_of()), F.when(F.col("estimated_value") >= 1000, F.concat(F.lit("$"), F.floor(F.col("estimated_value") / 1000).cast("string"), F.lit("K"))).otherwise("low"))


def events_since_by_type(spark, sf):
    found = listing.list_events(v.events(spark, sf), event_type="AWARDED", since=v.as_of(SINCE))
    return found.select("id", "opportunity_id", "event_type", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(100)


def latest_events_per_opportunity(spark, sf):
    return windows.latest_per_key(v.events(spark, sf), "opportunity_id", 20).select("id", "opportunity_id", "event_type", "created_at", "rank")


def events_by_type(spark, sf):
    return v.events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("opportunity_id").alias("opportunities"), F.max("created_at").alias("last_at"))


def runs_recent_with_portal(spark, sf):
    joined = v.runs(spark, sf).join(v.portals(spark, sf).select("portal_id", "portal_name"), "portal_id", "left")
    return joined.select("run_id", F.coalesce("portal_name", F.lit("?")).alias("portal_name"), "started_at", "status", "pages_scraped").orderBy(F.desc("started_at"), F.desc("run_id")).limit(20)


def run_durations(spark, sf):
    return v.runs(spark, sf).select("run_id", F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("finished_at")).alias("micros"), "status")


def run_summary_rollup(spark, sf):
    return aggregates.run_summary(v.runs(spark, sf))


def resumable_by_portal(spark, sf):
    return v.runs(spark, sf).where(F.col("status").isin("RUNNING", "PARTIAL", "FAILED")).groupBy("portal_id").agg(F.count("*").alias("n"), F.max("finished_at").alias("last_at"))


def portal_dashboard(spark, sf):
    totals = v.runs(spark, sf).groupBy("portal_id").agg(F.count("*").alias("total_runs"), F.sum("opportunities_new").alias("total_new"), F.max("finished_at").alias("last_scraped_at"), F.max(F.when(F.col("status") == "COMPLETED", F.col("finished_at"))).alias("last_success_at"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return v.portals(spark, sf).where("enabled").join(totals, "portal_id", "left").select("portal_id", "portal_name", zero("total_runs"), zero("total_new"), "last_scraped_at", "last_success_at")


def export_csv_projection(spark, sf):
    return listing.export_rows(v.opportunities(spark, sf), "csv")


def export_jsonl_projection(spark, sf):
    o = v.opportunities(spark, sf).withColumn("estimated_value", F.floor("estimated_value").cast("long"))
    return listing.export_rows(o, "jsonl")


def _whole(spark, sf):
    return v.opportunities(spark, sf).withColumn("estimated_value", F.floor("estimated_value"))


def export_json_projection(spark, sf):
    return listing.export_rows(_whole(spark, sf), "json")


def shown_csv(spark, sf):
    return listing.shown_rows(v.opportunities(spark, sf), "csv")


def shown_json(spark, sf):
    return listing.shown_rows(_whole(spark, sf), "json")


def quick_filters(spark, sf):
    o = v.opportunities(spark, sf).join(v.raw_listings(spark, sf).select("id", "value_text"), "id").withColumns({"description": F.lit(None).cast("string"), "location": F.lit("North")})
    kept = listing.quick_filter(o, ["urgent", "HIGH"], ["open", "pend"], ["BUILD", "auto"], "north", v.as_of("1996-01-01 00:00:00"), v.as_of("1999-01-01 00:00:00"), 1000, 400000)
    return kept.select("id", "title", "status", "category", "closing_at", "value_text")


def quick_confidence(spark, sf):
    return aggregates.quick_confidence(v.raw_listings(spark, sf).withColumn("posted_text", F.when(F.col("id") % 3 == 0, "x")))


def dedupe_first_wins(spark, sf):
    o = v.opportunities(spark, sf).withColumn("given", F.when(F.col("id") % 4 != 0, F.concat(F.lit("K-"), (F.col("id") % 500).cast("string"))))
    keyed = o.withColumn("dedupe_id", hashing.dedupe_id(F.col("given"), F.col("category"), F.col("agency")))
    return windows.first_wins(keyed, "dedupe_id", "id").select("dedupe_id", "id", "title")


def burst_window(spark, sf):
    return windows.bursts(v.events(spark, sf), 21600, 3)


def request_gaps(spark, sf):
    return windows.gaps(v.events(spark, sf), 3600)


def version_history(spark, sf):
    return windows.version_diffs(v.events(spark, sf))


def version_as_of(spark, sf):
    moments = v.events(spark, sf).select(F.col("id").alias("moment_id"), ((F.col("opportunity_id") + 1) % 150).alias("opportunity_id"), F.col("created_at").alias("moment"))
    return windows.version_as_of(v.events(spark, sf), moments)


def status_cube(spark, sf):
    cube = v.opportunities(spark, sf).cube("status", "category").agg(F.count("*").alias("n"), F.sum(F.col("estimated_value").cast("decimal(18,2)")).cast("double").alias("value"), F.grouping_id().cast("int").alias("level"))
    return cube.select("status", "category", "n", "value", "level")


def events_per_window(spark, sf):
    e = v.events(spark, sf).withColumn("day", F.date_trunc("DAY", "created_at").cast("timestamp_ntz"))
    return e.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))


def json_path_get(spark, sf):
    return v.events(spark, sf).select("id", F.get_json_object("diff", "$.k").try_cast("int").alias("k"))


O, E, R = f"with {OPPORTUNITIES}", f"with {EVENTS}", f"with {RUNS}"
URGENCY = f"""case when floor(date_sub('second', {NOW}, closing_at) / 86400.0) < 0 then 'Past'
  when floor(date_sub('second', {NOW}, closing_at) / 86400.0) <= 7 then cast(cast(floor(date_sub('second', {NOW}, closing_at) / 86400.0) as bigint) as varchar) || 'd'
  else strftime(closing_at, '%Y-%m-%d') end"""
SHORT = "case when length({c}) > {n} then substring({c}, 1, {m}) || '...' else {c} end as {c}"

SQL = {
    "portal_activity": O + """ select portal_id, portal_name, region, enabled, coalesce(n, 0) as n, coalesce(n_open, 0) as n_open, coalesce(n_awarded, 0) as n_awarded, coalesce(n_pending, 0) as n_pending, value, first_closing
 from portals left join (select portal_id, count(*) as n, count(*) filter (status = 'OPEN') as n_open, count(*) filter (status = 'AWARDED') as n_awarded, count(*) filter (status = 'PENDING') as n_pending,
 cast(sum(cast(estimated_value as decimal(18,2))) as double) as value, min(closing_at) filter (status = 'OPEN') as first_closing from opportunities group by 1) using (portal_id)""",
    "list_open_closing_soon": O + f" select * from opportunities where status = 'OPEN' and closing_at between {NOW} and {NOW} + to_days(30) order by closing_at, id limit 100",
    "list_page_offset": O + " select * from opportunities where portal_id = 3 order by closing_at asc nulls last, id limit 20 offset 20",
    "count_by_status": O + " select status, count(*) as n from opportunities group by 1",
    "status_percentages": O + " select cast(list_position(['OPEN','CLOSED','AWARDED','CANCELLED','PENDING','UNKNOWN'], status) as int) as place, status, n, round(100.0::double * n / total, 1) as pct from (select status, count(*) as n, sum(count(*)) over () as total from opportunities group by 1)",
    "closing_urgency": O + f" select id, {URGENCY} as urgency from opportunities",
    "display_rows": O + f" select id, {SHORT.format(c='title', n=30, m=27)}, {SHORT.format(c='agency', n=16, m=13)}, {URGENCY} as closing, case when estimated_value >= 1000 then '$' || cast(floor(estimated_value / 1000) as bigint) || 'K' else 'low' end as value from opportunities",
    "events_since_by_type": E + f" select id, opportunity_id, event_type, created_at from events_ where event_type = 'AWARDED' and created_at >= timestamp '{SINCE}' order by created_at desc, id desc limit 100",
    "latest_events_per_opportunity": E + " select * from (select id, opportunity_id, event_type, created_at, cast(row_number() over (partition by opportunity_id order by created_at desc, id desc) as int) as rank from events_) where rank <= 20",
    "events_by_type": E + " select event_type, count(*) as n, count(distinct opportunity_id) as opportunities, max(created_at) as last_at from events_ group by 1",
    "runs_recent_with_portal": R + ", portals as (select n_nationkey as portal_id, lower(n_name) as portal_name from nation) select run_id, coalesce(portal_name, '?') as portal_name, started_at, status, pages_scraped from runs left join portals using (portal_id) order by started_at desc, run_id desc limit 20",
    "run_durations": R + " select run_id, date_sub('microsecond', started_at, finished_at) as micros, status from runs",
    "run_summary_rollup": R + " select portal_id, count(*) as runs, cast(sum(pages_scraped) as bigint) as pages_scraped, cast(sum(opportunities_new) as bigint) as opportunities_new, cast(sum(opportunities_updated) as bigint) as opportunities_updated, cast(sum(errors_count) as bigint) as errors_count, cast(grouping(portal_id) as int) as is_total from runs group by rollup (portal_id)",
    "resumable_by_portal": R + " select portal_id, count(*) as n, max(finished_at) as last_at from runs where status in ('RUNNING', 'PARTIAL', 'FAILED') group by 1",
    "portal_dashboard": R + """, totals as (select portal_id, count(*) as total_runs, sum(opportunities_new) as total_new, max(finished_at) as last_scraped_at, max(finished_at) filter (status = 'COMPLETED') as last_success_at from runs group by 1)
 select n_nationkey as portal_id, lower(n_name) as portal_name, cast(coalesce(total_runs, 0) as bigint) as total_runs, cast(coalesce(total_new, 0) as bigint) as total_new, last_scraped_at, last_success_at from nation left join totals on n_nationkey = portal_id where n_nationkey % 5 <> 0""",
    "export_csv_projection": O + " select id, external_id, title, status, agency, strftime(closing_at, '%Y-%m-%dT%H:%M:%S') as closing_at, strftime(posted_at, '%Y-%m-%dT%H:%M:%S') as posted_at, estimated_value, cast(null as varchar) as source_url from opportunities",
    "export_jsonl_projection": O + """ select external_id, cast(to_json({'id': id, 'external_id': external_id, 'title': title, 'status': status, 'agency': agency, 'closing_at': strftime(closing_at, '%Y-%m-%dT%H:%M:%S'), 'posted_at': strftime(posted_at, '%Y-%m-%dT%H:%M:%S'), 'estimated_value': cast(floor(estimated_value) as bigint)}) as varchar) as line from opportunities""",
    "export_json_projection": O + """ select external_id, cast(to_json({'id': id, 'external_id': external_id, 'title': title, 'description': cast(null as varchar), 'status': status, 'agency': agency, 'closing_at': strftime(closing_at, '%Y-%m-%dT%H:%M:%S'), 'posted_at': strftime(posted_at, '%Y-%m-%dT%H:%M:%S'), 'estimated_value': cast(floor(estimated_value) as bigint), 'source_url': cast(null as varchar), 'detail_url': cast(null as varchar)}) as varchar) as line from opportunities""",
    "shown_csv": O + " select id, external_id, substring(title, 1, 80) as title, status, agency, strftime(closing_at, '%Y-%m-%dT%H:%M:%S') as closing_at, estimated_value from opportunities",
    "shown_json": O + """ select external_id, cast(to_json({'id': id, 'external_id': external_id, 'title': title, 'status': status, 'agency': agency, 'closing_at': strftime(closing_at, '%Y-%m-%dT%H:%M:%S'), 'posted_at': strftime(posted_at, '%Y-%m-%dT%H:%M:%S'), 'estimated_value': cast(floor(estimated_value) as bigint), 'source_url': cast(null as varchar)}) as varchar) as line from opportunities""",
    "quick_filters": f"with {LISTINGS}" + """ select o.id, o.title, status, o.category, closing_at, value_text from opportunities o join listings l on o.id = l.id
 where (contains(lower(o.title), 'urgent') or contains(lower(o.title), 'high')) and (contains(lower(status), 'open') or contains(lower(status), 'pend')) and (contains(lower(o.category), 'build') or contains(lower(o.category), 'auto'))
 and posted_at >= timestamp '1996-01-01' and coalesce(closing_at <= timestamp '1999-01-01', true)
 and coalesce(try_cast(nullif(regexp_replace(value_text, '[^0-9.]', '', 'g'), '') as double) between 1000 and 400000, true)""",
    "quick_confidence": f"with {LISTINGS}" + """ select portal_id, count(*) as n, round_even(least(1.0, sum(cast(10 + 3 * (3 + cast(closing_text is not null as int) + cast(id % 3 = 0 as int)) as double)) / 25.0 / count(*)), 6) as confidence from listings group by 1""",
    "dedupe_first_wins": O + """ select dedupe_id, id, title from (select *, row_number() over (partition by dedupe_id order by id) as rn from (select *, coalesce(case when id % 4 <> 0 then 'K-' || (id % 500) end, substring(md5(category || agency), 1, 16)) as dedupe_id from opportunities)) where rn = 1""",
    "burst_window": E + """, timed as (select id, opportunity_id, epoch_us(created_at) as micros from events_), told as (select *, count(*) over w as n, min(micros) over w as oldest from timed window w as (partition by opportunity_id order by micros range between 21600000000 preceding and current row))
 select id, opportunity_id, n, cast(case when n >= 3 then oldest + 21600000000 - micros else 0 end as bigint) as wait_micros from told""",
    "request_gaps": E + " select id, opportunity_id, gap_micros, coalesce(gap_micros < 3600000000, false) as too_soon from (select id, opportunity_id, date_sub('microsecond', lag(created_at) over (partition by opportunity_id order by created_at, id), created_at) as gap_micros from events_)",
    "version_history": E + " select id, opportunity_id, cast(row_number() over w as int) as version, lag(event_type) over w as before, event_type as after, lag(event_type) over w is distinct from event_type as changed from events_ window w as (partition by opportunity_id order by created_at, id)",
    "version_as_of": E + """, moments as (select id as moment_id, (opportunity_id + 1) % 150 as opportunity_id, created_at as moment from events_)
 select moment_id, m.opportunity_id, e.id as current_id, e.event_type as current_type from moments m asof left join events_ e on m.opportunity_id = e.opportunity_id and m.moment >= e.created_at""",
    "status_cube": O + " select status, category, count(*) as n, cast(sum(cast(estimated_value as decimal(18,2))) as double) as value, cast(grouping(status, category) as int) as level from opportunities group by cube (status, category)",
    "events_per_window": E + " select date_trunc('day', created_at) as day, event_type, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as value from events_ group by 1, 2",
    "json_path_get": E + " select id, try_cast(json_extract_string(diff, '$.k') as int) as k from events_",
}
