"""Deletes along foreign keys, runs that overlap, sessions and sliding windows, counters of a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidflow.functions import text as texts
from bidflow.operators import cascade, cdc, overlap, progress
from bidflow.plans.ctes import EVENTS, OPPORTUNITIES, RUNS
from bidflow.sources import config
from bidflow.sources import views as v
from bidflow.streaming import flows

T = F.col


def _store(spark, sf):
    """All tables of the store that name each other."""
    o = v.opportunities(spark, sf).select("id", "portal_id")
    e = v.events(spark, sf)
    d = v.table(spark, sf, "documents")
    runs = v.runs(spark, sf).select(T("run_id").alias("id"), F.when(T("run_id") % 6 > 0, T("portal_id")).alias("portal_id"), (T("run_id") % 4).alias("scheduled_job_id"))
    return {
        "portals": v.portals(spark, sf).select(T("portal_id").alias("id"), "enabled"),
        "opportunities": o,
        "opportunity_events": e.select("id", F.when(T("id") % 5 > 0, T("opportunity_id")).alias("opportunity_id"), T("id").alias("run_id")),
        "documents": d.select(T("doc_id").alias("id"), (T("doc_id") % 700).alias("opportunity_id")),
        "scrape_runs": runs,
        "page_snapshots": runs.where("id % 3 = 0").select((T("id") * 10).alias("id"), T("id").alias("run_id"), T("portal_id")),
    }


def _counts(tables):
    """One row per table: rows, and filled keys that are set to null rather than deleted."""
    out = []
    for name, df in tables.items():
        keys = [k.column for k in cascade.KEYS if k.table == name and k.column in df.columns]
        filled = F.concat_ws(",", *(F.concat(F.lit(f"{c}:"), F.count(c).cast("string")) for c in sorted(keys))) if keys else F.lit("")
        out.append(df.agg(F.count("*").alias("rows"), filled.alias("keys")).select(F.lit(name).alias("name"), "rows", "keys"))
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


def cascade_portals(spark, sf):
    """Portals that are off are deleted: opportunities, events and documents go with them, runs and snapshots lose them."""
    return _counts(cascade.delete(_store(spark, sf), "portals", ~T("enabled"))[0])


def cascade_runs(spark, sf):
    """Some runs are deleted: their snapshots go, their events lose them."""
    return _counts(cascade.delete(_store(spark, sf), "scrape_runs", T("id") % 5 == 0)[0])


def cascade_ids(spark, sf):
    """Which rows go from each table with the portals that are off."""
    gone = cascade.delete(_store(spark, sf), "portals", ~T("enabled"))[1]
    whole = None
    for name, ids in sorted(gone.items()):
        part = ids.select(F.lit(name).alias("name"), "id")
        whole = part if whole is None else whole.unionByName(part)
    return whole


def config_validation(spark, sf):
    """What is wrong with configurations of all kinds of values, and what stands for a value that is missing."""
    k = T("c_custkey")
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    text = join(
        '{"name": "', F.when(k % 9 == 0, "").otherwise(T("c_name")), '", "base_url": "', F.when(k % 8 == 0, "nowhere").otherwise("https://e.org/"), '", "seed_urls": [', F.when(k % 10 > 0, '"/l"').otherwise(""), '], "backend": {"preferred": "', F.when(k % 4 == 0, "curl").otherwise("http"),
        '"}, "politeness": {"min_delay_ms": ', k % 7 * 300, ', "max_delay_ms": 1000, "max_retries": ', k % 13, '}, "discovery": {"pagination": {"max_pages": ', k, '}}, "extraction": {"confidence_threshold": ', k % 1200 / 1000, ', "listing": {"fields": {"title": {"regex": "', F.when(k % 6 == 0, "(").otherwise("(.)"), '"}}}}}',
    )
    found = config.checked(texts.spread(v.table(spark, sf, "customer")).select("c_custkey", text.alias("text")), "c_custkey", "text")
    return found.select(T("id").alias("c_custkey"), F.array_join("faults", "; ").alias("faults"), F.get_json_object("settings", "$.politeness.concurrency").alias("concurrency"), F.get_json_object("settings", "$.display_name").alias("display_name"))


def _long_runs(spark, sf):
    """Runs of some length: as many minutes longer as their id tells."""
    return v.runs(spark, sf).withColumn("finished_at", T("finished_at") + F.make_dt_interval(F.lit(0), F.lit(0), (T("run_id") * 7 % 600).cast("int")))


def overlapping_runs(spark, sf):
    """Most runs of a portal at once, and how long more than two held."""
    return overlap.overlapping(_long_runs(spark, sf), "portal_id", limit=2)


def overlapping_in_all(spark, sf):
    """Most runs at once over all portals, and how long more than eight held."""
    return overlap.overlapping(_long_runs(spark, sf), limit=8, slice_seconds=1800)


def session_runs(spark, sf):
    """Runs by gaps of more than half an hour, from session windows."""
    return flows.sessions(v.events(spark, sf), "opportunity_id", 1800)


def sliding_activity(spark, sf):
    """Events by type of each day, the days beginning every six hours."""
    return flows.sliding(v.events(spark, sf), "1 day", "6 hours")


def observed_counters(spark, sf):
    """The counters of a merge, taken while its outcomes are written."""
    classes = cdc.classified(v.snapshot(spark, sf, False), v.snapshot(spark, sf, True)).select("outcome", "event", "changes")
    counts = progress.write_measured(classes, lambda df: df.write.format("noop").mode("overwrite").save())
    return spark.createDataFrame([tuple(counts[c] for c in ("found", "new", "updated", "unchanged"))], "found long, new long, updated long, unchanged long")


_STORE = f"""{OPPORTUNITIES}, {RUNS},
 sr as (select run_id as id, case when run_id % 6 > 0 then portal_id end as portal_id, run_id % 4 as scheduled_job_id from runs),
 oe as (select event_id as id, case when event_id % 5 > 0 then user_id end as opportunity_id, event_id as run_id from events),
 dc as (select doc_id as id, doc_id % 700 as opportunity_id from documents),
 ps as (select id * 10 as id, id as run_id, portal_id from sr where id % 3 = 0),
 gp as (select portal_id as id from portals where not enabled), go as (select id from opportunities where portal_id in (select id from gp))"""


def _overlap(key, limit):
    mine = f"r.{key} = p.{key} and " if key else ""
    by = f"partition by {key} " if key else ""
    k, pk = (f"{key}, ", f"p.{key}, ") if key else ("", "")
    group = f"group by {key}" if key else ""
    return f"""r as (select portal_id, epoch_us(started_at) as s, epoch_us(finished_at + to_minutes(run_id * 7 % 600)) as e from runs), p as (select distinct {k}s as t from r union select distinct {k}e + 1 from r),
 n as (select {pk}t, count(s) as level from p left join r on {mine}r.s <= p.t and r.e >= p.t group by {pk}t), m as (select *, lead(t) over ({by}order by t) - t as micros from n)
 select {k}max(level) as most_at_once, make_timestamp(arg_min(t, (-level, t))) as first_at, cast(coalesce(sum(micros) filter (level > {limit}), 0) as bigint) as micros_over from m {group}"""


SQL = {
    "cascade_portals": f"""with {_STORE} select 'portals' as name, count(*) filter (enabled) as rows, '' as keys from portals union all select 'opportunities', count(*), 'portal_id:' || count(portal_id) from opportunities where id not in (select id from go)
 union all select 'opportunity_events', count(*), 'opportunity_id:' || count(opportunity_id) || ',run_id:' || count(run_id) from oe where opportunity_id is null or opportunity_id not in (select id from go)
 union all select 'documents', count(*), 'opportunity_id:' || count(opportunity_id) from dc where opportunity_id not in (select id from go)
 union all select 'scrape_runs', count(*), 'portal_id:' || count(portal_id) filter (portal_id not in (select id from gp)) || ',scheduled_job_id:' || count(*) from sr
 union all select 'page_snapshots', count(*), 'portal_id:' || count(portal_id) filter (portal_id not in (select id from gp)) || ',run_id:' || count(*) from ps""",
    "cascade_runs": f"""with {_STORE}, gr as (select id from sr where id % 5 = 0) select 'portals' as name, count(*) as rows, '' as keys from portals union all select 'opportunities', count(*), 'portal_id:' || count(portal_id) from opportunities
 union all select 'opportunity_events', count(*), 'opportunity_id:' || count(opportunity_id) || ',run_id:' || count(*) filter (run_id not in (select id from gr)) from oe union all select 'documents', count(*), 'opportunity_id:' || count(opportunity_id) from dc
 union all select 'scrape_runs', count(*), 'portal_id:' || count(portal_id) || ',scheduled_job_id:' || count(*) from sr where id % 5 <> 0 union all select 'page_snapshots', count(*), 'portal_id:' || count(portal_id) || ',run_id:' || count(*) from ps where run_id % 5 <> 0""",
    "cascade_ids": f"with {_STORE} select 'portals' as name, id from gp union all select 'opportunities', id from go union all select 'opportunity_events', id from oe where opportunity_id in (select id from go) union all select 'documents', id from dc where opportunity_id in (select id from go)",
    "session_runs": f"with {RUNS.replace('cast(opportunity_id % 30 as int) as portal_id', 'opportunity_id')} select run_id, opportunity_id, started_at, finished_at, pages_scraped, errors_count, opportunities_new, opportunities_updated from runs",
    "sliding_activity": f"""with {EVENTS}, s as (select event_type, unnest(generate_series(time_bucket(interval 6 hour, created_at) - interval 18 hour, time_bucket(interval 6 hour, created_at), interval 6 hour)) as window_start from events_)
 select window_start, window_start + interval 1 day as window_end, event_type, count(*) as n from s group by all""",
    "observed_counters": f"""with {OPPORTUNITIES}, c as (select case when id % 10 = 0 then 'NEW' when (id % 7 = 0 and closing_at is not null) or (id % 13 = 0 and status <> 'CLOSED') then 'UPDATED' else 'UNCHANGED' end as outcome from opportunities)
 select count(*) as found, count(*) filter (outcome = 'NEW') as new, count(*) filter (outcome = 'UPDATED') as updated, count(*) filter (outcome = 'UNCHANGED') as unchanged from c""",
    "config_validation": """select c_custkey, concat_ws('; ', case when c_custkey % 9 = 0 then 'name: is not within 1 and 100' end, case when c_custkey % 10 = 0 then 'seed_urls: is not at least 1' end, case when c_custkey % 4 = 0 then 'backend.preferred: is none of http, playwright, crawl4ai' end,
 case when c_custkey % 13 > 10 then 'politeness.max_retries: is not within 0 and 10' end, case when c_custkey not between 1 and 1000 then 'discovery.pagination.max_pages: is not within 1 and 1000' end, case when c_custkey % 1200 > 1000 then 'extraction.confidence_threshold: is not within 0 and 1' end,
 case when c_custkey % 7 * 300 > 1000 then 'politeness.max_delay_ms: is less than min_delay_ms' end, case when c_custkey % 8 = 0 then 'base_url: is no URL' end, case when c_custkey % 6 = 0 then 'extraction.listing.fields.title.regex: is no pattern' end) as faults, '2' as concurrency, case when c_custkey % 9 = 0 then '' else c_name end as display_name from customer""",
    "overlapping_runs": f"with {RUNS}, {_overlap('portal_id', 2)}",
    "overlapping_in_all": f"with {RUNS}, {_overlap('', 8)}",
}
