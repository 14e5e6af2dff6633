"""Change capture, keyed state, locks and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidflow.operators import cdc, schedule
from bidflow.plans.ctes import CLASSES, OPPORTUNITIES, RUNS, SNAPSHOTS, fingerprint
from bidflow.sources import views as v


def _classes(spark, sf):
    return cdc.classified(v.snapshot(spark, sf, False), v.snapshot(spark, sf, True))


def cdc_classify(spark, sf):
    return _classes(spark, sf).select(*cdc.KEY, "outcome", "event")


def cdc_events(spark, sf):
    return cdc.events_of(_classes(spark, sf)).select(*cdc.KEY, "event_type", "n_changes", "fields", "significant")


def change_summary(spark, sf):
    return cdc.events_of(_classes(spark, sf)).select(*cdc.KEY, "summary")


def cdc_field_changes(spark, sf):
    return cdc.field_changes(_classes(spark, sf))


def cdc_missed_changes(spark, sf):
    return cdc.missed(_classes(spark, sf))


def cdc_repo_changes(spark, sf):
    return cdc.repo_changes(v.snapshot(spark, sf, False), v.snapshot(spark, sf, True))


def cdc_run_counters(spark, sf):
    return cdc.run_counters(_classes(spark, sf))


def cdc_upserted(spark, sf):
    return cdc.upserted(v.snapshot(spark, sf, False), v.snapshot(spark, sf, True)).select("id", *cdc.KEY, "status", "closing_at", "contact_name", "fingerprint")


def insert_if_absent(spark, sf):
    return cdc.insert_if_absent(v.snapshot(spark, sf, False), v.snapshot(spark, sf, True)).select("id", *cdc.KEY, "title")


def latest_of_batch(spark, sf):
    twice = v.snapshot(spark, sf, True).withColumn("external_id", F.concat(F.lit("OPP-"), (F.col("id") % 700).cast("string")))
    return cdc.last_of_batch(twice, "id").select(*cdc.KEY, "id", "status")


def portal_upsert(spark, sf):
    """Portals by name: seen ones are overwritten, new ones are added."""
    old = v.portals(spark, sf).where("portal_id < 20").select("portal_name", F.lit("https://old.example.org").alias("base_url"), F.lit(1).alias("runs"))
    new = v.portals(spark, sf).where("portal_id >= 10").select("portal_name", F.concat(F.lit("https://"), "portal_name", F.lit(".example.org")).alias("new_url"))
    return old.join(new, "portal_name", "full").select("portal_name", F.coalesce("new_url", "base_url").alias("base_url"), F.coalesce("runs", F.lit(0)).alias("runs"), F.col("base_url").isNull().alias("created"))


def cascade_delete(spark, sf):
    _, kept, runs = cdc.cascade_delete(v.portals(spark, sf), v.opportunities(spark, sf), v.runs(spark, sf), ~F.col("enabled"))
    a = kept.groupBy("portal_id").agg(F.count("*").alias("n")).select(F.lit("opportunity").alias("kind"), "portal_id", "n")
    return a.unionByName(runs.groupBy("portal_id").agg(F.count("*").alias("n")).select(F.lit("run").alias("kind"), "portal_id", "n"))


def merge_listing_detail(spark, sf):
    """Listings with the details that were found: a detail's filled fields win."""
    o = v.opportunities(spark, sf)
    detail = o.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, F.upper("category")).otherwise("").alias("d_category"), F.concat(F.lit("Dept of "), "agency").alias("d_agency"))
    return o.join(detail, "id", "left").select("id", F.coalesce(F.nullif("d_category", F.lit("")), "category").alias("category"), F.coalesce(F.nullif("d_agency", F.lit("")), "agency").alias("agency"), F.col("d_agency").isNotNull().alias("enriched"))


def lock_decision(spark, sf):
    o = v.opportunities(spark, sf)
    holder, wanted = F.when(F.col("id") % 3 != 0, F.concat(F.lit("w"), (F.col("id") % 4).cast("string"))), F.concat(F.lit("w"), (F.col("id") % 2).cast("string"))
    return o.select("id", schedule.lock_decision(holder, F.col("posted_at"), wanted, v.as_of("1997-01-01 00:00:00")).alias("decision"))


def schedule_expand_portals(spark, sf):
    jobs = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("job_id"), F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("nation_"), (F.col("s_suppkey") % 25).cast("string"), F.lit(", nation_3,, none"))).alias("portals"))
    return schedule.portals_of_job(jobs, v.portals(spark, sf)).distinct()


def schedule_next_fire(spark, sf):
    e = v.events(spark, sf)
    kind = F.when(F.col("id") % 3 == 0, "daily").when(F.col("id") % 3 == 1, "weekday").otherwise("hourly")
    time = F.format_string("%02d:%02d", (F.col("id") % 26).cast("int"), (F.col("id") % 60).cast("int"))
    return e.select("id", schedule.next_fire(kind, time, (F.col("id") % 12 + 1).cast("int"), F.col("created_at")).alias("fires_at"))


S, K, O = f"with {SNAPSHOTS}", f"with {CLASSES}", f"with {OPPORTUNITIES}"
FMT = "'%Y-%m-%d %H:%M:%S'"
N = "(cast(c_status as int) + cast(c_closing as int) + cast(c_contact as int))"
SQL = {
    "cdc_classify": K + " select portal_id, external_id, outcome, case when outcome <> 'UNCHANGED' then kind end as event from classes",
    "cdc_events": K + f""" select portal_id, external_id, kind as event_type, cast(case when outcome = 'NEW' then 0 else {N} end as bigint) as n_changes,
 case when outcome = 'NEW' then '' else concat_ws(',', case when c_status then 'status' end, case when c_closing then 'closing_at' end, case when c_contact then 'contact_name' end) end as fields,
 outcome <> 'NEW' and (c_status or c_closing) as significant from classes where outcome <> 'UNCHANGED'""",
    "change_summary": K + """ select portal_id, external_id, case when outcome = 'NEW' then 'New opportunity' when c_status then 'Status: ' || old_status || ' \u2192 ' || new_status
 when c_closing then 'Changed: closing_at' when c_contact then 'Updated: contact_name' end as summary from classes where outcome <> 'UNCHANGED'""",
    "cdc_field_changes": K + f""", u as (select * from classes where outcome = 'UPDATED')
 select portal_id, external_id, 'status' as field, old_status as old_value, new_status as new_value, 'high' as significance from u where c_status
 union all select portal_id, external_id, 'closing_at', strftime(old_closing, {FMT}), strftime(new_closing, {FMT}), 'high' from u where c_closing
 union all select portal_id, external_id, 'contact_name', old_contact, new_contact, 'medium' from u where c_contact""",
    "cdc_missed_changes": K + " select portal_id, external_id, old_contact as old_value, new_contact as new_value from classes where outcome = 'UNCHANGED' and c_contact",
    "cdc_repo_changes": K + f""" select portal_id, external_id, concat_ws(',', case when c_closing then 'closing_at' end, case when c_contact then 'contact_name' end, case when c_status then 'status' end) as fields, 'Updated ' || {N} || ' field(s)' as message from classes where known and {N} > 0""",
    "cdc_run_counters": K + " select portal_id, count(*) as found, count(*) filter (outcome = 'NEW') as new, count(*) filter (outcome = 'UPDATED') as updated, count(*) filter (outcome = 'UNCHANGED') as unchanged from classes group by 1",
    "cdc_upserted": S + f""", o as (select *, {fingerprint()} as fingerprint from old), n as (select *, {fingerprint()} as fingerprint from new)
 select case when keep then o.id else n.id end as id, portal_id, external_id, case when keep then o.status else n.status end as status, case when keep then o.closing_at else n.closing_at end as closing_at,
 case when keep then o.contact_name else n.contact_name end as contact_name, case when keep then o.fingerprint else n.fingerprint end as fingerprint
 from (select *, coalesce(n.id is null or o.fingerprint = n.fingerprint, false) as keep from o full join n using (portal_id, external_id))""".replace("case when keep then o.", "case when keep then o_").replace("else n.", "else n_").replace(
        "(select *, coalesce(n.id is null or o.fingerprint = n.fingerprint, false) as keep from o full join n using (portal_id, external_id))",
        "(select portal_id, external_id, coalesce(n.id is null or o.fingerprint = n.fingerprint, false) as keep, " + ", ".join(f"{s}.{c} as {s}_{c}" for s in "on" for c in ("id", "status", "closing_at", "contact_name", "fingerprint")) + " from o full join n using (portal_id, external_id))"),
    "insert_if_absent": S + " select id, portal_id, external_id, title from new anti join old using (portal_id, external_id)",
    "latest_of_batch": S + " select portal_id, external_id, id, status from (select portal_id, 'OPP-' || (id % 700) as external_id, id, status, row_number() over (partition by portal_id, id % 700 order by id desc) as rn from new) where rn = 1",
    "portal_upsert": "select lower(n_name) as portal_name, case when n_nationkey >= 10 then 'https://' || lower(n_name) || '.example.org' else 'https://old.example.org' end as base_url, cast(n_nationkey < 20 as int) as runs, n_nationkey >= 20 as created from nation",
    "cascade_delete": f"with {RUNS}, {OPPORTUNITIES}" + """
 select 'opportunity' as kind, portal_id, count(*) as n from opportunities where portal_id % 5 <> 0 group by 2
 union all select 'run', case when portal_id < 25 and portal_id % 5 <> 0 then portal_id end as p, count(*) from runs group by p""",
    "merge_listing_detail": O + " select id, case when id % 6 = 0 then upper(category) else category end as category, case when id % 3 = 0 then 'Dept of ' || agency else agency end as agency, id % 3 = 0 as enriched from opportunities",
    "lock_decision": O + " select id, case when id % 3 = 0 then 'acquired' when posted_at <= timestamp '1997-01-01' then 'taken over' when id % 4 = id % 2 then 'renewed' else 'refused' end as decision from opportunities",
    "schedule_expand_portals": "select s_suppkey as job_id, n_nationkey as portal_id from supplier, nation where s_suppkey % 5 = 0 or n_nationkey = s_suppkey % 25 or n_nationkey = 3",
    "schedule_next_fire": """with t as (select event_id as id, ts, case when event_id % 26 < 24 then date_trunc('day', ts) + to_minutes(cast((event_id % 26) * 60 + event_id % 60 as int)) end as at_ from events),
 d as (select *, case when at_ > ts then at_ else at_ + to_days(1) end as daily from t)
 select id, cast(case id % 3 when 0 then daily when 1 then daily + to_days(case isodow(daily) when 6 then 2 when 7 then 1 else 0 end) else ts + to_hours(cast(id % 12 + 1 as int)) end as timestamp) as fires_at from d""",
}
