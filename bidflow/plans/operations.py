"""Canonical rows, full diffs, runs, jobs, locks and portals' configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidflow.functions import dates, hashing, status, text
from bidflow.operators import canonical as canon
from bidflow.operators import cdc, runs, schedule
from bidflow.plans.ctes import LISTINGS, OPPORTUNITIES, RUNS, fingerprint
from bidflow.sources import views as v

T = F.col


def _raw(spark, sf):
    """Raw fields under several keys, as pages tell them; rows are joined and dealt out before their texts are made."""
    k = T("id")
    told = v.opportunities(spark, sf).select("id", T("posted_at").alias("told_at"), T("estimated_value").alias("told_value"))
    both = text.spread(v.opportunities(spark, sf).drop("posted_at").join(told, "id"))
    r = v.printed(both, "told_at", "told_value").withColumnsRenamed({"closing_text": "due_date", "status_text": "state", "agency": "buyer", "category": "type"})
    more = {
        "post_date": F.date_format("told_at", "yyyy-MM-dd"), "award_date": F.when(k % 4 == 0, F.date_format("told_at", "MM/dd/yyyy")),
        "awarded_value": F.when(k % 4 == 0, F.concat(F.lit("$"), F.format_number(F.floor("told_value").cast("long"), 0), F.lit(".75"))).otherwise("0"),
    }
    return r.withColumns(more).select(
        F.when(k % 9 != 0, T("external_id")).alias("bid_id"), "due_date", F.when(k % 5 != 0, T("state")).alias("state"), "title", "type", F.when(k % 3 == 0, F.concat(F.lit(" Dept  of "), T("type"))).alias("department"), "buyer", "post_date", "award_date", "awarded_value",
        F.concat(F.lit("Scope&nbsp;of &lt;"), k.cast("string"), F.lit("&gt;  ")).alias("details"), F.when(k % 2 == 0, F.concat_ws(", ", F.lit("10"), T("type"))).otherwise("").alias("commodity_codes"), F.concat(F.lit("buyer "), (k % 100).cast("string")).alias("contact"),
        F.when(k % 2 == 0, F.lit("a@b.c")).alias("email"), F.lit("555").alias("phone"), F.when(k % 4 == 0, T("buyer")).alias("winner"), F.when(k % 3 == 0, "0.75").when(k % 3 == 1, "n/a").alias("confidence"), T("id").alias("key"),
    )


def canonical_rows(spark, sf):
    found = canon.canonical(_raw(spark, sf), v.as_of(), ("key",))
    return found.select("key", "external_id", "description", "closing_at", "posted_at", "awarded_at", "status", "category", "agency", "department", "commodity_codes", "contact_name", "contact_email", "contact_phone", "awardee", "award_amount", "estimated_value_currency", "extraction_confidence", "warnings")


def listing_items(spark, sf):
    """Of records with an id or a title, what a listing keeps."""
    o = v.opportunities(spark, sf)
    blank = lambda c, n: F.when(T("id") % n == 0, F.lit("")).otherwise(T(c))
    records = o.select(blank("external_id", 2).alias("external_id"), blank("title", 3).alias("title"), T("closing_at").cast("string").alias("closing_at"), "status", "agency", F.lit("x").alias("location"), (T("id") % 10 / 10).alias("confidence"), T("id").alias("row_index"))
    return canon.listing_items(records).select("row_index", "external_id", "title", "status", "agency", "category", "confidence")


def detail_merge(spark, sf):
    """A detail's columns win wherever there is a detail, nulls included."""
    o = v.opportunities(spark, sf)
    detail = o.where("id % 3 = 0").select("id", F.when(T("id") % 2 == 0, F.upper("category")).alias("category"), F.lit("long").alias("description"))
    return canon.merged(o.select("id", "title", "category"), detail, "id").select("id", "category", "description")


def _full(spark, sf, later):
    """Snapshots with all fields that diffs compare; each differs in the later one by a rule of its own."""
    k = T("id")
    o = v.opportunities(spark, sf).select(
        "*", F.when(k % 4 == 0, F.floor("estimated_value").cast("double")).alias("award_amount"), F.when(k % 4 == 0, T("agency")).alias("awardee"), F.concat(F.lit("scope "), k.cast("string")).alias("description"), F.lit("dept").alias("department"),
        F.when(k % 4 == 0, T("posted_at")).alias("awarded_at"), F.concat(F.lit("buyer "), (k % 100).cast("string")).alias("contact_name"), F.lit("a@b.c").alias("contact_email"), F.lit("555").alias("contact_phone"), F.lit("here").alias("location"), F.lit("10,20").alias("commodity_codes"),
        F.concat(F.lit("/d/"), k.cast("string")).alias("detail_url"), F.lit(None).cast("string").alias("description_markdown"),
    )
    if not later:
        return o
    rules = {
        "title": (29, F.concat(T("title"), F.lit("!"))), "closing_at": (7, T("closing_at") + v.days(F.lit(7))), "award_amount": (19, F.lit(5.0)), "awardee": (23, F.lit("other")), "description": (31, F.lit("new scope")), "department": (11, F.lit("")),
        "awarded_at": (37, T("posted_at") + v.days(F.lit(1))), "contact_email": (13, F.lit(None).cast("string")), "contact_phone": (17, F.lit("556")), "location": (5, F.lit("there")), "commodity_codes": (3, F.lit("10,30")), "detail_url": (41, F.lit("/e")), "description_markdown": (2, F.lit("# md")),
    }
    return o.withColumns({c: F.when(k % n == 0, to).otherwise(T(c)) for c, (n, to) in rules.items()})


def _full_classes(spark, sf):
    return cdc.classified(_full(spark, sf, False), _full(spark, sf, True))


def cdc_all_fields(spark, sf):
    """Every change of every field that a diff compares."""
    return cdc.field_changes(_full_classes(spark, sf))


def cdc_tracked_fields(spark, sf):
    return cdc.repo_changes(_full(spark, sf, False), _full(spark, sf, True))


def diff_as_map(spark, sf):
    d = cdc.diff_map(_full_classes(spark, sf))
    return d.select(*cdc.KEY, "diff", cdc.shown_keys(T("diff")).alias("shown"))


def diff_as_list(spark, sf):
    d = cdc.diff_list(_full_classes(spark, sf))
    return d.select(*cdc.KEY, F.get_json_object("diff", "$.changes[0].field").alias("first_field"), F.get_json_object("diff", "$.old_fingerprint").alias("old_fingerprint"), F.get_json_object("diff", "$.is_significant").alias("significant"), cdc.shown_keys(T("diff")).alias("shown"))


def stable_fingerprint(spark, sf):
    """Keys of stored listings; letters beyond ASCII, quotes and empty fields among them."""
    c = v.table(spark, sf, "customer")
    agency = F.concat(T("c_name"), F.lit(" Zürich \"Ä\"\t")) 
    listing = c.select("c_custkey", F.when(T("c_custkey") % 3 == 0, "").otherwise(agency).alias("agency"), F.concat(F.lit("B-"), T("c_custkey").cast("string")).alias("external_id"), F.when(T("c_custkey") % 2 == 0, F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")).alias("posted_at"), T("c_mktsegment").alias("title"))
    return listing.select("c_custkey", hashing.stable_fingerprint(listing).alias("fingerprint"))


def last_seen(spark, sf):
    """The state after a run, with the time of the last sighting of each row."""
    old = v.snapshot(spark, sf, False).withColumn("last_seen_at", F.lit("1998-01-01").cast("timestamp_ntz"))
    new = v.snapshot(spark, sf, True).where("id % 4 <> 1")
    state = cdc.upserted(old, new, v.as_of())
    return state.select("id", "last_seen_at", "status")


def disappeared(spark, sf):
    old = v.snapshot(spark, sf, False).withColumn("last_seen_at", T("posted_at") + v.days((T("id") % 300).cast("int")))
    return cdc.disappeared(old, v.as_of(), 30)


def _running(spark, sf):
    r = v.runs(spark, sf)
    return r.select("run_id", "portal_id", F.when(T("run_id") % 3 == 0, T("status")).otherwise("RUNNING").alias("status"), "finished_at", F.lit(None).cast("string").alias("error_message"), "pages_scraped", "errors_count", F.lit(None).cast("string").alias("checkpoint"))


def run_lifecycle(spark, sf):
    """Counters are added, checkpoints saved, runs completed or failed; finished runs stay as they are."""
    e = v.events(spark, sf)
    stats = e.select(T("id").alias("run_id"), F.lit(1).alias("pages_scraped"), (T("id") % 2).alias("errors_count"))
    saved = e.where("id % 5 = 0").select(T("id").alias("run_id"), F.concat(F.lit('{"page": '), T("id").cast("string"), F.lit("}")).alias("checkpoint"))
    ends = e.where("id % 4 > 0").select(T("id").alias("run_id"), T("created_at").alias("finished_at"), F.when(T("id") % 7 == 0, "broken off").alias("error"))
    return runs.completed(runs.with_checkpoints(runs.with_stats(_running(spark, sf), stats), saved), ends)


def dry_run(spark, sf):
    """What a run would do, per portal and outcome, nothing written."""
    c = cdc.classified(v.snapshot(spark, sf, False), v.snapshot(spark, sf, True))
    return c.groupBy("portal_id", "outcome").agg(F.count("*").alias("n"))


def rows_deleted(spark, sf):
    """How many rows a delete takes, and whether it took any."""
    o = v.opportunities(spark, sf)
    return o.groupBy("portal_id").agg(F.count_if(T("closing_at") < v.as_of()).alias("deleted")).select("portal_id", "deleted", (T("deleted") > 0).alias("any"))


def strict_locks(spark, sf):
    o = v.opportunities(spark, sf)
    holder, asks, ends = F.when(T("id") % 5 > 0, F.concat(F.lit("h"), (T("id") % 3).cast("string"))), F.concat(F.lit("h"), (T("id") % 2).cast("string")), T("posted_at")
    return o.select("id", runs.strict_lock(holder, ends, v.as_of()).alias("decision"), runs.extended(ends, holder, asks, v.as_of(), F.lit(90)).alias("until"))


def portal_switch(spark, sf):
    p = v.portals(spark, sf)
    wanted = p.where("portal_id % 3 = 0").select("portal_name", (T("portal_id") % 2 == 0).alias("enabled"))
    return runs.switched(p, wanted)[0].select("portal_id", "enabled")


def job_last_status(spark, sf):
    jobs = v.portals(spark, sf).select(T("portal_id").alias("job_id"), F.lit(None).cast("timestamp_ntz").alias("last_run_at"), F.lit("never").alias("last_status"))
    return runs.job_status(jobs, v.runs(spark, sf).select(T("portal_id").alias("job_id"), "finished_at", "status"))


def job_validation(spark, sf):
    c = v.table(spark, sf, "customer").select("c_custkey", *(F.when(T("c_custkey") % n == 0, F.lit(x)).alias(name) for name, n, x in (("daily", 2, "08:30"), ("weekday", 3, "25:00"), ("hourly", 5, "4"), ("cron", 7, "0 6 * * 1"))), (T("c_custkey") % 11 == 0).alias("name_taken"))
    return c.select("c_custkey", F.array_join(runs.job_faults(c, c), "; ").alias("faults"))


def cron_next(spark, sf):
    """The next fire of cron jobs after each customer's point in time."""
    expression = F.element_at(F.array(*(F.lit(x) for x in ("30 6 * * *", "0 */6 * * *", "15 9 * * 1-5", "0 0 1,15 * *", "*/20 22 * * 0"))), (T("c_custkey") % 5 + 1).cast("int"))
    now = F.lit("2024-02-27 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (T("c_custkey") * 37 % 4000).cast("int"))
    return text.spread(v.table(spark, sf, "customer")).select("c_custkey", runs.next_cron(expression, now).alias("next_run_at"))


#: Schedules that may be years away, one that never fires, and one that isn't any.
_FAR = ["0 0 1 * *", "0 0 29 2 *", "30 12 31 12 5", "0 0 30 2 *", "*/7 3 * * *", "59 23 29 2 0", "whenever"]


def cron_far(spark, sf):
    """The next fire of schedules that fire once a month, in leap years, or on a weekday's date."""
    k = T("c_custkey")
    expression = F.element_at(F.array(*map(F.lit, _FAR)), (k % len(_FAR) + 1).cast("int"))
    now = F.lit("2023-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((k * 13 % 2200).cast("int"), F.lit(0), (k * 7 % 1440).cast("int"))
    return text.spread(v.table(spark, sf, "customer")).select("c_custkey", runs.next_cron(expression, now).alias("next_run_at"))


def zoned_schedules(spark, sf):
    """Daily, weekday and cron jobs in zones of their own, in UTC, and how late jitter may make them."""
    zone = F.element_at(F.array(*map(F.lit, ("America/New_York", "Europe/Berlin", "Asia/Kolkata"))), (T("id") % 3 + 1).cast("int"))
    kind, at = F.when(T("id") % 2 == 0, "daily").otherwise("weekday"), F.format_string("%02d:30", T("id") % 5 + 8)
    told = {"fires": schedule.in_zone(lambda now: schedule.next_fire(kind, at, F.lit(1), now), T("created_at"), zone), "cron": schedule.in_zone(lambda now: runs.next_cron("15 9 * * 1-5", now), T("created_at"), zone)}
    found = text.computed(text.spread(v.events(spark, sf)).select("id", "created_at"), told)
    late = schedule.jittered(T("fires"), F.lit(5), T("id"))
    return found.select("id", T("fires").alias("next_run_at"), T("cron").alias("next_cron_at"), F.timestamp_diff("SECOND", T("fires"), late).between(0, 300).alias("in_time"))


def blackout(spark, sf):
    start, end = F.when(T("id") % 2 == 0, "22:00").otherwise("01:30"), F.when(T("id") % 3 == 0, "06:00").otherwise(F.lit(None))
    return v.events(spark, sf).select("id", runs.blacked_out(T("created_at"), start, end).alias("blacked_out"))


def job_portals(spark, sf):
    name = F.lower(T("n_name"))
    given = F.when(T("n_nationkey") % 3 == 0, F.concat(F.lit('["'), name, F.lit('", " x "]'))).when(T("n_nationkey") % 3 == 1, F.concat(F.lit('{"portals": ["'), name, F.lit('"]}'))).otherwise(F.concat(name, F.lit(", y,,")))
    return v.table(spark, sf, "nation").select("n_nationkey", F.array_join(runs.portal_names(given), "|").alias("names"))


def portal_dispatch(spark, sf):
    kind = F.when(T("n_nationkey") % 2 == 0, "search_form").when(T("n_nationkey") % 5 == 0, "crawl").otherwise("generic_table")
    p = v.table(spark, sf, "nation").select("n_nationkey", kind.alias("kind"), F.when(T("n_nationkey") % 3 == 0, "playwright").otherwise("http").alias("preferred"))
    chosen = runs.backend_of(T("kind"), T("preferred"))
    return p.select("n_nationkey", chosen.alias("backend"), runs.plugin_of(T("kind"), chosen).alias("plugin"), runs.plugin_of(T("kind"), T("preferred")).alias("plugin_preferred"))


def backoff_delays(spark, sf):
    """Seconds before each further attempt; an answer's Retry-After in their place where it is a number."""
    after = F.when(T("id") % 3 == 0, "7.5").when(T("id") % 3 == 1, "soon").try_cast("double")
    return v.events(spark, sf).select("id", F.coalesce(after, runs.backoff(F.lit(1.5), F.lit(2.0), T("id") % 6 + 1, F.lit(30.0))).alias("delay"))


def dynamic_values(spark, sf):
    template = F.element_at(F.array(*(F.lit(x) for x in ("from ${TODAY}", "${TODAY+7d}..", "${TODAY-30d}", "since ${LAST_RUN_DATE}", "plain"))), (T("id") % 5 + 1).cast("int"))
    return v.opportunities(spark, sf).select("id", dates.dynamic_value(template, T("posted_at"), F.when(T("id") % 2 == 0, T("closing_at"))).alias("value"))


def natural_dates(spark, sf):
    """Dates in words, relative to each order's own date."""
    d = T("posted_at")
    fmt = lambda f: F.date_format(d, f)
    told = F.element_at(F.array(fmt("MMM d, yyyy"), F.concat(F.lit("Closing date: "), fmt("d MMMM yyyy")), F.concat(fmt("MMMM d, yyyy"), F.lit(" at 2:30 PM ET")), F.lit("Tomorrow"), F.lit("in 10 days"), F.lit("3 days ago"), fmt("MMM d"), F.lit("whenever"), F.lit("Feb 30, 2024")), (T("id") % 9 + 1).cast("int"))
    n = dates.natural_date(told, d)
    return v.opportunities(spark, sf).withColumn("n", n).select("id", T("n.value").alias("value"), T("n.confidence").alias("confidence"))


def exact_status(spark, sf):
    told = F.element_at(F.array(*(F.lit(x) for x in (" Under Review", "ENDED", "contract awarded", "stale", "void", "opened", ""))), (T("id") % 7 + 1).cast("int"))
    return v.opportunities(spark, sf).select("id", status.exact_status(told).alias("status"), F.initcap(F.lower(F.trim(told))).alias("shown"))


def opportunity_detail(spark, sf):
    """Every opportunity with its portal, also those whose portal is gone."""
    p = v.portals(spark, sf).where("enabled").select("portal_id", "portal_name")
    return v.opportunities(spark, sf).select("id", "portal_id").join(p, "portal_id", "left").select("id", "portal_name")


def share_with_links(spark, sf):
    """Shares of documents with a link, and with more than 40 characters, by source."""
    d = v.table(spark, sf, "documents")
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    text = F.coalesce("text", F.lit(""))
    return d.groupBy("source").agg(share(F.contains(text, F.lit("http"))).alias("linked"), share(F.length(text) > 40).alias("worded"))


def longest_title(spark, sf):
    """The longest line of a document that may be a title, the first of them."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(F.trim(x).alias("line"), i.alias("i"))), lambda x: F.length(x["line"]).between(4, 180))
    best = F.array_max(F.transform(lines, lambda x: F.struct(F.length(x["line"]).alias("n"), (-x["i"]).alias("back"), x["line"].alias("line"))))
    return v.table(spark, sf, "documents").select("doc_id", best["n"].alias("n"), (-best["back"]).alias("line"))


def dates_in_text(spark, sf):
    """First and second date in a text: of closing, of posting."""
    pattern = r"(?i)\b(\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+\d{1,2},\s+\d{4})\b"
    told = F.concat(F.lit("due "), F.date_format(F.coalesce("closing_at", "posted_at"), "MMMM d, yyyy"), F.lit("; posted "), F.date_format("posted_at", "yyyy-MM-dd"), F.lit(" or 1/2/98"))
    found = F.regexp_extract_all(told, F.lit(pattern), F.lit(1))
    return v.opportunities(spark, sf).select("id", F.get(found, F.lit(0)).alias("closing"), F.get(found, F.lit(1)).alias("posted"), F.size(found).cast("long").alias("n"))


def portal_preview(spark, sf):
    """The first 25 of each list, and the first 3 portals with how many more there are."""
    names = v.portals(spark, sf).groupBy("region").agg(F.sort_array(F.collect_list("portal_name")).alias("names"))  # the configured portals of a region
    return names.select("region", F.concat(F.array_join(F.slice("names", 1, 3), ", "), F.when(F.size("names") > 3, F.concat(F.lit(" (+"), (F.size("names") - 3).cast("string"), F.lit(")"))).otherwise("")).alias("shown"))


def portal_counters(spark, sf):
    """Of each portal: runs, new opportunities, the last run and the last that succeeded (kept when later ones fail)."""
    r = v.runs(spark, sf).groupBy("portal_id").agg(F.count("*").alias("total_runs"), F.sum("opportunities_new").alias("total_opportunities"), F.max("finished_at").alias("last_scraped_at"), F.max(F.when(T("status") == "COMPLETED", T("finished_at"))).alias("last_success_at"))
    p = v.portals(spark, sf).select("portal_id", "portal_name")
    return p.join(r, "portal_id", "left").select("portal_id", F.coalesce("total_runs", F.lit(0)).alias("total_runs"), F.coalesce("total_opportunities", F.lit(0)).alias("total_opportunities"), "last_scraped_at", "last_success_at")


def runs_of_named_portal(spark, sf):
    """Runs of portals that are asked for by name."""
    p = v.portals(spark, sf).where(T("portal_name").isin("nation_3", "nation_7", "none"))
    return v.runs(spark, sf).join(p.select("portal_id", "portal_name"), "portal_id").select("portal_name", "run_id", "status", F.timestamp_diff("SECOND", T("started_at"), T("finished_at")).alias("duration_seconds"))


def resumable_runs(spark, sf):
    """Runs that stopped short and have a checkpoint."""
    saved = v.events(spark, sf).where("id % 5 = 0").select(T("id").alias("run_id"), F.lit("{}").alias("checkpoint"))
    return runs.with_checkpoints(_running(spark, sf), saved).where(T("status").isin("RUNNING", "PARTIAL", "FAILED") & T("checkpoint").isNotNull()).select("run_id", "status")


def rate_limiter_stats(spark, sf):
    """Hosts that are tracked, and requests to each and in all."""
    hosts = v.table(spark, sf, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host")).agg(F.count("*").alias("requests"))
    return hosts.agg(F.count("*").alias("domains_tracked"), F.sum("requests").alias("total_requests"), F.max("requests").alias("most"), F.min("requests").alias("least"))


def nested_paths(spark, sf):
    """Dotted paths through objects and lists, out of range and absent ones among them."""
    j = F.to_json(F.struct(F.array(F.struct(F.struct(T("c_name").alias("name")).alias("buyer"), F.array(T("c_custkey"), T("c_custkey") + 1).alias("codes"))).alias("items")))
    at = lambda path: F.get_json_object(j, path)
    return v.table(spark, sf, "customer").select("c_custkey", at("$.items[0].buyer.name").alias("name"), at("$.items[0].codes[1]").alias("second"), at("$.items[1].buyer").alias("beyond"), at("$.items[0].none.x").alias("absent"))


def lookup_by_key(spark, sf):
    """Point lookups by portal and external id, and by fingerprint: each key's row, or none."""
    o = v.opportunities(spark, sf)
    keyed = o.select("id", "portal_id", "external_id", hashing.fingerprint(o).alias("fingerprint"))
    asked = o.select("portal_id", F.when(T("id") % 2 == 0, T("external_id")).otherwise("OPP-x").alias("external_id"))
    by_key = asked.join(keyed, ["portal_id", "external_id"], "left").select(F.lit("key").alias("by"), T("external_id").alias("asked"), "id")
    print_ = o.select(hashing.fingerprint(o).alias("fingerprint"))
    by_print = print_.join(keyed, "fingerprint", "left").select(F.lit("fingerprint").alias("by"), T("fingerprint").alias("asked"), "id")
    return by_key.unionByName(by_print)


def record_ordinals(spark, sf):
    """Places of records on their pages, and numbers of the pages of a portal, counted from 1."""
    o = v.opportunities(spark, sf).select("portal_id", F.floor(T("id") / 25).alias("page"), "id")
    pages = o.groupBy("portal_id", "page").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # 25 at most
    return pages.select("portal_id", "page", F.posexplode("ids").alias("row_index", "id"))


def schedule_changes(spark, sf):
    """Jobs after commands to add, pause, resume and delete."""
    n = v.table(spark, sf, "nation").select(F.lower("n_name").alias("name"), "n_nationkey")
    jobs = n.where("n_nationkey < 15").select("name", (T("n_nationkey") % 2 == 0).alias("enabled"), F.lit("a,b").alias("portals"))
    action = F.element_at(F.array(*(F.lit(x) for x in ("add", "pause", "resume", "delete"))), (T("n_nationkey") % 4 + 1).cast("int"))
    return runs.jobs_after(jobs, n.where("n_nationkey >= 5").select("name", action.alias("action"), F.when(T("n_nationkey") % 8 == 0, "c").alias("portals")))


def page_snapshots(spark, sf):
    """Pages that are kept for inspection, as their records are missing or unsure."""
    c = v.table(spark, sf, "customer").select(T("c_custkey").alias("page_id"), F.concat(F.lit("https://e.org/"), T("c_custkey").cast("string")).alias("url"))
    records = c.where("page_id % 3 > 0").select("page_id", (T("page_id") % 10 / 10).alias("confidence"))
    return runs.page_snapshots(c, records, v.as_of())


L, O = f"with {LISTINGS}", f"with {OPPORTUNITIES}"
_DATE = """case l.id % 7 when 4 then closing_at + interval 14 hour + interval 30 minute when 6 then null else closing_at end"""
# Field, when it differs, its old and new text, significance.
_FIELDS = [
    ("title", "id % 29 = 0", "title", "title || '!'", "high"), ("closing_at", "id % 7 = 0 and closing_at is not null", "strftime(closing_at, '%Y-%m-%d %H:%M:%S')", "strftime(closing_at + to_days(7), '%Y-%m-%d %H:%M:%S')", "high"),
    ("award_amount", "id % 19 = 0", "case when id % 4 = 0 then cast(cast(floor(estimated_value) as decimal(20,2)) as varchar) end", "'5.00'", "high"), ("awardee", "id % 23 = 0", "case when id % 4 = 0 then agency end", "'other'", "high"),
    ("description", "id % 31 = 0", "'scope ' || id", "'new scope'", "medium"), ("department", "id % 11 = 0", "'dept'", "''", "medium"), ("awarded_at", "id % 37 = 0", "case when id % 4 = 0 then strftime(posted_at, '%Y-%m-%d %H:%M:%S') end", "strftime(posted_at + to_days(1), '%Y-%m-%d %H:%M:%S')", "medium"),
    ("contact_email", "id % 13 = 0", "'a@b.c'", "null", "medium"), ("contact_phone", "id % 17 = 0", "'555'", "'556'", "low"), ("location", "id % 5 = 0", "'here'", "'there'", "low"), ("commodity_codes", "id % 3 = 0", "'10,20'", "'10,30'", "low"), ("detail_url", "id % 41 = 0", "'/d/' || id", "'/e'", "low"),
    ("description_markdown", "id % 2 = 0", "null", "'# md'", "low"),
]
#: Rows whose fingerprint differs.
_MOVED = "(id % 29 = 0 or id % 31 = 0 or (id % 7 = 0 and closing_at is not null))"
_CHANGES = "changes as (" + " union all ".join(f"select id, portal_id, external_id, {i} as i, '{f}' as field, {a} as old_value, {b} as new_value, '{s}' as significance from opportunities where {when} and {_MOVED}" for i, (f, when, a, b, s) in enumerate(_FIELDS)) + ")"
_JSON = "coalesce('\"' || {c} || '\"', 'null')"
_OLD = "substring(sha256(concat_ws('|', external_id, title, 'scope ' || id, status, category, agency, coalesce(strftime(closing_at, '%Y-%m-%d %H:%M:%S'), ''), coalesce(cast(cast(nullif(estimated_value, 0) as decimal(20,2)) as varchar), ''))), 1, 32)"
SQL = {
    "canonical_rows": L + f""" select l.id as key, case when l.id % 9 <> 0 then l.external_id else substring(md5(l.title), 1, 16) end as external_id, 'Scope of <' || l.id || '>' as description, {_DATE} as closing_at, posted_at, case when l.id % 4 = 0 then posted_at end as awarded_at,
 case when l.id % 5 <> 0 then o.status when l.id % 4 = 0 then 'AWARDED' when {_DATE} > timestamp '{v.AS_OF}' then 'OPEN' when {_DATE} is not null then 'CLOSED' else 'UNKNOWN' end as status, l.category, case when l.id % 3 = 0 then 'Dept of ' || l.category else l.agency end as agency, case when l.id % 3 = 0 then 'Dept of ' || l.category end as department,
 case when l.id % 2 = 0 then '10,' || l.category end as commodity_codes, 'buyer ' || (l.id % 100) as contact_name, case when l.id % 2 = 0 then 'a@b.c' end as contact_email, '555' as contact_phone, case when l.id % 4 = 0 then l.agency end as awardee, case when l.id % 4 = 0 then floor(estimated_value) + 0.75::double end as award_amount,
 'USD' as estimated_value_currency, case when l.id % 3 = 0 then 0.75 else 0.0 end::double as extraction_confidence, concat_ws('; ', case when l.id % 9 = 0 then 'external id made up' end, case when l.id % 7 = 6 then 'closing date not read' end) as warnings
 from listings l join opportunities o on l.id = o.id""",
    "listing_items": O + " select id as row_index, case when id % 2 = 0 then '' else external_id end as external_id, case when id % 3 = 0 then '' else title end as title, status, agency, cast(null as varchar) as category, (id % 10) / 10.0::double as confidence from opportunities where not (id % 6 = 0)",
    "detail_merge": O + " select id, case when id % 3 <> 0 then category when id % 2 = 0 then upper(category) end as category, case when id % 3 = 0 then 'long' end as description from opportunities",
    "cdc_all_fields": O + f", {_CHANGES} select portal_id, external_id, field, old_value, new_value, significance from changes",
    "cdc_tracked_fields": O + ", d as (select *, list_filter([case when id % 19 = 0 then 'award_amount' end, case when id % 23 = 0 then 'awardee' end, case when id % 7 = 0 and closing_at is not null then 'closing_at' end, case when id % 13 = 0 then 'contact_email' end, case when id % 31 = 0 then 'description' end, case when id % 29 = 0 then 'title' end], lambda x: x is not null) as f from opportunities) select portal_id, external_id, array_to_string(f, ',') as fields, 'Updated ' || len(f) || ' field(s)' as message from d where len(f) > 0",
    "diff_as_map": O + f""", {_CHANGES}, d as (select portal_id, external_id, '{{' || string_agg('"' || field || '":{{"old":' || {_JSON.format(c='old_value')} || ',"new":' || {_JSON.format(c='new_value')} || '}}', ',' order by i) || '}}' as diff, array_agg(field order by i) as f from changes group by portal_id, external_id)
 select portal_id, external_id, diff, array_to_string(f[1:3], ', ') || case when len(f) > 3 then ' (+' || (len(f) - 3) || ')' else '' end as shown from d""",
    "diff_as_list": O + f", {_CHANGES}, d as (select id, arg_min(field, i) as first_field, count(*) filter (significance = 'high') > 0 as high from changes group by id) select o.portal_id, o.external_id, first_field, {_OLD.replace('external_id', 'o.external_id').replace(' id)', ' o.id)').replace('|| id', '|| o.id')} as old_fingerprint, cast(high as varchar) as significant, 'changes, old_fingerprint, new_fingerprint (+1)' as shown from d join opportunities o using (id)",
    "stable_fingerprint": """select c_custkey, substring(sha256('{' || concat_ws(', ', case when c_custkey % 3 <> 0 then '"agency": "' || c_name || ' Z\\u00fcrich \\"\\u00c4\\"\\t"' end, '"external_id": "B-' || c_custkey || '"', case when c_custkey % 2 = 0 then '"posted_at": "2024-05-06 07:08:09"' end, '"title": "' || c_mktsegment || '"') || '}'), 1, 16) as fingerprint from customer""",
    "last_seen": f"{O}, c as (select *, id % 10 <> 0 as known, id % 4 <> 1 as seen from opportunities) select id, case when seen then timestamp '{v.AS_OF}' else timestamp '1998-01-01' end as last_seen_at, case when seen and id % 13 = 0 then 'CLOSED' else status end as status from c where known or seen",
    "disappeared": f"{O} select portal_id, external_id, 'EXPIRED' as event_type, posted_at + to_days(cast(id % 300 as int)) as last_seen_at from opportunities where id % 10 <> 0 and status = 'OPEN' and posted_at + to_days(cast(id % 300 as int)) < timestamp '{v.AS_OF}' - interval 30 day",
    "run_lifecycle": f"""with {RUNS}, r as (select run_id, portal_id, case when run_id % 3 = 0 then status else 'RUNNING' end as status, finished_at, pages_scraped + 1 as pages_scraped, errors_count + run_id % 2 as errors_count from runs),
 s as (select r.*, e.created_at, status = 'RUNNING' and run_id % 4 > 0 as ends from r join events_ e on e.id = run_id)
 select run_id, portal_id, case when not ends then status when run_id % 7 = 0 then 'FAILED' else 'COMPLETED' end as status, case when ends then created_at else finished_at end as finished_at, case when ends and run_id % 7 = 0 then 'broken off' end as error_message, pages_scraped, errors_count,
 case when run_id % 5 = 0 then '{{"page": ' || run_id || '}}' end as checkpoint from s""",
    "dry_run": f"""{O}, c as (select portal_id, case when id % 10 = 0 then 'NEW' when (id % 7 = 0 and closing_at is not null) or (id % 13 = 0 and status <> 'CLOSED') then 'UPDATED' else 'UNCHANGED' end as outcome from opportunities) select portal_id, outcome, count(*) as n from c group by 1, 2""",
    "rows_deleted": f"{O} select portal_id, count(*) filter (closing_at < timestamp '{v.AS_OF}') as deleted, count(*) filter (closing_at < timestamp '{v.AS_OF}') > 0 as any from opportunities group by 1",
    "strict_locks": f"{O} select id, case when id % 5 = 0 then 'acquired' when posted_at <= timestamp '{v.AS_OF}' then 'taken over' else 'refused' end as decision, case when id % 5 > 0 and id % 3 = id % 2 and posted_at > timestamp '{v.AS_OF}' then timestamp '{v.AS_OF}' + interval 90 second end as until from opportunities",
    "portal_switch": "select n_nationkey as portal_id, case when n_nationkey % 3 = 0 then n_nationkey % 2 = 0 else n_nationkey % 5 <> 0 end as enabled from nation",
    "job_last_status": f"with {RUNS}, l as (select portal_id, max(finished_at) as t, arg_max(status, (finished_at, status)) as s from runs group by 1) select n_nationkey as job_id, t as last_run_at, coalesce(s, 'never') as last_status from nation left join l on portal_id = n_nationkey",
    "job_validation": """select c_custkey, concat_ws('; ', case when cast(c_custkey % 2 = 0 as int) + cast(c_custkey % 3 = 0 as int) + cast(c_custkey % 5 = 0 as int) + cast(c_custkey % 7 = 0 as int) <> 1 then 'exactly one schedule' end, case when c_custkey % 11 = 0 then 'name is taken' end, case when c_custkey % 2 <> 0 and c_custkey % 3 = 0 then 'no time of day' end) as faults from customer""",
    "cron_next": """with p as (select c_custkey, timestamp '2024-02-27 00:00:00' + to_minutes(c_custkey * 37 % 4000) as t, c_custkey % 5 as k from customer),
 ms as (select unnest(generate_series(timestamp '2024-02-27 00:00:00', timestamp '2024-03-20 00:00:00', interval 1 minute)) as m),
 f as (select m, unnest([0, 1, 2, 3, 4]) as k from ms where minute(m) in (0, 15, 20, 30, 40)),
 g as (select m, k from f where case k when 0 then hour(m) = 6 and minute(m) = 30 when 1 then hour(m) % 6 = 0 and minute(m) = 0 when 2 then hour(m) = 9 and minute(m) = 15 and dayofweek(m) between 1 and 5 when 3 then hour(m) = 0 and minute(m) = 0 and day(m) in (1, 15) else hour(m) = 22 and minute(m) % 20 = 0 and dayofweek(m) = 0 end)
 select c_custkey, min(m) as next_run_at from p join g on g.k = p.k and g.m > p.t group by c_custkey""",
    "cron_far": """with p as (select c_custkey, timestamp '2023-01-01 00:00:00' + to_days(cast(c_custkey * 13 % 2200 as int)) + to_minutes(c_custkey * 7 % 1440) as t, c_custkey % 7 as k from customer),
 ds as (select unnest(generate_series(timestamp '2023-01-01', timestamp '2070-01-01', interval 1 day)) as d),
 f as (select 0 as k, d as m from ds where day(d) = 1 union all select 1, d from ds where month(d) = 2 and day(d) = 29 union all select 2, d + interval 750 minute from ds where month(d) = 12 and day(d) = 31 and dayofweek(d) = 5
  union all select 4, d + to_minutes(180 + x) from ds, (select unnest(range(0, 60, 7)) as x) where d < timestamp '2030-01-01' union all select 5, d + interval 1439 minute from ds where month(d) = 2 and day(d) = 29 and dayofweek(d) = 0)
 select c_custkey, min(m) as next_run_at from p left join f on f.k = p.k and f.m > p.t group by c_custkey""",
    "zoned_schedules": """with e as (select event_id as id, timezone(z, timezone('UTC', ts)) as now, event_id % 2 = 0 as every, (event_id % 5 + 8) * 60 + 30 as mins, z from (select *, list_extract(['America/New_York', 'Europe/Berlin', 'Asia/Kolkata'], cast(event_id % 3 + 1 as int)) as z from events)),
 d as (select *, date_trunc('day', now) + to_minutes(mins) as today, date_trunc('day', now) + interval 555 minute as c from e), n as (select *, case when today > now then today else today + interval 1 day end as next, case when c > now then c else c + interval 1 day end as cron from d),
 w as (select *, next + to_days(case when every then 0 when dayofweek(next) = 6 then 2 when dayofweek(next) = 0 then 1 else 0 end) as fires, cron + to_days(case dayofweek(cron) when 6 then 2 when 0 then 1 else 0 end) as cron_fires from n)
 select id, timezone('UTC', timezone(z, fires)) as next_run_at, timezone('UTC', timezone(z, cron_fires)) as next_cron_at, true as in_time from w""",
    "blackout": """with e as (select event_id as id, hour(ts) * 60 + minute(ts) as t from events) select id, case when id % 3 <> 0 then false when id % 2 = 0 then t >= 1320 or t < 360 else t >= 90 and t < 360 end as blacked_out from e""",
    "job_portals": "select n_nationkey, lower(n_name) || case n_nationkey % 3 when 0 then '|x' when 1 then '' else '|y' end as names from nation",
    "portal_dispatch": """with p as (select n_nationkey, n_nationkey % 2 = 0 as form, n_nationkey % 3 = 0 as browser from nation)
 select n_nationkey, case when form or browser then 'playwright' else 'http' end as backend, case when form then 'search_form' else 'generic_table' end as plugin, case when not form then 'generic_table' when browser then 'search_form' end as plugin_preferred from p""",
    "backoff_delays": "select event_id as id, case when event_id % 3 = 0 then 7.5::double else least(30.0::double, 1.5::double * pow(2.0::double, event_id % 6)) end as delay from events",
    "dynamic_values": O + " select id, case id % 5 when 0 then 'from ' || strftime(posted_at, '%Y-%m-%d') when 1 then strftime(posted_at + to_days(7), '%Y-%m-%d') || '..' when 2 then strftime(posted_at - to_days(30), '%Y-%m-%d') when 3 then 'since ' || strftime(coalesce(case when id % 2 = 0 then closing_at end, posted_at - to_days(30)), '%Y-%m-%d') else 'plain' end as value from opportunities",
    "natural_dates": O + """ select id, case id % 9 when 0 then posted_at when 1 then posted_at when 2 then posted_at + interval 14 hour + interval 30 minute when 3 then posted_at + to_days(1) when 4 then posted_at + to_days(10) when 5 then posted_at - to_days(3) when 6 then posted_at end as value,
 list_extract([0.8, 0.8, 0.9, 0.6, 0.6, 0.6, 0.7, 0.0, 0.0], cast(id % 9 + 1 as int))::double as confidence from opportunities""",
    "exact_status": O + " select id, list_extract(['OPEN', 'CLOSED', 'AWARDED', 'EXPIRED', 'CANCELLED', 'UNKNOWN', 'UNKNOWN'], cast(id % 7 + 1 as int)) as status, list_extract(['Under Review', 'Ended', 'Contract Awarded', 'Stale', 'Void', 'Opened', ''], cast(id % 7 + 1 as int)) as shown from opportunities",
    "opportunity_detail": O + " select o.id, p.portal_name from opportunities o left join (select * from portals where enabled) p using (portal_id)",
    "share_with_links": "select source, round(avg(cast(contains(coalesce(text, ''), 'http') as int)), 6) as linked, round(avg(cast(length(coalesce(text, '')) > 40 as int)), 6) as worded from documents group by 1",
    "longest_title": """with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents), e as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as i from l),
 c as (select doc_id, length(trim(line, ' ')) as n, i from e), b as (select doc_id, max(n) as n, arg_min(i, (-n, i)) as line from c where n between 4 and 180 group by 1) select d.doc_id, cast(n as int) as n, cast(line as int) as line from documents d left join b using (doc_id)""",
    "dates_in_text": O + " select id, strftime(coalesce(closing_at, posted_at), '%B %-d, %Y') as closing, strftime(posted_at, '%Y-%m-%d') as posted, 3::bigint as n from opportunities",
    "portal_preview": O + ", n as (select region, array_agg(portal_name order by portal_name) as names from portals group by 1) select region, array_to_string(names[1:3], ', ') || case when len(names) > 3 then ' (+' || (len(names) - 3) || ')' else '' end as shown from n",
    "portal_counters": f"""with {RUNS}, r as (select portal_id, count(*) as total_runs, cast(sum(opportunities_new) as bigint) as total_opportunities, max(finished_at) as last_scraped_at, max(finished_at) filter (status = 'COMPLETED') as last_success_at from runs group by 1)
 select n_nationkey as portal_id, coalesce(total_runs, 0) as total_runs, coalesce(total_opportunities, 0) as total_opportunities, last_scraped_at, last_success_at from nation left join r on portal_id = n_nationkey""",
    "runs_of_named_portal": f"with {RUNS} select lower(n_name) as portal_name, run_id, status, cast(epoch_us(finished_at) - epoch_us(started_at) as bigint) // 1000000 as duration_seconds from runs join nation on n_nationkey = portal_id where lower(n_name) in ('nation_3', 'nation_7', 'none')",
    "resumable_runs": f"with {RUNS}, r as (select run_id, case when run_id % 3 = 0 then status else 'RUNNING' end as status from runs) select run_id, status from r where run_id % 5 = 0 and status in ('RUNNING', 'PARTIAL', 'FAILED')",
    "rate_limiter_stats": "with h as (select regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, count(*) as requests from pages group by 1) select count(*) as domains_tracked, cast(sum(requests) as bigint) as total_requests, max(requests) as most, min(requests) as least from h",
    "nested_paths": "select c_custkey, c_name as name, cast(c_custkey + 1 as varchar) as second, cast(null as varchar) as beyond, cast(null as varchar) as absent from customer",
    "lookup_by_key": f"{O}, f as (select *, {fingerprint()} as fp from opportunities) select 'key' as by, case when id % 2 = 0 then external_id else 'OPP-x' end as asked, case when id % 2 = 0 then id end as id from f union all select 'fingerprint', fp, id from f",
    "record_ordinals": O + " select portal_id, cast(floor(id / 25) as bigint) as page, cast(row_number() over (partition by portal_id, floor(id / 25) order by id) - 1 as int) as row_index, id from opportunities",
    "schedule_changes": """with n as (select lower(n_name) as name, n_nationkey as k, n_nationkey < 15 as known, case when n_nationkey >= 5 then list_extract(['add', 'pause', 'resume', 'delete'], n_nationkey % 4 + 1) end as action from nation)
 select name, case when not known then true when action = 'pause' then false when action = 'resume' then true else k % 2 = 0 end as enabled, case when known then 'a,b' when k % 8 = 0 then 'c' else '' end as portals from n where (known and coalesce(action <> 'delete', true)) or (not known and action = 'add')""",
    "page_snapshots": f"""with c as (select c_custkey as page_id, 'https://e.org/' || c_custkey as url, case when c_custkey % 3 > 0 then (c_custkey % 10) / 10.0::double end as extraction_confidence from customer)
 select page_id, url, case when extraction_confidence is null then 'no_records' else 'low_confidence' end as reason, extraction_confidence, timestamp '{v.AS_OF}' as created_at from c where extraction_confidence is null or extraction_confidence < 0.4""",
}
