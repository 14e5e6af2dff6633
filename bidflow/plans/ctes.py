"""DuckDB definitions of the domain views that oracle queries begin with."""

OPPORTUNITIES = """
portals as (select n_nationkey as portal_id, lower(n_name) as portal_name, r_name as region, n_nationkey % 5 <> 0 as enabled
  from nation join region on n_regionkey = r_regionkey),
opportunities as (select o_orderkey as id, c_nationkey as portal_id, 'OPP-' || o_orderkey as external_id,
  o_orderpriority || ' supply contract ' || o_orderkey as title, c_name as agency, c_mktsegment as category, o_orderdate as posted_at,
  case when o_orderkey % 11 <> 0 then o_orderdate + to_days(cast(o_orderkey % 60 as int)) end as closing_at,
  case o_orderstatus when 'O' then 'OPEN' when 'F' then 'AWARDED' else 'PENDING' end as status, o_totalprice as estimated_value
  from orders join customer on o_custkey = c_custkey)"""

LISTINGS = (
    OPPORTUNITIES
    + """,
listings as (select id, portal_id, external_id, '  ' || title || ' &amp; services' || chr(9) as title, agency, category,
  case id % 7 when 0 then strftime(closing_at, '%Y-%m-%dT%H:%M:%S') when 1 then 'Closing date: ' || strftime(closing_at, '%Y-%m-%d %H:%M')
    when 2 then 'Due: ' || strftime(closing_at, '%Y-%m-%d') when 3 then strftime(closing_at, '%m/%d/%Y')
    when 4 then strftime(closing_at, '%m/%d/%Y') || ' 2:30 PM ET' when 5 then 'closes:  ' || strftime(closing_at, '%m/%d/%y') else 'to be announced' end as closing_text,
  case id % 5 when 0 then '$' || format('{:,}', cast(floor(estimated_value) as bigint)) || '.50'
    when 1 then 'EUR ' || replace(format('{:,}', cast(floor(estimated_value) as bigint)), ',', '.') || ',25'
    when 2 then 'USD ' || cast(floor(floor(estimated_value) / 1000) as bigint) || 'K'
    when 3 then '$' || cast(floor(estimated_value) as bigint) || ' - $' || (cast(floor(estimated_value) as bigint) + 1000) else 'n/a' end as value_text,
  case status when 'OPEN' then 'Open for bid' when 'AWARDED' then 'Contract awarded' else 'Under review' end as status_text
  from opportunities)"""
)

SNAPSHOTS = (
    OPPORTUNITIES
    + """,
old as (select *, 'buyer ' || (id % 100) as contact_name from opportunities where id % 10 <> 0),
new as (select * replace (case when id % 7 = 0 then closing_at + to_days(7) else closing_at end as closing_at,
    case when id % 13 = 0 then 'CLOSED' else status end as status),
  case when id % 17 = 0 then 'changed' else 'buyer ' || (id % 100) end as contact_name from opportunities)"""
)

FINGERPRINT = """substring(sha256(concat_ws('|', {p}external_id, {p}title, '', {p}status, {p}category, {p}agency,
  coalesce(strftime({p}closing_at, '%Y-%m-%d %H:%M:%S'), '{missing}'), coalesce(cast(cast(nullif({p}estimated_value, 0) as decimal(20,2)) as varchar), '{missing}'))), 1, 32)"""


def fingerprint(prefix: str = "", missing: str = "") -> str:
    return FINGERPRINT.format(p=prefix, missing=missing)


CLASSES = (
    SNAPSHOTS
    + f""",
both_ as (select n.portal_id, n.external_id, o.id is not null as known, {fingerprint('o.')} as old_fp, {fingerprint('n.')} as new_fp,
    o.status as old_status, n.status as new_status, o.closing_at as old_closing, n.closing_at as new_closing, o.contact_name as old_contact, n.contact_name as new_contact
  from new n left join old o on n.portal_id = o.portal_id and n.external_id = o.external_id),
classes as (select *, case when not known then 'NEW' when old_fp = new_fp then 'UNCHANGED' else 'UPDATED' end as outcome,
    case when not known then 'NEW' when old_status <> new_status and new_status in ('CLOSED', 'AWARDED', 'EXPIRED') then new_status else 'UPDATED' end as kind,
    old_status is distinct from new_status as c_status, old_closing is distinct from new_closing as c_closing, old_contact is distinct from new_contact as c_contact
  from both_)"""
)

EVENTS = """
events_ as (select event_id as id, user_id as opportunity_id, case event_type when 'signup' then 'NEW' when 'purchase' then 'AWARDED' when 'error' then 'ERROR' else 'UPDATED' end as event_type,
  props as diff, value, ts as created_at from events)"""

RUNS = (
    EVENTS
    + """,
numbered as (select *, coalesce(cast(date_sub('second', lag(created_at) over w, created_at) > 1800 as int), 1) as starts from events_ window w as (partition by opportunity_id order by created_at, id)),
counted as (select *, sum(starts) over (partition by opportunity_id order by created_at, id rows unbounded preceding) as run from numbered),
runs as (select min(id) as run_id, cast(opportunity_id % 30 as int) as portal_id, min(created_at) as started_at, max(created_at) as finished_at, count(*) as pages_scraped,
  count(*) filter (event_type = 'ERROR') as errors_count, count(*) filter (event_type = 'NEW') as opportunities_new, count(*) filter (event_type in ('UPDATED', 'AWARDED')) as opportunities_updated,
  case when count(*) filter (event_type = 'ERROR') = 0 then 'COMPLETED' else 'PARTIAL' end as status from counted group by opportunity_id, run)"""
)
