"""Scalar functions over raw listings: dates, money, status, text, headers, normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidflow.functions import dates, hashing, headers, money, status, text
from bidflow.plans.ctes import LISTINGS, OPPORTUNITIES, fingerprint
from bidflow.sources import views as v


def parse_date_formats(spark, sf):
    return text.computed(text.spread(v.raw_listings(spark, sf)), {"d": dates.parse_date(F.col("closing_text"))}).select("id", F.col("d.value").alias("closing_at"), F.col("d.confidence").alias("confidence"), F.col("d.format").alias("format"))


def _money(spark, sf, compat):
    m = text.computed(text.spread(v.raw_listings(spark, sf)), {"m": money.parse_money(F.col("value_text"), compat)})
    return m.select("id", F.round("m.amount", 4).alias("amount"), F.col("m.currency").alias("currency"), F.round("m.confidence", 4).alias("confidence"))


def parse_money_fixed(spark, sf):
    return _money(spark, sf, False)


def parse_money_compat(spark, sf):
    return _money(spark, sf, True)


def parse_status(spark, sf):
    s = text.computed(text.spread(v.raw_listings(spark, sf)), {"s": status.parse_status(F.col("status_text"))})
    return s.select("id", F.col("s.status").alias("status"), F.col("s.confidence").alias("confidence"))


def infer_status(spark, sf):
    o = v.opportunities(spark, sf)
    given, awarded = F.when(F.col("id") % 3 == 0, F.col("status")), F.when(F.col("id") % 4 == 0, F.col("posted_at"))
    return o.select("id", status.inferred(given, F.col("closing_at"), awarded, v.as_of()).alias("status"))


def normalize_title(spark, sf):
    return v.raw_listings(spark, sf).select("id", text.clean_html_text(F.col("title")).alias("title"))


def normalize_whitespace_text(spark, sf):
    t = text.normalize_whitespace(F.col("text"))
    return v.table(spark, sf, "documents").select("doc_id", F.md5(t).alias("md5"), F.length(t).cast("long").alias("chars"))


def clean_page_text(spark, sf):
    t = text.clean_html_text(F.regexp_replace("html", "<[^>]*>", " "))
    return v.table(spark, sf, "pages").select("page_id", F.md5(t).alias("md5"), F.length(t).cast("long").alias("chars"))


def value_compact(spark, sf):
    whole = F.floor("estimated_value").cast("double")
    return v.opportunities(spark, sf).select("id", money.compact(F.when(F.col("id") % 2 == 0, F.floor(whole / 1000) * 1000).otherwise((F.col("id") % 900).cast("double"))).alias("value"))


def header_exact_match(spark, sf):
    h = F.element_at(F.array(*(F.lit(x) for x in (" Bid Number", "CLOSING DATE", "Title", "Agency ", "state", "Award Amount", "Unknown", "type"))), (F.col("id") % 8 + 1).cast("int"))
    return v.opportunities(spark, sf).select("id", h.alias("header"), headers.exact_field(h).alias("field"))


def header_token_subset(spark, sf):
    h = F.concat_ws(" ", F.col("category"), F.element_at(F.array(*(F.lit(x) for x in ("(Bid) no", "date: Closing", "Project/Title", "the Agency!", "xyz"))), (F.col("id") % 5 + 1).cast("int")))
    return v.opportunities(spark, sf).select("id", h.alias("header"), headers.token_subset_field(h).alias("field"))


def label_keyword_match(spark, sf):
    h = F.element_at(F.array(*(F.lit(x) for x in ("Date Posted:", "Closing", "Bid #", "Commodity", "State", "Buyer", "Other"))), (F.col("id") % 7 + 1).cast("int"))
    return v.opportunities(spark, sf).select("id", headers.label_field(h).alias("field"))


def header_fuzzy_match(spark, sf):
    h = F.concat(F.substring(F.element_at(F.array(*(F.lit(x) for x in ("closing date", "solicitation number", "agency", "estimated value"))), (F.col("id") % 4 + 1).cast("int")), F.lit(1), (F.col("id") % 13 + 5).cast("int")), F.element_at(F.array(*(F.lit(x) for x in ("", "s", "_x"))), (F.col("id") % 3 + 1).cast("int")))
    return headers.fuzzy_fields(v.opportunities(spark, sf).select(h.alias("h")), "h")


def table_confidence(spark, sf):
    names = F.array_compact(F.array(*(F.when(F.col("id") % k != 0, F.lit(f)) for k, f in ((2, "external_id"), (3, "title"), (4, "closing_at"), (5, "status"), (7, "agency"), (6, "location")))))
    o = v.opportunities(spark, sf).withColumns({"fields": names, "rows": (F.col("id") % 9).cast("int")})
    return o.select("id", headers.table_confidence(F.col("fields"), F.greatest(F.size("fields") - 1, F.lit(0)), F.lit(8), F.col("rows")).alias("confidence"))


def normalize_opportunity(spark, sf):
    """Raw text fields to canonical ones, in one projection."""
    r = text.computed(text.spread(v.raw_listings(spark, sf)), {"d": dates.parse_date(F.col("closing_text")), "m": money.parse_money(F.col("value_text")), "s": status.parse_status(F.col("status_text"))})
    amount = F.when(F.col("m.amount") != 0, F.round("m.amount", 4))
    warn = F.array_compact(F.array(F.when(F.col("closing_text").isNotNull() & F.col("d.value").isNull(), F.lit("closing date not read"))))
    return r.select(
        text.first_filled("external_id", F.substring(F.md5("title"), 1, 16)).alias("external_id"), F.substring(text.clean_html_text(F.col("title")), 1, 1000).alias("title"), F.col("d.value").alias("closing_at"), F.col("s.status").alias("status"),
        amount.alias("estimated_value"), F.when(amount.isNotNull(), F.col("m.currency")).otherwise("USD").alias("currency"), text.normalize_whitespace(F.col("agency")).alias("agency"), F.array_join(F.transform(F.split("category", ","), lambda x: F.trim(x)), ",").alias("commodity_codes"), F.array_join(warn, ";").alias("warnings"),
    )


def fingerprint_canonical(spark, sf):
    o = v.opportunities(spark, sf)
    return o.select("id", hashing.fingerprint(o).alias("fingerprint"))


def fingerprint_dict(spark, sf):
    o = v.opportunities(spark, sf)
    return o.select("id", hashing.fingerprint(o, "None").alias("fingerprint"))


L, O = f"with {LISTINGS}", f"with {OPPORTUNITIES}"
DATES = """case id % 7 when 0 then closing_at when 1 then closing_at when 2 then closing_at when 3 then closing_at when 4 then closing_at + interval 14 hour + interval 30 minute when 5 then closing_at end"""


def _pick(items, of):
    return f"list_extract([{', '.join(chr(39) + x + chr(39) for x in items)}], cast({of} + 1 as int))"


def _money_sql(euro: str, dollars: str) -> str:
    """The amounts that the textual forms stand for; compat reads a lone comma as a decimal one."""
    whole = "cast(floor(estimated_value) as bigint)"
    return f"""{O} select id, case id % 5 when 0 then {dollars} when 1 then {euro} when 2 then floor({whole} / 1000) * 1000.0 when 3 then {whole} + 500.0 end as amount,
 case id % 5 when 1 then 'EUR' else 'USD' end as currency, case id % 5 when 0 then 0.9 when 1 then 0.95 when 2 then 0.95 when 3 then 0.81 else 0.0 end::double as confidence from opportunities"""


# Fields of the headers of header_exact_match; in header_token_subset a header's category has no alias.
_EXACT = "case id % 8 when 0 then 'external_id' when 1 then 'closing_at' when 2 then 'title' when 3 then 'agency' when 4 then 'status' when 5 then 'estimated_value' when 7 then 'category' end"
_SUBSET = "case id % 5 when 0 then 'external_id' when 1 then 'closing_at' when 2 then 'title' when 3 then 'agency' end"
WHOLE = "cast(floor(estimated_value) as bigint)"
SQL = {
    "parse_date_formats": L + f""" select l.id, {DATES.replace('id %', 'l.id %')} as closing_at,
 case when closing_at is null or l.id % 7 = 6 then 0.0 else list_extract([1.0, 0.95, 0.9, 0.85, 0.85, 0.75], cast(l.id % 7 + 1 as int)) end::double as confidence,
 case when closing_at is not null then list_extract(['iso8601', 'iso_space_no_sec', 'iso_date', 'us_date', 'us_datetime', 'us_date_short'], cast(l.id % 7 + 1 as int)) end as format
 from listings l join opportunities o on l.id = o.id""",
    "parse_money_fixed": _money_sql(f"{WHOLE} + 0.25", f"{WHOLE} + 0.5"),
    "parse_money_compat": _money_sql(f"{WHOLE} + 0.25", f"{WHOLE} + 0.5"),
    "parse_status": L + " select id, case status_text when 'Open for bid' then 'OPEN' when 'Contract awarded' then 'AWARDED' else 'PENDING' end as status, case status_text when 'Open for bid' then 0.85 when 'Contract awarded' then 0.85 else 0.95 end::double as confidence from listings",
    "infer_status": O + f" select id, case when id % 3 = 0 then status when id % 4 = 0 then 'AWARDED' when closing_at > timestamp '{v.AS_OF}' then 'OPEN' when closing_at is not null then 'CLOSED' else 'UNKNOWN' end as status from opportunities",
    "normalize_title": L + " select id, trim(regexp_replace(replace(title, '&amp;', '&'), '\\s+', ' ', 'g')) as title from listings",
    "normalize_whitespace_text": "select doc_id, md5(t) as md5, length(t) as chars from (select doc_id, trim(regexp_replace(text, '[\\s\\x{000B}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) as t from documents)",
    "clean_page_text": "select page_id, md5(t) as md5, length(t) as chars from (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;?', ' ', 'g'), '&amp;?', '&', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '\"', 'g'), '&#39;?', '''', 'g'), '[\\s\\x{000B}\\x{0085}\\x{00A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) as t from pages)",
    "value_compact": O + " select id, case when id % 2 = 1 then '$' || (id % 900) when floor(estimated_value / 1000) < 1 then '$0' else '$' || cast(floor(estimated_value / 1000) as bigint) || 'K' end as value from opportunities",
    "header_exact_match": O + f", h as (select id, {_pick([' Bid Number', 'CLOSING DATE', 'Title', 'Agency ', 'state', 'Award Amount', 'Unknown', 'type'], 'id % 8')} as header from opportunities) select id, header, {_EXACT} as field from h",
    "header_token_subset": O + f", h as (select id, category || ' ' || {_pick(['(Bid) no', 'date: Closing', 'Project/Title', 'the Agency!', 'xyz'], 'id % 5')} as header from opportunities) select id, header, {_SUBSET} as field from h",
    "label_keyword_match": O + f" select id, {_pick(['posted_at', 'closing_at', 'external_id', 'category', 'status', 'agency'], 'id % 7')} as field from opportunities",
    "table_confidence": O + """, t as (select id, id % 9 as n, cast(id % 2 <> 0 as int) + cast(id % 3 <> 0 as int) as req, cast(id % 4 <> 0 as int) + cast(id % 5 <> 0 as int) + cast(id % 7 <> 0 as int) as imp, cast(id % 6 <> 0 as int) as other from opportunities),
 u as (select *, req + imp + other as m from t)
 select id, case when n = 0 then 0.0::double else round_even(0.3::double * ((greatest(m - 1, 0) + 0.7::double * (m - greatest(m - 1, 0))) / 8) + 0.4::double * req / 2 + 0.2::double * imp / 4 + 0.1::double * least(1.0::double, n / 5.0::double), 3) end as confidence from u""",
    "normalize_opportunity": L + f""" select l.external_id, trim(regexp_replace(replace(l.title, '&amp;', '&'), '\\s+', ' ', 'g')) as title, {DATES.replace('id %', 'l.id %')} as closing_at, o.status,
 nullif(case l.id % 5 when 0 then {WHOLE} + 0.5 when 1 then {WHOLE} + 0.25 when 2 then floor({WHOLE} / 1000) * 1000.0 when 3 then {WHOLE} + 500.0 end, 0)::double as estimated_value,
 case when l.id % 5 = 1 then 'EUR' else 'USD' end as currency, l.agency, l.category as commodity_codes, case when l.id % 7 = 6 then 'closing date not read' else '' end as warnings
 from listings l join opportunities o on l.id = o.id""",
    "fingerprint_canonical": O + f" select id, {fingerprint()} as fingerprint from opportunities",
    "header_fuzzy_match": f"""with recursive {OPPORTUNITIES}, h as (select distinct substr(list_extract(['closing date', 'solicitation number', 'agency', 'estimated value'], cast(id % 4 + 1 as int)), 1, cast(id % 13 + 5 as int)) || list_extract(['', 's', '_x'], cast(id % 3 + 1 as int)) as header from opportunities),
 d as (select unnest({list(headers.synonyms())}) as name, unnest({list(headers.synonyms().values())}) as field, unnest(range({len(headers.synonyms())})) as rank),
 p as (select row_number() over () as pair, trim(lower(header)) as a, name as b, header, field, rank from h, d),
 l as (select pair, 0 as i, list_transform(range(length(b) + 1), lambda x: cast(0 as bigint)) as row from p
  union all select l.pair, i + 1, list_transform(range(1, length(b) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(row[k], case when k > 1 and substr(b, k - 1, 1) = substr(a, i + 1, 1) then row[k - 1] + 1 else 0 end)))) from l join p on p.pair = l.pair where i < length(a)),
 s as (select header, field, rank, cast(round_even(200.0 * row[-1] / (length(a) + length(b)), 0) as int) as score from l join p on p.pair = l.pair where i = length(a)),
 m as (select header, arg_max(field, (score, -rank)) as field, max(score) as score from s where score >= 75 group by 1)
 select header, field, score from h left join m using (header)""",
    "fingerprint_dict": O + f" select id, {fingerprint(missing='None')} as fingerprint from opportunities",
}
