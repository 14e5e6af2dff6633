"""Raw fields to canonical opportunities, in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidflow.functions import date_grammar, money, status, text

# Keys of raw fields in the order in which they are tried.
KEYS = {
    "external_id": ["external_id", "id", "bid_id", "rfp_id", "solicitation_id"],
    "title": ["title", "name", "project_title", "solicitation_title"],
    "description": ["description", "details", "summary", "scope"],
    "closing_at": ["closing_at", "close_date", "due_date", "deadline", "end_date"],
    "posted_at": ["posted_at", "post_date", "publish_date", "open_date", "start_date"],
    "awarded_at": ["awarded_at", "award_date"],
    "status": ["status", "state", "bid_status"],
    "estimated_value": ["estimated_value", "value", "amount", "budget", "contract_value"],
    "award_amount": ["award_amount", "awarded_value", "contract_amount"],
    "agency": ["agency", "department", "organization", "buyer"],
    "department": ["department"],
    "category": ["category", "type", "commodity", "classification"],
    "location": ["location"],
    "commodity_codes": ["commodity_codes"],
    "contact_name": ["contact_name", "contact", "buyer_name"],
    "contact_email": ["contact_email", "email"],
    "contact_phone": ["contact_phone", "phone"],
    "awardee": ["awardee", "vendor", "winner", "contractor"],
    "description_markdown": ["description_markdown"],
    "source_url": ["source_url"],
    "detail_url": ["detail_url"],
}
#: What a listing row keeps of a record.
LISTING = ["external_id", "title", "closing_at", "posted_at", "status", "agency", "category", "detail_url"]
LONGEST_TITLE, LONGEST = 1000, 500


def listing_items(records: DataFrame) -> DataFrame:
    """Records with an id or a title, the fields of listings alone."""
    return records.select(*(F.col(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in LISTING), *(c for c in ("confidence", "row_index") if c in records.columns)).where(text.first_filled("external_id", "title").isNotNull())


def canonical(raw: DataFrame, as_of: Column, keep: tuple = (), compat: bool = False, day_first: bool = False) -> DataFrame:
    """raw (any of the keys as text columns) as canonical rows, with warnings; ``keep`` are columns to carry along.

    Dates in words are read relative to as_of. ``compat`` reads money as the older parser does, which takes the comma of $1,234 for a decimal point.
    """

    def first(name: str) -> Column:
        there = [k for k in KEYS[name] if k in raw.columns]
        return text.first_filled(*there) if there else F.lit(None).cast("string")

    none = F.lit(None)
    cut = lambda name: F.nullif(F.substring(text.normalize_whitespace(first(name)), 1, LONGEST), F.lit(""))
    amount = lambda name: text.bound(money.parse_money(first(name), compat), lambda m: F.when(m["amount"] != 0, F.struct(F.round(m["amount"], 4).alias("amount"), m["currency"].alias("currency"))))
    date = lambda i: F.col("__dates")[i]["value"]
    title = F.nullif(F.substring(text.clean_html_text(first("title")), 1, LONGEST_TITLE), F.lit(""))
    stand_in = F.coalesce(*(text.first_filled(c) for c in ("title", "name", "description") if c in raw.columns), none.cast("string"))
    key = F.coalesce(first("external_id"), F.substring(F.md5(stand_in), 1, 16), F.concat(F.lit("unknown_"), F.unix_timestamp(as_of).cast("string")))
    told = text.computed(
        raw,
        {
            "__dates": F.transform(F.array(*map(first, ("closing_at", "posted_at", "awarded_at"))), lambda t: date_grammar.parse_any(t, as_of, day_first)),  # one expression for all three
            "__state": status.parse_status(first("status")),
        },
    )
    typed = told.select(
        *keep, key.alias("external_id"), first("external_id").isNull().alias("__made"), title.alias("title"), F.nullif(text.clean_html_text(first("description")), F.lit("")).alias("description"), first("description_markdown").alias("description_markdown"),
        date(0).alias("closing_at"), first("closing_at").isNotNull().alias("__told"), date(1).alias("posted_at"), date(2).alias("awarded_at"), F.when(first("status").isNotNull(), F.col("__state.status")).alias("__status"),
        cut("category").alias("category"), F.transform(F.split(first("commodity_codes"), ","), lambda x: F.trim(x)).alias("codes"), cut("agency").alias("agency"), cut("department").alias("department"), cut("location").alias("location"),
        *(first(c).alias(c) for c in ("contact_name", "contact_email", "contact_phone", "awardee", "source_url", "detail_url")), amount("estimated_value").alias("__value"), amount("award_amount").alias("__award"),
        F.coalesce(F.when(F.col("confidence").cast("string").rlike(r"(?i)\d|inf|nan"), F.col("confidence").try_cast("double")) if "confidence" in raw.columns else none.cast("double"), F.lit(0.0)).alias("extraction_confidence"),
    )
    state = status.inferred(F.col("__status"), F.col("closing_at"), F.col("awarded_at"), as_of)
    warnings = F.array_compact(F.array(F.when(F.col("__made"), F.lit("external id made up")), F.when(F.col("__told") & F.col("closing_at").isNull(), F.lit("closing date not read"))))
    return typed.select(
        *keep, "external_id", "title", "description", "description_markdown", "posted_at", "closing_at", "awarded_at", state.alias("status"), "category", F.nullif(F.array_join("codes", ","), F.lit("")).alias("commodity_codes"), "agency", "department",
        "location", "contact_name", "contact_email", "contact_phone", F.col("__value.amount").alias("estimated_value"), F.coalesce("__value.currency", F.lit("USD")).alias("estimated_value_currency"), F.col("__award.amount").alias("award_amount"),
        "awardee", "source_url", "detail_url", "extraction_confidence", F.array_join(warnings, "; ").alias("warnings"),
    )


def merged(listings: DataFrame, details: DataFrame, on: str) -> DataFrame:
    """Listings with their details: a detail's columns win, nulls included, where there is one."""
    fields = [c for c in details.columns if c != on]
    renamed = details.select(on, *(F.col(c).alias(f"__{c}") for c in fields), F.lit(True).alias("__there"))
    both = listings.join(renamed, on, "left")
    plain = [c for c in listings.columns if c != on and c not in fields]
    return both.select(on, *plain, *(F.when(F.col("__there"), F.col(f"__{c}")).otherwise(F.col(c) if c in listings.columns else F.lit(None)).alias(c) for c in fields))


def enriched(listings: DataFrame, details: DataFrame, fields: list[str], most: int, order: str) -> DataFrame:
    """Listings with the filled fields of their details, of the first most rows by order that have a detail_url; what was told stays where a detail is silent.

    detail tells what became of a row: scraped, failed (no detail came, or one without success), or null where none was asked for. details: detail_url, success, and some of the fields.
    """
    asked = listings.where(text.first_filled("detail_url").isNotNull()).orderBy(order).limit(most).select(F.col(order).alias("__order"), F.lit(True).alias("__asked"))
    told = [f for f in fields if f in details.columns]
    came = details.where("success").groupBy("detail_url").agg(F.max(F.struct(*told)).alias("__d"))
    both = listings.join(asked, F.col(order) == F.col("__order"), "left").join(came, "detail_url", "left")
    here = F.col("__asked") & F.col("__d").isNotNull()
    new = {f: F.coalesce(F.when(here, F.nullif(F.col(f"__d.{f}"), F.lit(""))), F.col(f) if f in listings.columns else F.lit(None).cast("string")) for f in told}
    outcome = F.when(here, "scraped").when(F.col("__asked"), "failed")
    return both.select(*(c for c in listings.columns if c not in new), *(c.alias(f) for f, c in new.items()), outcome.alias("detail"))
