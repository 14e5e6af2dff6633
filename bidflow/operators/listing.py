"""Filters, sorts, limits and projections over opportunities, events and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidflow.functions.text import absolute, shortened
from bidflow.scratch import discard, stored

# Columns of the exports.
CSV_COLUMNS = ["id", "external_id", "title", "status", "agency", "closing_at", "posted_at", "estimated_value", "source_url"]
JSON_COLUMNS = ["id", "external_id", "title", "description", "status", "agency", "closing_at", "posted_at", "estimated_value", "source_url", "detail_url"]
JSONL_COLUMNS = ["id", "external_id", "title", "status", "agency", "closing_at", "posted_at", "estimated_value"]
# Columns of lists that are printed.
SHOWN_JSON = ["id", "external_id", "title", "status", "agency", "closing_at", "posted_at", "estimated_value", "source_url"]
SHOWN_CSV = ["id", "external_id", "title", "status", "agency", "closing_at", "estimated_value"]


def list_opportunities(df: DataFrame, portal_id: int | None = None, status: str | None = None, closing_within_days: int | None = None, as_of: Column | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """The next to close first, those without a date last; ties by id."""
    if portal_id is not None:
        df = df.where(F.col("portal_id") == portal_id)
    if status is not None:
        df = df.where(F.col("status") == status.upper())
    if closing_within_days is not None:
        df = df.where(F.col("closing_at").between(as_of, as_of + F.make_dt_interval(F.lit(closing_within_days))))
    ordered = df.orderBy(F.asc_nulls_last("closing_at"), "id")
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def list_events(df: DataFrame, opportunity_id: int | None = None, event_type: str | None = None, since: Column | None = None) -> DataFrame:
    if opportunity_id is not None:
        df = df.where(F.col("opportunity_id") == opportunity_id)
    if event_type is not None:
        df = df.where(F.col("event_type") == event_type)
    return df if since is None else df.where(F.col("created_at") >= since)


def quick_filter(df: DataFrame, keywords: list[str] = (), statuses: list[str] = (), categories: list[str] = (), location: str | None = None, since: Column | None = None, closing_by: Column | None = None, low: float = 0, high: float = 0, base_url: str | None = None) -> DataFrame:
    """Substring filters over listing rows; rows whose date or value can't be read are kept. With base_url, links to details are made absolute first, filters or none."""
    if base_url and "detail_url" in df.columns:
        link = F.col("detail_url")
        df = df.withColumn("detail_url", F.when(link.startswith("http") | (link == ""), link).otherwise(absolute(F.lit(base_url), link)))

    def any_of(text: Column, words: list[str]) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | F.contains(text, F.lit(w.lower()))
        return found

    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    if keywords:
        df = df.where(any_of(F.concat_ws(" ", text("title"), text("description")), keywords))
    if statuses:
        df = df.where(any_of(text("status"), statuses))
    if categories:
        df = df.where(any_of(text("category"), categories))
    if location:
        df = df.where(F.contains(text("location"), F.lit(location.lower())))
    if since is not None:
        df = df.where(F.coalesce(F.col("posted_at") >= since, F.lit(True)))
    if closing_by is not None:
        df = df.where(F.coalesce(F.col("closing_at") <= closing_by, F.lit(True)))
    value = F.nullif(F.regexp_replace("value_text", r"[^\d.]", ""), F.lit("")).try_cast("double") if "value_text" in df.columns else F.col("estimated_value")
    if low:
        df = df.where(F.coalesce(value >= low, F.lit(True)))
    if high:
        df = df.where(F.coalesce(value <= high, F.lit(True)))
    return df


def export_rows(df: DataFrame, kind: str) -> DataFrame:
    """Rows as the exports write them: csv columns (no value: empty, 0 too), or one JSON object a line."""
    columns = {"csv": CSV_COLUMNS, "json": JSON_COLUMNS}.get(kind, JSONL_COLUMNS)
    return _shaped(df, columns, kind == "csv")


def shown_rows(df: DataFrame, kind: str) -> DataFrame:
    """Rows as lists print them: json objects a line, or csv columns with the first 80 letters of the title."""
    if kind == "csv":
        df = df.withColumn("title", F.substring("title", 1, 80))
    return _shaped(df, SHOWN_CSV if kind == "csv" else SHOWN_JSON, kind == "csv")


def _shaped(df: DataFrame, columns: list[str], plain: bool) -> DataFrame:
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c)
    shaped = df.select(*(stamp(c) if c in ("posted_at", "closing_at") else F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))
    return shaped if plain else shaped.select(F.col("external_id"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("line"))


def write_export(df: DataFrame, path: str) -> None:
    """The format follows the suffix: .csv, .jsonl (an object a line) or .json: the parts, one after the other, are one array."""
    kind = path.rsplit(".", 1)[-1]
    if kind not in ("csv", "json", "jsonl"):
        raise ValueError(f"no export format {kind!r}")
    shaped = export_rows(df, kind)
    if kind == "csv":
        shaped.withColumn("estimated_value", F.when(F.col("estimated_value") != 0, F.col("estimated_value"))).write.option("header", True).option("emptyValue", "").option("nullValue", '""').csv(path)
    elif kind == "jsonl":
        shaped.select("line").write.text(path)
    else:
        spark = df.sparkSession
        once = stored(shaped.select("line"), "export")  # read twice, so that the first row is the same both times
        numbered = once.select("line", F.monotonically_increasing_id().alias("n"))
        first = numbered.agg(F.min("n")).first()[0]
        rows = numbered.select(F.when(F.col("n") == first, F.col("line")).otherwise(F.concat(F.lit(","), "line")).alias("line"))
        edge = lambda mark: spark.range(1, numPartitions=1).select(F.lit(mark).alias("line"))
        edge("[").unionByName(rows).unionByName(edge("]")).write.text(path)
        discard(once)


def of_portal(opportunities: DataFrame, portals: DataFrame, name: str) -> DataFrame:
    """The opportunities of a portal by its name; none if there is no such portal."""
    return opportunities.join(portals.where(F.col("portal_name") == name).select("portal_id", "portal_name"), "portal_id")


def portal_view(portals: DataFrame, totals: DataFrame, enabled: bool = False) -> DataFrame:
    """Portals by name as JSON of six keys, with the opportunities and the last run of totals (portal_id, total_opportunities, last_scraped_at)."""
    shown = portals.where("enabled") if enabled else portals
    told = shown.join(totals, "portal_id", "left")
    stamp = F.date_format("last_scraped_at", "yyyy-MM-dd'T'HH:mm:ss")
    body = F.struct(F.col("portal_name").alias("name"), "display_name", "base_url", "enabled", F.coalesce("total_opportunities", F.lit(0)).cast("long").alias("total_opportunities"), stamp.alias("last_scraped"))
    return told.select("portal_name", F.to_json(body, {"ignoreNullFields": "false"}).alias("line")).orderBy("portal_name")


def table_view(df: DataFrame, urgency: Column, value: Column) -> DataFrame:
    return df.select("id", shortened(F.col("title"), 30).alias("title"), shortened(F.col("agency"), 16).alias("agency"), urgency.alias("closing"), value.alias("value"))
