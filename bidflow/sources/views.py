"""The procurement domain over the given tables: opportunities, raw listings, snapshots, events, runs, portals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The point in time of all queries that ask for "now".
AS_OF = "1998-06-01 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of(text: str = AS_OF):
    return F.lit(text).cast("timestamp_ntz")


def days(n):
    return F.make_dt_interval(n)


def portals(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("n_nationkey").alias("portal_id"), F.lower("n_name").alias("portal_name"), F.col("r_name").alias("region"), (F.col("n_nationkey") % 5 != 0).alias("enabled"))


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = F.col("o_orderkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("id"),
        F.col("c_nationkey").alias("portal_id"),
        F.concat(F.lit("OPP-"), key.cast("string")).alias("external_id"),
        F.concat(F.col("o_orderpriority"), F.lit(" supply contract "), key.cast("string")).alias("title"),
        F.col("c_name").alias("agency"),
        F.col("c_mktsegment").alias("category"),
        F.col("o_orderdate").alias("posted_at"),
        F.when(key % 11 != 0, F.col("o_orderdate") + days((key % 60).cast("int"))).alias("closing_at"),
        F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "F", "AWARDED").otherwise("PENDING").alias("status"),
        F.col("o_totalprice").alias("estimated_value"),
    )


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as portals print them: dates, money and statuses in rotating textual forms."""
    return printed(opportunities(spark, sf_dir))


def printed(o: DataFrame, *keep: str) -> DataFrame:
    """Opportunities as raw listings, with columns to carry along."""
    shape, date = F.col("id") % 7, F.col("closing_at")
    fmt = lambda f: F.date_format(date, f)
    closing = (
        F.when(shape == 0, fmt("yyyy-MM-dd'T'HH:mm:ss"))
        .when(shape == 1, F.concat(F.lit("Closing date: "), fmt("yyyy-MM-dd HH:mm")))
        .when(shape == 2, F.concat(F.lit("Due: "), fmt("yyyy-MM-dd")))
        .when(shape == 3, fmt("MM/dd/yyyy"))
        .when(shape == 4, F.concat(fmt("MM/dd/yyyy"), F.lit(" 2:30 PM ET")))
        .when(shape == 5, F.concat(F.lit("closes:  "), fmt("MM/dd/yy")))
        .otherwise(F.lit("to be announced"))
    )
    kind, whole = F.col("id") % 5, F.floor("estimated_value").cast("long")
    grouped = F.format_number(whole, 0)
    value = (
        F.when(kind == 0, F.concat(F.lit("$"), grouped, F.lit(".50")))
        .when(kind == 1, F.concat(F.lit("EUR "), F.replace(grouped, F.lit(","), F.lit(".")), F.lit(",25")))
        .when(kind == 2, F.concat(F.lit("USD "), (F.floor(whole / 1000)).cast("string"), F.lit("K")))
        .when(kind == 3, F.concat(F.lit("$"), whole.cast("string"), F.lit(" - $"), (whole + 1000).cast("string")))
        .otherwise(F.lit("n/a"))
    )
    status = F.when(F.col("status") == "OPEN", "Open for bid").when(F.col("status") == "AWARDED", "Contract awarded").otherwise("Under review")
    return o.select("id", "portal_id", "external_id", F.concat(F.lit("  "), "title", F.lit(" &amp; services\t")).alias("title"), "agency", "category", closing.alias("closing_text"), value.alias("value_text"), status.alias("status_text"), *keep)


def snapshot(spark: SparkSession, sf_dir: str, later: bool) -> DataFrame:
    """Two states of the portals: some keys are new in the later one, some closing dates, statuses and contacts differ."""
    o = opportunities(spark, sf_dir).withColumn("contact_name", F.concat(F.lit("buyer "), (F.col("id") % 100).cast("string")))
    if not later:
        return o.where("id % 10 <> 0")
    return o.withColumns(
        {
            "closing_at": F.when(F.col("id") % 7 == 0, F.col("closing_at") + days(F.lit(7))).otherwise(F.col("closing_at")),
            "status": F.when(F.col("id") % 13 == 0, "CLOSED").otherwise(F.col("status")),
            "contact_name": F.when(F.col("id") % 17 == 0, F.lit("changed")).otherwise(F.col("contact_name")),
        }
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("opportunity_id"),
        F.when(kind == "signup", "NEW").when(kind == "purchase", "AWARDED").when(kind == "error", "ERROR").otherwise("UPDATED").alias("event_type"),
        F.col("props").alias("diff"),
        F.col("value"),
        F.col("ts").alias("created_at"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrape runs: the events of a user without a gap of more than 30 minutes."""
    by_user = Window.partitionBy("opportunity_id").orderBy("created_at", "id")
    gap = F.timestamp_diff("SECOND", F.lag("created_at").over(by_user), F.col("created_at"))
    numbered = events(spark, sf_dir).withColumn("starts", F.coalesce((gap > 1800).cast("int"), F.lit(1)))
    numbered = numbered.withColumn("run", F.sum("starts").over(by_user.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = numbered.groupBy("opportunity_id", "run").agg(
        F.min("created_at").alias("started_at"), F.max("created_at").alias("finished_at"), F.count("*").alias("pages_scraped"), F.count_if(F.col("event_type") == "ERROR").alias("errors_count"),
        F.count_if(F.col("event_type") == "NEW").alias("opportunities_new"), F.count_if(F.col("event_type").isin("UPDATED", "AWARDED")).alias("opportunities_updated"), F.min("id").alias("run_id"),
    )
    return grouped.select("run_id", (F.col("opportunity_id") % 30).cast("int").alias("portal_id"), "started_at", "finished_at", "pages_scraped", "errors_count", "opportunities_new", "opportunities_updated", F.when(F.col("errors_count") == 0, "COMPLETED").otherwise("PARTIAL").alias("status"))
