"""Change data capture: classify, diff, emit events, apply.

The state of the portals is a table keyed by (portal_id, external_id). A batch of listings is joined
to it once; everything else is a projection of that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidflow.functions.hashing import as_text, fingerprint

KEY = ["portal_id", "external_id"]
# Significance of the fields that a diff compares.
SIGNIFICANCE = {
    "title": "high", "status": "high", "closing_at": "high", "estimated_value": "high", "award_amount": "high", "awardee": "high",
    "description": "medium", "agency": "medium", "department": "medium", "category": "medium", "posted_at": "medium", "awarded_at": "medium", "contact_name": "medium", "contact_email": "medium",
    "contact_phone": "low", "location": "low", "commodity_codes": "low", "detail_url": "low", "description_markdown": "low",
}
# Fields that a keyed store tracks.
TRACKED = ["title", "description", "status", "closing_at", "posted_at", "category", "agency", "estimated_value", "contact_name", "contact_email", "awardee", "award_amount"]


def last_of_batch(batch: DataFrame, order: str) -> DataFrame:
    """One row a key: the last by order."""
    row = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc(order)))
    return batch.withColumn("__row", row).where("__row = 1").drop("__row")


def printed(df: DataFrame) -> DataFrame:
    """df with its fingerprint; one that is stored with it is taken as it is."""
    return df if "fingerprint" in df.columns else df.withColumn("fingerprint", fingerprint(df))


def joined(state: DataFrame, batch: DataFrame) -> DataFrame:
    """batch beside the state's row of the same key: columns old_* and new_*. A state that keeps its fingerprints isn't hashed again."""
    kept = printed(state)
    old = kept.select(*(F.col(c).alias(c if c in KEY else f"old_{c}") for c in kept.columns), F.lit(True).alias("known"))
    new = batch.withColumn("fingerprint", fingerprint(batch)).select(*(F.col(c).alias(c if c in KEY else f"new_{c}") for c in [*batch.columns, "fingerprint"]))
    return new.join(old, KEY, "left")


def outcome() -> Column:
    """NEW, UNCHANGED or UPDATED, as runs count them."""
    return F.when(F.col("known").isNull(), "NEW").when(F.col("old_fingerprint") == F.col("new_fingerprint"), "UNCHANGED").otherwise("UPDATED")


def event_type() -> Column:
    moved = ~F.col("old_status").eqNullSafe(F.col("new_status"))
    ends = F.col("new_status").isin("CLOSED", "AWARDED", "EXPIRED")
    return F.when(F.col("known").isNull(), "NEW").when(moved & ends, F.col("new_status")).otherwise("UPDATED")


def changes(kinds: dict[str, str]) -> Column:
    """Array of (field, old, new, significance) of the fields that differ; empty and null are equal."""

    def one(name: str, level: str) -> Column:
        old, new = (as_text(f"{side}_{name}", kinds[f"new_{name}"]) for side in ("old", "new"))
        differs = ~F.nullif(old, F.lit("")).eqNullSafe(F.nullif(new, F.lit("")))
        return F.when(differs, F.struct(F.lit(name).alias("field"), old.alias("old"), new.alias("new"), F.lit(level).alias("significance")))

    return F.array_compact(F.array(*(one(n, s) for n, s in SIGNIFICANCE.items() if f"new_{n}" in kinds)))


def classified(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Every row of the batch with its outcome, event type (null if unchanged) and changes."""
    both = joined(state, batch)
    told = both.select("*", outcome().alias("outcome"), event_type().alias("kind"), changes(dict(both.dtypes)).alias("changes"))
    same = F.col("outcome") == "UNCHANGED"
    return told.withColumn("event", F.when(~same, F.col("kind"))).withColumn("changes", F.when((F.col("outcome") == "UPDATED"), F.col("changes")).otherwise(F.array_except("changes", "changes"))).drop("kind")


def summary_of(changes: Column) -> Column:
    """A line on an array of changes: the move of the status, else the fields of high significance; without any of these the first three of medium, without these how many minor ones."""
    fields = lambda level: F.transform(F.filter(changes, lambda c: c["significance"] == level), lambda c: c["field"])
    high, medium, low = (fields(level) for level in ("high", "medium", "low"))
    status = F.filter(changes, lambda c: c["field"] == "status")
    side = lambda name: F.coalesce(status[0][name], F.lit("None"))
    return (
        F.when(F.size(changes) == 0, "No changes")
        .when(F.size(status) > 0, F.concat(F.lit("Status: "), side("old"), F.lit(" \u2192 "), side("new")))
        .when(F.size(high) > 0, F.concat(F.lit("Changed: "), F.array_join(high, ", ")))
        .when(F.size(medium) > 0, F.concat(F.lit("Updated: "), F.array_join(F.slice(medium, 1, 3), ", ")))
        .otherwise(F.concat(F.size(low).cast("string"), F.lit(" minor field(s) updated")))
    )


def events_of(classes: DataFrame) -> DataFrame:
    """The rows to append to the event log."""
    summary = F.when(F.col("outcome") == "NEW", "New opportunity").when(F.col("outcome") == "UPDATED", summary_of(F.col("changes"))).otherwise("")
    return classes.where("event is not null").select(*KEY, F.col("event").alias("event_type"), F.size("changes").cast("long").alias("n_changes"), F.array_join(F.transform("changes", lambda c: c["field"]), ",").alias("fields"), F.exists("changes", lambda c: c["significance"] == "high").alias("significant"), summary.alias("summary"))


def field_changes(classes: DataFrame) -> DataFrame:
    return classes.where("event is not null").select(*KEY, F.explode("changes").alias("c")).select(*KEY, "c.field", F.col("c.old").alias("old_value"), F.col("c.new").alias("new_value"), "c.significance")


def missed(classes_of_all: DataFrame) -> DataFrame:
    """Rows whose fingerprints agree though a field outside it changed."""
    both = classes_of_all
    return both.where("outcome = 'UNCHANGED'").where(~F.col("old_contact_name").eqNullSafe(F.col("new_contact_name"))).select(*KEY, F.col("old_contact_name").alias("old_value"), F.col("new_contact_name").alias("new_value"))


def upserted(state: DataFrame, batch: DataFrame, seen_at: Column | None = None) -> DataFrame:
    """The state after the batch: rows with an equal fingerprint stay as they are.

    With seen_at, all rows that are in the batch get it as last_seen_at, unless the batch tells one of its own.
    """
    names = [c for c in state.columns if c != "fingerprint"]
    old = printed(state).select(*KEY, F.struct(*names, "fingerprint").alias("old"))
    told = batch if seen_at is None or "last_seen_at" in batch.columns else batch.withColumn("last_seen_at", seen_at)
    new = told.withColumn("fingerprint", fingerprint(batch)).select(*KEY, F.struct(*names, "fingerprint").alias("new"))
    both = old.join(new, KEY, "full")
    keep = F.col("new").isNull() | (F.col("old.fingerprint") == F.col("new.fingerprint"))
    rows = both.select(F.when(F.coalesce(keep, F.lit(False)), F.col("old")).otherwise(F.col("new")).alias("row"), F.col("new").alias("seen"))
    names = [c for c in [*names, "fingerprint"] if seen_at is None or c != "last_seen_at"]
    last = [] if seen_at is None else [F.coalesce("seen.last_seen_at", "row.last_seen_at").alias("last_seen_at")]
    return rows.select(*(f"row.{c}" for c in names), *last)


def disappeared(state: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Events for open rows that no run has seen for so many days."""
    return state.where((F.col("last_seen_at") < as_of - F.make_dt_interval(F.lit(days))) & (F.col("status") == "OPEN")).select(*KEY, F.lit("EXPIRED").alias("event_type"), "last_seen_at")


def diff_list(classes: DataFrame) -> DataFrame:
    """Diffs as JSON: what changed, both fingerprints, significance."""
    high = F.exists("changes", lambda c: c["significance"] == "high")
    body = F.struct("changes", F.col("old_fingerprint"), F.col("new_fingerprint"), high.alias("is_significant"))
    return classes.where("outcome = 'UPDATED'").select(*KEY, F.to_json(body, {"ignoreNullFields": "false"}).alias("diff"))


def diff_map(classes: DataFrame) -> DataFrame:
    """Diffs as JSON: each field with its old and new value."""
    pairs = F.map_from_entries(F.transform("changes", lambda c: F.struct(c["field"], F.struct(c["old"].alias("old"), c["new"].alias("new")))))
    return classes.where("outcome = 'UPDATED'").select(*KEY, F.to_json(pairs, {"ignoreNullFields": "false"}).alias("diff"))


def shown_keys(diff: Column, most: int = 3) -> Column:
    """The first keys of a diff, and how many more there are."""
    keys = F.json_object_keys(diff)
    return F.concat(F.array_join(F.slice(keys, 1, most), ", "), F.when(F.size(keys) > most, F.concat(F.lit(" (+"), (F.size(keys) - most).cast("string"), F.lit(")"))).otherwise(""))


def run_counters(classes: DataFrame) -> DataFrame:
    """Per portal what a run reports: closed and awarded ones count as updated."""
    count = lambda o: F.count_if(F.col("outcome") == o)
    return classes.groupBy("portal_id").agg(F.count("*").alias("found"), count("NEW").alias("new"), count("UPDATED").alias("updated"), count("UNCHANGED").alias("unchanged"))


def insert_if_absent(state: DataFrame, batch: DataFrame) -> DataFrame:
    return batch.join(state, KEY, "left_anti")


def _tracked(both: DataFrame) -> list[tuple[str, Column, Column]]:
    """(field, its new value, whether it differs) of the tracked fields of joined rows: by value, dates to the minute; a field that the batch lacks counts as null."""
    kinds = dict(both.dtypes)
    coarse = lambda c, name: F.date_trunc("MINUTE", c) if kinds[f"old_{name}"].startswith("timestamp") else c
    new = lambda name: F.col(f"new_{name}") if f"new_{name}" in kinds else F.lit(None).cast(kinds[f"old_{name}"])
    return [(c, new(c), ~coarse(F.col(f"old_{c}"), c).eqNullSafe(coarse(new(c), c))) for c in TRACKED if f"old_{c}" in kinds]


def repo_changes(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Tracked fields that differ, whatever the fingerprints say."""
    both = joined(state, batch).where("known")
    fields = F.array_sort(F.array_compact(F.array(*(F.when(differs, F.lit(c)) for c, _, differs in _tracked(both)))))
    return both.select(*KEY, fields.alias("f")).where(F.size("f") > 0).select(*KEY, F.array_join("f", ",").alias("fields"), F.concat(F.lit("Updated "), F.size("f").cast("string"), F.lit(" field(s)")).alias("message"))


def repo_upserted(state: DataFrame, batch: DataFrame, seen_at: Column | None = None) -> DataFrame:
    """The state after a keyed store has taken the batch: of known rows the tracked fields that differ change, and nothing else.

    raw_data and the fingerprint follow where a field has changed; last_seen_at becomes seen_at for all rows of the
    batch. New rows take the columns that the state has. Columns of the batch that the state lacks are ignored.
    """
    mine, told = printed(state), printed(batch)
    old = mine.select(*KEY, *(F.col(c).alias(f"old_{c}") for c in mine.columns if c not in KEY), F.lit(True).alias("known"))
    new = told.select(*KEY, *(F.col(c).alias(f"new_{c}") for c in told.columns if c not in KEY), F.lit(True).alias("told"))
    both = old.join(new, KEY, "full")
    tracked = {c: (value, differs) for c, value, differs in _tracked(both)}
    changed = F.lit(False)
    for _, differs in tracked.values():
        changed = changed | differs
    here, fresh = F.col("known").isNotNull() & F.col("told").isNotNull(), F.col("known").isNull()

    def column(c: str) -> Column:
        given = F.col(f"new_{c}") if c in told.columns else F.lit(None).cast(dict(mine.dtypes)[c])
        if c == "last_seen_at" and seen_at is not None:
            return F.when(F.col("told").isNotNull(), seen_at).otherwise(F.col("old_last_seen_at"))
        follows = here & tracked[c][1] if c in tracked else here & changed if c in ("fingerprint", "raw_data") and c in told.columns else F.lit(False)
        return F.when(fresh | follows, given).otherwise(F.col(f"old_{c}"))

    return both.select(*KEY, *(column(c).alias(c) for c in mine.columns if c not in KEY))


def repo_events(state: DataFrame, batch: DataFrame) -> DataFrame:
    """What a keyed store logs of the batch: new rows, and rows of which tracked fields changed."""
    fresh = batch.join(state, KEY, "left_anti").select(*KEY, F.lit("NEW").alias("event_type"), F.lit("Opportunity discovered").alias("message"))
    return fresh.unionByName(repo_changes(state, batch).select(*KEY, F.lit("UPDATED").alias("event_type"), "message"))


def cascade_delete(portals: DataFrame, opportunities: DataFrame, runs: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the portals that meet gone: their opportunities go, their runs lose the portal."""
    left = portals.where(~gone)
    kept = opportunities.join(left.select("portal_id"), "portal_id", "left_semi")
    known = left.select(F.col("portal_id").alias("known"))
    nulled = runs.join(known, F.col("portal_id") == F.col("known"), "left").withColumn("portal_id", F.col("known")).drop("known")
    return left, kept, nulled
