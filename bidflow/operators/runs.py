"""Runs, jobs, locks and portals as small tables that updates are joined to."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidflow.functions.text import bound
from bidflow.operators.schedule import minutes_of

COUNTERS = ["pages_scraped", "pages_failed", "opportunities_found", "opportunities_new", "opportunities_updated", "errors_count"]


def with_stats(runs: DataFrame, stats: DataFrame) -> DataFrame:
    """runs with the counters of stats (run_id, some counters) added; a run without stats stays, stats without a run are ignored."""
    names = [c for c in COUNTERS if c in stats.columns]
    more = stats.groupBy("run_id").agg(*(F.sum(c).alias(f"__{c}") for c in names))
    return runs.join(more, "run_id", "left").select(*((F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) if c in names else F.col(c) for c in runs.columns))


def completed(runs: DataFrame, ends: DataFrame) -> DataFrame:
    """runs after ends (run_id, finished_at, error): FAILED with an error, else COMPLETED; finished runs and unknown ids stay as they are."""
    told = ends.select("run_id", F.col("finished_at").alias("__at"), F.col("error").alias("__error"), F.lit(True).alias("__ends"))
    ends_now = F.col("__ends").isNotNull() & (F.col("status") == "RUNNING")
    new = {"status": F.when(ends_now, F.when(F.col("__error").isNull(), "COMPLETED").otherwise("FAILED")).otherwise(F.col("status")), "finished_at": F.when(ends_now, F.col("__at")).otherwise(F.col("finished_at")), "error_message": F.when(ends_now, F.col("__error")).otherwise(F.col("error_message"))}
    return runs.join(told, "run_id", "left").withColumns(new).select(*runs.columns)


def with_checkpoints(runs: DataFrame, saved: DataFrame) -> DataFrame:
    """runs with the checkpoints of saved (run_id, checkpoint)."""
    return runs.join(saved.withColumnRenamed("checkpoint", "__new"), "run_id", "left").withColumn("checkpoint", F.coalesce("__new", "checkpoint")).select(*runs.columns)


def strict_lock(holder: Column, expires: Column, now: Column) -> Column:
    """A lock that refuses its own holder too while it is valid."""
    return F.when(holder.isNull(), "acquired").when(expires <= now, "taken over").otherwise("refused")


def extended(expires: Column, holder: Column, wanted_by: Column, now: Column, seconds: Column) -> Column:
    """The new end of a lock that its holder extends while it is valid; null: refused."""
    return F.when((holder == wanted_by) & (expires > now), now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds))


def switched(portals: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """portals after wanted (portal_name, enabled), and the names that there are none of."""
    told = wanted.select("portal_name", F.col("enabled").alias("__to"))
    return portals.join(told, "portal_name", "left").withColumn("enabled", F.coalesce("__to", "enabled")).select(*portals.columns), wanted.join(portals, "portal_name", "left_anti").select("portal_name")


def job_status(jobs: DataFrame, finished: DataFrame) -> DataFrame:
    """jobs with the time and status of their last finished run (job_id, finished_at, status)."""
    last = finished.groupBy("job_id").agg(F.max(F.struct("finished_at", "status")).alias("l")).select("job_id", F.col("l.finished_at").alias("__at"), F.col("l.status").alias("__status"))
    return jobs.join(last, "job_id", "left").withColumns({"last_run_at": F.coalesce("__at", "last_run_at"), "last_status": F.coalesce("__status", "last_status")}).select(*jobs.columns)


def job_faults(jobs: DataFrame, known: DataFrame) -> Column:
    """Array of what is wrong with jobs to add (name, daily, weekday, hourly, cron): one schedule exactly, a new name, a time of day."""
    given = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("daily", "weekday", "hourly", "cron")), F.lit(0))
    clock = F.coalesce("daily", "weekday")
    return F.array_compact(F.array(F.when(given != 1, F.lit("exactly one schedule")), F.when(F.col("name_taken"), F.lit("name is taken")), F.when(clock.isNotNull() & minutes_of(clock).isNull(), F.lit("no time of day"))))


def blacked_out(now: Column, start: Column, end: Column) -> Column:
    """Whether the time of day lies in a window of HH:MM, which may pass midnight."""
    at, a, b = F.hour(now) * 60 + F.minute(now), minutes_of(start), minutes_of(end)
    return F.when(a.isNull() | b.isNull(), False).when(a <= b, (at >= a) & (at < b)).otherwise((at >= a) | (at < b))


def _cron_spans(field: Column, low: int) -> Column:
    """What a field names, as an array of first, last and step: ``*``, numbers, ranges, steps and lists of them."""

    def span(part: Column) -> Column:
        step = F.coalesce(F.regexp_extract(part, r"/(\d+)$", 1).try_cast("int"), F.lit(1))
        first = F.coalesce(F.regexp_extract(part, r"^(\d+)", 1).try_cast("int"), F.lit(low))
        last = F.when(part.startswith("*") | F.contains(part, F.lit("/")) & ~F.contains(part, F.lit("-")), F.lit(9999)).otherwise(F.coalesce(F.regexp_extract(part, r"-(\d+)", 1).try_cast("int"), first))
        return F.struct(first.alias("first"), last.alias("last"), step.alias("step"))

    return F.transform(F.split(field, ","), span)


#: Years in which any date of the calendar falls on any weekday at least once: 29 February meets one again after 40 at most.
CYCLE = 40
#: Bits of every so many values, from 0 to 59, by the step.
_STEPS = [sum(1 << k for k in range(0, 60, step)) for step in range(1, 61)]
#: Repeats the bits of a week over six weeks.
_WEEKS = sum(1 << 7 * k for k in range(6))


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", _long(1), n.cast("int"))


def _has(values: Column, n: Column) -> Column:
    return values.bitwiseAND(_bit(n)) != 0


def _least(values: Column) -> Column:
    """The least value of a set of bits; null if there is none."""
    return F.when(values != 0, F.bit_count(values.bitwiseAND(-values) - 1))


def _above(n: Column) -> Column:
    """The bits of all values above one."""
    return -_bit(n + 1)


def _cron_values(field: Column, low: int, high: int) -> Column:
    """The values that a field names, from low to high, as bits."""

    def named(span: Column) -> Column:
        first, last = span["first"], F.least(span["last"], F.lit(high))
        every = F.get(F.array(*map(_long, _STEPS)), F.least(span["step"], F.lit(60)) - 1)
        fitting = F.call_function("shiftleft", every, first).bitwiseAND(_bit(last + 1) - _bit(F.greatest(first, F.lit(low))))
        return F.when((first <= last) & (last >= low), fitting)

    return F.aggregate(_cron_spans(field, low), _long(0), lambda found, span: found.bitwiseOR(F.coalesce(named(span), _long(0))))


def _cron_bits(field: str, low: int, high: int) -> int:
    """_cron_values of a field that is known beforehand."""
    found = 0
    number = lambda pattern, part: next((int(n) for n in re.findall(pattern, part) if int(n) < 2**31), None)
    for part in field.split(","):
        step, first, last = (number(p, part) for p in (r"/([0-9]+)$", r"^([0-9]+)", r"-([0-9]+)"))
        first = low if first is None else first
        last = high if part.startswith("*") or "/" in part and "-" not in part else first if last is None else last
        if step != 0:
            found |= sum(1 << value for value in range(low, high + 1) if first <= value <= last and (value - first) % (step or 1) == 0)
    return found


def _next_day(after: Column, months: Column, days: Column, weekdays: Column) -> Column:
    """The first date after a date whose month, day and weekday are among the given ones (bits); months are tried in turn, the days of one all at once."""

    def of(k: Column) -> Column:
        def in_month(month: Column, least: Column) -> Column:
            """month counts from January of the date's year."""
            of_first = lambda first: bound(days.bitwiseAND(F.call_function("shiftleft", F.call_function("shiftright", k["weeks"], F.dayofweek(first) - 1), F.lit(1))).bitwiseAND(_bit(F.dayofmonth(F.last_day(first)) + 1) - 2).bitwiseAND(least), lambda fit: F.date_add(first, _least(fit) - 1))
            return F.when(_has(months, month % 12 + 1), bound(F.make_date(k["year"] + F.floor(month / 12).cast("int"), month % 12 + 1, F.lit(1)), of_first))

        every = _long(-1)
        later = F.aggregate(F.sequence(k["month"] + 2, F.lit(CYCLE * 12 + 11)), F.lit(None).cast("date"), lambda found, month: F.coalesce(found, in_month(month, every)))
        return F.coalesce(in_month(k["month"], _above(F.dayofmonth(after))), in_month(k["month"] + 1, every), later)

    return bound(F.struct(F.year(after).alias("year"), (F.month(after) - 1).alias("month"), (weekdays * _long(_WEEKS)).alias("weeks")), of)


def next_cron(expression: Column | str, now: Column) -> Column:
    """The next minute after now that a cron expression (minute, hour, day, month, weekday with 0 for Sunday) fits, however far off.

    Null: there is none (30 February), or the expression isn't one. One expression for all rows, told as text, is read here and not row by row.
    """
    fields = (("minutes", 0, 59), ("hours", 0, 23), ("days", 1, 31), ("months", 1, 12), ("weekdays", 0, 6))

    def of(part: Column) -> Column:
        """The values that fit each field are found once, as bits."""
        return bound(F.struct(*(_cron_values(F.get(part, F.lit(i)), low, high).alias(name) for i, (name, low, high) in enumerate(fields)), F.to_date(now).alias("today")), at)

    def at(fit: Column) -> Column:
        minutes, hours, days, months, weekdays = (fit[n] for n in ("minutes", "hours", "days", "months", "weekdays"))
        today = fit["today"]
        fits_today = _has(months, F.month(today)) & _has(days, F.dayofmonth(today)) & _has(weekdays, F.dayofweek(today) - 1)
        later = lambda values, than: _least(values.bitwiseAND(_above(than)))
        first = _least(minutes)
        this_hour = F.when(_has(hours, F.hour(now)), F.hour(now) * 60 + later(minutes, F.minute(now)))
        here = F.when(fits_today, F.coalesce(this_hour, later(hours, F.hour(now)) * 60 + first))
        minute_of = lambda start, m: start.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), m)
        return F.coalesce(minute_of(today, here), minute_of(_next_day(today, months, days, weekdays), _least(hours) * 60 + first))

    if isinstance(expression, str):
        told = [*expression.split(), *[None] * len(fields)]
        values = (F.lit(None if t is None else _cron_bits(t, low, high)).cast("long").alias(name) for t, (name, low, high) in zip(told, fields))
        return bound(F.struct(*values, F.to_date(now).alias("today")), at)
    return bound(F.split(F.trim(expression), r"\s+"), of)


def portal_names(given: Column) -> Column:
    """Names in a list as JSON, in an object's ``portals``, or parted by commas."""
    many = F.coalesce(F.from_json(F.when(given.startswith("["), given), "array<string>"), F.from_json(F.get_json_object(F.when(given.startswith("{"), given), "$.portals"), "array<string>"), F.split(F.when(~given.rlike(r"^[\[{]"), given), ","))
    return F.filter(F.transform(many, lambda x: F.trim(x)), lambda x: x != "")


def backend_of(portal_type: Column, preferred: Column) -> Column:
    return F.when((preferred == "playwright") | (portal_type == "search_form"), "playwright").otherwise("http")


def plugin_of(portal_type: Column, backend: Column) -> Column:
    """The plug-in by the portal's type; a search form needs a browser (null: it can't be run)."""
    return F.when(portal_type == "search_form", F.when(backend == "playwright", "search_form")).otherwise("generic_table")


def backoff(delay: Column, factor: Column, attempt: Column, most: Column) -> Column:
    """Seconds before an attempt (from 1): they grow by the factor, up to the most."""
    return F.least(most, delay * F.pow(factor, attempt - 1))


def jitter(low_ms: int, high_ms: int, seed: int) -> Column:
    return F.floor(F.rand(seed) * (high_ms - low_ms + 1) + low_ms) / 1000


def jobs_after(jobs: DataFrame, commands: DataFrame) -> DataFrame:
    """jobs (name, enabled, portals) after commands (name, action, portals), one a name: add (if the name is new; no portals: all), pause, resume, delete; what names no job is ignored."""
    told = commands.select("name", F.col("action").alias("__action"), F.col("portals").alias("__portals"))
    both = jobs.withColumn("__known", F.lit(True)).join(told, "name", "full")
    known, action = F.col("__known").isNotNull(), F.col("__action")
    kept = both.where((known & F.coalesce(action != "delete", F.lit(True))) | (~known & (action == "add")))
    enabled = F.when(~known, True).when(action == "pause", False).when(action == "resume", True).otherwise(F.col("enabled"))
    return kept.select("name", enabled.alias("enabled"), F.when(known, F.col("portals")).otherwise(F.coalesce("__portals", F.lit(""))).alias("portals"))


def page_snapshots(pages: DataFrame, records: DataFrame, at: Column, least: float = 0.4) -> DataFrame:
    """Rows to keep of pages (page_id, url) whose records (page_id, confidence) are missing or not sure enough, with the reason."""
    sure = records.groupBy("page_id").agg(F.max("confidence").alias("extraction_confidence"))
    reason = F.when(F.col("extraction_confidence").isNull(), "no_records").when(F.col("extraction_confidence") < least, "low_confidence")
    return pages.select("page_id", "url").join(sure, "page_id", "left").withColumn("reason", reason).where("reason is not null").select("page_id", "url", "reason", "extraction_confidence", at.alias("created_at"))
