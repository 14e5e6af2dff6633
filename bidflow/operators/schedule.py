"""Schedules and locks as pure columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidflow.functions.text import bound


def portals_of_job(jobs: DataFrame, portals: DataFrame) -> DataFrame:
    """Each job with the portals it names (comma-separated); none named: all."""
    names = F.filter(F.transform(F.split(F.coalesce("portals", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    told = jobs.withColumn("names", names)
    known = portals.select("portal_id", "portal_name")
    named = told.withColumn("portal_name", F.explode("names")).join(known, "portal_name")
    every = told.where(F.size("names") == 0).crossJoin(known)  # the portals are the configured ones: few
    return named.select("job_id", "portal_id").unionByName(every.select("job_id", "portal_id"))


def minutes_of(time_of_day: Column) -> Column:
    """Minutes from midnight of HH:MM; null if it isn't one."""
    hour, minute = F.regexp_extract(time_of_day, r"^(\d{1,2}):(\d{1,2})$", 1).try_cast("int"), F.regexp_extract(time_of_day, r"^(\d{1,2}):(\d{1,2})$", 2).try_cast("int")
    return F.when(hour.between(0, 23) & minute.between(0, 59), hour * 60 + minute)


def next_fire(kind: Column, time_of_day: Column, every_hours: Column, now: Column) -> Column:
    """When a job fires next after now: daily, weekday (Monday to Friday) or hourly."""
    today = F.date_trunc("DAY", now).cast("timestamp_ntz")
    at = today + F.make_dt_interval(F.lit(0), F.lit(0), minutes_of(time_of_day))
    daily = F.when(at > now, at).otherwise(at + F.make_dt_interval(F.lit(1)))
    day = F.dayofweek(daily)  # 1: Sunday
    weekday = daily + F.make_dt_interval(F.when(day == 7, 2).when(day == 1, 1).otherwise(0))
    return F.when(kind == "daily", daily).when(kind == "weekday", weekday).when(kind == "hourly", now + F.make_dt_interval(F.lit(0), every_hours))


def in_zone(fires, now: Column, zone: Column, *args: Column) -> Column:
    """fires(*args, now) with now, and what it gives, in UTC, and the schedule in a zone; an hour that the zone skips or repeats counts as its first offset has it."""
    return bound(F.convert_timezone(F.lit("UTC"), zone, now), lambda local: F.convert_timezone(zone, F.lit("UTC"), fires(*args, local)))


def jittered(at: Column, most_minutes: Column, *seed: Column) -> Column:
    """at, later by up to so many minutes; the same each time for the same seed (a job's name, say) and time."""
    return at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pmod(F.xxhash64(*seed, at), F.greatest(most_minutes, F.lit(0)) * 60 + 1))


def lock_decision(holder: Column, expires: Column, wanted_by: Column, now: Column) -> Column:
    """What happens when wanted_by asks for a lock: re-entrant for its holder, expired ones are taken over."""
    return F.when(holder.isNull(), "acquired").when(expires <= now, "taken over").when(holder == wanted_by, "renewed").otherwise("refused")
