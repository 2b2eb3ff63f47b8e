"""Run history: pages of runs, their intervals and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namelode.operators.records import page_bounds


def duration_text(micros: Column) -> Column:
    """A length of time above 0 as hours, minutes and seconds: 26h0m3.5s, 2m0s, 350ms."""
    us = micros.cast("bigint")
    part = lambda n: F.call_function("div", us, F.lit(n).cast("bigint"))
    hours, minutes, rest = part(3_600_000_000), part(60_000_000) % 60, us % 60_000_000

    def decimal(value: Column, unit: int, digits: int) -> Column:
        tail = F.rtrim(F.lpad((value % unit).cast("string"), digits, "0"), F.lit("0"))
        return F.concat(F.call_function("div", value, F.lit(unit).cast("bigint")).cast("string"), F.when(tail == "", "").otherwise(F.concat(F.lit("."), tail)))

    long = F.concat(
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"))).otherwise(""),
        F.when((hours > 0) | (minutes > 0), F.concat(minutes.cast("string"), F.lit("m"))).otherwise(""),
        decimal(rest, 1_000_000, 6),
        F.lit("s"),
    )
    short = F.when(us >= 1000, F.concat(decimal(us, 1000, 3), F.lit("ms"))).otherwise(F.concat(us.cast("string"), F.lit("µs")))
    return F.when(us >= 1_000_000, long).otherwise(short)


def run_page(runs: DataFrame, page: int = 1, per_page: int = 25) -> DataFrame:
    """A page of runs, latest first, with the time since the run before it on the page as hours and as text, and the number of all runs.

    The last run of a page, and one not later than the next, has no interval.
    """
    offset, limit = page_bounds(page, per_page)
    chosen = runs.orderBy(F.desc("started_at"), F.desc("id")).offset(offset).limit(limit)
    # the page is at most 100 rows
    latest = Window.orderBy(F.desc("started_at"), F.desc("id"))
    at = lambda c: F.unix_micros(c.cast("timestamp"))
    micros = at(F.col("started_at")) - at(F.lead("started_at").over(latest))
    timed = chosen.withColumn("interval_hours", F.when(micros > 0, F.round(micros / 3_600_000_000, 2))).withColumn("interval", F.when(micros > 0, duration_text(micros)))
    return timed.join(F.broadcast(runs.agg(F.count("*").alias("total"))))


def run_changes(changes: DataFrame) -> DataFrame:
    """Changes of records without added_inactive, in order of run, change and type."""
    return changes.filter("entity = 'sanctions_record' and change_type not in ('added_inactive')").orderBy(
        "run_id", "change_type", "record_type"
    )


def affected(changes: DataFrame) -> DataFrame:
    """(run_id, total_records_affected): the sum of the counts of each run's changes."""
    return run_changes(changes).groupBy("run_id").agg(F.sum("count").alias("total_records_affected"))


def record_changes(events: DataFrame, limit: int = 100) -> DataFrame:
    """The first events of each run by id: 100, or as many as asked for up to 500."""
    limit = 100 if limit < 1 else min(limit, 500)
    at = F.row_number().over(Window.partitionBy("run_id").orderBy("id"))
    return events.withColumn("n", at).filter(F.col("n") <= limit).drop("n")


def run_row(run_id: int, started_at, completed_at=None, status: str = "running", error: str | None = None) -> dict:
    """A row of the run history: running, completed or failed, with its duration in milliseconds."""
    duration = None if completed_at is None else int((completed_at - started_at).total_seconds() * 1000)
    return {"id": run_id, "started_at": started_at, "completed_at": completed_at, "status": status, "duration_ms": duration, "error": error}
