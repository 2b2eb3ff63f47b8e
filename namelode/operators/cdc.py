"""Feed loads against the stored records: what changed, and the new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namelode.operators.records import display_name
from namelode.session import nullif_empty, trimmed

#: The most change events that a run keeps, in order of record and change.
EVENT_LIMIT = 50_000
#: Columns of a record that a feed sets.
RECORD_FIELDS = ("record_type", "action", "action_date", "gender", "active_status", "deceased", "profile_notes")


def is_active(status: Column) -> Column:
    """Whether a status means active, case and outer white space aside."""
    return F.lower(trimmed(F.coalesce(status, F.lit("")))) == "active"


def is_complete_feed(scope: str, declared: int, incoming: int, existing: int) -> bool:
    """Whether a feed may remove the records that it lacks: labelled full and, of large stocks, nearly as large."""
    if scope.strip().lower() != "full":
        return False
    if existing > 10_000:
        floor = existing * 9 // 10
        return incoming >= floor and (declared <= 0 or declared >= floor)
    return True


def official_records(records: DataFrame) -> DataFrame:
    """(id, record_type, active_status) of records of no custom list, null text as ''."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return records.filter("custom_list_id is null").select("id", text("record_type"), text("active_status"))


def matched(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows beside the stored ones (full outer): ``e`` and ``i``; the first of repeated incoming ids.

    Rows without an id are skipped. Repeated rows meet by aggregation before the join.
    """
    fields = [c for c in incoming.columns if c not in ("id", "seq")]
    order = "seq" if "seq" in incoming.columns else F.struct(*fields)
    new = incoming.filter("id is not null").groupBy("id").agg(F.min_by(F.struct(*fields), order).alias("i"))
    old = existing.select("id", F.struct("record_type", "active_status").alias("e"))
    return old.join(new, "id", "full_outer")


def change_events(both: DataFrame, complete: bool) -> DataFrame:
    """(record_id, change_type, record_type): every change that the rows of ``matched`` make.

    New records are added (and added_inactive), others reactivated or inactivated by their status; a complete
    feed also removes the records that it lacks, each time anew, and inactivates those that were active. The
    type is the incoming one, that of removed records the stored one.
    """
    new, gone = F.col("e").isNull(), F.col("i").isNull()
    now, before = is_active(F.col("i.active_status")), is_active(F.col("e.active_status"))
    changes = (
        F.when(new & now, F.array(F.lit("added")))
        .when(new, F.array(F.lit("added"), F.lit("added_inactive")))
        .when(gone & before, F.array(F.lit("removed_from_feed"), F.lit("inactivated")))
        .when(gone, F.array(F.lit("removed_from_feed")))
        .when(now & ~before, F.array(F.lit("reactivated")))
        .when(before & ~now, F.array(F.lit("inactivated")))
    )
    rows = both if complete else both.filter(~gone)
    kind = F.when(gone, F.col("e.record_type")).otherwise(F.col("i.record_type"))
    return rows.select(F.col("id").alias("record_id"), kind.alias("record_type"), F.explode(changes).alias("change_type"))


def change_counts(events: DataFrame) -> DataFrame:
    """(change_type, entity, record_type, count) of the events; a record_type of '' is NULL."""
    return events.groupBy("change_type", nullif_empty(F.col("record_type")).alias("record_type")).agg(F.count("*").alias("count")).select(
        "change_type", F.lit("sanctions_record").alias("entity"), "record_type", "count"
    )


def kept_events(events: DataFrame, limit: int = EVENT_LIMIT) -> DataFrame:
    """The events that a run stores: none of added_inactive, the first ``limit`` by record and change."""
    return events.filter("change_type <> 'added_inactive'").orderBy("record_id", "change_type").limit(limit)


def needs_update() -> Column:
    """Of rows of ``matched``: whether a stored record is rewritten: its status text differs, or it is active and the row deletes it."""
    differs = F.coalesce(F.col("e.active_status"), F.lit("")) != F.coalesce(F.col("i.active_status"), F.lit(""))
    deletes = is_active(F.col("e.active_status")) & (F.coalesce(F.col("i.action"), F.lit("")) == "del")
    return F.col("e").isNotNull() & F.col("i").isNotNull() & (differs | deletes)


def applied(records: DataFrame, incoming: DataFrame, complete: bool, today: Column | None = None) -> DataFrame:
    """The records after a load: new ones added, those that need it rewritten whole, missing ones inactive.

    Records of custom lists stay as they are. Null fields of a row that rewrites a record become null.
    """
    today = F.date_format(F.current_date(), "yyyy-MM-dd") if today is None else today
    own = records.filter("custom_list_id is null")
    both = matched(official_records(records), incoming)
    both = both.withColumn("rewrite", needs_update() | F.col("e").isNull())
    stored = own.select("id", F.struct(*RECORD_FIELDS).alias("s"))
    rows = both.join(stored, "id", "left")
    removed = F.col("i").isNull() & F.lit(complete)

    def value(name: str) -> Column:
        col = F.when(F.col("rewrite"), F.col(f"i.{name}")).otherwise(F.col(f"s.{name}"))
        fixed = {"active_status": F.lit("Inactive"), "action": F.lit("del"), "action_date": today}.get(name)
        return (col if fixed is None else F.when(removed, fixed).otherwise(col)).alias(name)

    official = rows.select("id", *(value(n) for n in RECORD_FIELDS), F.lit(None).cast("bigint").alias("custom_list_id"))
    custom = records.filter("custom_list_id is not null").select("id", *RECORD_FIELDS, "custom_list_id")
    return official.unionByName(custom)


def upserted(existing: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``existing`` with the rows of ``incoming`` in place of those with their key, and new ones added.

    Of repeated incoming keys the one with the greatest ``seq`` holds (or, without it, the greatest row); null keys
    are skipped. Both sides are narrowed to ``key`` and ``columns``.
    """
    order = "seq" if "seq" in incoming.columns else F.struct(*columns)
    new = incoming.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("n"))
    old = existing.select(key, F.struct(*columns).alias("o"))
    row = F.coalesce("n", "o")
    return old.join(new, key, "full_outer").select(key, row.alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in columns))


def appended(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` and the rows of ``incoming`` whose keys are new; keys with a null never conflict."""
    whole = [F.col(k).isNotNull() for k in keys]
    complete = whole[0]
    for w in whole[1:]:
        complete = complete & w
    first = incoming.filter(complete).dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(first.select(*existing.columns)).unionByName(incoming.filter(~complete).select(*existing.columns))


#: Name types in the order in which a record is named by them; all others come first.
NAMED_BY = ("Primary Name", "Also Known As", "Spelling Variation")


def event_details(events: DataFrame, names: DataFrame, dates: DataFrame, countries: DataFrame, ref_countries: DataFrame) -> DataFrame:
    """Events with display_name, date_of_birth and countries (JSON) of their records.

    The name is the first that is not empty by type and id, the date the first birth date that is not empty
    by id, its parts joined by '-'; countries are listed by id with their names, or their codes without one.
    """
    own = events.select("record_id").distinct()
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, NAMED_BY)), F.col("name_type")), F.lit(0))
    shown = names.join(own, "record_id", "left_semi").withColumn("shown", trimmed(display_name()))
    named = shown.filter("shown <> ''").groupBy("record_id").agg(F.min_by("shown", F.struct(rank, "id")).alias("display_name"))
    dob = F.concat_ws("-", nullif_empty(F.col("year")), nullif_empty(F.col("month")), nullif_empty(F.col("day")))
    born = dates.filter(F.lower("date_type").contains("birth")).join(own, "record_id", "left_semi").withColumn("dob", dob)
    born = born.filter("dob <> ''").groupBy("record_id").agg(F.min_by("dob", "id").alias("date_of_birth"))
    listed = ref_countries.select(F.col("code").alias("country_code"), F.col("name").alias("listed"))
    lands = countries.join(own, "record_id", "left_semi").join(listed, "country_code", "left")
    one = F.struct("id", F.coalesce("country_type", F.lit("")).alias("type"), F.coalesce("country_code", F.lit("")).alias("code"),
                   F.coalesce("listed", "country_code", F.lit("")).alias("name"))
    lands = lands.groupBy("record_id").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda c: c.dropFields("id"))).alias("countries_json")
    )
    return events.join(named, "record_id", "left").join(born, "record_id", "left").join(lands, "record_id", "left")


def with_ids(rows: DataFrame, order: list[str], after: int) -> DataFrame:
    """``rows`` with dense ids counting on from ``after`` in the given order.

    Rows are sorted by range over all tasks and numbered within each; only the sizes of the ranges are summed up.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    placed = placed.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("bigint"), 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn("id", F.col("_start") + F.col("_at") + 1 + after).drop("_part", "_at", "_start")
