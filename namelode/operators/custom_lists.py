"""Custom lists: upload, listing, deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namelode.functions.dates import parse_partial_date

#: An upload entry.
ENTRY = """record_type string, name string, aliases array<string>, date_of_birth string, nationality string, gender string,
    profile_notes string, id_type string, id_value string"""


def list_counts(custom_lists: DataFrame, records: DataFrame) -> DataFrame:
    """Every custom list with the number of its records, newest first; 0 for empty lists.

    Records are counted before they meet the lists, so a list that holds most of them is no hot key.
    """
    held = records.filter("custom_list_id is not null").groupBy(F.col("custom_list_id").alias("id")).agg(F.count("*").alias("record_count"))
    joined = custom_lists.join(held, "id", "left").withColumn("record_count", F.coalesce("record_count", F.lit(0)))
    return joined.orderBy(F.desc("created_at"), "id")


def has_list(custom_lists: DataFrame, list_id: int) -> bool:
    """Whether the list exists."""
    return not custom_lists.filter(F.col("id") == list_id).isEmpty()


def without_list(records: DataFrame, children: dict[str, DataFrame], list_id: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The records and their child tables without those of a deleted list; other lists stay as they are."""
    gone = records.filter(F.col("custom_list_id") == list_id).select(F.col("id").alias("record_id"))
    kept = {name: rows.join(gone, "record_id", "left_anti") for name, rows in children.items()}
    return records.filter(~F.col("custom_list_id").eqNullSafe(F.lit(list_id))), kept


def uploaded(entries: DataFrame, list_id: int, first_id: int) -> dict[str, DataFrame]:
    """The rows that an upload of ``entries`` adds: records, names, dates, countries, id_numbers.

    Record ids count from ``first_id`` in the order of ``entry_no``, a column that the upload numbers. An entry's
    name is its primary name, each alias another; organisations' names are entity names. Dates of birth are
    split into their parts, and are left out where they are none; entries without a name add nothing.
    """
    # ids must be dense and in order of entry: the position is counted within ranges of entry_no, and the ranges added up
    named = entries.filter(F.trim(F.coalesce("name", F.lit(""))) != "").withColumn("block", F.expr("entry_no div 100000"))
    sizes = named.groupBy("block").agg(F.count("*").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("block").orderBy("entry_no"))
    rows = named.withColumn("at", inside).join(starts, "block").withColumn("id", F.col("start") + F.col("at") + (first_id - 1))
    entity = F.lower(F.coalesce("record_type", F.lit(""))) == "entity"
    records = rows.select("id", F.when(entity, "Entity").otherwise("Person").alias("record_type"), F.lit("Active").alias("active_status"),
                          "gender", "profile_notes", F.lit(list_id).cast("bigint").alias("custom_list_id"))
    listed = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    names = (
        rows.select("id", entity.alias("entity"), F.posexplode(listed).alias("n", "text"))
        .filter(F.trim(F.coalesce("text", F.lit(""))) != "")
        .select(F.col("id").alias("record_id"), F.when(F.col("n") == 0, "Primary Name").otherwise("Also Known As").alias("name_type"),
                F.when(~F.col("entity"), F.col("text")).alias("single_string_name"), F.when(F.col("entity"), F.col("text")).alias("entity_name"))
    )
    born = parse_partial_date(F.col("date_of_birth"))
    text = lambda c: F.when(F.col(f"b.{c}") > 0, F.col(f"b.{c}").cast("string"))
    dates = rows.select(F.col("id").alias("record_id"), born.alias("b")).filter("b is not null").select(
        "record_id", F.lit("Date of Birth").alias("date_type"), text("d").alias("day"), text("m").alias("month"), text("y").alias("year")
    )
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    countries = rows.filter(filled("nationality")).select(
        F.col("id").alias("record_id"), F.lit("Nationality").alias("country_type"), F.col("nationality").alias("country_code")
    )
    numbers = rows.filter(filled("id_value")).select(F.col("id").alias("record_id"), "id_type", "id_value")
    return {"records": records, "names": names, "dates": dates, "countries": countries, "id_numbers": numbers}
