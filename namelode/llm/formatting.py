"""Records that differ only in formatting, collapsed with the number of their copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words: blanks and punctuation.
SEPARATOR = r"(?U)[\s\p{Z}\p{P}]+"
#: Joins raw fields; it occurs in no field that a person typed.
UNIT, ITEM, NONE = "\u001f", "\u001e", "\u001d"


def name_words(*fields: Column) -> Column:
    """The words of all ``fields`` together, in lower case and sorted; repeated words are kept."""
    text = F.lower(F.concat_ws(" ", *fields))
    words = F.filter(F.split(F.regexp_replace(text, SEPARATOR, " "), " "), lambda w: w != "")
    return F.concat_ws(" ", F.array_sort(words))


def squeezed(text: Column) -> Column:
    """``text`` in lower case without blanks and punctuation."""
    return F.regexp_replace(F.lower(text), SEPARATOR, "")


def person_contents(records: DataFrame, names: DataFrame, dates: DataFrame, countries: DataFrame) -> DataFrame:
    """(record_id, raw) of each person record with a surname in its Primary Name row.

    ``raw`` holds, as they are stored, the name parts of that row (of several the one with the smallest
    id), the set of years of the Date of Birth rows and the set of country codes; nulls and '' are
    absent names and years, a code is absent if null. Sets are found by aggregation, so repeated rows,
    however many, leave one value.
    """
    people = records.filter(~(F.lower(F.trim(F.coalesce("record_type", F.lit("")))) == "entity")).select(
        F.col("id").alias("record_id")
    )
    primary = (
        names.filter((F.col("name_type") == "Primary Name") & F.col("record_id").isNotNull())
        .groupBy("record_id")
        .agg(F.min(F.struct("id", "first_name", "middle_name", "surname")).alias("p"))
        .filter(F.coalesce(F.col("p.surname"), F.lit("")) != "")
    )
    years = (
        dates.filter((F.col("date_type") == "Date of Birth") & (F.coalesce("year", F.lit("")) != ""))
        .groupBy("record_id")
        .agg(F.array_sort(F.collect_set("year")).alias("years"))
    )
    codes = (
        countries.filter(F.col("country_code").isNotNull())
        .groupBy("record_id")
        .agg(F.array_sort(F.collect_set("country_code")).alias("codes"))
    )
    name = F.concat_ws(UNIT, *(F.coalesce(F.col(f"p.{c}"), F.lit("")) for c in ("first_name", "middle_name", "surname")))

    def stored(values: str) -> Column:
        return F.coalesce(F.concat(F.lit(ITEM), F.array_join(values, ITEM)), F.lit(NONE))

    return (
        people.join(primary, "record_id")
        .join(years, "record_id", "left")
        .join(codes, "record_id", "left")
        .select("record_id", F.concat_ws(UNIT, name, stored("years"), stored("codes")).alias("raw"))
    )


def canonical(raw: Column) -> Column:
    """The content of ``raw`` without its formatting: case, blanks, punctuation, order of words and fields."""
    part = F.split(raw, UNIT)
    name = name_words(part[0], part[1], part[2])

    def plain_set(stored: Column) -> Column:
        items = F.slice(F.split(stored, ITEM), 2, 1 << 30)
        return F.when(stored == NONE, F.lit(NONE)).otherwise(
            F.concat(F.lit(ITEM), F.array_join(F.array_sort(F.array_distinct(F.transform(items, squeezed))), ITEM))
        )

    return F.concat_ws(UNIT, name, plain_set(part[3]), plain_set(part[4]))


def collapse(contents: DataFrame, salts: int = 32) -> DataFrame:
    """(record_id, keep_id, copies) of every row of ``contents`` (record_id, raw).

    Byte-identical rows are collapsed first, with their number and smallest id; only the distinct ones
    are brought to canonical form and grouped again on its full text, their numbers summed. To give
    each row the smallest id of its group, rows meet their collapsed row on the raw text and one of
    ``salts`` parts of the ids, so a text that a third of all rows share is spread over many tasks.
    """
    part = F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int")
    rows = contents.withColumn("part", part)
    distinct = rows.groupBy("raw", "part").agg(F.count("*").alias("n"), F.min("record_id").alias("first_id"))
    survivors = distinct.withColumn("content", canonical(F.col("raw")))
    groups = survivors.groupBy("content").agg(F.sum("n").alias("copies"), F.min("first_id").alias("keep_id"))
    found = survivors.select("raw", "part", "content").join(groups.filter("copies > 1"), "content")
    return rows.join(found, ["raw", "part"]).select("record_id", "keep_id", "copies")


def formatting_copies(records: DataFrame, names: DataFrame, dates: DataFrame, countries: DataFrame) -> DataFrame:
    """(keep_id, copy_id): each record that repeats the one with the smallest id in another format."""
    rows = collapse(person_contents(records, names, dates, countries))
    return rows.filter("record_id <> keep_id").select("keep_id", F.col("record_id").alias("copy_id"))


def collapsed_records(records: DataFrame, names: DataFrame, dates: DataFrame, countries: DataFrame) -> DataFrame:
    """(keep_id, copies): one row for each group of two or more records of the same content."""
    rows = collapse(person_contents(records, names, dates, countries))
    return rows.filter("record_id = keep_id").select("keep_id", "copies")
